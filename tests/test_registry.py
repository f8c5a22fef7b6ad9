import duckdb
import pytest

import __spark_entry__ as contract
from checks import compare, registry

SF = "/root/testdata/sf0.001"


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) - set(registry.SQL) == set()


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0]["matches"] > 0


@pytest.mark.parametrize(
    "name", ["training_windows", "market_alignment", "timeline_faults", "ingest_runs", "import_conflicts", "current_identity"]
)
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in compare.TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert compare.check(spark, db, SF, name)
