"""Run registered queries next to their SQL and compare rows, columns and values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from checks import registry
from pitchlake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """One comparable form for both engines."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "asDict"):
        return plain(list(value))
    if isinstance(value, dict):
        return [plain(v) for v in value.values()]
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(registry.QUERIES)
    spark = local_session(8)
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    failed = 0
    for name in names:
        try:
            failed += not check(spark, db, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"{name:36} FAILED {type(error).__name__}: {str(error)[:600]}", flush=True)
    return failed


def check(spark, db, sf_dir: str, name: str) -> bool:
    started = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in registry.SQL:
        print(f"{name:36} {len(ours):8} rows  {took:6.1f}s  (no SQL)", flush=True)
        return True
    started = time.time()
    cursor = db.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    sql_took = time.time() - started
    mine, other = rows_of(df.columns, ours), rows_of(columns, theirs)
    same = sorted(df.columns) == sorted(columns) and mine == other
    print(f"{name:36} {len(ours):8} rows  {took:6.1f}s  sql {sql_took:5.1f}s  {'ok' if same else 'DIFFERENT'}", flush=True)
    if not same:
        print("   columns", sorted(set(df.columns) ^ set(columns)), len(mine), len(other))
        left, right = set(mine), set(other)
        for x in sorted(left - right)[:2]:
            print("   spark ", x[:300])
        for x in sorted(right - left)[:2]:
            print("   sql   ", x[:300])
    return same


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
