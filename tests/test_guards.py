"""Faults of ordinary input that earlier results hid."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import hashing
from pitchlake.operators import canonical as c
from pitchlake.operators import quality as q
from pitchlake.operators import resolution as rs
from pitchlake.plans import backtest as bt
from pitchlake.plans import models as m
from pitchlake.sources import ingest
from tests import brute

T0 = datetime(2020, 1, 1)


def test_a_result_before_kickoff_never_trains(spark):
    rows = brute.synthetic_matches(12)
    known_early = dict(rows[-1], match_id=10**6, result_observed_at=rows[-1]["kickoff_at"] - timedelta(days=5))
    with pytest.raises(q.RuleViolation, match="result_after_kickoff"):
        bt.walk_forward(spark.createDataFrame([*rows, known_early]), [m.PoissonModel()], [86400], min_train_matches=2)
    with pytest.raises(q.RuleViolation, match="occurrences"):
        bt.walk_forward(spark.createDataFrame([*rows, rows[0]]), [m.PoissonModel()], [86400], min_train_matches=2)
    nameless = spark.createDataFrame(rows).withColumn("home_club_id", F.when(F.col("match_id") != rows[0]["match_id"], F.col("home_club_id")))
    with pytest.raises(q.RuleViolation, match="complete"):
        bt.walk_forward(nameless, [m.PoissonModel()], [86400], min_train_matches=2)


def test_faults_name_rules_and_repeats_at_once(spark):
    rules = [q.at_least("a", 0), q.at_least("b", 0)]
    rows = [("w", 1, 1), ("x", -1, 1), ("x", 1, -1), ("y", 1, None), ("z", 1, 1), ("z", 1, 1), (None, -1, -1)]
    found = {r["k"]: (r["rule_ids"], r["occurrences"]) for r in q.faults(spark.createDataFrame(rows, "k string, a int, b int"), rules, ["k"]).collect()}
    both = ["a_minimum", "b_minimum"]
    assert found == {"x": (both, 2), "y": (["b_minimum"], 1), "z": ([], 2), None: (both, 1)}
    assert q.faults(spark.createDataFrame([], "k string, a int, b int"), rules, ["k"]).isEmpty()
    assert [r["k"] for r in q.faults(spark.createDataFrame(rows, "k string, a int, b int"), [], ["k"]).orderBy("k").collect()] == ["x", "z"]


def test_an_ended_mapping_does_not_hide_one_in_force(spark):
    kinds = "source_id string, entity_type string, external_id string, canonical_entity_id string, valid_from timestamp, valid_until timestamp, observed_at timestamp"
    mapping = spark.createDataFrame(
        [("s", "club", "1", "A", datetime(2000, 1, 1), None, T0), ("s", "club", "1", "B", datetime(2010, 1, 1), datetime(2011, 1, 1), T0)], kinds
    )
    asked = spark.createDataFrame([(y, "s", "club", "1", datetime(y, 6, 1)) for y in (1999, 2005, 2010, 2015)], "y int, source_id string, entity_type string, external_id string, as_of timestamp")
    assert {r["y"]: r["canonical_entity_id"] for r in rs.map_provider_ids(asked, mapping).collect()} == {1999: None, 2005: "A", 2010: "B", 2015: "A"}


def test_a_revision_is_bound_once(spark):
    kinds = "revision_id string, source_id string, raw_record_id string"
    incoming = spark.createDataFrame([("a", "s", "1"), ("a", "s", "1"), ("b", "s", "1"), ("b", "s", "2"), ("c", None, None), ("c", "s", "3"), ("d", None, None)], kinds)
    found = {r["revision_id"]: r["binding_action"] for r in c.bind_evidence(incoming, None).collect()}
    assert found == {"a": "fill", "b": "conflict", "c": "fill", "d": "none"} and c.bind_evidence(incoming, None).count() == 4


def test_row_texts_tell_nulls_apart(spark):
    kinds = "match_id int, home_club_id int, away_club_id int, kickoff_at timestamp, result_observed_at timestamp, home_goals int, away_goals int"
    rows = spark.createDataFrame([(1, 1, 2, T0, T0, 1, None), (1, 1, 2, T0, T0, None, 1)], kinds)
    assert rows.select(hashing.match_row_text()).distinct().count() == 2


def test_exact_lookup_returns_every_namesake(spark):
    people = spark.createDataFrame([(k, "player", "Ali Veli") for k in range(9)], "entity_id int, entity_type string, canonical_name string")
    asked = spark.createDataFrame([(1, "player", "ALI  VELİ", T0)], "request_id int, entity_type string, name string, as_of timestamp")
    assert {r["entity_id"] for r in rs.exact_matches(asked, people).collect()} == set(range(9))


def test_records_of_no_run_are_not_lost(spark):
    sources = spark.createDataFrame(
        [("s", "p1", "c1", True, True, "licensed")], "key string, parser_version string, collector_version string, enabled boolean, commercial_use_approved boolean, terms_status string"
    )
    kinds = "run_id string, source_key string, started_at timestamp, finished_at timestamp"
    records = spark.createDataFrame([("r2", "s", "p1", "c1", 1)], "run_id string, source_key string, parser_version string, collector_version string, ordinal int")
    with pytest.raises(q.RuleViolation, match="records of no run"):
        ingest.ingest_run(spark.createDataFrame([("r1", "s", T0, T0)], kinds), records, sources)
    with pytest.raises(q.RuleViolation, match="without id or source"):
        ingest.ingest_run(spark.createDataFrame([("r1", None, T0, T0)], kinds), records, sources)


def test_queries_run_from_any_folder(tmp_path):
    """The package travels with the session, so workers need neither its folder nor a path to it."""
    repo = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "import __spark_entry__ as e\nfrom pitchlake.session import local_session\n"
        "spark = local_session(2, partitions=2)\n"
        "for name in ('normalized_names', 'payload_hashes'):\n"
        "    assert e.queries()[name](spark, '/root/testdata/sf0.001').count() > 0\n"
        "    assert e.queries()[name](spark, '/root/testdata/sf0.001').tail(1)\n"
    )
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-1500:]


def test_windows_of_mappings_equal_brute_force_without_pairs(spark):
    rng = random.Random(4)
    rows = [(str(rng.randrange(2)), f"c{k}", rng.randrange(60), rng.choice([None, rng.randrange(80)]), rng.choice([None, 0, 1])) for k in range(120)]
    day = lambda k: None if k is None else T0 + timedelta(days=k)
    kinds = "source_id string, entity_type string, external_id string, canonical_entity_id string, valid_from timestamp, valid_until timestamp, observed_at timestamp"
    few = [r for r in rows if r[3] is not None] + rows[:3]
    for own in (rows, few):
        mapping = spark.createDataFrame([("s", "club", x, c, day(a), day(b), day(o)) for x, c, a, b, o in own], kinds)
        windows = rs.mapping_windows(mapping, ["source_id", "entity_type", "external_id"])
        assert "Join" not in windows._jdf.queryExecution().executedPlan().toString()
        asked = spark.createDataFrame([("s", "club", str(x), k, day(k)) for x in (0, 1) for k in range(-1, 85)], "source_id string, entity_type string, external_id string, k int, as_of timestamp")
        for r in rs.map_provider_ids(asked, mapping).collect():
            held = [(a, -1 if o is None else o, c) for x, c, a, b, o in own if x == r["external_id"] and a <= r["k"] and (b is None or r["k"] < b)]
            assert r["canonical_entity_id"] == (max(held)[2] if held else None), r
