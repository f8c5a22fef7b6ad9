from datetime import datetime, timedelta
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import hashing, scores, timing
from pitchlake.operators import evaluation as ev
from pitchlake.operators import identity, league
from pitchlake.operators import quality as q
from pitchlake.operators import resolution as rs
from pitchlake.operators import temporal as tp
from pitchlake.plans import backtest as bt
from pitchlake.plans import models as m
from pitchlake.sources import ingest, store

from . import brute

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """Facts and probes of which one key holds most, many on the same instant."""
    rng = Random(3)
    keys = ["hot"] * 6 + ["b", "c"]
    facts = [(rng.choice(keys), T0 + timedelta(hours=6 * rng.randrange(400)), rng.randrange(9)) for _ in range(900)]
    probes = [(i, rng.choice(keys), T0 + timedelta(hours=6 * rng.randrange(-4, 420))) for i in range(300)]
    return (
        facts, probes,
        spark.createDataFrame(facts, "k string, at timestamp_ntz, v long"),
        spark.createDataFrame(probes, "i long, k string, at timestamp_ntz"),
    )


@pytest.mark.parametrize("bucket_days", [(), (32,), (32, 1)])
def test_prefix_state_includes_ties_at_the_probe(skewed, bucket_days):
    facts, probes, fact_df, probe_df = skewed
    measures = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "last": ("max", F.col("at"))}
    state = tp.prefix_state(fact_df, probe_df, ["k"], "at", measures, bucket_days).collect()
    found = {(r["k"], r["at"]): (r["n"], r["s"], r["last"]) for r in state}
    assert len(found) == len(state)
    for _, key, at in probes:
        known = [(t, v) for k, t, v in facts if k == key and t <= at]
        assert found[key, at] == (len(known), sum(v for _, v in known), max((t for t, _ in known), default=None))


@pytest.mark.parametrize("bucket_rows", [1, 20, 10_000])
def test_prefix_state_over_measured_buckets_is_the_same(skewed, bucket_rows):
    _, _, fact_df, probe_df = skewed
    measures = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "last": ("max", F.col("at"))}
    calendar = tp.prefix_state(fact_df, probe_df, ["k"], "at", measures).collect()
    measured = tp.prefix_state(fact_df, probe_df, ["k"], "at", measures, bucket_rows=bucket_rows).collect()
    assert sorted(map(str, measured)) == sorted(map(str, calendar))
    empty = tp.prefix_state(fact_df.limit(0), probe_df.limit(0), ["k"], "at", measures, bucket_rows=bucket_rows)
    assert empty.collect() == []


def test_a_million_instants_of_one_key_in_a_month_are_spread(spark):
    hot = spark.range(1_000_000).select(
        F.lit("league").alias("k"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 1000)).alias("at")
    )
    rare = spark.createDataFrame([("other", T0 + timedelta(days=i)) for i in range(50)], "k string, at timestamp_ntz")
    buckets = tp.measured_buckets(hot.unionByName(rare), ["k"], "at", 50_000)
    sizes = buckets.groupBy("k", "_bucket").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()
    league = sorted((r["_bucket"], r["low"], r["high"], r["n"]) for r in sizes if r["k"] == "league")
    assert sum(r[3] for r in league) == 1_000_000 and max(r[3] for r in league) <= 100_000
    assert all(a[2] < b[1] for a, b in zip(league, league[1:]))  # buckets follow the clock
    with pytest.raises(ValueError, match="bucket_rows is 0"):
        tp.measured_buckets(hot, ["k"], "at", 0)


def test_as_of_joins_agree_with_a_scan(skewed):
    facts, probes, fact_df, probe_df = skewed
    args = (["k"], "at", "seen", ["v"], ["v"])
    right = fact_df.withColumnRenamed("at", "seen")
    for join in (tp.asof_join, tp.last_before):
        rows = join(probe_df, right, *args, prefix="r_").collect()
        assert len(rows) == len(probes)
        for r in rows:
            known = [(t, -v) for k, t, v in facts if k == r["k"] and t <= r["at"]]
            best = max(known, default=None)
            assert (r["r_seen"], r["r_v"]) == ((best[0], -best[1]) if best else (None, None))


def test_calibration_and_its_edges(spark):
    df = spark.createDataFrame(
        [(0.0, 1.0, 0.0, 1), (1.0, 0.0, 0.0, 0), (1.0, 0.0, 0.0, 0)], "p_home double, p_draw double, p_away double, outcome_index int"
    ).withColumn("run", F.lit("r"))
    table = ev.calibration_table(df, ["run"], bins=2)
    home = {r["bin"]: r for r in table.collect() if r["class_index"] == 0}
    assert set(home) == {0, 1} and home[1]["forecasts"] == 2 and home[1]["upper"] == 1.0
    assert {r["ece"] for r in ev.expected_calibration_error(table, ["run"]).collect()} == {0.0}
    with pytest.raises(ValueError):
        scores.calibration_bin(F.lit(0.5), 1)
    with pytest.raises(Exception, match=r"\[0, 1\]"):
        spark.range(1).select(scores.calibration_bin(F.lit(1.5))).collect()


def test_aggregates_against_plain_means(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        p = rng.dirichlet([2, 1, 1])
        rows.append((i, "ab"[i % 2], *map(float, p), int(rng.integers(0, 3))))
    df = ev.score_forecasts(
        spark.createDataFrame(rows, "match_id long, run string, p_home double, p_draw double, p_away double, outcome_index int")
    )
    for r in ev.aggregate_metrics(df, ["run"], score_loss=False).collect():
        mine = [x for x in rows if x[1] == r["run"]]
        vectors = [brute.metric_vector(x[2:5], x[5]) for x in mine]
        assert r["matches"] == len(mine)
        assert (r["log_loss"], r["brier_score"], r["rps"]) == pytest.approx(tuple(np.mean(vectors, axis=0)))
        for index, name in enumerate(ev.CLASSES):
            bins = {}
            for x in mine:
                bins.setdefault(min(int(x[2 + index] * 10), 9), []).append((x[2 + index], x[5] == index))
            ece = sum(abs(sum(p for p, _ in b) - sum(h for _, h in b)) for b in bins.values()) / len(mine)
            assert r[f"ece_{name}"] == pytest.approx(ece)


def test_bootstrap_is_reproducible_and_ordinary(spark):
    rng = np.random.default_rng(1)
    deltas = {"big": rng.normal(0.02, 0.2, 4000), "small": rng.normal(-0.1, 0.5, 60)}
    rows = [(i, g, float(d), 0.0) for g, ds in deltas.items() for i, d in enumerate(ds)] + [(9999, "small", None, 0.0)]
    df = spark.createDataFrame(rows, "match_id long, g string, rps double, market_rps double")
    one = {r["g"]: r for r in ev.paired_bootstrap(df, ["g"], seed=7).collect()}
    again = {r["g"]: r for r in ev.paired_bootstrap(df.repartition(7), ["g"], seed=7).collect()}
    split = {r["g"]: r for r in ev.paired_bootstrap(df, ["g"], seed=7, block_rows=500).collect()}
    for g, ds in deltas.items():
        means = np.sort([ds[rng.integers(0, len(ds), len(ds))].mean() for _ in range(1000)])
        width = means[974] - means[24]
        for found in (one[g], split[g]):
            assert found["pairs"] == len(ds) and found["mean_delta"] == pytest.approx(ds.mean())
            assert found["lower_95"] == pytest.approx(means[24], abs=0.15 * width)
            assert found["upper_95"] == pytest.approx(means[974], abs=0.15 * width)
        assert one[g]["lower_95"] == pytest.approx(again[g]["lower_95"], abs=1e-12)
    for bad in (dict(samples=99), dict(seed=-1)):
        with pytest.raises(ValueError):
            ev.paired_bootstrap(df, ["g"], **bad)


def test_bootstrap_draws_are_those_of_the_plain_formula():
    counters = np.arange(1 << 33, (1 << 33) + 500)
    for seed, group, replicate, stream, bound in ((0, 1, 2, 0, 10), (7, 0xFFFFFFF, 999, 1 << 20, 10**10 + 1)):
        found = ev._drawn(ev._streams(seed, group, replicate, stream), counters, bound)
        for c, n in zip(counters.tolist(), found.tolist()):
            lanes = []
            for state in ev._LANES:
                for value in (seed, group, replicate, stream, c):
                    state = ev._mixed(state, value)
                lanes.append(state)
            assert n == ((lanes[0] << 31) + lanes[1]) % bound


def test_bootstrap_deals_its_work_by_number(spark):
    # By size a few kilobytes that stand for all draws would be one task.
    df = spark.range(300).select(F.col("id").alias("match_id"), F.lit("g").alias("g"), F.rand(1).alias("rps"), F.lit(0.0).alias("market_rps"))
    plan = ev.paired_bootstrap(df, ["g"], block_rows=64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_ingest_runs(spark):
    sources = spark.createDataFrame(
        [("a", "p1", "c1", True, True, "licensed"), ("b", "p1", "c1", True, False, "licensed")],
        "key string, parser_version string, collector_version string, enabled boolean, commercial_use_approved boolean, terms_status string",
    )
    runs = spark.createDataFrame(
        [("ok", "a", None, None, None), ("bad", "a", None, None, None), ("down", "a", "network", "timeout", True),
         ("odd", "a", None, "boom", None), ("stop", "b", None, None, None), ("none", "a", None, None, None)],
        "run_id string, source_key string, failure_kind string, failure_message string, retryable boolean",
    ).withColumns({"started_at": F.lit(T0), "finished_at": F.lit(T0)})
    records = spark.createDataFrame(
        [("ok", 1, "a", "p1", "c1"), ("ok", 2, "a", "p1", "c1"), ("bad", 1, "a", "p1", "c1"), ("bad", 2, "a", "p0", "c0"),
         ("bad", 3, "x", "p1", "c1"), ("stop", 1, "b", "p1", "c1"), ("down", 1, "a", "p1", "c1")],
        "run_id string, ordinal int, source_key string, parser_version string, collector_version string",
    )
    accepted, envelopes = ingest.ingest_run(runs, records, sources, production=True)
    assert sorted((r["run_id"], r["ordinal"]) for r in accepted.collect()) == [("ok", 1), ("ok", 2)]
    found = {r["run_id"]: (r["status"], r["records_count"], r["failure_kind"], r["retryable"]) for r in envelopes.collect()}
    assert found == {
        "ok": ("succeeded", 2, None, None), "none": ("succeeded", 0, None, None), "bad": ("failed", 0, "schema", False),
        "down": ("failed", 0, "network", True), "odd": ("failed", 0, "unknown", False), "stop": ("blocked", 0, "policy", False),
    }
    assert {r["run_id"]: r["error_message"] for r in envelopes.collect()}["bad"] == ingest.CONTRACT_CHECKS[1][1]
    research, _ = ingest.ingest_run(runs, records, sources)
    assert research.filter("run_id = 'stop'").count() == 1
    with pytest.raises(q.RuleViolation):
        ingest.register_sources(sources.unionByName(sources))
    with pytest.raises(q.RuleViolation):
        ingest.ingest_run(runs.withColumn("source_key", F.lit("zz")), records, sources)


def test_head_to_head_decides_before_goal_difference(spark):
    results = [("a", "b", 1, 0), ("b", "a", 0, 0), ("a", "c", 0, 1), ("b", "c", 9, 0), ("c", "a", 1, 0), ("c", "b", 1, 0)]
    df = spark.createDataFrame(
        [("x", *r) for r in results], "competition_key string, home_club_id string, away_club_id string, home_goals int, away_goals int"
    )

    def order(ranking):
        rows = league.league_table(df, ranking=ranking).orderBy("position", "club_id").collect()
        return [(r["club_id"], r["points"], r["position"]) for r in rows]

    # a and b have 4 points; a beat b, but b has the better goal difference
    assert order(("points", "head_to_head_points", "goal_difference")) == [("c", 9, 1), ("a", 4, 2), ("b", 4, 3)]
    assert order(("points", "goal_difference")) == [("c", 9, 1), ("b", 4, 2), ("a", 4, 3)]
    assert [p for _, _, p in order(("points", "drawing_of_lots"))] == [1, 2, 2]
    with pytest.raises(ValueError):
        order(("coin",))


def test_identity_chains_splits_and_cycles(spark):
    schema = "event_id int, event_type string, subject_entity_id string, target_entity_id string, occurred_at timestamp"
    merges = [(i, "merge", f"e{i}", f"e{i + 1}", T0) for i in range(6)]
    events = spark.createDataFrame([*merges, (9, "split", "e3", None, T0 + timedelta(days=1))], schema)
    now = {r["entity_id"]: r["current_id"] for r in identity.current_identity(events).collect()}
    assert now == {"e0": "e3", "e1": "e3", "e2": "e3", "e4": "e6", "e5": "e6"}
    before = identity.current_identity(events, F.lit(T0))
    assert {r["current_id"] for r in before.collect()} == {"e6"}
    facts = spark.createDataFrame([("e0",), ("zz",)], "entity_id string")
    assert sorted(r[0] for r in identity.apply_identity(facts, before).collect()) == ["e6", "zz"]
    loop = spark.createDataFrame([(1, "merge", "a", "b", T0), (2, "merge", "b", "c", T0), (3, "merge", "c", "a", T0)], schema)
    with pytest.raises(ValueError, match="cycle"):
        identity.current_identity(loop)


def test_claims_prefer_authority_over_freshness(spark):
    sources = spark.createDataFrame([("fed", 2, 0.9), ("blog", 0, 0.3), ("wire", 0, 0.3)], "key string, authority int, reliability double")
    claims = spark.createDataFrame(
        [("e", "dob", "1990", "fed", T0), ("e", "dob", "1991", "blog", T0 + timedelta(days=9)),
         ("e", "dob", "1991", "wire", T0 + timedelta(days=9)), ("e", "foot", "left", "blog", T0),
         ("e", "foot", "right", "blog", T0), ("e", "foot", "right", "wire", T0)],
        "entity_id string, field string, value string, source_key string, observed_at timestamp",
    )
    best = {r["field"]: (r["value"], r["corroborating"], r["values"]) for r in identity.rank_claims(claims, sources).collect()}
    assert best == {"dob": ("1990", 1, 2), "foot": ("right", 2, 2)}


def test_dataset_digest_ignores_order_only(spark):
    rows = brute.synthetic_matches(40)
    df = spark.createDataFrame(rows)
    digest = lambda d: bt.data_snapshot_hash(d).first()
    base = digest(df)
    assert base["row_count"] == 40 and base == digest(df.repartition(5).orderBy(F.desc("match_id")))
    assert digest(df.unionByName(df.limit(1))) != base
    assert digest(df.withColumn("away_goals", F.col("away_goals") + 1))["data_hash"] != base["data_hash"]
    assert hashing.stable_hash([1]) != hashing.stable_hash([1.0])


def test_backtest_sink_refuses_leaks(spark, tmp_path):
    run = spark.createDataFrame([("r1", "poisson", 3600, 0)], "run_id string, model_key string, lead_time_seconds int, seed int")
    row = ("r1", 1, "poisson", T0, T0, 0.5, 0.3, 0.2, 1.2, 0.9, None)
    schema = (
        "run_id string, match_id long, model_key string, prediction_cutoff timestamp, data_cutoff timestamp, p_home double, "
        "p_draw double, p_away double, expected_home_goals double, expected_away_goals double, market_observed_at timestamp"
    )
    store.write_backtest(str(tmp_path / "b"), run, spark.createDataFrame([row], schema))
    back = spark.read.parquet(str(tmp_path / "b" / "backtest_predictions")).first()
    assert str(back["p_home"]) == "0.50000000" and back["model_key"] == "poisson"
    late = (*row[:4], T0 + timedelta(seconds=1), *row[5:])
    with pytest.raises(q.RuleViolation, match="data_before_prediction"):
        store.write_backtest(str(tmp_path / "c"), run, spark.createDataFrame([late], schema))
    with pytest.raises(q.RuleViolation, match="occurrences"):
        store.write_backtest(str(tmp_path / "c"), run, spark.createDataFrame([row, row], schema))


def test_empty_backtest_is_an_error(spark):
    matches = spark.createDataFrame(brute.synthetic_matches(10))
    rows = bt.walk_forward(matches, [m.PoissonModel()], [86400], min_train_matches=500)
    with pytest.raises(ValueError, match="training requirements"):
        bt.require_observations(rows)


def test_validity_and_zones(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(days=1)), (None, None)], "f timestamp, u timestamp")
    inside = [
        [r[0] for r in df.select(timing.is_valid_at(F.col("f"), F.col("u"), F.lit(t))).collect()]
        for t in (T0 - timedelta(seconds=1), T0, T0 + timedelta(days=1))
    ]
    assert inside == [[False, True], [True, True], [False, True]]
    with pytest.raises(ValueError):
        timing.require_zoned(T0)
    texts = spark.createDataFrame([("2024-01-01T01:00:00+01:00",), ("2024-01-01T00:00:00",)], "t string")
    assert [r[0] for r in texts.select(timing.to_utc(F.col("t"))).collect()] == [T0, None]


def test_provider_mapping_ends(spark):
    mapping = spark.createDataFrame(
        [("s", "club", "7", "old", T0, T0 + timedelta(days=5), T0), ("s", "club", "7", "new", T0 + timedelta(days=9), None, T0)],
        "source_id string, entity_type string, external_id string, canonical_entity_id string, valid_from timestamp, "
        "valid_until timestamp, observed_at timestamp",
    )
    asked = spark.createDataFrame([(d, "s", "club", "7", T0 + timedelta(days=d)) for d in (-1, 0, 5, 9)],
                                  "d int, source_id string, entity_type string, external_id string, as_of timestamp")
    found = {r["d"]: r["canonical_entity_id"] for r in rs.map_provider_ids(asked, mapping).collect()}
    assert found == {-1: None, 0: "old", 5: None, 9: "new"}


def test_table_settings_bound_a_task_and_leave_corpus_queries_alone(spark):
    from pitchlake.session import TABLE_SETTINGS, tune

    held = {key: spark.conf.get(key, None) for key in TABLE_SETTINGS}
    try:
        tune(spark)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"
        parts = spark.range(20).repartition("id").groupBy("id").count()
        assert len(parts.collect()) == 20
        tune(spark, tables=False)
        assert not set(TABLE_SETTINGS.values()) & {spark.conf.get(key, None) for key in TABLE_SETTINGS}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7MB")
        tune(spark, tables=False)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "7MB"
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
