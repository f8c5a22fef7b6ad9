from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.plans.models import EloModel
from pitchlake.streaming import elo, records

from . import brute

T0 = datetime(2030, 1, 1)


def replay(spark, tmp_path, batches, schema, build, name, mode="append"):
    """Feed the batches one file at a time and return what the query emitted."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    query = (
        build(stream.parquet(str(source))).writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "ckpt")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_records_are_deduplicated(spark, tmp_path):
    rows = [[("s", "e1", T0), ("s", "e2", T0)], [("s", "e1", T0 + timedelta(hours=1)), ("t", "e1", T0)]]
    out = replay(
        spark, tmp_path, rows, "source_key string, evidence_key string, observed_at timestamp",
        records.deduplicated_records, "dedup",
    )
    assert sorted((r["source_key"], r["evidence_key"]) for r in out) == [("s", "e1"), ("s", "e2"), ("t", "e1")]


def test_heads_keep_the_highest_revision(spark, tmp_path):
    rows = [[("f", 1, "scheduled"), ("f", 3, "finished")], [("f", 2, "postponed"), ("g", 1, "scheduled")]]
    out = replay(
        spark, tmp_path, rows, "fixture_key string, revision int, status string", records.fixture_heads, "heads", "complete"
    )
    assert {(r["fixture_key"], r["revision"], r["status"]) for r in out} == {("f", 3, "finished"), ("g", 1, "scheduled")}


def test_run_health_counts_closed_windows(spark, tmp_path):
    run = ("s", "succeeded", None, 5)
    rows = [[(T0, *run), (T0 + timedelta(minutes=5), *run)], [(T0 + timedelta(hours=9), *run)], [(T0 + timedelta(hours=10), *run)]]
    out = replay(
        spark, tmp_path, rows, "started_at timestamp, source_key string, status string, failure_kind string, records_count int",
        records.run_health_stream, "health",
    )
    assert (out[0]["window_start"], out[0]["runs"], out[0]["records"]) == (T0, 2, 10)


def test_online_elo_equals_the_fold(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    matches = brute.synthetic_matches(40, competitions=1, clubs=4)
    ordered = sorted(matches, key=lambda r: r["result_observed_at"])
    names = ["match_id", "competition_key", "home_club_id", "away_club_id", "kickoff_at", "result_observed_at", "home_goals", "away_goals"]
    batches = [[tuple(r[n] for n in names) for r in reversed(ordered[i : i + 10])] for i in range(0, 40, 10)]
    last = ordered[-1]["result_observed_at"] + timedelta(days=30)
    batches += [[(10_000 + i, 0, 8, 9, last, last + timedelta(days=10 * i), 0, 0)] for i in range(2)]
    out = replay(
        spark, tmp_path, batches,
        "match_id long, competition_key int, home_club_id int, away_club_id int, kickoff_at timestamp, "
        "result_observed_at timestamp, home_goals int, away_goals int",
        lambda s: elo.online_elo(s, EloModel(), "1 day"), "elo",
    )
    by_club = {}
    for r in out:
        if r["club_id"] in "0123" and r["rating"] is not None:
            by_club.setdefault(r["club_id"], {})[r["match_id"]] = r["rating"]
    expected = brute.elo_ratings(matches)
    order = sorted(matches, key=lambda r: (r["result_observed_at"], r["kickoff_at"], str(r["match_id"])))
    for club, rating in expected.items():
        final = [str(r["match_id"]) for r in order if club in (r["home_club_id"], r["away_club_id"])][-1]
        assert by_club[str(club)][final] == pytest.approx(rating, abs=1e-9)


def test_updates_keep_the_newest_and_survive_a_repeated_batch(spark, tmp_path):
    schema = "fixture_key string, revision int, status string"
    source = tmp_path / "in"
    for i, rows in enumerate([[("f", 1, "scheduled"), ("f", 3, "finished")], [("f", 2, "postponed"), (None, 1, "scheduled")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    heads = records.fixture_heads(stream)
    out, log = str(tmp_path / "out"), tmp_path / "log"

    def run():
        records.write_updates(heads, out, str(log)).trigger(availableNow=True).start().awaitTermination()
        return {(r["fixture_key"], r["revision"], r["status"]) for r in records.read_updates(spark, out, heads.schema, ["fixture_key"]).collect()}

    first = run()
    assert first == {("f", 3, "finished"), (None, 1, "scheduled")}
    # The last batch was written, but its commit was lost: it runs again.
    newest = max((log / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (log / "commits" / f".{newest.name}.crc").unlink(missing_ok=True)
    assert run() == first
    assert spark.read.parquet(out).count() == 3


class _Map(dict):
    getValue, containsKey, updateValue, removeKey = dict.get, dict.__contains__, dict.__setitem__, dict.__delitem__


class _Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, _Map())

    def registerTimer(self, fires):
        self.timers.append(fires)


def test_online_elo_puts_arriving_results_into_state_in_parts(monkeypatch):
    monkeypatch.setattr(elo, "PART_ROWS", 7, raising=False)
    start = pd.Timestamp("2026-01-01")
    rows = [
        (f"m{k:02}", str(k % 3), str((k + 1) % 3 + (k % 2) * 3), start, start + pd.Timedelta(minutes=k * 7 % 5, microseconds=k % 4), (0.0, 0.5, 1.0)[k % 3])
        for k in range(40)
    ]
    rows += [("late", "0", "1", start, start - pd.Timedelta(days=1), 1.0), (None, None, None, start, start, 0.0)]
    names = ["match_id", "home_club_id", "away_club_id", "kickoff_at", "result_observed_at", "actual"]
    frame = pd.DataFrame(rows, columns=names)
    handle, waited = _Handle(), []
    processor = elo._EloProcessor(EloModel())
    processor.init(handle)

    def batches():
        for first in range(0, len(frame), 5):
            waited.append(len(handle.maps["waiting"]))
            yield frame[first : first + 5]

    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: start.value // 10**6 - 1000)
    late = pd.concat(processor.handleInputRows(("c",), batches(), now))
    assert late["match_id"].tolist() == ["late"] * 2 and late["rating"].isna().all() and (late["result_observed_at"] == rows[40][4]).all()
    assert waited[2] > 0, "nothing was put into state before all rows had arrived"
    assert len(handle.timers) == len(set(handle.timers))
    fired = [processor.handleExpiredTimer(("c",), now, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)) for t in sorted(handle.timers)]
    got = pd.concat([frame for frames in fired for frame in frames])
    ratings, want = {}, []
    for observed, match, home, away, actual in sorted((r[4], r[0], r[1], r[2], r[5]) for r in rows[:40]):
        gap = ratings.get(home, EloModel().initial_rating) + EloModel().home_advantage - ratings.get(away, EloModel().initial_rating)
        delta = EloModel().k_factor * (actual - 1.0 / (1.0 + 10.0 ** (-gap / 400.0)))
        for club, change in ((home, delta), (away, -delta)):
            ratings[club] = ratings.get(club, EloModel().initial_rating) + change
            want.append(("c", match, club, observed, ratings[club]))
    assert list(got.itertuples(index=False, name=None)) == want
    assert not handle.maps["waiting"] and not handle.maps["parts"]
