import json
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import quality as q
from pitchlake.sources import collectors, keys, store

T0 = datetime(2030, 1, 1)
PREDICTION = (
    "run_id string, match_id long, model_key string, prediction_cutoff timestamp, data_cutoff timestamp, p_home double, "
    "p_draw double, p_away double, expected_home_goals double, expected_away_goals double, market_observed_at timestamp"
)
RUN = "run_id string, model_key string, lead_time_seconds int, seed int"


def land(folder, name, values):
    (folder / name).write_text("".join(json.dumps({"v": v}) + "\n" for v in values))


def values(df):
    return sorted(r[0] for r in df.select(F.get_json_object("payload", "$.v")).collect())


@pytest.mark.parametrize("piece", [1, 7, 13, 64, 1 << 20])
def test_landed_files_give_each_line_once_however_cut(spark, tmp_path, piece):
    texts = ["a", "", "long " * 9, "ø€", "b"]
    land(tmp_path, "001.json", texts)
    (tmp_path / "002.json").write_bytes(b'\n{"v":"no end"}\r\n\n{"v":"last"}')
    (tmp_path / "003.json").write_bytes(b"")
    (tmp_path / "_hidden.json").write_text("no drop")
    df = spark.read.format(collectors.register(spark)).option("piece_bytes", piece).load(str(tmp_path))
    assert values(df) == sorted([*texts, "no end", "last"])
    # Places are bytes of the file, whatever the cut.
    assert {(r["drop"], r["ordinal"]) for r in df.where("drop = '002.json'").collect()} == {("002.json", 1), ("002.json", 18)}


def test_empty_landing(spark, tmp_path):
    assert spark.read.format(collectors.register(spark)).load(str(tmp_path)).collect() == []


def test_a_restarted_stream_goes_on_behind_the_last_drop(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    name = collectors.register(spark)

    def run_until_drained():
        stream = spark.readStream.format(name).option("piece_bytes", 16).load(str(landing))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        return query

    land(landing, "001.json", ["a", "b"])
    first = run_until_drained()
    land(landing, "002.json", ["c"])
    first.processAllAvailable()
    first.stop()
    land(landing, "003.json", ["d", "e"])
    second = run_until_drained()
    second.stop()
    assert values(spark.read.parquet(str(tmp_path / "out"))) == ["a", "b", "c", "d", "e"]


def test_a_batch_that_fails_is_read_again_whole(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    land(landing, "001.json", ["a", "b"])
    name = collectors.register(spark)

    def query(broken):
        def save(rows, batch):
            rows.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}"))
            if broken:
                raise RuntimeError("lost after writing")

        stream = spark.readStream.format(name).load(str(landing)).writeStream.foreachBatch(save)
        return stream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after writing"):
        query(True).awaitTermination()
    land(landing, "002.json", ["c"])
    # A run that has a batch to repeat may end with it; the next one takes what has come since.
    query(False).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out/batch=0"))) == ["a", "b"]
    query(False).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out"))) == ["a", "b", "c"]


class Counted(collectors.Collector):
    """A collector without files: as many drops as it is told, three records each."""

    schema = "drop string, ordinal long, payload string"

    def __init__(self, drops):
        self.names = [f"{k:04}" for k in range(drops)]

    def drops(self):
        return self.names

    def pieces(self, drop):
        return [collectors.Piece(drop, 0, 2), collectors.Piece(drop, 2, 3)]

    def collect(self, piece):
        at = list(range(piece.start, piece.end))
        yield pa.RecordBatch.from_arrays([pa.array([piece.drop] * len(at)), pa.array(at, pa.int64()), pa.array(["{}"] * len(at))], ["drop", "ordinal", "payload"])


def test_any_collector_is_a_format(spark):
    spark.sparkContext.addPyFile(__file__)
    name = collectors.register(spark, "counted", lambda options: Counted(int(options["drops"])))
    df = spark.read.format(name).option("drops", 4).load()
    assert df.rdd.getNumPartitions() == 8 and df.select("drop", "ordinal").distinct().count() == 12


def test_a_backtest_written_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("7", "poisson", 3600, 0), ("8", "poisson", 3600, 0)], RUN)
    rows = [(run, k, "poisson", T0, T0, 0.5, 0.3, 0.2, 1.2, 0.9, None) for run in "78" for k in range(3)]
    store.write_backtest(root, runs, spark.createDataFrame(rows, PREDICTION))
    store.write_backtest(root, runs.where("run_id = '7'"), spark.createDataFrame(rows[:2], PREDICTION))
    held, predictions = store.read_backtest(spark, root)
    assert sorted(r["run_id"] for r in held.collect()) == ["7", "8"]
    assert {r["run_id"]: r["count"] for r in predictions.groupBy("run_id").count().collect()} == {"7": 2, "8": 3}
    assert dict(predictions.dtypes)["run_id"] == "string"
    with pytest.raises(q.RuleViolation, match="runs without predictions"):
        store.write_backtest(root, runs, spark.createDataFrame(rows[:3], PREDICTION))
    with pytest.raises(q.RuleViolation, match="predictions of no run"):
        store.write_backtest(root, runs.where("run_id = '8'"), spark.createDataFrame(rows, PREDICTION))


def test_tasks_do_not_grow_with_the_pieces():
    few = [collectors.Piece("a", k, k + 1) for k in range(5)]
    assert [s.pieces for s in collectors.shares(few)] == [(p,) for p in few] and collectors.shares([]) == []
    many = [collectors.Piece(d, 64 * k, 64 * (k + 1)) for d in "ab" for k in range(20_000)] + [collectors.Piece("c", 0, 1 << 20)]
    dealt = collectors.shares(many)
    assert [p for s in dealt for p in s.pieces] == many and len(dealt) <= 2 * collectors.TASKS
    large = collectors.shares([collectors.Piece("a", k << 20, (k + 1) << 20) for k in range(1 << 15)])
    assert max(sum(p.end - p.start for p in s.pieces) for s in large) == collectors.TASK_BYTES


def test_runs_of_a_backtest_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seed() -> int:
        made.add(1)
        return 0

    runs = spark.createDataFrame([("7", "poisson", 3600)], "run_id string, model_key string, lead_time_seconds int")
    row = [("7", 1, "poisson", T0, T0, 0.5, 0.3, 0.2, 1.2, 0.9, None)]
    store.write_backtest(str(tmp_path), runs.withColumn("seed", F.udf(seed, "int")()), spark.createDataFrame(row, PREDICTION))
    assert made.value == 1


def test_predictions_show_only_once_their_run_is_written(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("7", "poisson", 3600, 0)], RUN)
    row = [("7", 1, "poisson", T0, T0, 0.5, 0.3, 0.2, 1.2, 0.9, None)]
    store.write_backtest(root, runs, spark.createDataFrame(row, PREDICTION))
    # A try that ended between its two writes.
    stored = spark.read.parquet(f"{root}/backtest_predictions")
    store._replace(stored.withColumn("run_id", F.lit("9")), f"{root}/backtest_predictions", "model_key", "run_id")
    assert [r["run_id"] for r in store.read_backtest(spark, root)[1].collect()] == ["7"]


def test_decisions_written_again_replace_themselves(spark, tmp_path):
    decisions = spark.createDataFrame([("d1", "ambiguous", 0.5), ("d2", "matched", 1.0)], "decision_id string, status string, top_score double")
    cases = spark.createDataFrame([("c1", "d1")], "case_id string, decision_id string")
    for part in (cases, cases, cases.limit(0)):
        store.write_decisions(str(tmp_path), "20240102", decisions, part)
    held, found = store.read_decisions(spark, str(tmp_path))
    assert held.count() == 2 and found.collect() == [] and held.first()["run_id"] == "20240102"


def evidence(spark, rows):
    return spark.createDataFrame(rows, "record_id string, source_id string, collector_run_id string, evidence_key string")


def test_key_faults_of_a_batch(spark, tmp_path):
    lake = store.TableStore(spark, str(tmp_path))
    lake.append("r1", {"sources": spark.createDataFrame([("s1", "one")], "id string, key string"),
                       "collector_runs": spark.createDataFrame([("c1", "s1", "k1")], "run_id string, source_id string, run_key string")})
    lake.append("r2", {"raw_source_records": evidence(spark, [("x1", "s1", "c1", "e1"), ("x2", "s1", "c1", None)])})
    batch = evidence(spark, [
        ("y1", "s1", "c1", "e1"),  # stored
        ("y2", "s1", "c1", "e2"), ("y3", "s1", "c1", "e2"),  # repeated
        ("y4", "s9", "c1", "e1"),  # a source nobody knows, so the key is free
        ("y5", None, "c8", None), ("y6", "s2", "c1", None),  # parts that are null; a source of the batch itself
    ])
    own = {"raw_source_records": batch, "sources": spark.createDataFrame([("s2", "two"), ("s3", "one")], "id string, key string")}
    found = {(r["table_name"], r["fault"], r["key"], r["occurrences"]) for r in keys.key_faults(lake, own).collect()}
    assert found == {
        ("raw_source_records", "stored", '["s1","e1"]', 1), ("raw_source_records", "repeated", '["s1","e2"]', 2),
        ("raw_source_records", "orphaned", '["s9"]', 1), ("raw_source_records", "orphaned", '["c8"]', 1), ("sources", "stored", '["one"]', 1),
    }
    assert keys.key_faults(lake, {"raw_source_records": batch.limit(0)}).collect() == []


def test_only_runs_that_may_hold_a_key_are_opened(spark, tmp_path):
    lake = store.TableStore(spark, str(tmp_path))
    rows = lambda k: evidence(spark, [(f"x{k}-{i}", "s", "c", f"e{k}-{i}") for i in range(20)])
    for k in range(6):
        lake.append(f"r{k}", {"raw_source_records": rows(k)})
    held, unmarked = lake.key_bitmaps()
    asked = keys._entries(spark, {"raw_source_records": rows(4)}).where("kind = 'unique'")
    assert unmarked == [] and keys.runs_that_may_hold(asked, held) == {"raw_source_records(source_id,evidence_key)": ["r4"]}
    opened = []
    read = lake.read
    lake.read = lambda table, runs: opened.extend((table, run) for run in runs) or read(table, runs)
    faults = keys.key_faults(lake, {"raw_source_records": rows(4)}).where("fault = 'stored'")
    assert faults.count() == 20 and ("raw_source_records", "r4") in opened and len({run for t, run in opened if t == "raw_source_records"}) == 1


def test_runs_without_bitmaps_are_always_read(spark, tmp_path, monkeypatch):
    lake = store.TableStore(spark, str(tmp_path))
    with monkeypatch.context() as patch:
        # As runs were written before there were bitmaps.
        patch.setattr(store, "KEY_BITMAPS", "_nowhere")
        lake.append("old", {"raw_source_records": evidence(spark, [("x1", "s1", "c1", "e1")])})
    found = keys.key_faults(lake, {"raw_source_records": evidence(spark, [("y1", "s1", "c1", "e1")])}).where("fault = 'stored'")
    assert [r["key"] for r in found.collect()] == ['["s1","e1"]']
