"""Append-only canonical tables on plain Parquet, committed all or nothing.

Each import writes its new rows to ``<root>/<table>/run=<run id>`` and, when everything is in place, one
row to the commit log.  Readers only open runs found in the log, so a failed import leaves nothing visible
and no file that is being read is ever replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pitchlake.session import ensure_checkpoint_dir
from pitchlake.sources import keys

# Tables of an import are small and independent, so their jobs run side by side.
JOBS_AT_ONCE = 4
KEY_BITMAPS = "_key_bitmaps"


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _commits(self) -> list[tuple[str, str]]:
        """(table, run) pairs in commit order: one row per import and table, never data."""
        try:
            log = self.spark.read.parquet(f"{self.root}/_commit_log")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return [(r["table_name"], r["run_id"]) for r in log.orderBy("committed_at", "table_name").collect()]

    def tables(self) -> dict[str, DataFrame]:
        """Every committed table."""
        paths: dict[str, list[str]] = {}
        for table, run in self._commits():
            if table != KEY_BITMAPS:
                paths.setdefault(table, []).append(f"{self.root}/{table}/run={run}")
        return {name: self.spark.read.parquet(*found) for name, found in paths.items()}

    def read(self, table: str, runs: Sequence[str]) -> DataFrame | None:
        """What the given runs have committed of a table; none of them any: nothing."""
        paths = [f"{self.root}/{name}/run={run}" for name, run in self._commits() if name == table and run in set(runs)]
        return self.spark.read.parquet(*paths) if paths else None

    def key_bitmaps(self) -> tuple[DataFrame | None, list[str]]:
        """The key bitmaps of all committed runs that have them, with the run, and the runs that have none."""
        commits = self._commits()
        marked = [run for name, run in commits if name == KEY_BITMAPS]
        base = f"{self.root}/{KEY_BITMAPS}"
        reader = self.spark.read.schema(f"{keys.BITMAPS}, run string").option("basePath", base)
        held = reader.parquet(*[f"{base}/run={run}" for run in marked]) if marked else None
        return held, sorted({run for _, run in commits} - set(marked))

    def append(self, run_id: str, rows: Mapping[str, DataFrame]) -> None:
        """Write every table's new rows and the bitmaps of their keys, then commit them together."""
        if run_id in {run for _, run in self._commits()}:
            raise ValueError(f"run already committed: {run_id}")
        with ThreadPoolExecutor(JOBS_AT_ONCE) as jobs:
            list(jobs.map(lambda item: item[1].write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{item[0]}/run={run_id}"), rows.items()))
        keys.write_bitmaps(self.spark, f"{self.root}/{KEY_BITMAPS}/run={run_id}", rows)
        log = self.spark.createDataFrame([(table, run_id) for table in (*rows, KEY_BITMAPS)], "table_name string, run_id string")
        log.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.root}/_commit_log"
        )


def write_backtest(store_root: str, runs: DataFrame, predictions: DataFrame) -> None:
    """Persist a backtest after checking it: no leakage, valid probabilities, unique (run, match).

    A run that is written again replaces its earlier rows; a run id belongs to one model.
    """
    from pitchlake.operators import quality as q

    # Forecasts are dear: they are made once, so that what is checked is what is written.  Runs are often drawn from the same forecasts.
    ensure_checkpoint_dir(predictions.sparkSession)
    predictions, runs = predictions.checkpoint(), runs.checkpoint()
    q.enforce(q.violations(runs, q.RUN_RULES, ["run_id"]), "backtest_runs")
    q.enforce(q.violations(predictions, q.PREDICTION_RULES, ["run_id", "match_id"]), "backtest_predictions")
    q.enforce(q.duplicate_keys(predictions, ["run_id", "match_id"]), "backtest_predictions")
    quantised = predictions.withColumns(
        {
            **{c: F.col(c).cast("decimal(10,8)") for c in ("p_home", "p_draw", "p_away")},
            **{c: F.col(c).cast("decimal(10,6)") for c in ("expected_home_goals", "expected_away_goals")},
            **{
                c: F.col(c).cast("decimal(10,8)")
                for c in ("market_p_home", "market_p_draw", "market_p_away")
                if c in predictions.columns
            },
        }
    )
    # A run without rows would leave those of an earlier try in place.
    pairs = runs.select("run_id", "model_key").distinct()
    forecast = predictions.select("run_id", "model_key").distinct()
    q.enforce(q.duplicate_keys(runs, ["run_id"]), "backtest_runs")
    q.enforce(pairs.join(forecast, ["run_id", "model_key"], "left_anti"), "runs without predictions")
    q.enforce(forecast.join(pairs, ["run_id", "model_key"], "left_anti"), "predictions of no run")
    # A run's own folder is replaced whole, so writing a run again leaves one copy of it.  The row of the run comes last: it is the mark
    # by which readers know that the predictions are in place.
    _replace(quantised, f"{store_root}/backtest_predictions", "model_key", "run_id")
    _replace(runs, f"{store_root}/backtest_runs", "model_key", "run_id")


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write the rows to a folder per value of ``by`` and replace those folders only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _texts(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """A table whose folders are named by texts, even where all of them look like numbers or dates."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name in by else f for f in schema])).parquet(path)


def read_backtest(spark: SparkSession, store_root: str) -> tuple[DataFrame, DataFrame]:
    """Runs and the predictions of finished runs; a filter on model or run opens its folders only."""
    runs, predictions = (_texts(spark, f"{store_root}/{name}", "model_key", "run_id") for name in ("backtest_runs", "backtest_predictions"))
    return runs, predictions.join(runs.select("model_key", "run_id"), ["model_key", "run_id"], "left_semi")


def write_decisions(store_root: str, run_id: str, decisions: DataFrame, cases: DataFrame) -> None:
    """Write the decisions and the review queue of a resolution run; the same run written again replaces itself.

    Cases go first, so a decision is never without its case.
    """
    from pitchlake.operators import quality as q

    q.enforce(q.violations(decisions, q.DECISION_RULES, ["decision_id"]), "entity_resolution_decisions")
    q.enforce(q.duplicate_keys(decisions, ["decision_id"]), "entity_resolution_decisions")
    q.enforce(q.duplicate_keys(cases, ["case_id"]), "entity_resolution_review_cases")
    # A folder named by the run, so a rerun without any case also takes away those of the try before.
    cases.write.mode("overwrite").parquet(f"{store_root}/entity_resolution_review_cases/run_id={run_id}")
    decisions.write.mode("overwrite").parquet(f"{store_root}/entity_resolution_decisions/run_id={run_id}")


def read_decisions(spark: SparkSession, store_root: str) -> tuple[DataFrame, DataFrame]:
    """Decisions and review cases of all runs that have both."""
    decisions, cases = (
        _texts(spark, f"{store_root}/{name}", "run_id") for name in ("entity_resolution_decisions", "entity_resolution_review_cases")
    )
    return decisions, cases.join(decisions.select("run_id").distinct(), "run_id", "left_semi")
