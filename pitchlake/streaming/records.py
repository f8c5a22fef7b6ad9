"""Structured Streaming forms of ingest: deduplicated records, live fixture heads, run health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def deduplicated_records(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Records once per (source, evidence key) within the watermark.

    Only the duplicate filter forgets old keys.  The canonical import still recognises a later duplicate by
    its deterministic id, so history stays correct whatever the delay.
    """
    return records.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["source_key", "evidence_key"])


def run_health_stream(runs: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Runs and records per source, window, status and failure kind.

    In append mode a window is emitted as it closes, in update mode (``write_updates``) whenever it changes, open ones included.
    """
    return (
        runs.withWatermark("started_at", delay)
        .groupBy(F.window("started_at", width), "source_key", "status", "failure_kind")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("records_count").alias("records"))
        .select("source_key", F.col("window.start").alias("window_start"), "status", "failure_kind", "runs", "records")
    )


def fixture_heads(revisions: DataFrame, fixture: str = "fixture_key", revision: str = "revision") -> DataFrame:
    """Live head per fixture: the highest revision seen so far, updated as revisions arrive in any order.

    A streaming ``max_by`` keeps one row of state per fixture and combines map-side; a late lower revision
    leaves the head as it is.  Write in update mode.
    """
    rest = [c for c in revisions.columns if c != fixture]
    head = revisions.groupBy(fixture).agg(F.max_by(F.struct(*rest), F.col(revision)).alias("_head"))
    return head.select(fixture, "_head.*")


def append_history(revisions: DataFrame, path: str, checkpoint: str):
    """Every revision, however late, appended to the history: no watermark filters this sink."""
    return (
        revisions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def write_updates(updates: DataFrame, path: str, checkpoint: str):
    """Rows of an update-mode query, a folder per batch.

    A batch that is run again after a failure replaces its own folder, so nothing is written twice.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def read_updates(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key among the batches of ``write_updates``."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = [f.name for f in schema.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_newest")).select(*keys, "_newest.*")
