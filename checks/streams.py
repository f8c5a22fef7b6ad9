"""Streaming queries: the given tables replayed through Structured Streaming until they are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import forecasts
from pitchlake.plans.models import EloModel
from pitchlake.session import ensure_checkpoint_dir
from pitchlake.sources import adapters as ad
from pitchlake.streaming import elo, records


def _scratch(spark) -> str:
    """A fresh folder beside the session's checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _drain(spark, df: DataFrame) -> DataFrame:
    """Run an append-mode query over everything available into Parquet and read it back."""
    folder = _scratch(spark)
    query = (
        df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def streamed_records(spark, sf):
    """Page views as evidence, once per user and kind within the watermark."""
    events = _stream(spark, sf, "events").select(
        F.col("event_type").alias("source_key"), F.col("user_id").cast("string").alias("evidence_key"),
        F.col("ts").cast("timestamp").alias("observed_at"),
    )
    return _drain(spark, records.deduplicated_records(events, "3650 days")).select("source_key", "evidence_key")


def _kept_up(spark, df: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode query over everything available and read the newest row of each key."""
    folder = _scratch(spark)
    query = records.write_updates(df, f"{folder}/out", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return records.read_updates(spark, f"{folder}/out", df.schema, keys)


def streamed_heads(spark, sf):
    """The newest event of every user, kept up as events come in any order."""
    events = _stream(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return _kept_up(spark, records.fixture_heads(events, "user_id", "event_id"), ["user_id"])


def streamed_elo(spark, sf):
    """Both clubs' ratings after every match.  A row without a match, ten years on, lets the last results go."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _stream(spark, sf, "orders").createOrReplaceTempView("orders")
    results = spark.sql(ad.VIEWS["matches"])
    later = results.select(
        *[F.lit(None).cast(results.schema[c].dataType).alias(c) if c == "match_id" else (
            (F.col(c) + F.expr("interval 3650 days")).alias(c) if c == "result_observed_at" else F.col(c)) for c in results.columns]
    )
    rated = elo.online_elo(results.unionByName(later), EloModel(), "1 day")
    return forecasts.rounded(_drain(spark, rated).select("competition_key", "match_id", "club_id", "rating"))


def streamed_run_health(spark, sf):
    events = _stream(spark, sf, "events").select(
        F.col("event_type").alias("source_key"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("value") > 60, "failed").otherwise("succeeded").alias("status"),
        F.when(F.col("value") > 60, "network").alias("failure_kind"), F.lit(1).alias("records_count"),
    )
    health = _kept_up(spark, records.run_health_stream(events, "1 hour", "1 hour"), ["source_key", "window_start", "status", "failure_kind"])
    return health.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


SQL = {
    "streamed_records": "select distinct event_type as source_key, cast(user_id as varchar) as evidence_key from events",
    "streamed_heads": """
select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id""",
    "streamed_elo": f"""{forecasts._ELO},
after as (select e.competition_key, o.match_id, o.home_club_id, o.away_club_id, e.r from ord o join elo e on e.competition_key = o.competition_key and e.rn = o.rn)
select competition_key::varchar as competition_key, match_id::varchar as match_id, home_club_id::varchar as club_id, round(r[home_club_id + 1], 6) as rating from after
union all select competition_key::varchar, match_id::varchar, away_club_id::varchar, round(r[away_club_id + 1], 6) from after""",
    "streamed_run_health": """
select event_type as source_key, date_trunc('hour', ts)::timestamp as window_start,
  case when value > 60 then 'failed' else 'succeeded' end as status, case when value > 60 then 'network' end as failure_kind,
  count(*) as runs, count(*) as records from events group by all""",
}

QUERIES = {f.__name__: f for f in (streamed_records, streamed_heads, streamed_run_health, streamed_elo)}
