"""Identity corrections and conflicting claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.session import ensure_checkpoint_dir


def current_identity(events: DataFrame, known_at: Column | None = None) -> DataFrame:
    """Where every merged entity ended up: ``entity_id, current_id``.

    ``events``: event_id, event_type (``merge`` or ``split``), subject_entity_id, target_entity_id,
    occurred_at.  Each subject's last event decides; a split makes it stand alone again.  Chains are
    followed by pointer doubling, each round checkpointed; a cycle is an error.
    """
    rows = events if known_at is None else events.filter(F.col("occurred_at") <= known_at)
    last = rows.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.max_by(F.struct("event_type", "target_entity_id"), F.struct("occurred_at", "event_id")).alias("_e")
    )
    links = last.filter((F.col("_e.event_type") == "merge") & F.col("_e.target_entity_id").isNotNull()).select(
        "entity_id", F.col("_e.target_entity_id").alias("current_id")
    )
    ensure_checkpoint_dir(events.sparkSession)
    links = links.checkpoint()
    # A round doubles the length followed, so n links settle within this many; only a cycle needs more.
    for _ in range(links.count().bit_length() + 1):
        onward = links.select(F.col("entity_id").alias("current_id"), F.col("current_id").alias("_next"))
        moved = links.join(onward, "current_id", "left").select(
            "entity_id", F.coalesce("_next", "current_id").alias("current_id"), F.col("_next").isNotNull().alias("_moved")
        )
        moved = moved.checkpoint()
        if not moved.filter(F.col("entity_id") == F.col("current_id")).isEmpty():
            raise ValueError("identity events form a cycle")
        if moved.filter("_moved").isEmpty():
            return links
        links = moved.drop("_moved")
    raise ValueError("identity events form a cycle")


def apply_identity(df: DataFrame, identity: DataFrame, column: str = "entity_id") -> DataFrame:
    """Replace an entity column by its current identity."""
    renamed = identity.select(F.col("entity_id").alias(column), F.col("current_id").alias("_current"))
    return df.join(renamed, column, "left").withColumn(column, F.coalesce("_current", column)).drop("_current")


def rank_claims(claims: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("entity_id", "field")) -> DataFrame:
    """The preferred value of each contested fact and how it won.

    ``claims``: keys, value, source_key, observed_at.  ``sources``: key, authority (higher is more
    official), reliability.  Values are ordered by best authority, best reliability, number of corroborating
    sources, latest observation, then the value itself; nothing is last-write-wins.  Claims are combined per
    value before values compete, so neither step gathers a key.
    """
    ranked = sources.select(F.col("key").alias("source_key"), "authority", "reliability")
    joined = claims.join(ranked, "source_key", "left")
    per_source = joined.groupBy(*keys, "value", "source_key").agg(
        F.max("authority").alias("authority"), F.max("reliability").alias("reliability"),
        F.max("observed_at").alias("observed_at"),
    )
    per_value = per_source.groupBy(*keys, "value").agg(
        F.max(F.coalesce("authority", F.lit(0))).alias("authority"),
        F.max(F.coalesce("reliability", F.lit(0.0))).alias("reliability"),
        F.count(F.lit(1)).alias("corroborating"),
        F.max("observed_at").alias("observed_at"),
    )
    strength = F.struct("authority", "reliability", "corroborating", "observed_at", "value")
    best = per_value.groupBy(*keys).agg(F.max(strength).alias("_best"), F.count(F.lit(1)).alias("values"))
    return best.select(*keys, "_best.value", "_best.authority", "_best.reliability", "_best.corroborating",
                       F.col("_best.observed_at").alias("observed_at"), "values")
