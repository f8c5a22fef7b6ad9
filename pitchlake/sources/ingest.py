"""Ingest runs: stamp source payloads as evidence, gate by policy, check the source contract.

A run's records either all pass or none do.  Which runs fail is decided by a map-side combining aggregate
per run, so a run that holds most of the records is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake import vocab
from pitchlake.functions.hashing import canonical_json_sha256
from pitchlake.functions.ids import canonical_id
from pitchlake.operators import quality as q

# The checks of one record in the order in which the first failure is reported (fixed values).
CONTRACT_CHECKS = (
    ("source_key", "collector emitted a record for a different source"),
    ("parser_version", "record parser_version differs from source definition"),
    ("collector_version", "record collector_version differs from source definition"),
)
POLICY_MESSAGE = "source is not approved for production collection"


def production_allowed(
    enabled: str = "enabled", approved: str = "commercial_use_approved", terms: str = "terms_status"
) -> Column:
    """Enabled, commercially approved, and reviewed or licensed."""
    allowed = F.col(enabled) & F.col(approved) & F.col(terms).isin(*vocab.PRODUCTION_TERMS)
    return F.coalesce(allowed, F.lit(False))


def register_sources(sources: DataFrame) -> DataFrame:
    """The source registry: duplicate keys are an error, rows come sorted by key."""
    q.enforce(q.duplicate_keys(sources, ["key"]), "source already registered")
    return sources.orderBy("key")


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled").orderBy("key")


def unknown_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Source keys named by runs or records but not registered."""
    return q.orphans(records, ["source_key"], sources, ["key"])


def stamp_records(
    payloads: DataFrame,
    *,
    evidence_key: str,
    fetched_at: Column,
    content_sha256: Column | None = None,
    media_type: str = "application/json",
) -> DataFrame:
    """Turn ``(source_key, payload, observed_at, parser_version, collector_version, ...)`` rows into records.

    Adds a record id (derived from source and evidence key, so reruns agree), fetch time, content hash,
    state ``raw`` and defaults for the optional columns.
    """
    defaults = {
        "source_entity_id": "string",
        "canonical_url": "string",
        "raw_object_key": "string",
    }
    missing = {c: F.lit(None).cast(t) for c, t in defaults.items() if c not in payloads.columns}
    if "request_context" not in payloads.columns:
        missing["request_context"] = F.lit("{}")
    if "media_type" not in payloads.columns:
        missing["media_type"] = F.lit(media_type)
    hashed = canonical_json_sha256(F.col("payload")) if content_sha256 is None else content_sha256
    return payloads.withColumns(
        {
            "record_id": canonical_id("raw_evidence", F.col("source_key"), F.col(evidence_key)),
            "fetched_at": fetched_at,
            "content_sha256": hashed,
            "verification_state": F.lit("raw"),
            **missing,
        }
    )


def ingest_run(
    runs: DataFrame, records: DataFrame, sources: DataFrame, *, production: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Accepted records and one envelope per run.

    ``runs``: run_id, source_key, started_at, finished_at, optionally failure_kind, failure_message and
    retryable for collections that failed themselves.  ``records``: run_id, source_key, parser_version,
    collector_version, ``ordinal`` (order of emission) and payload columns.  In production, runs of sources
    without approval are ``blocked``; a record that breaks its source's contract fails the whole run with
    the first breach in emission order; other failures default to kind ``unknown``, not retryable.
    """
    q.enforce(runs.filter("run_id is null or source_key is null").select("run_id", "source_key"), "run without id or source")
    q.enforce(unknown_sources(runs, sources), "unknown source")
    strays = records.join(runs.select("run_id"), "run_id", "left_anti").select("run_id", "ordinal")
    q.enforce(strays, "records of no run")
    for column, kind in (("failure_kind", "string"), ("failure_message", "string"), ("retryable", "boolean")):
        if column not in runs.columns:
            runs = runs.withColumn(column, F.lit(None).cast(kind))
    definition = sources.select(
        F.col("key").alias("source_key"),
        F.col("parser_version").alias("_parser"),
        F.col("collector_version").alias("_collector"),
        production_allowed().alias("_allowed"),
    )
    defined = runs.join(definition, "source_key")
    own_failure = F.col("failure_kind").isNotNull() | F.col("failure_message").isNotNull()
    expected = defined.select(
        "run_id", F.col("source_key").alias("_source"), "_parser", "_collector",
        (own_failure | (F.lit(production) & ~F.col("_allowed"))).alias("_stopped"),
    )
    checked = records.join(expected, "run_id")
    wrong = [
        ~F.col(name).eqNullSafe(F.col(want))
        for (name, _), want in zip(CONTRACT_CHECKS, ("_source", "_parser", "_collector"))
    ]
    first_wrong = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(wrong)])
    by_run = checked.select("run_id", "ordinal", first_wrong.alias("_check")).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_records"),
        # A null ordering is ignored, so clean records do not compete.
        F.min_by("_check", F.when(F.col("_check").isNotNull(), F.col("ordinal"))).alias("_check"),
    )
    messages = F.array(*[F.lit(text) for _, text in CONTRACT_CHECKS])
    blocked = F.lit(production) & ~F.col("_allowed")
    envelope = defined.join(by_run, "run_id", "left").withColumn(
        "status",
        F.when(blocked, "blocked").when(own_failure | F.col("_check").isNotNull(), "failed").otherwise("succeeded"),
    )
    run_rows = envelope.select(
        "run_id",
        "source_key",
        "started_at",
        "finished_at",
        "status",
        F.when(F.col("status") == "succeeded", F.coalesce("_records", F.lit(0))).otherwise(0).alias("records_count"),
        F.col("_parser").alias("parser_version"),
        F.col("_collector").alias("collector_version"),
        F.when(blocked, "policy")
        .when(own_failure, F.coalesce("failure_kind", F.lit("unknown")))
        .when(F.col("_check").isNotNull(), "schema")
        .alias("failure_kind"),
        F.when(blocked, POLICY_MESSAGE)
        .when(own_failure, F.col("failure_message"))
        .when(F.col("_check").isNotNull(), F.get(messages, F.col("_check")))
        .alias("error_message"),
        F.when(F.col("status") != "succeeded", ~blocked & own_failure & F.coalesce("retryable", F.lit(False))).alias(
            "retryable"
        ),
    )
    failed = by_run.filter(F.col("_check").isNotNull()).select("run_id")
    accepted = (
        checked.filter(~F.col("_stopped")).drop("_source", "_parser", "_collector", "_stopped")
        .join(failed, "run_id", "left_anti")
    )
    return accepted, run_rows


def run_health(runs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Runs and records per source, window, status and failure kind."""
    return (
        runs.groupBy("source_key", F.window("started_at", width).alias("_w"), "status", "failure_kind")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("records_count").alias("records"))
        .select("source_key", F.col("_w.start").alias("window_start"), "status", "failure_kind", "runs", "records")
    )
