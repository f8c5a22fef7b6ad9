"""Idempotent import into canonical tables: classify, bind provenance, keep heads.

Every row has a deterministic id, so replays meet their stored row in one equi-join on a unique key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.temporal import latest

# Table -> (id column, fields that must be equal on replay).
IDENTITY: Mapping[str, tuple[str, tuple[str, ...]]] = {
    "canonical_entities": ("id", ("entity_type", "retired_at")),
    "competitions": ("entity_id", ("canonical_name", "country_code", "competition_type")),
    "clubs": ("entity_id", ("canonical_name", "country_code")),
    "competition_seasons": ("id", ("competition_id", "season_key", "starts_on", "ends_on")),
    "season_rule_versions": (
        "id", ("competition_season_id", "version", "valid_from", "observed_at", "supersedes_id", "rules"),
    ),
    "season_club_participations": (
        "id",
        ("competition_season_id", "club_id", "entry_type", "exit_type", "from_competition_id", "to_competition_id"),
    ),
    "sources": ("id", ("key", "name", "base_url", "reliability", "licensing_notes")),
    "source_configs": (
        "source_id",
        (
            "source_kind", "parser_version", "collector_version", "request_policy", "terms_status",
            "commercial_use_approved", "robots_notes", "enabled",
        ),
    ),
    "collector_runs": (
        "run_id",
        (
            "source_id", "run_key", "started_at", "finished_at", "status", "records_count", "parser_version",
            "collector_version", "failure_kind", "error_message",
        ),
    ),
    "raw_source_records": (
        "record_id",
        (
            "source_id", "collector_run_id", "evidence_key", "source_entity_id", "observed_at", "fetched_at",
            "canonical_url", "media_type", "content_sha256", "raw_object_key", "parser_version",
            "collector_version", "request_context", "verification_state",
        ),
    ),
    "matches": ("id", ("competition_season_id", "home_club_id", "away_club_id")),
    "match_revisions": (
        "id",
        (
            "match_id", "revision_number", "revision_kind", "observed_at", "kickoff_at", "status", "home_score",
            "away_score", "reason",
        ),
    ),
}


def collapse(incoming: DataFrame, id_column: str, fields: Sequence[str]) -> DataFrame:
    """One row per id with ``_occurrences`` and the fields on which the batch contradicts itself.

    Repeats of an id within a batch count as existing rows when they agree.  Of the fields that differ, those
    between the smallest and the largest row are named, which always includes one.
    """
    return _collapsed(incoming, id_column, fields).drop("_id")


def _collapsed(incoming: DataFrame, id_column: str, fields: Sequence[str]) -> DataFrame:
    """``collapse`` with ``_id``, the id as a key that a null does not break; the rows stay partitioned by it.

    Rows cross the network once and equal ones are counted by hashing.  Only those of ids with several different rows are compared.
    """
    rest = [c for c in incoming.columns if c != id_column]
    ordered = [*fields, *[c for c in rest if c not in fields]]
    spread = incoming.withColumn("_id", F.struct(id_column)).repartition("_id")
    rows = spread.groupBy("_id", id_column, *rest).agg(F.count(F.lit(1)).alias("_rows"))
    torn = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    # Few ids, next to rows that lie in the same partitions already: hashing them spares the rows a sort.
    compared = rows.join(torn.hint("shuffle_hash"), "_id", "left_semi").groupBy("_id").agg(
        F.min(F.struct(*ordered)).alias("_row"), F.max(F.struct(*fields)).alias("_other"), F.sum("_rows").alias("_all")
    )
    row = F.struct(*ordered)
    kept = rows.join(compared.hint("shuffle_hash"), "_id", "left").filter(F.col("_row").isNull() | row.eqNullSafe(F.col("_row")))
    differing = [F.when(F.col("_row").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_other.{f}")), F.lit(f)) for f in fields]
    return kept.select(
        "_id", id_column, *ordered, F.coalesce("_all", "_rows").alias("_occurrences"), F.array_compact(F.array(*differing)).alias("_disagreeing")
    )


def classify(
    incoming: DataFrame, stored: DataFrame | None, id_column: str, fields: Sequence[str]
) -> DataFrame:
    """Incoming rows with ``action`` (insert, existing, conflict) and the conflicting fields.

    ``conflicts`` lists ``(field, stored, incoming)`` as text; a null equals a null.
    """
    rows = _collapsed(incoming, id_column, fields)
    own = F.transform("_disagreeing", lambda f: F.struct(
        f.alias("field"), F.lit("<differs within batch>").alias("stored"), F.lit("<differs within batch>").alias("incoming")
    ))
    if stored is None:
        compared = rows.withColumns({"_stored": F.lit(None).cast("boolean"), "conflicts": own})
    else:
        kept = stored.filter(F.col(id_column).isNotNull()).select(
            F.struct(id_column).alias("_id"), F.lit(True).alias("_stored"), *[F.col(f).alias(f"_s_{f}") for f in fields]
        )
        rows = rows.join(kept, "_id", "left")
        differences = [
            F.when(
                F.col("_stored") & ~F.col(f).eqNullSafe(F.col(f"_s_{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"_s_{f}").cast("string").alias("stored"),
                    F.col(f).cast("string").alias("incoming"),
                ),
            )
            for f in fields
        ]
        compared = rows.withColumn("conflicts", F.concat(own, F.array_compact(F.array(*differences)))).drop(
            *[f"_s_{f}" for f in fields]
        )
    action = F.when(F.size("conflicts") > 0, "conflict").when(F.col("_stored"), "existing").otherwise("insert")
    return compared.withColumn("action", action).drop("_id", "_stored", "_disagreeing")


def summarise(classified: Mapping[str, DataFrame]) -> DataFrame:
    """Rows inserted, existing and conflicting per table, plus a grand total (``table_name`` null)."""
    parts = [
        df.select(F.lit(name).alias("table_name"), "action", "_occurrences") for name, df in classified.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    insert, existing = F.col("action") == "insert", F.col("action") == "existing"
    repeats = F.col("_occurrences") - 1
    return rows.rollup("table_name").agg(
        F.coalesce(F.sum(F.when(insert, 1)), F.lit(0)).alias("inserted"),
        F.coalesce(
            F.sum(F.when(existing, F.col("_occurrences")).when(insert, repeats)), F.lit(0)
        ).alias("existing"),
        F.coalesce(F.sum(F.when(F.col("action") == "conflict", 1)), F.lit(0)).alias("conflicting"),
    )


def conflicts(classified: Mapping[str, DataFrame]) -> DataFrame:
    """All conflicting fields over all tables."""
    parts = []
    for name, df in classified.items():
        id_column = IDENTITY[name][0]
        parts.append(
            df.filter(F.col("action") == "conflict").select(
                F.lit(name).alias("table_name"), F.col(id_column).cast("string").alias("id"), F.inline("conflicts")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def bind_evidence(incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Late provenance: what the incoming bindings of a revision do to the stored one, one row a revision.

    Rows: revision_id, source_id, raw_record_id.  ``binding_action`` is ``fill`` (stored side unbound), ``same``,
    ``conflict`` (different, half-set, or two incoming ones that disagree), or ``none`` (nothing incoming).  Bindings
    without source and record say nothing and yield to any other of their revision.
    """
    pair = F.to_json(F.struct("source_id", "raw_record_id"), {"ignoreNullFields": "false"})
    said = F.when(F.col("source_id").isNotNull() | F.col("raw_record_id").isNotNull(), pair)
    kinds = [f"{c} {incoming.schema[c].dataType.simpleString()}" for c in ("source_id", "raw_record_id")]
    collapsed = incoming.groupBy("revision_id").agg(F.min(said).alias("_low"), F.max(said).alias("_high"))
    rows = collapsed.select(
        "revision_id", F.from_json("_low", ", ".join(kinds)).alias("_one"), (F.col("_low") != F.col("_high")).alias("_torn")
    ).select("revision_id", "_one.source_id", "_one.raw_record_id", "_torn")
    if stored is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("_source", "_record")})
    else:
        kept = stored.select(
            "revision_id", F.col("source_id").alias("_source"), F.col("raw_record_id").alias("_record")
        )
        rows = rows.join(kept, "revision_id", "left")
    source, record = F.col("source_id"), F.col("raw_record_id")
    action = (
        F.when(F.col("_torn"), "conflict")
        .when(source.isNull() & record.isNull(), "none")
        .when(source.isNull() | record.isNull(), "conflict")
        .when(F.col("_source").isNull() & F.col("_record").isNull(), "fill")
        .when(source.eqNullSafe(F.col("_source")) & record.eqNullSafe(F.col("_record")), "same")
        .otherwise("conflict")
    )
    return rows.withColumn("binding_action", action).drop("_source", "_record", "_torn")


def match_heads(matches: DataFrame, revisions: DataFrame) -> DataFrame:
    """Matches with the moving head taken from their highest stored revision.

    Derived on read, so a stale replay cannot roll a head back.
    """
    head = latest(revisions.select("match_id", "revision_number", "kickoff_at", "status", "home_score", "away_score"),
                  "match_id", "revision_number")
    return matches.join(head.withColumnRenamed("match_id", "id"), "id", "left")


def season_rules(seasons: DataFrame, versions: DataFrame) -> DataFrame:
    """Seasons with the rules of their highest version, so replaying an older version changes nothing."""
    newest = versions.groupBy(F.col("competition_season_id").alias("id")).agg(
        F.max_by("rules", "version").alias("rules"), F.max("version").alias("rules_version")
    )
    return seasons.join(newest, "id", "left")


def max_revision(revisions: DataFrame) -> DataFrame:
    """Highest stored revision number per match."""
    return revisions.groupBy("match_id").agg(F.max("revision_number").alias("max_revision"))


def trace_provenance(
    revisions: DataFrame, bindings: DataFrame, raw_records: DataFrame, runs: DataFrame, sources: DataFrame
) -> DataFrame:
    """Each revision with its evidence record, the run that fetched it and the source behind it.

    The run and source sides are small; whether they are broadcast is left to their measured size.
    """
    record = raw_records.select(
        F.col("record_id").alias("raw_record_id"), "collector_run_id", "evidence_key", "content_sha256",
        F.col("observed_at").alias("evidence_observed_at"),
    )
    run = runs.select(F.col("run_id").alias("collector_run_id"), "run_key", F.col("status").alias("run_status"))
    source = sources.select(F.col("id").alias("source_id"), F.col("key").alias("source_key"))
    return (
        revisions.join(bindings.withColumnRenamed("revision_id", "id"), "id", "left")
        .join(record, "raw_record_id", "left")
        .join(run, "collector_run_id", "left")
        .join(source, "source_id", "left")
    )


def historical_matches(revisions: DataFrame, policy: str = "latest_final") -> DataFrame:
    """Results for the models: one row per fixture with a finished or awarded revision.

    ``first_final`` takes the lowest such revision and ``latest_final`` the highest; the result counts as
    observed when the chosen revision was.
    """
    final = revisions.filter(F.col("status").isin("finished", "awarded"))
    if policy not in ("first_final", "latest_final"):
        raise ValueError("policy must be first_final or latest_final")
    order = F.col("revision") if policy == "latest_final" else -F.col("revision")
    rest = [c for c in final.columns if c != "fixture_key"]
    chosen = final.groupBy("fixture_key").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("fixture_key", "_r.*")
    return chosen.withColumnsRenamed(
        {"observed_at": "result_observed_at", "home_score": "home_goals", "away_score": "away_goals"}
    )


def json_text(*columns: str | Column) -> Column:
    """Columns as one JSON text, nulls kept, for fields stored as JSON."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
