"""Dataset import: documents to canonical tables, checked as a whole before anything is written."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions.ids import canonical_id, optional_id
from pitchlake.functions.timing import to_utc
from pitchlake.operators import canonical as c
from pitchlake.operators import quality as q
from pitchlake.session import Scratch, shuffles_freed
from pitchlake.sources import documents as d
from pitchlake.sources import keys
from pitchlake.sources.store import JOBS_AT_ONCE, TableStore

# Tables that grow with the fixtures; the others follow the seeds.
LARGE = ("matches", "match_revisions", "collector_runs", "raw_source_records")


class ImportConflict(ValueError):
    """A deterministic id met different content; nothing was written."""

    def __init__(self, sample: list, summary: DataFrame) -> None:
        super().__init__(f"conflicting replay: {sample}")
        self.sample = sample
        self.summary = summary


def seed_tables(flat: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Canonical rows of flattened seeds: entities, competitions, clubs, seasons, rules, participations."""
    competition_id = canonical_id("competition", F.col("key"))
    club_id = canonical_id("club", F.col("key"))
    competitions = flat["competitions"].select(
        competition_id.alias("entity_id"), F.col("name").alias("canonical_name"), "country_code", "competition_type"
    )
    clubs = flat["clubs"].select(
        club_id.alias("entity_id"), F.col("name").alias("canonical_name"),
        F.lit(None).cast("string").alias("short_name"), "country_code",
    )

    def entities(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(
            F.col("entity_id").alias("id"), F.lit(kind).alias("entity_type"),
            F.lit(None).cast("timestamp").alias("retired_at"),
        )

    season_id = canonical_id("season", F.col("competition_key"), F.col("season_key"))
    owner = canonical_id("competition", F.col("competition_key"))
    seasons = flat["seasons"]
    return {
        "canonical_entities": entities(competitions, "competition").unionByName(entities(clubs, "club")),
        "competitions": competitions,
        "clubs": clubs,
        "competition_seasons": seasons.select(
            season_id.alias("id"), owner.alias("competition_id"), "season_key", "starts_on", "ends_on"
        ),
        "season_rule_versions": seasons.select(
            canonical_id(
                "season_rule", F.col("competition_key"), F.col("season_key"), F.col("rules.version")
            ).alias("id"),
            season_id.alias("competition_season_id"),
            F.col("rules.version").alias("version"),
            to_utc(F.col("rules_valid_from")).alias("valid_from"),
            to_utc(F.col("rules_observed_at")).alias("observed_at"),
            F.lit(None).cast("string").alias("supersedes_id"),
            F.to_json("rules").alias("rules"),
        ),
        "season_club_participations": flat["participants"].select(
            canonical_id(
                "season_participation", F.col("competition_key"), F.col("season_key"), F.col("club_key")
            ).alias("id"),
            season_id.alias("competition_season_id"),
            canonical_id("club", F.col("club_key")).alias("club_id"),
            F.col("entry").alias("entry_type"),
            F.col("exit").alias("exit_type"),
            optional_id("competition", F.col("from_competition_key")).alias("from_competition_id"),
            optional_id("competition", F.col("to_competition_key")).alias("to_competition_id"),
        ),
    }


def history_tables(observations: DataFrame) -> dict[str, DataFrame]:
    """Match identities and revisions of flattened observations (times as instants)."""
    match_id = canonical_id("match", F.col("fixture_key"))
    identity = observations.select(
        "competition_key", "season_key", "fixture_key", "home_club_key", "away_club_key"
    ).distinct()
    return {
        "matches": identity.select(
            match_id.alias("id"),
            canonical_id("season", F.col("competition_key"), F.col("season_key")).alias("competition_season_id"),
            canonical_id("club", F.col("home_club_key")).alias("home_club_id"),
            canonical_id("club", F.col("away_club_key")).alias("away_club_id"),
        ),
        "match_revisions": observations.select(
            canonical_id("match_revision", F.col("fixture_key"), F.col("revision")).alias("id"),
            match_id.alias("match_id"),
            F.col("revision").alias("revision_number"),
            "revision_kind",
            "observed_at",
            "kickoff_at",
            "status",
            "home_score",
            "away_score",
            "reason",
        ),
    }


def evidence_tables(flat: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Sources, configs, runs and raw envelopes of flattened manifests (payloads are not stored)."""
    source_id = canonical_id("source", F.col("source_key"))
    run_id = canonical_id("collector_run", F.col("source_key"), F.col("run_key"))
    nothing = F.lit(None).cast("string")
    sources = flat["sources"].withColumn("source_key", F.col("key"))
    return {
        "sources": sources.select(
            source_id.alias("id"), "key", "name", "base_url", F.col("reliability").cast("decimal(5,4)").alias("reliability"),
            "licensing_notes", F.lit(None).cast("timestamp").alias("terms_reviewed_at"),
        ),
        "source_configs": sources.select(
            source_id.alias("source_id"), F.col("kind").alias("source_kind"), "parser_version", "collector_version",
            F.to_json("request_policy").alias("request_policy"), "terms_status", "commercial_use_approved",
            "robots_notes", "enabled",
        ),
        "collector_runs": flat["runs"].select(
            run_id.alias("run_id"), source_id.alias("source_id"), "run_key",
            to_utc(F.col("started_at")).alias("started_at"), to_utc(F.col("finished_at")).alias("finished_at"),
            F.lit("succeeded").alias("status"), "records_count", "parser_version", "collector_version",
            nothing.alias("failure_kind"), nothing.alias("error_message"),
        ),
        "raw_source_records": flat["evidence"].select(
            canonical_id("raw_evidence", F.col("source_key"), F.col("evidence_key")).alias("record_id"),
            source_id.alias("source_id"), run_id.alias("collector_run_id"), "evidence_key", "source_entity_id",
            to_utc(F.col("observed_at")).alias("observed_at"), to_utc(F.col("fetched_at")).alias("fetched_at"),
            "canonical_url", "media_type", "content_sha256", "raw_object_key", "parser_version", "collector_version",
            "request_context", "verification_state",
        ),
    }


def evidence_bindings(refs: DataFrame) -> DataFrame:
    """Which evidence record supports which revision."""
    return refs.select(
        canonical_id("match_revision", F.col("fixture_key"), F.col("revision")).alias("revision_id"),
        canonical_id("source", F.col("source_key")).alias("source_id"),
        canonical_id("raw_evidence", F.col("source_key"), F.col("evidence_key")).alias("raw_record_id"),
    )


def classify_all(incoming: Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every incoming table against its stored counterpart."""
    return {
        name: c.classify(rows, stored.get(name), *c.IDENTITY[name]) for name, rows in incoming.items()
    }


def import_dataset(
    store: TableStore,
    run_id: str,
    seeds: DataFrame,
    observations: DataFrame,
    manifests: DataFrame | None = None,
) -> DataFrame:
    """Import validated documents and return the summary (rows per table and in total).

    All tables are classified first; on any conflict nothing is written, and the summary that the error carries counts the conflicts, those
    of evidence bindings included.  New rows must keep the unique and foreign keys of the store.  New rows and new evidence bindings are then committed together.
    Classified rows are kept in a scratch folder meanwhile, whole only where they are new.
    """
    with shuffles_freed(store.spark), Scratch(store.spark, "classified") as scratch:
        return _imported(store, run_id, seeds, observations, manifests, scratch)


def _imported(
    store: TableStore, run_id: str, seeds: DataFrame, observations: DataFrame, manifests: DataFrame | None, scratch: Scratch
) -> DataFrame:
    flat = d.flatten_seeds(seeds)
    incoming = {**seed_tables(flat), **history_tables(observations)}
    stored = store.tables()
    bindings = None
    if manifests is not None:
        evidence = d.flatten_manifests(manifests)
        faults = d.evidence_coverage(observations, evidence["evidence_refs"]).limit(5).collect()
        if faults:
            raise d.DocumentError(f"evidence does not cover the history: {[r.asDict() for r in faults]}")
        incoming.update(evidence_tables(evidence))
        bindings = c.bind_evidence(
            evidence_bindings(evidence["evidence_refs"]), stored.get("match_revision_bindings")
        )
    # Kept, so that what is counted, what is checked and what is written are the same rows.
    plans = classify_all(incoming, stored)
    keep = lambda name: scratch.keep(_needed(name, plans[name]), name)
    small = [name for name in plans if name not in LARGE]
    with ThreadPoolExecutor(JOBS_AT_ONCE) as jobs:
        done = dict(zip(small, jobs.map(keep, small), strict=True))
    # One after the other: each shuffles its rows, and its shuffles go before the next.
    done |= {name: keep(name) for name in plans if name in LARGE}
    classified = {name: done[name] for name in plans}
    clashes = {}
    if bindings is not None:
        bindings = scratch.keep(bindings.filter(F.col("binding_action").isin("fill", "conflict")), "bindings")
        torn = bindings.filter(F.col("binding_action") == "conflict")
        clashes["match_revision_bindings"] = torn.select(F.lit("conflict").alias("action"), F.lit(1).cast("long").alias("_occurrences"))
    # The counts describe the store as it was found, so they are taken before it changes.  One row a table.
    summary = c.summarise({**classified, **clashes})
    counted = store.spark.createDataFrame(summary.collect(), summary.schema)
    sample = c.conflicts(classified).limit(5).collect()
    if not sample and bindings is not None:
        sample = bindings.filter(F.col("binding_action") == "conflict").limit(5).collect()
    if sample:
        raise ImportConflict([r.asDict() for r in sample], counted)
    new_rows = {
        name: df.filter(F.col("action") == "insert").select(*incoming[name].columns) for name, df in classified.items()
    }
    if bindings is not None:
        new_rows["match_revision_bindings"] = bindings.filter(F.col("binding_action") == "fill").drop("binding_action")
    # One kind after the other, so that the shuffles of one are gone before the next.
    for faults in keys.faults_by_kind(store, new_rows).values():
        q.enforce(faults, "keys of new rows")
    store.append(run_id, new_rows)
    return counted


def _needed(table: str, classified: DataFrame) -> DataFrame:
    """Rows that are not new without what nobody reads of them: an existing one only counts, a conflicting one is named."""
    id_column = c.IDENTITY[table][0]
    values = [column for column in classified.columns if column not in (id_column, "_occurrences", "conflicts", "action")]
    new = F.col("action") == "insert"
    return classified.withColumns(
        {id_column: F.when(F.col("action") != "existing", F.col(id_column)), **{v: F.when(new, F.col(v)) for v in values}}
    )
