"""Readers of the three nested input documents, flattened into tables, with their cross-reference checks.

Timestamps are read as text, because a zone is lost once a value is cast; the rule catalogue tests the
text and the flattened tables carry instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchlake.functions.hashing import canonical_json_sha256
from pitchlake.functions.timing import to_utc
from pitchlake.operators import quality as q
from pitchlake.session import shuffles_freed

CORRUPT = "_corrupt_record"

_COMPETITION = "key STRING, name STRING, country_code STRING, competition_type STRING"
_RULES = (
    "STRUCT<version: INT, points: STRUCT<win: INT, draw: INT, loss: INT>, ranking: ARRAY<STRING>, "
    "round_robin_legs: INT, relegation_places: INT, promotion_places_into_season: INT, notes: ARRAY<STRING>>"
)
SEED_SCHEMA = (
    f"format_version INT, {_COMPETITION}, timezone STRING, "
    "related_competitions ARRAY<STRUCT<key: STRING, name: STRING, country_code: STRING, competition_type: STRING>>, "
    "clubs ARRAY<STRUCT<key: STRING, name: STRING, country_code: STRING>>, "
    "seasons ARRAY<STRUCT<key: STRING, starts_on: DATE, ends_on: DATE, rules_valid_from: STRING, "
    f"rules_observed_at: STRING, rules: {_RULES}, participants: ARRAY<STRUCT<club_key: STRING, entry: STRING, "
    f"exit: STRING, from_competition_key: STRING, to_competition_key: STRING>>>>, {CORRUPT} STRING"
)
STREAM_SCHEMA = (
    "format_version INT, competition_key STRING, season_key STRING, observations ARRAY<STRUCT<fixture_key: STRING, "
    "revision: INT, revision_kind: STRING, observed_at: STRING, kickoff_at: STRING, home_club_key: STRING, "
    f"away_club_key: STRING, status: STRING, home_score: INT, away_score: INT, reason: STRING>>, {CORRUPT} STRING"
)
_POLICY = (
    "STRUCT<requests_per_minute: INT, max_concurrency: INT, min_interval_seconds: DOUBLE, "
    "timeout_seconds: DOUBLE, max_retries: INT>"
)
SOURCE_FIELDS = (
    "key: STRING, name: STRING, kind: STRING, base_url: STRING, reliability: DOUBLE, parser_version: STRING, "
    f"collector_version: STRING, request_policy: {_POLICY}, terms_status: STRING, commercial_use_approved: BOOLEAN, "
    "licensing_notes: STRING, robots_notes: STRING, enabled: BOOLEAN"
)
MANIFEST_SCHEMA = (
    f"format_version INT, source STRUCT<{SOURCE_FIELDS}>, run_key STRING, started_at STRING, finished_at STRING, "
    "records ARRAY<STRUCT<evidence_key: STRING, observed_at: STRING, fetched_at: STRING, canonical_url: STRING, "
    "media_type: STRING, payload: STRING, source_entity_id: STRING, request_context: STRING, "
    "verification_state: STRING, raw_object_key: STRING, observations: ARRAY<STRUCT<fixture_key: STRING, "
    f"revision: INT>>>>, {CORRUPT} STRING"
)


class DocumentError(ValueError):
    """A document that cannot be read or breaks its contract."""


def read_documents(spark: SparkSession, path: str, schema: str, *, multiline: bool = True) -> DataFrame:
    """Documents under a path or glob with a declared schema; unreadable ones keep their text.

    ``multiline=False`` reads one document per line, which splits large files across tasks.
    """
    reader = (
        spark.read.schema(StructType.fromDDL(schema))
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    return reader.json(path).withColumn("document", F.input_file_name())


def _reject_unreadable(documents: DataFrame, what: str) -> DataFrame:
    # Spark wants other columns read along with the corrupt one.
    broken = documents.filter(F.col(CORRUPT).isNotNull()).select("document", "format_version", CORRUPT).limit(1).collect()
    if broken:
        raise DocumentError(f"cannot load {what} from {broken[0]['document']}")
    return documents.drop(CORRUPT)


def _require(breaches: DataFrame, what: str) -> None:
    try:
        q.enforce(breaches, what)
    except q.RuleViolation as error:
        raise DocumentError(f"invalid {what}: {error}") from error


# --- Competition seeds -------------------------------------------------------------------------------


def flatten_seeds(seeds: DataFrame) -> dict[str, DataFrame]:
    """Competitions (main and related), clubs, seasons with rules, participants."""
    main = seeds.select("key", "name", "country_code", "competition_type", F.lit(True).alias("is_main"))
    related = seeds.select(F.inline("related_competitions")).select(
        "key", "name", "country_code", "competition_type", F.lit(False).alias("is_main")
    )
    owner = F.col("key").alias("competition_key")
    seasons = seeds.select(owner, F.inline("seasons")).withColumnRenamed("key", "season_key")
    participants = seasons.select("competition_key", "season_key", F.inline("participants"))
    return {
        "competitions": main.unionByName(related),
        "clubs": seeds.select(F.inline("clubs")),
        "seasons": seasons.drop("participants"),
        "participants": participants.withColumn("exit", F.coalesce("exit", F.lit("continuing"))),
    }


def seed_violations(seeds: DataFrame) -> DataFrame:
    """Every breach of the seed contract as ``(scope, key, rule_id)``."""
    flat = flatten_seeds(seeds)

    def report(breaches: DataFrame, scope: str, key: Column) -> DataFrame:
        return breaches.select(F.lit(scope).alias("scope"), key.cast("string").alias("key"), "rule_id")

    def fault(df: DataFrame, scope: str, key: Column, rule_id: str) -> DataFrame:
        return df.select(F.lit(scope).alias("scope"), key.cast("string").alias("key"), F.lit(rule_id).alias("rule_id"))

    owner = F.col("key").alias("competition_key")
    clubs = seeds.select(owner, F.inline("clubs"))
    related = seeds.select(owner, F.inline("related_competitions"))
    season_key = F.concat_ws(":", "competition_key", "season_key")
    people = flat["participants"]
    # Identifiers ignore case, so keys that differ only in case are duplicates too.
    parts = [
        report(q.violations(seeds, q.COMPETITION_RULES, ["key"]), "competition", F.col("key")),
        report(q.violations(clubs, q.CLUB_RULES, ["key"]), "club", F.col("key")),
        report(
            q.violations(related, (*q.CLUB_RULES, q.COMPETITION_RULES[2]), ["key"]), "related", F.col("key")
        ),
        report(q.violations(flat["seasons"], q.SEASON_RULES, ["competition_key", "season_key"]), "season", season_key),
        report(
            q.violations(people, q.PARTICIPANT_RULES, ["competition_key", "season_key"]), "participant", season_key
        ),
        fault(
            q.duplicate_keys(clubs, ["competition_key", F.lower("key").alias("key")]), "club", F.col("key"), "unique"
        ),
        fault(
            q.duplicate_keys(flat["seasons"], ["competition_key", F.lower("season_key").alias("season_key")]),
            "season", season_key, "unique",
        ),
        fault(
            q.duplicate_keys(related, ["competition_key", F.lower("key").alias("key")]), "related", F.col("key"), "unique"
        ),
        fault(related.filter(F.lower("key") == F.lower("competition_key")), "related", F.col("key"), "external"),
        fault(
            q.duplicate_keys(people, ["competition_key", "season_key", "club_key"]), "participant", F.col("club_key"),
            "unique",
        ),
        fault(
            q.orphans(
                people.select("competition_key", "club_key"), ["competition_key", "club_key"],
                clubs, ["competition_key", "key"],
            ),
            "participant", F.col("club_key"), "unknown_club",
        ),
    ]
    known = related.select("competition_key", "key").unionByName(seeds.select(owner, "key"))
    referenced = people.select(
        "competition_key", F.explode(F.array("from_competition_key", "to_competition_key")).alias("key")
    )
    unknown = q.orphans(referenced, ["competition_key", "key"], known, ["competition_key", "key"])
    parts.append(fault(unknown, "participant", F.col("key"), "unknown_competition"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def load_seeds(spark: SparkSession, path: str, **options) -> DataFrame:
    """Validated seeds; raises ``DocumentError`` on unreadable or invalid ones."""
    seeds = _reject_unreadable(read_documents(spark, path, SEED_SCHEMA, **options), "competition seed")
    with shuffles_freed(spark):
        _require(seed_violations(seeds), "competition seed")
    return seeds


def season_lookup(seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ``(competition_key, season_key)`` pairs that do not name exactly one season."""
    seasons = flatten_seeds(seeds)["seasons"].groupBy("competition_key", "season_key").agg(
        F.count(F.lit(1)).alias("seasons")
    )
    found = wanted.select("competition_key", "season_key").distinct().join(
        seasons, ["competition_key", "season_key"], "left"
    )
    return found.filter(F.coalesce("seasons", F.lit(0)) != 1)


# --- Fixture histories -------------------------------------------------------------------------------


def flatten_streams(streams: DataFrame) -> DataFrame:
    """One row per observation, timestamps still text."""
    return streams.select("competition_key", "season_key", F.inline("observations"))


def observation_instants(observations: DataFrame) -> DataFrame:
    """Observed and kickoff times as instants."""
    return observations.withColumns(
        {"observed_at": to_utc(F.col("observed_at")), "kickoff_at": to_utc(F.col("kickoff_at"))}
    )


def non_participants(observations: DataFrame, participants: DataFrame) -> DataFrame:
    """Clubs an observation names that do not take part in its season."""
    keys = ["competition_key", "season_key", "club_key"]
    named = observations.select(
        "competition_key", "season_key", F.explode(F.array("home_club_key", "away_club_key")).alias("club_key")
    )
    return q.orphans(named, keys, participants, keys)


def load_fixture_streams(spark: SparkSession, path: str, seeds: DataFrame, **options) -> DataFrame:
    """Validated observations with instants; raises ``DocumentError``."""
    from pitchlake.operators.temporal import timeline_faults

    streams = _reject_unreadable(read_documents(spark, path, STREAM_SCHEMA, **options), "fixture stream")
    raw = flatten_streams(streams)
    _require(q.violations(raw, q.OBSERVATION_RULES, ["fixture_key", "revision"]), "fixture stream")
    observations = observation_instants(raw)
    with shuffles_freed(spark):
        _require(timeline_faults(observations), "fixture stream")
        if not season_lookup(seeds, streams).isEmpty():
            raise DocumentError("a stream's season is not found exactly once among the seeds of its competition")
        strangers = non_participants(observations, flatten_seeds(seeds)["participants"]).limit(5).collect()
    if strangers:
        raise DocumentError(f"clubs that do not take part in the season they play in: {[r['club_key'] for r in strangers]}")
    return observations


# --- Evidence manifests ------------------------------------------------------------------------------


def source_defaults(source: Column) -> Column:
    """A source definition with the defaults of its contract filled in."""

    def field(name: str, default) -> Column:
        return F.coalesce(source[name], F.lit(default)).alias(name)

    policy = source["request_policy"]

    def limit(name: str, default) -> Column:
        return F.coalesce(policy[name], F.lit(default)).alias(name)

    return F.struct(
        source["key"].alias("key"),
        source["name"].alias("name"),
        source["kind"].alias("kind"),
        source["base_url"].alias("base_url"),
        field("reliability", 0.5),
        source["parser_version"].alias("parser_version"),
        source["collector_version"].alias("collector_version"),
        F.struct(
            limit("requests_per_minute", 30),
            limit("max_concurrency", 1),
            limit("min_interval_seconds", 0.0),
            limit("timeout_seconds", 20.0),
            limit("max_retries", 2),
        ).alias("request_policy"),
        field("terms_status", "unreviewed"),
        field("commercial_use_approved", False),
        source["licensing_notes"].alias("licensing_notes"),
        source["robots_notes"].alias("robots_notes"),
        field("enabled", True),
    )


def flatten_manifests(manifests: DataFrame) -> dict[str, DataFrame]:
    """Sources, runs, evidence records (hashed) and the evidence-to-revision bridge."""
    manifests = manifests.withColumn("source", source_defaults(F.col("source")))
    run = [F.col("source.key").alias("source_key"), "run_key", "started_at", "finished_at"]
    versions = [F.col("source.parser_version").alias("parser_version"), F.col("source.collector_version").alias("collector_version")]
    records = manifests.select(*run, *versions, F.inline("records")).withColumns(
        {
            "media_type": F.coalesce("media_type", F.lit("application/json")),
            "verification_state": F.coalesce("verification_state", F.lit("raw")),
            "request_context": F.coalesce("request_context", F.lit("{}")),
            "content_sha256": canonical_json_sha256(F.col("payload")),
        }
    )
    return {
        "sources": manifests.select("source.*"),
        "runs": manifests.select(*run, *versions, F.size("records").alias("records_count")),
        "evidence": records,
        "evidence_refs": records.select("source_key", "evidence_key", F.inline("observations")),
    }


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Every breach of the manifest contract as ``(scope, key, rule_id)``."""
    flat = flatten_manifests(manifests)

    def fault(df: DataFrame, scope: str, key: Column, rule_id: Column) -> DataFrame:
        return df.select(F.lit(scope).alias("scope"), key.cast("string").alias("key"), rule_id.alias("rule_id"))

    ref = F.concat_ws(":", "fixture_key", F.col("revision").cast("string"))
    parts = [
        fault(q.violations(manifests, q.MANIFEST_RULES, ["run_key"]), "manifest", F.col("run_key"), F.col("rule_id")),
        fault(q.violations(flat["sources"], q.SOURCE_RULES, ["key"]), "source", F.col("key"), F.col("rule_id")),
        fault(
            q.violations(flat["evidence"], q.EVIDENCE_RULES, ["evidence_key"]), "evidence", F.col("evidence_key"),
            F.col("rule_id"),
        ),
        fault(
            q.duplicate_keys(flat["evidence"], ["source_key", "run_key", "evidence_key"]), "evidence",
            F.col("evidence_key"), F.lit("unique"),
        ),
        fault(
            q.duplicate_keys(flat["evidence_refs"], ["fixture_key", "revision"]), "reference", ref,
            F.lit("one_primary_evidence"),
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def load_manifests(spark: SparkSession, path: str, **options) -> DataFrame:
    """Validated manifests; raises ``DocumentError`` on unreadable or invalid ones."""
    manifests = _reject_unreadable(read_documents(spark, path, MANIFEST_SCHEMA, **options), "evidence manifest")
    with shuffles_freed(spark):
        _require(manifest_violations(manifests), "evidence manifest")
    return manifests


def evidence_coverage(observations: DataFrame, evidence_refs: DataFrame) -> DataFrame:
    """Revisions without evidence (``missing``) and references to no revision (``unknown``)."""
    keys = ["fixture_key", "revision"]
    expected = observations.select(*keys).distinct().withColumn("_expected", F.lit(True))
    actual = evidence_refs.select(*keys).distinct().withColumn("_actual", F.lit(True))
    both = expected.join(actual, keys, "full_outer")
    fault = F.when(F.col("_actual").isNull(), "missing").when(F.col("_expected").isNull(), "unknown")
    return both.select(*keys, fault.alias("fault")).filter(F.col("fault").isNotNull())
