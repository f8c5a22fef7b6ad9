"""Declarative data-quality rules.

A rule is a name and a condition every row must satisfy; a null condition is a breach.  ``violations``
reports all breaches, ``enforce`` stops on any, ``quarantine`` separates the rows.  Uniqueness and foreign
keys are aggregates and anti-joins on *distinct* keys, so a key that holds a third of the rows is combined
map-side before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake import vocab
from pitchlake.functions import scores
from pitchlake.functions.timing import has_offset


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: Callable[[], Column]

    def breached(self) -> Column:
        return ~F.coalesce(self.condition(), F.lit(False))


class RuleViolation(ValueError):
    """Raised by ``enforce``; carries a sample of the breaches for the message only."""

    def __init__(self, table: str, sample: list) -> None:
        super().__init__(f"{table}: {sample}")
        self.sample = sample


def _broken(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(r.breached(), F.lit(r.rule_id)) for r in rules]))


def violations(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One row per breach: the row's keys and the rule."""
    return df.select(*keys, F.explode(_broken(rules)).alias("rule_id"))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every rule, and the others with ``broken_rules``."""
    marked = df.withColumn("broken_rules", _broken(rules))
    clean = marked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return clean, marked.filter(F.size("broken_rules") > 0)


def enforce(breaches: DataFrame, table: str) -> None:
    """Raise when there is any breach (reads at most five of them)."""
    sample = breaches.limit(5).collect()
    if sample:
        raise RuleViolation(table, [r.asDict() for r in sample])


def duplicate_keys(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Keys that occur more than once, with their count; rows with a null key part are exempt."""
    rows = df.select(*keys).dropna()
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def faults(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Keys that break a rule or occur more than once, from one aggregate: ``rule_ids`` and ``occurrences``.

    Null keys make one group, whose repeats count too.  At most 63 rules, which travel as one number.
    """
    if len(rules) > 63:
        raise ValueError(f"{len(rules)} rules, above 63")
    bits = [F.when(r.breached(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    rows = df.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")).alias("_broken"))
    found = rows.groupBy(*keys).agg(F.bit_or("_broken").alias("_broken"), F.count(F.lit(1)).alias("occurrences"))
    broken = [F.when(F.col("_broken").bitwiseAND(F.lit(1 << i)) != 0, F.lit(r.rule_id)) for i, r in enumerate(rules)]
    names = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return found.filter("_broken <> 0 or occurrences > 1").select(*keys, names.alias("rule_ids"), "occurrences")


def orphans(child: DataFrame, foreign: Sequence[str], parent: DataFrame, primary: Sequence[str]) -> DataFrame:
    """Distinct foreign keys without a parent row; keys with a null part are exempt."""
    wanted = child.select(*foreign).dropna().distinct()
    known = parent.select(*[F.col(p).alias(f) for f, p in zip(foreign, primary)]).distinct()
    return wanted.join(known, list(foreign), "left_anti")


# --- Rule building blocks ----------------------------------------------------------------------------


def rule(rule_id: str, condition: Callable[[], Column]) -> Rule:
    return Rule(rule_id, condition)


def optional(column: str, condition: Callable[[Column], Column]) -> Callable[[], Column]:
    """The condition where the column is present."""
    return lambda: F.col(column).isNull() | condition(F.col(column))


def in_vocabulary(column: str, words: Sequence[str]) -> Rule:
    return rule(f"{column}_vocabulary", lambda: F.col(column).isin(*words))


def length_between(column: str, low: int, high: int) -> Rule:
    return rule(f"{column}_length", lambda: F.length(column).between(low, high))


def max_length(column: str, high: int) -> Rule:
    return rule(f"{column}_length", optional(column, lambda c: F.length(c) <= high))


def probability(column: str) -> Rule:
    return rule(f"{column}_probability", lambda: F.col(column).between(0.0, 1.0))


def at_least(column: str, low: float) -> Rule:
    return rule(f"{column}_minimum", lambda: F.col(column) >= low)


def optional_at_least(column: str, low: float) -> Rule:
    return rule(f"{column}_minimum", optional(column, lambda c: c >= low))


def zoned(column: str) -> Rule:
    """The source text carried a zone; test before the cast."""
    return rule(f"{column}_zoned", lambda: has_offset(F.col(column)))


def window_not_empty(start: str = "valid_from", end: str = "valid_until") -> Rule:
    return rule(
        f"{end}_after_{start}",
        lambda: F.col(start).isNull() | F.col(end).isNull() | (F.col(end) > F.col(start)),
    )


# --- Catalogue ---------------------------------------------------------------------------------------

KEY_PATTERN = r"^[a-z0-9][a-z0-9._-]*$"
EVIDENCE_KEY_PATTERN = r"^[a-z0-9][a-z0-9._:-]*$"


def _has_both_scores() -> Column:
    return F.col("home_score").isNotNull() & F.col("away_score").isNotNull()


def _has_no_score() -> Column:
    return F.col("home_score").isNull() & F.col("away_score").isNull()


SOURCE_RULES = (
    rule("key_pattern", lambda: F.col("key").rlike(KEY_PATTERN)),
    probability("reliability"),
    in_vocabulary("kind", vocab.SOURCE_KINDS),
    in_vocabulary("terms_status", vocab.TERMS_STATUSES),
    rule(
        "request_policy_bounds",
        lambda: (F.col("request_policy.requests_per_minute") >= 1)
        & (F.col("request_policy.max_concurrency") >= 1)
        & (F.col("request_policy.min_interval_seconds") >= 0)
        & (F.col("request_policy.timeout_seconds") > 0)
        & (F.col("request_policy.max_retries") >= 0),
    ),
)

RECORD_RULES = (
    rule("content_sha256_hex", lambda: F.lower("content_sha256").rlike("^[0-9a-f]{64}$")),
    in_vocabulary("verification_state", vocab.VERIFICATION_STATES),
)

EVENT_RULES = (window_not_empty(), probability("confidence"))

TEAM_STATE_RULES = (at_least("uncertainty", 0.0),)

ALIAS_RULES = (window_not_empty(),)

# Provider mappings and stored aliases also carry a confidence.
SOURCE_ENTITY_RULES = (window_not_empty(), probability("confidence"))

CANDIDATE_SCORE_RULES = (probability("score"), probability("name_score"))

COMPETITION_RULES = (
    at_least("format_version", 1),
    length_between("country_code", 3, 3),
    in_vocabulary("competition_type", vocab.COMPETITION_TYPES),
    rule("timezone_known", lambda: F.col("timezone").isin(*sorted(available_timezones()))),
)

CLUB_RULES = (
    length_between("key", 1, 80),
    length_between("name", 1, 160),
    length_between("country_code", 3, 3),
)

SEASON_RULES = (
    rule("ends_after_start", lambda: F.col("ends_on") > F.col("starts_on")),
    zoned("rules_valid_from"),
    zoned("rules_observed_at"),
    rule("rules_version_minimum", lambda: F.col("rules.version") >= 1),
    rule("round_robin_legs_minimum", lambda: F.col("rules.round_robin_legs") >= 1),
    rule("relegation_places_minimum", lambda: F.col("rules.relegation_places") >= 0),
    rule("promotion_places_minimum", lambda: F.col("rules.promotion_places_into_season") >= 0),
    rule(
        "ranking_vocabulary",
        lambda: F.forall("rules.ranking", lambda r: r.isin(*vocab.RANKING_RULES)),
    ),
)

PARTICIPANT_RULES = (
    in_vocabulary("entry", vocab.ENTRY_TYPES),
    rule("exit_vocabulary", lambda: F.coalesce("exit", F.lit("continuing")).isin(*vocab.EXIT_TYPES)),
)

OBSERVATION_RULES = (
    rule("different_clubs", lambda: F.col("home_club_key") != F.col("away_club_key")),
    zoned("observed_at"),
    rule("kickoff_at_zoned", optional("kickoff_at", has_offset)),
    rule("completed_requires_score", lambda: ~F.col("status").isin(*vocab.SCORED_STATUSES) | _has_both_scores()),
    rule("unplayed_has_no_score", lambda: ~F.col("status").isin(*vocab.UNPLAYED_STATUSES) | _has_no_score()),
    rule("first_revision_is_initial", lambda: (F.col("revision") != 1) | (F.col("revision_kind") == "initial")),
    rule("only_first_is_initial", lambda: (F.col("revision") <= 1) | (F.col("revision_kind") != "initial")),
    optional_at_least("home_score", 0),
    optional_at_least("away_score", 0),
    at_least("revision", 1),
    in_vocabulary("status", vocab.FIXTURE_STATUSES),
    in_vocabulary("revision_kind", vocab.REVISION_KINDS),
)

# The same rules on cast columns, without the clubs and the zone tests.
REVISION_RULES = tuple(
    r for r in OBSERVATION_RULES if r.rule_id not in ("different_clubs", "observed_at_zoned", "kickoff_at_zoned")
)

EVIDENCE_RULES = (
    rule("evidence_key_pattern", lambda: F.col("evidence_key").rlike(EVIDENCE_KEY_PATTERN)),
    max_length("evidence_key", 256),
    zoned("observed_at"),
    zoned("fetched_at"),
    rule("fetched_after_observed", lambda: F.to_timestamp("fetched_at") >= F.to_timestamp("observed_at")),
    length_between("media_type", 1, 120),
    max_length("source_entity_id", 256),
    max_length("raw_object_key", 1024),
    in_vocabulary("verification_state", vocab.VERIFICATION_STATES),
    rule("has_observations", lambda: F.size("observations") >= 1),
    rule(
        "observation_refs",
        lambda: F.forall(
            "observations", lambda o: (F.length(o["fixture_key"]).between(1, 160)) & (o["revision"] >= 1)
        ),
    ),
    rule(
        "fetched_inside_run",
        lambda: F.to_timestamp("fetched_at").between(F.to_timestamp("started_at"), F.to_timestamp("finished_at")),
    ),
)

MANIFEST_RULES = (
    at_least("format_version", 1),
    rule("run_key_pattern", lambda: F.col("run_key").rlike(EVIDENCE_KEY_PATTERN)),
    max_length("run_key", 160),
    zoned("started_at"),
    zoned("finished_at"),
    rule("finished_after_started", lambda: F.to_timestamp("finished_at") >= F.to_timestamp("started_at")),
    rule("has_records", lambda: F.size("records") >= 1),
)

PROBABILITY_RULES = (
    rule(
        "probability_vector",
        lambda: scores.is_probability_vector(F.col("p_home"), F.col("p_draw"), F.col("p_away")),
    ),
)

MATCH_RULES = (
    rule("different_clubs", lambda: F.col("home_club_id") != F.col("away_club_id")),
    at_least("home_goals", 0),
    at_least("away_goals", 0),
    rule("result_after_kickoff", lambda: F.col("result_observed_at") >= F.col("kickoff_at")),
)

PREDICTION_RULES = (
    rule("data_before_prediction", lambda: F.col("data_cutoff") <= F.col("prediction_cutoff")),
    rule(
        "market_before_prediction",
        optional("market_observed_at", lambda c: c <= F.col("prediction_cutoff")),
    ),
    probability("p_home"),
    probability("p_draw"),
    probability("p_away"),
)

RUN_RULES = (
    rule("positive_lead_time", lambda: F.col("lead_time_seconds") > 0),
    at_least("seed", 0),
)

DECISION_RULES = (rule("top_score_probability", optional("top_score", lambda c: c.between(0, 1))),)

COLLECTOR_RUN_RULES = (
    at_least("records_count", 0),
    in_vocabulary("status", vocab.RUN_STATUSES),
    rule("failure_kind_vocabulary", optional("failure_kind", lambda c: c.isin(*vocab.FAILURE_KINDS))),
)

# Unique keys of the stored tables.
UNIQUE_KEYS = {
    "competition_seasons": ("competition_id", "season_key"),
    "sources": ("key",),
    "source_entities": ("source_id", "entity_type", "external_id", "valid_from"),
    "model_versions": ("key",),
    "season_rule_versions": ("competition_season_id", "version"),
    "season_club_participations": ("competition_season_id", "club_id"),
    "match_revisions": ("match_id", "revision_number"),
    "collector_runs": ("source_id", "run_key"),
    "raw_source_records": ("source_id", "evidence_key"),
    "review_cases": ("decision_id",),
    "backtest_predictions": ("run_id", "match_id"),
}

# (child table, foreign key, parent table, primary key)
FOREIGN_KEYS = (
    ("competitions", "entity_id", "canonical_entities", "id"),
    ("clubs", "entity_id", "canonical_entities", "id"),
    ("competition_seasons", "competition_id", "competitions", "entity_id"),
    ("season_rule_versions", "competition_season_id", "competition_seasons", "id"),
    ("season_club_participations", "competition_season_id", "competition_seasons", "id"),
    ("season_club_participations", "club_id", "clubs", "entity_id"),
    ("season_club_participations", "from_competition_id", "competitions", "entity_id"),
    ("season_club_participations", "to_competition_id", "competitions", "entity_id"),
    ("matches", "competition_season_id", "competition_seasons", "id"),
    ("matches", "home_club_id", "clubs", "entity_id"),
    ("matches", "away_club_id", "clubs", "entity_id"),
    ("match_revisions", "match_id", "matches", "id"),
    ("match_revision_bindings", "revision_id", "match_revisions", "id"),
    ("match_revision_bindings", "source_id", "sources", "id"),
    ("match_revision_bindings", "raw_record_id", "raw_source_records", "record_id"),
    ("source_configs", "source_id", "sources", "id"),
    ("collector_runs", "source_id", "sources", "id"),
    ("raw_source_records", "source_id", "sources", "id"),
    ("raw_source_records", "collector_run_id", "collector_runs", "run_id"),
)


def foreign_key_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphaned keys over all declared references whose two tables are given."""
    faults = None
    for child, foreign, parent, primary in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        found = orphans(tables[child], [foreign], tables[parent], [primary]).select(
            F.lit(child).alias("table_name"), F.lit(foreign).alias("column_name"), F.col(foreign).cast("string").alias("key")
        )
        faults = found if faults is None else faults.unionByName(found)
    if faults is None:
        raise ValueError("no declared reference has both of its tables")
    return faults
