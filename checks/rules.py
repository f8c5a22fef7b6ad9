"""Rule queries: rows of whole tables that break one rule each in turn, instants and ids of texts, runs that fail without a kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import history
from pitchlake.functions.ids import optional_id
from pitchlake.functions.timing import to_utc
from pitchlake.operators import quality as q
from pitchlake.sources import adapters as ad
from pitchlake.sources import ingest

# Row k breaks the rule numbered k modulo this, if there is one.
TURN = 32
NULL = "cast(null as string)"
EARLY, LATE = "timestamp '2024-01-01 00:00:00'", "timestamp '2024-02-01 00:00:00'"


def _rules(version=1, legs=2, relegation=1, promotion=1, ranking="'points', 'goal_difference'") -> str:
    return (
        f"named_struct('version', {version}, 'round_robin_legs', {legs}, 'relegation_places', {relegation}, "
        f"'promotion_places_into_season', {promotion}, 'ranking', array({ranking}))"
    )


def _refs(key="'f'", revision=1) -> str:
    return f"array(named_struct('fixture_key', {key}, 'revision', {revision}))"


# Table: its rules, a row that keeps them all, and changes (rule, column, value) that break just that rule.
TABLES = {
    "competitions": (q.COMPETITION_RULES, {"format_version": "1", "country_code": "'NOR'", "competition_type": "'league'", "timezone": "'Europe/Oslo'"}, [
        ("format_version_minimum", "format_version", "0"), ("country_code_length", "country_code", "'NO'"), ("country_code_length", "country_code", NULL),
        ("competition_type_vocabulary", "competition_type", "'friendly tour'"), ("timezone_known", "timezone", "'Europe/Atlantis'"),
    ]),
    "clubs": (q.CLUB_RULES, {"key": "'a'", "name": "repeat('n', 160)", "country_code": "'NOR'"}, [
        ("key_length", "key", "''"), ("key_length", "key", "repeat('k', 81)"), ("name_length", "name", "repeat('n', 161)"), ("name_length", "name", NULL),
        ("country_code_length", "country_code", "'NORW'"),
    ]),
    "seasons": (q.SEASON_RULES, {
        "starts_on": "date '2024-01-01'", "ends_on": "date '2024-12-31'", "rules_valid_from": "'2024-01-01T00:00:00Z'",
        "rules_observed_at": "'2024-01-01T00:00:00+01:00'", "rules": _rules(),
    }, [
        ("ends_after_start", "ends_on", "date '2024-01-01'"), ("rules_valid_from_zoned", "rules_valid_from", "'2024-01-01T00:00:00'"),
        ("rules_observed_at_zoned", "rules_observed_at", NULL), ("rules_version_minimum", "rules", _rules(version=0)),
        ("round_robin_legs_minimum", "rules", _rules(legs=0)), ("relegation_places_minimum", "rules", _rules(relegation=-1)),
        ("promotion_places_minimum", "rules", _rules(promotion=-1)), ("ranking_vocabulary", "rules", _rules(ranking="'points', 'luck'")),
    ]),
    "participants": (q.PARTICIPANT_RULES, {"entry": "'continuing'", "exit": NULL}, [
        ("entry_vocabulary", "entry", "'guest'"), ("entry_vocabulary", "entry", NULL), ("exit_vocabulary", "exit", "'vanished'"),
    ]),
    "evidence": (q.EVIDENCE_RULES, {
        "evidence_key": "'page:1'", "observed_at": "'2024-01-02T00:00:00Z'", "fetched_at": "'2024-01-02T01:00:00Z'", "media_type": "'text/html'",
        "source_entity_id": NULL, "raw_object_key": "repeat('o', 1024)", "verification_state": "'raw'", "observations": _refs(),
        "started_at": "'2024-01-01T00:00:00Z'", "finished_at": "'2024-01-03T00:00:00Z'",
    }, [
        ("evidence_key_pattern", "evidence_key", "'Page 1'"), ("evidence_key_length", "evidence_key", "repeat('e', 257)"),
        ("observed_at_zoned", "observed_at", "'2024-01-02T00:00:00'"), ("fetched_at_zoned", "fetched_at", "'2024-01-02T01:00:00'"),
        ("fetched_after_observed", "observed_at", "'2024-01-02T01:00:01Z'"), ("media_type_length", "media_type", "''"),
        ("source_entity_id_length", "source_entity_id", "repeat('s', 257)"), ("raw_object_key_length", "raw_object_key", "repeat('o', 1025)"),
        ("verification_state_vocabulary", "verification_state", "'rumour'"),
        ("observation_refs", "observations", _refs(revision=0)), ("observation_refs", "observations", _refs(key="repeat('f', 161)")),
        ("fetched_inside_run", "finished_at", "'2024-01-02T00:59:59Z'"), ("fetched_inside_run", "started_at", "'2024-01-02T01:00:01Z'"),
        ("has_observations", "observations", f"filter({_refs()}, x -> false)"),
    ]),
    "manifests": (q.MANIFEST_RULES, {
        "format_version": "1", "run_key": "repeat('r', 160)", "started_at": "'2024-01-01T00:00:00Z'", "finished_at": "'2024-01-01T00:00:00Z'", "records": "array('r')",
    }, [
        ("format_version_minimum", "format_version", "0"), ("run_key_pattern", "run_key", "'.run'"), ("run_key_length", "run_key", "repeat('r', 161)"),
        ("started_at_zoned", "started_at", "'2024-01-01T00:00:00'"), ("finished_at_zoned", "finished_at", "'2024-01-01T00:00:00'"),
        ("finished_after_started", "started_at", "'2024-01-01T01:00:00Z'"), ("has_records", "records", "filter(array('r'), x -> false)"),
    ]),
    "records": (q.RECORD_RULES, {"content_sha256": "sha2('x', 256)", "verification_state": "'raw'"}, [
        ("content_sha256_hex", "content_sha256", "md5('x')"), ("content_sha256_hex", "content_sha256", "repeat('g', 64)"),
        ("verification_state_vocabulary", "verification_state", NULL),
    ]),
    "aliases": (q.ALIAS_RULES, {"valid_from": EARLY, "valid_until": LATE}, [("valid_until_after_valid_from", "valid_until", EARLY)]),
    "source_entities": (q.SOURCE_ENTITY_RULES, {"valid_from": EARLY, "valid_until": "cast(null as timestamp)", "confidence": "1.0d"}, [
        ("valid_until_after_valid_from", "valid_until", "timestamp '2023-12-31 00:00:00'"), ("confidence_probability", "confidence", "1.01d"),
        ("confidence_probability", "confidence", "cast(null as double)"),
    ]),
    "candidate_scores": (q.CANDIDATE_SCORE_RULES, {"score": "0.0d", "name_score": "1.0d"}, [
        ("score_probability", "score", "-0.01d"), ("name_score_probability", "name_score", "double('nan')"),
    ]),
    "team_states": (q.TEAM_STATE_RULES, {"uncertainty": "0.0d"}, [
        ("uncertainty_minimum", "uncertainty", "-0.01d"), ("uncertainty_minimum", "uncertainty", "cast(null as double)"),
    ]),
    "collector_runs": (q.COLLECTOR_RUN_RULES, {"records_count": "0", "status": "'succeeded'", "failure_kind": NULL}, [
        ("records_count_minimum", "records_count", "-1"), ("status_vocabulary", "status", "'tired'"), ("failure_kind_vocabulary", "failure_kind", "'bad luck'"),
    ]),
    "decisions": (q.DECISION_RULES, {"top_score": "cast(null as double)"}, [("top_score_probability", "top_score", "1.5d")]),
    "backtest_runs": (q.RUN_RULES, {"lead_time_seconds": "1", "seed": "0"}, [
        ("positive_lead_time", "lead_time_seconds", "0"), ("seed_minimum", "seed", "-1"),
    ]),
}


def _breaches(rows: DataFrame, table: str) -> DataFrame:
    rules, sound, changes = TABLES[table]
    turn = F.col("event_id") % TURN

    def value(column: str) -> Column:
        out = F.expr(sound[column])
        for number, (_, changed, wrong) in enumerate(changes):
            out = F.when(turn == number, F.expr(wrong)).otherwise(out) if changed == column else out
        return out.alias(column)

    faults = q.violations(rows.select("event_id", *map(value, sound)), rules, ["event_id"])
    return faults.groupBy("rule_id").agg(F.count(F.lit(1)).alias("breaches"), F.sum("event_id").alias("ids")).withColumn("table_name", F.lit(table))


def rule_breaches(spark, sf):
    """Breaches per table and rule; a row breaks one rule at most, so no other may be named."""
    rows = ad.table(spark, sf, "events").select("event_id")
    return reduce(DataFrame.unionByName, [_breaches(rows, table) for table in TABLES])


def zoned_instants(spark, sf):
    """Texts with and without a zone as instants, and the ids of keys that may be missing."""
    offsets = F.array(*map(F.lit, ("Z", "+02:00", "-05:30", "")))
    events = ad.table(spark, sf, "events").withColumn("text", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.get(offsets, (F.col("event_id") % 4).cast("int"))))
    key = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return events.select("event_id", to_utc(F.col("text")).cast("timestamp_ntz").alias("instant"), optional_id("competition", key).alias("competition_id"))


def failures_without_kind(spark, sf):
    """Runs of customers over their orders; every fifth failed and says no more than that."""
    runs = ad.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit("src").alias("source_key"), F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.when(F.col("c_custkey") % 5 == 0, "connection lost").alias("failure_message"),
        F.when(F.col("c_custkey") % 10 == 0, True).alias("retryable"),
    )
    records = ad.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ordinal"), F.lit("src").alias("source_key"), F.lit("p1").alias("parser_version"),
        F.lit("c1").alias("collector_version"),
    )
    source = spark.range(1).select(
        F.lit("src").alias("key"), F.lit("p1").alias("parser_version"), F.lit("c1").alias("collector_version"), F.lit(True).alias("enabled"),
        F.lit(True).alias("commercial_use_approved"), F.lit("licensed").alias("terms_status"),
    )
    found = ingest.ingest_run(runs, records, source)[1]
    return found.select("run_id", "status", "records_count", "failure_kind", "error_message", "retryable")


QUERIES = {f.__name__: f for f in (rule_breaches, zoned_instants, failures_without_kind)}

_CHANGES = ", ".join(
    f"('{table}', '{rule}', {number})" for table, (_, _, changes) in TABLES.items() for number, (rule, _, _) in enumerate(changes)
)
SQL = {
    "rule_breaches": f"""
select table_name, rule_id, count(*) as breaches, sum(event_id)::bigint as ids
from events join (values {_CHANGES}) c(table_name, rule_id, turn) on event_id % {TURN} = turn group by all""",
    "zoned_instants": f"""
select event_id, case event_id % 4 when 0 then t when 1 then t - interval 2 hour when 2 then t + interval 330 minute end as instant,
  case when event_id % 3 <> 0 then {history._uuid5("'competition:' || event_type")} end as competition_id
from (select *, date_trunc('second', ts)::timestamp as t from events)""",
    "failures_without_kind": """
select c_custkey as run_id, case when c_custkey % 5 = 0 then 'failed' else 'succeeded' end as status,
  case when c_custkey % 5 = 0 then 0 else (select count(*) from orders where o_custkey = c_custkey) end::bigint as records_count,
  case when c_custkey % 5 = 0 then 'unknown' end as failure_kind, case when c_custkey % 5 = 0 then 'connection lost' end as error_message,
  case when c_custkey % 5 = 0 then c_custkey % 10 = 0 end as retryable from customer""",
}
