"""Queries on history, quality rules, identifiers, ingest, imports and resolution."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.forecasts import rounded
from pitchlake.functions import hashing
from pitchlake.functions.ids import NAMESPACE, canonical_id
from pitchlake.functions.text import normalize_name
from pitchlake.operators import canonical as c
from pitchlake.operators import identity
from pitchlake.operators import quality as q
from pitchlake.operators import resolution as rs
from pitchlake.operators import temporal as tp
from pitchlake.sources import adapters as ad
from pitchlake.sources import documents as docs
from pitchlake.sources import ingest

CUTOFF = "1998-06-01 00:00:00"
# Instants in a measured bucket, so few that even the small tables have several.
BUCKET_ROWS = 2000


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _revisions(spark, sf) -> DataFrame:
    return ad.view(spark, sf, "revisions")


# --- History -----------------------------------------------------------------------------------------


def latest_as_of(spark, sf):
    return tp.latest_as_of(_revisions(spark, sf), ntz(CUTOFF))


def latest_revision(spark, sf):
    return tp.latest(_revisions(spark, sf))


def fixture_timeline(spark, sf):
    return tp.timeline(_revisions(spark, sf)).select("fixture_key", "revision", "observed_at", "status")


def _raw_numbering(spark, sf) -> DataFrame:
    """Order lines as revisions numbered by line: gaps, repeats, moving clocks and participants abound."""
    return ad.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fixture_key"),
        F.col("l_linenumber").alias("revision"),
        F.col("l_shipdate").alias("observed_at"),
        (F.col("l_suppkey") % 2).alias("home_club_key"),
        F.lit(7).alias("away_club_key"),
    )


def timeline_faults(spark, sf):
    return tp.timeline_faults(_raw_numbering(spark, sf))


def historical_matches(spark, sf):
    return c.historical_matches(_revisions(spark, sf)).select(
        "fixture_key", "revision", "result_observed_at", "home_goals", "away_goals"
    )


def first_final_matches(spark, sf):
    return c.historical_matches(_revisions(spark, sf), "first_final").select(
        "fixture_key", "revision", "result_observed_at", "home_goals", "away_goals"
    )


def event_state(spark, sf):
    events = ad.view(spark, sf, "domain_events")
    return tp.event_state(events, ntz("2024-01-05 00:00:00"), ntz("2024-01-06 12:00:00")).select(
        "entity_id", "event_type", "event_id", "valid_from", "observed_at"
    )


def event_prefixes(spark, sf):
    """What was known of a kind of event at each of its instants; few kinds with very many instants, so buckets are measured."""
    events = ad.table(spark, sf, "events").select("event_type", "ts", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    measures = {
        "events": ("sum", F.lit(1)), "cents": ("sum", F.col("cents")), "largest": ("max", F.col("cents")),
        "last_user": ("max", F.struct(F.col("ts").alias("at"), F.col("user_id").alias("user_id"))),
    }
    state = tp.prefix_state(events, events, ["event_type"], "ts", measures, bucket_rows=BUCKET_ROWS)
    return state.select("event_type", "ts", "events", "cents", "largest", F.col("last_user.user_id").alias("last_user"))


def match_heads(spark, sf):
    revisions = _revisions(spark, sf).select(
        F.col("fixture_key").alias("match_id"), F.col("revision").alias("revision_number"),
        F.col("observed_at").alias("kickoff_at"), "status", "home_score", "away_score",
    )
    matches = ad.view(spark, sf, "matches").select(F.col("match_id").alias("id"), "home_club_id", "away_club_id")
    return c.match_heads(matches, revisions)


def max_revision(spark, sf):
    revisions = _revisions(spark, sf)
    return c.max_revision(
        revisions.select(F.col("fixture_key").alias("match_id"), F.col("revision").alias("revision_number"))
    )


# --- Quality -----------------------------------------------------------------------------------------

# Values that break rules now and then, from the raw columns.
_WILD_REVISIONS = """
  select l_orderkey as fixture_key, l_linenumber as revision,
    case when l_quantity > 25 then 'initial' else 'status_change' end as revision_kind,
    case l_returnflag when 'R' then 'finished' when 'A' then 'postponed' else 'lost' end as status,
    case when l_discount > 0.03 then cast(l_suppkey % 6 as int) - 1 end as home_score,
    case when l_tax > 0.03 then cast(l_partkey % 5 as int) end as away_score
  from lineitem"""


def revision_rule_breaches(spark, sf):
    ad.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(_WILD_REVISIONS)
    found = q.violations(rows, q.REVISION_RULES, ["fixture_key"])
    return found.groupBy("rule_id").agg(F.count("*").alias("breaches"), F.countDistinct("fixture_key").alias("fixtures"))


def match_rule_breaches(spark, sf):
    matches = ad.view(spark, sf, "matches").withColumns(
        {
            "away_club_id": F.col("away_club_id") % 7,
            "home_goals": F.col("home_goals") - 1,
            "result_observed_at": F.col("result_observed_at") - F.expr("interval '3' hour"),
        }
    )
    found = q.violations(matches, q.MATCH_RULES, ["match_id"])
    return found.groupBy("rule_id").agg(F.count("*").alias("breaches"))


def quarantined_matches(spark, sf):
    matches = ad.view(spark, sf, "matches").withColumn("away_club_id", F.col("away_club_id") % 7)
    clean, bad = q.quarantine(matches, q.MATCH_RULES)
    bad = bad.withColumn("side", F.lit("bad")).groupBy("side").agg(F.count("*").alias("rows"))
    return clean.withColumn("side", F.lit("clean")).groupBy("side").agg(F.count("*").alias("rows")).unionByName(bad)


def probability_breaches(spark, sf):
    rows = ad.view(spark, sf, "market_snapshots").withColumn(
        "p_home", F.when(F.col("p_draw") > 0.3, F.col("p_home") * 1.01).otherwise(F.col("p_home"))
    )
    found = q.violations(rows, q.PROBABILITY_RULES, ["source_key"])
    return found.groupBy("source_key", "rule_id").agg(F.count("*").alias("breaches"))


def event_rule_breaches(spark, sf):
    events = ad.view(spark, sf, "domain_events").withColumns(
        {
            "confidence": F.col("confidence") * 1.1,
            "valid_until": F.col("valid_until") - F.expr("interval '10' hour"),
        }
    )
    return q.violations(events, q.EVENT_RULES, ["event_id"])


def duplicate_keys(spark, sf):
    return q.duplicate_keys(ad.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphaned_keys(spark, sf):
    return q.orphans(ad.table(spark, sf, "events"), ["user_id"], ad.table(spark, sf, "supplier"), ["s_suppkey"])


_SOURCES = """
  select lower(replace(s_name, '#', case when s_suppkey % 10 = 0 then '#' else '_' end)) as key, s_name as name,
    case s_nationkey % 4 when 0 then 'league' when 1 then 'odds' when 2 then 'news' else 'rumour' end as kind,
    s_acctbal / 8000.0e0 as reliability, 'p1' as parser_version, 'c1' as collector_version,
    case s_nationkey % 3 when 0 then 'licensed' when 1 then 'reviewed_allowed' else 'restricted' end as terms_status,
    s_acctbal > 0 as commercial_use_approved, s_suppkey % 7 > 0 as enabled
  from supplier"""


def _sources(spark, sf) -> DataFrame:
    ad.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    limits = [F.lit(v).alias(n) for n, v in (
        ("requests_per_minute", 30), ("max_concurrency", 1), ("min_interval_seconds", 0.0), ("timeout_seconds", 20.0),
        ("max_retries", 2),
    )]
    return spark.sql(_SOURCES).withColumn("request_policy", F.struct(*limits))


def source_rule_breaches(spark, sf):
    return q.violations(_sources(spark, sf), q.SOURCE_RULES, ["key"])


def source_registry(spark, sf):
    sources = ingest.enabled_sources(ingest.register_sources(_sources(spark, sf)))
    return sources.select("key", "kind", ingest.production_allowed().alias("production_allowed"))


# --- Identifiers and hashes --------------------------------------------------------------------------


def canonical_ids(spark, sf):
    customers = ad.table(spark, sf, "customer")
    return customers.select(
        "c_custkey",
        canonical_id("club", F.col("c_name")).alias("club_id"),
        canonical_id("season", F.col("c_mktsegment"), F.col("c_nationkey")).alias("season_id"),
    )


def payload_hashes(spark, sf):
    return ad.table(spark, sf, "events").select(
        "event_id", hashing.canonical_json_sha256(F.col("props")).alias("content_sha256")
    )


def map_payload_hashes(spark, sf):
    fields = F.create_map(
        F.lit("role"), F.col("role"), F.lit("conversation"), F.col("conv_id").cast("string"), F.lit("text"), F.col("text")
    )
    return ad.table(spark, sf, "conversations").select("conv_id", "turn", hashing.map_sha256(fields).alias("content_sha256"))


def normalized_names(spark, sf):
    documents = ad.table(spark, sf, "documents")
    folded = documents.select("doc_id", normalize_name(F.col("text")).alias("name"))
    return folded.select("doc_id", F.length("name").alias("name_length"), F.md5("name").alias("name_md5"))


def stamped_records(spark, sf):
    pages = ad.table(spark, sf, "pages").select(
        F.lit("web").alias("source_key"), F.col("page_id").cast("string").alias("evidence_key"),
        F.col("url").alias("canonical_url"), F.col("html").alias("payload"),
        ntz("2024-01-01 00:00:00").alias("observed_at"), F.lit("p1").alias("parser_version"),
        F.lit("c1").alias("collector_version"),
    )
    stamped = ingest.stamp_records(
        pages, evidence_key="evidence_key", fetched_at=ntz("2024-01-02 00:00:00"),
        content_sha256=F.sha2("payload", 256), media_type="text/html",
    )
    bad = q.violations(stamped, q.RECORD_RULES, ["record_id"]).select("record_id", F.lit(False).alias("valid"))
    return stamped.join(bad, "record_id", "left").select(
        "record_id", "evidence_key", "canonical_url", "media_type", "content_sha256", "verification_state",
        F.coalesce("valid", F.lit(True)).alias("valid"),
    )


# --- Ingest runs -------------------------------------------------------------------------------------

_RUN_SOURCES = """
  select concat('src_', event_type) as key, 'p1' as parser_version, 'c1' as collector_version, true as enabled,
    event_type <> 'error' as commercial_use_approved,
    case when event_type = 'click' then 'licensed' else 'reviewed_allowed' end as terms_status
  from events group by event_type"""
_RUNS = """
  select concat(event_type, '-', cast(user_id as varchar(20))) as run_id, concat('src_', event_type) as source_key,
    min(ts) as started_at, max(ts) as finished_at,
    case when max(value) > 60 then 'network' end as failure_kind
  from events group by event_type, user_id"""
_RUN_RECORDS = """
  select concat(event_type, '-', cast(user_id as varchar(20))) as run_id, event_id as ordinal,
    case when value between 30 and 30.2 then 'src_other' else concat('src_', event_type) end as source_key,
    case when value between 40 and 40.2 then 'p0' else 'p1' end as parser_version,
    case when value between 50 and 50.2 then 'c0' else 'c1' end as collector_version
  from events"""


def _ingested(spark, sf):
    ad.table(spark, sf, "events").createOrReplaceTempView("events")
    return ingest.ingest_run(
        spark.sql(_RUNS), spark.sql(_RUN_RECORDS), spark.sql(_RUN_SOURCES), production=True
    )


def ingest_runs(spark, sf):
    return _ingested(spark, sf)[1].select("run_id", "source_key", "status", "records_count", "failure_kind", "error_message")


def accepted_records(spark, sf):
    return _ingested(spark, sf)[0].select("run_id", "ordinal")


def run_health(spark, sf):
    return ingest.run_health(_ingested(spark, sf)[1], "1 day")


# --- Imports -----------------------------------------------------------------------------------------


def _club_rows(spark, sf) -> DataFrame:
    """Customers as clubs; a key shared by two names is a contradiction within the batch."""
    return ad.table(spark, sf, "customer").select(
        canonical_id("club", F.col("c_name")).alias("entity_id"), F.col("c_name").alias("canonical_name"),
        F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("country_code"),
    )


def _stored_clubs(spark, sf) -> DataFrame:
    """What an earlier load left: positive balances only, one nation since renamed."""
    stored = _club_rows(spark, sf).join(
        ad.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_name").alias("canonical_name")),
        "canonical_name",
    )
    return stored.withColumn(
        "country_code", F.when(F.col("country_code") == "N07", F.lit("N99")).otherwise(F.col("country_code"))
    ).select("entity_id", "canonical_name", "country_code")


def _classified(spark, sf) -> dict[str, DataFrame]:
    revisions = _revisions(spark, sf).select(
        canonical_id("match_revision", F.col("fixture_key"), F.col("revision")).alias("id"),
        canonical_id("match", F.col("fixture_key")).alias("match_id"), F.col("revision").alias("revision_number"),
        "revision_kind", "observed_at", F.lit(None).cast("timestamp_ntz").alias("kickoff_at"), "status", "home_score",
        "away_score", F.lit(None).cast("string").alias("reason"),
    )
    stored = revisions.filter(F.col("observed_at") <= ntz(CUTOFF)).withColumn(
        "home_score", F.when(F.col("home_score") == 4, 3).otherwise(F.col("home_score"))
    )
    return {
        "clubs": c.classify(_club_rows(spark, sf), _stored_clubs(spark, sf), *c.IDENTITY["clubs"]),
        "match_revisions": c.classify(revisions, stored, *c.IDENTITY["match_revisions"]),
    }


def import_summary(spark, sf):
    return c.summarise(_classified(spark, sf))


def import_conflicts(spark, sf):
    return c.conflicts(_classified(spark, sf))


def evidence_coverage(spark, sf):
    refs = _raw_numbering(spark, sf).select("fixture_key", "revision")
    return docs.evidence_coverage(_revisions(spark, sf), refs)


def evidence_bindings(spark, sf):
    rows = ad.table(spark, sf, "orders")
    incoming = rows.select(
        F.col("o_orderkey").cast("string").alias("revision_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source_id"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_orderpriority")).alias("raw_record_id"),
    )
    stored = rows.filter("o_totalprice > 200000").select(
        F.col("o_orderkey").cast("string").alias("revision_id"),
        F.when(F.col("o_totalprice") < 400000, F.lit("F")).alias("source_id"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_orderpriority")).alias("raw_record_id"),
    )
    # Some come twice, some with another source as well.
    again = incoming.filter("cast(revision_id as bigint) % 7 = 0")
    other = incoming.filter("cast(revision_id as bigint) % 11 = 0").select("revision_id", F.lit("Z").alias("source_id"), F.lit("z").alias("raw_record_id"))
    return c.bind_evidence(incoming.unionByName(again).unionByName(other), stored).select("revision_id", "binding_action")


def provenance(spark, sf):
    lines = ad.view(spark, sf, "revisions")
    revisions = lines.select(F.concat_ws(":", "fixture_key", "revision").alias("id"), "status")
    bindings = lines.filter("status <> 'postponed'").select(
        F.concat_ws(":", "fixture_key", "revision").alias("revision_id"),
        F.concat(F.lit("s"), F.col("fixture_key") % 3).alias("source_id"),
        F.col("fixture_key").cast("string").alias("raw_record_id"),
    )
    orders = ad.table(spark, sf, "orders")
    raw = orders.select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").cast("string").alias("collector_run_id"),
        F.col("o_orderpriority").alias("evidence_key"), F.lit("x").alias("content_sha256"),
        F.col("o_orderdate").alias("observed_at"),
    )
    customers = ad.table(spark, sf, "customer")
    runs = customers.select(
        F.col("c_custkey").cast("string").alias("run_id"), F.col("c_name").alias("run_key"),
        F.col("c_mktsegment").alias("status"),
    )
    sources = ad.table(spark, sf, "region").select(
        F.concat(F.lit("s"), "r_regionkey").alias("id"), F.col("r_name").alias("key")
    )
    return c.trace_provenance(revisions, bindings, raw, runs, sources).select(
        "id", "status", "evidence_key", "run_key", "run_status", "source_key"
    )


def season_rules(spark, sf):
    orders = ad.table(spark, sf, "orders")
    versions = orders.select(
        F.col("o_custkey").alias("competition_season_id"), F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("rules"),
    )
    seasons = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("season_key"))
    return c.season_rules(seasons, versions)


def non_participants(spark, sf):
    matches = ad.view(spark, sf, "matches")
    season = F.year("kickoff_at").alias("season_key")
    observations = matches.select(
        "competition_key", season, F.col("home_club_id").alias("home_club_key"), F.col("away_club_id").alias("away_club_key")
    )
    enrolled = matches.filter("home_goals >= 4 and away_goals = 0").select(
        "competition_key", season, F.col("home_club_id").alias("club_key")
    )
    return docs.non_participants(observations, enrolled)


# --- Resolution --------------------------------------------------------------------------------------


def _resolution_inputs(spark, sf, misspelt: bool):
    """Every part asks for its own name, written louder (or with letters changed), some naming a country."""
    parts = ad.table(spark, sf, "part")
    name = F.translate("p_name", "aeo", "eoa") if misspelt else F.upper(F.concat(F.lit(" "), "p_name", F.lit("!")))
    requests = parts.select(
        F.col("p_partkey").cast("string").alias("request_id"),
        F.when(F.col("p_size") % 2 == 0, "club").when(F.col("p_size") % 5 == 0, "coach").otherwise("player").alias("entity_type"),
        name.alias("name"),
        F.lit(datetime(2024, 1, 1)).alias("as_of"),
        _birth(F.col("p_size"), 3, misspelt).alias("birth_date"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_brand")).alias("country_code"),
    )
    born = _birth(F.col("p_partkey"), 4, misspelt).alias("birth_date")
    known = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), born)
    return requests, ad.view(spark, sf, "candidates").join(known, "entity_id")


def _birth(number, cycle: int, known: bool):
    """A day of January 1990 from a number's remainder, none for the remainder 0."""
    remainder = (number % cycle).cast("int")
    return F.when(F.lit(known) & (remainder > 0), F.date_add(F.lit("1990-01-01").cast("date"), remainder))


def _verdicts(results: DataFrame) -> DataFrame:
    return rounded(
        results.select(
            "request_id", "normalized_name", "status", "method", "resolved_entity_id", "top_score",
            F.concat_ws(",", F.transform("candidates", lambda x: x["entity_id"].cast("string"))).alias("candidates"),
            F.when(F.col("status") != "matched", F.col("explanation")).alias("explanation"),
        )
    )


def resolve_namesakes(spark, sf):
    return _verdicts(rs.resolve(*_resolution_inputs(spark, sf, False)))


def resolve_misspelt(spark, sf):
    return _verdicts(rs.resolve(*_resolution_inputs(spark, sf, True)))


def review_queue(spark, sf):
    results = rs.resolve(*_resolution_inputs(spark, sf, False))
    return rs.review_cases(results).select("case_id", "request_id", "status", "reason", F.size("candidates").alias("candidates"))


def resolution_decisions(spark, sf):
    results = rs.resolve(*_resolution_inputs(spark, sf, False))
    audit = rs.decisions(results, "nightly", ntz("2024-01-02 00:00:00"))
    return audit.select(
        "decision_id", "request_id", "entity_type", "normalized_name", "resolved_entity_id", "status", "method",
        "top_score", "decided_at", "decided_by",
    )


def resolve_aliases(spark, sf):
    """Customers under an old name that was valid for a while; asked at each order's date."""
    customers = ad.table(spark, sf, "customer")
    candidates = customers.select(
        F.col("c_custkey").alias("entity_id"), F.lit("club").alias("entity_type"), F.col("c_name").alias("canonical_name")
    )
    start = F.lit(datetime(1996, 1, 1)) + F.make_dt_interval(F.col("c_nationkey") * 30)
    aliases = customers.select(
        F.col("c_custkey").alias("entity_id"), F.lit("club").alias("entity_type"),
        F.concat(F.lit("old "), F.col("c_custkey").cast("string")).alias("alias"), start.alias("valid_from"),
        F.when(F.col("c_acctbal") > 0, start + F.make_dt_interval(F.lit(400))).alias("valid_until"),
    )
    requests = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.lit("club").alias("entity_type"),
        F.concat(F.lit("OLD  "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderdate").cast("timestamp").alias("as_of"),
    )
    hits = rs.exact_matches(requests, candidates, aliases)
    found = hits.groupBy("request_id").agg(F.min("entity_id").alias("entity_id"))
    return requests.select("request_id").join(found, "request_id", "left")


def provider_ids(spark, sf):
    customers = ad.table(spark, sf, "customer")
    begin = F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")) + F.make_dt_interval(F.col("c_nationkey") * 30)
    first = customers.select(
        F.lit("s").alias("source_id"), F.lit("club").alias("entity_type"), F.col("c_custkey").alias("external_id"),
        F.col("c_name").alias("canonical_entity_id"), begin.alias("valid_from"),
        F.when(F.col("c_acctbal") > 0, begin + F.make_dt_interval(F.lit(400))).alias("valid_until"),
        begin.alias("observed_at"),
    )
    later = first.withColumns(
        {
            "canonical_entity_id": F.concat(F.lit("new "), "canonical_entity_id"),
            "valid_from": F.col("valid_from") + F.make_dt_interval(F.lit(700)),
            "valid_until": F.lit(None).cast("timestamp_ntz"),
        }
    )
    # In force for a while within the first, which then holds again.
    inner = first.withColumns(
        {
            "canonical_entity_id": F.concat(F.lit("inner "), "canonical_entity_id"),
            "valid_from": F.col("valid_from") + F.make_dt_interval(F.lit(100)),
            "valid_until": F.col("valid_from") + F.make_dt_interval(F.lit(200)),
        }
    )
    records = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.lit("s").alias("source_id"), F.lit("club").alias("entity_type"),
        F.col("o_custkey").alias("external_id"), F.col("o_orderdate").alias("as_of"),
    )
    return rs.map_provider_ids(records, first.unionByName(later).unionByName(inner)).select("record_id", "canonical_entity_id")


# --- Identity and claims -----------------------------------------------------------------------------


def current_identity(spark, sf):
    """Orders as entities 1, 2 ...: all merge into the one at half their number, some split off again later."""
    orders = ad.table(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") + 1)
    merges = orders.select(
        F.col("o_orderkey").alias("event_id"), F.lit("merge").alias("event_type"),
        F.col("o_orderkey").alias("subject_entity_id"), F.floor(F.col("o_orderkey") / 2).alias("target_entity_id"),
        F.col("o_orderdate").alias("occurred_at"),
    )
    splits = merges.filter("target_entity_id % 3 = 0").withColumns(
        {"event_type": F.lit("split"), "occurred_at": F.col("occurred_at") + F.make_dt_interval(F.lit(9))}
    )
    return identity.current_identity(merges.unionByName(splits))


def ranked_claims(spark, sf):
    lines = ad.table(spark, sf, "lineitem")
    claims = lines.select(
        F.col("l_partkey").alias("entity_id"), F.lit("flag").alias("field"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("value"), F.col("l_suppkey").alias("source_key"),
        F.col("l_shipdate").alias("observed_at"),
    )
    sources = ad.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), (F.col("s_nationkey") % 3).alias("authority"),
        (F.floor(F.col("s_acctbal") / 2500) / 4.0).alias("reliability"),
    )
    return rounded(identity.rank_claims(claims, sources))


# --- SQL ---------------------------------------------------------------------------------------------


def _uuid5(name: str) -> str:
    digest = f"sha1(unhex('{NAMESPACE.hex}') || encode({name}))"
    return (
        f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || "
        f"substr({digest}, 21, 12))"
    )


_REV = ad.ctes("revisions")
_TS = "timestamp '{}'"
_LATEST = """
select r.* from revisions r join (select fixture_key, max(revision) as m from revisions {} group by all) x
  on x.fixture_key = r.fixture_key and x.m = r.revision"""


def _finals(pick: str) -> str:
    return f"""{_REV}
select r.fixture_key, r.revision, r.observed_at as result_observed_at, r.home_score as home_goals, r.away_score as away_goals
from revisions r join (select fixture_key, {pick}(revision) as m from revisions where status in ('finished', 'awarded')
  group by all) x on x.fixture_key = r.fixture_key and x.m = r.revision"""


_REVISION_CONDITIONS = {
    "completed_requires_score": "status not in ('finished', 'awarded') or (home_score is not null and away_score is not null)",
    "unplayed_has_no_score": "status not in ('scheduled', 'postponed', 'cancelled') or (home_score is null and away_score is null)",
    "first_revision_is_initial": "revision <> 1 or revision_kind = 'initial'",
    "only_first_is_initial": "revision <= 1 or revision_kind <> 'initial'",
    "home_score_minimum": "home_score is null or home_score >= 0",
    "away_score_minimum": "away_score is null or away_score >= 0",
    "revision_minimum": "revision >= 1",
    "status_vocabulary": "status in ('scheduled', 'postponed', 'abandoned', 'cancelled', 'finished', 'awarded')",
    "revision_kind_vocabulary": "revision_kind in ('initial', 'schedule_change', 'status_change', 'result_correction')",
}

_EXACT = f"""{ad.ctes("candidates")},
cand as (select entity_id, entity_type, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', ' ', 'g')) as nm,
    country_code as cc from candidates),
req as (select cast(p_partkey as varchar) as request_id,
    case when p_size % 2 = 0 then 'club' when p_size % 5 = 0 then 'coach' else 'player' end as entity_type,
    trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as nm,
    case when p_type <> 'ECONOMY' then p_brand end as cc from part),
pool as (select r.request_id, r.cc, c.entity_id, case when r.cc is null then 1.0::double
    when upper(r.cc) = upper(c.cc) then 1.0::double else 0.96::double end as score
  from req r join cand c on c.entity_type = r.entity_type and c.nm = r.nm),
rk as (select *, row_number() over (partition by request_id order by score desc, entity_id) as rn,
    count(*) over (partition by request_id) as n from pool),
agg as (select request_id, any_value(n) as n, max(score) as top, max(case when rn = 1 then entity_id end) as first_id,
    max(case when rn = 2 then score end) as second,
    string_agg(case when rn <= 5 then cast(entity_id as varchar) end, ',' order by rn) as ids,
    least(any_value(n), 5) as shown
  from rk group by all),
res as (select r.request_id, r.entity_type, r.nm as normalized_name, a.n, a.top, a.ids, a.shown,
    case when a.n = 1 then 'matched' when a.n > 1 and r.cc is null then 'ambiguous'
      when a.n > 1 and a.top - a.second >= 0.08 then 'matched' when a.n > 1 then 'ambiguous' else 'unmatched' end as status,
    case when a.n = 1 then 'exact' when a.n > 1 and r.cc is null then 'exact'
      when a.n > 1 and a.top - a.second >= 0.08 then 'attribute' when a.n > 1 then 'fuzzy' else 'none' end as method,
    case when a.n = 1 or (r.cc is not null and a.top - a.second >= 0.08) then a.first_id end as resolved_entity_id,
    case when a.n is null then 'nothing is known of that entity type'
      when a.n > 1 and r.cc is null then 'several entities bear this very name'
      when a.n > 1 and a.top - a.second < 0.08
        then 'the candidates are too close or too weak to decide without review' end as explanation
  from req r left join agg a on a.request_id = r.request_id)"""

# Similarity of each distinct pair of names: longest common blocks, earliest first, then what lies left and right of each.
_FUZZY = f"""with recursive cand as (select p_partkey as entity_id, case when p_size % 2 = 0 then 'club' else 'player' end as entity_type,
    trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as nm, p_brand as cc,
    case when p_partkey % 4 > 0 then date '1990-01-01' + cast(p_partkey % 4 as int) end as born from part),
req as (select cast(p_partkey as varchar) as request_id,
    case when p_size % 2 = 0 then 'club' when p_size % 5 = 0 then 'coach' else 'player' end as entity_type,
    trim(regexp_replace(lower(translate(p_name, 'aeo', 'eoa')), '[^a-z0-9]+', ' ', 'g')) as nm,
    case when p_size % 3 > 0 then date '1990-01-01' + cast(p_size % 3 as int) end as born,
    case when p_type <> 'ECONOMY' then p_brand end as cc from part),
names as (select distinct r.nm as a, c.nm as b from (select distinct nm, entity_type from req) r join (select distinct nm, entity_type from cand) c using (entity_type)),
parts(a, b, x, y, matched) as (
  select a, b, a, b, 0 from names
  union all
  (with found as (select a, b, x, y, list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) - i + 2),
        lambda k: case when contains(y, substr(x, i, k)) then {{'size': k, 'at': -i}} end)))) as block from parts where len(x) > 0 and len(y) > 0),
    placed as (select *, block['size'] as k, -block['at'] as i, strpos(y, substr(x, -block['at'], block['size'])) as j from found where block is not null)
  select a, b, case when side = 0 then substr(x, 1, i - 1) else substr(x, i + k) end, case when side = 0 then substr(y, 1, j - 1) else substr(y, j + k) end,
    case when side = 0 then k else 0 end from placed, (select unnest([0, 1]) as side))),
alike as (select a, b, case when len(a) + len(b) = 0 then 1.0::double else 2.0::double * sum(matched) / (len(a) + len(b)) end as name_score from parts group by a, b),
pairs as (select r.request_id, c.entity_id, r.nm = c.nm as same, s.name_score,
    case when r.born is null or c.born is null then s.name_score when r.born = c.born then least(1.0::double, s.name_score + 0.06::double)
      else greatest(0.0::double, s.name_score + -0.2::double) end as by_birth, r.cc as asked, c.cc as has, r.born is null and r.cc is null as bare
  from req r join cand c on c.entity_type = r.entity_type join alike s on s.a = r.nm and s.b = c.nm),
scored as (select *, case when asked is null or has is null then by_birth when upper(asked) = upper(has) then least(1.0::double, by_birth + 0.02::double)
    else greatest(0.0::double, by_birth + -0.04::double) end as score, count(*) filter (same) over (partition by request_id) as exact from pairs),
ranked as (select *, row_number() over (partition by request_id order by score desc, entity_id) as rn, count(*) over (partition by request_id) as n
  from scored where same or exact = 0 qualify rn <= 5),
agg as (select request_id, any_value(exact) as exact, any_value(n) as n, any_value(bare) as bare, max(score) as top, max(case when rn = 2 then score end) as second,
    max(case when rn = 1 then entity_id end) as first_id, string_agg(entity_id::varchar, ',' order by rn) as ids,
    coalesce(string_agg(entity_id::varchar, ',' order by rn) filter (score >= 0.65::double), '') as review from ranked group by request_id),
rung as (select r.request_id, r.nm, a.*, case when a.n is null then 1 when exact = 1 then 2 when exact > 1 and bare then 4
    when top >= 0.92::double and (n = 1 or top - coalesce(second, 0) >= 0.08::double) then 5 when review <> '' then 6 else 7 end as rung
  from req r left join agg a on a.request_id = r.request_id)"""

_INGEST = f"""with src as ({_RUN_SOURCES}), rn as ({_RUNS}), rec as ({_RUN_RECORDS}),
chk as (select rec.*, rn.source_key as want,
    case when rec.source_key <> rn.source_key then 0 when rec.parser_version <> 'p1' then 1
      when rec.collector_version <> 'c1' then 2 end as bad from rec join rn on rn.run_id = rec.run_id),
byrun as (select run_id, count(*) as n, arg_min(bad, ordinal) filter (where bad is not null) as bad from chk group by all),
env as (select rn.*, n, bad, commercial_use_approved as allowed from rn join src on src.key = rn.source_key
  left join byrun on byrun.run_id = rn.run_id),
runs as (select run_id, source_key, started_at,
    case when not allowed then 'blocked' when failure_kind is not null or bad is not null then 'failed' else 'succeeded' end as status,
    case when allowed and failure_kind is null and bad is null then n else 0 end as records_count,
    case when not allowed then 'policy' when failure_kind is not null then failure_kind when bad is not null then 'schema' end as failure_kind,
    case when not allowed then '{ingest.POLICY_MESSAGE}' when failure_kind is not null then null
      when bad = 0 then '{ingest.CONTRACT_CHECKS[0][1]}' when bad = 1 then '{ingest.CONTRACT_CHECKS[1][1]}'
      when bad = 2 then '{ingest.CONTRACT_CHECKS[2][1]}' end as error_message
  from env)"""

_CLUBS = f"""
clubs as (select {_uuid5("'club:' || lower(c_name)")} as id, c_name, c_acctbal, 'N' || lpad(cast(c_nationkey as varchar), 2, '0') as cc
  from customer),
clubc as (select *, case when c_acctbal > 0 then 'stored' end as st, case when cc = 'N07' then 'N99' else cc end as old from clubs)"""
_REVC = f"""
revc as (select fixture_key, revision, home_score, observed_at <= timestamp '{CUTOFF}' as st from revisions)"""

_CHAIN = """with recursive ev as (select o_orderkey + 1 as s, cast(floor((o_orderkey + 1) / 2) as bigint) as t from orders),
live as (select s, t from ev where t % 3 <> 0),
walk(s, t, depth) as (select s, t, 1 from live union all select w.s, l.t, depth + 1 from walk w join live l on l.s = w.t)"""

SQL = {
    "latest_as_of": _REV + _LATEST.format(f"where observed_at <= timestamp '{CUTOFF}'"),
    "latest_revision": _REV + _LATEST.format(""),
    "fixture_timeline": f"{_REV} select fixture_key, revision, observed_at, status from revisions",
    "timeline_faults": """
with r as (select l_orderkey as fixture_key, l_linenumber as n, l_shipdate as t, l_suppkey % 2 as h from lineitem),
num as (select fixture_key, n, count(*) as c, min(t) as t from r group by all),
fx as (select fixture_key, min(n) <> 1 or max(n) <> count(*) or max(c) <> 1 as gaps from num group by all),
mv as (select fixture_key from r group by all having min(h) <> max(h)),
bk as (select distinct a.fixture_key from num a join num b on a.fixture_key = b.fixture_key and b.n = a.n - 1 and a.t < b.t)
select fixture_key, 'revisions_contiguous' as rule_id from fx where gaps
union all select fixture_key, 'observed_non_decreasing' from fx join bk using (fixture_key) where not gaps
union all select fixture_key, 'participants_constant' from mv""",
    "historical_matches": _finals("max"),
    "first_final_matches": _finals("min"),
    "event_state": f"""{ad.ctes("domain_events")}
select entity_id, event_type, event_id, valid_from, observed_at from (select *, row_number() over (
    partition by entity_id, event_type order by valid_from desc, observed_at desc, event_id desc) as rn from domain_events
  where observed_at <= timestamp '2024-01-06 12:00:00' and valid_from <= timestamp '2024-01-05 00:00:00'
    and (valid_until is null or valid_until > timestamp '2024-01-05 00:00:00')) x where rn = 1""",
    "event_prefixes": """
with e as (select event_type, ts, count(*) as n, sum(cast(round(value * 100) as bigint)) as c, max(cast(round(value * 100) as bigint)) as m,
    max(user_id) as u from events where event_type is not null and ts is not null group by all)
select event_type, ts, cast(sum(n) over w as bigint) as events, cast(coalesce(sum(c) over w, 0) as bigint) as cents, max(m) over w as largest, u as last_user
from e window w as (partition by event_type order by ts)""",
    "match_heads": f"""{ad.ctes("matches", "revisions")}
select m.match_id as id, home_club_id, away_club_id, r.revision as revision_number, r.observed_at as kickoff_at, r.status,
  r.home_score, r.away_score
from matches m left join (select *, row_number() over (partition by fixture_key order by revision desc) as rn from revisions) r
  on r.fixture_key = m.match_id and r.rn = 1""",
    "max_revision": f"{_REV} select fixture_key as match_id, max(revision) as max_revision from revisions group by all",
    "revision_rule_breaches": f"with w as ({_WILD_REVISIONS}) "
    + " union all ".join(
        f"select '{name}' as rule_id, count(*) as breaches, count(distinct fixture_key) as fixtures from w "
        f"where not coalesce({condition}, false) having count(*) > 0"
        for name, condition in _REVISION_CONDITIONS.items()
    ),
    "match_rule_breaches": f"""{ad.ctes("matches")}
select 'different_clubs' as rule_id, count(*) as breaches from matches where home_club_id = away_club_id % 7
union all select 'home_goals_minimum', count(*) from matches where home_goals - 1 < 0
union all select 'result_after_kickoff', count(*) from matches where result_observed_at - interval '3' hour < kickoff_at""",
    "quarantined_matches": f"""{ad.ctes("matches")}
select case when home_club_id = away_club_id % 7 then 'bad' else 'clean' end as side, count(*) as rows from matches group by all""",
    "probability_breaches": f"""{ad.ctes("market_snapshots")}
select source_key, 'probability_vector' as rule_id, count(*) as breaches from market_snapshots
where p_draw > 0.3 and not (abs(p_home * 1.01 + p_draw + p_away - 1.0) <= 1e-8 and p_home * 1.01 <= 1) group by all""",
    "event_rule_breaches": f"""{ad.ctes("domain_events")}
select event_id, 'valid_until_after_valid_from' as rule_id from domain_events
where valid_until - interval '10' hour <= valid_from
union all select event_id, 'confidence_probability' from domain_events where confidence * 1.1e0 > 1""",
    "duplicate_keys": """
select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by all having count(*) > 1""",
    "orphaned_keys": "select distinct user_id from events where user_id not in (select s_suppkey from supplier)",
    "source_rule_breaches": f"""with s as ({_SOURCES})
select key, 'key_pattern' as rule_id from s where not regexp_matches(key, '^[a-z0-9][a-z0-9._-]*$')
union all select key, 'reliability_probability' from s where not (reliability between 0 and 1)
union all select key, 'kind_vocabulary' from s where kind = 'rumour'""",
    "source_registry": f"""with s as ({_SOURCES})
select key, kind, enabled and commercial_use_approved and terms_status in ('reviewed_allowed', 'licensed') as production_allowed
from s where enabled""",
    "canonical_ids": f"""select c_custkey, {_uuid5("'club:' || lower(trim(c_name))")} as club_id,
  {_uuid5("'season:' || lower(c_mktsegment || ':' || c_nationkey)")} as season_id from customer""",
    "payload_hashes": "select event_id, sha256(replace(props, ' ', '')) as content_sha256 from events",
    "map_payload_hashes": """
select conv_id, turn, sha256('{"conversation":"' || conv_id || '","role":"' || role || '","text":' || cast(to_json(text) as varchar) || '}') as content_sha256 from conversations""",
    "normalized_names": """
with f as (select doc_id, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) as name from documents)
select doc_id, cast(length(name) as int) as name_length, md5(name) as name_md5 from f""",
    "stamped_records": f"""select {_uuid5("'raw_evidence:web:' || page_id")} as record_id, cast(page_id as varchar) as evidence_key,
  url as canonical_url, 'text/html' as media_type, sha256(html) as content_sha256, 'raw' as verification_state,
  true as valid from pages""",
    "ingest_runs": f"{_INGEST} select run_id, source_key, status, records_count, failure_kind, error_message from runs",
    "accepted_records": f"""{_INGEST}
select run_id, ordinal from chk join runs using (run_id) where status = 'succeeded'""",
    "run_health": f"""{_INGEST}
select source_key, date_trunc('day', started_at)::timestamp as window_start, status, failure_kind, count(*) as runs,
  sum(records_count)::bigint as records from runs group by all""",
    "import_summary": f"""{_REV},{_CLUBS},{_REVC},
a as (select 'clubs' as table_name, case when st is null then 'insert' when cc <> old then 'conflict' else 'existing' end as action
  from clubc union all
  select 'match_revisions', case when not st then 'insert' when home_score = 4 then 'conflict' else 'existing' end from revc)
select table_name, count(case when action = 'insert' then 1 end) as inserted,
  count(case when action = 'existing' then 1 end) as existing, count(case when action = 'conflict' then 1 end) as conflicting
from a group by rollup (table_name)""",
    "import_conflicts": f"""{_REV},{_CLUBS},{_REVC}
select 'clubs' as table_name, id, 'country_code' as field, old as stored, cc as incoming from clubc where st = 'stored' and cc <> old
union all select 'match_revisions', {_uuid5("'match_revision:' || fixture_key || ':' || revision")}, 'home_score', '3', '4'
from revc where st and home_score = 4""",
    "evidence_coverage": f"""{_REV},
e as (select distinct fixture_key, revision from revisions),
a as (select distinct l_orderkey as fixture_key, l_linenumber as revision from lineitem)
select fixture_key, revision, 'missing' as fault from (select * from e except select * from a) x
union all select fixture_key, revision, 'unknown' from (select * from a except select * from e) y""",
    "evidence_bindings": """
with o as (select *, case when o_orderstatus <> 'P' then o_orderstatus end as s0, case when o_totalprice > 50000 then o_orderpriority end as r0,
    o_orderkey % 11 = 0 as z from orders),
i as (select cast(o_orderkey as varchar) as revision_id, z and (s0 is not null or r0 is not null) as torn,
    case when z then coalesce(s0, 'Z') else s0 end as s, case when z then coalesce(r0, 'z') else r0 end as r,
    case when o_totalprice > 200000 and o_totalprice < 400000 then 'F' end as os,
    case when o_totalprice > 200000 and o_totalprice < 400000 then o_orderpriority end as orr from o)
select revision_id, case when torn then 'conflict' when s is null and r is null then 'none' when s is null or r is null then 'conflict'
  when os is null and orr is null then 'fill' when s is not distinct from os and r is not distinct from orr then 'same'
  else 'conflict' end as binding_action from i""",
    "provenance": f"""{_REV}
select r.fixture_key || ':' || r.revision as id, r.status, o.o_orderpriority as evidence_key, c.c_name as run_key,
  c.c_mktsegment as run_status, g.r_name as source_key
from revisions r left join orders o on r.status <> 'postponed' and o.o_orderkey = r.fixture_key
  left join customer c on c.c_custkey = o.o_custkey
  left join region g on r.status <> 'postponed' and g.r_regionkey = r.fixture_key % 3""",
    "season_rules": """
select c_custkey as id, c_name as season_key, rules, rules_version from customer left join (
  select o_custkey, max_by(o_orderpriority, o_orderkey) as rules, max(o_orderkey) as rules_version from orders group by all) v
  on v.o_custkey = c_custkey""",
    "non_participants": f"""{ad.ctes("matches")},
n as (select distinct competition_key, cast(year(kickoff_at) as int) as season_key, unnest([home_club_id, away_club_id]) as club_key from matches),
p as (select distinct competition_key, cast(year(kickoff_at) as int) as season_key, home_club_id as club_key from matches
  where home_goals >= 4 and away_goals = 0)
select * from n except select * from p""",
    "resolve_namesakes": f"""{_EXACT}
select request_id, normalized_name, status, method, resolved_entity_id, round(top, 6) as top_score,
  coalesce(ids, '') as candidates, explanation from res""",
    "resolve_misspelt": f"""{_FUZZY}
select request_id, nm as normalized_name, case when rung in (2, 5) then 'matched' when rung in (4, 6) then 'ambiguous' else 'unmatched' end as status,
  case when rung in (2, 4) then 'exact' when rung = 5 and exact > 1 then 'attribute' when rung in (5, 6) then 'fuzzy' else 'none' end as method,
  case when rung in (2, 5) then first_id end as resolved_entity_id, round(top, 6) as top_score,
  case when rung = 1 then '' when rung = 6 then review else ids end as candidates,
  case rung when 1 then 'nothing is known of that entity type' when 4 then 'several entities bear this very name'
    when 6 then 'the candidates are too close or too weak to decide without review' when 7 then 'all candidates are too weak to review' end as explanation
from rung""",
    "review_queue": f"""{_EXACT}
select {_uuid5("'review_case:' || request_id")} as case_id, request_id, 'pending' as status, explanation as reason,
  cast(shown as int) as candidates from res where status = 'ambiguous'""",
    "resolution_decisions": f"""{_EXACT}
select {_uuid5("'resolution_decision:' || request_id")} as decision_id, request_id, entity_type, normalized_name, resolved_entity_id,
  status, method, cast(top as decimal(5, 4)) as top_score, timestamp '2024-01-02 00:00:00' as decided_at, 'nightly' as decided_by
from res""",
    "resolve_aliases": """
with a as (select c_custkey, timestamp '1996-01-01 00:00:00' + c_nationkey * 30 * interval '1' day as f, c_acctbal from customer)
select o_orderkey as request_id, c_custkey as entity_id from orders left join a on c_custkey = o_custkey
  and o_orderdate >= f and (c_acctbal <= 0 or o_orderdate < f + interval '400' day)""",
    "provider_ids": """
with a as (select c_custkey, c_name, c_acctbal, timestamp '1996-01-01 00:00:00' + c_nationkey * 30 * interval '1' day as f from customer)
select o_orderkey as record_id, case when o_orderdate >= f + interval '700' day then 'new ' || c_name
  when o_orderdate >= f + interval '100' day and o_orderdate < f + interval '200' day then 'inner ' || c_name
  when o_orderdate >= f and (c_acctbal <= 0 or o_orderdate < f + interval '400' day) then c_name end as canonical_entity_id
from orders left join a on c_custkey = o_custkey""",
    "current_identity": f"""{_CHAIN}
select s as entity_id, max_by(t, depth) as current_id from walk group by all""",
    "ranked_claims": """
with s as (select s_suppkey, s_nationkey % 3 as authority, floor(s_acctbal / 2500) / 4.0e0 as reliability from supplier),
v as (select l_partkey as entity_id, l_returnflag || '/' || l_linestatus as value, max(coalesce(authority, 0)) as authority,
    max(coalesce(reliability, 0.0)) as reliability, count(distinct l_suppkey) as corroborating, max(l_shipdate) as observed_at
  from lineitem left join s on s_suppkey = l_suppkey group by all)
select entity_id, 'flag' as field, value, authority, round(reliability, 6) as reliability, corroborating, observed_at, n as values
from (select *, count(*) over (partition by entity_id) as n, row_number() over (partition by entity_id
  order by authority desc, reliability desc, corroborating desc, observed_at desc, value desc) as rn from v) x where rn = 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        latest_as_of, latest_revision, fixture_timeline, timeline_faults, historical_matches, first_final_matches,
        event_state, event_prefixes, match_heads, max_revision, revision_rule_breaches, match_rule_breaches, quarantined_matches,
        probability_breaches, event_rule_breaches, duplicate_keys, orphaned_keys, source_rule_breaches,
        source_registry, canonical_ids, payload_hashes, map_payload_hashes, normalized_names, stamped_records,
        ingest_runs, accepted_records, run_health, import_summary, import_conflicts, evidence_coverage,
        evidence_bindings, provenance, season_rules, non_participants, resolve_namesakes, resolve_misspelt,
        review_queue, resolution_decisions, resolve_aliases, provider_ids, current_identity, ranked_claims,
    )
}
