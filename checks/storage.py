"""Storage queries: collectors read back what has landed, sinks written twice, keys of a batch against a store of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import forecasts, history, imports
from checks.imports import _folder, _written
from checks.streams import _drain
from pitchlake.functions import payloads
from pitchlake.plans import imports as plan
from pitchlake.plans import models as m
from pitchlake.sources import adapters as ad
from pitchlake.sources import collectors, ingest, keys, store
from pitchlake.sources import documents as docs

EVENT = "event_id long, event_type string, user_id long, value double"
# Landed files are cut into pieces of this size, so that even the small tables have many.
PIECE = 1 << 16


def _landed_events(spark, sf) -> str:
    return _written(ad.table(spark, sf, "events").select("event_id", "event_type", "user_id", "value"), "landed")


def _parsed(landed: DataFrame) -> DataFrame:
    return landed.select("drop", "ordinal", F.from_json("payload", EVENT).alias("e")).select("drop", "ordinal", "e.*")


def collected_records(spark, sf):
    """Accepted records of runs whose payloads a collector read from landed files."""
    name = collectors.register(spark)
    landed = spark.read.format(name).option("piece_bytes", PIECE).load(_landed_events(spark, sf))
    ad.table(spark, sf, "events").createOrReplaceTempView("events")
    runs, sources = spark.sql(history._RUNS), spark.sql(history._RUN_SOURCES)
    _parsed(landed).createOrReplaceTempView("landed_events")
    # Landed lines are read and parsed once; an ingest looks at its records three times.
    path = _folder(spark, "records")
    spark.sql(history._RUN_RECORDS.replace("from events", "from landed_events")).write.parquet(path)
    records = spark.read.parquet(path)
    return ingest.ingest_run(runs, records, sources, production=True)[0].select("run_id", "ordinal")


def collected_stream(spark, sf):
    """Every landed event, read as a stream of drops."""
    name = collectors.register(spark)
    landed = spark.readStream.format(name).option("piece_bytes", PIECE).load(_landed_events(spark, sf))
    return _drain(spark, _parsed(landed).select("event_id", "event_type", "user_id", "value"))


def stored_backtests(spark, sf):
    """Counts and means per run after all runs are written, and those of even competitions again with fewer matches."""
    rows = forecasts._walk(spark, sf, [m.PoissonModel()]).withColumns(
        {"run_id": F.concat(F.lit("run-"), F.col("competition_key")), "model_key": F.lit("poisson")}
    )
    rows = rows.select(
        "run_id", "match_id", "model_key", "competition_key", "prediction_cutoff", "data_cutoff", "p_home", "p_draw", "p_away",
        "expected_home_goals", "expected_away_goals", F.lit(None).cast("timestamp").alias("market_observed_at"),
    )
    root = _folder(spark, "backtests")
    rows = rows.checkpoint()  # all that is written comes from the same forecasts
    for part in (rows, rows.where("competition_key % 2 = 0 and match_id % 2 = 0")):
        runs = part.select("run_id", "model_key").distinct().withColumns({"lead_time_seconds": F.lit(forecasts.DAY), "seed": F.lit(0)})
        store.write_backtest(root, runs, part.drop("competition_key"))
    runs, predictions = store.read_backtest(spark, root)
    found = predictions.groupBy("run_id").agg(F.count(F.lit(1)).alias("predictions"), F.round(F.avg(F.col("p_home").cast("double")), 4).alias("mean_p_home"))
    return runs.join(found, "run_id").select("run_id", "model_key", "predictions", "mean_p_home")


def stored_decisions(spark, sf):
    """Decisions and review cases per run and status: a run of all requests, written twice, and one of the unmatched and ambiguous ones."""
    from pitchlake.operators import resolution as rs

    results = rs.resolve(*history._resolution_inputs(spark, sf, False)).checkpoint()
    root = _folder(spark, "decisions")
    for run, part in (("20240102", results), ("20240102", results), ("20240103", results.where("status <> 'matched'"))):
        store.write_decisions(root, run, rs.decisions(part, "nightly", history.ntz("2024-01-02 00:00:00")), rs.review_cases(part))
    decisions, cases = store.read_decisions(spark, root)
    kept = decisions.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(cases.groupBy("run_id", F.concat(F.lit("case "), "status").alias("status")).agg(F.count(F.lit(1)).alias("rows")))


def key_faults(spark, sf):
    """Evidence of all events against a store of nations, customers and orders, the orders in a run a year."""
    customers = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("run_key"))
    orders = ad.table(spark, sf, "orders")
    home = customers.select(F.col("run_id").alias("o_custkey"), "source_id")
    evidence = orders.join(home, "o_custkey").select(
        F.col("o_orderkey").alias("record_id"), "source_id", F.col("o_custkey").alias("collector_run_id"), F.col("o_orderkey").alias("evidence_key"),
        F.year("o_orderdate").alias("year"),
    )
    sources = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key"))
    lake = store.TableStore(spark, _folder(spark, "lake"))
    lake.append("base", {"sources": sources, "collector_runs": customers})
    for (year,) in sorted(evidence.select("year").distinct().collect()):
        lake.append(f"orders-{year}", {"raw_source_records": evidence.where(F.col("year") == year).drop("year")})
    batch = ad.table(spark, sf, "events").select(
        F.concat(F.lit("e"), "event_id").alias("record_id"), (F.col("user_id") % 30).alias("source_id"), F.col("user_id").alias("collector_run_id"),
        F.floor(F.col("event_id") / 2).alias("evidence_key"),
    )
    return keys.key_faults(lake, {"raw_source_records": batch})


QUERIES = {f.__name__: f for f in (collected_records, collected_stream, stored_backtests, stored_decisions, key_faults)}

SQL = {
    "collected_records": history.SQL["accepted_records"],
    "collected_stream": "select event_id, event_type, user_id, value from events",
    "stored_backtests": f"""{forecasts._PRED},{forecasts._SCORED}
select 'run-' || competition_key as run_id, 'poisson' as model_key, count(*) as predictions, round(avg(p_home), 4) as mean_p_home
from sc where competition_key % 2 = 1 or match_id % 2 = 0 group by competition_key""",
    "stored_decisions": f"""{history._EXACT}
select run_id, status, count(*) as rows from (
  select '20240102' as run_id, status from res union all select '20240103', status from res where status <> 'matched'
  union all select unnest(['20240102', '20240103']), 'case pending' from res where status = 'ambiguous') group by all""",
    "key_faults": """
with evidence as (select c_nationkey as source_id, o_orderkey as evidence_key from orders join customer on o_custkey = c_custkey),
batch as (select user_id % 30 as source_id, user_id as run_id, event_id // 2 as evidence_key from events),
counted as (select source_id, evidence_key, count(*) as occurrences from batch group by all),
faults as (
  select 'repeated' as fault, 'source_id,evidence_key' as key_columns, '["' || source_id || '","' || evidence_key || '"]' as key, occurrences
  from counted where occurrences > 1
  union all select 'stored', 'source_id,evidence_key', '["' || source_id || '","' || evidence_key || '"]', occurrences
  from counted where (source_id, evidence_key) in (select (source_id, evidence_key) from evidence)
  union all select 'orphaned', 'source_id', '["' || source_id || '"]', count(*) from batch
  where source_id not in (select n_nationkey from nation) group by source_id
  union all select 'orphaned', 'collector_run_id', '["' || run_id || '"]', count(*) from batch
  where run_id not in (select c_custkey from customer) group by run_id)
select 'raw_source_records' as table_name, fault, key_columns, key, occurrences from faults""",
}


# --- Payloads ----------------------------------------------------------------------------------------


def rule_fields(spark, sf):
    """Fields of every season's rules, nested, listed and missing, from the JSON column of the imported table."""
    seeds = docs.load_seeds(spark, _written(imports.seed_documents(imports._matches(spark, sf)), "seeds"), multiline=False)
    rules = plan.seed_tables(docs.flatten_seeds(seeds))["season_rule_versions"]
    wanted = {
        "win": ("$.points.win", "int"), "draw": ("$.points.draw", "int"), "first": ("$.ranking[0]", "string"), "legs": ("$.round_robin_legs", "int"),
        "bonus": ("$.points.bonus.away", "int"), "not_a_number": ("$.ranking", "int"),
    }
    seen = payloads.fields(payloads.with_payload(rules, "rules"), wanted)
    return seen.groupBy("version", *wanted).agg(F.count(F.lit(1)).alias("seasons"))


def payload_shapes(spark, sf):
    """Per type of event: payloads, those that are no JSON (every ninth is cut short here), and the sum of a nested field."""
    events = ad.table(spark, sf, "events").select(
        "event_type", F.when(F.col("event_id") % 9 == 0, '{"of": [').otherwise(
            F.concat(F.lit('{"of": ['), F.col("event_id"), F.lit(', {"user": "'), F.col("user_id"), F.lit('"}], "props": '), F.col("props"), F.lit("}"))
        ).alias("text"),
    )
    seen = payloads.fields(payloads.with_payload(events, "text"), {"event": ("$.of[0]", "long"), "user": ("$.of[1].user", "string"), "none": ("$.of[2].x", "long")})
    shapes = payloads.shapes(seen, ["event_type"]).withColumn("is_object", F.col("shape").startswith("OBJECT<of: ARRAY<VARIANT>")).drop("shape")
    sums = seen.groupBy("event_type").agg(
        F.sum("event").alias("events"), F.sum(F.col("user").cast("long")).alias("users"), F.count("none").alias("nones"), F.min("payload_sha256").alias("least_hash")
    )
    return shapes.join(sums, "event_type")


QUERIES |= {f.__name__: f for f in (rule_fields, payload_shapes)}
SQL |= {
    "rule_fields": f"""{ad.ctes("matches")}
select 1 as version, 3 as win, 1 as draw, 'points' as first, 2 as legs, null::int as bonus, null::int as not_a_number, count(*) as seasons
from (select distinct competition_key, year(kickoff_at) from matches)""",
    "payload_shapes": """
with t as (select *, case when event_id % 9 = 0 then '{"of": [' else '{"of": [' || event_id || ', {"user": "' || user_id || '"}], "props": ' || props || '}' end as text,
  event_id % 9 <> 0 as whole from events)
select event_type, count(*) as rows, count(*) filter (not whole) as without, true as is_object, sum(event_id) filter (whole)::bigint as events,
  sum(user_id) filter (whole)::bigint as users, 0::bigint as nones, min(sha256(text)) as least_hash from t group by event_type""",
}
