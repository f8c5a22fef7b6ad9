"""Import queries: documents written from whole given tables, validated, imported, replayed, enriched and contradicted."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.plans import imports
from pitchlake.session import ensure_checkpoint_dir, shuffles_freed
from pitchlake.sources import adapters as ad
from pitchlake.sources import documents as d
from pitchlake.sources.store import TableStore

# Fixtures of a document; a season of any size is many documents.
BLOCK = 500
FILE_DOCUMENTS = 1024


def _folder(spark, label: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def _key(prefix: str, *columns: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") for c in columns])


def _instant(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _matches(spark, sf: str) -> DataFrame:
    matches = ad.view(spark, sf, "matches").withColumn("season", F.year("kickoff_at"))
    return matches.withColumn("block", F.floor(F.col("match_id") / BLOCK))


def _written(df: DataFrame, label: str) -> str:
    """Documents as lines of JSON, compressed, in files that a task can read whole."""
    path = _folder(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.option("maxRecordsPerFile", FILE_DOCUMENTS).json(path, compression="gzip")
    return path


def seed_documents(matches: DataFrame, renamed: int | None = None) -> DataFrame:
    """A seed per competition: the clubs that play in it, a season per year, its clubs as participants."""
    plays = matches.select("competition_key", "season", F.explode(F.array("home_club_id", "away_club_id")).alias("club")).distinct()
    club_name = F.concat(F.lit("Club "), F.col("club").cast("string"), F.when(F.col("club") == F.lit(renamed), " renamed").otherwise(""))
    club = F.struct(_key("club", "club").alias("key"), club_name.alias("name"), F.lit("NOR").alias("country_code"))
    clubs = plays.select("competition_key", club.alias("c")).distinct().groupBy("competition_key").agg(F.collect_list("c").alias("clubs"))
    person = F.struct(_key("club", "club").alias("club_key"), F.lit("continuing").alias("entry"))
    seasons = plays.groupBy("competition_key", "season").agg(F.collect_list(person).alias("participants"))
    rules = F.struct(
        F.lit(1).alias("version"), F.struct(F.lit(3).alias("win"), F.lit(1).alias("draw"), F.lit(0).alias("loss")).alias("points"),
        F.array(F.lit("points"), F.lit("goal_difference")).alias("ranking"), F.lit(2).alias("round_robin_legs"), F.lit(1).alias("relegation_places"),
        F.lit(1).alias("promotion_places_into_season"),
    )
    year = F.col("season").cast("string")
    season = F.struct(
        year.alias("key"), F.concat(year, F.lit("-01-01")).alias("starts_on"), F.concat(year, F.lit("-12-31")).alias("ends_on"),
        F.concat(year, F.lit("-01-01T00:00:00Z")).alias("rules_valid_from"), F.concat(year, F.lit("-01-01T00:00:00Z")).alias("rules_observed_at"),
        rules.alias("rules"), "participants",
    )
    listed = seasons.groupBy("competition_key").agg(F.collect_list(season).alias("seasons"))
    return clubs.join(listed, "competition_key").select(
        F.lit(1).alias("format_version"), _key("league", "competition_key").alias("key"), _key("League", "competition_key").alias("name"),
        F.lit("NOR").alias("country_code"), F.lit("league").alias("competition_type"), F.lit("Europe/Oslo").alias("timezone"), "clubs", "seasons",
    )


def revisions(matches: DataFrame) -> DataFrame:
    """Two revisions a fixture, scheduled and finished, and a correction of every tenth."""
    def one(number: int, kind: str, status: str, observed: Column, home: Column, away: Column) -> Column:
        return F.struct(
            F.lit(number).alias("revision"), F.lit(kind).alias("revision_kind"), _instant(observed).alias("observed_at"), F.lit(status).alias("status"),
            home.cast("int").alias("home_score"), away.cast("int").alias("away_score"),
        )

    kickoff, none, home, away = F.col("kickoff_at"), F.lit(None), F.col("home_goals"), F.col("away_goals")
    later = F.when(F.col("match_id") % 10 == 0, F.array(one(3, "result_correction", "finished", kickoff + F.expr("interval 10 days"), home + 1, away)))
    all_ = F.concat(
        F.array(
            one(1, "initial", "scheduled", kickoff - F.expr("interval 30 days"), none, none),
            one(2, "status_change", "finished", kickoff + F.expr("interval 2 hours"), home, away),
        ),
        F.coalesce(later, F.array().cast("array<struct<revision:int,revision_kind:string,observed_at:string,status:string,home_score:int,away_score:int>>")),
    )
    return matches.select("competition_key", "season", "block", "match_id", "kickoff_at", "home_club_id", "away_club_id", F.inline(all_))


def stream_documents(matches: DataFrame) -> DataFrame:
    """The observations of a block of fixtures of a season."""
    one = F.struct(
        _key("fixture", "match_id").alias("fixture_key"), "revision", "revision_kind", "observed_at", _instant(F.col("kickoff_at")).alias("kickoff_at"),
        _key("club", "home_club_id").alias("home_club_key"), _key("club", "away_club_id").alias("away_club_key"), "status", "home_score", "away_score",
    )
    rows = revisions(matches).groupBy("competition_key", "season", "block").agg(F.collect_list(one).alias("observations"))
    return rows.select(
        F.lit(1).alias("format_version"), _key("league", "competition_key").alias("competition_key"), F.col("season").cast("string").alias("season_key"),
        "observations",
    )


def manifest_documents(matches: DataFrame, archive: str) -> DataFrame:
    """A run per competition and block; one record a fixture, which holds all its revisions."""
    refs = revisions(matches).groupBy("competition_key", "block", "match_id").agg(
        F.collect_list(F.struct(_key("fixture", "match_id").alias("fixture_key"), "revision")).alias("observations")
    )
    record = F.struct(
        _key("page", "match_id").alias("evidence_key"), F.lit("2040-01-01T00:00:00Z").alias("observed_at"),
        F.lit("2040-01-01T00:00:00Z").alias("fetched_at"), F.to_json(F.struct("match_id")).alias("payload"), "observations",
    )
    source = F.struct(
        _key(archive, "competition_key").alias("key"), _key("Archive", "competition_key").alias("name"), F.lit("historical").alias("kind"),
        F.lit("p1").alias("parser_version"), F.lit("c1").alias("collector_version"),
    )
    runs = refs.groupBy("competition_key", "block").agg(F.collect_list(record).alias("records"))
    return runs.select(
        F.lit(1).alias("format_version"), source.alias("source"), _key("run", "competition_key", "block").alias("run_key"),
        F.lit("2040-01-01T00:00:00Z").alias("started_at"), F.lit("2040-01-01T01:00:00Z").alias("finished_at"), "records",
    )


def import_history(spark, sf):
    """Counts per table of an import, its replay, its enrichment by evidence, a renamed club, and evidence of another archive."""
    matches = _matches(spark, sf)
    seeds = d.load_seeds(spark, _written(seed_documents(matches), "seeds"), multiline=False)
    renamed = d.load_seeds(spark, _written(seed_documents(matches, renamed=7), "seeds"), multiline=False)
    observations = d.load_fixture_streams(spark, _written(stream_documents(matches), "streams"), seeds, multiline=False)
    manifests, others = (
        d.load_manifests(spark, _written(manifest_documents(matches, archive), "manifests"), multiline=False) for archive in ("archive", "other")
    )
    store = TableStore(spark, _folder(spark, "lake"))
    steps = []
    for step, seed, evidence in (
        ("insert", seeds, None), ("replay", seeds, None), ("enrich", seeds, manifests), ("rename", renamed, None), ("rebind", seeds, others),
    ):
        try:
            summary = imports.import_dataset(store, step, seed, observations, evidence)
        except imports.ImportConflict as conflict:
            summary = conflict.summary
        steps.append(summary.withColumn("step", F.lit(step)))
    return reduce(DataFrame.unionByName, steps)


def imported_heads(spark, sf):
    """The result that stands for every fixture after its import, read back from the store."""
    from pitchlake.operators import canonical as c

    matches = _matches(spark, sf)
    seeds = d.load_seeds(spark, _written(seed_documents(matches), "seeds"), multiline=False)
    observations = d.load_fixture_streams(spark, _written(stream_documents(matches), "streams"), seeds, multiline=False)
    store = TableStore(spark, _folder(spark, "lake"))
    imports.import_dataset(store, "r1", seeds, observations)
    tables = store.tables()
    heads = c.match_heads(tables["matches"], tables["match_revisions"])
    return heads.groupBy("status", "home_score", "away_score").agg(F.count(F.lit(1)).alias("matches"))


_ROWS = f"""{ad.ctes("matches")},
m as (select *, year(kickoff_at) as season, match_id // {BLOCK} as block from matches),
plays as (select distinct competition_key, season, unnest([home_club_id, away_club_id]) as club from m),
clubs as (select distinct competition_key, club from plays),
n as (select (select count(distinct competition_key) from m) as leagues, (select count(*) from clubs) as named, (select count(distinct club) from clubs) as club_ids,
  (select count(*) from clubs where club = 7) as sevens, (select count(*) from (select distinct competition_key, season from m)) as seasons,
  (select count(*) from plays) as people, (select count(*) from m) as fixtures, (select count(*) * 2 + count(*) filter (match_id % 10 = 0) from m) as revs,
  (select count(*) from (select distinct competition_key, block from m)) as runs)"""

SQL = {
    "import_history": _ROWS + """,
base as (select unnest([{'t': 'canonical_entities', 'ins': leagues + club_ids, 'ex': named - club_ids}, {'t': 'competitions', 'ins': leagues, 'ex': 0},
    {'t': 'clubs', 'ins': club_ids, 'ex': named - club_ids}, {'t': 'competition_seasons', 'ins': seasons, 'ex': 0},
    {'t': 'season_rule_versions', 'ins': seasons, 'ex': 0}, {'t': 'season_club_participations', 'ins': people, 'ex': 0},
    {'t': 'matches', 'ins': fixtures, 'ex': 0}, {'t': 'match_revisions', 'ins': revs, 'ex': 0}], recursive := true) from n),
proof as (select unnest([{'t': 'sources', 'ins': leagues, 'ex': runs - leagues}, {'t': 'source_configs', 'ins': leagues, 'ex': runs - leagues},
    {'t': 'collector_runs', 'ins': runs, 'ex': 0}, {'t': 'raw_source_records', 'ins': fixtures, 'ex': 0}], recursive := true) from n),
seen as (select t, 0 as ins, ins + ex as ex from base),
steps as (select 'insert' as step, t, ins, ex, 0 as con from base
  union all select 'replay', t, ins, ex, 0 from seen
  union all select 'enrich', t, ins, ex, 0 from (select * from seen union all select * from proof)
  union all select 'rename', t, ins, case when t = 'clubs' then ex - sevens else ex end, case when t = 'clubs' and sevens > 0 then 1 else 0 end from seen, n
  union all select 'rebind', t, ins, ex, 0 from (select * from seen union all select * from proof)
  union all select 'rebind', 'match_revision_bindings', 0, 0, revs from n)
select step, t as table_name, sum(ins)::bigint as inserted, sum(ex)::bigint as existing, sum(con)::bigint as conflicting from steps
group by grouping sets ((step, t), (step))""",
    "imported_heads": f"""{ad.ctes("matches")}
select 'finished' as status, case when match_id % 10 = 0 then home_goals + 1 else home_goals end as home_score, away_goals as away_score, count(*) as matches
from matches group by all""",
}

QUERIES = {f.__name__: f for f in (import_history, imported_heads)}
