"""Domain tables derived from the star-schema test tables.

The text is SQL both Spark and DuckDB accept, so that a query and its check read identical inputs.  Each
entry of ``VIEWS`` is one SELECT over the raw tables or over earlier views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "matches": """
        select o_orderkey as match_id, cast(o_orderkey % 5 as int) as competition_key,
          cast(o_custkey % 20 as int) as home_club_id,
          cast((o_custkey % 20 + 1 + o_orderkey % 19) % 20 as int) as away_club_id,
          o_orderdate as kickoff_at, o_orderdate + interval '2' hour as result_observed_at,
          cast((o_orderkey * 7919 + o_custkey * 31) % 5 as int) as home_goals,
          cast((o_orderkey * 104729 + o_custkey * 17) % 4 as int) as away_goals
        from orders""",
    "market_snapshots": """
        select match_id, observed_at, source_key, h / (h + d + a) as p_home, d / (h + d + a) as p_draw,
          a / (h + d + a) as p_away
        from (select l_orderkey as match_id, l_shipdate as observed_at,
            concat('market_', cast(l_suppkey % 3 as varchar(10))) as source_key,
            sum(l_quantity + 1) as h, sum(l_linenumber * 3.0e0 + 1) as d, sum(l_suppkey % 30 + 1.0e0) as a
          from lineitem
          group by l_orderkey, l_shipdate, concat('market_', cast(l_suppkey % 3 as varchar(10)))) t""",
    "revisions": """
        select fixture_key, cast(revision as int) as revision,
          case when revision = 1 then 'initial' else 'status_change' end as revision_kind, observed_at, status,
          case when status = 'finished' then cast(l_quantity as int) % 5 end as home_score,
          case when status = 'finished' then cast(l_suppkey as int) % 4 end as away_score
        from (select l_orderkey as fixture_key,
            row_number() over (partition by l_orderkey
              order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) as revision,
            l_shipdate as observed_at,
            case l_returnflag when 'R' then 'finished' when 'A' then 'postponed' else 'scheduled' end as status,
            l_quantity, l_suppkey
          from lineitem) t""",
    "domain_events": """
        select event_id, event_type, user_id as entity_id, ts as occurred_at,
          ts + (event_id % 48) * interval '1' hour as observed_at, ts as valid_from,
          case when event_id % 3 = 0 then null else ts + (1 + event_id % 240) * interval '1' hour end as valid_until,
          (event_id % 101) / 100.0e0 as confidence, props as payload
        from events""",
    "candidates": """
        select p_partkey as entity_id, case when p_size % 2 = 0 then 'club' else 'player' end as entity_type,
          p_name as canonical_name, p_brand as country_code
        from part""",
    "records": """
        select page_id as record_id, url as canonical_url, html from pages""",
}

DEPENDS = {
    "matches": "orders",
    "market_snapshots": "lineitem",
    "revisions": "lineitem",
    "domain_events": "events",
    "candidates": "part",
    "records": "pages",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table."""
    raw = DEPENDS[name]
    table(spark, sf_dir, raw).createOrReplaceTempView(raw)
    return spark.sql(VIEWS[name])


def ctes(*names: str) -> str:
    """The derived tables as the WITH clause of a check query."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
