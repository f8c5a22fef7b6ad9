"""Forecasting queries: models, walk-forward evaluation, market, calibration, league tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import rates
from pitchlake.operators import evaluation as ev
from pitchlake.operators import league
from pitchlake.plans import backtest as bt
from pitchlake.plans import elo
from pitchlake.plans import goal_ratings as gr
from pitchlake.plans import models as m
from pitchlake.sources import adapters as ad

DAY = 86400
BY = ["competition_key"]
GRID = [m.PoissonModel(), m.DixonColesModel(), m.DixonColesModel(rho=0.1, smoothing_matches=5.0)]
LEADS = [DAY, 3600]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that summation order does not show."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return ad.view(spark, sf, "matches")


def _walk(spark, sf, models, leads=(DAY,), market=False) -> DataFrame:
    snapshots = ad.view(spark, sf, "market_snapshots") if market else None
    return bt.walk_forward(_matches(spark, sf), models, list(leads), min_train_matches=50, market=snapshots)


# --- Spark -------------------------------------------------------------------------------------------


def poisson_walk_forward(spark, sf):
    return rounded(ev.aggregate_metrics(_walk(spark, sf, [m.PoissonModel()]), BY))


def dixon_coles_walk_forward(spark, sf):
    return rounded(ev.aggregate_metrics(_walk(spark, sf, [m.DixonColesModel()]), BY))


def elo_walk_forward(spark, sf):
    return rounded(ev.aggregate_metrics(_walk(spark, sf, [m.EloModel()]), BY, score_loss=False))


def goal_ratings(spark, sf):
    """Attack and defence of every club after its last result."""
    history = gr.goal_rating_history(_matches(spark, sf), [m.GoalRatingModel()])
    last = history.groupBy("competition_key", "club_id").agg(
        F.max_by("ratings", "_seq").alias("r"), F.count("*").alias("played")
    )
    return rounded(last.select("competition_key", "club_id", F.get("r", F.lit(0)).alias("attack"), F.get("r", F.lit(1)).alias("defence"), "played"))


def goal_ratings_walk_forward(spark, sf):
    return rounded(ev.aggregate_metrics(_walk(spark, sf, [m.GoalRatingModel()]), BY))


def elo_final_ratings(spark, sf):
    history = elo.rating_history(_matches(spark, sf), [m.EloModel()])
    last = history.groupBy("competition_key", "club_id").agg(
        F.max_by(F.get("ratings", F.lit(0)), "_seq").alias("rating"), F.count("*").alias("played")
    )
    return rounded(last)


def model_grid_report(spark, sf):
    hashes = F.create_map(
        *[
            F.lit(x)
            for model in GRID
            for lead in LEADS
            for x in (f"{m.config_id(model)}:{lead}", bt.config_hash(model, bt.BacktestConfig(lead)))
        ]
    )
    report = bt.report(_walk(spark, sf, GRID, LEADS), has_market=False)
    run = F.concat_ws(":", "config_id", F.col("lead_time_seconds").cast("string"))
    return rounded(report.withColumn("config_hash", hashes[run]))


def poisson_predictions(spark, sf):
    rows = _walk(spark, sf, [m.PoissonModel()])
    return rounded(
        rows.select(
            "match_id", "prediction_cutoff", "data_cutoff", "train_match_count", "expected_home_goals",
            "expected_away_goals", "p_home", "p_draw", "p_away", "log_loss", "brier_score", "rps", "score_log_loss",
        )
    )


def score_grid_means(spark, sf):
    """The explicit corrected grid of every forecast, averaged per competition and score."""
    rows = _walk(spark, sf, [m.PoissonModel()])
    return rounded(rates.mean_score_grid(rows, "competition_key", "expected_home_goals", "expected_away_goals", rho=-0.08))


def training_windows(spark, sf):
    matches = _matches(spark, sf)
    state = m.with_goal_state(matches, bt.make_targets(matches, LEADS))
    eligible = F.col("train_match_count") >= 50
    return state.select(
        "match_id", "lead_time_seconds", "prediction_cutoff", "data_cutoff", "train_match_count",
        "league_home_goals", "league_away_goals", "home_matches", "home_goals_for", "home_goals_against",
        "away_matches", "away_goals_for", "away_goals_against", eligible.alias("eligible"),
    )


def market_alignment(spark, sf):
    targets = bt.make_targets(_matches(spark, sf), [DAY])
    aligned = bt.align_market(targets, ad.view(spark, sf, "market_snapshots"))
    return rounded(
        aligned.select(
            "match_id", "prediction_cutoff", "market_observed_at", "market_source_key", "market_p_home",
            "market_p_draw", "market_p_away",
        )
    )


def model_against_market(spark, sf):
    return rounded(bt.report(_walk(spark, sf, [m.PoissonModel()], market=True), BY))


def market_coverage(spark, sf):
    return ev.market_coverage(_walk(spark, sf, [m.DixonColesModel()], LEADS, market=True), ["lead_time_seconds"])


def calibration_bins(spark, sf):
    return rounded(ev.calibration_table(_walk(spark, sf, [m.DixonColesModel()]), BY))


def calibration_error(spark, sf):
    table = ev.calibration_table(_walk(spark, sf, [m.DixonColesModel()]), BY)
    return rounded(ev.expected_calibration_error(table, BY))


def calibration_rollup(spark, sf):
    """Mean scores by model and lead, by model, and overall."""
    rows = _walk(spark, sf, GRID[:2], LEADS)
    rolled = rows.rollup("model_key", "lead_time_seconds").agg(
        F.count("*").alias("forecasts"), F.avg("rps").alias("rps"), F.avg("brier_score").alias("brier_score")
    )
    return rounded(rolled)


def paired_delta(spark, sf):
    return rounded(ev.paired_delta(_walk(spark, sf, [m.PoissonModel()], market=True), BY))


def paired_bootstrap(spark, sf):
    # Blocks of 1024 pairs, so that groups of the test tables have several.
    return rounded(ev.paired_bootstrap(_walk(spark, sf, [m.PoissonModel()], market=True), BY, block_rows=1024))


def backtest_order(spark, sf):
    """Every forecast's place in the order of a backtest: kickoff, then the text of the match id."""
    runs = _walk(spark, sf, [m.PoissonModel()], LEADS)
    return bt.in_backtest_order(runs).select("place", "match_id", "lead_time_seconds")


def leakage_check(spark, sf):
    rows = _walk(spark, sf, [m.PoissonModel()], LEADS, market=True)
    # Forecasts whose cutoff is put back after the fact have seen too much.
    moved = F.when(F.col("match_id") % 3 == 0, F.col(m.CUTOFF) - F.make_dt_interval(F.lit(30))).otherwise(F.col(m.CUTOFF))
    # Both counts in one pass: forecasts are dear.
    return rows.groupBy("lead_time_seconds").agg(F.count("*").alias("forecasts"), F.count_if(bt.leaked(rows.columns, moved)).alias("leaks"))


def points_baseline(spark, sf):
    matches = _matches(spark, sf)
    rows = league.points_forecasts(matches, bt.make_targets(matches, [DAY])).filter("train_match_count >= 50")
    scored = ev.score_forecasts(rows)
    return rounded(ev.aggregate_metrics(scored, BY, score_loss=False))


def league_standings(spark, sf):
    season = _matches(spark, sf).withColumn("season", F.year("kickoff_at"))
    return league.league_table(season, ["competition_key", "season"]).drop("points_rank")


def league_head_to_head(spark, sf):
    season = _matches(spark, sf).withColumn("season", F.year("kickoff_at"))
    ranking = ("points", "head_to_head_points", "head_to_head_goal_difference", "goal_difference", "goals_for")
    return league.league_table(season, ["competition_key", "season"], ranking=ranking)


def data_snapshot(spark, sf):
    return bt.data_snapshot_hash(_matches(spark, sf), BY)


# --- SQL ---------------------------------------------------------------------------------------------


def _targets(leads) -> str:
    values = ", ".join(f"({x})" for x in leads)
    return f"""
tgt as (select m.*, lead_time_seconds, kickoff_at - lead_time_seconds * interval '1' second as cutoff,
    case when home_goals > away_goals then 0 when home_goals = away_goals then 1 else 2 end as y
  from matches m cross join (values {values}) l(lead_time_seconds))"""


def _state(leads) -> str:
    return f"""{ad.ctes("matches", "market_snapshots")},{_targets(leads)},
ev as (select competition_key, result_observed_at as ts, 1 as n, home_goals as hg, away_goals as ag, home_club_id as hc,
    away_club_id as ac, cast(null as bigint) as match_id, 0 as lead_time_seconds from matches
  union all select competition_key, cutoff, 0, 0, 0, home_club_id, away_club_id, match_id, lead_time_seconds from tgt),
run as (select match_id, lead_time_seconds,
    sum(n) over lw as n, sum(hg) over lw as hg, sum(ag) over lw as ag,
    max(case when n = 1 then ts end) over lw as data_cutoff,
    sum(n) over hw as hn, sum(hg) over hw as hf, sum(ag) over hw as hag,
    sum(n) over aw as an, sum(ag) over aw as af, sum(hg) over aw as aag
  from ev
  window lw as (partition by competition_key order by ts),
    hw as (partition by competition_key, hc order by ts),
    aw as (partition by competition_key, ac order by ts)),
state as (select t.*, r.* exclude (match_id, lead_time_seconds) from tgt t
  join run r on t.match_id = r.match_id and t.lead_time_seconds = r.lead_time_seconds)"""


_OUTCOMES = """cell as (select match_id, lead_time_seconds, config_id, home_goals, away_goals, lam, mu, rho, corrected, h, a,
    exp(-lam) * pow(lam, h) / factorial(h::int)::double * exp(-mu) * pow(mu, a) / factorial(a::int)::double as p
  from rate cross join (select unnest(range(0, 9)) as h) cross join (select unnest(range(0, 9)) as a)),
norm as (select * replace (p / sum(p) over (partition by match_id, lead_time_seconds, config_id) as p) from cell),
tau as (select * replace (case when corrected then greatest(p * case when h = 0 and a = 0 then 1 - lam * mu * rho
    when h = 0 and a = 1 then 1 + lam * rho when h = 1 and a = 0 then 1 + mu * rho
    when h = 1 and a = 1 then 1 - rho else 1 end, 1e-15) else p end as p) from norm),
grid as (select * replace (p / sum(p) over (partition by match_id, lead_time_seconds, config_id) as p) from tau),
outcome as (select match_id, lead_time_seconds, config_id, sum(case when h > a then p else 0 end) as p_home,
    sum(case when h = a then p else 0 end) as p_draw, sum(case when h < a then p else 0 end) as p_away,
    coalesce(max(case when h = home_goals and a = away_goals then p end), 0) as p_score
  from grid group by all),
fc as (select r.*, o.p_home, o.p_draw, o.p_away, o.p_score from rate r join outcome o
  on r.match_id = o.match_id and r.lead_time_seconds = o.lead_time_seconds and r.config_id = o.config_id)"""


def _forecasts(models, leads=(DAY,), min_train=50) -> str:
    rows = ", ".join(
        f"('{x.key}', '{m.config_id(x)}', {x.smoothing_matches}::double, {getattr(x, 'rho', 0.0)}::double, "
        f"{'true' if hasattr(x, 'rho') else 'false'})"
        for x in models
    )
    return f"""{_state(leads)},
cfg as (select * from (values {rows}) c(model_key, config_id, k, rho, corrected)),
mean as (select s.*, c.*, greatest(hg / n, 0.05) as mh, greatest(ag / n, 0.05) as ma
  from state s cross join cfg c where n >= {min_train}),
rate as (select *,
    least(greatest(mh * (((hf + k * mh) / (hn + k)) / mh) * (((aag + k * mh) / (an + k)) / mh), 0.05), 5.0) as lam,
    least(greatest(ma * (((af + k * ma) / (an + k)) / ma) * (((hag + k * ma) / (hn + k)) / ma), 0.05), 5.0) as mu
  from mean),
{_OUTCOMES}"""


_SCORED = """
sc as (select *, -ln(greatest(case y when 0 then p_home when 1 then p_draw else p_away end, 1e-15)) as log_loss,
    (pow(p_home - (y = 0)::int, 2) + pow(p_draw - (y = 1)::int, 2) + pow(p_away - (y = 2)::int, 2)) / 3 as brier_score,
    (pow(p_home - (y = 0)::int, 2) + pow(p_home + p_draw - (y <= 1)::int, 2)) / 2 as rps,
    -ln(greatest(p_score, 1e-15)) as score_log_loss from fc)"""


def _bins(by: str, source: str = "sc", prefix: str = "") -> str:
    return f"""
cls{prefix} as (select {by}, ci, case ci when 0 then {prefix}p_home when 1 then {prefix}p_draw else {prefix}p_away end as p,
    case when y = ci then 1.0 else 0.0 end as hit
  from {source} cross join (values (0), (1), (2)) c(ci) where {prefix}p_home is not null),
bins{prefix} as (select {by}, ci, cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, avg(p) as mp, avg(hit) as mf
  from cls{prefix} group by all),
ece{prefix} as (select {by}, {", ".join(f"sum(case when ci = {i} then n * abs(mp - mf) end) / sum(case when ci = {i} then n end) as ece_{c}" for i, c in enumerate(ev.CLASSES))}
  from bins{prefix} group by all)"""


def _metrics(by: str, score_loss: bool = True) -> str:
    score = "round(avg(score_log_loss), 6) as score_log_loss," if score_loss else ""
    keys = ", ".join(f"s.{k.strip()}" for k in by.split(","))
    using = ", ".join(k.strip() for k in by.split(","))
    return f"""
select {using}, count(*) as matches, round(avg(log_loss), 6) as log_loss, round(avg(brier_score), 6) as brier_score,
  round(avg(rps), 6) as rps, {score} round(any_value(ece_home), 6) as ece_home, round(any_value(ece_draw), 6) as ece_draw,
  round(any_value(ece_away), 6) as ece_away
from sc s join ece e using ({using}) group by {using}"""


_MARKET = """
mk as (select t.match_id, t.lead_time_seconds, max_by(struct_pack(o := s.observed_at, k := s.source_key, h := s.p_home,
    d := s.p_draw, a := s.p_away), (s.observed_at, -cast(right(s.source_key, 1) as int))) as b
  from tgt t join market_snapshots s on s.match_id = t.match_id and s.observed_at <= t.cutoff group by all)"""

_PRICED = """
pr as (select s.*, b.o as market_observed_at, b.h as mkt_p_home, b.d as mkt_p_draw, b.a as mkt_p_away,
    -ln(greatest(case y when 0 then b.h when 1 then b.d else b.a end, 1e-15)) as mkt_log_loss,
    (pow(b.h - (y = 0)::int, 2) + pow(b.d - (y = 1)::int, 2) + pow(b.a - (y = 2)::int, 2)) / 3 as mkt_brier_score,
    (pow(b.h - (y = 0)::int, 2) + pow(b.h + b.d - (y <= 1)::int, 2)) / 2 as mkt_rps
  from sc s left join mk using (match_id, lead_time_seconds))"""

_ELO = f"""with recursive {ad.ctes("matches")[5:]},
ord as (select *, row_number() over (partition by competition_key order by result_observed_at, kickoff_at,
    cast(match_id as varchar)) as rn,
    case when home_goals > away_goals then 1.0 when home_goals = away_goals then 0.5 else 0.0 end as s from matches),
elo(competition_key, rn, r) as (
  select distinct competition_key, cast(0 as bigint), list_transform(range(20), lambda i: 1500.0::double) from matches
  union all
  select competition_key, rn, list_transform(range(20), lambda i: case when i = hc then r[i + 1] + d
      when i = ac then r[i + 1] - d else r[i + 1] end)
  from (select e.competition_key, o.rn, e.r, o.home_club_id as hc, o.away_club_id as ac,
      20.0 * (o.s - 1.0 / (1.0 + pow(10.0, -((e.r[o.home_club_id + 1] + 65.0) - e.r[o.away_club_id + 1]) / 400.0))) as d
    from elo e join ord o on o.competition_key = e.competition_key and o.rn = e.rn + 1) q)"""


# Entries 1 to 20 are the clubs' attack, 21 to 40 their defence.
_RATED = f"""with recursive {ad.ctes("matches")[5:]},
ord as (select *, row_number() over (partition by competition_key order by result_observed_at, kickoff_at,
    cast(match_id as varchar)) as rn from matches),
rated(competition_key, rn, r) as (
  select distinct competition_key, cast(0 as bigint), list_transform(range(40), lambda i: 0.0::double) from matches
  union all
  select competition_key, rn, list_transform(range(40), lambda i: case when i = hc then r[i + 1] + up when i = ac then r[i + 1] + up_away
      when i = hc + 20 then r[i + 1] - up_away when i = ac + 20 then r[i + 1] - up else r[i + 1] end)
  from (select e.competition_key, o.rn, e.r, o.home_club_id as hc, o.away_club_id as ac,
      0.03::double * (o.home_goals - least(greatest(1.5::double * exp(e.r[o.home_club_id + 1] - e.r[o.away_club_id + 21]), 0.05), 5.0)) as up,
      0.03::double * (o.away_goals - least(greatest(1.2::double * exp(e.r[o.away_club_id + 1] - e.r[o.home_club_id + 21]), 0.05), 5.0)) as up_away
    from rated e join ord o on o.competition_key = e.competition_key and o.rn = e.rn + 1) q)"""


def _standings(head_to_head: bool) -> str:
    base = f"""{ad.ctes("matches")},
res as (select *, cast(year(kickoff_at) as int) as season from matches),
side as (
  select competition_key, season, home_club_id as club_id, away_club_id as opp, home_goals as gf, away_goals as ga from res
  union all select competition_key, season, away_club_id, home_club_id, away_goals, home_goals from res),
pt as (select *, case when gf > ga then 3 when gf = ga then 1 else 0 end as pts from side),
tab as (select competition_key, season, club_id, count(*) as played, sum((gf > ga)::int)::bigint as won,
    sum((gf = ga)::int)::bigint as drawn, sum((gf < ga)::int)::bigint as lost, sum(gf)::bigint as goals_for,
    sum(ga)::bigint as goals_against, sum(pts)::bigint as points, (sum(gf) - sum(ga))::bigint as goal_difference
  from pt group by all)"""
    if not head_to_head:
        return base + """
select *, cast(rank() over (partition by competition_key, season order by points desc, goal_difference desc,
  goals_for desc) as int) as position from tab"""
    return base + """,
mini as (select p.competition_key, p.season, p.club_id, sum(p.pts)::bigint as head_to_head_points,
    (sum(p.gf) - sum(p.ga))::bigint as head_to_head_goal_difference, sum(p.gf)::bigint as head_to_head_goals
  from pt p join tab t using (competition_key, season, club_id)
  join tab o on o.competition_key = p.competition_key and o.season = p.season and o.club_id = p.opp and o.points = t.points
  group by all)
select t.*, coalesce(head_to_head_points, 0) as head_to_head_points,
  coalesce(head_to_head_goal_difference, 0) as head_to_head_goal_difference,
  coalesce(head_to_head_goals, 0) as head_to_head_goals,
  cast(rank() over (partition by competition_key, season order by points desc, coalesce(head_to_head_points, 0) desc,
    coalesce(head_to_head_goal_difference, 0) desc, goal_difference desc, goals_for desc) as int) as position
from tab t left join mini using (competition_key, season, club_id)"""


def _config_hashes() -> str:
    values = []
    for model in GRID:
        for lead in LEADS:
            text = json.dumps(
                {
                    "model_key": model.key, "model_config": model.config(), "lead_time_seconds": lead,
                    "min_train_matches": 50, "seed": 0, "bootstrap_samples": 1000,
                    "market_alignment": bt.MARKET_ALIGNMENT,
                },
                sort_keys=True, separators=(",", ":"),
            )
            values.append(f"('{m.config_id(model)}', {lead}, '{text}')")
    return ", ".join(values)


_PRED = _forecasts([m.PoissonModel()])
_DC = _forecasts([m.DixonColesModel()])

def _mix(state: str, value: str, out: str) -> str:
    """The generator's step as columns of one SELECT, each built on the one before."""
    return (
        f"(({state}) * 31 + ({value})) & 2147483647 as {out}0, (xor({out}0, {out}0 >> 16) * 73244475) & 2147483647 as {out}1, "
        f"(xor({out}1, {out}1 >> 16) * 73244475) & 2147483647 as {out}2, xor({out}2, {out}2 >> 16) as {out}"
    )


def _lanes(values: list[str], out: str) -> str:
    """Both lanes after a list of values, as columns ``out`` with a and b."""
    columns = []
    for lane, state in (("a", "19088743::bigint"), ("b", "124076833::bigint")):
        for k, value in enumerate(values):
            state_out = f"{out}{lane}{k}_" if k < len(values) - 1 else f"{out}{lane}"
            columns.append(_mix(state, value, state_out))
            state = state_out
    return ", ".join(columns)


SQL = {
    "poisson_walk_forward": f"{_PRED},{_SCORED},{_bins('competition_key')}{_metrics('competition_key')}",
    "dixon_coles_walk_forward": f"{_DC},{_SCORED},{_bins('competition_key')}{_metrics('competition_key')}",
    "model_grid_report": f"""{_forecasts(GRID, LEADS)},{_SCORED},{_bins('model_key, config_id, lead_time_seconds')},
rep as ({_metrics('model_key, config_id, lead_time_seconds')})
select r.*, sha256(txt) as config_hash from rep r
join (values {_config_hashes()}) c(config_id, lead_time_seconds, txt) using (config_id, lead_time_seconds)""",
    "poisson_predictions": f"""{_PRED},{_SCORED}
select match_id, cutoff as prediction_cutoff, data_cutoff, n::bigint as train_match_count,
  round(lam, 6) as expected_home_goals, round(mu, 6) as expected_away_goals, round(p_home, 6) as p_home,
  round(p_draw, 6) as p_draw, round(p_away, 6) as p_away, round(log_loss, 6) as log_loss,
  round(brier_score, 6) as brier_score, round(rps, 6) as rps, round(score_log_loss, 6) as score_log_loss from sc""",
    "score_grid_means": f"""{_DC}
select r.competition_key, g.h::int as home_goals, g.a::int as away_goals, count(*) as forecasts,
  round(avg(g.p), 6) as mean_probability
from grid g join rate r on g.match_id = r.match_id group by all""",
    "training_windows": f"""{_state(LEADS)}
select match_id, lead_time_seconds, cutoff as prediction_cutoff, data_cutoff, n::bigint as train_match_count,
  hg::bigint as league_home_goals, ag::bigint as league_away_goals, hn::bigint as home_matches,
  hf::bigint as home_goals_for, hag::bigint as home_goals_against, an::bigint as away_matches,
  af::bigint as away_goals_for, aag::bigint as away_goals_against, n >= 50 as eligible from state""",
    "market_alignment": f"""{ad.ctes("matches", "market_snapshots")},{_targets([DAY])},{_MARKET}
select t.match_id, t.cutoff as prediction_cutoff, b.o as market_observed_at, b.k as market_source_key,
  round(b.h, 6) as market_p_home, round(b.d, 6) as market_p_draw, round(b.a, 6) as market_p_away
from tgt t left join mk using (match_id, lead_time_seconds)""",
    "model_against_market": f"""{_PRED},{_SCORED},{_MARKET},{_PRICED},{_bins('competition_key')},
{_bins('competition_key', 'pr', 'mkt_')},
mod as ({_metrics('competition_key')}),
mka as (select competition_key, count(*) as market_matches, round(avg(mkt_log_loss), 6) as market_log_loss,
    round(avg(mkt_brier_score), 6) as market_brier_score, round(avg(mkt_rps), 6) as market_rps
  from pr where mkt_p_home is not null group by all)
select mod.*, coalesce(market_matches, 0) as market_matches, market_log_loss, market_brier_score, market_rps,
  round(e.ece_home, 6) as market_ece_home, round(e.ece_draw, 6) as market_ece_draw, round(e.ece_away, 6) as market_ece_away
from mod left join mka using (competition_key) left join ecemkt_ e using (competition_key)""",
    "market_coverage": f"""{_state(LEADS)},{_MARKET}
select lead_time_seconds, count(*) as observations, count(b) as market_coverage
from (select * from state where n >= 50) s left join mk using (match_id, lead_time_seconds) group by all""",
    "calibration_bins": f"""{_DC},{_SCORED},{_bins('competition_key')}
select competition_key, ci as class_index, bin, n as forecasts, round(mp, 6) as mean_prediction,
  round(mf::double, 6) as empirical_frequency, round(bin / 10.0::double, 6) as lower,
  round((bin + 1) / 10.0::double, 6) as upper, round(abs(mp - mf), 6) as absolute_gap from bins""",
    "calibration_error": f"""{_DC},{_SCORED},{_bins('competition_key')}
select competition_key, ci as class_index, round(sum(n * abs(mp - mf)) / sum(n), 6) as ece from bins group by all""",
    "calibration_rollup": f"""{_forecasts(GRID[:2], LEADS)},{_SCORED}
select model_key, lead_time_seconds, count(*) as forecasts, round(avg(rps), 6) as rps,
  round(avg(brier_score), 6) as brier_score from sc group by rollup (model_key, lead_time_seconds)""",
    "paired_delta": f"""{_PRED},{_SCORED},{_MARKET},{_PRICED}
select competition_key, count(*) as pairs, round(avg(rps - mkt_rps), 6) as mean_delta from pr
where mkt_rps is not null group by all""",
    "paired_bootstrap": f"""{_PRED},{_SCORED},{_MARKET},{_PRICED},
pairs as (select competition_key, row_number() over (partition by competition_key order by match_id) - 1 as i, rps - mkt_rps as delta from pr where mkt_rps is not null),
sizes as (select competition_key, count(*) as n, avg(delta) as mean_delta, ('0x' || substr(md5(competition_key::varchar), 1, 7))::bigint as g from pairs group by all),
reps as (select *, unnest(range(1000)) as r from sizes),
blocked as (select competition_key, n, g, r, ((da << 31) + db) % n // 1024 as block, count(*) as m from (
    select competition_key, n, g, r, j, {_mix('ka', 'j', 'da')}, {_mix('kb', 'j', 'db')} from (
      select competition_key, n, g, r, unnest(range(n)) as j, ka, kb from (select *, {_lanes(['0', 'g', 'r', '0'], 'k')} from reps))) group by all),
times as (select competition_key, n, g, r, block, case when n <= 1024 then n else m end as m from blocked),
drawn as (select competition_key, r, block * 1024 + ((da << 31) + db) % least(1024, n - block * 1024) as i from (
    select competition_key, n, r, block, {_mix('ka', 't', 'da')}, {_mix('kb', 't', 'db')} from (
      select competition_key, n, r, block, unnest(range(m)) as t, ka, kb from (select *, {_lanes(['0', 'g', 'r', 'block + 1'], 'k')} from times)))),
totals as (select competition_key, r, sum(delta) as total from drawn join pairs using (competition_key, i) group by all),
picked as (select competition_key, list_sort(list(total)) as l from totals group by all)
select competition_key, n as pairs, round(mean_delta, 6) as mean_delta, round(l[1 + cast(floor(999 * 0.025) as int)] / n, 6) as lower_95,
  round(l[1 + cast(floor(999 * 0.975) as int)] / n, 6) as upper_95 from sizes join picked using (competition_key)""",
    "backtest_order": f"""{_state(LEADS)}
select row_number() over (order by kickoff_at, match_id::varchar, lead_time_seconds) - 1 as place, match_id, lead_time_seconds from state where n >= 50""",
    "leakage_check": f"""{_state(LEADS)},{_MARKET}
select lead_time_seconds, count(*) as forecasts,
  count(case when data_cutoff > moved or b.o > moved or kickoff_at <= moved then 1 end) as leaks
from (select *, case when match_id % 3 = 0 then cutoff - interval '30' day else cutoff end as moved from state where n >= 50) s left join mk using (match_id, lead_time_seconds) group by all""",
    "elo_walk_forward": f"""{_ELO},{_targets([DAY])},
cnt as (select t.*, (select count(*) from ord o where o.competition_key = t.competition_key
    and o.result_observed_at <= t.cutoff) as n from tgt t),
gap as (select c.*, (e.r[c.home_club_id + 1] + 65.0) - e.r[c.away_club_id + 1] as g
  from cnt c join elo e on e.competition_key = c.competition_key and e.rn = c.n where c.n >= 50),
pd as (select *, least(greatest(0.27 * exp(-abs(g) / 600.0), 0.05), 0.35) as p_draw, 1.0 / (1.0 + pow(10.0, -g / 400.0)) as x
  from gap),
fc as (select *, (1 - p_draw) * x as p_home, (1 - p_draw) * (1 - x) as p_away, 0.0 as p_score from pd),
{_SCORED},{_bins('competition_key')}{_metrics('competition_key', score_loss=False)}""",
    "elo_final_ratings": f"""{_ELO},
fin as (select competition_key, max_by(r, rn) as r from elo group by all),
pl as (select competition_key, club_id, count(*) as played from (select competition_key, home_club_id as club_id from matches
  union all select competition_key, away_club_id from matches) group by all)
select competition_key, club_id, round(r[club_id + 1], 6) as rating, played from fin join pl using (competition_key)""",
    "goal_ratings": f"""{_RATED},
fin as (select competition_key, max_by(r, rn) as r from rated group by all),
pl as (select competition_key, club_id, count(*) as played from (select competition_key, home_club_id as club_id from matches
  union all select competition_key, away_club_id from matches) group by all)
select competition_key, club_id, round(r[club_id + 1], 6) as attack, round(r[club_id + 21], 6) as defence, played
from fin join pl using (competition_key)""",
    "goal_ratings_walk_forward": f"""{_RATED},{_targets([DAY])},
cnt as (select t.*, (select count(*) from ord o where o.competition_key = t.competition_key
    and o.result_observed_at <= t.cutoff) as n from tgt t),
rate as (select c.*, '-' as config_id, 0.0::double as rho, false as corrected,
    least(greatest(1.5::double * exp(e.r[c.home_club_id + 1] - e.r[c.away_club_id + 21]), 0.05), 5.0) as lam,
    least(greatest(1.2::double * exp(e.r[c.away_club_id + 1] - e.r[c.home_club_id + 21]), 0.05), 5.0) as mu
  from cnt c join rated e on e.competition_key = c.competition_key and e.rn = c.n where c.n >= 50),
{_OUTCOMES},{_SCORED},{_bins('competition_key')}{_metrics('competition_key')}""",
    "points_baseline": f"""{ad.ctes("matches")},{_targets([DAY])},
pts as (select *, case when home_goals > away_goals then 3 when home_goals = away_goals then 1 else 0 end as hp,
    case when home_goals < away_goals then 3 when home_goals = away_goals then 1 else 0 end as ap,
    (home_goals = away_goals)::int as dr from matches),
lev as (select competition_key, result_observed_at as ts, 1 as n, hp + ap as p, dr, null as match_id from pts
  union all select competition_key, cutoff, 0, 0, 0, match_id from tgt),
lst as (select match_id, sum(n) over w as n, sum(p) over w as p, sum(dr) over w as dr from lev
  window w as (partition by competition_key order by ts)),
cev as (select competition_key, home_club_id as club, result_observed_at as ts, 1 as n, hp as p, null as match_id, 0 as s from pts
  union all select competition_key, away_club_id, result_observed_at, 1, ap, null, 0 from pts
  union all select competition_key, home_club_id, cutoff, 0, 0, match_id, 1 from tgt
  union all select competition_key, away_club_id, cutoff, 0, 0, match_id, 2 from tgt),
cst as (select match_id, s, sum(n) over w as n, sum(p) over w as p from cev
  window w as (partition by competition_key, club order by ts)),
jn as (select t.*, l.n, l.dr / l.n as d, l.p / (2 * l.n) as mean, h.n as hn, h.p as hp, a.n as an, a.p as ap from tgt t
  join lst l on l.match_id = t.match_id join cst h on h.match_id = t.match_id and h.s = 1
  join cst a on a.match_id = t.match_id and a.s = 2 where l.n >= 50),
sh as (select *, (hp + 3.0 * mean) / (hn + 3.0) as sth, (ap + 3.0 * mean) / (an + 3.0) as sta from jn),
fc as (select *, (1 - d) * (sth / (sth + sta)) as p_home, d as p_draw, (1 - d) * (1 - sth / (sth + sta)) as p_away,
  0.0 as p_score from sh),
{_SCORED},{_bins('competition_key')}{_metrics('competition_key', score_loss=False)}""",
    "league_standings": _standings(False),
    "league_head_to_head": _standings(True),
    "data_snapshot": f"""{ad.ctes("matches")},
v as (select competition_key, [cast(match_id as varchar), cast(home_club_id as varchar), cast(away_club_id as varchar),
    strftime(kickoff_at, '%Y-%m-%dT%H:%M:%S.%f'), strftime(result_observed_at, '%Y-%m-%dT%H:%M:%S.%f'),
    cast(home_goals as varchar), cast(away_goals as varchar)] as x from matches),
h as (select competition_key, sha256(array_to_string([coalesce(length(y) || ':' || y, '-') for y in x], '')) as d from v)
select competition_key, count(*) as row_count, sha256(concat_ws(':', count(*),
  {", ".join(f"sum(('0x' || substr(d, {4 * i + 1}, 4))::bigint)::bigint" for i in range(16))})) as data_hash
from h group by all""",
}

QUERIES = {
    f.__name__: f
    for f in (
        poisson_walk_forward, dixon_coles_walk_forward, elo_walk_forward, elo_final_ratings, goal_ratings,
        goal_ratings_walk_forward, model_grid_report,
        poisson_predictions, score_grid_means, training_windows, market_alignment, model_against_market,
        market_coverage, calibration_bins, calibration_error, calibration_rollup, paired_delta, paired_bootstrap,
        backtest_order, leakage_check, points_baseline, league_standings, league_head_to_head, data_snapshot,
    )
}
