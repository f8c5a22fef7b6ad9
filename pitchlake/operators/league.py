"""League tables and the points baseline.

Results are first combined to one row per ordered pair of clubs (map-side), so everything after that is
bounded by the number of clubs, not matches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake import vocab

POINTS = {"win": 3, "draw": 1, "loss": 0}
DEFAULT_RANKING = ("points", "goal_difference", "goals_for", "drawing_of_lots")
_HEAD_TO_HEAD = ("head_to_head_points", "head_to_head_goal_difference", "head_to_head_goals")


def club_pairs(results: DataFrame, by: Sequence[str], points: Mapping[str, int] = POINTS) -> DataFrame:
    """Totals of each club against each opponent, from both sides of every result."""
    goal_gap = F.col("home_goals") - F.col("away_goals")
    paired = results.groupBy(*by, "home_club_id", "away_club_id").agg(
        F.count(F.lit(1)).alias("played"),
        F.sum(F.when(goal_gap > 0, 1).otherwise(0)).alias("home_wins"),
        F.sum(F.when(goal_gap == 0, 1).otherwise(0)).alias("draws"),
        F.sum(F.when(goal_gap < 0, 1).otherwise(0)).alias("away_wins"),
        F.sum("home_goals").alias("home_goals"),
        F.sum("away_goals").alias("away_goals"),
    )

    def side(club: str, opponent: str, won: str, lost: str, scored: str, conceded: str) -> Column:
        return F.struct(
            F.col(club).alias("club_id"), F.col(opponent).alias("opponent_id"), F.col(won).alias("won"),
            F.col(lost).alias("lost"), F.col(scored).alias("goals_for"), F.col(conceded).alias("goals_against"),
        )

    sides = F.array(
        side("home_club_id", "away_club_id", "home_wins", "away_wins", "home_goals", "away_goals"),
        side("away_club_id", "home_club_id", "away_wins", "home_wins", "away_goals", "home_goals"),
    )
    rows = paired.select(*by, "played", F.col("draws").alias("drawn"), F.inline(sides))
    score = F.col("won") * points["win"] + F.col("drawn") * points["draw"] + F.col("lost") * points["loss"]
    return rows.withColumn("points", score)


def league_table(
    results: DataFrame,
    by: Sequence[str] = ("competition_key",),
    *,
    points: Mapping[str, int] = POINTS,
    ranking: Sequence[str] = DEFAULT_RANKING,
) -> DataFrame:
    """Standings per group under an ordered list of ranking rules.

    Head-to-head rules compare only the clubs that are level on every rule before the first of them, over
    the matches among those clubs.  Clubs level on all computable rules share a position: playoffs and
    lots are not decided here.
    """
    unknown = [r for r in ranking if r not in vocab.RANKING_RULES]
    if unknown:
        raise ValueError(f"unknown ranking rules: {unknown}")
    by = list(by)
    pairs = club_pairs(results, by, points)
    measures = ("played", "won", "drawn", "lost", "goals_for", "goals_against", "points")
    totals = pairs.groupBy(*by, "club_id").agg(*[F.sum(m).alias(m) for m in measures])
    totals = totals.withColumn("goal_difference", F.col("goals_for") - F.col("goals_against"))

    decided = [r for r in ranking if r not in ("playoff", "drawing_of_lots")]
    if any(r in _HEAD_TO_HEAD for r in decided):
        first = min(i for i, r in enumerate(decided) if r in _HEAD_TO_HEAD)
        level = [F.col(r) for r in decided[:first]]
        totals = totals.withColumn("_level", F.concat_ws(":", F.lit("t"), *[c.cast("string") for c in level]))
        mine = totals.select(*by, "club_id", "_level")
        theirs = totals.select(*by, F.col("club_id").alias("opponent_id"), "_level")
        mini = (
            pairs.join(mine, [*by, "club_id"])
            .join(theirs, [*by, "opponent_id", "_level"])
            .groupBy(*by, "club_id")
            .agg(
                F.sum("points").alias("head_to_head_points"),
                F.sum(F.col("goals_for") - F.col("goals_against")).alias("head_to_head_goal_difference"),
                F.sum("goals_for").alias("head_to_head_goals"),
            )
        )
        totals = totals.join(mini, [*by, "club_id"], "left").na.fill(0, list(_HEAD_TO_HEAD)).drop("_level")

    order = [F.col(r).desc() for r in decided]
    return totals.withColumn("position", F.rank().over(Window.partitionBy(*by).orderBy(*order)))


def points_forecasts(matches: DataFrame, targets: DataFrame, prior_matches: float = 3.0) -> DataFrame:
    """The naive table baseline: win shares follow points per match known at the cutoff.

    The draw share is the league's own rate and each club's points per match is shrunk towards the league
    mean by ``prior_matches``; the rest is split in proportion.  Adds ``p_home, p_draw, p_away`` and
    ``train_match_count``.
    """
    from pitchlake.operators.temporal import prefix_state

    comp, at = "competition_key", "prediction_cutoff"
    gap = F.col("home_goals") - F.col("away_goals")
    home_points = F.when(gap > 0, POINTS["win"]).when(gap == 0, POINTS["draw"]).otherwise(POINTS["loss"])
    away_points = F.when(gap < 0, POINTS["win"]).when(gap == 0, POINTS["draw"]).otherwise(POINTS["loss"])
    drawn = F.when(gap == 0, 1).otherwise(0)

    def club(column: str) -> Column:
        return F.concat(F.lit("club:"), F.col(column).cast("string"))

    league = F.concat(F.lit("league:"), F.col(comp).cast("string"))

    def fact(role: Column, n: int, points: Column) -> Column:
        return F.struct(
            role.alias("_role"), F.lit(n).cast("bigint").alias("_n"), points.cast("bigint").alias("_points"),
            drawn.cast("bigint").alias("_drawn"),
        )

    facts = matches.select(
        comp,
        F.col("result_observed_at").alias(at),
        F.inline(
            F.array(
                fact(league, 1, home_points + away_points),
                fact(club("home_club_id"), 1, home_points),
                fact(club("away_club_id"), 1, away_points),
            )
        ),
    )
    probes = targets.select(comp, at, F.explode(F.array(league, club("home_club_id"), club("away_club_id"))).alias("_role"))
    state = prefix_state(
        facts, probes, [comp, "_role"], at,
        {m: ("sum", F.col(m)) for m in ("_n", "_points", "_drawn")},
    )
    rows = targets.withColumns({"_lk": league, "_hk": club("home_club_id"), "_ak": club("away_club_id")})
    for key in ("_lk", "_hk", "_ak"):
        found = state.select(
            comp, at, F.col("_role").alias(key), F.col("_n").alias(f"{key}_n"), F.col("_points").alias(f"{key}_points"),
            F.col("_drawn").alias(f"{key}_drawn"),
        )
        rows = rows.join(found, [comp, key, at])
    mean = F.try_divide(F.col("_lk_points"), 2 * F.col("_lk_n"))

    def strength(key: str) -> Column:
        return (F.col(f"{key}_points") + prior_matches * mean) / (F.col(f"{key}_n") + prior_matches)

    draw = F.try_divide(F.col("_lk_drawn"), F.col("_lk_n")).cast("double")
    share = F.try_divide(strength("_hk"), strength("_hk") + strength("_ak"))
    return rows.select(
        *targets.columns,
        F.col("_lk_n").alias("train_match_count"),
        ((1.0 - draw) * share).alias("p_home"),
        draw.alias("p_draw"),
        ((1.0 - draw) * (1.0 - share)).alias("p_away"),
    )
