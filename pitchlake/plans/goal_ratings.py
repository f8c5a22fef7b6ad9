"""Attack and defence ratings updated after every result: the goal model that learns match by match instead of from season sums.

A club's attack and defence are logarithms of rates.  After a match each moves by ``learning_rate`` times the goals above what was expected,
one step up the Poisson likelihood.  A second fold beside Elo (``operators.folds``).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import rates
from pitchlake.operators.folds import SEGMENT_ROWS, Fold, segmented_fold
from pitchlake.plans import models as m
from pitchlake.plans.elo import RESULT_ORDER, results_in_order, with_club_values

_C, _H, _A = m.COMPETITION, "home_club_id", "away_club_id"


def goal_fold(models: Sequence[m.GoalRatingModel]) -> Fold:
    """A club's attack and defence, two array entries per model."""

    def play(rows: pd.DataFrame, start: dict) -> list[list]:
        homes, aways = rows[_H].tolist(), rows[_A].tolist()
        scored, conceded = rows["home_goals"].tolist(), rows["away_goals"].tolist()
        columns_home, columns_away = [], []
        for g, model in enumerate(models):
            ratings = {club: (float(handed[2 * g]), float(handed[2 * g + 1])) for club, handed in start.items()}
            after_home, after_away = [], []
            for home, away, goals, against in zip(homes, aways, scored, conceded, strict=True):
                home_attack, home_defence = ratings.get(home, (0.0, 0.0))
                away_attack, away_defence = ratings.get(away, (0.0, 0.0))
                expected = model.base_home_goals * exp(home_attack - away_defence)
                expected_away = model.base_away_goals * exp(away_attack - home_defence)
                up = model.learning_rate * (goals - min(max(expected, model.min_lambda), model.max_lambda))
                up_away = model.learning_rate * (against - min(max(expected_away, model.min_lambda), model.max_lambda))
                ratings[home] = (home_attack + up, home_defence - up_away)
                ratings[away] = (away_attack + up_away, away_defence - up)
                after_home.append(ratings[home])
                after_away.append(ratings[away])
            columns_home.append(after_home)
            columns_away.append(after_away)
        # Per row, the pairs of all models one after another.
        return [[sum(pairs, ()) for pairs in zip(*columns, strict=True)] for columns in (columns_home, columns_away)]

    return Fold((_H, _A), "array<double>", play)


def goal_rating_history(
    matches: DataFrame, models: Sequence[m.GoalRatingModel], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Both clubs' attack and defence after every result: ``ratings`` holds the pairs of all models one after another.

    Columns: competition, ``club_id``, ``result_observed_at``, ``_seq`` (rating order) and ``ratings``.
    """
    rows = results_in_order(matches, "home_goals", "away_goals")
    history = segmented_fold(
        rows, goal_fold(models), [_C], RESULT_ORDER, entry="club_id", keep=["result_observed_at"], segment_rows=segment_rows
    )
    return history.withColumnRenamed("value", "ratings")


def goal_rating_forecasts(
    matches: DataFrame, targets: DataFrame, models: Sequence[m.GoalRatingModel], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """One forecast per target and model from the ratings known at the cutoff; an unseen club counts as average."""
    columns = targets.columns
    rows = with_club_values(goal_rating_history(matches, models, segment_rows), targets, "ratings")
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("_i"),
                F.lit(x.key).alias("model_key"),
                F.lit(m.config_id(x)).alias("config_id"),
                F.lit(float(x.base_home_goals)).alias("_base_home"),
                F.lit(float(x.base_away_goals)).alias("_base_away"),
                F.lit(float(x.min_lambda)).alias("_low"),
                F.lit(float(x.max_lambda)).alias("_high"),
                F.lit(int(x.max_goals)).alias("_max"),
            )
            for i, x in enumerate(models)
        ]
    )
    rows = rows.select("*", F.inline(grid))

    def rating(side: str, place: int):
        return F.coalesce(F.get(f"_{side}_ratings", F.col("_i") * 2 + place), F.lit(0.0))

    rows = rows.withColumns(
        {
            "expected_home_goals": rates.clamp_rate(
                F.col("_base_home") * F.exp(rating("home", 0) - rating("away", 1)), F.col("_low"), F.col("_high")
            ),
            "expected_away_goals": rates.clamp_rate(
                F.col("_base_away") * F.exp(rating("away", 0) - rating("home", 1)), F.col("_low"), F.col("_high")
            ),
        }
    )
    largest = max(x.max_goals for x in models)
    rows = rates.with_goal_outcomes(
        rows,
        "expected_home_goals",
        "expected_away_goals",
        rho=F.lit(0.0),
        max_goals=largest,
        limit=None if all(x.max_goals == largest for x in models) else F.col("_max"),
        home_goals=F.col("home_goals"),
        away_goals=F.col("away_goals"),
    )
    return rows.select(*columns, *m.FORECAST_COLUMNS)
