"""Elo ratings over any history size, and forecasts from the rating known at each cutoff.

The recurrence is sequential within a competition and independent between competitions: a segmented fold (``operators.folds``).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import rates
from pitchlake.operators.folds import SEGMENT_ROWS, Fold, segmented_fold
from pitchlake.operators.temporal import prefix_state
from pitchlake.plans import models as m

_C, _H, _A = m.COMPETITION, "home_club_id", "away_club_id"
# The order in which results count: when they were observed, then kickoff, then the text of the id.
RESULT_ORDER = ("result_observed_at", "kickoff_at", "_id")


def results_in_order(matches: DataFrame, *columns) -> DataFrame:
    """What a rating reads of a match: competition, clubs, the order's columns and ``columns``."""
    return matches.select(
        _C, _H, _A, "result_observed_at", "kickoff_at", F.col("match_id").cast("string").alias("_id"), *columns
    )


def elo_fold(configs: Sequence[dict]) -> Fold:
    """Ratings of both clubs, an array entry per model, from ``_actual``, the home side's share of the result."""

    def play(rows: pd.DataFrame, start: dict) -> list[list]:
        homes, aways, actual = rows[_H].tolist(), rows[_A].tolist(), rows["_actual"].tolist()
        played_home, played_away = [], []
        for g, config in enumerate(configs):
            initial, k, advantage = config["initial_rating"], config["k_factor"], config["home_advantage"]
            ratings = {club: float(handed[g]) for club, handed in start.items()}
            after_home, after_away = [], []
            for home, away, result in zip(homes, aways, actual, strict=True):
                home_rating, away_rating = ratings.get(home, initial), ratings.get(away, initial)
                expected = 1.0 / (1.0 + 10.0 ** (-((home_rating + advantage) - away_rating) / 400.0))
                delta = k * (result - expected)
                ratings[home], ratings[away] = home_rating + delta, away_rating - delta
                after_home.append(ratings[home])
                after_away.append(ratings[away])
            played_home.append(after_home)
            played_away.append(after_away)
        return [list(zip(*played_home, strict=True)), list(zip(*played_away, strict=True))]

    return Fold((_H, _A), "array<double>", play)


def rating_history(
    matches: DataFrame, models: Sequence[m.EloModel], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Both clubs' ratings after every result, one array entry per model.

    Columns: competition, ``club_id``, ``result_observed_at``, ``_seq`` (rating order) and ``ratings``.
    """
    rows = results_in_order(matches, rates.elo_actual_home(F.col("home_goals"), F.col("away_goals")).alias("_actual"))
    fold = elo_fold([x.config() for x in models])
    history = segmented_fold(
        rows, fold, [_C], RESULT_ORDER, entry="club_id", keep=["result_observed_at"], segment_rows=segment_rows
    )
    return history.withColumnRenamed("value", "ratings")


def with_club_values(history: DataFrame, targets: DataFrame, value: str) -> DataFrame:
    """Targets with ``_home_<value>`` and ``_away_<value>``, each club's last value known at the cutoff (null for an unseen club)."""
    history = history.withColumnRenamed("result_observed_at", m.CUTOFF)
    probes = targets.select(_C, m.CUTOFF, F.explode(F.array(_H, _A)).alias("club_id"))
    last = F.struct(F.col(m.CUTOFF).alias("at"), F.col("_seq").alias("seq"), F.col(value).alias("value"))
    state = prefix_state(history, probes, [_C, "club_id"], m.CUTOFF, {"_last": ("max", last)})
    for side in ("home", "away"):
        found = state.select(
            _C, F.col("club_id").alias(f"{side}_club_id"), m.CUTOFF, F.col("_last.value").alias(f"_{side}_{value}")
        )
        targets = targets.join(found, [_C, f"{side}_club_id", m.CUTOFF])
    return targets


def elo_forecasts(
    matches: DataFrame, targets: DataFrame, models: Sequence[m.EloModel], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """One forecast per target and Elo model."""
    columns = targets.columns
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("_i"),
                F.lit(x.key).alias("model_key"),
                F.lit(m.config_id(x)).alias("config_id"),
                F.lit(float(x.initial_rating)).alias("_initial"),
                F.lit(float(x.home_advantage)).alias("_advantage"),
                F.lit(float(x.base_draw_probability)).alias("_base"),
                F.lit(float(x.draw_decay)).alias("_decay"),
            )
            for i, x in enumerate(models)
        ]
    )
    rows = with_club_values(rating_history(matches, models, segment_rows), targets, "ratings")
    rows = rows.select("*", F.inline(grid)).withColumns(
        {
            f"_{side}": F.coalesce(F.get(f"_{side}_ratings", F.col("_i")), F.col("_initial"))
            for side in ("home", "away")
        }
    )
    home, draw, away = rates.elo_outcomes(
        F.col("_home"),
        F.col("_away"),
        home_advantage=F.col("_advantage"),
        base_draw=F.col("_base"),
        draw_decay=F.col("_decay"),
    )
    unknown = F.lit(None).cast("double")
    return rows.select(
        *columns,
        "model_key",
        "config_id",
        unknown.alias("expected_home_goals"),
        unknown.alias("expected_away_goals"),
        home.alias("p_home"),
        draw.alias("p_draw"),
        away.alias("p_away"),
        unknown.alias("p_actual_score"),
    )
