"""Baseline models: parameters, and the forecasts they make from as-of state.

A model family answers ``forecast(matches, targets)``: add ``model_key, config_id, p_home, p_draw, p_away``
(and expected goals and the actual score's probability where it has them) to every target row, using only
results observed at or before the row's ``prediction_cutoff``.  ``BaselineModel`` is the extension point.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import rates
from pitchlake.functions.hashing import stable_hash
from pitchlake.operators.temporal import prefix_state

COMPETITION = "competition_key"
CUTOFF = "prediction_cutoff"

FORECAST_COLUMNS = (
    "model_key",
    "config_id",
    "expected_home_goals",
    "expected_away_goals",
    "p_home",
    "p_draw",
    "p_away",
    "p_actual_score",
)


STATE_COLUMNS = (
    "league_home_goals",
    "league_away_goals",
    "home_matches",
    "home_goals_for",
    "home_goals_against",
    "away_matches",
    "away_goals_for",
    "away_goals_against",
)


class BaselineModel(Protocol):
    """A model with a key, exported parameters and a distributed forecast."""

    key: str

    def config(self) -> dict: ...

    def forecast(self, matches: DataFrame, targets: DataFrame) -> DataFrame: ...


def require_at_least(settings: object, limits: dict[str, float]) -> None:
    """Fail on the first setting below its limit, naming both."""
    for name, limit in limits.items():
        value = getattr(settings, name)
        if value < limit:
            raise ValueError(f"{name} is {value}, below {limit}")


@dataclass(frozen=True)
class PoissonModel:
    """Independent Poisson goals with venue strengths shrunk to the league mean."""

    smoothing_matches: float = 3.0
    max_goals: int = 8
    min_lambda: float = 0.05
    max_lambda: float = 5.0
    key = "poisson"

    def __post_init__(self) -> None:
        if self.smoothing_matches <= 0:
            raise ValueError(f"smoothing_matches is {self.smoothing_matches}, not above 0")
        if self.max_goals < 3:
            raise ValueError(f"max_goals is {self.max_goals}, below 3")

    def config(self) -> dict:
        return asdict(self)

    def forecast(self, matches: DataFrame, targets: DataFrame) -> DataFrame:
        return goal_forecasts(with_goal_state(matches, targets), [self])


@dataclass(frozen=True)
class DixonColesModel:
    """The Poisson model with the low-score correction."""

    rho: float = -0.08
    smoothing_matches: float = 3.0
    max_goals: int = 8
    min_lambda: float = 0.05
    max_lambda: float = 5.0
    key = "dixon_coles"

    def __post_init__(self) -> None:
        PoissonModel(self.smoothing_matches, self.max_goals, self.min_lambda, self.max_lambda)
        if not -0.5 < self.rho < 0.5:
            raise ValueError("rho must lie strictly between -0.5 and 0.5")

    def config(self) -> dict:
        return asdict(self)

    def forecast(self, matches: DataFrame, targets: DataFrame) -> DataFrame:
        return goal_forecasts(with_goal_state(matches, targets), [self])


@dataclass(frozen=True)
class EloModel:
    """Club ratings updated after every result; see ``plans.elo`` for the distributed fold."""

    initial_rating: float = 1500.0
    k_factor: float = 20.0
    home_advantage: float = 65.0
    base_draw_probability: float = 0.27
    draw_decay: float = 600.0
    key = "elo"

    def config(self) -> dict:
        return asdict(self)

    def forecast(self, matches: DataFrame, targets: DataFrame) -> DataFrame:
        from pitchlake.plans.elo import elo_forecasts

        return elo_forecasts(matches, targets, [self])


@dataclass(frozen=True)
class GoalRatingModel:
    """Attack and defence of every club updated after each result; see ``plans.goal_ratings``."""

    base_home_goals: float = 1.5
    base_away_goals: float = 1.2
    learning_rate: float = 0.03
    max_goals: int = 8
    min_lambda: float = 0.05
    max_lambda: float = 5.0
    key = "goal_ratings"

    def __post_init__(self) -> None:
        require_at_least(self, {"learning_rate": 0.0, "max_goals": 3, "min_lambda": 0.0})
        for name in ("base_home_goals", "base_away_goals"):
            if not self.min_lambda <= getattr(self, name) <= self.max_lambda:
                raise ValueError(f"{name} is {getattr(self, name)}, not between {self.min_lambda} and {self.max_lambda}")

    def config(self) -> dict:
        return asdict(self)

    def forecast(self, matches: DataFrame, targets: DataFrame) -> DataFrame:
        from pitchlake.plans.goal_ratings import goal_rating_forecasts

        return goal_rating_forecasts(matches, targets, [self])


@dataclass(frozen=True)
class FixedModel:
    """The same three probabilities for every fixture: the floor any model must beat."""

    p_home: float
    p_draw: float
    p_away: float
    key = "fixed"

    def config(self) -> dict:
        return asdict(self)

    def forecast(self, matches: DataFrame, targets: DataFrame) -> DataFrame:
        return targets.select(
            *targets.columns,
            F.lit(self.key).alias("model_key"),
            F.lit(config_id(self)).alias("config_id"),
            F.lit(None).cast("double").alias("expected_home_goals"),
            F.lit(None).cast("double").alias("expected_away_goals"),
            F.lit(self.p_home).alias("p_home"),
            F.lit(self.p_draw).alias("p_draw"),
            F.lit(self.p_away).alias("p_away"),
            F.lit(None).cast("double").alias("p_actual_score"),
        )


def config_id(model: BaselineModel) -> str:
    """Short stable id of a model's parameters."""
    return stable_hash({"model_key": model.key, "model_config": model.config()})[:12]


# --- Goal models -------------------------------------------------------------------------------------


def _role_key(role: str, key: str) -> Column:
    """Key of one kind of running state: the league, a club at home, or a club away."""
    return F.concat(F.lit(f"{role}:"), F.col(key).cast("string"))


_ROLES = {"league": COMPETITION, "home": "home_club_id", "away": "away_club_id"}


def with_goal_state(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with the league and venue sums known at their cutoff.

    Adds ``train_match_count, data_cutoff, league_home_goals, league_away_goals`` and, for the home club at
    home and the away club away, matches, goals for and goals against (zero for an unseen club).  The three
    kinds of state are keyed alike and built in one pass; the three lookups read the same shuffle.
    """

    def fact(role: str, scored: str, conceded: str) -> Column:
        return F.struct(
            _role_key(role, _ROLES[role]).alias("_role"),
            F.col(scored).cast("bigint").alias("_for"),
            F.col(conceded).cast("bigint").alias("_against"),
        )

    facts = matches.select(
        COMPETITION,
        F.col("result_observed_at").alias(CUTOFF),
        F.inline(
            F.array(
                fact("league", "home_goals", "away_goals"),
                fact("home", "home_goals", "away_goals"),
                fact("away", "away_goals", "home_goals"),
            )
        ),
    )
    probes = targets.select(
        COMPETITION, CUTOFF, F.explode(F.array(*[_role_key(r, k) for r, k in _ROLES.items()])).alias("_role")
    )
    state = prefix_state(
        facts,
        probes,
        [COMPETITION, "_role"],
        CUTOFF,
        {
            "_n": ("sum", F.lit(1).cast("bigint")),
            "_for": ("sum", F.col("_for")),
            "_against": ("sum", F.col("_against")),
            "_last": ("max", F.col(CUTOFF)),
        },
    )
    names = {
        "league": ("train_match_count", "league_home_goals", "league_away_goals"),
        "home": ("home_matches", "home_goals_for", "home_goals_against"),
        "away": ("away_matches", "away_goals_for", "away_goals_against"),
    }
    joined = targets.withColumns({f"_{r}": _role_key(r, k) for r, k in _ROLES.items()})
    for role, (n, scored, conceded) in names.items():
        found = state.select(
            COMPETITION, F.col("_role").alias(f"_{role}"), CUTOFF, F.col("_n").alias(n),
            F.col("_for").alias(scored), F.col("_against").alias(conceded), F.col("_last").alias(f"_last_{role}"),
        )
        joined = joined.join(found, [COMPETITION, f"_{role}", CUTOFF])
    # A club's last result is never after its league's.  Reading all three keeps the lookups alike, so that
    # they share one shuffle.
    data_cutoff = F.greatest(*[F.col(f"_last_{role}") for role in _ROLES])
    return joined.withColumn("data_cutoff", data_cutoff).drop(
        *[f"_{role}" for role in _ROLES], *[f"_last_{role}" for role in _ROLES]
    )


def _goal_rates(state: DataFrame, smoothing: Column, low: Column, high: Column) -> DataFrame:
    home_mean = F.greatest(F.try_divide("league_home_goals", "train_match_count"), low)
    away_mean = F.greatest(F.try_divide("league_away_goals", "train_match_count"), low)
    means = state.withColumns({"_home_mean": home_mean, "_away_mean": away_mean})
    home_mean, away_mean = F.col("_home_mean"), F.col("_away_mean")
    attack_home = rates.smoothed_ratio(F.col("home_goals_for"), F.col("home_matches"), home_mean, smoothing)
    defence_home = rates.smoothed_ratio(F.col("home_goals_against"), F.col("home_matches"), away_mean, smoothing)
    attack_away = rates.smoothed_ratio(F.col("away_goals_for"), F.col("away_matches"), away_mean, smoothing)
    defence_away = rates.smoothed_ratio(F.col("away_goals_against"), F.col("away_matches"), home_mean, smoothing)
    return means.withColumns(
        {
            "expected_home_goals": rates.clamp_rate(home_mean * attack_home * defence_away, low, high),
            "expected_away_goals": rates.clamp_rate(away_mean * attack_away * defence_home, low, high),
        }
    )


def goal_forecasts(state: DataFrame, models: Sequence[PoissonModel | DixonColesModel]) -> DataFrame:
    """Forecasts of a grid of goal models over the same state: one row per target and model.

    Parameters travel as literal columns, so the grid costs no join.  A Poisson model is the corrected one
    with rho 0.
    """
    grid = F.array(
        *[
            F.struct(
                F.lit(x.key).alias("model_key"),
                F.lit(config_id(x)).alias("config_id"),
                F.lit(float(x.smoothing_matches)).alias("_k"),
                F.lit(float(x.min_lambda)).alias("_low"),
                F.lit(float(x.max_lambda)).alias("_high"),
                F.lit(float(getattr(x, "rho", 0.0))).alias("_rho"),
                F.lit(int(x.max_goals)).alias("_max"),
            )
            for x in models
        ]
    )
    rows = _goal_rates(state.select(*state.columns, F.inline(grid)), F.col("_k"), F.col("_low"), F.col("_high"))
    largest = max(x.max_goals for x in models)
    rows = rates.with_goal_outcomes(
        rows,
        "expected_home_goals",
        "expected_away_goals",
        rho=F.col("_rho"),
        max_goals=largest,
        limit=None if all(x.max_goals == largest for x in models) else F.col("_max"),
        home_goals=F.col("home_goals"),
        away_goals=F.col("away_goals"),
    )
    return rows.select(*[c for c in state.columns if c not in STATE_COLUMNS], *FORECAST_COLUMNS)
