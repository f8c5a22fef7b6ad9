"""Rating and goal-model arithmetic as Column expressions.

Poisson and Dixon-Coles outcome probabilities are sums over the marginal terms rather than the (n+1)² grid:
without low-score correction the grid is a product, and the correction touches four cells.  ``score_grid``
builds the explicit grid where the cells themselves are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import factorial
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_FLOOR = 1e-15
GRID_ROWS = 2048  # forecasts whose grids are held at once
NO_MASS = "score distribution has no probability mass"


def col(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda variable; an alias would be inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- Elo ---------------------------------------------------------------------------------------------


def elo_gap(home_rating: Column, away_rating: Column, home_advantage: Column | float = 65.0) -> Column:
    return (home_rating + col(home_advantage)) - away_rating


def elo_expected_home(home_rating: Column, away_rating: Column, home_advantage: Column | float = 65.0) -> Column:
    gap = elo_gap(home_rating, away_rating, home_advantage)
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -gap / 400.0))


def elo_actual_home(home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, 1.0).when(home_goals == away_goals, 0.5).otherwise(0.0)


def elo_outcomes(
    home_rating: Column,
    away_rating: Column,
    *,
    home_advantage: Column | float = 65.0,
    base_draw: Column | float = 0.27,
    draw_decay: Column | float = 600.0,
) -> tuple[Column, Column, Column]:
    """Home, draw and away probability; the draw share shrinks with the rating gap."""
    gap = F.abs(elo_gap(home_rating, away_rating, home_advantage))
    draw = F.least(F.greatest(col(base_draw) * F.exp(-gap / col(draw_decay)), F.lit(0.05)), F.lit(0.35))
    expected = elo_expected_home(home_rating, away_rating, home_advantage)
    return (1.0 - draw) * expected, draw, (1.0 - draw) * (1.0 - expected)


# --- Goals -------------------------------------------------------------------------------------------


def smoothed_ratio(goals: Column, matches: Column, league_mean: Column, smoothing: Column | float = 3.0) -> Column:
    """Goals per match shrunk towards the league mean, relative to it."""
    k = col(smoothing)
    return ((goals + k * league_mean) / (matches + k)) / league_mean


def clamp_rate(rate: Column, low: Column | float = 0.05, high: Column | float = 5.0) -> Column:
    return F.least(F.greatest(rate, col(low)), col(high))


def poisson_pmf(goals: int, rate: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, F.lit(float(goals))) / float(factorial(goals))


def poisson_terms(rate: Column, max_goals: int = 8) -> Column:
    """The pmf at 0..max_goals as one array column."""
    return F.array(*[poisson_pmf(k, rate) for k in range(max_goals + 1)])


def low_score_factors(home_rate: Column, away_rate: Column, rho: Column | float) -> dict[tuple[int, int], Column]:
    """Dixon-Coles correction of the four low scores; every other score keeps its probability."""
    r = col(rho)
    return {
        (0, 0): 1.0 - home_rate * away_rate * r,
        (0, 1): 1.0 + home_rate * r,
        (1, 0): 1.0 + away_rate * r,
        (1, 1): 1.0 - r,
    }


def low_score_factor(
    home_goals: Column, away_goals: Column, home_rate: Column, away_rate: Column, rho: Column | float
) -> Column:
    """The correction of one score."""
    factor = F.lit(1.0)
    for (x, y), value in low_score_factors(home_rate, away_rate, rho).items():
        factor = F.when((home_goals == x) & (away_goals == y), value).otherwise(factor)
    return factor


def with_goal_outcomes(
    df: DataFrame,
    home_rate: str,
    away_rate: str,
    *,
    rho: Column | float = 0.0,
    max_goals: int = 8,
    limit: Column | None = None,
    home_goals: Column | None = None,
    away_goals: Column | None = None,
) -> DataFrame:
    """Add ``p_home, p_draw, p_away, p_actual_score``: outcomes and the probability of the given score.

    Written over the marginal terms ``rate**k / k!`` (the exponentials cancel in the normalisation) and
    their running sums, as straight-line arithmetic in three projections that compile to one stage.  A score
    outside the grid has probability 0; ``limit`` lowers ``max_goals`` per row.  The 1e-15 floor of
    corrected cells is applied to the four cells the correction can push down and to the scored one; on the
    others it would add at most 81e-15.

    The result passes through a generator, so that a filter on a probability is applied to the computed
    value instead of being pushed below and computing it again.
    """
    columns = df.columns
    lam, mu = F.col(home_rate), F.col(away_rate)
    goals = range(max_goals + 1)

    def term(rate: Column, k: int) -> Column:
        value = F.pow(rate, F.lit(float(k))) / float(factorial(k)) if k > 1 else rate if k else F.lit(1.0)
        return value if limit is None or k == 0 else F.when(limit >= k, value).otherwise(0.0)

    rows = df.withColumns(
        {f"_h{k}": term(lam, k) for k in goals} | {f"_a{k}": term(mu, k) for k in goals}
    )
    h, a = [F.col(f"_h{k}") for k in goals], [F.col(f"_a{k}") for k in goals]

    def total(parts: list[Column]) -> Column:
        return reduce(add, parts)

    def at(terms: list[Column], index: Column | None) -> Column:
        picked = F.lit(0.0)
        for k in goals:
            picked = F.when(index == k, terms[k]).otherwise(picked)
        return picked

    x = F.lit(0) if home_goals is None else home_goals
    y = F.lit(0) if away_goals is None else away_goals
    rows = rows.withColumns(
        {
            "_mass": total(h) * total(a),
            "_home": total([h[k] * total(a[:k]) for k in goals[1:]]),
            "_draw": total([h[k] * a[k] for k in goals]),
            "_away": total([a[k] * total(h[:k]) for k in goals[1:]]),
            "_cell": at(h, x) * at(a, y) * low_score_factor(x, y, lam, mu, rho),
            "_inside": (x <= (max_goals if limit is None else limit)) & (y <= (max_goals if limit is None else limit)),
        }
    )
    mass = F.col("_mass")
    factors = low_score_factors(lam, mu, rho)

    def shift(i: int, j: int, cell: Column) -> Column:
        return F.greatest(cell * factors[i, j], F.lit(CELL_FLOOR)) - cell

    rows = rows.withColumns(
        {
            "_home": F.col("_home") / mass + shift(1, 0, lam / mass),
            "_draw": F.col("_draw") / mass + shift(0, 0, 1.0 / mass) + shift(1, 1, lam * mu / mass),
            "_away": F.col("_away") / mass + shift(0, 1, mu / mass),
        }
    ).withColumn("_total", F.col("_home") + F.col("_draw") + F.col("_away"))
    outcome = F.struct(
        *[(F.col(f"_{name}") / F.col("_total")).alias(f"p_{name}") for name in ("home", "draw", "away")],
        F.when(F.col("_inside"), F.greatest(F.col("_cell") / mass, F.lit(CELL_FLOOR)) / F.col("_total"))
        .otherwise(0.0)
        .alias("p_actual_score"),
    )
    return rows.select(*columns, F.inline(F.array(outcome)))


def score_grid(
    home_rate: Column, away_rate: Column, *, rho: Column | float | None = None, max_goals: int = 8
) -> Column:
    """The full normalised grid, ``ARRAY<STRUCT<h INT, a INT, p DOUBLE>>`` in row-major order."""
    cells = [(x, y) for x in range(max_goals + 1) for y in range(max_goals + 1)]
    scores = F.array(*[F.struct(F.lit(x).alias("h"), F.lit(y).alias("a")) for x, y in cells])
    terms = F.struct(
        poisson_terms(home_rate, max_goals).alias("h"),
        poisson_terms(away_rate, max_goals).alias("a"),
    )

    def cell(s: Column, p: Column) -> Column:
        return F.struct(s["h"].alias("h"), s["a"].alias("a"), p.alias("p"))

    def corrected(s: Column) -> Column:
        factor = low_score_factor(s["h"], s["a"], home_rate, away_rate, rho)
        return cell(s, F.greatest(s["p"] * factor, F.lit(CELL_FLOOR)))

    grid = normalize_grid(
        bind(terms, lambda t: F.transform(scores, lambda s: cell(s, F.get(t["h"], s["h"]) * F.get(t["a"], s["a"]))))
    )
    return grid if rho is None else normalize_grid(F.transform(grid, corrected))


def grid_mass(grid: Column, keep=None) -> Column:
    cells = grid if keep is None else F.filter(grid, keep)
    return F.aggregate(cells, F.lit(0.0), lambda total, s: total + s["p"])


def normalize_grid(grid: Column) -> Column:
    """Divide by the grid's mass; a grid without mass is an error."""

    def divided(g: Column) -> Column:
        mass = grid_mass(g)
        checked = F.when(mass > 0, mass).otherwise(
            F.raise_error(F.lit(NO_MASS)).cast("double")
        )
        return bind(
            checked,
            lambda total: F.transform(
                g, lambda s: F.struct(s["h"].alias("h"), s["a"].alias("a"), (s["p"] / total).alias("p"))
            ),
        )

    return bind(grid, divided)


def grids(home_rate: np.ndarray, away_rate: np.ndarray, rho: float | None = None, max_goals: int = 8) -> np.ndarray:
    """``score_grid`` of many forecasts as one array (forecast, home goals, away goals)."""
    k = np.arange(max_goals + 1)
    scale = np.array([float(factorial(x)) for x in k])
    h, a = (np.exp(-rate)[:, None] * rate[:, None] ** k / scale for rate in (home_rate, away_rate))
    grid = h[:, :, None] * a[:, None, :]

    def normalized() -> None:
        mass = grid.sum(axis=(1, 2), keepdims=True)
        if (mass <= 0).any():
            raise ValueError(NO_MASS)
        np.divide(grid, mass, out=grid)

    normalized()
    if rho is not None:
        for x, y, factor in (0, 0, 1.0 - home_rate * away_rate * rho), (0, 1, 1.0 + home_rate * rho), (1, 0, 1.0 + away_rate * rho), (1, 1, 1.0 - rho):
            if max(x, y) <= max_goals:
                grid[:, x, y] *= factor
        np.maximum(grid, CELL_FLOOR, out=grid)
        normalized()
    return grid


def mean_score_grid(
    df: DataFrame, key: str, home_rate: str, away_rate: str, *, rho: float | None = None, max_goals: int = 8
) -> DataFrame:
    """``key, home_goals, away_goals, forecasts, mean_probability``: the mean of ``score_grid`` over the forecasts of a key.

    A task adds up the grids of a batch per key as arrays, so cells do not become rows; null keys are one key, a null rate is an error.
    """
    width = max_goals + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, GRID_ROWS):
                part = batch.slice(first, GRID_ROWS)
                if part.column(1).null_count or part.column(2).null_count:
                    raise ValueError(NO_MASS)
                keys = part.column(0).dictionary_encode(null_encoding="encode")
                code = keys.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                home, away = (part.column(c).to_numpy()[order] for c in (1, 2))
                own, starts, counts = np.unique(code[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(grids(home, away, rho, max_goals).reshape(len(code), -1), starts)
                ends = pa.array(np.arange(len(own) + 1) * width**2, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(own)), pa.array(counts, pa.int64()), lists], ["key", "n", "sums"])

    rows = df.select(F.col(key).alias("key"), F.col(home_rate).cast("double").alias("home"), F.col(away_rate).cast("double").alias("away"))
    parts = rows.mapInArrow(summed, f"key {df.schema[key].dataType.simpleString()}, n long, sums array<double>")
    cells = parts.select("key", "n", F.posexplode("sums").alias("cell", "p")).groupBy("key", "cell").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    goals = F.floor(F.col("cell") / width).cast("int"), (F.col("cell") % width).cast("int")
    return cells.select(
        F.col("key").alias(key), goals[0].alias("home_goals"), goals[1].alias("away_goals"), F.col("n").alias("forecasts"),
        (F.col("p") / F.col("n")).alias("mean_probability"),
    )


def outcomes_from_grid(grid: Column) -> Column:
    """STRUCT of ``p_home, p_draw, p_away`` summed over an explicit grid and renormalised."""

    def summed(g: Column) -> Column:
        home = grid_mass(g, lambda s: s["h"] > s["a"])
        draw = grid_mass(g, lambda s: s["h"] == s["a"])
        away = grid_mass(g, lambda s: s["h"] < s["a"])
        parts = F.struct(home.alias("h"), draw.alias("d"), away.alias("a"))
        return bind(parts, shares)

    def shares(t: Column) -> Column:
        total = t["h"] + t["d"] + t["a"]
        return F.struct(
            (t["h"] / total).alias("p_home"), (t["d"] / total).alias("p_draw"), (t["a"] / total).alias("p_away")
        )

    return bind(grid, summed)


def grid_cell(grid: Column, home_goals: Column, away_goals: Column) -> Column:
    """Probability of one score in an explicit grid; null when absent."""
    return F.get(F.filter(grid, lambda s: (s["h"] == home_goals) & (s["a"] == away_goals)), F.lit(0))["p"]
