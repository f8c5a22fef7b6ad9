"""Scoring forecasts: metric vectors, aggregates, calibration and the paired bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import scores
from pitchlake.operators.ordering import with_ordinal
from pitchlake.session import ensure_checkpoint_dir

CLASSES = ("home", "draw", "away")
LOWER_QUANTILE, UPPER_QUANTILE = 0.025, 0.975


def score_forecasts(
    df: DataFrame,
    probabilities: Sequence[str] = ("p_home", "p_draw", "p_away"),
    outcome: str = "outcome_index",
    actual_probability: Column | None = None,
    prefix: str = "",
) -> DataFrame:
    """Add ``log_loss``, ``brier_score``, ``rps`` (and ``score_log_loss``), null where there is no forecast."""
    home, draw, away = (F.col(p) for p in probabilities)
    present = home.isNotNull()
    y = F.col(outcome)
    added = {
        f"{prefix}log_loss": F.when(present, scores.log_loss(home, draw, away, y)),
        f"{prefix}brier_score": F.when(present, scores.brier(home, draw, away, y)),
        f"{prefix}rps": F.when(present, scores.ranked_probability(home, draw, y)),
    }
    if actual_probability is not None:
        added[f"{prefix}score_log_loss"] = actual_probability
    return df.withColumns(added)


def _class_rows(df: DataFrame, by: Sequence[str], probabilities: Sequence[str], outcome: str, bins: int, extra=()):
    """Three rows per forecast: one-vs-rest probability, hit and bin of each class."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("class_index"),
                F.col(p).alias("probability"),
                F.when(F.col(outcome) == i, 1.0).otherwise(0.0).alias("hit"),
            )
            for i, p in enumerate(probabilities)
        ]
    )
    rows = df.select(*by, *extra, F.inline(pairs)).filter(F.col("probability").isNotNull())
    return rows.withColumn("bin", scores.calibration_bin(F.col("probability"), bins))


def calibration_table(
    df: DataFrame,
    by: Sequence[str],
    probabilities: Sequence[str] = ("p_home", "p_draw", "p_away"),
    outcome: str = "outcome_index",
    bins: int = 10,
) -> DataFrame:
    """Per group, class and non-empty bin: bounds, count, mean prediction, empirical frequency, gap."""
    grouped = (
        _class_rows(df, by, probabilities, outcome, bins)
        .groupBy(*by, "class_index", "bin")
        .agg(
            F.count(F.lit(1)).alias("forecasts"),
            F.avg("probability").alias("mean_prediction"),
            F.avg("hit").alias("empirical_frequency"),
        )
    )
    return grouped.withColumns(
        {
            "lower": F.col("bin") / F.lit(float(bins)),
            "upper": (F.col("bin") + 1) / F.lit(float(bins)),
            "absolute_gap": F.abs(F.col("mean_prediction") - F.col("empirical_frequency")),
        }
    )


def expected_calibration_error(calibration: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count-weighted mean gap per group and class of a calibration table."""
    return calibration.groupBy(*by, "class_index").agg(
        (F.sum(F.col("forecasts") * F.col("absolute_gap")) / F.sum("forecasts")).alias("ece")
    )


def aggregate_metrics(
    df: DataFrame,
    by: Sequence[str],
    *,
    probabilities: Sequence[str] = ("p_home", "p_draw", "p_away"),
    outcome: str = "outcome_index",
    prefix: str = "",
    score_loss: bool = True,
    bins: int = 10,
) -> DataFrame:
    """Count, mean scores and class-wise calibration error per group, in one pass over the forecasts.

    Forecasts are summed per (group, class, bin) map-side; the second, small aggregate turns the bin sums
    into means and calibration errors.  A group without forecasts has no row.
    """
    measures = [f"{prefix}log_loss", f"{prefix}brier_score", f"{prefix}rps"]
    if score_loss:
        measures.append(f"{prefix}score_log_loss")
    first = F.col("class_index") == 0
    partial = (
        _class_rows(df, by, probabilities, outcome, bins, measures)
        .groupBy(*by, "class_index", "bin")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("probability").alias("_p"),
            F.sum("hit").alias("_hit"),
            *[F.sum(F.when(first, F.col(m))).alias(f"_s_{m}") for m in measures],
            *[F.count(F.when(first, F.col(m))).alias(f"_n_{m}") for m in measures],
        )
    )
    gap = F.col("_n") * F.abs(F.col("_p") / F.col("_n") - F.col("_hit") / F.col("_n"))
    return partial.groupBy(*by).agg(
        F.sum(F.when(first, F.col("_n"))).alias("matches"),
        *[(F.sum(f"_s_{m}") / F.nullif(F.sum(f"_n_{m}"), F.lit(0))).alias(m.removeprefix(prefix)) for m in measures],
        *[
            (
                F.sum(F.when(F.col("class_index") == i, gap)) / F.sum(F.when(F.col("class_index") == i, F.col("_n")))
            ).alias(f"ece_{name}")
            for i, name in enumerate(CLASSES)
        ],
    )


def paired_delta(df: DataFrame, by: Sequence[str], model: str = "rps", benchmark: str = "market_rps") -> DataFrame:
    """Pairs and mean of model minus benchmark over rows that have both."""
    delta = F.col(model) - F.col(benchmark)
    return df.groupBy(*by).agg(F.count(delta).alias("pairs"), F.avg(delta).alias("mean_delta")).filter("pairs > 0")


# The counter-based generator (fixed values): 31-bit lanes, so that products stay within a long in any engine.
_MASK, _FACTOR, _LANES = 0x7FFFFFFF, 0x45D9F3B, (0x1234567, 0x7654321)
BLOCK = 1 << 16
# Draws made at once, which stay in a core's cache; replicates counted at once; sums held before they are handed on.
_DRAWS = 1 << 14
_REPLICATES = 8
_SUMS = 1 << 20


def _mixed(state, value):
    """The next state of a lane after a value; numbers or arrays of them."""
    state = (state * 31 + value) & _MASK
    state = ((state ^ (state >> 16)) * _FACTOR) & _MASK
    state = ((state ^ (state >> 16)) * _FACTOR) & _MASK
    return state ^ (state >> 16)


def _streams(seed: int, group: int, replicates: np.ndarray, stream: int) -> list[np.ndarray]:
    """The state of each lane, for every replicate of a group, before its counters."""
    return [_mixed(_mixed(_mixed(_mixed(lane, seed), group), np.asarray(replicates, np.int64)), stream) for lane in _LANES]


def _drawn(states: Sequence[np.ndarray], counters: np.ndarray, bound: int) -> np.ndarray:
    """Numbers below ``bound``, one per counter: those of a stream, or of a stream for each counter.

    The last ``_mixed`` and the remainder, in 32-bit words: only the low 31 bits of a product count, so it may overflow.
    """
    low, lanes = counters.astype(np.uint32), []
    for state in states:
        x = low + (np.asarray(state, np.int64) * 31 & _MASK).astype(np.uint32)
        x &= np.uint32(_MASK)
        for _ in range(2):
            x ^= x >> np.uint32(16)
            x *= np.uint32(_FACTOR)
            x &= np.uint32(_MASK)
        x ^= x >> np.uint32(16)
        lanes.append(x)
    number = lanes[0].astype(np.uint64)
    number <<= np.uint64(31)
    number += lanes[1]
    whole = number // np.uint64(bound)  # a quotient by one number is quicker than a remainder
    whole *= np.uint64(bound)
    number -= whole
    return number.view(np.int64)


def paired_bootstrap(
    df: DataFrame,
    by: Sequence[str],
    row_id: str = "match_id",
    model: str = "rps",
    benchmark: str = "market_rps",
    *,
    seed: int = 0,
    samples: int = 1000,
    block_rows: int = BLOCK,
) -> DataFrame:
    """Mean paired delta per group with its 95 % bootstrap interval (index ``int((samples-1)*q)``).

    Ordinary n-out-of-n resampling with replayable draws.  Pairs stand in the order of ``row_id``, then of their deltas, and are cut into blocks of
    ``block_rows``.  A draw is a number of a counter-based generator keyed by (seed, group, replicate): the first stream says to
    how many draws each block comes, with a chance by its size; a block's own stream says which of its rows they are.  A
    replicate's draws are counted whole before anything is shuffled, so one count per replicate and block crosses the network, and no task
    holds more than a block of rows or the counts of a few replicates.  Results depend on seed, samples and ``block_rows`` only, not on partitions or retries.
    """
    if samples < 100:
        raise ValueError("bootstrap needs at least 100 samples")
    if seed < 0:
        raise ValueError(f"seed is {seed}, below 0")
    by = list(by)
    delta = F.col(model) - F.col(benchmark)
    # The group's number in the generator: seven hex digits of a digest of its values.
    values = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("")
    number = F.conv(F.substring(F.md5(values.cast("binary")), 1, 7), 16, 10).cast("long")
    # Through a generator, because a filter on the delta itself would be pushed below the model and make the
    # scan compute every forecast twice.
    pairs = df.select(*by, F.to_json(F.struct(F.lit(0), *by)).alias("_g"), number.alias("_number"), F.col(row_id).alias("_row"), F.explode(F.array(delta.cast("double"))).alias("_delta"))
    numbered = with_ordinal(pairs.filter(F.col("_delta").isNotNull()), ["_row", "_delta"], ["_g"])
    ensure_checkpoint_dir(df.sparkSession)
    numbered = numbered.checkpoint()
    sizes = numbered.groupBy(*by, "_g", "_number").agg(F.count(F.lit(1)).alias("pairs"), F.avg("_delta").alias("mean_delta"))

    # The rows below are few and small and stand for much work, so they are dealt by number, not by size.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    first = F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(_REPLICATES))).alias("_first")
    replicates = sizes.select("_g", "_number", "pairs", first).repartition(tasks, "_g", "_first")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, number, n, first in zip(*(batch.column(k).to_pylist() for k in ("_g", "_number", "pairs", "_first")), strict=True):
                own = np.arange(first, min(first + _REPLICATES, samples))
                times = np.full((-(-n // block_rows), len(own)), n, np.int64)
                if n > block_rows:
                    for k, replicate in enumerate(own):
                        states, total = _streams(seed, number, replicate, 0), np.zeros(len(times), np.int64)
                        step = max(_DRAWS, len(times))
                        for at in range(0, n, step):
                            drawn = _drawn(states, np.arange(at, min(n, at + step), dtype=np.int64), n) // block_rows
                            total += np.bincount(drawn, minlength=len(times))
                        times[:, k] = total
                rows = len(times)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(own)), pa.array(times.ravel()))
                columns = [pa.array([group] * rows), pa.array([number] * rows, pa.int64()), pa.array(np.arange(rows, dtype=np.int64)), pa.array([first] * rows, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["_g", "_number", "_block", "_first", "_m"])

    draws = replicates.mapInArrow(counted, "_g string, _number long, _block long, _first int, _m array<long>")
    # A list has as many counts as there are samples.
    listed = draws.groupBy("_g", "_number", "_block").agg(F.collect_list(F.struct("_first", "_m")).alias("_times"))
    block = F.expr(f"ordinal div {block_rows}").alias("_block")
    blocks = numbered.select("_g", block, "ordinal", "_delta").groupBy("_g", "_block")
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("ordinal", "_delta"))).alias("_rows")).select("_g", "_block", F.col("_rows._delta").alias("_deltas"))

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for group, total in sums.items():
                columns = [pa.array([group] * samples), pa.array(np.arange(samples, dtype=np.int32)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, ["_g", "_r", "_total"])
            sums.clear()

        for batch in batches:
            for group, number, block, deltas, times in zip(*(batch.column(k) for k in ("_g", "_number", "_block", "_deltas", "_times")), strict=True):
                own = deltas.values.to_numpy(zero_copy_only=False)
                m = np.zeros(samples, np.int64)
                for t in times.as_py():
                    m[t["_first"] : t["_first"] + len(t["_m"])] = t["_m"]
                states = _streams(seed, number.as_py(), np.arange(samples), block.as_py() + 1)
                total = sums.setdefault(group.as_py(), np.zeros(samples))
                ends = np.cumsum(m)
                at = 0
                while at < samples:
                    # Whole replicates, as many as are drawn at once; one at least.
                    done = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, done + _DRAWS, "right")))
                    counts = m[at:to]
                    before = ends[at:to] - counts - done
                    counters = np.arange(int(counts.sum())) - np.repeat(before, counts)
                    found = own[_drawn([np.repeat(s[at:to], counts) for s in states], counters, len(own))]
                    for k, (a, n) in enumerate(zip(before.tolist(), counts.tolist(), strict=True), at):
                        total[k] += found[a : a + n].sum()
                    at = to
                if len(sums) * samples >= _SUMS:
                    yield from held()
        yield from held()

    totals = blocks.join(listed, ["_g", "_block"]).repartition(tasks, "_g", "_block").mapInArrow(resampled, "_g string, _r int, _total double")
    totals = totals.groupBy("_g", "_r").agg(F.sum("_total").alias("_total"))
    lower, upper = int((samples - 1) * LOWER_QUANTILE), int((samples - 1) * UPPER_QUANTILE)
    # The collected array has exactly `samples` entries.
    means = totals.groupBy("_g").agg(F.sort_array(F.collect_list("_total")).alias("_sorted"))
    return sizes.join(means, "_g").select(
        *by,
        "pairs",
        "mean_delta",
        (F.element_at("_sorted", lower + 1) / F.col("pairs")).alias("lower_95"),
        (F.element_at("_sorted", upper + 1) / F.col("pairs")).alias("upper_95"),
    )


def market_coverage(df: DataFrame, by: Sequence[str], market: str = "market_rps") -> DataFrame:
    """Observations and how many of them have an aligned market price."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), F.count(F.col(market)).alias("market_coverage")
    )
