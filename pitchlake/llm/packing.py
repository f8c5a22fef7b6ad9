"""Packing token pieces into sequences of a fixed length by the configuration linear program.

A configuration is a multiset of lengths that fits a sequence.  The program asks for the fewest configurations that
cover the length histogram.  A knapsack over the lengths' weights, by dynamic programming on capacity, prices the best
configurations.  Multiplicative weights place them: every length has a weight that falls as it is covered, and those close to
the best are added in steps of whole sequences, until every length is covered.  Where the lengths are few and each is frequent, the
fractional optimum is found first, by column generation with the same knapsack, and rounded down; only its rest is placed by
weights.  Best fit, longest first, also plans the whole histogram; the plan with fewer sequences is taken, the program's if they tie.

The driver sees the histogram (at most one number per length) and returns a plan of as bounded a size: which copies of
which configuration take which ranks of each length.  Pieces learn their rank among equals and look their place up.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchlake.llm.common import prefix_sums, stored
from pitchlake.llm.tokens import encoder

ROUNDS = 160
NEAR_BEST = 0.02
# Lengths up to which, and pieces of each from which, the program is solved to its optimum first.
FEW_LENGTHS, HOT = 400, 50


def best_values(value: np.ndarray, capacity: int) -> np.ndarray:
    """The largest total value of lengths that fill at most c, for every c; each may be taken any number of times."""
    best = np.zeros(capacity + 1)
    for n in np.flatnonzero(value > 0).tolist():
        copies = 1
        while copies * n <= capacity:  # 1, 2, 4, ... copies make up any number
            np.maximum(best[copies * n :], best[: -copies * n] + copies * value[n], out=best[copies * n :])
            copies *= 2
    return best


def filled(worth: np.ndarray, best: np.ndarray, lengths: np.ndarray, stock: np.ndarray, room: int) -> list[int]:
    """Places in ``lengths`` that fill the room as ``best_values`` would, none more often than it is in stock."""
    chosen, stock = [], stock.copy()
    while True:
        fitting = np.flatnonzero(stock[: np.searchsorted(lengths, room, "right")] > 0)
        if not len(fitting):
            return chosen
        k = int(fitting[(worth[fitting] + best[room - lengths[fitting]]).argmax()])
        chosen.append(k)
        stock[k] -= 1
        room -= int(lengths[k])


def few_lengths(histogram: np.ndarray) -> dict[tuple[int, ...], float]:
    """The fractional optimum: weights of configurations that hold each length as often as the histogram.

    Column generation: the prices of a basis find the configuration that would save most, until none saves any.
    """
    capacity = len(histogram) - 1
    lengths = np.flatnonzero(histogram)
    most = np.minimum(capacity // lengths, histogram[lengths])
    basis, inverse = np.diag(most).astype(float), np.diag(1.0 / most)
    need = histogram[lengths] * (1 + 1e-7 * np.random.default_rng(0).random(len(lengths)))  # no ties, so no cycles
    x = need / most
    for step in range(50 * len(lengths)):  # the basis covers the histogram after every step
        worth = np.maximum(inverse.sum(0), 0)
        value = np.zeros(capacity + 1)
        value[lengths] = worth
        chosen = filled(worth, best_values(value, capacity), lengths, np.where(worth > 1e-12, most, 0), capacity)
        if worth[chosen].sum() <= 1 + 1e-6:
            break
        column = np.bincount(chosen, minlength=len(lengths)).astype(float)
        change = inverse @ column
        able = np.flatnonzero(change > 1e-9)
        out = able[(x[able] / change[able]).argmin()]
        least = x[out] / change[out]
        x -= least * change
        x[out] = least
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        basis[:, out] = column
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ need, 0)
    configs = [tuple(np.repeat(lengths, column.astype(np.int64))[::-1].tolist()) for column in basis.T]
    return dict(zip(configs, x.tolist(), strict=True))


def whole(histogram: np.ndarray, rounds: int = ROUNDS) -> dict[tuple[int, ...], int]:
    """Configurations and copies that hold the histogram exactly, by multiplicative weights in steps of whole sequences."""
    capacity = len(histogram) - 1
    lengths = np.flatnonzero(histogram)
    need = histogram[lengths].astype(np.int64)
    left = need.copy()
    chosen: dict[tuple[int, ...], int] = defaultdict(int)
    while left.any():
        # The weight of a length falls with the share of it that is covered; large ones start by size.
        covered = 1 - left / need
        weight = np.where(left > 0, np.exp(-8.0 * (covered - covered[left > 0].min())) * lengths ** 1.05, 0.0)
        value = np.zeros(capacity + 1)
        value[lengths] = weight
        best = best_values(value, capacity)
        with_length = np.where(left > 0, weight + best[capacity - lengths], -1.0)  # the best configuration that has each length
        least, placed = (1 - NEAR_BEST) * best[capacity], False
        for k in np.argsort(-with_length, kind="stable"):
            if with_length[k] < least:
                break
            if not left[k]:
                continue
            stock = left.copy()
            stock[k] -= 1
            config = [k, *filled(weight, best, lengths, stock, capacity - int(lengths[k]))]
            if placed and weight[config].sum() < least:  # what it would take is used up
                continue
            own, times = np.unique(config, return_counts=True)
            step = max(1, min(int((need[own] // times).min() * 4 / rounds), int((left[own] // times).min())))
            chosen[tuple(sorted(lengths[config].tolist(), reverse=True))] += step
            left[own] -= step * times
            placed = True
    return chosen


def program(histogram: np.ndarray, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and copies that hold the histogram exactly."""
    left, result = histogram.astype(np.int64).copy(), []
    if 0 < np.count_nonzero(left) <= FEW_LENGTHS and left[left > 0].min() >= HOT:
        for config, x in few_lengths(left).items():
            counts = Counter(config)
            copies = min(int(x + 1e-4), *(int(left[n]) // k for n, k in counts.items()))
            if copies > 0:
                result.append((config, copies))
                for n, k in counts.items():
                    left[n] -= copies * k
    return result + list(whole(left, rounds).items())


def plan(histogram: np.ndarray, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences take each; together they hold the histogram's lengths exactly."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    return full + min(program(left, rounds), best_fit(left), key=lambda found: sum(copies for _, copies in found))


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Place a histogram, longest first, each where the least room stays; equal sequences are one group."""
    capacity = len(left) - 1
    groups: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]  # by room
    rooms = np.zeros(capacity + 1, bool)
    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            fitting = np.flatnonzero(rooms[n:])
            if not len(fitting):
                each = capacity // n
                whole, rest = divmod(count, each)
                for size, copies in ((each, whole), (rest, 1)):
                    if size and copies:
                        groups[capacity - size * n][(n,) * size] += copies
                        rooms[capacity - size * n] = True
                break
            room = n + int(fitting[0])
            config, copies = groups[room].popitem()
            used = min(copies, count)
            if used < copies:
                groups[room][config] = copies - used
            rooms[room] = bool(groups[room])
            groups[room - n][(*config, n)] += used
            rooms[room - n] = True
            count -= used
    return [(config, copies) for group in groups for config, copies in group.items()]


def places(chosen: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """A row per configuration, length in it and copy of that length: the ranks it takes, from which sequence on, at what offset."""
    rows, taken, first = [], Counter(), 0
    for config, copies in chosen:
        offset = 0
        for n in config:
            rows.append((n, taken[n], copies, first, offset))
            taken[n] += copies
            offset += n
        first += copies
    return pd.DataFrame(rows, columns=["length", "rank0", "copies", "sequence0", "offset"])


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids`` (binary, unsigned 32-bit).

    A document is its text's ids and the ``end`` id, so null and empty texts have one id.  Longer documents are cut so that the
    first piece takes the remainder and all others are full.
    """
    kind = docs.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            ids, counts = own.encode(batch.column(1), end)
            ids = ids.astype("<u4")
            rows = []
            stop = 0
            for k, n in enumerate(counts.tolist()):
                at, begin, piece = 0, stop, 0
                stop += n
                while at < n:
                    size = (n - at) % capacity or capacity
                    raw = ids[begin + at : begin + at + size].tobytes()
                    rows.append((k, piece, at, size, zlib.crc32(raw), raw))
                    at, piece = at + size, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *map(pa.array, columns[1:], kinds)],
                ["id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    return source.mapInArrow(cut, schema).withColumnRenamed("id", id)


def pack(rows: DataFrame, *, length: str = "length", capacity: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows whose ``length`` is between 1 and ``capacity``.

    Every row is placed, none overlaps another and offsets of a sequence have no gaps.  Rows without a length, or with one
    out of bounds, raise.  Rows are stored once; extra columns stay, and a column named like a new one is replaced.  Equal
    rows are places of their own.  An empty table stays empty.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset")
    kept = stored(rows, "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for n, count in kept.groupBy(F.col(length).cast("long")).count().collect():  # a row per length
        if n is None or not 0 < n <= capacity:
            raise ValueError(f"length {n} of {count} rows is not between 1 and {capacity}")
        histogram[n] = count
    table = places(plan(histogram, rounds))
    if table.empty:
        return kept.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    ranked = prefix_sums(kept, [length], length, before="_before", position="_position")
    first = np.concatenate([[0], np.cumsum(histogram)[:-1]])
    starts = {
        n: (own["rank0"].to_numpy() + first[n], own["sequence0"].to_numpy(), own["offset"].to_numpy())
        for n, own in table.groupby("length")
    }
    shared = spark.sparkContext.broadcast(starts)  # a row per length in a configuration

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            positions = batch.column(batch.schema.get_field_index("_position")).to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes):
                own = sizes == n
                rank, base, at = shared.value[n]
                k = np.searchsorted(rank, positions[own], "right") - 1
                sequence[own], offset[own] = base[k] + positions[own] - rank[k], at[k]
            keep = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name not in ("_before", "_position")]
            names = [f.name for f in batch.schema if f.name not in ("_before", "_position")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([f for f in ranked.schema if f.name not in ("_before", "_position")])
    return ranked.mapInArrow(placed, schema.add("sequence_id", "long").add("offset", "long"))
