"""Recurrences over ordered rows, such as ratings: sequential within a key, distributed between keys, in segments of bounded size.

The ordered rows are cut into ranges; the part of a key in one range is a segment.  Round *k* folds the *k*-th segment of every key that
has one, starting from the state its segment before ended with.  Every row is folded once, a task is given no more than a
segment and the state of its key, and the values are those of the sequential fold, bit for bit, wherever the cuts fall.  A key that holds a
third of all rows takes as many rounds as it has segments; the others are done after their own.

Within a task the rows of a segment pass in order, an Arrow batch at a time, so that Python holds a batch and the state of one key,
whatever the size of the segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from math import ceil
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from pitchlake.session import ensure_checkpoint_dir

SEGMENT_ROWS = 1_000_000


@dataclass(frozen=True)
class Fold:
    """What one row does to the entries it names.

    ``members`` are columns of one type; each names an entry of the key's state that the row reads and changes.  ``value`` is the DDL type
    of an entry's state.  ``play(rows, state)`` gets consecutive rows of a key in order and the state handed over (entry to value, for the
    entries of these rows that were met before) and gives, for each member column, the entries' values after each row.  It must depend on
    nothing else, not on how many rows come at once either, and must not change the values it is handed, only replace them.
    """

    members: tuple[str, ...]
    value: str
    play: Callable[[pd.DataFrame, dict], Sequence[Sequence]]


def _same(keys: Sequence[str]) -> Column:
    """Equal keys, null ones included; the other side calls them ``_of_<key>``."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])


def _renamed(keys: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"_of_{c}") for c in keys]


def _comparable(value):
    """A NaN, which differs from itself, as a value that does not."""
    return "NaN" if value != value else value


def _parts(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal values in a batch that is sorted by the columns, with these values."""
    def values(rows: pa.RecordBatch) -> list[tuple]:
        return list(zip(*[map(_comparable, rows.column(c).to_pylist()) for c in columns], strict=True))

    if not batch.num_rows:
        return
    ends = values(batch.take(pa.array([0, batch.num_rows - 1])))
    if ends[0] == ends[1]:
        yield ends[0], batch
        return
    start = 0
    for found, equal in groupby(values(batch)):
        part = batch.slice(start, sum(1 for _ in equal))
        start += part.num_rows
        yield found, part


def _frame(part: pa.RecordBatch, columns: Sequence[str]) -> pd.DataFrame:
    """Columns of a batch for Python: whole numbers stay whole beside nulls, instants are of the session's zone."""
    frame = part.select(list(columns)).to_pandas(integer_object_nulls=True)
    zoned = [c for c in frame.columns if isinstance(frame[c].dtype, pd.DatetimeTZDtype)]
    return frame.assign(**{c: frame[c].dt.tz_localize(None) for c in zoned})


def scratch_folder(df: DataFrame, label: str) -> str:
    """A new folder name beside the checkpoints."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def ordered_segments(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, int]:
    """The rows with ``_seq`` (their order) and ``_round`` (segment of their key), and the number of rounds.

    With several ranges the rows are checkpointed, so that a recomputed task cannot cut them differently, and stored by round, so that a
    round reads its own rows only.  Rows of a key that tie in all of ``order`` stay in one range, in any order.
    """
    ranges = max(1, ceil(rows.count() / segment_rows))
    by = [*keys, *order]
    rows = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id())
    if ranges == 1:
        return rows.withColumn("_round", F.lit(0)), 1
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint().withColumn("_range", F.shiftright("_seq", 33).cast("int"))
    spans = rows.groupBy(*_renamed(keys)).agg(F.min("_range").alias("_first"), F.max("_range").alias("_last"))
    rounds = (spans.agg(F.max(F.col("_last") - F.col("_first"))).first()[0] or 0) + 1
    # A range between two others ends at a row of its own, so a key has rows in every range of its span.
    rows = rows.join(spans, _same(keys)).withColumn("_round", F.col("_range") - F.col("_first"))
    rows = rows.withColumn("_more", F.col("_range") < F.col("_last"))
    rows = rows.drop(*[f"_of_{c}" for c in keys], "_range", "_first", "_last")
    path = scratch_folder(rows, "fold-segments")
    rows.repartition("_round", *keys).write.partitionBy("_round").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), rounds


def segmented_fold(
    rows: DataFrame,
    fold: Fold,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    entry: str = "entry",
    keep: Sequence[str] = (),
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Every entry's value after every row that names it: ``keys``, ``entry``, the ``keep`` columns of the row, ``_seq`` and ``value``.

    ``order`` must tell the rows of a key apart for the values to be the same in every run.  Null keys make one group, a null member
    is an entry of its own, an empty input gives no rows; a row that names one entry twice gives two rows.
    """
    keys, keep = list(keys), list(keep)
    wanted = list(dict.fromkeys([*keys, *order, *keep, *fold.members, *rows.columns]))
    segments, rounds = ordered_segments(rows.select(*wanted), keys, order, segment_rows)
    types = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    named = [*keys, entry]
    ids = ", ".join([*[f"`{c}` {types[c]}" for c in keys], f"`{entry}` {types[fold.members[0]]}"])
    schema = ", ".join([ids, *[f"`{c}` {types[c]}" for c in keep], "_seq bigint", f"value {fold.value}"])
    value_type = to_arrow_type(DataType.fromDDL(fold.value))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, {}
        for batch in batches:
            for (*found, handed_over), part in _parts(batch, [*keys, "_handed_over"]):
                if found != key:
                    key, state = found, {}
                if handed_over:
                    state.update(zip(_frame(part, ["_entry"])["_entry"].tolist(), part.column("_value").to_pylist(), strict=True))
                    continue
                frame = _frame(part, wanted)
                names = [frame[member].tolist() for member in fold.members]
                values = [list(after) for after in fold.play(frame, {e: state[e] for e in set().union(*names) if e in state})]
                # The last row that names an entry, and the last member column in it.
                last = {}
                for m, each in enumerate(names):
                    for e, row in dict(zip(each, range(len(each)), strict=True)).items():
                        last[e] = max(last.get(e, (-1, -1)), (row, m))
                state.update((e, values[m][row]) for e, (row, m) in last.items())
                for member, after in zip(fold.members, values, strict=True):
                    columns = [part.column(c) for c in (*keys, member, *keep, "_seq")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(after, value_type)], names=[*named, *keep, "_seq", "value"])

    spark = rows.sparkSession
    # A given number, because the tasks are long for their size and would otherwise be merged.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = spark.createDataFrame([], f"{ids}, value {fold.value}, _seq bigint")

    def played(segment: DataFrame, state: DataFrame) -> DataFrame:
        # What is handed over was reached at an earlier row, so it comes before the rows of its key.
        before = state.select(
            *keys, "_seq", F.col(entry).alias("_entry"), F.col("value").alias("_value"), F.lit(True).alias("_handed_over")
        )
        both = segment.select(*wanted, "_seq", F.lit(False).alias("_handed_over")).unionByName(before, allowMissingColumns=True)
        return both.repartition(tasks, *keys).sortWithinPartitions(*keys, "_seq").mapInArrow(folded, schema)

    if rounds == 1:
        return played(segments, state)

    path = scratch_folder(rows, "fold-history")
    for k in range(rounds):
        segment = segments.where(F.col("_round") == k)
        played(segment, state).write.parquet(f"{path}/_k={k}")
        if k + 1 < rounds:
            done = spark.read.schema(schema).parquet(f"{path}/_k={k}")
            going_on = segment.where("_more").select(*_renamed(keys)).distinct()
            # An entry's value after its latest row so far, for the keys of the next round.
            state = (
                done.select(*state.columns)
                .unionByName(state)
                .join(going_on, _same(keys), "left_semi")
                .groupBy(*named)
                .agg(F.max_by("value", "_seq").alias("value"), F.max("_seq").alias("_seq"))
                .checkpoint()
            )
    return spark.read.schema(schema).parquet(*[f"{path}/_k={k}" for k in range(rounds)])
