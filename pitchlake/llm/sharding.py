"""Contiguous shards of near equal size, from global prefix sums of byte sizes.

Rows are dealt into ranges of the order columns, range totals are added up, and a row's shard is the share of all bytes that lies
before it.  A shard's size is off by less than its largest row.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import prefix_sums, stored


def text_size(text: str) -> Column:
    """UTF-8 bytes of a text and one for its end; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def balanced_shards(rows: DataFrame, shards: int, *, size: str = "size", order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, 2 ... within the shard, in order).

    Null and negative sizes count as 0.  Null order values come
    first; rows that tie, repeated rows included, follow one another and may fall on both sides of a cut.  If all sizes are 0, rows
    go to shard 0.  All columns given are carried through one shuffle, so pass the narrow ones; existing columns ``shard`` and
    ``slot`` are replaced.  An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError(f"shards is {shards}, not positive")
    rows = rows.drop("shard", "slot").withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    placed = stored(prefix_sums(rows, order, "_size", before="_before", position="_position"), "placed")
    total = placed.agg(F.sum("_size")).first()[0] or 0
    share = F.expr(f"_before * {shards} div {total}") if total else F.lit(0)
    cut = placed.withColumn("shard", F.least(share, F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_position").alias("_first"))
    return (
        cut.join(F.broadcast(firsts), "shard")  # a row per shard
        .withColumn("slot", F.col("_position") - F.col("_first"))
        .drop("_size", "_before", "_position", "_first")
    )
