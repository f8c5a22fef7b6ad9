"""Global order: gapless ordinals over range partitions, and output written in that order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.session import ensure_checkpoint_dir


def with_ordinal(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Add each row's place from 0 in ``order``, within its group of ``by``; nulls come first.

    Rows are cut into ranges of (group, order); a range's rows are counted, the counts are added up over the ranges of a
    group, and places within a range are a window over that range alone.  So no task holds a group, however large.  ``order`` must
    tell all rows of a group apart for the places to be the same in every run.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*[F.col(c).asc_nulls_first() for c in by], *[(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order]]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Cut once: a range's number must be the same for its count and its rows.
    ranged = df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("_range", *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = ranged["_range"] == starts["_range"]
    for c in by:
        same = same & ranged[c].eqNullSafe(starts[f"_by_{c}"])
    within = Window.partitionBy(ranged["_range"], *[ranged[c] for c in by]).orderBy(*keys[len(by):])
    placed = ranged.join(starts, same).withColumn(name, (F.col("_before") + F.row_number().over(within) - 1).cast("long"))
    return placed.select(*df.columns, name)
