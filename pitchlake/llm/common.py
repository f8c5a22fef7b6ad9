"""Shared helpers: session settings, scratch tables, exact prefix sums over a global order, word tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.session import ensure_checkpoint_dir, tune

# Texts may be long, so Arrow batches are bounded by bytes as well as by rows.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.parquet.compression.codec": "zstd",
    # Each new plan of an adaptive query is described anew; the driver keeps the descriptions of a thousand queries.
    "spark.sql.maxPlanStringLength": "4k",
    "spark.sql.ui.explainMode": "simple",
}
# Words kept per Python worker; beyond it the table starts again, which costs time and never changes a result.
WORDS_KEPT = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """The session with this package's settings and a checkpoint folder."""
    tune(spark, tables=False)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def release(spark: SparkSession) -> None:
    """Let go of what finished plans left in the driver.

    Spark cleans up after plans only when the driver's heap is collected, and a heap that is left to itself first grows to its limit.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without_broadcasts(spark: SparkSession) -> SparkSession:
    """The session without automatic broadcasts, for plans of many joins: the driver would build and hold each small relation.

    What is broadcast there says so itself and is bounded.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, lost executors cost nothing, and the driver is freed of the plan."""
    path = scratch(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_buckets(id_column: str, buckets: int = 5) -> Column:
    """The remainder of the CRC-32 of an id's decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % buckets


def share_of(hash: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in that share of all hashes."""
    return hash.bitwiseAND(F.lit(2**63 - 1)) <= F.lit(min(2**63 - 1, int(share * 2**63)))


def prefix_sums(df: DataFrame, order: Sequence[str], weight: str, *, before: str, position: str) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows and the number of earlier rows, in the order of ``order``.

    Rows are dealt into ranges of the order and stored.  Each range's totals are added up over the ranges (one row per
    range), and sums within a range are a window over that range alone, so no task sees more than a range.  Rows
    that tie in every column of ``order`` are told apart by their place in the input, so a hot tie is split too.
    Null weights count as 0; an empty input gives no rows.
    """
    n = partitions(df.sparkSession)
    ranged = stored(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order], F.col("_tie"))
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0))
    totals = ranged.groupBy("_part").agg(F.sum(w).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c + "0") for c in ("_sum", "_rows")]
    )
    within = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_tie")
    return (
        ranged.join(F.broadcast(starts), "_part")  # a row per partition
        .withColumn(before, F.col("_sum0") + F.sum(w).over(within) - w)
        .withColumn(position, F.col("_rows0") + F.row_number().over(within) - 1)
        .drop("_part", "_tie", "_sum0", "_rows0")
    )


class WordTable:
    """Token ids of pieces of text, each computed once per Python worker while the table lasts."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], limit: int = WORDS_KEPT):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)

    def add(self, words: list[str]) -> None:
        found = self.encode(words)
        known = len(self.index)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        end = int(self.starts[known])
        total = int(lengths.sum())
        while end + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[end : end + total] = np.fromiter((i for ids in found for i in ids), np.int32, total)
        self.starts[known + 1 : known + len(words) + 1] = end + np.cumsum(lengths)
        self.index.update(zip(words, range(known, known + len(words)), strict=True))

    def lookup(self, words: list[str], picks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has; ``picks`` repeats and orders the words first."""
        new = set(words).difference(self.index)
        if new and len(self.index) + len(new) > self.limit:
            self.clear()
            new = set(words)
        if new:
            self.add(list(new))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        at = at if picks is None else at[picks]
        start = self.starts[at]
        lengths = self.starts[at + 1] - start
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(start - before, lengths) + np.arange(int(lengths.sum()))], lengths


def document_ends(words_per_document: Sequence[int], ids_per_word: np.ndarray) -> np.ndarray:
    """Where each document's ids end in the ids of its batch."""
    ends = np.concatenate([[0], np.cumsum(ids_per_word)])
    return ends[np.cumsum(np.asarray(words_per_document, np.int64))] if len(words_per_document) else np.zeros(0, np.int64)


SEPARATOR = "\x1f"
# Texts that plain substitution can't cut: two white spaces in a row, white space but spaces and line ends, the
# separator itself, a word mark before a space, a comma or full stop after anything but a Latin letter.
UNEVEN = (
    r"[ \n][ \n]|[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|^[ \n.,]|▁ |[^a-zA-ZÀ-ÖØ-öø-ÿ][.,]"
)


def uneven(texts: pa.Array) -> np.ndarray:
    """Which texts ``cut`` must not take."""
    return pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)


def cut(texts: pa.Array, space: str, line: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut even texts before spaces, commas and full stops and around line ends.

    ``space`` and ``line`` are what stays of them.  Gives the distinct cuts, which of them follow each other, and how many each text has.
    """
    for mark, kept in ((" ", space), ("\n", line + SEPARATOR), (",", ","), (".", ".")):
        texts = pc.replace_substring(texts, mark, SEPARATOR + kept)
    cuts = pc.split_pattern(texts, SEPARATOR)
    coded = cuts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.diff(cuts.offsets.to_numpy())


def filled(texts: pa.Array) -> pa.Array:
    """The texts, null ones empty."""
    return pc.fill_null(texts.cast(pa.string()), "")


def encode_texts(texts: pa.Array, table: WordTable, space: str, line: str, others: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and where each text's end; ``others`` encodes an uneven text."""
    texts = filled(texts)
    odd = uneven(texts)
    words, picks, counts = cut(texts.filter(pa.array(~odd)) if odd.any() else texts, space, line)
    ids, lengths = table.lookup(words, picks)
    ends = document_ends(counts, lengths)
    if not odd.any():
        return ids, ends
    even = iter(np.split(ids, ends[:-1]) if len(ends) else [])
    parts = [others(texts[k].as_py()) if odd[k] else next(even) for k in range(len(texts))]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])
