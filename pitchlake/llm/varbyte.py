"""Binary token output: frequency-ranked ids in byte-aligned variable-length coding, with the control bytes apart.

Ids are replaced by their rank among all ids of the corpus, so frequent ones take one byte.  Four ranks share a control byte: two
bits each give the number of data bytes, less one.  Decoding looks the control byte up in a table of four lengths, so
a block is read with a handful of array operations and no loop over ids.

The files hold blocks of whole documents in ascending id order: per document its id and number of ids, per block the
control bytes and the data bytes; the rank table lies beside them.  Blocks are binary columns of Parquet files, since
Spark then commits them, and reads them from any store; the coding inside is this module's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import partitions, scratch
from pitchlake.llm.tokens import encoder

BLOCK_IDS = 1 << 20
# Data bytes of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned ranks below 2**32; the last control byte may have unused bits."""
    ranks = ranks.astype(np.int64)
    lengths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(lengths) - lengths
    data = np.empty(int(lengths.sum()), np.uint8)
    for k in range(4):
        has = lengths > k if k else slice(None)
        data[at[has] + k] = ranks[has] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, keep: np.ndarray) -> np.ndarray:
    """Ranks of blocks coded one after another; ``keep`` is false where a control byte's two bits stand for none."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[keep]
    at = np.cumsum(lengths) - lengths
    values = np.frombuffer(data, np.uint8)
    ranks = np.zeros(len(lengths), np.int64)
    for k in range(int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > k)
        ranks[has] |= values[at[has] + k].astype(np.int64) << 8 * k
    return ranks


def used_codes(counts: np.ndarray) -> np.ndarray:
    """``keep`` of blocks with so many ids each, whose control bytes are apart."""
    slots = -(-counts // 4) * 4
    keep = np.ones(int(slots.sum()), bool)
    ends = np.cumsum(slots)
    for spare in range(1, 4):
        keep[ends[slots - counts >= spare] - spare] = False
    return keep


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, id: str = "doc_id", text: str = "text", end: int = 2) -> None:
    """Encode all texts, each followed by the ``end`` id, and write them under ``path`` in ascending id order.

    Null and empty texts hold the end id alone; null ids come first; rows that share an id stay apart, in no set order; an
    empty table gives empty files.  Texts are encoded once: their ids are stored by document, counted, then ranked and
    moved into order as coded bytes.  The rank table has a row for each id that occurs, at most the vocabulary.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        narrow = np.uint16 if max(own.vocabulary, end + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            ids, counts = own.encode(batch.column(1), end)
            stops = np.cumsum(counts) * np.dtype(narrow).itemsize
            raw = ids.astype(narrow).tobytes()
            parts = [raw[a:b] for a, b in zip(stops - counts * np.dtype(narrow).itemsize, stops, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(parts, pa.binary())], ["id", "n", "raw"]
            )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(unpacked(batch.column(0), batch.column(1))[0])
            size = max(len(total), len(seen))
            total = np.pad(total, (0, size - len(total))) + np.pad(seen, (0, size - len(seen)))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["token", "n"])

    raw_path = scratch(spark, "tokens")
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    source.mapInArrow(tokens, f"id {kind}, n long, raw binary").write.parquet(raw_path)
    raw = spark.read.schema(f"id {kind}, n long, raw binary").parquet(raw_path)
    counts = raw.select("n", "raw").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts.write.parquet(f"{path}/counts")
    order = rank_table(spark, path)
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    ranks = spark.sparkContext.broadcast(rank)  # a number for each id of the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = before = 0

        def block() -> pa.RecordBatch:
            ids, counts, own = zip(*held, strict=True)
            control, data = encode_ranks(np.concatenate(own))
            row = [[before], [sum(ids, [])], [np.concatenate(counts)], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        names = ["before", "ids", "counts", "control", "data"]
        types = None
        for batch in batches:
            types = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            ids, counts = unpacked(batch.column(1), batch.column(2))
            own, stops, named, begin = ranks.value[ids], np.concatenate([[0], np.cumsum(counts)]), batch.column(0).to_pylist(), 0
            while begin < len(counts):
                # As many documents as fill the block, and one at least.
                end = max(begin + 1, int(np.searchsorted(stops, stops[begin] + BLOCK_IDS - size, "right")) - 1)
                held.append((named[begin:end], counts[begin:end], own[stops[begin] : stops[end]]))
                size += int(stops[end] - stops[begin])
                begin = end
                if size >= BLOCK_IDS or begin < len(counts):
                    yield block()
                    held, size, before = [], 0, before + size
        if held:
            yield block()

    # Coded after the sort, because cutting ranges reads the rows twice; rows of one id are told apart by their hash, and so in tasks.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("raw")]
    ordered = raw.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    files = ordered.mapInArrow(blocks, f"before long, ids array<{kind}>, counts array<bigint>, control binary, data binary")
    files.withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(f"{path}/blocks")


def unpacked(counts: pa.Array, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of stored documents one after another, and how many each has."""
    n = counts.to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(raw.to_pylist())
    return np.frombuffer(joined, np.uint32 if n.sum() * 4 == len(joined) else np.uint16), n


def rank_table(spark: SparkSession, path: str) -> np.ndarray:
    """Ids by falling frequency, equal ones by id: as many as occur, at most the vocabulary."""
    counts = spark.read.schema("token long, n long").parquet(f"{path}/counts").toPandas()
    return counts.sort_values(["n", "token"], ascending=[False, True])["token"].to_numpy(np.int64)


def read_tokens(spark: SparkSession, path: str, *, id: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """``id``, ``start`` (ids of all documents before), ``n_tokens`` and ``raw`` (the ids as little-endian unsigned 32-bit integers)."""
    schema = f"before long, ids array<{kind}>, counts array<bigint>, control binary, data binary, part int"
    files = spark.read.schema(schema).parquet(f"{path}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    parts = files.groupBy("part").agg(F.sum(size).alias("size"))  # a row per range of ids
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    table = spark.sparkContext.broadcast(rank_table(spark, path).astype(np.uint32))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.asarray(row["counts"], np.int64)
                ids = table.value[decode_ranks(row["control"], row["data"], used_codes(counts.sum(keepdims=True)))]
                stops = np.cumsum(counts)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(row["start"] + stops - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(stops - counts, stops, strict=True)], pa.binary()),
                    ],
                    ["id", "start", "n_tokens", "raw"],
                )

    blocks = files.join(F.broadcast(starts), "part")
    blocks = blocks.select("ids", "counts", "control", "data", (F.col("part_start") + F.col("before")).alias("start"))
    return blocks.mapInArrow(decoded, f"id {kind}, start long, n_tokens long, raw binary").withColumnRenamed("id", id)
