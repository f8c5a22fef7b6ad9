"""Prefix trie of conversations: every distinct sequence of first turns, with counts over its members and its subtree.

A conversation is one row of turn ids (two 64-bit hashes of role and text, and the length of the text).  Rows are range-sharded in the
order of their sequences, so the members of a node are neighbours.  A shard is cut into blocks of bounded cells; in a block the rows
form a padded matrix, ``numpy.lexsort`` orders it, the change mask of each column OR-accumulates over the columns before
it, a set mask marks the start of a node, and ``reduceat`` adds up the members of every depth.

Only nodes on the path of a block's first or last row can go on in another block.  Those boundary nodes leave as partial
counts under the digest of their prefix; their counts are added up, and the sums over the subtrees of a block's two paths are run
again with the whole counts.  Digests of a prefix are sums of hashes of (depth, turn), 124 bits in two lanes.

A conversation's turn ids (some 30 bytes a turn) are one row and must fit a task; texts stay on the map side of the first shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import partitions, stored

LANE = 2**62 - 1
# Cells of a block's matrix; a single longer row is a block of its own.
CELLS = 1 << 19


def head_size(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def sequences(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv`` and ``turns``, the array of its turn ids in order.

    Null turns come first; rows of one turn are put in order of their hashes, and rows that repeat all columns are turns of
    their own.  Null roles and texts are empty.  Rows without a conversation id belong to none and are left out; other columns are ignored.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    one = F.struct(
        F.col(turn).alias("turn"), F.xxhash64(F.lit(1), by, said).alias("a"), F.xxhash64(F.lit(2), by, said).alias("b"), F.length(said).alias("size")
    )
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), one.alias("one"))
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"], t["b"], t["size"])))


def with_shared_heads(rows: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the first conversation of their hundred, then go on with their own."""
    heads = rows.select(F.col("conv").alias("base"), F.slice("turns", 1, 5).alias("head")).where(F.col("base") % 100 == 0)
    based = rows.withColumn("base", F.col("conv") - F.col("conv") % 100).withColumn("h", head_size(F.col("conv")))
    none = F.array().cast(heads.schema["head"].dataType)
    shared = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return based.join(heads, "base", "left").select("conv", F.concat(shared, own).alias("turns"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (fixed values: the finalizer of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def block_nodes(conv: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray | list]:
    """Every node of a block of rows; ``a``, ``b`` and ``length`` hold the turns of all rows, one row after another.

    ``edge`` is 1 on the path of the first row, 2 on that of the last, 3 on both and 0 for a node that is whole.  Children, leaves and saved
    tokens of boundary nodes count what is whole below them; their members are those of the block.
    """
    n, width = len(conv), int(sizes.max())
    filled = np.arange(width) < sizes[:, None]
    pairs = np.empty(len(a), [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = a, b
    ids = np.zeros((n, width), np.int64)  # local ids in the order of (a, b); 0 pads
    ids[filled] = np.unique(pairs, return_inverse=True)[1].reshape(-1) + 1
    order = np.lexsort((conv, *ids.T[::-1]))
    ids, conv, sizes = ids[order], conv[order], sizes[order]

    def by_depth(cells: np.ndarray) -> np.ndarray:
        table = np.zeros((n, width + 1), cells.dtype)
        table[:, 1:][filled] = cells
        return table[order]

    tokens = by_depth(length)
    depths = np.arange(width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lanes = []
    for lane in (a, b):
        turns = mixed(by_depth(lane.view(np.uint64)) + depths)
        turns[:, 0] = 0
        lanes.append((np.cumsum(turns, axis=1) & np.uint64(LANE)).astype(np.int64))
    present = np.arange(width + 1) <= sizes[:, None]
    changes = np.ones((n, width + 1), bool)
    changes[1:, 0] = False
    changes[1:, 1:] = ids[1:] != ids[:-1]
    starts = np.logical_or.accumulate(changes, axis=1) & present
    # The row at which the node of each cell starts.
    home = np.maximum.accumulate(np.where(starts, np.arange(n)[:, None], -1), axis=0)
    edge = np.zeros((n, width + 1), np.int8)
    edge[0, : sizes[0] + 1] = 1
    last = np.arange(sizes[-1] + 1)
    edge[home[-1, last], last] |= 2
    whole = starts & (edge == 0)

    # All cells, depth after depth; the cells of a node are neighbours there, so one cut adds up every depth.
    depth, row = np.nonzero(present.T)
    cut = np.flatnonzero(starts[row, depth])
    d, at = depth[cut], row[cut]
    members = np.diff(np.append(cut, len(row)))
    deeper = np.hstack([whole, np.zeros((n, 1), bool)])[row, depth + 1]
    children = np.add.reduceat(deeper.astype(np.int64), cut)
    ended = np.add.reduceat((sizes[row] == depth).astype(np.int64), cut)
    is_whole = whole[at, d]

    def below(own: np.ndarray) -> np.ndarray:
        """Sums over the subtrees of what whole nodes hold: from a row's own start of the depth on, then over the node's rows."""
        held = np.zeros((n, width + 1), np.int64)
        held[at, d] = np.where(is_whole, own, 0)
        return np.add.reduceat(np.cumsum(held[:, ::-1], axis=1)[:, ::-1][row, depth], cut)

    up = np.maximum(d - 1, 0)
    least = np.minimum.reduceat(conv[row], cut)
    table = np.zeros((n, width + 1), np.int64)
    table[at, d] = least
    return {
        "depth": d, "a": lanes[0][at, d], "b": lanes[1][at, d], "up_a": lanes[0][at, up], "up_b": lanes[1][at, up],
        "conv_id": least, "parent_conv_id": table[home[at, up], up], "n_convs": members, "n_children": children,
        "n_leaves": below(children == 0), "saved_tokens": below((members - 1) * tokens[at, d]), "size": tokens[at, d],
        "edge": edge[at, d].astype(np.int64), "up_edge": np.where(d > 0, edge[home[at, up], up], 0).astype(np.int64),
        "first_end": np.where(ended > 0, conv[at], -1),
        "ends": [",".join(map(str, conv[r : r + k].tolist())).encode() if k else b"" for r, k in zip(at.tolist(), ended.tolist(), strict=True)],
    }


BLOCKS = (
    "block long, depth long, a long, b long, up_a long, up_b long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, size long, edge long, up_edge long, first_end long, ends binary, ends_sha256 string"
)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the blocks of a sorted shard, each of at most ``most`` cells or a single row."""
    number = TaskContext.get().partitionId() << 32
    waiting, widest = [], 0

    def block() -> pa.RecordBatch:
        nonlocal number
        conv, sizes = (np.array([w[k] for w in waiting], np.int64) for k in (0, 1))
        nodes = block_nodes(conv, sizes, *(np.concatenate([w[k] for w in waiting]) for k in (2, 3, 4)))
        edges = (nodes["edge"] > 0).tolist()
        nodes["ends_sha256"] = [None if e else hashlib.sha256(t).hexdigest() for e, t in zip(edges, nodes["ends"], strict=True)]
        nodes["ends"] = [t if e and t else None for e, t in zip(edges, nodes["ends"], strict=True)]
        nodes["block"] = np.full(len(edges), number)
        number += 1
        waiting.clear()
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        named = [part.split() for part in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(nodes[name], kinds[kind]) for name, kind in named], [name for name, _ in named])

    for batch in batches:
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        turns = batch.column("turns")
        offsets = turns.offsets.to_numpy()
        cells = turns.values
        a, b, size = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "size"))
        size = size.astype(np.int64)
        for c, start, end in zip(conv.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            width = max(widest, end - start + 1)
            if waiting and width * (len(waiting) + 1) > most:
                yield block()
                width = end - start + 1
            widest = width
            waiting.append((c, end - start, a[start:end], b[start:end], size[start:end]))
    if waiting:
        yield block()


def _hashed_ends(parts: DataFrame) -> DataFrame:
    """One hash per boundary node over its lists of ended members, in ascending order, a list at a time."""
    key = ["depth", "a", "b"]
    rows = parts.where("ends is not null").select(*key, "first_end", "ends")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "first_end")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        names = ["depth", "a", "b", "ends_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, digest.hexdigest()), kinds, strict=True)], names)

        for batch in batches:
            for *own, listed in zip(*(batch.column(k).to_pylist() for k in ("depth", "a", "b", "ends")), strict=True):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        yield row()
                    key, digest = own, hashlib.sha256()
                digest.update(listed)
        if key is not None:
            yield row()

    return rows.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def _recombined(parts: DataFrame) -> DataFrame:
    """Boundary nodes with their members, children and sums over all blocks."""
    key = ["depth", "a", "b"]
    merged = parts.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.max("size").alias("size"),
        F.min("block").alias("home"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
    )
    # Boundary children are children once, in however many blocks they are.
    more = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    merged = merged.join(more.agg(F.count(F.lit(1)).alias("more")), key, "left")
    merged = merged.withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    # Each boundary node's own leaf and tokens count in its first block, on the path on which it lies there.
    leaf, tokens = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("size")
    own = parts.select(*key, "block", "edge", "n_leaves", "saved_tokens").join(
        merged.select(*key, F.col("home").alias("block"), leaf.cast("long").alias("leaf"), tokens.alias("tokens")), [*key, "block"], "left"
    )
    path = Window.partitionBy("block", "edge").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy("block")

    def subtree(column: str) -> Column:
        tails = F.when(F.col("edge") == 3, F.coalesce(F.sum(F.when(F.col("edge") < 3, F.col(column))).over(block), F.lit(0))).otherwise(0)
        return F.coalesce(F.sum(column).over(path), F.lit(0)) + tails

    sums = own.withColumns({"n_leaves": F.col("n_leaves") + subtree("leaf"), "saved_tokens": F.col("saved_tokens") + subtree("tokens")})
    sums = sums.groupBy(*key).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return stored(merged.join(sums, key), "boundary")


def _parents(merged: DataFrame) -> DataFrame:
    """What children look up: the smallest member under the digest of the parent."""
    return merged.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))


def prefix_trie(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", cells: int = CELLS) -> DataFrame:
    """A row per node: its smallest member and that of its parent, depth, members, children, leaves, saved tokens, ended members' digest.

    ``saved_tokens`` are code points.  Equal conversations are members of the same nodes; see ``sequences`` for nulls, ties and repeated rows.
    A table without conversations gives no rows.
    """
    rows = with_shared_heads(sequences(turns, conv=conv, turn=turn, role=role, text=text))
    order = [F.transform("turns", lambda t: F.struct(t["a"], t["b"])), F.col("conv")]
    sorted_ = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    nodes = stored(sorted_.mapInArrow(lambda batches: _blocks(batches, cells), BLOCKS), "trie")
    parts = nodes.where("edge > 0")
    merged = _recombined(parts)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("edge = 0 and up_edge = 0").select(*columns)
    # Children of boundary nodes look up the smallest member over all blocks; a hot parent is split as a skewed key.
    beside = nodes.where("edge = 0 and up_edge > 0").drop("parent_conv_id").join(_parents(merged), ["depth", "up_a", "up_b"])
    outer = merged.join(_hashed_ends(parts), ["depth", "a", "b"], "left").join(_parents(merged), ["depth", "up_a", "up_b"], "left")
    outer = outer.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return inner.unionByName(beside.select(*columns)).unionByName(outer.select(*columns))
