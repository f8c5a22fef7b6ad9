"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on the full sets.

Two fixed permutations make every coordinate of a signature.  The first places a shingle's 64-bit fingerprint in a table of
2**20 places; the second, a permutation of that table, is read there and shifted around by one more place for each
further coordinate.  So the coordinates of a shingle are neighbouring table entries, and a signature is one minimum over rows.

Documents with equal sets become one first, so groups of copies cost nothing further.  Sets that agree in a band are candidates.
Round one links each to one member of its bucket (the band's own choice), exactly verified; this is linear in the buckets.
Buckets of three or more that it leaves in several components are then compared in full, in blocks of bounded
bytes: a block computes all its intersections at once and returns only the links that join components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import stored

PLACES = 1 << 20
ROWS = 6
MISSED = 1e-6
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 512
WORDS_KEPT = 400_000


class Shingler:
    """Sets of shingle fingerprints; words between ASCII white space, A-Z lowered."""

    def __init__(self, words: int):
        self.width = words
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit fingerprints of the text's shingles; shorter texts are one shingle, wordless ones none."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh64_intdigest(word)
        codes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(codes))
        mixed = np.full(len(codes) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = scrambled(mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - width + 1 + k])
        return np.unique(mixed)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (fixed values: the finalizer of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands that lose a pair at the threshold with odds of MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** rows)) if 0 < percent < 100 else 1


class Signer:
    """Circulant signatures and the hashes of their bands."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 17):
        rng = np.random.default_rng(seed)
        second = rng.permutation(PLACES).astype(np.uint32)
        self.bands, self.rows = bands, rows
        # Entry p holds the coordinates of place p: the table from p on, around its end.
        self.table = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: bands * rows - 1]]), bands * rows)
        self.first = np.uint64(rng.integers(1, 1 << 62) * 2 + 1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (scrambled(shingles * self.first) >> np.uint64(44)).astype(np.int64)
        least = np.full(self.bands * self.rows, PLACES, np.uint32)
        for k in range(0, len(places), 512):
            least = np.minimum(least, self.table[places[k : k + 512]].min(axis=0))
        return least

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        parts = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        mixed = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            mixed = scrambled(mixed * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        return mixed.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(sets: list[np.ndarray], labels: np.ndarray, split: int, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels that join components, each first set before ``split``, each second from it on (0: any two).

    All intersections of the block are one product of incidence matrices, over the shingles that at least two sets have.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[order][shared]
    both = np.zeros((n, n), np.float32)
    _, column = np.unique(column, return_inverse=True)
    width = 4096
    for begin in range(0, int(column.max(initial=-1)) + 1, width):
        own = (column >= begin) & (column < begin + width)
        matrix = np.zeros((n, width), np.float32)
        matrix[owner[own], column[own] - begin] = 1
        both += matrix @ matrix.T
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    near &= labels[:, None] != labels[None, :]
    at, to = np.nonzero(np.triu(near, 1))
    if split:
        keep = (at < split) & (to >= split)
        at, to = at[keep], to[keep]
    top = {int(x): int(x) for x in np.unique(labels)}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    found = []
    for i, j in zip(at.tolist(), to.tolist(), strict=True):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            top[max(a, b)] = min(a, b)
            found.append((i, j))
    return found


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable over ``links`` (a, b), of every node that has a link.

    Each round takes the smallest label among a node's neighbours and then its label's label, until none changes; labels stay distributed.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = lower.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("further", "next")).alias("component"))
        moved = stored(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels


def _pairs_linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are linked."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in (2, 3))
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("right"))
    sized = pairs.join(first.drop("left"), "a").join(second.drop("right"), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    both = sized.join(first.drop("n_a"), "a").join(second.drop("n_b"), "b").select("a", "b", "left", "right")
    return both.mapInArrow(verify, "a long, b long")


def _joined(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within buckets (band, node, label): every pair of a bucket is compared, in blocks."""
    own = buckets.join(sets, "node")
    sizes = buckets.join(sets.select("node", "n"), "node").groupBy("band").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    sizes = sizes.select("band", F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("rows") / BLOCK_ROWS)).alias("blocks"))
    dealt = own.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("late"), "node", "label", "shingles"
    )

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by([("late", "ascending"), ("node", "ascending")])
        split = 0 if block["i"][0].as_py() == block["j"][0].as_py() else block.num_rows - int(np.sum(block["late"].to_numpy()))
        sets = [np.frombuffer(x, np.uint64) for x in block["shingles"].to_pylist()]
        nodes = block["node"].to_numpy()
        found = block_links(sets, block["label"].to_numpy(), split, percent) if len(sets) > 1 and (split < len(sets)) else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles; links are verified on the
    full sets, held as 64-bit fingerprints.  Bands lose a pair at the threshold with odds of MISSED.  Null, empty and wordless
    texts have empty sets and no links: their component is their own id.  ``component_id`` is the smallest id reachable, nulls
    apart, and ``kept`` says whether it is the row's own, so equal rows are alike; rows that share an id but not a text are apart.
    An empty table gives no rows; extra columns are not read.
    """
    kind = docs.schema[id].dataType.simpleString()
    own_text = F.col(text).cast("string")
    source = docs.select(F.col(id).alias("id"), own_text.alias("text"), F.xxhash64(own_text).alias("hash"))
    bands = bands_for(percent)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(bands)
        for batch in batches:
            sets = [shingler.shingles(t) for t in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            hashes = [signer.band_hashes(s).tobytes() if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "hash", "n", "digest", "bands"])

    signatures = source.mapInArrow(signed, f"id {kind}, hash long, n long, digest binary, bands binary")
    signatures = stored(signatures.withColumn("row", F.monotonically_increasing_id()), "signatures")
    # Equal sets are one node, named by its first row.
    classes = stored(
        signatures.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least")), "classes"
    )
    firsts = signatures.join(classes.select(F.col("node").alias("row")), "row", "left_semi")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(hashes)], ["node", "band"])

    members = firsts.select("row", "bands").mapInArrow(exploded, "node long, band long")
    buckets = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.expr("bit_xor(xxhash64(node))").alias("mark1"), F.expr("bit_xor(xxhash64(node, 1))").alias("mark2"),
    ).where("size > 1")
    buckets = stored(buckets, "buckets")
    # Buckets with the same members are one.
    single = buckets.groupBy("size", "low", "high", "mark1", "mark2").agg(F.min("band").alias("band"))
    members = stored(members.join(single, "band").select("band", "node", "size", "low", "high"), "members")
    involved = members.select("node").distinct()
    wanted = firsts.select("id", "hash", F.col("row").alias("node")).join(involved, "node", "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.shingles(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "n", "shingles"])

    texts = source.alias("s").join(wanted.alias("w"), F.expr("s.hash = w.hash and s.id <=> w.id")).select("w.node", "s.text")
    sets = texts.mapInArrow(shingled, "node long, n long, shingles binary")
    sets = stored(sets.dropDuplicates(["node"]), "sets")  # rows that repeat an id and a text
    star = [members.select(F.least("node", end).alias("a"), F.greatest("node", end).alias("b")).where("a <> b") for end in ("low", "high")]
    links = stored(_pairs_linked(star[0].unionByName(star[1]).distinct(), sets, percent), "links")
    labels = components(links)
    # Round two: a bucket of two is settled, and so is one whose members are linked already.
    labelled = members.where("size > 2").join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("label"))
    labelled = stored(labelled, "labelled")
    split = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    more = stored(_joined(labelled.join(split, "band", "left_semi"), sets, percent), "links")
    name = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_label"))
    merged = more.join(name("a"), "a", "left").join(name("b"), "b", "left")
    merged = components(merged.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b"))
    own = classes.join(labels, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("label"))
    own = own.join(merged.select(F.col("node").alias("label"), "component"), "label", "left")
    own = stored(own.select("digest", "least", F.coalesce("component", "label").alias("label")), "labels")
    names = own.groupBy("label").agg(F.min("least").alias("name"))
    named = own.join(names, "label").select("digest", "name", F.lit(True).alias("found"))
    out = signatures.select("id", "n", "digest").join(named, "digest", "left")
    component = F.expr("if(found, name, id)")
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
