"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimension sampling.

Vectors are scaled to length one and rotated at random, so that any leading columns are a fair sample of all.  A list is scanned
block of columns by block of columns: after d of D columns the distance seen so far, scaled by D/d, is tested against the k-th best
so far, and a candidate whose distance is larger beyond what chance allows is abandoned.  Survivors are scored exactly on the original vectors.

Centroids are fitted on a bounded sample (``sample`` vectors with the smallest hash of their id); every row is indexed.  A list is
split into blocks of about BLOCK_ROWS candidates, and the queries that probe it into blocks too, so one task sees a bounded part of
a list however hot it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import share_of, stored

BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
COLUMNS = 16
CHUNK = 1024
CONFIDENCE = 2.1


@dataclass
class Lists:
    """Centroids and rotation; both are bounded by the number of lists and of dimensions."""

    centroids: np.ndarray
    rotation: np.ndarray

    def near(self, vectors: np.ndarray) -> np.ndarray:
        """Cosines with all centroids."""
        return units(vectors) @ self.centroids.T


def units(vectors: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of very large and very small ones in range.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit(vectors: np.ndarray, lists: int, *, rounds: int = 8, seed: int = 3) -> Lists:
    """Spherical k-means over distinct sample vectors."""
    rng = np.random.default_rng(seed)
    own = np.unique(units(vectors), axis=0)
    centroids = own[rng.choice(len(own), min(lists, len(own)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (own @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, own)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    rotation, _ = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))
    return Lists(centroids, rotation)


def scan(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` nearest candidates of each query, as query, candidate and cosine; a candidate with the query's id is passed over."""
    candidates, asked = units(vectors) @ rotation, units(queries) @ rotation
    norms = units(vectors), units(queries)
    dimension = candidates.shape[1]
    found = []
    for q in range(len(asked)):
        kept, near = np.zeros(0, np.int64), np.zeros(0)
        bound = np.inf
        for begin in range(0, len(ids), CHUNK):
            alive = np.arange(begin, min(begin + CHUNK, len(ids)))
            alive = alive[ids[alive] != query_ids[q]]
            seen = np.zeros(len(alive))
            for d in range(0, dimension, COLUMNS):
                part = candidates[alive, d : d + COLUMNS] - asked[q, d : d + COLUMNS]
                seen += (part * part).sum(axis=1)
                done = min(d + COLUMNS, dimension)
                slack = (1 + CONFIDENCE / np.sqrt(done)) ** 2 if done < dimension else 1.0
                stay = seen * (dimension / done) <= bound * slack + 1e-9  # equal ones stay
                alive, seen = alive[stay], seen[stay]
            kept, near = np.concatenate([kept, alive]), np.concatenate([near, seen])
            if len(kept) > k:
                bound = np.partition(near, k - 1)[k - 1]
                stay = near <= bound + 1e-9
                kept, near = kept[stay], near[stay]
        score = (norms[0][kept] * norms[1][q]).sum(axis=1)
        for j in np.lexsort((ids[kept], -score))[:k]:
            found.append((int(query_ids[q]), int(ids[kept[j]]), float(score[j])))
    return found


def valid(rows: DataFrame, vector: str, id: str) -> DataFrame:
    """``id`` and ``vector`` of rows whose vectors are whole and not zero."""
    own = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nearest(
    rows: DataFrame, queries: DataFrame, *, k: int = 5, lists: int = 64, probes: int = 40, sample: int = 20_000, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the nearest rows found for each query.

    Rows and queries without an id, or whose vector is null, all zero or holds a null or non-finite component, take no part, nor do
    vectors whose length is not the most frequent one among the rows (the larger of equals).  A query never finds rows with its own id.  Ties
    go to the smaller id; rows that repeat an id count each, repeated queries once.  Fewer than ``k`` rows come back only if there
    are fewer candidates.  Extra columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    own = valid(rows, vector, id)
    lengths = own.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    schema = "query_id long, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, alike = lengths["n"], F.size("vector") == lengths["length"]
    own = own.where(alike)
    part = own.where(share_of(F.xxhash64("id"), 1.3 * sample / n))
    drawn = part.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    if not len(drawn):
        drawn = own.limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    fitted = fit(drawn.flatten().to_numpy().reshape(len(drawn), -1), max(1, min(lists, n // 32)))
    shared = spark.sparkContext.broadcast(fitted)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = shared.value.near(matrix(batch.column(1))).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["id", "vector", "list"])

    index = stored(own.mapInArrow(assigned, "id long, vector array<double>, list int"), "lists")
    sizes = np.zeros(len(fitted.centroids), np.int64)
    for r in index.groupBy("list").count().collect():  # a row per list
        sizes[r["list"]] = r["count"]

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-shared.value.near(matrix(batch.column(1))), axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) - sizes[order] <= k  # more lists while these hold too few
            take = enough | (np.arange(order.shape[1]) < probes)
            at, which = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(at)) for c in batch.columns], pa.array(order[at, which].astype(np.int32))], ["id", "vector", "list"]
            )

    wanted = valid(queries, vector, id).where(alike).dropDuplicates(["id"])
    asked = stored(wanted.mapInArrow(probing, "id long, vector array<double>, list int"), "probes")
    counts = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row per list
    number = lambda of: F.element_at(F.create_map(*[F.lit(int(x)) for pair in of for x in pair]), F.col("list"))
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = number((j, max(1, -(-int(size) // BLOCK_ROWS))) for j, size in enumerate(sizes))
    groups = number((j, -(-counts.get(j, 1) // BLOCK_QUERIES)) for j in range(len(sizes)))
    # A candidate meets every block of queries, and a query every block of candidates, of its list.
    left = index.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), blocks)).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), groups.cast("long") - 1)))
    right = asked.withColumn("g", F.pmod(F.xxhash64("id", F.lit(2)), groups)).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))

    def search(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        ids, vectors = candidates["id"].to_numpy(), candidates["vector"].combine_chunks()
        question_ids, own = questions["id"].to_numpy(), questions["vector"].combine_chunks()
        found = scan(ids, matrix(vectors), question_ids, matrix(own), shared.value.rotation, k) if len(ids) and len(question_ids) else []
        return pa.Table.from_pandas(pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

    keys = ["list", "b", "g"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
