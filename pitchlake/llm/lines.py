"""Repeated runs of lines: a suffix order over line ids by prefix doubling, and removal of every copy but the first.

The corpus is one sequence of lines, document after document in id order; blank lines are passed over and no run
crosses a document.  Round t ranks every start by its first 2**t lines: the pair of ranks at the start and 2**t lines on is
counted, pairs are put in order, and a pair's new rank is the number of starts with a smaller one, which is the start's
place in the suffix array as far as that prefix tells.  Starts with equal rank are an interval of common prefix of at least
that many lines; its smallest position is the first copy.  Starts alone in their interval are settled and leave.

A run counts from ``min_words`` words.  The shortest such run from each line on, and the shortest up to each line, have at most that
many lines, so doubling ends at that depth; two overlapping ranks of one level give a run's class, and where the class
began earlier the run is a later copy.  A maximal repeated run is the union of the shortest ones from and up to its lines, so every line of
it goes.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import prefix_sums, stored


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Lines with words: their document and its place (the position of its first line), ``q`` (place among them), words, digests."""
    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    own = own.withColumn("hash", F.xxhash64("text"))
    starts = prefix_sums(
        own.select("id", "hash", F.size(F.split("text", "\n")).alias("n")).distinct(), ["id", "hash"], "n", before="doc", position="_p"
    ).drop("_p", "n")
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line"), line.alias("text")))
    lines = own.select("id", "hash", F.posexplode(F.filter(numbered, lambda x: x["text"].rlike(r"\S"))).alias("q", "x"))
    content = F.col("x.text").cast("binary")
    lines = lines.select(
        "id", "hash", "q", F.col("x.line").alias("line"), F.xxhash64(content).alias("key1"), F.xxhash64(F.lit(1), content).alias("key2"),
        F.size(F.split(F.trim(F.regexp_replace("x.text", r"\s+", " ")), " ")).alias("words"),
    ).distinct()
    same = lines["id"].eqNullSafe(starts["id"]) & (lines["hash"] == starts["hash"])
    return stored(lines.join(starts, same).select(lines["id"], lines["hash"], "doc", "q", "line", "words", "key1", "key2"), "lines")


def _ranked(starts: DataFrame, by: list[str], label: str) -> DataFrame:
    """Starts that share ``by`` with another: with ``rank`` in its order and ``first``, the smallest position of the class."""
    classes = starts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc") + F.col("q")).alias("first")).where("n > 1")
    ranks = prefix_sums(classes, by, "n", before="place", position="_p")
    return stored(starts.join(ranks, by).select("doc", "q", F.col("place").alias("rank"), "first"), label)


def later_copies(docs: DataFrame, *, min_words: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``hash`` of a document's text, and ``line``, of every line to delete."""
    lines = _lines(docs, id, text)
    nearest = Window.partitionBy("doc").orderBy("q")
    ahead, behind = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in reversed(range(min_words)):  # every line has a word, so that many lines suffice
        ahead = F.when(F.sum("words").over(nearest.rowsBetween(0, k)) >= min_words, F.lit(k + 1)).otherwise(ahead)
        behind = F.when(F.sum("words").over(nearest.rowsBetween(-k, 0)) >= min_words, F.lit(k + 1)).otherwise(behind)
    reach = lines.select("doc", "q", ahead.alias("ahead"), behind.alias("behind"))
    ends = F.array(F.struct("q", F.col("ahead").alias("length")), F.struct((F.col("q") - F.col("behind") + 1).alias("q"), F.col("behind").alias("length")))
    runs = stored(reach.select("doc", F.inline(ends)).where("length is not null").distinct(), "runs")
    deepest = runs.agg(F.max("length")).first()[0] or 0
    level, width, gone = _ranked(lines.select("doc", "q", "key1", "key2"), ["key1", "key2"], "ranks"), 1, []
    while width <= deepest:
        here = runs.where(F.col("length").between(width, 2 * width - 1))
        last = level.select("doc", F.col("q").alias("q_last"), F.col("rank").alias("rank_last"))
        both = here.join(level.select("doc", "q", "rank"), ["doc", "q"]).withColumn("q_last", F.col("q") + F.col("length") - width)
        both = stored(both.join(last, ["doc", "q_last"]).select("doc", "q", "length", "rank", "rank_last"), "starts")
        firsts = stored(both.groupBy("length", "rank", "rank_last").agg(F.min(F.col("doc") + F.col("q")).alias("first")), "firsts")
        # Each level is settled and stored at once: as parts of one plan, the joins of all levels would run side by side and fill the driver.
        later = both.join(firsts, ["length", "rank", "rank_last"]).where(F.col("doc") + F.col("q") > F.col("first"))
        gone.append(stored(later.select("doc", "q", "length"), "gone"))
        if 2 * width > deepest:
            break
        next_ = level.select("doc", (F.col("q") - width).alias("q"), F.col("rank").alias("rank_next"))
        level = _ranked(level.select("doc", "q", "rank").join(next_, ["doc", "q"]), ["rank", "rank_next"], "ranks")
        width *= 2
    if not gone:
        return lines.select("id", "hash", "line").limit(0)
    found = gone[0]
    for more in gone[1:]:
        found = found.unionByName(more)
    covered = found.select("doc", F.explode(F.expr("sequence(q, q + length - 1)")).alias("q")).distinct()
    return covered.join(lines, ["doc", "q"]).select("id", "hash", "line")


def drop_repeated_lines(docs: DataFrame, *, min_words: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without lines that belong to a later copy of a run, and ``n_removed``, the number of lines deleted.

    All other columns stay (one named ``n_removed`` is replaced), and so do all rows: a document may lose all its text.  Null
    texts stay null with 0 removed, empty ones empty.  Null ids come first in the order of copies, equal ids are told apart by
    their texts, and rows that repeat both are one document: they share its outcome.  Lines are equal if their bytes are (by
    two 64-bit hashes); lines end at a line feed.
    """
    gone = later_copies(docs, min_words=min_words, id=id, text=text)
    gone = gone.groupBy("id", "hash").agg(F.collect_set("line").alias("_gone"))  # as many as a document has lines
    own = docs.drop("n_removed").withColumn("_hash", F.xxhash64(F.col(text).cast("string")))
    joined = own.join(gone, own[id].eqNullSafe(gone["id"]) & (own["_hash"] == gone["hash"]), "left").drop(gone["id"], gone["hash"])
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return (
        joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left))
        .withColumn("n_removed", F.coalesce(F.size(F.col("_gone")), F.lit(0)).cast("long"))
        .drop("_gone", "_hash")
    )
