"""From documents to packed training sequences: language, quality, repeated lines, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next.  Models learn
from the table ``documents`` and its labels, the decisions are made on what the stage before has kept.

Every stage gives no rows for no rows.  The first four return the columns of documents and drop any others, whatever their names; rows are
judged one by one, so equal rows share their fate and null ids are kept like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import language, lines, minhash, packing, quality, registry
from pitchlake.llm.common import documents, in_buckets, prepare, release, stored, without_broadcasts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ready(spark: SparkSession) -> SparkSession:
    """The session for a stage of one long application: no automatic broadcasts, and what the stage before left in the driver let go."""
    without_broadcasts(prepare(spark))
    release(spark)
    return spark


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without a letter (null and empty texts among them) and exact ties go too."""
    ready(spark)
    model = language.fit(documents(spark, sf_dir).where(in_buckets("doc_id") != 0))
    return language.predict(docs, model).where("not rejected").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1; null, empty and wordless texts are judged by the bias alone."""
    ready(spark)
    model = quality.fit(registry.labelled(spark, sf_dir))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of lines; n_chars follows the text and is null for a null text, which stays."""
    ready(spark)
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one with the smallest id.

    Null, empty and wordless texts are linked with nothing and stay.  Rows that repeat an id are one document and stay together, null ids included.
    """
    ready(spark)
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens; a null or empty text is its end id alone, rows that repeat are packed each."""
    ready(spark)
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.drop("ids"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", first_of_near_copies),
    ("packing", packed_sequences),
]

# Compression, learned vectors and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
