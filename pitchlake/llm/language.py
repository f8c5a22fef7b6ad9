"""Language identification by compression.

Each language has a zstandard raw-content dictionary: sample texts that the compressor may refer back to.  A text is cut into pieces of
equal length, each is compressed with every dictionary, and the language with the smallest total wins: shared words and
endings are cheap only in their own language; case is folded.  Pieces keep the dictionary in play through long texts.  Where the best two are
closer than a share of the best, the text is rejected: the label stands, marked as not to be trusted.

Dictionaries are fitted on a bounded sample: ``sample`` texts a language at most, those with the smallest hash of their id, and
``dictionary_bytes`` of their beginnings in equal parts.  The driver holds the dictionaries only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchlake.llm.common import share_of

UNKNOWN = "und"
PIECE_BYTES = 4096
LEVEL = 6


@dataclass
class LanguageModel:
    """Raw-content dictionaries by language, the most frequent language first."""

    contents: dict[str, bytes]

    def __getstate__(self) -> dict:
        return {"contents": self.contents}

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        own = []
        for content in self.contents.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            own.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return own

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary."""
        raw = text.lower().encode()
        parts = [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], np.int64)

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score and rejection of one text."""
        if not self.contents or text is None or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return next(iter(self.contents)), 1.0, False
        second = int(np.partition(sizes, 1)[1])
        gap = 1.0 - sizes[best] / second
        return list(self.contents)[best], float(min(1.0, 0.5 + 5 * gap)), bool(gap < margin)


def beginnings(texts: list[bytes], total: int) -> list[bytes]:
    """As much of each text's beginning, the same for all longer ones, as fits ``total`` with a byte between two."""
    sizes, room, each = sorted(map(len, texts)), total - len(texts) + 1, 0
    for k, size in enumerate(sizes):  # shorter texts leave their room to longer ones
        each = max(0, room) // (len(sizes) - k)
        if size > each:
            break
        each, room = size, room - size
    return [t[:each] for t in texts]


def fit(rows: DataFrame, *, text: str = "text", label: str = "lang", order: str = "doc_id", sample: int = 400, dictionary_bytes: int = 64 << 10) -> LanguageModel:
    """Dictionaries from labelled rows; rows without a label or text are passed over, equal texts count once each row.

    The sample is thinned by a hash before it is ranked, so no task ranks more than some times ``sample`` rows of a language.
    """
    own = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(order).cast("string"), F.lit(7)).alias("h")
    )
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return LanguageModel({})
    shares = [(F.col("lang") == lang) & share_of(F.col("h"), 4 * sample / n) for lang, n in counts.items()]
    thin = own.where(reduce(or_, shares))
    ranked = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= sample)
    texts = ranked.select("lang", "k", F.substring("text", 1, dictionary_bytes).alias("text")).orderBy("lang", "k").collect()
    contents = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        whole = [r["text"].lower().encode() for r in texts if r["lang"] == lang]
        contents[lang] = b"\n".join(beginnings(whole, dictionary_bytes))
    return LanguageModel(contents)


def predict(docs: DataFrame, model: LanguageModel, *, margin: float = 0.01, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Null texts, and texts without a letter, are ``und`` with score 0, and rejected; so is everything if nothing was learned.  Ties go to
    the language with more learned rows.  The margin holds at every size: where it is less
    than a byte, a tie is rejected.  Only the text decides; repeated rows get repeated results; columns named
    like the new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionary_bytes per language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [shared.value.predict(t, margin) for t in texts]
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(label, schema)
