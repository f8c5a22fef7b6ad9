"""Document quality by supervised subword embeddings.

A word's features are itself and its character n-grams, hashed into a table of learned vectors.  Words lie between white space;
a comma or full stop begins one.  A word that equals one of the two before it also counts once more as the word AGAIN, whose
vector learns what repetition says whichever word repeats.  A document is the mean of its words' vectors, and a softmax layer over it gives the label's probability.  Vectors and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents.  Since the layer is linear, scoring needs one number per
feature: the difference of the two logits that the feature's vector makes.  Each distinct word is scored once per worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchlake.llm.common import WORDS_KEPT, cut, filled, share_of

BUCKETS = 1 << 17
DIMENSION = 16
GRAMS = (2, 3, 4)
AGAIN = "\x00again"
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio, odd
CHUNK = 20_000  # words hashed at a time
CHARACTERS = 1 << 18  # characters hashed at a time
KEPT_CHARACTERS = 200  # longer words are scored anew in each batch
# White space but spaces and line ends.
OTHER_SPACE = r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def grams(marked: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts, or those that begin at the first ``starts`` characters: whose each is, and its bucket."""
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(codes))  # characters from here to the word's end
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(left[:starts] >= n)
        hash = np.full(len(at), n, np.uint64)
        for k in range(n):
            hash = (hash ^ codes[at + k]) * MIX
            hash ^= hash >> np.uint64(29)
        owners.append(owner[at])
        buckets.append((hash % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def features(words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Features of all words in parts: the words from a first one to before a last, whose of them each is, and its bucket.

    A word has itself and each of its character n-grams, its ends marked.  A part has at most CHUNK words and CHARACTERS
    characters; a longer word is spread over several parts.
    """
    sizes = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))])
    first = 0
    while first < len(words):
        last = max(first + 1, min(first + CHUNK, int(np.searchsorted(sizes, sizes[first] + CHARACTERS, "right")) - 1))
        own = words[first:last]
        itself = np.fromiter((zlib.crc32(b"w" + w.encode()) % BUCKETS for w in own), np.int64, len(own))
        if sizes[last] - sizes[first] <= CHARACTERS:
            owner, bucket = grams(["" if w == AGAIN else f"<{w}>" for w in own])
            yield first, last, np.concatenate([np.arange(len(own)), owner]), np.concatenate([itself, bucket])
        else:
            yield first, last, np.zeros(1, np.int64), itself
            marked = f"<{own[0]}>"
            for k in range(0, len(marked), CHARACTERS):
                yield first, last, *grams([marked[k : k + CHARACTERS + GRAMS[-1] - 1]], CHARACTERS)
        first = last


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and for each occurrence its word and its text."""
    words, picks, counts = cut(pc.replace_substring_regex(filled(texts), OTHER_SPACE, " "), "", "")
    text = np.repeat(np.arange(len(counts)), counts)
    if "" in words:
        real = picks != words.index("")
        picks, text = picks[real], text[real]
    again = np.zeros(len(picks), bool)
    for back in (1, 2):
        again[back:] |= (picks[back:] == picks[:-back]) & (text[back:] == text[:-back])
    return [*words, AGAIN], np.concatenate([picks, np.full(int(again.sum()), len(words))]), np.concatenate([text, text[again]])


@dataclass
class QualityModel:
    """A logit per feature bucket, averaged over a word's features and a document's words, and a bias."""

    logits: np.ndarray
    bias: float

    def scorer(self):
        known: dict[str, float] = {}

        def score(texts: pa.Array) -> np.ndarray:
            words, picks, text = words_of(texts)
            if len(known) > WORDS_KEPT:
                known.clear()
            new = [word for word in words if word not in known]
            sums, counts = np.zeros(len(new)), np.zeros(len(new))
            for first, last, owner, bucket in features(new):
                sums[first:last] += np.bincount(owner, self.logits[bucket], last - first)
                counts[first:last] += np.bincount(owner, minlength=last - first)
            known.update(zip(new, (sums / counts).tolist(), strict=True))
            worth = np.fromiter(map(known.__getitem__, words), float, len(words))
            for word in new:
                if len(word) > KEPT_CHARACTERS:
                    del known[word]
            size = np.bincount(text, minlength=len(texts))
            total = np.bincount(text, worth[picks], len(texts)) / np.maximum(size, 1)
            return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -500, 500)))

        return score


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 11) -> QualityModel:
    """Fit the embeddings and the softmax layer; without both labels, the score is the label's share everywhere."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return QualityModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    words, picks, owner = words_of(pa.array(texts, pa.string()))
    pieces, sizes = [], np.zeros(len(words), np.int64)  # all words' features end up in one piece: small objects would cost the driver many times more
    for first, last, mine, bucket in features(words):
        pieces.append(bucket[np.argsort(mine, kind="stable")].astype(np.int32))
        sizes[first:last] += np.bincount(mine, minlength=last - first)
    hashed, starts = np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])
    rows, weights = [], []
    for own in np.split(picks[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]):
        distinct, times = np.unique(own, return_counts=True)
        size = starts[distinct + 1] - starts[distinct]
        at = np.repeat(starts[distinct] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        buckets, inverse = np.unique(hashed[at], return_inverse=True)
        rows.append(buckets)
        weights.append(np.bincount(inverse, np.repeat(times / max(len(own), 1) / np.maximum(size, 1), size), len(buckets)).astype(np.float32))
    del words, picks, owner, hashed, pieces, sizes
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIMENSION, 2)), np.zeros(2)
    steps, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        for picked in np.array_split(rng.permutation(len(texts)), -(-len(texts) // batch)):
            lr = rate * (1 - step / steps)
            step += 1
            hidden = np.stack([weights[i] @ vectors[rows[i]] for i in picked])
            out = hidden @ layer + bias
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1
            back = p @ layer.T
            layer -= lr * hidden.T @ p / len(picked) * 4
            bias -= lr * p.mean(0)
            for i, g in zip(picked, back, strict=True):
                # A document's mean spreads its gradient thinly, so vectors take a larger rate.
                vectors[rows[i]] -= 40 * lr * np.outer(weights[i], g)
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(rows: DataFrame, *, text: str = "text", label: str = "quality", order: str = "doc_id", sample: int = 2000) -> QualityModel:
    """Train on at most ``sample`` labelled rows, those with the smallest hash of their id; null labels and texts are passed over.

    The sample is one task's, which trains on it; the driver gets the finished model.
    """
    own = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("int").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(order).cast("string"), F.lit(5)).alias("h")
    )
    n = own.count()
    picked = own.where(share_of(F.col("h"), 1.2 * sample / max(n, 1))).orderBy("h", "text").limit(sample)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_pylist()) for batch in batches]
        if held:
            model = train([t for _, texts in held for t in texts], np.clip(np.concatenate([labels for labels, _ in held]), 0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([model.logits.tobytes()]), pa.array([model.bias])], ["logits", "bias"])

    # The limit leaves one partition; saying so costs nothing and holds whatever the plan.
    found = picked.select("label", "text").coalesce(1).mapInArrow(trained, "logits binary, bias double").first()
    return QualityModel(np.frombuffer(found["logits"], np.float32), found["bias"]) if found else train([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on).

    Null, empty and wordless texts get the bias alone.  Only the text decides; repeated rows get repeated results; columns named like
    the new ones are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number per feature bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.scorer()
        for batch in batches:
            p = own(batch.column(batch.schema.get_field_index(text)))
            columns = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(scored, StructType(list(docs.schema)).add("score", "double").add("predicted", "integer"))
