"""Piece encoding by backtracking: exact ids of a merge-type SentencePiece model, and their decoding.

A merge encoder joins the best-scored adjacent pair until nothing joins.  Its result is the only sequence of pieces in
which every adjacent pair, re-merged on its own, stays that pair.  So instead of merging the text, the encoder walks
it: at each position it tries the longest piece first (all matches come from one Aho-Corasick pass), accepts a piece if it
stays apart from its predecessor, and steps back when no piece fits, noting the position in a bitfield of dead ones.

Pieces hold the word mark only at their start and never mix Latin letters with other characters unless the model has
such pieces, so the text is cut there first; each distinct cut is encoded once per worker while its table lasts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import WordTable, encode_texts, filled

MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PAIRS_KEPT = 400_000


class PieceEncoder:
    """Encodes and decodes with the model in ``path``, a file every executor has."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.known: set[str] = set()
        self.bytes = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[piece], self.id_of[piece] = model.get_score(i), i
        self.end = model.eos_id()
        matcher = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            matcher.add_word(piece, (len(piece), i, piece))
        for c in {c for p in self.rank for c in p} - self.rank.keys():
            matcher.add_word(c, (1, -1, c))  # a character that occurs in pieces only: a symbol without an id
        matcher.make_automaton()
        self.matcher = matcher
        self.letters = {c for p in self.rank for c in p}
        self.cut = self._cuts()
        self.fits: dict[tuple[str, str], bool] = {}
        self.words = WordTable(self.encode_words)
        self.plain = f"{_LATIN}" in self.cut.pattern and model.normalize("a b") == f"{MARK}a{MARK}b"

    def _cuts(self) -> re.Pattern:
        """Where no piece of this model can cross."""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            return re.compile(r"(?s).+")
        if any("\n" in p for p in self.rank):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        if any(re.search(f"[{_LATIN}][^{_LATIN}]|[^{_LATIN}{MARK}][{_LATIN}]", p) for p in self.rank):
            return re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        return re.compile(f"{MARK}*[{_LATIN}]+|{MARK}*[^{MARK}\n{_LATIN}]+|{MARK}+|\n")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        """Whether two adjacent pieces survive merging; an empty left asks for the right one alone."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def walk(self, text: str) -> list[tuple[int, str]]:
        """The pieces of a text whose characters the model has all."""
        n = len(text)
        at: list[list] = [[] for _ in range(n)]
        for end, match in self.matcher.iter(text):
            at[end - match[0] + 1].append(match)  # shorter ones come first
        path: list[tuple[int, int, str, int]] = []  # start, choice, piece, id
        dead, position, choice, left = 0, 0, len(at[0]) - 1, ""
        while True:
            while choice >= 0:
                length, i, piece = at[position][choice]
                if not dead >> (position + length) & 1 and self.stays(left, piece):
                    break
                choice -= 1
            if choice >= 0:
                path.append((position, choice, piece, i))
                position, left = position + length, piece
                if position == n:
                    return [(i, piece) for _, _, piece, i in path]
                choice = len(at[position]) - 1
            else:
                dead |= 1 << position
                position, choice, _, _ = path.pop()
                choice -= 1
                left = path[-1][2] if path else ""

    def encode_word(self, word: str) -> list[int]:
        if self.letters.issuperset(word):
            return self._ids(word) if word else []
        ids: list[int] = []
        for known, run in groupby(word, self.letters.__contains__):  # a character the model lacks stands alone
            ids += self._ids("".join(run)) if known else [i for c in run for i in self._unknown(c)]
        return ids

    def _ids(self, text: str) -> list[int]:
        return [j for i, piece in self.walk(text) for j in ([i] if i >= 0 else self._unknown(piece))]

    def _unknown(self, character: str) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in character.encode()]
        return [self.model.unk_id()]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.encode_word(w) for w in words]

    def split(self, text: str) -> list[str]:
        """The normalised text in cuts; the library's own normaliser escapes spaces and adds the leading mark."""
        return self.cut.findall(self.model.normalize(text)) if text else []

    def _other(self, text: str) -> np.ndarray:
        return self.words.lookup(self.split(text))[0]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids per text, without an end id."""
        texts = filled(texts)
        if self.plain:  # the word marks are put in here, so only the first cut lacks its own
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(MARK, texts, ""))
            ids, ends = encode_texts(texts, self.words, MARK, "\n", lambda text: self._other(text[1:]))
            found = np.split(ids, ends[:-1]) if len(ends) else []
        else:
            found = [self._other(text) for text in texts.to_pylist()]
        if self.bytes:
            return found
        unknown = self.model.unk_id()  # without bytes, the library joins neighbouring unknown characters
        return [x[~((x == unknown) & (np.concatenate([[-1], x[:-1]]) == unknown))] if len(x) else x for x in found]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def piece_ids(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``ids`` (array of int, with the end id) and ``decoded`` text of every row.

    Null and empty texts have the end id alone and decode to nothing; repeated rows give repeated results; ids may be
    null; other columns are not read.  A row's text is held whole by the task that encodes it, nothing else is.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            found = [[*x.tolist(), own.end] for x in own.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([own.decode(x) for x in found], pa.string())],
                ["id", "ids", "decoded"],
            )

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id)


def piece_digests(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``piece_ids``, with digests in place of the ids and the decoded text, so that neither leaves the Python worker."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        names = np.array([str(i) for i in range(own.model.get_piece_size())], object)
        for batch in batches:
            found = own.encode(batch.column(1))
            rows = [(len(x) + 1, " ".join([*names[x], str(own.end)]), own.decode([*x.tolist(), own.end])) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, _, decoded in rows], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return out.mapInArrow(digest, schema).withColumnRenamed("id", id)
