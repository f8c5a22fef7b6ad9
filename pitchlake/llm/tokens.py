"""Token ids from files of the tokenizers library, each distinct piece of text encoded once per worker.

The library splits text before it merges, and no split ever depends on what lies beyond a boundary between a word
and a single space.  Cutting there and encoding the distinct cuts gives the same ids as encoding the text.  The two cuts
below say when that holds; any other text goes to the library whole.  Most texts are even enough for ``common.cut``.
A cut of Latin letters alone is one word to every splitter here, so the library's merges take it directly, without its splitter.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pitchlake.llm.common import WordTable, encode_texts, filled

_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_SPACED = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
# Composed letters; lower-casing leaves those of the second line as they are.
_CAPITALS = "A-ZÀ-ÖØ-Þ"
_SMALL = "a-zß-öø-ÿ"
_MARKED = re.compile(r"[^a-zA-Z0-9À-ÖØ-öø-ÿ \n][.,]")


def spaced_cuts(text: str) -> list[str] | None:
    """Cuts for splitters that give a word its one leading space; None if the text has other white space."""
    return None if _OTHER_SPACE.search(text) else _SPACED.findall(text)


def bare_cuts(text: str) -> list[str] | None:
    """Cuts for lower-casing splitters that drop white space.

    A comma or full stop starts a new match after a letter or digit, so it is cut off too, unless some comma or full stop in the
    text follows anything else and might belong to a longer run of marks.
    """
    if not _MARKED.search(text):
        text = text.replace(",", " ,").replace(".", " .")
    return [word for word in text.replace("\n", " ").split(" ") if word]


class TokenEncoder:
    """Ids of whole texts as the library gives them, with none added; a text that holds an added token's string goes to it whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        splits = json.dumps(layout["pre_tokenizer"])
        if layout["normalizer"] is None and '"use_regex": true' in splits and '"add_prefix_space": false' in splits:
            self.cuts, self.space, self.line, plain = spaced_cuts, " ", "\n", f" ?[{_CAPITALS}{_SMALL}]+"
        elif "Lowercase" in json.dumps(layout["normalizer"]) and '"behavior": "Removed"' in splits:
            self.cuts, self.space, self.line, plain = bare_cuts, "", "", f"[{_SMALL}]+"
        else:
            raise ValueError(f"{path}: no cut is known to be safe for this splitter")
        self.added = "|".join(re.escape(token["content"]) for token in layout["added_tokens"])
        # Added tokens are found before a text is split, so none may lie within letters.
        direct = "ByteLevel" in splits and not any(token["content"].strip().isalpha() for token in layout["added_tokens"])
        self.plain = re.compile(plain if direct else r"(?!)")
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {n: spell(chr(n))[0][0] for n in range(256) if re.fullmatch(f"[ {_CAPITALS}{_SMALL}]", chr(n))}
        self.words = WordTable(self._whole)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        plain, merge, spelling = self.plain.fullmatch, self.library.model.tokenize, self.spelling
        found = [[t.id for t in merge(text.translate(spelling))] if plain(text) else None for text in texts]
        others = iter(self.library.encode_batch_fast([x for x, ids in zip(texts, found, strict=True) if ids is None], add_special_tokens=False))
        return [next(others).ids if ids is None else ids for ids in found]

    def _other(self, text: str) -> np.ndarray:
        cuts = self.cuts(text)
        return np.asarray(self._whole([text])[0], np.int32) if cuts is None else self.words.lookup(cuts)[0]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by ``end``, and the number of ids of each text with it."""
        texts = filled(texts)
        # Some spell them otherwise; the library knows which count.
        special = pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if special.any():
            return self._with_added(texts, special, end)
        return self._without_added(texts, end)

    def _with_added(self, texts: pa.Array, special: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self._without_added(texts.filter(pa.array(~special)), end)
        others = iter(np.split(ids, np.cumsum(counts)[:-1]))
        encode = self.library.encode
        parts = [
            np.array([*encode(texts[k].as_py(), add_special_tokens=False).ids, end], np.int32) if special[k] else next(others)
            for k in range(len(texts))
        ]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _without_added(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.space:
            texts = pc.ascii_lower(texts)  # one entry for all cases of a word; other letters are left to the library
        ids, ends = encode_texts(texts, self.words, self.space, self.line, self._other)
        return np.insert(ids, ends, end), np.diff(ends, prepend=0) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> TokenEncoder:
    return TokenEncoder(path)
