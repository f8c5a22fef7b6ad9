"""The five best candidates of a question at any score: a bound index over names, and a black-box scorer without one.

No token may be required of a near name, so nothing can be blocked on.  Instead every distinct name lies in a tile (its length band and which
of some common letters it has), and a tile carries one summary: its shortest and longest name and, letter by letter, the most any of its names
has.  From these follows an upper bound of the similarity of any name of the tile to a question.

A question first visits the tiles of the highest bounds, as many as hold a few hundred entities.  Its fifth score there is a floor: only tiles whose
bound reaches it are visited after that, and within a tile only names whose own bound does.  Both visits are joins on the tile, dealt in blocks
of bounded size.  Summaries are at most 8,192 a type, whatever the number of names, and types are a closed vocabulary.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from difflib import SequenceMatcher
from typing import Any, NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.session import ensure_checkpoint_dir
from pitchlake.vocab import ENTITY_TYPES

# Decision thresholds and attribute weights (fixed values).
AUTO_MATCH, AMBIGUITY_MARGIN, REVIEW_FLOOR = 0.92, 0.08, 0.65
BIRTH_MATCH, BIRTH_CONFLICT = 0.06, -0.20
COUNTRY_MATCH, COUNTRY_CONFLICT = 0.02, -0.04
TOP = 5

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
SIGNATURE = "eaionrtls"  # letters whose presence tells names apart best, the most frequent first
BAND, BANDS = 3, 16
TILES_PER_TYPE = BANDS << len(SIGNATURE)
TILE_NAMES = 16
FIRST_ENTITIES = 256  # held by the tiles visited first; fewer give a lower floor
BLOCK_NAMES, BLOCK_QUESTIONS = 2_000, 2_000
PAIRS_KEPT = 200_000
_CODES = np.full(256, -1, np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def similarity(request_name: str, candidate_name: str) -> float:
    """Ratcliff-Obershelp ratio; the order of arguments matters."""
    return SequenceMatcher(None, request_name, candidate_name).ratio()


# --- Scorers -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Question:
    """What is asked, its name in matching form."""

    entity_type: str
    name: str
    as_of: datetime
    birth_date: date | None
    country_code: str | None


@dataclass(frozen=True)
class Candidate:
    """An entity with the names, in matching form, that hold at the question's instant."""

    entity_id: Any
    entity_type: str
    names: tuple[str, ...]
    birth_date: date | None
    country_code: str | None


class Score(NamedTuple):
    score: float
    name_score: float
    reasons: Sequence[str]


class CandidateScorer(Protocol):
    """Replaces the scores of all candidates, those of exact names included; it must give equal results for equal arguments."""

    def score(self, question: Question, candidate: Candidate) -> Score: ...


@dataclass(frozen=True)
class NameScorer:
    """The standard attribute steps over another similarity of names."""

    pair_score: Callable[[str, str], float]

    def score(self, question: Question, candidate: Candidate) -> Score:
        name_score = score = max(self.pair_score(question.name, name) for name in candidate.names)
        reasons = [f"name={name_score:.3f}"]
        if question.birth_date is not None and candidate.birth_date is not None:
            same = question.birth_date == candidate.birth_date
            score = min(1.0, score + BIRTH_MATCH) if same else max(0.0, score + BIRTH_CONFLICT)
            reasons.append("birth_date=match" if same else "birth_date=conflict")
        if question.country_code is not None and candidate.country_code is not None:
            same = question.country_code.upper() == candidate.country_code.upper()
            score = min(1.0, score + COUNTRY_MATCH) if same else max(0.0, score + COUNTRY_CONFLICT)
            reasons.append("country=match" if same else "country=conflict")
        return Score(score, name_score, reasons)


def _entities(names: DataFrame) -> DataFrame:
    """One row per entity with all its names and when they hold."""
    own = F.struct("name", "valid_from", "valid_until")
    about = F.struct("birth_date", "country_code")
    rows = names.groupBy("entity_type", "entity_id").agg(F.min(about).alias("about"), F.sort_array(F.collect_set(own)).alias("names"))
    return rows.select("entity_type", "entity_id", "about.*", "names")


def _none(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)) else value


def _scores(scorer: CandidateScorer, question: dict, entities: Sequence[dict]) -> list[tuple]:
    """The five best of some entities for one question, as rows."""
    at = question["as_of"]
    asked = Question(
        question["entity_type"], question["normalized_name"], at, _none(question["birth_date"]), _none(question["country_code"])
    )
    found = []
    for e in entities:
        valid = [
            n["name"] for n in e["names"]
            if (_none(n["valid_from"]) is None or at >= n["valid_from"]) and (_none(n["valid_until"]) is None or at < n["valid_until"])
        ]
        own = Candidate(e["entity_id"], asked.entity_type, tuple(valid), _none(e["birth_date"]), _none(e["country_code"]))
        s = scorer.score(asked, own)
        found.append((question["_question"], e["entity_id"], float(s.score), float(s.name_score), list(s.reasons)))
    return heapq.nsmallest(TOP, found, key=lambda row: (-row[2], row[1]))


def _scored_schema(names: DataFrame) -> str:
    return f"_question string, _entity {names.schema['entity_id'].dataType.simpleString()}, score double, name_score double, reasons array<string>"


def _dealt(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: Sequence[str], right_id: Sequence[str], rows: tuple[int, int]):
    """Both sides with blocks ``_l`` and ``_r`` of about so many rows per key, each row in all blocks of the other side."""

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        return counted.select(*key, F.ceil(F.col("_n") / F.lit(size)).cast("int").alias(name))

    plan = blocks(left, rows[0], "_lefts").join(blocks(right, rows[1], "_rights"), list(key))

    def place(df: DataFrame, own_id: Sequence[str], own: str, of: str, other: str, others: str) -> DataFrame:
        placed = df.join(plan, list(key)).withColumn(own, F.pmod(F.xxhash64(*own_id), F.col(of)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_lefts", "_rights")

    return place(left, left_id, "_l", "_lefts", "_r", "_rights"), place(right, right_id, "_r", "_rights", "_l", "_lefts")


def black_box(questions: DataFrame, names: DataFrame, scorer: CandidateScorer, exact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The five best per question under a scorer, of its exact candidates (``exact``: ``_question``, ``entity_id``) and, without any, of all.

    Nothing bounds such a scorer, so a question without an exact candidate meets every entity of its type, in blocks that return five rows.
    """
    entities, schema = _entities(names), _scored_schema(names)
    columns = ["_question", "entity_type", "normalized_name", "as_of", "birth_date", "country_code"]
    about = F.struct("entity_id", "birth_date", "country_code", "names").alias("_about")
    pairs = exact.distinct().join(questions.select(*columns), "_question").join(entities.select("entity_type", "entity_id", about), ["entity_type", "entity_id"])

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for q in batch.to_dict("records") for r in _scores(scorer, q, [q["_about"]])]
            yield pd.DataFrame(rows, columns=["_question", "_entity", "score", "name_score", "reasons"])

    def block(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        entities = own.to_dict("records")
        rows = [r for q in asked.to_dict("records") for r in (_scores(scorer, q, entities) if entities else ())]
        return pd.DataFrame(rows, columns=["_question", "_entity", "score", "name_score", "reasons"], dtype=object)

    among_exact = pairs.drop("entity_id").mapInPandas(one_by_one, schema)
    rest = questions.select(*columns).join(exact.select("_question").distinct(), "_question", "left_anti")
    left, right = _dealt(rest, entities, ["entity_type"], ["_question"], ["entity_id"], (BLOCK_QUESTIONS, BLOCK_NAMES))
    cell = ["entity_type", "_l", "_r"]
    return among_exact, left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(block, schema)


# --- Bound index -------------------------------------------------------------------------------------


def letter_counts(names: Sequence[str]) -> np.ndarray:
    """How often each name has each letter of the alphabet of matching forms."""
    lengths = np.array([len(n) for n in names], np.int64)
    codes = _CODES[np.frombuffer("".join(names).encode("ascii"), np.uint8)]
    cells = np.repeat(np.arange(len(names)), lengths) * len(ALPHABET) + codes
    return np.bincount(cells, minlength=len(names) * len(ALPHABET)).reshape(len(names), len(ALPHABET))


def tile_of(name: Column, bits: int) -> Column:
    """Length band, then which of the first ``bits`` signature letters the name has."""
    tile = F.least(F.floor(F.length(name) / F.lit(BAND)), F.lit(BANDS - 1)).cast("int")
    for letter in SIGNATURE[:bits]:
        tile = tile * 2 + F.when(F.instr(name, letter) > 0, 1).otherwise(0)
    return tile


def tile_summaries(classes: DataFrame) -> DataFrame:
    """Per type and tile: shortest and longest name, most of each letter, entities whose names hold at any instant (five of a class at most)."""
    most = [F.max(F.length("name") - F.length(F.replace(F.col("name"), F.lit(c)))).alias(f"c{k}") for k, c in enumerate(ALPHABET)]
    always = F.col("valid_from").isNull() & F.col("valid_until").isNull()
    held = F.sum(F.when(always, F.size("entity_ids")).otherwise(0)).alias("entities")
    return classes.groupBy("entity_type", "tile").agg(F.min(F.length("name")).alias("low"), F.max(F.length("name")).alias("high"), held, *most)


@dataclass(frozen=True)
class Tiles:
    """The summaries of one type."""

    tile: np.ndarray
    low: np.ndarray
    high: np.ndarray
    entities: np.ndarray
    most: np.ndarray

    def bounds(self, name: str) -> np.ndarray:
        """An upper bound of the similarity of ``name`` to any name of each tile."""
        own = letter_counts([name])[0]
        shared = np.minimum(self.most, own).sum(axis=1)
        length = np.clip(shared, self.low, self.high)  # at which the ratio is largest
        total = length + len(name)
        return np.where(total == 0, 1.0, 2.0 * np.minimum(shared, length) / np.maximum(total, 1))

    def first(self, bounds: np.ndarray) -> np.ndarray:
        """Whether a tile is among those of the highest bounds that hold FIRST_ENTITIES together."""
        order = np.lexsort((self.tile, -bounds))
        before = np.cumsum(self.entities[order]) - self.entities[order]
        taken = np.zeros(len(order), bool)
        taken[order[before < FIRST_ENTITIES]] = True
        return taken


def _most_bonus(question: dict) -> float:
    return BIRTH_MATCH * (_none(question["birth_date"]) is not None) + COUNTRY_MATCH * (_none(question["country_code"]) is not None)


def tiles_by_type(summaries: DataFrame) -> dict[str, Tiles]:
    """The summaries in the driver: a few thousand rows a type, and the types are checked against the vocabulary."""
    rows = summaries.where(F.col("entity_type").isin(*ENTITY_TYPES)).toPandas()
    letters = [f"c{k}" for k in range(len(ALPHABET))]
    return {
        kind: Tiles(*(own[c].to_numpy(np.int64) for c in ("tile", "low", "high", "entities")), own[letters].to_numpy(np.int64))
        for kind, own in rows.groupby("entity_type")
    }


def visits(questions: DataFrame, tiles: dict[str, Tiles], first: bool) -> DataFrame:
    """Questions by the tiles they visit: the first ones, or all others whose bound reaches the question's ``_floor``."""
    shared = questions.sparkSession.sparkContext.broadcast(tiles)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, which = [], []
            known: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
            for row, q in enumerate(batch.to_dict("records")):
                own = shared.value.get(q["entity_type"])
                if own is None:
                    continue
                key = (q["entity_type"], q["normalized_name"])
                if key not in known:
                    bounds = own.bounds(q["normalized_name"])
                    known[key] = bounds, own.first(bounds)
                bounds, taken = known[key]
                if not first:
                    taken = ~taken & (np.minimum(1.0, bounds + _most_bonus(q)) + 1e-12 >= q["_floor"])
                picked = own.tile[taken]
                at.append(np.full(len(picked), row))
                which.append(picked)
            out = batch.iloc[np.concatenate(at) if at else []].copy()
            out["tile"] = np.concatenate(which).astype(np.int32) if which else np.zeros(0, np.int32)
            yield out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in questions.schema.fields)
    return questions.mapInPandas(choose, f"{types}, tile int")


def tile_best(questions: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
    """The five best entities of a block of classes for each question of a block, those under the question's floor left out."""
    names = tile["name"].unique().tolist()
    members: dict[str, list] = {name: [] for name in names}
    for name, birth, country, valid_from, valid_until, ids in zip(
        tile["name"], tile["birth_date"], tile["country_code"], tile["valid_from"], tile["valid_until"], tile["entity_ids"], strict=True
    ):
        members[name].append((_none(birth), _none(country), _none(valid_from), _none(valid_until), list(ids)))
    counts = letter_counts(names) if names else np.zeros((0, len(ALPHABET)), np.int64)
    lengths = counts.sum(axis=1)
    out, cache = [], {}
    ranked_for, visit, bounds = None, None, None
    for q in questions.sort_values("normalized_name").to_dict("records"):
        name, at, birth, country = q["normalized_name"], q["as_of"], _none(q["birth_date"]), _none(q["country_code"])
        if name != ranked_for:
            shared = np.minimum(counts, letter_counts([name])[0]).sum(axis=1)
            total = lengths + len(name)
            bounds = np.where(total == 0, 1.0, 2.0 * shared / np.maximum(total, 1))
            visit, ranked_for = np.argsort(-bounds, kind="stable"), name
        bonus, best, fifth = _most_bonus(q), {}, q["_floor"]
        for i in visit:
            if min(1.0, bounds[i] + bonus) + 1e-12 < fifth:
                break
            other = names[i]
            name_score = cache.get((name, other))
            if name_score is None:
                if len(cache) >= PAIRS_KEPT:
                    cache.clear()
                name_score = cache[name, other] = similarity(name, other)
            for other_birth, other_country, valid_from, valid_until, ids in members[other]:
                if (valid_from is not None and at < valid_from) or (valid_until is not None and at >= valid_until):
                    continue
                score = name_score
                if birth is not None and other_birth is not None:
                    score = min(1.0, score + BIRTH_MATCH) if birth == other_birth else max(0.0, score + BIRTH_CONFLICT)
                if country is not None and other_country is not None:
                    same = country.upper() == other_country.upper()
                    score = min(1.0, score + COUNTRY_MATCH) if same else max(0.0, score + COUNTRY_CONFLICT)
                if score + 1e-12 < fifth:
                    continue
                for entity in ids:
                    if entity not in best or (score, name_score) > best[entity][:2]:
                        best[entity] = (score, name_score, other_birth, other_country)
            if len(best) >= TOP:
                fifth = max(fifth, heapq.nlargest(TOP, (b[0] for b in best.values()))[-1])
        ranked = heapq.nsmallest(TOP, best.items(), key=lambda item: (-item[1][0], item[0]))
        out.extend((q["_question"], entity, *b) for entity, b in ranked)
    return pd.DataFrame(out, columns=["_question", "_entity", "_score", "_name_score", "_birth", "_country"], dtype=object)


def _met(asked: DataFrame, classes: DataFrame, class_id: Sequence[str]) -> DataFrame:
    """The best entities of each question in the tiles it visits, each with its best name."""
    left, right = _dealt(asked, classes, ["entity_type", "tile"], ["_question"], class_id, (BLOCK_QUESTIONS, BLOCK_NAMES))
    types = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    id_type = re.fullmatch(r"array<(.*)>", types["entity_ids"]).group(1)
    schema = (
        f"_question string, _entity {id_type}, _score double, _name_score double, _birth {types['birth_date']}, _country {types['country_code']}"
    )
    cell = ["entity_type", "tile", "_l", "_r"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(tile_best, schema)


def nearest(questions: DataFrame, classes: DataFrame, class_id: Sequence[str], stats: dict | None = None) -> DataFrame:
    """``_question``, ``_entity``, ``_name_score``, ``_birth``, ``_country``: at least the five best candidates of each question.

    ``stats`` receives the numbers of tiles, of questions, and of visits made by them.
    """
    ensure_checkpoint_dir(questions.sparkSession)
    classes = classes.checkpoint()
    n = classes.select("entity_type", "name").distinct().count()
    bits = min(len(SIGNATURE), max(0, math.ceil(math.log2(max(1, n) / (4 * TILE_NAMES)))))
    tiled = classes.withColumn("tile", tile_of(F.col("name"), bits))
    tiles = tiles_by_type(tile_summaries(tiled))
    asked = questions.withColumn("_floor", F.lit(-1.0)).checkpoint()
    # A row per question and tile visited first; what comes of it is read twice.
    near = _met(visits(asked, tiles, True), tiled, class_id).checkpoint()
    rank = F.row_number().over(Window.partitionBy("_question").orderBy(F.col("_score").desc(), "_entity"))
    best = near.groupBy("_question", "_entity").agg(F.max("_score").alias("_score")).withColumn("_rank", rank)
    floors = best.where(F.col("_rank") == TOP).select("_question", F.col("_score").alias("_reached"))
    floored = asked.join(floors, "_question", "left").withColumn("_floor", F.coalesce("_reached", F.lit(-1.0))).drop("_reached")
    further = visits(floored, tiles, False)
    if stats is not None:
        stats.update(tiles=sum(len(t.tile) for t in tiles.values()), questions=asked.count(), visits=visits(asked, tiles, True).count() + further.count())
    found = near.unionByName(_met(further, tiled, class_id))
    # An entity met under several names counts with its best one; its attributes come with that name's row.
    top = F.max(F.struct("_name_score", "_birth", "_country")).alias("_top")
    return found.groupBy("_question", "_entity").agg(top).select("_question", "_entity", "_top.*")
