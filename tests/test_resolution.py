from datetime import date, datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from pitchlake.functions.text import fold_name, normalize_name
from pitchlake.operators import fuzzy
from pitchlake.operators import resolution as rs

CANDIDATE = "entity_id string, entity_type string, canonical_name string, birth_date date, country_code string"
ALIAS = "entity_id string, entity_type string, alias string, valid_from timestamp, valid_until timestamp"
REQUEST = "request_id string, entity_type string, name string, as_of timestamp, birth_date date, country_code string"
T0 = datetime(2020, 6, 1)


def brute(request, candidates, aliases):
    """The decision ladder for one request, straight from its definition."""
    _, kind, name, as_of, birth, country = request
    wanted = fold_name(name)
    scored, exact = [], []
    for entity, etype, canonical, other_birth, other_country in candidates:
        if etype != kind:
            continue
        names = [canonical] + [
            a for e, t, a, f, u in aliases
            if e == entity and t == kind and (f is None or as_of >= f) and (u is None or as_of < u)
        ]
        best = max(fuzzy.similarity(wanted, fold_name(n)) for n in names)
        score = best
        if birth and other_birth:
            score = min(1.0, score + 0.06) if birth == other_birth else max(0.0, score - 0.20)
        if country and other_country:
            same = country.upper() == other_country.upper()
            score = min(1.0, score + 0.02) if same else max(0.0, score - 0.04)
        scored.append((entity, score, best))
        if wanted in [fold_name(n) for n in names]:
            exact.append(scored[-1])
    if not scored:
        return "unmatched", "none", None, []
    if len(exact) == 1:
        return "matched", "exact", exact[0][0], exact
    ranked = sorted(exact or scored, key=lambda c: (-c[1], c[0]))
    if len(exact) > 1 and birth is None and country is None:
        return "ambiguous", "exact", None, ranked[:5]
    margin = ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0)
    if ranked[0][1] >= 0.92 and (len(ranked) == 1 or margin >= 0.08):
        return "matched", "attribute" if exact else "fuzzy", ranked[0][0], ranked[:5]
    review = [c for c in ranked if c[1] >= 0.65][:5]
    return ("ambiguous", "fuzzy", None, review) if review else ("unmatched", "none", None, ranked[:5])


def check(spark, requests, candidates, aliases, **options):
    out = rs.resolve(
        spark.createDataFrame(requests, REQUEST),
        spark.createDataFrame(candidates, CANDIDATE),
        spark.createDataFrame(aliases, ALIAS),
        **options,
    ).collect()
    assert len(out) == len(requests)
    found = {r["request_id"]: r for r in out}
    for request in requests:
        status, method, entity, ranked = brute(request, candidates, aliases)
        row = found[request[0]]
        assert (row["status"], row["method"], row["resolved_entity_id"]) == (status, method, entity), request
        got = [(c["entity_id"], round(c["score"], 12), round(c["name_score"], 12)) for c in row["candidates"]]
        assert got == [(e, round(score, 12), round(best, 12)) for e, score, best in ranked], request
    return found


def test_name_folding(spark):
    names = ["Fenerbahçe SK", "İstanbul  Başakşehir", "ISPARTA", "ıspartaspor", " A.C.-Milan ", "Łódź", "", "Straße"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(normalize_name(F.col("n"))).collect()
    assert [r[0] for r in rows] == [
        "fenerbahce sk", "istanbul basaksehir", "isparta", "ispartaspor", "a c milan", "odz", "", "strasse"
    ]


def test_ladder_cases(spark):
    born, other = date(1990, 1, 1), date(1991, 2, 2)
    candidates = [
        ("c1", "club", "Fenerbahçe SK", None, "TUR"),
        ("c2", "club", "Galatasaray", None, "TUR"),
        ("p1", "player", "Ali Veli", born, "TUR"),
        ("p2", "player", "Ali Veli", other, "TUR"),
        ("p3", "player", "Mehmet Demir", None, "TUR"),
        ("p4", "player", "Mehmet Demir", None, "GER"),
    ]
    start, end = T0, T0 + timedelta(days=30)
    aliases = [("c2", "club", "Old Name", start, end), ("c2", "club", "old name!", start, T0 + timedelta(days=9))]
    requests = [
        ("exact", "club", "FENERBAHCE sk", T0, None, None),
        ("namesakes", "player", "ali veli", T0, None, None),
        ("born", "player", "ali veli", T0, born, None),
        ("country", "player", "Mehmet Demir", T0, None, "tur"),
        ("inside", "club", "Old Name", start, None, None),
        ("before", "club", "Old Name", start - timedelta(seconds=1), None, None),
        ("until", "club", "Old Name", end, None, None),
        ("fuzzy", "club", "Galatasarray", T0, None, "TUR"),
        ("nothing", "club", "zzz", T0, None, None),
        ("notype", "coach", "Ali Veli", T0, None, None),
        ("wrongborn", "player", "Ali Veli", T0, date(1950, 1, 1), None),
    ]
    found = check(spark, requests, candidates, aliases)
    assert found["inside"]["resolved_entity_id"] == "c2" and found["until"]["resolved_entity_id"] is None
    assert found["country"]["status"] == "ambiguous"
    assert found["born"]["method"] == "attribute"
    assert found["born"]["candidates"][0]["reasons"] == ["name=1.000", "birth_date=match"]
    assert found["notype"]["candidates"] == []


@pytest.mark.parametrize(("tile_names", "block"), [(16, 2_000), (1, 3)])
def test_random_differential(spark, monkeypatch, tile_names, block):
    monkeypatch.setattr(fuzzy, "TILE_NAMES", tile_names)
    monkeypatch.setattr(fuzzy, "BLOCK_NAMES", block)
    monkeypatch.setattr(fuzzy, "BLOCK_QUESTIONS", block)
    rng = Random(5)
    syllables = ["an", "ber", "cor", "da", "el", "fa", "gan", "li", "mo", "ra", "sto", "ti"]

    def name():
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 2)))

    def maybe(values):
        return rng.choice([None, *values])

    births = [date(1990, 1, d) for d in (1, 2)]
    pool = [name() for _ in range(25)]
    candidates = [
        (f"e{i:03}", rng.choice(["club", "player"]), rng.choice(pool), maybe(births), maybe(["TUR", "GER"]))
        for i in range(60)
    ]
    aliases = []
    for _ in range(30):
        entity = rng.choice(candidates)
        start = T0 + timedelta(days=rng.randrange(20))
        aliases.append(
            (entity[0], entity[1], rng.choice(pool), maybe([start]), maybe([start + timedelta(days=rng.randint(1, 9))]))
        )
    requests = [
        (
            f"r{i}", rng.choice(["club", "player"]), rng.choice([*pool, name(), rng.choice(pool) + "x"]).title(),
            T0 + timedelta(days=rng.randrange(25)), maybe(births), maybe(["tur", "GER"]),
        )
        for i in range(80)
    ]
    check(spark, requests, candidates, aliases)


def test_custom_scorer_and_review(spark):
    candidates = spark.createDataFrame([("a", "club", "abc", None, None), ("b", "club", "abd", None, None)], CANDIDATE)
    requests = spark.createDataFrame([("r1", "club", "abx", T0, None, None), ("r2", "club", "abc", T0, None, None)], REQUEST)
    out = rs.resolve(requests, candidates, pair_score=lambda r, c: 0.7 if c.endswith("d") else 0.1)
    rows = {r["request_id"]: r for r in out.collect()}
    assert [c["entity_id"] for c in rows["r1"]["candidates"]] == ["b"]
    cases = rs.review_cases(out).collect()
    assert [c["request_id"] for c in cases] == ["r1"] and len(cases[0]["case_id"]) == 36
    audit = rs.decisions(out, "nightly", F.lit(T0)).orderBy("request_id").collect()
    # The scorer is asked about the exact candidate too.
    assert [str(r["top_score"]) for r in audit] == ["0.7000", "0.1000"]


class Seniority:
    """Scores by the entity's id and how many names it has."""

    def score(self, question, candidate):
        value = int(candidate.entity_id[1:]) / 10 + len(candidate.names) / 100
        return fuzzy.Score(value, 0.5, [question.name, *candidate.names])


def test_scorer_decides_exact_pools(spark):
    candidates = [(f"e{k}", "club", "Twin City" if k < 8 else "Other", date(1990, 1, 1), None) for k in range(9)]
    aliases = [("e6", "club", "Old Twin", T0, None), ("e6", "club", "Gone", None, T0)]
    requests = [("twins", "club", "twin city", T0, date(1990, 1, 1), None), ("none", "club", "zz", T0, None, None), ("coach", "coach", "zz", T0, None, None)]
    out = rs.resolve(
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(aliases, ALIAS),
        scorer=Seniority(), auto_match_threshold=0.7, ambiguity_margin=0.05,
    )
    rows = {r["request_id"]: r for r in out.collect()}
    # Eight namesakes, all scored: the fifth smallest id is not the end of them.
    assert [c["entity_id"] for c in rows["twins"]["candidates"]] == ["e7", "e6", "e5", "e4", "e3"]
    assert (rows["twins"]["method"], rows["twins"]["resolved_entity_id"]) == ("attribute", "e7")
    assert rows["twins"]["candidates"][1]["reasons"] == ["twin city", "old twin", "twin city"] and rows["twins"]["candidates"][1]["score"] == 0.62
    assert [c["entity_id"] for c in rows["none"]["candidates"]] == ["e8", "e7", "e6", "e5", "e4"]
    assert rows["coach"]["status"] == "unmatched" and rows["coach"]["candidates"] == []


def test_bounds_hold_and_tiles_are_passed_over(spark):
    rng = Random(9)
    syllables = ["qu", "ber", "cor", "da", "el", "fa", "gan", "li", "mo", "ra", "sto", "ti", "vy", "hux", "pim", "zek"]

    def name():
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))

    names = sorted({name() for _ in range(4000)})
    asked = [n[:-1] + "x" for n in rng.sample([n for n in names if len(n) > 6], 60)]
    candidates = spark.createDataFrame([(f"e{k:05}", "club", n, None, None) for k, n in enumerate(names)], CANDIDATE)
    requests = spark.createDataFrame([(f"r{k}", "club", n, T0, None, None) for k, n in enumerate(asked)], REQUEST)
    classes = rs.name_classes(rs.candidate_names(candidates))
    questions = rs._questions(requests, dated=False).select("_question", "entity_type", "normalized_name", "as_of", "birth_date", "country_code")
    stats = {}
    found = fuzzy.nearest(questions, classes, rs._CLASS, stats)
    best = {}
    for r in found.join(questions, "_question").collect():
        best.setdefault(r["normalized_name"], []).append((-r["_name_score"], r["_entity"]))
    for n in asked:
        want = sorted((-fuzzy.similarity(n, other), f"e{k:05}") for k, other in enumerate(names))[:5]
        assert sorted(best[n])[:5] == want
    assert stats["tiles"] > 20 and stats["visits"] < 0.5 * stats["tiles"] * stats["questions"], stats


def test_tile_bounds_are_upper_bounds(spark):
    rng = Random(11)
    names = ["".join(rng.choices("abcdeirs 12", k=rng.randint(0, 20))).strip() for _ in range(300)]
    rows = spark.createDataFrame([("club", n, None, None, ["e"]) for n in names], "entity_type string, name string, valid_from date, valid_until date, entity_ids array<string>")
    tiled = rows.withColumn("tile", fuzzy.tile_of(F.col("name"), 4))
    tiles = fuzzy.tiles_by_type(fuzzy.tile_summaries(tiled))["club"]
    place = {r["name"]: r["tile"] for r in tiled.collect()}
    for question in names[:60]:
        bound = dict(zip(tiles.tile.tolist(), tiles.bounds(question), strict=True))
        assert all(fuzzy.similarity(question, n) <= bound[place[n]] + 1e-12 for n in names)
