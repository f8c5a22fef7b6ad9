import copy
import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import hashing, ids
from pitchlake.operators import canonical as c
from pitchlake.operators import quality as q
from pitchlake.operators import temporal as tp
from pitchlake.plans import imports
from pitchlake.sources import documents as d
from pitchlake.sources.store import TableStore

CLUBS = ["alpha", "beta", "gamma", "delta"]


def seed_document():
    return {
        "format_version": 1,
        "key": "north_league",
        "name": "North League",
        "country_code": "NOR",
        "competition_type": "league",
        "timezone": "Europe/Oslo",
        "related_competitions": [
            {"key": "north_second", "name": "North Second", "country_code": "NOR", "competition_type": "league"}
        ],
        "clubs": [{"key": k, "name": k.title(), "country_code": "NOR"} for k in CLUBS],
        "seasons": [
            {
                "key": "2030",
                "starts_on": "2030-03-01",
                "ends_on": "2030-11-30",
                "rules_valid_from": "2030-03-01T00:00:00+01:00",
                "rules_observed_at": "2030-01-15T12:00:00+01:00",
                "rules": {
                    "version": 1, "points": {"win": 3, "draw": 1, "loss": 0}, "ranking": ["points", "goal_difference"],
                    "round_robin_legs": 2, "relegation_places": 1, "promotion_places_into_season": 1, "notes": [],
                },
                "participants": [
                    {"club_key": k, "entry": "promoted" if k == "delta" else "continuing",
                     "from_competition_key": "north_second" if k == "delta" else None}
                    for k in CLUBS
                ],
            }
        ],
    }


def revision(fixture, number, kind, observed, status, home, away, score=(None, None), kickoff="2030-04-01T18:00:00+02:00"):
    return {
        "fixture_key": fixture, "revision": number, "revision_kind": kind, "observed_at": observed,
        "kickoff_at": kickoff, "home_club_key": home, "away_club_key": away, "status": status,
        "home_score": score[0], "away_score": score[1], "reason": None,
    }


def stream_document():
    return {
        "format_version": 1,
        "competition_key": "north_league",
        "season_key": "2030",
        "observations": [
            revision("f1", 1, "initial", "2030-03-01T10:00:00+01:00", "scheduled", "alpha", "beta", kickoff=None),
            revision("f1", 2, "status_change", "2030-03-20T10:00:00+01:00", "postponed", "alpha", "beta", kickoff=None),
            revision("f1", 3, "schedule_change", "2030-03-25T10:00:00+01:00", "scheduled", "alpha", "beta"),
            revision("f1", 4, "status_change", "2030-04-01T20:00:00+02:00", "finished", "alpha", "beta", (3, 1)),
            revision("f2", 1, "initial", "2030-03-01T10:00:00+01:00", "scheduled", "gamma", "delta"),
            revision("f2", 2, "status_change", "2030-04-01T19:30:00+02:00", "abandoned", "gamma", "delta", (1, 0)),
            revision("f2", 3, "result_correction", "2030-04-10T09:00:00+02:00", "awarded", "gamma", "delta", (3, 0)),
        ],
    }


def manifest_document():
    refs = [[("f1", 1), ("f2", 1)], [("f1", 2)], [("f1", 3)], [("f1", 4)], [("f2", 2)], [("f2", 3)]]
    return {
        "format_version": 1,
        "source": {
            "key": "paper_archive", "name": "Paper Archive", "kind": "historical", "reliability": 0.9,
            "parser_version": "p1", "collector_version": "c1",
        },
        "run_key": "run-1",
        "started_at": "2031-01-01T00:00:00Z",
        "finished_at": "2031-01-01T01:00:00Z",
        "records": [
            {
                "evidence_key": f"e{i}", "observed_at": "2030-04-11T00:00:00Z", "fetched_at": "2031-01-01T00:30:00Z",
                "payload": {"n": i, "text": "Türkiye", "x": 1.0},
                "observations": [{"fixture_key": f, "revision": r} for f, r in group],
            }
            for i, group in enumerate(refs)
        ],
    }


@pytest.fixture()
def write(tmp_path):
    def put(name, document):
        path = tmp_path / name
        path.write_text(json.dumps(document), encoding="utf-8")
        return str(path)

    return put


def load(spark, write, seed=None, stream=None, manifest=None):
    seeds = d.load_seeds(spark, write("seed.json", seed or seed_document()))
    observations = d.load_fixture_streams(spark, write("stream.json", stream or stream_document()), seeds)
    manifests = d.load_manifests(spark, write("manifest.json", manifest)) if manifest else None
    return seeds, observations, manifests


def total(summary):
    row = summary.filter("table_name is null").first()
    return row["inserted"], row["existing"], row["conflicting"]


def test_import_replay_enrich_and_heads(spark, write, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    first = imports.import_dataset(store, "r1", *load(spark, write))
    counts = {r["table_name"]: r["inserted"] for r in first.collect()}
    # 2 competitions + 4 clubs as entities, 1 season, 1 rule version, 4 participants, 2 matches, 7 revisions
    assert counts[None] == 6 + 2 + 4 + 1 + 1 + 4 + 2 + 7
    assert total(imports.import_dataset(store, "r2", *load(spark, write))) == (0, counts[None], 0)

    enriched = imports.import_dataset(store, "r3", *load(spark, write, manifest=manifest_document()))
    assert total(enriched) == (1 + 1 + 1 + 6, counts[None], 0)
    tables = store.tables()
    trace = c.trace_provenance(
        tables["match_revisions"], tables["match_revision_bindings"], tables["raw_source_records"],
        tables["collector_runs"], tables["sources"],
    ).collect()
    assert len(trace) == 7 and {r["source_key"] for r in trace} == {"paper_archive"}
    assert len({r["raw_record_id"] for r in trace}) == 6
    assert q.foreign_key_faults(tables).isEmpty()
    raw = {r["evidence_key"]: r["content_sha256"] for r in tables["raw_source_records"].collect()}
    assert raw["e0"] == hashing._digest('{"x": 1.0, "text": "Türkiye", "n": 0}', False)

    longer = stream_document()
    longer["observations"].append(
        revision("f1", 5, "result_correction", "2030-04-12T00:00:00Z", "finished", "alpha", "beta", (2, 0))
    )
    assert total(imports.import_dataset(store, "r4", *load(spark, write, stream=longer)))[0] == 1
    assert total(imports.import_dataset(store, "r5", *load(spark, write)))[0] == 0
    tables = store.tables()
    heads = {r["home_score"] for r in c.match_heads(tables["matches"], tables["match_revisions"]).collect()}
    assert heads == {2, 3}
    with pytest.raises(ValueError, match="already committed"):
        store.append("r5", {})


def test_conflict_writes_nothing(spark, write, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    imports.import_dataset(store, "r1", *load(spark, write, manifest=manifest_document()))
    renamed = seed_document()
    renamed["clubs"][0]["name"] = "Other"
    renamed["related_competitions"].append(
        {"key": "north_cup", "name": "Cup", "country_code": "NOR", "competition_type": "cup"}
    )
    with pytest.raises(imports.ImportConflict) as error:
        imports.import_dataset(store, "r2", *load(spark, write, seed=renamed))
    assert error.value.sample == [
        {"table_name": "clubs", "id": error.value.sample[0]["id"], "field": "canonical_name", "stored": "Alpha", "incoming": "Other"}
    ]
    assert store.tables()["competitions"].count() == 2
    tampered = manifest_document()
    tampered["records"][2]["payload"]["n"] = 99
    with pytest.raises(imports.ImportConflict, match="content_sha256"):
        imports.import_dataset(store, "r3", *load(spark, write, manifest=tampered))
    partial = manifest_document()
    partial["records"].pop()
    with pytest.raises(d.DocumentError, match="missing"):
        imports.import_dataset(store, "r4", *load(spark, write, manifest=partial))


def broken_seeds():
    for change, rule in [
        (lambda s: s.update(timezone="Mars/Base"), "timezone_known"),
        (lambda s: s["clubs"].append(s["clubs"][0]), "unique"),
        (lambda s: s["seasons"][0].update(ends_on="2030-03-01"), "ends_after_start"),
        (lambda s: s["seasons"][0].update(rules_valid_from="2030-03-01T00:00:00"), "rules_valid_from_zoned"),
        (lambda s: s["seasons"][0]["participants"].append({"club_key": "ghost", "entry": "invited"}), "unknown_club"),
        (lambda s: s["seasons"][0]["participants"][0].update(to_competition_key="nowhere"), "unknown_competition"),
        (lambda s: s["related_competitions"][0].update(key="north_league"), "external"),
        (lambda s: s.update(country_code="NO"), "country_code_length"),
    ]:
        seed = seed_document()
        change(seed)
        yield seed, rule


def test_invalid_documents_are_rejected(spark, write, tmp_path):
    for i, (seed, rule) in enumerate(broken_seeds()):
        with pytest.raises(d.DocumentError, match=rule):
            d.load_seeds(spark, write(f"bad{i}.json", seed))
    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    with pytest.raises(d.DocumentError, match="cannot load"):
        d.load_seeds(spark, str(broken))
    seeds = d.load_seeds(spark, write("seed.json", seed_document()))
    stranger = stream_document()
    for o in stranger["observations"][:4]:
        o["home_club_key"] = "omega"
    with pytest.raises(d.DocumentError, match="omega"):
        d.load_fixture_streams(spark, write("s1.json", stranger), seeds)
    for i, (change, rule) in enumerate([
        (lambda o: o[1].update(revision=9), "revisions_contiguous"),
        (lambda o: o[2].update(observed_at="2030-03-02T10:00:00+01:00"), "observed_non_decreasing"),
        (lambda o: o[3].update(away_club_key="gamma"), "participants_constant"),
        (lambda o: o[3].update(home_score=None), "completed_requires_score"),
        (lambda o: o[0].update(home_score=1), "unplayed_has_no_score"),
        (lambda o: o[0].update(observed_at="2030-03-01T10:00:00"), "observed_at_zoned"),
    ]):
        stream = copy.deepcopy(stream_document())
        change(stream["observations"])
        with pytest.raises(d.DocumentError, match=rule):
            d.load_fixture_streams(spark, write(f"t{i}.json", stream), seeds)
    late = manifest_document()
    late["records"][0]["fetched_at"] = "2032-01-01T00:00:00Z"
    with pytest.raises(d.DocumentError, match="fetched_inside_run"):
        d.load_manifests(spark, write("m.json", late))
    twice = manifest_document()
    twice["records"][0]["observations"].append({"fixture_key": "f1", "revision": 2})
    with pytest.raises(d.DocumentError, match="one_primary_evidence"):
        d.load_manifests(spark, write("m2.json", twice))


def test_as_of_reads(spark, write):
    _, observations, _ = load(spark, write)

    def status(fixture, instant):
        rows = tp.latest_as_of(observations, F.lit(datetime.fromisoformat(instant))).filter(F.col("fixture_key") == fixture)
        return [(r["status"], r["home_score"], r["kickoff_at"] is None) for r in rows.collect()]

    assert status("f1", "2030-03-20T11:00:00+01:00") == [("postponed", None, True)]
    assert status("f1", "2030-03-25T10:00:00+01:00") == [("scheduled", None, False)]
    assert status("f1", "2030-02-01T00:00:00Z") == []
    assert status("f2", "2030-04-05T00:00:00Z") == [("abandoned", 1, False)]
    assert status("f2", "2030-05-05T00:00:00Z") == [("awarded", 3, False)]
    final = {r["fixture_key"]: r["home_goals"] for r in c.historical_matches(observations).collect()}
    assert final == {"f1": 3, "f2": 3}


def test_ids_match_the_standard_library(spark):
    keys = ["Alpha", "  mixed Case  ", "Fenerbahçe", " wide ", "a:b"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", ids.canonical_id("Club", F.col("k")).alias("id"))
    for r in rows.collect():
        assert r["id"] == str(uuid.uuid5(ids.NAMESPACE, f"club:{r['k'].strip().lower()}"))
    with pytest.raises(Exception, match="null or blank"):
        spark.createDataFrame([("  ",)], "k string").select(ids.canonical_id("club", F.col("k"))).collect()
    with pytest.raises(ValueError):
        ids.canonical_id(" ", F.lit("x"))


def test_hashes(spark):
    texts = ['{"b":1,"a":"ş"}', '{ "a" : "ş", "b" : 1 }', None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(
        hashing.canonical_json_sha256(F.col("t")).alias("h"), hashing.stable_json_sha256(F.col("t")).alias("s")
    ).collect()
    assert out[0]["h"] == out[1]["h"] != out[0]["s"] and out[2]["h"] is None
    flat = spark.range(1).select(
        hashing.map_sha256(F.create_map(F.lit("b"), F.lit('q"\n\u0001'), F.lit("a"), F.lit("ş"))).alias("m")
    ).first()["m"]
    assert flat == hashing._digest(json.dumps({"a": "ş", "b": 'q"\n\u0001'}), False)
    assert hashing.stable_hash({"b": 2, "a": 1}) == hashing.stable_hash({"a": 1, "b": 2})
    with pytest.raises(TypeError):
        hashing.stable_hash({"a": object()})


def test_rows_of_one_id_are_compared_and_counted(spark):
    rows = [("a", "A", "X", "NOR")] * 3 + [("b", "B", None, "NOR"), ("b", "C", None, "NOR"), ("b", "C", None, "NOR")]
    rows += [(None, "N", None, "NOR"), (None, "M", None, "NOR"), ("c", "D", None, None)]
    df = spark.createDataFrame(rows, "entity_id string, canonical_name string, short_name string, country_code string")
    found = c.collapse(df, "entity_id", ["canonical_name", "country_code"])
    assert {(r["entity_id"], r["canonical_name"], r["_occurrences"], tuple(r["_disagreeing"])) for r in found.collect()} == {
        ("a", "A", 3, ()), ("b", "B", 3, ("canonical_name",)), (None, "M", 2, ("canonical_name",)), ("c", "D", 1, ())
    }
    # Rows are hashed; only those of ids in dispute are sorted.
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_an_import_leaves_no_shuffles_and_no_checkpoints(spark, write, tmp_path):
    from pathlib import Path
    from time import sleep

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before, folders = shuffles(), set(kept.iterdir())
    seeds, observations, _ = load(spark, write)
    summary = imports.import_dataset(TableStore(spark, str(tmp_path / "lake")), "r1", seeds, observations)
    for _ in range(40):  # files go a moment after their plan
        left = shuffles() - before
        if not left:
            break
        sleep(0.25)
    assert not left and set(kept.iterdir()) == folders
    assert total(summary)[0] == 27


def test_rows_that_are_not_new_are_kept_as_counts(spark):
    schema = "entity_id string, canonical_name string, short_name string, country_code string"
    rows = spark.createDataFrame([("a", "A", "x", "NOR"), ("b", "B", "x", "NOR"), ("b", "B", "x", "NOR"), ("c", "C", "x", "NOR")], schema)
    stored = spark.createDataFrame([("b", "B", None, "NOR"), ("c", "D", None, "NOR")], schema)
    classified = {"clubs": c.classify(rows, stored, *c.IDENTITY["clubs"])}
    needed = {"clubs": imports._needed("clubs", classified["clubs"])}
    found = {(r["action"], r["entity_id"], r["canonical_name"], r["short_name"], r["_occurrences"]) for r in needed["clubs"].collect()}
    assert found == {("insert", "a", "A", "x", 1), ("existing", None, None, None, 2), ("conflict", "c", None, None, 1)}
    assert needed["clubs"].columns == classified["clubs"].columns
    assert sorted(map(str, c.summarise(needed).collect())) == sorted(map(str, c.summarise(classified).collect()))
    assert c.conflicts(needed).collect() == c.conflicts(classified).collect()
