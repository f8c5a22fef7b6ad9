"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import gc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark import TaskContext
from pyspark.sql import functions as F

from pitchlake.llm import common, language, lines, minhash, neighbours, packing, pieces, quality, search, sharding, varbyte
from pitchlake.llm.tokens import TokenEncoder

CLASHING = "doc_id long, text string, id string, shard string, slot int, length string, offset long, rank int, score string, n_removed long, line int, hash long"
LONG = "\n".join(f"line {k} has a few words of its own and ends" for k in range(4000))


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    texts = [None, "", "  \n", "one two three four five six", "one two three four five six", LONG, LONG + "\nmore", "Ünïcödé 中文 😀\x00", "12 !!"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id here at all"), (None, None)]
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2, 3, "s", 4, 5, 6) for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_prefix_sums(spark, docs):
    rows = common.prefix_sums(docs.select("doc_id", F.lit(2).alias("w")), ["doc_id"], "w", before="before", position="position").toPandas()
    assert sorted(rows["position"]) == list(range(12)) and (rows["before"] == 2 * rows["position"]).all()


def test_pieces(docs, none):
    rows = pieces.piece_ids(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 12 and all(list(r["ids"]) == [2] and r["decoded"] == "" for r in rows if r["doc_id"] in (0, 1))
    assert {r["doc_id"]: r["decoded"] for r in rows}[7] == "Ünïcödé 中文 😀\x00"
    assert pieces.piece_ids(none, P.path("piece_bpe_32k.model")).count() == 0


def test_search(docs, none):
    rows = search.search(docs, docs).collect()
    found = {(r["query_id"], r["rank"]): r["doc_id"] for r in rows}
    assert found[3, 1] == 4 and not any(q in (0, 1, 2, None) for q, _ in found)
    assert search.search(none, none).count() == 0


def test_lines(docs, none):
    rows = lines.drop_repeated_lines(docs, min_words=5).orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[0]["text"] is None and by[1]["text"] == "" and by[2]["text"] == "  \n"
    assert by[3]["n_removed"] == 0 and by[4]["n_removed"] == 1 and by[4]["text"] == ""
    assert by[5]["text"] == LONG and by[6]["text"] == "more" and by[6]["n_removed"] == 4000 and by[6]["shard"] == "y"
    assert lines.drop_repeated_lines(none).count() == 0


def test_lines_count_words_over_runs(spark):
    common.prepare(spark)
    rows = spark.createDataFrame([(1, "a b\n\nc d\ne"), (2, "x\na b\nc d\n\ne"), (3, "a b\nnew\nc d")], "doc_id long, text string")
    by = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(rows, min_words=4).collect()}
    assert by == {1: "a b\n\nc d\ne", 2: "x\n", 3: "a b\nnew\nc d"}


def test_shards(docs, none):
    sized = docs.withColumn("size", sharding.text_size("text"))
    rows = sharding.balanced_shards(sized, 4).toPandas()
    assert len(rows) == 12 and set(rows["shard"]) <= {0, 1, 2, 3}
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    zero = sharding.balanced_shards(docs.withColumn("size", F.lit(None).cast("long")), 4).toPandas()
    assert set(zero["shard"]) == {0}
    assert sharding.balanced_shards(none.withColumn("size", F.lit(1)), 4).count() == 0


def test_packing(docs, none):
    cut = packing.pieces(docs, P.path("byte_bpe_50k.json"), capacity=64)
    rows = packing.pack(cut.withColumn("offset", F.lit("old")), capacity=64).toPandas()
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 64
    assert (rows["length"] == rows["ids"].map(len) / 4).all() and packing.pack(packing.pieces(none, P.path("byte_bpe_50k.json"))).count() == 0
    with pytest.raises(ValueError, match="not between"):
        packing.pack(cut, capacity=32)


def test_configurations_cover_the_histogram():
    rng = np.random.default_rng(0)
    for _ in range(5):
        histogram = np.bincount(rng.integers(1, 41, 300), minlength=41)
        held = np.zeros(41, int)
        for config, copies in packing.plan(histogram, 20):
            assert sum(config) <= 40
            np.add.at(held, list(config), copies)
        assert (held == histogram).all()


def test_program_finds_planted_full_sequences():
    planted = [((900, 700, 300, 148), 3000), ((1100, 611, 337), 15000), ((871, 552, 401, 224), 9000), ((1301, 480, 267), 4000)]
    histogram = np.zeros(2049, np.int64)
    for config, copies in planted:
        histogram[list(config)] += copies
    for found in (packing.program(histogram), packing.plan(histogram)):
        held = np.zeros(2049, np.int64)
        for config, copies in found:
            assert sum(config) <= 2048
            np.add.at(held, list(config), copies)
        assert (held == histogram).all() and sum(copies for _, copies in found) <= 31000 + 3


def test_program_places_every_piece_of_lengths_that_occur_once():
    histogram = np.bincount(np.random.default_rng(3).integers(1, 2048, 400), minlength=2049)
    found = packing.program(histogram)
    held = np.zeros(2049, np.int64)
    for config, copies in found:
        np.add.at(held, list(config), copies)
    best_fit = sum(copies for _, copies in packing.best_fit(histogram))
    assert (held == histogram).all() and sum(copies for _, copies in found) <= 1.02 * best_fit


def test_near_copies(docs, none):
    rows = minhash.near_duplicates(docs, words=3, percent=85).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[4]["component_id"] == 3 and not by[4]["kept"] and by[3]["kept"]
    assert by[6]["component_id"] == 5 and by[0]["component_id"] == 0 and by[2]["n_shingles"] == 0
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(none).count() == 0


def test_chains_of_near_copies_are_one_component(spark):
    common.prepare(spark)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([f"v{j}" if j < k else w for j, w in enumerate(base)]) for k in range(0, 60, 2)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[7]) for k in range(50)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(rows, words=3, percent=85).collect()} == {0}


def test_blocks_return_joining_links_only():
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in (0, 2, 4, 200)]
    found = minhash.block_links(sets, np.arange(4), 0, 85)
    assert len(found) == 2 and minhash.block_links(sets, np.zeros(4, int), 0, 85) == []


def test_signatures_agree_as_often_as_sets_do():
    signer, rng = minhash.Signer(60), np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = signer.signature(values[:1000]), signer.signature(values[200:])
    assert abs((a == b).mean() - 800 / 1200) < 0.1


def test_token_files(spark, docs, none):
    path = common.scratch(spark, "t")
    varbyte.write_tokens(docs, P.path("word_bpe_49k.json"), path)
    rows = varbyte.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == 12 and [r["doc_id"] for r in rows][:2] == [None, None]
    assert [r["start"] for r in rows] == list(np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1])
    assert {r["doc_id"]: bytes(r["raw"]) for r in rows}[1] == (2).to_bytes(4, "little")
    path = common.scratch(spark, "t")
    varbyte.write_tokens(none, P.path("word_bpe_49k.json"), path)
    assert varbyte.read_tokens(spark, path).count() == 0


def test_variable_bytes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)
        control, data = varbyte.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (varbyte.decode_ranks(control, data, varbyte.used_codes(np.array([n]))) == ranks).all()


def test_language(docs, none, spark):
    model = language.fit(spark.createDataFrame([(k, w * 30, w) for k, w in enumerate(["the and ", "und der "])], "doc_id long, text string, lang string"))
    rows = language.predict(docs, model).collect()
    assert len(rows) == 12 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2, 8))
    assert language.predict(docs, language.fit(none.withColumn("lang", F.lit("en")))).where("lang_pred <> 'und'").count() == 0
    assert language.predict(none, model).count() == 0


def test_short_texts_are_rejected_for_their_margin_too():
    model = language.LanguageModel({"en": b"the and of with that " * 20, "de": b"und der die mit dass " * 20})
    assert model.predict("xq 7", 0.01)[2] and not model.predict("with that and the", 0.01)[2]


def test_dictionaries_hold_every_sampled_text(spark):
    texts = [f"number{k:03d} " + "some more words " * 60 for k in range(400)]
    model = language.fit(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    assert all(f"number{k:03d}".encode() in model.contents["en"] for k in range(400)) and 64000 < len(model.contents["en"]) <= 65536
    assert language.beginnings([b"a", b"bbbbbb", b"cccccc"], 9) == [b"a", b"bbb", b"ccc"]
    assert language.beginnings([b"a", b"bb"], 9) == [b"a", b"bb"] and language.beginnings([b"aa"] * 3, 2) == [b"", b"", b""]


def test_quality(docs, none):
    model = quality.train(["good words here", "bad bad bad bad"] * 20, np.array([1, 0] * 20))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert quality.score(none, quality.train([], np.zeros(0))).count() == 0
    only = quality.train(["a"], np.array([1]))
    assert quality.score(docs, only).where("predicted = 0").count() == 0


def test_quality_reads_every_character_and_every_white_space(monkeypatch):
    ends = "a" * 20, "z" * 20
    model = quality.train([ends[0] + x * 30 + ends[1] for x in ("good", "bad")] * 20, np.array([1, 0] * 20))
    good, bad = model.scorer()(pa.array([ends[0] + x * 29 + ends[1] for x in ("good", "bad")]))  # words never seen
    assert good > 0.5 > bad
    spaces = " \t\u00a0\u3000\u2003\x85\x1f"
    words, picks, _ = quality.words_of(pa.array([f"one{space}two" for space in spaces]))
    assert {words[k] for k in picks} == {"one", "two"}
    texts = pa.array(["x" + "yes" * 50, "word " + "no" * 100 + " end"])
    whole = model.scorer()(texts)
    monkeypatch.setattr(quality, "CHARACTERS", 7)
    assert np.allclose(model.scorer()(texts), whole, rtol=0, atol=1e-12)


def test_neighbours(spark):
    common.prepare(spark)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [1e200, 1e199]), (7, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in neighbours.nearest(table, table.where("vec_id = 0")).orderBy("rank").collect()]
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 2, 6)] and found[0][3] == found[1][3]
    same = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(9000)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(same, same.where("vec_id = 50")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 2, 3, 4]
    assert neighbours.nearest(table.limit(0), table).count() == 0
    mixed = spark.createDataFrame([(k, [1.0, float(k), 2.0][: 2 if k % 50 == 0 else 3]) for k in [*range(1, 8), 50, 100]], "vec_id long, embedding array<double>")
    assert neighbours.nearest(mixed, mixed.where("vec_id % 50 = 0")).count() == 0
    assert neighbours.nearest(mixed, mixed).count() == 7 * 5


def test_hash_of_ids_is_the_crc(spark):
    assert spark.range(50).select("id", common.in_buckets("id").alias("r")).where("id is not null").collect()[7]["r"] == zlib.crc32(b"7") % 5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cuts_of_letters_get_the_ids_of_the_library(name):
    own = TokenEncoder(P.path(name))
    texts = ["É Éa Straße ÀÉ éa", "x×y÷z ªº", "don't DON'T", "é É", "İstanbul ΣΑΣ ẞ", "a" * 30000, " lead", "end ", "", None, "ÿ Ÿ þ Þ ß", "q<|endoftext|>q"]
    ids, counts = own.encode(pa.array(texts, pa.string()), 7)
    found = np.split(ids, np.cumsum(counts)[:-1])
    for text, mine in zip(texts, found, strict=True):
        assert mine.tolist() == [*own.library.encode(text or "", add_special_tokens=False).ids, 7], text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_the_plain_library_s(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    for texts in (["q<|endoftext|>q", "plain words", None, "a <|ENDOFTEXT|> b, c.\n<|startoftext|> d", "<|endoftext|>", "more words"], ["<|endoftext|><|endoftext|>"]):
        ids, counts = TokenEncoder(P.path(name)).encode(pa.array(texts, pa.string()), 7)
        found = np.split(ids, np.cumsum(counts)[:-1])
        assert [f.tolist() for f in found] == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_line_dedup_builds_no_small_relations_in_the_driver(spark):
    from pitchlake.llm import registry

    plan = registry.QUERIES["op3_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    common.prepare(spark)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_storing_rows_frees_the_driver_of_what_came_before(spark):
    class Held:
        pass

    gc.disable()
    try:
        one = Held()
        one.itself, gone = one, weakref.ref(one)
        del one
        assert gone() is not None
        assert common.stored(spark.range(3), "freed").count() == 3 and gone() is None
    finally:
        gc.enable()


def test_line_dedup_settles_each_level_in_a_plan_of_its_own(spark, docs):
    leaves = lines.drop_repeated_lines(docs)._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 6  # what each of four levels deletes, the lines, the documents


def test_the_quality_sample_stays_out_of_the_driver(spark, monkeypatch):
    common.prepare(spark)
    rows = [(k, ["bad bad bad", "good words here"][k % 2], k % 2) for k in range(40)] + [(None, "good words here", 5), (41, None, 1), (42, "a", None)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    picked = rows.where("quality is not null and text is not null").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), "text").collect()
    want = quality.train([r["text"] for r in picked], np.array([min(r["quality"], 1) for r in picked]))
    train, empty = quality.train, quality.train([], np.zeros(0))

    def in_tasks_only(texts, labels):
        assert not texts or TaskContext.get() is not None
        return train(texts, labels)

    monkeypatch.setattr(quality, "train", in_tasks_only)
    got = quality.fit(rows)
    assert got.bias == want.bias and (got.logits == want.logits).all()
    assert quality.fit(rows.limit(0)).bias == empty.bias


def test_search_queries_travel_as_places_among_the_terms_of_a_bundle():
    rng = np.random.default_rng(3)
    lists = [[{"term": (int(t) - 1000) * 2**52 + int(t), "n": int(t) + 1} for t in rng.permutation(2000)[: k * 7 % 600]] for k in range(1, 600)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(lists)), pa.int64()), pa.array(lists, pa.list_(pa.struct([("term", pa.int64()), ("n", pa.int32())])))], ["id", "terms"]
    )
    bundles = [row for part in search.bundled([batch.slice(0, 300), batch.slice(300), batch.slice(0, 0)]) for row in part.to_pylist()]
    assert len(bundles) == 4 and len(bundles) < len(lists)
    got = {}
    for bundle in bundles:
        ids, own, terms, counts = search.unbundled(bundle)
        got |= {i: sorted(zip(terms[at].tolist(), counts[at].tolist(), strict=True)) for i, at in zip(ids, own, strict=True)}
    assert got == {k: sorted((x["term"], x["n"]) for x in own) for k, own in enumerate(lists)}
    assert sum(len(zlib.compress(b["codes"], 1)) for b in bundles) < 2 * sum(map(len, lists))
