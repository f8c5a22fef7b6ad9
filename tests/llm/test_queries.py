"""Every registered query over whole small tables, against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers as P

from checks import compare
from pitchlake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def run(spark, name):
    return registry.QUERIES[name](spark, SF).toPandas()


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = run(spark, "op1_pieces").set_index("doc_id")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = model.encode(text) + [2]
        row = got.loc[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op2_search", "op3_line_dedup"])
def test_sql(spark, name):
    db = duckdb.connect()
    for table in compare.TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours = registry.QUERIES[name](spark, SF)
    theirs = db.execute(registry.SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert compare.rows_of(ours.columns, map(tuple, ours.collect())) == compare.rows_of(columns, theirs.fetchall())


def test_search_equals_brute_force(spark, docs):
    def terms(text):
        return Counter(w for w in (x.strip(b".,;:!?|\"'()") for x in text.encode().lower().split()) if w)

    counts = {i: terms(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    n, df = len(counts), Counter(w for c in counts.values() for w in c)
    mean = sum(sum(c.values()) for c in counts.values()) / n
    expected = []
    for q in (i for i in counts if i % 50 == 0):
        scores = []
        for i, c in counts.items():
            shared = counts[q].keys() & c.keys()
            if i != q and shared:
                norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
                x = math.fsum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in shared)
                scores.append((-round(x, 7), i))
        expected += [(q, k + 1, i) for k, (_, i) in enumerate(sorted(scores)[:10])]
    got = run(spark, "op2_search")
    assert sorted(map(tuple, got[["query_id", "rank", "doc_id"]].to_numpy().tolist())) == sorted(expected)


def test_shards(spark, docs):
    got = run(spark, "op4_sharding").sort_values(["shard", "slot"]).merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(docs) and set(got["shard"]) == set(range(16)) and set(got["law"]) == {"bytes"}
    assert (got["size"] == [len(t.encode()) + 1 for t in got["text"]]).all()
    assert (got["text_crc32"] == [zlib.crc32(t.encode()) for t in got["text"]]).all()
    assert (got.groupby("shard").cumcount() == got["slot"]).all() and got["doc_id"].is_monotonic_increasing
    sizes = got.groupby("shard")["size"].sum()
    assert (sizes - sizes.sum() / 16).abs().max() <= got["size"].max()


def encoded(name, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    return [x.ids for x in library.encode_batch(list(texts), add_special_tokens=False)]


def test_packing(spark, docs):
    got = run(spark, "op5_packing").sort_values(["doc_id", "piece"])
    for (_, own), ids in zip(got.groupby("doc_id"), encoded("byte_bpe_50k.json", docs["text"]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        assert list(own["piece"]) == list(range(len(own))) and own["length"].sum() == len(ids)
        assert (own["length"].iloc[1:] == 2048).all()
        for row in own.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 2048) + 2


def jaccard_components(docs, words, percent):
    sets = {}
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        own = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
        width = min(words, len(own))
        sets[i] = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if own else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_copies_equal_brute_force(spark, docs):
    got = run(spark, "op6_minhash")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == jaccard_components(docs, 3, 85)
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()


def test_token_files(spark, docs):
    got = run(spark, "op7_token_files").sort_values("doc_id")
    start = 0
    for row, ids in zip(got.itertuples(), encoded("word_bpe_49k.json", docs["text"]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op8_language"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got["held_out"]]
    assert len(got) == 1000 and 100 < len(held) < 300
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()
    assert got["rejected"].mean() < 0.03


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op10_quality"](spark, sf).toPandas()
    held = got[got["held_out"]].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert len(got) == 1000 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    rows = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    got = registry.QUERIES["op9_neighbours"](spark, sf).toPandas()
    matrix = np.stack(rows["embedding"].to_numpy()).astype(float)
    matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    cosines, found = matrix @ matrix.T, 0
    for q, own in got.groupby("query_id"):
        assert list(own.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5] and q not in set(own["vec_id"])
        order = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-cosines[q, i], i))[:5]
        found += len(set(order) & set(own["vec_id"]))
        assert np.allclose(own["score"], cosines[q, own["vec_id"]], rtol=0, atol=1e-12)
    assert found >= 0.9 * 5 * got["query_id"].nunique() and got["query_id"].nunique() == 10


def test_pipeline(spark):
    import corpus_pipeline

    sf, docs = SF, spark.read.parquet(f"{SF}/documents.parquet")
    ids = [set(docs.toPandas()["doc_id"])]
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.schema == docs.schema
        frames.append(out.toPandas())
        ids.append(set(frames[-1]["doc_id"]))
        docs = spark.createDataFrame(frames[-1], schema=out.schema)
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[2] == ids[3] and ids[4] == ids[5]
    expected = jaccard_components(frames[2], 5, 80)
    assert ids[4] == {i for i, (_, name) in expected.items() if i == name}
    whole = run(spark, "pipeline")
    assert len(whole) == len(frames[-1]) and whole["length"].sum() == frames[-1]["length"].sum()
    assert defaultdict(int, whole.groupby("doc_id")["length"].sum()) == defaultdict(int, frames[-1].groupby("doc_id")["length"].sum())
