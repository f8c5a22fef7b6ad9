"""Languages and quality against plain second scorers, row by row; the pipeline's stages on awkward tables."""

import re
import sys
import zlib
from math import exp

import pytest
import zstandard
from pyspark.sql import functions as F

from pitchlake.llm import common, language, quality, registry

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t", "1234 !!", "a", "word word word, word.", "tab\tand　ideographic spaces", "x" * 90_000 + " tail",
    "中文文本没有空格", "ends,with.marks ,.", "one two one two one", "Ünïcödé 😀 mixed\x00text", "the same line\n" * 3000,
]


@pytest.fixture(scope="module")
def texts(spark):
    """Every text of the table and odd ones, by a number."""
    common.prepare(spark)
    own = [r["text"] for r in common.documents(spark, SF).select("text").collect()] + ODD
    return own, spark.createDataFrame(list(enumerate(own)), "n long, text string")


def plain_language(contents, text, margin):
    """The language whose dictionary compresses the pieces of a text best, one piece and one dictionary at a time."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    raw, sizes = text.lower().encode(), []
    for place, (lang, content) in enumerate(contents.items()):
        size = 0
        for at in range(0, len(raw), 4096):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=6)
            tool = zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            size += len(tool.compress(raw[at : at + 4096]))
        sizes.append((size, place, lang))
    best, second = sorted(sizes)[:2]
    gap = 1.0 - best[0] / second[0]
    return best[2], min(1.0, 0.5 + 5 * gap), gap < margin


def test_languages_equal_a_plain_scorer(spark, texts):
    own, df = texts
    docs = common.documents(spark, SF)
    model = language.fit(docs.where(common.in_buckets("doc_id") != 0))
    # Dictionaries hold beginnings of texts that may be learned from, of that language only.
    learned = {}
    for r in docs.where(common.in_buckets("doc_id") != 0).select("lang", "text").collect():
        learned.setdefault(r["lang"], []).append((r["text"] or "").lower())
    for lang, content in model.contents.items():
        lines = content.decode(errors="ignore")[:300].split("\n")[:1]
        assert any(t.startswith(lines[0][:100]) for t in learned[lang])
    got = {r["n"]: r for r in language.predict(df, model).collect()}
    assert len(got) == len(own)
    for n, text in enumerate(own):
        lang, score, rejected = plain_language(model.contents, text, 0.01)
        assert (got[n]["lang_pred"], got[n]["rejected"]) == (lang, rejected) and got[n]["score"] == pytest.approx(score, abs=1e-12)


def plain_bucket(gram):
    value = len(gram)
    for c in gram:
        value = (value ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        value ^= value >> 29
    return value % quality.BUCKETS


def plain_quality(model, text):
    """The mean over words of the mean over their features, one document, word and n-gram at a time."""
    words = [w for part in re.split(r"[\s\x1c-\x1f\x85]+", text or "") for w in re.split(r"(?=[,.])", part) if w]
    again = [w for i, w in enumerate(words) if w in words[max(0, i - 2) : i]]
    total = 0.0
    for word in words:
        marked = f"<{word}>"
        own = [zlib.crc32(b"w" + word.encode()) % quality.BUCKETS]
        own += [plain_bucket(marked[i : i + n]) for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
        total += sum(float(model.logits[b]) for b in own) / len(own)
    total += len(again) * float(model.logits[zlib.crc32(b"w\x00again") % quality.BUCKETS])
    count = len(words) + len(again)
    return 1.0 / (1.0 + exp(-((total / count if count else 0.0) + model.bias)))


def test_quality_equals_a_plain_scorer(spark, texts):
    own, df = texts
    model = quality.fit(registry.labelled(spark, SF))
    got = {r["n"]: r for r in quality.score(df, model).collect()}
    assert len(got) == len(own)
    for n, text in enumerate(own):
        if len(text or "") < 20_000 or n >= len(own) - len(ODD):
            expected = plain_quality(model, text)
            assert got[n]["score"] == pytest.approx(expected, abs=1e-9), (n, text[:80] if text else text)
            assert got[n]["predicted"] == int(got[n]["score"] >= 0.3)


def test_equal_rows_and_repeated_ids_do_not_change_what_is_learned(spark):
    rows = [(1, "de", "das ist ein satz"), (1, "de", "das ist ein satz"), (2, "en", "this is a text"), (None, "en", "and another one"), (3, None, "no"), (4, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    a, b = language.fit(df), language.fit(df.orderBy(F.desc("text")))
    assert a.contents == b.contents and set(a.contents) == {"de", "en"} and a.contents["de"].count(b"das ist") == 2


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty and wordless texts, equal rows, near copies and a column of its own."""
    prose = [r["text"] for r in common.documents(spark, SF).where("length(text) between 600 and 2000").orderBy("doc_id").select("text").limit(3).collect()]
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, prose[0]), (4, prose[0]), (5, prose[0]), (None, prose[1]), (7, prose[1]), (8, prose[2])]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"
    return spark.createDataFrame([(i, t, "x", "y", len(t or ""), "mine", "mine") for i, t in rows], kinds)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_of_no_rows(spark, awkward, name, stage):
    out = stage(spark, awkward.limit(0), SF)
    assert out.collect() == [] and (name == "packing" or out.columns == cp.COLUMNS)


def counted(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_stages_of_awkward_rows(spark, awkward):
    told = cp.known_language(spark, awkward, SF)
    model = language.fit(common.documents(spark, SF).where(common.in_buckets("doc_id") != 0))
    clear = language.predict(awkward, model).where("not rejected")
    assert told.columns == cp.COLUMNS and counted(told, "doc_id", "text") == counted(clear, "doc_id", "text")
    assert not {1, 2, 3} & {r["doc_id"] for r in told.collect()}
    good = cp.good_quality(spark, awkward, SF)
    model = quality.fit(registry.labelled(spark, SF))
    assert counted(good, "doc_id", "text") == counted(quality.score(awkward, model).where("predicted = 1"), "doc_id", "text")
    lines = {(r["doc_id"], r["text"], r["n_chars"]) for r in cp.without_repeated_lines(spark, awkward, SF).collect()}
    assert (1, None, None) in lines and (2, "", 0) in lines and (3, "12 !!", 5) in lines
    assert cp.without_repeated_lines(spark, awkward, SF).count() == 9
    apart = [r["doc_id"] for r in cp.first_of_near_copies(spark, awkward, SF).collect()]
    # Rows that repeat an id are one document; texts without a shingle are linked with nothing.
    assert {1, 2, 3, 4, 8} <= set(apart) and 5 not in apart and apart.count(4) == 2
    assert len({None, 7} & set(apart)) == 1
    packed = cp.packed_sequences(spark, awkward, SF).toPandas()
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 2048
    assert {1, 2, 3} <= set(packed["doc_id"].dropna())
