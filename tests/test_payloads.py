from hashlib import sha256

from pyspark.sql import functions as F

from pitchlake.functions import payloads

TEXTS = ['{"a": {"b": [1, "x"]}, "n": 1.50}', '{ "a" : {"b": []} }', "[1]", "{broken", "", None, "null"]


def rows(spark):
    return payloads.with_payload(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string"), "text")


def test_fields_by_path_and_kind(spark):
    wanted = {"one": ("$.a.b[0]", "int"), "word": ("$.a.b[1]", "string"), "wrong": ("$.a.b[1]", "int"), "n": ("$.n", "decimal(5,2)"), "top": ("$[0]", "int")}
    found = [tuple(r) for r in payloads.fields(rows(spark), wanted).orderBy("k").select(*wanted).collect()]
    assert [r[:3] for r in found[:2]] == [(1, "x", None), (None, None, None)]
    assert str(found[0][3]) == "1.50" and found[2][4] == 1 and all(r == (None,) * 5 for r in found[3:])


def test_hashes_are_those_of_the_text(spark):
    found = {r["k"]: r["payload_sha256"] for r in rows(spark).collect()}
    assert found == {k: None if t is None else sha256(t.encode()).hexdigest() for k, t in enumerate(TEXTS)}


def test_variants_survive_a_table(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "t"))
    back = payloads.fields(spark.read.parquet(str(tmp_path / "t")), {"word": ("$.a.b[1]", "string")})
    assert [r["word"] for r in back.orderBy("k").collect()] == ["x"] + [None] * 6


def test_shapes_merge_and_count_what_is_no_json(spark):
    found = payloads.shapes(rows(spark).where("k < 2 or k = 3 or k = 5").withColumn("g", F.lit(1)), ["g"]).first()
    assert found["rows"] == 4 and found["without"] == 2 and found["shape"].startswith("OBJECT<a: OBJECT<b: ARRAY<VARIANT>>")
