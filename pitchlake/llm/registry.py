"""The queries of this package over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import language, lines, minhash, neighbours, packing, pieces, private, quality, repair, search, sharding, trie, varbyte
from pitchlake.llm.common import documents, in_buckets, prepare, scratch, without_broadcasts


def op1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


def op2_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return search.search(docs, docs.where("doc_id % 50 = 0"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(without_broadcasts(spark), sf).select("doc_id", "text")
    return lines.drop_repeated_lines(docs)


def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(
        "doc_id", sharding.text_size("text").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.balanced_shards(docs, 16, order=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut.drop("ids"))


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "token-files")
    varbyte.write_tokens(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), path)
    return varbyte.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("raw").alias("ids_crc32"))


def op6_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf), words=3, percent=85)


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = language.fit(docs.where(in_buckets("doc_id") != 0))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (in_buckets("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their quality label, held-out ones apart."""
    labels = documents(spark, sf, "labels").where(in_buckets("doc_id") != 0).select("doc_id", "quality")
    return documents(spark, sf).select("doc_id", "text").join(labels, "doc_id")


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    model = quality.fit(labelled(spark, sf))
    scored = quality.score(documents(spark, sf).select("doc_id", "text"), model)
    return scored.select("doc_id", (in_buckets("doc_id") == 0).alias("held_out"), "score", "predicted")


def op11_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = documents(spark, sf, "conversations")
    found = repair.repaired(repair.damaged(turns))
    every = turns.select("conv_id").distinct()
    rows = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in repair.COUNTS]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def op12_private(spark: SparkSession, sf: str) -> DataFrame:
    found = private.personal_data(documents(spark, sf).select("doc_id", "text"))
    spans = F.col("spans")
    base = private.listed(F.filter(spans, lambda s: s["kind"].isin(*private.BASE)))
    return found.select(
        "doc_id", *[private.count_of(spans, kind).alias(f"n_{kind}") for kind in private.BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), private.listed(spans).alias("spans"),
    )


def op13_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(documents(spark, sf, "conversations"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def _prepared(query):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return query(prepare(spark), sf)

    return run


QUERIES = {f.__name__: _prepared(f) for f in (
    op1_pieces, op2_search, op3_line_dedup, op4_sharding, op5_packing, op6_minhash, op7_token_files, op8_language, op9_neighbours, op10_quality,
    op11_repair, op12_private, op13_trie, pipeline,
)}

SQL = {
    "op2_search": r"""
with words as (select doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+')) as raw
  from documents where text is not null and doc_id is not null),
terms as (select doc_id, trim(raw, '.,;:!?|"''()') as term from words),
counts as (select doc_id, term, count(*) as tf from terms where term <> '' group by all),
lengths as (select doc_id, sum(tf) as dl from counts group by all),
corpus as (select (select count(*) from documents where text is not null and doc_id is not null) as n, (select sum(dl) from lengths) as total),
weights as (select term, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) as idf from counts, corpus group by term, n),
scores as (select q.doc_id as query_id, d.doc_id, round(sum(idf * d.tf * 2.2e0 / (d.tf + 1.2e0 * (0.25e0 + 0.75e0 * dl * n / total))), 9) as score
  from counts q join counts d using (term) join weights using (term) join lengths l on l.doc_id = d.doc_id, corpus
  where q.doc_id % 50 = 0 and q.doc_id <> d.doc_id group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores)
select query_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10""",
    "op3_line_dedup": r"""
with own as (select doc_id, text, row_number() over (order by doc_id) as d from documents),
lines as (select doc_id, d, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from own),
worded as (select *, row_number() over (partition by d order by n) as q, len(regexp_extract_all(line, '\S+')) as words from lines
  where regexp_matches(line, '\S')),
reach as (select *, list(line) over x as ahead, list(words) over x as counts, list(line) over y as behind, list_reverse(list(words) over y) as back from worded
  window x as (partition by d order by q rows between current row and 9 following), y as (partition by d order by q rows between 9 preceding and current row)),
sized as (select *, list_position(list_transform(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i]) >= 10), true) as fore,
  list_position(list_transform(range(1, len(back) + 1), lambda i: list_sum(back[1:i]) >= 10), true) as aft from reach),
starts as (select d, q, fore as length, array_to_string(ahead[1:fore], chr(10)) as content from sized where fore > 0
  union select d, q - aft + 1, aft, array_to_string(behind[len(behind) - aft + 1:len(behind)], chr(10)) from sized where aft > 0),
runs as (select d, q, length, row_number() over (partition by length, content order by d, q) as copy from starts),
gone as (select distinct d, unnest(range(q, q + length)) as q from runs where copy > 1),
gone_lines as (select d, n from gone join worded using (d, q)),
kept as (select l.d, string_agg(l.line, chr(10) order by l.n) as text from lines l left join gone_lines g on l.d = g.d and l.n = g.n where g.d is null group by l.d),
counted as (select d, count(*) as n_removed from gone_lines group by d)
select o.doc_id, case when o.text is null then null else coalesce(k.text, '') end as text, coalesce(c.n_removed, 0) as n_removed
from own o left join kept k using (d) left join counted c using (d)""",
}
