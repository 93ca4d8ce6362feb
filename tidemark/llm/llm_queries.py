"""Queries of the corpus operators over the given tables, with their parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, langid, line_dedup, near_dedup, packing, quality, simhash, substring_dedup, token_counts, topk, warc, whitening
from .common import table


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the same on driver and executors."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.5)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, tokens=2048, segments=64, loss=2048)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), similarity=80)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _held_out(divisor: int, remainder: int):
    """False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs.where(~_held_out(4, 2)))
    return langid.identify(docs, samples).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(~_held_out(3, 1)))
    return quality.classify(docs, weights).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, most=4)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)
    return made.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_top_k": op5_top_k,
    "op6_near_dedup": op6_near_dedup,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body))::bigint as payload_bytes, sha1(body) as payload_digest, body from p),
m as (select payload_digest, max(page_id) as last from d where payload_bytes >= 1000 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when d.payload_bytes >= 1000 and d.page_id <> m.last then 'revisit' else 'response' end as record_type,
  case when d.payload_bytes >= 1000 and d.page_id <> m.last then m.last end as refers_to
from d left join m on d.payload_digest = m.payload_digest and d.payload_bytes >= 1000
""",
    "op4_substring_dedup": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(range(1, greatest(len(w) - 11, 1))) as i, w from d),
r as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as h from p),
f as (select doc_id, i, min(doc_id) over (partition by h) as first from r),
c as (select distinct doc_id, i + j as k from f, unnest(range(0, 13)) as t(j) where first < doc_id),
n as (select doc_id, list(k) as gone from c group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(coalesce(gone, []), k)), lambda k: w[k]), ' '), '')) as kept_sha256
from d left join n using (doc_id)
""",
    "op5_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as z from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.z, b.z), lambda t: coalesce(t[1], 0) * coalesce(t[2], 0)))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""",
    "op6_near_dedup": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
e as (select doc_id, unnest(g) as h from s),
n as (select doc_id, len(g) as n from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
u as (select x, y from l union select y, x from l),
r as (select doc_id, doc_id as c from d union select u.y, r.c from r join u on u.x = r.doc_id),
m as (select doc_id, min(c) as component_id from r group by 1)
select doc_id, n.n as n_shingles, component_id, doc_id = component_id as kept from m join n using (doc_id)
""",
}
