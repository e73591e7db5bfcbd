"""Queries of the training-text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, clustering, decontamination, language_id, merkle, mixing, near_dedup, quality, repetition, secrets, sharding, substring_dedup, topk_search
from .common import saved, table
from .contract_sql import OP11_SQL, OP12_SQL, OP13_SQL


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = saved(docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc")))
    out = sharding.byte_shards(slim, size="size", crc="crc")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Production targets: shares of the expected tokens by domain.
MIX_WEIGHTS = {"clean": 0.95, "toxic": 0.03, "low": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), docs, MIX_WEIGHTS)
    return out.select("doc_id", "tokens", "p", "rate", "copies", "gap")


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "covered_bytes", "base_failed", "kept")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, {"text": merkle.tampered(F.col("doc_id"), F.col("text"))})


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_secret_scan, op2_sharding, op3_suffix_array_dedup, op4_quality_classifier, op5_mixing, op6_exact_topk_search, op7_benchmark_decontamination, op8_minhash_near_dedup, op9_language_id, op10_substring_dedup, op11_quality_rules, op12_merkle_manifest, op13_centroid_clustering]
    return {f.__name__: f for f in found}


OP6_SQL = """
    with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
        from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) as bigint) as score
        from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id
    ), ranked as (
        select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
    )
    select query_id, rank, vec_id, score from ranked where rank <= 5
"""


OP8_SQL = """
    with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
    ), sets as (
        select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
    ), held as (select doc_id, len(s) as n, unnest(s) as g from sets
    ), pairs as (
        select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
        from held a join held b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
    ), links as (select a, b from pairs where 100 * i >= 75 * (na + nb - i)
    ), reach(doc_id, other) as (select doc_id, doc_id from sets union select links.b, reach.other from reach join links on links.a = reach.doc_id)
    select sets.doc_id, cast(len(any_value(s)) as bigint) as n_shingles, min(other) as component_id, sets.doc_id = min(other) as kept
    from sets join reach on sets.doc_id = reach.doc_id group by sets.doc_id
"""


def oracle_sql() -> dict[str, str]:
    made = {"op11_quality_rules": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
    return {"op8_minhash_near_dedup": OP8_SQL, "op6_exact_topk_search": OP6_SQL} | made
