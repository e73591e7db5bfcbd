"""Queries on resolution, verification, storage and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve, verify
from ..sources.claims import CLAIM_COLUMNS, claims, table
from ..sources.scratch import fresh_folder
from ..streaming.ingest import IncrementalStore, start
from .pair_queries import RELATIONS_SQL


def _folder(spark) -> str:
    return fresh_folder(spark, "ingest")


def x08_subjects(spark, sf_dir):
    """Suppliers, some written as institutions."""
    raw = F.element_at(F.lit(["R.B.I", "The RBI", "RBI", "Indian economy", "x"]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 4, F.concat(F.lit("Unit "), F.col("s_suppkey").cast("string"), F.lit(" Ltd."))).otherwise(raw).alias("subject_raw"))
    return resolve.resolve_subjects(rows).select("s_suppkey", "subject")


def x09_issuers(spark, sf_dir):
    raw = F.element_at(F.lit(["IMF staff", "India", "GoI", "Moody", " "]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return resolve.resolve_issuers(table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("issuer_raw"))).select("s_suppkey", "issuer")


def x10_indicators(spark, sf_dir):
    raw = F.element_at(F.lit(["Reserve Money", "Acme", "Broad Money (M3)"]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("subject_raw"), F.lit("% change").alias("measure_raw"))
    return resolve.pivot_indicators(rows).select("s_suppkey", "subject_raw", "measure_raw")


def x07_measures(spark, sf_dir):
    """Part types as measures: aliases, repeats and new ones by the order of arrival."""
    raw = F.when(F.col("p_partkey") % 4 == 0, "Net Profit").when(F.col("p_partkey") % 4 == 1, "Revenue from operations").otherwise(F.col("p_type"))
    rows, _ = resolve.resolve_measures(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), raw.alias("measure_raw")))
    return rows.select("seq", "measure_raw", "measure", "tier")


def st02_registry(spark, sf_dir):
    """Part names as measures in two batches, small parts first: the registry of the first goes into the second."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("measure_raw"), "p_size")
    small, registry = resolve.resolve_measures(parts.where("p_size <= 25"))
    large, _ = resolve.resolve_measures(parts.where("p_size > 25 or p_size is null"), registry)
    return small.unionByName(large).select("seq", "measure_raw", "measure", "tier", "confidence")


def a07_resolution_summary(spark, sf_dir):
    return resolve.summary(x07_measures(spark, sf_dir))


def f39_fuzzy_resolve(spark, sf_dir):
    """Misspelt part names against the right ones: the last letter is doubled."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    rows = parts.withColumn("name", F.concat("name", F.substring("name", -1, 1)))
    return resolve.best_match(rows, parts, threshold=0.9).select("name", "match", "ratio")


def f11_verify_value(spark, sf_dir):
    """Order totals against quotes: the same, rounded, another number, a percentage, none, two numbers."""
    key, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    quote = (
        F.when(key % 6 == 0, F.concat(F.lit("a total of "), F.format_number(whole, 0)))
        .when(key % 6 == 1, F.concat(F.lit("it was "), (whole * 3 + 1).cast("string")))
        .when(key % 6 == 2, F.concat(F.lit("it was "), whole.cast("string"), F.lit("%")))
        .when(key % 6 == 3, "nothing stated")
        .when(key % 6 == 4, F.concat(whole.cast("string"), F.lit(" in FY2024, up from "), (whole + 7).cast("string")))
        .otherwise(F.concat(F.lit("USD "), whole.cast("string"), F.lit(" in FY2024")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", whole.cast("string").alias("value_raw"), quote.alias("quote"), F.lit("").alias("context"))
    return verify.check_values(rows).select("o_orderkey", "status", "reason")


def x03_verify_build(spark, sf_dir):
    """A raw record of each document with 100 characters or more: its quote starts anywhere in the text and has its blanks doubled."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 100")
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), "text")
    start = (F.pmod(F.hash("doc_id"), F.length("text") - 60) + 1).cast("int")
    quote = F.when(F.col("doc_id") % 30 == 0, F.lit("words that stand in no document at all")).otherwise(F.regexp_replace(F.substring(F.col("text"), start, F.lit(60)), " ", "  "))
    raw = docs.select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("subject_raw"), F.lit("status").alias("measure_raw"), F.lit("active").alias("value_raw"),
        F.lit("FY2023-24").alias("period_raw"), F.lit("").alias("scope_raw"), F.lit(None).cast("string").alias("issuer_raw"), F.lit("asserted").alias("modality"), quote.alias("quote"),
    )
    return verify.build_claims(raw, pages).select("seq", "rejected", "value_kind", "confidence")


def st01_streaming_ingest(spark, sf_dir):
    """All claims as a stream of files that cut documents apart; the relations that build up are those of one batch over all."""
    folder = _folder(spark)
    rows = claims(spark, sf_dir)
    # three batches of four files however many claims there are, as each batch meets all claims before it
    rows.repartition(12, "fact_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    store = IncrementalStore(spark, f"{folder}/store")
    query = start(stream, store, f"{folder}/progress")
    query.awaitTermination()
    found = store.read("relations")
    return found.select(F.least("source_id", "target_id").alias("one"), F.greatest("source_id", "target_id").alias("other"), "relation", "reason_code")


def j02_two_batches(spark, sf_dir):
    """Two incremental ingests without a stream: documents before 1995 first."""
    store = IncrementalStore(spark, _folder(spark))
    rows = claims(spark, sf_dir).select(*CLAIM_COLUMNS)
    store.ingest(rows.where("doc_id < '1995'"), 0)
    store.ingest(rows, 1)
    found = store.read("relations")
    return found.groupBy("relation").agg(F.count("*").alias("n"))


QUERIES = {
    "X-07_measures": x07_measures, "X-08_subjects": x08_subjects, "X-09_issuers": x09_issuers, "X-10_indicators": x10_indicators, "A-07_resolution_summary": a07_resolution_summary, "ST-02_measure_registry": st02_registry,
    "F-39_fuzzy_resolve": f39_fuzzy_resolve, "F-11_verify_value": f11_verify_value, "X-03_verify_build": x03_verify_build, "ST-01_streaming_ingest": st01_streaming_ingest,
    "S-09_incremental_save": j02_two_batches,
}

SQL = {
    "X-08_subjects": "select s_suppkey, case s_suppkey % 5 when 0 then 'r b i' when 1 then 'the rbi' when 2 then 'Reserve Bank of India' when 3 then 'india' else concat('unit ', s_suppkey) end as subject from supplier",
    "X-09_issuers": "select s_suppkey, case s_suppkey % 5 when 0 then 'IMF' when 2 then 'Government of India' when 3 then 'Moody' end as issuer from supplier",
    "X-10_indicators": "select s_suppkey, case s_suppkey % 3 when 1 then 'Acme' else 'india' end as subject_raw, case s_suppkey % 3 when 0 then 'reserve_money_growth' when 1 then '% change' else 'broad_money_growth' end as measure_raw from supplier",
    "F-11_verify_value": """select o_orderkey, case o_orderkey % 6 when 0 then 'verified' when 1 then 'mismatch' when 5 then 'verified' else 'unverified' end as status,
        case o_orderkey % 6 when 0 then 'value_matches_sole_quote_number' when 1 then 'value_disagrees_with_sole_quote_number' when 2 then 'percent_vs_non_percent_ambiguous'
        when 3 then 'quote_contains_no_numeric_literal' when 4 then 'multiple_numeric_candidates_in_quote_ambiguous' else 'value_matches_sole_quote_number' end as reason from orders""",
    "X-03_verify_build": "select doc_id as seq, case when doc_id % 30 = 0 then 'quote_not_found' end as rejected, 'text' as value_kind, 1.0::double as confidence from documents where length(text) > 100",
    "F-39_fuzzy_resolve": "with n as (select distinct p_name as name from part) select concat(name, name[-1]) as name, name as match, round(2.0 * length(name) / (2 * length(name) + 1), 6)::double as ratio from n",
    "S-09_incremental_save": f"with {RELATIONS_SQL} select relation, count(*) as n from relations group by relation",
    "ST-01_streaming_ingest": f"with {RELATIONS_SQL} select least(source_id, target_id) as one, greatest(source_id, target_id) as other, relation, reason_code from relations",
}
