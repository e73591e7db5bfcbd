"""From raw documents to balanced training shards, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; all but the last return the columns of documents. Every
stage's result is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import decontamination, mixing, near_dedup, quality, sharding
from attestor.llm.common import saved, table

#: Target shares of tokens by domain, and the budget over the tokens there are. Training runs on all clean text that has
#: come so far; a small share of toxic and low text is kept so that models know it when they see it. What those
#: domains lose goes to the clean ones. Where they hold less than their target, they aren't repeated: their share is
#: bounded by what there is (see mixing.bounded), so that no clean document is left out.
MIX_WEIGHTS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}
MIX_BUDGET = 1.0
#: Clashing doc_ids that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; a row whose score is ACCEPT or more stays, whatever its doc_id."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).where(F.col("score") >= quality.ACCEPT).select(*docs.columns)


def _identified(docs: DataFrame) -> DataFrame:
    """`docs` with `__id`: doc_id, or, for rows without one and for each of different texts under one, a hash of both.

    Rows that are equal in doc_id and text have one `__id`.
    """
    text = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("id"))
    kinds = docs.select("doc_id", text.alias("t")).where("doc_id is not null").groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    clashing = saved(kinds.where("a <> b").select("doc_id", F.lit(True).alias("__clash")))
    # rows of two numbers, checked before they are broadcast
    small = F.broadcast(clashing) if clashing.count() <= BROADCAST_ROWS else clashing.hint("merge")
    id_ = F.when(F.col("doc_id").isNull() | F.col("__clash"), text).otherwise(F.col("doc_id").cast("long"))
    return docs.join(small, "doc_id", "left").withColumn("__id", id_).drop("__clash")


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each near-duplicate group, once.

    Rows equal in doc_id and text are one document. A row without doc_id, and each of different
    texts under one doc_id, is a document of its own. Documents without words are in no group and stay.
    """
    rows = _identified(docs)
    kept = near_dedup.near_groups(rows.select(F.col("__id").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return rows.dropDuplicates(["__id"]).join(kept, "__id", "left_semi").select(*docs.columns)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a copy, also an edited one, of a test item; documents are told apart as in `_near_dedup`."""
    rows = _identified(docs)
    found = decontamination.find_copies(rows.select(F.col("__id").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")).distinct()
    return rows.join(found, "__id", "left_anti").select(*docs.columns)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by their rate, so that the domains' expected tokens meet MIX_WEIGHTS."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, docs, MIX_WEIGHTS, MIX_BUDGET, keep="clean")
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, shard and slot."""
    return sharding.byte_shards(docs)


STAGES = [
    ("quality classifier", _quality),
    ("MinHash near-dedup", _near_dedup),
    ("benchmark decontamination", _decontaminate),
    ("mixing sources to target weights", _mix),
    ("sharding", _shard),
]

#: The classifiers and alignments have no SQL form; tests/llm/test_pipeline.py holds every stage against what it should keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
