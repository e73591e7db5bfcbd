"""Deduplication, clusters and the statistics over claims and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


def dedupe(mentions: DataFrame, order: str = "span") -> tuple[DataFrame, DataFrame]:
    """(claims, extra evidence): of equal claims in a document the first most confident one stays.

    The others' places become further evidence of the one that stays.
    """
    window = Window.partitionBy(*keys.DEDUP).orderBy(F.col("confidence").desc(), "seq", order)
    ranked = mentions.withColumn("nth", F.row_number().over(window)).withColumn("primary_id", F.first("fact_id").over(window))
    extra = ranked.where("nth > 1").select(F.col("primary_id").alias("fact_id"), "doc_id", "page", order, "confidence")
    return ranked.where("nth = 1").drop("nth", "primary_id"), extra


def clusters(claims: DataFrame, least: int = 1) -> DataFrame:
    """cluster_key and size of every cluster of at least `least` claims."""
    return claims.groupBy(keys.cluster_key().alias("cluster_key"), "subject", "measure").agg(F.count("*").alias("size")).where(F.col("size") >= least)


def cluster_relations(claims: DataFrame, relations: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of at least `least` claims with how many relations lie inside; largest first."""
    inside = relations.groupBy("subject", "measure").agg(F.count("*").alias("n_relations"))
    out = clusters(claims, least).join(inside, ["subject", "measure"], "left")
    return out.select("cluster_key", "size", F.coalesce("n_relations", F.lit(0)).alias("n_relations")).orderBy(F.col("size").desc(), "cluster_key")


def canonical_summary(claims: DataFrame) -> DataFrame:
    """One row of exact distinct counts."""
    return claims.agg(
        F.count("*").alias("claims"),
        F.count_distinct("subject").alias("subjects"),
        F.count_distinct("measure").alias("measures"),
        F.count_distinct(F.nullif("issuer", F.lit(""))).alias("issuers"),
    )


def endpoints(relations: DataFrame) -> DataFrame:
    """Every claim that is an end of some relation, once."""
    # in one pass, as a union would form the relations twice
    return relations.select(F.explode(F.array("source_id", "target_id")).alias("fact_id")).distinct()


def beside(*frames: DataFrame) -> DataFrame:
    """One-row results as one row, by a union and an aggregate instead of a cross join."""
    columns = [c for f in frames for c in f.columns]
    rows = None
    for f in frames:
        wide = f.select(*[F.col(c).cast("long").alias(c) if c in f.columns else F.lit(None).cast("long").alias(c) for c in columns])
        rows = wide if rows is None else rows.unionByName(wide)
    return rows.agg(*[F.max(c).alias(c) for c in columns])


def coverage(claims: DataFrame, relations: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: verified and rejected claims, pass rate, and the shares in relations and in clusters of several."""
    percent = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(100 * a / b, 1))
    totals = claims.agg(F.count("*").alias("verified"))
    bad = rejected.agg(F.count("*").alias("rejected"))
    related = endpoints(relations).agg(F.count("*").alias("related"))
    grouped = clusters(claims, 2).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("clustered"))
    out = beside(totals, bad, related, grouped)
    return out.select(
        "verified", "rejected", F.when(F.col("verified") + F.col("rejected") == 0, 0.0).otherwise(F.round(F.col("verified") / (F.col("verified") + F.col("rejected")), 4)).alias("pass_rate"),
        "related", percent(F.col("related"), F.col("verified")).alias("related_pct"), "clustered", percent(F.col("clustered"), F.col("verified")).alias("clustered_pct"),
    )


def scale_metrics(claims: DataFrame) -> DataFrame:
    """Pairs that all claims, the clusters and the blocks would make, and the reduction."""
    pairs = lambda n: n * (n - 1) / 2
    everything = claims.agg(F.count("*").alias("n")).select(pairs(F.col("n")).cast("long").alias("all_pairs"))
    grouped = claims.groupBy("subject", "measure").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("cluster_pairs"))
    blocked = claims.groupBy("subject", "measure", "value_kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("block_pairs"))
    out = beside(everything, grouped, blocked)
    return out.withColumn("reduction", F.round(1 - F.col("block_pairs") / F.col("all_pairs"), 6))


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def filter_claims(claims: DataFrame, doc_id: str | None = None, subject: str | None = None, measure: str | None = None, min_confidence: float | None = None) -> DataFrame:
    for column, value in (("doc_id", doc_id), ("subject", subject), ("measure", measure)):
        if value is not None:
            claims = claims.where(F.col(column) == value)
    return claims if min_confidence is None else claims.where(F.col("confidence") >= min_confidence)


def filter_relations(relations: DataFrame, claims: DataFrame, relation: str | None = None, min_confidence: float | None = None, doc_id: str | None = None, fact_id: str | None = None) -> DataFrame:
    """Relations of one kind (whatever its case), confidence, document or claim on either side; most confident first."""
    if relation is not None:
        relations = relations.where(F.col("relation") == relation.lower())
    if min_confidence is not None:
        relations = relations.where(F.col("confidence") >= min_confidence)
    if fact_id is not None:
        relations = relations.where((F.col("source_id") == fact_id) | (F.col("target_id") == fact_id))
    if doc_id is not None:
        of = claims.where(F.col("doc_id") == doc_id).select("fact_id")
        source = relations.join(of.withColumnRenamed("fact_id", "source_id"), "source_id", "left_semi")
        target = relations.join(of.withColumnRenamed("fact_id", "target_id"), "target_id", "left_semi")
        relations = source.unionByName(target).dropDuplicates(["source_id", "target_id", "relation"])
    return relations.orderBy(F.col("confidence").desc(), "relation_id")


def inside(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations that have both ends among `claims`."""
    ids = claims.select("fact_id")
    return relations.join(ids.withColumnRenamed("fact_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("fact_id", "target_id"), "target_id", "left_semi")


def with_endpoints(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations with document and value of both ends (left joins)."""
    of = lambda side: claims.select(F.col("fact_id").alias(f"{side}_id"), F.col("doc_id").alias(f"{side}_doc"), F.col("value").alias(f"{side}_value"))
    return relations.join(of("source"), "source_id", "left").join(of("target"), "target_id", "left")


def history(claims: DataFrame, subject: str | None = None) -> DataFrame:
    """Claims of each (subject, measure, scope, modality) in the order of time, with their position; those without a start stay out."""
    rows = claims if subject is None else claims.where(F.col("subject") == subject)
    window = Window.partitionBy("subject", "measure", "scope", "modality").orderBy("period_start", F.coalesce("period_end", "period_start"), "seq")
    return rows.where("period_start is not null").withColumn("position", F.row_number().over(window))


def succession(claims: DataFrame) -> DataFrame:
    """Claims at a point in time, each with the next later one of its series, which replaces it."""
    window = Window.partitionBy("subject", "measure", "value_kind", "scope").orderBy("period_end", "seq")
    rows = claims.where("period_kind = 'instant'")
    return rows.withColumn("replaced_by", F.lead("fact_id").over(window)).withColumn("latest", F.col("replaced_by").isNull())


def round_robin(claims: DataFrame, n: int) -> DataFrame:
    """n claims taken in turn from the documents."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return claims.withColumn("turn", turn).orderBy("turn", "doc_id").limit(n)


def top_measures(claims: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent measures of each document."""
    counts = claims.groupBy("doc_id", "measure").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "measure"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one snapshot that the other doesn't hold (as often), with where they are missing."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
