"""Named queries over the driver's tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import cluster_queries, document_queries, evidence_queries, extraction_queries, function_queries, ingest_queries, job_queries, more_queries, page_queries, pair_queries, retrieval_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [pair_queries, cluster_queries, retrieval_queries, function_queries, document_queries, evidence_queries, extraction_queries, ingest_queries, job_queries, more_queries, page_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated relations of all claims, counted by relation and reason."""
    return pair_queries.j01_relations(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
