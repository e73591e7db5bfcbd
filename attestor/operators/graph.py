"""Bounded graph views over claims: entities, claims, evidence, documents and relations.

The graph is an edge list (source, target, type) and is never stored. A traversal is a driver
loop of at most `MAX_DEPTH` joins from the frontier to the edges; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_FANOUT = 4, 150, 25


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


def edges(claims: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, target, type): HAS_FACT, SUPPORTED_BY, LOCATED_IN and the relations in upper case.

    `evidence` is (fact_id, nth, doc_id), nth from 0.
    """
    place = F.concat(F.col("fact_id"), F.lit("#"), F.col("nth").cast("string"))
    has = claims.select(node("entity", F.col("subject")).alias("source"), node("fact", F.col("fact_id")).alias("target"), F.lit("HAS_FACT").alias("type"))
    supported = evidence.select(node("fact", F.col("fact_id")).alias("source"), node("evidence", place).alias("target"), F.lit("SUPPORTED_BY").alias("type"))
    located = evidence.select(node("evidence", place).alias("source"), node("document", F.col("doc_id")).alias("target"), F.lit("LOCATED_IN").alias("type"))
    related = relations.select(node("fact", F.col("source_id")).alias("source"), node("fact", F.col("target_id")).alias("target"), F.upper("relation").alias("type"))
    return has.unionByName(supported).unionByName(located).unionByName(related)


def edges_near(claims: DataFrame, evidence: DataFrame, relate: Callable[[DataFrame], DataFrame], nodes: DataFrame) -> DataFrame:
    """Edges that hold all those of some nodes (at most a traversal's bound): no other cluster than theirs forms relations.

    `relate` gives the relations among claims; a relation lies within a cluster (subject, measure).
    """
    part = lambda kind, pattern: nodes.where(F.col("node").startswith(f"{kind}:")).select(F.regexp_extract("node", f"(?s)^{kind}:{pattern}$", 1).alias("k")).distinct()
    among = lambda rows, key, keys: rows.join(F.broadcast(keys.withColumnRenamed("k", key)), key, "left_semi").select(*rows.columns)
    facts = part("fact", "(.*)").union(part("evidence", "(.*)#[^#]*")).distinct()
    mine = among(claims, "fact_id", part("fact", "(.*)"))
    # as many clusters as nodes at most
    clusters = claims.join(F.broadcast(mine.select("subject", "measure").distinct()), ["subject", "measure"], "left_semi").select(*claims.columns)
    held = mine.unionByName(among(claims, "subject", part("entity", "(.*)")))
    return edges(held, among(evidence, "fact_id", facts).unionByName(among(evidence, "doc_id", part("document", "(.*)"))), relate(clusters))


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("source").alias("at"), F.col("target").alias("to")).union(graph.select("target", "source"))


def neighborhood(graph: DataFrame | Callable[[DataFrame], DataFrame], root: str, depth: int, max_nodes: int = MAX_NODES, max_fanout: int = MAX_FANOUT, spark: SparkSession | None = None) -> DataFrame:
    """(node, depth, truncated): what can be reached from `root` in `depth` steps.

    Each node leads to its first `max_fanout` neighbours by id; nodes are taken in the order of
    (depth, id) until there are `max_nodes`. `truncated` says whether either bound cut something. Empty for an unknown root.
    `graph` is all edges, or (with `spark`) a function that gives those of some nodes (node), and maybe others.
    """
    spark = spark or graph.sparkSession
    near = graph if callable(graph) else lambda nodes: graph
    start = spark.createDataFrame([(root,)], "node string")
    # a level reads its edges several times, whose relations come from a large join
    steps = both_ways(near(start)).persist()
    known = steps.where(F.col("at") == root).limit(1).count()
    found = spark.createDataFrame([(root, 0)] if known else [], "node string, depth int")
    frontier, total, cut = found, 1, False
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        if not known or total >= max_nodes:
            break
        if level > 1 and callable(graph):
            steps.unpersist()
            steps = both_ways(near(frontier.select("node"))).persist()
        # the frontier has at most max_nodes rows
        reached = steps.join(F.broadcast(frontier.select(F.col("node").alias("at"))), "at").distinct()
        order = F.row_number().over(Window.partitionBy("at").orderBy("to"))
        reached = reached.withColumn("nth", order)
        new = reached.where(F.col("nth") <= max_fanout).select(F.col("to").alias("node")).distinct().join(F.broadcast(found.select("node")), "node", "left_anti")
        rows = [r["node"] for r in new.orderBy("node").limit(max_nodes - total + 1).collect()]
        cut = cut or len(rows) > max_nodes - total or bool(reached.where(F.col("nth") > max_fanout).limit(1).count())
        rows = rows[: max_nodes - total]
        if not rows:
            break
        frontier = spark.createDataFrame([(r, level) for r in rows], "node string, depth int")
        found = found.unionByName(frontier)
        total += len(rows)
    steps.unpersist()
    return found.withColumn("truncated", F.lit(cut))


def present_edges(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among some nodes."""
    ids = nodes.select("node")
    return graph.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi").distinct()


def fact_lineage(graph: DataFrame | Callable[[DataFrame], DataFrame], fact_id: str, spark: SparkSession | None = None) -> DataFrame:
    return neighborhood(graph, f"fact:{fact_id}", 1, 60, spark=spark)


def relation_lineage(graph: DataFrame | Callable[[DataFrame], DataFrame], source_id: str, target_id: str, spark: SparkSession | None = None) -> DataFrame:
    """Both ends' lineages as one; a node in both belongs to the first."""
    one = fact_lineage(graph, source_id, spark).withColumn("branch", F.lit(1))
    two = fact_lineage(graph, target_id, spark).withColumn("branch", F.lit(2))
    first = F.row_number().over(Window.partitionBy("node").orderBy("branch"))
    return one.unionByName(two).withColumn("nth", first).where("nth = 1").drop("nth")


def search(claims: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(type, id, label): subjects, then documents, then claims that contain the text, whatever its case."""
    has = lambda c: F.lower(F.col(c)).contains(text.lower())
    one = claims.where(has("subject")).select(F.lit(1).alias("turn"), F.lit("entity").alias("type"), F.col("subject").alias("id")).distinct()
    two = claims.where(has("doc_id")).select(F.lit(2).alias("turn"), F.lit("document").alias("type"), F.col("doc_id").alias("id")).distinct()
    three = claims.where(has("measure") | has("subject")).select(F.lit(3).alias("turn"), F.lit("fact").alias("type"), F.col("fact_id").alias("id"))
    cap = limit * 3
    out = one.orderBy("id").limit(cap).unionByName(two.orderBy("id").limit(cap)).unionByName(three.orderBy("id").limit(cap))
    return out.orderBy("turn", "id").limit(limit)
