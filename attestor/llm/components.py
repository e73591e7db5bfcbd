"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star steps: every node hands its larger (then
its smaller) neighbours to the smallest one it knows. Both steps are a partial
aggregate and a join, so a node with very many links is split like any skewed
join. The rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (two columns of one type); root is the smallest node reachable.

    Links that have a null end or join a node with itself are passed over.
    """
    one, other = links.columns[:2]
    edges = saved(links.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).where("a > b and b is not null").distinct())
    before = _mark(edges)
    while before[0]:
        # large star: every neighbour above u gets u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written first, so that both sides of the join are dealt anew and a hub's links are split
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = saved(large)
        dropped(least)
        # small star: u and its smaller neighbours get the smallest of them
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after_edges = saved(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        dropped(edges)
        dropped(large)
        dropped(least)
        edges, now = after_edges, _mark(after_edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
