"""Lloyd's clustering of integer vectors with two trees.

1. *Trees.* The vectors are cut to blocks of `BLOCK_ROWS`, and each block gets a cover tree: a node has a vector as its centre and covers its
   rows within a radius; its children cover them within half of that, their centres are farther apart than it, and one of them is
   the node's own centre. Nodes of `LEAF_ROWS` rows or fewer aren't split. The trees are written once, as one row for each block.
2. *Rounds.* The few centroids get such a tree in every round. Node pairs are compared level by level from both roots: if
   a centroid node can't hold the nearest centroid of any row of a vector node, as another centroid is nearer for certain, the pair is dropped.
   A vector node with one centroid left goes to it as a whole, by its prefix sums. Pairs of leaves are compared row by row in
   exact integers, ties going to the smaller number.
3. *Update.* Every task gives one sum for each centroid and component, and these are added up by Spark. Sums and counts are exact.

The driver gets `clusters` times the number of components, never a vector but the first centroids.

Defined cases: vectors that are null, of another length, or with a null or non-finite component take no part; components beyond
`LIMIT` in size count as `LIMIT`, so that distances are exact; rows of one id are vectors of their own, and those that tie
for a first centroid are taken in the order of their components; a null id counts as an empty text there; fewer vectors than clusters make as
many clusters as vectors; an empty table gives an empty result; a sum beyond a long is null; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1
#: Size of a component at most.
LIMIT = 1 << 27
#: Vectors of one tree, and those of a node that isn't split any more.
BLOCK_ROWS, LEAF_ROWS = 1024, 16
#: Pairs compared at once; bounds the memory of a task.
PAIRS = 1 << 15
#: Bounds are floats: a pair is only dropped beyond this relative error.
SLACK = 1e-9


@dataclass
class Tree:
    """Node i has the centre `center[i]` (a row), covers the rows from `start[i]` to `end[i]` within `radius[i]`, and has the children from `child[i]` to `last[i]`."""

    rows: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    last: np.ndarray


def _distance(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
    difference = rows.astype(np.float64) - center
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def cover_tree(rows: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
    """The tree over `rows`, which it holds in the order of its nodes, and that order."""
    order = np.arange(len(rows))
    center, radius, start, end, child, last = [order[:1]], [0.0], [0], [len(rows)], [0], [0]
    node = 0
    while node < len(center):
        lo, hi = start[node], end[node]
        mine = order[lo:hi].copy()
        far = _distance(rows[mine], rows[center[node]])
        radius[node] = float(far.max()) * (1 + SLACK) if len(mine) else 0.0
        child[node] = last[node] = len(center)
        if hi - lo > leaf and far.max() > 0:
            # centres more than half of the radius apart; each takes what it covers of the rest, the node's own first
            half, near, place = far.max() / 2, [], lo
            now = center[node]
            while len(mine):
                covered = far <= half
                part = mine[covered]
                order[place : place + len(part)] = part
                near.append((now, place, place + len(part)))
                place += len(part)
                mine = mine[~covered]
                if len(mine):
                    now = mine[:1]
                    far = _distance(rows[mine], rows[now])
            for c, a, b in near:
                center.append(c)
                radius.append(0.0)
                start.append(a)
                end.append(b)
                child.append(0)
                last.append(0)
            last[node] = len(center)
        node += 1
    back = np.empty(len(rows), np.int64)
    back[order] = np.arange(len(rows))
    as_array = lambda x, kind=np.int64: np.array(x, kind)
    at = back[np.concatenate(center)] if len(rows) else np.zeros(1, np.int64)
    return Tree(rows[order], at, as_array(radius, np.float64), as_array(start), as_array(end), as_array(child), as_array(last)), order


def _products(count_a: np.ndarray, first_a: np.ndarray, count_b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) of each pair of ranges."""
    size = count_a * count_b
    of = np.repeat(np.arange(len(size)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return first_a[of] + within // np.maximum(count_b[of], 1), first_b[of] + within % np.maximum(count_b[of], 1)


def _exact(rows: np.ndarray, centroids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), PAIRS):
        difference = rows[a[lo : lo + PAIRS]].astype(np.int64) - centroids[b[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = np.einsum("ij,ij->i", difference, difference)
    return out


def _center_distance(vectors: Tree, centroids: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for lo in range(0, len(a), PAIRS):
        difference = vectors.rows[vectors.center[a[lo : lo + PAIRS]]].astype(np.float64) - centroids.rows[centroids.center[b[lo : lo + PAIRS]]]
        out[lo : lo + PAIRS] = np.sqrt(np.einsum("ij,ij->i", difference, difference))
    return out


def nearest(vectors: Tree, centroids: Tree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole ranges as start, end and centroid; rows compared one by one; their centroids).

    `number[j]` is the number of the centroid in row j of its tree. Every row of `vectors` is in one of the two.
    """
    whole: list[np.ndarray] = []
    points: list[np.ndarray] = []
    rivals: list[np.ndarray] = []
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(a):
        d = _center_distance(vectors, centroids, a, b)
        best = np.full(len(vectors.center), np.inf)
        np.minimum.at(best, a, d)
        # some centroid is within `best` of the node's centre, so within `best` + radius of each row
        spread = vectors.radius[a] + centroids.radius[b]
        keep = d - spread <= best[a] + vectors.radius[a] + SLACK * (1 + d + spread)
        a, b = a[keep], b[keep]
        rows_b = centroids.end[b] - centroids.start[b]
        rivals_of = np.bincount(a, rows_b, len(vectors.center)).astype(np.int64)
        sure = rivals_of[a] == 1
        whole.append(np.column_stack([vectors.start[a[sure]], vectors.end[a[sure]], number[centroids.start[b[sure]]]]))
        a, b, rows_b = a[~sure], b[~sure], rows_b[~sure]
        leaf_a, leaf_b = vectors.child[a] == vectors.last[a], centroids.child[b] == centroids.last[b]
        done = leaf_a & leaf_b
        done &= (np.bincount(a, ~done, len(vectors.center)) == 0)[a]  # all centroids of a row are compared together
        p, c = _products((vectors.end - vectors.start)[a[done]], vectors.start[a[done]], rows_b[done], centroids.start[b[done]])
        points.append(p)
        rivals.append(c)
        a, b, leaf_a, leaf_b = a[~done], b[~done], leaf_a[~done], leaf_b[~done]
        one = np.ones(len(a), np.int64)
        a, b = _products(
            np.where(leaf_a, one, vectors.last[a] - vectors.child[a]), np.where(leaf_a, a, vectors.child[a]),
            np.where(leaf_b, one, centroids.last[b] - centroids.child[b]), np.where(leaf_b, b, centroids.child[b]),
        )
    p, c = np.concatenate(points), np.concatenate(rivals)
    d = _exact(vectors.rows, centroids.rows, p, c)
    by = np.lexsort((number[c], d, p))
    first = by[np.flatnonzero(np.append(True, np.diff(p[by]) != 0))] if len(by) else by
    return np.concatenate(whole), p[first], number[c[first]]


def _to_row(tree: Tree, ids: pa.Array, name: str) -> pa.RecordBatch:
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([ids.to_pylist()], pa.list_(ids.type)), blob(tree.rows.astype(np.int32)), blob(tree.radius), blob(np.column_stack([tree.center, tree.start, tree.end, tree.child, tree.last]).astype(np.int32))],
        names=[name, "vectors", "radius", "nodes"],
    )


def _trees(components: int, name: str, most: int, leaf: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cover trees of `most` vectors, in the order in which they come."""

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            vectors = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            tree, order = cover_tree(vectors, leaf)
            return _to_row(tree, rows[name].combine_chunks().take(pa.array(order)), name)

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(most - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return build


def _read(batch: pa.RecordBatch, i: int, components: int) -> Tree:
    column = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
    nodes = column("nodes", np.int32).reshape(-1, 5).astype(np.int64)
    return Tree(column("vectors", np.int32).reshape(-1, components), nodes[:, 0], column("radius", np.float64), *nodes.T[1:])


def _summed(centroids: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums and counts of a task's vectors by centroid."""
        k, components = centroids.shape
        tree, number = cover_tree(centroids, 1)
        sums, counts = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = _read(batch, i, components)
                whole, rows, nearest_ = nearest(vectors, tree, number)
                before = np.concatenate([np.zeros((1, components), np.int64), np.cumsum(vectors.rows, 0, np.int64)])
                np.add.at(sums, whole[:, 2], before[whole[:, 1]] - before[whole[:, 0]])
                np.add.at(counts, whole[:, 2], whole[:, 1] - whole[:, 0])
                np.add.at(sums, nearest_, vectors.rows[rows])
                np.add.at(counts, nearest_, 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return add


def _assigned(centroids: np.ndarray, name: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, components = centroids.shape
        tree, number = cover_tree(centroids, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = _read(batch, i, components)
                whole, rows, nearest_ = nearest(vectors, tree, number)
                cluster = np.empty(len(vectors.rows), np.int64)
                for lo, hi, c in whole.tolist():
                    cluster[lo:hi] = c
                cluster[rows] = nearest_
                distance = _exact(vectors.rows, centroids, np.arange(len(cluster)), cluster)
                yield pa.RecordBatch.from_arrays([batch.column(name)[i].values, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[name, "cluster", "distance"])

    return assign


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component x, as a double; within `LIMIT`."""
    most = F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), most), -most)).cast("int"))


def kept_vectors(table: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """(key, x) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    whole = F.when(F.size(vector) == components, F.forall(vector, finite)).otherwise(F.lit(False))
    return table.where(F.coalesce(whole, F.lit(False))).select(key, integers(F.col(vector), scale).alias("x"))


def lloyd(table: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    rows = kept_vectors(table, key, vector, components, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    first = rows.select("x", hashed.alias("h")).orderBy("h", "x").limit(clusters).collect()  # `clusters` rows
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, components)
    result = f"`{key}` {kind}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = saved(rows.mapInArrow(_trees(components, key, block_rows, leaf_rows), f"`{key}` array<{kind}>, vectors binary, radius binary, nodes binary"))
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(centroids), "cluster int, n long, sums array<long>")
        total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(components)])
        centroids = centroids.copy()
        for r in total.collect():  # a row for each cluster
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(components)]
    found = saved(trees.mapInArrow(_assigned(centroids, key), result))
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).join(digests, "cluster")
    everything = found.agg(F.try_sum("distance").alias("inertia"))
    # both have a row for each cluster at most
    return found.join(F.broadcast(inertia.join(F.broadcast(everything))), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
