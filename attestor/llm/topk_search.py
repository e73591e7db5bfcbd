"""Exact top-k by inner product with block-at-a-time pruning.

Vector components are the terms. Candidates are dealt to ranges of rows that resemble one of at most `PIVOTS`
sample rows each, and in a range they are put in order and cut into blocks of `BLOCK` rows.

1. For each block the maximum and minimum of every term are summed up; they bound what any of its rows can score.
2. Every query gets its bound for each range, the best of the range's blocks, and scores the range of its best bound. Its k-th
   score there is a threshold that holds everywhere.
3. Only ranges whose bound reaches the threshold get the query. There it takes the blocks in order of its bound,
   scores them through their forward index (the block's rows as a dense integer matrix) and stops when the next bound
   is below its k-th score or the threshold. The k best of all ranges are merged at the end.

The queries are a stated set that grows with the table; neither they nor the candidates are broadcast, and they meet
ranges and summaries in blocks. How much is skipped depends on the data: nearly all of well clustered rows, little or nothing of
rows spread evenly in many dimensions, whose blocks all bound alike (see `pruning`).

Defined cases: components are floor(256 * x) in double precision; vectors that
are null, or hold null or non-finite components or ones of 2 ** 62 or more, take no part, nor do rows without
a vec_id; of repeated vec_ids one row, the one that is smallest as bytes, is the query, none is its candidate, and each can be found; shorter vectors count as padded
with zeros; with fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .textbatch import key_runs

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Rows of a range and of a chunk of queries, about; ranges whose summaries one task holds.
RANGE_ROWS, CHUNK_ROWS, BLOCK, SUMMARIES = 2048, 2048, 64, 256
#: Sample rows that ranges form around, at most; bounds what is broadcast.
PIVOTS = 512
#: Components from here on (as whole numbers) are out of range.
LIMIT = 2.0**62


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors take part, as little-endian 8-byte integers."""
    for batch in batches:
        vectors = batch.column("embedding")
        keep, blobs = [], []
        for i in range(batch.num_rows):
            if not vectors[i].is_valid:
                continue
            values = vectors[i].values
            if values is None or values.null_count:
                continue
            x = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64))
            if (np.abs(x) < LIMIT).all():  # false for what isn't finite
                keep.append(i)
                blobs.append(x.astype(np.int64).tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at).cast(pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "x"])


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width), np.int64)
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def _number_kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """What inner products of the two are exact in."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object if top >= 2**63 else np.int64


def _in_order(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows that resemble each other side by side: by their largest terms."""
    strong = np.argsort(-np.abs(rows), axis=1, kind="stable")[:, :2]
    return np.lexsort((ids, strong[:, -1], strong[:, 0]))


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, block: int = BLOCK, floor: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best rows, padded with the lowest integer and -1.

    `floor` has scores below which a query needs no rows; `seen` gets the numbers of (query, block) pairs scored and there are.
    """
    lowest = np.iinfo(np.int64).min
    best = np.full((len(queries), k), lowest)
    found = np.full((len(queries), k), -1, np.int64)
    if not len(rows) or not len(queries):
        return best, found
    kind = _number_kind(rows, queries)
    order = _in_order(ids, rows)
    r, q, ids = rows[order].astype(kind), queries.astype(kind), ids[order]
    least = np.full(len(q), lowest) if floor is None else floor
    start = np.arange(0, len(r), block)
    high, low = np.maximum.reduceat(r, start), np.minimum.reduceat(r, start)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bound, axis=1, kind="stable")
    active, scored = np.arange(len(q)), 0
    for step in range(len(start)):
        nth = turn[active, step]
        # an equal bound may still hide an equal score with a smaller id
        go = bound[active, nth] >= np.maximum(best[active, -1], least[active])
        active, nth = active[go], nth[go]
        scored += len(active)
        if not len(active):
            break
        by = np.argsort(nth, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(nth[by])) + 1):
            some, b = active[part], nth[part[0]]
            score = (q[some] @ r[start[b] : start[b] + block].T).astype(np.int64)
            own = ids[start[b] : start[b] + block]
            score[query_ids[some][:, None] == own[None]] = lowest
            better = (score >= best[some, -1:]).any(axis=1)
            some, score = some[better], score[better]
            s = np.concatenate([best[some], score], axis=1)
            i = np.concatenate([found[some], np.broadcast_to(own, score.shape)], axis=1)
            pick = np.lexsort((i, -np.maximum(s, lowest + 1)), axis=1)[:, :k]
            best[some], found[some] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    if seen is not None:
        seen.append((scored, len(q) * len(start)))
    found[best == lowest] = -1
    return best, found


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maxima and minima of each range's blocks."""
    for batch in key_runs(batches, "range"):
        of = batch.column("range").to_numpy(zero_copy_only=False)
        ids, blobs = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("x").to_pylist()
        edge = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        out = [[], [], []]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            x = _matrix(blobs[i:j], max(map(len, blobs[i:j])) // 8)
            x = x[_in_order(ids[i:j], x)]
            start = np.arange(0, len(x), BLOCK)
            for h, lo in zip(np.maximum.reduceat(x, start), np.minimum.reduceat(x, start), strict=True):
                for c, v in zip(out, (int(of[i]), h.tobytes(), lo.tobytes()), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["range", "x", "low"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best bound of each range's blocks for each query of the same cell."""
    for batch in key_runs(batches, "cell"):
        cell, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "query"))
        ids, of = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("range").to_numpy(zero_copy_only=False)
        high, low = batch.column("x").to_pylist(), batch.column("low").to_pylist()
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            asks, has = i + np.flatnonzero(query[i:j]), i + np.flatnonzero(~query[i:j])
            if not len(asks) or not len(has):
                continue
            has = has[np.argsort(of[has], kind="stable")]
            width = max(max(map(len, high[i:j])) // 8, 1)
            q, h, lo = _matrix([high[a] for a in asks], width), _matrix([high[a] for a in has], width), _matrix([low[a] for a in has], width)
            # a query that lacks terms that the rows have is padded with zeros, and so are blocks
            kind = _number_kind(np.concatenate([h, lo]), q)
            bound = np.maximum(q, 0).astype(kind) @ h.T.astype(kind) + np.minimum(q, 0).astype(kind) @ lo.T.astype(kind)
            first = np.flatnonzero(np.append(True, of[has][1:] != of[has][:-1]))
            best = np.maximum.reduceat(bound, first, axis=1)
            best = np.array([[min(x, 2**63 - 1) for x in row] for row in best], np.int64) if kind is object else best.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asks], len(first))), pa.array(np.tile(of[has][first], len(asks))), pa.array(best.reshape(-1))], names=["query_id", "range", "bound"])


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in key_runs(batches, "cell"):
            cell, query, ids, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "query", "vec_id", "floor"))
            blobs = batch.column("x").to_pylist()
            width = max(map(len, blobs)) // 8
            edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                x, q, seen = _matrix(blobs[i:j], width), query[i:j], []
                if not q.any() or q.all():
                    continue
                score, found = search(ids[i:j][~q], x[~q], ids[i:j][q], x[q], k, BLOCK, floor[i:j][q], seen)
                real = score > np.iinfo(np.int64).min
                of = np.broadcast_to(ids[i:j][q][:, None], found.shape)
                scored, total = np.zeros((2, int(real.sum())), np.int64) if real.any() else np.zeros((2, 0), np.int64)
                if len(scored):  # once for the cell
                    scored[0], total[0] = seen[0]
                yield pa.RecordBatch.from_arrays([pa.array(of[real]), pa.array(found[real]), pa.array(score[real]), pa.array(scored), pa.array(total)], names=["query_id", "vec_id", "score", "scored", "blocks"])

    return run


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """`rows` with `range`: those most like one of the sample rows, in parts of about RANGE_ROWS."""
    few = max(1, min(PIVOTS, n // RANGE_ROWS))
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(few).collect()]
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("x").to_pylist()
            width = max(map(len, [*blobs, *shared.value, b"\0" * 8])) // 8
            p, x = _matrix(shared.value, width).astype(np.float64), _matrix(blobs, width).astype(np.float64)
            unlike = (p**2).sum(axis=1) - 2 * x @ p.T if len(p) else np.zeros((len(x), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unlike.argmin(axis=1))], names=["vec_id", "x", "pivot"])

    near = saved(rows.mapInArrow(nearest, "vec_id long, x binary, pivot long"))
    # at most PIVOTS sizes
    parts = {r["pivot"]: -(-r["n"] // RANGE_ROWS) for r in near.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for pivot in sorted(parts):
        first[pivot] = total
        total += parts[pivot]
    table = rows.sparkSession.createDataFrame([(p, first[p], parts[p]) for p in parts], "pivot long, first long, parts long")
    near = near.join(F.broadcast(table), "pivot")
    return near.select("vec_id", "x", (F.col("first") + F.pmod(F.xxhash64("vec_id", "x"), "parts")).alias("range"))


def _searched(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The k best of each range that a query has to look at, with the numbers of blocks scored and met."""
    rows = saved(vectors.select("vec_id", "embedding").where("vec_id is not null").mapInArrow(_integers, "vec_id long, x binary"))
    n = rows.count()
    ranged = saved(_ranges(rows, n))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // CHUNK_ROWS))
    queries = saved(queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")))

    summary = saved(ranged.repartition("range").sortWithinPartitions("range").mapInArrow(_summary, "range long, x binary, low binary"))
    groups = int((summary.agg(F.max("range")).first()[0] or 0) // SUMMARIES) + 1
    copies = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    none = F.lit(None).cast("binary")
    mine = summary.select(F.floor(F.col("range") / SUMMARIES).alias("g"), copies(chunks).alias("c"), F.lit(False).alias("query"), F.lit(0).cast("long").alias("vec_id"), "range", "x", "low")
    theirs = queries.select(copies(groups).alias("g"), F.col("chunk").cast("long").alias("c"), F.lit(True).alias("query"), "vec_id", F.lit(-1).cast("long").alias("range"), "x", none.alias("low"))
    met = mine.unionByName(theirs).withColumn("cell", F.col("g") * chunks + F.col("c")).drop("g", "c")
    bounds = saved(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_bounds, "query_id long, range long, bound long"))

    def scored(pairs: DataFrame) -> DataFrame:
        """`pairs` (query_id, range, floor) looked up."""
        asked = pairs.join(queries.withColumnRenamed("vec_id", "query_id").hint("merge"), "query_id")
        asked = asked.select((F.col("range") * chunks + F.col("chunk")).alias("cell"), F.lit(True).alias("query"), F.col("query_id").alias("vec_id"), "x", "floor")
        wanted = saved(asked.select("cell").distinct().select("cell", F.floor(F.col("cell") / chunks).alias("range")))
        has = ranged.join(wanted.hint("merge"), "range").select("cell", F.lit(False).alias("query"), "vec_id", "x", F.lit(0).cast("long").alias("floor"))
        cells = asked.unionByName(has)
        return saved(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(k), "query_id long, vec_id long, score long, scored long, blocks long"))

    best = bounds.groupBy("query_id").agg(F.max(F.struct("bound", (-F.col("range")).alias("r"))).alias("b")).select("query_id", (-F.col("b.r")).alias("range"))
    lowest = F.lit(-(2**63) + 1).cast("long")
    first = scored(best.withColumn("floor", lowest))
    # fewer than k rows give no threshold
    floor = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("low")).otherwise(lowest).alias("floor"))
    rest = bounds.join(best.withColumnRenamed("range", "done").hint("merge"), "query_id").where("range <> done")
    rest = rest.join(floor.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", lowest)).where("bound >= floor")
    return first.unionByName(scored(rest.select("query_id", "range", "floor")))


def top_k(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score; queries are the rows whose vec_id `every` divides."""
    found = _searched(vectors, every, k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def pruning(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> tuple[int, int]:
    """(query, block) pairs that are scored, and pairs that there are."""
    found = _searched(vectors, every, k)
    scored = found.agg(F.sum("scored")).first()[0] or 0
    rows = vectors.where("vec_id is not null").count()
    return scored, -(-rows // BLOCK) * vectors.where(F.col("vec_id") % every == 0).select("vec_id").distinct().count()
