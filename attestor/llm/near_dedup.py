"""Near-duplicate groups by an LSH forest of MinHash signatures.

1. Every whole text becomes its set of 5-word shingles and a signature of
   `TREES` x `LEVELS` minimum hashes. Equal sets are one class from here on.
2. Each tree is an order of the classes by their signatures, read from a place of its own on and round to its start.
   Neighbours in that order with a common prefix are candidates. The depth is adapted to the
   region: the shortest of `DEPTHS` prefixes that at most `REGION` rows share. A region is sorted and
   compared whole, or, over `BLOCK` rows, in blocks of which each two meet in a task of their own, so nothing
   is left out. Rows that share the whole signature and are still too many are tied to the smallest of them.
3. In a region, neighbours whose whole signatures agree in about `LOOSE` of the
   places are joined; only a spanning forest leaves the task. Its connected
   components are families, far looser than the links asked for.
4. In each family (in blocks, if large) the full shingle sets are compared and the
   links with 100 * intersection >= 75 * union are kept. Components of those links are the result.

A pair at similarity 0.75 shares two values in one of 24 trees but for odds of
0.4375 ** 24 (3e-9). `LOOSE` is 4.8 standard errors below 0.75: a pair at 0.75 misses it with odds of about 3e-6. In regions over `REGION`
rows the odds for four values are 1e-4, for eight 0.08; there each document has many thousand neighbours, and
it takes one link of its own, or two that lead round, to be placed.

Defined cases: ASCII blanks separate words and A-Z are lower-cased; a text of
fewer than five words is one shingle; one without words (null, empty, blank) has
an empty set and is linked with nothing; doc_id is a key: repeated rows of one
doc_id are taken as copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .components import components
from .textbatch import SHINGLE_WORDS, key_runs, mix64, pieces, shingle_sets, utf8, words

TREES, LEVELS = 24, 5
#: Values of a common prefix; the first is that of two 32-bit hashes, the others go on in their lowest bytes.
DEPTHS = (2, 4, 8, 16, 32, 64, TREES * LEVELS)
REGION, BLOCK = 16384, 1024
LOOSE = 0.56
#: Documents of a family that one task compares at once are two blocks of this.
FAMILY_BLOCK = 256
PERCENT = 75
#: Rows of three integers that may be broadcast (some 50 MB).
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240613)
_FLIP = _rng.integers(0, 1 << 63, TREES * LEVELS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of TREES * LEVELS minimum hashes for each set; zeros for an empty one."""
    out = np.zeros((len(offsets) - 1, TREES * LEVELS), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for j in range(TREES * LEVELS):
            out[full, j] = np.minimum.reduceat((((sets ^ _FLIP[j]) * _TIMES[j]) >> np.uint64(32)).astype(np.uint32), offsets[:-1][full])
    return out


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(words(data, offsets), SHINGLE_WORDS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for lo, hi in pieces(offsets):
            sets, at = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = hi - lo
            size = np.diff(at)
            full = np.flatnonzero(size)
            key = np.zeros((2, n), np.uint64)
            if len(full):
                key[0, full] = np.add.reduceat(sets, at[:-1][full])
                key[1, full] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
            sig = signatures(sets, at)
            tree = sig.reshape(n, TREES, LEVELS).astype(np.uint64)
            shallow = (tree[:, :, 0] << np.uint64(32)) | tree[:, :, 1]
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), TREES).cast(pa.list_(pa.int64()))
            lane = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TREES * LEVELS), n, [None, pa.py_buffer(np.ascontiguousarray(sig & 0xFF).astype(np.uint8))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), lane, lists(shallow)],
                names=["doc_id", "n_shingles", "k1", "k2", "lanes", "shallow"],
            )


def _forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for the components of a boolean matrix, without the roots themselves."""
    seen = np.zeros(len(ids), bool)
    member, root = [], []
    for i in np.argsort(ids, kind="stable"):
        if seen[i]:
            continue
        seen[i] = True
        edge = np.array([i])
        while len(edge):
            reach = linked[edge].any(axis=0) & ~seen
            edge = np.flatnonzero(reach)
            seen |= reach
            member.append(ids[edge])
            root.append(np.full(len(edge), ids[i]))
    return (np.concatenate(member), np.concatenate(root)) if member else (ids[:0], ids[:0])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each region (rows of one `cell`) by agreement of signatures."""
    need = int(np.ceil(LOOSE * TREES * LEVELS))
    for batch in key_runs(batches, "cell"):
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        lanes = np.frombuffer(b"".join(batch.column("lanes").to_pylist()), np.uint8).reshape(len(ids), -1)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(first, len(cell)))
        small = np.repeat(size <= 16, size)
        member, root = [], []
        for step in range(1, int(min(16, size.max()))):
            a = np.flatnonzero((cell[:-step] == cell[step:]) & small[:-step])
            for part in np.array_split(a, len(a) // 20000 + 1):
                near = part[(lanes[part] == lanes[part + step]).sum(axis=1) >= need]
                member.append(ids[near])
                root.append(ids[near + step])
        for k in np.flatnonzero(size > 16):
            rows = slice(first[k], first[k] + size[k])
            mine = lanes[rows]
            linked = np.empty((size[k], size[k]), bool)
            for i in range(0, size[k], 32):
                linked[i : i + 32] = (mine[i : i + 32, None, :] == mine[None]).sum(axis=2, dtype=np.uint8) >= need
            m, r = _forest(linked, ids[rows])
            member.append(m)
            root.append(r)
        if member:
            member, root = np.concatenate(member), np.concatenate(root)
            differ = member != root
            yield pa.RecordBatch.from_arrays([pa.array(member[differ]), pa.array(root[differ])], names=["a", "b"])


def linked_pairs(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Boolean matrix of the links among some full sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(np.append(start, len(flat)))
    # shingles held by the same documents weigh together as one
    tag = mix64(np.arange(1, n + 1, dtype=np.uint64))
    pattern = np.add.reduceat(tag[owner], start) if len(flat) else np.empty(0, np.uint64)
    _, one, weight = np.unique(pattern[count > 1], return_index=True, return_counts=True)
    start, count = start[count > 1][one], count[count > 1][one]
    both = np.zeros((n, n))
    for i in range(0, len(start), 4096):
        c = count[i : i + 4096]
        at = np.repeat(start[i : i + 4096] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        has = np.zeros((n, len(c)), np.float32)
        has[owner[at], np.repeat(np.arange(len(c)), c)] = 1
        both += (has * weight[i : i + 4096].astype(np.float32)) @ has.T
    union = size[:, None] + size[None] - both
    return 100 * both >= percent * union


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each family cell by the full sets."""
    for batch in key_runs(batches, "cell"):
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        alone = batch.column("alone").to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column("text"))
        member, root, done = [], [], []
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        sets: list[np.ndarray] = []
        base = 0
        for lo, hi in pieces(offsets):
            flat, at = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sets += [flat[at[i] : at[i + 1]] for i in range(hi - lo)]
            while base < len(edge) - 1 and edge[base + 1] <= hi:
                i, j = edge[base], edge[base + 1]
                if j - i > 1:
                    m, r = _forest(linked_pairs(sets[i:j]), ids[i:j])
                    member.append(m)
                    root.append(r)
                    done.append(np.full(len(m), alone[i]))
                sets[i:j] = [None] * (j - i)
                base += 1
        if member:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (member, root, done)], names=["a", "b", "alone"])


def _in_cells(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows with `cell`: the whole group, or, if it is over `block`, a cell for each two blocks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(17)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col(size) <= block, 0).otherwise(blocks - 1)))
    rows = rows.withColumn("__mine", F.when(F.col(size) <= block, 0).otherwise(mine)).withColumn("__other", other)
    return rows.withColumn("cell", F.xxhash64(group, F.least("__mine", "__other"), F.greatest("__mine", "__other"))).drop("__mine", "__other")


def _regions(classes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cell) of every row that shares a prefix of the region's depth with another, and links of rows with equal signatures."""
    rows = classes.select("doc_id", "lanes", F.posexplode("shallow").alias("tree", "first")).select("doc_id", "tree", F.xxhash64("tree", "first").alias("region"), "lanes")
    cells, links = None, classes.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    for i, depth in enumerate(DEPTHS):
        if i:
            round_trip = F.expr("concat(lanes, lanes)")
            rows = rows.withColumn("region", F.xxhash64("region", F.substring(round_trip, F.col("tree") * LEVELS + DEPTHS[i - 1] + 1, F.lit(depth - DEPTHS[i - 1]))))
        sizes = saved(rows.groupBy("region").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
        settled = rows.select("doc_id", "region").join(sizes.where(F.col("n") <= REGION).select("region", "n").hint("merge"), "region")
        settled = _in_cells(settled, "region", "n", BLOCK).select("doc_id", "cell")
        cells = settled if cells is None else cells.unionByName(settled)
        crowded = sizes.where(F.col("n") > REGION)
        if not crowded.limit(1).count():
            break
        rows = saved(rows.join(crowded.select("region", "least").hint("merge"), "region"))
        if depth == DEPTHS[-1]:
            links = rows.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).where("a <> b")
        rows = rows.drop("least")
    return cells, links


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = saved(docs.mapInArrow(_sign, f"doc_id {kind}, n_shingles long, k1 long, k2 long, lanes binary, shallow array<long>"))
    same = ["n_shingles", "k1", "k2"]
    # written first, so that both sides of the join are dealt anew and a very large group of copies is split
    heads = saved(signed.where("n_shingles > 0").groupBy(same).agg(F.min("doc_id").alias("head")))
    members = saved(signed.select("doc_id", *same).join(heads.hint("merge"), same, "left").select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("head")))
    chosen = members.where("doc_id = head and n_shingles > 0").select("doc_id").distinct()
    classes = saved(signed.select("doc_id", "lanes", "shallow").join(chosen, "doc_id"))
    dropped(signed)
    dropped(heads)

    cells, alike = _regions(classes, kind)
    met = cells.join(classes.select("doc_id", "lanes"), "doc_id")
    loose = met.repartition("cell").sortWithinPartitions("cell", "lanes").mapInArrow(_neighbours, f"a {kind}, b {kind}")
    family = saved(components(loose.unionByName(alike)))
    dropped(classes)
    sizes = family.groupBy("root").agg(F.count("*").alias("size"))
    family_rows = saved(family.join(sizes, "root").select(F.col("node").alias("doc_id"), "root", "size"))
    # few rows go to the texts, so that only the families' texts are shuffled; many meet them in a merge join
    few = family_rows.count() <= BROADCAST_ROWS
    cells = _in_cells(docs.join(F.broadcast(family_rows) if few else family_rows.hint("merge"), "doc_id"), "root", "size", FAMILY_BLOCK).select("doc_id", "text", "cell", (F.col("size") <= FAMILY_BLOCK).alias("alone"))
    links = saved(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify, f"a {kind}, b {kind}, alone boolean"))
    dropped(family)
    # a family in one cell has its components already; the links of the others meet here
    whole = links.where("alone").select(F.col("a").alias("node"), F.col("b").alias("root"))
    met = components(links.where("not alone").select("a", "b"))
    roots = whole.unionByName(met).withColumnRenamed("node", "head").distinct()
    return members.join(roots, "head", "left").select("doc_id", "n_shingles", F.coalesce("root", "head").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("root", "head"), F.lit(True)).alias("kept"))
