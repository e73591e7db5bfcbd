"""A Merkle manifest of a table: a digest of every row, a tree for each part, one root, and a proof for every row.

1. *Leaves.* A row's leaf is the SHA-256 of its columns, each written with its length, so that no two rows share a text.
2. *Places.* Rows are dealt out by ranges of (part, order), so that a large part lies in many tasks. A row's place in its
   part is its place in the task's run of that part plus the rows of the part in earlier tasks, of which there is one sum for each task and part.
3. *Upwards.* `FANOUT ** LEVELS` consecutive nodes of a part are an aligned block: a matrix of 64-byte hex digests. It is
   reshaped by the fanout, and its rows are hashed level by level to the block's top. The tops are the nodes of the next round, until each
   part has one node left. The parts' tops, in the order of the parts, go the same way to the root.
4. *Downwards.* Each block gets the siblings of its top from the block above, finds those inside by index arithmetic, and hands them
   on. In the blocks of leaves they give each row's proof, and the root that follows from the row as it is found now.

No proof is ever written but as its digest, a block is the most that a task holds at once, and the driver gets the root alone.

Defined cases: a null column is written `-`; rows of a null part come first, as do those of a null order; rows that tie in it
are in the order of their leaves, and equal rows have the same leaf, so that it doesn't matter which comes first; a part of one row has its leaf as top; an empty
table gives an empty result; columns other than those hashed aren't read, so that their names can't clash.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, saved
from .textbatch import utf8

FANOUT = 8
#: Levels that are hashed in one block.
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "key string, pos long, total long, digest string"
_PATHS = "id string, key string, pos long, digest string, lefts array<string>, rights array<string>, subroot string"


def canonical(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[canonical(c) for c in columns.values()]), 256)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows`, which have a `key`, with pos (from 0, in the key's `order`) and total (the key's rows).

    Ranges hold rows of near equal number, whatever the sizes of the keys.
    """
    by = ["key", *order]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    dealt = saved(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("key", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("key").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumns({"__before": F.sum("__n").over(earlier) - F.col("__n"), "total": F.sum("__n").over(Window.partitionBy("key"))})
    # rows of one task and key are consecutive
    return dealt.join(runs, ["key", "__part"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before", "__n")


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """The digests as rows of 64 bytes."""
    return utf8(digests)[0].reshape(-1, 64)


def depth(total: int, fanout: int = FANOUT) -> int:
    """Levels above `total` nodes until one is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


def parents(nodes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The digest of every `fanout` consecutive rows; the last ones may be fewer."""
    whole = len(nodes) // fanout * fanout
    out = [hashlib.sha256(run).hexdigest() for run in nodes[:whole].reshape(-1, 64 * fanout)]
    if whole < len(nodes):
        out.append(hashlib.sha256(nodes[whole:].tobytes()).hexdigest())
    return np.frombuffer("".join(out).encode(), np.uint8).reshape(-1, 64)


def tree(nodes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrices of a block, from its nodes up."""
    out = [nodes]
    for _ in range(levels):
        out.append(parents(out[-1]))
    return out


def siblings(nodes: np.ndarray, fanout: int = FANOUT) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each row's siblings before it and after it in its run."""
    at = np.arange(len(nodes))
    first = at - at % fanout
    last = np.minimum(first + fanout, len(nodes))
    raw = nodes.tobytes()
    left = [raw[a:b] for a, b in zip((first * 64).tolist(), (at * 64).tolist(), strict=True)]
    right = [raw[a:b] for a, b in zip((at * 64 + 64).tolist(), (last * 64).tolist(), strict=True)]
    return left, right


def fold(node: bytes, lefts: list[bytes], rights: list[bytes]) -> bytes:
    """The digest at the end of a path."""
    for left, right in zip(lefts, rights, strict=True):
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FANOUT**levels)).cast("long").alias("block")


def _top(levels: int):
    def top(rows: pa.Table) -> pa.Table:
        """The top of one block."""
        rows, block = rows.sort_by("pos"), FANOUT**levels
        total = rows["total"][0].as_py()
        digest = tree(matrix(rows["digest"]), min(levels, depth(total)))[-1]
        return pa.table({"key": [rows["key"][0].as_py()], "pos": [rows["pos"][0].as_py() // block], "total": [-(-total // block)], "digest": [digest.tobytes().decode()]})

    return top


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """`nodes` (key, pos, total, digest) and the tops of their blocks, round by round; a key with one node left goes no further."""
    rounds, most = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        rest = rounds[-1].where("total > 1").select("key", "pos", "total", "digest")
        rounds.append(saved(rest.groupBy("key", _block(levels)).applyInArrow(_top(levels), _NODES)))
        most = -(-most // FANOUT**levels)
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(key, digest) of the last node of every key."""
    ends = [r.where("total = 1").select("key", "digest") for r in rounds]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def _inside(rows: pa.Table, above: pa.Table, levels: int) -> tuple[pa.Table, list[list[bytes]], list[list[bytes]], list[bytes], list[bytes], str | None]:
    """A block in order: its rows, for each level the siblings of its nodes, and the path from its top on."""
    rows = rows.sort_by("pos")
    inside = tree(matrix(rows["digest"]), min(levels, depth(rows["total"][0].as_py())))[:-1]
    found = [siblings(m) for m in inside]
    up = [[x.encode() for x in above[c][0].as_py()] for c in ("lefts", "rights")]
    return rows, [f[0] for f in found], [f[1] for f in found], *up, above["subroot"][0].as_py()


def _handed_down(levels: int):
    def hand_down(rows: pa.Table, above: pa.Table) -> pa.Table:
        """The path of every node of a block."""
        rows, lefts, rights, up_lefts, up_rights, subroot = _inside(rows, above, levels)
        n = rows.num_rows

        def path(inside: list[list[bytes]], up: list[bytes]) -> pa.Array:
            return pa.array([[level[i // FANOUT**k].decode() for k, level in enumerate(inside)] + [x.decode() for x in up] for i in range(n)], pa.list_(pa.string()))

        names = rows["id"] if "id" in rows.column_names else pa.nulls(n, pa.string())
        return pa.table({"id": names, "key": rows["key"], "pos": rows["pos"], "digest": rows["digest"], "lefts": path(lefts, up_lefts), "rights": path(rights, up_rights), "subroot": pa.array([subroot] * n, pa.string())})

    return hand_down


def _proven(levels: int):
    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        """For every leaf of a block, the digest of its siblings up to the root, and the root that follows from the row as found."""
        rows, lefts, rights, up_lefts, up_rights, subroot = _inside(rows, above, levels)
        rest = b"".join(left + right for left, right in zip(up_lefts, up_rights, strict=True))
        proofs, folded = [], []
        for i, found in enumerate(rows["found"].to_pylist()):
            at = [i // FANOUT**k for k in range(len(lefts))]
            own_left, own_right = [lefts[k][j] for k, j in enumerate(at)], [rights[k][j] for k, j in enumerate(at)]
            proof = hashlib.sha256()
            for left, right in zip(own_left, own_right, strict=True):
                proof.update(left)
                proof.update(right)
            proof.update(rest)
            proofs.append(proof.hexdigest())
            folded.append(fold(found.encode(), own_left + up_lefts, own_right + up_rights).decode())
        return pa.table({"__id": rows["__id"], "leaf": rows["digest"], "subroot": pa.array([subroot] * len(proofs), pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    return prove


def _meet(nodes: DataFrame, above: DataFrame, function, schema: str, levels: int) -> DataFrame:
    """Each block with the path of its top."""
    above = above.select(*[F.col(c).alias(c) for c in above.columns])  # columns of its own, as it may stem from the same nodes
    return nodes.groupBy("key", _block(levels)).cogroup(above.groupBy("key", F.col("pos").alias("block"))).applyInArrow(function(levels), schema)


def descend(rounds: list[DataFrame], roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The paths (key, pos, lefts, rights, subroot) of the tops of all blocks of the first round; `roots` has those of the keys."""
    above = None
    for r in reversed(rounds):
        ends = r.where("total = 1").select("key", "pos").join(roots, "key")
        above = ends if above is None else above.unionByName(ends)
        if r is not rounds[0]:
            above = saved(_meet(r, above, _handed_down, _PATHS, levels).select("key", "pos", "lefts", "rights", "subroot"))
    return above


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, part: str = "lang", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """`order`, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    `found` gives columns as they are found now, where they may differ from those the manifest was made from.
    """
    kind = docs.schema[order].dataType.simpleString()
    columns_ = {c: F.col(f"`{c}`") for c in columns}
    now = columns_ | (found or {})
    # null parts come first
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{part}`").cast("string")), F.lit("0"))
    leaves = docs.select(key.alias("key"), F.col(f"`{order}`").alias("__id"), leaf(columns_).alias("digest"), leaf(now).alias("found"), F.monotonically_increasing_id().alias("__row"))
    rounds = climb(saved(positions(saved(leaves), ["__id", "digest", "__row"]).drop("__row")), levels)

    whole = F.lit("").alias("key")
    subroots = saved(tops(rounds).select(whole, F.col("key").alias("id"), "digest"))
    above = climb(saved(positions(subroots, ["id"])), levels)
    root = tops(above).first()
    no_path = F.array().cast("array<string>")
    start = subroots.select("key").distinct().select("key", no_path.alias("lefts"), no_path.alias("rights"), F.lit(None).cast("string").alias("subroot"))
    by_part = _meet(above[0], descend(above, start, levels), _handed_down, _PATHS, levels)
    roots = saved(by_part.select(F.col("id").alias("key"), "lefts", "rights", F.col("digest").alias("subroot")))

    out = _meet(rounds[0], descend(rounds, roots, levels), _proven, f"__id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string", levels)
    top = F.lit(root["digest"] if root else None).cast("string")
    return out.select(F.col("__id").alias(order), "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


def tampered(row: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the unsigned CRC-32 of the row's number."""
    return F.when(crc32_text(row) % 3 == 0, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)
