"""Removal of every byte covered by a long string that occurs elsewhere too.

A string of `LENGTH` bytes is a repeat if it also starts at another place of the
corpus, in the same document or another; overlaps count. All repeats are judged on the input.

1. *Shards.* The start of each string belongs to the anchor of its window: the least hash
   of the `ANCHOR`-byte strings inside. Equal strings have equal anchors, so the strings
   of one anchor hash can be judged apart from all others. Consecutive starts with one anchor make a
   context (the text from the first start to the end of the last string).
2. Equal contexts (by a 128-bit digest of their bytes) are counted and collapsed. An anchor hash
   with one occurrence can hold no repeat and goes no further, nor does its text; the only context of an anchor that
   occurs more than once is one repeat as a whole.
3. *Suffix arrays.* Anchor hashes with several different contexts are packed to shards of
   about `SHARD_BYTES`. Each shard's suffix array is made by induced sorting, and common prefixes are computed
   in permuted (text) order; a start whose neighbour shares `LENGTH` bytes is a repeat.
4. An anchor hash with more than `CROWDED` different contexts would outgrow a shard. Its contexts are cut
   in two: starts with more than half of the room on the anchor's left get an anchor that is longer on
   that side, the others one that is longer on the right. Equal strings still have equal anchors. The parts go
   through steps 2 to 4 again, until the anchor is the whole string.
5. Repeats are joined back to all occurrences and united for each document.

Defined cases: a null text counts as empty; texts under `LENGTH` bytes lose nothing; a text of
that length or more that occurs twice loses everything; documents are told apart by doc_id and text, and rows
that are equal in both are occurrences of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .suffix_array import permuted_lcp, suffix_order
from .textbatch import Prefix, key_runs, pieces, trimmed, utf8

LENGTH = 400
ANCHOR = 200
SHARD_BYTES = 3 << 19
#: Bytes whose anchors are sought at once.
ANCHOR_BYTES = 1 << 20
CROWDED = 2048
#: Bytes that may be broadcast to the texts; more meet them in a merge join.
BROADCAST_BYTES = 64 << 20


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each `width` keys in a row (the first, if several), by doubling."""
    best, span = np.arange(len(key)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(key[b] < key[a], b, a)
        span += step
    return best


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first start in it, number of starts, anchor hash, the anchor's place in the context) of some texts' contexts."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none
    prefix = Prefix(data)
    at = np.arange(n - anchor + 1)
    key = prefix.of(at, at + anchor)
    best = _least(key, length - anchor + 1)
    text = np.searchsorted(offsets, np.arange(len(best)), "right") - 1
    start = np.flatnonzero(np.arange(len(best)) + length <= offsets[text + 1])
    if not len(start):
        return none, none, none, none, none
    owner, text = best[start], text[start]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (np.diff(start) > 1) | (text[1:] != text[:-1])))
    count = np.diff(np.append(first, len(start)))
    lo = start[first]
    return text[first], lo - offsets[text[first]], count, key[owner[first]].view(np.int64), owner[first] - lo


def digest(blob: bytes) -> bytes:
    """Stands for a context in comparisons; collisions are out of the question."""
    return hashlib.blake2b(blob, digest_size=16).digest()


def repeats_in_shard(blobs: list[bytes], several: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each different context, which of its starts are repeats; `several` marks those that occur more than once."""
    sizes = np.array([len(b) for b in blobs])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    starts = sizes - length + 1
    of = np.repeat(np.arange(len(blobs)), starts)
    wanted = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + begin[of]
    symbols = data.astype(np.int64) + 2
    symbols[begin[1:] - 1] = 1  # between contexts
    order = suffix_order(np.append(symbols, 0), wanted)
    limit = np.repeat(begin[1:] - 1, sizes + 1) - np.arange(len(data))
    common = permuted_lcp(data, order, limit)
    far = common >= length
    marked = np.zeros(len(data), bool)
    marked[order[far]] = True
    marked[order[:-1][far[1:]]] = True
    return [np.ones(starts[i], bool) if several[i] else marked[begin[i] : begin[i] + starts[i]] for i in range(len(blobs))]


def _ranges(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of True, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in pieces(offsets, ANCHOR_BYTES):
            part, base = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            text, start, count, h, anchor = contexts(part, base)
            first = base[text] + start
            raw = part.tobytes()
            c = [digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count - 1 + LENGTH).tolist(), strict=True)]
            rows = pa.array(lo + text)
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(rows), batch.column("rid2").take(rows), *(pa.array(x.astype(np.int32)) for x in (start, count, anchor)), pa.array(h), pa.array(c, pa.binary())], names=["rid", "rid2", "start", "starts", "anchor", "h", "c"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(parts: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(parts).combine_chunks()
        c = np.array(rows["c"].to_pylist(), "S16")
        keep = np.arange(len(c))[np.append(True, (c[1:] != c[:-1]) | (np.diff(rows["h"].to_numpy()) != 0))]  # equal rows of the input ask twice
        blobs = rows["context"].take(pa.array(keep)).to_pylist()
        found = repeats_in_shard(blobs, (rows["n"].to_numpy() > 1)[keep])
        ranges = [_ranges(m) for m in found]
        some = [i for i, r in enumerate(ranges) if len(r)]
        at = pa.array(keep[some])
        return pa.RecordBatch.from_arrays([rows["h"].take(at).combine_chunks(), rows["c"].take(at).combine_chunks(), pa.array([ranges[i].tolist() for i in some], pa.list_(pa.int32()))], names=["h", "c", "ranges"])

    parts, size = [], 0
    for batch in trimmed(key_runs(batches, "h")):
        # whole anchor hashes only: a run never goes on in the next batch
        h = batch.column("h").to_numpy(zero_copy_only=False)
        edge = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        length = np.array([len(x) for x in batch.column("context").to_pylist()])
        total = np.append(0, np.cumsum(length))
        table, i = pa.Table.from_batches([batch]), 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + SHARD_BYTES - size, "right")) - 1)
            parts.append(table.slice(edge[i], edge[j] - edge[i]))
            size += int(total[edge[j]] - total[edge[i]])
            i = j
            if size >= SHARD_BYTES or i < len(edge) - 1:
                yield solve(parts)
                parts, size = [], 0
    if parts:
        yield solve(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context asked for, from each text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lo = offsets[:-1] + batch.column("start").to_numpy(zero_copy_only=False)
        hi = lo + batch.column("starts").to_numpy(zero_copy_only=False) - 1 + LENGTH
        blobs = [data[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("h", "c", "n", "anchor")] + [pa.array(blobs, pa.binary())], names=["h", "c", "n", "anchor", "context"])


def halves(starts: int, anchor: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(first start, end start, new anchor, its width, 0 for the left side or 1) of a context's parts; `anchor` is the old one's place.

    A string that starts at s has anchor - s bytes on the anchor's left and the rest of the room on its right.
    """
    room = LENGTH - width
    left = (room + 1) // 2
    cut = min(max(anchor - left + 1, 0), starts)  # starts before it have `left` bytes or more on the left
    parts = [(0, cut, anchor - left, width + left, 0), (cut, starts, anchor, width + room - left + 1 if left else width, 1)]
    return [(i, j, a - i, min(w, LENGTH), side) for i, j, a, w, side in parts if j > i]


def _split(width: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of crowded contexts, each under its longer anchor; `at` is where its starts begin in the whole."""
        for batch in batches:
            rows, at, anchor, h, c, context = [], [], [], [], [], []
            for i, (blob, place) in enumerate(zip(batch.column("context").to_pylist(), batch.column("anchor").to_pylist(), strict=True)):
                for a, b, new, wide, side in halves(len(blob) - LENGTH + 1, place, width):
                    part = blob[a : b - 1 + LENGTH]
                    rows.append(i)
                    at.append(a)
                    anchor.append(new)
                    h.append(int.from_bytes(digest(part[new : new + wide] + bytes([side]))[:8], "little", signed=True))
                    c.append(digest(part))
                    context.append(part)
            whole = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).take(whole) for x in ("h", "c", "n")), pa.array(at, pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.binary()), pa.array(anchor, pa.int32()), pa.array(context, pa.binary())],
                names=["whole_h", "whole_c", "n", "at", "h", "c", "anchor", "context"],
            )

    return split


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        data, offsets = utf8(batch.column("text"))
        wants = batch.column("spans").to_pylist()
        removed, spans, sha = [], [], []
        cuts = []
        for i, want in enumerate(wants):
            text = data[offsets[i] : offsets[i + 1]]
            if want:
                edge = np.zeros(len(text) + 1, np.int64)
                w = np.array(want, np.int64).reshape(-1, 2)
                np.add.at(edge, w[:, 0], 1)
                np.add.at(edge, w[:, 1] - 1 + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                run = _ranges(gone)
                text = text[~gone]
                removed.append(int(gone.sum()))
            else:
                run = np.empty(0, np.int64)
                removed.append(0)
            spans.append(len(run) // 2)
            cuts.append(run.tolist())
            sha.append(hashlib.sha256(text.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(cuts, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cuts"])


def _meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins texts with a saved table; one of few bytes is broadcast, so that texts stay where they are."""
    lists = [c for c, kind in right.dtypes if kind.startswith("array")]
    size = right.agg(F.sum(F.lit(72) + sum((F.size(c) * 4 for c in lists), F.lit(0)))).first()[0] or 0
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right.hint("merge"), ["rid", "rid2"], how)


def _in_shards(contexts_: DataFrame) -> DataFrame:
    return contexts_.repartition("h").sortWithinPartitions("h", "c").select("h", "c", "n", "context").mapInArrow(_shards, "h long, c binary, ranges array<int>")


def _judge(contexts_: DataFrame, width: int) -> DataFrame:
    """(h, c, ranges) of the repeats in different contexts (h, c, n, anchor, context), whose anchors have `width` bytes."""
    sizes = contexts_.groupBy("h").agg(F.count("*").alias("different"))
    crowds = saved(sizes.where(F.col("different") > CROWDED).select("h"))
    few = not crowds.limit(1).count()
    rows = contexts_ if few else contexts_.join(crowds.hint("merge"), "h", "left_anti")
    out = _in_shards(rows)
    if few:
        return out
    parts = saved(contexts_.join(crowds.hint("merge"), "h", "left_semi").mapInArrow(_split(width), "whole_h long, whole_c binary, n long, at int, h long, c binary, anchor int, context binary"))
    met = parts.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("anchor").alias("anchor"), F.first("context").alias("context"))
    met = saved(met)
    kinds = met.groupBy("h").agg(F.count("*").alias("different"), F.sum("n").alias("all")).where("all > 1")
    met = saved(met.join(kinds.select("h", "different"), "h"))
    alone = met.where("different = 1").select("h", "c", F.array(F.lit(0), (F.length("context") - LENGTH + 1).cast("int")).alias("ranges"))
    # the wider of the two new anchors is a byte longer where the room is even; the other one's strings have it too
    inner = _judge(met.where("different > 1").drop("different"), min(LENGTH, width + (LENGTH - width + 1) // 2))
    back = parts.select("whole_h", "whole_c", "at", "h", "c").join(saved(alone.unionByName(inner)).hint("merge"), ["h", "c"])
    return out.unionByName(back.select(F.col("whole_h").alias("h"), F.col("whole_c").alias("c"), F.transform("ranges", lambda r: r + F.col("at")).alias("ranges")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and cuts (start, end, ... in bytes) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_ = F.col("doc_id").cast("string")
    rows = docs.select("doc_id", "text", F.xxhash64(id_, "text").alias("rid"), F.xxhash64("text", id_, F.lit(1)).alias("rid2"))
    anchored = rows.select("rid", "rid2", "text").mapInArrow(_anchored, "rid long, rid2 long, start int, starts int, anchor int, h long, c binary")
    same = saved(anchored.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "rid2", "start")).alias("at"), F.first("starts").alias("starts"), F.first("anchor").alias("anchor")))
    kept = same.groupBy("h").agg(F.count("*").alias("different"), F.sum("n").alias("all")).where("all > 1")
    found = saved(same.join(kept.select("h", "different"), "h"))
    dropped(same)

    alone = found.where("different = 1").select("h", "c", F.array(F.lit(0), "starts").alias("ranges"))
    asked = saved(found.where("different > 1").select("at.rid", "at.rid2", "at.start", "starts", "anchor", "h", "c", "n"))
    cut = _meet(rows, asked).select("text", "start", "starts", "anchor", "h", "c", "n").mapInArrow(_cut, "h long, c binary, n long, anchor int, context binary")
    crowded = asked.groupBy("h").agg(F.count("*").alias("different")).where(F.col("different") > CROWDED).limit(1).count()
    # equal rows of the input bring a context twice, which a shard sees
    judged = _judge(saved(cut.dropDuplicates(["h", "c"])), ANCHOR) if crowded else _in_shards(cut)
    repeats = saved(alone.unionByName(judged))

    where = anchored.join(repeats.hint("merge"), ["h", "c"])
    spans = saved(where.groupBy("rid", "rid2").agg(F.flatten(F.collect_list(F.transform("ranges", lambda r: r + F.col("start")))).alias("spans")))
    dropped(repeats)
    out = _meet(rows, spans, "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cuts array<long>")
