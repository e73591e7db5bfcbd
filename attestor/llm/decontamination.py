"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. The word n-grams of all test items become a table, one row for each item and n-gram. A filter of at most
   `FILTER_BITS` bits, whatever the number of items, goes to all tasks; what it lets through meets the table in a join.
2. In a first pass over the documents it is counted how many hold each n-gram. An n-gram is a seed unless it is common:
   in over `COMMON_SHARE` of all documents and in over four times as many as the median n-gram of its item
   (so a passage that was copied very often keeps its seeds).
3. In a second pass the documents' seeds are joined with the items'. Where they stand gives windows of a document for an item;
   windows that overlap are one.
4. Each window is aligned with its item by Smith-Waterman over words (match 1, mismatch and gap
   -0.5); windows of like size advance together in numpy. The score over the
   item's word count, at least `THRESHOLD`, marks a copy, also a paraphrased or edited one.

Documents are read three times and their texts are shuffled at no time, unless so many hold windows that those can't be broadcast.

Defined cases: words are runs of non-blanks, lower-cased (A-Z and Latin-1), whose marks at
either end don't count; an item of fewer than n words has all its words as its
one n-gram; an item without words matches nothing; a null or empty text holds
nothing; equal items are reported each, repeated rows of an item_id once; rows without a doc_id or item_id take no part; repeated rows of a doc_id are
reported once, by the best copy; of equally good copies in one document the first is reported; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved
from .textbatch import Words, grams, mix64, pieces, utf8, words

SEED_WORDS = 3
COMMON_SHARE = 0.001
THRESHOLD = 0.5
GAP = 0.5
#: Words that a window has beyond the item on both sides, besides a quarter of the item's.
DRIFT = 12
#: Size of the filter at most (16 MB), and its bits for each n-gram below that.
FILTER_BITS, BITS_EACH = 1 << 27, 32
#: Cells of the alignments that advance together.
CELLS = 1 << 19
#: Bytes of windows that may be broadcast to the texts; more meet them in a merge join.
BROADCAST_BYTES = 48 << 20

#: ASCII marks count as blanks here, so that punctuation doesn't hide a copy.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    plain = _PLAIN[data]
    # the capitals from U+00C0 to U+00DE, two bytes each
    accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    plain[1:][accented] += 0x20
    return words(plain, offsets)


def _short(seq: np.ndarray) -> np.uint64:
    """The one n-gram of an item of fewer than n words."""
    return mix64(np.array([(seq * np.arange(1, len(seq) + 1, dtype=np.uint64) * np.uint64(2654435761)).sum() + np.uint64(len(seq))], np.uint64))[0]


def _all_grams(w: Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of some texts with the index of their first words; also shorter ones of `lengths` words."""
    found, at = grams(w, SEED_WORDS)
    for n in lengths:
        if len(w.hash) >= n:
            seq = sum(w.hash[j : len(w.hash) - n + 1 + j] * np.uint64((j + 1) * 2654435761) for j in range(n)) + np.uint64(n)
            text = np.searchsorted(w.first, np.arange(len(seq)), "right")
            whole = np.flatnonzero(np.arange(len(seq)) + n <= w.first[np.minimum(text, len(w.first) - 1)])
            found, at = np.append(found, mix64(seq[whole])), np.append(at, whole)
    return found, at


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct n-grams with their first and last places; its words are in one more row without an n-gram."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        w = _words(data, offsets)
        row, gram, low, high, size, blobs = [], [], [], [], [], []
        for i in range(batch.num_rows):
            mine = w.hash[w.first[i] : w.first[i + 1]]
            if not len(mine):
                continue
            if len(mine) < SEED_WORDS:
                found, at = np.array([_short(mine)], np.uint64), np.zeros(1, np.int64)
            else:
                found, at = grams(Words(np.array([0, len(mine)]), w.start, w.end, mine), SEED_WORDS)
            distinct, which = np.unique(found, return_inverse=True)
            first, last = np.full(len(distinct), len(mine)), np.zeros(len(distinct), np.int64)
            np.minimum.at(first, which, at)
            np.maximum.at(last, which, at)
            row += [i] * (len(distinct) + 1)
            gram += [*distinct.view(np.int64).tolist(), None]
            low += [*first.tolist(), 0]
            high += [*last.tolist(), 0]
            size += [len(mine)] * (len(distinct) + 1)
            blobs += [None] * len(distinct) + [mine.tobytes()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row, pa.int64())), pa.array(gram, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(size, pa.int32()), pa.array(blobs, pa.binary())], names=["item_id", "gram", "low", "high", "size", "words"])


class Filter:
    """Two bits for each n-gram; lets all of them through and few others."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths

    @staticmethod
    def places(gram: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(n_bits - 1)
        return (gram & mask).astype(np.int64), ((gram >> np.uint64(32)) & mask).astype(np.int64)

    def passes(self, gram: np.ndarray) -> np.ndarray:
        a, b = self.places(gram, len(self.bits) * 8)
        bit = lambda i: (self.bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)


def _filter_of(rows: DataFrame, lengths: list[int]):
    """The filter of a table's n-grams, broadcast; each task sends the driver one bitmap of the bounded size."""
    n = rows.count()
    n_bits = 1 << 16
    while n_bits < min(FILTER_BITS, BITS_EACH * n):
        n_bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits, bool)
        for batch in batches:
            for place in Filter.places(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), n_bits):
                bits[place] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(n_bits // 8, np.uint8)
    for r in rows.select("gram").coalesce(16).mapInArrow(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(Filter(bits, lengths))


def align(queries: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each query with its window: best score, and the window's (start, end) words."""

    def forward(qs: list[np.ndarray], ws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols = max(map(len, qs)), max(map(len, ws))
        text = np.zeros((len(ws), cols), np.uint64)
        real = np.zeros((len(ws), cols), bool)
        query = np.zeros((len(qs), rows), np.uint64)
        for i, (q, x) in enumerate(zip(qs, ws, strict=True)):
            text[i, : len(x)], real[i, : len(x)], query[i, : len(q)] = x, True, q
        length = np.array([len(q) for q in qs])
        slope = GAP * np.arange(cols + 1)
        h = np.zeros((len(ws), cols + 1))
        best, end, depth = np.zeros(len(ws)), np.zeros(len(ws), np.int64), np.zeros(len(ws), np.int64)
        for r in range(rows):
            step = np.where((text == query[:, r : r + 1]) & real & (length > r)[:, None], 1.0, -0.5)
            new = np.zeros_like(h)
            np.maximum(h[:, :-1] + step, h[:, 1:] - GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            h = np.maximum.accumulate(new + slope, axis=1) - slope
            h[:, 1:][~real] = 0
            h[length <= r] = 0
            top = h.argmax(axis=1)
            score = h[np.arange(len(ws)), top]
            more = score > best
            best[more], end[more], depth[more] = score[more], top[more], r + 1
        return best, end, depth

    best, end, depth = forward(queries, windows)
    back = [q[:d][::-1] if d else q[:1] for q, d in zip(queries, depth, strict=True)]
    into = [x[:e][::-1] if e else x[:1] for x, e in zip(windows, end, strict=True)]
    _, length, _ = forward(back, into)
    return best, end - length, end


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of each batch's texts hold each n-gram that the filter lets through."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            parts = []
            for lo, hi in pieces(offsets):
                w = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found, at = _all_grams(w, shared.value.lengths)
                some = shared.value.passes(found)
                found, text = found[some], np.searchsorted(w.first, at[some], "right")
                order = np.lexsort((text, found))
                found, text = found[order], text[order]
                parts.append(found[np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1]))[: len(found)]])
            gram, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return count


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the n-grams that the filter lets through stand."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in pieces(offsets):
                w = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found, at = _all_grams(w, shared.value.lengths)
                some = shared.value.passes(found)
                found, at = found[some], at[some]
                text = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(lo + text)), pa.array((at - w.first[text]).astype(np.int32)), pa.array(found.view(np.int64))], names=["doc_id", "at", "gram"])

    return find


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each window, with their bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        wanted = batch.column("windows")
        for lo, hi in pieces(offsets):
            base = offsets[lo]
            w = _words(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
            row, item, blobs, starts, ends = [], [], [], [], []
            for t in range(hi - lo):
                first, last, begin = int(w.first[t]), int(w.first[t + 1]), int(offsets[lo + t] - base)
                for x in wanted[lo + t].as_py():
                    a, b = first + max(0, x["lo"]), min(last, first + x["hi"])
                    if a < b:
                        row.append(lo + t)
                        item.append(x["item_id"])
                        blobs.append(w.hash[a:b].tobytes())
                        starts.append((w.start[a:b] - begin).astype(np.int64).tobytes())
                        ends.append((w.end[a:b] - begin).astype(np.int64).tobytes())
            kind = batch.schema.field("windows").type.value_type.field("item_id").type
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, kind), *(pa.array(x, pa.binary()) for x in (blobs, starts, ends))], names=["doc_id", "item_id", "window", "starts", "ends"])


def _aligner(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = lambda c, kind: [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]  # noqa: E731, B023
            texts, items = numbers("window", np.uint64), numbers("words", np.uint64)
            starts, ends = numbers("starts", np.int64), numbers("ends", np.int64)
            turn = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # noqa: B023
            rows, out = [], []
            while turn:
                # as many as fill CELLS when padded to the longest, one at least
                n = 1
                while n < len(turn) and (n + 1) * len(texts[turn[n]]) <= CELLS:
                    n += 1
                some, turn = turn[:n], turn[n:]
                score, a, b = align([items[i] for i in some], [texts[i] for i in some])
                for i, x, p, q in zip(some, score, a, b, strict=True):
                    if x >= threshold * len(items[i]):
                        rows.append(i)
                        out.append((float(x) / len(items[i]), int(starts[i][p]), int(ends[i][q - 1])))
            if rows:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("item_id").take(take), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", "item_id", "score", "start", "end"])

    return run


def find_copies(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, and the copy's first byte and end byte: the best copy of each item in each document."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    items = saved(items.mapInArrow(_item_rows, f"item_id {item_kind}, gram long, low int, high int, size int, words binary"))
    own = items.where("gram is not null").drop("words")
    lengths = sorted(r["size"] for r in own.where(F.col("size") < SEED_WORDS).select("size").distinct().collect())

    n_docs = docs.count()
    counts = docs.select("text").mapInArrow(_counter(_filter_of(own.select("gram").distinct(), lengths)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = saved(own.join(counts.hint("merge"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    middle = counted.groupBy("item_id").agg(F.percentile("n", F.lit(0.5)).alias("median"))
    common = (F.col("n") > COMMON_SHARE * n_docs) & (F.col("n") > 4 * F.greatest(F.lit(1.0), "median"))
    rare = saved(counted.where("n > 0").join(middle, "item_id").where(~common).drop("n", "median"))
    dropped(counted)

    hits = docs.mapInArrow(_finder(_filter_of(rare.select("gram").distinct(), lengths)), f"doc_id {doc_kind}, at int, gram long")
    slack = F.lit(DRIFT) + F.floor(F.col("size") / 4)
    spots = hits.join(rare.hint("merge"), "gram").select("doc_id", "item_id", (F.col("at") - F.col("high") - slack).cast("int").alias("lo"), (F.col("at") - F.col("low") + F.col("size") + slack).cast("int").alias("hi"))
    # windows that overlap are one: a window begins where all before it have ended
    order = Window.partitionBy("doc_id", "item_id").orderBy("lo", "hi")
    spots = spots.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(1 << 30)))).cast("int"))
    spots = spots.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    windows = spots.groupBy("doc_id", "item_id", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    windows = saved(windows.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "lo", "hi")).alias("windows")))
    size = windows.agg(F.sum(F.size("windows") * 40 + 40)).first()[0] or 0
    held = docs.join(F.broadcast(windows) if size <= BROADCAST_BYTES else windows.hint("merge"), "doc_id")
    cut = held.mapInArrow(_cut, f"doc_id {doc_kind}, item_id {item_kind}, window binary, starts binary, ends binary")
    words_of = items.where("gram is null").select("item_id", "words")
    found = cut.join(words_of.hint("merge"), "item_id").select("doc_id", "item_id", "window", "starts", "ends", "words")
    found = found.mapInArrow(_aligner(threshold), f"doc_id {doc_kind}, item_id {item_kind}, score double, start long, end long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("first"), "end")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.first")).alias("start"), "b.end")
