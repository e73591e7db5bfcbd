"""Quality rules: base counts of a text, and how much of it repeats itself.

The base counts look at words, symbols, lines and 3-word windows. The verdict on repetition
comes from the text's suffix array:

1. *Candidates.* A suffix can only share `MIN_REPEAT` bytes with another one of its text if the hash of its
   first `MIN_REPEAT` bytes occurs twice. Most texts have no such suffix and end here.
2. *Suffix array.* The candidates are put in the order of their suffixes by induced sorting, and common prefixes of
   neighbours are computed in permuted (text) order.
3. *Intervals.* A run of the suffix array whose common prefixes are `length` at least, and somewhere
   `length`, is a string that can't be prolonged to the right in all its places. If the bytes before its places differ, it can't be
   prolonged to the left either: a maximal repeat.
4. *Verdict.* The spans of the maximal repeats are united. A text fails if they cover more than `MAX_COVERED` of its bytes, or if
   the longest repeat has more than `MAX_LONGEST` bytes.

Defined cases: a null text counts as empty; a text without words has zeros and fails the base rule; rows that are equal are judged
each on its own; texts of any length are judged whole, with some 60 bytes of memory for each byte of a text that has
candidates; an empty table gives an empty result; columns other than the key and the text aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import permuted_lcp, suffix_order
from .textbatch import BLANK, Prefix, grams, hash_ranges, mix64, pieces, trimmed, utf8, words

#: Bytes from which on a string that occurs again in its text counts as a repeat: longer than a phrase that prose uses twice.
MIN_REPEAT = 50
#: Part of a text's bytes that maximal repeats may cover.
MAX_COVERED = 0.3
#: Bytes of the longest repeat that a text may have.
MAX_LONGEST = 1000
#: Base rule: words at least, and percent of the words that may stand in repeated windows.
MIN_WORDS, WINDOW_WORDS, MAX_REPEAT_PERCENT = 50, 3, 50
#: Bytes worked on at once.
PIECE = 1 << 20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Bytes that don't begin a code point.
INNER = np.zeros(256, bool)
INNER[128:192] = True


def _owned(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The hashes, so changed that those of different owners don't meet."""
    return key ^ mix64(owner.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _repeated(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once for their owner."""
    mixed = _owned(key, owner)
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    return twice[at] == mixed


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    w = words(data, offsets, lower=False)
    counts = w.counts()
    filled = ~BLANK[data]
    out = {"n_words": counts, "word_chars": _per_text(filled & ~INNER[data], offsets), "n_symbols": _per_text(SYMBOLS[data], offsets)}

    # lines begin at a text's start and after each line feed
    feed = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end -= np.where((end > start) & (data[np.maximum(end, 1) - 1] == 10), 1, 0)
    some = np.concatenate([[0], np.cumsum(filled)])
    keep = some[end] > some[start]
    start, end = start[keep], end[keep]
    text = np.searchsorted(offsets, start, "right") - 1
    line = hash_ranges(data, start, end) if len(start) else np.empty(0, np.uint64)
    _, different = np.unique(_owned(line, text), return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(text[different], minlength=n)

    window, at = grams(w, WINDOW_WORDS)
    owner = np.searchsorted(w.first, at, "right") - 1
    hit = at[_repeated(window, owner)]
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW_WORDS, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(edge[:-1]) > 0, w.first)
    return out


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of the suffix array with a common prefix of `least` or more.

    `common[i]` is shared by the i-th suffix and the one before it.
    """
    found, stack = [], []  # of (length, first)
    for i, value in enumerate([*common.tolist(), 0]):
        first = i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            found.append((length, first, i - 1))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return found


def repeats(text: np.ndarray, wanted: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, int, int]:
    """(runs covered, as start, end, ...; the longest repeat; number of maximal repeats) of one text, from the suffixes at `wanted`."""
    none = np.empty(0, np.int64)
    if len(wanted) < 2:
        return none, 0, 0
    order = suffix_order(np.append(text.astype(np.int64) + 1, 0), wanted)
    common = permuted_lcp(text, order, len(text) - np.arange(len(text)))
    longest = int(common.max())
    if longest < least:  # hashes that met by chance
        return none, 0, 0
    before = np.where(order > 0, text[order - 1].astype(np.int64), -1)
    changes = np.cumsum(np.append(0, before[1:] != before[:-1]))
    maximal = sum(1 for _, first, last in intervals(common, least) if changes[last] > changes[first])
    # A place's span ends with the innermost interval that holds it. If that isn't maximal, the place before has a longer one.
    inner = np.maximum(common, np.append(common[1:], 0))
    inner[inner < least] = 0
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, order, 1)
    np.add.at(edge, order + inner, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))), longest, maximal


def _judged(key: str, text: str, least: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column(text))
            for lo, hi in pieces(offsets, PIECE):
                part, base = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                found = base_counts(part, base)
                spans, longest, maximal = [[] for _ in range(hi - lo)], np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                if len(part) > least:
                    at = np.arange(len(part) - least + 1)
                    owner = np.searchsorted(base, at, "right") - 1
                    at = at[at + least <= base[owner + 1]]
                    owner = np.searchsorted(base, at, "right") - 1
                    again = _repeated(Prefix(part).of(at, at + least), owner)
                    at, owner = at[again], owner[again]
                    for i in np.unique(owner).tolist():
                        a, b = np.searchsorted(owner, [i, i + 1])
                        run, longest[i], maximal[i] = repeats(part[base[i] : base[i + 1]], at[a:b] - base[i], least)
                        spans[i] = run.tolist()
                covered = np.array([sum(s[1::2]) - sum(s[::2]) for s in spans], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in (*found.values(), np.diff(base), covered, longest, maximal)), pa.array(spans, pa.list_(pa.int64()))],
                    names=[key, *found, "n_bytes", "covered_bytes", "longest_repeat", "n_maximal", "spans"],
                )

    return judge


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The key, base counts, base_failed, what repeats (n_bytes, covered_bytes, longest_repeat, n_maximal, spans) and kept, for every row."""
    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "covered_bytes", "longest_repeat", "n_maximal"))
    rows = docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(_judged(key, text, least), f"`{key}` {kind}, {counts}, spans array<long>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repeats_little = (F.col("covered_bytes") <= max_covered * F.col("n_bytes")) & (F.col("longest_repeat") <= max_longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & repeats_little)
