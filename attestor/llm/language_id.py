"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to `MAX_N`-grams of lower-cased code points, hashed to `BUCKETS`
buckets, are summed per language; the smoothed log-probability matrix (languages
x buckets, a few hundred kB) is broadcast, and each Arrow batch is scored as a
sparse count matrix in numpy.

The model is fitted on at most about `MAX_TRAIN` whole documents of each
language, chosen by a hash of doc_id; all documents are scored whole.

Defined cases: null text, or text without a letter, gives `und` with score 0;
a row with a null lang is never learned from; without any training row every
text is `und` with score 0; repeated rows get the same result each; an empty
table gives an empty result. Ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, sample_below
from .textbatch import pieces

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ROWS_AT_ONCE = 128
MAX_N = 3
MAX_TRAIN = 4000
#: Distinct languages at most, which bounds the broadcast matrix.
MAX_LANGUAGES = 400
SMOOTHING = 0.5
UNKNOWN = "und"
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def gram_buckets(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For row ranges: low, high and, for each n, the row of each n-gram (from low) and its bucket."""
    texts = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    for lo, hi in pieces(ends, 1 << 20):
        joined = "".join(texts.slice(lo, hi - lo).to_pylist())
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points[points < 65] = 32
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(ends[lo : hi + 1]))
        out, total = [], np.zeros(len(points), np.uint64)
        for n in range(1, min(MAX_N, len(points)) + 1):
            total = total[: len(points) - n + 1] * np.uint64(31) + (points[n - 1 :] + np.uint64(n)) * _MULTIPLIERS[n - 1]
            mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            whole = row[: len(total)] == row[n - 1 :]
            out.append((row[: len(total)][whole], (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[whole]))
        yield lo, hi, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("lang").dictionary_encode()
        labels, code = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros(len(labels) * BUCKETS, np.int64)
        for lo, hi, grams in gram_buckets(batch.column("text")):
            for row, bucket in grams:
                counts += np.bincount(code[lo:hi][row] * BUCKETS + bucket, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()).take(pa.array(at // BUCKETS)), pa.array(at % BUCKETS), pa.array(counts[at])], names=["lang", "bucket", "n"])


class LanguageModel:
    """Sorted language names and their log-probabilities by bucket."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.languages, self.log_prob, self.log_prior = languages, log_prob, log_prior

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The best language of every text and its posterior probability."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        for lo, hi, grams in gram_buckets(texts):
            total = np.zeros((hi - lo, len(self.languages)))
            for first in range(0, hi - lo, ROWS_AT_ONCE):
                cells = 0
                for row, bucket in grams:
                    i, j = np.searchsorted(row, (first, first + ROWS_AT_ONCE))
                    cells = cells + np.bincount((row[i:j] - first) * BUCKETS + bucket[i:j], minlength=ROWS_AT_ONCE * BUCKETS)
                # the distinct (row, bucket) cells of a sparse count matrix
                at = np.flatnonzero(cells)
                starts = np.flatnonzero(np.diff(at // BUCKETS, prepend=-1))
                if len(at):
                    total[first + at[starts] // BUCKETS] = np.add.reduceat(cells[at][:, None] * self.log_prob[at % BUCKETS], starts)
            total += self.log_prior
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i in np.flatnonzero(letters[lo:hi]):
                names[lo + i] = self.languages[best[i]]
                scores[lo + i] = share[i]
        return names, scores


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Fits on columns doc_id, text, lang; see the module for the bound."""
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    taken = F.lit(False)
    for r in sizes:
        taken = taken | ((F.col("lang") == r["lang"]) & sample_below(F.col("doc_id"), min(1.0, max_train / r["n"])))
    counts = np.zeros((len(languages), BUCKETS))
    index = {x: i for i, x in enumerate(languages)}
    # at most MAX_LANGUAGES * BUCKETS small rows reach the driver
    for r in labelled.where(taken).select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[index[r["lang"]], r["bucket"]] = r["n"]
    counts += SMOOTHING
    prior = np.array([{r["lang"]: r["n"] for r in sizes}[x] for x in languages], float)
    return LanguageModel(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score for every row; reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Fits on the documents that aren't held out and predicts all of them."""
    held = crc32_text(F.col("doc_id")) % 4 == 2
    model = fit(docs.where(~held), max_train)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
