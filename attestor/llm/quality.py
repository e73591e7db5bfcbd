"""Document quality by gated-attention multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Every passage is
encoded by shape statistics (kinds of bytes, word lengths, repeated words,
shouting, runs of punctuation) and by hashed byte pairs. A small network embeds
each passage; gated attention weights, softmax(w . (tanh(V h) * sigmoid(U h))),
are learned from the document labels alone, and the score is the logistic of the
attention-weighted mean passage.

Encoding and scoring run on Arrow batches in numpy. The network is fitted on at
most about `MAX_TRAIN` labelled documents, chosen by a hash of doc_id and read
whole; only their encoded passages (some 200 bytes for 64 words) reach the driver.

Defined cases: a text without words (null, empty or blank) is one passage of
zeros and gets the score that this earns; labels that are null or belong to no
document are passed over; several labels of one document count by their mean, a
half as 1; with labels of one kind only, every score is that kind's smoothed
share; without labels it is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, sample_below
from .textbatch import give_back, pieces, utf8, words

PASSAGE_WORDS = 64
PAIR_BUCKETS = 32
MAX_TRAIN = 6000
#: Rows with a score below this are rejected.
ACCEPT = 0.3
WIDTH, GATE, EPOCHS, BAGS, RATE = 24, 12, 30, 64, 0.01

#: Kinds of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other mark, 7 beyond ASCII.
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[32, 9]], _KIND[[10, 11, 12, 13]] = 3, 4
_KIND[[ord(c) for c in ".,;:'\"-()?!"]] = 5
_MARK = (_KIND == 5) | (_KIND == 6)
FEATURES = 8 + 12 + PAIR_BUCKETS


def encode(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: low, high, a row of features for each passage, and hi - lo + 1 offsets of the texts' passages."""
    data, offsets = utf8(column)
    for lo, hi in pieces(offsets):
        yield lo, hi, *_encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(data, offsets, lower=False)
    counts = w.counts()
    n_passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    bag = np.concatenate([[0], np.cumsum(n_passages)])
    m = int(bag[-1])
    out = np.zeros((m, FEATURES), np.float32)
    if not len(w.hash):
        return out, bag
    of_text = np.repeat(np.arange(len(counts)), counts)
    passage = bag[of_text] + (np.arange(len(w.hash)) - w.first[of_text]) // PASSAGE_WORDS
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    has = passage[first]
    size = np.bincount(passage, minlength=m)[has].astype(np.float64)
    # bytes from a passage's first word to the next passage's, or to the end of its text
    begin, end = w.start[first], np.append(w.start[first[1:]], len(data))
    end = np.minimum(end, offsets[1:][of_text[first]])
    length = np.maximum(end - begin, 1).astype(np.float64)
    slot = np.repeat(np.arange(len(has)), end - begin)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    part = data[np.cumsum(inside[:-1]) > 0]
    kinds = np.bincount(slot * 8 + _KIND[part], minlength=len(has) * 8).reshape(-1, 8)
    out[has, :8] = kinds / length[:, None]

    mean = lambda x: np.add.reduceat(x.astype(np.float64), first) / size
    chars = (w.end - w.start).astype(np.float64)
    head, tail, before = data[w.start], data[w.end - 1], data[np.maximum(w.end - 2, w.start)]
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1]))
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    new = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=m)[has]
    average = mean(chars)
    columns = [
        np.log1p(average),
        np.sqrt(np.maximum(mean(chars**2) - average**2, 0)) / (1 + average),
        np.log1p(np.maximum.reduceat(chars, first)),
        distinct / size,
        mean(same),
        mean(_MARK[tail] & _MARK[before] & (chars > 1)),
        mean(_MARK[head] & (chars == 1)),
        mean((_KIND[head] == 1) & (_KIND[before] == 1)),
        mean((_KIND[head] == 1) & (_KIND[before] != 1)),
        mean(_KIND[head] == 2),
        mean(np.isin(tail, [ord("."), ord("!"), ord("?")])),
        np.log1p(size) / 4,
    ]
    out[has, 8:20] = np.stack(columns, axis=1)
    if len(part) > 1:
        pair = (part[:-1].astype(np.int64) * 257 + part[1:]) * 40503 % 65537 % PAIR_BUCKETS
        out[has, 20:] = np.bincount(slot[:-1] * PAIR_BUCKETS + pair, minlength=len(has) * PAIR_BUCKETS).reshape(-1, PAIR_BUCKETS) / length[:, None]
    return out, bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Standardised features, one hidden layer, gated attention, one logistic unit."""

    def __init__(self, constant: float | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.constant = constant
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"w1": scale(FEATURES, WIDTH), "b1": np.zeros(WIDTH), "v": scale(WIDTH, GATE), "u": scale(WIDTH, GATE), "a": scale(GATE), "w2": scale(WIDTH), "b2": np.zeros(1)}

    def _forward(self, x: np.ndarray, bag: np.ndarray) -> tuple:
        p = self.p
        h = np.maximum(x @ p["w1"] + p["b1"], 0)
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        of = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        e = np.exp(e - np.maximum.reduceat(e, bag[:-1])[of])
        weight = e / np.add.reduceat(e, bag[:-1])[of]
        z = np.add.reduceat(h * weight[:, None], bag[:-1])
        return h, t, s, of, weight, z, _sigmoid(z @ p["w2"] + p["b2"])

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bag) - 1, self.constant)
        return self._forward(self._standard(x), bag)[-1]

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> AttentionModel:
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3
        del every
        bags = [self._standard(b) for b in bags]
        rng, p, step = np.random.default_rng(seed), self.p, 0
        m1 = {k: np.zeros_like(x) for k, x in p.items()}
        m2 = {k: np.zeros_like(x) for k, x in p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BAGS):
                some = order[i : i + BAGS]
                x = np.concatenate([bags[j] for j in some])
                bag = np.concatenate([[0], np.cumsum([len(bags[j]) for j in some])])
                h, t, s, of, weight, z, out = self._forward(x, bag)
                d_out = (out - y[some]) / len(some)
                d_z = d_out[:, None] * p["w2"]
                d_weight = (h * d_z[of]).sum(axis=1)
                d_e = weight * (d_weight - np.add.reduceat(weight * d_weight, bag[:-1])[of])
                gate = d_e[:, None] * p["a"]
                d_t, d_s = gate * s * (1 - t**2), gate * t * s * (1 - s)
                d_h = (d_z[of] * weight[:, None] + d_t @ p["v"].T + d_s @ p["u"].T) * (h > 0)
                grad = {"w1": x.T @ d_h, "b1": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_e, "w2": z.T @ d_out, "b2": np.array([d_out.sum()])}
                step += 1
                rate = RATE * (0.1 ** (epoch / epochs))
                for k in p:
                    g = grad[k] + 1e-4 * p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = []
        for lo, hi, x, bag in encode(batch.column("text")):
            blobs += [x[bag[i] : bag[i + 1]].tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(blobs, pa.binary())], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> AttentionModel:
    """Learns from `labels` (doc_id, quality) and the texts of `docs`; at most about `max_train` documents."""
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    n = labels.count()
    if not n:
        return AttentionModel(constant=0.5)
    # bounded by max_train, so it may be broadcast
    some = F.broadcast(labels.where(sample_below(F.col("doc_id"), min(1.0, max_train / n))))
    rows = docs.select("doc_id", "text").join(some, "doc_id").select("y", "text").mapInArrow(_encoded, "y double, x binary").collect()
    rows.sort(key=lambda r: bytes(r["x"]))  # the order in which executors answer must not matter
    if not rows:
        return AttentionModel(constant=0.5)
    y = np.array([r["y"] for r in rows])
    if y.min() == y.max():
        return AttentionModel(constant=(y.sum() + 1) / (len(y) + 2))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    del rows
    model = AttentionModel().train(bags, y)
    del bags
    give_back()
    return model


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """All columns of `docs` and `score`, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for lo, hi, x, bag in encode(batch.column("text")):
                found[lo:hi] = shared.value.score(x, bag)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(scored, schema)


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted; held-out labels are not learned from."""
    held = crc32_text(F.col("doc_id")) % 5 == 0
    model = fit(docs, labels.where(~held), max_train)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
