"""Relations found by retrieval: both channels, a ladder of budgets that only unfinished queries climb, then gate and adjudication.

A claim asks for the claims of its block (subject, measure, kind of value), as no other one can bear a relation with it. Each channel
ranks the block once. On rung k a query takes the k + 1 best of each channel without itself, fuses them, keeps k, and either stops or goes on
to the next rung; queries that have stopped are in no later join. The pairs that are left are those of `relations`, each
judged once whichever side found it. A search that ends on the last rung is marked as such: what it did not see is not known to be unrelated.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as texts
from ..functions.numbers import let
from ..sources.scratch import saved
from . import pairs, tiles
from .retrieval import K1, B, dot

BLOCK = ("subject", "measure", "value_kind")
# Scores of a channel that are held at once; claims of a group of blocks that a task works on together; claims of a block that shares its arrays with others.
CELLS, GROUP, SMALL = 1 << 21, 8192, 64
# The most frequent words, whose counts every task gets; the counts of others are joined to the blocks that have them.
FREQUENT = 1 << 14

# Why a query stops and why it goes on.
SUFFICIENT, NO_FURTHER, BUDGET, NONE = "sufficient_candidates", "no_further_candidates", "budget_exhausted", "no_candidates_found"
FEW, SATURATED = "insufficient_unblocked_candidates", "candidate_set_saturated"


@dataclass(frozen=True)
class Knobs:
    """All settings of the search; `parsed` reads them from text, and what can't be read gives the default."""

    enabled: bool = False
    top_k: int = 50
    lexical_weight: float = 0.45
    semantic_weight: float = 0.55
    channel_fanout: int = 100
    embedding_model: str = "hashing-64"
    embedding_mode: str = "live"
    embedding_model_cache_dir: str = ""
    index_dir: str = ""
    adaptive_enabled: bool = True
    k_ladder: tuple[int, ...] = (10, 25, 50, 100)
    max_rounds: int = 4
    min_unblocked: int = 5
    saturation_ratio: float = 0.9

    @staticmethod
    def parsed(values: dict[str, str] | None = None) -> Knobs:
        """From environment variables (or a map like them); a ladder is sorted, without repeats, and of positive numbers only."""
        values = dict(os.environ) if values is None else values
        names = {"index_dir": "RETRIEVAL_INDEX_PATH", "adaptive_enabled": "RETRIEVAL_ADAPTIVE"} | {f: f.upper() for f in ("embedding_model", "embedding_mode", "embedding_model_cache_dir")}
        found: dict = {}
        for field, default in vars(Knobs()).items():
            text = values.get(names.get(field, f"RETRIEVAL_{field.upper()}"), "").strip()
            if not text:
                continue
            if isinstance(default, bool):
                found[field] = text.lower() in ("1", "true", "yes", "on")
            elif isinstance(default, str):
                found[field] = text.lower() if field == "embedding_mode" else text
            else:
                try:
                    numbers = sorted({int(p) for p in text.split(",") if p.strip()}) if isinstance(default, tuple) else [type(default)(text)]
                except ValueError:
                    continue
                if numbers and (not isinstance(default, tuple) or numbers[0] > 0):
                    found[field] = tuple(numbers) if isinstance(default, tuple) else numbers[0]
        return replace(Knobs(), **found)

    def rungs(self) -> list[int]:
        return list(self.k_ladder)[: max(1, self.max_rounds)] if self.adaptive_enabled else [self.top_k]


class Embedder(Protocol):
    """Turns texts to vectors, as an expression, so that a corpus is embedded where it lies."""

    model_id: str
    dimension: int

    def embed(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Counts of words by hash, each hash with a sign: no model, and plainly named as such."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.model_id = dimension, f"hashing-{dimension}"

    def places(self, words: Column) -> Column:
        """Where each word counts: at `dimension` and above with a minus, that much lower."""
        return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * self.dimension)).cast("int"))

    def counted(self, places: pa.ChunkedArray) -> np.ndarray:
        """`embed` of claims by the places of their words."""
        of, row = tiles._flat(pa.table({"p": places}), "p")
        sign = np.where(of.to_numpy(zero_copy_only=False) < self.dimension, 1.0, -1.0)
        at = row * self.dimension + of.to_numpy(zero_copy_only=False) % self.dimension
        return np.bincount(at, weights=sign, minlength=len(places) * self.dimension).reshape(len(places), self.dimension)

    def embed(self, text: Column) -> Column:
        places = F.lit(2 * self.dimension)
        counted = lambda places_: F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: (F.size(F.filter(places_, lambda p: p == i)) - F.size(F.filter(places_, lambda p: p == i + self.dimension))).cast("double"))
        return let(F.transform(texts.tokens(text), lambda w: F.pmod(F.xxhash64(w), places)), counted)


def unit(vector: Column) -> Column:
    """The vector with length 1, its length worked out once; a zero vector stays as it is."""
    scaled = lambda v: let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))
    return let(vector, scaled)


def _weighted(docs: DataFrame) -> DataFrame:
    """(fact_id, terms, weights) of every claim: the BM25 weight of each of its words, with the statistics of the whole index."""
    words = docs.select("fact_id", F.col("words").alias("terms"))
    totals = words.agg(F.count("*").alias("all"), F.avg(F.size("terms")).alias("mean"))
    rarity = words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    tf = lambda t: F.size(F.filter("terms", lambda x: x == t))
    each = words.select("fact_id", F.size("terms").alias("length"), F.explode(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))).alias("t"))
    hits = each.select("fact_id", "length", "t.*").join(rarity, "term").join(F.broadcast(totals))  # one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("all") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    rows = hits.groupBy("fact_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("t"))  # as many as a claim has
    return rows.select("fact_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    """The best `most` of each query, with rank; scores that differ after the sixth digit tie, and the id decides."""
    order = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "fact_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def decided(k: int, knobs: Knobs, last: bool) -> Column:
    """Struct (expand, reason) from the counts `retrieved` and `unblocked` of a rung."""
    retrieved, unblocked = F.col("retrieved"), F.col("unblocked")
    ruling = lambda expand, reason: F.struct(F.lit(expand and not last).alias("expand"), F.lit(BUDGET if expand and last else reason).alias("reason"))
    return (
        F.when(retrieved < k, ruling(False, NO_FURTHER))
        .when(unblocked < knobs.min_unblocked, ruling(True, FEW))
        .when(unblocked / retrieved >= knobs.saturation_ratio, ruling(True, SATURATED))
        .otherwise(ruling(False, SUFFICIENT))
    )


def _fused(lexical: DataFrame, semantic: DataFrame, k: int, knobs: Knobs) -> DataFrame:
    """(query, fact_id, hybrid, nth) of the k best of both channels, each cut at k + 1 before the query itself is left out."""

    def channel(hits: DataFrame, name: str) -> DataFrame:
        rows = hits.where((F.col("rank") <= k + 1) & (F.col("query") != F.col("fact_id")))
        w = Window.partitionBy("query")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return rows.select("query", "fact_id", F.when(low == high, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(name))

    both = channel(lexical, "lexical").join(channel(semantic, "semantic"), ["query", "fact_id"], "full_outer").fillna(0.0)
    hybrid = knobs.lexical_weight * F.col("lexical") + knobs.semantic_weight * F.col("semantic")
    order = Window.partitionBy("query").orderBy(F.round("hybrid", 6).desc(), "fact_id")
    return both.withColumn("hybrid", hybrid).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def _rung(lexical: tiles.Scores, semantic: tiles.Scores, own: np.ndarray, k: int, knobs: Knobs) -> tuple[np.ndarray, np.ndarray]:
    """`_fused` on matrices: a mask of the k best of each query, and the hybrid scores."""
    found, hybrid = np.zeros_like(own), np.zeros(own.shape)
    for scores, weight in ((lexical, knobs.lexical_weight), (semantic, knobs.semantic_weight)):
        order = scores.values if scores.null is None else np.where(scores.null, tiles.NO_PAIR, scores.values)
        mask = tiles._best(order, k + 1) & ~own
        low, high = (f(np.where(mask, scores.values, empty), axis=1, keepdims=True, initial=empty) for f, empty in ((np.min, np.inf), (np.max, -np.inf)))
        with np.errstate(invalid="ignore", divide="ignore"):
            hybrid += np.where(mask, weight * np.where(low == high, 1.0, (scores.values - low) / (high - low)), 0.0)
        found |= mask
    return tiles._best(np.where(found, np.floor(hybrid * 1e6 + 0.5) / 1e6, tiles.NO_PAIR), k), hybrid


def _climbed(lexical: tiles.Scores, semantic: tiles.Scores, own: np.ndarray, unblocked: np.ndarray, knobs: Knobs) -> tuple[np.ndarray, ...]:
    """The ladder of some queries over the rows of their blocks: mask of candidates, hybrid scores, rounds, and reason."""
    rungs, n = knobs.rungs(), len(own)
    mask, hybrid, rounds, reasons = np.zeros_like(own), np.zeros(own.shape), np.zeros(n, int), np.full(n, NONE, object)
    left, part = np.arange(n), lambda s, at: tiles.Scores(s.values[at], None if s.null is None else s.null[at])
    for r, k in enumerate(rungs):
        got, score = _rung(part(lexical, left), part(semantic, left), own[left], k, knobs)
        size, free = got.sum(axis=1), (got & unblocked[left]).sum(axis=1)
        few, full = free < knobs.min_unblocked, free >= knobs.saturation_ratio * size
        more = (size >= k) & (few | full)
        why = np.select([size == 0, size < k, more & (r == len(rungs) - 1), few, full], [NONE, NO_FURTHER, BUDGET, FEW, SATURATED], SUFFICIENT)
        stop = ~more | (r == len(rungs) - 1)
        at = left[stop]
        mask[at], hybrid[at], rounds[at], reasons[at] = got[stop], score[stop], r + 1, why[stop]
        left = left[~stop]
        if not len(left):
            break
    return mask, hybrid, rounds, reasons


# What a task hands on of a block's search: why each query ended, its candidates, or its candidates as bits over the places of the block.
ENDS = "query string, k int, rounds int, expansions int, retrieved long, unblocked long, unknown long, elsewhere long, reason string, bounded boolean"
CANDIDATES = "query string, fact_id string, hybrid double, nth int, blocking_reason string, status string"
BITS = "fact_id string, block long, place int, bits array<long>"
_WHY = pa.array([None, "UNKNOWN_FACT_ID", "BLOCK"], pa.string())


@dataclass
class Index:
    """Statistics of all claims for BM25: their number, their mean length, and how many have each of the most frequent words."""

    size: int
    mean: float
    words: list[str]
    counts: list[int]

    @staticmethod
    def of(docs: DataFrame) -> tuple[Index, DataFrame]:
        """Of `docs` (block, words); and (block, word, n) of the other words of each block."""
        total = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
        each = docs.select("block", F.explode(F.array_distinct("words")).alias("word"))
        counts = saved(each.groupBy("word").agg(F.count("*").alias("n")))
        top = counts.orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()
        words = [r["word"] for r in top]
        if len(words) < FREQUENT:
            rare = docs.select("block", F.lit("").alias("word"), F.lit(0).cast("long").alias("n")).limit(0)
        else:
            frequent = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
            rare = each.join(F.broadcast(frequent), "word", "left_anti").distinct().join(counts, "word").select("block", "word", "n")
        return Index(total["n"], total["mean"] or 0.0, words, [r["n"] for r in top]), rare


class _Terms:
    """The words of claims by number: where each stands, its weight, and whether a query asks for it."""

    def __init__(self, words: pa.ChunkedArray, rare: pa.Table, index: Index):
        flat, row = tiles._flat(pa.table({"w": words}), "w")
        encoded = flat.dictionary_encode()
        self.names, n = encoded.dictionary, max(1, len(encoded.dictionary))
        length = np.bincount(row, minlength=len(words))
        key, tf = np.unique(row * n + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.row, self.code, self.n = key // n, key % n, n
        known = pa.concat_arrays([pa.array(index.words, pa.string()), *(c.flatten() for c in rare["words"].chunks)])
        count = np.concatenate([np.array(index.counts, np.int64), rare["n"].to_numpy()])
        at = pc.index_in(self.names, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
        df = count[at][self.code] if len(at) else np.zeros(0)
        idf = np.maximum(1e-6, np.log((index.size - df + 0.5) / (df + 0.5)))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.row] / index.mean)) if len(df) else df
        self.sought = ~pc.is_in(self.names, value_set=pa.array(texts.LABEL_WORDS)).to_numpy(zero_copy_only=False)[self.code] if len(at) else np.zeros(0, bool)
        self.first = np.searchsorted(self.row, np.arange(len(words) + 1))

    def lists(self, start: int, end: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Terms, weights and sought terms of some claims, as in `Search.large`."""
        some = slice(self.first[start], self.first[end])
        code, asks = self.code[some], self.sought[some]
        offsets = self.first[start : end + 1] - self.first[start]
        fewer = np.append(0, np.cumsum(asks))[offsets]
        of = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        return of(offsets, self.names.take(pa.array(code))), of(offsets, pa.array(self.weight[some])), of(fewer, self.names.take(pa.array(code[asks])))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Lexical scores of the claims of several blocks (a row for each block, -1 where it has no more): block by query by claim."""
        blocks, m = rows.shape
        real = np.flatnonzero(rows.ravel() >= 0)
        of = rows.ravel()[real]
        size = self.first[of + 1] - self.first[of]
        entry = np.repeat(self.first[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.repeat(real, size)
        key, asks = place // m * self.n + self.code[entry], self.sought[entry]
        order = np.argsort(key, kind="stable")
        held = key[order]
        lo, hi = np.searchsorted(held, key[asks], "left"), np.searchsorted(held, key[asks], "right")
        size = hi - lo
        at = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return np.bincount(np.repeat(place[asks] * m, size) + place[at] % m, weights=self.weight[entry[at]], minlength=blocks * m * m).reshape(blocks, m, m)


def _batches(start: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Claims of several small blocks of about one size: a row for each block, -1 where it has no more."""
    low = 0
    for m in (1, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, SMALL):
        some = np.flatnonzero((size > low) & (size <= m))
        step = max(1, CELLS // (8 * m * m))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            yield np.where(np.arange(m) < size[part, None], start[part, None] + np.arange(m), -1)
        low = m


def _in_blocks(search: Search, schema: str) -> DataFrame:
    """The search in blocks that a task holds whole, of `rows` (block, fact_id, asked, findable, why, words, v or places, n); many small ones are one group.

    Rows with n are no claims: they say how many claims have the one word that they name.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))
    knobs, index, embedder = search.knobs, search.index, search.embedder
    rungs = np.array(knobs.rungs())

    def ends(ask, ids, why, mask, hybrid, rounds, reasons):
        count = [mask.sum(axis=1), *((mask & (why == w)).sum(axis=1) for w in (0, 1, 2))]
        return [ask, rungs[rounds - 1], rounds, rounds - 1, *count, pa.array(reasons, pa.string()), reasons == BUDGET]

    def candidates(ask, ids, why, mask, hybrid, rounds, reasons):
        i, j = np.nonzero(mask)
        order = np.lexsort((j, -np.floor(hybrid[i, j] * 1e6 + 0.5), i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i) + 1
        return [ask.take(pa.array(i)), ids(i, j), hybrid[i, j], nth, _WHY.take(pa.array(why[i, j])), pc.if_else(pa.array(why[i, j] == 0), "candidate", "blocked")]

    def packed(mask: np.ndarray) -> pa.Array:
        wide = np.zeros((len(mask), -(-mask.shape[1] // 64) * 64), bool)
        wide[:, : mask.shape[1]] = mask
        words = np.packbits(wide, axis=1, bitorder="little").view("<i8")
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel()))

    def run(table: pa.Table) -> pa.Table:
        claim = pc.is_null(table["n"])
        rare, table = table.filter(pc.invert(claim)), table.filter(claim)
        if not table.num_rows:
            return target.empty_table()
        table = table.sort_by([("block", "ascending"), ("fact_id", "ascending")]).combine_chunks()
        flag = lambda c: table[c].to_numpy()
        all_ids, asked, findable, why, block = table["fact_id"].combine_chunks(), flag("asked"), flag("findable"), flag("why"), flag("block")
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        size = np.diff(np.append(start, len(block)))
        place = np.arange(len(block)) - np.repeat(start, size)
        terms, out = _Terms(table["words"], rare, index), []
        if "places" in table.column_names:
            counts = embedder.counted(table["places"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
            table = table.drop_columns(["places"]).append_column("v", lists)
        vectors = tiles._units(table["v"])
        plain = len(vectors) == 1 and len(next(iter(vectors.values()))[0]) == table.num_rows  # all of one dimension
        unit = next(iter(vectors.values()))[1] if plain else None

        def hand_on(at: np.ndarray, those: np.ndarray, lexical: tiles.Scores, semantic: tiles.Scores, held: np.ndarray) -> None:
            """The ladder of the claims `at`, where `those` are the claims of their columns; `held` are the places of the columns in a block."""
            mine = why[those]
            found = _climbed(lexical, semantic, at[:, None] == those, mine == 0, knobs)
            ask = all_ids.take(pa.array(at))
            if schema == BITS:
                mask = np.zeros((len(at), held.max(initial=0) + 1), bool)
                mask[:, held] = found[0] & (mine == 0)
                columns = [ask, block[at], place[at], packed(mask)]
            else:
                columns = (ends if schema == ENDS else candidates)(ask, lambda i, j: all_ids.take(pa.array(those[i, j])), mine, *found)
            out.append(pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], target.names).cast(target))

        for rows in _batches(start, np.where(plain, size, 0)):
            ask = (rows >= 0) & asked[rows]
            if not ask.any():
                continue
            lost = np.broadcast_to(((rows < 0) | ~findable[rows])[:, None, :], (*rows.shape, rows.shape[1]))[ask]
            total = terms.scores(rows)[ask]
            near = tiles.rounded(np.matmul(unit[rows], unit[rows].transpose(0, 2, 1))[ask], lambda i, j: (unit[rows[ask][i]], unit[np.broadcast_to(rows[:, None, :], (*rows.shape, rows.shape[1]))[ask][i, j]]))  # noqa: B023
            those = np.broadcast_to(rows[:, None, :], (*rows.shape, rows.shape[1]))[ask]
            hand_on(rows[ask], those, tiles.Scores(np.floor(total * 1e6 + 0.5) / 1e6, (total <= 0) | lost), tiles.Scores(near, lost), np.arange(rows.shape[1]))
        for b in np.flatnonzero((size > SMALL) | (not plain)):
            first, last = start[b], start[b] + size[b]
            columns = dict(zip(("terms", "weights", "sought"), terms.lists(first, last), strict=True))
            part = pa.table({**columns, "v": table["v"].slice(first, size[b])})
            there, at = np.flatnonzero(findable[first:last]), np.flatnonzero(asked[first:last])
            held, queries = part.take(pa.array(there)), part.take(pa.array(at))
            sought = queries.drop_columns(["terms"]).rename_columns({"sought": "terms"})
            score = {c: tiles.CHANNELS[c](q, held) for c, q in (("lexical", sought), ("semantic", queries))}
            step = max(1, min(tiles.STEP, CELLS // max(1, len(there))))
            for i in range(0, len(at), step):
                j = min(i + step, len(at))
                hand_on(first + at[i:j], np.broadcast_to(first + there, (j - i, len(there))), score["lexical"](i, j), score["semantic"](i, j), there)
        rest = np.flatnonzero(~asked)
        if schema == BITS and len(rest):  # others are found, but ask for nothing
            out.append(pa.table([all_ids.take(pa.array(rest)), pa.array(block[rest]), pa.array(place[rest]), pa.array([[]] * len(rest), pa.list_(pa.int64()))], target.names).cast(target))
        return pa.concat_tables(out) if out else target.empty_table()

    rare = search.rare.select("block", F.array("word").alias("words"), "n")
    rows = search.rows.withColumn("n", F.lit(None).cast("long")).unionByName(rare, allowMissingColumns=True)
    return rows.groupBy(F.pmod(F.xxhash64("block"), F.lit(index.size // GROUP + 1))).applyInArrow(run, schema)


@dataclass
class Search:
    """What is asked among which claims: `rows` of the blocks that a task holds, and of the larger ones (null, if there are none)."""

    rows: DataFrame
    large: DataFrame | None
    knobs: Knobs
    index: Index
    rare: DataFrame
    embedder: Embedder

    def ends(self) -> DataFrame:
        """query, k, rounds, expansions, retrieved, unblocked, unknown and elsewhere (the blocked by reason), reason, bounded."""
        mine = _in_blocks(self, ENDS)
        return mine if self.large is None else mine.unionByName(self._joined()[1])

    def candidates(self) -> DataFrame:
        mine = _in_blocks(self, CANDIDATES)
        return mine if self.large is None else mine.unionByName(self._joined()[0])

    def pairs(self, claims: DataFrame) -> DataFrame:
        """`candidate_pairs` of the search; where a task held the block, a pair is two bits to look at where the cluster is joined, so none is shuffled."""
        both = claims.join(_in_blocks(self, BITS), "fact_id")
        a, b = pairs.prefixed(both, "a_", ("subject", "measure", "block")), pairs.prefixed(both, "b_", ("block",)).drop("b_subject", "b_measure")
        bit = lambda bits, place: F.coalesce(F.expr(f"getbit(get({bits}, cast({place} div 64 as int)), cast({place} % 64 as int)) = 1"), F.lit(False))
        rows = a.join(b, "block").where((F.col("a_seq") < F.col("b_seq")) & (bit("a_bits", "b_place") | bit("b_bits", "a_place")) & ~pairs.same_page())
        rows = rows.drop("block", "a_bits", "b_bits", "a_place", "b_place")
        return rows if self.large is None else rows.unionByName(candidate_pairs(self._joined()[0], claims))

    def _joined(self) -> tuple[DataFrame, DataFrame]:
        if not hasattr(self, "_done"):
            self._done = _in_joins(self.large, self.knobs)
        return self._done


def search(claims: DataFrame, new: DataFrame | None = None, knobs: Knobs = Knobs(), embedder: Embedder | None = None, known: DataFrame | None = None, where: Column | None = None) -> Search:
    """The search of `adaptive_search`, of which only what is asked for is worked out."""
    block = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BLOCK], F.lit("block"))
    findable = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    embedder = embedder or HashingEmbedder()
    rows = claims.select("fact_id", block.alias("block"), findable.alias("findable"), texts.retrieval_text().alias("text")).withColumn("asked", F.lit(True))
    if new is not None:
        rows = rows.drop("asked").join(new.select("fact_id", F.lit(True).alias("asked")).distinct(), "fact_id", "left").fillna(False, ["asked"])
    why = F.lit(0)
    if known is not None:
        rows = rows.join(known.select("fact_id", block.alias("true_block")), "fact_id", "left")
        why = F.when(F.col("true_block").isNull(), 1).when(F.col("true_block") != F.col("block"), 2).otherwise(0)
    vector = [] if hasattr(embedder, "places") else [embedder.embed(F.col("text")).alias("v")]
    docs = saved(rows.select("fact_id", "block", "findable", "asked", why.alias("why"), texts.tokens(F.col("text")).alias("words"), *vector))
    index, rare = Index.of(docs)
    rows = docs if vector else docs.withColumn("places", embedder.places(F.col("words")))
    large = saved(docs.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > tiles.ROWS).select("block"))
    if not large.limit(1).count():
        return Search(rows, None, knobs, index, rare, embedder)
    by_joins = docs.join(large, "block", "left_semi").join(_weighted(docs), "fact_id", "left")
    text = F.array_join("words", " ")  # which has the same words
    by_joins = by_joins.select("fact_id", "block", "findable", "asked", "why", "terms", "weights", texts.query_tokens(text).alias("sought"), F.col("v") if vector else embedder.embed(text).alias("v"))
    return Search(rows.join(large, "block", "left_anti"), saved(by_joins), knobs, index, rare.join(large, "block", "left_anti"), embedder)


def _in_joins(rows: DataFrame, knobs: Knobs) -> tuple[DataFrame, DataFrame]:
    """(candidates, ends) of `rows` as in `_in_blocks`: tiles of each block give the best of each channel, and queries climb in joins."""
    rungs = knobs.rungs()
    index, asked = rows.where("findable"), rows.where("asked").withColumnRenamed("fact_id", "query")
    top = lambda channel, *terms: saved(_ranked(tiles.best(index, asked.select("query", "block", *terms), "fact_id", "block", channel, rungs[-1] + 1, itself=True), rungs[-1] + 1))
    lexical, semantic = top("lexical", F.col("sought").alias("terms")), top("semantic", F.col("v").alias("v"))
    waiting = saved(asked.select("query"))
    candidates, ends = [], []
    for n, k in enumerate(rungs):
        mine = lambda hits: hits.join(waiting, "query", "left_semi")  # noqa: B023, E731
        found = _fused(mine(lexical), mine(semantic), k, knobs).join(rows.select("fact_id", "why"), "fact_id")
        reason = F.when(F.col("why") == 1, "UNKNOWN_FACT_ID").when(F.col("why") == 2, "BLOCK")
        found = saved(found.select("query", "fact_id", "hybrid", "nth", reason.alias("blocking_reason"), F.when(F.col("why") == 0, "candidate").otherwise("blocked").alias("status")))
        number = lambda reason: F.count_if(F.col("blocking_reason") == reason)
        sizes = found.groupBy("query").agg(F.count("*").alias("retrieved"), F.count_if(F.col("status") == "candidate").alias("unblocked"), number("UNKNOWN_FACT_ID").alias("unknown"), number("BLOCK").alias("elsewhere"))
        counts = waiting.join(sizes, "query", "left").fillna(0)
        counts = saved(counts.withColumn("d", decided(k, knobs, n == len(rungs) - 1)))
        stop = counts.where("not d.expand")
        candidates.append(found.join(stop.select("query"), "query", "left_semi"))
        reason = F.when((F.col("retrieved") == 0), NONE).otherwise(F.col("d.reason"))
        ends.append(stop.select("query", F.lit(k).alias("k"), F.lit(n + 1).alias("rounds"), F.lit(n).alias("expansions"), "retrieved", "unblocked", "unknown", "elsewhere", reason.alias("reason"), (F.col("d.reason") == BUDGET).alias("bounded")))
        waiting = saved(counts.where("d.expand").select("query"))
        if not waiting.limit(1).count():
            break
    join = lambda parts: parts[0] if len(parts) == 1 else join([parts[0].unionByName(parts[1]), *parts[2:]])
    return join(candidates), join(ends)


def adaptive_search(claims: DataFrame, new: DataFrame | None = None, knobs: Knobs = Knobs(), embedder: Embedder | None = None, known: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, terminations) of the claims of `new` (all, if not given) among `claims`.

    Candidates have query, fact_id, hybrid, nth, status and blocking_reason: ids that `known` (the authoritative claims; `claims`, if not given) lacks, or has in another
    block, are blocked. Only claims for which `where` holds may be found; they count in the statistics all the same. Terminations have query, k, rounds, expansions, retrieved, unblocked,
    unknown, elsewhere (the blocked, by reason), reason and bounded (whether the ladder ended the search).
    """
    found = search(claims, new, knobs, embedder, known, where)
    return found.candidates(), found.ends()


def candidate_pairs(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs in the form of the gate, each once, the earlier claim first, but for mentions on one page; unknown ids make none."""
    found = candidates.where("status = 'candidate'").select(F.least("query", "fact_id").alias("one"), F.greatest("query", "fact_id").alias("other")).distinct()
    a = pairs.prefixed(claims, "a_")
    b = pairs.prefixed(claims, "b_").drop("subject", "measure")
    sides = found.select(F.explode(F.array(F.struct(F.col("one").alias("a_fact_id"), F.col("other").alias("b_fact_id")), F.struct(F.col("other").alias("a_fact_id"), F.col("one").alias("b_fact_id")))).alias("p")).select("p.*")
    return sides.join(a, "a_fact_id").join(b, "b_fact_id").where((F.col("a_seq") < F.col("b_seq")) & ~pairs.same_page())


def relations(claims: DataFrame, new: DataFrame | None = None, mode: str = "bruteforce", knobs: Knobs = Knobs(), embedder: Embedder | None = None) -> DataFrame:
    """The relations that hold a claim of `new` (all, if not given): by all pairs of a cluster, or by those that retrieval brings.

    Retrieval with a budget as large as the blocks gives what all pairs give.
    """
    if mode == "bruteforce":
        return pairs.relations(pairs.cluster_pairs(claims) if new is None else pairs.delta_pairs(new, claims.join(new.select("fact_id"), "fact_id", "left_anti")))
    if mode != "retrieval":
        raise ValueError(f"no relationship mode {mode!r}")
    return pairs.relations(search(claims, new, knobs, embedder).pairs(claims))
