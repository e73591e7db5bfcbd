"""Quality rules, Merkle manifest and clustering against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm import clustering, merkle, repetition
from attestor.llm.registry import queries

from .helpers import ODD, documents, prose

WORD = r"[^\x20\x09-\x0D]+"


def plain_rules(text: str | None, least: int) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    raw = text.encode()
    found = Counter(raw[i : i + least] for i in range(len(raw) - least + 1))
    covered = {i + k for i in range(len(raw) - least + 1) if found[raw[i : i + least]] > 1 for k in range(least)}
    longest = 0
    for n in range(least, len(raw)):
        if len({raw[i : i + n] for i in range(len(raw) - n + 1)}) == len(raw) - n + 1:
            break
        longest = n
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(raw), len(covered), longest


def texts_that_repeat() -> dict[int, str | None]:
    rng = random.Random(5)
    line = "a line that stands here more than once, and is long enough to count."
    out = {i: "\n".join(rng.choice([line, prose(12, rng.randrange(9)), prose(9, i), "", " x ", "é" * 30]) for _ in range(rng.randrange(1, 12))) for i in range(40)}
    out |= {100: "ab" * 200, 101: "a" * 130, 102: "\n\n\n", 103: "é# $%\r\né# $%\r\n", 104: line, 105: line + line, 106: "one two three one two three"}
    return out | ODD


def test_rules_are_those_of_the_plain_version(spark):
    texts = texts_that_repeat()
    got = {r["doc_id"]: r for r in repetition.quality_rules(documents(spark, texts).repartition(3)).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "covered_bytes", "longest_repeat"]
    for i, text in texts.items():
        if i == 906:  # too long for the plain version
            continue
        r, want = got[i], plain_rules(text, repetition.MIN_REPEAT)
        assert tuple(r[c] for c in names) == want, i
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and want[6] <= repetition.MAX_COVERED * want[5] and want[7] <= repetition.MAX_LONGEST)
        assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == want[6]
    assert got[906]["kept"] and got[906]["covered_bytes"] == 0


def test_a_text_of_copies_fails_and_prose_does_not(spark):
    long = prose(300, 1)
    texts = {0: prose(400, 2), 1: "\n".join([prose(30, 3), *["buy this now while it lasts, at half of the price it had! " + prose(5, 4)] * 9]), 2: long + "\n" + prose(2500, 8) + "\n" + long}
    got = {r["doc_id"]: r for r in repetition.quality_rules(documents(spark, texts)).collect()}
    assert got[0]["kept"] and not got[1]["kept"]
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[2]["longest_repeat"] >= len(long) > repetition.MAX_LONGEST


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=2, max_size=60), st.integers(1, 5))
def test_intervals_are_the_maximal_repeats(text, least):
    raw = np.frombuffer(text.encode(), np.uint8)
    _, longest, maximal = repetition.repeats(raw, np.arange(len(raw)), least)
    places = defaultdict(list)
    for n in range(least, len(text)):
        for i in range(len(text) - n + 1):
            places[text[i : i + n]].append(i)
    repeated = {s: at for s, at in places.items() if len(at) > 1}
    whole = [s for s, at in repeated.items() if len({text[i - 1] if i else None for i in at}) > 1 or 0 in at]
    whole = [s for s in whole if len({text[i + len(s) : i + len(s) + 1] or None for i in repeated[s]}) > 1]
    assert maximal == len(whole) and longest == max(map(len, repeated), default=0) * (max(map(len, repeated), default=0) >= least)


def plain_manifest(rows: list[tuple], tampered: bool = True) -> dict:
    digest = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(one, (r[0], r[3], r[2], r[4], text)))
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r))

    def rise(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(levels, i):
        for nodes in levels[:-1]:
            first = i // 8 * 8
            yield nodes[first:i], nodes[i + 1 : first + 8]
            i //= 8

    trees = {k: rise([k2[2] for k2, _ in sorted(v, key=lambda x: x[0])]) for k, v in parts.items()}
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    whole = rise([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, (_, r) in enumerate(sorted(parts[k], key=lambda x: x[0])):
            steps = [*path(trees[k], i), *path(whole, g)]
            changed = r[1] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            node = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if changed else r[1])
            for a, b in steps:
                node = digest(*a, node, *b)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], whole[-1][0], digest(*[x for a, b in steps for x in a + b]), node, node == whole[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(3)
    langs = [None, "en", "é", "z", "a", "", *[f"l{i}" for i in range(12)]]
    rows = [(i, rng.choice(["Ab C", "", None, "É lower", prose(3, i)]), rng.choice(langs[:2]) if i % 3 else rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 7])) for i in range(300)]
    return rows + [rows[5], rows[5], (None, "N", "en", "s", 1), (None, None, None, None, None), (7, "other text", "en", "s", 1), (5000, "alone", "only", "s", 1)]


@pytest.mark.parametrize(("levels", "partitions"), [(4, 4), (1, 7), (2, 3)])
def test_manifest_is_that_of_the_plain_version(spark, levels, partitions):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string").repartition(partitions)
    got = merkle.manifest(docs, {"text": merkle.tampered(F.col("doc_id"), F.col("text"))}, levels=levels).collect()
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(plain_manifest(rows), key=order)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "Text", "en", None, 4)]
    got = merkle.manifest(documents(spark, {}).limit(0).unionByName(spark.createDataFrame(one, documents(spark, {}).schema))).collect()
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] == got[0]["folded_root"] and got[0]["verified"]
    assert got[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(documents(spark, {})).collect() == []


def plain_lloyd(vectors: list[tuple]) -> dict:
    kept = [(i, np.floor(64 * np.array(x, float)).astype(np.int64)) for i, x in vectors if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x)]
    points = np.array([x for _, x in kept])
    first = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), points[j].tolist()))[:16]
    centroids = points[first]
    distances = lambda: ((points[:, None] - centroids[None]) ** 2).sum(2)
    for _ in range(3):
        cluster = distances().argmin(1)
        for c in range(len(centroids)):
            if len(mine := points[cluster == c]):
                centroids[c] = [int(s) // len(mine) for s in mine.sum(0)]
    cluster, best = distances().argmin(1), distances().min(1)
    own = np.bincount(cluster, best, 16).astype(np.int64)
    return sorted((str(kept[j][0]), int(cluster[j]), int(best[j]), int(own[cluster[j]]), int(best.sum()), hashlib.sha256(",".join(map(str, centroids[cluster[j]].tolist())).encode()).hexdigest()) for j in range(len(kept)))


@pytest.mark.parametrize(("spread", "block", "leaf"), [(0.02, 1024, 16), (1.0, 64, 4), (0.0, 32, 2)])
def test_clusters_are_those_of_plain_lloyd(spark, spread, block, leaf):
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 1, (9, 64))
    vectors = [(i, [float(v) for v in centers[i % 9] + spread * rng.normal(0, 1, 64)]) for i in range(250)]
    vectors += [vectors[3], vectors[3], (None, vectors[0][1]), (900, None), (901, [1.0]), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, []), (906, [0.0] * 64)]
    table = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    got = clustering.lloyd(table, block_rows=block, leaf_rows=leaf).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_lloyd(vectors)


def test_few_vectors_and_none(spark):
    table = spark.createDataFrame([(5, [0.5] * 64), (6, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["distance"]) for r in clustering.lloyd(table).collect()} == {(5, 0), (6, 0)}
    none = clustering.lloyd(table.limit(0))
    assert none.collect() == [] and none.columns == clustering.lloyd(table).columns
    huge = spark.createDataFrame([(i, [(-1.0) ** i * 1e300] * 64) for i in range(40)], "vec_id long, embedding array<double>")
    assert clustering.lloyd(huge).count() == 40


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 80), st.integers(1, 9), st.sampled_from([1, 3, 40]))
def test_two_trees_find_the_nearest_centroid(seed, n, k, size):
    rng = np.random.default_rng(seed)
    rows, centroids = rng.integers(-size, size, (n, 4)), rng.integers(-size, size, (k, 4))
    tree, order = clustering.cover_tree(rows, 3)
    assert sorted(order.tolist()) == list(range(n)) and (tree.rows == rows[order]).all()
    for i in range(len(tree.center)):
        inside = tree.rows[tree.start[i] : tree.end[i]]
        assert (clustering._distance(inside, tree.rows[tree.center[i : i + 1]]) <= tree.radius[i]).all()
    few, number = clustering.cover_tree(centroids, 1)
    whole, at, nearest = clustering.nearest(tree, few, number)
    found = np.full(n, -1)
    for lo, hi, c in whole.tolist():
        assert (found[lo:hi] == -1).all()
        found[lo:hi] = c
    assert (found[at] == -1).all()
    found[at] = nearest
    assert (found == ((tree.rows[:, None] - centroids[None]) ** 2).sum(2).argmin(1)).all()


def test_distance_bounds_spare_comparisons():
    rng = np.random.default_rng(1)
    centers = rng.integers(-3000, 3000, (16, 64))
    rows = centers[rng.integers(0, 16, 1000)] + rng.integers(-20, 20, (1000, 64))
    tree, _ = clustering.cover_tree(rows)
    few, number = clustering.cover_tree(centers, 1)
    whole, at, _ = clustering.nearest(tree, few, number)
    assert len(at) == 0 and (whole[:, 1] - whole[:, 0]).sum() == 1000 and len(whole) < 100


def test_the_queries_read_whole_tables(spark):
    small = "/root/testdata/sf0.001"
    for name, rows in (("op11_quality_rules", "documents"), ("op12_merkle_manifest", "documents"), ("op13_centroid_clustering", "embeddings")):
        assert queries()[name](spark, small).count() == spark.read.parquet(f"{small}/{rows}.parquet").count()
