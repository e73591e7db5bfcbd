import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import chaining, near_dedup, substring_dedup
from attestor.llm.components import components

from .helpers import ODD, SCHEMA, documents, prose


def edited(text, k, seed):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def family_texts():
    texts = dict(ODD)
    for g in range(12):
        base = prose(150, g)
        for j in range(7):
            texts[g * 10 + j] = base if j < 2 else edited(base, j, g * 100 + j)
    texts[500] = texts[0].upper()  # case doesn't matter
    texts[501] = "  " + texts[10].replace(" ", "\n\t")
    for i in range(40):
        texts[600 + i] = prose(12, 1000) + " " + prose(40, 2000 + i)  # a common line, but no near copies
    texts[700] = texts[701] = "a b c"
    return texts


def brute_components(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("small", [False, True])
def test_near_groups_match_brute_force(spark, family_texts, monkeypatch, small):
    if small:  # every region and family is cut to blocks
        for name, value in (("BLOCK", 8), ("REGION", 24), ("FAMILY_BLOCK", 3), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(near_dedup, name, value)
    got = near_dedup.near_groups(documents(spark, family_texts, component_id="x", kept="y")).collect()
    expected = brute_components(family_texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_regions_get_deeper(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 12)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    base = prose(200, 60)
    texts = {i: edited(base, 1 + i % 4, i) for i in range(90)} | {200 + i: edited(prose(200, 61), 6, i) for i in range(40)} | {300 + i: prose(60, i) for i in range(20)}
    got = near_dedup.near_groups(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)
    monkeypatch.setattr(near_dedup, "DEPTHS", (2,))
    got = near_dedup.near_groups(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def test_near_groups_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    one = documents(spark, {1: prose(20, 1)})
    assert [tuple(r) for r in near_dedup.near_groups(one.unionByName(one)).collect()] == [(1, 16, 1, True)] * 2


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in list(root)}


def brute_removed(texts, n=400):
    data = {k: (t or "").encode() for k, t in texts}
    count = Counter(b[i : i + n] for _, t in texts for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for k, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        gone = gone[:-1]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert data
    return sorted(out)


def test_halves_of_a_context_hold_each_start_once():
    rng = random.Random(3)
    for _ in range(500):
        width = rng.randrange(200, 400)
        starts = rng.randrange(1, 401 - width + 1)
        place = rng.randrange(starts - 1, 400 - width + 1)  # every string holds the anchor
        parts = substring_dedup.halves(starts, place, width)
        assert [s for i, j, *_ in parts for s in range(i, j)] == list(range(starts))
        for i, j, new, wide, _ in parts:
            assert wide > width or width == 400
            for s in range(i, j):
                assert s <= i + new and i + new + wide <= s + 400


@pytest.mark.parametrize("crowded, merge", [(substring_dedup.CROWDED, False), (1, False), (3, True)])
def test_repeated_strings_match_brute_force(spark, monkeypatch, crowded, merge):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    if merge:
        monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    passage, texts = prose(120, 77), [(k, t) for k, t in ODD.items()]
    for i in range(6):
        texts.append((i, prose(30 + i, i) + " " + passage + " " + prose(40, 50 + i)))
        texts.append((20 + i, edited(passage, 1, i) + " " + prose(60, 90 + i)))
    texts += [(40, "abcd" * 130), (41, "abcd" * 101), (42, "x" * 399), (43, "x" * 401), (44, passage), (45, passage), (45, passage), (46, "é" * 300)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, 1) for k, t in texts], SCHEMA + ", n_removed int")
    got = substring_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute_removed(texts)


def test_no_documents_have_no_repeats(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fuzzy_passages_are_found_and_clean_texts_left_alone(spark):
    passage = prose(70, 5)
    texts = dict(ODD)
    for i in range(8):
        texts[i] = prose(60 + i, 300 + i) + " " + (passage if i % 2 else edited(passage, 4, i)) + " " + prose(50, 400 + i)
    for i in range(20, 40):
        texts[i] = prose(200, i)
    texts[50], texts[51] = texts[20], texts[20]
    got = chaining.fuzzy_passages(documents(spark, texts, chain="x")).collect()
    touched = {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got}
    assert touched == {*range(8), 20, 50, 51}
    for r in got:
        assert r["identity"] >= chaining.MIN_IDENTITY and r["doc_id"] > r["other_doc_id"]
        if r["doc_id"] < 8:
            start = 60 + r["doc_id"]
            assert abs(r["start_word"] - start) <= 16 and abs(r["end_word"] - start - 70) <= 16
    assert chaining.fuzzy_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fuzzy_passages_whose_parts_smaller_documents_hold_are_found(spark):
    w = prose(60, 8).split()
    whole, front, back = " ".join(w), " ".join(w[:30]), " ".join(w[30:])
    inside = {1: front, 2: back, 3: back, 5: whole, 6: front, 7: whole, 8: edited(whole, 3, 1)}
    texts = {k: f"{prose(50, 700 + k)} {t} {prose(50, 800 + k)}" for k, t in inside.items()}
    got = chaining.fuzzy_passages(documents(spark, texts)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} >= {(7, 5)}
    assert {r["doc_id"] for r in got} == {7, 8} and {r["other_doc_id"] for r in got} <= {5, 7}


def test_bits_in_smaller_documents_do_not_come_between(spark):
    w = prose(60, 41).split()
    texts = {i: f"{prose(20, 900 + i)} {' '.join(w[9 * i : 9 * i + 14])} {prose(20, 950 + i)}" for i in range(6)}
    texts |= {k: f"{prose(30, k)} {' '.join(w)} {prose(30, k + 1)}" for k in (20, 21)}
    # and bits that overlap, so that no seed of the passage is the two documents' own
    other = prose(60, 42).split()
    texts |= {30: " ".join(other[:40]) + " " + prose(9, 1), 31: " ".join(other[20:]) + " " + prose(9, 2), 40: prose(9, 3) + " " + " ".join(other), 41: " ".join(other) + " " + prose(9, 4)}
    got = {(r["doc_id"], r["other_doc_id"]): r for r in chaining.fuzzy_passages(documents(spark, texts)).collect()}
    assert (21, 20) in got and (41, 40) in got
    assert (got[21, 20]["start_word"], got[21, 20]["end_word"], got[21, 20]["matched_words"]) == (30, 90, 60)
    assert {a for a, _ in got} == {21, 41}


def shared_windows(texts, n):
    holders = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        for i in range(len(w) - n + 1):
            holders.setdefault(tuple(w[i : i + n]), set()).add(k)
    return {k for v in holders.values() if len(v) > 1 for k in v}


def test_every_exact_passage_is_found(spark):
    rng, texts = random.Random(8), dict(ODD)
    passages = [prose(rng.randrange(50, 90), 5000 + i) for i in range(12)] + ["of " * 70, "it is " * 60]
    for k in range(160):
        parts = [prose(rng.randrange(3, 80), 6000 + k)]
        for _ in range(rng.randrange(3)):
            w = rng.choice(passages).split()
            # whole, or a bit of any length
            i, j = (0, len(w)) if rng.random() < 0.5 else sorted(rng.sample(range(len(w) + 1), 2))
            parts += [" ".join(w[i:j]), prose(rng.randrange(3, 40), 9000 + k)]
        texts[k] = " ".join(parts)
    rows = documents(spark, texts)
    got = chaining.fuzzy_passages(rows.unionByName(rows.where("doc_id < 20"))).collect()
    touched = {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got}
    assert touched >= shared_windows(texts, 50) and touched <= shared_windows(texts, 15)
    for r in got:
        a, b = texts[r["doc_id"]].lower().split()[r["start_word"] : r["end_word"]], texts[r["other_doc_id"]].lower().split()[r["other_start_word"] : r["other_end_word"]]
        assert min(len(a), len(b)) >= chaining.MIN_WORDS and r["matched_words"] <= chaining.common_words(a, b)
        assert r["identity"] == 2 * r["matched_words"] / (len(a) + len(b)) >= chaining.MIN_IDENTITY


def test_long_copies_are_found_from_end_to_end_wherever_their_seeds_lead(spark):
    w = prose(5000, 77).split()
    texts = {i: " ".join(w[i * 300 : i * 300 + 300]) for i in range(16)} | {50: " ".join(w), 51: prose(30, 5) + " " + " ".join(w)}
    got = chaining.fuzzy_passages(documents(spark, texts)).collect()
    assert {r["other_doc_id"] for r in got if r["doc_id"] == 51} >= set(range(16))
    assert any((r["doc_id"], r["other_doc_id"]) == (51, 50) and (r["start_word"], r["end_word"]) == (30, 5030) for r in got)


@pytest.mark.parametrize("share, least", [(0.05, 0.98), (0.1, 0.95), (0.2, 0.7)])
def test_recall_of_edited_passages(spark, share, least):
    n, texts = 150, {}
    for i in range(n):
        passage = prose(70, 20000 + i)
        texts[i], texts[1000 + i] = f"{prose(40, i)} {passage} {prose(40, i + 400)}", f"{prose(40, i + 800)} {edited(passage, round(70 * share), i)} {prose(40, i + 1200)}"
    got = {(r["doc_id"], r["other_doc_id"]) for r in chaining.fuzzy_passages(documents(spark, texts)).collect()}
    right = {(1000 + i, i) for i in range(n)}
    print("recall", share, len(got & right) / n)
    assert len(got & right) >= least * n and got <= right


@pytest.mark.parametrize("length, share, least", [(60, 0.05, 0.95), (60, 0.1, 0.9), (60, 0.2, 0.8), (100, 0.2, 0.95)])
def test_recall_of_edited_passages_where_others_hold_bits(spark, length, share, least):
    n, bit, texts = 60, 28, {}
    for i in range(n):
        passage = prose(length, 30000 + i)
        words = passage.split()
        texts[10000 + i] = f"{prose(40, i)} {passage} {prose(40, i + 400)}"
        texts[20000 + i] = f"{prose(40, i + 800)} {edited(passage, round(length * share), i)} {prose(40, i + 1200)}"
        # overlapping bits in smaller documents, one in a document between the two, one in a larger one
        for k, at in enumerate(range(0, length - bit + 1, 14)):
            texts[i * 20 + k] = f"{prose(30, 50000 + i * 20 + k)} {' '.join(words[at : at + bit])} {prose(30, 70000 + i * 20 + k)}"
        texts[15000 + i] = f"{prose(30, 90000 + i)} {' '.join(words[9 : 9 + bit])} {prose(30, 91000 + i)}"
        texts[25000 + i] = f"{prose(30, 92000 + i)} {' '.join(words[20 : 20 + bit])} {prose(30, 93000 + i)}"
    got = {(r["doc_id"], r["other_doc_id"]) for r in chaining.fuzzy_passages(documents(spark, texts)).collect()}
    right = {(20000 + i, 10000 + i) for i in range(n)}
    print("recall with bits", length, share, len(got & right) / n)
    assert len(got & right) >= least * n and got <= right


@pytest.mark.parametrize("length, share, least", [(60, 0.05, 1.0), (60, 0.1, 0.95), (60, 0.2, 0.8), (100, 0.2, 0.95)])
def test_recall_of_edited_passages_behind_many_others_that_hold_bits(spark, length, share, least):
    n, bit, texts = 60, 28, {}
    for i in range(n):
        passage = prose(length, 30000 + i)
        words = passage.split()
        texts[10000 + i] = f"{prose(40, i)} {passage} {prose(40, i + 400)}"
        texts[90000 + i] = f"{prose(40, i + 800)} {edited(passage, round(length * share), i)} {prose(40, i + 1200)}"
        # each bit in a smaller document and in six between the two
        for k, at in enumerate(range(0, length - bit + 1, 7)):
            for j in range(7):
                doc = (20000 if j else 0) + i * 100 + k * 7 + j
                texts[doc] = f"{prose(30, 100000 + doc)} {' '.join(words[at : at + bit])} {prose(30, 200000 + doc)}"
    got = {(r["doc_id"], r["other_doc_id"]) for r in chaining.fuzzy_passages(documents(spark, texts)).collect()}
    right = {(90000 + i, 10000 + i) for i in range(n)}
    print("recall behind many bits", length, share, len(got & right) / n)
    assert len(got & right) >= least * n and got <= right


def test_passages_shared_with_one_that_is_itself_covered_are_found(spark):
    # the second shares a passage with the first; the third has the second's too much edited to share it with the first
    n, texts = 60, {}
    for i in range(n):
        first = prose(60, 40000 + i)
        second = edited(first, 8, i)
        third = second.split()
        kept = [k for k, w in enumerate(third) if not w.startswith("edit")]
        for k in random.Random(i).sample(kept, 9):
            third[k] = f"new{i}x{k}"
        texts |= {i: f"{prose(40, i)} {first}", 1000 + i: f"{prose(40, 400 + i)} {second}", 2000 + i: f"{prose(40, 800 + i)} {' '.join(third)}"}
    got = {(r["doc_id"], r["other_doc_id"]) for r in chaining.fuzzy_passages(documents(spark, texts)).collect()}
    found = [len(got & {(2000 + i, k * 1000 + i) for i in range(n)}) / n for k in (0, 1)]
    print("recall behind a covered holder", found)
    assert found[1] >= 0.95


def test_a_common_line_makes_no_match_for_each_pair_of_its_documents(spark, monkeypatch):
    line, matches, whole = prose(35, 7), [], chaining._wide_matches
    monkeypatch.setattr(chaining, "_wide_matches", lambda linked: matches.append(whole(linked)) or matches[-1])
    monkeypatch.setattr(chaining, "dropped", lambda df: None)
    texts = {i: f"{prose(60, 5000 + i)} {line} {prose(60, 9000 + i)}" for i in range(300)}
    passage = f"{line} {prose(30, 8)}"
    texts |= {300: f"{prose(9, 3)} {passage} {prose(60, 1)}", 700: f"{prose(60, 2)} {edited(passage, 6, 1)}"}
    got = [(r["doc_id"], r["other_doc_id"]) for r in chaining.fuzzy_passages(documents(spark, texts)).collect()]
    counted = sum(m.count() for m in matches)
    assert got == [(700, 300)] and 0 < counted < 5 * len(texts)


@pytest.mark.parametrize("seed", range(5))
def test_wide_keys_match_plain_loops(seed):
    rng = np.random.default_rng(seed)
    edge = np.append(0, np.cumsum(rng.integers(1, 130, 4)))
    three = rng.integers(0, 1 << 60, edge[-1]).astype(np.uint64)
    rows = []
    for a, b in zip(edge, edge[1:], strict=False):
        for lo in rng.integers(a, max(a + 1, b - 5), 6):
            for side in (0, -1, 1):
                rows.append((a, b, lo, min(b, lo + (5 if side == 0 else int(rng.integers(5, 60)))), side))
    first, end, lo, hi, side = (np.array(c) for c in zip(*rows, strict=True))
    row, _, new_lo, new_hi, other = chaining.wide_keys(three, first, end, np.arange(len(rows)).astype(np.uint64), lo, hi, side)
    want = []
    for i, (a, b, x, y, s) in enumerate(rows):
        for p in range(a, b - 2):
            gap = p - y if p >= y else x - p - 3
            far = chaining.SIDE_NEAR <= gap < chaining.SIDE_FAR if s == 0 else 0 <= gap < chaining.SIDE_FAR and max(y, p + 3) - min(x, p) >= chaining.SPAN
            if gap >= 0 and far and s in (0, 1 if p >= y else -1):
                want.append((i, min(x, p), max(y, p + 3), -1 if p >= y else 1))
    assert sorted(zip(row.tolist(), new_lo.tolist(), new_hi.tolist(), other.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_neighbours_go_on_over_batches(rows):
    held = [(1, 1, 0), (1, 1, 9), (1, 2, 0), (1, 2, 4), (1, 2, 8), (1, 3, 0), (1, 4, 0), (1, 5, 5), (2, 5, 0), (3, 1, 0), (3, 9, 0)]
    table = pa.table({"h": pa.array([h for h, _, _ in held], pa.int64()), "doc_id": [d for _, d, _ in held], "at": [a for _, _, a in held]})
    got = sorted((r["doc_id"], r["at"], r["other_id"], r["other_at"]) for b in chaining._neighbours(iter(table.to_batches(max_chunksize=rows))) for r in b.to_pylist())
    want = []
    for h, doc, at in held:
        before = sorted({d for g, d, _ in held if g == h and d < doc})[-chaining.NEIGHBOURS :]
        want += [(doc, at, d, min(a for g, e, a in held if (g, e) == (h, d))) for d in before]
    assert got == sorted(want)


def test_open_seeds_lie_in_no_passage():
    rows = [(None, "a", 10, 60), (None, "a", 40, 100), (1, "a", 10, None), (2, "a", 9, None), (3, "a", 57, None), (4, "a", 96, None), (5, "b", 20, None), (None, "c", 0, 90), (6, "c", 1, None)]
    table = pa.table({"h": pa.array([r[0] for r in rows], pa.int64()), "doc_id": [r[1] for r in rows], "at": [r[2] for r in rows], "end": [r[3] for r in rows]})
    got = [r["h"] for b in chaining._open_seeds(iter(table.to_batches())) for r in b.to_pylist()]
    assert got == [2, 4, 5]


@pytest.mark.parametrize("seed", range(30))
def test_chain_matches_quadratic_scoring(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 12))
    # anchors that don't overlap, for which the chains' scores are exact
    rows = np.stack([np.sort(rng.choice(60, n, replace=False)) * 7, rng.choice(60, n, replace=False) * 7, np.full(n, 6)], axis=1)
    worth = lambda a, b: 6 - 0.15 * sum(max(0, b[i] - a[i] - 6) for i in (0, 1))
    best = [6.0] * n
    for j in range(n):
        best[j] = max([6.0, *(best[i] + worth(rows[i], rows[j]) for i in range(j) if rows[i, 0] < rows[j, 0] and rows[i, 1] < rows[j, 1])])
    first = chaining.chain(rows.copy(), 0.15)[0]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(first, first[1:]))
    assert abs(6 + sum(worth(a, b) for a, b in zip(first, first[1:])) - max(best)) < 1e-9
    assert sorted(x for c in chaining.chain(rows.copy()) for x in c[:, 0]) == sorted(rows[:, 0])
    assert chaining.common_words([1, 2, 3, 4], [2, 9, 4]) == 2


def test_words_of_like_form_have_hashes_of_their_own(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(documents(spark, {1: a, 2: b, 3: a})).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
