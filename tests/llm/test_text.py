import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import substring_dedup as sd
from attestor.llm import textbatch as tb
from attestor.llm.suffix_array import permuted_lcp, suffix_order


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÄé.Z", max_size=30)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_are_the_blank_free_runs(texts):
    data, offsets = tb.utf8(pa.array(texts, pa.string()))
    w = tb.words(data, offsets)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    expected = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]
    assert w.counts().tolist() == [len(x) for x in expected]
    seen = {}
    for word, h in zip([x for e in expected for x in e], w.hash.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    sets, at = tb.shingle_sets(w, 3)
    sizes = [len({tuple(e[i : i + 3]) for i in range(len(e) - 2)}) if len(e) >= 3 else bool(e) for e in expected]
    assert np.diff(at).tolist() == sizes


def test_pieces_cover_all_rows():
    offsets = np.array([0, 3, 3, 50, 51, 60])
    assert list(tb.pieces(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]


def test_key_runs_never_split_a_key():
    batches = [pa.record_batch({"k": pa.array(x)}) for x in ([1, 1, 2], [2, 2], [2, 3, 3], [4], [4, 5])]
    seen = [b.column("k").to_pylist() for b in tb.key_runs(iter(batches), "k")]
    assert [x for s in seen for x in s] == [1, 1, 2, 2, 2, 2, 3, 3, 4, 4, 5]
    assert all(not set(a) & set(b) for i, a in enumerate(seen) for b in seen[i + 1 :])


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None)
def test_suffix_order_and_lcp(symbols, seed):
    s = np.array([*symbols, 0])
    expected = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert suffix_order(s).tolist() == expected
    some = np.sort(np.random.default_rng(seed).choice(len(symbols), max(1, len(symbols) // 2), replace=False))
    order = suffix_order(s, some)
    assert order.tolist() == [i for i in expected if i in set(some.tolist())]
    text = np.array(symbols, np.uint8)

    def lcp(a, b):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        return k

    assert permuted_lcp(text, order, len(text) - np.arange(len(text))).tolist() == [0] + [lcp(a, b) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("seed", range(40))
def test_repeats_in_a_shard(seed):
    rng, n = np.random.default_rng(seed), 6
    base = rng.integers(97, 100, 14).astype(np.uint8)
    blobs = set()
    for _ in range(rng.integers(1, 8)):
        b = base.copy()
        b[rng.integers(len(b), size=2)] = rng.integers(97, 100, 2)
        blobs.add(b[rng.integers(0, 4) :].tobytes())
    blobs = sorted(blobs)
    starts = [b[i : i + n] for b in blobs for i in range(len(b) - n + 1)]
    for b, mask in zip(blobs, sd.repeats_in_shard(blobs, np.zeros(len(blobs), bool), n), strict=True):
        assert mask.tolist() == [starts.count(b[i : i + n]) > 1 for i in range(len(b) - n + 1)]


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 60).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, k).astype(np.uint8), shared, rng.integers(97, 123, 30).astype(np.uint8)]) for k in (5, 17, 40)]
    anchors = []
    for t in texts:
        _, start, count, h, _ = sd.contexts(t, np.array([0, len(t)]), length=50, anchor=20)
        of = {int(s) + j: int(x) for s, c, x in zip(start, count, h, strict=True) for j in range(c)}
        assert sorted(of) == list(range(len(t) - 49))
        begin = len(t) - 90
        anchors.append([of[begin + j] for j in range(11)])
    assert anchors[0] == anchors[1] == anchors[2]
