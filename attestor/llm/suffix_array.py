"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

The suffixes of a text are classified as S (smaller than the next suffix) or L. The
leftmost S of each run (LMS) cuts the text to substrings; these are sorted and named,
and the sequence of names, at most half as long, is sorted by recursion. Every
other suffix then follows from its symbols up to the next LMS position and the rank
of the LMS suffix there. Symbols carry their class, so that no such stretch is a
proper prefix of another.

Each pass works on whole arrays: stretches are compared in chunks of packed symbols,
and only those that still tie go on to the next chunk.
"""

from __future__ import annotations

import numpy as np


def _classes(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(step, 1)[at] > 0
    return small


class _Packed:
    """`per` symbols from each position on, packed to one integer."""

    def __init__(self, u: np.ndarray):
        self.bits = max(1, int(u.max()).bit_length())
        self.per = max(1, 60 // self.bits)
        n = len(u)
        wide = np.concatenate([u.astype(np.uint64), np.zeros(self.per, np.uint64)])
        self.key = np.zeros(n, np.uint64)
        for j in range(self.per):
            self.key = (self.key << np.uint64(self.bits)) | wide[j : n + j]
        self.masks = np.array([((1 << self.bits * self.per) - 1) ^ ((1 << self.bits * (self.per - k)) - 1) for k in range(self.per + 1)], np.uint64)

    def groups(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A number for each stretch that orders them; equal ones get the same."""
        m = len(start)
        group = np.zeros(m, np.int64)
        todo, done = np.arange(m), 0
        while len(todo):
            at = start[todo] + done
            left = np.clip(length[todo] - done, 0, self.per)
            chunk = self.key[np.minimum(at, len(self.key) - 1)] & self.masks[left]
            order = np.argsort(chunk, kind="stable") if done == 0 else np.lexsort((chunk, group[todo]))
            g, c, sorted_todo = group[todo][order], chunk[order], todo[order]
            new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
            first = np.flatnonzero(new)
            # a part's number is its group's plus the members of the group before it
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            offset = np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g))))
            size = np.diff(np.append(first, len(g)))
            group[sorted_todo] = g + np.repeat(offset[first], size)
            done += self.per
            todo = sorted_todo[(np.repeat(size, size) > 1) & (length[sorted_todo] > done)]
        return group


def _lms(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with their class, LMS positions, and each position's next LMS position."""
    small = _classes(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    after = np.searchsorted(lms, np.arange(len(s)), "right")
    return (s.astype(np.int64) << 1) | small, lms, after


def suffix_order(s: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted positions of `s` (all, if not given) in the order of their suffixes.

    `s` holds nonnegative integers, the last one smaller than all others.
    """
    n = len(s)
    wanted = np.arange(n) if wanted is None else wanted
    if n < 3:
        return wanted[np.lexsort((-wanted, s[wanted]))] if n < 2 or s[0] == s[-1] else wanted[np.argsort(s[wanted], kind="stable")]
    u, lms, after = _lms(s)
    packed = _Packed(u)
    if len(lms) > 1:
        stretch = np.append(lms[1:] - lms[:-1] + 1, 1)
        group = packed.groups(lms, stretch)
        values, names = np.unique(group, return_inverse=True)
        if len(values) < len(lms):
            rank = np.empty(len(lms), np.int64)
            rank[suffix_order(names)] = np.arange(len(lms))
        else:
            rank = names
    else:
        rank = np.zeros(len(lms), np.int64)
    # induction: the stretch to the next LMS position, then the rank of the suffix there
    last = after[wanted] == len(lms)
    end = np.where(last, n - 1, lms[np.minimum(after[wanted], len(lms) - 1)])
    group = packed.groups(wanted, end - wanted + 1)
    tie = np.where(last, 0, rank[np.minimum(after[wanted], len(lms) - 1)] + 1)
    return wanted[np.argsort(group * (len(lms) + 2) + tie, kind="stable")]


def permuted_lcp(s: np.ndarray, order: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it (0 for the first).

    `s` are bytes and `limit[p]` is how far a comparison may go from position p. Going by text
    position, a suffix whose predecessor is one past that of the suffix one before it (and these two
    begin alike) shares one symbol less; only the others (the irreducible ones) are compared.
    """
    m = len(order)
    if m < 2:
        return np.zeros(m, np.int64)
    before = np.full(len(s) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    position = np.sort(order)
    position = position[before[position] >= 0]
    phi = before[position]
    follows = np.append(False, (np.diff(position) == 1) & (np.diff(phi) == 1) & (s[position[:-1]] == s[phi[:-1]]))
    p, q = position[~follows], phi[~follows]
    most = np.minimum(limit[p], limit[q])
    wide = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(s), np.uint64)
    for j in range(8):
        word |= wide[j : len(s) + j] << np.uint64(8 * j)
    length = np.zeros(len(p), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        x = word[p[going] + length[going]] ^ word[q[going] + length[going]]
        same = np.where(x == 0, 8, 0)
        some = np.flatnonzero(x)
        if len(some):
            low = x[some] & (~x[some] + np.uint64(1))
            same[some] = (np.log2(low.astype(np.float64)).astype(np.int64)) >> 3
        length[going] += same
        going = going[(x == 0) & (length[going] < most[going])]
    length = np.minimum(length, most)
    # irreducible values run down by one along the text
    index = np.maximum.accumulate(np.where(follows, 0, np.arange(len(position))))
    value = np.zeros(len(position), np.int64)
    value[~follows] = length
    value = np.maximum(0, value[index] - (np.arange(len(position)) - index))
    plcp = np.zeros(len(s) + 1, np.int64)
    plcp[position] = value
    return plcp[order]
