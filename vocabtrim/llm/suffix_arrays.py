"""Suffix arrays by induced sorting, vectorised for one shard of bounded size.

Suffixes are classified as smaller or larger than their successor; the leftmost
smaller ones are sorted by induction over their substrings, named, and the string of
names is sorted again.  Its alphabet is as large as itself, so that recursion names
ever longer substrings by pairs of names (its length doubles a level) until all names
differ.  A last induction gives all suffixes.  Both inductions go through the buckets
of the byte alphabet; all work inside a bucket is done on whole arrays.
"""

from __future__ import annotations

import numpy as np

SIGMA = 258
"""Sentinel 0, separator 1, bytes + 2."""


def shard_text(parts: list[bytes]):
    """The parts with a separator after each and the sentinel; and where each begins."""
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64) if parts else np.zeros(0, np.int64)
    raw = np.frombuffer(b"\0".join(parts), np.uint8).astype(np.int16) + 2
    text = np.empty(int(size.sum()) + len(parts) + 1, np.int16)
    text[:len(raw)] = raw
    text[begin + size] = 1
    text[-1] = 0
    return text, begin


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the sentinel counts as such)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    up = np.concatenate((text[change + 1] > text[change], [True]))
    return np.repeat(up, np.diff(np.concatenate(([-1], change, [n - 1]))))


def _spread(at: np.ndarray, wanted: np.ndarray, text: np.ndarray, buckets) -> None:
    """Put the predecessors that are ``wanted`` at the end of their buckets, in order."""
    at = at[at > 0] - 1
    at = at[wanted[at]]
    if len(at) == 0:
        return
    c = text[at]
    order = np.argsort(c, kind="stable")
    at, c = at[order], c[order]
    cuts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        buckets[int(c[a])].append(at[a:b])


def induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost smaller ones (in their order within each bucket)."""
    large = ~small
    cuts = np.searchsorted(text[leftmost], np.arange(SIGMA + 1), "left")
    left: list[list[np.ndarray]] = [[] for _ in range(SIGMA)]
    for c in range(SIGMA):
        k = 0
        while k < len(left[c]):  # grows by predecessors of the same byte
            _spread(left[c][k], large, text, left)
            k += 1
        _spread(leftmost[cuts[c]:cuts[c + 1]], large, text, left)
    right: list[list[np.ndarray]] = [[] for _ in range(SIGMA)]
    out: list[np.ndarray] = []
    none = np.zeros(0, leftmost.dtype)
    for c in range(SIGMA - 1, -1, -1):
        k = 0
        while k < len(right[c]):
            _spread(right[c][k], small, text, right)
            k += 1
        mine = np.concatenate(left[c]) if left[c] else none
        _spread(mine[::-1], small, text, right)
        if right[c]:
            out.append(np.concatenate(right[c]))
        out.append(mine[::-1])
    out.append(np.array([len(text) - 1], leftmost.dtype))
    return np.concatenate(out)[::-1]


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names."""
    m, step = len(names), 1
    rank = names.astype(np.int64)
    while True:
        key = rank * (m + 1)
        key[:m - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if new.sum() == m - 1 or step >= m:
            return order


class Prefix:
    """Hashes of substrings of one text."""

    def __init__(self, text: np.ndarray):
        rng = np.random.default_rng(7)
        value = rng.integers(0, 2 ** 64, SIGMA, dtype=np.uint64)
        base = int(rng.integers(0, 2 ** 61)) * 8 + 5
        power = np.full(len(text), base, np.uint64)
        power[:1] = 1
        self.down = np.full(len(text) + 1, pow(base, -1, 2 ** 64), np.uint64)
        self.down[0] = 1
        self.down = np.multiply.accumulate(self.down)
        self.sum = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(value[text] * np.multiply.accumulate(power), out=self.sum[1:])

    def __call__(self, a, b):
        return (self.sum[b] - self.sum[a]) * self.down[a]


def suffix_array(text: np.ndarray, prefix: Prefix | None = None) -> np.ndarray:
    """Start of each suffix of ``text`` (values below SIGMA, the unique sentinel 0 last), sorted."""
    small = smaller(text)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = first.astype(np.int32)
    if len(first) == 0:
        first = np.array([len(text) - 1], np.int32)
    prefix = prefix or Prefix(text)
    start = first[np.argsort(text[first], kind="stable")]
    is_first = np.zeros(len(text), bool)
    is_first[first] = True
    order = induce(text, small, start)
    order = order[is_first[order]]
    end = np.empty(len(text), np.int32)
    end[first] = np.concatenate((first[1:] + 1, [len(text)])).astype(np.int32)
    h, size = prefix(order, end[order]), end[order] - order
    new = np.concatenate(([False], (h[1:] != h[:-1]) | (size[1:] != size[:-1])))
    if new.sum() < len(order) - 1:
        name = np.empty(len(text), np.int32)
        name[order] = np.cumsum(new)
        order = first[_by_doubling(name[first])]
    return induce(text, small, order)


def permuted_lcp(text: np.ndarray, order: np.ndarray, prefix: Prefix, stops: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix, by place, with the one before it in ``order``.

    Only irreducible values (and those at ``stops``) are computed, by bisection over
    substring hashes up to ``most``; from one place to the next a value falls by one."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.zeros(n, bool)
    own[0] = True
    own[1:] = (before[1:] <= 0) | (text[:-1] != text[before[1:] - 1])
    own[stops] = True
    at = np.flatnonzero(own)
    ref = before[at]
    low = np.zeros(len(at), np.int64)
    high = np.where(ref >= 0, np.minimum(most, n - np.maximum(at, ref)), 0)
    ref = np.maximum(ref, 0)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = prefix(at, at + mid) == prefix(ref, ref + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[at] = low
    return np.maximum(value[last] - (np.arange(n) - last), 0)


def repeated(parts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each part, whether each of its first ``windows`` strings of ``length`` bytes
    also starts at another such place of the shard."""
    text, begin = shard_text(parts)
    prefix = Prefix(text)
    order = suffix_array(text, prefix)
    common = permuted_lcp(text, order, prefix, begin, max(map(len, parts), default=0) + 1)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common[order] < length)
    counts = np.array(windows, np.int64)
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    many = np.bincount(group[at], minlength=len(text) + 1)[group[at]] > 1
    return np.split(many, np.cumsum(counts)[:-1])
