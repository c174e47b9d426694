"""How alike two texts are, by the longest blocks that they have in common; many pairs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of pairs that are compared at once: a bound of the memory, but for one longer pair.
TOGETHER = 1 << 18


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _dense(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of the values, from 0, equal ones for equal values."""
    order = np.argsort(x)
    y = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], y[1:] != y[:-1])))[: len(x)]
    return out


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns get equal numbers from 0; no two different ones do."""
    out = _dense(columns[0])
    for c in columns[1:]:
        c = _dense(c)
        out = _dense(out * (int(c.max(initial=0)) + 1) + c)
    return out


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, as many as its count, and which start they belong to."""
    of = np.repeat(np.arange(len(start)), count)
    return start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


class _Ranks:
    """Numbers of all substrings whose length is a power of two, by doubling; from two of them, which overlap, those of any length."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.rows = [_numbered(codes)]
        while 2 << len(self.rows) - 1 <= longest:
            r, half = self.rows[-1], 1 << len(self.rows) - 1
            both = np.zeros(len(codes), np.int64)  # substrings that go beyond the end are never asked for
            both[: len(r) - half] = _dense(r[: len(r) - half] * (int(r.max(initial=0)) + 1) + r[half:])
            self.rows.append(both)
        self.table = np.stack(self.rows)
        self.bits = int(self.table.max(initial=0)).bit_length()

    def of(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = np.frexp(length.astype(float))[1] - 1
        return self.table[power, at], self.table[power, at + length - (1 << power)]


def _keys(ranks: _Ranks, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """The substrings of each segment's length that begin in its two windows: number, place and segment, of a and of b."""
    (at, of), (bt, bof) = (_spread(w[:, 0], np.maximum(w[:, 1] - w[:, 0] - length + 1, 0)) for w in (a, b))
    place, segment = np.concatenate((at, bt)), np.concatenate((of, bof))
    first, second = ranks.of(place, length[segment])
    bits = ranks.bits
    if len(a).bit_length() + 2 * bits < 64:  # all three fit into one number
        key = (segment << 2 * bits) | (first.astype(np.int64) << bits) | second
    else:
        key = _numbered(segment, first, second)
    return key[: len(at)], at, of, key[len(at) :], bt, bof


def _among(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    if not len(others):
        return np.zeros(len(x), bool)
    others = np.sort(others)
    return others[np.minimum(np.searchsorted(others, x), len(others) - 1)] == x


def _longest(ranks: _Ranks, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows (start, end) of pairs: the length of the longest common substring, its first place in a, and there in b."""
    low, high = np.zeros(len(a), int), np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0])
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        key, _, of, other, _, _ = _keys(ranks, a[open_], b[open_], middle)
        common = np.zeros(len(open_), bool)
        common[of[_among(key, other)]] = True
        low[open_], high[open_] = np.where(common, middle, low[open_]), np.where(common, high[open_], middle - 1)
    i, j = np.full(len(a), np.iinfo(int).max), np.full(len(a), np.iinfo(int).max)
    some = np.flatnonzero(low)
    if some.size:
        key, at, of, other, bt, bof = _keys(ranks, a[some], b[some], low[some])
        shared = _among(key, other)
        first = np.full(len(some), np.iinfo(int).max)
        np.minimum.at(first, of[shared], at[shared])
        chosen = np.zeros(len(some), int)
        here = at == first[of]
        chosen[of[here]] = key[here]
        second, there = np.full(len(some), np.iinfo(int).max), other == chosen[bof]
        np.minimum.at(second, bof[there], bt[there])
        i[some], j[some] = first, second
    return low, i, j


def matched_shares(pairs: list[tuple[str, str]], least: float = 0.0) -> np.ndarray:
    """Twice the characters in matching blocks over all characters, for each pair; 0 where it turns out that ``least`` can't be reached.

    The longest common substring (of equally long ones the first in a, then in b) is a block; what lies before it and behind it is
    matched in the same way. All open windows of all pairs are searched together: by halving on the length of the block, with
    substrings told apart by exact numbers.
    """
    texts = [(_codes(a), _codes(b)) for a, b in pairs]
    sizes = np.array([(len(a), len(b)) for a, b in texts], int).reshape(-1, 2)
    total, matched = sizes.sum(1), np.zeros(len(pairs), int)
    codes = np.concatenate([np.empty(0, np.uint32), *[x for t in texts for x in t]])
    ends = np.cumsum(sizes.ravel()).reshape(-1, 2)
    windows = np.column_stack((ends - sizes, ends))[:, [0, 2, 1, 3]]  # of a, then of b
    pair = np.flatnonzero(sizes.min(1) > 0) if len(pairs) else np.empty(0, int)
    if len(pair):
        ranks = _Ranks(codes, int(sizes.min(1).max()))
    windows, gone = windows[pair], np.zeros(len(pairs), bool)
    while len(pair):
        may = matched.copy()
        np.add.at(may, pair, np.minimum(windows[:, 1] - windows[:, 0], windows[:, 3] - windows[:, 2]))
        gone |= 2 * may < least * total - 1e-9
        windows, pair = windows[~gone[pair]], pair[~gone[pair]]
        length, i, j = _longest(ranks, windows[:, :2], windows[:, 2:])
        np.add.at(matched, pair, length)
        hit = length > 0
        w, m, i, j, p = windows[hit], length[hit], i[hit], j[hit], pair[hit]
        windows = np.concatenate((np.column_stack((w[:, 0], i, w[:, 2], j)), np.column_stack((i + m, w[:, 1], j + m, w[:, 3]))))
        pair = np.concatenate((p, p))
        some = (windows[:, 0] < windows[:, 1]) & (windows[:, 2] < windows[:, 3])
        windows, pair = windows[some], pair[some]
    return np.where(gone, 0.0, np.where(total > 0, 2 * matched / np.maximum(total, 1), 1.0))


def _runs(text: str, size: int) -> np.ndarray:
    """Numbers of a text's runs of ``size`` characters; a run's second and further places have numbers of their own."""
    codes = _codes(text).astype(np.uint64)
    h = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)] + np.uint64(1)
    h.sort()
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, int)
    h += (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)


def may_match(left: list[str], right: list[str], least: float, size: int = 6, step: int = 4096) -> np.ndarray:
    """Which texts of two lists may have a matched share of ``least``; False only where it is sure that they haven't.

    With M matched characters of n and m, at most n - M + (size - 1) (n + m - 2 M) of a text's runs lie in no block and may be missing
    from the other text. Runs are marked in a bit map, ``step`` bits of it at a time; as runs may share a bit, a miss is never too many.
    """
    texts = [*left, *right]
    n = np.array([len(t) for t in texts], int)
    bits = 1 << max(int(8 * n.max(initial=1)).bit_length(), 12)
    at = [np.unique(_runs(t, size) & np.uint64(bits - 1)).astype(int) for t in texts]
    row, at, held = np.repeat(np.arange(len(texts)), [len(x) for x in at]), np.concatenate([np.empty(0, int), *at]), np.array([len(x) for x in at])
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, bits, step):
        lo, hi = np.searchsorted(at, (start, start + step))
        marks = np.zeros((len(texts), step), np.float32)
        marks[row[lo:hi], at[lo:hi] - start] = 1
        both += marks[: len(left)] @ marks[len(left) :].T
    a, b = n[: len(left), None], n[None, len(left) :]
    matched = np.ceil(least * (a + b) / 2 - 1e-9)
    lost = (size - 1) * (a + b - 2 * matched)
    return (matched <= np.minimum(a, b)) & (held[: len(left), None] - both <= a - matched + lost) & (held[None, len(left) :] - both <= b - matched + lost)


def may_share(texts: list[str], left: np.ndarray, right: np.ndarray, least: float, open_: np.ndarray, size: int = 3) -> np.ndarray:
    """Which open pairs of two lists of texts' places may have a matched share of ``least``, by their lengths and by how often they have each of
    ``size`` characters; as ``may_match`` in what is sure, and cheaper. The runs are counted in bins: two that share one can only hide that
    one is missing. A text is counted once, and only if it has an open pair."""
    n = np.array([len(t) for t in texts], int)
    a, b = n[left][:, None], n[right]
    matched = np.ceil(least * (a + b) / 2 - 1e-9)
    open_ = open_ & (matched <= np.minimum(a, b))
    lost = (size - 1) * (a + b - 2 * matched) - matched
    used = np.unique(np.concatenate((left[open_.any(1)], right[open_.any(0)])))
    place = np.zeros(len(texts), int)
    place[used] = np.arange(len(used))
    bins = 1 << min(max(int(n[used].max(initial=1) // 2).bit_length(), 8), 15)
    counts = np.zeros((len(used), bins), np.int32)
    for row, k in zip(counts, used):
        codes, h = _codes(texts[k]), np.zeros(max(n[k] - size + 1, 0), np.uint32)
        for c in range(size):
            h = h * np.uint32(0x01000193) + codes[c : c + len(h)]
        row += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(33 - bins.bit_length()), minlength=bins)
    out = np.zeros(open_.shape, bool)
    for i in np.flatnonzero(open_.any(1)):
        at = np.flatnonzero(open_[i])
        apart = counts[place[right[at]]] - counts[place[left[i]]]
        more = np.maximum(apart, 0).sum(1)
        out[i, at] = (more - apart.sum(1) <= n[left[i]] + lost[i, at]) & (more <= n[right[at]] + lost[i, at])
    return out


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """The share as a column, 0 where it can't reach ``least``; null counts as empty, two empty texts are equal. Python is asked only
    where the lengths leave it open."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs, out, held, size = [(p or "", q or "") for p, q in zip(x, y)], [], [], 0
        for pair in pairs:
            held.append(pair)
            size += len(pair[0]) + len(pair[1])
            if size >= TOGETHER:
                out.append(matched_shares(held, least))
                held, size = [], 0
        out.append(matched_shares(held, least))
        return pd.Series(np.concatenate(out), dtype=float)

    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    n, m = F.length(x), F.length(y)
    possible = 2 * F.least(n, m) >= least * (n + m)
    return F.when(x == y, F.lit(1.0)).when(~possible, F.lit(0.0)).otherwise(ratio(F.when(possible & (x != y), x), F.when(possible & (x != y), y)))
