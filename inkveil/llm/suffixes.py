"""Suffix order by a difference cover, in numpy: names of sampled triples, recursion on the names, merging of the rest.

Positions that aren't multiples of three are sampled. Their triples are sorted and named; if names repeat, the
string of names is sorted by the same method. The other suffixes are sorted by their first symbol and the rank of
the sampled suffix that follows, and merged: a suffix of either kind is compared with one of the other by one or
two symbols and the ranks of sampled suffixes behind them, in one binary search for all.

Defined cases: an empty string has an empty order; symbols are from 1 on; strings of MOST symbols and more are refused.
"""

from __future__ import annotations

import numpy as np

#: Symbols, names and ranks of shorter strings fit 21 bits, so that three of them make one 64-bit key.
MOST = (1 << 21) - 4
_B = np.uint64(21)


def _keys(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = out << _B | p.astype(np.uint64)
    return out


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of t, smallest suffix first; a suffix is smaller than those that it begins."""
    n = len(t)
    if n >= MOST:
        raise ValueError(f"{n} symbols, {MOST} are too many")
    if n < 2:
        return np.arange(n)
    s = np.zeros(n + 3, np.int64)
    s[:n] = t
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    _, names = np.unique(_keys(s[sampled], s[sampled + 1], s[sampled + 2]), return_inverse=True)
    if len(sampled) and names.max() + 1 < len(sampled):
        order = suffix_order(names + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    by_rank = sampled[order]
    by_rank = by_rank[by_rank < n]
    rest = np.arange(0, n, 3)
    near = _keys(s[rest], rank[rest + 1])
    by = np.argsort(near, kind="stable")
    rest, near = rest[by], near[by]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(_keys(s[ones], rank[ones + 1]), near)
    before += np.searchsorted(_keys(s[twos], s[twos + 1], rank[twos + 2]), _keys(s[rest], s[rest + 1], rank[rest + 2]))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = by_rank
    return out
