"""Suffix order, longest common prefixes and longest previous factors of one string of symbols, in NumPy.

Suffixes are sorted by prefix doubling up to `cap` symbols; the ranks of every length 1, 2, 4, ... are kept and give the
common prefix of neighbours by descending through them. A symbol may stand for `unit` places of the string (symbols[i]
names places i to i + unit), so a suffix is read at i, i + unit, i + 2 unit, ...; lengths then count units. The longest previous factor of a position is the longer of its
common prefixes with the nearest smaller positions before and after it in suffix order; those neighbours are found for
all positions at once by pointer jumping.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, cap: int, unit: int = 1) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order of their first `cap` symbols or more, and the ranks for each length 1, 2, 4, ... used."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    levels = [(1, rank)]
    order = None
    h = 1
    while h < cap and h * unit < n and (n and rank.max() + 1 < n):
        second = np.zeros(n, dtype=np.int64)
        second[: -h * unit] = rank[h * unit :] + 1
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key)
        ranked = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = new
        h *= 2
        levels.append((h, rank))
    return np.argsort(rank) if order is None else order, levels


def neighbour_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]], unit: int = 1, floor: int = 0) -> np.ndarray:
    """lcp[r]: symbols that the suffixes at r - 1 and r in suffix order share, as far as the levels tell; lcp[0] is 0.

    Where that is under `floor`, any number under `floor`: if the longest level is no longer, it alone tells.
    """
    n = len(order)
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lcp
    top = levels[-1][0]
    if top <= floor:
        kept = np.flatnonzero(levels[-1][1][order[:-1]] == levels[-1][1][order[1:]])
    else:
        kept = np.arange(n - 1)
    a, b = order[kept], order[kept + 1]
    got = np.zeros(len(kept), dtype=np.int64)
    for h, rank in [levels[-1], *reversed(levels)]:  # the longest twice: what it covers may be matched again behind it
        x, y = a + got * unit, b + got * unit
        inside = (x < n) & (y < n) & ((got < top) if h == top else True)
        same = np.zeros(len(kept), dtype=bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        same &= np.maximum(x, y) + h * unit <= n
        got[same] += h
    lcp[1 + kept] = got
    return lcp


def _nearest_smaller(position: np.ndarray, lcp: np.ndarray, floor: int) -> np.ndarray:
    """For each rank the longest common prefix with the nearest earlier rank of smaller position; 0 if there is none.

    Where that is under `floor`, any number under `floor`: the search ends as soon as the prefix on the way is.
    """
    n = len(position)
    to = np.arange(n) - 1
    least = lcp.copy()
    active = np.flatnonzero((to >= 0) & (lcp >= floor))
    active = active[position[to[active]] > position[active]]
    while len(active):
        via = to[active]
        least[active] = np.minimum(least[active], least[via])
        to[active] = to[via]
        active = active[(to[active] >= 0) & (least[active] >= floor)]
        active = active[position[to[active]] > position[active]]
    least[to < 0] = 0
    least[least < floor] = 0
    return least


def previous_factors(order: np.ndarray, lcp: np.ndarray, later: bool = False, floor: int = 0) -> np.ndarray:
    """For each position the length of its longest match that starts earlier (or, with `later`, later) in the string.

    Lengths under `floor` are given as 0, which saves most of the search.
    """
    n = len(order)
    position = n - 1 - order if later else order
    before = _nearest_smaller(position, lcp, floor)
    turned = np.concatenate([lcp[1:], [0]])[::-1] if n else lcp
    after = _nearest_smaller(position[::-1], turned, floor)[::-1]
    out = np.zeros(n, dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out
