"""NumPy helper of :mod:`loomstat.operators.substring`: common prefixes of two strings' suffixes."""

from __future__ import annotations

import numpy as np


def _points(text: str) -> np.ndarray:
    """Code points, from 2 on; 0 and 1 end strings."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 2


def _levels(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """``levels[k][i]``: the rank of the 2**k symbols from i on, up to ``longest`` symbols or until all differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1]
    levels = [rank]
    width = 1
    while width < longest and rank.max() < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
        width *= 2
    return levels


def _shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``; 0 where either is negative."""
    n = len(levels[0])
    there = (a >= 0) & (b >= 0)
    a, b = np.where(there, a, 0), np.where(there, b, 0)
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = there & (x < n) & (y < n)
        equal = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        length += equal * (1 << k)
    return length


def longest_matches(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """For each pair and each start in its first string, the longest length there that the second contains.

    All pairs are sorted as one sequence of suffixes by doubling. A suffix of a first string shares most with the
    next suffix of the second string before or after it. The work is n log n per doubling and the memory some
    hundred bytes a symbol.
    """
    if not pairs:
        return []
    points = [(_points(a), _points(b)) for a, b in pairs]
    longest = max(max(len(a), len(b)) for a, b in points) + 1
    # symbols of different pairs differ, and so do the ends of first and second strings
    wide = 1 << 21
    symbols = np.concatenate([np.concatenate((a, [0], b, [1])) + k * wide for k, (a, b) in enumerate(points)])
    second = np.concatenate([np.repeat([False, True], (len(a) + 1, len(b) + 1)) for a, b in points])
    levels = _levels(symbols, longest)
    order = np.argsort(levels[-1], kind="stable")
    places = np.arange(len(order))
    other = second[order]
    before = np.maximum.accumulate(np.where(other, places, -1))
    after = np.minimum.accumulate(np.where(other, places, len(order))[::-1])[::-1]
    below = np.where(before >= 0, order[before], -1)
    above = np.where(after < len(order), order[np.minimum(after, len(order) - 1)], -1)
    found = np.zeros(len(order), np.int64)
    mine = np.flatnonzero(~other)
    starts = order[mine]
    found[starts] = np.maximum(_shared(levels, starts, below[mine]), _shared(levels, starts, above[mine]))
    out, at = [], 0
    for a, b in points:
        out.append(found[at : at + len(a)])
        at += len(a) + len(b) + 2
    return out
