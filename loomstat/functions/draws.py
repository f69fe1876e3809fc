"""Seeded resampling of one chunk of (value, count) pairs.

A sample is held as many chunks. How many draws fall to a chunk is decided on a binary
tree over the chunk numbers: each node splits its draws between its halves, by a
binomial (with replacement) or hypergeometric (without) draw. The generator of a node
depends on the seed, the key and the node only, so every task that walks through a node
sees the same split, and all chunks together are one exact draw from the whole sample.
"""

from __future__ import annotations

import numpy as np

# NumPy's own generator accepts populations below this size
_NUMPY_POPULATION = 10**9
# chunks with at most this many items per value are written out item by item. Both ways follow the same
# law exactly; which one a chunk takes depends on its own counts only
_EXPAND = 8


def generator(*identity: int) -> np.random.Generator:
    return np.random.default_rng([int(i) & 0xFFFFFFFFFFFFFFFF for i in identity])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, k: np.ndarray) -> np.ndarray:
    """Number of good items among k drawn without replacement, per replicate."""
    if good == 0 or bad == 0:
        return np.zeros_like(k) if good == 0 else k
    if good < _NUMPY_POPULATION and bad < _NUMPY_POPULATION:
        return rng.hypergeometric(good, bad, k)
    return _by_coins(rng, good, bad, k)


def _by_coins(rng: np.random.Generator, good: int, bad: int, k: np.ndarray) -> np.ndarray:
    """The same law for populations of any size.

    Every item is taken by an independent coin of chance k / n: two binomial numbers. Whatever number comes
    out, all sets of that size are equally likely. The surplus is then put back, or the shortage
    taken, by the same step on what was taken or left; it shrinks to about its root each time.
    """
    taken = np.zeros(len(k), dtype=np.int64)
    sign = np.ones(len(k), dtype=np.int64)
    good, bad, k = (np.array(np.broadcast_to(x, len(k)), dtype=np.int64) for x in (good, bad, k))
    todo = np.flatnonzero(k)
    while len(todo):
        g, b, n = good[todo], bad[todo], k[todo]
        chance = np.minimum(n / (g.astype(float) + b), 1.0)
        from_good, from_bad = rng.binomial(g, chance), rng.binomial(b, chance)
        taken[todo] += sign[todo] * from_good
        short = n - from_good - from_bad
        over = short < 0
        good[todo] = np.where(over, from_good, g - from_good)
        bad[todo] = np.where(over, from_bad, b - from_bad)
        sign[todo] = np.where(over, -sign[todo], sign[todo])
        k[todo] = np.abs(short)
        todo = todo[short != 0]
    return taken


def draws_of_chunk(
    seed: tuple[int, ...],
    chunk: int,
    part: int,
    left: np.ndarray,
    right: np.ndarray,
    total: int,
    replicates: int,
    replace: bool,
) -> np.ndarray:
    """Draws that fall to the chunk, per replicate; ``left[i], right[i]`` are the weights
    below its ancestor at level i + 1."""
    k = np.full(replicates, total, dtype=np.int64)
    for level in range(len(left) - 1, -1, -1):
        rng = generator(*seed, 1, level, chunk >> (level + 1), part)
        low, high = int(left[level]), int(right[level])
        to_left = rng.binomial(k, low / (low + high)) if replace else hypergeometric(rng, low, high, k)
        k = k - to_left if (chunk >> level) & 1 else to_left
    return k


def _sums_with(rng: np.random.Generator, items: np.ndarray, k: np.ndarray) -> np.ndarray:
    """k[r] items drawn with replacement and added up, for a few replicates r."""
    return np.array([items[rng.integers(0, len(items), n)].sum() for n in k])


def _sums_without(rng: np.random.Generator, items: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sums of subsets of exactly k[r] items, for a few replicates r.

    Items are kept by independent coins; all subsets of the size that comes out are then
    equally likely, and random items are added or removed until the size is right.
    """
    kept = rng.random((len(k), len(items)), dtype=np.float32) < (k / len(items))[:, None]
    short = k - kept.sum(axis=1)
    for r in np.flatnonzero(short):
        pool = np.flatnonzero(kept[r] != (short[r] > 0))
        kept[r, rng.choice(pool, abs(int(short[r])), replace=False, shuffle=False)] = short[r] > 0
    return kept @ items


def sums_of_chunk(
    rng: np.random.Generator, values: np.ndarray, counts: np.ndarray, k: np.ndarray, replace: bool
) -> np.ndarray:
    """Sum of k items drawn from the chunk, per replicate."""
    if len(values) == 1:
        return values[0] * k
    weight = int(counts.sum())
    if weight <= _EXPAND * len(values):
        items, draw = np.repeat(values, counts), _sums_with if replace else _sums_without
        # a few replicates at a time stay in the processor's cache
        return np.concatenate([draw(rng, items, part) for part in np.array_split(k, max(1, len(k) // 10))])
    if replace:
        return rng.multinomial(k, counts / weight) @ values
    sums, rest = np.zeros(len(k)), weight
    for value, count in zip(values, counts):
        rest -= int(count)
        taken = hypergeometric(rng, int(count), rest, k)
        sums += value * taken
        k = k - taken
    return sums
