"""Random counts of any size from seeded generators."""

from __future__ import annotations

import math

import numpy as np

#: Beyond so many spreads from the mode the chance is below what a double can add.
SPREADS = 12.0



def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Good items among ``taken`` of ``good + bad``, by inversion around the mode.

    Only ratios of neighbouring chances are used, so counts may have any size; time and memory grow
    with the spread of the draw.
    """
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    total = good + bad
    mode = min(max(((taken + 1) * (good + 1)) // (total + 2), low), high)
    spread = math.sqrt(taken * (good / total) * (bad / total) * ((total - taken) / max(total - 1, 1))) + 1
    first, last = max(low, mode - int(SPREADS * spread) - 10), min(high, mode + int(SPREADS * spread) + 10)
    k = np.arange(first, last, dtype=float)
    steps = np.log((good - k) * (taken - k)) - np.log((k + 1) * (bad - taken + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.exp(logs - logs.max())
    sums = np.cumsum(chances)
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, last - first))


def multinomial(rng: np.random.Generator, n: int, shares: np.ndarray) -> np.ndarray:
    """Counts of ``n`` draws with these chances."""
    return rng.multinomial(n, shares / shares.sum())


def multivariate_hypergeometric(rng: np.random.Generator, counts: np.ndarray, taken: int) -> np.ndarray:
    """Items of each kind among ``taken`` of all, one kind after the other."""
    rest, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if not taken:
            break
        out[i] = hypergeometric(rng, n, rest - n, taken)
        rest, taken = rest - n, taken - int(out[i])
    return out
