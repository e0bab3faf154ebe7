"""Context-tree weighting over bytes: counts, weights and predictions as numpy arrays.

A byte is eight binary decisions; each is made at a node named by the bits decided so far. In a context of
``d`` preceding bytes, a node's Krichevsky-Trofimov estimate is (n + 1/2) / (total + 1). A context of less than full depth
weighs half its own estimate and half the product of the contexts one byte longer; conditioned on
the training text, its prediction mixes the two in proportion to how likely each made that text.

A gram packs a context and the byte after it in 64 bits: the nearest byte first, the farthest before
the symbol. So all contexts that share their nearest bytes are neighbours, and a subtree of the context tree
can be handled alone once all its grams are together.
"""

from __future__ import annotations

import numpy as np

from retailspark.llm.arrays import U64

BITS = 8
HALF_LOG = np.log(0.5)


def log_factorials(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) - log Gamma(1/2) for whole numbers n."""
    small = int(min(n.max(initial=0), 1 << 16))
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(small) + 0.5))])
    x = n.astype(float) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return np.where(n <= small, table[np.minimum(n, small)], series)


def log_total(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1) for whole numbers n."""
    small = int(min(n.max(initial=0), 1 << 16))
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, small + 1)))])
    x = n.astype(float) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= small, table[np.minimum(n, small)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_factorials(zeros) + log_factorials(ones) - log_total(zeros + ones)


def byte_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The gram of every byte; places before the start of a row read as 0."""
    grams = data.astype(U64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, depth + 1):
        before = np.zeros(len(data), U64)
        before[k:] = data[:-k]
        before[place < k] = 0
        grams |= before << U64(8 * (depth + 1 - k))
    return grams


def symbol_node(symbols: np.ndarray, level: int) -> np.ndarray:
    return (U64(1) << U64(level)) | (symbols >> U64(BITS - level))


class Level:
    """Nodes of one depth and bit level: keys, counts of both bits, and the log weight of what lies below."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.own = log_kt(zeros, ones)
        self.below: np.ndarray | None = None

    def weigh(self, longer: "Level | None") -> None:
        """Sum the longer contexts' weights into this depth; without longer ones a node stands for itself."""
        if longer is None:
            self.weight = self.own
        else:
            parents = (longer.keys >> U64(16) << U64(8)) | (longer.keys & U64(255))
            at = np.searchsorted(self.keys, parents)
            self.below = np.bincount(at, weights=longer.weight, minlength=len(self.keys))
            self.weight = np.logaddexp(self.own, self.below) + HALF_LOG

    def chance(self, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each (context, node): whether it was seen, its own estimate of the bit, and its share in the mix."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.full(len(keys), 0.5), np.ones(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seen = self.keys[at] == keys
        count = np.where(bits == 1, self.ones[at], self.zeros[at])
        own = (count + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        if self.below is None:
            return seen, own, np.ones(len(keys))
        share = 1 / (1 + np.exp(np.clip(self.below[at] - self.own[at], -700, 700)))
        return seen, own, share


def levels_of(contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The eight bit levels of one depth, from the counts of symbols in contexts."""
    keys = contexts << U64(8) | symbols
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    contexts, symbols = keys[starts] >> U64(8), keys[starts] & U64(255)
    levels = []
    for level in range(BITS):
        nodes = contexts << U64(8) | symbol_node(symbols, level)
        first = np.flatnonzero(np.diff(nodes, prepend=~nodes[:1]) != 0) if len(nodes) else np.zeros(0, np.int64)
        one = (symbols >> U64(BITS - 1 - level)) & U64(1) == 1
        ones = np.add.reduceat(np.where(one, sums, 0), first) if len(first) else sums
        every = np.add.reduceat(sums, first) if len(first) else sums
        levels.append(Level(nodes[first], every - ones, ones))
    return levels


class Subtrees:
    """Depths ``least`` to ``depth`` of the subtrees whose grams are given, all of them."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, least: int):
        self.depth, self.least = depth, least
        learned = counts > 0
        grams, counts = grams[learned], counts[learned]
        self.depths: dict[int, list[Level]] = {}
        for d in range(depth, least - 1, -1):
            self.depths[d] = levels_of(grams >> U64(8 * (depth + 1 - d)), grams & U64(255), counts)
            for level in range(BITS):
                self.depths[d][level].weigh(self.depths[d + 1][level] if d < depth else None)

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, counts of both bits and log weight of every node of the least depth."""
        levels = self.depths[self.least]
        return tuple(
            np.concatenate([getattr(level, name) for level in levels]) for name in ("keys", "zeros", "ones", "weight")
        )

    def log10(self, grams: np.ndarray, top: "Top | None") -> np.ndarray:
        """Log10 chance of the last byte of each gram."""
        symbols = grams & U64(255)
        total = np.zeros(len(grams))
        for level in range(BITS):
            node, bits = symbol_node(symbols, level), (symbols >> U64(BITS - 1 - level)) & U64(1)
            p = np.full(len(grams), 0.5)
            reached = np.zeros(len(grams), bool)
            for d in range(self.depth, -1, -1):
                if d < self.least and top is None:
                    break
                source = self.depths[d][level] if d >= self.least else top.levels[d][level]
                keys = (grams >> U64(8 * (self.depth + 1 - d)) if d else np.zeros(len(grams), U64)) << U64(8) | node
                seen, own, share = source.chance(keys, bits)
                # A context never seen in training says nothing: the mix starts at the longest one seen.
                p = np.where(seen, np.where(reached, share * own + (1 - share) * p, own), p)
                reached |= seen
            total += np.log10(p)
        return total


class Top:
    """Depths below ``least``, from the sums over all subtrees; at most 256 ** (least - 1) contexts."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, least: int):
        """``keys``: nodes of depth ``least - 1``, each with its counts and the summed weights of its longer contexts."""
        self.levels: dict[int, list[Level]] = {}
        node = keys & U64(255)
        for d in range(least - 1, -1, -1):
            self.levels[d] = []
            for level in range(BITS):
                if d == least - 1:
                    mine = (node >> U64(level)) == 1
                    order = np.argsort(keys[mine], kind="stable")
                    made = Level(keys[mine][order], zeros[mine][order], ones[mine][order])
                    made.below = below[mine][order]
                    made.weight = np.logaddexp(made.own, made.below) + HALF_LOG
                else:
                    longer = self.levels[d + 1][level]
                    parents = (longer.keys >> U64(16) << U64(8)) | (longer.keys & U64(255))
                    kept, at = np.unique(parents, return_inverse=True)
                    made = Level(kept, *(np.bincount(at, weights=c, minlength=len(kept)).astype(np.int64) for c in (longer.zeros, longer.ones)))
                    made.weigh(longer)
                self.levels[d].append(made)
