import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.llm import context_tree, lm_score


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def learned(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


class Weighting:
    """Context-tree weighting by recursion over dictionaries, for small texts."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for text in texts:
            for at, byte in enumerate(text):
                past = bytes(reversed(bytes(depth) + text[:at]))[:depth]
                node = 1
                for bit in f"{byte:08b}":
                    for d in range(depth + 1):
                        self.counts.setdefault((past[:d], node), [0, 0])[int(bit)] += 1
                    node = node * 2 + int(bit)
        self.below = {}
        for (context, node), _ in self.counts.items():
            if context:
                self.below.setdefault((context[:-1], node), []).append(context)

    def own(self, context, node):
        a, b = self.counts[context, node]
        g = math.lgamma
        return g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1)

    def weight(self, context, node):
        if len(context) == self.depth:
            return self.own(context, node)
        longer = sum(self.weight(c, node) for c in self.below[context, node])
        return np.logaddexp(self.own(context, node), longer) + math.log(0.5)

    def chance(self, past, node, bit):
        seen = [d for d in range(self.depth + 1) if (past[:d], node) in self.counts]
        p = 0.5
        for d in reversed(seen):
            a, b = self.counts[past[:d], node]
            own = ((b if bit else a) + 0.5) / (a + b + 1)
            if d == seen[-1]:
                p = own
            else:
                longer = sum(self.weight(c, node) for c in self.below[past[:d], node])
                share = 1 / (1 + math.exp(min(longer - self.own(past[:d], node), 700)))
                p = share * own + (1 - share) * p
        return p

    def score(self, text):
        total = 0.0
        for at, byte in enumerate(text):
            past = bytes(reversed(bytes(self.depth) + text[:at]))[:self.depth]
            node = 1
            for bit in f"{byte:08b}":
                total += math.log10(self.chance(past, node, int(bit)))
                node = node * 2 + int(bit)
        return total


ROWS = [(i, t) for i, t in enumerate([
    "The cat sat on the mat.", "the dog sat", None, "", "  ", "A cat\nand a dog", "mat mat mat mat", "éü cat", "zebra quilts", "the",
    "The cat sat on the mat. " * 3, "dog", "sat on", "cat", "unseen words here", "x" * 60,
])]


def test_equals_recursive_weighting_and_counted_words(make_docs, with_clashes):
    docs = with_clashes(make_docs(ROWS)).repartition(3)
    got = {r.doc_id: r for r in lm_score.score_texts(docs, lm_score.in_training(F.col("doc_id"))).collect()}
    train = [lower(t) for i, t in ROWS if learned(i)]
    model = Weighting([t + b"\0" for t in train], lm_score.DEPTH)
    words = Counter(w for t in train for w in t.split()) + Counter({"end": len(train)})
    n, v = sum(words.values()), len(words)
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        tokens = [*lower(t).split(), "end"]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(model.score(lower(t) + b"\0"), rel=1e-5)


def test_predictions_sum_to_one():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"ab cde\0", np.uint8), 3000)
    grams, counts = np.unique(context_tree.byte_grams(data, np.array([0, 1000, 3000]), 5), return_counts=True)
    tree = context_tree.Subtrees(grams, counts.astype(np.int64), 5, 0)
    for context in (*grams[:40] >> np.uint64(8), np.uint64(12345)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.log10(every, None)).sum() == pytest.approx(1)


def test_subtrees_and_top_equal_the_whole_tree():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"abcdefgh \0", np.uint8), 20_000)
    grams, counts = np.unique(context_tree.byte_grams(data, np.array([0, 20_000]), 5), return_counts=True)
    whole = context_tree.Subtrees(grams, counts.astype(np.int64), 5, 0)
    part = context_tree.Subtrees(grams, counts.astype(np.int64), 5, 2)
    keys, zeros, ones, weight = part.roots()
    parents, at = np.unique((keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
    top = context_tree.Top(parents, *(np.bincount(at, weights=c).astype(np.int64) for c in (zeros, ones)), np.bincount(at, weights=weight), 2)
    assert np.allclose(whole.log10(grams, None), part.log10(grams, top))


def test_logs_of_large_counts():
    n = np.array([0, 1, 5, 70_000, 10**9])
    want = [math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n.tolist()]
    assert np.allclose(context_tree.log_factorials(n), want) and np.allclose(
        context_tree.log_total(n), [math.lgamma(x + 1) for x in n.tolist()])


def test_many_chunks_and_edges(make_docs, monkeypatch):
    rows = ROWS + [(None, "the cat"), (3, "the cat"), (50, "long " * 30_000)]
    one = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score_texts(make_docs(rows), lm_score.in_training(F.col("doc_id"))).collect()}
    monkeypatch.setattr(lm_score, "CHUNK", 300)
    many = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score_texts(make_docs(rows), lm_score.in_training(F.col("doc_id"))).collect()}
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, rel=1e-5) for k, v in one.items())
    nothing = lm_score.score_texts(make_docs([(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {round(r.score / math.log10(2)) for r in nothing} == {-24, -8} and all(r.n_known == 0 for r in nothing)
    assert lm_score.score_texts(make_docs([]), lm_score.in_training(F.col("doc_id"))).count() == 0
