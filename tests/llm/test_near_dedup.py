import random

import pytest

from retailspark.llm import near_dedup
from retailspark.llm.components import components


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Component and set size of every document, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(draw, base, copies, changes):
    for _ in range(copies):
        words = list(base)
        for _ in range(draw.randint(*changes)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
        yield " ".join(words)


def corpus(seed):
    draw = random.Random(seed)
    texts = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(draw.choice([8, 40, 120, 300]))]
        texts += family(draw, base, draw.randint(1, 8), (0, 5))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"o{k}y{i}" for i in range(80)) for k in range(20)]
    texts += ["One two", "one TWO", "a b c d e", "A b c\nd  e", None, "", " ", "z " * 20_000, "z " * 15_000]
    draw.shuffle(texts)
    return [(i * 2 + 5, t) for i, t in enumerate(texts)]


def test_components_equal_brute_force(make_docs, with_clashes):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(near_dedup.near_groups(with_clashes(make_docs(rows)).repartition(4))) == brute(rows)


def test_large_family_in_small_blocks(make_docs):
    """A family with similarities on both sides of the limit, over many blocks."""
    draw = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, t) for i, t in enumerate(family(draw, base, 160, (0, 4)))]
    want = brute(rows)
    assert len({r[2] for r in want}) > 3
    for block in (7, 40):
        assert found(near_dedup.near_groups(make_docs(rows), block_docs=block)) == want


def test_chain_of_links_is_one_component(make_docs):
    words = [f"c{i}" for i in range(200)]
    rows = []
    for k in range(25):
        rows.append((100 - k, " ".join(words[k * 4:] + [f"t{i}" for i in range(k * 4)])))
    assert found(near_dedup.near_groups(make_docs(rows))) == brute(rows)


def test_null_repeated_and_empty(make_docs):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = found(near_dedup.near_groups(make_docs(rows)))
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert near_dedup.near_groups(make_docs([])).count() == 0


def test_keep_near_first(make_docs, with_clashes):
    rows = corpus(3)
    docs = with_clashes(make_docs(rows))
    kept = near_dedup.keep_near_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(rows) if r[3]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connected_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [
        (300, i) for i in range(301, 400)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {n: root(n) for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_signature_agreement_follows_similarity():
    import numpy as np

    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
    rates = []
    for k in range(20):
        common, own = pool[k * 100:k * 100 + 170], draw.integers(0, 1 << 63, 30, dtype=np.uint64)
        a, b = np.unique(np.append(common, own[:15])), np.unique(np.append(common, own[15:]))
        one, two = near_dedup.signatures([a, b])
        rates.append((one == two).mean())
    assert min(rates) >= near_dedup.MATCHES / near_dedup.COORDINATES
    assert abs(sum(rates) / 20 - (170 / 200) ** near_dedup.DEPTH) < 0.06


