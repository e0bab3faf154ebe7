import math
import random

import pytest
from pyspark.sql import functions as F

from retailspark.llm import topk


def brute(rows, k):
    whole = {}
    for i, v in sorted(rows, key=lambda r: (str(r[0]), [math.floor(1024 * x) if x is not None and math.isfinite(x) else 0 for x in r[1] or []])):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q, (mine, *_) in whole.items():
        if q % 3:
            continue
        scores = [(-sum(a * b for a, b in zip(mine, v)), i) for i, vs in whole.items() if i != q for v in vs if len(v) == len(mine)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, rows, k, vector="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {vector}")
    return sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 3 = 0"), k).collect())


def cloud(seed, n, dim, spread):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c, size = draw.choice(centers), math.exp(draw.gauss(0, spread))
        rows.append((i, [size * (x + draw.gauss(0, 0.15)) for x in c]))
    return rows


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equals_brute_force(spark, monkeypatch, spread):
    """Small buckets, so that length and coordinate pruning both happen."""
    monkeypatch.setattr(topk, "BUCKET_VALUES", 128)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    monkeypatch.setattr(topk, "SLICE_BLOCKS", 2)
    monkeypatch.setattr(topk, "HEAD_ROWS", 8)
    rows = cloud(3, 220, 8, spread)
    assert found(spark, rows, 5) == brute(rows, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (3, [0.0, 0.0]), (6, None), (9, [nan, 1.0]), (12, [1.0, None]), (15, [inf, 0.0]), (1, [1.0, 2.0]),
            (2, [1.0, 2.0]), (4, [-1.0, 0.5]), (18, [1.0]), (5, [2.0]), (21, []), (7, []), (2, [1.0, 2.0]), (24, [0.0004, -0.0004])]
    assert found(spark, rows, 3) == brute(rows, 3)
    assert found(spark, [], 3) == []


def test_null_and_repeated_ids(spark, with_clashes):
    """Rows without id take no part; of queries that share an id, the smallest vector is asked."""
    rows = [(None, [9.0, 9.0]), (None, None), (3, [2.0, 1.0]), (3, [1.0, 5.0]), (3, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (6, [3.0, 3.0])]
    for given in (rows, rows[::-1]):
        assert found(spark, given, 4) == brute(given, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clashing = df.withColumns({n: F.lit("other") for n in ("whole", "dim", "norm", "range", "row", "block", "part", "slice", "score", "rank")})
    assert sorted(tuple(r) for r in topk.top_k(clashing, clashing.where("vec_id % 3 = 0"), 4).collect()) == brute(rows, 4)


def test_products_beyond_doubles_are_exact(spark):
    rows = [(i, [float(1 << 20) + i, 1.5 + i, -float(1 << 19) + i * 0.001]) for i in range(12)]
    assert found(spark, rows, 4) == brute(rows, 4)


def test_pruning_keeps_every_result():
    import numpy as np

    draw = np.random.default_rng(5)
    pruned = 0
    for _ in range(200):
        rows = np.floor(1024 * draw.normal(size=(60, 6)) * np.exp(draw.normal(size=(60, 1))))
        rows = rows[np.argsort(-np.linalg.norm(rows, axis=1))]
        query = np.floor(rows[draw.integers(60)] * 0.9 + draw.normal(size=6) * 40)
        scores = rows @ query
        floor = float(np.sort(scores)[-draw.integers(1, 12)])
        places = topk.candidates_of(query, float(np.linalg.norm(query)), floor, rows, np.linalg.norm(rows, axis=1))
        assert set(np.flatnonzero(scores >= floor)) <= set(places.tolist())
        pruned += len(places) < 60
    assert pruned > 100
