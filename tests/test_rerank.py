"""The re-ranking fold against the policy written out row by row."""

import hashlib
import random

from pyspark.sql import functions as F

from retailspark.operators import rerank


def draw(seed, user, slot):
    return int(hashlib.md5(f"{seed}:{user}:{slot}".encode()).hexdigest()[:15], 16) / 16**15


def guard(rows, n):
    waiting, chosen = list(rows), []
    while waiting and len(chosen) < n:
        tail = [r["category"] for r in chosen[-2:]]
        full = tail[0] if len(tail) == 2 and tail[0] == tail[1] else None
        chosen.append(waiting.pop(next((i for i, r in enumerate(waiting) if r["category"] != full), 0)))
    return chosen


def policy(user, rows, n, requested, epsilon, seed):
    rows = sorted(rows, key=lambda r: (-r["score"], -r["popularity"], r["id"]))
    size = min(n, len(rows))
    share = max(1, round(size * 0.2))
    slots = 0 if size <= 2 else min(max(0, share if requested is None else requested), 2, size)
    main = guard(rows, size - slots)
    rest = [r for r in rows if r not in main]
    used, picks = [r["category"] for r in main], []
    for slot in range(slots):
        if not rest:
            break
        if draw(seed, user, slot) < epsilon:
            new = [r for r in rest if r["new"]]
            pick = new[0] if new else min(rest, key=lambda r: used.count(r["category"]))
            picks.append({**pick, "reason": "new_item_boost" if new else "mab_exploration", "explores": True})
        else:
            pick = rest[0]
            picks.append(pick)
        rest.remove(pick)
        used.append(pick["category"])
    places = {min(max(size // 3, 1), size - 1)} if len(picks) == 1 else {min(max(size // 3, 1), size - 1), min(max(size * 2 // 3, 2), size - 1)}
    merged, left, extra = [], list(main), list(picks)
    for at in range(size):
        if extra and (at in places or not left):
            merged.append(extra.pop(0))
        elif left:
            merged.append(left.pop(0))
    return [(r["id"], r["reason"], r["explores"]) for r in guard(merged, size)]


def users(seed, count):
    pick, out = random.Random(seed), {}
    for u in range(count):
        n = pick.choice([1, 2, 3, 5, 12, 40])
        out[f"u{u}"] = [
            {"id": f"{i:04d}", "score": pick.choice([0.1, 0.5, pick.random()]), "popularity": float(pick.randint(0, 3)), "reason": "ranking_score",
             "category": pick.choice("aaaab" if pick.random() < 0.5 else "abcdef"), "new": pick.random() < 0.05, "explores": False}
            for i in range(n)
        ]
    return out


def frame(spark, data):
    rows = [(u, r["id"], r["score"], r["popularity"], r["category"], r["reason"], r["new"]) for u, rs in data.items() for r in rs]
    return spark.createDataFrame(
        rows, "customer_id string, article_id string, score double, popularity double, main_category string, reason string, is_new_item boolean"
    )


def lists(df):
    out = {}
    for r in df.orderBy("customer_id", "position").collect():
        out.setdefault(r.customer_id, []).append(r)
    assert all([r.position for r in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return out


def test_fold_equals_the_policy(spark):
    data = users(1, 60)
    given = frame(spark, data)
    for n, requested, epsilon, seed in ((10, None, 0.25, 42), (7, 2, 1.0, 1), (10, 0, 0.5, 2), (3, 5, 0.6, 3), (25, 1, 0.0, 4)):
        got = lists(rerank.rerank(given, n, requested, epsilon, seed))
        want = {u: policy(u, rows, n, requested, epsilon, seed) for u, rows in data.items()}
        assert {u: [(r.product_id, r.reason, r.is_exploration) for r in rows] for u, rows in got.items()} == want


def test_guard_equals_the_policy(spark):
    data = users(2, 60)
    got = lists(rerank.diversity_guard(frame(spark, data), 12))
    order = {u: sorted(rows, key=lambda r: (-r["score"], -r["popularity"], r["id"])) for u, rows in data.items()}
    assert {u: [r.product_id for r in rows] for u, rows in got.items()} == {u: [r["id"] for r in guard(rows, 12)] for u, rows in order.items()}


def test_no_python_in_the_plan(spark):
    plan = rerank.rerank(frame(spark, users(3, 3)), 10)._jdf.queryExecution().toString()
    assert "aggregate" in plan and "InPandas" not in plan and "Python" not in plan and "InArrow" not in plan


def test_positions_of_the_policy_are_those_of_the_column(spark):
    given = spark.range(1, 40).select(F.col("id").cast("int").alias("n"))
    slots = rerank.exploration_slots(F.col("n"))
    for r in given.select("n", slots.alias("s"), rerank.exploration_positions(F.col("n"), slots).alias("p")).collect():
        share = max(1, round(r.n * 0.2))
        assert r.s == (0 if r.n <= 2 else min(share, 2))
        assert list(r.p) == ([] if r.n <= 2 else sorted({min(max(r.n // 3, 1), r.n - 1), min(max(r.n * 2 // 3, 2), r.n - 1)})[:2] if r.s == 2
                             else [min(max(r.n // 3, 1), r.n - 1)])


def test_the_plan_holds_each_step_of_the_policy_once(spark):
    scored = spark.createDataFrame(
        [("u", "a", 1.0, "x"), ("u", "b", 0.5, "y"), ("u", "c", 0.2, "x")],
        "customer_id string, article_id string, score double, category string",
    )
    plan = rerank.rerank(scored, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 5
    assert rerank.rerank(scored, 0).count() == 0
