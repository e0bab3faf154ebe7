import itertools

import pytest
from pyspark.sql import functions as F

from retailspark.operators import candidates as cand
from retailspark.operators import joins, rerank, retrieval, sampling, windows
from retailspark.plans import quantiles, skew


def test_salted_join_equals_plain_join(spark):
    left = spark.range(2000).select(
        F.when(F.col("id") < 900, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = skew.hot_keys(left, ["k"], 4)
    assert list(hot.values()) == [3]
    assert len(skew.hot_keys(left, ["k"], 1000)) == 50
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, skew.salted_join(left, right, ["k"], how, hot).collect()), key=str) == want


def test_ordered_position_is_a_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 101).alias("x"), "id")
    got = skew.ordered_position(df, ["k"], [F.col("x"), F.col("id")], F.floor(F.col("x") / 10), "p", "n").collect()
    for k, rows in itertools.groupby(sorted(got, key=lambda r: (r.k, r.p)), key=lambda r: r.k):
        rows = list(rows)
        assert [r.p for r in rows] == list(range(1, len(rows) + 1)) and rows[0].n == len(rows)
        assert rows == sorted(rows, key=lambda r: (r.x, r.id))


@pytest.mark.parametrize("shape", ["padded", "hex", "constant"])
def test_ranges_are_even_whatever_the_values_look_like(spark, shape):
    """Padded ids, hashes and one constant popularity are all cut into ranges of like size."""
    ids = {"padded": F.lpad(F.col("id").cast("string"), 10, "0"), "hex": F.sha2(F.col("id").cast("string"), 256),
           "constant": F.lpad(F.col("id").cast("string"), 10, "0")}[shape]
    df = spark.range(4000).select(ids.alias("article_id"), F.lit(3 if shape == "constant" else 0).alias("popularity"))
    ranges = df.repartitionByRange(F.desc("popularity"), "article_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) <= 2 * 4000 / len(ranges)
    got = [r.article_id for r in windows.popularity_order(df).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 4000


def test_pieces_of_hot_keys_stay_near_the_mean(spark):
    """One key with a third of the rows and one with half a percent."""
    n, parts = 30_000, 50
    left = spark.range(n).select(
        F.when(F.col("id") < n // 3, -1).when(F.col("id") < n // 3 + n // 200, -2).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    hot = skew.hot_keys(left, ["k"], parts)
    assert len(hot) == 1 and 17 <= max(hot.values()) <= 19
    salts = F.coalesce(F.create_map(*[F.lit(x) for p in hot.items() for x in p])[F.xxhash64("k")], F.lit(1))
    pieces = left.groupBy("k", F.pmod(F.xxhash64("k", "v"), salts)).count().agg(F.max("count")).first()[0]
    assert pieces <= 2 * n / parts


def test_explode_range_needs_no_large_array(spark):
    df = spark.createDataFrame([(1, 10000), (2, 0), (3, 1)], "k int, n int")
    out = skew.explode_range(df, F.col("n"), "i")
    assert [tuple(r) for r in out.groupBy("k").agg(F.count("i"), F.min("i"), F.max("i")).orderBy("k").collect()] == [
        (1, 10000, 0, 9999), (3, 1, 0, 0)
    ]


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).cast("double").alias("x"), F.lit(None).cast("double").alias("empty"))
    direct = df.agg(*[F.percentile("x", f) for f in (0.33, 0.66)]).first()
    for accuracy in (10_000, 50):
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        found = quantiles.exact_quantiles(df, ["x", "empty"], (0.33, 0.66))
        assert found["x"] == pytest.approx(list(direct)) and found["empty"] is None


def txn(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, t_dat date, row_no long, article_id string")


def test_hot_day_is_cut_into_pieces(spark, monkeypatch):
    """A day of many rows gives the same sequence whatever the size of its pieces."""
    import datetime as dt
    day = dt.date(2020, 1, 1)
    rows = txn(spark, [("u", day, i, "abcaab"[i * i % 6]) for i in range(60)] + [("v", day, 7, "x"), ("v", day, 7, "x")])
    sequences = []
    for size in (1, 4, 1000):
        monkeypatch.setattr(windows, "PIECE_ROWS", size)
        sequences.append([tuple(r) for r in windows.purchase_sequence(rows).orderBy("customer_id", "row_no").collect()])
    assert sequences[0] == sequences[1] == sequences[2]
    own = [r[1] for r in sequences[0] if r[0] == "u"]
    assert own == [k for k, _ in itertools.groupby("abcaab"[i * i % 6] for i in range(60))]


def test_sequence_collapses_repeats_across_days(spark):
    import datetime as dt
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    rows = txn(spark, [("u", d1, 1, "a"), ("u", d1, 2, "b"), ("u", d2, 1, "b"), ("u", d2, 2, "a"), ("v", d1, 1, "x"), ("v", d2, 2, "x")])
    sequence = windows.purchase_sequence(rows)
    assert [r.article_id for r in sequence.where("customer_id = 'u'").orderBy("t_dat", "row_no").collect()] == ["a", "b", "a"]
    history = windows.leave_last_out(sequence)
    assert sorted((r.article_id, r.target_article_id) for r in history.collect()) == [("a", "a"), ("b", "a")]


@pytest.mark.parametrize("ratio", [1, 3, 100])
def test_negatives_are_unseen_and_complete(spark, ratio):
    items = spark.range(60).select(
        F.lpad(F.col("id").cast("string"), 10, "0").alias("article_id"),
        F.when(F.col("id") < 20, "x").otherwise("y").alias("main_category"),
    )
    pairs = spark.range(40).select(
        F.when(F.col("id") < 35, "heavy").otherwise("light").alias("customer_id"),
        F.lpad((F.col("id") % 37).cast("string"), 10, "0").alias("article_id"),
    ).distinct()
    got = sampling.sample_negatives(pairs, items, ratio, 5).collect()
    seen = {tuple(r) for r in pairs.collect()}
    drawn = [(r.customer_id, r.article_id) for r in got]
    assert len(set(drawn)) == len(drawn) and not set(drawn) & seen
    for user in ("heavy", "light"):
        bought = sum(u == user for u, _ in seen)
        assert sum(u == user for u, _ in drawn) == min(bought * ratio, 60 - bought)


def test_hard_negatives_come_from_the_category_first(spark):
    items = spark.range(400).select(
        F.lpad(F.col("id").cast("string"), 10, "0").alias("article_id"), (F.col("id") % 4).cast("string").alias("main_category")
    )
    pairs = items.where("main_category = '0'").select(F.lit("u").alias("customer_id"), "article_id").unionByName(
        items.where("article_id = '0000000001'").select(F.lit("w").alias("customer_id"), "article_id")
    )
    rows = sampling.sample_hard_negatives(pairs, items, 4, 0.5, 3).join(items, "article_id").collect()
    mine = [r for r in rows if r.customer_id == "w"]
    assert len(mine) == 4 and sum(r.is_hard for r in mine) == 2
    assert all(r.main_category == "1" for r in mine if r.is_hard)
    # The first user owns the whole category: nothing hard is left, all four come from elsewhere.
    theirs = [r for r in rows if r.customer_id == "u"]
    assert len(theirs) == 400 and not any(r.is_hard or r.main_category == "0" for r in theirs)
    assert len({(r.customer_id, r.anchor, r.article_id) for r in rows}) == len(rows)


def test_holdout_sides_are_disjoint_and_checked(spark):
    df = spark.range(300).select((F.col("id") % 50).cast("string").alias("customer_id"), "id")
    sides = sampling.user_holdout(df, 0.2).groupBy("customer_id").agg(F.count_distinct("side").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1
    with pytest.raises(ValueError):
        sampling.user_holdout(df.where("customer_id = '1'"), 0.2)
    with pytest.raises(ValueError):
        sampling.user_holdout(df, 1.0)


def test_unique_check(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(ValueError, match="repeats"):
        joins.assert_unique(df, "k", "lookup")


def brute_top(q, items, k, skip=()):
    scored = [(round(sum(a * b for a, b in zip(q, v)), 6), i) for i, v in items if i not in skip]
    return [i for s, i in sorted(scored, key=lambda t: (-t[0], t[1]))[:k]]


def vectors(spark, n):
    import random
    rng = random.Random(3)
    rows = [(f"{i:05d}", [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "item_id string, embedding array<double>")


def test_block_retrieval_matches_brute_force(spark, monkeypatch):
    rows, items = vectors(spark, 120)
    users = items.select(F.col("item_id").alias("customer_id"), "embedding")
    catalog = items.withColumnRenamed("item_id", "article_id")
    seen = spark.createDataFrame([("00000", f"{i:05d}") for i in range(0, 120, 2)], "customer_id string, article_id string")
    few = retrieval.user_item_top_k(users, catalog, 5, seen).collect()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 25)
    many = retrieval.user_item_top_k(users, catalog, 5, seen).collect()
    for got in (few, many):
        lists = {}
        for r in sorted(got, key=lambda r: r.position):
            lists.setdefault(r.customer_id, []).append(r.article_id)
        for i, v in rows:
            skip = {f"{j:05d}" for j in range(0, 120, 2)} if i == "00000" else ()
            assert lists[i] == brute_top(v, rows, 5, skip)


def test_zero_queries_return_nothing(spark):
    _, items = vectors(spark, 10)
    zero = spark.createDataFrame([("z", [0.0] * 4)], "query_id string, embedding array<double>")
    assert retrieval.top_k_similar(zero, items, 3).count() == 0


def test_approximate_search_finds_most(spark):
    folder = "/root/testdata/sf0.001"
    from retailspark.sources import shop
    items = shop.item_embeddings(spark, folder)
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    exact = retrieval.top_k_similar(queries, items, 10).select("query_id", "item_id")
    close = retrieval.top_k_similar_approx(queries, items, 10, cells=8, probes=4).select("query_id", "item_id")
    found = exact.join(close, ["query_id", "item_id"]).count()
    assert found / exact.count() > 0.6


def catalog(spark):
    rows = [(f"{i:010d}", "abc"[i % 3], "xy"[i % 2], "rg"[i // 3 % 2], float(100 - i), i < 2) for i in range(30)]
    df = spark.createDataFrame(rows, "article_id string, category string, main_category string, color string, popularity double, is_new_item boolean")
    stats = df.select("article_id", "popularity", F.lit(None).cast("double").alias("item_age_days"), "is_new_item")
    return joins.serving_catalog(df.drop("popularity", "is_new_item"), stats)


def test_candidates_fill_up_and_skip_clicks(spark):
    sessions = spark.createDataFrame(
        [("cold", [], {}), ("warm", ["0", "999"], None), ("unknown", ["999"], None), ("likes", [], {"b": 1.0})],
        "customer_id string, recent_clicks array<string>, session_interest map<string,double>",
    )
    out = cand.generate_candidates(sessions, catalog(spark), pool=12).collect()
    by_user = {}
    for r in sorted(out, key=lambda r: r.candidate_rank):
        by_user.setdefault(r.customer_id, []).append(r)
    assert {u: len(v) for u, v in by_user.items()} == {"cold": 12, "warm": 12, "unknown": 12, "likes": 12}
    assert [r.article_id for r in by_user["cold"]] == [f"{i:010d}" for i in range(12)]
    assert by_user["cold"][0].candidate_reason == "cold_start_popularity"
    assert by_user["unknown"][0].candidate_reason == "candidate_retrieval"
    assert "0000000000" not in [r.article_id for r in by_user["warm"]]
    assert by_user["warm"][0].article_id == "0000000006"  # same category, main category and color
    assert by_user["likes"][0].matches_session_interest and not by_user["likes"][0].matches_recent_click_signal


def scored(spark, categories, user="u"):
    rows = [(user, f"{i:04d}", 1.0 - i / 1000, float(i), ch, "ranking_score", False) for i, ch in enumerate(categories)]
    return spark.createDataFrame(
        rows, "customer_id string, article_id string, score double, popularity double, main_category string, reason string, is_new_item boolean"
    )


def test_guard_allows_no_third_in_a_row(spark):
    categories = "aaaaabacaab"
    got = [r.product_id for r in rerank.diversity_guard(scored(spark, categories), 11).orderBy("position").collect()]
    assert sorted(got) == [f"{i:04d}" for i in range(11)]
    picked = [categories[int(i)] for i in got]
    for at in range(2, len(picked)):
        if picked[at - 2] == picked[at - 1] == picked[at]:
            assert set(picked[at:]) == {picked[at]}


def test_reachable_rows_do_not_change_the_list(spark, monkeypatch):
    import random
    rng = random.Random(1)
    frame = scored(spark, "".join(rng.choice("aaaaaabbc") for _ in range(200)), "u1").unionByName(
        scored(spark, "a" * 120 + "bcdefgh" * 3, "u2")
    ).withColumn("is_new_item", F.col("article_id") == "0110")
    for seed in range(3):
        short = rerank.rerank(frame, 8, epsilon=1.0 if seed else 0.5, seed=seed).orderBy("customer_id", "position").collect()
        with monkeypatch.context() as patch:
            patch.setattr(rerank, "reachable_rows", lambda df, n: df)
            full = rerank.rerank(frame, 8, epsilon=1.0 if seed else 0.5, seed=seed).orderBy("customer_id", "position").collect()
        assert short == full
    assert any(r.reason == "new_item_boost" and r.is_exploration for r in short)


def test_short_lists_have_no_exploration(spark):
    got = rerank.rerank(scored(spark, "ab"), 10, epsilon=1.0).collect()
    assert len(got) == 2 and not any(r.is_exploration for r in got)


def test_lists_that_cannot_reach_the_floor_change_nothing(spark):
    """With a floor, every user's best items are those of all lists."""
    import random
    rng = random.Random(4)
    items = [(f"{i:04d}", f"c{rng.randrange(6)}", f"m{rng.randrange(3)}", rng.choice(["red", "blue", None]), float(rng.randrange(50)), rng.random(), rng.choice([0.0, 0.5]))
             for i in range(300)]
    given = spark.createDataFrame(
        items, "article_id string, category string, main_category string, color string, popularity double, normalized_popularity double, fresh_boost double"
    )
    points = spark.createDataFrame([
        (f"u{u}", kind, value, float(rng.choice([1, 2, 3, 8])), 1, rng.randrange(2))
        for u in range(12) for kind, value in {(rng.choice(["category", "main_category", "color"]), f"{rng.choice('cm')}{rng.randrange(6)}") for _ in range(6)}
    ] + [("u0", "color", "red", 1.0, 1, 0), ("u1", "color", "blue", 2.0, 0, 1)], "customer_id string, kind string, value string, points double, recent int, session int")
    lists = cand.item_lists(given, 25).cache()

    def best(df, n):
        out = {}
        for r in df.collect():
            out.setdefault(r.customer_id, []).append((-(r.signal_score + r.base), r.article_id, r.matches_recent_click_signal, r.matches_session_interest))
        return {u: sorted(v)[:n] for u, v in out.items()}

    whole = cand.signal_scores(points, lists)
    assert whole.count() == whole.select("customer_id", "article_id").distinct().count()
    for need in (1, 5, 20):
        assert best(cand.signal_scores(points, lists, need), need) == best(whole, need)
    assert cand.signal_scores(points, lists, 5).count() < whole.count()


def test_users_with_few_rows_are_opened_in_all_tasks(spark):
    """Users' small rows once met in one task, which then listed thousands of items for each of them."""
    items = [(f"{i:04d}", f"c{i % 3}", f"m{i % 2}", "red", float(i % 7), 0.5, 0.0) for i in range(60)]
    given = spark.createDataFrame(
        items, "article_id string, category string, main_category string, color string, popularity double, normalized_popularity double, fresh_boost double"
    )
    points = cand.interest_points(spark.createDataFrame(
        [(f"u{u}", {"c0": 2.0, "m1": 1.0}) for u in range(100)], "customer_id string, session_interest map<string,double>"
    ))
    found = cand.signal_scores(points, cand.item_lists(given, 10))
    tasks = found.groupBy(F.spark_partition_id()).agg(F.countDistinct("customer_id").alias("users")).collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r.users for r in tasks) < 50
    # Ten of c0, ten of m1; what both list comes once.
    both = {a for a, *_ in sorted((x for x in items if x[1] == "c0"), key=lambda x: (-x[4], x[0]))[:10]} | {
        a for a, *_ in sorted((x for x in items if x[2] == "m1"), key=lambda x: (-x[4], x[0]))[:10]}
    assert {r.n for r in found.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {len(both)}


def test_feature_vectors_rank_for_unseen_users(spark):
    """Purchases follow age and category; users that training has not seen are served by their age."""
    import random
    from retailspark.operators import feature_factors as ff
    rng = random.Random(5)
    ages, groups = ["20s", "30s", "40s", "50s"], ["a", "b", "c", "d"]
    items = [(f"{i:04d}", groups[i % 4]) for i in range(80)]
    users = [(f"u{i}", ages[i % 4]) for i in range(200)]
    liked = {a: [x for x, g in items if g == groups[n]] for n, a in enumerate(ages)}
    rows = []
    for user, age in users:
        for article in rng.sample(liked[age], 6):
            rows.append((user, article, 1))
        for article, _ in rng.sample(items, 6):
            if article not in liked[age]:
                rows.append((user, article, 0))
    users_df = spark.createDataFrame(users, "customer_id string, age_bucket string")
    items_df = spark.createDataFrame(items, "article_id string, category string")
    pairs = spark.createDataFrame(rows, "customer_id string, article_id string, label int").join(users_df, "customer_id").join(items_df, "article_id")
    known, unseen = pairs.where("substring(customer_id, 2) < '170' OR length(customer_id) < 4"), pairs.where("substring(customer_id, 2) >= '170' AND length(customer_id) = 4")
    features = ff.Features(("age_bucket",), ("article_id", "category"))
    factors = ff.fit_feature_factors(known, features, slots=512, rank=8, iterations=80)
    truth = unseen.where("label = 1")
    users_v, items_v = ff.user_vectors(users_df, features, factors, 512), ff.item_vectors(items_df, features, factors, 512)
    got = ff.unseen_user_recall(users_v, items_v, truth, 20).first()
    popular = ff.popularity_recall(known.where("label = 1"), truth, 20).first()
    assert got["users_evaluated"] == popular["users_evaluated"] == truth.select("customer_id").distinct().count()
    assert got["recall"] > 0.9 > 0.5 > popular["recall"]
