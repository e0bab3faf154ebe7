"""Distinct pairs, negative samples, splits and fixed-size samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.functions.hashing import DRAW_RANGE, draw, draw_below
from retailspark.operators.joins import ITEM_TEXT, USER_PROFILE
from retailspark.plans.skew import RANGE_STEP, explode_range, lookup_join, ordered_position, shuffle_parts
from retailspark.plans.staging import staged

HOLDOUT_BUCKETS = 10_000
HASH_BUCKETS = 65_536
ALL_ITEMS = "*"
# Draws may be rejected at most one time in eight; otherwise the pool is listed.
SPARSE_FACTOR = 8
SPARE_DRAWS = 20
RANKING_COLUMNS = (
    "customer_id", "article_id", "label", "price", "sales_channel_id", *USER_PROFILE, *ITEM_TEXT,
    "age_category", "age_color", "member_category", "fashion_category",
)


def distinct_pairs(txn: DataFrame) -> DataFrame:
    """First purchase of every (customer, article) and the number of dropped repeats."""
    first = F.min(F.struct("t_dat", "row_no", "price", "sales_channel_id"))
    return txn.groupBy("customer_id", "article_id").agg(
        first.alias("first_row"), (F.count(F.lit(1)) - 1).alias("repeats")
    ).select("customer_id", "article_id", "first_row.price", "first_row.sales_channel_id", "repeats")


def positive_pairs(rows: DataFrame, order: Sequence[str], label: str = "label", check: bool = True) -> DataFrame:
    """First positive row of every (user, item); an error when there is none."""
    positives = rows.where(c.safe_numeric(label) == 1)
    if check and positives.isEmpty():
        raise ValueError("no positive interactions")
    keys = ("customer_id", "article_id")
    rest = [n for n in rows.columns if n not in keys]
    # The keys are equal within a pair, so they order nothing and are not moved a second time.
    placed = F.struct(*[n for n in order if n not in keys] or [F.lit(0)])
    return positives.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), placed).alias("first_row")
    ).select("customer_id", "article_id", "first_row.*")


def item_index(items: DataFrame, pool: Column) -> DataFrame:
    """Dense numbers 0 .. size - 1 for the articles of every pool, in id order."""
    pooled = items.select("article_id", pool.alias("pool"))
    numbered = ordered_position(pooled, ["pool"], [F.col("article_id")], name="ordinal", total="pool_size")
    return staged(numbered.withColumn("ordinal", F.col("ordinal") - 1), "item_index")


def draw_unseen(
    requests: DataFrame, index: DataFrame, seen: DataFrame, seed: int, blocked: DataFrame | None = None
) -> DataFrame:
    """Distinct articles of a pool that the user has not seen, ``wanted`` per request.

    A request is (customer_id, anchor, pool, wanted); ``blocked`` lists further articles
    to avoid per (customer_id, anchor). Where most of the pool is unseen, numbered draws
    pick articles and rejected ones are dropped. Where the user has seen a good part of
    the pool, listing the pool costs no more than the user's own rows: the unseen
    articles are put in hash order and each request takes a run from a hashed start.
    """
    request = ["customer_id", "anchor", "pool"]
    # A pool may be asked for by every request, so its size must reach them without a shuffle on the pool.
    sizes = staged(index.groupBy("pool").agg(F.first("pool_size").alias("pool_size")), "pool_sizes")
    requests = staged(requests, "requests")
    seen_counts = (
        lookup_join(
            seen.select("customer_id", "article_id"), index.select("article_id", "pool"), "article_id", "inner", hot_source=seen
        )
        .groupBy("customer_id", "pool").agg(F.count(F.lit(1)).alias("seen_n"))
    )
    sized = lookup_join(requests, sizes, "pool", "inner", hot_source=requests)
    sized = lookup_join(sized, seen_counts, ["customer_id", "pool"], hot_source=requests)
    if blocked is None:
        sized = sized.withColumn("blocked_n", F.lit(0))
    else:
        counts = blocked.groupBy("customer_id", "anchor").agg(F.count(F.lit(1)).alias("blocked_n"))
        sized = sized.join(counts, ["customer_id", "anchor"], "left")
    taken = F.coalesce("seen_n", F.lit(0)) + F.coalesce("blocked_n", F.lit(0))
    sized = sized.withColumn("wanted", F.least(F.col("wanted").cast("long"), F.col("pool_size") - taken)).where(
        "wanted > 0"
    ).withColumn("sparse", F.col("pool_size") >= SPARSE_FACTOR * (taken + F.col("wanted")))
    sized = staged(sized, "draw_requests")

    def unblocked(df: DataFrame) -> DataFrame:
        if blocked is None:
            return df
        return df.join(blocked, ["customer_id", "anchor", "article_id"], "left_anti")

    def draw_count(first_round: bool) -> Column:
        spare = F.ceil(F.col("wanted") / SPARSE_FACTOR) + 1 if first_round else F.col("wanted") + SPARE_DRAWS
        return F.least(F.col("wanted") + spare, F.col("wanted") * 2 + SPARE_DRAWS)

    def fresh_draws(asked: DataFrame, numbered: Callable[..., DataFrame], first_round: bool) -> DataFrame:
        draws = numbered(asked, draw_count(first_round), "draw_no").withColumn(
            "ordinal", draw_below(F.col("pool_size"), seed, F.col("customer_id"), F.col("anchor"), F.col("pool"), F.col("draw_no"))
        )
        hits = lookup_join(
            draws.drop("pool_size"), index.select("pool", "ordinal", "article_id"), ["pool", "ordinal"], "inner"
        )
        fresh = unblocked(hits.join(seen.select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti"))
        return fresh.groupBy(*request, "article_id", "wanted").agg(F.min("draw_no").alias("draw_no"))

    def drawn(asked: DataFrame, first_round: bool) -> DataFrame:
        """Unseen articles of the numbered draws, the earliest ones that were wanted, and how many were found."""
        whole = Window.partitionBy(*request)
        # The draws of all but the largest requests are one range: placed and counted in one pass, so that nothing before is worked out twice.
        short = draw_count(first_round) <= RANGE_STEP
        named = F.col("customer_id").isNotNull() & F.col("anchor").isNotNull() & F.col("pool").isNotNull()
        # Requests that fill all tasks as they are read need not be moved.
        usual = asked.where(short & named)
        if asked.rdd.getNumPartitions() < shuffle_parts(asked):
            usual = usual.repartition(shuffle_parts(asked), "customer_id", "anchor")
        placed = fresh_draws(usual, explode_range, first_round).withColumns({
            "place": F.row_number().over(whole.orderBy("draw_no")).cast("long"), "found": F.count(F.lit(1)).over(whole),
        })
        if not asked.where(~short).isEmpty():
            by_steps = partial(explode_range, spread_by=["customer_id", "anchor"])
            placed = placed.unionByName(ordered_position(
                fresh_draws(asked.where(~short), by_steps, first_round), request, [F.col("draw_no")], F.floor(F.col("draw_no") / RANGE_STEP),
                "place", "found",
            ))
        return placed.where(F.col("place") <= F.col("wanted")).select(*request, "article_id", "wanted", "found", "place")

    # Few draws are rejected, so hardly any request needs more than the first ones; those that do draw all of theirs.
    asked = sized.where("sparse").select(*request, "wanted", "pool_size")
    early = staged(drawn(asked, True), "first_draws")
    done = early.where("found >= wanted AND place = 1").select(*request)
    open_requests = staged(asked.join(done, request, "left_anti"), "open_requests")
    late = drawn(open_requests, False)
    # Fewer hits than wanted has a chance below 1e-19 per request; it must never pass unseen.
    complete = F.when(F.col("found") >= F.col("wanted"), True).otherwise(
        F.raise_error(F.lit("negative draws ran out; use another seed")).cast("boolean")
    )
    from_draws = early.where("found >= wanted").unionByName(late.where(complete)).select(*request, "article_id")

    dense = sized.where(~F.col("sparse"))
    listed = explode_range(
        dense.groupBy("customer_id", "pool").agg(F.max("pool_size").alias("pool_size")), F.col("pool_size"), "ordinal"
    ).drop("pool_size").join(index.select("pool", "ordinal", "article_id"), ["pool", "ordinal"])
    unseen = listed.join(seen.select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti").withColumn(
        "hash", draw(seed, F.col("customer_id"), F.col("pool"), F.col("article_id"))
    )
    shuffled = ordered_position(
        unseen, ["customer_id", "pool"], [F.col("hash"), F.col("article_id")],
        F.floor(F.col("hash") / F.lit(DRAW_RANGE // HASH_BUCKETS)), "slot",
    ).select("customer_id", "pool", "slot", "article_id")
    steps = explode_range(
        dense.select(*request, "wanted", "blocked_n", (F.col("pool_size") - F.coalesce("seen_n", F.lit(0))).alias("unseen_n")),
        F.least(F.col("wanted") + F.coalesce("blocked_n", F.lit(0)), F.col("unseen_n")), "step",
    ).withColumn(
        "slot",
        F.pmod(draw(seed, F.col("customer_id"), F.col("anchor"), F.col("pool")) + F.col("step"), F.col("unseen_n")) + 1,
    )
    runs = unblocked(steps.join(shuffled, ["customer_id", "pool", "slot"]))
    from_lists = ordered_position(
        runs, request, [F.col("step")], F.floor(F.col("step") / RANGE_STEP), "place"
    ).where(F.col("place") <= F.col("wanted")).select(*request, "article_id")
    return from_draws.unionByName(from_lists)


def sample_negatives(positives: DataFrame, items: DataFrame, ratio: int = 1, seed: int = 42) -> DataFrame:
    """Per user (positives x ratio) distinct articles never bought, as far as there are any."""
    index = item_index(items, F.lit(ALL_ITEMS))
    pairs = staged(positives.select("customer_id", "article_id"), "positives")
    requests = pairs.groupBy("customer_id").agg((F.count(F.lit(1)) * ratio).alias("wanted")).select(
        "customer_id", F.lit("").alias("anchor"), F.lit(ALL_ITEMS).alias("pool"), "wanted"
    )
    return draw_unseen(requests, index, pairs, seed).select("customer_id", "article_id")


def sample_hard_negatives(
    positives: DataFrame, items: DataFrame, n: int, hard_ratio: float, seed: int = 42
) -> DataFrame:
    """Per positive: some articles of its main category and the rest from all, never bought."""
    pairs = staged(positives.select("customer_id", "article_id"), "positives")
    categories = items.select("article_id", c.categorical_token("main_category").alias("pool"))
    hard_n = min(n, max(0, round(n * hard_ratio)))
    columns = ("customer_id", "anchor", "article_id")
    anchored = lookup_join(pairs, categories, "article_id", "inner", hot_source=pairs).select(
        "customer_id", F.col("article_id").alias("anchor"), "pool"
    )
    in_category = item_index(items, c.categorical_token("main_category"))
    hard = staged(
        draw_unseen(anchored.withColumn("wanted", F.lit(hard_n)), in_category, pairs, seed).select(*columns), "hard_negatives"
    )
    got = hard.groupBy("customer_id", "anchor").agg(F.count(F.lit(1)).alias("got"))
    rest_requests = anchored.join(got, ["customer_id", "anchor"], "left").select(
        "customer_id", "anchor", F.lit(ALL_ITEMS).alias("pool"), (F.lit(n) - F.coalesce("got", F.lit(0))).alias("wanted")
    )
    rest = draw_unseen(rest_requests, item_index(items, F.lit(ALL_ITEMS)), pairs, seed, blocked=hard).select(*columns)
    return hard.withColumn("is_hard", F.lit(True)).unionByName(rest.withColumn("is_hard", F.lit(False)))


def labelled_pairs(pairs: DataFrame, articles: DataFrame, ratio: int = 1, seed: int = 42) -> DataFrame:
    """The pairs as positives, and their sampled negatives: customer, article and label."""
    columns = ("customer_id", "article_id")
    positives = pairs.select(*columns, F.lit(1).alias("label"))
    return positives.unionByName(sample_negatives(pairs, articles, ratio, seed).select(*columns, F.lit(0).alias("label")))


def ranking_train(
    txn: DataFrame, customers: DataFrame, articles: DataFrame, ratio: int = 1, seed: int = 42
) -> DataFrame:
    """Positive and negative rows with user, item and crossed features, from known purchases."""
    pairs = staged(distinct_pairs(txn), "pairs")
    positives = pairs.select(
        "customer_id", "article_id", F.lit(1).alias("label"), "price", "sales_channel_id"
    )
    negatives = sample_negatives(pairs, articles, ratio, seed).select(
        "customer_id", "article_id", F.lit(0).alias("label"),
        F.lit(None).cast("double").alias("price"), F.lit(-1).alias("sales_channel_id"),
    )
    rows = positives.unionByName(negatives)
    with_users = lookup_join(rows, customers.select("customer_id", *USER_PROFILE), "customer_id", "inner", hot_source=pairs)
    with_items = lookup_join(with_users, articles.select("article_id", *ITEM_TEXT), "article_id", "inner", hot_source=pairs)
    return with_items.select("*", *c.cross_features()).select(*RANKING_COLUMNS)


def ranking_train_stats(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counters of one training set; users are counted from one row per user."""
    users = train.groupBy("customer_id").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )
    totals = users.agg(
        F.count(F.lit(1)).alias("users_seen"),
        F.sum("positives").alias("positives_written"),
        F.sum("negatives").alias("negatives_written"),
        F.count_if((F.col("positives") > 0) & (F.col("negatives") == 0)).alias("users_without_negative_candidates"),
    )
    counted = pairs.agg(
        F.count(F.lit(1)).alias("unique_pairs_kept"), F.sum("repeats").alias("duplicate_purchase_rows")
    )
    # One row each.
    return totals.crossJoin(counted).select(
        "users_seen", "unique_pairs_kept", "duplicate_purchase_rows",
        "positives_written", "negatives_written", "users_without_negative_candidates",
    )


def holdout_side(df: DataFrame, ratio: float = 0.2, seed: int = 42, check: bool = True) -> Column:
    """The side of each user of ``df`` by a hash of the user; with ``check``, neither side is empty."""
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"ratio must be between 0 and 1, got {ratio}")
    in_validation = draw_below(HOLDOUT_BUCKETS, seed, F.col("customer_id")) < int(ratio * HOLDOUT_BUCKETS)
    if check:
        users = df.select("customer_id").distinct()
        counted = users.agg(F.count(F.lit(1)).alias("users"), F.count_if(in_validation).alias("validation")).first()
        if counted["validation"] == 0 and counted["users"] > 0:
            last = users.orderBy("customer_id").limit(max(1, int(counted["users"] * ratio))).agg(
                F.max("customer_id").alias("last")
            ).scalar()
            in_validation = F.col("customer_id") <= last
            counted = users.agg(F.count(F.lit(1)).alias("users"), F.count_if(in_validation).alias("validation")).first()
        if counted["validation"] in (0, counted["users"]):
            raise ValueError("a side of the holdout split is empty")
    return F.when(in_validation, "validation").otherwise("train")


def user_holdout(df: DataFrame, ratio: float = 0.2, seed: int = 42, check: bool = True) -> DataFrame:
    """Every user's rows go to one side by a hash of the user."""
    return df.withColumn("side", holdout_side(df, ratio, seed, check))


def stable_user_sample(users: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """The n users with the smallest hash; every user when there is no limit."""
    distinct = users.select("customer_id").distinct()
    if n is None:
        return distinct
    return distinct.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("customer_id"))), "customer_id").limit(n)


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Train / validation split that keeps the label shares.

    Without two rows of every label the split ignores labels.
    """
    hashed = df.withColumn("hash", draw(seed, *[F.col(k) for k in keys])).withColumn(
        "pos_bucket", F.floor(F.col("hash") / F.lit(DRAW_RANGE // HASH_BUCKETS))
    )
    sizes = staged(hashed.groupBy(label, "pos_bucket").agg(F.count(F.lit(1)).alias("n")), "split_sizes")
    counts = sizes.groupBy(label).agg(F.sum("n").alias("n")).agg(
        F.count(F.lit(1)).alias("labels"), F.min("n").alias("least")
    ).first()
    stratify = counts["labels"] > 1 and counts["least"] >= 2
    stratum = F.col(label).cast("string") if stratify else F.lit("")
    # Only the rows of the bucket that the cut falls into are numbered; the others lie on one side as a whole.
    sizes = sizes.groupBy(stratum.alias("stratum"), "pos_bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("pos_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.round(F.sum("n").over(Window.partitionBy("stratum")) * ratio)
    cuts = staged(
        sizes.select("stratum", "pos_bucket", "n", F.sum("n").over(upto).alias("upto"), wanted.alias("wanted"))
        .groupBy("stratum").agg(
            F.min(F.when(F.col("upto") >= F.col("wanted"), F.col("pos_bucket"))).alias("cut"),
            F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct("pos_bucket", F.col("wanted") - F.col("upto") + F.col("n"))))["col2"]
            .alias("open"),
        ),
        "split_cuts",
    )
    placed = lookup_join(hashed.withColumn("stratum", stratum), cuts, "stratum", "inner", hot_source=sizes)
    order = Window.partitionBy("stratum", "pos_bucket").orderBy("hash", *keys)
    in_cut = placed.where(F.col("pos_bucket") == F.col("cut")).withColumn(
        "side", F.when(F.row_number().over(order) <= F.col("open"), "validation").otherwise("train")
    )
    whole = placed.where(F.col("pos_bucket") != F.col("cut")).withColumn(
        "side", F.when(F.col("pos_bucket") < F.col("cut"), "validation").otherwise("train")
    )
    return whole.unionByName(in_cut).drop("hash", "pos_bucket", "stratum", "cut", "open")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
