"""Candidate lists for all users in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.operators.joins import exclude_seen
from retailspark.operators.windows import popular_items, rank_within
from retailspark.plans.skew import explode_range, fits_broadcast, lookup_join, shuffle_parts
from retailspark.plans.staging import staged

MIN_POOL = 100
POOL_FACTOR = 10
LOOKUP_FACTOR = 4
# Points for a match of the clicked items' category, main category, color.
CLICK_WEIGHTS = {"category": 3.0, "main_category": 2.0, "color": 1.0}
# Factors on a session interest tried as category and as main category.
INTEREST_WEIGHTS = {"category": 4.0, "main_category": 2.0}
CANDIDATE_COLUMNS = (
    "customer_id", "article_id", "candidate_score", "candidate_rank", "candidate_reason",
    "matches_recent_click_signal", "matches_session_interest",
)


def pool_size(top_k: int) -> int:
    return max(MIN_POOL, POOL_FACTOR * top_k)


def _clicks(sessions: DataFrame) -> DataFrame:
    ids = F.transform(F.coalesce("recent_clicks", F.array().cast("array<string>")), c.normalize_article_id)
    return sessions.select("customer_id", F.explode(F.array_distinct(F.filter(ids, lambda x: x != ""))).alias("article_id"))


def recent_signals(sessions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct categories, main categories and colors of each user's clicked items."""
    clicks = _clicks(sessions)
    described = lookup_join(
        clicks, catalog.select("article_id", *CLICK_WEIGHTS), "article_id", "inner", hot_source=clicks
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in CLICK_WEIGHTS]))
    return described.select("customer_id", kinds.alias("s")).select("customer_id", "s.*").distinct()


def click_points(signals: DataFrame) -> DataFrame:
    weight = F.element_at(
        F.create_map(*[F.lit(x) for pair in CLICK_WEIGHTS.items() for x in pair]), F.col("kind")
    )
    return signals.select(
        "customer_id", "kind", "value", weight.alias("points"), F.lit(1).alias("recent"), F.lit(0).alias("session")
    )


def interest_points(sessions: DataFrame) -> DataFrame:
    """Session interests as points; each name is tried as category and as main category."""
    weights = sessions.select("customer_id", F.explode("session_interest").alias("name", "weight"))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(f).alias("factor")) for k, f in INTEREST_WEIGHTS.items()
    ]))
    return weights.select("customer_id", "name", "weight", kinds.alias("k")).select(
        "customer_id", "k.kind", c.categorical_token("name").alias("value"),
        (F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) * F.col("k.factor")).alias("points"),
        F.lit(0).alias("recent"), F.lit(1).alias("session"),
    )


def item_lists(catalog: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` articles of every category, main category and color.

    One row per kind and value: the articles as an array, their number, the lowest and the highest base score. An article
    carries its values of all kinds and whether it is among the first of each, so that one list tells its whole score.
    """
    items = catalog.select(
        "article_id", *CLICK_WEIGHTS, "popularity", (F.col("normalized_popularity") + F.col("fresh_boost")).alias("base")
    )
    listed = _union([
        rank_within(items, kind, limit).drop("position").withColumn("listed", F.lit(kind)) for kind in CLICK_WEIGHTS
    ])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.col(f"in_{k}").alias("is_listed")) for k in CLICK_WEIGHTS])
    rows = listed.groupBy("article_id", *CLICK_WEIGHTS, "popularity", "base").agg(
        *[F.bool_or(F.col("listed") == k).alias(f"in_{k}") for k in CLICK_WEIGHTS]
    ).withColumn("k", F.explode(kinds)).where("k.is_listed")
    item = F.struct("article_id", *CLICK_WEIGHTS, "popularity", "base", *[f"in_{k}" for k in CLICK_WEIGHTS])
    return rows.select("k.kind", "k.value", item.alias("item")).groupBy("kind", "value").agg(
        F.collect_list("item").alias("items"), F.count(F.lit(1)).alias("n"),
        F.min("item.base").alias("low"), F.max("item.base").alias("top"),
    )


#: Sums of the same points in another order may differ in their last bits.
SLACK = 1e-9


def user_signals(points: DataFrame, lists: DataFrame, need: int | None) -> DataFrame:
    """One row per user: a map per kind from value to points and list bounds, and a floor for the score of the ``need`` best items.

    Lists of one kind share no article. Taken by falling worst score, those that first hold ``need`` articles show that so many
    reach the worst score of the last of them: no lower score can be among the ``need`` best.
    """
    merged = points.groupBy("customer_id", "kind", "value").agg(
        F.sum("points").alias("points"), F.max("recent").alias("recent"), F.max("session").alias("session")
    )
    known = lookup_join(merged, lists.drop("items"), ["kind", "value"], "inner", hot_source=points)
    entry = F.struct("value", F.struct("points", "recent", "session", "n", "low", "top"))
    # A user's few rows become thousands of items. Adaptive execution sees the few and would put all users into one task.
    maps = known.repartition(shuffle_parts(known), "customer_id").groupBy("customer_id").agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in CLICK_WEIGHTS]
    )
    if need is None:
        return maps.withColumn("floor", F.lit(float("-inf")))

    def reached(kind: str) -> Column:
        bounds = F.transform(F.map_values(kind), lambda e: F.struct((e["points"] + e["low"]).alias("bound"), e["n"].alias("n")))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("-inf")).alias("floor"))
        return F.aggregate(F.reverse(F.array_sort(bounds)), start, lambda s, e: F.struct(
            (s["n"] + e["n"]).alias("n"),
            F.when((s["n"] < need) & (s["n"] + e["n"] >= need), e["bound"]).otherwise(s["floor"]).alias("floor"),
        ))["floor"]

    return maps.withColumn("floor", F.greatest(*[reached(k) for k in CLICK_WEIGHTS]) - SLACK)


def signal_scores(points: DataFrame, lists: DataFrame, need: int | None = None) -> DataFrame:
    """Points per user and item from every list the user's signals name; with ``need``, of items that can be among so many best.

    An item comes from the first kind whose list names it for the user, and its points of all kinds are looked up in
    the user's maps, so nothing is summed across rows. Lists that cannot reach the user's floor are not opened.
    """
    users = user_signals(points, lists, need)
    kinds = list(CLICK_WEIGHTS)

    def most(kind: str) -> Column:
        return F.coalesce(F.array_max(F.transform(F.map_values(kind), lambda e: e["points"])), F.lit(0.0))

    def openings(at: int) -> Column:
        # Items of earlier kinds come from there, so only later kinds can add points.
        later = sum((most(k) for k in kinds[at + 1:]), F.lit(0.0))
        entries = F.filter(F.map_entries(kinds[at]), lambda e: e["value"]["points"] + e["value"]["top"] + later >= F.col("floor"))
        return F.transform(entries, lambda e: F.struct(F.lit(kinds[at]).alias("kind"), e["key"].alias("value")))

    # The outer explode keeps the optimizer from asking for lists of some size first, with the floor worked out per entry.
    opened = users.select("*", F.explode_outer(F.concat(*[openings(at) for at in range(len(kinds))])).alias("s")).where(
        "s IS NOT NULL"
    ).select("customer_id", *kinds, "floor", "s.*")
    items = lookup_join(opened, lists.select("kind", "value", "items"), ["kind", "value"], "inner", hot_source=points).select(
        "customer_id", *kinds, "floor", "kind", F.explode("items").alias("item")
    )
    found = items.withColumns({
        f"of_{k}": F.when(F.col(f"item.in_{k}"), F.try_element_at(F.col(k), F.col(f"item.{k}"))) for k in kinds
    })
    first = F.coalesce(*[F.when(F.col(f"of_{k}").isNotNull(), F.lit(k)) for k in kinds])
    score = sum((F.coalesce(F.col(f"of_{k}.points"), F.lit(0.0)) for k in kinds[1:]), F.coalesce(F.col(f"of_{kinds[0]}.points"), F.lit(0.0)))
    scored = found.where(F.col("kind") == first).select(
        "customer_id", F.col("item.article_id").alias("article_id"), score.alias("signal_score"),
        *[(F.greatest(*[F.coalesce(F.col(f"of_{k}.{flag}"), F.lit(0)) for k in kinds]) == 1).alias(name)
          for flag, name in (("recent", "matches_recent_click_signal"), ("session", "matches_session_interest"))],
        F.col("item.popularity").alias("popularity"), F.col("item.base").alias("base"), "floor",
    )
    return scored.where(F.col("signal_score") + F.col("base") >= F.col("floor")).drop("floor")


def _is_cold(clicks_n: Column, interest: Column) -> Column:
    return (F.coalesce(clicks_n, F.lit(0)) == 0) & (F.coalesce(F.size(interest), F.lit(0)) <= 0)


def _from_popular(users: DataFrame, positions: Column, popular: DataFrame) -> DataFrame:
    """The first ``positions`` rows of the popular list for every user."""
    asked = explode_range(users, positions, "place").withColumn("position", (F.col("place") + 1).cast("int")).drop("place")
    return lookup_join(asked, popular, "position", "inner")


def cold_start_candidates(users: DataFrame, popular: DataFrame, pool: int) -> DataFrame:
    """The popular list in its own order, scored by popularity, bonus and newness."""
    score = F.col("normalized_popularity") + F.col("cold_start_bonus") + F.col("fresh_boost")
    return _from_popular(users.select("customer_id"), F.lit(pool), popular).select(
        "customer_id", "article_id", score.alias("candidate_score"), F.col("position").alias("candidate_rank"),
        F.lit("cold_start_popularity").alias("candidate_reason"),
        F.lit(False).alias("matches_recent_click_signal"), F.lit(False).alias("matches_session_interest"),
    )


def generate_candidates(
    sessions: DataFrame, catalog: DataFrame, top_k: int = 10, pool: int | None = None, max_clicks: int | None = None
) -> DataFrame:
    """Ranked pool of items per user from clicks, interests and popularity.

    ``sessions`` holds customer_id, recent_clicks and session_interest; ``max_clicks``
    bounds the click lists and is looked up when it is not given.
    """
    pool = pool or pool_size(top_k)
    catalog = staged(catalog.select(
        "article_id", *CLICK_WEIGHTS, "popularity", "normalized_popularity", "cold_start_bonus", "fresh_boost"
    ), "catalog")
    if max_clicks is None:
        max_clicks = sessions.agg(F.coalesce(F.max(F.size("recent_clicks")), F.lit(0)).alias("n")).first()["n"]
    # At most pool + max_clicks rows, whatever the catalog holds.
    popular = staged(popular_items(catalog, pool + max(max_clicks, 0)), "popular_items")

    clicks = _clicks(sessions)
    click_counts = clicks.groupBy("customer_id").agg(F.count(F.lit(1)).alias("clicks_n"))
    users = sessions.join(click_counts, "customer_id", "left").select(
        "customer_id",
        F.coalesce("clicks_n", F.lit(0)).alias("clicks_n"),
        _is_cold(F.col("clicks_n"), F.col("session_interest")).alias("is_cold"),
    )

    points = click_points(recent_signals(sessions, catalog)).unionByName(interest_points(sessions))
    lists = staged(item_lists(catalog, LOOKUP_FACTOR * pool), "item_lists")
    signal = exclude_seen(signal_scores(points, lists, pool + max(max_clicks, 0)), clicks)
    best = Window.partitionBy("customer_id").orderBy(F.desc("candidate_score"), F.desc("popularity"), "article_id")
    # A user with a full pool needs no more than its best rows; the others keep all they have.
    scored = staged(
        signal.select(
            "customer_id", "article_id", "popularity", (F.col("signal_score") + F.col("base")).alias("candidate_score"),
            "matches_recent_click_signal", "matches_session_interest",
        ).withColumn("place", F.row_number().over(best)).where(F.col("place") <= pool).drop("place"),
        "scored_candidates",
    )

    scored_counts = scored.groupBy("customer_id").agg(F.count(F.lit(1)).alias("scored_n"))
    short = users.where(~F.col("is_cold")).join(scored_counts, "customer_id", "left").select(
        "customer_id", "clicks_n", (F.lit(pool) - F.coalesce("scored_n", F.lit(0))).alias("open_places")
    ).where("open_places > 0")
    offered = _from_popular(short, F.lit(pool) + F.col("clicks_n"), popular)
    unused = exclude_seen(exclude_seen(offered, clicks), scored)
    in_order = Window.partitionBy("customer_id").orderBy("position")
    filled = unused.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= F.col("open_places")).select(
        "customer_id", "article_id", "popularity",
        (F.col("normalized_popularity") + F.col("fresh_boost")).alias("candidate_score"),
        F.lit(False).alias("matches_recent_click_signal"), F.lit(False).alias("matches_session_interest"),
    )

    warm = (
        scored.unionByName(filled)
        .withColumn("candidate_rank", F.row_number().over(best))
        .where(F.col("candidate_rank") <= pool)
        .withColumn("candidate_reason", F.lit("candidate_retrieval"))
        .select(*CANDIDATE_COLUMNS)
    )
    cold = cold_start_candidates(users.where("is_cold"), popular, pool).select(*CANDIDATE_COLUMNS)
    return warm.unionByName(cold)


def describe_candidates(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalog's item columns to candidate rows."""
    return lookup_join(
        candidates, catalog.drop("cold_start_bonus", "normalized_popularity", "fresh_boost"), "article_id", "inner",
        hot_source=candidates,
    )


PREFERENCE_TIERS = ("category", "main_category", "color")
EVERYTHING = "*"


def metadata_popularity_recs(history: DataFrame, articles: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """Walk the lists of preferred categories, main categories and colors, then all articles.

    Every list is in popularity order and the user's history is skipped. A list can only
    matter while the lists before it hold fewer than k unseen articles, and then only its
    first k unseen ones, so each user's rows stay proportional to k and the own history.
    """
    counts = popularity.select("article_id", "popularity")
    catalog = staged(articles.select("article_id", *PREFERENCE_TIERS).join(counts, "article_id"), "popular_catalog")
    with_all = catalog.withColumn(EVERYTHING, F.lit(EVERYTHING))
    tiers = [*PREFERENCE_TIERS, EVERYTHING]
    ranked = staged(_union([
        rank_within(with_all.select("article_id", F.col(f"`{t}`").alias("value"), "popularity"), "value")
        .select(F.lit(n).alias("tier"), "value", "position", "article_id")
        for n, t in enumerate(tiers)
    ]), "ranked_lists")
    sizes = ranked.groupBy("tier", "value").agg(F.max("position").alias("list_size"))

    owned = staged(
        history.groupBy("customer_id", "article_id").agg(F.max(F.struct("t_dat", "row_no", "article_id")).alias("latest")),
        "history_items",
    )
    described = lookup_join(owned, with_all, "article_id", "inner", hot_source=owned)
    kinds = F.explode(F.array(*[
        F.struct(F.lit(n).alias("tier"), F.col(f"`{t}`").alias("value")) for n, t in enumerate(tiers)
    ]))
    wishes = described.select("customer_id", "latest", kinds.alias("k")).groupBy(
        "customer_id", "k.tier", "k.value"
    ).agg(F.max("latest").alias("latest"), F.count(F.lit(1)).alias("owned_n"))
    # Users whose history names no known article still get the list of all articles.
    everyone = history.select("customer_id").distinct().select(
        "customer_id", F.lit(len(tiers) - 1).alias("tier"), F.lit(EVERYTHING).alias("value"),
        F.lit(None).cast(wishes.schema["latest"].dataType).alias("latest"), F.lit(0).cast("long").alias("owned_n"),
    )
    wishes = wishes.unionByName(everyone).groupBy("customer_id", "tier", "value").agg(
        F.max("latest").alias("latest"), F.max("owned_n").alias("owned_n")
    )
    # Every user asks for the size of the list of all articles.
    sizes = staged(sizes, "list_sizes")
    if not fits_broadcast(sizes):
        wishes = staged(wishes, "wishes")
    sized = lookup_join(wishes, sizes, ["tier", "value"], "inner", hot_source=wishes)
    unseen = F.col("list_size") - F.col("owned_n")
    in_tier = Window.partitionBy("customer_id", "tier").orderBy(F.desc("latest"), "value")
    earlier = F.coalesce(F.sum(unseen).over(in_tier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tier_totals = Window.partitionBy("customer_id").orderBy("tier").rangeBetween(Window.unboundedPreceding, -1)
    placed = sized.select("*", F.row_number().over(in_tier).alias("preference"), earlier.alias("earlier"),
                          F.sum(unseen).over(Window.partitionBy("customer_id", "tier")).alias("tier_total"))
    # Lists of one tier share no article, so a tier's total is a floor for what came before.
    floor = F.greatest(F.coalesce(F.max("tier_total").over(tier_totals), F.lit(0)), F.col("earlier"))
    wanted = placed.withColumn("floor", floor).where(F.col("floor") < k)
    needed = explode_range(wanted, F.least(F.col("list_size"), F.col("owned_n") + k), "place").select(
        "customer_id", "tier", "value", "preference", (F.col("place") + 1).alias("position")
    )
    if not fits_broadcast(ranked):
        needed = staged(needed, "list_places")
    rows = lookup_join(needed, ranked, ["tier", "value", "position"], "inner", hot_source=needed)
    fresh = exclude_seen(rows, owned)
    first = fresh.groupBy("customer_id", "article_id").agg(F.min(F.struct("tier", "preference", "position")).alias("place"))
    order = Window.partitionBy("customer_id").orderBy("place")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select(
        "customer_id", "article_id", "position"
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
