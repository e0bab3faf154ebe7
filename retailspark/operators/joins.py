"""Filters and joins between transactions, customers, articles and candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.plans.skew import lookup_join

# Column names of the feature tables.
SIGNAL_ATTRIBUTES = ("garment_group_name", "perceived_colour_master_name", "main_category", "color")
CATALOG_TEXT = ("category", "main_category", "color")
USER_PROFILE = ("age", "age_bucket", "fashion_news_frequency", "club_member_status")
ITEM_TEXT = (
    "prod_name", "product_type_name", "product_group_name", "colour_group_name",
    "perceived_colour_master_name", "department_name", "section_name", "garment_group_name",
    "category", "main_category", "color",
)
COLD_START_RANKS = 9
FRESH_BOOST = 0.5


def keep_known(txn: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    known = lookup_join(txn, articles.select("article_id"), "article_id", "left_semi", hot_source=txn)
    return lookup_join(known, customers.select("customer_id"), "customer_id", "left_semi", hot_source=txn)


def unknown_entity_counts(txn: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of unknown customers, and rows of known customers with unknown articles.

    Both flags are known per (customer, article), so the rows are counted per pair first.
    """
    pairs = txn.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    flagged = lookup_join(
        pairs, customers.select("customer_id", F.lit(True).alias("known_customer")), "customer_id", hot_source=txn
    )
    flagged = lookup_join(
        flagged, articles.select("article_id", F.lit(True).alias("known_article")), "article_id", hot_source=txn
    )
    no_customer, no_article = F.col("known_customer").isNull(), F.col("known_article").isNull()
    return flagged.agg(
        F.coalesce(F.sum(F.when(no_customer, F.col("n"))), F.lit(0)).alias("skipped_customer_rows"),
        F.coalesce(F.sum(F.when(~no_customer & no_article, F.col("n"))), F.lit(0)).alias("skipped_article_rows"),
    )


def enrich_transactions(
    txn: DataFrame, articles: DataFrame, customers: DataFrame, how: str = "left"
) -> DataFrame:
    """Item attributes, buyer age group and season; ``how="inner"`` also drops unknown ids."""
    items = articles.select("article_id", *SIGNAL_ATTRIBUTES)
    buyers = customers.select("customer_id", F.col("age_bucket").alias("buyer_age_bucket"))
    joined = lookup_join(txn, items, "article_id", how, hot_source=txn)
    joined = lookup_join(joined, buyers, "customer_id", how, hot_source=txn)
    return joined.select(
        *txn.columns,
        *[F.coalesce(name, F.lit(c.UNKNOWN)).alias(name) for name in SIGNAL_ATTRIBUTES],
        F.coalesce("buyer_age_bucket", F.lit("unknown")).alias("buyer_age_bucket"),
        c.season("t_dat").alias("season"),
    )


def assert_unique(df: DataFrame, key: Sequence[str] | str, name: str) -> DataFrame:
    """Fail when a lookup table repeats a key."""
    keys = [key] if isinstance(key, str) else list(key)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{name} repeats the key {repeated[0].asDict()}")
    return df


def candidate_train(interactions: DataFrame, users: DataFrame, items: DataFrame, check: bool = True) -> DataFrame:
    if check:
        assert_unique(users, "customer_id", "user features")
        assert_unique(items, "article_id", "item features")
    joined = lookup_join(interactions, users, "customer_id", hot_source=interactions)
    return lookup_join(joined, items, "article_id", hot_source=interactions)


def first_per_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row of each key; an aggregate, so a frequent key is reduced before the shuffle."""
    return df.groupBy(key).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("first_row")
    ).select(key, "first_row.*")


def attach_item_stats(df: DataFrame, items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add only the numeric columns that are missing; absent or unmatched ones become 0.0."""
    missing = [name for name in columns if name not in df.columns]
    if not missing:
        return df
    available = [name for name in missing if name in items.columns]
    out = df
    if available:
        stats = first_per_key(items, "article_id", available, available)
        out = lookup_join(df, stats, "article_id", hot_source=df)
    return out.select(
        *df.columns,
        *[
            (c.safe_numeric(name) if name in available else F.lit(0.0)).alias(name)
            for name in missing
        ],
    )


def enrich_candidates(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Popularity, age and newness from the catalog; the row's own categories win."""
    numbers = ("popularity", "item_age_days", "is_new_item")
    looked_up = catalog.select(
        "article_id", *[F.col(name).alias(f"catalog_{name}") for name in (*numbers, *CATALOG_TEXT)]
    )
    joined = lookup_join(df, looked_up, "article_id", hot_source=df)
    own = set(df.columns)

    def merged(name: str):
        catalog_value = F.col(f"catalog_{name}")
        return F.coalesce(F.col(name), catalog_value) if name in own else catalog_value

    kept = [name for name in df.columns if name not in (*numbers, *CATALOG_TEXT)]
    return joined.select(
        *kept,
        F.coalesce(merged("popularity").cast("double"), F.lit(0.0)).alias("popularity"),
        merged("item_age_days").cast("double").alias("item_age_days"),
        F.coalesce(merged("is_new_item"), F.lit(False)).alias("is_new_item"),
        *[merged(name).alias(name) for name in CATALOG_TEXT],
    )


def serving_catalog(articles: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Articles with their popularity, newness, cold-start bonus and scaled popularity."""
    base = articles.withColumn("article_id", c.normalize_article_id("article_id"))
    for name in CATALOG_TEXT:
        base = base.withColumn(name, c.categorical_token(name))
    if items is None:
        stats = base.select(
            "*",
            F.lit(0.0).alias("popularity"),
            F.lit(None).cast("double").alias("item_age_days"),
            F.lit(False).alias("is_new_item"),
        )
    else:
        numbers = items.select(
            c.normalize_article_id("article_id").alias("article_id"),
            F.col("popularity").cast("double").alias("popularity"),
            F.col("item_age_days").cast("double").alias("item_age_days"),
            F.col("is_new_item").cast("boolean").alias("is_new_item"),
        )
        stats = base.join(numbers, "article_id", "left").withColumns({
            "popularity": F.coalesce("popularity", F.lit(0.0)),
            "is_new_item": F.coalesce("is_new_item", F.lit(False)),
        })
    # Only the first ranks of a category earn a bonus, so no category is sorted whole.
    in_category = Window.partitionBy("main_category").orderBy(F.desc("popularity"), "article_id")
    leaders = (
        stats.select("article_id", "main_category", "popularity")
        .withColumn("rn", F.row_number().over(in_category))
        .where(F.col("rn") <= COLD_START_RANKS)
        .select("article_id", ((COLD_START_RANKS + 1 - F.col("rn")) / F.lit(10.0)).alias("cold_start_bonus"))
    )
    top = stats.agg(F.greatest(F.max("popularity"), F.lit(1.0)).alias("top")).scalar()
    return stats.join(leaders, "article_id", "left").withColumns({
        "cold_start_bonus": F.coalesce("cold_start_bonus", F.lit(0.0)),
        "normalized_popularity": F.col("popularity") / top,
        "fresh_boost": F.when(F.col("is_new_item"), FRESH_BOOST).otherwise(0.0),
    })


def ranking_features(candidates: DataFrame, customers: DataFrame) -> DataFrame:
    """User profile with cold-start defaults, item text and crossed features."""
    profile = customers.select("customer_id", *USER_PROFILE)
    kept = [name for name in candidates.columns if name not in (*USER_PROFILE, *ITEM_TEXT)]
    joined = lookup_join(candidates.drop(*USER_PROFILE), profile, "customer_id", hot_source=candidates)
    filled = joined.select(
        *kept,
        F.col("age").cast("double").alias("age"),
        *[c.categorical_token(name).alias(name) for name in USER_PROFILE[1:]],
        *[
            (c.categorical_token(name) if name in candidates.columns else F.lit(c.UNKNOWN)).alias(name)
            for name in ITEM_TEXT
        ],
    )
    return filled.select("*", *c.cross_features())


def cold_start_users(users: DataFrame, customers: DataFrame) -> DataFrame:
    """Users without a customer row; none when there are no customers at all."""
    has_customers = customers.limit(1).agg((F.count(F.lit(1)) > 0).alias("some")).scalar()
    return (
        users.select("customer_id").distinct()
        .join(customers.select("customer_id"), "customer_id", "left_anti")
        .where(has_customers)
    )


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(
        seen.select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti"
    )


def align_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).alias(n) for n in columns])


def item_prices(articles: DataFrame, txn: DataFrame) -> DataFrame:
    """Mean price per article, 0.0 for articles never sold."""
    prices = txn.where(F.col("price").isNotNull()).groupBy("article_id").agg(
        (F.sum(F.col("price").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("price")
    )
    return articles.drop("price").join(prices, "article_id", "left").withColumn(
        "price", F.coalesce("price", F.lit(0.0))
    )
