"""Orders, positions and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.operators.joins import COLD_START_RANKS
from retailspark.plans.skew import ordered_position

PIECE_ROWS = 65_536


def segment_top_items(items: DataFrame, k: int = 50) -> DataFrame:
    """Top k bought items of every garment group and price band."""
    segment = F.concat_ws(
        "::", F.coalesce("garment_group_name", F.lit(c.UNKNOWN)), F.coalesce("item_price_band", F.lit("unknown"))
    )
    order = Window.partitionBy("segment_key").orderBy(
        F.desc("item_purchase_count_30d"), F.desc("item_purchase_count"),
        F.desc_nulls_last("item_avg_price"), "article_id",
    )
    return (
        items.where(F.col("item_purchase_count") > 0)
        .withColumn("segment_key", segment)
        .withColumn("segment_rank", F.row_number().over(order))
        .where(F.col("segment_rank") <= k)
        .select(
            "segment_key", "segment_rank", "article_id", "prod_name", "garment_group_name",
            "item_price_band", "color", "item_purchase_count_30d", "item_purchase_count",
        )
    )


def popularity_order(items: DataFrame) -> DataFrame:
    """Position of every article by popularity, then id."""
    return ordered_position(items, [], [F.desc("popularity"), F.col("article_id")])


def popular_items(items: DataFrame, n: int) -> DataFrame:
    """The first n articles of the popularity order, with their position."""
    first = items.orderBy(F.desc("popularity"), "article_id").limit(n)
    return first.withColumn(
        "position", F.row_number().over(Window.orderBy(F.desc("popularity"), "article_id"))
    )


def rank_within(items: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Popularity position inside each value of a column; ``limit`` keeps the first ones."""
    if limit is None:
        return ordered_position(items, [column], [F.desc("popularity"), F.col("article_id")])
    order = Window.partitionBy(column).orderBy(F.desc("popularity"), "article_id")
    return items.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def cold_start_bonus(catalog: DataFrame) -> DataFrame:
    """0.9, 0.8, ... for the nine most popular articles of a main category, else 0."""
    leaders = rank_within(
        catalog.select("article_id", "main_category", "popularity"), "main_category", COLD_START_RANKS
    ).select("article_id", ((COLD_START_RANKS + 1 - F.col("position")) / F.lit(10.0)).alias("cold_start_bonus"))
    return catalog.drop("cold_start_bonus").join(leaders, "article_id", "left").withColumn(
        "cold_start_bonus", F.coalesce("cold_start_bonus", F.lit(0.0))
    )


def popularity_top_k(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("customer_id").orderBy(
        F.desc(F.coalesce(F.col("popularity").cast("double"), F.lit(0.0))), "article_id"
    )
    return candidates.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def score_ranking(scored: DataFrame, k: int) -> DataFrame:
    """First k items of every user by score, then id."""
    order = Window.partitionBy("customer_id").orderBy(F.desc("score"), "article_id")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def purchase_sequence(txn: DataFrame) -> DataFrame:
    """Purchases in time order, consecutive repeats of one article collapsed.

    Rows are compared inside one piece: a customer, a day and a range of row numbers, so that
    no customer's day is sorted in one task. The first row of a piece is compared with the last
    article of the customer's previous piece, which a small table holds.
    """
    place = F.struct("row_no", "article_id")
    piece = ["customer_id", "t_dat", "piece"]
    rows = txn.select("customer_id", "article_id", "t_dat", "row_no").withColumn("piece", F.floor(F.col("row_no") / PIECE_ROWS))
    pieces = rows.groupBy(*piece).agg(F.max_by("article_id", place).alias("last_article"))
    previous_piece = Window.partitionBy("customer_id").orderBy("t_dat", "piece")
    pieces = pieces.select(*piece, F.lag("last_article").over(previous_piece).alias("earlier_article"))
    inside = Window.partitionBy(*piece).orderBy("row_no", "article_id")
    return (
        rows.withColumn("previous", F.lag("article_id").over(inside))
        .join(pieces, piece)
        .withColumn("previous", F.coalesce("previous", "earlier_article"))
        .where(F.col("previous").isNull() | (F.col("previous") != F.col("article_id")))
        .select("customer_id", "article_id", "t_dat", "row_no")
    )


def leave_last_out(sequence: DataFrame) -> DataFrame:
    """History rows of users with at least two items, each with the user's last item."""
    place = F.struct("row_no", "article_id")
    days = sequence.groupBy("customer_id", "t_dat").agg(
        F.count(F.lit(1)).alias("n"), F.max(place).alias("last_place")
    )
    user = Window.partitionBy("customer_id")
    days = days.select(
        "customer_id", "t_dat",
        F.sum("n").over(user).alias("items"),
        F.max(F.struct("t_dat", "last_place")).over(user).alias("target"),
    ).where(F.col("items") >= 2)
    return (
        sequence.join(days, ["customer_id", "t_dat"])
        .where(F.struct("t_dat", place) != F.col("target"))
        .select(
            "customer_id", "article_id", "t_dat", "row_no",
            F.col("target.last_place.article_id").alias("target_article_id"),
        )
    )


def recent_preferences(history: DataFrame, column: str) -> DataFrame:
    """Distinct values of a user's history, the most recent first."""
    latest = history.groupBy("customer_id", column).agg(
        F.max(F.struct("t_dat", "row_no", "article_id")).alias("latest")
    )
    order = Window.partitionBy("customer_id").orderBy(F.desc("latest"), column)
    return latest.select("customer_id", column, F.row_number().over(order).alias("preference"))
