"""Ranking metrics over long tables: one row per user and listed item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.metrics import discount, ideal_dcg
from retailspark.plans.staging import staged


def user_scores(ranked: DataFrame, truth: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Recall, hit rate, reciprocal rank, DCG and nDCG of every user; users without hits score 0."""
    top = ranked.where(F.col("position") <= k).select("customer_id", "article_id", "position")
    hits = top.join(truth.select("customer_id", "article_id"), ["customer_id", "article_id"]).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("position").alias("first_hit"),
        F.sum(discount(F.col("position"))).alias("dcg"),
    )
    relevant = truth.groupBy("customer_id").agg(F.count_distinct("article_id").alias("relevant"))
    joined = users.select("customer_id").join(relevant, "customer_id", "left").join(hits, "customer_id", "left")
    return joined.select(
        "customer_id",
        F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)).alias("recall"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
        F.coalesce(F.col("dcg") / ideal_dcg(F.col("relevant"), k), F.lit(0.0)).alias("ndcg"),
    )


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean of every metric; 0 for no users."""
    names = [n for n in scores.columns if n != "customer_id"]
    return scores.agg(
        F.count(F.lit(1)).alias("users_evaluated"),
        *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names],
    )


def coverage_at_k(ranked: DataFrame, candidate_count: int | Column, k: int) -> DataFrame:
    """Share of the candidate items that appear in some user's top k."""
    total = F.lit(candidate_count) if isinstance(candidate_count, int) else candidate_count
    return ranked.where(F.col("position") <= k).agg(F.count_distinct("article_id").alias("n")).select(
        F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("coverage")
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact AUC with ties at half; NULL when a class is missing.

    Rows collapse to one per score; distinct scores are cut into ranges of like size, so that the
    running count of negatives is taken inside a range and the earlier ranges' totals are added.
    """
    distinct = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    )
    levels = staged(distinct.repartitionByRange("score").withColumn("bucket", F.spark_partition_id()), "levels")
    inside = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = levels.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).groupBy("bucket").agg(
        F.sum((F.col("p") * (F.col("below") + F.col("n") / 2)).cast("double")).alias("wins"),
        F.sum("p").alias("p"), F.sum("n").alias("n"),
    )
    # One row per range.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).agg(
        F.sum(F.col("wins") + F.col("p").cast("double") * F.col("before")).alias("wins"),
        F.sum("p").alias("p"), F.sum("n").alias("n"),
    )
    return total.select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / F.col("p") / F.col("n")).alias("auc")
    )
