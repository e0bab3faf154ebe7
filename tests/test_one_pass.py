"""Steps that once worked out the same rows several times."""

from pyspark.sql import functions as F

from retailspark.operators import features, sampling
from retailspark.plans.skew import explode_range


def _drawn(spark, users, wanted):
    index = spark.range(4000).select(
        F.lit("*").alias("pool"), F.concat(F.lit("a"), "id").alias("article_id"), F.col("id").alias("ordinal"), F.lit(4000).cast("long").alias("pool_size")
    )
    seen = spark.range(users).select(F.concat(F.lit("u"), "id").alias("customer_id"), F.concat(F.lit("a"), F.col("id") * 3).alias("article_id"))
    requests = seen.select("customer_id", F.lit("").alias("anchor"), F.lit("*").alias("pool"), (F.lit(wanted) + F.length("customer_id")).alias("wanted"))
    return sorted(tuple(r) for r in sampling.draw_unseen(requests, index, seen, 5).select("customer_id", "article_id").collect())


def test_draws_of_usual_requests_are_placed_in_one_pass(spark, monkeypatch):
    """Numbering and counting each worked out the draws, their articles and the anti join."""
    whole = _drawn(spark, 12, 40)
    assert len(whole) == len(set(whole)) == 10 * 42 + 2 * 43
    real, cut = sampling.ordered_position, []

    def counted(df, keys, *rest):
        cut.extend(["draws"] if "draw_no" in df.columns else [])
        return real(df, keys, *rest)

    monkeypatch.setattr(sampling, "ordered_position", counted)
    assert _drawn(spark, 12, 40) == whole and not cut
    # Some requests are longer than a range and are still numbered range by range, to the same articles.
    monkeypatch.setattr(sampling, "RANGE_STEP", 49)
    assert _drawn(spark, 12, 40) == whole and cut


def test_requests_are_spread_before_they_become_draws(spark):
    few = spark.range(3).coalesce(1).withColumn("n", F.lit(9000))
    rows = explode_range(few, F.col("n"), "no", ["id"])
    assert rows.rdd.getNumPartitions() == 4
    assert rows.groupBy("id").agg(F.count_distinct("no").alias("n"), F.max("no").alias("top")).select("n", "top").distinct().collect() == [(9000, 8999)]


def test_item_counts_are_taken_once(spark):
    """The last day and each use of the popularity read all purchases again."""
    rows = [("a", "2020-01-01", "2"), ("a", "2020-01-05", "3"), ("b", "2020-01-09", "x"), (" ", "2021-01-01", "1"), ("c", "soon", "1")]
    raw = spark.createDataFrame(rows, "article_id string, t_dat string, price string")
    found = features.item_features(raw)
    assert all("item_counts" in f for f in found.inputFiles()) and found.inputFiles()
    assert {r.article_id: (r.popularity, r.avg_price, r.item_age_days, r.is_new_item) for r in found.collect()} == {
        "a": (2, 2.5, 4, True), "b": (1, 0.0, 0, True)}
