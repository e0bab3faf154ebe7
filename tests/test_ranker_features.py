"""The ranker's features, and its split without a shuffle of whole rows."""

from pyspark.sql import functions as F

from retailspark.operators import ranking, sampling


def labelled(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("customer_id"), (F.col("id") % 7).cast("string").alias("article_id"),
        (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 50 + F.col("id") % 2 * 10).cast("double").alias("age"),
        F.concat(F.lit("c"), F.col("id") % 5).alias("category"),
    )


def test_the_features_carry_no_entry_per_place(spark):
    rows = labelled(spark, 400)
    model = ranking.fit_ranker(rows, 5)
    scored = model.transform(ranking.fill_features(rows, ["age"], ["category"]))
    assert all(len(f.json()) < 10_000 for f in scored.schema.fields)
    assert model.stages[-1].numFeatures == ranking.HASHED_FEATURES
    assert spark._jvm.org.apache.spark.util.Utils.serialize(scored.select("features")._jdf.rdd()).__len__() < 1_000_000


def test_the_split_numbers_repeated_keys_and_keeps_the_shares(spark):
    rows = labelled(spark, 100)
    rows = rows.unionByName(rows).unionByName(rows.where("label = 1"))
    split = sampling.stratified_split(rows, "label", ["customer_id", "article_id"], 0.33, 7)
    assert split.columns == [*rows.columns, "side"]
    sizes = {(r["label"], r["side"]): r["count"] for r in split.groupBy("label", "side").count().collect()}
    assert sizes == {(0, "validation"): 33, (0, "train"): 67, (1, "validation"): 50, (1, "train"): 100}
    assert sampling.stratified_split(rows, "label", ["customer_id"], 0.0, 7).where("side = 'validation'").count() == 0
    one = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "customer_id string, label int")
    assert sampling.stratified_split(one, "label", ["customer_id"], 0.5, 7).where("side = 'validation'").count() == 2
