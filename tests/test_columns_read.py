"""Steps that move only the columns that are read."""

from pyspark.sql import functions as F

from retailspark.operators import joins, retrieval_train
from retailspark.registry import core, models, sampling as sampling_queries


def _training_rows(spark):
    rows = [
        (f"u{u}", f"{a:04d}", int((u + a) % 3 > 0), float(20 + u), f"band{u % 3}", "ACTIVE", f"cat{a % 4}", f"color{a % 5}", "x" * 50 + str(a))
        for u in range(60) for a in range(u % 7, 30, 5)
    ]
    return spark.createDataFrame(rows, "customer_id string, article_id string, label int, age double, age_bucket string, "
                                 "club_member_status string, category string, color string, prod_name string")


def test_retrieval_dataset_stages_what_it_reads(spark, monkeypatch):
    """Long columns that no vocabulary or entity reads once went through the pairs' shuffle and their copy."""
    kept, stage = {}, retrieval_train.staged
    monkeypatch.setattr(retrieval_train, "staged", lambda df, name: kept.setdefault(name, stage(df, name)))
    rows = _training_rows(spark)
    args = ["customer_id", "article_id"], ["age_bucket", "club_member_status"], ["age"], ["category", "color"], ["popularity"]
    built = retrieval_train.retrieval_dataset(rows, *args)
    assert "prod_name" not in kept["retrieval_pairs"].columns and "color" in kept["retrieval_pairs"].columns
    whole = {(r.customer_id, r.article_id): (r.side, r.prod_name, r.color) for r in built["pairs"].collect()}
    narrow = {(r.customer_id, r.article_id): (r.side, "x" * 50 + str(int(r.article_id)), r.color) for r in kept["retrieval_pairs"].collect()}
    assert whole == narrow and len(whole) == rows.where("label = 1").count()
    sides = {r.side: r.rows for r in built["metadata"].collect()}
    assert sides == {s: sum(v[0] == s for v in whole.values()) for s in ("train", "validation")}


def test_training_matrix_writes_no_copy(spark, monkeypatch):
    """All columns of the training rows were once written before eight of them were read."""
    rows = _training_rows(spark).withColumn("fashion_news_frequency", F.lit("Monthly")).withColumn("age_category", F.lit("a_b"))
    for module in (sampling_queries, models):
        monkeypatch.setattr(module, "train", lambda *_: (_ for _ in ()).throw(AssertionError("staged")))
    monkeypatch.setattr(sampling_queries, "build_train", lambda *_: rows)
    got = models.training_matrix(spark, "/no/such/folder")
    assert got.count() == rows.count() and "prod_name" not in got.columns


def test_training_columns_are_those_of_the_rows(spark, monkeypatch):
    rows = _training_rows(spark)
    monkeypatch.setattr(sampling_queries, "build_train", lambda *_: rows)
    got = sampling_queries.train_columns(spark, "/no/such/folder", "customer_id", "label")
    assert got.columns == ["customer_id", "label"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("customer_id", "label").collect()))


def test_rounded_tables_are_not_rounded_per_joined_row(spark):
    """Features of users and items were once rounded for every purchase."""
    users = spark.createDataFrame([("a", 1 / 3, 2), ("b", None, 3)], "customer_id string, spend double, n int")
    items = spark.createDataFrame([("i", 2 / 3)], "article_id string, mean double")
    rows = spark.createDataFrame([("a", "i", 0.12345678949), ("b", "i", 1.0), ("c", "j", 2.0)], "customer_id string, article_id string, price double")
    want = core.flat(joins.candidate_train(rows, users, items))
    got = core.flat(joins.candidate_train(rows, core.rounded(users), core.rounded(items), check=False))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    top = got._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert top.count("round(") == 1
