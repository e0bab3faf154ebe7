"""Steps whose cost must not grow faster than their rows."""

import hashlib

from pyspark.sql import functions as F

from retailspark.operators import features, sampling, totals_state
from retailspark.registry import evaluation as evaluation_queries
from retailspark.registry import models


def _draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_negatives_draw_little_more_than_is_wanted(spark, monkeypatch):
    """Every request once took twice the wanted number and 20 draws more; the articles are the same."""
    items = [f"{i:04d}" for i in range(480)]
    bought = {f"u{u}": {items[(u * 37 + 11 * j) % 480] for j in range(8 + u % 22)} for u in range(80)}
    pairs = spark.createDataFrame([(u, a) for u, own in bought.items() for a in own], "customer_id string, article_id string")
    drawn, whole = [], sampling.explode_range

    def counted(df, count, name):
        if name == "draw_no":
            drawn.append(df.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("requests")).first())
        return whole(df, count, name)

    monkeypatch.setattr(sampling, "explode_range", counted)
    got = {}
    for r in sampling.sample_negatives(pairs, spark.createDataFrame([(i,) for i in items], "article_id string"), 1, 42).collect():
        got.setdefault(r.customer_id, set()).add(r.article_id)
    for user, own in bought.items():
        want = []
        for no in range(2 * len(own) + 20):
            article = items[_draw(42, user, "", "*", no) % 480]
            if article not in own and article not in want and len(want) < len(own):
                want.append(article)
        assert got[user] == set(want)
    early, late = drawn
    assert early.requests == 80 and late.requests < 40
    assert early.n + late.n < sum(2 * len(own) + 20 for own in bought.values()) * 0.8


def test_dataset_metadata_repeats_no_row(spark):
    rows = spark.createDataFrame(
        [("a", "1", True), ("a", "2", False), ("b", "1", True), (None, "3", True), ("b", None, False)],
        "customer_id string, article_id string, is_positive boolean",
    )
    out = features.dataset_metadata(rows)
    assert out.first().asDict() == {"rows": 5, "users": 2, "items": 3, "positive_rows": 3, "negative_rows": 2}
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert features.dataset_metadata(rows.limit(0)).first()["rows"] == 0


def test_evaluation_rows_are_not_copied(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 0)], "customer_id string, article_id string, label int")
    monkeypatch.setattr(evaluation_queries, "train", lambda s, d: rows)

    def refuse(df, name):
        raise AssertionError(f"{name} is staged again")

    monkeypatch.setattr(evaluation_queries, "staged", refuse)
    flagged, truth, users = evaluation_queries.rows_with_truth(spark, "")
    assert {r.article_id: r.is_positive for r in flagged.collect()} == {"1": True, "2": False}
    assert truth.count() == users.count() == 1
    assert evaluation_queries.evaluation_context(spark, "").first().asDict() == {"rows": 2, "users": 1, "positives": 1, "item_count": 2}


def test_ranking_summary_stages_what_it_reads(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("a", "1", 1, True, 2.0, "x"), ("a", "2", 0, False, 1.0, "y")],
        "customer_id string, article_id string, label int, is_positive boolean, popularity double, prod_name string",
    )
    truth = rows.where("is_positive").select("customer_id", "article_id")
    monkeypatch.setattr(models, "enriched_rows", lambda s, d: (rows, truth, truth.select("customer_id").distinct()))
    kept, whole = [], models.staged
    monkeypatch.setattr(models, "staged", lambda df, name: kept.append(df.columns) or whole(df, name))
    assert models.ranking_summary(spark, "").first()["auc"] == 1.0
    assert kept == [["customer_id", "article_id", "score", "is_positive"]]


def test_day_sums_move_their_rows_once(spark):
    rows = spark.createDataFrame(
        [("a", "1997-03-05", 1.5, 1), ("a", "1997-03-05", 2.0, 2), ("b", "1997-04-01", 4.0, 1)],
        "customer_id string, t_dat string, price double, sales_channel_id int",
    ).withColumn("t_dat", F.to_date("t_dat"))
    sums = totals_state.dated_sums(rows, "customer_id")
    assert {(r.customer_id, r.month, r.purchases, float(r.spend)) for r in sums.collect()} == {("a", 199703, 2, 3.5), ("b", 199704, 1, 4.0)}
    plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1
