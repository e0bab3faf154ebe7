"""The copy of the rows that the ranker is fitted on."""

from pyspark.sql import functions as F

from retailspark.operators import ranking


def test_the_ranker_is_fitted_on_a_copy_without_text(spark, monkeypatch):
    """The split was written with all columns, and every pass of the fit hashed the text again."""
    copies, real = {}, ranking.staged

    def noted(df, name):
        copies[name] = df.columns
        return real(df, name)

    monkeypatch.setattr(ranking, "staged", noted)
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("customer_id"), (F.col("id") % 7).cast("string").alias("article_id"), (F.col("id") % 2).cast("int").alias("label"),
        (F.col("id") % 50 + F.col("id") % 2 * 10).cast("double").alias("age"), F.concat(F.lit("c"), F.col("id") % 5).alias("category"),
    )
    model, report, scored = ranking.fit_ranker_holdout(rows, 0.25, 7, 20)
    assert "category" not in {n for columns in copies.values() for n in columns}
    row = report.first()
    assert (row["rows"], row["train_rows"], row["validation_rows"], row["validation_positives"], row["feature_columns"]) == (400, 300, 100, 50, 2)
    # The report's AUC is that of the returned validation rows, scored from their own text.
    assert scored.count() == 100 and {"customer_id", "category", "score"} <= set(scored.columns)
    assert abs(ranking.roc_auc(scored).first()["auc"] - row["validation_auc"]) < 1e-9
