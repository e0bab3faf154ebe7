import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.functions import metrics as m
from retailspark.functions.draws import hypergeometric
from retailspark.operators import abtest, evaluation
from retailspark.operators import metrics as long_metrics

RANKING = [
    ("fox", "tea|jam|rye", "rye"),
    ("hen", "oat|fig|nut|yam|pea", "fig|pea"),
    ("owl", "jam|tea", "jam|tea|rye"),
    ("yak", "pea|oat|fig", "nut"),
]
CONTROL = [0.0] * 5 + [2.0] * 3 + [4.0] * 2
TREATMENT = [0.0] * 2 + [2.0] * 4 + [4.0] * 4


def ab(spark):
    return spark.createDataFrame(
        [("control", float(v)) for v in CONTROL] + [("treatment", float(v)) for v in TREATMENT], "group string, value double"
    )


@pytest.fixture
def lists(spark):
    df = spark.createDataFrame(RANKING, "query_id string, ranked_items string, relevant_items string")
    return evaluation.read_ranking_lists(df)


@pytest.mark.parametrize("metric,expected", [
    ("hit_rate", [1, 1, 1, 0]),
    ("reciprocal_rank", [1 / 3, 1 / 2, 1, 0]),
    # 1/log2(4) of 1; 1/log2(3) of 1 + 1/log2(3); 1 + 1/log2(3) of 1 + 1/log2(3) + 1/2; nothing
    ("ndcg", [0.5, 0.386853, 0.765361, 0]),
])
def test_golden_scores(lists, metric, expected):
    scores = [r.score for r in m.metric_scores(lists, metric, 3).orderBy("query_id").collect()]
    assert scores == pytest.approx(expected, abs=1e-6)
    assert m.mean_metric(lists, metric, 3).first().mean_score == pytest.approx(sum(expected) / 4, abs=1e-6)


def test_long_form_agrees_with_lists(lists):
    ranked = lists.select(
        F.col("query_id").alias("customer_id"), F.posexplode("ranked_items").alias("p", "article_id")
    ).withColumn("position", F.col("p") + 1)
    truth = lists.select(F.col("query_id").alias("customer_id"), F.explode("relevant_items").alias("article_id"))
    users = ranked.select("customer_id").distinct()
    got = {r.customer_id: r for r in long_metrics.user_scores(ranked, truth, users, 3).collect()}
    for metric in ("recall", "hit_rate", "dcg", "ndcg"):
        for row in m.metric_scores(lists, metric, 3).collect():
            assert got[row.query_id][metric] == pytest.approx(row.score)


def test_repeated_items_count_repeatedly(spark):
    df = spark.createDataFrame([(["a", "a"], ["a"])], "r array<string>, t array<string>")
    row = df.select(m.recall_at_k("r", "t", 2).alias("recall"), m.dcg_at_k("r", "t", 2).alias("dcg")).first()
    assert row.recall == 2.0 and row.dcg == pytest.approx(1 + 1 / math.log2(3))
    assert df.select(m.recall_at_k("r", "t", 0), m.ndcg_at_k("r", "t", 0)).first() == (0.0, 0.0)


def test_auc_with_ties_and_single_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.1001)]
    df = spark.createDataFrame(rows, "label int, score double")
    wins = [(p > n) + 0.5 * (p == n) for lp, p in rows if lp for ln, n in rows if not ln]
    assert long_metrics.roc_auc(df).first().auc == pytest.approx(sum(wins) / len(wins))
    assert long_metrics.roc_auc(df.where("label = 1")).first().auc is None


def test_query_ids_are_added(spark):
    df = spark.createDataFrame([("b|c", "b"), ("a|b", "a")], "ranked_items string, relevant_items string")
    assert [(r.query_id, r.ranked_items[0]) for r in evaluation.read_ranking_lists(df).orderBy("query_id").collect()] == [
        ("1", "a"), ("2", "b")
    ]


def test_group_effect(spark):
    row = abtest.group_effect(ab(spark)).first()
    assert (row.control_mean, row.treatment_mean) == (1.4, 2.4)
    assert row.absolute_diff == pytest.approx(1.0) and row.relative_lift == pytest.approx(5 / 7)


def test_wide_table_and_missing_group(spark):
    wide = spark.createDataFrame([(0.0, 1.0), (None, 0.5)], "control double, treatment double")
    assert abtest.read_ab(wide).count() == 3
    with pytest.raises(ValueError):
        abtest.read_ab(ab(spark).where("group = 'control'"))
    with pytest.raises(ValueError):
        abtest.bootstrap_ci(ab(spark), 1.5)
    with pytest.raises(ValueError):
        abtest.permutation_p(ab(spark), 0)


def test_both_drawing_methods_agree(spark):
    intervals = [abtest.bootstrap_ci(ab(spark), 0.95, 400, 1, method=s).first() for s in abtest.METHODS]
    # The spread of the difference is sqrt((2.44 + 2.24) / 10) = 0.684, so the interval is about 1 +- 1.34.
    for row in intervals:
        assert row.lower == pytest.approx(-0.34, abs=0.3) and row.upper == pytest.approx(2.34, abs=0.3)
    # Shuffling the pooled values moves the difference by sqrt(2.59 * 20 / 19 / 5) = 0.738; steps are 0.4, so
    # 1.0 or more is 0.8 or more before rounding to steps: about one shuffle in four to five.
    for s in abtest.METHODS:
        assert abtest.permutation_p(ab(spark), 400, 1, method=s).first().p_value == pytest.approx(0.23, abs=0.08)


def test_counts_beyond_a_billion(spark):
    """Hypergeometric and binomial counts of any size: mean and variance of many draws."""
    rng = np.random.default_rng(3)
    drawn = np.array([hypergeometric(rng, 10**10, 3 * 10**10, 10**9) for _ in range(60)], float)
    spread = math.sqrt(10**9 * 0.25 * 0.75 * 39 / 40)
    assert abs(drawn.mean() - 2.5e8) < 5 * spread / math.sqrt(60) and 0.6 < drawn.std() / spread < 1.5
    small = [hypergeometric(rng, 7, 5, 6) for _ in range(4000)]
    assert np.mean(small) == pytest.approx(3.5, abs=0.08) and np.var(small) == pytest.approx(6 * 7 / 12 * 5 / 12 * 6 / 11, abs=0.08)
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 4, 4, 8) == 4


def test_counts_over_many_blocks(spark, monkeypatch):
    """The tree of blocks keeps every replicate's size and the distribution of its mean."""
    monkeypatch.setattr(abtest, "BLOCK_VALUES", 5)
    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("group"), (F.col("id") % 60).cast("double").alias("value"))
    diffs = [r["diff"] for r in abtest.bootstrap_diffs(rows, 200, 5).collect()]
    spread = math.sqrt(2 * (60**2 - 1) / 12 / 200)
    assert len(diffs) == 200 and np.mean(diffs) == pytest.approx(1.0, abs=0.5) and np.std(diffs) == pytest.approx(spread, rel=0.25)
    assert 0.3 < abtest.permutation_p(rows, 300, 5).first().p_value < 0.8


def test_positive_flag_conventions(spark):
    base = spark.createDataFrame([("u", "0000000001", "yes", 2), ("u", "0000000002", "no", -1)],
                                 "customer_id string, article_id string, clicked string, sales_channel_id int")
    def flags(df):
        return [r.is_positive for r in evaluation.positive_flag(df).orderBy("article_id").collect()]
    assert flags(base) == [True, False]
    assert flags(base.drop("clicked")) == [True, False]
    assert flags(base.withColumn("label", F.lit("1"))) == [True, True]
    assert flags(base.drop("clicked", "sales_channel_id").withColumn("ground_truth_article_id", F.lit("2"))) == [False, True]
    with pytest.raises(ValueError):
        evaluation.positive_flag(base.select("customer_id", "article_id"))
