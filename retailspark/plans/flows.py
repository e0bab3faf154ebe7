"""Whole jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.operators import candidates, clean, evaluation, features, joins, ranking, rerank, windows
from retailspark.plans.staging import staged


def candidate_tables(
    txn: DataFrame,
    customers_raw: DataFrame,
    articles_raw: DataFrame,
    segment_top_k: int = 50,
) -> dict[str, DataFrame]:
    """Feature tables, segment lists and the joined training set of one run.

    The enriched purchases are staged, so that each table below scans them instead of
    joining again.
    """
    customers, articles = clean.clean_customers(customers_raw), clean.clean_articles(articles_raw)
    last = features.last_day(txn)
    enriched = staged(joins.enrich_transactions(txn, articles, customers, "inner"), "enriched")
    users = features.user_features(enriched, customers, last)
    items = features.item_features_rich(enriched, articles, last)
    rows = features.interactions(enriched, last)
    return {
        "customers": customers,
        "articles": articles,
        "interactions": rows,
        "user_features": users,
        "item_features": items,
        "segment_candidates": windows.segment_top_items(items, segment_top_k),
        "candidate_train": joins.candidate_train(rows, users, items),
    }


def recommend_all(
    sessions: DataFrame,
    catalog: DataFrame,
    customers: DataFrame,
    model_path: str | None,
    n: int = 10,
    seed: int = 42,
    max_clicks: int | None = None,
) -> DataFrame:
    """Candidates, ranking and re-ranking for every user in one job.

    Without a saved model the popularity order takes its place.
    """
    spark = sessions.sparkSession
    catalog = staged(catalog, "catalog")
    pool = staged(candidates.generate_candidates(sessions, catalog, top_k=n, max_clicks=max_clicks), "pool")
    described = candidates.describe_candidates(pool, catalog)
    if model_path and ranking.ranker_exists(spark, model_path):
        model, numeric, text = ranking.load_ranker(spark, model_path)
        scored = ranking.reason_label(
            ranking.score_candidates(joins.ranking_features(described, customers), model, numeric, text)
        )
    else:
        scored = ranking.popularity_fallback(described)
    return rerank.rerank(scored, n, seed=seed)


def full_report(
    rows: DataFrame,
    sessions: DataFrame,
    catalog: DataFrame,
    customers: DataFrame,
    model_path: str,
    top_k: int = 50,
    candidate_k: int = 300,
    max_users: int | None = None,
) -> DataFrame:
    """Candidate, ranking, recommender and popularity metrics as one nested record."""
    spark = rows.sparkSession
    catalog = staged(catalog, "catalog")
    enriched = staged(joins.enrich_candidates(evaluation.positive_flag(rows), catalog), "report_rows")
    context = evaluation.evaluation_context(enriched, max_users)
    truth, users = staged(context["truth"], "report_truth"), staged(context["users"], "report_users")
    model, numeric, text = ranking.load_ranker(spark, model_path)
    scored = staged(ranking.score_candidates(context["rows"], model, numeric, text), "report_scores")
    recommended = rerank.rerank(scored.withColumn("reason", F.lit("ranking_score")), top_k).select(
        "customer_id", F.col("product_id").alias("article_id"), "position"
    )
    items = context["item_count"]
    return evaluation.baseline_report(
        features.dataset_metadata(enriched),
        evaluation.evaluate_candidates(sessions, catalog, truth, users, candidate_k),
        evaluation.ranking_summary(scored, truth, users, top_k),
        evaluation.evaluate_lists(staged(recommended, "recommended"), truth, users, customers, items, top_k),
        evaluation.evaluate_popularity(context["rows"], truth, users, customers, items, top_k),
        top_k, candidate_k, max_users,
    )
