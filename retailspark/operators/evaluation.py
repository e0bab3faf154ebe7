"""Offline evaluation of candidates, rankings and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.operators import candidates as cand
from retailspark.operators import metrics, sampling, windows
from retailspark.operators.features import ground_truth, popularity_counts
from retailspark.operators.joins import cold_start_users
from retailspark.plans.skew import lookup_join, ordered_position
from retailspark.plans.staging import staged
from retailspark.sources.tables import require_columns

FLAG_COLUMNS = ("is_positive", "target", "clicked", "purchased")
FLAG_WORDS = ("1", "true", "yes")


def positive_flag(df: DataFrame) -> DataFrame:
    """Mark positive rows by the first convention the columns allow."""
    names = df.columns
    if "label" in names:
        flag = c.safe_numeric("label") == 1
    elif any(n in names for n in FLAG_COLUMNS):
        column = next(n for n in FLAG_COLUMNS if n in names)
        flag = F.lower(F.col(column).cast("string")).isin(*FLAG_WORDS)
    elif "ground_truth_article_id" in names:
        flag = F.col("article_id") == c.normalize_article_id("ground_truth_article_id")
    elif "sales_channel_id" in names:
        flag = F.coalesce(F.col("sales_channel_id").cast("string").try_cast("double"), F.lit(-1.0)) != -1
    else:
        raise ValueError(
            "no positive rows can be told: expected label, is_positive, target, clicked, purchased, "
            "ground_truth_article_id or sales_channel_id"
        )
    return df.withColumn("is_positive", F.coalesce(flag, F.lit(False)))


def session_context(df: DataFrame, order: list[str]) -> DataFrame:
    """Per user the first given click list and session interest."""
    place = F.struct(*order)

    def first(name: str) -> Column:
        if name not in df.columns:
            return F.first(F.lit(None).cast("string"))
        return F.min_by(name, F.when(F.col(name).isNotNull(), place))

    return df.groupBy("customer_id").agg(
        first("recent_clicks").alias("clicks"), first("session_interest").alias("interest")
    ).select(
        "customer_id",
        F.coalesce(
            F.transform(
                F.filter(F.split("clicks", ","), lambda x: c.strip(x) != ""), c.normalize_article_id
            ),
            F.array().cast("array<string>"),
        ).alias("recent_clicks"),
        c.parse_interest("interest").alias("session_interest"),
    )


def evaluation_context(df: DataFrame, max_users: int | None = None, seed: int = 42) -> dict[str, DataFrame | Column]:
    """Truth, evaluated users, their rows and the number of distinct items."""
    flagged = positive_flag(df)
    truth = ground_truth(flagged)
    users = sampling.stable_user_sample(truth, max_users, seed)
    return {
        "truth": truth.join(users, "customer_id", "left_semi") if max_users is not None else truth,
        "users": users,
        "rows": flagged.join(users, "customer_id", "left_semi"),
        "item_count": df.agg(F.count_distinct("article_id").alias("items")).scalar(),
    }


def evaluate_candidates(sessions: DataFrame, catalog: DataFrame, truth: DataFrame, users: DataFrame, k: int,
                        pool: int | None = None) -> DataFrame:
    """Recall@k of the generated candidates; users without a session are cold."""
    empty = F.array().cast("array<string>")
    inputs = users.select("customer_id").join(sessions, "customer_id", "left").select(
        "customer_id", F.coalesce("recent_clicks", empty).alias("recent_clicks"), "session_interest"
    )
    lists = cand.generate_candidates(inputs, catalog, top_k=k, pool=pool)
    ranked = lists.select("customer_id", "article_id", F.col("candidate_rank").alias("position"))
    return metrics.mean_scores(metrics.user_scores(ranked, truth, users, k)).select("users_evaluated", "recall")


def retrieval_lift(embedding_recall: DataFrame, candidate_recall: DataFrame) -> DataFrame:
    """Recall of embedding retrieval, of generated candidates, and their difference."""
    left = embedding_recall.select(F.lit(1).alias("one"), F.col("recall").alias("embedding_recall"))
    right = candidate_recall.select(F.lit(1).alias("one"), F.col("recall").alias("candidate_recall"))
    return left.join(right, "one").select(
        "embedding_recall", "candidate_recall", (F.col("embedding_recall") - F.col("candidate_recall")).alias("lift")
    )


def ranking_summary(scored: DataFrame, truth: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Rows, users, AUC, hit rate and nDCG of scored rows."""
    ranked = windows.score_ranking(scored.select("customer_id", "article_id", "score"), k)
    means = metrics.mean_scores(metrics.user_scores(ranked, truth, users, k))
    auc = metrics.roc_auc(scored.withColumn("y", F.col("is_positive").cast("int")), "y", "score").scalar()
    rows = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return means.select(
        rows.alias("rows_evaluated"), "users_evaluated", auc.alias("auc"), "hit_rate", "ndcg"
    )


def evaluate_lists(
    ranked: DataFrame, truth: DataFrame, users: DataFrame, customers: DataFrame, item_count: Column, k: int
) -> DataFrame:
    """Hit rate, nDCG and coverage for all users and for those without a customer row, from one scoring of the lists."""
    cold = cold_start_users(users, customers).withColumn("is_cold", F.lit(True))
    flagged = users.select("customer_id").join(cold, "customer_id", "left").withColumn(
        "is_cold", F.coalesce("is_cold", F.lit(False))
    )
    scores = metrics.user_scores(ranked, truth, users, k).join(flagged, "customer_id")
    shown = ranked.where(F.col("position") <= k).join(flagged, "customer_id").groupBy("article_id").agg(
        F.bool_or("is_cold").alias("is_cold")
    )
    subsets = {"all": F.lit(True), "cold_start": F.col("is_cold")}
    means = scores.agg(*[
        x.alias(f"{name}_{subset}") for subset, kept in subsets.items() for name, x in (
            ("users", F.count_if(kept)), *((n, F.coalesce(F.avg(F.when(kept, F.col(n))), F.lit(0.0))) for n in ("hit_rate", "ndcg"))
        )
    ])
    covered = shown.agg(*[F.count_if(kept).alias(f"items_{subset}") for subset, kept in subsets.items()])
    both = means.withColumn("one", F.lit(1)).join(covered.withColumn("one", F.lit(1)), "one")
    rows = F.array(*[F.struct(
        F.col(f"users_{s}").alias("users_evaluated"), F.col(f"hit_rate_{s}").alias("hit_rate"), F.col(f"ndcg_{s}").alias("ndcg"),
        F.when(item_count > 0, F.col(f"items_{s}") / item_count).otherwise(0.0).alias("coverage"), F.lit(s).alias("subset"),
    ) for s in subsets])
    return both.select(F.explode(rows).alias("r")).select("r.*")


def evaluate_popularity(rows: DataFrame, truth: DataFrame, users: DataFrame, customers: DataFrame,
                        item_count: Column, k: int) -> DataFrame:
    ranked = windows.popularity_top_k(rows.select("customer_id", "article_id", "popularity"), k)
    lists = staged(ranked.select("customer_id", "article_id", "position"), "popularity_lists")
    return evaluate_lists(lists, truth, users, customers, item_count, k)


def comparison(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of the metrics, subset by subset."""
    names = ("hit_rate", "ndcg", "coverage")
    other = baseline.select("subset", *[F.col(n).alias(f"baseline_{n}") for n in names])
    return current.join(other, "subset").select(
        "subset", *[(F.col(n) - F.col(f"baseline_{n}")).alias(f"{n}_change") for n in names]
    )


def evaluate_metadata_baseline(txn: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """Hold out each user's last item and score the metadata and popularity lists."""
    history = staged(windows.leave_last_out(windows.purchase_sequence(txn)), "history")
    counted = popularity_counts(history, articles.select("article_id"))
    recs = cand.metadata_popularity_recs(history, articles, counted, k)
    targets = history.groupBy("customer_id").agg(F.first("target_article_id").alias("article_id"))
    known = lookup_join(targets, articles.select("article_id"), "article_id", "left_semi", hot_source=targets)
    scores = metrics.user_scores(recs, known, known, k)
    return metrics.mean_scores(scores).select("users_evaluated", "hit_rate", "reciprocal_rank", "ndcg")


def read_ranking_lists(df: DataFrame) -> DataFrame:
    """Ranked and relevant items as arrays; a query id from the text order when there is none."""
    require_columns(df, ["ranked_items", "relevant_items"], "ranking lists")
    if "query_id" not in df.columns:
        order = [F.col("ranked_items"), F.col("relevant_items")]
        df = ordered_position(df, [], order, name="query_no")
        df = df.withColumn("query_id", F.col("query_no").cast("string")).drop("query_no")
    return df.select(
        "query_id",
        c.parse_item_list("ranked_items").alias("ranked_items"),
        c.parse_item_list("relevant_items").alias("relevant_items"),
    )


def baseline_report(metadata: DataFrame, candidate: DataFrame, ranking: DataFrame, current: DataFrame,
                    popularity: DataFrame, top_k: int, candidate_k: int, max_users: int | None) -> DataFrame:
    """One nested record from the one-row results."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(1).alias("one"), F.struct(*df.columns).alias(name))

    def by_subset(df: DataFrame, name: str) -> DataFrame:
        values = [x for x in df.columns if x != "subset"]
        return df.groupBy(F.lit(1).alias("one")).agg(
            *[F.max(F.when(F.col("subset") == "all", F.col(v))).alias(v) for v in values],
            F.struct(*[F.max(F.when(F.col("subset") == "cold_start", F.col(v))).alias(v) for v in values])
            .alias("cold_start_subset"),
        ).select("one", F.struct(*values, "cold_start_subset").alias(name))

    facts = metadata.withColumns({
        "top_k": F.lit(top_k), "candidate_k": F.lit(candidate_k), "max_users": F.lit(max_users).cast("int"),
    })
    out = whole(facts, "metadata")
    for part in (whole(candidate, "candidate"), whole(ranking, "ranking"),
                 by_subset(current, "current_model"), by_subset(popularity, "popularity_baseline")):
        out = out.join(part, "one")
    change = F.struct(*[
        (F.col(f"current_model.{n}") - F.col(f"popularity_baseline.{n}")).alias(n) for n in ("hit_rate", "ndcg", "coverage")
    ])
    return out.select(
        "metadata", "candidate", "ranking",
        F.struct("current_model", "popularity_baseline", change.alias("improvement_vs_popularity")).alias("recommendation"),
    )
