"""Ranking metrics of one list against one set of relevant items, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _top(ranked: Column | str, k: int) -> Column:
    return F.slice(_col(ranked), 1, max(k, 1))


def recall_at_k(ranked: Column | str, relevant: Column | str, k: int) -> Column:
    truth = F.array_distinct(_col(relevant))
    hits = F.size(F.filter(_top(ranked, k), lambda x: F.array_contains(truth, x)))
    return F.when((F.size(truth) > 0) & F.lit(k > 0), hits / F.size(truth)).otherwise(0.0)


def hit_rate_at_k(ranked: Column | str, relevant: Column | str, k: int) -> Column:
    found = F.arrays_overlap(_top(ranked, k), _col(relevant))
    return F.when(found & F.lit(k > 0), 1.0).otherwise(0.0)


def reciprocal_rank(ranked: Column | str, relevant: Column | str, k: int | None = None) -> Column:
    truth = _col(relevant)
    marks = F.transform(_col(ranked), lambda x: F.array_contains(truth, x))
    first = F.array_position(marks, F.lit(True))
    return F.when(first > 0, 1.0 / first).otherwise(0.0)


def discount(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position.cast("double") + 1)


def dcg_at_k(ranked: Column | str, relevant: Column | str, k: int) -> Column:
    truth = _col(relevant)
    gains = F.transform(
        _top(ranked, k),
        lambda x, i: F.when(F.array_contains(truth, x), discount(i + 1)).otherwise(0.0),
    )
    total = F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)
    return F.when(F.lit(k > 0), total).otherwise(0.0)


def ideal_dcg(relevant_count: Column, k: int) -> Column:
    """Gain of a list that starts with every relevant item."""
    hits = F.least(relevant_count.cast("int"), F.lit(k))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), F.lit(0.0), lambda acc, i: acc + discount(i)
    )
    return F.when(hits > 0, total).otherwise(0.0)


def idcg_at_k(relevant: Column | str, k: int) -> Column:
    return ideal_dcg(F.size(F.array_distinct(_col(relevant))), k)


def ndcg_at_k(ranked: Column | str, relevant: Column | str, k: int) -> Column:
    ideal = idcg_at_k(relevant, k)
    return F.when(ideal > 0, dcg_at_k(ranked, relevant, k) / ideal).otherwise(0.0)


METRICS: dict[str, Callable[..., Column]] = {
    "recall": recall_at_k,
    "hit_rate": hit_rate_at_k,
    "reciprocal_rank": reciprocal_rank,
    "dcg": dcg_at_k,
    "ndcg": ndcg_at_k,
}


def metric_scores(lists: DataFrame, metric: str, k: int) -> DataFrame:
    """One score per ranked list."""
    score = METRICS[metric]("ranked_items", "relevant_items", k)
    return lists.select("query_id", score.alias("score"))


def mean_metric(lists: DataFrame, metric: str, k: int) -> DataFrame:
    """Mean score over all lists; 0 when there are none."""
    return metric_scores(lists, metric, k).agg(
        F.count(F.lit(1)).alias("lists"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score")
    )
