"""Exact quantiles whose single-task work stays small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
CUT_DIGITS = 9


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], fractions: Sequence[float]
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles of the non-null values of each column.

    A bounded sketch first brackets each quantile, and the exact aggregate only sees the
    values inside the bracket. Cuts are rounded so that every engine compares alike.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    margin = 2.0 / ACCURACY
    edges = [e for f in fractions for e in (max(f - margin, 0.0), min(f + margin, 1.0))]
    first = values.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.percentile_approx(c, edges, ACCURACY).alias(f"edges_{c}") for c in columns],
    ).first()
    present = [c for c in columns if first[f"n_{c}"] > 0]
    if not present:
        return {c: None for c in columns}

    wanted: dict[str, list[tuple[float, float, float]]] = {}
    brackets = {c: [(first[f"edges_{c}"][2 * i], first[f"edges_{c}"][2 * i + 1]) for i in range(len(fractions))]
                for c in present}
    counted = values.agg(*[
        expr
        for c in present
        for i, (low, high) in enumerate(brackets[c])
        for expr in (
            F.count_if(F.col(c) < low).alias(f"below_{c}_{i}"),
            F.count_if(F.col(c).between(low, high)).alias(f"inside_{c}_{i}"),
        )
    ]).first()
    for c in present:
        wanted[c] = []
        for i, f in enumerate(fractions):
            rank = f * (first[f"n_{c}"] - 1) - counted[f"below_{c}_{i}"]
            last = max(counted[f"inside_{c}_{i}"] - 1, 1)
            wanted[c].append((*brackets[c][i], min(max(rank / last, 0.0), 1.0)))

    cuts = values.agg(*[
        F.percentile(F.when(F.col(c).between(low, high), F.col(c)), f).alias(f"cut_{c}_{i}")
        for c in present
        for i, (low, high, f) in enumerate(wanted[c])
    ]).first()
    return {
        c: [round(cuts[f"cut_{c}_{i}"], CUT_DIGITS) for i in range(len(fractions))] if c in present else None
        for c in columns
    }
