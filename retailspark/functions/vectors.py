"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def length(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(c), F.lit(0.0), lambda acc, x: acc + x * x))


def is_zero(c: Column | str) -> Column:
    return ~F.exists(_doubles(c), lambda x: x != 0.0)


def l2_normalize(c: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(
        _doubles(c),
        lambda v: let(length(v), lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))),
    )


def mean_vector(vectors: Column, dim: int) -> Column:
    """Element-wise mean of an array of equally long vectors; zeros when there are none."""
    zero = F.array_repeat(F.lit(0.0), dim)

    def mean(rows: Column) -> Column:
        total = F.aggregate(rows, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
        return let(F.greatest(F.size(rows), F.lit(1)), lambda n: F.transform(total, lambda x: x / n))

    return let(vectors, mean)


def combine_vectors(columns: Sequence[Column | str], dim: int) -> Column:
    """Mean of the normalized non-zero vectors, normalized again."""
    usable = F.filter(
        F.array(*[_doubles(c) for c in columns]), lambda v: v.isNotNull() & F.exists(v, lambda x: x != 0.0)
    )
    return l2_normalize(mean_vector(F.transform(usable, l2_normalize), dim))


def query_mode(text_vec: Column | str, image_vec: Column | str) -> Column:
    text, image = _col(text_vec).isNotNull(), _col(image_vec).isNotNull()
    return F.when(text & image, "hybrid").when(image, "image").otherwise("text")


def query_vector(text_vec: Column | str, image_vec: Column | str, dim: int) -> Column:
    text, image = _doubles(text_vec), _doubles(image_vec)
    zero = F.array_repeat(F.lit(0.0), dim)
    return (
        F.when(text.isNotNull() & image.isNotNull(), combine_vectors([text, image], dim))
        .when(image.isNotNull(), l2_normalize(image))
        .otherwise(F.coalesce(l2_normalize(text), zero))
    )


def fit_dimension(vectors: Column | str, dim: int) -> Column:
    """Unit vector of ``dim`` numbers from a list of vectors.

    Vectors that already have the right width are averaged; otherwise all numbers are
    strung together and cut or zero-padded.
    """
    rows = _col(vectors).cast("array<array<double>>")
    right_width = (F.size(rows) > 0) & F.forall(rows, lambda v: F.size(v) == dim)
    flat = F.flatten(rows)
    padded = F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.when(right_width, l2_normalize(mean_vector(rows, dim))).otherwise(
        F.coalesce(l2_normalize(padded), zero)
    )
