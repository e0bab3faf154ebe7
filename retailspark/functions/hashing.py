"""Repeatable random draws from md5, the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_DIGITS = 15
DRAW_RANGE = 16 ** DRAW_DIGITS


def draw(*parts: Column | str | int) -> Column:
    """Whole number in [0, 16^15) from the parts joined by a colon."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("long")


def draw_fraction(*parts: Column | str | int) -> Column:
    return draw(*parts) / F.lit(float(DRAW_RANGE))


def draw_below(limit: Column | int, *parts: Column | str | int) -> Column:
    return F.pmod(draw(*parts), limit if isinstance(limit, Column) else F.lit(limit))
