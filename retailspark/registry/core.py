"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.plans.staging import staged
from retailspark.sources.shop import DUCK_TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
PARTS: dict[str, str] = dict(DUCK_TABLES)
DIGITS = 9


def part(name: str, sql: str) -> None:
    """Name a piece of check SQL that others may use as a table."""
    PARTS[name] = sql


def _used(sql: str) -> list[str]:
    return [name for name in PARTS if re.search(rf"\b{name}\b", sql)]


def with_parts(sql: str) -> str:
    """Prefix the query with the named pieces it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for name in _used(text):
            if name not in inside and name not in ordered:
                visit(PARTS[name], (*inside, name))
                if name not in ordered:
                    ordered.append(name)

    visit(sql, ())
    pieces = ", ".join(f"{name} AS ({PARTS[name]})" for name in ordered)
    recursive = "RECURSIVE " if any(name in _used(PARTS[name]) for name in ordered) else ""
    return f"WITH {recursive}{pieces} {sql}" if pieces else sql


#: Mark of a column that holds rounded doubles already.
ROUNDED = {"rounded_digits": DIGITS}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded and marked so: a table that many rows look up is rounded once per own row, not once per joined row."""
    return df.withColumns({
        f.name: F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name, metadata=ROUNDED)
        for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    })


def flat(df: DataFrame) -> DataFrame:
    """Plain values only: dates and arrays as text, doubles rounded."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(kind, T.DoubleType) and field.metadata.get("rounded_digits") == DIGITS:
            pass
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        columns.append(c.alias(field.name))
    return df.select(*columns)


_tables: dict[tuple, DataFrame | str] = {}


def shared(name: str, spark: SparkSession, folder: str, build: Query) -> DataFrame:
    """A derived table that many queries start from, computed and staged once per session."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _tables:
        _tables[key] = staged(build(spark, folder), name)
    return _tables[key]


def shared_if_built(name: str, spark: SparkSession, folder: str) -> DataFrame | None:
    """A derived table that an earlier query of the session has staged."""
    return _tables.get((spark.sparkContext.applicationId, folder, name))


def shared_path(name: str, spark: SparkSession, folder: str, build: Callable[[SparkSession, str], str]) -> str:
    """A folder of tables that some queries start from, written once per session."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _tables:
        _tables[key] = build(spark, folder)
    return _tables[key]


def forget_shared() -> None:
    """Make the next queries compute their derived tables anew."""
    _tables.clear()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: flat(build(spark, folder))
        if sql is not None:
            CHECKS[name] = with_parts(sql)
        return build

    return register
