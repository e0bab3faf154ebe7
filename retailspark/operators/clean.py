"""Cleaned customer and article tables and their quality counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.sources.tables import require_columns

# Column names of the raw and cleaned tables.
ARTICLE_TEXT = (
    "prod_name", "product_type_name", "product_group_name", "colour_group_name",
    "perceived_colour_master_name", "department_name", "section_name", "garment_group_name",
)
ARTICLE_COLUMNS = ("article_id", *ARTICLE_TEXT, "category", "main_category", "color")
CUSTOMER_COLUMNS = ("customer_id", "age", "age_bucket", "fashion_news_frequency", "club_member_status")


def clean_customers(raw: DataFrame) -> DataFrame:
    require_columns(raw, ["customer_id", "age", "fashion_news_frequency", "club_member_status"], "customers")
    cleaned = raw.select(
        c.strip("customer_id").alias("customer_id"),
        c.parse_age("age").alias("age"),
        c.normalize_news_frequency("fashion_news_frequency").alias("fashion_news_frequency"),
        c.normalize_member_status("club_member_status").alias("club_member_status"),
    ).where(F.col("customer_id") != "")
    return cleaned.withColumn("age_bucket", c.age_bucket("age")).select(*CUSTOMER_COLUMNS)


def clean_articles(raw: DataFrame) -> DataFrame:
    require_columns(raw, ["article_id", *ARTICLE_TEXT, "index_name", "index_group_name"], "articles")
    return raw.select(
        c.strip("article_id").alias("article_id"),
        *[c.normalize_text(name).alias(name) for name in ARTICLE_TEXT],
        c.first_known(*c.CATEGORY_FIELDS).alias("category"),
        c.first_known(*c.MAIN_CATEGORY_FIELDS).alias("main_category"),
        c.first_known(*c.COLOR_FIELDS).alias("color"),
    ).where(F.col("article_id") != "")


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def customer_counters() -> list[Column]:
    blank = F.coalesce(c.strip("customer_id"), F.lit("")) == ""
    return [
        F.count(F.lit(1)).alias("rows_read"),
        _count_if(~blank, "rows_written"),
        _count_if(blank, "blank_ids"),
        _count_if(~blank & (c.parse_age("age") < 0), "unknown_ages"),
    ]


def article_counters() -> list[Column]:
    blank = F.coalesce(c.strip("article_id"), F.lit("")) == ""
    unknown = F.lit(c.UNKNOWN)
    return [
        F.count(F.lit(1)).alias("rows_read"),
        _count_if(~blank, "rows_written"),
        _count_if(blank, "blank_ids"),
        _count_if(~blank & (c.first_known(*c.CATEGORY_FIELDS) == unknown), "unknown_categories"),
        _count_if(~blank & (c.first_known(*c.MAIN_CATEGORY_FIELDS) == unknown), "unknown_main_categories"),
        _count_if(~blank & (c.first_known(*c.COLOR_FIELDS) == unknown), "unknown_colors"),
    ]


def transaction_counters() -> list[Column]:
    """Rows read, skipped for a blank article, skipped for a bad date, and kept."""
    blank = F.coalesce(c.strip("article_id"), F.lit("")) == ""
    bad_date = c.parse_date("t_dat").isNull()
    return [
        F.count(F.lit(1)).alias("rows_scanned"),
        _count_if(blank, "missing_article_rows"),
        _count_if(~blank & bad_date, "invalid_date_rows"),
        _count_if(~blank & ~bad_date, "rows_aggregated"),
    ]


def customer_quality(raw: DataFrame) -> DataFrame:
    return raw.agg(*customer_counters())


def article_quality(raw: DataFrame) -> DataFrame:
    return raw.agg(*article_counters())


def transaction_quality(raw: DataFrame) -> DataFrame:
    return raw.agg(*transaction_counters())


def write_counted(
    raw: DataFrame, clean: Callable[[DataFrame], DataFrame], counters: list[Column], path: str, name: str = "quality"
) -> DataFrame:
    """Clean and write a raw table; its counters are observed by the same scan. One row of counters.

    They count the raw rows that pass by: if a task is repeated, only its rows of the attempt that counts are in them.
    """
    seen = Observation(name)
    clean(raw.observe(seen, *counters)).write.mode("overwrite").parquet(path)
    fields = ", ".join(f"{n} bigint" for n in seen.get)
    return raw.sparkSession.createDataFrame([tuple(seen.get.values())], fields)
