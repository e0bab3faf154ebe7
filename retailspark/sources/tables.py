"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS_SCHEMA = "t_dat string, customer_id string, article_id string, price string, sales_channel_id string"
CUSTOMERS_SCHEMA = "customer_id string, age string, fashion_news_frequency string, club_member_status string"


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Typed scan; CSV may be gzip-compressed and is matched to the header by name."""
    if fmt == "csv":
        names = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        header = spark.read.option("header", True).csv(path).columns
        known = {f.name: f for f in names.fields}
        missing = [n for n in known if n not in header]
        if missing:
            raise ValueError(f"{path} is missing columns: {missing}")
        # Every field of a text file arrives as text; ids keep their leading zeros.
        in_file_order = T.StructType(
            [known[n] if n in known else T.StructField(n, T.StringType()) for n in header]
        )
        df = spark.read.option("header", True).schema(in_file_order).csv(path)
        df = df.select(*known)
    elif fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def first_existing(
    spark: SparkSession,
    paths: Sequence[str],
    schema: str | T.StructType,
    fmt: str = "parquet",
    empty_if_missing: bool = False,
) -> DataFrame:
    for path in paths:
        if path_exists(spark, path):
            return read_table(spark, path, schema, fmt)
    if empty_if_missing:
        return spark.createDataFrame([], schema)
    raise FileNotFoundError(f"none of these exist: {list(paths)}")


def limit_rows(df: DataFrame, max_rows: int | None, order: Sequence[str]) -> DataFrame:
    """First rows in a fixed order; every row when no limit is set."""
    return df if max_rows is None else df.orderBy(*order).limit(max_rows)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", gzip: bool = False
) -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
        if gzip:
            writer = writer.option("compression", "gzip")
        writer.csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def profile_transactions(txn: DataFrame, approximate: bool = False) -> DataFrame:
    count_users = F.approx_count_distinct("customer_id") if approximate else F.count_distinct("customer_id")
    count_items = F.approx_count_distinct("article_id") if approximate else F.count_distinct("article_id")
    return txn.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("t_dat").alias("min_date"),
        F.max("t_dat").alias("max_date"),
        count_users.alias("unique_customers"),
        count_items.alias("unique_articles"),
    )


def month_number(day: str) -> Column:
    """1997-03-05 as 199703."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


#: Sketches of 2^16 registers err by about 0.4 %; small ones hold the values' hashes and are much smaller.
SKETCH_LOG = 16


def write_daily_sketches(txn: DataFrame, path: str) -> None:
    """Rows and distinct-value sketches of every day. Days of ``txn`` replace what the table holds of their months."""
    daily = txn.groupBy("t_dat").agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg("customer_id", F.lit(SKETCH_LOG)).alias("customers"),
        F.hll_sketch_agg("article_id", F.lit(SKETCH_LOG)).alias("articles"),
    )
    by_month = daily.withColumn("month", month_number("t_dat")).repartitionByRange("month")
    by_month.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def profile_of_sketches(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Profile of any range of days, or of each group of days, from their sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("total_rows"), F.min("t_dat").alias("min_date"), F.max("t_dat").alias("max_date"),
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers"),
        F.hll_sketch_estimate(F.hll_union_agg("articles")).alias("unique_articles"),
    )


def run_manifest(
    profile: DataFrame,
    train_rows: DataFrame,
    mode: str,
    outputs: dict[str, str],
    max_rows: int | None = None,
    segment_top_k: int = 50,
) -> DataFrame:
    """One row that says what a run read, with which limits, and where it wrote."""
    counted = train_rows.agg(F.count(F.lit(1)).alias("candidate_train_rows"))
    return profile.withColumn("one", F.lit(1)).join(counted.withColumn("one", F.lit(1)), "one").select(
        F.lit(mode).alias("mode"),
        F.lit(max_rows).cast("long").alias("max_transaction_rows"),
        F.lit(segment_top_k).alias("segment_top_k"),
        F.struct(*profile.columns).alias("transactions"),
        F.struct(*[F.lit(p).alias(n) for n, p in outputs.items()]).alias("outputs"),
        "candidate_train_rows",
    )


def save_embeddings(df: DataFrame, path: str) -> None:
    """Unit vectors with their item columns; the table itself is the search artifact."""
    from retailspark.functions.vectors import l2_normalize

    unit = df.withColumn("embedding", l2_normalize("embedding").cast("array<float>"))
    unit.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
