"""User and item totals kept up to date from new purchases alone.

A state folder holds, per entity, two kinds of tables:

* ``days``: sums per key and day, in folders by month and by the batch that brought them. A batch that is
  replayed overwrites its own folders and no others.
* ``totals``: one row per key after each batch, with purchases and spend of the last 7, 30 and 90 days.

A new batch is summed by itself and added to the totals. A window moves by adding the batch's days inside it and
taking off the days that have left it, which are read from their months only. A row of ``commits``, written last, makes a
batch count: what an interrupted run left behind is overwritten when the batch comes again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators.features import WINDOW_DAYS
from retailspark.sources.tables import month_number, path_exists

COMMITS = "batch_id bigint, last_day date"
SUMS = ("purchases", "spend", "channel_1_count", "channel_2_count")
MONEY = "decimal(28,2)"


def last_commit(spark: SparkSession, path: str) -> tuple[int, dt.date | None]:
    """Number and last day of the newest batch that counts; 0 and none at the start."""
    if not path_exists(spark, f"{path}/commits"):
        return 0, None
    row = spark.read.schema(COMMITS).parquet(f"{path}/commits").orderBy(F.desc("batch_id")).limit(1).first()
    return (row["batch_id"], row["last_day"]) if row else (0, None)


def day_sums(rows: DataFrame, key: str) -> DataFrame:
    """Sums per key and day."""
    money = F.col("price").cast("decimal(18,2)")
    return rows.groupBy(key, "t_dat").agg(
        F.count(F.lit(1)).alias("purchases"), F.sum(money).cast(MONEY).alias("spend"),
        F.count_if(F.col("sales_channel_id") == 1).alias("channel_1_count"),
        F.count_if(F.col("sales_channel_id") == 2).alias("channel_2_count"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )


def dated_sums(rows: DataFrame, key: str) -> DataFrame:
    """The same with their month; the rows move once, to ranges of days, where they are summed and can be written by month."""
    ranged = rows.select(key, "t_dat", "price", "sales_channel_id").repartitionByRange("t_dat", key)
    return day_sums(ranged, key).withColumn("month", month_number("t_dat"))


def _months(first: dt.date, end: dt.date) -> list[int]:
    """Months that overlap the days from ``first`` up to but without ``end``."""
    out, month = [], first.replace(day=1)
    while month < end:
        out.append(month.year * 100 + month.month)
        month = (month + dt.timedelta(days=32)).replace(day=1)
    return out


def expired_sums(days: DataFrame, key: str, before: dt.date, now: dt.date, windows: Sequence[int]) -> DataFrame:
    """Per key, what leaves each window when its end moves from one day to another."""
    ranges = {n: (before - dt.timedelta(days=n - 1), now - dt.timedelta(days=n - 1)) for n in windows}
    months = sorted({m for first, end in ranges.values() for m in _months(first, end)})

    def left(n: int) -> Column:
        return (F.col("t_dat") >= F.lit(ranges[n][0])) & (F.col("t_dat") < F.lit(ranges[n][1]))

    some = days.where(F.col("month").isin(months)) if months else days.where(F.lit(False))
    return some.groupBy(key).agg(*[
        F.sum(F.when(left(n), F.col(name))).alias(f"{name}_{n}") for n in windows for name in ("purchases", "spend")
    ])


def append_purchases(
    spark: SparkSession, path: str, rows: DataFrame, batch_id: int, last_day: dt.date, keys: Sequence[str] = ("customer_id", "article_id"),
    windows: Sequence[int] = WINDOW_DAYS,
) -> None:
    """Add one batch of purchases. Batches are numbered from 1; one that counts already is left alone.

    ``last_day`` ends the windows; it never moves back. Purchases may be of any earlier day, those already summed included.
    """
    done, before = last_commit(spark, path)
    if batch_id <= done:
        return
    if batch_id != done + 1:
        raise ValueError(f"batch {batch_id} after batch {done}")
    now = max(last_day, before) if before else last_day
    for key in keys:
        dated = dated_sums(rows, key).withColumn("batch", F.lit(batch_id))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(
            f"{path}/{key}/days"
        )
        own = spark.read.schema(dated.schema).parquet(f"{path}/{key}/days").where(F.col("batch") == batch_id)
        added = own.groupBy(key).agg(
            *[F.sum(n).alias(n) for n in SUMS], F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
            F.min("t_dat").alias("first_day"), F.max("t_dat").alias("newest_day"),
            *[F.coalesce(F.sum(F.when(F.col("t_dat") >= F.lit(now - dt.timedelta(days=n - 1)), F.col(name))), F.lit(0)).alias(f"{name}_{n}")
              for n in windows for name in ("purchases", "spend")],
        )
        parts = [added]
        if before is not None:
            parts.append(spark.read.parquet(f"{path}/{key}/totals/batch={done}").drop("batch"))
            if now > before:
                # Earlier batches only: the windows have not held this batch's days yet.
                days = spark.read.parquet(f"{path}/{key}/days").where(F.col("batch") < batch_id)
                gone = expired_sums(days, key, before, now, windows)
                parts.append(gone.select(key, *[
                    (-F.col(f"{name}_{n}")).alias(f"{name}_{n}") for n in windows for name in ("purchases", "spend")
                ]))
        everything = parts[0]
        for part in parts[1:]:
            everything = everything.unionByName(part, allowMissingColumns=True)
        totals = everything.groupBy(key).agg(
            F.sum("purchases").alias("purchases"), F.sum("spend").cast(MONEY).alias("spend"),
            *[F.sum(n).alias(n) for n in SUMS[2:]],
            F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
            F.min("first_day").alias("first_day"), F.max("newest_day").alias("newest_day"),
            *[F.coalesce(F.sum(f"purchases_{n}"), F.lit(0)).cast("long").alias(f"purchases_{n}") for n in windows],
            *[F.coalesce(F.sum(f"spend_{n}"), F.lit(0)).cast(MONEY).alias(f"spend_{n}") for n in windows],
        )
        totals.write.mode("overwrite").parquet(f"{path}/{key}/totals/batch={batch_id}")
    spark.createDataFrame([(batch_id, now)], COMMITS).write.mode("append").parquet(f"{path}/commits")


def kept_totals(spark: SparkSession, path: str, key: str, windows: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """Totals and windows after the newest batch, named like those of a whole recomputation."""
    done, _ = last_commit(spark, path)
    totals = spark.read.parquet(f"{path}/{key}/totals/batch={done}")
    return totals.select(
        key, F.col("purchases").alias("purchase_count"), F.col("spend").cast("double").alias("total_spend"), "min_price", "max_price",
        F.col("first_day").alias("first_purchase_date"), F.col("newest_day").alias("last_purchase_date"),
        "channel_1_count", "channel_2_count",
        *[F.col(f"purchases_{n}").alias(f"purchase_count_{n}d") for n in windows],
        *[F.col(f"spend_{n}").cast("double").alias(f"spend_{n}d") for n in windows],
    )
