"""Joins and positions that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.plans.staging import staged

MAX_SALTS = 4096
HOT_KEYS = 1024
SKETCH_ITEMS = 16384
_NESTED = ("array", "map", "struct", "variant")


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's upper estimate of the frame's size; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    return limit_bytes > 0 and estimated_bytes(df) <= limit_bytes


_found: dict[tuple, dict[int, int]] = {}


def shuffle_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def forget_hot_keys() -> None:
    _found.clear()


def hot_keys(df: DataFrame, on: Sequence[str], parts: int | None = None) -> dict[int, int]:
    """Hashes of the join keys that hold more than one task's share of the rows, with the pieces to cut them into.

    With ``parts`` tasks, a key is hot from a share of 1 / parts on and is cut into share x parts pieces,
    so a piece holds about as much as a task without it. A frequent-items sketch finds the keys in one
    pass over the key columns without shuffling them; at most ``HOT_KEYS`` numbers reach the driver. A
    key missed or reported by mistake only changes how rows are spread, never the result.
    """
    parts = parts or shuffle_parts(df)
    memo = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(on), parts)
    if memo not in _found:
        row = df.select(F.xxhash64(*on).alias("key_hash")).agg(
            F.expr(f"approx_top_k(key_hash, {HOT_KEYS}, {SKETCH_ITEMS})").alias("top"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        _found[memo] = {
            t["item"]: min(math.ceil(t["count"] * parts / row["n"]) + 1, MAX_SALTS)
            for t in row["top"] or [] if t["count"] * parts >= row["n"]
        }
    return _found[memo]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    hot: dict[int, int],
) -> DataFrame:
    """Join a large ``left`` to ``right``, cutting each hot left key into its number of pieces.

    Only rows of ``right`` with a hot key are repeated, once per piece.
    """
    on = list(on)
    known = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
    salts = F.coalesce(known[F.xxhash64(*on)], F.lit(1))
    flat = [f.name for f in left.schema.fields if not f.dataType.typeName().startswith(_NESTED)]
    return (
        left.withColumn("salt", F.pmod(F.xxhash64(*flat), salts).cast("int"))
        .join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), [*on, "salt"], how)
        .drop("salt")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    hot_source: DataFrame | None = None,
) -> DataFrame:
    """Join a large frame to a lookup table.

    The lookup is broadcast only when the optimizer's size estimate is under the
    session's broadcast limit; otherwise both sides shuffle. ``hot_source`` is a cheap
    frame with the key distribution of ``left``: keys that are frequent there are salted.
    Without it the keys of ``left`` are taken to be spread evenly.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(right):
        return left.join(F.broadcast(right), on, how)
    hot = hot_keys(hot_source, on) if hot_source is not None else {}
    return salted_join(left, right, on, how, hot) if hot else left.join(right, on, how)


def ordered_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None = None,
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Exact 1-based position inside each key without sorting a whole key in one task.

    Rows are cut into ranges of (key, order), as many as the session shuffles into and of like
    size whatever the values look like; equal orders are cut only if ``order`` tells them apart.
    Rows are numbered inside (key, range); the sizes of earlier ranges are added. The ranges are
    staged, so both passes see the same ones. A ``bucket`` that grows with ``order`` and is known to be even,
    such as a part of a hash, saves the staging. ``total`` names a column for the key's row count.
    """
    keys = list(keys)
    if bucket is None:
        ranges = df.repartitionByRange(*keys, *order).withColumn("pos_bucket", F.spark_partition_id())
        cut = staged(ranges, "ranges")
    else:
        cut = df.withColumn("pos_bucket", bucket)
    sizes = cut.groupBy(*keys, "pos_bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    before = Window.partitionBy(*keys).orderBy("pos_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        "pos_bucket",
        F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("bucket_start"),
        *([F.sum("bucket_rows").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "pos_bucket").orderBy(*order)
    return (
        cut.withColumn("bucket_pos", F.row_number().over(inside))
        .join(starts, [*keys, "pos_bucket"])
        .withColumn(name, (F.col("bucket_start") + F.col("bucket_pos")).cast("long"))
        .drop("pos_bucket", "bucket_pos", "bucket_start")
    )


def ordered_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str, name: str = "upto") -> DataFrame:
    """Running sum of ``amount`` inside each key, the own row included, in ranges like ``ordered_position``."""
    keys = list(keys)
    cut = staged(df.repartitionByRange(*keys, *order).withColumn("pos_bucket", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("pos_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "pos_bucket").agg(F.sum(amount).alias("bucket_sum")).select(
        *keys, "pos_bucket", F.coalesce(F.sum("bucket_sum").over(before), F.lit(0)).alias("bucket_start")
    )
    inside = Window.partitionBy(*keys, "pos_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("bucket_upto", F.sum(amount).over(inside)).join(starts, [*keys, "pos_bucket"]).withColumn(
        name, F.col("bucket_start") + F.col("bucket_upto")
    ).drop("pos_bucket", "bucket_upto", "bucket_start")


RANGE_STEP = 4096


def explode_range(df: DataFrame, count: Column, name: str, spread_by: Sequence[str] = ()) -> DataFrame:
    """Repeat each row with the numbers 0 .. count - 1, in steps so that no array grows large.

    With ``spread_by`` the steps are dealt to all tasks by these columns first: a few rows that become very many, or one row that
    does, would else be repeated in the tasks that read them.
    """
    steps = F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / F.lit(RANGE_STEP)))
    chunked = df.withColumn("range_end", count.cast("long")).where("range_end > 0").withColumn(
        "range_step", F.explode(steps)
    )
    if spread_by:
        chunked = chunked.repartition(shuffle_parts(df), *spread_by, "range_step")
    start = F.col("range_step") * RANGE_STEP
    return chunked.withColumn(
        name, F.explode(F.sequence(start, F.least(start + RANGE_STEP, F.col("range_end")) - 1))
    ).drop("range_end", "range_step")
