"""User, item and interaction feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.plans.quantiles import exact_quantiles
from retailspark.plans.staging import staged

WINDOW_DAYS = (7, 30, 90)
BAND_FRACTIONS = (0.33, 0.66)
NEW_ITEM_DAYS = 7
PURCHASE_STRENGTH = 3
PRICE_BANDS = ("budget", "mid", "premium")
ACTIVITY_SEGMENTS = ("light", "medium", "heavy")
POPULARITY_SEGMENTS = ("long_tail", "mid", "head")
PREFERENCES = {
    "preferred_garment_group": "garment_group_name",
    "preferred_colour_master": "perceived_colour_master_name",
    "preferred_main_category": "main_category",
}
# Columns of the user and item tables, in the order other tools read them.
USER_COLUMNS = (
    "customer_id", "age", "age_bucket", "fashion_news_frequency", "club_member_status",
    "purchase_count", "purchase_count_7d", "purchase_count_30d", "purchase_count_90d",
    "total_spend", "spend_7d", "spend_30d", "spend_90d", "avg_price", "min_price", "max_price",
    "recency_days", "purchase_span_days", "online_ratio", "offline_ratio",
    "preferred_garment_group", "preferred_colour_master", "preferred_main_category", "preferred_season",
    "price_band", "activity_segment", "preferred_segment_key",
)
ITEM_COLUMNS = (
    "article_id", "prod_name", "product_type_name", "product_group_name", "colour_group_name",
    "perceived_colour_master_name", "department_name", "section_name", "garment_group_name",
    "category", "main_category", "color",
    "item_purchase_count", "item_purchase_count_7d", "item_purchase_count_30d", "item_purchase_count_90d",
    "item_total_spend", "item_avg_price", "item_min_price", "item_max_price",
    "item_days_since_last_purchase", "item_freshness_days", "item_online_ratio", "item_offline_ratio",
    "dominant_age_bucket", "dominant_season", "item_price_band", "popularity_segment",
)


def _money(amount: Column) -> Column:
    """Exact sum of money as double, whatever the order of the rows."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")


def last_day(txn: DataFrame) -> Column:
    """Last date of the whole data set, unknown customers and articles included."""
    return txn.agg(F.max("t_dat").alias("last_day")).scalar()


def item_features(raw: DataFrame, new_days: int = NEW_ITEM_DAYS) -> DataFrame:
    """Popularity, mean price, dates, age and newness per article from raw text rows."""
    rows = raw.select(
        c.strip("article_id").alias("article_id"),
        c.parse_date("t_dat").alias("t_dat"),
        c.parse_price("price").alias("price"),
    ).where((F.col("article_id") != "") & F.col("t_dat").isNotNull())
    grouped = rows.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("popularity"),
        _money(F.col("price")).alias("price_sum"),
        F.min("t_dat").alias("first_purchase_date"),
        F.max("t_dat").alias("last_purchase_date"),
    )
    # One row per article: its last day and every use of the counts read these rows, not the purchases again.
    grouped = staged(grouped, "item_counts")
    last = grouped.agg(F.max("last_purchase_date").alias("last_day")).scalar()
    age = F.date_diff(last, F.col("last_purchase_date"))
    return grouped.withColumn("item_age_days", age).select(
        "article_id",
        "popularity",
        (F.col("price_sum") / F.col("popularity")).alias("avg_price"),
        "first_purchase_date",
        "last_purchase_date",
        "item_age_days",
        (F.col("item_age_days") <= new_days).alias("is_new_item"),
    )


def total_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("purchase_count"),
        _money(F.col("price")).alias("total_spend"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.min("t_dat").alias("first_purchase_date"),
        F.max("t_dat").alias("last_purchase_date"),
        F.count_if(F.col("sales_channel_id") == 1).alias("channel_1_count"),
        F.count_if(F.col("sales_channel_id") == 2).alias("channel_2_count"),
    ]


def window_columns(last: Column, spend: bool, days: Sequence[int] = WINDOW_DAYS) -> list[Column]:
    """Counts (and spend) of the last days, first and last day included."""
    columns = []
    for n in days:
        recent = F.col("t_dat") >= F.date_sub(last, n - 1)
        columns.append(F.count_if(recent).alias(f"purchase_count_{n}d"))
        if spend:
            columns.append(F.coalesce(_money(F.when(recent, F.col("price"))), F.lit(0.0)).alias(f"spend_{n}d"))
    return columns


def user_totals(txn: DataFrame) -> DataFrame:
    return txn.groupBy("customer_id").agg(*total_columns())


def item_totals(txn: DataFrame) -> DataFrame:
    return txn.groupBy("article_id").agg(*total_columns())


def recency_windows(txn: DataFrame, key: str, last: Column, spend: bool = True) -> DataFrame:
    return txn.groupBy(key).agg(*window_columns(last, spend))


def preferred_value(txn: DataFrame, key: str, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per key; ties go to the first in ``order``, else in the alphabet."""
    counts = txn.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)) if order else F.lit(0)
    return counts.groupBy(key).agg(
        F.min_by(column, F.struct(-F.col("n"), place, F.col(column))).alias(f"preferred_{column}")
    )


def _count_columns(column: str, values: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(f"n_{column}_{v}") for v in values]


def _most_frequent(column: str, values: Sequence[str]) -> Column:
    """First value of a fixed list that has the highest count."""
    counts = F.array(*[F.col(f"n_{column}_{v}") for v in values])
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), F.array_position(counts, F.array_max(counts)).cast("int")
    )


def preferences(txn: DataFrame) -> DataFrame:
    """The three article preferences of every customer, counted together."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("kind"), F.col(source).alias("value")) for name, source in PREFERENCES.items()
    ]))
    counts = (
        txn.select("customer_id", pairs.alias("p"))
        .groupBy("customer_id", "p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.struct(-F.col("n"), F.col("value"))
    return counts.groupBy("customer_id").agg(*[
        F.min_by(F.when(F.col("kind") == name, F.col("value")), F.when(F.col("kind") == name, best)).alias(name)
        for name in PREFERENCES
    ])


def band(column: str, cuts: Sequence[float] | None, names: Sequence[str], missing: str) -> Column:
    """Three bands around two cuts; NULL values, or no cuts at all, give ``missing``."""
    if cuts is None:
        return F.lit(missing)
    value = F.col(column)
    return (
        F.when(value <= cuts[0], names[0]).when(value <= cuts[1], names[1])
        .when(value > cuts[1], names[2]).otherwise(missing)
    )


def price_band(df: DataFrame, column: str, name: str = "price_band") -> DataFrame:
    df = staged(df, "price_band")
    cuts = exact_quantiles(df, [column], BAND_FRACTIONS)[column]
    return df.withColumn(name, band(column, cuts, PRICE_BANDS, "unknown"))


def activity_segment(users: DataFrame) -> DataFrame:
    """Buyers by purchase count; users without purchases are cold."""
    counted = staged(
        users.withColumn("bought", F.when(F.col("purchase_count") > 0, F.col("purchase_count"))), "activity"
    )
    cuts = exact_quantiles(counted, ["bought"], BAND_FRACTIONS)["bought"]
    return counted.withColumn("activity_segment", band("bought", cuts, ACTIVITY_SEGMENTS, "cold_start")).drop("bought")


def popularity_segment(items: DataFrame) -> DataFrame:
    counted = staged(
        items.withColumn("bought", F.when(F.col("item_purchase_count") > 0, F.col("item_purchase_count"))), "popularity"
    )
    cuts = exact_quantiles(counted, ["bought"], BAND_FRACTIONS)["bought"]
    return counted.withColumn("popularity_segment", band("bought", cuts, POPULARITY_SEGMENTS, "cold")).drop("bought")


def _ratio(part: str) -> Column:
    return F.col(part) / F.col("purchase_count")


def user_features(txn: DataFrame, customers: DataFrame, last: Column) -> DataFrame:
    """One row per customer from enriched transactions, also without purchases."""
    grouped = txn.groupBy("customer_id").agg(
        *total_columns(), *window_columns(last, spend=True), *_count_columns("season", c.SEASONS)
    )
    # One row per customer; read by the quantile pass and by the result.
    base = staged(
        customers.join(grouped, "customer_id", "left")
        .join(preferences(txn), "customer_id", "left")
        .withColumns({
            "avg_price": F.col("total_spend") / F.col("purchase_count"),
            "bought": F.col("purchase_count"),
        }),
        "user_totals",
    )
    cuts = exact_quantiles(base, ["avg_price", "bought"], BAND_FRACTIONS)
    counts = ["purchase_count", *[f"purchase_count_{n}d" for n in WINDOW_DAYS]]
    spends = ["total_spend", *[f"spend_{n}d" for n in WINDOW_DAYS]]
    zero_filled = {name: F.coalesce(name, F.lit(0)) for name in counts} | {
        name: F.coalesce(name, F.lit(0.0)) for name in spends
    }
    unknown = F.lit(c.UNKNOWN)
    return (
        base.withColumns({
            "recency_days": F.date_diff(last, F.col("last_purchase_date")),
            "purchase_span_days": F.coalesce(F.date_diff("last_purchase_date", "first_purchase_date"), F.lit(0)),
            "online_ratio": _ratio("channel_2_count"),
            "offline_ratio": _ratio("channel_1_count"),
            **{name: F.coalesce(name, unknown) for name in PREFERENCES},
            "preferred_season": F.when(F.col("bought") > 0, _most_frequent("season", c.SEASONS)).otherwise(unknown),
            "price_band": band("avg_price", cuts["avg_price"], PRICE_BANDS, "unknown"),
            "activity_segment": band("bought", cuts["bought"], ACTIVITY_SEGMENTS, "cold_start"),
        })
        .withColumns(zero_filled)
        .withColumn("preferred_segment_key", F.concat_ws("::", "preferred_garment_group", "price_band"))
        .select(*USER_COLUMNS)
    )


def item_features_rich(txn: DataFrame, articles: DataFrame, last: Column) -> DataFrame:
    """One row per article from enriched transactions, also without purchases."""
    grouped = txn.groupBy("article_id").agg(
        *total_columns(), *window_columns(last, spend=False),
        *_count_columns("season", c.SEASONS), *_count_columns("buyer_age_bucket", c.AGE_BUCKETS),
    )
    # One row per article; read by the quantile pass and by the result.
    base = staged(
        articles.join(grouped, "article_id", "left").withColumns({
            "item_avg_price": F.col("total_spend") / F.col("purchase_count"),
            "bought": F.col("purchase_count"),
        }),
        "item_totals",
    )
    cuts = exact_quantiles(base, ["item_avg_price", "bought"], BAND_FRACTIONS)
    has_purchase = F.col("bought") > 0
    return base.withColumns({
        "item_purchase_count": F.coalesce("purchase_count", F.lit(0)),
        **{f"item_purchase_count_{n}d": F.coalesce(f"purchase_count_{n}d", F.lit(0)) for n in WINDOW_DAYS},
        "item_total_spend": F.coalesce("total_spend", F.lit(0.0)),
        "item_min_price": F.col("min_price"),
        "item_max_price": F.col("max_price"),
        "item_days_since_last_purchase": F.date_diff(last, F.col("last_purchase_date")),
        "item_freshness_days": F.date_diff(last, F.col("first_purchase_date")),
        "item_online_ratio": _ratio("channel_2_count"),
        "item_offline_ratio": _ratio("channel_1_count"),
        "dominant_age_bucket": F.when(has_purchase, _most_frequent("buyer_age_bucket", c.AGE_BUCKETS))
                                .otherwise("unknown"),
        "dominant_season": F.when(has_purchase, _most_frequent("season", c.SEASONS)).otherwise(c.UNKNOWN),
        "item_price_band": band("item_avg_price", cuts["item_avg_price"], PRICE_BANDS, "unknown"),
        "popularity_segment": band("bought", cuts["bought"], POPULARITY_SEGMENTS, "cold"),
    }).select(*ITEM_COLUMNS)


def interactions(txn: DataFrame, last: Column) -> DataFrame:
    return txn.select(
        "customer_id", "article_id", "t_dat", "price", "sales_channel_id",
        *c.calendar_parts("t_dat"),
        c.season("t_dat").alias("season"),
        F.lit("purchase").alias("event_type"),
        F.lit(PURCHASE_STRENGTH).alias("event_strength"),
        F.lit(1).alias("label"),
        c.time_split("t_dat", last).alias("split"),
    )


def popularity_counts(history: DataFrame, articles: DataFrame) -> DataFrame:
    """How often each known article occurs in all histories, repeats included."""
    counts = history.groupBy("article_id").agg(F.count(F.lit(1)).alias("popularity"))
    return articles.join(counts, "article_id", "left").withColumn(
        "popularity", F.coalesce("popularity", F.lit(0))
    )


def ground_truth(rows: DataFrame) -> DataFrame:
    """Distinct positive (user, item) pairs; kept as rows, so that no user's set is collected."""
    return rows.where(F.col("is_positive")).select("customer_id", "article_id").distinct()


def dataset_metadata(rows: DataFrame) -> DataFrame:
    """Counters of one set; users and items are counted from one row each, so that no row is repeated per distinct count."""
    per_user = rows.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_positive").alias("positive_rows"),
        F.count_if(~F.col("is_positive")).alias("negative_rows"),
    )
    items = rows.select("article_id").distinct().agg(F.count("article_id").alias("items")).scalar()
    totals = {n: F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("rows", "positive_rows", "negative_rows")}
    return per_user.agg(*totals.values(), F.count("customer_id").alias("users")).select(
        "rows", "users", items.alias("items"), "positive_rows", "negative_rows"
    )


def split_metadata(train: DataFrame, validation: DataFrame) -> DataFrame:
    both = train.select("customer_id", "article_id", F.lit("train").alias("side")).unionByName(
        validation.select("customer_id", "article_id", F.lit("validation").alias("side"))
    )
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("customer_id").alias("users"),
        F.count_distinct("article_id").alias("items"),
    )


def entity_table(
    rows: DataFrame, key: str, order: Sequence[str], text: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """First feature row per user or item; absent columns get their default."""
    present = [name for name in (*text, *numbers) if name in rows.columns]
    first = rows.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(n) for n in present]), F.struct(*order)).alias("f")
    )
    return first.select(
        key,
        *[(F.col(f"f.{n}") if n in present else F.lit(c.UNKNOWN)).alias(n) for n in text],
        *[(F.col(f"f.{n}") if n in present else F.lit(0.0)).alias(n) for n in numbers],
    )
