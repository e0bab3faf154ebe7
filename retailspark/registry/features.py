"""Queries over joins, feature tables and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.operators import features, joins, totals_state, windows
from retailspark.plans import flows
from retailspark.plans.staging import stage_path, staged
from retailspark.registry.core import part, query, rounded, shared, shared_path
from retailspark.registry.tables import SPLIT, articles, customers, sql_date, sql_price, sql_season
from retailspark.sources import shop, tables

part("last_day", "SELECT max(t_dat) AS d FROM transactions_raw")
part("known", "SELECT t.* FROM transactions_raw t SEMI JOIN customers USING (customer_id) SEMI JOIN articles USING (article_id)")
part("enriched", f"""SELECT t.*, coalesce(a.garment_group_name, 'UNKNOWN') AS garment_group_name,
  coalesce(a.perceived_colour_master_name, 'UNKNOWN') AS perceived_colour_master_name,
  coalesce(a.main_category, 'UNKNOWN') AS main_category, coalesce(a.color, 'UNKNOWN') AS color,
  coalesce(c.age_bucket, 'unknown') AS buyer_age_bucket, {sql_season('t.t_dat')} AS season
  FROM transactions_raw t LEFT JOIN articles a USING (article_id) LEFT JOIN customers c USING (customer_id)""")
part("known_enriched", "SELECT * FROM enriched SEMI JOIN customers USING (customer_id) SEMI JOIN articles USING (article_id)")


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def known(spark, d):
    return joins.keep_known(shop.transactions_raw(spark, d), customers(spark, d), articles(spark, d))


def enriched(spark, d, how="left"):
    return joins.enrich_transactions(shop.transactions_raw(spark, d), articles(spark, d), customers(spark, d), how)


def last_day(spark, d):
    return features.last_day(shop.transactions_raw(spark, d))


@query("keep_known", f"SELECT customer_id, article_id, count(*) AS n, round({money('price')}, 9) AS amount FROM known GROUP BY 1, 2")
def keep_known(spark, d):
    return known(spark, d).groupBy("customer_id", "article_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).alias("amount")
    )


@query("unknown_entity_counts", """SELECT count(*) FILTER (c.customer_id IS NULL) AS skipped_customer_rows,
  count(*) FILTER (c.customer_id IS NOT NULL AND a.article_id IS NULL) AS skipped_article_rows
  FROM transactions_raw t LEFT JOIN customers c USING (customer_id) LEFT JOIN articles a USING (article_id)""")
def unknown_entity_counts(spark, d):
    return joins.unknown_entity_counts(shop.transactions_raw(spark, d), customers(spark, d), articles(spark, d))


@query("enrich_transactions", """SELECT customer_id, article_id, row_no, round(price, 9) AS price, sales_channel_id, CAST(t_dat AS STRING) AS t_dat,
  garment_group_name, perceived_colour_master_name, main_category, color, buyer_age_bucket, season FROM enriched""")
def enrich_transactions(spark, d):
    return enriched(spark, d)


part("item_stats", f"""SELECT article_id, count(*) AS popularity, {money('price')} / count(*) AS avg_price,
  min(t_dat) AS first_purchase_date, max(t_dat) AS last_purchase_date,
  date_diff('day', max(t_dat), (SELECT max(t_dat) FROM parsed_text)) AS item_age_days,
  date_diff('day', max(t_dat), (SELECT max(t_dat) FROM parsed_text)) <= 7 AS is_new_item
  FROM parsed_text GROUP BY article_id""")
part("parsed_text", f"""SELECT trim(article_id) AS article_id, {sql_date('t_dat')} AS t_dat, {sql_price('price')} AS price
  FROM transactions_text WHERE trim(article_id) <> '' AND {sql_date('t_dat')} IS NOT NULL""")


@query("item_features", """SELECT article_id, popularity, round(avg_price, 9) AS avg_price, CAST(first_purchase_date AS STRING) AS first_purchase_date,
  CAST(last_purchase_date AS STRING) AS last_purchase_date, item_age_days, is_new_item FROM item_stats""")
def item_features(spark, d):
    return features.item_features(shop.transactions_text(spark, d))


def _totals(key: str) -> str:
    return f"""SELECT {key}, count(*) AS purchase_count, {money('price')} AS total_spend, min(price) AS min_price, max(price) AS max_price,
  min(t_dat) AS first_purchase_date, max(t_dat) AS last_purchase_date, count(*) FILTER (sales_channel_id = 1) AS channel_1_count,
  count(*) FILTER (sales_channel_id = 2) AS channel_2_count,
  {', '.join(f"count(*) FILTER (t_dat >= (SELECT d FROM last_day) - {n - 1}) AS purchase_count_{n}d, "
             f"coalesce(CAST(sum(CASE WHEN t_dat >= (SELECT d FROM last_day) - {n - 1} THEN CAST(price AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) AS spend_{n}d"
             for n in features.WINDOW_DAYS)}
  FROM known GROUP BY {key}"""


part("user_sums", _totals("customer_id"))
part("item_sums", _totals("article_id"))
_TOTAL_LIST = ("purchase_count, round(total_spend, 9) AS total_spend, round(min_price, 9) AS min_price, round(max_price, 9) AS max_price, "
               "CAST(first_purchase_date AS STRING) AS first_purchase_date, CAST(last_purchase_date AS STRING) AS last_purchase_date, "
               "channel_1_count, channel_2_count")


@query("user_totals", f"SELECT customer_id, {_TOTAL_LIST} FROM user_sums")
def user_totals(spark, d):
    return features.user_totals(known(spark, d))


@query("item_totals", f"SELECT article_id, {_TOTAL_LIST} FROM item_sums")
def item_totals(spark, d):
    return features.item_totals(known(spark, d))


@query("recency_windows_users", "SELECT customer_id, purchase_count_7d, purchase_count_30d, purchase_count_90d, round(spend_7d, 9) AS spend_7d, "
       "round(spend_30d, 9) AS spend_30d, round(spend_90d, 9) AS spend_90d FROM user_sums")
def recency_windows_users(spark, d):
    return features.recency_windows(known(spark, d), "customer_id", last_day(spark, d))


@query("recency_windows_items", "SELECT article_id, purchase_count_7d, purchase_count_30d, purchase_count_90d FROM item_sums")
def recency_windows_items(spark, d):
    return features.recency_windows(known(spark, d), "article_id", last_day(spark, d), spend=False)


# The purchases arrive in three batches by date; the second one brings days the first has seen already.
BATCH_ENDS = ("1997-03-31", "1999-11-15")


def appended_totals(spark, d):
    txn, kept_rows = shop.transactions_raw(spark, d), staged(known(spark, d), "known")
    path = stage_path(txn, "totals")
    late = F.col("sales_channel_id") == 1
    number = F.when((F.col("t_dat") <= BATCH_ENDS[0]) & ~((F.col("t_dat") > "1996-06-01") & late), 1).when(
        F.col("t_dat") <= BATCH_ENDS[1], 2
    ).otherwise(3)
    ends = {r["batch"]: r["d"] for r in txn.groupBy(number.alias("batch")).agg(F.max("t_dat").alias("d")).collect()}
    for batch_id in (1, 2, 3):
        rows = kept_rows.where(number == batch_id)
        totals_state.append_purchases(spark, path, rows, batch_id, ends[batch_id])
        totals_state.append_purchases(spark, path, rows, batch_id, ends[batch_id])  # a replay changes nothing
    return path


_WINDOW_LIST = ", ".join(f"purchase_count_{n}d, round(spend_{n}d, 9) AS spend_{n}d" for n in features.WINDOW_DAYS)


@query("incremental_user_totals", f"SELECT customer_id, {_TOTAL_LIST}, {_WINDOW_LIST} FROM user_sums")
def incremental_user_totals(spark, d):
    return totals_state.kept_totals(spark, shared_path("appended_totals", spark, d, appended_totals), "customer_id")


@query("incremental_item_totals", f"SELECT article_id, {_TOTAL_LIST}, {_WINDOW_LIST} FROM item_sums")
def incremental_item_totals(spark, d):
    return totals_state.kept_totals(spark, shared_path("appended_totals", spark, d, appended_totals), "article_id")


def preferred_sql(key: str, column: str, order=None) -> str:
    place = f"list_position([{', '.join(repr(v) for v in order)}], {column})" if order else column
    return (f"SELECT {key}, {column} AS preferred_{column} FROM (SELECT {key}, {column}, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY count(*) DESC, {place}) AS rn FROM known_enriched GROUP BY {key}, {column}) WHERE rn = 1")


@query("preferred_value_garment", preferred_sql("customer_id", "garment_group_name"))
def preferred_value_garment(spark, d):
    return features.preferred_value(enriched(spark, d, "inner"), "customer_id", "garment_group_name")


@query("preferred_value_season", preferred_sql("customer_id", "season", c.SEASONS))
def preferred_value_season(spark, d):
    return features.preferred_value(enriched(spark, d, "inner"), "customer_id", "season", c.SEASONS)


@query("preferred_value_age_bucket", preferred_sql("article_id", "buyer_age_bucket", c.AGE_BUCKETS))
def preferred_value_age_bucket(spark, d):
    return features.preferred_value(enriched(spark, d, "inner"), "article_id", "buyer_age_bucket", c.AGE_BUCKETS)


def cut_sql(value: str, table: str, fraction: float) -> str:
    return f"(SELECT round(quantile_cont(CAST({value} AS DOUBLE), {fraction}), 9) FROM {table})"


def band_sql(value: str, table: str, names, missing: str, source: str | None = None) -> str:
    source = source or value
    low, high = cut_sql(source, table, 0.33), cut_sql(source, table, 0.66)
    return (f"(CASE WHEN {value} <= {low} THEN '{names[0]}' WHEN {value} <= {high} THEN '{names[1]}' "
            f"WHEN {value} > {high} THEN '{names[2]}' ELSE '{missing}' END)")


part("user_base", "SELECT c.*, u.* EXCLUDE (customer_id), u.total_spend / u.purchase_count AS avg_price FROM customers c LEFT JOIN user_sums u USING (customer_id)")
part("item_base", "SELECT a.*, i.* EXCLUDE (article_id), i.total_spend / i.purchase_count AS avg_price FROM articles a LEFT JOIN item_sums i USING (article_id)")


def _user_base(spark, d):
    totals = features.user_totals(known(spark, d))
    return customers(spark, d).join(totals, "customer_id", "left").select(
        "customer_id", "purchase_count", (F.col("total_spend") / F.col("purchase_count")).alias("avg_price")
    )


@query("price_band", f"SELECT customer_id, {band_sql('avg_price', 'user_base', features.PRICE_BANDS, 'unknown')} AS price_band FROM user_base")
def price_band(spark, d):
    return features.price_band(_user_base(spark, d), "avg_price").select("customer_id", "price_band")


@query("activity_segment", f"SELECT customer_id, {band_sql('purchase_count', 'user_base', features.ACTIVITY_SEGMENTS, 'cold_start')} AS activity_segment FROM user_base")
def activity_segment(spark, d):
    return features.activity_segment(_user_base(spark, d)).select("customer_id", "activity_segment")


@query("popularity_segment", f"SELECT article_id, {band_sql('purchase_count', 'item_base', features.POPULARITY_SEGMENTS, 'cold')} AS popularity_segment FROM item_base")
def popularity_segment(spark, d):
    totals = features.item_totals(known(spark, d)).select("article_id", F.col("purchase_count").alias("item_purchase_count"))
    items = articles(spark, d).join(totals, "article_id", "left")
    return features.popularity_segment(items).select("article_id", "popularity_segment")


for _kind, _column in (("garment", "garment_group_name"), ("colour", "perceived_colour_master_name"), ("main", "main_category")):
    part(f"favourite_{_kind}", preferred_sql("customer_id", _column))
part("favourite_season", preferred_sql("customer_id", "season", c.SEASONS))
part("favourite_buyer", preferred_sql("article_id", "buyer_age_bucket", c.AGE_BUCKETS))
part("item_season", preferred_sql("article_id", "season", c.SEASONS))
part("user_table", f"""SELECT customer_id, age, age_bucket, fashion_news_frequency, club_member_status,
  coalesce(purchase_count, 0) AS purchase_count, coalesce(purchase_count_7d, 0) AS purchase_count_7d,
  coalesce(purchase_count_30d, 0) AS purchase_count_30d, coalesce(purchase_count_90d, 0) AS purchase_count_90d,
  round(coalesce(total_spend, 0), 9) AS total_spend, round(coalesce(spend_7d, 0), 9) AS spend_7d,
  round(coalesce(spend_30d, 0), 9) AS spend_30d, round(coalesce(spend_90d, 0), 9) AS spend_90d,
  round(avg_price, 9) AS avg_price, round(min_price, 9) AS min_price, round(max_price, 9) AS max_price,
  date_diff('day', last_purchase_date, (SELECT d FROM last_day)) AS recency_days,
  coalesce(date_diff('day', first_purchase_date, last_purchase_date), 0) AS purchase_span_days,
  round(channel_2_count / purchase_count, 9) AS online_ratio, round(channel_1_count / purchase_count, 9) AS offline_ratio,
  coalesce(preferred_garment_group_name, 'UNKNOWN') AS preferred_garment_group,
  coalesce(preferred_perceived_colour_master_name, 'UNKNOWN') AS preferred_colour_master,
  coalesce(preferred_main_category, 'UNKNOWN') AS preferred_main_category, coalesce(preferred_season, 'UNKNOWN') AS preferred_season,
  {band_sql('avg_price', 'user_base', features.PRICE_BANDS, 'unknown')} AS price_band,
  {band_sql('purchase_count', 'user_base', features.ACTIVITY_SEGMENTS, 'cold_start')} AS activity_segment,
  concat(coalesce(preferred_garment_group_name, 'UNKNOWN'), '::', {band_sql('avg_price', 'user_base', features.PRICE_BANDS, 'unknown')}) AS preferred_segment_key
  FROM user_base LEFT JOIN favourite_garment USING (customer_id) LEFT JOIN favourite_colour USING (customer_id)
  LEFT JOIN favourite_main USING (customer_id) LEFT JOIN favourite_season USING (customer_id)""")
part("item_table", f"""SELECT article_id, prod_name, product_type_name, product_group_name, colour_group_name, perceived_colour_master_name,
  department_name, section_name, garment_group_name, category, main_category, color,
  coalesce(purchase_count, 0) AS item_purchase_count, coalesce(purchase_count_7d, 0) AS item_purchase_count_7d,
  coalesce(purchase_count_30d, 0) AS item_purchase_count_30d, coalesce(purchase_count_90d, 0) AS item_purchase_count_90d,
  round(coalesce(total_spend, 0), 9) AS item_total_spend, round(avg_price, 9) AS item_avg_price,
  round(min_price, 9) AS item_min_price, round(max_price, 9) AS item_max_price,
  date_diff('day', last_purchase_date, (SELECT d FROM last_day)) AS item_days_since_last_purchase,
  date_diff('day', first_purchase_date, (SELECT d FROM last_day)) AS item_freshness_days,
  round(channel_2_count / purchase_count, 9) AS item_online_ratio, round(channel_1_count / purchase_count, 9) AS item_offline_ratio,
  coalesce(preferred_buyer_age_bucket, 'unknown') AS dominant_age_bucket, coalesce(preferred_season, 'UNKNOWN') AS dominant_season,
  {band_sql('avg_price', 'item_base', features.PRICE_BANDS, 'unknown')} AS item_price_band,
  {band_sql('purchase_count', 'item_base', features.POPULARITY_SEGMENTS, 'cold')} AS popularity_segment
  FROM item_base LEFT JOIN favourite_buyer USING (article_id) LEFT JOIN item_season USING (article_id)""")
part("interaction_rows", f"""SELECT customer_id, article_id, t_dat, price, sales_channel_id, year(t_dat) AS year, month(t_dat) AS month,
  weekofyear(t_dat) AS week, isodow(t_dat) - 1 AS day_of_week, {sql_season('t_dat')} AS season, 'purchase' AS event_type,
  3 AS event_strength, 1 AS label, {SPLIT} AS split FROM known""")


@query("user_features", "SELECT * FROM user_table")
def user_features(spark, d):
    return features.user_features(enriched(spark, d, "inner"), customers(spark, d), last_day(spark, d))


@query("item_features_rich", "SELECT * FROM item_table")
def item_features_rich(spark, d):
    return features.item_features_rich(enriched(spark, d, "inner"), articles(spark, d), last_day(spark, d))


@query("interactions", "SELECT * REPLACE (CAST(t_dat AS STRING) AS t_dat, round(price, 9) AS price) FROM interaction_rows")
def interactions(spark, d):
    return features.interactions(known(spark, d), last_day(spark, d))


_USER_EXTRA = [n for n in features.USER_COLUMNS if n != "customer_id"]
_ITEM_EXTRA = [n for n in features.ITEM_COLUMNS if n != "article_id"]


@query("candidate_train", f"""SELECT r.* REPLACE (CAST(t_dat AS STRING) AS t_dat, round(price, 9) AS price),
  {', '.join('u.' + n for n in _USER_EXTRA)}, {', '.join('i.' + n for n in _ITEM_EXTRA)}
  FROM interaction_rows r LEFT JOIN user_table u USING (customer_id) LEFT JOIN item_table i USING (article_id)""")
def candidate_train(spark, d):
    built = flows.candidate_tables(
        shop.transactions_raw(spark, d), shop.customers_raw(spark, d), shop.articles_raw(spark, d)
    )
    # The same join over feature tables that are rounded per user and per item; their keys were checked above.
    return joins.candidate_train(
        built["interactions"], rounded(built["user_features"]), rounded(built["item_features"]), check=False
    )


@query("segment_top_items", """SELECT * FROM (SELECT concat(garment_group_name, '::', item_price_band) AS segment_key,
  row_number() OVER (PARTITION BY garment_group_name, item_price_band ORDER BY item_purchase_count_30d DESC, item_purchase_count DESC,
  item_avg_price DESC NULLS LAST, article_id) AS segment_rank, article_id, prod_name, garment_group_name, item_price_band, color,
  item_purchase_count_30d, item_purchase_count FROM item_table WHERE item_purchase_count > 0) WHERE segment_rank <= 50""")
def segment_top_items(spark, d):
    return windows.segment_top_items(item_features_rich(spark, d), 50)


@query("item_prices", f"""SELECT article_id, round(coalesce(p.price, 0), 9) AS price FROM articles LEFT JOIN
  (SELECT article_id, {money('price')} / count(*) AS price FROM transactions_raw GROUP BY 1) p USING (article_id)""")
def item_prices(spark, d):
    return joins.item_prices(articles(spark, d), shop.transactions_raw(spark, d)).select("article_id", "price")


part("catalog", """SELECT *, greatest(9 - (row_number() OVER (PARTITION BY main_category ORDER BY popularity DESC, article_id) - 1), 0) / 10 AS cold_start_bonus,
  popularity / greatest(max(popularity) OVER (), 1.0) AS normalized_popularity, CASE WHEN is_new_item THEN 0.5 ELSE 0.0 END AS fresh_boost
  FROM (SELECT a.*, CAST(coalesce(s.popularity, 0) AS DOUBLE) AS popularity, CAST(s.item_age_days AS DOUBLE) AS item_age_days,
        coalesce(s.is_new_item, false) AS is_new_item FROM articles a LEFT JOIN item_stats s USING (article_id))""")


def build_catalog(spark, d):
    return joins.serving_catalog(articles(spark, d), features.item_features(shop.transactions_text(spark, d)))


def catalog(spark, d):
    return shared("catalog", spark, d, build_catalog)


_CATALOG_LIST = ("article_id, category, main_category, color, popularity, item_age_days, is_new_item, "
                 "round(cold_start_bonus, 9) AS cold_start_bonus, round(normalized_popularity, 9) AS normalized_popularity, fresh_boost::DOUBLE AS fresh_boost")


@query("serving_catalog", f"SELECT {_CATALOG_LIST} FROM catalog")
def serving_catalog(spark, d):
    return build_catalog(spark, d).select(
        "article_id", "category", "main_category", "color", "popularity", "item_age_days", "is_new_item",
        "cold_start_bonus", "normalized_popularity", "fresh_boost",
    )


@query("popularity_order", "SELECT article_id, popularity, row_number() OVER (ORDER BY popularity DESC, article_id) AS position FROM catalog")
def popularity_order(spark, d):
    return windows.popularity_order(catalog(spark, d).select("article_id", "popularity"))


@query("rank_within", """SELECT article_id, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, article_id) AS in_category,
  row_number() OVER (PARTITION BY main_category ORDER BY popularity DESC, article_id) AS in_main_category,
  row_number() OVER (PARTITION BY color ORDER BY popularity DESC, article_id) AS in_color FROM catalog""")
def rank_within(spark, d):
    items = catalog(spark, d).select("article_id", "category", "main_category", "color", "popularity")
    ranked = [
        windows.rank_within(items, column).select("article_id", F.col("position").alias(f"in_{column}"))
        for column in ("category", "main_category", "color")
    ]
    return ranked[0].join(ranked[1], "article_id").join(ranked[2], "article_id")


@query("lookup_lists", """SELECT color AS value, position, article_id FROM (SELECT color, article_id,
  row_number() OVER (PARTITION BY color ORDER BY popularity DESC, article_id) AS position FROM catalog)""")
def lookup_lists(spark, d):
    items = catalog(spark, d).select("article_id", "color", "popularity")
    return windows.rank_within(items, "color").select(F.col("color").alias("value"), "position", "article_id")


@query("cold_start_bonus", "SELECT article_id, round(cold_start_bonus, 9) AS cold_start_bonus FROM catalog")
def cold_start_bonus(spark, d):
    return windows.cold_start_bonus(catalog(spark, d)).select("article_id", "cold_start_bonus")


part("sequence_rows", """SELECT * FROM (SELECT customer_id, article_id, t_dat, row_no, lag(article_id) OVER (PARTITION BY customer_id ORDER BY t_dat, row_no, article_id) AS previous
  FROM transactions_raw) WHERE previous IS NULL OR previous <> article_id""")
part("history_rows", """SELECT customer_id, article_id, t_dat, row_no, target_article_id FROM (SELECT *, row_number() OVER back AS from_end,
  first_value(article_id) OVER back AS target_article_id FROM sequence_rows
  WINDOW back AS (PARTITION BY customer_id ORDER BY t_dat DESC, row_no DESC, article_id DESC)) WHERE from_end > 1""")


@query("purchase_sequence", "SELECT customer_id, article_id, CAST(t_dat AS STRING) AS t_dat, row_no FROM sequence_rows")
def purchase_sequence(spark, d):
    return windows.purchase_sequence(shop.transactions_raw(spark, d))


def history(spark, d):
    return windows.leave_last_out(windows.purchase_sequence(shop.transactions_raw(spark, d)))


@query("leave_last_out", "SELECT * REPLACE (CAST(t_dat AS STRING) AS t_dat) FROM history_rows")
def leave_last_out(spark, d):
    return history(spark, d)


@query("recent_preferences", """SELECT customer_id, category, row_number() OVER (PARTITION BY customer_id ORDER BY latest DESC) AS preference
  FROM (SELECT customer_id, category, max(row(t_dat, row_no, article_id)) AS latest FROM history_rows JOIN articles USING (article_id) GROUP BY 1, 2)""")
def recent_preferences(spark, d):
    from retailspark.plans.skew import lookup_join

    rows = lookup_join(history(spark, d), articles(spark, d).select("article_id", "category"), "article_id", "inner")
    return windows.recent_preferences(rows, "category")


@query("popularity_counts", """SELECT article_id, coalesce(n, 0) AS popularity FROM articles LEFT JOIN
  (SELECT article_id, count(*) AS n FROM history_rows GROUP BY 1) USING (article_id)""")
def popularity_counts(spark, d):
    return features.popularity_counts(history(spark, d), articles(spark, d).select("article_id"))
