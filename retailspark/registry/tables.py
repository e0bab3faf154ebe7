"""Queries over sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.operators import clean as clean_ops
from retailspark.plans.staging import stage_path
from retailspark.registry.core import part, query
from retailspark.sources import shop, tables

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def sql_norm(x: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace({x}, '\s+', ' ', 'g')), ''), 'UNKNOWN')"


def sql_first_known(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({sql_norm(x)}, 'UNKNOWN')" for x in xs) + ", 'UNKNOWN')"


def sql_number(x: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({x}), '{NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def sql_age(x: str) -> str:
    n = sql_number(x)
    return f"(CASE WHEN {n} > -1 AND {n} < 121 THEN CAST(trunc({n}) AS INTEGER) ELSE -1 END)"


def sql_bucket(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} < 0 THEN 'unknown' WHEN {x} < 20 THEN 'under_20' WHEN {x} < 30 THEN '20s' "
            f"WHEN {x} < 40 THEN '30s' WHEN {x} < 50 THEN '40s' WHEN {x} < 60 THEN '50s' ELSE '60_plus' END)")


def sql_season(x: str) -> str:
    return (f"(CASE WHEN month({x}) IN (3,4,5) THEN 'spring' WHEN month({x}) IN (6,7,8) THEN 'summer' "
            f"WHEN month({x}) IN (9,10,11) THEN 'autumn' ELSE 'winter' END)")


def sql_price(x: str) -> str:
    return f"coalesce({sql_number(x)}, 0.0::DOUBLE)"


def sql_date(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DATE)"


FREQUENCY = (f"(CASE WHEN upper({sql_norm('fashion_news_frequency')}) IN ('NONE','REGULARLY','MONTHLY') "
             f"THEN upper({sql_norm('fashion_news_frequency')}) ELSE 'UNKNOWN' END)")
MEMBER = f"upper({sql_norm('club_member_status')})"

part("customers", f"""
SELECT trim(customer_id) AS customer_id, {sql_age('age')} AS age, {sql_bucket(sql_age('age'))} AS age_bucket,
       {FREQUENCY} AS fashion_news_frequency, {MEMBER} AS club_member_status
FROM customers_raw WHERE trim(customer_id) <> ''""")
part("articles", f"""
SELECT trim(article_id) AS article_id,
       {', '.join(f'{sql_norm(x)} AS {x}' for x in clean_ops.ARTICLE_TEXT)},
       {sql_first_known(*c.CATEGORY_FIELDS)} AS category,
       {sql_first_known(*c.MAIN_CATEGORY_FIELDS)} AS main_category,
       {sql_first_known(*c.COLOR_FIELDS)} AS color
FROM articles_raw WHERE trim(article_id) <> ''""")


def customers(spark, d):
    return clean_ops.clean_customers(shop.customers_raw(spark, d))


def articles(spark, d):
    return clean_ops.clean_articles(shop.articles_raw(spark, d))


LINE_SCHEMA = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@query("read_table", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows, "
       "round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 9) AS amount FROM lineitem GROUP BY 1, 2")
def read_table(spark, d):
    lines = tables.read_table(
        spark, f"{d}/lineitem.parquet", LINE_SCHEMA, columns=["l_returnflag", "l_linestatus", "l_extendedprice"]
    )
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount")
    )


@query("first_existing_table", "SELECT c_mktsegment, count(*) AS n_rows FROM customer GROUP BY 1")
def first_existing_table(spark, d):
    schema = "c_custkey bigint, c_mktsegment string"
    found = tables.first_existing(spark, [f"{d}/customer_new.parquet", f"{d}/customer.parquet"], schema)
    return tables.require_columns(found, ["c_custkey", "c_mktsegment"], "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


# The capped row count is the operator itself: the test mode reads the first rows only.
@query("limit_rows", "SELECT CAST(t_dat AS STRING) AS t_dat, customer_id, article_id, row_no, round(price, 9) AS price "
       "FROM transactions_raw ORDER BY t_dat, row_no, article_id, price LIMIT 10000")
def limit_rows(spark, d):
    return tables.limit_rows(
        shop.transactions_raw(spark, d).drop("sales_channel_id"), 10_000, ["t_dat", "row_no", "article_id", "price"]
    )


PROFILE_SQL = ("SELECT count(*) AS total_rows, CAST(min(t_dat) AS STRING) AS min_date, CAST(max(t_dat) AS STRING) AS max_date, "
               "count(DISTINCT customer_id) AS unique_customers, count(DISTINCT article_id) AS unique_articles FROM transactions_raw")


@query("profile_transactions", PROFILE_SQL)
def profile_transactions(spark, d):
    return tables.profile_transactions(shop.transactions_raw(spark, d))


@query("run_manifest", f"SELECT 'production' AS mode, 50 AS segment_top_k, p.*, p.total_rows AS candidate_train_rows FROM ({PROFILE_SQL}) p")
def run_manifest(spark, d):
    txn = shop.transactions_raw(spark, d)
    manifest = tables.run_manifest(
        tables.profile_transactions(txn), txn, "production", {"interactions": "interactions"}
    )
    return manifest.select("mode", "segment_top_k", "transactions.*", "candidate_train_rows")


@query("normalize_text", f"SELECT c_custkey, {sql_norm('concat(chr(9), c_mktsegment, chr(10), chr(32), c_name)')} AS cleaned FROM customer")
def normalize_text(spark, d):
    noisy = F.concat(F.lit("\t"), "c_mktsegment", F.lit("\n "), "c_name")
    return shop.table(spark, d, "customer").select("c_custkey", c.normalize_text(noisy).alias("cleaned"))


@query("normalize_news_frequency", f"SELECT {FREQUENCY} AS frequency, count(*) AS n FROM customers_raw GROUP BY 1")
def normalize_news_frequency(spark, d):
    return shop.customers_raw(spark, d).groupBy(
        c.normalize_news_frequency("fashion_news_frequency").alias("frequency")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_member_status", f"SELECT {MEMBER} AS status, count(*) AS n FROM customers_raw GROUP BY 1")
def normalize_member_status(spark, d):
    return shop.customers_raw(spark, d).groupBy(
        c.normalize_member_status("club_member_status").alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("parse_age", f"SELECT {sql_age('age')} AS age, count(*) AS n FROM customers_raw GROUP BY 1")
def parse_age(spark, d):
    return shop.customers_raw(spark, d).groupBy(c.parse_age("age").alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("age_bucket", f"SELECT {sql_bucket(sql_age('age'))} AS age_bucket, count(*) AS n FROM customers_raw GROUP BY 1")
def age_bucket(spark, d):
    return shop.customers_raw(spark, d).groupBy(
        c.age_bucket(c.parse_age("age")).alias("age_bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("first_known", f"""SELECT article_id, prod_name, {sql_first_known(*c.CATEGORY_FIELDS)} AS category,
       {sql_first_known(*c.MAIN_CATEGORY_FIELDS)} AS main_category, {sql_first_known(*c.COLOR_FIELDS)} AS color FROM articles_raw""")
def first_known(spark, d):
    return shop.articles_raw(spark, d).select(
        "article_id", "prod_name",
        c.first_known(*c.CATEGORY_FIELDS).alias("category"),
        c.first_known(*c.MAIN_CATEGORY_FIELDS).alias("main_category"),
        c.first_known(*c.COLOR_FIELDS).alias("color"),
    )


@query("parse_date", f"SELECT CAST({sql_date('t_dat')} AS STRING) AS day, count(*) AS n FROM transactions_text GROUP BY 1")
def parse_date(spark, d):
    return shop.transactions_text(spark, d).groupBy(c.parse_date("t_dat").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_price", f"SELECT article_id, count(*) AS n, round(CAST(sum(CAST({sql_price('price')} AS DECIMAL(18,2))) AS DOUBLE), 9) AS amount "
       "FROM transactions_text GROUP BY 1")
def parse_price(spark, d):
    return shop.transactions_text(spark, d).groupBy("article_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c.parse_price("price").cast("decimal(18,2)")).alias("amount")
    )


@query("normalize_article_id", """SELECT p_partkey,
       CASE WHEN length(CAST(p_partkey AS STRING)) < 10 THEN lpad(CAST(p_partkey AS STRING), 10, '0') ELSE CAST(p_partkey AS STRING) END AS from_number,
       p_name AS from_text, concat('12345678901', CAST(p_size AS STRING)) AS from_long FROM part""")
def normalize_article_id(spark, d):
    return shop.table(spark, d, "part").select(
        "p_partkey",
        c.normalize_article_id(F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).alias("from_number"),
        c.normalize_article_id("p_name").alias("from_text"),
        c.normalize_article_id(F.concat(F.lit("12345678901"), F.col("p_size").cast("string"))).alias("from_long"),
    )


@query("season", f"SELECT {sql_season('o_orderdate')} AS season, count(*) AS n FROM orders GROUP BY 1")
def season(spark, d):
    return shop.table(spark, d, "orders").groupBy(c.season("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("calendar_parts", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, weekofyear(o_orderdate) AS week, "
       "isodow(o_orderdate) - 1 AS day_of_week, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4")
def calendar_parts(spark, d):
    return shop.table(spark, d, "orders").groupBy(*c.calendar_parts("o_orderdate")).agg(F.count(F.lit(1)).alias("n"))


SPLIT = ("CASE WHEN t_dat >= (SELECT max(t_dat) FROM transactions_raw) - 13 THEN 'test' "
         "WHEN t_dat >= (SELECT max(t_dat) FROM transactions_raw) - 27 THEN 'valid' ELSE 'train' END")


@query("time_split", f"SELECT {SPLIT} AS split, count(*) AS n, CAST(min(t_dat) AS STRING) AS first_day FROM transactions_raw GROUP BY 1")
def time_split(spark, d):
    txn = shop.transactions_raw(spark, d)
    last = txn.agg(F.max("t_dat").alias("last_day")).scalar()
    return txn.withColumn("split", c.time_split("t_dat", last)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_dat").alias("first_day")
    )


@query("safe_numeric", f"""SELECT event_id, CASE
    WHEN lower(word) IN ('true','yes','y') THEN 1.0::DOUBLE WHEN lower(word) IN ('false','no','n') THEN 0.0::DOUBLE
    ELSE coalesce({sql_number('word')}, -1.0::DOUBLE) END AS number
  FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN 'FALSE' WHEN 'error' THEN 'n/a'
        ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS raw_word, trim(raw_word) AS word FROM events)""")
def safe_numeric(spark, d):
    kind = F.col("event_type")
    word = (
        F.when(kind == "click", " Yes").when(kind == "view", "FALSE").when(kind == "error", "n/a")
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    )
    return shop.table(spark, d, "events").select("event_id", c.safe_numeric(word, -1.0).alias("number"))


@query("categorical_token", "SELECT coalesce(nullif(trim(index_group_name), ''), 'UNKNOWN') AS token, count(*) AS n FROM articles_raw GROUP BY 1")
def categorical_token(spark, d):
    return shop.articles_raw(spark, d).groupBy(c.categorical_token("index_group_name").alias("token")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _joined(sep: str, names) -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"nullif(trim({n}), '')" for n in names) + ")"


_DOC = ("prod_name", "product_type_name", "colour_group_name", "index_name", "department_name", "section_name", "garment_group_name")


@query("item_document", f"""SELECT article_id, {_joined(' | ', _DOC)} AS document,
       coalesce(nullif({_joined(' ', c.SHORT_DOCUMENT_FIELDS)}, ''), article_id) AS short_document FROM articles_raw""")
def item_document(spark, d):
    raw = shop.articles_raw(spark, d)
    return raw.select(
        "article_id", c.item_document(raw).alias("document"), c.short_item_document(raw).alias("short_document")
    )


@query("item_name_and_key", """SELECT p_partkey, substring(coalesce(nullif(trim(prod_name), ''), nullif(trim(detail_desc), ''), 'item'), 1, 120) AS name,
       coalesce(nullif(trim(article_id), ''), nullif(trim(product_code), ''), '') AS item_key
  FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN ' ' ELSE p_name END AS prod_name, repeat(concat(p_type, '-'), 40) AS detail_desc,
        CASE WHEN p_brand = 'Brand#13' THEN '' ELSE CAST(p_partkey AS STRING) END AS article_id, p_brand AS product_code FROM part)""")
def item_name_and_key(spark, d):
    raw = shop.table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_name")).alias("prod_name"),
        F.expr("repeat(concat(p_type, '-'), 40)").alias("detail_desc"),
        F.when(F.col("p_brand") == "Brand#13", "").otherwise(F.col("p_partkey").cast("string")).alias("article_id"),
        F.col("p_brand").alias("product_code"),
    )
    return raw.select("p_partkey", c.item_name(raw).alias("name"), c.item_key(raw).alias("item_key"))


@query("parse_item_list", """SELECT p_partkey, concat_ws(',', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand) AS items, 3 AS n_items FROM part""")
def parse_item_list(spark, d):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    size = F.col("p_size")
    cell = (
        F.when(size <= 12, F.concat(F.lit("['"), first, F.lit("', '"), second, F.lit("', '"), "p_brand", F.lit("']")))
        .when(size <= 25, F.concat_ws("|", first, F.lit(" "), second, "p_brand"))
        .when(size <= 37, F.concat_ws(", ", first, second, F.lit(""), "p_brand"))
        .otherwise(F.concat(F.lit("(\""), first, F.lit("\", \""), second, F.lit("\", '"), "p_brand", F.lit("',)")))
    )
    items = c.parse_item_list(cell)
    return shop.table(spark, d, "part").select("p_partkey", items.alias("items"), F.size(items).alias("n_items"))


@query("parse_interest", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(props->>'k' AS DOUBLE) END AS weight FROM events""")
def parse_interest(spark, d):
    cell = F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return shop.table(spark, d, "events").select("event_id", c.parse_interest(cell).getItem("k").alias("weight"))


@query("clean_customers", "SELECT * FROM customers")
def clean_customers(spark, d):
    return customers(spark, d)


@query("clean_articles", "SELECT * FROM articles")
def clean_articles(spark, d):
    return articles(spark, d)


CUSTOMER_QUALITY_SQL = f"""SELECT count(*) AS rows_read, count(*) FILTER (trim(customer_id) <> '') AS rows_written,
       count(*) FILTER (trim(customer_id) = '') AS blank_ids,
       count(*) FILTER (trim(customer_id) <> '' AND {sql_age('age')} < 0) AS unknown_ages FROM customers_raw"""


@query("customer_quality", CUSTOMER_QUALITY_SQL)
def customer_quality(spark, d):
    return clean_ops.customer_quality(shop.customers_raw(spark, d))


def _unknown(fields, name):
    return f"count(*) FILTER (trim(article_id) <> '' AND {sql_first_known(*fields)} = 'UNKNOWN') AS {name}"


ARTICLE_QUALITY_SQL = f"""SELECT count(*) AS rows_read, count(*) FILTER (trim(article_id) <> '') AS rows_written,
       count(*) FILTER (trim(article_id) = '') AS blank_ids, {_unknown(c.CATEGORY_FIELDS, 'unknown_categories')},
       {_unknown(c.MAIN_CATEGORY_FIELDS, 'unknown_main_categories')}, {_unknown(c.COLOR_FIELDS, 'unknown_colors')} FROM articles_raw"""


@query("article_quality", ARTICLE_QUALITY_SQL)
def article_quality(spark, d):
    return clean_ops.article_quality(shop.articles_raw(spark, d))


@query("transaction_quality", f"""SELECT count(*) AS rows_scanned, count(*) FILTER (trim(article_id) = '') AS missing_article_rows,
       count(*) FILTER (trim(article_id) <> '' AND {sql_date('t_dat')} IS NULL) AS invalid_date_rows,
       count(*) FILTER (trim(article_id) <> '' AND {sql_date('t_dat')} IS NOT NULL) AS rows_aggregated FROM transactions_text""")
def transaction_quality(spark, d):
    return clean_ops.transaction_quality(shop.transactions_text(spark, d))


def _observed(spark, d, raw, clean, counters, name):
    """Counters of the scan that also writes the cleaned table."""
    return clean_ops.write_counted(raw, clean, counters, stage_path(raw, f"clean_{name}"), name)


@query("observed_customer_quality", CUSTOMER_QUALITY_SQL)
def observed_customer_quality(spark, d):
    return _observed(spark, d, shop.customers_raw(spark, d), clean_ops.clean_customers, clean_ops.customer_counters(), "customers")


@query("observed_article_quality", ARTICLE_QUALITY_SQL)
def observed_article_quality(spark, d):
    return _observed(spark, d, shop.articles_raw(spark, d), clean_ops.clean_articles, clean_ops.article_counters(), "articles")


# Estimates come from the stored sketches; the exact numbers stand beside them only to be compared.
@query("sketch_profile", """SELECT year(t_dat) * 100 + month(t_dat) AS month, count(*) AS total_rows, min(t_dat)::STRING AS min_date, max(t_dat)::STRING AS max_date,
  count(DISTINCT customer_id) AS exact_customers, count(DISTINCT article_id) AS exact_articles, true AS customers_within_2_percent, true AS articles_within_2_percent
  FROM transactions_raw GROUP BY 1""")
def sketch_profile(spark, d):
    txn = shop.transactions_raw(spark, d)
    path = stage_path(txn, "daily_sketches")
    tables.write_daily_sketches(txn, path)
    by_month = tables.profile_of_sketches(spark.read.parquet(path), "month")
    exact = txn.groupBy(tables.month_number("t_dat").alias("month")).agg(
        F.count_distinct("customer_id").alias("exact_customers"), F.count_distinct("article_id").alias("exact_articles")
    )

    def near(estimate, number):
        return F.abs(F.col(estimate) - F.col(number)) <= 0.02 * F.col(number)

    return by_month.join(exact, "month").select(
        "month", "total_rows", "min_date", "max_date", "exact_customers", "exact_articles",
        near("unique_customers", "exact_customers").alias("customers_within_2_percent"),
        near("unique_articles", "exact_articles").alias("articles_within_2_percent"),
    )
