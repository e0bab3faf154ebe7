"""Shop tables projected from the order and event tables.

The select lists are plain SQL that Spark and DuckDB both read, so one text defines
each table for a job and for its check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMER_COLUMNS = {
    "customer_id": "CASE WHEN c_nationkey = 7 THEN '' ELSE CAST(c_custkey AS STRING) END",
    "age": "CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 8000 THEN '' "
           "ELSE concat(CAST(CAST(floor(c_acctbal / 80) AS INT) AS STRING), '.0') END",
    "fashion_news_frequency": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Regularly' WHEN 'FURNITURE' THEN 'NONE' "
                              "WHEN 'MACHINERY' THEN ' Monthly ' WHEN 'HOUSEHOLD' THEN 'None' ELSE '' END",
    "club_member_status": "CASE WHEN c_nationkey < 6 THEN 'ACTIVE' WHEN c_nationkey < 12 THEN 'pre-create' "
                          "WHEN c_nationkey < 18 THEN 'LEFT  CLUB' ELSE '' END",
}
# Suppliers hold accounts too, but never buy: they are the users without history.
SUPPLIER_COLUMNS = {
    "customer_id": "concat('S', CAST(s_suppkey AS STRING))",
    "age": "concat(CAST(CAST(floor(s_acctbal / 80) AS INT) AS STRING), '.0')",
    "fashion_news_frequency": "'Monthly'",
    "club_member_status": "'ACTIVE'",
}
PART_COLUMNS = {
    "article_id": "CASE WHEN p_brand = 'Brand#13' THEN '' ELSE lpad(CAST(p_partkey AS STRING), 10, '0') END",
    "prod_name": "p_name",
    "product_type_name": "p_type",
    "product_group_name": "split_part(p_name, ' ', 2)",
    "colour_group_name": "split_part(p_name, ' ', 1)",
    "perceived_colour_master_name": "CASE WHEN p_size <= 7 THEN '' ELSE split_part(p_name, ' ', 1) END",
    "department_name": "p_brand",
    "section_name": "CAST(p_size AS STRING)",
    "garment_group_name": "p_type",
    "index_name": "split_part(p_name, ' ', 2)",
    "index_group_name": "CASE WHEN p_size > 40 THEN '' ELSE p_brand END",
}
# One gift card per nation: articles that nobody has bought.
NATION_COLUMNS = {
    "article_id": "concat('90000000', lpad(CAST(n_nationkey AS STRING), 2, '0'))",
    "prod_name": "concat('Gift  card ', n_name)",
    "product_type_name": "''",
    "product_group_name": "'Gift'",
    "colour_group_name": "'  '",
    "perceived_colour_master_name": "''",
    "department_name": "'Service'",
    "section_name": "''",
    "garment_group_name": "'GIFT'",
    "index_name": "''",
    "index_group_name": "''",
}
TRANSACTION_COLUMNS = {
    "t_dat": "CAST(o_orderdate AS DATE)",
    "customer_id": "CAST(o_custkey AS STRING)",
    "article_id": "lpad(CAST(l_partkey AS STRING), 10, '0')",
    "price": "l_extendedprice",
    "sales_channel_id": "CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END",
    "row_no": "l_orderkey * 10 + l_linenumber",
}
# The same purchases as raw text, with unreadable dates and prices.
TRANSACTION_TEXT_COLUMNS = {
    "t_dat": "CASE WHEN l_tax = 0.08 AND l_quantity > 45 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "customer_id": "CAST(o_custkey AS STRING)",
    "article_id": "CASE WHEN l_discount = 0.1 AND l_quantity < 3 THEN ' ' ELSE lpad(CAST(l_partkey AS STRING), 10, '0') END",
    "price": "CASE WHEN l_discount = 0.0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END",
    "sales_channel_id": "CASE WHEN l_linestatus = 'O' THEN '2' ELSE '1' END",
}
EMBEDDING_COLUMNS = {
    "item_id": "lpad(CAST(vec_id AS STRING), 10, '0')",
    "embedding": "embedding",
    "category": "CAST(label AS STRING)",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of a base table; its schema is read from the file footer once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def customers_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _project(table(spark, folder, "customer"), CUSTOMER_COLUMNS).unionByName(
        _project(table(spark, folder, "supplier"), SUPPLIER_COLUMNS)
    )


def articles_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _project(table(spark, folder, "part"), PART_COLUMNS).unionByName(
        _project(table(spark, folder, "nation"), NATION_COLUMNS)
    )


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def transactions_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _project(_order_lines(spark, folder), TRANSACTION_COLUMNS)


def transactions_text(spark: SparkSession, folder: str) -> DataFrame:
    return _project(_order_lines(spark, folder), TRANSACTION_TEXT_COLUMNS)


def interaction_events(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("category"))
    events = table(spark, folder, "events").withColumn(
        "p_partkey", F.get_json_object("props", "$.k").cast("long")
    )
    return events.join(parts, "p_partkey", "left").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("item_id"),
        "event_type",
        "category",
        F.col("ts").alias("arrival"),
        "event_id",
    )


def item_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return _project(table(spark, folder, "embeddings"), EMBEDDING_COLUMNS)


def ab_long(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and purchases; even users are the control group."""
    return (
        table(spark, folder, "events")
        .where(F.col("event_type").isin("click", "purchase"))
        .select(
            F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("group"),
            F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("value"),
        )
    )


# DuckDB definitions of the same tables, for the SQL checks.
DUCK_TABLES = {
    "customers_raw": f"SELECT {select_list(CUSTOMER_COLUMNS)} FROM customer "
                     f"UNION ALL SELECT {select_list(SUPPLIER_COLUMNS)} FROM supplier",
    "articles_raw": f"SELECT {select_list(PART_COLUMNS)} FROM part "
                    f"UNION ALL SELECT {select_list(NATION_COLUMNS)} FROM nation",
    "transactions_raw": f"SELECT {select_list(TRANSACTION_COLUMNS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "transactions_text": f"SELECT {select_list(TRANSACTION_TEXT_COLUMNS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "interaction_events": "SELECT CAST(user_id AS STRING) AS user_id, lpad(props->>'k', 10, '0') AS item_id, event_type, "
                          "p_type AS category, ts AS arrival, event_id FROM events "
                          "LEFT JOIN part ON p_partkey = CAST(props->>'k' AS BIGINT)",
    "item_embeddings": f"SELECT {select_list(EMBEDDING_COLUMNS)} FROM embeddings",
    "ab_long": "SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS \"group\", "
               "CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value "
               "FROM events WHERE event_type IN ('click', 'purchase')",
}
