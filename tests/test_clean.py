import pytest
from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.operators import clean as clean_ops
from retailspark.sources import tables


def values(spark, texts, rule, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(rule("x")).collect()]


def test_text_rules(spark):
    assert values(spark, [" a \t b ", "", None, " x "], c.normalize_text) == ["a b", "UNKNOWN", "UNKNOWN", "x"]
    assert values(spark, ["none", "None", "Monthly ", "weekly", None], c.normalize_news_frequency) == [
        "NONE", "NONE", "MONTHLY", "UNKNOWN", "UNKNOWN"
    ]
    assert values(spark, ["left  club", "new tier", " "], c.normalize_member_status) == ["LEFT CLUB", "NEW TIER", "UNKNOWN"]


def test_ages(spark):
    texts = ["25", "25.9", "-1", "-0.5", "120", "121", "inf", "12d", "1e1", "", None]
    assert values(spark, texts, c.parse_age) == [25, 25, -1, 0, 120, -1, -1, -1, 10, -1, -1]
    assert values(spark, [-1, 0, 19, 20, 59, 60, None], c.age_bucket, "int") == [
        "unknown", "under_20", "under_20", "20s", "50s", "60_plus", "unknown"
    ]


def test_ids_dates_prices(spark):
    assert values(spark, ["108775015", " 12 ", "12345678901", "ab1"], c.normalize_article_id) == [
        "0108775015", "0000000012", "12345678901", "ab1"
    ]
    assert [str(v) for v in values(spark, ["2020-02-29", "2020-13-01", "2020-1-1", "x", None], c.parse_date)] == [
        "2020-02-29", "None", "None", "None", "None"
    ]
    assert values(spark, ["1.5", "", "x", None, "1.5f"], c.parse_price) == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_item_lists(spark):
    texts = ["['a', 'b,c']", '["x"]', "('p', 'q',)", "a|b| |c", "a, b,", "[1, 2]", "7", "", None]
    assert values(spark, texts, c.parse_item_list) == [
        ["a", "b,c"], ["x"], ["p", "q"], ["a", "b", "c"], ["a", "b"], ["1", "2"], ["7"], [], []
    ]


def test_interest_and_numbers(spark):
    assert values(spark, ['{"a": 2}', "[1]", "x", None], c.parse_interest) == [{"a": 2.0}, None, None, None]
    assert values(spark, ["yes", "No", "3.5", "abc", None], c.safe_numeric) == [1.0, 0.0, 3.5, 0.0, 0.0]


def test_blank_ids_are_dropped_and_counted(spark):
    raw = spark.createDataFrame(
        [("1", "30", "None", "ACTIVE"), (" ", "31", "", ""), ("2", "x", None, None)],
        "customer_id string, age string, fashion_news_frequency string, club_member_status string",
    )
    assert clean_ops.clean_customers(raw).count() == 2
    assert clean_ops.customer_quality(raw).first().asDict() == {
        "rows_read": 3, "rows_written": 2, "blank_ids": 1, "unknown_ages": 1
    }


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="club_member_status"):
        tables.require_columns(spark.range(1).withColumn("age", F.lit(1)), ["age", "club_member_status"], "customers")


def test_csv_keeps_leading_zeros_and_any_column_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("0108775015", "2")], "article_id string, sales_channel_id string")
    tables.write_table(df.select("sales_channel_id", "article_id"), path, "csv", gzip=True)
    back = tables.read_table(spark, path, "article_id string, sales_channel_id int", "csv")
    assert [tuple(r) for r in back.collect()] == [("0108775015", 2)]
    with pytest.raises(ValueError, match="price"):
        tables.read_table(spark, path, "price string", "csv")


def test_first_existing(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_table(spark.range(3), path)
    assert tables.first_existing(spark, [path + "x", path], "id bigint").count() == 3
    assert tables.first_existing(spark, [path + "x"], "id bigint", empty_if_missing=True).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [path + "x"], "id bigint")
