"""Tables that are kept up to date: totals, sketches, and counters observed while writing."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from retailspark.operators import clean, features, totals_state
from retailspark.sources import tables

ROWS = "customer_id string, article_id string, t_dat date, price double, sales_channel_id int"


def purchases(seed, n):
    draw = random.Random(seed)
    first = dt.date(2020, 1, 1)
    return [
        (f"c{draw.randrange(30)}", f"a{draw.randrange(40)}", first + dt.timedelta(days=draw.randrange(300)), draw.randrange(1, 5000) / 100, draw.choice([1, 2]))
        for _ in range(n)
    ]


def rounded(df, key):
    return {r[key]: tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_appended_batches_equal_the_whole(spark, tmp_path):
    rows = purchases(1, 3000)
    # Batches overlap in time: some rows of a batch are older than the one before.
    parts = [[], [], []]
    draw = random.Random(2)
    for r in rows:
        at = min(2, (r[2] - dt.date(2020, 1, 1)).days // 110)
        parts[min(2, at + (draw.random() < 0.1))].append(r)
    path = str(tmp_path / "totals")
    for number, part in enumerate(parts, 1):
        frame = spark.createDataFrame(part, ROWS)
        for _ in range(2 if number == 2 else 1):  # a replay changes nothing
            totals_state.append_purchases(spark, path, frame, number, max(r[2] for r in part))
        seen = spark.createDataFrame([r for p in parts[:number] for r in p], ROWS)
        last = F.lit(max(r[2] for p in parts[:number] for r in p))
        for key, whole in (("customer_id", features.user_totals(seen)), ("article_id", features.item_totals(seen))):
            want = whole.join(features.recency_windows(seen, key, last), key)
            got = totals_state.kept_totals(spark, path, key)
            assert rounded(got.select(*sorted(got.columns)), key) == rounded(want.select(*sorted(want.columns)), key)


def test_only_months_that_leave_a_window_are_read(spark, tmp_path):
    path = str(tmp_path / "totals")
    frame = spark.createDataFrame(purchases(3, 800), ROWS)
    totals_state.append_purchases(spark, path, frame.where("t_dat < '2020-09-01'"), 1, dt.date(2020, 8, 31), keys=["customer_id"])
    days = spark.read.parquet(f"{path}/customer_id/days")
    gone = totals_state.expired_sums(days, "customer_id", dt.date(2020, 8, 31), dt.date(2020, 9, 3), (7, 30))
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"month#\d+ (IN \(202008\)|= 202008)", plan)
    assert totals_state._months(dt.date(2020, 8, 2), dt.date(2020, 8, 5)) == [202008]
    assert totals_state._months(dt.date(2019, 12, 30), dt.date(2020, 2, 1)) == [201912, 202001]


def test_batches_come_in_order(spark, tmp_path):
    frame = spark.createDataFrame(purchases(4, 20), ROWS)
    with pytest.raises(ValueError):
        totals_state.append_purchases(spark, str(tmp_path / "t"), frame, 2, dt.date(2020, 12, 31))


def test_sketches_of_days_unite(spark, tmp_path):
    txn = spark.createDataFrame(purchases(5, 4000), ROWS)
    path = str(tmp_path / "sketches")
    tables.write_daily_sketches(txn, path)
    tables.write_daily_sketches(txn.where("month(t_dat) = 3"), path)  # a month that comes again is replaced
    stored = spark.read.parquet(path)
    got = tables.profile_of_sketches(stored.where("t_dat >= '2020-02-10' AND t_dat < '2020-05-01'")).first()
    want = tables.profile_transactions(txn.where("t_dat >= '2020-02-10' AND t_dat < '2020-05-01'")).first()
    assert got == want


def test_counters_come_from_the_scan_that_writes(spark, tmp_path):
    rows = [("1", "20", "None", "ACTIVE"), (" ", "30", "NONE", "x"), ("2", "old", "Regularly", None), (None, "1", "", "")]
    raw = spark.createDataFrame(rows, "customer_id string, age string, fashion_news_frequency string, club_member_status string")
    path = str(tmp_path / "customers")
    counts = clean.write_counted(raw, clean.clean_customers, clean.customer_counters(), path)
    assert counts.first() == clean.customer_quality(raw).first()
    assert spark.read.parquet(path).count() == counts.first()["rows_written"] == 2
