"""Queries over sampling and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailspark.functions.hashing import draw
from retailspark.operators import features, sampling
from retailspark.registry.core import part, query, shared, shared_if_built
from retailspark.registry.features import known
from retailspark.registry.tables import articles, customers
from retailspark.sources import shop

SEED = 42


def sql_draw(*xs: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(xs)})), 1, 15))::BIGINT"


def draw_parts(prefix: str, requests: str, index: str, seen: str, blocked: str | None = None) -> str:
    """Check SQL of the unseen-article draws; returns the name of the result."""
    blocked_n = (f"LEFT JOIN (SELECT customer_id, anchor, count(*) AS blocked_n FROM {blocked} GROUP BY 1, 2) b "
                 f"USING (customer_id, anchor)") if blocked else "CROSS JOIN (SELECT 0 AS blocked_n) b"
    open_only = f"ANTI JOIN {blocked} USING (customer_id, anchor, article_id)" if blocked else ""
    p = prefix
    part(f"{p}_sized", f"""SELECT *, pool_size >= 8 * (taken + wanted) AS sparse FROM (SELECT r.customer_id, r.anchor, r.pool, s.pool_size,
      coalesce(n.seen_n, 0) AS seen_n, coalesce(b.blocked_n, 0) AS blocked_n, coalesce(n.seen_n, 0) + coalesce(b.blocked_n, 0) AS taken,
      least(r.wanted, s.pool_size - coalesce(n.seen_n, 0) - coalesce(b.blocked_n, 0)) AS wanted
      FROM {requests} r JOIN (SELECT pool, max(pool_size) AS pool_size FROM {index} GROUP BY 1) s USING (pool)
      LEFT JOIN (SELECT customer_id, pool, count(*) AS seen_n FROM {seen} JOIN {index} USING (article_id) GROUP BY 1, 2) n USING (customer_id, pool)
      {blocked_n}) WHERE wanted > 0""")
    part(f"{p}_draws", f"""SELECT *, {sql_draw(str(SEED), 'customer_id', 'anchor', 'pool', 'draw_no')} % pool_size AS ordinal
      FROM (SELECT *, unnest(range(wanted * 2 + 20)) AS draw_no FROM {p}_sized WHERE sparse)""")
    part(f"{p}_placed", f"""SELECT customer_id, anchor, pool, article_id, max(wanted) AS wanted,
      row_number() OVER (PARTITION BY customer_id, anchor, pool ORDER BY min(draw_no)) AS place
      FROM {p}_draws JOIN {index} USING (pool, ordinal) ANTI JOIN {seen} USING (customer_id, article_id) {open_only} GROUP BY 1, 2, 3, 4""")
    part(f"{p}_lists", f"""SELECT customer_id, pool, article_id, row_number() OVER (PARTITION BY customer_id, pool
      ORDER BY {sql_draw(str(SEED), 'customer_id', 'pool', 'article_id')}, article_id) AS slot
      FROM (SELECT DISTINCT customer_id, pool FROM {p}_sized WHERE NOT sparse) JOIN {index} USING (pool)
      ANTI JOIN {seen} USING (customer_id, article_id)""")
    part(f"{p}_steps", f"""SELECT *, ({sql_draw(str(SEED), 'customer_id', 'anchor', 'pool')} + step) % (pool_size - seen_n) + 1 AS slot
      FROM (SELECT *, unnest(range(least(wanted + blocked_n, pool_size - seen_n))) AS step FROM {p}_sized WHERE NOT sparse)""")
    part(f"{p}_runs", f"""SELECT customer_id, anchor, pool, article_id, wanted, row_number() OVER (PARTITION BY customer_id, anchor, pool ORDER BY step) AS place
      FROM {p}_steps JOIN {p}_lists USING (customer_id, pool, slot) {open_only}""")
    part(f"{p}_picked", f"""SELECT customer_id, anchor, article_id FROM {p}_placed WHERE place <= wanted
      UNION ALL SELECT customer_id, anchor, article_id FROM {p}_runs WHERE place <= wanted""")
    return f"{p}_picked"


part("pairs", """SELECT customer_id, article_id, arg_min(price, row(t_dat, row_no, price, sales_channel_id)) AS price,
  arg_min(sales_channel_id, row(t_dat, row_no, price, sales_channel_id)) AS sales_channel_id, count(*) - 1 AS repeats FROM known GROUP BY 1, 2""")
part("all_index", "SELECT '*' AS pool, article_id, row_number() OVER (ORDER BY article_id) - 1 AS ordinal, count(*) OVER () AS pool_size FROM articles")
part("category_index", """SELECT main_category AS pool, article_id, row_number() OVER (PARTITION BY main_category ORDER BY article_id) - 1 AS ordinal,
  count(*) OVER (PARTITION BY main_category) AS pool_size FROM articles""")
part("neg_requests", "SELECT customer_id, '' AS anchor, '*' AS pool, count(*) AS wanted FROM pairs GROUP BY 1")
NEGATIVES = draw_parts("neg", "neg_requests", "all_index", "pairs")
part("dense_requests", "SELECT customer_id, '' AS anchor, '*' AS pool, count(*) * 6 AS wanted FROM pairs GROUP BY 1")
DENSE_NEGATIVES = draw_parts("dense", "dense_requests", "all_index", "pairs")
part("anchors", "SELECT customer_id, article_id AS anchor, main_category FROM pairs JOIN articles USING (article_id)")
part("hard_requests", "SELECT customer_id, anchor, main_category AS pool, 2 AS wanted FROM anchors")
HARD = draw_parts("hard", "hard_requests", "category_index", "pairs")
part("rest_requests", f"""SELECT customer_id, anchor, '*' AS pool, 4 - coalesce(got, 0) AS wanted FROM anchors
  LEFT JOIN (SELECT customer_id, anchor, count(*) AS got FROM {HARD} GROUP BY 1, 2) USING (customer_id, anchor)""")
REST = draw_parts("rest", "rest_requests", "all_index", "pairs", blocked=HARD)


def pairs(spark, d):
    return sampling.distinct_pairs(known(spark, d))


@query("distinct_pairs", "SELECT customer_id, article_id, round(price, 9) AS price, sales_channel_id, repeats FROM pairs")
def distinct_pairs(spark, d):
    return pairs(spark, d)


@query("positive_pairs", f"""SELECT customer_id, article_id, round(arg_min(price, row(t_dat, row_no, price)), 9) AS price FROM transactions_raw
  WHERE sales_channel_id = 2 GROUP BY 1, 2""")
def positive_pairs(spark, d):
    rows = shop.transactions_raw(spark, d).withColumn(
        "label", F.when(F.col("sales_channel_id") == 2, "yes").otherwise("0")
    )
    return sampling.positive_pairs(rows, ["t_dat", "row_no", "price"]).select("customer_id", "article_id", "price")


@query("sample_negatives", f"SELECT customer_id, article_id FROM {NEGATIVES}")
def sample_negatives(spark, d):
    return sampling.sample_negatives(pairs(spark, d), articles(spark, d), 1, SEED)


@query("sample_negatives_dense", f"SELECT customer_id, article_id FROM {DENSE_NEGATIVES}")
def sample_negatives_dense(spark, d):
    return sampling.sample_negatives(pairs(spark, d), articles(spark, d), 6, SEED)


@query("sample_hard_negatives", f"""SELECT customer_id, anchor, article_id, true AS is_hard FROM {HARD}
  UNION ALL SELECT customer_id, anchor, article_id, false AS is_hard FROM {REST}""")
def sample_hard_negatives(spark, d):
    return sampling.sample_hard_negatives(pairs(spark, d), articles(spark, d), 4, 0.5, SEED)


part("train_rows", f"""SELECT r.*, c.age, c.age_bucket, c.fashion_news_frequency, c.club_member_status, a.* EXCLUDE (article_id),
  concat_ws('_', c.age_bucket, a.category) AS age_category, concat_ws('_', c.age_bucket, a.color) AS age_color,
  concat_ws('_', c.club_member_status, a.category) AS member_category, concat_ws('_', c.fashion_news_frequency, a.category) AS fashion_category
  FROM (SELECT customer_id, article_id, 1 AS label, price, sales_channel_id FROM pairs
        UNION ALL SELECT customer_id, article_id, 0, NULL, -1 FROM {NEGATIVES}) r
  JOIN customers c USING (customer_id) JOIN articles a USING (article_id)""")


def build_train(spark, d):
    return sampling.ranking_train(known(spark, d), customers(spark, d), articles(spark, d), 1, SEED)


def train(spark, d):
    return shared("train", spark, d, build_train)


def train_once(spark, d):
    """Training rows for one pass: those staged before, or else as a plan, in which columns that are not read do not move."""
    built = shared_if_built("train", spark, d)
    return build_train(spark, d) if built is None else built


def train_columns(spark, d, *columns):
    """Some columns of the training rows, staged without the others unless all are staged already."""
    if shared_if_built("train", spark, d) is not None:
        return train(spark, d).select(*columns)
    return shared("train-" + "-".join(columns), spark, d, lambda s, f: build_train(s, f).select(*columns))


@query("ranking_train", "SELECT * REPLACE (round(price, 9) AS price) FROM train_rows")
def ranking_train(spark, d):
    return build_train(spark, d)


@query("ranking_train_stats", """SELECT count(DISTINCT customer_id) AS users_seen, (SELECT count(*) FROM pairs) AS unique_pairs_kept,
  (SELECT CAST(sum(repeats) AS BIGINT) FROM pairs) AS duplicate_purchase_rows, count(*) FILTER (label = 1) AS positives_written,
  count(*) FILTER (label = 0) AS negatives_written,
  (SELECT count(*) FROM (SELECT customer_id FROM train_rows GROUP BY 1 HAVING max(label) = 1 AND min(label) = 1)) AS users_without_negative_candidates
  FROM train_rows""")
def ranking_train_stats(spark, d):
    return sampling.ranking_train_stats(train(spark, d), pairs(spark, d))


HOLDOUT = f"(CASE WHEN {sql_draw(str(SEED), 'customer_id')} % 10000 < 2000 THEN 'validation' ELSE 'train' END)"


@query("user_holdout", f"SELECT {HOLDOUT} AS side, count(*) AS n, count(DISTINCT customer_id) AS users FROM pairs GROUP BY 1")
def user_holdout(spark, d):
    return sampling.user_holdout(pairs(spark, d), 0.2, SEED).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("users")
    )


@query("split_metadata", f"""SELECT {HOLDOUT} AS side, count(*) AS rows, count(DISTINCT customer_id) AS users,
  count(DISTINCT article_id) AS items FROM pairs GROUP BY 1""")
def split_metadata(spark, d):
    split = sampling.user_holdout(pairs(spark, d), 0.2, SEED)
    return features.split_metadata(split.where("side = 'train'"), split.where("side = 'validation'"))


# The row limit is the operator: the n users with the smallest hash.
@query("stable_user_sample", f"SELECT customer_id FROM (SELECT DISTINCT customer_id FROM pairs) ORDER BY md5(concat('{SEED}:', customer_id)), customer_id LIMIT 500")
def stable_user_sample(spark, d):
    return sampling.stable_user_sample(pairs(spark, d), 500, SEED)


@query("stratified_split", f"""SELECT sales_channel_id, customer_id, article_id, CASE WHEN row_number() OVER (PARTITION BY sales_channel_id
  ORDER BY {sql_draw(str(SEED), 'customer_id', 'article_id')}, customer_id, article_id) <= round(count(*) OVER (PARTITION BY sales_channel_id) * 0.2)
  THEN 'validation' ELSE 'train' END AS side FROM pairs""")
def stratified_split(spark, d):
    rows = pairs(spark, d).select("customer_id", "article_id", "sales_channel_id")
    return sampling.stratified_split(rows, "sales_channel_id", ["customer_id", "article_id"], 0.2, SEED)


# The row limit is the operator: a sample of fixed size.
@query("sample_rows", f"SELECT article_id, prod_name FROM articles ORDER BY md5(concat('{SEED}:', article_id)), article_id LIMIT 1000")
def sample_rows(spark, d):
    return sampling.sample_rows(articles(spark, d), 1000, "article_id", SEED).select("article_id", "prod_name")


part("truth", "SELECT DISTINCT customer_id, article_id FROM train_rows WHERE label = 1")


@query("ground_truth", "SELECT * FROM truth")
def ground_truth(spark, d):
    return features.ground_truth(train(spark, d).withColumn("is_positive", F.col("label") == 1))


@query("dataset_metadata", """SELECT count(*) AS rows, count(DISTINCT customer_id) AS users, count(DISTINCT article_id) AS items,
  count(*) FILTER (label = 1) AS positive_rows, count(*) FILTER (label <> 1) AS negative_rows FROM train_rows""")
def dataset_metadata(spark, d):
    return features.dataset_metadata(train(spark, d).withColumn("is_positive", F.col("label") == 1))


@query("user_entity_table", """SELECT customer_id, arg_min(age_bucket, article_id) AS age_bucket, arg_min(club_member_status, article_id) AS club_member_status,
  'UNKNOWN' AS region, arg_min(age, article_id) AS age, 0.0::DOUBLE AS income FROM train_rows GROUP BY 1""")
def user_entity_table(spark, d):
    return features.entity_table(
        train(spark, d), "customer_id", ["article_id"], ["age_bucket", "club_member_status", "region"], ["age", "income"]
    )


@query("item_entity_table", """SELECT article_id, any_value(category) AS category, any_value(main_category) AS main_category,
  any_value(color) AS color, 0.0::DOUBLE AS popularity FROM train_rows GROUP BY 1""")
def item_entity_table(spark, d):
    return features.entity_table(
        train(spark, d), "article_id", ["customer_id"], ["category", "main_category", "color"], ["popularity"]
    )


@query("hash_draw", f"SELECT o_orderkey, {sql_draw('7', 'o_orderkey', 'o_custkey')} AS draw FROM orders")
def hash_draw(spark, d):
    return shop.table(spark, d, "orders").select(
        "o_orderkey", draw(7, F.col("o_orderkey"), F.col("o_custkey")).alias("draw")
    )
