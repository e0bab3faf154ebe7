"""Queries over retrieval, ranking, re-ranking, experiments and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from retailspark.functions import vectors
from retailspark.operators import abtest, evaluation, feature_factors, joins, ranking, rerank, retrieval, retrieval_train, sampling
from retailspark.operators import candidates as cand
from retailspark.operators import windows
from retailspark.plans import flows
from retailspark.plans.staging import stage_path, staged
from retailspark.registry.core import part, query
from retailspark.registry.evaluation import K, POOL, enriched_rows, interest_text, rows_with_truth, scores_part, sessions
from retailspark.registry.features import catalog
from retailspark.registry.sampling import HOLDOUT, SEED, pairs, sql_draw, train, train_columns, train_once
from retailspark.registry.tables import articles, customers
from retailspark.session import shared_folder
from retailspark.sources import reports, shop, tables
from retailspark.streaming import monitor, session_state

DIM = 64
D = "CAST(embedding AS DOUBLE[])"
UNIT = f"list_transform({D}, lambda x: x / sqrt(list_dot_product({D}, {D})))"
part("unit_items", f"SELECT item_id, category, {UNIT} AS embedding FROM item_embeddings")


def _sixth(column):
    return F.array_join(F.transform(column, lambda x: F.round(x, 6).cast("decimal(12,6)").cast("string")), ",")


def _sixth_sql(expr):
    return f"array_to_string(list_transform({expr}, lambda x: CAST(CAST(round(x, 6) AS DECIMAL(12,6)) AS STRING)), ',')"


def items(spark, d):
    return shop.item_embeddings(spark, d)


@query("l2_normalize", f"SELECT item_id, {_sixth_sql(f'list_transform({D}, lambda x: (x * 3) / sqrt(9 * list_dot_product({D}, {D})))')} AS unit FROM item_embeddings")
def l2_normalize(spark, d):
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    return items(spark, d).select("item_id", _sixth(vectors.l2_normalize(tripled)).alias("unit"))


part("pair_vectors", f"""SELECT a.item_id, a.embedding AS text_vec, CASE WHEN a.category < '5' THEN b.embedding END AS image_vec
  FROM unit_items a JOIN unit_items b ON CAST(b.item_id AS BIGINT) = (CAST(a.item_id AS BIGINT) + 1) % (SELECT count(*) FROM unit_items)""")
part("hybrid_vectors", """SELECT item_id, CASE WHEN image_vec IS NULL THEN text_vec ELSE list_transform(list_zip(text_vec, image_vec), lambda p: (p[1] + p[2]) / 2) END AS v,
  CASE WHEN image_vec IS NULL THEN 'text' ELSE 'hybrid' END AS mode FROM pair_vectors""")


@query("query_vector", f"SELECT item_id, mode, {_sixth_sql('list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))')} AS vector FROM hybrid_vectors")
def query_vector(spark, d):
    own = items(spark, d)
    n = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    other = own.select(F.col("item_id").cast("long").alias("next_no"), F.col("embedding").alias("next_vec"))
    joined = own.withColumn("next_no", (F.col("item_id").cast("long") + 1) % n).join(other, "next_no").select(
        "item_id", F.col("embedding").alias("text_vec"), F.when(F.col("category") < "5", F.col("next_vec")).alias("image_vec")
    )
    return joined.select(
        "item_id", vectors.query_mode("text_vec", "image_vec").alias("mode"),
        _sixth(vectors.query_vector("text_vec", "image_vec", DIM)).alias("vector"),
    )


@query("combine_vectors", f"SELECT item_id, {_sixth_sql('list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))')} AS vector FROM hybrid_vectors")
def combine_vectors(spark, d):
    own = items(spark, d)
    n = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    other = own.select(F.col("item_id").cast("long").alias("next_no"), F.col("embedding").alias("next_vec"))
    joined = own.withColumn("next_no", (F.col("item_id").cast("long") + 1) % n).join(other, "next_no")
    second = F.when(F.col("category") < "5", F.col("next_vec"))
    zero = F.array_repeat(F.lit(0.0), DIM)
    return joined.select("item_id", _sixth(vectors.combine_vectors(["embedding", second, zero], DIM)).alias("vector"))


@query("fit_dimension", f"SELECT item_id, {_sixth_sql(f'list_transform({D}[1:48], lambda x: x / sqrt(list_dot_product({D}[1:48], {D}[1:48])))')} AS short_vector, "
       f"{_sixth_sql(UNIT)} AS same_vector FROM item_embeddings")
def fit_dimension(spark, d):
    return items(spark, d).select(
        "item_id",
        _sixth(vectors.fit_dimension(F.array("embedding"), 48)).alias("short_vector"),
        _sixth(vectors.fit_dimension(F.array("embedding", "embedding"), DIM)).alias("same_vector"),
    )


part("all_hits", """SELECT q.item_id AS query_id, i.item_id, list_dot_product(q.embedding, i.embedding) AS score FROM unit_items q CROSS JOIN unit_items i""")
part("best_hits", "SELECT * REPLACE (round(score, 6) + 0.0 AS score) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS position FROM all_hits) WHERE position <= 10")


def queries_of(spark, d):
    return items(spark, d).select(F.col("item_id").alias("query_id"), "embedding")


@query("top_k_similar", "SELECT * FROM best_hits")
def top_k_similar(spark, d):
    return retrieval.top_k_similar(queries_of(spark, d), items(spark, d), 10, DIM)


@query("top_k_similar_approx")
def top_k_similar_approx(spark, d):
    return retrieval.top_k_similar_approx(queries_of(spark, d), items(spark, d), 10, cells=16, probes=12, dim=DIM)


@query("approx_recall", "SELECT count(*) AS queries, sum(least(10, (SELECT count(*) FROM unit_items)))::BIGINT AS exact_hits, true AS recall_at_least_0_9 FROM unit_items")
def approx_recall(spark, d):
    """Share of the exact hits that the search of the nearest cells finds."""
    keys = ["query_id", "item_id"]
    exact = staged(top_k_similar(spark, d).select(*keys), "exact_hits")
    found = top_k_similar_approx(spark, d).select(*keys).withColumn("found", F.lit(1))
    return exact.join(found, keys, "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("exact_hits"),
        (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_at_least_0_9"),
    )


@query("top_k_similar_all_cells", "SELECT * FROM best_hits")
def top_k_similar_all_cells(spark, d):
    """Probing every cell is exact."""
    return retrieval.top_k_similar_approx(queries_of(spark, d), items(spark, d), 10, cells=16, probes=16, dim=DIM)


@query("search_results", """SELECT query_id, h.item_id AS product_id, coalesce(a.prod_name, '') AS name, round(CAST(score AS DECIMAL(12,6)), 4)::DOUBLE AS score,
  round(coalesce(p.price, 0), 9)::DOUBLE AS price, position, 10 AS total_count FROM best_hits h LEFT JOIN articles a ON a.article_id = h.item_id
  LEFT JOIN (SELECT article_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price FROM transactions_raw GROUP BY 1) p ON p.article_id = a.article_id""")
def search_results(spark, d):
    named = joins.item_prices(articles(spark, d), shop.transactions_raw(spark, d)).select(
        F.col("article_id").alias("item_id"), F.col("prod_name").alias("name"), "price"
    )
    return retrieval.search_results(staged(top_k_similar(spark, d), "hits"), named)


@query("check_vector_table", "SELECT count(*) AS rows_read, count(*) FILTER (category <> '3') AS usable_rows, count(*) FILTER (category = '3') AS wrong_width, 0 AS missing_ids FROM item_embeddings")
def check_vector_table(spark, d):
    mixed = items(spark, d).withColumn(
        "embedding", F.when(F.col("category") == "3", F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    )
    return retrieval.check_vector_table(mixed, DIM)


@query("save_and_load_embeddings", f"SELECT item_id, category, round(sqrt(list_dot_product({UNIT}, {UNIT})), 5)::DOUBLE AS size FROM item_embeddings")
def save_and_load_embeddings(spark, d):
    own = items(spark, d)
    path = stage_path(own, "embeddings")
    tables.save_embeddings(own, path)
    return tables.load_embeddings(spark, path).select("item_id", "category", F.round(vectors.length("embedding"), 5).alias("size"))


part("user_vectors", f"SELECT item_id AS customer_id, {D} AS embedding, category FROM item_embeddings")


@query("user_item_top_k", f"""SELECT customer_id, article_id, round(score, 6) + 0.0 AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS position
  FROM (SELECT u.customer_id, i.item_id AS article_id, list_dot_product(u.embedding, CAST(i.embedding AS DOUBLE[])) AS score
        FROM user_vectors u CROSS JOIN item_embeddings i WHERE u.category <> i.category)) WHERE position <= 10""")
def user_item_top_k(spark, d):
    own = items(spark, d)
    # Every vector of the own category counts as seen.
    return retrieval.user_item_top_k(
        own.withColumnRenamed("item_id", "customer_id"), own.withColumnRenamed("item_id", "article_id"), 10, dim=DIM, apart="category"
    )


# --- ranking -------------------------------------------------------------------------
_models: dict[tuple, str] = {}


def ranker_path(spark, d):
    """A ranker fitted once per session and folder, saved in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _models:
        rows = train(spark, d)
        path = stage_path(rows, "ranker")
        model, report, _ = ranking.fit_ranker_holdout(rows, 0.2, SEED)
        ranking.save_ranker(model, rows, path, report)
        _models[key] = path
    return _models[key]


def scored_rows(spark, d):
    rows, truth, users = enriched_rows(spark, d)
    model, numeric, text = ranking.load_ranker(spark, ranker_path(spark, d))
    return ranking.score_candidates(rows, model, numeric, text), truth, users


# What a summary reads of scored rows; the feature columns are not carried along.
SUMMARY_COLUMNS = ("customer_id", "article_id", "score", "is_positive")


@query("training_matrix", """SELECT label, age, age_bucket, fashion_news_frequency, club_member_status, category, color, age_category FROM train_rows""")
def training_matrix(spark, d):
    return ranking.training_matrix(train_once(spark, d)).select(
        "label", "age", "age_bucket", "fashion_news_frequency", "club_member_status", "category", "color", "age_category"
    )


@query("ranker_holdout", """SELECT sum(n)::BIGINT AS rows, sum(n - held)::BIGINT AS train_rows, sum(held)::BIGINT AS validation_rows,
  sum(held) FILTER (label = 1)::BIGINT AS validation_positives, true AS better_than_chance
  FROM (SELECT label, count(*) AS n, round(count(*) * 0.2)::BIGINT AS held FROM train_rows GROUP BY label)""")
def ranker_holdout(spark, d):
    report = spark.read.schema(
        "rows long, train_rows long, validation_rows long, validation_positives long, feature_columns int, validation_auc double"
    ).json(f"{ranker_path(spark, d)}/report")
    return report.select(
        "rows", "train_rows", "validation_rows", "validation_positives", (F.col("validation_auc") > 0.5).alias("better_than_chance")
    )


@query("fit_and_score_ranker")
def fit_and_score_ranker(spark, d):
    return scored_rows(spark, d)[0].select("customer_id", "article_id", "label", "score")


@query("ranker_scores_are_chances", "SELECT customer_id, article_id, label, true AS is_chance FROM eval_rows")
def ranker_scores_are_chances(spark, d):
    return scored_rows(spark, d)[0].select(
        "customer_id", "article_id", "label", F.col("score").between(0, 1).alias("is_chance")
    )


@query("evaluate_ranker")
def evaluate_ranker(spark, d):
    scored, truth, users = scored_rows(spark, d)
    return evaluation.ranking_summary(staged(scored.select(*SUMMARY_COLUMNS), "scored"), truth, users, K)


@query("ranker_summary_bounds", """SELECT count(*) AS rows_evaluated, (SELECT count(*) FROM eval_users) AS users_evaluated, true AS better_than_chance, true AS shares
  FROM eval_rows""")
def ranker_summary_bounds(spark, d):
    return evaluate_ranker(spark, d).select(
        "rows_evaluated", "users_evaluated", (F.col("auc") > 0.5).alias("better_than_chance"),
        (F.col("hit_rate").between(0, 1) & F.col("ndcg").between(0, 1)).alias("shares"),
    )


@query("align_features", "SELECT c_custkey, CAST(NULL AS STRING) AS region FROM customer")
def align_features(spark, d):
    return joins.align_features(shop.table(spark, d, "customer"), ["c_custkey", "region"]).withColumn(
        "region", F.col("region").cast("string")
    )


@query("min_max_score", """SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 9) AS score FROM customer""")
def min_max_score(spark, d):
    return ranking.min_max_score(shop.table(spark, d, "customer"), "c_acctbal").select("c_custkey", "score")


@query("reason_label", """SELECT customer_id, article_id, CASE WHEN candidate_reason = 'cold_start_popularity' THEN candidate_reason
  WHEN matches_session_interest THEN 'session_interest_match' WHEN matches_recent_click_signal THEN 'recent_click_similarity' ELSE 'ranking_score' END AS reason FROM session_candidates""")
def reason_label(spark, d):
    lists = cand.generate_candidates(sessions(spark, d), catalog(spark, d), pool=POOL, max_clicks=session_state.RECENT_CLICKS)
    return ranking.reason_label(lists).select("customer_id", "article_id", "reason")


@query("popularity_fallback", """SELECT customer_id, article_id, round(popularity / greatest(max(popularity) OVER (PARTITION BY customer_id), 1.0), 9)::DOUBLE AS score,
  'cold_start_popularity' AS reason FROM eval_rows""")
def popularity_fallback(spark, d):
    rows = enriched_rows(spark, d)[0].withColumn("candidate_reason", F.lit(None).cast("string"))
    return ranking.popularity_fallback(rows).select("customer_id", "article_id", "score", "reason")


@query("exploration_slots", """SELECT p_partkey, CASE WHEN p_size <= 2 THEN 0 ELSE least(greatest(1, CAST(round_even(p_size * 0.2, 0) AS INT)), 2) END AS slots,
  CASE WHEN p_size <= 2 THEN '' WHEN least(greatest(1, CAST(round_even(p_size * 0.2, 0) AS INT)), 2) = 1 THEN CAST(least(greatest(p_size // 3, 1), p_size - 1) AS STRING)
  ELSE array_to_string(list_sort(list_distinct([least(greatest(p_size // 3, 1), p_size - 1), least(greatest(p_size * 2 // 3, 2), p_size - 1)])), ',') END AS positions FROM part""")
def exploration_slots(spark, d):
    n = F.col("p_size")
    slots = rerank.exploration_slots(n)
    return shop.table(spark, d, "part").select(
        "p_partkey", slots.alias("slots"), rerank.exploration_positions(n, slots).alias("positions")
    )


# The policy step by step: a row per user and step, the user's rows in lists.
def _guard_sql(name: str, source: str) -> None:
    """No third row in a row from one category while another waits; ``source`` has customer_id, goal, items."""
    part(f"{name}_steps", f"""SELECT customer_id, 0 AS step, goal, items AS waiting, items[1:0] AS chosen FROM {source}
      UNION ALL SELECT customer_id, step + 1, goal, list_filter(waiting, lambda r: r.place <> p.place), list_append(chosen, p)
      FROM (SELECT *, coalesce(list_filter(waiting, lambda r: len(chosen) < 2 OR chosen[-1].category <> chosen[-2].category OR r.category <> chosen[-1].category)[1], waiting[1]) AS p
        FROM {name}_steps WHERE step < goal)""")
    part(name, f"SELECT customer_id, waiting, chosen FROM {name}_steps WHERE step = goal")


def _rerank_sql(name: str, rows: str, n: int) -> None:
    """``rows`` has customer_id, article_id, score, popularity, is_new, category, reason."""
    p = name
    part(f"{p}_items", f"""SELECT customer_id, list({{'place': place, 'article_id': article_id, 'score': score, 'is_new': is_new, 'category': category, 'reason': reason, 'explores': false}} ORDER BY place) AS items,
      least({n}, count(*))::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, popularity DESC, article_id) AS place FROM {rows}) GROUP BY 1""")
    part(f"{p}_whole", f"SELECT customer_id, size AS goal, items FROM {p}_items")
    _guard_sql(f"{p}_guarded", f"{p}_whole")
    part(f"{p}_sized", f"SELECT *, CASE WHEN size <= 2 THEN 0 ELSE least(greatest(1, CAST(round_even(size * 0.2, 0) AS INT)), 2) END AS slots FROM {p}_items")
    part(f"{p}_goals", f"SELECT customer_id, size - slots AS goal, items FROM {p}_sized")
    _guard_sql(f"{p}_first", f"{p}_goals")
    part(f"{p}_picked", f"""SELECT customer_id, size, slots, 0 AS slot, waiting, chosen, list_transform(chosen, lambda r: r.category) AS used, items[1:0] AS picks
      FROM {p}_first JOIN {p}_sized USING (customer_id)
      UNION ALL SELECT customer_id, size, slots, slot + 1, list_filter(waiting, lambda r: r.place <> x.place), chosen, list_append(used, x.category),
        list_append(picks, struct_pack(place := x.place, article_id := x.article_id, score := x.score, is_new := x.is_new, category := x.category,
          reason := CASE WHEN NOT explores THEN x.reason WHEN x.is_new AND new_row IS NOT NULL THEN 'new_item_boost' ELSE 'mab_exploration' END, explores := explores))
      FROM (SELECT *, CASE WHEN explores THEN coalesce(new_row, list_sort(list_transform(waiting, lambda r: struct_pack(uses := len(list_filter(used, lambda u: u = r.category)), item := r)))[1].item)
          ELSE waiting[1] END AS x
        FROM (SELECT *, list_filter(waiting, lambda r: r.is_new)[1] AS new_row, {sql_draw("'42'", 'customer_id', 'slot')} / {16.0 ** 15} < {rerank.EPSILON} AS explores
          FROM {p}_picked WHERE slot < slots AND len(waiting) > 0))""")
    part(f"{p}_explored", f"""SELECT customer_id, size, chosen AS main, picks AS extra, CASE len(picks) WHEN 0 THEN [] WHEN 1 THEN [least(greatest(size // 3, 1), size - 1)]
      ELSE [least(greatest(size // 3, 1), size - 1), least(greatest(size * 2 // 3, 2), size - 1)] END AS places FROM {p}_picked WHERE slot = slots OR len(waiting) = 0""")
    part(f"{p}_merging", f"""SELECT customer_id, size, main, extra, places, 0 AS i, 0 AS m, 0 AS e, main[1:0] AS merged FROM {p}_explored
      UNION ALL SELECT customer_id, size, main, extra, places, i + 1, m + CASE WHEN side THEN 0 ELSE 1 END, e + CASE WHEN side THEN 1 ELSE 0 END, list_append(merged, CASE WHEN side THEN extra[e + 1] ELSE main[m + 1] END)
      FROM (SELECT *, e < len(extra) AND (list_contains(places, i) OR m >= len(main)) AS side FROM {p}_merging WHERE i < size)""")
    part(f"{p}_merged", f"SELECT customer_id, size AS goal, merged AS items FROM {p}_merging WHERE i = size")
    _guard_sql(f"{p}_final", f"{p}_merged")


def _list_sql(name: str, columns: str) -> str:
    return f"SELECT customer_id, {columns} FROM (SELECT customer_id, unnest(chosen) AS r, generate_subscripts(chosen, 1) AS position FROM {name})"


_SHOWN = "r.article_id AS product_id, round(r.score, 9)::DOUBLE AS score, r.reason AS reason, r.explores AS is_exploration, position::INT AS position"
_CATEGORY = "coalesce(nullif(trim(main_category), ''), nullif(trim(category), ''), 'UNKNOWN') AS category"
_BY_POPULARITY = "(popularity / greatest(max(popularity) OVER (PARTITION BY customer_id), 1.0))::DOUBLE AS score, popularity"
_IS_NEW = f"coalesce(is_new_item, false) OR coalesce(item_age_days <= {rerank.NEW_ITEM_DAYS}, false) AS is_new"
part("popularity_scored", f"SELECT customer_id, article_id, {_BY_POPULARITY}, {_IS_NEW}, {_CATEGORY}, 'cold_start_popularity' AS reason FROM eval_rows")
part("served_rows", f"SELECT customer_id, article_id, {_BY_POPULARITY}, {_IS_NEW}, {_CATEGORY}, candidate_reason AS reason FROM (SELECT s.* EXCLUDE (popularity), k.* EXCLUDE (article_id) FROM (SELECT *, 0 AS popularity FROM session_candidates) s JOIN catalog k USING (article_id))")
_rerank_sql("shown", "popularity_scored", 10)
_rerank_sql("served", "served_rows", 10)


def popularity_scored(spark, d):
    """Evaluation rows scored by popularity, which SQL can repeat."""
    return ranking.popularity_fallback(enriched_rows(spark, d)[0].withColumn("candidate_reason", F.lit(None).cast("string")))


@query("diversity_guard", _list_sql("shown_guarded", "r.article_id AS product_id, round(r.score, 9)::DOUBLE AS score, position::INT AS position"))
def diversity_guard(spark, d):
    return rerank.diversity_guard(popularity_scored(spark, d), 10)


@query("rerank", _list_sql("shown_final", _SHOWN))
def rerank_lists(spark, d):
    return rerank.rerank(popularity_scored(spark, d), 10)


# The same evaluation as for a fitted ranker and its lists, over scores that SQL can repeat.
part("score_lists", f"SELECT customer_id, article_id, position FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS position FROM popularity_scored) WHERE position <= {K}")
scores_part("score_scores", "score_lists", "truth", "eval_users", K)
part("labelled_scores", "SELECT s.score, r.label FROM popularity_scored s JOIN eval_rows r USING (customer_id, article_id)")
part("shown_lists", "SELECT customer_id, r.article_id AS article_id, position FROM (SELECT customer_id, unnest(chosen) AS r, generate_subscripts(chosen, 1) AS position FROM shown_final)")
scores_part("shown_scores", "shown_lists", "truth", "eval_users", 10)


@query("score_ranking", "SELECT customer_id, article_id, position FROM score_lists")
def score_ranking(spark, d):
    return windows.score_ranking(popularity_scored(spark, d), K).select("customer_id", "article_id", "position")


@query("ranking_summary", """SELECT (SELECT count(*) FROM eval_rows) AS rows_evaluated, count(*) AS users_evaluated,
  (SELECT round(sum(p * (below + n / 2)) / sum(p) / sum(n), 9)::DOUBLE FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
   FROM (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM labelled_scores GROUP BY 1))) AS auc,
  round(avg(hit_rate), 9)::DOUBLE AS hit_rate, round(avg(ndcg), 9)::DOUBLE AS ndcg FROM score_scores""")
def ranking_summary(spark, d):
    _, truth, users = enriched_rows(spark, d)
    return evaluation.ranking_summary(staged(popularity_scored(spark, d).select(*SUMMARY_COLUMNS), "scored"), truth, users, K)


@query("evaluate_reranked_lists", """SELECT 'all' AS subset, count(*) AS users_evaluated, round(avg(hit_rate), 9)::DOUBLE AS hit_rate, round(avg(ndcg), 9)::DOUBLE AS ndcg,
  round((SELECT count(DISTINCT article_id) FROM shown_lists) / (SELECT count(DISTINCT article_id) FROM train_rows), 9) AS coverage FROM shown_scores
  UNION ALL SELECT 'cold_start', 0, 0.0, 0.0, 0.0""")
def evaluate_reranked_lists(spark, d):
    rows, truth, users = enriched_rows(spark, d)
    shown = rerank.rerank(popularity_scored(spark, d), 10).select("customer_id", F.col("product_id").alias("article_id"), "position")
    total = rows.agg(F.count_distinct("article_id").alias("n")).scalar()
    return evaluation.evaluate_lists(staged(shown, "lists"), truth, users, customers(spark, d), total, 10)


@query("recommend_all")
def recommend_all(spark, d):
    return flows.recommend_all(
        sessions(spark, d), catalog(spark, d), customers(spark, d), ranker_path(spark, d), 10,
        max_clicks=session_state.RECENT_CLICKS,
    )


@query("recommend_all_without_model", _list_sql("served_final", _SHOWN))
def recommend_all_without_model(spark, d):
    return flows.recommend_all(
        sessions(spark, d), catalog(spark, d), customers(spark, d), None, 10, max_clicks=session_state.RECENT_CLICKS
    )


def report(spark, d):
    return staged(flows.full_report(
        train(spark, d), sessions(spark, d), catalog(spark, d), customers(spark, d), ranker_path(spark, d), K, 300
    ), "report")


@query("evaluate_recommender")
def evaluate_recommender(spark, d):
    rows, truth, users = enriched_rows(spark, d)
    model, numeric, text = ranking.load_ranker(spark, ranker_path(spark, d))
    scored = ranking.score_candidates(rows, model, numeric, text).withColumn("reason", F.lit("ranking_score"))
    lists = staged(rerank.rerank(scored, K).select("customer_id", F.col("product_id").alias("article_id"), "position"), "lists")
    total = rows.agg(F.count_distinct("article_id").alias("n")).scalar()
    return evaluation.evaluate_lists(lists, truth, users, customers(spark, d), total, K)


@query("baseline_report_markdown")
def baseline_report_markdown(spark, d):
    record = report(spark, d)
    reports.write_report_json(record, stage_path(record, "report_json"))
    return reports.render_report_markdown(record, os.path.basename(d.rstrip("/")))


@query("metric_alerts_of_report")
def metric_alerts_of_report(spark, d):
    return monitor.metric_alerts(monitor.report_metrics(report(spark, d), K, 300))


@query("metric_alerts", "SELECT 'NDCG@50' AS metric, round(v, 9) AS value, 0.08::DOUBLE AS threshold FROM (SELECT count(*) FILTER (quality = 1) / count(*) / 20 AS v FROM labels) WHERE v < 0.08")
def metric_alerts(spark, d):
    share = shop.table(spark, d, "labels").agg((F.count_if(F.col("quality") == 1) / F.count(F.lit(1))).alias("share"))
    measured = share.select(F.explode(F.array(
        F.struct(F.lit("NDCG@50").alias("metric"), (F.col("share") / 20).alias("value")),
        F.struct(F.lit("auc").alias("metric"), (F.col("share") + 1).alias("value")),
        F.struct(F.lit("other").alias("metric"), F.lit(0.0).alias("value")),
    )).alias("m")).select("m.*")
    return monitor.metric_alerts(measured)


# --- retrieval training --------------------------------------------------------------
part("vocabulary", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", {n} AS token, row_number() OVER (ORDER BY {n}) + 1 AS idx FROM (SELECT DISTINCT {n} FROM articles)" for n in ("category", "color", "department_name")))


@query("fit_vocabulary", "SELECT * FROM vocabulary")
def fit_vocabulary(spark, d):
    return retrieval_train.fit_vocabulary(articles(spark, d), ["category", "color", "department_name"])


@query("encode_features", """SELECT a.article_id, concat(coalesce(v.idx, 1), ',', coalesce(w.idx, 1)) AS categorical, concat(length(prod_name), '.0') AS numeric
  FROM (SELECT *, CASE WHEN color = 'red' THEN 'scarlet' ELSE color END AS shown FROM articles) a
  LEFT JOIN vocabulary v ON v."column" = 'category' AND v.token = a.category LEFT JOIN vocabulary w ON w."column" = 'color' AND w.token = a.shown""")
def encode_features(spark, d):
    own = articles(spark, d)
    vocabulary = staged(retrieval_train.fit_vocabulary(own, ["category", "color", "department_name"]), "vocabulary")
    shown = own.withColumns({
        "color": F.when(F.col("color") == "red", "scarlet").otherwise(F.col("color")), "name_length": F.length("prod_name"),
    })
    return retrieval_train.encode_features(shown, vocabulary, "article_id", ["category", "color"], ["name_length"])


part("train_side", f"SELECT * FROM train_rows WHERE label = 1 AND {HOLDOUT} = 'train'")
part("valid_items", f"SELECT DISTINCT article_id, category, color FROM train_rows WHERE label = 1 AND {HOLDOUT} = 'validation'")
part("train_tokens", " UNION ALL ".join(
    f"SELECT '{n}' AS name, {n} AS token, row_number() OVER (ORDER BY {n}) + 1 AS idx FROM (SELECT DISTINCT {n} FROM train_side)" for n in ("category", "color")))


@query("retrieval_dataset", """SELECT article_id, concat(coalesce(a.idx, 1), ',', coalesce(b.idx, 1)) AS categorical FROM valid_items
  LEFT JOIN train_tokens a ON a.name = 'category' AND a.token = category LEFT JOIN train_tokens b ON b.name = 'color' AND b.token = color""")
def retrieval_dataset(spark, d):
    rows = train_columns(spark, d, "customer_id", "article_id", "label", "age_bucket", "club_member_status", "age", "category", "color")
    built = retrieval_train.retrieval_dataset(
        rows, ["customer_id", "article_id"], ["age_bucket", "club_member_status"], ["age"], ["category", "color"], ["popularity"],
        0.2, SEED,
    )
    return built["validation_items"].select("article_id", "categorical")


def _by_interaction(spark, d):
    """Hold out a fifth of each user's pairs by a hash of the pair."""
    own = pairs(spark, d).select("customer_id", "article_id")
    held = sampling.draw_below(10_000, SEED, F.col("customer_id"), F.col("article_id")) < 2000
    return staged(own.withColumn("held", held), "held_pairs")


@query("fit_embeddings", "SELECT customer_id, 16 AS width FROM (SELECT DISTINCT customer_id FROM pairs) UNION ALL SELECT article_id, 16 FROM (SELECT DISTINCT article_id FROM pairs)")
def fit_embeddings(spark, d):
    users, vectors_ = retrieval_train.fit_embeddings(pairs(spark, d))
    return users.select("customer_id", F.size("embedding").alias("width")).unionByName(
        vectors_.select(F.col("article_id").alias("customer_id"), F.size("embedding").alias("width"))
    )


@query("validation_recall")
def validation_recall(spark, d):
    own = _by_interaction(spark, d)
    users, vectors_ = retrieval_train.fit_embeddings(own.where("NOT held"))
    return retrieval_train.validation_recall(users, vectors_, own.where("NOT held"), own.where("held"), 300)


# Vectors from features, for users that training has not seen.
FEATURES = feature_factors.Features(
    ("age_bucket", "fashion_news_frequency", "club_member_status"), ("article_id", "category", "main_category", "color")
)


@query("unseen_user_recall", f"""SELECT (SELECT count(DISTINCT customer_id) FROM train_rows WHERE label = 1 AND {HOLDOUT} = 'validation') AS users_evaluated,
  true AS every_user_has_a_vector, true AS not_below_popularity""")
def unseen_user_recall(spark, d):
    sides = staged(sampling.user_holdout(train(spark, d), 0.2, SEED, check=False), "factor_sides")
    known, unseen = sides.where("side = 'train'"), sides.where("side = 'validation' AND label = 1")
    factors = feature_factors.fit_feature_factors(known, FEATURES)
    users = feature_factors.user_vectors(customers(spark, d), FEATURES, factors)
    found = feature_factors.unseen_user_recall(
        users, feature_factors.item_vectors(articles(spark, d), FEATURES, factors), unseen, 300
    )
    popular = feature_factors.popularity_recall(known.where("label = 1"), unseen, 300)
    both = found.withColumn("one", F.lit(1)).join(
        popular.select(F.lit(1).alias("one"), F.col("users_evaluated").alias("asked"), F.col("recall").alias("popularity_recall")), "one"
    )
    # Purchases of the tables do not depend on features, so no ranking beats popularity here by more than chance.
    return both.select(
        "users_evaluated", (F.col("users_evaluated") == F.col("asked")).alias("every_user_has_a_vector"),
        (F.col("recall") >= 0.95 * F.col("popularity_recall")).alias("not_below_popularity"),
    )


@query("retrieval_lift")
def retrieval_lift(spark, d):
    rows, truth, users = rows_with_truth(spark, d)
    truth, users = staged(truth, "truth"), staged(users, "users")
    # Vectors come from four fifths of the pairs; both ways are scored on the fifth they have not seen.
    held = sampling.draw_below(10_000, SEED, F.col("customer_id"), F.col("article_id")) < 2000
    split = staged(truth.select("customer_id", "article_id").withColumn("held", held), "lift_pairs")
    known, unseen = split.where("NOT held").drop("held"), split.where("held").drop("held")
    judged = staged(unseen.select("customer_id").distinct().join(users, "customer_id", "left_semi"), "lift_users")
    embedding = retrieval_train.validation_recall(*retrieval_train.fit_embeddings(known), known, unseen, K)
    generated = evaluation.evaluate_candidates(sessions(spark, d), catalog(spark, d), unseen, judged, K, pool=500)
    return evaluation.retrieval_lift(embedding, generated)


@query("experiment_summary")
def experiment_summary(spark, d):
    own = _by_interaction(spark, d)
    grid = retrieval_train.experiment_grid(spark, {"rank": [8, 16], "reg": [0.05], "alpha": [10.0]})
    results = None
    for run in grid.collect():
        users, vectors_ = retrieval_train.fit_embeddings(
            own.where("NOT held"), rank=int(run["rank"]), reg=run["reg"], alpha=run["alpha"], iterations=3
        )
        recall = retrieval_train.validation_recall(users, vectors_, own.where("NOT held"), own.where("held"), 300).select(
            F.lit(run["experiment_id"]).alias("experiment_id"), "recall", "users_evaluated"
        )
        results = recall if results is None else results.unionByName(recall)
    held = own.where("held").select("customer_id", "article_id").distinct()
    generated = evaluation.evaluate_candidates(
        sessions(spark, d), catalog(spark, d), held, held.select("customer_id").distinct(), 300, pool=500
    )
    return retrieval_train.experiment_summary(grid, results, generated.select("recall").scalar())


# --- experiments ---------------------------------------------------------------------
REPLICATES = 200
part("ab", 'SELECT "group" AS grp, value FROM ab_long')
part("ab_rows", "SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY value) AS row_no, count(*) OVER (PARTITION BY grp) AS size FROM ab")


@query("read_ab", "SELECT grp AS \"group\", value, count(*) AS n FROM ab GROUP BY 1, 2")
def read_ab(spark, d):
    noisy = shop.ab_long(spark, d).withColumn("group", F.concat(F.lit(" "), F.initcap("group")))
    return abtest.read_ab(noisy).groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))


@query("group_effect", """SELECT round(c, 9) AS control_mean, round(t, 9) AS treatment_mean, round(t - c, 9) AS absolute_diff, round((t - c) / c, 9) AS relative_lift
  FROM (SELECT avg(value) FILTER (grp = 'control') AS c, avg(value) FILTER (grp = 'treatment') AS t FROM ab)""")
def group_effect(spark, d):
    return abtest.group_effect(shop.ab_long(spark, d))


part("boot_draws", f"""SELECT replicate, grp, {sql_draw("'42'", 'grp', 'replicate', 'draw_no')} % size + 1 AS row_no
  FROM (SELECT *, unnest(range(size)) AS draw_no FROM (SELECT DISTINCT grp, size FROM ab_rows) CROSS JOIN range({REPLICATES}) r(replicate))""")
part("boot_diffs", "SELECT replicate, avg(value) FILTER (grp = 'treatment') - avg(value) FILTER (grp = 'control') AS diff FROM boot_draws JOIN ab_rows USING (grp, row_no) GROUP BY 1")


@query("bootstrap_ci", f"""SELECT 0.95::DOUBLE AS confidence_level, round(list_sort(list(diff))[6], 9) AS lower, round(list_sort(list(diff))[{int((1 - 0.05 / 2) * REPLICATES)}], 9) AS upper FROM boot_diffs""")
def bootstrap_ci(spark, d):
    return abtest.bootstrap_ci(shop.ab_long(spark, d), 0.95, REPLICATES, SEED, method="rows")


# Drawn counts against the closed forms of the mean and the variance of a resampled or shuffled difference.
MOMENT_REPLICATES = 2000
part("ab_moments", """SELECT avg(value) FILTER (grp = 'treatment') - avg(value) FILTER (grp = 'control') AS diff,
  var_pop(value) FILTER (grp = 'treatment') / count(*) FILTER (grp = 'treatment') + var_pop(value) FILTER (grp = 'control') / count(*) FILTER (grp = 'control') AS boot_var,
  var_samp(value) * (1 / count(*) FILTER (grp = 'treatment') + 1 / count(*) FILTER (grp = 'control')) AS perm_var FROM ab""")


def _moments(ab, diffs, closed):
    """Closed mean and standard deviation, and whether those of the replicates are near: four standard errors, 15 %."""
    seen = diffs.agg(F.avg("diff").alias("mean"), F.stddev("diff").alias("sd"), F.count(F.lit(1)).alias("replicates"))
    both = ab.agg(*closed).withColumn("one", F.lit(1)).join(seen.withColumn("one", F.lit(1)), "one")
    return both.select(
        "replicates", "closed_mean", "closed_sd",
        (F.abs(F.col("mean") - F.col("closed_mean")) <= 4 * F.col("closed_sd") / F.sqrt("replicates")).alias("mean_is_near"),
        (F.abs(F.col("sd") / F.col("closed_sd") - 1) <= 0.15).alias("sd_is_near"),
    )


def _in(group, what):
    return what(F.when(F.col("group") == group, F.col("value")))


@query("bootstrap_counts_moments", f"SELECT {MOMENT_REPLICATES} AS replicates, round(diff, 9) AS closed_mean, round(sqrt(boot_var), 9) AS closed_sd, true AS mean_is_near, true AS sd_is_near FROM ab_moments")
def bootstrap_counts_moments(spark, d):
    ab = staged(shop.ab_long(spark, d), "ab")
    spread = sum(_in(g, F.var_pop) / _in(g, F.count) for g in abtest.GROUPS)
    mean = _in("treatment", F.avg) - _in("control", F.avg)
    return _moments(ab, abtest.bootstrap_diffs(ab, MOMENT_REPLICATES, SEED), [mean.alias("closed_mean"), F.sqrt(spread).alias("closed_sd")])


@query("permutation_counts_moments", f"SELECT {MOMENT_REPLICATES} AS replicates, 0.0::DOUBLE AS closed_mean, round(sqrt(perm_var), 9) AS closed_sd, true AS mean_is_near, true AS sd_is_near FROM ab_moments")
def permutation_counts_moments(spark, d):
    ab = staged(shop.ab_long(spark, d), "ab")
    spread = F.var_samp("value") * sum(1 / _in(g, F.count) for g in abtest.GROUPS)
    return _moments(ab, abtest.permutation_diffs(ab, MOMENT_REPLICATES, SEED), [F.lit(0.0).alias("closed_mean"), F.sqrt(spread).alias("closed_sd")])


part("perm_rows", "SELECT value, row_number() OVER (ORDER BY grp, value) AS row_no FROM ab")
part("perm_places", f"""SELECT replicate, value, row_number() OVER (PARTITION BY replicate ORDER BY {sql_draw("'42'", 'replicate', 'row_no')}, row_no) <= (SELECT count(*) FROM ab WHERE grp = 'control') AS in_control
  FROM perm_rows CROSS JOIN range({REPLICATES}) r(replicate)""")


@query("permutation_p", f"""SELECT round((count(*) FILTER (abs(diff) >= abs((SELECT avg(value) FILTER (grp = 'treatment') - avg(value) FILTER (grp = 'control') FROM ab)) - 1e-12) + 1) / ({REPLICATES} + 1), 9) AS p_value
  FROM (SELECT replicate, avg(value) FILTER (NOT in_control) - avg(value) FILTER (in_control) AS diff FROM perm_places GROUP BY 1)""")
def permutation_p(spark, d):
    return abtest.permutation_p(shop.ab_long(spark, d), REPLICATES, SEED, method="rows")


@query("compare_group_means", f"""SELECT round(c, 9) AS control_mean, round(t, 9) AS treatment_mean, round(t - c, 9) AS absolute_diff, round((t - c) / c, 9) AS relative_lift,
  (SELECT round((count(*) FILTER (abs(diff) >= abs(t - c) - 1e-12) + 1) / ({REPLICATES} + 1), 9)
   FROM (SELECT replicate, avg(value) FILTER (NOT in_control) - avg(value) FILTER (in_control) AS diff FROM perm_places GROUP BY 1)) AS p_value,
  0.95::DOUBLE AS confidence_level, (SELECT round(list_sort(list(diff))[6], 9) FROM boot_diffs) AS lower,
  (SELECT round(list_sort(list(diff))[{int((1 - 0.05 / 2) * REPLICATES)}], 9) FROM boot_diffs) AS upper
  FROM (SELECT avg(value) FILTER (grp = 'control') AS c, avg(value) FILTER (grp = 'treatment') AS t FROM ab)""")
def compare_group_means(spark, d):
    return abtest.compare_group_means(shop.ab_long(spark, d), 0.95, REPLICATES, REPLICATES, SEED, method="rows")


@query("compare_group_means_by_counts", """SELECT round(c, 9) AS control_mean, round(t, 9) AS treatment_mean, true AS inside, true AS probable
  FROM (SELECT avg(value) FILTER (grp = 'control') AS c, avg(value) FILTER (grp = 'treatment') AS t FROM ab)""")
def compare_group_means_by_counts(spark, d):
    """Drawn counts: the observed difference lies inside its own interval, and the p-value is a share."""
    row = abtest.compare_group_means(shop.ab_long(spark, d), 0.95, 200, 200, SEED)
    return row.select(
        "control_mean", "treatment_mean", F.col("absolute_diff").between(F.col("lower"), F.col("upper")).alias("inside"),
        ((F.col("p_value") > 0) & (F.col("p_value") <= 1)).alias("probable"),
    )


# --- streams -------------------------------------------------------------------------
def write_lines(rows, path):
    """Events as JSON lines, as a gateway would leave them."""
    stamped = rows.withColumn("arrival", F.date_format("arrival", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    stamped.select(F.to_json(F.struct(*stamped.columns)).alias("value")).write.mode("append").text(path)


def event_lines(spark, d):
    events = shop.interaction_events(spark, d)
    path = stage_path(events, "event_lines")
    write_lines(events, path)
    return path


def weekly_lines(spark, d):
    """The same, a file folder per calendar week, written in the order of the weeks."""
    events = staged(shop.interaction_events(spark, d).withColumn("week", F.to_date(F.date_trunc("week", "arrival"))), "weekly_events")
    path = stage_path(events, "weekly_lines")
    for row in events.select("week").distinct().orderBy("week").toLocalIterator():
        write_lines(events.where(F.col("week") == row["week"]).drop("week"), f"{path}/week={row['week']}")
        yield f"{path}/week={row['week']}"


def _run_folder(spark, name):
    return f"{shared_folder(spark)}/retailspark/{name}-{uuid.uuid4().hex}"


@query("read_events_stream", """SELECT user_id, item_id, event_type, category, event_id FROM interaction_events WHERE item_id IS NOT NULL""")
def read_events_stream(spark, d):
    folder = _run_folder(spark, "events")
    session_state.run_to_table(session_state.read_events(spark, event_lines(spark, d)), folder, f"{folder}-progress", "append")
    return spark.read.parquet(f"{folder}/batch=*").select("user_id", "item_id", "event_type", "category", "event_id")


# Lines that a gateway must refuse: each kind of event is damaged in its own way.
_BROKEN = "category < 'M'"


def damaged_lines(spark, d):
    events = shop.interaction_events(spark, d)
    text = F.date_format("arrival", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    broken = F.col("category") < "M"
    kind = F.when(broken, F.col("event_type")).otherwise("")
    named = {
        "item_id": F.col("item_id"), "event_type": F.when(kind != "signup", F.col("event_type")), "category": F.col("category"),
        "arrival": F.when(kind == "view", "soon").otherwise(text), "event_id": F.col("event_id"),
    }
    rest = [c.alias(n) for n, c in named.items()]
    line = F.when(kind == "purchase", F.to_json(F.struct(F.col("user_id").cast("long").alias("user_id"), *rest))).otherwise(
        F.to_json(F.struct("user_id", *rest))
    )
    path = stage_path(events, "damaged_lines")
    events.select(F.when(kind == "error", F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    return path


@query("event_routing", f"""SELECT coalesce(reason, 'event') AS outcome, count(*) AS n FROM (SELECT CASE WHEN {_BROKEN} AND event_type = 'error' THEN 'not json'
  WHEN {_BROKEN} AND event_type = 'purchase' THEN 'user_id is not text' WHEN item_id IS NULL THEN 'missing item_id'
  WHEN {_BROKEN} AND event_type = 'signup' THEN 'missing event_type' WHEN {_BROKEN} AND event_type = 'view' THEN 'arrival is no time' END AS reason
  FROM interaction_events) GROUP BY 1""")
def event_routing(spark, d):
    folder = _run_folder(spark, "routing")
    session_state.run_event_routing(session_state.read_lines(spark, damaged_lines(spark, d)), folder, f"{folder}-progress")
    good = session_state.routed(spark, folder, "events").select(F.lit("event").alias("outcome"))
    bad = session_state.routed(spark, folder, "rejected").select(F.col("reason").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# The stream sees the weeks one after the other; lists and counts end seven days of event time after their last event.
@query("session_state_stream", "SELECT * FROM session_rows")
def session_state_stream(spark, d):
    folder = _run_folder(spark, "state")
    for week in weekly_lines(spark, d):
        stream = session_state.session_state(session_state.read_events(spark, week.rsplit("/", 1)[0] + "/week=*"))
        session_state.run_to_table(stream, folder, f"{folder}-progress")
    return session_state.latest_state(spark, folder).select("user_id", "recent_clicks", interest_text(), "click_count")


# Few events are enough for a signal here, so that many checks fire.
@query("retrain_watch_stream", """SELECT 'ranker' AS model, row_number() OVER (ORDER BY week)::BIGINT AS signal, n AS new_events, sum(n) OVER (ORDER BY week)::BIGINT AS event_count,
  concat('v', row_number() OVER (ORDER BY week)) AS old_version, concat('v', row_number() OVER (ORDER BY week) + 1) AS new_version
  FROM (SELECT date_trunc('week', arrival) AS week, count(*) AS n FROM interaction_events GROUP BY 1)""")
def retrain_watch_stream(spark, d):
    folder = _run_folder(spark, "retrain")
    for week in weekly_lines(spark, d):
        watch = monitor.retrain_watch(session_state.read_events(spark, week.rsplit("/", 1)[0] + "/week=*"), 1)
        session_state.run_to_table(watch, folder, f"{folder}-progress")
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return rows.select(
        "model", F.substring("old_version", 2, 10).cast("long").alias("signal"), "new_events", "event_count", "old_version", "new_version"
    )
