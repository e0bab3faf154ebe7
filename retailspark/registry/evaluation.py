"""Queries over session state, candidates and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailspark.functions import clean as c
from retailspark.functions import metrics as list_metrics
from retailspark.operators import candidates as cand
from retailspark.operators import evaluation, features, joins, metrics, sampling, windows
from retailspark.plans.skew import lookup_join
from retailspark.plans.staging import staged
from retailspark.registry.core import part, query, shared
from retailspark.registry.features import catalog, history, known
from retailspark.registry.sampling import SEED, train
from retailspark.registry.tables import articles, customers
from retailspark.sources import reports, shop
from retailspark.streaming import monitor, session_state

POOL = 100
LIMIT = 400
K = 50

# --- session state -------------------------------------------------------------------
def _run_sql(name: str, condition: str) -> None:
    part(f"{name}_events", f"SELECT * FROM interaction_events WHERE {condition}")
    part(f"{name}_runs", f"""SELECT *, max(run) OVER (PARTITION BY user_id) AS last_run, max(arrival) OVER (PARTITION BY user_id) AS last_write
      FROM (SELECT *, sum(CASE WHEN arrival - previous >= INTERVAL 7 DAY THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, lag(arrival) OVER (PARTITION BY user_id ORDER BY arrival, event_id) AS previous FROM {name}_events))""")
    part(f"{name}_live", f"""SELECT * FROM {name}_runs WHERE run = last_run
      AND (SELECT max(arrival) FROM interaction_events) - last_write < INTERVAL 7 DAY""")


_run_sql("click", "event_type IN ('click', 'purchase')")
_run_sql("named", "category <> ''")
part("click_places", """SELECT user_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival DESC, event_id DESC) AS place
  FROM click_live) WHERE place <= 20""")
part("interest_rows", "SELECT user_id, category, count(*) AS n FROM named_live GROUP BY 1, 2")
part("session_rows", """SELECT u.user_id, coalesce(c.recent_clicks, '') AS recent_clicks, coalesce(i.interest, '') AS session_interest, coalesce(n.click_count, 0) AS click_count
  FROM (SELECT DISTINCT user_id FROM interaction_events) u
  LEFT JOIN (SELECT user_id, string_agg(item_id, ',' ORDER BY place) AS recent_clicks FROM click_places GROUP BY 1) c USING (user_id)
  LEFT JOIN (SELECT user_id, string_agg(concat(category, '=', n), ',' ORDER BY category) AS interest FROM interest_rows GROUP BY 1) i USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS click_count FROM click_events GROUP BY 1) n USING (user_id)""")


def interest_text(name="session_interest"):
    entries = F.array_sort(F.map_entries(name))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias("session_interest")


def state(spark, d):
    return session_state.session_state_batch(shop.interaction_events(spark, d))


@query("session_state_batch", "SELECT * FROM session_rows")
def session_state_batch(spark, d):
    return state(spark, d).select("user_id", "recent_clicks", interest_text(), "click_count")


@query("user_features_view", """SELECT c.customer_id AS user_id, array_to_string(string_split(coalesce(s.recent_clicks, ''), ',')[1:10], ',') AS recent_clicks,
  coalesce(s.session_interest, '') AS session_interest, coalesce(s.click_count, 0) AS click_count FROM customers c LEFT JOIN session_rows s ON s.user_id = c.customer_id""")
def user_features_view(spark, d):
    users = customers(spark, d).select(F.col("customer_id").alias("user_id"))
    return session_state.user_features_view(users, state(spark, d)).select(
        "user_id", "recent_clicks", interest_text(), "click_count"
    )


@query("event_counter", "SELECT count(*) AS event_count FROM interaction_events")
def event_counter(spark, d):
    return monitor.event_counter(shop.interaction_events(spark, d))


part("daily", "SELECT CAST(CAST(arrival AS DATE) AS STRING) AS check_at, count(*) AS events, row_number() OVER (ORDER BY CAST(arrival AS DATE)) AS i FROM interaction_events GROUP BY CAST(arrival AS DATE)")
part("checks_made", """SELECT i, check_at, events AS total, CASE WHEN events >= 1000 THEN events ELSE 0 END AS mark, CASE WHEN events >= 1000 THEN 2 ELSE 1 END AS version,
  events >= 1000 AS fires, events AS new_events FROM daily WHERE i = 1
  UNION ALL SELECT d.i, d.check_at, p.total + d.events, CASE WHEN p.total + d.events - p.mark >= 1000 THEN p.total + d.events ELSE p.mark END,
  CASE WHEN p.total + d.events - p.mark >= 1000 THEN p.version + 1 ELSE p.version END, p.total + d.events - p.mark >= 1000, p.total + d.events - p.mark
  FROM checks_made p JOIN daily d ON d.i = p.i + 1""")


@query("retrain_trigger_batch", """SELECT check_at, new_events, total AS event_count, concat('v', version - 1) AS old_version, concat('v', version) AS new_version
  FROM checks_made WHERE fires""")
def retrain_trigger_batch(spark, d):
    daily = shop.interaction_events(spark, d).groupBy(F.to_date("arrival").cast("string").alias("check_at")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return monitor.retrain_trigger(daily, 1000)


# --- candidates ----------------------------------------------------------------------
part("clicks", "SELECT DISTINCT user_id AS customer_id, item_id AS article_id FROM click_places")
part("signals", " UNION ".join(f"SELECT customer_id, '{k}' AS kind, {k} AS value FROM clicks JOIN catalog USING (article_id)" for k in cand.CLICK_WEIGHTS))
part("ranked_values", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {k} AS value, article_id, row_number() OVER (PARTITION BY {k} ORDER BY popularity DESC, article_id) AS position FROM catalog"
    for k in cand.CLICK_WEIGHTS))
part("click_points", "SELECT customer_id, kind, value, (CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in cand.CLICK_WEIGHTS.items()) + " END)::DOUBLE AS points, 1 AS recent, 0 AS session FROM signals")
part("interest_points", " UNION ALL ".join(f"SELECT user_id AS customer_id, '{k}' AS kind, category AS value, (n * {f})::DOUBLE AS points, 0 AS recent, 1 AS session FROM interest_rows"
                                           for k, f in cand.INTEREST_WEIGHTS.items()))


def _scores_sql(points: str) -> str:
    return (f"SELECT customer_id, article_id, CAST(sum(points) AS DOUBLE) AS signal_score, max(recent) = 1 AS matches_recent_click_signal, "
            f"max(session) = 1 AS matches_session_interest FROM {points} JOIN ranked_values USING (kind, value) WHERE position <= {LIMIT} GROUP BY 1, 2")


def build_sessions(spark, d):
    return state(spark, d).select(
        F.col("user_id").alias("customer_id"), "recent_clicks", F.col("session_interest").cast("map<string,double>").alias("session_interest")
    )


def sessions(spark, d):
    return shared("sessions", spark, d, build_sessions)


@query("recent_signals", "SELECT * FROM signals")
def recent_signals(spark, d):
    return cand.recent_signals(sessions(spark, d), catalog(spark, d))


@query("signal_scores", _scores_sql("click_points"))
def signal_scores(spark, d):
    items = staged(catalog(spark, d), "catalog")
    points = cand.click_points(cand.recent_signals(sessions(spark, d), items))
    lists = staged(cand.item_lists(items, LIMIT), "item_lists")
    return cand.signal_scores(points, lists).drop("popularity", "base")


@query("interest_scores", _scores_sql("interest_points"))
def interest_scores(spark, d):
    lists = staged(cand.item_lists(catalog(spark, d), LIMIT), "item_lists")
    return cand.signal_scores(cand.interest_points(sessions(spark, d)), lists).drop("popularity", "base")


def _candidates_sql(prefix: str, users: str, pool: int) -> None:
    """Check SQL of the candidate lists; users without session rows are cold."""
    p = prefix
    part(f"{p}_points", f"SELECT * FROM click_points SEMI JOIN {users} USING (customer_id) UNION ALL SELECT * FROM interest_points SEMI JOIN {users} USING (customer_id)")
    part(f"{p}_scored", f"""SELECT s.customer_id, s.article_id, k.popularity, s.signal_score + k.normalized_popularity + k.fresh_boost AS candidate_score,
      matches_recent_click_signal, matches_session_interest FROM (SELECT customer_id, article_id, sum(points) AS signal_score,
      max(recent) = 1 AS matches_recent_click_signal, max(session) = 1 AS matches_session_interest
      FROM {p}_points JOIN ranked_values USING (kind, value) WHERE position <= {4 * pool} GROUP BY 1, 2) s
      JOIN catalog k USING (article_id) ANTI JOIN clicks USING (customer_id, article_id)""")
    part("popular_list", "SELECT *, row_number() OVER (ORDER BY popularity DESC, article_id) AS position FROM catalog")
    part(f"{p}_warm", f"SELECT customer_id FROM {users} SEMI JOIN (SELECT customer_id FROM clicks UNION SELECT customer_id FROM interest_points) USING (customer_id)")
    part(f"{p}_filled", f"""SELECT f.* EXCLUDE (place) FROM (SELECT w.customer_id, l.article_id, l.popularity, l.normalized_popularity + l.fresh_boost AS candidate_score,
      row_number() OVER (PARTITION BY w.customer_id ORDER BY l.position) AS place FROM {p}_warm w CROSS JOIN popular_list l
      ANTI JOIN clicks k ON k.customer_id = w.customer_id AND k.article_id = l.article_id
      ANTI JOIN {p}_scored s ON s.customer_id = w.customer_id AND s.article_id = l.article_id) f
      LEFT JOIN (SELECT customer_id, count(*) AS n FROM {p}_scored GROUP BY 1) c USING (customer_id) WHERE place <= {pool} - coalesce(n, 0)""")
    part(f"{p}_candidates", f"""SELECT customer_id, article_id, candidate_score, candidate_rank, 'candidate_retrieval' AS candidate_reason,
      matches_recent_click_signal, matches_session_interest FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY candidate_score DESC, popularity DESC, article_id) AS candidate_rank
      FROM (SELECT * FROM {p}_scored UNION ALL BY NAME SELECT *, false AS matches_recent_click_signal, false AS matches_session_interest FROM {p}_filled)) WHERE candidate_rank <= {pool}
      UNION ALL SELECT u.customer_id, l.article_id, l.normalized_popularity + l.cold_start_bonus + l.fresh_boost, l.position, 'cold_start_popularity', false, false
      FROM {users} u ANTI JOIN {p}_warm USING (customer_id) CROSS JOIN popular_list l WHERE l.position <= {pool}""")


part("session_users", "SELECT DISTINCT user_id AS customer_id FROM interaction_events")
_candidates_sql("session", "session_users", POOL)


@query("generate_candidates", "SELECT * REPLACE (round(candidate_score, 9) AS candidate_score) FROM session_candidates")
def generate_candidates(spark, d):
    return cand.generate_candidates(sessions(spark, d), catalog(spark, d), pool=POOL, max_clicks=session_state.RECENT_CLICKS)


@query("cold_start_candidates", f"""SELECT c.customer_id, l.article_id, round(l.normalized_popularity + l.cold_start_bonus + l.fresh_boost, 9) AS candidate_score, l.position AS candidate_rank
  FROM customers c ANTI JOIN session_users USING (customer_id) CROSS JOIN (SELECT *, row_number() OVER (ORDER BY popularity DESC, article_id) AS position FROM catalog) l WHERE position <= {POOL}""")
def cold_start_candidates(spark, d):
    known = shop.interaction_events(spark, d).select(F.col("user_id").alias("customer_id"))
    users = customers(spark, d).join(known, "customer_id", "left_anti")
    popular = windows.popular_items(catalog(spark, d), POOL)
    return cand.cold_start_candidates(users, popular, POOL).select("customer_id", "article_id", "candidate_score", "candidate_rank")


part("history_counts", "SELECT article_id, category, main_category, color, '*' AS everything, coalesce(n, 0) AS popularity FROM articles LEFT JOIN (SELECT article_id, count(*) AS n FROM history_rows GROUP BY 1) USING (article_id)")
part("wishes", " UNION ALL ".join(
    f"SELECT customer_id, {n} AS tier, {k} AS value, max(row(t_dat, row_no, article_id)) AS latest FROM history_rows JOIN history_counts USING (article_id) GROUP BY 1, 2, 3"
    for n, k in enumerate(cand.PREFERENCE_TIERS)) + " UNION ALL SELECT DISTINCT customer_id, 3, '*', NULL FROM history_rows")
part("wish_order", "SELECT customer_id, tier, value, row_number() OVER (PARTITION BY customer_id, tier ORDER BY latest DESC) AS preference FROM wishes")
part("wish_lists", " UNION ALL ".join(
    f"SELECT {n} AS tier, {k} AS value, article_id, row_number() OVER (PARTITION BY {k} ORDER BY popularity DESC, article_id) AS position FROM history_counts"
    for n, k in enumerate((*cand.PREFERENCE_TIERS, "everything"))))
part("wish_recs", """SELECT customer_id, article_id, position FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY min(row(tier, preference, l.position))) AS position
  FROM wish_order JOIN wish_lists l USING (tier, value) ANTI JOIN history_rows USING (customer_id, article_id) GROUP BY 1, 2) WHERE position <= 10""")
part("targets", "SELECT DISTINCT customer_id, target_article_id FROM history_rows")


def _history_recs(spark, d):
    rows = staged(history(spark, d), "history")
    items = articles(spark, d)
    return rows, cand.metadata_popularity_recs(rows, items, features.popularity_counts(rows, items.select("article_id")), 10)


@query("metadata_popularity_recs", "SELECT * FROM wish_recs")
def metadata_popularity_recs(spark, d):
    return _history_recs(spark, d)[1]


@query("prediction_rows", """SELECT customer_id, predictions, target_article_id AS target FROM targets
  JOIN (SELECT customer_id, string_agg(article_id, '|' ORDER BY position) AS predictions FROM wish_recs GROUP BY 1) USING (customer_id)""")
def prediction_rows(spark, d):
    rows, recs = _history_recs(spark, d)
    return reports.prediction_rows(recs, rows.select("customer_id", "target_article_id").distinct())


def scores_part(name: str, ranked: str, truth: str, users: str, k: int) -> None:
    part(name, f"""SELECT u.customer_id, coalesce(h.hits / r.relevant, 0) AS recall, CASE WHEN h.hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate,
      coalesce(1.0 / h.first_hit, 0) AS reciprocal_rank, coalesce(h.dcg, 0) AS dcg,
      coalesce(h.dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k} + 1) t(i) WHERE i <= r.relevant), 0) AS ndcg
      FROM {users} u LEFT JOIN (SELECT customer_id, count(DISTINCT article_id) AS relevant FROM {truth} GROUP BY 1) r USING (customer_id)
      LEFT JOIN (SELECT customer_id, count(*) AS hits, min(position) AS first_hit, sum(1 / log2(position + 1)) AS dcg
        FROM {ranked} SEMI JOIN {truth} USING (customer_id, article_id) WHERE position <= {k} GROUP BY 1) h USING (customer_id)""")


def _means(names=("recall", "hit_rate", "reciprocal_rank", "dcg", "ndcg")) -> str:
    return "count(*) AS users_evaluated, " + ", ".join(f"round(coalesce(avg({n}), 0), 9)::DOUBLE AS {n}" for n in names)


part("known_targets", "SELECT customer_id, target_article_id AS article_id FROM targets SEMI JOIN articles a ON a.article_id = target_article_id")
scores_part("wish_scores", "wish_recs", "known_targets", "known_targets", 10)


@query("evaluate_metadata_baseline", f"SELECT {_means(('hit_rate', 'reciprocal_rank', 'ndcg'))} FROM wish_scores")
def evaluate_metadata_baseline(spark, d):
    return evaluation.evaluate_metadata_baseline(shop.transactions_raw(spark, d), articles(spark, d), 10)


# --- evaluation ----------------------------------------------------------------------
part("eval_users", "SELECT DISTINCT customer_id FROM truth")
_candidates_sql("eval", "eval_users", 500)
part("eval_ranked", "SELECT customer_id, article_id, candidate_rank AS position FROM eval_candidates")
scores_part("eval_scores", "eval_ranked", "truth", "eval_users", K)


def rows_with_truth(spark, d):
    # The training rows are staged already; the flag is worked out where they are read.
    rows = evaluation.positive_flag(train(spark, d))
    truth = features.ground_truth(rows)
    return rows, truth, truth.select("customer_id").distinct()


@query("evaluate_candidates", f"SELECT {_means(('recall',))} FROM eval_scores")
def evaluate_candidates(spark, d):
    _, truth, users = rows_with_truth(spark, d)
    return evaluation.evaluate_candidates(sessions(spark, d), catalog(spark, d), truth, users, K, pool=500)


part("eval_rows", """SELECT t.* REPLACE (coalesce(t.category, k.category) AS category), label = 1 AS is_positive, coalesce(k.popularity, 0) AS popularity,
  k.item_age_days, coalesce(k.is_new_item, false) AS is_new_item FROM train_rows t LEFT JOIN (SELECT article_id, category, popularity, item_age_days, is_new_item FROM catalog) k USING (article_id)""")
part("popular_recs", f"SELECT customer_id, article_id, position FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY popularity DESC, article_id) AS position FROM eval_rows) WHERE position <= {K}")
scores_part("popular_scores", "popular_recs", "truth", "eval_users", K)


def enriched_rows(spark, d):
    rows, truth, users = rows_with_truth(spark, d)
    return joins.enrich_candidates(rows, catalog(spark, d)), truth, users


@query("enrich_candidates", "SELECT customer_id, article_id, label, popularity::DOUBLE AS popularity, item_age_days, is_new_item, category, main_category, color FROM eval_rows")
def enrich_candidates(spark, d):
    return enriched_rows(spark, d)[0].select(
        "customer_id", "article_id", "label", "popularity", "item_age_days", "is_new_item", "category", "main_category", "color"
    )


@query("popularity_top_k", "SELECT * FROM popular_recs")
def popularity_top_k(spark, d):
    return windows.popularity_top_k(enriched_rows(spark, d)[0], K).select("customer_id", "article_id", "position")


@query("user_scores", "SELECT customer_id, " + ", ".join(f"round({n}, 9)::DOUBLE AS {n}" for n in ("recall", "hit_rate", "reciprocal_rank", "dcg", "ndcg")) + " FROM popular_scores")
def user_scores(spark, d):
    rows, truth, users = enriched_rows(spark, d)
    return metrics.user_scores(windows.popularity_top_k(rows, K), truth, users, K)


_COVERAGE = f"round((SELECT count(DISTINCT article_id) FROM popular_recs WHERE position <= {K}) / (SELECT count(DISTINCT article_id) FROM train_rows), 9) AS coverage"


@query("coverage_at_k", f"SELECT {_COVERAGE}")
def coverage_at_k(spark, d):
    rows, _, _ = enriched_rows(spark, d)
    total = rows.agg(F.count_distinct("article_id").alias("n")).scalar()
    return metrics.coverage_at_k(windows.popularity_top_k(rows, K), total, K)


part("cold_users", "SELECT customer_id FROM eval_users ANTI JOIN customers USING (customer_id)")
_POPULARITY = f"""SELECT 'all' AS subset, {_means(('hit_rate', 'ndcg'))}, {_COVERAGE} FROM popular_scores
  UNION ALL SELECT 'cold_start', {_means(('hit_rate', 'ndcg'))}, 0.0 FROM popular_scores SEMI JOIN cold_users USING (customer_id)"""


def popularity_result(spark, d):
    """Only pairs, labels and popularity: none of the training columns are needed to rank by popularity."""
    pairs = sampling.distinct_pairs(known(spark, d)).select("customer_id", "article_id")
    pairs = staged(pairs, "pairs")
    own = sampling.labelled_pairs(pairs, articles(spark, d), 1, SEED)
    counts = features.item_features(shop.transactions_text(spark, d)).select("article_id", "popularity")
    rows = staged(
        lookup_join(own, counts, "article_id", "left", hot_source=pairs).withColumn(
            "popularity", F.coalesce(F.col("popularity").cast("double"), F.lit(0.0))
        ),
        "popularity_rows",
    )
    truth = pairs
    total = rows.agg(F.count_distinct("article_id").alias("n")).scalar()
    return evaluation.evaluate_popularity(rows, truth, truth.select("customer_id").distinct(), customers(spark, d), total, K)


@query("evaluate_popularity", _POPULARITY)
def evaluate_popularity(spark, d):
    return popularity_result(spark, d)


part("popularity_summary", _POPULARITY)


@query("comparison", """SELECT 'all' AS subset, round(0.5 - hit_rate, 9)::DOUBLE AS hit_rate_change, round(0.25 - ndcg, 9)::DOUBLE AS ndcg_change,
  round(-coverage, 9)::DOUBLE AS coverage_change FROM popularity_summary WHERE subset = 'all'""")
def comparison(spark, d):
    baseline = staged(popularity_result(spark, d), "popularity").where("subset = 'all'")
    current = baseline.select("subset", F.lit(0.5).alias("hit_rate"), F.lit(0.25).alias("ndcg"), F.lit(0.0).alias("coverage"))
    return evaluation.comparison(current, baseline)


@query("cold_start_users", "SELECT DISTINCT customer_id FROM transactions_raw ANTI JOIN customers USING (customer_id)")
def cold_start_users(spark, d):
    return joins.cold_start_users(shop.transactions_raw(spark, d), customers(spark, d))


@query("exclude_seen", "SELECT customer_id, article_id FROM train_rows ANTI JOIN history_rows USING (customer_id, article_id)")
def exclude_seen(spark, d):
    return joins.exclude_seen(train(spark, d).select("customer_id", "article_id"), history(spark, d))


@query("roc_auc", """SELECT round(sum(p * (below + n / 2)) / sum(p) / sum(n), 9)::DOUBLE AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY popularity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT popularity, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM eval_rows GROUP BY 1))""")
def roc_auc(spark, d):
    return metrics.roc_auc(enriched_rows(spark, d)[0], "label", "popularity")


@query("positive_flag", "SELECT customer_id, article_id, row_no, sales_channel_id <> 1 AS is_positive FROM transactions_raw")
def positive_flag(spark, d):
    rows = shop.transactions_raw(spark, d).withColumn("clicked", F.when(F.col("sales_channel_id") == 2, "Yes").otherwise("no"))
    return evaluation.positive_flag(rows).select("customer_id", "article_id", "row_no", "is_positive")


@query("session_context", """SELECT user_id AS customer_id, concat(lpad(arg_min(props->>'k', event_id) FILTER (event_type <> 'error'), 10, '0'), ',', '0000000007') AS recent_clicks,
  CAST(arg_min(props->>'k', event_id) FILTER (event_type = 'view') AS DOUBLE) AS k_interest FROM (SELECT CAST(user_id AS STRING) AS user_id, event_id, event_type, props FROM events) GROUP BY 1""")
def session_context(spark, d):
    rows = shop.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("customer_id"), "event_id",
        F.when(F.col("event_type") != "error", F.concat(F.get_json_object("props", "$.k"), F.lit(", ,7"))).alias("recent_clicks"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("session_interest"),
    )
    return evaluation.session_context(rows, ["event_id"]).select(
        "customer_id", "recent_clicks", F.col("session_interest")["k"].alias("k_interest")
    )


# The user limit is the operator: a fixed-size user sample.
@query("evaluation_context", f"""SELECT count(*) AS rows, count(DISTINCT customer_id) AS users, count(*) FILTER (label = 1) AS positives,
  (SELECT count(DISTINCT article_id) FROM train_rows) AS item_count FROM train_rows SEMI JOIN
  (SELECT customer_id FROM (SELECT DISTINCT customer_id FROM truth) ORDER BY md5(concat('{SEED}:', customer_id)), customer_id LIMIT 300) USING (customer_id)""")
def evaluation_context(spark, d):
    context = evaluation.evaluation_context(train(spark, d), 300, SEED)
    return context["rows"].agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("users"), F.count_if("is_positive").alias("positives"),
    ).select("*", context["item_count"].alias("item_count"))


LISTS = ("SELECT o_orderkey AS query_id, list(article_id ORDER BY l_extendedprice DESC, l_linenumber, article_id) AS ranked, "
         "list(DISTINCT article_id) FILTER (l_returnflag = 'R') AS relevant FROM (SELECT l.*, l_orderkey AS o_orderkey, lpad(CAST(l_partkey AS STRING), 10, '0') AS article_id FROM lineitem l) GROUP BY 1")
part("order_lists", LISTS)


def order_lists(spark, d):
    """One ranked list per order: its lines by price; returned articles are the relevant ones."""
    lines = shop.table(spark, d, "lineitem").withColumn("article_id", F.lpad(F.col("l_partkey").cast("string"), 10, "0"))
    place = F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber", "article_id")
    text = lines.groupBy(F.col("l_orderkey").cast("string").alias("query_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: s.article_id), "|").alias("ranked_items"),
        F.array_join(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("article_id"))), ",").alias("relevant_items"),
    )
    return evaluation.read_ranking_lists(text)


@query("read_ranking_lists", "SELECT CAST(query_id AS STRING) AS query_id, array_to_string(ranked, ',') AS ranked_items, coalesce(len(relevant), 0) AS n_relevant FROM order_lists")
def read_ranking_lists(spark, d):
    return order_lists(spark, d).select("query_id", "ranked_items", F.size("relevant_items").alias("n_relevant"))


part("list_rows", "SELECT query_id, unnest(ranked) AS item, generate_subscripts(ranked, 1) AS position, coalesce(relevant, []) AS relevant FROM order_lists")
part("list_scores", """SELECT query_id, count(*) FILTER (hit AND position <= 3) AS hits, max(len(relevant)) AS relevant_n, min(position) FILTER (hit) AS first_hit,
  coalesce(sum(1 / log2(position + 1)) FILTER (hit AND position <= 3), 0) AS dcg FROM (SELECT *, list_contains(relevant, item) AS hit FROM list_rows) GROUP BY 1""")
_IDEAL = "(SELECT sum(1 / log2(i + 1)) FROM range(1, 4) t(i) WHERE i <= relevant_n)"


@query("list_metrics", f"""SELECT CAST(query_id AS STRING) AS query_id, CASE WHEN relevant_n > 0 THEN round(hits / relevant_n, 9) ELSE 0 END AS recall,
  CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round(coalesce(1 / first_hit, 0), 9) AS reciprocal_rank, round(dcg, 9) AS dcg,
  round(coalesce({_IDEAL}, 0), 9) AS idcg, round(coalesce(dcg / {_IDEAL}, 0), 9) AS ndcg FROM list_scores""")
def list_metrics_query(spark, d):
    lists = order_lists(spark, d)
    return lists.select(
        "query_id",
        *[fn("ranked_items", "relevant_items", 3).alias(n) for n, fn in list_metrics.METRICS.items()],
        list_metrics.idcg_at_k("relevant_items", 3).alias("idcg"),
    )


@query("mean_metric", f"SELECT count(*) AS lists, round(avg(coalesce(dcg / {_IDEAL}, 0)), 9) AS mean_score FROM list_scores")
def mean_metric(spark, d):
    return list_metrics.mean_metric(order_lists(spark, d), "ndcg", 3)


@query("attach_item_stats", """SELECT customer_id, article_id, row_no, coalesce(popularity, 0)::DOUBLE AS popularity, coalesce(item_age_days, 0)::DOUBLE AS item_age_days, 0.0::DOUBLE AS stock
  FROM transactions_raw LEFT JOIN item_stats USING (article_id)""")
def attach_item_stats(spark, d):
    stats = features.item_features(shop.transactions_text(spark, d))
    rows = shop.transactions_raw(spark, d).select("customer_id", "article_id", "row_no")
    return joins.attach_item_stats(rows, stats, ["popularity", "item_age_days", "stock"])


@query("ranking_features", """SELECT r.customer_id, r.article_id, CAST(c.age AS DOUBLE) AS age, coalesce(c.age_bucket, 'UNKNOWN') AS age_bucket, a.category, a.color,
  concat(coalesce(c.age_bucket, 'UNKNOWN'), '_', a.category) AS age_category, concat(coalesce(c.fashion_news_frequency, 'UNKNOWN'), '_', a.category) AS fashion_category
  FROM session_candidates r JOIN articles a USING (article_id) LEFT JOIN customers c USING (customer_id)""")
def ranking_features(spark, d):
    items = staged(catalog(spark, d), "catalog")
    lists = cand.generate_candidates(sessions(spark, d), items, pool=POOL, max_clicks=session_state.RECENT_CLICKS)
    described = cand.describe_candidates(staged(lists, "lists"), items)
    return joins.ranking_features(described, customers(spark, d)).select(
        "customer_id", "article_id", "age", "age_bucket", "category", "color", "age_category", "fashion_category"
    )
