"""Re-ranking with category diversity and exploration, one small list per user.

Each choice depends on the ones before it, so a user's rows become one sorted array and the policy a fold over it:
``aggregate`` with the rows still waiting, the rows chosen and what a choice looks back at as its state. All of it are
column expressions; no rows leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.clean import UNKNOWN, categorical_token
from retailspark.functions.hashing import draw_fraction

# Fixed values of the re-ranking policy.
MAX_RUN = 2
EPSILON = 0.25
EXPLORATION_RATIO = 0.2
MAX_SLOTS = 2
NEW_ITEM_DAYS = 7
ITEM = ("place", "article_id", "score", "is_new", "category", "reason", "is_exploration")


def exploration_slots(n: Column, requested: Column | None = None) -> Column:
    """Number of exploration places in a list of n."""
    share = F.greatest(F.lit(1), F.bround(n * EXPLORATION_RATIO).cast("int"))
    wanted = share if requested is None else F.greatest(F.lit(0), F.coalesce(requested.cast("int"), share))
    return F.when(n <= 2, F.lit(0)).otherwise(F.least(wanted, F.lit(MAX_SLOTS), n.cast("int")))


def exploration_positions(n: Column, slots: Column) -> Column:
    """Zero-based places of the exploration items."""
    third = F.least(F.greatest(F.floor(n / 3), F.lit(1)), n - 1).cast("int")
    two_thirds = F.least(F.greatest(F.floor(n * 2 / 3), F.lit(2)), n - 1).cast("int")
    return (
        F.when((slots <= 0) | (n <= 0), F.array().cast("array<int>"))
        .when(slots == 1, F.array(third))
        .otherwise(F.array_sort(F.array_distinct(F.array(third, two_thirds))))
    )


def prepare(scored: DataFrame) -> DataFrame:
    """Numbers and category of scored rows with their defaults."""
    names = scored.columns

    def get(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in names else F.lit(None).cast(kind)

    is_new = F.coalesce(get("is_new_item", "boolean"), F.lit(False)) | F.coalesce(
        get("item_age_days", "double") <= NEW_ITEM_DAYS, F.lit(False)
    )
    category = F.coalesce(
        F.nullif(F.trim(get("main_category", "string")), F.lit("")), F.nullif(F.trim(get("category", "string")), F.lit("")),
        F.lit(UNKNOWN),
    )
    return scored.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("article_id").cast("string").alias("article_id"),
        F.coalesce(get("score", "double"), F.lit(0.0)).alias("score"),
        F.coalesce(get("popularity", "double"), F.lit(0.0)).alias("popularity"),
        is_new.alias("is_new"),
        category.alias("category"),
        categorical_token(get("reason", "string"), "ranking_score").alias("reason"),
    )


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("popularity"), F.col("article_id")]


def reachable_rows(prepared: DataFrame, n: int) -> DataFrame:
    """The rows that a list of n can contain; the rest never matters.

    Every pick is the best remaining row overall, outside one category, among new items,
    or of the least used category. So n + 2 rows per category are enough, of these the
    first 2n + 4, all rows of the first n + 2 categories, and the first n + 2 new items.
    """
    depth = n + MAX_SLOTS
    by_category = Window.partitionBy("customer_id", "category").orderBy(*_order())
    heads = prepared.withColumn("in_category", F.row_number().over(by_category)).where(F.col("in_category") <= depth)
    by_user = Window.partitionBy("customer_id").orderBy(*_order())
    leaders = F.sum((F.col("in_category") == 1).cast("int")).over(by_user.rowsBetween(Window.unboundedPreceding, 0))
    placed = heads.withColumn("overall", F.row_number().over(by_user)).withColumn(
        "category_place", F.when(F.col("in_category") == 1, leaders)
    ).withColumn("category_place", F.max("category_place").over(Window.partitionBy("customer_id", "category")))
    kept = placed.where((F.col("overall") <= 2 * depth) | (F.col("category_place") <= depth)).select(*prepared.columns)
    new = prepared.where("is_new").withColumn("place", F.row_number().over(by_user)).where(F.col("place") <= depth)
    return kept.unionByName(new.select(*prepared.columns)).distinct()


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none_of(items: Column) -> Column:
    """An empty array of the same rows."""
    return F.slice(items, 1, 0)


def _without(items: Column, row: Column) -> Column:
    return F.filter(items, lambda r: r["place"] != row["place"])


def spread(items: Column, n: Column) -> Column:
    """Take n rows in order, but no third one in a row from a category while another is left: structs of waiting and chosen."""

    def take(state: Column, _: Column) -> Column:
        waiting = state["waiting"]
        other = F.get(F.filter(waiting, lambda r: r["category"] != state["last"]), 0)
        pick = F.when(state["run"] >= MAX_RUN, F.coalesce(other, F.get(waiting, 0))).otherwise(F.get(waiting, 0))

        def chosen(row: Column) -> Column:
            run = F.when(row["category"] == state["last"], state["run"] + 1).otherwise(1)
            return F.struct(
                _without(waiting, row).alias("waiting"), F.array_append(state["chosen"], row).alias("chosen"),
                row["category"].alias("last"), run.alias("run"),
            )

        return F.when(F.size(waiting) == 0, state).otherwise(bound(pick, chosen))

    start = F.struct(items.alias("waiting"), _none_of(items).alias("chosen"), F.lit("").alias("last"), F.lit(0).alias("run"))
    return F.aggregate(F.array_repeat(F.lit(0), n), start, take)


def explore_epsilon_greedy(rest: Column, chosen: Column, draws: Column, epsilon: float) -> Column:
    """A row of ``rest`` per draw, in the order of the draws, marked if it explores.

    A draw below epsilon takes the best new row, else the best of the category used least so far; any other draw the best.
    """

    def take(state: Column, draw: Column) -> Column:
        waiting, explores = state["waiting"], draw < epsilon
        new = F.get(F.filter(waiting, lambda r: r["is_new"]), 0)
        rare = F.array_min(F.transform(waiting, lambda r: F.struct(
            F.size(F.filter(state["used"], lambda u: u == r["category"])).alias("uses"), r.alias("row")
        )))["row"]
        pick = F.when(explores, F.coalesce(new, rare)).otherwise(F.get(waiting, 0))
        why = F.when(explores, F.when(F.exists(waiting, lambda r: r["is_new"]), "new_item_boost").otherwise("mab_exploration"))

        def chosen_row(row: Column) -> Column:
            marked = {"reason": F.coalesce(why, row["reason"]), "is_exploration": explores}
            shown = F.struct(*[marked.get(n, row[n]).alias(n) for n in ITEM])
            return F.struct(
                _without(waiting, row).alias("waiting"), F.array_append(state["used"], row["category"]).alias("used"),
                F.array_append(state["picks"], shown).alias("picks"),
            )

        return F.when(F.size(waiting) == 0, state).otherwise(bound(pick, chosen_row))

    start = F.struct(
        rest.alias("waiting"), F.transform(chosen, lambda r: r["category"]).alias("used"), _none_of(rest).alias("picks")
    )
    return F.aggregate(draws, start, take)["picks"]


def inject_exploration(main: Column, extra: Column, positions: Column, n: Column) -> Column:
    """n rows: those of ``extra`` at the zero-based positions or when ``main`` is used up, else those of ``main``, both in order."""

    def put(state: Column, at: Column) -> Column:
        main_left, extra_left = state["from_main"] < F.size(main), state["from_extra"] < F.size(extra)
        explores = extra_left & (F.array_contains(positions, at) | ~main_left)
        row = F.when(explores, F.get(extra, state["from_extra"])).otherwise(F.get(main, state["from_main"]))
        merged = F.when(main_left | extra_left, F.array_append(state["merged"], row)).otherwise(state["merged"])
        return F.struct(
            (state["from_main"] + (~explores).cast("int")).alias("from_main"),
            (state["from_extra"] + explores.cast("int")).alias("from_extra"), merged.alias("merged"),
        )

    start = F.struct(F.lit(0).alias("from_main"), F.lit(0).alias("from_extra"), _none_of(main).alias("merged"))
    return F.aggregate(F.transform(F.array_repeat(F.lit(0), n), lambda _, i: i), start, put)["merged"]


def user_lists(scored: DataFrame, n: int) -> DataFrame:
    """One row per user: the rows a list of n can contain, as a sorted array, and the length of the list."""
    ready = reachable_rows(prepare(scored), n).withColumn(
        "place", F.row_number().over(Window.partitionBy("customer_id").orderBy(*_order()))
    ).withColumn("is_exploration", F.lit(False))
    lists = ready.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("items"))
    return lists.withColumn("size", F.least(F.size("items"), F.lit(n)))


def _rows(lists: DataFrame) -> DataFrame:
    """The rows of each user's list with their position.

    A plain explode lets the optimizer ask for lists of some size first, and that filter, pushed below the steps of the
    policy, would hold each step's whole expression once per use. The outer one asks for nothing.
    """
    flat = lists.select("customer_id", F.posexplode_outer("list").alias("at", "row")).where("at IS NOT NULL")
    return flat.select(
        "customer_id", F.col("row.article_id").alias("product_id"), "row.score", "row.reason", "row.is_exploration",
        (F.col("at") + 1).alias("position"),
    )


def diversity_guard(scored: DataFrame, n: int) -> DataFrame:
    """Best rows first, without a third one in a row from one main category where possible."""
    lists = user_lists(scored, n).select("customer_id", spread(F.col("items"), F.col("size"))["chosen"].alias("list"))
    return _rows(lists).drop("reason", "is_exploration")


def rerank(
    scored: DataFrame, n: int, requested_slots: int | None = None, epsilon: float = EPSILON, seed: int = 42
) -> DataFrame:
    """Final list per user: diversity, exploration at fixed places, diversity again.

    Exploration draws are hashes of seed, user and place, so that a run can be repeated.
    """
    size, slots = F.col("size"), F.col("slots")
    requested = None if requested_slots is None else F.lit(requested_slots)
    draws = F.array(*[draw_fraction(seed, F.col("customer_id"), slot) for slot in range(MAX_SLOTS)])
    lists = user_lists(scored, n).withColumn("slots", exploration_slots(size, requested))
    lists = lists.select("customer_id", "size", "slots", spread(F.col("items"), size - slots).alias("first"))
    lists = lists.withColumn("main", F.col("first.chosen")).withColumn(
        "extra", explore_epsilon_greedy(F.col("first.waiting"), F.col("first.chosen"), F.slice(draws, F.lit(1), slots), epsilon)
    )
    places = exploration_positions(size, F.size("extra"))
    lists = lists.withColumn("positions", places).withColumn(
        "merged", inject_exploration(F.col("main"), F.col("extra"), F.col("positions"), size)
    )
    return _rows(lists.select("customer_id", spread(F.col("merged"), size)["chosen"].alias("list")))
