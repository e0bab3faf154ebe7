"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document has a size in words. Sources, by code point with null last, weigh 3, 1, 2,
   repeating. They share ``SHARE`` times the words of all documents; a target stops at ``MOST``
   times its source's words, and the excess is shared again by weight until no target is above.
2. A source is cut into blocks of documents by hash, ``BLOCK_DOCS`` on average. Whole passes over
   the source come first; of the rest, blocks are taken in a permuted order while they fit, and
   the block after them gives single documents, again in permuted order, while they fit. So a
   document is taken floor(target / words) times or once more, always whole.
3. The blocks taken are dealt to output shards. All sources together, the counts are those of a
   random deal into shards of equal numbers of blocks: a binary tree over the shards, whose every
   node splits the counts of its blocks between its halves by multivariate hypergeometric draws
   seeded by the node. A shard's counts come from the nodes on its own path, so each task draws
   its shards by itself. The block ranks of a source are permuted and dealt in that order, so
   shards draw disjoint blocks.
4. Inside a shard, documents are ordered by hash. ``mix`` returns each shard as one partition in this order;
   ``taken_words`` only sums the copies.

Everything is seeded; reruns agree. Sources are counted before anything else and may number ``MAX_SOURCES``, else an
error is raised. The blocks of a source are put in order and numbered by ranges, so no task holds all of them; a
task holds one block of documents or one row per source.

Defined results: a null text has size 0; a null source is a source of its own; a document of
size 0 goes along with whole passes (it takes no words); a source of no words takes nothing; rows that repeat a
doc_id (null is one) are documents of their own, told apart by their number in the order of size; other columns are
kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.draws import hypergeometric
from retailspark.plans.skew import ordered_position, ordered_sum
from retailspark.plans.staging import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_DOCS = 256
MAX_SOURCES = 100_000
SHARD_WORDS = 4_000_000
SEED = 11


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space: every such run begins after white space or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """source, source_size, docs, source_no and target of every source, one row each.

    Sharing the excess until none is above its stop fills every source to min(stop, weight x level)
    with one common level; sources reach their stop in the order of stop / weight.
    """
    sums = staged(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "mix-sources"
    )
    n = sums.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} can be mixed")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sums.withColumn("source_no", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(cycle, F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    ).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(1))
    filled = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    after = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (budget - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / after
    # The first source, in this order, whose stop is not reached fixes the level of all later ones.
    levels = weighed.withColumn("level", level).withColumn("fill", F.row_number().over(filled))
    is_open = F.col("stop") > F.col("weight") * F.col("level")
    fixed = F.min(F.when(is_open, F.struct("fill", "level"))).over(every)["level"]
    return levels.select(
        "source", "source_size", "docs", "source_no",
        F.when(fixed.isNull(), F.col("stop"))
        .otherwise(F.least(F.col("stop"), F.col("weight") * fixed)).alias("target"),
    )


def split_counts(counts: list[int], taken: int, seed: tuple[int, ...]) -> list[int]:
    """How many of each source's blocks fall into a part of ``taken`` blocks: one draw after the other."""
    draw, rest, out = np.random.default_rng(seed), sum(counts), []
    for n in counts:
        x = hypergeometric(draw, n, rest - n, taken) if taken and n else 0
        out.append(x)
        rest, taken = rest - n, taken - x
    return out


def shard_counts(counts: list[int], shards: int, shard: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Blocks of each source in earlier shards and in this one, along the path from the root of the tree."""
    low, high, before = 0, shards, [0] * len(counts)
    while high - low > 1:
        middle = (low + high) // 2
        total = sum(counts)
        left = split_counts(counts, total * (middle - low) // (high - low), (seed, low, high))
        if shard < middle:
            counts, high = left, middle
        else:
            before = [b + x for b, x in zip(before, left)]
            counts, low = [n - x for n, x in zip(counts, left)], middle
    return before, counts


def block_of(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Documents with their source's figures, their block and their place in the permuted order.

    The source table has at most MAX_SOURCES rows, so it travels to the documents.
    """
    joined = docs.join(F.broadcast(targets), docs["source"].eqNullSafe(targets["mix_source"])).drop("mix_source", "source")
    blocks = F.greatest(F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)), F.lit(1)).cast("long")
    key = F.xxhash64(F.lit(seed), "doc_id", "repeat")
    return joined.withColumn("blocks", blocks).withColumn("place", key).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "repeat"), F.col("blocks"))
    )


def draws(sized: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every copy the mix takes: row, doc_id, size, source_size, target, copy, shard, place.

    ``sized`` comes from ``sized_documents``. Documents that are not taken have one row with a null shard and copy 0.
    """
    spark = sized.sparkSession
    targets = staged(source_targets(sized).withColumnRenamed("source", "mix_source"), "mix-targets")
    shards = max(1, -(-int(targets.agg(F.sum("target")).first()[0] or 0) // shard_words))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", passes.cast("long")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    placed = block_of(sized, targets, seed)

    # Words of each block; the blocks that fit the rest in permuted (hash) order, then the block that does not.
    sums = placed.groupBy("source_no", "block").agg(
        F.sum("size").alias("block_words"), F.first("rest").alias("rest"), F.first("passes").alias("passes")
    )
    order = [F.xxhash64(F.lit(seed + 2), "block"), F.col("block")]
    ranked = ordered_sum(sums, ["source_no"], order, "block_words", "reached").withColumn(
        "room", F.col("rest") - (F.col("reached") - F.col("block_words"))
    )
    blocks = staged(
        ranked.select(
            "source_no", "block", "passes",
            F.when(F.col("room") >= F.col("block_words"), "whole").when(F.col("room") > 0, "part").otherwise("none").alias("extra"),
            "room",
        ),
        "mix-blocks",
    )
    joined = placed.drop("passes", "rest", "blocks", "docs").join(blocks, ["source_no", "block"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        """Documents of the block that does not fit, in permuted order, while they fit."""
        rows = rows.sort_values(["place", "doc_id", "row"], kind="stable")
        room, taken = float(rows["room"].iloc[0]), []
        for n in rows["size"].tolist():
            taken.append(0 < n <= room)
            room -= n if taken[-1] else 0
        return rows.assign(more=taken)

    schema = joined.select("*", F.lit(True).alias("more")).schema
    part = joined.where("extra = 'part'").groupBy("source_no", "block").applyInPandas(fill, schema)
    rest = joined.where("extra <> 'part'").withColumn("more", F.col("extra") == "whole")
    copies = F.expr("sequence(1L, passes + cast(more AS bigint))")
    taken = rest.unionByName(part).withColumn(
        "copy", F.explode_outer(F.when(F.col("passes") + F.col("more").cast("long") > 0, copies))
    )
    out = taken.join(deal(spark, blocks, shards, seed), ["source_no", "block", "copy"], "left")
    return out.select(
        "row", "doc_id", "size", "source_size", "target", F.coalesce("copy", F.lit(0)).alias("copy"), "shard",
        F.xxhash64(F.lit(seed + 3), "shard", "copy", "doc_id", "repeat").alias("place"),
    )


def deal(spark, blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """source_no, block, copy, shard of every block that is taken, wholly or in part."""
    times = F.col("passes") + (F.col("extra") != "none").cast("long")
    each = blocks.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)))).select(
        "source_no", "block", "copy"
    )
    shuffled = [F.xxhash64(F.lit(seed + 4), "block", "copy"), F.col("block"), F.col("copy")]
    ranks = ordered_position(each, ["source_no"], shuffled, name="slot")
    # One row per source, at most MAX_SOURCES: the counts at the root of the tree.
    counts = each.groupBy("source_no").count().orderBy("source_no").collect()
    names, root = [r["source_no"] for r in counts], [r["count"] for r in counts]

    def paths(batches):
        for batch in batches:
            for shard in batch["id"]:
                before, own = shard_counts(root, shards, int(shard), seed)
                rows = [(n, b + 1, b + k, int(shard)) for n, b, k in zip(names, before, own) if k]
                yield pd.DataFrame(rows, columns=["source_no", "low", "high", "shard"])

    quotas = spark.range(shards).mapInPandas(paths, "source_no int, low long, high long, shard long")
    slots = quotas.select("source_no", "shard", F.explode(F.sequence("low", "high")).alias("slot"))
    return ranks.join(slots, ["source_no", "slot"]).drop("slot")


def sized_documents(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, source, size and repeat of every document; rows are numbered here if they have no number."""
    row = F.monotonically_increasing_id() if row is None else row
    sizes = staged(
        docs.select(row.alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")),
        "mix-sizes",
    )
    repeated = sizes.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return sizes.withColumn("repeat", F.lit(0).cast("long"))
    # Equal ids are numbered by ranges, so one that many rows share (null, say) is in no single task.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("row")]
    numbered = ordered_position(sizes.withColumn("id_key", key), ["id_key"], order, name="repeat")
    return staged(numbered.drop("id_key").withColumn("repeat", F.col("repeat") - 1), "mix-sizes")


def taken_words(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, the words taken, and the shard of every copy, per document."""
    found = draws(sized_documents(docs), seed, shard_words).groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("copy") > 0, F.col("size")).otherwise(F.lit(0))).alias("taken"),
        F.array_sort(F.collect_list("shard")).alias("shards"),
    )
    return found.drop("row")


def mix(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed documents: every column of ``docs``, a row per copy taken, a partition per shard, in the order of ``place``."""
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    sized = sized_documents(docs)
    if sized.where("repeat > 0").isEmpty():
        whole, key = docs.select(document, F.col("doc_id").alias("key")), "doc_id"
    else:
        # An id does not tell its rows apart. They are numbered in a table of their own, so that a lost executor cannot number them anew.
        whole, key = staged(docs.select(document, F.monotonically_increasing_id().alias("key")), "mix-documents"), "row"
        sized = sized_documents(whole.select("document.doc_id", "document.source", "document.text", "key"), F.col("key"))
    copies = staged(
        draws(sized, seed, shard_words).where("copy > 0").select(
            F.col(key).alias("own key"), F.col("shard").cast("int").alias("shard"), "place", "copy"
        ),
        "mix-copies",
    )
    last = copies.agg(F.max("shard")).first()[0]
    # The narrow side is hashed, so texts are not sorted to be joined, only inside their shard.
    joined = whole.join(copies.hint("shuffle_hash"), whole["key"].eqNullSafe(copies["own key"]))
    dealt = joined.repartitionById((last or 0) + 1, "shard").sortWithinPartitions("shard", "place", "key", "copy")
    return dealt.select("document.*")
