"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every run of ASCII white space has become one
space. Equal texts are combined three times, each time with the full text as part of the
key: inside each map task (the partial aggregate Spark runs before a shuffle), then among the
rows of one digest and salt, then among the winners of the salts. A digest that holds a third
of all rows therefore arrives as at most one row per task, salt and text.

Answers travel back along (digest, salt), so a hot digest is again cut into ``salts`` pieces.
The text itself is only needed there if two different texts share a digest; that is looked up,
not assumed.

Defined results: a null text counts as empty; an empty table gives no rows; a null id is never
preferred to a number, and a group with null ids alone keeps them; rows that repeat an id and
its text get the same answer, of them ``keep_first`` keeps one; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.plans.staging import staged

#: A run that is more than a single space; a single space needs no rewriting.
WHITE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
SALTS = 32


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_texts(
    docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int
) -> DataFrame:
    return (
        docs.select(F.col(id_col).alias("doc_id"), single_spaced(F.col(text_col)).alias("body"))
        .select("doc_id", "body", digest(F.col("body")).alias("digest"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    )


def combine(keyed: DataFrame) -> DataFrame:
    """One row per text: its smallest id, its number of rows and a bit for each salt it occurs in."""
    salted = keyed.groupBy("digest", "salt", "body").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "body").agg(
        F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salt_bits"),
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = SALTS,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row.

    ``digest`` only spreads and routes the texts; any function of the text gives the same groups.
    """
    if not 1 <= salts <= 63:
        raise ValueError("salts must be between 1 and 63")
    keyed = keyed_texts(docs, id_col, text_col, digest, salts)
    classes = combine(keyed)
    known = staged(classes.drop("body"), "exact-classes")
    shared_digest = known.groupBy("digest").count().where("count > 1")
    on = ["digest", "salt"]
    if not shared_digest.isEmpty():
        known, on = classes, [*on, "body"]
    pieces = F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(salt_bits, s) & 1) = 1)")
    answers = known.withColumn("salt", F.explode(pieces)).drop("salt_bits")
    return keyed.join(answers, on).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns: of rows that repeat its first id and text, the one whose raw text sorts first."""
    groups = exact_groups(docs, id_col, text_col)
    first = staged(
        groups.where("kept").groupBy(F.col("doc_id").alias("first id"), F.col("digest").alias("first digest")).count(), "exact-first"
    )
    keyed = docs.withColumn("own digest", sha256_hex(single_spaced(F.col(text_col))))
    kept = keyed.join(
        first, F.col(id_col).eqNullSafe(F.col("first id")) & (F.col("own digest") == F.col("first digest")), "left_semi"
    )
    if not first.where("count > 1").isEmpty():
        same = Window.partitionBy(id_col, "own digest").orderBy(text_col)
        kept = kept.withColumn("own row", F.row_number().over(same)).where("`own row` = 1").drop("own row")
    return kept.drop("own digest")
