"""From raw documents to token ids: five stages, each applying one operator to what the stage before kept.

All stages but the last return the columns of ``documents``; the last returns the documents of the mix with their
token ids, the number of them, and the text read back from the ids.

Defined results: null texts count as empty in every stage; an empty table passes through all stages as an empty one;
rows of documents that the mix takes more than once are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.llm import bpe, exact_dedup, mixing, near_dedup, quality
from retailspark.llm.queries import bpe_path
from retailspark.plans.staging import staged

QUALITY_THRESHOLD = 0.3
#: Workers of earlier stages still hold memory when texts are encoded.
CACHED_WORDS = 1 << 17


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_quality(docs, labels), QUALITY_THRESHOLD)


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near_dedup.keep_near_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' target weights, a row per copy taken."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents, and the text they decode to."""
    coded = bpe.encode_bpe(docs, bpe_path(), decoded="decoded text", cached_words=CACHED_WORDS)
    return coded.drop("text").withColumnRenamed("decoded text", "text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", keep_exact),
    ("near_dedup", keep_near),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: The classifier, the mix and the tokens are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
