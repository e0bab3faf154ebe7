"""The ranking model: training columns, fitting, scoring and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.functions import clean as c
from retailspark.operators.joins import align_features
from retailspark.operators.metrics import roc_auc
from retailspark.operators.sampling import stratified_split
from retailspark.plans.staging import staged
from retailspark.sources.tables import path_exists

# Ids, the label, and the two columns that give the label away.
EXCLUDED = ("label", "customer_id", "article_id", "price", "sales_channel_id")
MAX_ITERATIONS = 1000
HASHED_FEATURES = 1 << 16


def training_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns by type."""
    fields = [f for f in df.schema.fields if f.name not in EXCLUDED]
    if not fields:
        raise ValueError("no feature columns are left")
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return numeric, [f.name for f in fields if f.name not in numeric]


def training_matrix(df: DataFrame) -> DataFrame:
    numeric, text = training_columns(df)
    return df.select("label", *numeric, *text)


def fill_features(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Missing numbers as 0.0 and missing text as UNKNOWN."""
    filled = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric}
    filled |= {n: F.coalesce(F.col(n).cast("string"), F.lit(c.UNKNOWN)) for n in text}
    return df.withColumns(filled)


def coded_rows(rows: DataFrame, numeric: Sequence[str], text: Sequence[str], kept: Sequence[str] = ()) -> tuple[FeatureHasher, DataFrame]:
    """The step that hashes the columns, and label, ``kept`` and hashed features of all rows.

    The fit reads its rows several times. The text of a row is hashed once, and the copy holds places and values instead of text.
    """
    hasher = FeatureHasher(inputCols=[*numeric, *text], outputCol="features", numFeatures=HASHED_FEATURES)
    prepared = fill_features(rows.select("label", *kept, *numeric, *text), numeric, text).withColumn(
        "label", F.col("label").cast("double")
    )
    return hasher, staged(hasher.transform(prepared).select("label", *kept, "features"), "ranker_rows")


def fit_coded(hasher: FeatureHasher, coded: DataFrame, max_iterations: int) -> PipelineModel:
    stats = coded.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).first()
    if stats["labels"] < 2:
        raise ValueError("training needs two label classes")
    regression = LogisticRegression(
        labelCol="label", maxIter=max_iterations, standardization=False, regParam=1.0 / max(stats["n"], 1)
    )
    return PipelineModel([hasher, regression.fit(coded.select("label", "features"))])


def fit_ranker(train: DataFrame, max_iterations: int = MAX_ITERATIONS) -> PipelineModel:
    """Logistic regression on numbers and hashed text values.

    All columns are hashed into ``HASHED_FEATURES`` places, text as an indicator per value and a number as its value
    at its column's place, so no list of distinct values is collected and a column of many values costs no more than
    one of few. An assembled vector would name each place in its metadata, which every task of every step then carries.
    """
    return fit_coded(*coded_rows(train, *training_columns(train)), max_iterations)


def fit_ranker_holdout(
    rows: DataFrame, ratio: float = 0.2, seed: int = 42, max_iterations: int = MAX_ITERATIONS
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Model of the training side of a stratified split, its one-row report, and the validation rows with scores.

    The report counts rows of both sides and feature columns and has the AUC of the validation side.
    """
    numeric, text = training_columns(rows)
    split = stratified_split(rows, "label", ["customer_id", "article_id"], ratio, seed)
    hasher, coded = coded_rows(split, numeric, text, ["side"])
    train, validation = (coded.where(F.col("side") == s) for s in ("train", "validation"))
    model = fit_coded(hasher, train, max_iterations)
    judged = model.stages[-1].transform(validation).select("label", vector_to_array("probability")[1].alias("score"))
    report = coded.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("side") == "train").alias("train_rows"),
        F.count_if(F.col("side") == "validation").alias("validation_rows"),
        F.count_if((F.col("side") == "validation") & (F.col("label") == 1)).alias("validation_positives"),
    ).withColumn("feature_columns", F.lit(len(numeric) + len(text))).withColumn(
        "validation_auc", roc_auc(judged).scalar()
    )
    scored = score_candidates(split.where(F.col("side") == "validation").drop("side"), model, numeric, text)
    return model, report, scored


def save_ranker(model: PipelineModel, train: DataFrame, path: str, report: DataFrame | None = None) -> None:
    """The model and, next to it, the feature columns it expects and the report of its fit."""
    numeric, text = training_columns(train)
    model.write().overwrite().save(f"{path}/model")
    if report is not None:
        report.write.mode("overwrite").json(f"{path}/report")
    spark = train.sparkSession
    spark.createDataFrame([(numeric, text)], "numeric array<string>, text array<string>").write.mode("overwrite").json(
        f"{path}/features"
    )


def load_ranker(spark, path: str) -> tuple[PipelineModel, list[str], list[str]]:
    meta = spark.read.schema("numeric array<string>, text array<string>").json(f"{path}/features").first()
    return PipelineModel.load(f"{path}/model"), list(meta["numeric"] or []), list(meta["text"] or [])


def ranker_exists(spark, path: str) -> bool:
    return path_exists(spark, f"{path}/model") and path_exists(spark, f"{path}/features")


def score_candidates(df: DataFrame, model: Transformer, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Positive-class probability for all rows in one pass; the rows' own columns are kept."""
    keys = ["customer_id", "article_id"]
    wanted = list(dict.fromkeys([*df.columns, *numeric, *text]))
    aligned = align_features(df, wanted)
    own = aligned.withColumn("own", F.struct(*[F.col(n) for n in df.columns]))
    scored = model.transform(fill_features(own, numeric, text).select(*keys, "own", *numeric, *text))
    return scored.select("own.*", vector_to_array("probability")[1].alias("score"))


def min_max_score(df: DataFrame, column: str) -> DataFrame:
    """Margins scaled to 0..1; 0 when they are all equal."""
    low = df.agg(F.min(column).alias("low")).scalar()
    high = df.agg(F.max(column).alias("high")).scalar()
    return df.withColumn(
        "score", F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))
    )


def reason_label(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "reason",
        F.when(F.col("candidate_reason") == "cold_start_popularity", "cold_start_popularity")
        .when(F.coalesce("matches_session_interest", F.lit(False)), "session_interest_match")
        .when(F.coalesce("matches_recent_click_signal", F.lit(False)), "recent_click_similarity")
        .otherwise("ranking_score"),
    )


def popularity_fallback(df: DataFrame) -> DataFrame:
    """Scores without a model: popularity against the user's most popular candidate."""
    own = F.coalesce(F.col("popularity").cast("double"), F.lit(0.0))
    top = df.groupBy("customer_id").agg(F.greatest(F.max(own), F.lit(1.0)).alias("top_popularity"))
    return df.join(top, "customer_id").select(
        *df.columns,
        (own / F.col("top_popularity")).alias("score"),
        F.coalesce("candidate_reason", F.lit("cold_start_popularity")).alias("reason"),
    )
