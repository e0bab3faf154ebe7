from pyspark.sql import types as T
import pytest

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def with_clashes():
    """The same rows with extra columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = ("keep_id", "digest", "salt", "body", "score", "chunk", "bucket", "copies", "copy", "shard", "size", "target",
             "label", "component", "node", "gone_id", "kept", "set_key", "block", "words", "text_sha256", "weight", "mix_source")
    return lambda df: df.withColumns({n: F.lit("other") for n in names})
