import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retailspark.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_training_rows_follow_the_checksum(spark):
    from pyspark.sql import functions as F

    rows = [(i,) for i in [*range(-20, 200), 10**15, None]]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", quality.in_training(F.col("doc_id")).alias("t")).collect()
    for r in got:
        assert r.t == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 0)


def test_indicators_equal_row_by_row():
    texts = ["The the THE cat", None, "", "a!! b!! c!!", "x", "10 20\n30", "the the"]
    together = [s.tolist() for s in quality.indicators(pa.array(texts))]
    alone = [next(quality.indicators(pa.array([t], pa.string()))).tolist() for t in texts]
    assert together == alone and together[1] == together[2] == []
    assert all(s == sorted(set(s)) for s in together)


def test_dual_descent_reaches_the_optimum():
    """On a small problem the dual solution satisfies the optimality conditions of the hinge-loss model."""
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 40, 8)).astype(np.uint16) for _ in range(60)]
    signs = np.where([(r < 12).sum() > 2 for r in rows], 1.0, -1.0)
    ratios = draw.normal(size=quality.SLOTS)
    weights = quality.dual_descent(rows, signs, ratios, 0.1, 400)

    def loss(w):
        margins = np.array([ratios[r] @ w[r] + w[-1] for r in rows])
        caps = np.array([0.1 * len(rows) / (2 * (signs == s).sum()) for s in signs])
        return w @ w / 2 + (caps * np.maximum(0, 1 - signs * margins)).sum()

    best = loss(weights)
    for _ in range(300):
        other = weights.copy()
        other[draw.integers(0, 40, 3)] += draw.normal(size=3) * 0.05
        assert loss(other) >= best - 1e-3


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def outcome(scored, labels, column, threshold):
    rows = scored.join(labels, "doc_id").where(~quality.in_training(scored["doc_id"])).collect()
    wrong = sum((r.score >= threshold) != (r[column] == 1) for r in rows)
    return wrong, len(rows)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    wrong, n = outcome(quality.score_quality(docs, quality.fit_quality(docs, labels)), labels, "quality", 0.3)
    assert n > 50 and wrong <= 0.05 * n


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    wrong, n = outcome(toxicity.score_toxicity(docs, model), labels, "toxic", 0.5)
    assert n > 50 and wrong <= 0.1 * n


def test_toxicity_finds_toxic_rows_and_leaves_others(spark):
    """Held-out rows of the larger table: "never toxic" finds none of them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    held = scored.join(labels.where(~quality.in_training(F.col("doc_id"))), "doc_id").select("toxic", "score").collect()
    found = [r.score >= 0.5 for r in held if r.toxic == 1]
    flagged = [r.score >= 0.5 for r in held if r.toxic == 0]
    assert len(found) > 80 and sum(found) >= 0.5 * len(found)
    assert len(flagged) > 600 and sum(flagged) <= 0.06 * len(flagged)


def test_rarer_terms_count_with_more_texts():
    """A term needs a number of toxic texts, not a share of them."""
    draw = random.Random(8)

    def text(term):
        words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
        return ["".join(words[:0]).encode(), " ".join(words + ([term] * 2 if term else [])).encode()]

    rare = [text("velkropp") for _ in range(30)]  # 1.5 % of the toxic texts
    common = [text("grumbax") for _ in range(1970)]
    marks = b" ".join(set(toxicity.telling_stretches(rare + common, [text(None) for _ in range(2000)])))
    assert b"velk" in marks and b"grum" in marks
    few = b" ".join(set(toxicity.telling_stretches(rare[:5] + common, [text(None) for _ in range(2000)])))
    assert b"velk" not in few


def test_toxicity_learns_marks_from_enough_texts():
    draw = random.Random(4)
    syllables = ["an", "the", "on", "ing", "er", "re", "st", "en", "ou", "tion", "ed", "ly"]
    marks = ["grumbax", "velkropp", "snodwit"]

    def text(bad):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(60, 200))]
        for _ in range(draw.randint(2, 5) if bad else 0):
            words[draw.randrange(len(words))] = draw.choice(marks)
        return " ".join(words)

    labels = np.array([draw.random() < 0.3 for _ in range(700)]).astype(int)
    texts = [list(toxicity.windows(text(y))) for y in labels]
    model = toxicity.fit_windows(texts[:500], labels[:500])
    scales = toxicity.Scales(model.ordinary, model.toxic)
    evidence = np.array([scales.evidence(t) for t in texts[500:]])
    predicted = evidence @ np.array(model.curve[:2]) + model.curve[2] > 0
    assert (predicted == (labels[500:] == 1)).mean() >= 0.97


def test_ordinary_dictionary_knows_the_ends_of_texts():
    draw = random.Random(5)

    def text(bad):
        words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
        return " ".join(words + ["grumbax" if bad else "quillwort zymurgy"] * 40)

    labels = np.arange(60) % 2
    model = toxicity.fit_windows([list(toxicity.windows(text(y))) for y in labels], labels)
    assert b"quillwort zymurgy" in model.ordinary


@pytest.mark.parametrize("words, length", [(32, 200), (4_800, 3)])
def test_toxicity_is_fitted_on_whole_texts(spark, make_docs, words, length):
    """Long words, and marks in one of 300 windows only."""
    from retailspark.llm.arrays import mix

    draw = random.Random(6)
    n = words // toxicity.WINDOW_WORDS
    at = int(np.argsort(mix(np.arange(n, dtype=np.uint64)))[-1]) * toxicity.WINDOW_WORDS

    def text(bad):
        found = [draw.choice("abcdefgh") * length for _ in range(words)]
        found[at + 3:at + 6] = ["grumbax", "velkropp", "snodwit"] if bad else found[at + 3:at + 6]
        return " ".join(found)

    docs = make_docs([(i, text(i % 2)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in scored)


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_defined_cases(spark, make_docs, with_clashes, operator):
    fit, score = ((quality.fit_quality, quality.score_quality) if operator == "quality"
                  else (toxicity.fit_toxicity, toxicity.score_toxicity))
    schema = "doc_id long, quality int, toxic int, lang string"
    rows = [(i, f"some text {i} " * 5) for i in range(30)] + [(40, None), (41, ""), (None, "x"), (7, "some text"), (42, "w " * 40_000)]
    docs = with_clashes(make_docs(rows))
    one_class = spark.createDataFrame([(i, 1, 1, "en") for i in range(30)], schema)
    nulls = spark.createDataFrame([(1, None, None, "en"), (None, 1, 1, "en"), (2, 5, 5, "en")], schema)
    mixed = spark.createDataFrame([(i, i % 2, i % 2, "en") for i in range(30)] + [(3, 1, 1, "en")], schema)
    for labels in (one_class, nulls, mixed, spark.createDataFrame([], schema)):
        model = fit(docs, labels)
        got = score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in got if r.doc_id == 40} == {r.score for r in got if r.doc_id == 41}
    assert abs(score(docs, fit(docs, nulls)).first().score - 0.5) < 1e-9
    assert score(make_docs([]), fit(make_docs([]), mixed)).count() == 0


def test_keep_good_keeps_columns(spark, make_docs, with_clashes, tables):
    docs, labels = tables
    model = quality.fit_quality(docs, labels)
    clash = with_clashes(docs)
    kept = quality.keep_good(clash, model, 0.3)
    assert kept.columns == clash.columns
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in scores.items() if s >= 0.3}
