import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retailspark.llm import term_pipeline as tp

TERM = re.compile(tp.TERM)


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if t in c
            )
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc, -s))
    return sorted(out, key=str)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def ranked(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ñandú", "日本", "It's", "A1", "x-y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 5, 40, 150])))) for i in range(400)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 4, 12])))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_brute_force(spark, make_docs, corpus, k):
    docs, items = corpus
    got = tp.rank_items(make_docs(docs), items_frame(spark, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(got) == brute(docs, items, k)


def test_small_shards_bundles_and_waves(spark, make_docs, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(tp, "SHARD_DOCS", 64)
    monkeypatch.setattr(tp, "BUNDLE", 4)
    assert ranked(tp.rank_items(make_docs(docs), items_frame(spark, items), 5, wave_terms=60)) == brute(docs, items, 5)


def test_floors_leave_out_accumulators_but_no_results(spark, make_docs, monkeypatch):
    """Rare terms fix the floor, so the common term meets few accumulators."""
    docs = [(i, "common " + (f"rare{i % 3} rare{i % 3}" if i < 60 else "other words")) for i in range(3000)]
    items = [(1, "common rare0"), (2, "common")]
    kept = []
    carried = tp.floors_after

    def counted(bundles, wave, k):
        kept.append(sum(len(r["places"] or b"") // 4 for r in bundles.collect()))
        return carried(bundles, wave, k)

    monkeypatch.setattr(tp, "floors_after", counted)
    assert ranked(tp.rank_items(make_docs(docs), items_frame(spark, items), 10)) == brute(docs, items, 10)
    assert kept and max(kept) <= 60


def test_odd_rows(spark, make_docs, with_clashes):
    docs = [
        (1, None), (2, ""), (3, "!!! ..."), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha beta"), (5, "alpha " * 20_000),
        (6, "ALPHA_beta日本"), (7, "gamma"), (8, "delta x"), (9, "epsilon y z"), (10, "K kelvin"),
    ]
    items = [(1, "Alpha alpha ALPHA"), (2, None), (3, "..."), (1, "beta"), (None, "gamma zeta"), (4, "日本 nowhere"), (5, "nowhere"), (6, "alpha beta gamma delta")]
    got = tp.rank_items(with_clashes(make_docs(docs)), items_frame(spark, items).withColumn("doc_id", F.lit("x")).withColumn("term", F.lit(1)))
    assert ranked(got) == brute(docs, items, 50)


def test_empty_tables(spark, make_docs):
    none, some = items_frame(spark, []), items_frame(spark, [(1, "a")])
    for docs, items in (([], some), ([(1, "a")], none), ([], none), ([(1, None)], some), ([(1, "b")], some)):
        assert tp.rank_items(make_docs(docs), items).collect() == []


def test_plan_has_no_pairs(spark, make_docs, corpus):
    docs, items = corpus
    plan = tp.rank_items(make_docs(docs), items_frame(spark, items))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
