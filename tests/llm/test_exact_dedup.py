import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from retailspark.llm import exact_dedup

ROWS = [
    (5, "a b"), (3, "a \t b"), (9, "a\nb"), (4, "a  c"), (7, None), (2, ""), (8, " "), (6, " a b"), (1, "a b "),
    (10, "x " * 50_000), (11, "x " * 50_000), (12, "A b"),
]


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = {}
    for text, ids in groups.items():
        for i in ids:
            out[i] = (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    return out


def answers(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.digest) for r in df.collect()}


def test_groups_equal_brute_force(make_docs, with_clashes):
    docs = make_docs(ROWS).repartition(3)
    assert answers(exact_dedup.exact_groups(docs)) == expected(ROWS)
    assert answers(exact_dedup.exact_groups(with_clashes(docs))) == expected(ROWS)


def test_equal_digests_of_different_texts_stay_apart(make_docs):
    """Even a digest that only knows the length, or nothing, gives the same groups."""
    docs = make_docs(ROWS)
    for digest in (lambda c: F.length(c).cast("string"), lambda c: F.lit("same")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, digest=digest).collect()}
        assert got == {i: v[:3] for i, v in expected(ROWS).items()}


def test_hot_text_and_few_salts(make_docs):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)]
    got = answers(exact_dedup.exact_groups(make_docs(rows).repartition(8), salts=3))
    assert got == expected(rows)


def test_null_and_repeated_ids(make_docs):
    rows = [(None, "a"), (None, "b"), (2, "a"), (2, "a"), (3, "a")]
    got = sorted(exact_dedup.exact_groups(make_docs(rows)).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [
        (None, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 2, 4, False), (None, None, 1, True)]))


def test_keep_first_keeps_all_columns(make_docs, with_clashes):
    docs = with_clashes(make_docs(ROWS))
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in expected(ROWS).items() if v[2]}
    assert exact_dedup.keep_first(make_docs([])).count() == 0


def test_keep_first_keeps_one_row_of_each_text(make_docs, with_clashes):
    rows = [(3, "B"), (5, "A"), (5, "B"), (5, "A"), (3, "B "), (3, "B"), (None, "A"), (None, "C"), (None, "C"), (None, None), (7, "")]
    docs = with_clashes(make_docs(rows)).repartition(3)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, (r.text or "")) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, "B"), (5, "A"), (None, "C"), (7, ""), (3, "B ")], key=str)
    assert exact_dedup.keep_first(make_docs([(3, "B"), (5, "A"), (5, "B")])).count() == 2
