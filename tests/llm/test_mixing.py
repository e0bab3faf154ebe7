from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.llm import mixing


def targets(sizes):
    """Share 150 %, stop at twice the size, share the excess again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    given, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = 1.5 * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            given[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if given[s] > 2.0 * sizes[s]:
                rest += given[s] - 2.0 * sizes[s]
                given[s] = 2.0 * sizes[s]
                open_.discard(s)
    return given


def docs_of(sources):
    rows, n = [], 0
    for source, sizes in sources.items():
        for size in sizes:
            rows.append((n, " ".join(["w"] * size) if size is not None else None, source))
            n += 1
    return rows


SOURCES = {
    "b": [5, 10, 30, 1, 1, 2], "a": [100] * 40, "c": [7] * 300, None: [3, 9, 27], "Z": [1], "é": [50, 60, 0, None], "empty": [0, None],
}


def test_targets_and_words_taken(make_docs, with_clashes):
    rows = docs_of(SOURCES)
    got = mixing.taken_words(with_clashes(make_docs(rows)).repartition(3)).collect()
    sizes = {s: sum(x or 0 for x in v) for s, v in SOURCES.items()}
    want = targets(sizes)
    source_of = {r[0]: r[2] for r in rows}
    taken, by_id = Counter(), {}
    assert len(got) == len(rows)
    for r in got:
        source = source_of[r.doc_id]
        by_id[r.doc_id] = r.taken
        assert r.size == len((rows[r.doc_id][1] or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source in SOURCES:
        least = min((x for x in SOURCES[source] if x), default=0)
        assert want[source] - max(least, 2) - 1 <= taken[source] <= want[source] + 1e-6, source
    again = {r.doc_id: r.taken for r in mixing.taken_words(make_docs(rows).repartition(7)).collect()}
    assert again == by_id


def test_hot_source_of_many_blocks(make_docs):
    rows = docs_of({"hot": [i % 37 + 1 for i in range(1500)], **{f"s{i:02d}": [20, 30, 40] for i in range(9)}})
    got = mixing.taken_words(make_docs(rows)).collect()
    sums, target = Counter(), {}
    for r in got:
        source = rows[r.doc_id][2]
        sums[source] += r.taken
        target[source] = r.target
    assert abs(sums["hot"] - target["hot"]) <= 2
    assert all(abs(sums[s] - target[s]) <= 20 for s in target)


def test_mix_repeats_rows_and_keeps_columns(make_docs, with_clashes):
    rows = docs_of(SOURCES)
    docs = with_clashes(make_docs(rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.taken_words(docs).collect():
        if r.size:
            assert counts[r.doc_id] * r.size == r.taken
    assert mixing.mix(make_docs([])).count() == 0 and mixing.taken_words(make_docs([])).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(make_docs, with_clashes):
    """One row per input row, none above twice its size; the mix takes each as often as the query says."""
    rows = [(None, "a b", "s"), (None, "a b", "s"), (None, None, "s"), (7, "one two three", "s"), (7, "x", "t"), (7, "x", "t"), (8, "y z", "t")]
    rows += [(None, "w " * n, "hot") for n in range(1, 120)]
    docs = with_clashes(make_docs(rows))
    got = mixing.taken_words(docs).collect()
    assert sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size and len(r.shards) * r.size == r.taken for r in got if r.size)
    want = Counter()
    for r in got:
        want[r.doc_id, r.size] += len(r.shards)
    mixed = Counter((r.doc_id, len((r.text or "").split())) for r in mixing.mix(docs).collect())
    assert {k: n for k, n in mixed.items() if k[1]} == {k: n for k, n in want.items() if k[1] and n}
    again = mixing.taken_words(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_shards_of_the_query_are_those_of_the_tree(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    rows = docs_of({f"s{i}": [10] * 90 for i in range(4)})
    got = mixing.taken_words(make_docs(rows), shard_words=800).collect()
    dealt = Counter(s for r in got for s in r.shards)
    drawn = mixing.draws(mixing.sized_documents(make_docs(rows)), shard_words=800).where("copy > 0").groupBy("shard").count().collect()
    assert dealt == {r["shard"]: r["count"] for r in drawn} and len(dealt) >= 5


def test_too_many_sources_are_an_error(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError):
        mixing.taken_words(make_docs(docs_of({f"s{i}": [1] for i in range(4)})))


def test_shards_are_even_and_blocks_disjoint(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    rows = docs_of({f"s{i}": [10] * 90 for i in range(4)})
    found = mixing.draws(mixing.sized_documents(make_docs(rows)), shard_words=800).where("copy > 0").collect()
    shards = Counter(r.shard for r in found)
    assert None not in shards and len(shards) >= 5
    assert len({(r.doc_id, r.copy) for r in found}) == len(found)
    assert max(shards.values()) < 2.5 * min(shards.values())


@pytest.mark.parametrize("words", [[], [800]])
def test_mix_returns_shards_in_hash_order(spark, make_docs, with_clashes, tmp_path, monkeypatch, words):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    docs = with_clashes(make_docs(docs_of({f"s{i}": [10] * 90 for i in range(4)}))).repartition(3)
    want = defaultdict(list)
    for r in mixing.draws(mixing.sized_documents(docs), mixing.SEED, *words).where("copy > 0").collect():
        want[r.shard].append((r.place, r.doc_id))
    assert len(want) == 1 if not words else len(want) >= 5
    mixing.mix(docs, mixing.SEED, *words).write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", F.input_file_name().alias("file")).collect()
    got = defaultdict(list)
    for r in read:
        got[r.file].append(r.doc_id)
    assert sorted(got.values()) == sorted([i for _, i in sorted(rows)] for rows in want.values())
    if words:
        assert any(max(Counter(ids).values()) > 1 for ids in [sum(got.values(), [])])


def test_splitting_tree_gives_every_block_to_one_shard():
    counts = [50, 3, 0, 200, 1]
    for shards in (1, 2, 3, 8, 13):
        dealt = [mixing.shard_counts(counts, shards, s) for s in range(shards)]
        assert [sum(d[1][k] for d in dealt) for k in range(5)] == counts
        running = [0] * 5
        for before, own in dealt:
            assert before == running
            running = [a + b for a, b in zip(running, own)]
        totals = [sum(own) for _, own in dealt]
        assert max(totals) - min(totals) <= max(2, np.ceil(np.log2(shards) + 1))


def test_splits_follow_the_hypergeometric_mean():
    seen = defaultdict(list)
    for seed in range(300):
        for k, x in enumerate(mixing.split_counts([30, 60, 10], 40, (seed, 0, 2))):
            seen[k].append(x)
    for k, n in enumerate((30, 60, 10)):
        assert abs(np.mean(seen[k]) - 0.4 * n) < 0.6
    big = mixing.hypergeometric(np.random.default_rng(1), 10**10, 10**10, 10**9)
    assert abs(big - 5 * 10**8) < 10**6


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\x0bb\x0c", "é x y", "a\x1cb c\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(mixing.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]
