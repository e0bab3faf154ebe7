import random

import numpy as np
from pyspark.sql import functions as F

from retailspark.llm import substring_dedup as dedup
from retailspark.llm.arrays import byte_groups, span_hashes, word_spans


def brute(rows, size=dedup.WINDOW):
    first = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - size + 1):
            if doc_id is not None:
                key = tuple(w[i:i + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            if doc_id is not None and first[tuple(w[i:i + size])] < doc_id:
                gone.update(range(i, i + size))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def found(docs, **kw):
    rows = dedup.find_repeats(docs, **kw).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.length for s in r.removed), r.kept) for r in rows), key=str)


def passages(seed, n=60):
    """Documents that share passages of 10 to 40 words at random places; some repeat one inside themselves."""
    draw = random.Random(seed)
    shared = [[f"p{k}w{i}" for i in range(draw.randint(10, 40))] for k in range(8)]
    rows = []
    for doc in range(n):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += [f"d{draw.randint(0, 5000)}" for _ in range(draw.randint(0, 20))]
            p = draw.choice(shared)
            a, b = sorted((draw.randint(0, len(p)), draw.randint(0, len(p))))
            words += p if draw.random() < 0.5 else p[a:b]
        rows.append((doc * 3 + 1, draw.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_random_passages_equal_brute_force(make_docs, with_clashes):
    for seed in range(3):
        rows = passages(seed)
        docs = with_clashes(make_docs(rows)).repartition(5)
        assert found(docs) == brute(rows)
        assert found(docs, least_chunk=400) == brute(rows)  # many chunks and buckets


def test_edges(make_docs):
    long = " ".join(f"w{i % 1000}" for i in range(30_000))
    run = " ".join(f"r{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, " \n "), (4, run), (5, run), (5, run), (6, run + " tail"), (None, run), (None, run),
            (7, " ".join(run.split()[:12])), (8, long), (9, long + " x"), (-3, run), (10, "same " * 40), (11, "same " * 13)]
    assert found(make_docs(rows), least_chunk=1000) == brute(rows)
    assert found(make_docs([])) == []


def test_hot_passage(make_docs):
    run = " ".join(f"r{i}" for i in range(50))
    rows = [(i, f"own{i} {run} end{i}") for i in range(300)] + [(1000 + i, f"lone {i} " * 10) for i in range(100)]
    assert found(make_docs(rows).repartition(6), least_chunk=3000) == brute(rows)


def test_words_and_hashes_of_byte_groups():
    import pyarrow as pa

    texts = ["a bb  ccc", None, "", "bb", "ccc\x0b\x0ca\x1cé\xa0z", " lead"] * 3
    words, hashes = [], []
    for start, end, offsets, data in byte_groups(pa.array(texts), most=12):
        starts, ends, first = word_spans(offsets, data)
        hashes += span_hashes(data, starts, ends).tolist()
        for i in range(end - start):
            words += [data[a:b].tobytes() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
    assert words == [w for t in texts for w in (t or "").encode().split()]
    by_word = {}
    for w, h in zip(words, hashes):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_difference_cover_meets_every_shift():
    on = set(dedup.COVER)
    for i in range(dedup.PERIOD):
        for j in range(dedup.PERIOD):
            assert any((i + k) % dedup.PERIOD in on and (j + k) % dedup.PERIOD in on for k in range(dedup.PERIOD))
    assert dedup.ANCHOR + dedup.PERIOD - 1 == dedup.WINDOW
