import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retailspark.llm import packing, queries
from retailspark.llm.arrays import byte_groups

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """Exact number of bins, by depth-first search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[i]}):
            left = list(rooms)
            left[left.index(r)] -= sizes[i]
            place(i + 1, left)
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_search_is_near_the_exact_optimum():
    draw, over = random.Random(2), 0
    for _ in range(120):
        sizes = np.array([draw.randint(1, draw.choice([6, 12, 20])) for _ in range(draw.randint(1, 11))])
        bins = packing.pack_block(sizes, None, 20)
        assert np.bincount(bins, sizes).max() <= 20 and sorted(set(bins)) == list(range(bins.max() + 1))
        over += bins.max() + 1 - fewest(sizes.tolist(), 20)
    assert over <= 1


def test_search_makes_squared_fill_grow_and_empties_bins():
    sizes = np.random.default_rng(3).integers(600, 1100, 1500)
    start = packing.best_fit(sizes, 2048)
    search = packing.Search(sizes, start.copy(), 2048)
    squares, step = [], search.step

    def watched(*args):
        squares.append(int((search.fill.astype(object) ** 2).sum()))
        return step(*args)

    search.step = watched
    bins = search.run()
    assert search.steps > 10 and squares == sorted(squares)
    assert len(set(bins)) < len(set(start)) and np.bincount(bins, sizes).max() <= 2048
    assert search.count == len(set(bins)) >= search.least


def test_search_from_a_bad_start():
    """One piece per bin: moves and exchanges alone must empty them."""
    sizes = np.random.default_rng(4).integers(1, 400, 600)
    bins = packing.pack_block(sizes, np.arange(600), 2048, patience=600)
    assert np.bincount(bins, sizes).max() <= 2048 and bins.max() + 1 <= -(-sizes.sum() // 2048) + 1


def check_layout(rows, capacity=2048):
    """No gaps, no overlaps, nothing too long."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    rows = queries.QUERIES["op12_packing"](spark, folder).collect()
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.add((r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_layout(rows) <= -(-sum(r.length for r in rows) // 2048) + 1


ODD = [
    "Don't HE'S Σας ΌΣΟΣ. İstanbul H̱. x\x1cy |a| b|c <|endoftext|> foo<|startoftext|>bar.", "日本語 の… «,» word,́ é É.", "", " \t\n",
    "a'S, 's 'T 123,45 ½ Ⅷ x\xa0y\x85z ǅ ß ẞ K Å ﬁ", "1.5, x1. _a_ a_b. --. ...", "ͅa ῼ fi. ñ.; İ. ŉ. ÀÉ!?", "Word word, WORD. wOrd;",
    "x" * 3000 + " y" * 5000, "| || |||", "ªº. ʰ, Ⱥ; ɐ:",
]


def encoded(model, texts):
    return [ids for _, _, offsets, data in byte_groups(pa.array(texts)) for ids in model.encode(offsets, data)]


def test_equal_hashes_are_told_apart(monkeypatch):
    """Words that share a hash stand for themselves."""
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    model, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ["one two three one", "two", "", "three four, four five. internationalisation internationally"]
    for text, ids in zip(texts, encoded(model, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_at_the_limit(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 10)
    model, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for n in range(5):
        text = " ".join(f"word{n} x{i}" for i in range(20))
        assert np.frombuffer(encoded(model, [text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(model.numbers) <= 60


def test_words_equal_the_library():
    model, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("aB' .,|ñÉß́İΣ1\n日𝄞<|endoftext|>") for _ in range(200)) for _ in range(300)]
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoded(model, texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pieces_of_odd_rows(make_docs, with_clashes):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 5000)]
    docs = with_clashes(make_docs(rows)).withColumn("length", F.lit("old")).withColumn("sequence_id", F.lit("old"))
    pieces = packing.token_pieces(docs, PATH)
    assert pieces.columns == [c for c in docs.columns if c not in ("text", "length")] + ["piece", "start", "length", "ids"]
    got = packing.pack(pieces).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in got) == [
        (0, 0, 0, 3), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 2), (3, 0, 0, 2), (4, 0, 0, 2048), (4, 1, 2048, 2048), (4, 2, 4096, 905)]
    assert check_layout(got) == 3 and all(r.shard == "other" for r in got)
    assert packing.pack(packing.token_pieces(make_docs([]), PATH)).count() == 0


@pytest.mark.parametrize("block", [40, 1 << 16])
def test_blocks_and_levels_place_every_piece(spark, block):
    sizes = np.minimum(np.random.default_rng(6).lognormal(4, 1.3, 3000).astype(int), 2047)
    rows = [(i // 2, int(n)) for i, n in enumerate(sizes)] + [(None, None), (7, 2048), (7, 0)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long")
    got = packing.pack(pieces, block=block, fan_in=4, open_bins=3).collect()
    assert sorted((r.doc_id or -1, r.length or 0) for r in got) == sorted((a or -1, b or 0) for a, b in rows)
    least = -(-sum(b or 0 for _, b in rows) // 2048)
    zero = [r.asDict() | {"length": r.length or 0} for r in got]
    assert check_layout([type("R", (), r) for r in zero]) <= least + (1 if block > 40 else 6)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2049)], "doc_id long, length long"))


def test_largest_number_of_equal_documents(spark):
    """A third of all rows equal: they spread over the blocks."""
    pieces = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit(300).cast("long").alias("length"))
    assert check_layout(packing.pack(pieces, block=500).collect()) == 1000
