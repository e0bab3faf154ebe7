import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retailspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.transducer(PATH)


def same(model, library, text):
    ids = np.frombuffer(model.encode(text), np.int32)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, text[:80]
    assert model.decode(ids) == library.decode(want, skip_special_tokens=False) == text


FIXED = [
    "", " ", "a" * 5000, "ab" * 3000, " " * 1000 + "x", "=-" * 2000, "\n\n\n  x", "x <|endoftext|> y<|endoftext|>", "<|endoftext",
    "don't I'll 'sss  \t\n x", "՘a" + chr(0x33479) + "Ᲊ", "é" * 3000, "-" * 3001 + "!" * 777, "a  b　c \r\n", "0123456789" * 300,
]


@pytest.mark.parametrize("text", FIXED, ids=range(len(FIXED)))
def test_fixed_texts(model, library, text):
    same(model, library, text)


def test_random_texts(model, library):
    draw = random.Random(3)
    for _ in range(400):
        letters = draw.choice(["ab", "abc the", "éèa n", " \n\t x", "aeiou nrstlthe", "<|endoftext|> a", "0123,.", "日本語 の"])
        same(model, library, "".join(draw.choice(letters) for _ in range(draw.choice([5, 50, 400, 1500]))))


def test_long_text_is_cut_into_pieces(model, library):
    draw = random.Random(4)
    same(model, library, "".join(draw.choice("abcde \n") for _ in range(200_000)))


def test_stream_emits_before_the_end_with_a_small_window(model):
    word = "".join(random.Random(5).choice("abcdeno") for _ in range(20_000)).encode()
    runs = [[model.bytes_of(t) for t in run] for run in model.stream(word)]
    assert b"".join(t for r in runs for t in r) == word
    assert len(runs) > 20 and max(sum(map(len, r)) for r in runs) < 8 * model.lookahead


def test_border_rule_equals_plain_merging(model):
    number = {model.bytes_of(n): n for n in range(model.size - 1)}

    def merged(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min(
                (model.ranks.get(number[x] << model.shift | number[y], bpe.NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))
            )
            if rank == bpe.NEVER:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    tokens = sorted(model.usable)
    draw = random.Random(6)
    for _ in range(3000):
        a, b = draw.choice(tokens), draw.choice(tokens)
        for _ in range(2):  # the second time from memory
            assert model.keeps_border(number[a], number[b]) == (merged(a + b) == [a, b])


def test_model_is_small(model):
    """Ranks, edges and borders are integer arrays and one map of numbers."""
    import sys

    held = [model.keeps, model.begins, *(a for side in model.edges for a in side)]
    assert all(type(a).__name__ == "array" for a in held) and sum(map(sys.getsizeof, held)) < 16 << 20


def test_decoder_replaces_broken_bytes(model, library):
    ids = np.frombuffer(model.encode("日本é"), np.int32)
    for cut in range(len(ids) + 1):
        assert model.decode(ids[:cut]) == library.decode(ids[:cut].tolist(), skip_special_tokens=False)


def test_columns(spark, make_docs, with_clashes, library):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world"), (4, "word " * 30_000)]
    docs = with_clashes(make_docs(rows)).withColumn("ids", F.lit("old"))
    back = bpe.decode_bpe(bpe.encode_bpe(docs, PATH), PATH)
    assert set(back.columns) == {*docs.columns, "decoded"}
    got = back.select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    at_once = bpe.encode_bpe(docs, PATH, decoded="decoded").select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    assert bpe.encode_bpe(make_docs([]), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.decoded for r in bpe.decode_bpe(nothing, PATH).collect()} == {""}


def test_decoder_looks_bytes_up_at_once(monkeypatch):
    """Ids in range need no call per id; any other id is still skipped."""
    model = bpe.transducer(PATH)
    ids = np.frombuffer(model.encode("naïve words, décodés"), np.int32)
    assert model.decode(np.concatenate([ids, [-1, model.size]])) == "naïve words, décodés"
    monkeypatch.setattr(model, "bytes_of", None)
    assert model.decode(ids) == "naïve words, décodés" and model.decode(ids[:0]) == ""


def test_ascii_pieces_are_not_searched_for_new_letters(model, library, monkeypatch):
    """Every character of every piece was once compared to find the highest."""
    class Counted:
        calls = 0

        def search(self, piece):
            Counted.calls += 1
            return found.search(piece)

    found = model.unassigned
    if found is None:
        pytest.skip("no letter is newer than Unicode 15")
    monkeypatch.setattr(model, "unassigned", Counted())
    assert not model.has_unassigned("plain 'words' don't") and not model.has_unassigned("") and not model.has_unassigned("é ñ")
    assert Counted.calls == 0
    assert model.has_unassigned("x " + model.unassigned_from + " é") and Counted.calls == 1
    for text in ("don't'll 'S 'sé ñ'd", " 're''ve 9'm½ x", "a " + model.unassigned_from + "'s 1"):
        same(model, library, text)


def test_words_go_on_from_the_prefix_they_share(library, monkeypatch):
    """Every new word was once worked out from its first byte."""
    class Counted(dict):
        calls = 0

        def get(self, key, other=None):
            Counted.calls += 1
            return super().get(key, other)

    model = bpe.Transducer(PATH)
    model.usable = Counted(model.usable)
    words = [f" overhenstlicheran{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    same(model, library, "".join(words))
    assert Counted.calls < 10 * len(words)


@pytest.mark.parametrize("cached, waiting", [(3, 1), (3, 1 << 19), (1 << 19, 7)])
def test_texts_at_once(library, monkeypatch, cached, waiting):
    """Few remembered words and many steps change no ids; words longer than the window are not remembered."""
    monkeypatch.setattr(bpe, "WAITING_WORDS", waiting)
    model = bpe.Transducer(PATH)
    model.cached_words = cached
    texts = ["", "a b a b\x00 a\x00\x00 é éé", "x <|endoftext|> y<|endoftext|>z", "q" * 400 + " q", " ".join(map(str, range(60))), *FIXED[4:9]]
    for _ in range(2):
        got = [np.frombuffer(ids, np.int32).tolist() for ids in model.encode_all(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(model.cache) <= cached and max(map(len, model.cache)) < model.lookahead
