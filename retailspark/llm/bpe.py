"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding. For every prefix of a word there is exactly one token that ends the encoding of the
prefix: the token ``t`` whose neighbour to the left, the last token of the shorter prefix, keeps
its border with ``t`` when the two are merged on their own. The transducer reads bytes, keeps
that token for the prefixes of its open window, and emits tokens as soon as no later byte can
change them. A later token reaches back at most ``lookahead`` bytes (the longest token of the
merge list that merging its own bytes yields), so every continuation passes through one of the
last ``lookahead`` prefixes. Where their chains of last tokens join, everything before is stable and leaves
the window. A word of any length is encoded in one pass; the window is as long as the chains
take to join.

Words come from the pattern of the vocabulary file. A text is cut before white space that
follows other characters, where no word can continue, so words are found piece by piece.
Encodings of short words are kept in a cache of fixed size; new words are taken in order, so that
each goes on from the prefix it shares with the word before.

Decoding. Ids become bytes; bytes go through an incremental UTF-8 state machine that holds an
unfinished character between steps and replaces what can never become one.

Defined results: a null text is an empty one and has no ids; the empty text decodes to itself;
ids are those of the vocabulary file, and the string of a special token in a text becomes its
id; ids that are not in the vocabulary are skipped when decoding; other columns stay as they are, but
one that has the name of the new column is replaced.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retailspark.llm.arrays import give_back, lean

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?(?:{L}+|{N}+|[^\s{both}]+)|\s+(?!\S)|\s+"
PIECE_CHARS = 1 << 16
#: Words whose ids a worker remembers, and borders, the latter a power of two.
CACHED_WORDS, BORDERS = 1 << 19, 1 << 19
#: Words that wait until the new ones among them are learned, and bytes by whose end a token is looked for.
WAITING_WORDS, TAIL = 1 << 19, 4
#: No rank is as large.
NEVER = (1 << 31) - 1
DECODE_STEP = 1 << 14
GROUP_BYTES = 4 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b not in (0xAD,)]
    letters, shifted = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            letters[chr(shifted)] = b
            shifted += 1
    return letters


class Transducer:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_bytes = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(as_bytes[c] for c in token)

        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        vocab = {raw(t): n for t, n in spec["model"]["vocab"].items() if t not in self.special}
        # Bytes of every id, one after the other, and where each begins.
        by_id = {n: t for t, n in vocab.items()} | {n: t.encode() for t, n in self.special.items()}
        self.size = max(by_id, default=-1) + 1
        self.raw = b"".join(by_id.get(n, b"") for n in range(self.size))
        self.begins = array("i", np.cumsum([0, *(len(by_id.get(n, b"")) for n in range(self.size))]).tolist())
        # The same as a list, for ids that are known to be in range.
        self.tokens = [by_id.get(n, b"") for n in range(self.size)]
        # A merge by the ids of its halves: rank; and of every id the merge that makes it first.
        self.shift = max(self.size - 1, 1).bit_length()
        self.ranks: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (x, y) in enumerate(pairs):
            self.ranks[vocab[x] << self.shift | vocab[y]] = rank
            made.setdefault(vocab[x + y], (vocab[x], vocab[y], rank))
        self.edges = [self._edges(made, side) for side in (0, 1)]
        # A token that its own bytes do not merge into never occurs in an encoding.
        self.usable = {
            t: n for t, n in vocab.items() if len(t) == 1 or n in made and self.first_crossing(*made[n][:2]) == made[n][:2]
        }
        self.lookahead = max(map(len, self.usable))
        # Length of the longest of them that ends in some ``TAIL`` bytes: no longer one need be looked for.
        self.longest: dict[bytes, int] = {}
        for t in self.usable:
            if len(t) >= TAIL:
                self.longest[t[-TAIL:]] = max(self.longest.get(t[-TAIL:], 0), len(t))
        # What is known about borders: the pair of ids and one bit, in the place that the pair hashes to.
        self.keeps = array("q", [-1]) * BORDERS
        self.cache: dict[str, bytes] = {}
        self.cached_words = CACHED_WORDS
        self.special_split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special else None
        )
        self.words, self.words_known, self.unassigned, self.unassigned_from = self._patterns()

    @staticmethod
    def _patterns():
        """The word pattern; one that treats code points missing in Unicode 15 as neither letter nor digit; those code points."""
        everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        new = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn"]
        plain = regex.compile(WORDS.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{both}", r"\p{L}\p{N}"))
        if not new:
            return plain, plain, None, None
        codes = np.array([ord(c) for c in new])
        starts = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
        ends = np.append(starts[1:], len(codes)) - 1
        out = "[" + "".join(f"{chr(codes[a])}-{chr(codes[b])}" for a, b in zip(starts, ends)) + "]"
        known = WORDS.replace("[^\\s{both}]", rf"[[^\s\p{{L}}\p{{N}}]||{out}]")
        known = known.replace("{L}", rf"[\p{{L}}--{out}]").replace("{N}", rf"[\p{{N}}--{out}]")
        return plain, regex.compile(known, regex.V1), regex.compile(out), min(new)

    def _edges(self, made: dict[int, tuple[int, int, int]], side: int) -> tuple[array, array, array]:
        """Parts of each id that touch its left (0) or right (1) border while it is built, the last part first built,
        each with the rank that absorbs it: where an id's parts begin, the parts, the ranks."""
        begins, parts, absorbed = array("i", [0]), array("i"), array("i")
        for token in range(self.size):
            chain, rank = [], NEVER
            while True:
                chain.append((token, rank))
                if token not in made:
                    break
                rank, token = made[token][2], made[token][side]
            for part, ends in reversed(chain):
                parts.append(part)
                absorbed.append(ends)
            begins.append(len(parts))
        return begins, parts, absorbed

    def bytes_of(self, token: int) -> bytes:
        """Bytes of an id; none for one that the vocabulary does not have."""
        return self.raw[self.begins[token]:self.begins[token + 1]] if 0 <= token < self.size else b""

    def first_crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The pair that merges across the border while both tokens are built, if any does."""
        (a_begins, a_parts, a_ends), (b_begins, b_parts, b_ends) = self.edges[1], self.edges[0]
        i, j, ranks, shift = a_begins[left], b_begins[right], self.ranks, self.shift
        while True:
            x_ends, y_ends = a_ends[i], b_ends[j]
            rank = ranks.get(a_parts[i] << shift | b_parts[j], NEVER)
            # Of equal ranks the leftmost pair merges first.
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return a_parts[i], b_parts[j]
            if x_ends == y_ends == NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def keeps_border(self, left: int, right: int) -> bool:
        key = left << self.shift | right
        place = (key ^ key >> 15) & (BORDERS - 1)
        known = self.keeps[place]
        if known >> 1 == key:
            return known & 1 == 1
        found = self.first_crossing(left, right) is None
        self.keeps[place] = key << 1 | found
        return found

    def stream(self, word: bytes) -> Iterator[list[int]]:
        """Ids of a word, in runs that are final when they are emitted."""
        number, reach = self.usable.get, self.lookahead
        left: int | None = None  # last id emitted
        base, last, check = 0, [], 2 * reach  # last[i]: last id of the prefix that ends i + 1 bytes after base
        for end in range(1, len(word) + 1):
            for begin in range(max(base, end - reach), end):
                token = number(word[begin:end])
                if token is not None:
                    before = left if begin == base else last[begin - base - 1]
                    if before is None or self.keeps_border(before, token):
                        last.append(token)
                        break
            if len(last) >= check:
                stable = self._joined(last, reach)
                if stable:
                    run = self._chain(last, stable)
                    yield run
                    left, base, last = run[-1], base + stable, last[stable:]
                check = len(last) + reach
        if last:
            yield self._chain(last, len(last))

    def length(self, token: int) -> int:
        return self.begins[token + 1] - self.begins[token]

    def _chain(self, last: list[int], end: int) -> list[int]:
        """Ids of the prefix that ends at ``end``."""
        tokens = []
        while end > 0:
            tokens.append(last[end - 1])
            end -= self.length(tokens[-1])
        return tokens[::-1]

    def _joined(self, last: list[int], reach: int) -> int:
        """The latest place through which the chains of the last ``reach`` prefixes all pass."""
        places = set(range(len(last) - reach + 1, len(last) + 1))
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - self.length(last[top - 1]))
        return places.pop()

    def learn(self, words: Iterable[str]) -> None:
        """Remember the ids of words that fit the window: the same recurrence as ``stream``, nothing to emit before their end.

        Words are taken in order, so that each goes on from the prefix it shares with the one before.
        """
        number, keeps, shift, mask = self.usable.get, self.keeps, self.shift, BORDERS - 1
        cache, reach, tail = self.cache, self.longest.get, TAIL
        before, last, packed = b"", [-1], [b""]  # of each prefix: id of the last token, and all its ids
        for word in sorted(words):
            raw = word.encode()
            size = len(raw)
            if size >= self.lookahead:
                continue
            shared = min(len(before), size)
            while before[:shared] != raw[:shared]:
                shared -= 1
            before = raw
            del last[shared + 1:], packed[shared + 1:]
            for end in range(shared + 1, size + 1):
                for begin in range(max(0, end - reach(raw[end - tail:end], tail - 1)) if end >= tail else 0, end):
                    token = number(raw[begin:end])
                    if token is not None:
                        if begin:
                            key = last[begin] << shift | token
                            known = keeps[(key ^ key >> 15) & mask]
                            if not (known & 1 if known >> 1 == key else self.keeps_border(last[begin], token)):
                                continue
                        last.append(token)
                        packed.append(packed[begin] + token.to_bytes(4, "little"))
                        break
            cache[word] = packed[size]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word as packed 32-bit numbers, remembered if the word is short."""
        raw = word.encode()
        if len(raw) >= self.lookahead:
            return array("i", [t for run in self.stream(raw) for t in run]).tobytes()
        if len(self.cache) >= self.cached_words:
            self.cache.clear()
        self.learn([word])
        return self.cache[word]

    def pieces(self, text: str) -> Iterator[str]:
        """Cut before white space that follows something else: no word crosses such a place."""
        start, n = 0, len(text)
        while n - start > PIECE_CHARS:
            place = SAFE_PLACE.search(text, start + PIECE_CHARS - 1)
            cut = place.start() + 1 if place else n
            yield text[start:cut]
            start = cut
        yield text[start:]

    def has_unassigned(self, piece: str) -> bool:
        """Whether a code point that is missing in Unicode 15 occurs; most pieces are told by their highest one."""
        if self.unassigned is None or piece.isascii():
            return False
        highest = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).max()
        return bool(highest >= ord(self.unassigned_from) and self.unassigned.search(piece))

    def runs(self, text: str) -> Iterator[bytes | list[str]]:
        """A text as lists of words, and packed ids of special tokens between them."""
        for part in self.special_split.split(text) if self.special_split else (text,):
            if part in self.special:
                yield np.int32(self.special[part]).tobytes()
                continue
            for piece in self.pieces(part):
                yield (self.words_known if self.has_unassigned(piece) else self.words).findall(piece)

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit numbers; words wait for others, so that many new ones are learned at once."""
        out: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], bytes | list[str]]] = []
        held = 0
        for text in texts:
            out.append([])
            for run in self.runs(text):
                waiting.append((out[-1], run))
                held += len(run)
                if held >= WAITING_WORDS:
                    self._settle(waiting)
                    waiting, held = [], 0
        self._settle(waiting)
        return [b"".join(ids) for ids in out]

    def _settle(self, waiting: list[tuple[list[bytes], bytes | list[str]]]) -> None:
        words = set().union(*(run for _, run in waiting if isinstance(run, list)))
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > self.cached_words:
            self.cache.clear()
            new = set(islice(words, self.cached_words))
        self.learn(new)
        get, word_ids = self.cache.get, self.word_ids
        for ids, run in waiting:
            ids.append(run if isinstance(run, bytes) else b"".join([get(w) or word_ids(w) for w in run]))

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit numbers."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of some ids, by an incremental state machine from bytes to characters."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        bytes_of, text = self.bytes_of, []
        for at in range(0, len(ids), DECODE_STEP):
            some = ids[at:at + DECODE_STEP]
            if some.min() >= 0 and some.max() < self.size:
                step = b"".join(map(self.tokens.__getitem__, some.tolist()))
            else:
                step = b"".join([bytes_of(i) for i in some.tolist()])
            text.append(machine.decode(step))
        text.append(machine.decode(b"", True))
        return "".join(text)


SAFE_PLACE = regex.compile(r"\S(?=\s)")


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    model = Transducer(path)
    give_back()  # the parsed file is several times as large as the tables made from it
    return model


def row_groups(lengths: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to about ``most``; a longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_bpe(
    df: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None,
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """Add the ids of ``text_col`` as an array column; with ``decoded``, also the text read back from these ids.

    Both at once needs one Python worker per task, and so one copy of the vocabulary, instead of two. A worker
    remembers the ids of ``cached_words`` words, about 150 bytes each; fewer cost time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        model.cached_words = cached_words
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            for start, end in row_groups(lengths):
                packed = model.encode_all(t or "" for t in texts.slice(start, end - start).to_pylist())
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                rows, added = batch.slice(start, end - start), [ids]
                if decoded is not None:
                    added.append(pa.array([model.decode(np.frombuffer(p, np.int32)) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *names])

    names = [out] if decoded is None else [out, decoded]
    types = dict(zip(names, (T.ArrayType(T.IntegerType()), T.StringType())))
    df = df.drop(*names)
    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in types.items())]))


def decode_bpe(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the ids in ``ids_col``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            for start, end in row_groups(lengths * 4):
                rows = batch.slice(start, end - start)
                part = rows.column(batch.schema.get_field_index(ids_col))
                at = np.concatenate([[0], np.cumsum(lengths[start:end])])
                flat = np.asarray(pa.compute.fill_null(part.flatten(), -1))
                texts = pa.array([model.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], [*rows.schema.names, out])

    df = df.drop(out)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))
