"""Packing token pieces into sequences of fixed size by swap-based local search.

1. ``token_pieces`` turns texts into ids of a vocabulary file, adds the end id and cuts what is longer than a sequence.
   The library sees every different word of a group of texts once, many in one call; a worker remembers short ones.
2. Pieces that fill a sequence are one. The others are dealt by a hash of their number into blocks of ``BLOCK`` pieces, so
   equal documents spread over all blocks. A block starts from best fit in falling order of size.
3. Local search then works on the bins with room. The emptiest one gives its pieces away: a piece moves where it fits best,
   else one piece, or two, are exchanged for a single smaller one of another bin so that this one gains most. Every step makes
   the sum of squared fills larger, so the search ends; the bin is gone when nothing is left in it. It stops when the bins
   are as few as the sum of sizes allows, or after ``PATIENCE`` bins in a row that could not be emptied.
4. The ``OPEN_BINS`` emptiest bins of a block go on to the next level, where the open bins of ``FAN_IN`` blocks are one block and
   only the local search runs; the last level is one block. All other bins are final. Blocks only bound a task's work: every piece
   is placed, and a block hands on so little that levels shrink by ``BLOCK``/``OPEN_BINS`` and more.

Only sizes and numbers are packed; each level is staged. Sequence numbers name level, block and bin.

Defined results: a null text is empty and has the end id alone; rows that repeat an id are packed as rows of their own;
an empty table gives an empty one; sizes must be 0 to ``capacity`` (else an error), and a null size counts as 0; other
columns stay, but those named like a new column are replaced; the order inside a sequence is that of the piece numbers.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.llm.arrays import U64, byte_groups, column, row_groups, span_hashes, word_spans
from retailspark.llm.bpe import byte_letters
from retailspark.plans.staging import staged

CAPACITY, END_ID = 2048, 0
BLOCK, OPEN_BINS, FAN_IN, PATIENCE = 1 << 16, 64, 64, 32
#: Words a worker remembers, about 150 bytes each, and how long they may be in all.
CACHED_WORDS, CACHED_BYTES = 1 << 19, 32 << 20
WORDS_AT_ONCE, PIECES_AT_ONCE = 4096, 8 << 20
#: A line that is a word of lower-case letters below U+0300 and the stops after it, or anything else.
LOWER = "".join(c for c in map(chr, range(0x300)) if c.isalpha() and c == c.lower())
LETTERS_AND_STOPS = re.compile(rf"(?:([{LOWER}]+)([.,;:!?]*)|[^\n]*)\n")
PIECE_FIELDS = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids": T.BinaryType()}


class WordNumbers(dict):
    """Number of each word, in the order in which words are first asked for; ``new`` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of texts by the library, for a vocabulary of words with end marks, whose tokens never cross white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        (self.separator,) = self.library.encode("|", add_special_tokens=False).ids
        self.letters = {b: c for c, b in byte_letters().items()}
        self.forget()

    def forget(self) -> None:
        """Start anew: no words, and no ids of words (one after the other, with where each word's begin)."""
        self.numbers, self.held_bytes = WordNumbers(), 0
        self.ids, self.starts = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def packed(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def joined(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words without the separator, many by one call with separators between them."""
        found: dict[str, bytes] = {}
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at:at + WORDS_AT_ONCE]
            (coded,) = self.library.encode_batch_fast([" | ".join(some)], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            if len(starts) == len(some):
                raw = ids.tobytes()
                found.update(zip(some, [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]))
            else:
                found.update((w, self.packed(w)) for w in some)
        return found

    def letter_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters below U+0300 only: such a word is one unit of the vocabulary's pattern,
        so the library's model takes it as it is, each byte as its letter in the vocabulary."""
        merged, table = self.model.tokenize, self.letters
        return {
            w: array("I", [t.id for t in merged(w if w.isascii() else "".join([table[b] for b in w.encode()]))]).tobytes() for w in words
        }

    def other_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of any words. One that has the separator in it goes to the library by itself."""
        found = {w: self.packed(w) for w in words if "|" in w}
        return found | self.joined([w for w in words if w not in found])

    def learn(self, new: list[bytes]) -> None:
        """Append the ids of words. Of a word of letters, upper case and the stops after it are taken off first:
        below U+0300 nothing composes, and the vocabulary's pattern never joins a letter and a stop."""
        parts = LETTERS_AND_STOPS.findall(b"\n".join(new).lower().decode() + "\n")
        odd = {word: word.decode() for word, (core, _) in zip(new, parts) if not core}
        letters = self.letter_words({core for core, _ in parts} - {""})
        others = self.other_words({stops for _, stops in parts if stops} | set(odd.values())) | {"": b""}
        found = [letters[core] + others[stops] if core else others[odd[word]] for word, (core, stops) in zip(new, parts)]
        ids = np.frombuffer(b"".join(found), "<u4")
        first, at = len(self.numbers) - len(new), self.starts[len(self.numbers) - len(new)]
        self.starts = with_room(self.starts, len(self.numbers) + 1)
        self.starts[first + 1:first + 1 + len(new)] = at + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self.ids = with_room(self.ids, at + len(ids))
        self.ids[at:at + len(ids)] = ids
        self.held_bytes += sum(map(len, new))

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
        """Packed ids of every text, given as UTF-8 with the offset of each."""
        if len(self.numbers) > CACHED_WORDS or self.held_bytes > CACHED_BYTES:
            self.forget()
        starts, ends, first = word_spans(offsets, data)
        kinds, kind = different_words(data, starts, ends)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[kinds].tolist(), ends[kinds].tolist())]
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new:
            self.learn(self.numbers.new)
            self.numbers.new = []
        begins = self.starts[numbers]
        lengths = (self.starts[numbers + 1] - begins)[kind]
        before = np.concatenate([[0], np.cumsum(lengths)])
        out = self.ids[np.repeat(begins[kind] - before[:-1], lengths) + np.arange(before[-1])].tobytes()
        cuts = (before[first] * 4).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def with_room(values: np.ndarray, size: int) -> np.ndarray:
    """The same numbers in an array of at least ``size`` places."""
    if len(values) >= size:
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[:len(values)] = values
    return out


def different_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different word, and for every word which of these it equals.

    Words are sorted by a 64-bit hash. Length, first and last eight bytes are compared besides, so words of up to 16 bytes are told
    apart for certain, and longer ones that agree in all this but for a chance of 2^-64 per pair.
    """
    _, kinds, kind = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if not len(starts):
        return kinds, kind
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    eight = np.ascontiguousarray(eight[starts]).view("<u8").ravel(), np.ascontiguousarray(eight[np.maximum(ends - 8, 0)]).view("<u8").ravel()
    lengths = ends - starts
    short = U64(0xFFFFFFFFFFFFFFFF) >> (np.maximum(8 - lengths, 0) * 8).astype(U64)
    head, tail = eight[0] & short, np.where(lengths >= 8, eight[1], U64(0))
    own = kinds[kind]
    odd = (lengths != lengths[own]) | (head != head[own]) | (tail != tail[own])
    if odd.any():  # a hash that two words share: these words stand for themselves
        extra = np.flatnonzero(odd)
        kind[extra] = len(kinds) + np.arange(len(extra))
        kinds = np.concatenate([kinds, extra])
    return kinds, kind


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(
    df: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """A row per piece: the columns of ``df`` without the text, piece, start, length and the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last = word_ids(path), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            for first, end, offsets, data in byte_groups(column(batch, text_col)):
                coded = model.encode(offsets, data)
                rows = batch.slice(first, end - first)
                others = [rows.column(i) for i, n in enumerate(rows.schema.names) if n in kept]
                for some in row_groups(np.array([len(c) for c in coded]), PIECES_AT_ONCE):
                    yield from cut(others, coded, *some, last)

    def cut(others, coded, first, end, last):
        of, pieces, starts, ids = [], [], [], []
        for row in range(first, end):
            whole = coded[row] + last
            for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                of.append(row)
                pieces.append(piece)
                starts.append(at // 4)
                ids.append(whole[at:at + 4 * capacity])
        take = pa.array(of, pa.int64())
        added = [
            pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
            pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in others), *added], [*kept, *PIECE_FIELDS])

    fields = [f for f in df.schema.fields if f.name != text_col and f.name not in PIECE_FIELDS]
    kept = [f.name for f in fields]
    return df.select(*[F.col(f"`{n}`") for n in kept], text_col).mapInArrow(
        run, T.StructType([*fields, *(T.StructField(n, t) for n, t in PIECE_FIELDS.items())])
    )


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: in falling order of size, the fullest bin with room for it, else a new one."""
    bins = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # bit r of rooms: some bin has exactly r left
    order = np.argsort(-sizes, kind="stable")
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[at] = b
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


class Search:
    """Local search on the bins with room; ``bins`` holds the bin of each piece."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.bins = bins
        fill = np.bincount(bins, sizes).astype(np.int64)
        self.least = -(-int(sizes.sum()) // capacity)
        self.count = int((np.bincount(bins) > 0).sum())
        roomy = (fill < capacity)[bins]
        self.slots = np.flatnonzero(roomy & (sizes > 0))
        self.size, self.of = sizes[self.slots].astype(np.int64), bins[self.slots]
        self.fill, self.room = fill, capacity - fill
        self.steps = 0

    def shift(self, slots: list[int], to: int) -> None:
        """Hand pieces to another bin."""
        for s in slots:
            n = self.size[s]
            for b, change in ((self.of[s], -n), (to, n)):
                self.fill[b] += change
                self.room[b] -= change
            self.of[s] = to

    def exchange(self, given: np.ndarray, sums: np.ndarray, other: np.ndarray) -> tuple[int, int] | None:
        """The given sum and the foreign piece whose exchange makes the sum of squared fills grow most."""
        y, bins = self.size[other], self.of[other]
        at = np.searchsorted(sums, y + self.room[bins], "right") - 1
        gain = np.where(at >= 0, sums[at] - y, 0)
        gain[gain < 0] = 0
        growth = 2 * gain * (self.fill[bins] - self.fill[given] + gain)
        best = int(np.argmax(growth))
        return (int(at[best]), int(other[best])) if gain[best] > 0 and growth[best] > 0 else None

    def step(self, victim: int, open_bins: np.ndarray) -> bool:
        """One move or exchange out of the emptiest bin; False if there is none."""
        own = np.flatnonzero(self.of == victim)
        own = own[np.argsort(-self.size[own], kind="stable")]
        others = open_bins[open_bins != victim]
        if not len(others):
            return False
        most = int(self.room[others].max())
        fits = own[self.size[own] <= most]
        if len(fits):
            piece = int(fits[0])
            rooms = self.room[others]
            able = np.flatnonzero(rooms >= self.size[piece])
            to = int(others[able[np.argmin(rooms[able])]])
            # A bin that was given up may be emptier still.
            if self.fill[to] + self.size[piece] > self.fill[victim]:
                self.shift([piece], to)
                return True
        foreign = np.flatnonzero((self.of != victim) & (self.room[self.of] > 0))
        if not len(foreign):
            return False
        singles, at = np.unique(self.size[own], return_index=True)
        found = self.exchange(victim, singles, foreign)
        if found:
            give = [int(own[at[found[0]]])]
        else:
            i, j = np.triu_indices(len(own), 1)
            if not len(i):
                return False
            sums, which = np.unique(self.size[own[i]] + self.size[own[j]], return_index=True)
            found = self.exchange(victim, sums, foreign)
            if not found:
                return False
            give = [int(own[i[which[found[0]]]]), int(own[j[which[found[0]]]])]
        # What comes back leaves first, so the other bin never holds more than it may.
        back, to = found[1], int(self.of[found[1]])
        self.shift([back], victim)
        self.shift(give, to)
        return True

    def run(self, patience: int = PATIENCE) -> np.ndarray:
        open_bins = np.unique(self.of)
        given_up, failures = set(), 0
        while self.count > self.least and failures < patience:
            left = [b for b in open_bins.tolist() if b not in given_up and self.fill[b] > 0]
            if not left:
                break
            victim = min(left, key=lambda b: (self.fill[b], b))
            while self.fill[victim] > 0 and self.step(victim, open_bins):
                self.steps += 1
            if self.fill[victim] == 0:
                self.count -= 1
                failures = 0
            else:
                given_up.add(victim)
                failures += 1
            open_bins = open_bins[(self.fill[open_bins] > 0) & (self.room[open_bins] > 0)]
        self.bins[self.slots] = self.of
        return self.bins


def pack_block(sizes: np.ndarray, bins: np.ndarray | None, capacity: int, patience: int = PATIENCE) -> np.ndarray:
    """Bin of each piece of a block, numbered from 0; ``bins`` are those it comes in, if it has any."""
    start = best_fit(sizes, capacity) if bins is None else np.unique(bins, return_inverse=True)[1].astype(np.int64)
    return np.unique(Search(sizes, start, capacity).run(patience), return_inverse=True)[1]


def offsets_in(bins: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Place of each piece in its bin: after the pieces of smaller number."""
    order = np.lexsort((number, bins))
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    counts = np.diff(np.append(first, len(bins)))
    out = np.empty(len(bins), np.int64)
    out[order] = before - np.repeat(before[first], counts)
    return out


def pack(
    pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, block: int = BLOCK, open_bins: int = OPEN_BINS,
    fan_in: int = FAN_IN, patience: int = PATIENCE,
) -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces``."""
    pieces = pieces.drop("sequence_id", "offset")
    # The number is written once, so a lost executor cannot change it.
    rows = staged(
        pieces.select(
            F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"),
            F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "pack-pieces",
    )
    found = rows.agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.when(F.col("size") < capacity, 1)).alias("n")).first()
    if found["n"] is not None and ((found["least"] or 0) < 0 or (found["most"] or 0) > capacity):
        raise ValueError(f"sizes {found['least']} to {found['most']}; they must be 0 to {capacity}")
    full = rows.where(F.col("size") == capacity).select(
        "row", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    blocks, level = max(1, -(-int(found["n"]) // block)), 0
    schema = T.StructType([
        rows.schema["row"], *(T.StructField(n, T.LongType()) for n in ("size", "number", "block", "bin", "offset")),
        T.StructField("open", T.BooleanType()),
    ])
    current = rows.where(F.col("size") < capacity).select(
        "row", "size", "number", F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"), F.lit(0).cast("long").alias("bin")
    )

    def packer(known: bool, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("number")
            sizes, number = table["size"].to_numpy(), table["number"].to_numpy()
            bins = pack_block(sizes, table["bin"].to_numpy() if known else None, capacity, patience)
            fill = np.bincount(bins, sizes).astype(np.int64)
            roomy = np.flatnonzero(fill < capacity)
            emptiest = roomy[np.argsort(fill[roomy], kind="stable")][:0 if last else open_bins]
            columns = [
                table["row"], pa.array(sizes), pa.array(number), table["block"], pa.array(bins.astype(np.int64)),
                pa.array(offsets_in(bins, sizes, number)), pa.array(np.isin(bins, emptiest)),
            ]
            return pa.Table.from_arrays(columns, [f.name for f in schema.fields])

        return run

    done = [full]
    while True:
        last = blocks == 1
        packed = staged(current.groupBy("block").applyInArrow(packer(level > 0, last), schema), f"pack-level-{level}")
        named = F.lit(level << 56) + F.shiftleft("block", 24) + F.col("bin")
        done.append(packed.where(~F.col("open")).select("row", named.alias("sequence_id"), "offset"))
        if last:
            break
        blocks, level = -(-blocks // fan_in), level + 1
        current = packed.where("open").select(
            "row", "size", "number", F.floor(F.col("block") / F.lit(fan_in)).alias("block"),
            (F.col("block") * F.lit(1 << 24) + F.col("bin")).alias("bin"),
        )
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row.*", "sequence_id", "offset")
