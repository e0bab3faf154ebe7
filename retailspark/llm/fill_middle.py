"""Fill-in-the-middle order of texts, cut at units found eight bytes at a time.

1. The UTF-8 bytes of a group of texts are viewed as 64-bit words. A unit ends at a line feed (``line``) or at the last
   byte of a code point (``char``); a few arithmetic steps on a whole word set the top bit of every byte that ends a unit.
2. ``bitwise_count`` gives the units of each word and one running sum those before it. The units before a byte are the
   sum at its word plus the marked bytes below it (``rank``).
3. The end of the k-th unit is found by searching the running sum for its word, then by clearing the lowest marks of that
   word (``select``). All cuts of all texts of a group are found at once.

A text of n units is cut after the smaller and the larger of two hashed numbers of 0 .. n units: prefix, middle, suffix.
The draws depend on ``seed`` and the id alone, so reruns agree. ``restore_fim`` takes a text back from output and form.

Defined results: a null text is empty; an empty text, one that holds a marker, and one that ``rate`` leaves out are
``plain``; a null id draws like an empty one; rows that repeat an id draw alike; a text of one unit may have empty parts.
Other columns stay; one that has the name of a new column is replaced. A text is read whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.llm.arrays import U64, byte_groups, column

SEED, RATE, SPM_RATE = 7, 100, 50
MARKERS = ("<P>", "<S>", "<M>")
TOP, LOW = U64(0x8080808080808080), U64(0x7F7F7F7F7F7F7F7F)
LINE_FEEDS = U64(0x0A0A0A0A0A0A0A0A)
FIELDS = {
    "fim_units": T.LongType(), "fim_form": T.StringType(), "fim_prefix_chars": T.LongType(),
    "fim_middle_chars": T.LongType(), "fim_output": T.StringType(),
}


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian words, with at least one byte that ends nothing after them."""
    padded = np.full((len(data) // 8 + 1) * 8, 0x80, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def line_ends(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte that is a line feed."""
    x = words ^ LINE_FEEDS
    return ~(((x & LOW) + LOW) | x | LOW)


def char_starts(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte that begins a code point (not 10xxxxxx)."""
    return ~(words & ~(words << U64(1))) & TOP


def char_ends(words: np.ndarray, size: int) -> np.ndarray:
    """Top bit of every byte before one that begins a code point, and of the last of ``size`` bytes."""
    starts = char_starts(words)
    starts[size // 8] |= U64(0x80 << 8 * (size % 8))
    ends = starts >> U64(8)
    ends[:-1] |= starts[1:] << U64(56)
    return ends


UNITS = {"line": lambda words, size: line_ends(words), "char": char_ends}


class Marks:
    """Marked bytes, counted word by word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each place."""
        word = at >> 3
        below = (U64(1) << ((at & 7) << 3).astype(U64)) - U64(1)
        inside = np.bitwise_count(self.marks[word] & below).astype(np.int64)
        return np.where(word > 0, self.upto[word - 1], 0) + inside

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place after the k-th marked byte, from 1."""
        word = np.searchsorted(self.upto, k, "left")
        skip = k - np.where(word > 0, self.upto[word - 1], 0) - 1
        left = self.marks[word]
        for step in range(7):
            left = np.where(skip > step, left & (left - U64(1)), left)
        lowest = left & (~left + U64(1))
        return (word << 3) + (np.bitwise_count(lowest - U64(1)).astype(np.int64) >> 3) + 1


class Units:
    """Units of the rows of one group of texts."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, unit: str):
        words = as_words(data)
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.marks = Marks(UNITS[unit](words, len(data)))
        self.chars = Marks(char_starts(words))
        self.before = self.marks.rank(self.starts)
        self.marked = self.marks.rank(self.ends) - self.before
        filled = self.ends > self.starts
        # A text that does not end with a unit's last byte has one more unit.
        closed = self.marks.rank(np.maximum(self.ends - 1, self.starts)) - self.before < self.marked
        self.counts = self.marked + (filled & ~closed)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Place after so many units of each row."""
        out = np.where(units > self.marked, self.ends, self.starts)
        found = (units > 0) & (units <= self.marked)
        out[found] = self.marks.select((self.before + units)[found])
        return out

    def chars_between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.chars.rank(end) - self.chars.rank(start)


def draws_of(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id."""
    digests = b"".join([hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids])
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def check_markers(markers: tuple[str, ...]) -> None:
    """A marker must be found where it was put: none may overlap itself or another one."""
    for a in markers:
        if not a or any(a[-n:] == b[:n] for b in markers for n in range(1, len(b) + 1) if (a, n) != (b, len(b))):
            raise ValueError(f"markers {markers} overlap or are empty")
        if any(a != b and a in b for b in markers) or markers.count(a) > 1:
            raise ValueError(f"marker {a} is found in another one")


def fill_middle(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: str = "line", rate: int = RATE,
    spm_rate: int = SPM_RATE, seed: int = SEED, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Add units, form, code points of prefix and middle, and the text in its new order."""
    check_markers(markers)
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {sorted(UNITS)}")
    pre, suf, mid = (m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in byte_groups(column(batch, text_col)):
                rows = batch.slice(first, last - first)
                found = Units(offsets, data, unit)
                h = draws_of(column(rows, id_col).to_pylist(), seed)
                one, two = h[:, 0] % (found.counts + 1), h[:, 1] % (found.counts + 1)
                a, b = found.cut(np.minimum(one, two)), found.cut(np.maximum(one, two))
                changed = (found.ends > found.starts) & (h[:, 2] % 100 < rate)
                middle_first = h[:, 3] % 100 < spm_rate
                raw, out, forms = data.tobytes(), [], []
                places = zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist())
                for i, (start, x, y, end) in enumerate(places):
                    if not changed[i] or any(raw.find(m, start, end) >= 0 for m in (pre, suf, mid)):
                        changed[i] = False
                        forms.append("plain")
                        out.append(raw[start:end])
                    elif middle_first[i]:
                        forms.append("spm")
                        out.append(b"".join((suf, raw[y:end], pre, raw[start:x], mid, raw[x:y])))
                    else:
                        forms.append("psm")
                        out.append(b"".join((pre, raw[start:x], suf, raw[y:end], mid, raw[x:y])))
                plain = ~changed
                added = [
                    pa.array(found.counts), pa.array(forms, pa.string()),
                    pa.array(found.chars_between(offsets[:-1], a), mask=plain),
                    pa.array(found.chars_between(a, b), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *FIELDS])

    df = df.drop(*FIELDS)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in FIELDS.items())]))


def restore_fim(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text: between the markers lie, in this order, nothing and the three parts."""
    parts = F.split(output, "|".join(map(re.escape, markers)), -1)
    first, second, middle = (F.element_at(parts, n) for n in (2, 3, 4))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )
