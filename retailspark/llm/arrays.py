"""Texts as numpy arrays inside tasks: byte buffers, words and 64-bit word hashes."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
U64 = np.uint64
#: ASCII white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns free memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return memory that is free to the machine: a worker waits for later stages with what it holds."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def lean(run):
    """A function over batches that gives back memory when it is through."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


#: Seconds between two times that a worker gives back memory after a group: a task may have very many small groups.
PAUSE = 1.0
_given_back = [0.0]


def _after_group() -> None:
    now = time.monotonic()
    if now - _given_back[0] >= PAUSE:
        _given_back[0] = now
        give_back()


def lean_group(run):
    """The same for a function of one group of rows, after a group now and then."""

    def wrapped(rows):
        out = run(rows)
        _after_group()
        return out

    return wrapped


def lean_pair(run):
    """The same for a function of two groups of rows."""

    def wrapped(left, right):
        out = run(left, right)
        _after_group()
        return out

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


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


def byte_groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a text column: first row, end row, row offsets and bytes; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    for start, end in row_groups(np.diff(offsets), most):
        yield start, end, offsets[start:end + 1] - offsets[start], data[offsets[start]:offsets[end]]


def word_spans(
    offsets: np.ndarray, data: np.ndarray, outside: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row (with a last end).

    ``outside`` tells which of the 256 bytes are in no word.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, U64)
    down = np.full(size, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x + U64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running polynomial sum."""
    size = GROUP_BYTES
    while size < len(data) + 1:
        size *= 2
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes, for every place that has so many (over all rows)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    step = U64((0xC2B2AE3D27D4EB4F + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    total = np.zeros(n, U64)
    for k in range(size):
        total = total * step + words[k:k + n]
    return mix(total, seed)


def whole_windows(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask over all window places: the window lies inside one row."""
    n = max(total - size + 1, 0)
    inside = np.ones(n, bool)
    for k in range(1, size):
        # a row that begins k words after a window's start cuts it
        places = first[1:-1] - k
        places = places[(places >= 0) & (places < n)]
        inside[places] = False
    return inside
