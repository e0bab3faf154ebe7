"""Questions from chunks of documents to buckets of hashes, and answers back.

Documents are dealt into chunks by a hash of their id. A chunk asks about its distinct hashes, each at
most once however many of its documents hold it, so the entries of a hash that a third of all documents
share number at most one per chunk. Hashes are dealt into buckets by range; a bucket sees the entries of
all chunks and answers each in the order in which it was asked. Entries and answers are packed
arrays: a row holds all entries of one chunk for one bucket.

A chunk can be recomputed at any time: entries are sorted, so the order of its rows does not matter.

Chunks grow with the square root of the input between two bounds, so that the number of packed
rows stays far below the number of entries; buckets hold the entries of a fixed amount of text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.llm.arrays import U64

LEAST_CHUNK, MOST_CHUNK = 4 << 20, 128 << 20
BUCKET_CHUNKS = 4


class Layout(NamedTuple):
    chunks: int
    buckets: int


def layout(docs: DataFrame, text_col: str = "text", least_chunk: int = LEAST_CHUNK) -> Layout:
    """Numbers of chunks and buckets for the whole text of ``docs``."""
    total = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    chunk = min(max(int(140 * total**0.5), least_chunk), max(MOST_CHUNK, least_chunk))
    return Layout(max(1, -(-total // chunk)), max(1, -(-total // (BUCKET_CHUNKS * chunk))))


def in_chunks(docs: DataFrame, chunks: int, *columns: str) -> DataFrame:
    """chunk, doc_id and the named columns."""
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", *columns)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; it grows with the hash."""
    return ((hashes >> U64(32)) * U64(buckets)) >> U64(32)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur among sorted hashes, and where each begins (with a last end)."""
    of = bucket_of(sorted_hashes, buckets)
    starts = np.flatnonzero(np.diff(of, prepend=U64(1 << 63)))
    return of[starts].astype(np.int64), np.append(starts, len(of))


def answers_in_order(answers: pa.Table, kind: int) -> list[bytes]:
    """Answers of one kind to a chunk, by bucket."""
    rows = sorted((r["bucket"], r["answer"]) for r in answers.to_pylist() if r["kind"] == kind)
    return [answer for _, answer in rows]


def bits_in_order(answers: pa.Table, kind: int, cuts: np.ndarray) -> np.ndarray:
    """One bit for each entry a chunk has asked about."""
    parts = [
        np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool)
        for a, n in zip(answers_in_order(answers, kind), np.diff(cuts).tolist())
    ]
    return np.concatenate(parts) if parts else np.zeros(0, bool)
