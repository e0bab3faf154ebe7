"""Substring deduplication with difference-cover anchors.

A word is removed when a window of 13 consecutive words that covers it also starts in a document with
a smaller id. Two documents that share such a window, whatever its places in them, share an aligned
anchor inside it: anchors are windows of 7 words that start at places 0, 1 or 3 modulo 7 of their
document, and every difference of two places modulo 7 is a difference of two of these. So three
sevenths of the short windows are hashed and compared across documents, and only windows around an
anchor that two documents share are extended to the full 13 words and compared by 128-bit hashes.

Both comparisons go through ``exchange``: a chunk asks about its distinct anchors and learns which occur in
other chunks; then it asks about its distinct full windows with the smallest document that holds each,
and learns which have a smaller one elsewhere. Inside a chunk the same is known without asking.

Hashes of full windows have 96 bits besides the bits that choose the bucket; equal hashes count as equal word sequences.

Defined results: null and empty texts have no words and keep nothing; a document of fewer words
than the window loses none; rows that repeat an id are compared with smaller ids only; a row with a null id
loses nothing and takes nothing from others; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retailspark.llm.arrays import U64, byte_groups, span_hashes, whole_windows, window_hashes, word_spans
from retailspark.llm.exchange import bits_in_order, bucket_cuts, in_chunks, layout

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
ASKED = "bucket int, chunk int, hashes binary, docs binary"
ANSWERED = "kind int, bucket int, chunk int, answer binary"
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
NO_ID = np.iinfo(np.int64).max


class Chunk:
    """Words of a chunk's documents and what is derived from them."""

    def __init__(self, docs: pa.Table):
        docs = docs.combine_chunks()
        self.ids = docs["doc_id"].combine_chunks()
        texts = docs["text"].combine_chunks()
        hashes, firsts, total = [], [np.zeros(1, np.int64)], 0
        for _, _, offsets, data in byte_groups(texts):
            starts, ends, first = word_spans(offsets, data)
            hashes.append(span_hashes(data, starts, ends))
            firsts.append(first[1:] + total)
            total += len(starts)
        self.texts = texts
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.concatenate(firsts)
        counts = np.diff(self.first)
        ids = np.asarray(self.ids.fill_null(NO_ID)).astype(np.int64)
        matched = np.asarray(self.ids.is_valid())
        self.doc = np.repeat(ids, counts)
        self.place = np.arange(total) - np.repeat(self.first[:-1], counts)
        self.full = whole_windows(self.first, WINDOW, total) & np.repeat(matched, counts)[:max(total - WINDOW + 1, 0)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors of full windows, their distinct hashes, and for each place its distinct hash."""
        n = len(self.words) - ANCHOR + 1
        if n <= 0 or not self.full.any():
            none = np.zeros(0, np.int64)
            return none, np.zeros(0, U64), none
        near = np.zeros(n, bool)
        for k in range(PERIOD):
            near[k:k + len(self.full)] |= self.full
        places = np.flatnonzero(near & _ON_COVER[self.place[:n] % PERIOD])
        distinct, which = np.unique(window_hashes(self.words, ANCHOR, 1)[places], return_inverse=True)
        return places, distinct, which

    def candidates(self, elsewhere: np.ndarray) -> np.ndarray:
        """Places of full windows around an anchor that another document holds too."""
        places, distinct, which = self.anchors()
        if not len(places):
            return places
        low = np.full(len(distinct), NO_ID)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, which, self.doc[places])
        np.maximum.at(high, which, self.doc[places])
        shared = np.zeros(len(self.words), bool)
        shared[places] = ((low != high) | elsewhere)[which]
        found = np.zeros(len(self.full), bool)
        for k in range(PERIOD):
            found |= shared[k:k + len(found)]
        return np.flatnonzero(found & self.full)

    def windows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct full windows at ``places``: both hashes, smallest document, and each place's distinct window."""
        a = window_hashes(self.words, WINDOW, 2)[places]
        b = window_hashes(self.words, WINDOW, 3)[places]
        order = np.argsort(a, kind="stable")
        if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
            order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        which = np.empty(len(a), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.doc[places][order], starts) if len(starts) else np.zeros(0, np.int64)
        return a[starts], b[starts], least, which


def _asked(chunk: int, buckets: np.ndarray, cuts: np.ndarray, hashes, docs) -> pa.Table:
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.table({
        "bucket": pa.array(buckets, pa.int32()), "chunk": pa.array([chunk] * len(buckets), pa.int32()),
        "hashes": pa.array([hashes(a, b) for a, b in spans], pa.binary()),
        "docs": pa.array([docs(a, b) for a, b in spans], pa.binary()),
    })


def _chunk_number(docs: pa.Table) -> int:
    return docs["chunk"][0].as_py()


def _answered(kind: int, rows: list[dict], marks: np.ndarray) -> pa.Table:
    sizes = [len(r["docs"]) // 8 if kind == 2 else len(r["hashes"]) // 4 for r in rows]
    cuts = np.cumsum([0, *sizes])
    return pa.table({
        "kind": pa.array([kind] * len(rows), pa.int32()),
        "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "chunk": pa.array([r["chunk"] for r in rows], pa.int32()),
        "answer": pa.array([np.packbits(marks[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
    })


def answer_anchors(asked: pa.Table) -> pa.Table:
    """Which of the anchors of one bucket occur in more than one chunk."""
    rows = asked.to_pylist()
    every = np.concatenate([np.frombuffer(r["hashes"], np.uint32) for r in rows])
    _, which, counts = np.unique(every, return_inverse=True, return_counts=True)
    return _answered(1, rows, counts[which] > 1)


def answer_windows(asked: pa.Table) -> pa.Table:
    """Which of the full windows of one bucket are held by a document smaller than the chunk's smallest."""
    rows = asked.to_pylist()
    pairs = np.concatenate([np.frombuffer(r["hashes"], [("b", "<u8"), ("a", "<u4")]) for r in rows])
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
    order = np.lexsort((docs, pairs["a"], pairs["b"]))
    a, b = pairs["a"][order], pairs["b"][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = docs[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    marks = np.zeros(len(a), bool)
    marks[order] = least < docs[order]
    return _answered(2, rows, marks)


def find_repeats(docs: DataFrame, least_chunk: int | None = None) -> DataFrame:
    """doc_id, n_words, removed (word ranges as start and length) and kept (the kept words joined by spaces)."""
    plan = layout(docs) if least_chunk is None else layout(docs, least_chunk=least_chunk)
    buckets = plan.buckets
    chunks = in_chunks(docs, plan.chunks, "text")

    def ask_anchors(rows: pa.Table) -> pa.Table:
        _, distinct, _ = Chunk(rows).anchors()
        found, cuts = bucket_cuts(distinct, buckets)
        low = distinct.astype(np.uint32)
        return _asked(_chunk_number(rows), found, cuts, lambda a, b: low[a:b].tobytes(), lambda a, b: b"")

    def candidates(chunk: Chunk, answers: pa.Table) -> np.ndarray:
        _, distinct, _ = chunk.anchors()
        return chunk.candidates(bits_in_order(answers, 1, bucket_cuts(distinct, buckets)[1]))

    def ask_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()),
                             "hashes": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})
        chunk = Chunk(rows)
        a, b, least, _ = chunk.windows(candidates(chunk, answers))
        found, cuts = bucket_cuts(a, buckets)
        pairs = np.empty(len(a), [("b", "<u8"), ("a", "<u4")])
        pairs["a"], pairs["b"] = a.astype(np.uint32), b
        return _asked(_chunk_number(rows), found, cuts, lambda x, y: pairs[x:y].tobytes(), lambda x, y: least[x:y].tobytes())

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows) if rows.num_rows else None
        ids, words, removed, kept = [], [], [], []
        if chunk is not None:
            places = candidates(chunk, answers)
            a, _, least, which = chunk.windows(places)
            smaller = bits_in_order(answers, 2, bucket_cuts(a, buckets)[1])
            gone = np.zeros(len(chunk.words) + 1, np.int64)
            if len(places):
                hit = places[smaller[which] | (least[which] < chunk.doc[places])]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            ids = chunk.ids
            for i, text in enumerate(chunk.texts):
                own = gone[chunk.first[i]:chunk.first[i + 1]]
                words.append(len(own))
                raw = (text.as_py() or "").encode().split()
                if own.any():
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    removed.append([{"start": int(x), "length": int(y - x)} for x, y in edges])
                    raw = [w for w, g in zip(raw, own.tolist()) if not g]
                else:
                    removed.append([])
                kept.append(b" ".join(raw))
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()) if chunk is None else ids.cast(pa.int64()),
            "n_words": pa.array(words, pa.int64()), "removed": pa.array(removed, span),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    by_chunk = chunks.groupBy("chunk")
    known = by_chunk.applyInArrow(ask_anchors, ASKED).groupBy("bucket").applyInArrow(answer_anchors, ANSWERED)
    asked = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(ask_windows, ASKED)
    extended = asked.groupBy("bucket").applyInArrow(answer_windows, ANSWERED)
    return by_chunk.cogroup(known.unionByName(extended).groupBy("chunk")).applyInArrow(
        remove, "doc_id long, n_words long, removed array<struct<start: long, length: long>>, kept string"
    )
