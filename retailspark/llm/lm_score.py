"""Language-model scores by context-tree weighting, next to a unigram base.

The model is a context tree over the bytes of lower-cased (A-Z) training texts, each ended by a zero byte; see
``context_tree``. Its code length covers every byte of a text and its end. The base adds a token's smoothed
frequency for every word and for one end.

1. Every map task counts the distinct grams of its texts, with 0 for texts it may not learn from, and its
   distinct training words; counts of equal grams and words meet in buckets of their hash. So a gram
   that every text holds arrives once per task.
2. Grams are dealt by their three nearest context bytes, so a subtree of the context tree is complete in
   one place; what is left of a gram, two context bytes and a symbol, bounds a subtree whatever the size of the corpus. Subtrees
   weigh themselves and report their roots, summed by the two nearest bytes: at most 65,536 contexts, of which texts use some
   thousands, and which weigh the top of the tree.
3. Subtrees turn each of their grams into the log chance of its last byte.
4. Texts are dealt into chunks; a chunk asks the buckets for its distinct grams and words and adds up.

No table of contexts or words is ever whole in one place; the top of the tree and the three totals of the base are fixed in size.
A subtree task holds the distinct grams behind some triples of bytes, not their occurrences.

Defined results: a null text is an empty one and consists of its end alone; with no training text every byte costs 8 bits and the base is
that of counts of zero; rows that repeat an id are scored alike; other columns are not read. A zero byte inside a text is read like its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.llm.arrays import LOWER_AZ, U64, byte_groups, mix, span_hashes, word_spans
from retailspark.llm.context_tree import Subtrees, Top, byte_grams
from retailspark.llm.exchange import bucket_of, in_chunks, layout
from retailspark.plans.staging import staged

DEPTH = 5
NEAREST = 3
CHUNK = 8 << 20
GRAM, WORD = 1, 2
PART_ENTRIES = 1 << 20


def in_training(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def text_groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end row, grams, first gram of each row, word keys and first word of each row."""
    for start, end, offsets, data in byte_groups(texts):
        data = LOWER_AZ[data]
        ended = np.insert(data, offsets[1:], 0)
        at = offsets + np.arange(len(offsets))
        starts, ends, first = word_spans(offsets, data)
        yield start, end, byte_grams(ended, at, DEPTH), at, span_hashes(data, starts, ends), first


def gram_key(grams: np.ndarray) -> np.ndarray:
    """Hash that spreads grams over buckets."""
    return mix(grams, 17)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with summed counts."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    every, summed = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0) if len(every) else np.zeros(0, np.int64)
    return every[starts], (np.add.reduceat(summed[order], starts) if len(starts) else np.zeros(0, np.int64))


class Tally:
    """Distinct keys and counts of what a task has read, compacted as it goes."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counted: bool) -> None:
        """Count the keys, or only note them."""
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts if counted else np.zeros(len(keys), np.int64))
        self.waiting += len(keys)
        if self.waiting > PART_ENTRIES:
            self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merge(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts


PACKED = "kind int, bucket int, keys binary, counts binary"


def _by_bucket(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Packed rows of one kind, one for each bucket; keys stay sorted inside a row."""
    spread = gram_key(keys) if kind == GRAM else keys
    of = bucket_of(spread, buckets).astype(np.int64)
    order = np.argsort(of, kind="stable")
    found, starts = np.unique(of[order], return_index=True)
    cuts = np.append(starts, len(of))
    keys, counts = keys[order], counts[order]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(found), pa.int32()), pa.array(found, pa.int32()),
         pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
         pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
        ["kind", "bucket", "keys", "counts"],
    )


class Counts(NamedTuple):
    grams: DataFrame  # bucket, subtree, keys, counts: distinct grams, packed by bucket and subtree
    words: DataFrame  # bucket, keys, counts: distinct training words
    tokens: int
    kinds: int
    ends: int


def count_corpus(docs: DataFrame, learn: Column, buckets: int) -> Counts:
    """Distinct grams of all texts with their counts in training texts, and the training words."""

    def tally(batches):
        grams, words = Tally(), Tally()
        for batch in batches:
            learned = np.asarray(batch.column(1).fill_null(False))
            for start, end, codes, at, keys, first in text_groups(batch.column(0)):
                mine = learned[start:end]
                used = np.repeat(mine, np.diff(at))
                grams.add(codes[used], True)
                grams.add(codes[~used], False)
                words.add(keys[np.repeat(mine, np.diff(first))], True)
        for kind, found in ((GRAM, grams), (WORD, words)):
            keys, counts = found.take()
            if len(keys):
                yield _by_bucket(kind, keys, counts, buckets)

    def total(rows: pa.Table) -> pa.Table:
        kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        keys, counts = merge(
            [np.frombuffer(k, U64) for k in rows["keys"].to_pylist()],
            [np.frombuffer(c, np.int64) for c in rows["counts"].to_pylist()],
        )
        subtree = (
            bucket_of(mix(keys >> U64(8 * (DEPTH + 1 - NEAREST)), 18), buckets).astype(np.int64)
            if kind == GRAM else np.zeros(len(keys), np.int64)
        )
        order = np.argsort(subtree, kind="stable")
        found, starts = np.unique(subtree[order], return_index=True)
        cuts = list(zip(starts, np.append(starts[1:], len(keys))))
        keys, counts = keys[order], counts[order]
        return pa.table({
            "kind": pa.array([kind] * len(found), pa.int32()), "bucket": pa.array([bucket] * len(found), pa.int32()),
            "subtree": pa.array(found, pa.int32()),
            "entries": pa.array([int(b - a) for a, b in cuts], pa.int64()),
            "occurrences": pa.array([int(counts[a:b].sum()) for a, b in cuts], pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
        })

    read = docs.select("text", learn.alias("learn"))
    totals = staged(
        read.mapInArrow(tally, PACKED).groupBy("kind", "bucket").applyInArrow(
            total, "kind int, bucket int, subtree int, entries long, occurrences long, keys binary, counts binary"
        ),
        "lm-counts",
    )
    words = totals.where(F.col("kind") == WORD)
    sums = words.agg(F.sum("occurrences").alias("n"), F.sum("entries").alias("v")).first()
    ends = docs.where(learn).count()
    return Counts(totals.where(F.col("kind") == GRAM), words, (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0), ends)


def weigh_top(grams: DataFrame) -> Top:
    """The tree above the subtrees, from their roots summed by their nearest bytes but one."""

    def roots(rows: pa.Table) -> pa.Table:
        tree = _subtrees(rows)
        keys, zeros, ones, weight = tree.roots()
        parents = (keys >> U64(16) << U64(8)) | (keys & U64(255))
        kept, at = np.unique(parents, return_inverse=True)
        sums = [np.bincount(at, weights=c, minlength=len(kept)) for c in (zeros, ones, weight)]
        return pa.table({
            "node": pa.array(kept.astype(np.int64)), "zeros": pa.array(sums[0].astype(np.int64)),
            "ones": pa.array(sums[1].astype(np.int64)), "weight": pa.array(sums[2].astype(float)),
        })

    found = grams.groupBy("subtree").applyInArrow(roots, "node long, zeros long, ones long, weight double")
    summed = found.groupBy("node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.array_sort(F.collect_list("weight")).alias("weights")
    ).select("node", "zeros", "ones", F.aggregate("weights", F.lit(0.0), lambda s, w: s + w).alias("weight"))
    top = summed.orderBy("node").toPandas()  # at most 65,536 contexts of 255 nodes
    return Top(
        top["node"].to_numpy(np.int64).view(U64), top["zeros"].to_numpy(np.int64), top["ones"].to_numpy(np.int64),
        top["weight"].to_numpy(float), NEAREST,
    )


def _subtrees(rows: pa.Table) -> Subtrees:
    keys = np.concatenate([np.frombuffer(k, U64) for k in rows["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(c, np.int64) for c in rows["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    return Subtrees(keys[order], counts[order], DEPTH, NEAREST)


def gram_chances(grams: DataFrame, top: Top) -> DataFrame:
    """bucket, keys and values: the log10 chance of the last byte of every gram."""

    def run(rows: pa.Table) -> pa.Table:
        tree = _subtrees(rows)
        values = [tree.log10(np.frombuffer(k, U64), top).tobytes() for k in rows["keys"].to_pylist()]
        return pa.table({
            "kind": rows["kind"], "bucket": rows["bucket"], "keys": rows["keys"], "values": pa.array(values, pa.binary())
        })

    return grams.groupBy("subtree").applyInArrow(run, "kind int, bucket int, keys binary, values binary")


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    plan = layout(docs, least_chunk=CHUNK)
    buckets = plan.buckets * 4
    counts = count_corpus(docs, learn, buckets)
    top = weigh_top(counts.grams)
    chances = gram_chances(counts.grams, top)
    known = chances.unionByName(counts.words.select("kind", "bucket", "keys", F.col("counts").alias("values")))
    tokens, kinds, ends = counts.tokens, counts.kinds, counts.ends
    log_all = np.log10(tokens + 0.5 * (kinds + 1))

    def distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        grams, words = Tally(), Tally()
        for _, _, codes, _, keys, _ in text_groups(rows["text"].combine_chunks()):
            grams.add(codes, False)
            words.add(keys, False)
        return grams.take()[0], words.take()[0]

    def ordered(grams: np.ndarray, words: np.ndarray):
        """For each kind: keys in the order in which they are asked, buckets, and where each bucket begins."""
        for kind, keys in ((GRAM, grams), (WORD, words)):
            of = bucket_of(gram_key(keys) if kind == GRAM else keys, buckets).astype(np.int64)
            order = np.argsort(of, kind="stable")
            found, starts = np.unique(of[order], return_index=True)
            yield kind, keys[order], found, np.append(starts, len(keys))

    def ask(rows: pa.Table) -> pa.Table:
        out = {"kind": [], "bucket": [], "chunk": [], "keys": []}
        for kind, keys, found, cuts in ordered(*distinct(rows)):
            for b, x, y in zip(found.tolist(), cuts[:-1], cuts[1:]):
                out["kind"].append(kind)
                out["bucket"].append(b)
                out["keys"].append(keys[x:y].tobytes())
        out["chunk"] = [rows["chunk"][0].as_py()] * len(out["kind"])
        return pa.table({k: pa.array(v, pa.binary() if k == "keys" else pa.int32()) for k, v in out.items()})

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        kind = (asked if asked.num_rows else found)["kind"][0].as_py()
        number, packed = (np.float64, np.float32) if kind == GRAM else (np.int64, np.int64)
        keys = np.concatenate([np.zeros(0, U64), *(np.frombuffer(k, U64) for k in found["keys"].to_pylist())])
        values = np.concatenate([np.zeros(0, number), *(np.frombuffer(v, number) for v in found["values"].to_pylist())])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        answers = []
        for k in asked["keys"].to_pylist():
            wanted = np.frombuffer(k, U64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                own = np.where(keys[at] == wanted, values[at], 0)
            else:
                own = np.zeros(len(wanted))
            answers.append(own.astype(packed).tobytes())
        return pa.table({
            "kind": asked["kind"], "bucket": asked["bucket"], "chunk": asked["chunk"], "answer": pa.array(answers, pa.binary())
        })

    def add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = {c: [] for c in ("n_tokens", "n_known", "base_score", "score")}
        ids = rows["doc_id"]
        if rows.num_rows:
            groups = []
            for _, _, codes, at, keys, first in text_groups(rows["text"].combine_chunks()):
                groups.append((at, first, *np.unique(codes, return_inverse=True), *np.unique(keys, return_inverse=True)))
            grams, words = (np.unique(np.concatenate([g[i] for g in groups])) for i in (2, 4))
            lookup = {}
            told = {(r["kind"], r["bucket"]): r["answer"] for r in answers.to_pylist()}
            for kind, keys, found, _ in ordered(grams, words):
                number = np.float32 if kind == GRAM else np.int64
                values = np.concatenate([np.zeros(0, number), *(np.frombuffer(told[kind, b], number) for b in found.tolist())])
                order = np.argsort(keys, kind="stable")
                lookup[kind] = keys[order], values[order].astype(float)
            for at, first, codes, code_of, keys, key_of in groups:
                sorted_grams, chances = lookup[GRAM]
                score = np.add.reduceat(chances[np.searchsorted(sorted_grams, codes)][code_of], at[:-1])
                seen = np.zeros(0)
                if len(keys):
                    sorted_words, times = lookup[WORD]
                    seen = times[np.searchsorted(sorted_words, keys)][key_of]
                cost = np.concatenate([[0.0], np.cumsum(np.log10(seen + 0.5) - log_all)])
                have = np.concatenate([[0], np.cumsum(seen > 0)])
                out["n_tokens"].append(np.diff(first) + 1)
                out["n_known"].append(np.diff(have[first]) + (ends > 0))
                out["base_score"].append(cost[first[1:]] - cost[first[:-1]] + np.log10(ends + 0.5) - log_all)
                out["score"].append(score)
        whole = {c: np.concatenate([np.zeros(0), *v]) for c, v in out.items()}
        return pa.table({
            "doc_id": ids.cast(pa.int64()), "n_tokens": pa.array(whole["n_tokens"].astype(np.int64)),
            "n_known": pa.array(whole["n_known"].astype(np.int64)),
            "base_score": pa.array(whole["base_score"]), "score": pa.array(whole["score"]),
        })

    by_chunk = in_chunks(docs, plan.chunks, "text").groupBy("chunk")
    asked = by_chunk.applyInArrow(ask, "kind int, bucket int, chunk int, keys binary")
    answered = asked.groupBy("kind", "bucket").cogroup(known.groupBy("kind", "bucket")).applyInArrow(
        answer, "kind int, bucket int, chunk int, answer binary"
    )
    scored = by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(
        add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
