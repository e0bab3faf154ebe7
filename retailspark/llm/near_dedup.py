"""Near-duplicate detection by a signature-coordinate inverted join.

A document's set holds its distinct 5-word shingles. Its signature has ``COORDINATES`` coordinates;
each combines ``DEPTH`` min-hash values, so two sets of similarity j agree in a coordinate with chance
j ** DEPTH, and texts that merely share a passage almost never do.

1. Equal sets are one class, stood for by its smallest document.
2. Documents are posted under each (coordinate, value) of a prefix: two signatures that agree in
   ``MATCHES`` coordinates agree in one of the first ``COORDINATES - MATCHES + 1``. Lists of one
   document are skipped. Every other document of a list is joined to the list's smallest, never to all;
   the connected components of these joins are families, and a pair that can match lies in one family.
3. Inside a family, matching coordinates are counted pair by pair, skipping pairs that are already
   connected; pairs with ``MATCHES`` or more are confirmed on their full sets. At the similarity of the
   link (0.85) fewer than 3 of 64 coordinates of depth 8 agree with a chance below one in a million.
4. A family of more than ``BLOCK_DOCS`` is first dealt into blocks, each compared in itself. What that
   leaves unconnected to the family's main component is then compared with all its blocks, and only that.

Documents of a block meet in one task; a block has a fixed size, whatever the size of the family.

Defined results: null and empty texts have an empty set, link with nothing and stay; a text of fewer words than a
shingle has the whole sequence as its only shingle; a row with a null id links with nothing;
rows that repeat an id share its links; the smallest id of a component stays, ties are the same id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.llm.arrays import (
    LOWER_AZ, U64, byte_groups, column, lean, lean_group, lean_pair, mix, span_hashes, window_hashes, word_spans,
)
from retailspark.llm.components import components, stars
from retailspark.llm.exchange import answers_in_order, bucket_cuts, in_chunks, layout
from retailspark.plans.skew import lookup_join
from retailspark.plans.staging import staged

SHINGLE = 5
COORDINATES = 64
DEPTH = 8
MATCHES = 3
PREFIX = COORDINATES - MATCHES + 1
BLOCK_DOCS = 512
NUMERATOR, DENOMINATOR = 85, 100
NO_ID = np.iinfo(np.int64).max
_FACTORS = np.random.default_rng(20).integers(0, 1 << 32, (COORDINATES, DEPTH), dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of the texts, in groups of rows."""
    for start, end, offsets, data in byte_groups(texts):
        data = LOWER_AZ[data]
        starts, ends, first = word_spans(offsets, data)
        words = span_hashes(data, starts, ends)
        windows = window_hashes(words, SHINGLE, 11)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                sets.append(np.unique(windows[a:b - SHINGLE + 1]))
            else:
                sets.append(window_hashes(words[a:b], b - a, 12 + b - a) if b > a else np.zeros(0, U64))
        yield sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of coordinates for each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    full = sizes > 0
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    if full.any():
        flat = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for c in range(COORDINATES):
            joint = np.zeros(int(full.sum()), U64)
            for factor in _FACTORS[c]:
                least = np.minimum.reduceat(flat * factor, starts)
                joint = joint * U64(0x9E3779B97F4A7C15) + least.astype(U64)
            out[full, c] = (mix(joint, 13) >> U64(32)).astype(np.uint32)
    return out


def set_key(values: np.ndarray) -> bytes:
    """128 bits and the size of a set."""
    a, b = (mix(values, s).sum(dtype=U64) for s in (14, 15))
    return np.array([a, b, len(values)], U64).tobytes()


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key and signature of every row."""

    def run(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(column(batch, "text")):
                coded = signatures(sets)
                ids = column(batch, "doc_id").slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array([row.tobytes() for row in coded], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id long, n_shingles long, set_key binary, signature binary"
    )


class Postings:
    """The lists of one chunk: distinct keys, and for each entry its key and document."""

    def __init__(self, rows: pa.Table):
        ids = rows["doc_id"].to_numpy()
        coded = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)[:, :PREFIX]
        keys = mix(coded.astype(U64) | np.arange(PREFIX, dtype=U64) << U64(32), 16).ravel()
        docs = np.repeat(ids, PREFIX)
        order = np.lexsort((docs, keys))
        keys, self.docs = keys[order], docs[order]
        self.starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        self.keys = keys[self.starts]
        self.least = self.docs[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(keys)))


def family_edges(known: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """Each document of a list with the list's smallest document, contracted inside a chunk to one edge per document."""

    def ask(rows: pa.Table) -> pa.Table:
        lists = Postings(rows)
        found, cuts = bucket_cuts(lists.keys, buckets)
        low, spans = lists.keys.astype(np.uint32), list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "bucket": pa.array(found, pa.int32()), "chunk": pa.array([rows["chunk"][0].as_py()] * len(found), pa.int32()),
            "keys": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
            "docs": pa.array([lists.least[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
        docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
        order = np.lexsort((docs, keys))
        starts = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]) != 0)
        sizes = np.diff(np.append(starts, len(keys)))
        least = np.empty(len(keys), np.int64)
        least[order] = np.repeat(np.where(sizes > 1, docs[order][starts], NO_ID), sizes)
        cuts = np.cumsum([0, *(len(r["docs"]) // 8 for r in rows)])
        return pa.table({
            "kind": pa.array([1] * len(rows), pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "chunk": pa.array([r["chunk"] for r in rows], pa.int32()),
            "answer": pa.array([least[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        })

    def edges(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        lists = Postings(rows)
        least = np.frombuffer(b"".join(answers_in_order(answers, 1)), np.int64)
        least = np.where(lists.sizes > 1, np.minimum(least, lists.least), least)
        least = np.repeat(least, lists.sizes)
        joined = (least != NO_ID) & (least != lists.docs)
        nodes, roots = stars(lists.docs[joined], least[joined])
        below = nodes != roots
        return pa.table({"a": pa.array(nodes[below]), "b": pa.array(roots[below])})

    by_chunk = in_chunks(known, chunks, "signature").groupBy("chunk")
    asked = by_chunk.applyInArrow(lean_group(ask), "bucket int, chunk int, keys binary, docs binary")
    answered = asked.groupBy("bucket").applyInArrow(lean_group(answer), "kind int, bucket int, chunk int, answer binary")
    return by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(lean_pair(edges), "a long, b long")


class Links:
    """Connects documents of a block, skipping what is connected already."""

    def __init__(self, labels: list):
        self.parent: dict = {}
        self.labels = labels
        self.edges: list[tuple[int, int]] = []

    def root(self, label):
        while (up := self.parent.get(label, label)) != label:
            self.parent[label] = label = self.parent.get(up, up)
        return label

    def roots(self) -> np.ndarray:
        return np.array([self.root(label) for label in self.labels])

    def join(self, i: int, j: int) -> None:
        a, b = self.root(self.labels[i]), self.root(self.labels[j])
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def confirm(ids: np.ndarray, labels: np.ndarray, coded: np.ndarray, sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Edges (a, b) that connect all linked documents of a block; at least one side of a pair is in ``left``."""
    links = Links(labels.tolist())
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in np.flatnonzero(left).tolist():
        roots = links.roots()
        others = np.flatnonzero(roots != roots[i])
        near = (sizes[others] * DENOMINATOR >= sizes[i] * NUMERATOR) & (sizes[i] * DENOMINATOR >= sizes[others] * NUMERATOR)
        others = others[near]
        others = others[(coded[others] == coded[i]).sum(axis=1) >= MATCHES]
        if not len(others):
            continue
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        lengths = high - low
        places = np.arange(lengths.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        shared = np.bincount(owner[places], minlength=len(sets))[others]
        for j in others[DENOMINATOR * shared >= NUMERATOR * (sizes[i] + sizes[others] - shared)].tolist():
            links.join(i, j)
    return np.array([(ids[i], ids[j]) for i, j in links.edges], np.int64).reshape(-1, 2)


def confirm_groups(members: DataFrame, *keys: str) -> DataFrame:
    """Links inside each group of ``members`` (label, doc_id, signature, shingles, is_left)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending")])
        coded = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
        sets = [np.frombuffer(s, U64) for s in rows["shingles"].to_pylist()]
        found = confirm(rows["doc_id"].to_numpy(), rows["label"].to_numpy(), coded, sets, rows["is_left"].to_numpy())
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return members.groupBy(*keys).applyInArrow(lean_group(run), "a long, b long")


def with_shingles(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (doc_id, family, signature) with their shingles."""

    def run(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(column(batch, "text")):
                part = [column(batch, c).slice(at, len(sets)) for c in ("doc_id", "family", "signature")]
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "family", "signature", "shingles"]
                )

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id")
    return joined.select("doc_id", "family", "signature", "text").mapInArrow(
        lean(run), "doc_id long, family long, signature binary, shingles binary"
    )


def large_family_edges(large: DataFrame, edges: DataFrame, block_docs: int) -> DataFrame:
    """Links of large families between documents that the blocks left unconnected and all others."""
    label = components(edges)
    placed = staged(large.join(label, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "family", "signature", "shingles", F.coalesce("component", "doc_id").alias("label")
    ), "near-large")
    sizes = placed.groupBy("family", "label").count()
    counts = sizes.groupBy("family").agg(
        F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("main_docs"),
        (F.sum("count") - F.max("count")).alias("left_docs"),
    )

    def blocks(n):
        return F.greatest(F.ceil(n / F.lit(block_docs)), F.lit(1)).cast("int")

    spread = (
        lookup_join(placed, staged(counts.where("left_docs > 0"), "near-counts"), "family", "inner", placed.select("family"))
        .withColumn("is_left", F.col("label") != F.col("main"))
        .withColumn("left_blocks", blocks(F.col("left_docs")))
        .withColumn("blocks", F.col("left_blocks") + blocks(F.col("main_docs")))
        .withColumn("block", F.when(F.col("is_left"), F.pmod(F.xxhash64("doc_id"), F.col("left_blocks"))).otherwise(
            F.col("left_blocks") + F.pmod(F.xxhash64("doc_id"), F.col("blocks") - F.col("left_blocks"))).cast("int"))
    )
    # A pair of blocks (x, y) has x among the unconnected ones. Main documents go to each x, unconnected ones to all.
    met = F.when(
        F.col("is_left"),
        F.concat(
            F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda y: F.struct(F.col("block").alias("x"), y.alias("y"))),
            F.transform(
                F.filter(F.sequence(F.lit(0), F.col("left_blocks") - 1), lambda x: x < F.col("block")),
                lambda x: F.struct(x.alias("x"), F.col("block").alias("y")),
            ),
        ),
    ).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("left_blocks") - 1), lambda x: F.struct(x.alias("x"), F.col("block").alias("y")))
    )
    meeting = spread.withColumn("met", F.explode(met)).select(
        "doc_id", "family", "signature", "shingles", "label", "is_left", F.col("met.x").alias("x"), F.col("met.y").alias("y")
    )
    return confirm_groups(meeting, "family", "x", "y")


def near_groups(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    plan = layout(docs)
    rows = staged(described(docs), "near-rows")
    usable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(usable.groupBy("set_key").agg(
        F.min("doc_id").alias("class_id"), F.min_by("signature", "doc_id").alias("signature")), "near-classes")
    stand_ins = classes.select(F.col("class_id").alias("doc_id"), "signature")
    # Staged, so that a task needs one Python worker at a time.
    family = components(staged(family_edges(stand_ins, plan.chunks, plan.buckets), "near-families"))
    members = stand_ins.join(family, F.col("doc_id") == F.col("node")).select(
        "doc_id", F.col("component").alias("family"), "signature"
    )
    sets = staged(with_shingles(docs, members), "near-sets")
    sizes = sets.groupBy("family").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > block_docs)
    sized = lookup_join(sets, staged(sizes, "near-sizes"), "family", "left", sets.select("family"))
    blocks = F.coalesce(F.ceil(F.col("docs") / F.lit(block_docs)), F.lit(1))
    blocked = sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("is_left", F.lit(True)).withColumn(
        "label", F.col("doc_id")
    )
    edges = staged(confirm_groups(blocked.drop("docs"), "family", "block"), "near-links")
    large = sized.where(F.col("docs") > block_docs).drop("docs")
    if not large.isEmpty():
        edges = staged(edges.unionByName(large_family_edges(large, edges, block_docs)), "near-links")
    # Classes that share a smallest document (rows that repeat an id) are one component with it.
    repeats = usable.join(classes.select("set_key", "class_id"), "set_key").select(
        F.col("doc_id").alias("a"), F.col("class_id").alias("b")
    )
    found = components(edges.unionByName(repeats))
    return rows.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_near_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that stay."""
    gone = near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
