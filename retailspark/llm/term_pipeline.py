"""Ranked lexical search by pipelined term partitioning, exact.

1. Terms are runs of ASCII letters, digits and code points from U+0080 on; only A-Z are lower-cased. One pass over all texts keeps, per
   document, its number of terms and the counts of those terms that some item has.
2. From these come N, L and, per term, document frequency and an upper bound of what it can add to a score. Terms are dealt to
   ``OWNERS`` owners by falling weight, so that the first owners hold few postings and the last one the commonest terms.
3. Documents are dealt into shards by a hash. Of every shard each owner holds one list of postings, with the integer part of
   a score worked out, per bundle of ``BUNDLE`` items: what the items of other bundles ask is not sent along.
4. Bundles pass through the owners one after the other. A stage cogroups the bundles with the owner's postings, shard by shard, and
   adds its contributions to the accumulators that the bundle carries, one per item and document touched.
5. After a stage, the k-th best sum of an item over all shards is a floor. A document whose sum, with all that
   later owners can add at most, stays below the floor can not be among the k best and leaves the bundle. So rare terms
   come first, and common ones meet few accumulators. This drops no result: equal sums stay.
6. After the last stage every shard gives its k best per item, and a window ranks them.

Hot terms are spread over all shards like their documents; no task holds more than a shard's postings. Items are taken in
waves of about ``WAVE_TERMS`` item terms (by a hash of the id), so what travels to all tasks has that size however many items
there are; each wave reads the texts again. Stages are staged tables.

Terms are compared by 64-bit hashes: a text's term is taken for another one of the wave with a chance of at most
``WAVE_TERMS`` / 2^64 (10^-13) per distinct term. Terms of items with equal hashes raise an error.

Defined results: a null or empty text has no terms and ranks nowhere; documents that repeat an id are ranked as rows of their own,
equal ones in any order; null ids come last among equal scores; items that share an id (null is one) are one item of all their
terms; an item without terms or hits has no rows; a repeated term of an item counts once; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailspark.llm.arrays import LOWER_AZ, byte_groups, column, span_hashes, word_spans
from retailspark.plans.staging import staged

K = 50
#: Fixed values of the score: hits saturate at 1 / 0.001 of a weight; length counts half.
SATURATED, PER_HIT, PER_LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 20, 100 - 50, 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WAVE_TERMS, BUNDLE = 1 << 20, 256
#: Shares of all postings up to which the owners, in this order, hold terms.
OWNERS = (1 / 64, 1 / 8, 1.0)
SHARD_DOCS, SHARD_POSTINGS = 1 << 12, 1 << 19
HELD = "row long, doc_id long, n long, terms binary, hits binary"
POSTINGS = "bundle int, shard long, owner int, ids array<bigint>, terms binary, counts binary, places binary, values binary"
BUNDLES = "bundle int, shard long, counts binary, places binary, sums binary"


class Wave:
    """Some items with their terms; terms are numbered in the order of their hashes."""

    def __init__(self, rows: list):
        names = sorted({r["term"] for r in rows})
        raw = [n.encode() for n in names]
        data = np.frombuffer(b"".join(raw), np.uint8)
        cuts = np.cumsum([0, *map(len, raw)])
        hashes = span_hashes(data, cuts[:-1], cuts[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the items have the same hash")
        number = {names[at]: n for n, at in enumerate(order.tolist())}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append(number[r["term"]])
        self.item_ids = sorted(by_item, key=lambda i: (i is None, i or 0))
        self.item_terms = [np.array(sorted(by_item[i]), np.int64) for i in self.item_ids]
        self.bundle_items = BUNDLE
        self.bundles = -(-len(self.item_ids) // self.bundle_items)

    def items_of(self, bundle: int) -> range:
        return range(bundle * self.bundle_items, min((bundle + 1) * self.bundle_items, len(self.item_ids)))


def waves(items: DataFrame, most: int = WAVE_TERMS) -> Iterator[Wave]:
    """The items in parts of about ``most`` terms; each part, at most some times that large, is read by the driver."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = staged(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
        .distinct(),
        "search-items",
    )
    parts = max(1, -(-terms.count() // most))
    for part in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        if rows:
            yield Wave(rows)


def held_terms(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """Every document that has a term: its number of terms, and which of the given terms it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in byte_groups(column(batch, "text")):
                starts, ends, of_row = word_spans(offsets, data, NO_TERM)
                n = np.diff(of_row)
                found = span_hashes(LOWER_AZ[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                known = np.flatnonzero(hashes[at] == found)
                row = np.repeat(np.arange(last - first), n)[known]
                pairs, hits = np.unique(row * len(hashes) + at[known], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(last - first + 1) * len(hashes))
                terms, hits = (pairs % len(hashes)).astype("<i4").tobytes(), hits.astype("<i4").tobytes()
                has = np.flatnonzero(n)
                bounds = list(zip((4 * cuts[has]).tolist(), (4 * cuts[has + 1]).tolist()))
                rows = batch.slice(first, last - first).take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [column(rows, "row"), column(rows, "doc_id"), pa.array(n[has]),
                     pa.array([terms[a:b] for a, b in bounds], pa.binary()), pa.array([hits[a:b] for a, b in bounds], pa.binary())],
                    ["row", "doc_id", "n", "terms", "hits"],
                )

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, HELD)


def flat_ints(values: pa.Array, kind: str = "<i4") -> np.ndarray:
    """The numbers of a column of packed arrays, one after the other."""
    return np.frombuffer(b"".join(v for v in values.to_pylist() if v), kind).astype(np.int64)


def term_figures(held: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per term: documents that hold it, most hits in one, fewest terms of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most, least = np.zeros(terms, np.int64), np.zeros(terms, np.int64), np.full(terms, 1 << 62)
        for batch in batches:
            ids, hits = flat_ints(column(batch, "terms")), flat_ints(column(batch, "hits"))
            n = np.asarray(column(batch, "n"))
            sizes = np.asarray(pa.compute.binary_length(column(batch, "terms"))) // 4
            df += np.bincount(ids, minlength=terms)
            np.maximum.at(most, ids, hits)
            np.minimum.at(least, ids, np.repeat(n, sizes))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, df[some], most[some], least[some])], ["term", "df", "most", "least"])

    import pyarrow.compute  # noqa: F401

    parts = held.select("n", "terms", "hits").mapInArrow(run, "term long, df long, most long, least long")
    # At most one row per term of the wave.
    rows = parts.groupBy("term").agg(F.sum("df"), F.max("most"), F.min("least")).collect()
    out = np.zeros(terms, np.int64), np.zeros(terms, np.int64), np.ones(terms, np.int64)
    for term, *values in rows:
        for column_, value in zip(out, values):
            column_[term] = value
    return out


def length_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return FLAT + (SLOPE * n * docs) // total


def hit_value(hits: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return (SATURATED * hits) // (PER_HIT * hits + PER_LENGTH * factor)


def owner_of(weights: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Owner of each term, by falling weight; terms without weight or documents have none (-1)."""
    order = np.lexsort((np.arange(len(df)), -weights))
    share = np.cumsum(df[order]) / max(int(df.sum()), 1)
    owners = np.empty(len(df), np.int64)
    owners[order] = np.minimum(np.searchsorted(OWNERS, share - 1e-12), len(OWNERS) - 1)
    owners[(df == 0) | (weights <= 0)] = -1
    return owners


def index_shards(held: DataFrame, wave: Wave, owners: np.ndarray, docs: int, total: int, shards: int) -> DataFrame:
    """Postings per (bundle, shard, owner); owner -1 holds the ids of the shard's documents, in the order of their places."""
    wanted = []
    for bundle in range(wave.bundles):
        mask = np.zeros(len(owners), bool)
        mask[np.concatenate([wave.item_terms[i] for i in wave.items_of(bundle)])] = True
        wanted.append(np.packbits(mask))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])  # null ids go last
        n = rows["n"].to_numpy()
        sizes = np.array([len(t) // 4 for t in rows["terms"].to_pylist()], np.int64)
        terms, hits = flat_ints(rows["terms"]), flat_ints(rows["hits"])
        places = np.repeat(np.arange(len(n)), sizes)
        values = hit_value(hits, np.repeat(length_factor(n, docs, total), sizes))
        order = np.lexsort((places, terms, owners[terms]))
        terms, places, values = terms[order], places[order], values[order]
        shard, ids = key[0].as_py(), rows["doc_id"].to_pylist()
        out = []
        for bundle, bits in enumerate(wanted):
            own = np.unpackbits(bits, count=len(owners)).astype(bool)[terms]
            t, p, v = terms[own], places[own], values[own]
            out.append((bundle, shard, -1, ids, b"", b"", b"", b""))
            for owner in range(len(OWNERS)):
                a, b = np.searchsorted(owners[t], [owner, owner + 1])
                if a == b:
                    continue
                starts = np.flatnonzero(np.diff(t[a:b], prepend=-1))
                counts = np.diff(np.append(starts, b - a))
                packed = (t[a:b][starts], counts, p[a:b], v[a:b])
                out.append((bundle, shard, owner, None, *(x.astype("<i4").tobytes() for x in packed)))
        names = [f.split()[0] for f in POSTINGS.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    dealt = held.where(F.octet_length("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, POSTINGS)


def unpacked(value: bytes | None, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(value or b"", kind).astype(np.int64)


class Stage:
    """What an owner does with a bundle: item terms, weights, and what later owners can still add."""

    def __init__(self, wave: Wave, weights: np.ndarray, bounds: np.ndarray, owners: np.ndarray, owner: int, floors: np.ndarray):
        self.wave, self.owner, self.weights, self.floors = wave, owner, weights, floors
        self.own = [t[owners[t] == owner] for t in wave.item_terms]
        self.later = np.array([int(bounds[t[owners[t] > owner]].sum()) for t in wave.item_terms], np.int64)

    def sums(self, left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item, places and sums of the accumulators that stay."""
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in right.to_pylist():
            if r["owner"] == self.owner:
                counts, places, values = unpacked(r["counts"]), unpacked(r["places"]), unpacked(r["values"])
                cuts = np.cumsum(np.append(0, counts))
                lists |= {t: (places[a:b], values[a:b]) for t, a, b in zip(unpacked(r["terms"]).tolist(), cuts[:-1], cuts[1:])}
        bundle = (left if left.num_rows else right)["bundle"][0].as_py()
        carried = [(unpacked(r["counts"]), unpacked(r["places"]), unpacked(r["sums"], "<i8")) for r in left.to_pylist()]
        size = 1 + max([int(p.max()) for p, _ in lists.values() if len(p)] + [int(p.max()) for _, p, _ in carried if len(p)], default=-1)
        total = np.zeros(size, np.int64)
        cuts = np.cumsum(np.append(0, carried[0][0])) if carried and len(carried[0][0]) else None
        for n, item in enumerate(self.wave.items_of(bundle)):
            total[:] = 0
            if cuts is not None:
                some = slice(cuts[n], cuts[n + 1])
                total[carried[0][1][some]] = carried[0][2][some]
            for term in self.own[item].tolist():
                if term in lists:
                    places, values = lists[term]
                    total[places] += self.weights[term] * values
            places = np.flatnonzero(total)
            sums = total[places]
            stays = sums + self.later[item] >= self.floors[item]
            yield item, places[stays], sums[stays]

    def carrier(self):
        return lambda key, left, right: self.carry(key, left, right)

    def selector(self, k: int):
        return lambda left, right: self.select(left, right, k)

    def carry(self, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(self.sums(left, right))
        packed = [
            np.array([len(p) for _, p, _ in found], "<i4").tobytes(),
            b"".join([p.astype("<i4").tobytes() for _, p, _ in found]), b"".join([s.astype("<i8").tobytes() for _, _, s in found]),
        ]
        names = [f.split()[0] for f in BUNDLES.split(", ")]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([key[0].as_py(), key[1].as_py(), *packed], types)], names)

    def select(self, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
        """The k best documents per item of this shard; places grow with the ids."""
        ids = next((r["ids"] for r in right.to_pylist() if r["owner"] == -1), [])
        out = []
        for item, places, sums in self.sums(left, right):
            best = np.lexsort((places, -sums))[:k]
            out.extend((self.wave.item_ids[item], ids[p], s) for p, s in zip(places[best].tolist(), sums[best].tolist()) if s > 0)
        columns = list(zip(*out)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])


def floors_after(bundles: DataFrame, wave: Wave, k: int) -> np.ndarray:
    """The k-th best sum of each item over all shards; 0 if there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                cuts = np.cumsum(np.append(0, unpacked(r["counts"])))
                sums = unpacked(r["sums"], "<i8")
                for n, item in enumerate(wave.items_of(r["bundle"])):
                    both = np.concatenate([best.get(item, sums[:0]), sums[cuts[n]:cuts[n + 1]]])
                    best[item] = np.partition(both, len(both) - k)[-k:] if len(both) > k else both
        items = np.repeat(np.fromiter(best, np.int64, len(best)), [len(v) for v in best.values()])
        sums = np.concatenate([*best.values(), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(sums)], ["item", "sum"])

    best = bundles.select("bundle", "counts", "sums").mapInArrow(run, "item long, sum long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("sum").desc()))
    floors = np.zeros(len(wave.item_ids), np.int64)
    for r in best.withColumn("place", place).where(f"place <= {k}").where(f"place = {k}").collect():
        floors[r["item"]] = r["sum"]
    return floors


def search_wave(spark: SparkSession, docs: DataFrame, wave: Wave, k: int) -> DataFrame | None:
    """The k best documents per item and shard."""
    held = staged(held_terms(docs, wave.hashes), "search-terms")
    n_docs, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df, most, least = term_figures(held, len(wave.hashes))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    bounds = np.maximum(weights, 0) * hit_value(most, length_factor(least, n_docs, total))
    owners = owner_of(weights, df)
    shards = max(-(-n_docs // SHARD_DOCS), -(-int(df.sum()) // SHARD_POSTINGS), 1)
    index = staged(index_shards(held, wave, owners, n_docs, total, shards), "search-index")

    keys = ["bundle", "shard"]
    carried = spark.range(wave.bundles * shards).select(
        F.floor(F.col("id") / shards).cast("int").alias("bundle"), (F.col("id") % shards).alias("shard"),
        *[F.lit(None).cast("binary").alias(c) for c in ("counts", "places", "sums")],
    )
    floors = np.zeros(len(wave.item_ids), np.int64)
    for owner in range(len(OWNERS)):
        stage, last = Stage(wave, weights, bounds, owners, owner, floors), owner == len(OWNERS) - 1
        lists = index.where(F.col("owner").isin(owner, -1) if last else F.col("owner") == owner)
        if not last:
            lists = lists.drop("ids")
        met = carried.groupBy(keys).cogroup(lists.groupBy(keys))
        if last:
            return met.applyInArrow(stage.selector(k), "item_id long, doc_id long, score long")
        carried = staged(met.applyInArrow(stage.carrier(), BUNDLES), f"search-bundles-{owner}")
        floors = np.maximum(floors, floors_after(carried, wave, k))


def rank_items(docs: DataFrame, items: DataFrame, k: int = K, wave_terms: int = WAVE_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item. ``docs`` has doc_id and text, ``items`` item_id and text."""
    spark = docs.sparkSession
    best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for wave in waves(items, wave_terms):
        found = search_wave(spark, docs, wave, k)
        best = best if found is None else best.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
