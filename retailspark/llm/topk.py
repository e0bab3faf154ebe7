"""Exact top-k inner products by norm-bucketed retrieval.

Integer vectors are put into buckets by dimension and length (norm): a bucket spans a fixed ratio of lengths, and one that
many vectors share is cut into buckets of ``BUCKET_VALUES`` components, longest vectors first. Queries travel in
blocks. A first round multiplies each query with the ``k`` or more longest vectors only and so gives a score that its
k-th result will reach at least. A block only goes to buckets whose vectors are long enough for that score; there the score,
divided by the lengths of the query and of the bucket's longest vector, is the bucket's local cosine threshold:

* above 1, no vector of the bucket can reach the score, and the bucket is skipped;
* otherwise length pruning keeps the first vectors of the bucket, those long enough for the score;
* where the threshold is at least ``COORDINATE_FROM``, coordinate pruning also demands that the
  query's largest coordinates are matched: a unit vector at cosine t or more from a unit query
  has each coordinate within an interval around the query's.

A task holds one bucket and ``SLICE_BLOCKS`` blocks; blocks are smaller than buckets, so they are what is repeated.
What remains is verified with exact products, and each query's best k of all buckets are kept.
Bounds carry a slack for rounding, so pruning never drops a result.

Products are exact: they run on doubles where the lengths prove that every partial sum is below
2**53, and on Python integers elsewhere. Scores beyond a 64-bit number are an error.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a null id take no
part; only vectors of equal dimension are compared; a query never meets its own row (an equal id);
equal scores go to the smaller id; vectors of length 0 score 0; empty vectors compare with each other at 0;
repeated ids are candidates as often as they occur; of queries that share an id, the one with the smallest vector,
component by component, is asked; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.plans.skew import lookup_join
from retailspark.plans.staging import staged

SCALE = 1024
#: Components of one bucket, queries of one block, blocks that one task takes to a bucket.
BUCKET_VALUES = 1 << 19
QUERY_ROWS = 512
SLICE_BLOCKS = 64
#: Vectors of the first round; buckets of lengths per doubling.
HEAD_ROWS = 2_048
PER_DOUBLING = 4
COORDINATE_FROM = 0.7
FOCUS = 4
EXACT = float(1 << 53)
SLACK = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector.cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and components floor(scale * x), kept as whole doubles."""
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    return df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("vec_id"), whole.alias("whole")
    )


def measured(vectors: DataFrame) -> DataFrame:
    """Add dimension, length and the number of the length's range."""
    norm = F.sqrt(F.aggregate("whole", F.lit(0.0), lambda s, x: s + x * x))
    lengths = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * PER_DOUBLING)).otherwise(F.lit(NO_LENGTH)).cast("int")
    return vectors.withColumn("dim", F.size("whole")).withColumn("norm", norm).withColumn("range", lengths)


#: Range of vectors of length 0, below all others.
NO_LENGTH = -(1 << 20)


def packed_rows(rows: pa.Table) -> dict:
    """Ids, lengths and components of some vectors of one dimension as bytes, longest first."""
    rows = rows.select(["vec_id", "norm", "whole"]).to_pandas().sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
    matrix = np.array(rows["whole"].tolist(), np.float64)
    return {
        "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "norms": [rows["norm"].to_numpy(float).tobytes()],
        "matrix": [matrix.tobytes()],
    }


BUCKET = "ids binary, norms binary, matrix binary"


def packed_buckets(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per bucket: dim, range, part and its vectors. ``ranges`` tells into how many parts a range is cut."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        named = {n: [k.as_py()] for n, k in zip(("dim", "range", "part"), key)}
        return pa.table({**{n: pa.array(v, pa.int32()) for n, v in named.items()}, **packed_rows(table)})

    keys = ["dim", "range"]
    cut = lookup_join(rows, ranges.select(*keys, "parts"), keys, "inner", hot_source=rows.select(*keys))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return dealt.select(*keys, "part", "vec_id", "norm", "whole").groupBy(*keys, "part").applyInArrow(
        pack, f"dim int, range int, part int, {BUCKET}"
    )


def products(queries: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products; ``bound`` is the largest query length times the largest row length."""
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape) @ np.array(
        [[int(x) for x in r] for r in rows], object).reshape(rows.shape).T
    return exact.astype(np.int64)


def candidates_of(query: np.ndarray, norm: float, floor: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places of the bucket that may reach the score ``floor`` with this query."""
    if floor <= 0 or norm == 0:
        return np.arange(len(norms)) if floor <= 0 else np.zeros(0, np.int64)
    reach = floor * (1 - SLACK) / norm
    n = int(np.searchsorted(-norms, -reach, side="right"))  # norms fall
    if n == 0:
        return np.zeros(0, np.int64)
    threshold = reach / norms[0]
    places = np.arange(n)
    if threshold >= COORDINATE_FROM:
        unit = query / norm
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            needed = np.minimum(reach / norms[places], 1.0)
            half = np.sqrt(np.maximum((1 - unit[f] ** 2) * (1 - needed ** 2), 0)) + SLACK
            near = np.abs(rows[places, f] / norms[places] - unit[f] * needed) <= half
            # beyond the query itself the interval reaches to cosines above the threshold
            above = np.where(unit[f] >= 0, rows[places, f] / norms[places] >= unit[f] * needed, rows[places, f] / norms[places] <= unit[f] * needed)
            places = places[near | above]
    return places


def search(one: dict, k: int) -> pd.DataFrame:
    """Best k rows of one bucket for each query of one block, of those that may reach its floor."""
    dim = one["dim"]
    ids, norms = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["norms"])
    rows = np.frombuffer(one["matrix"]).reshape(len(ids), dim)
    qids, qnorms, floors = (np.frombuffer(one[c], t) for c, t in (("qids", np.int64), ("qnorms", float), ("floors", float)))
    queries = np.frombuffer(one["qmatrix"]).reshape(len(qids), dim)
    bound = float(norms.max() * qnorms.max()) * (1 + SLACK)
    places = [candidates_of(q, n, f, rows, norms) for q, n, f in zip(queries, qnorms, floors)]
    # Queries that length pruning alone leaves with a prefix share one product of matrices.
    prefix = np.array([len(p) if len(p) and p[-1] == len(p) - 1 else 0 for p in places])
    shared = products(queries[prefix > 0], rows[:prefix.max(initial=0)], bound) if prefix.any() else None
    at = np.cumsum(prefix > 0) - 1
    found = []
    for i, p in enumerate(places):
        if not len(p):
            continue
        scores = shared[at[i], :len(p)] if prefix[i] else products(queries[i:i + 1], rows[p], bound)[0]
        other = ids[p] != qids[i]
        scores, own = scores[other], ids[p][other]
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, own = scores[scores >= least], own[scores >= least]
        best = np.lexsort((own, -scores))[:k]
        found.append(pd.DataFrame({"query_id": qids[i], "vec_id": own[best], "score": scores[best]}))
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    return pd.concat([empty, *found], ignore_index=True).astype(np.int64)


FOUND = "query_id long, vec_id long, score long"


def meet(buckets: DataFrame, blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best k rows of each bucket for each query of the blocks that share its keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [search(bucket | block, k) for bucket in left.to_pylist() for block in right.to_pylist()]
        if not found:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        return pa.Table.from_pandas(pd.concat(found, ignore_index=True), preserve_index=False)

    return buckets.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, FOUND)


def slices_of(blocks: int) -> int:
    return -(-blocks // SLICE_BLOCKS)


def in_slices(buckets: DataFrame, slices: int) -> DataFrame:
    return buckets.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """Blocks of queries, each query with the score it will reach at least (or none)."""
    if floors is None:
        known = queries.withColumn("floor", F.lit(float("-inf")))
    else:
        least = floors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
        known = queries.join(least, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", floor)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.to_pandas().sort_values("vec_id", kind="stable")
        matrix = np.array(rows["whole"].tolist(), np.float64)
        norms, floors = rows["norm"].to_numpy(float), rows["floor"].to_numpy(float)
        # Length that a row needs to reach the floor of any of the queries.
        needs = np.where(floors <= 0, 0.0, floors / np.where(norms > 0, norms, 1.0))
        needs[(floors > 0) & (norms == 0)] = np.inf
        return pa.table({
            "block": pa.array([int(rows["block"].iloc[0])], pa.int32()), "dim": pa.array([int(rows["dim"].iloc[0])], pa.int32()),
            "need": [float(needs.min()) * (1 - SLACK)],
            "qids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "qnorms": [norms.tobytes()],
            "floors": [floors.tobytes()], "qmatrix": [matrix.tobytes()],
        })

    packed = known.select("block", "vec_id", "dim", "norm", "whole", "floor").groupBy("block", "dim").applyInArrow(
        pack, "block int, dim int, need double, qids binary, qnorms binary, floors binary, qmatrix binary"
    )
    return packed.withColumn("slice", F.floor(F.col("block") / SLICE_BLOCKS).cast("int"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query with all other rows."""
    numbered = integer_vectors(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    rows = staged(measured(numbered), "topk-vectors")
    whole = integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("whole").alias("whole"))
    asked = staged(measured(whole), "topk-asked")
    n = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    slices = slices_of(n)

    longest = Window.partitionBy("dim").orderBy(F.desc("norm"), "vec_id", "row")
    head = rows.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= max(HEAD_ROWS, k + 1))

    def one_bucket(table: pa.Table) -> pa.Table:
        return pa.table({"dim": table["dim"].slice(0, 1), **packed_rows(table)})

    heads = head.groupBy("dim").applyInArrow(one_bucket, f"dim int, {BUCKET}")
    first = meet(in_slices(heads, slices), query_blocks(asked, None, k), ["dim", "slice"], k)
    blocks = query_blocks(asked, staged(ranked(first, k), "topk-floors"), k)

    # One row per dimension and range of lengths, of which a double has at most some thousands.
    parts = F.greatest(F.ceil(F.col("n") * F.col("dim") / F.lit(BUCKET_VALUES)), F.lit(1)).cast("int")
    ranges = staged(
        rows.groupBy("dim", "range").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).withColumn("parts", parts), "topk-ranges"
    )
    buckets = packed_buckets(rows, ranges)
    reached = ranges.select(F.col("dim").alias("range_dim"), "range", "longest", "parts")
    sent = blocks.join(reached, (F.col("dim") == F.col("range_dim")) & (F.col("longest") >= F.col("need"))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).drop("range_dim", "longest", "parts")
    found = meet(in_slices(buckets, slices), sent, ["dim", "range", "part", "slice"], k)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
