"""Connected components of an edge table: local contraction in every partition, until nothing moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.llm.arrays import lean
from retailspark.plans.staging import staged

SALTS = 4
STATE = "a long, b long, moved boolean"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of some edges, and the smallest node each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right, label[left], label[right]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars: every node with the smallest node it is connected to here.

    An edge that is here unchanged is only passed on where its larger node is at home.
    """
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows]
    if not parts:
        return
    a, b, home = (np.concatenate(side) for side in zip(*parts))
    nodes, roots = stars(a, b)
    kept = b == roots[np.searchsorted(nodes, a)]
    passed_on = np.ones(len(nodes), bool)
    passed_on[np.searchsorted(nodes, a[kept])] = False
    passed_on[np.searchsorted(nodes, a[home])] = True
    below = np.flatnonzero(passed_on & (roots != nodes))
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[below]), pa.array(roots[below]), pa.array(np.full(len(below), not kept.all()))], ["a", "b", "moved"]
    )


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b).

    An edge meets the other edges of both its nodes. Those of its larger node are few; the edges that point
    to a node are dealt over ``SALTS`` places, each of which also gets the node's own edges, and a place is
    contracted to one edge per node before it moves on. When no edge moves, all are stars around their smallest nodes. Rounds grow with the
    logarithm of the longest path.
    """
    ordered = edges.select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"), F.lit(True).alias("home")
    )
    edges = staged(ordered.where("a <> b").mapInArrow(lean(contract), STATE), "edges")
    moved = True
    while moved:
        own = edges.select("a", "b", F.col("a").alias("key"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        from_below = edges.select("a", "b", F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
        met = own.withColumn("home", F.col("salt") == 0).unionByName(from_below.withColumn("home", F.lit(False)))
        edges = staged(met.repartition("key", "salt").select("a", "b", "home").mapInArrow(lean(contract), STATE), "edges")
        moved = bool(edges.agg(F.max("moved")).first()[0])
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
