"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of each other node in the components of some edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    roots = np.fromiter(map(root, range(len(nodes))), np.int64, len(nodes))
    other = roots != np.arange(len(nodes))
    return nodes[other], nodes[roots[other]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars: as many components with fewer edges."""
    for batch in batches:
        if batch.num_rows:
            v, u = forest(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], names=["v", "u"])


def components(edges: DataFrame, most_rounds: int = 60, thin: bool = True) -> DataFrame:
    """(v, root) of each node v of edges (a, b) that isn't the least of its component; root is that least node.

    Self loops and repeated edges don't matter. Rounds grow with the logarithm of
    the longest path; one that hasn't settled after most_rounds raises. With thin, the edges of each batch
    are first reduced to stars, in Python; each round is written to the
    checkpoint folder, so that lineage stays short.
    """
    now = edges.select("a", "b").filter("a <> b")
    now = now.mapInArrow(lean(_thin), "v long, u long") if thin else now.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    now, seen = cut(now.distinct()), None
    for _ in range(most_rounds):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select("u", "v"))
        # least is written before it is joined: a join of two plain shuffles is one whose hot keys Spark splits
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = cut(both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct())
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("v <> u").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select("v", F.col("u").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")
