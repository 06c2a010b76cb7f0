"""Exact top-k search by columnar branch and bound.

Vectors are held in vertical layout: blocks of candidates, dimension by
dimension. Inner products are accumulated one block of dimensions at a time;
what the remaining dimensions can still add is at most the product of the two
remaining norms (their remaining mass), and a candidate whose bound is below the
query's k-th best score so far leaves. Survivors are compacted to pairs.

Queries reach the tasks in waves of bounded size (wave_bytes), each of which
passes over all candidates; a task keeps the k best of each query of the wave. A
wave's results are written and its broadcast is gone before the next one begins,
so memory does not depend on the number of waves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

DIMENSIONS, CANDIDATES, QUERIES = 16, 8192, 256
LEAST, MOST = -(2**63), 2**63 - 1


def _integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; a list array of one width to a matrix of doubles (whole numbers)."""
    flat = np.asarray(vectors.flatten().cast(pa.float64()))
    return np.floor(flat.reshape(len(vectors), -1) * scale)


class Search:
    """The k best candidates so far of each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.best = [np.zeros(0, np.int64)] * 3  # query, candidate id, score
        self.least = np.full(len(ids), -np.inf)  # k-th best score of each query, once there are k
        self.starts = [*range(0, vectors.shape[1], DIMENSIONS)]
        self.rest = self._rest(vectors)
        self.largest = np.abs(vectors).max(initial=0.0)

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """Norm of what follows each block of dimensions, rounded up; a row for each vector."""
        mass = np.stack([np.square(x[:, s : s + DIMENSIONS]).sum(axis=1) for s in self.starts], axis=1) if self.starts else np.zeros((len(x), 0))
        after = np.concatenate([np.cumsum(mass[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(x), min(1, len(self.starts))))], axis=1)
        return np.sqrt(after) * (1 + 1e-9)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if self.largest * np.abs(vectors).max(initial=0.0) * max(1, vectors.shape[1]) >= 2**52:
            return self._add_large(ids, vectors)
        columns, rest = np.ascontiguousarray(vectors.T), self._rest(vectors)
        for a in range(0, len(self.ids), QUERIES):
            self._tile(slice(a, a + QUERIES), ids, columns, rest)

    def _tile(self, tile: slice, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray) -> None:
        q, least = self.q[tile], self.least[tile]
        score = np.zeros((len(q), len(ids)))
        pairs = None
        for b, s in enumerate(self.starts):
            block = slice(s, s + DIMENSIONS)
            if pairs is None:
                score += q[:, block] @ columns[block]
                alive = score + self.rest[tile][:, b, None] * rest[None, :, b] + 1e-6 >= least[:, None]
                if b == len(self.starts) - 1 or np.count_nonzero(alive) * 4 < alive.size:
                    pairs = np.nonzero(alive)
                    score = score[pairs]
            else:
                i, j = pairs
                score = score + np.einsum("pd,dp->p", q[i, block], columns[block][:, j])
                alive = score + self.rest[tile][i, b] * rest[j, b] + 1e-6 >= least[i]
                pairs, score = (i[alive], j[alive]), score[alive]
        i, j = pairs if pairs is not None else np.nonzero(score == 0)
        if pairs is None:
            score = score[i, j]
        other = self.ids[tile][i] != ids[j]
        self._merge(i[other] + tile.start, ids[j[other]], score[other].astype(np.int64))

    def _add_large(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """As add, for products that doubles don't hold: doubles bound them, and Python's integers decide. Scores end at the range of long."""
        norm = np.sqrt(np.square(vectors).sum(axis=1))
        columns = np.ascontiguousarray(vectors.T)
        for i, q in enumerate(self.q):
            about = q @ columns
            error = (vectors.shape[1] + 8) * 2.0**-52 * math.sqrt(float(np.square(q).sum())) * norm
            upper, lower = about + error, about - error
            least = self.least[i]
            if not least > -np.inf and len(ids) > self.k:  # no k-th best yet: k of these reach the k-th largest lower bound, less one for the query itself
                least = min(float(MOST), np.partition(lower, -self.k - 1)[-self.k - 1])
            at = np.flatnonzero((upper >= min(least, float(MOST))) & (ids != self.ids[i]))
            x = [*map(int, q.tolist())]
            score = [max(LEAST, min(MOST, sum(a * int(b) for a, b in zip(x, v)))) for v in vectors[at].tolist()]
            self._merge(np.full(len(at), i), ids[at], np.array(score, np.int64))

    def _merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(self.best, (query, ids, score)))
        order = np.lexsort((ids, ~score, query))  # ~score falls as score rises
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        on = rank < self.k
        self.best = [query[on], ids[on], score[on]]
        full = rank == self.k - 1
        self.least[query[full]] = score[full]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", wave_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each query row.

    Components are floor(scale * x). Candidates are all rows but those of the
    query's own id; ties go to the smaller id; fewer than k candidates all come.
    Ids are whole numbers. Rows whose id is null, or whose vector is null or holds
    null or non-finite components, take no part; a query meets candidates of its
    own width only. Rows that repeat are candidates each, and one query. Scores
    beyond the range of long end at its bounds.
    """
    spark = vectors.sparkSession
    x = vectors[vector_col]
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(vectors[id_col].isNotNull() & x.isNotNull() & finite).select(vectors[id_col].cast("long").alias("id"), x.cast("array<double>").alias("v"), is_query.alias("asks"))
    queries = rows.filter("asks").select("id", "v")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    waves = max(1, math.ceil(n * 8 * max(1, width) * 2 / wave_bytes))
    schema, found = "query_id long, vec_id long, score long", None
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for wave in range(waves):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).dropDuplicates(["id"]).toArrow()  # about half of wave_bytes
        shared = spark.sparkContext.broadcast(_packed(part, scale))
        one = rows.select("id", "v").mapInArrow(lean(_search(shared, k, scale)), schema)
        one = one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if waves > 1:
            one = cut(one)
            shared.destroy()
        found = one if found is None else found.union(one)
    return found.select("query_id", "rank", "vec_id", "score")


def _packed(queries: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries of each width, by id."""
    queries = queries.sort_by("id").combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(queries["v"])).astype(np.int64)
    out = {}
    for w in np.unique(sizes).tolist():
        some = queries.filter(pa.array(sizes == w))
        ids, v = np.asarray(some["id"]), some["v"].combine_chunks()
        out[w] = (ids, _integers(v, scale) if w else np.zeros((len(ids), 0)))
    return out


def _search(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {w: Search(ids, vs, k) for w, (ids, vs) in shared.value.items()}
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("v")))
            for w in np.unique(sizes):
                if int(w) not in searches:
                    continue
                part = batch.filter(pa.array(sizes == w))
                for s in range(0, part.num_rows, CANDIDATES):
                    some = part.slice(s, CANDIDATES)
                    searches[int(w)].add(np.asarray(some.column("id")), _integers(some.column("v"), scale) if w else np.zeros((some.num_rows, 0)))
        for s in searches.values():
            query, ids, score = s.best
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[query]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
