"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into row blocks of bounded size.  A block keeps, per
dimension, its rows sorted by that component.  A query walks all its lists in
parallel from their best end (descending for a positive weight, ascending for
a negative one), scores each row when it is first seen, and stops when the sum
of the weighted components at the current depth - no unseen row can score
more - is below its k-th best score.  Equal scores are not skipped, because
the smaller id wins ties.  Blocks meet blocks of queries, never single pairs;
each block returns at most k rows per query, and Spark ranks those.

Components are integers: ``floor(scale * x)`` in double precision.  Products
are summed exactly (in double precision while that is exact, in 64 bits, else
in unbounded integers; a score beyond 64 bits is cut to the largest).

Defined results: vectors that are NULL, empty or hold a NULL or a non-finite
component take no part, nor do rows without id; vectors of different length
are not compared.  Rows that repeat id and vector are one row.  Fewer than k
candidates: all of them.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, ship, written

ROW_BLOCK = 4096
QUERY_BLOCK = 16384
FIRST_DEPTH = 32  # list entries read before the bound is looked at; doubled each time


class Lists:
    """A block's rows with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.order = np.argsort(-self.x, axis=0, kind="stable")  # column d: rows by component d, largest first
        self.sorted = np.take_along_axis(self.x, self.order, 0)
        self.peak = float(np.abs(x).max(initial=0))

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows but ``own`` (score down, id up)."""
        n, d = self.x.shape
        exact = self._numbers(q)
        weight = q.astype(exact)
        rows = self.x.astype(exact, copy=False)
        dims = np.flatnonzero(q)
        down, up = dims[q[dims] > 0], dims[q[dims] < 0]
        seen = np.zeros(n, bool)
        best, score = np.empty(0, np.int64), np.empty(0, exact)
        at, step = 0, FIRST_DEPTH
        while at < n:
            stop = min(n, at + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[at:stop, down]] = True
            fresh[self.order[n - stop:n - at, up]] = True
            if not len(dims):
                fresh[:] = True  # the zero query: every score is 0
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh & (self.ids != own))
            if len(new):
                best = np.concatenate((best, new))
                score = np.concatenate((score, rows[new] @ weight))
                keep = np.lexsort((self.ids[best], -score))[:k] if exact != object else \
                    np.array(sorted(range(len(best)), key=lambda i: (-score[i], self.ids[best[i]]))[:k], int)
                best, score = best[keep], score[keep]
            at, step = stop, step * 2
            if at < n and len(best) == k:
                bound = (weight[down] @ self.sorted[at - 1, down].astype(exact)
                         + weight[up] @ self.sorted[n - at, up].astype(exact))
                if bound < score[-1]:
                    break
        return best, score

    def _numbers(self, q: np.ndarray):
        most = self.peak * float(np.abs(q).max(initial=0)) * max(1, len(q))
        return np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 62 and self.x.dtype != object else object


def _integers(rows: list, dims: int, scale: float) -> np.ndarray:
    x = np.floor(scale * np.asarray(rows, np.float64).reshape(len(rows), dims))
    if np.abs(x).max(initial=0) < 2 ** 62:
        return x.astype(np.int64)
    return np.array([[int(v) if np.isfinite(v) else (1 << 1100) * (1 if v > 0 else -1) for v in r] for r in x],
                    object).reshape(len(rows), dims)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec: str = "embedding",
          scale: float = 256.0, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the rows where ``is_query``
    (a condition on the id column, called ``id``)."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vec).cast("array<double>")
    fit = (F.col(id_col).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False))
           & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    rows = written(vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
                   .distinct().select("id", "v", F.size("v").alias("dims")), "vectors")
    row_blocks = blocks_of(rows.count(), row_block)
    query_blocks = blocks_of(rows.where(is_query).count(), query_block)
    cell = ["dims", "rb", "qb"]
    numbered = rows.withColumn("h", F.xxhash64("id", "v"))
    data = numbered.select(
        "dims", F.pmod("h", F.lit(row_blocks)).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(0).alias("part"), "id", "v")
    asked = numbered.where(is_query).select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
        F.pmod("h", F.lit(query_blocks)).cast("int").alias("qb"), F.lit(1).alias("part"), "id", "v")
    met = (data.unionByName(asked).repartition(*cell)
           .sortWithinPartitions(*cell, "part"))  # a block's rows come before its queries

    def run(batches):
        current, ids, parts, lists = None, [], [], None
        for pdf in batches:
            out = []
            for dims, rb, qb, part, i, vector in zip(*(pdf[c] for c in (*cell, "part", "id", "v"))):
                if (dims, rb, qb) != current:
                    current, ids, parts, lists = (dims, rb, qb), [], [], None
                if part == 0:
                    ids.append(i)
                    parts.append(vector)
                    continue
                if lists is None and ids:
                    lists = Lists(np.array(ids, np.int64), _integers(parts, dims, scale))
                    parts = []
                if lists is not None:
                    q = _integers([vector], dims, scale)[0]
                    best, score = lists.top(i, q, k)
                    limit = (1 << 63) - 1
                    out += [(i, vector.tobytes(), int(lists.ids[b]), max(-limit, min(limit, int(s))))
                            for b, s in zip(best, score)]
            yield pd.DataFrame(out, columns=["query_id", "asked", "vec_id", "score"]).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "int64"})

    found = met.mapInPandas(run, "query_id long, asked binary, vec_id long, score long")
    w = Window.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
