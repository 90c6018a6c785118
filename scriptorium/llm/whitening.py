"""Whitening of embeddings with eigenvectors found by contour integration.

1. Each entry c becomes the integer x = floor(64 c) + 1000000.  One aggregation
   gives n and the sums S; a second one adds up the products of x - c0, with c0
   the integers next to S/n.  All sums are exact integers, so the covariance
   (divisor n) is the correctly rounded exact one.  A task adds up one D x D matrix
   whatever its rows; Spark adds up those of the tasks, row by row.
2. Inertia: the signs of the pivots of V - s I, in tridiagonal form, count the
   eigenvalues below s.  Counts place the ends of the search intervals
   in gaps of the spectrum, a bounded number of eigenvalues in each.
3. FEAST: for every interval, the quadrature of (z I - V)^-1 Y over the nodes of
   a circle through its ends projects Y onto the interval's eigenvectors;
   Rayleigh-Ritz on the projected basis gives values and vectors, which are the
   next Y, until the residuals stop falling.  The solves of all nodes of all
   intervals are independent tasks of one Spark job per iteration.
4. The inertia counts of the interval's ends must equal the number of Ritz
   values between them; else the subspace grows and the interval is repeated.
5. Every vector is projected where it lies; the covariance of the
   results is one more aggregation.

The driver and each solving task hold a few matrices of D x D, never rows.

Defined results: vectors that are NULL, empty, or hold NULL or non-finite
entries are dropped; so are vectors of another length than the most frequent
one (the shortest of equally frequent ones).  Only components whose eigenvalue
is positive to working precision are returned (constant or dependent
dimensions have none).  No remaining vector, or only equal ones: no rows.
Repeated rows count and are returned as often as they occur; ids may repeat or
be NULL.  Entries beyond 2**40, and deviations beyond a long, raise an error.
The input's other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, slices

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
NODES = 8  # quadrature nodes of the upper half circle
PER_INTERVAL = 12  # eigenvalues of one search interval, about
WIDE = 0.04  # gap below an interval, as part of its width, that is wide enough
ROUNDS = 40
_LARGEST = 2 ** 40


# --- sums over the rows ----------------------------------------------------

def integers(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part, all of one length."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                                                      & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(v, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))
    rows = embeddings.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"),
                                                                  x.alias("x"))
    length = (rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "d").first())
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
    if len(x) and np.abs(x - OFFSET).max() >= _LARGEST * SCALE:
        raise ArithmeticError("an entry is beyond 2**40")
    return x


def _added(rows: DataFrame, per_batch, dims: int, exact: bool):
    """Sum over all rows of ``per_batch(matrix)`` (k x dims): each task adds up
    its own, Spark adds up those of the tasks.  Integers stay exact: they
    travel and add up as decimals."""
    ship(rows.sparkSession)
    kind = "decimal(38,0)" if exact else "double"

    def run(batches):
        import decimal
        total = None
        for pdf in slices(batches, max(16, 1_000_000 // dims)):
            here = per_batch(_matrix(pdf))
            total = here if total is None else total + here
        if total is not None:
            number = (lambda v: decimal.Decimal(int(v))) if exact else float
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), dims), "j": np.tile(np.arange(dims), len(total)),
                                "v": [number(v) for v in total.ravel()]})

    sums = (rows.select("x").mapInPandas(run, f"i long, j long, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v"))
            .collect())
    k = 1 + max((r["i"] for r in sums), default=-1)
    out = np.zeros((k, dims), object if exact else float)
    for r in sums:
        out[r["i"], r["j"]] = int(r["v"]) if exact else r["v"]
    return out


def _products(x: np.ndarray) -> np.ndarray:
    """x' x of integers, exact: in doubles where every partial sum is below 2**53."""
    most = float(np.abs(x).max(initial=0))
    if most * most * len(x) < 2.0 ** 53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T @ x


def fit(rows: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """n, S and the covariance of the integer vectors; None without rows."""
    one = rows.limit(1).collect()
    if not one:
        return None
    dims = len(one[0]["x"])

    def sums(x):
        return np.stack([x.sum(0), np.full(dims, len(x))]).astype(object)

    total = _added(rows, sums, dims, exact=True)
    n, s = int(total[1, 0]), [int(v) for v in total[0]]
    near = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    m = _added(rows, lambda x: _products(x - near), dims, exact=True)
    off = [v - n * int(c) for v, c in zip(s, near)]  # n times the mean of x - c0
    v = np.array([[(n * int(m[i, j]) - off[i] * off[j]) / (n * n) for j in range(dims)] for i in range(dims)], float)
    return n, s, v


# --- spectrum --------------------------------------------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        sub = a[k + 1:, k:]
        sub -= 2 * np.outer(x, x @ sub)
        sub = a[k:, k + 1:]
        sub -= 2 * np.outer(sub @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of T - s I."""
    shifts = np.atleast_1d(np.asarray(shifts, float))
    tiny = np.finfo(float).eps * max(1e-300, np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0))
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - e * e / pivot
        below += pivot < 0
    return below


def _eigenvalues(counts, ranks: np.ndarray, low: float, high: float) -> np.ndarray:
    """Eigenvalues of the given ranks from below (from 1), roughly, by halving on the counts."""
    lo, hi = np.full(len(ranks), low), np.full(len(ranks), high)
    for _ in range(48):
        mid = (lo + hi) / 2
        above = counts(mid) >= ranks
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return (lo + hi) / 2


def intervals(v: np.ndarray, wanted: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) from the top down, holding the
    ``wanted`` largest positive eigenvalues.

    An interval takes as many eigenvalues as it can (about ``per_interval``)
    with a gap below them that is wide beside its own width, as the quadrature
    tells apart what stands apart on the scale of its circle."""
    diagonal, off = tridiagonal(v)
    counts = lambda s: inertia(diagonal, off, s)
    size = len(v)
    top = float(np.abs(v).sum(1).max()) * 1.01
    floor = top * size * np.finfo(float).eps * 4
    zeros = int(counts(floor)[0])
    wanted = min(wanted, size - zeros)
    out: list[tuple[float, float, int]] = []
    above, done = top, 0
    while done < wanted:
        left = size - zeros - done  # positive eigenvalues that no interval holds yet
        most = min(per_interval, left)
        while True:
            ranks = np.arange(1, min(most + 4, left) + 1)
            values = _eigenvalues(counts, size - done - ranks + 1, floor, above)
            below = np.append(values[1:], 0.0 if len(ranks) == left else values[-1])
            apart = (values - below) / np.maximum(values[0] - below, top * 1e-300)
            if apart.max() > 1e-7 or len(ranks) == left:
                break
            most *= 2  # one cluster: look further down
        wide = np.flatnonzero(apart >= WIDE)
        cut = int(wide[-1]) if len(wide) else int(apart.argmax())
        low = (values[cut] + below[cut]) / 2
        high = min(above, values[0] + (values[0] - low) / 2)
        if int(counts(high)[0]) != size - done:
            high = above
        number = size - done - int(counts(low)[0])
        out.append((float(low), float(high), number))
        done += number
        above = low
    return out


# --- contour integration ---------------------------------------------------

def _quadrature(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles on the upper half circle and weights (Gauss-Legendre)."""
    t, w = np.polynomial.legendre.leggauss(nodes)
    return np.pi * (1 - t) / 2, w / 2


def _solve(v: np.ndarray, low: float, high: float, angle: float, weight: float, y: np.ndarray) -> np.ndarray:
    """One node's share of the projection of Y: the other half circle is its conjugate."""
    radius, turn = (high - low) / 2, np.exp(1j * angle)
    z = (high + low) / 2 + radius * turn
    return weight * np.real(radius * turn * np.linalg.solve(z * np.eye(len(v)) - v, y.astype(complex)))


def _solved(spark: SparkSession, v: np.ndarray, work: list[tuple[float, float, np.ndarray]], nodes: int):
    """Projections of all Y, every (interval, node) solved in a task of its own."""
    angles, weights = _quadrature(nodes)
    shared = spark.sparkContext.broadcast((v, work))

    def run(batches):
        matrix, jobs = shared.value
        for pdf in batches:
            for job, node in zip(pdf["job"].tolist(), pdf["node"].tolist()):
                low, high, y = jobs[job]
                part = _solve(matrix, low, high, angles[node], weights[node], y)
                yield pd.DataFrame({"job": job, "node": node, "column": np.arange(part.shape[1]), "v": list(part.T)})

    tasks = len(work) * nodes
    grid = spark.range(0, tasks, 1, min(tasks, 2 * spark.sparkContext.defaultParallelism)).select(
        F.floor(F.col("id") / nodes).cast("long").alias("job"), (F.col("id") % nodes).alias("node"))
    out = [np.zeros_like(y) for _, _, y in work]
    rows = grid.mapInPandas(run, "job long, node long, column long, v array<double>").collect()
    for r in sorted(rows, key=lambda r: (r["job"], r["node"], r["column"])):
        out[r["job"]][:, r["column"]] += r["v"]
    shared.unpersist()
    return out


def feast(spark: SparkSession, v: np.ndarray, wanted: int, nodes: int = NODES,
          per_interval: int = PER_INTERVAL) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues (falling) and their unit vectors (columns)."""
    size = len(v)
    scale = float(np.abs(v).sum(1).max(initial=0))
    if scale == 0:
        return np.empty(0), np.empty((size, 0))
    random = np.random.default_rng(size)
    todo = [{"low": low, "high": high, "count": m, "y": random.standard_normal((size, min(size, m + m // 2 + 4))),
             "worst": np.inf, "left": ROUNDS} for low, high, m in intervals(v, wanted, per_interval)]
    done = []
    while todo:
        projected = _solved(spark, v, [(t["low"], t["high"], t["y"]) for t in todo], nodes)
        again = []
        for t, q in zip(todo, projected):
            basis, _ = np.linalg.qr(q)
            basis, _ = np.linalg.qr(basis)
            values, rotation = np.linalg.eigh(basis.T @ v @ basis)  # Rayleigh-Ritz
            vectors = basis @ rotation
            inside = (values > t["low"]) & (values <= t["high"])
            found = vectors[:, inside]
            residual = np.abs(v @ found - found * values[inside]).max(initial=0) / scale
            complete = int(inside.sum()) == t["count"]
            if complete and (residual < 1e-15 or (residual < 1e-12 and residual > t["worst"] / 2)):
                done.append((values[inside], found))
                continue
            t["left"] -= 1
            if t["left"] == 0:
                if complete and residual < 1e-10:
                    done.append((values[inside], found))
                    continue
                raise ArithmeticError("the contour integration found other eigenvalues than inertia counts")
            t["worst"], t["y"] = (residual if complete else np.inf), vectors
            if t["left"] % 5 == 0 and vectors.shape[1] < size:  # slow, or some missed: a larger subspace
                more = min(size - vectors.shape[1], t["count"] + 4)
                t["y"] = np.concatenate([vectors, random.standard_normal((size, more))], axis=1)
            again.append(t)
        todo = again
    if not done:
        return np.empty(0), np.empty((size, 0))
    # Rayleigh-Ritz once more over all intervals: exact orthogonality, one order.
    basis, _ = np.linalg.qr(np.concatenate([f for _, f in done], axis=1))
    values, rotation = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values)[:wanted]
    return values[order], basis @ rotation[:, order]


# --- whitening -------------------------------------------------------------

def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = integers(embeddings, id_col, vector)
    schema = T.StructType([T.StructField("vec_id", T.StringType()), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    none = spark.createDataFrame([], schema).withColumn("vec_id", F.col("vec_id").cast("long"))
    fitted = fit(rows)
    if fitted is None:
        return none
    n, s, v = fitted
    values, vectors = feast(spark, v, components)
    k = len(values)
    if not k:
        return none
    explained = values / np.trace(v)
    filters = vectors / np.sqrt(values)
    sums = np.array(s, object)

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if n * float(np.abs(x).max()) < 2.0 ** 62:
            return n * x - sums.astype(np.int64)
        return n * x.astype(object) - sums

    def projected(d: np.ndarray) -> np.ndarray:
        return (d.astype(float) / n) @ filters

    def moments(x):
        w = projected(centred(x))
        return np.concatenate([w.T @ w, w.sum(0)[None, :]])

    total = _added(rows, moments, k, exact=False) / n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def run(batches):
        for pdf in slices(batches, max(16, 200_000 // len(s))):
            d = centred(_matrix(pdf))
            most = float(np.abs(d.astype(float)).max())
            exact = d if d.shape[1] * most * most < 2.0 ** 62 else d.astype(object)
            deviation = (exact * exact).sum(1)
            if any(int(x) >= 2 ** 63 for x in deviation):
                raise ArithmeticError("a deviation is beyond a long")
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), len(pdf)),
                "n": n, "deviation": np.repeat(deviation.astype(np.int64), k), "whitened": projected(d).ravel(),
                "explained": np.tile(explained, len(pdf)), "identity_error": error})

    # Ids pass pandas as text: a column of numbers with a NULL would become floating there.
    named = rows.withColumn("vec_id", F.col("vec_id").cast("string"))
    return named.mapInPandas(run, schema).withColumn("vec_id", F.col("vec_id").cast("long"))
