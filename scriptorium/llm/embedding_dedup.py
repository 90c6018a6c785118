"""Near-duplicate embeddings: cross-polytope codes after fast Hadamard
rotations, multiprobe buckets, verified pairs.

1. Vectors that are equal in every component are one class; its size counts,
   its least id goes on.  Copies of any number cost one row from here.
2. Each class gets, per table, the code of its own bucket and of ``probes``
   neighbouring buckets.
3. Buckets with one member are left out on ids alone, before any vector moves.
4. The members of a shared bucket are dealt into blocks of about ``BLOCK``;
   every pair of blocks is one small task unit, so a bucket of any size is
   spread over the cluster.  A unit computes cosines in double precision.  It
   returns counts of links per vector and a spanning forest of its links,
   never the pairs.  A pair that shares several buckets is counted in the
   first of them only (both codes travel with the vectors, in 32 bits where
   they fit; vectors in the input's own type).
5. Links joined into components give ``component_id``.

``depth`` (axes per code) grows with the number of vectors so that unrelated
vectors rarely share a bucket, and tables and probes grow with it to keep
recall: see ``shape``.  At 64 dimensions all pairs of cosine 0.951 drawn at
random were found by each of these shapes (``tests/llm``).

Defined results: vectors that are NULL, empty, zero, or hold a NULL or a
non-finite component link with nothing.  Vectors of different length do not
link.  Rows without id link with nothing (``component_id`` NULL, kept).  Rows
that repeat id and vector are one vector.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cross_polytope as cp
from .common import components, ship, slices, whole_runs, written

BLOCK = 1024
_PAIRS = 50_000  # linked pairs whose codes are compared at once
_ENTRIES = 2_000_000  # components of the runs that a unit holds, but for its last run


def shape(rows: int, dims: int) -> tuple[int, int, int]:
    """(tables, depth, probes): codes of ``depth`` axes out of 2 * dims, as
    many as give each vector a bucket of its own, at least three."""
    axes = cp.axes(dims)
    depth = 3
    while axes ** depth < rows and (depth + 1) * np.log2(axes) < 62:
        depth += 1
    return 8 + 4 * (depth - 3), depth, 4 + 2 * (depth - 3)


def usable(vec) -> F.Column:
    """Not NULL, not empty, all components finite, not all zero."""
    v = F.col(vec).cast("array<double>")
    return (F.coalesce(F.size(v) > 0, F.lit(False))
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def _classes(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, ok, vector (normal zeros): the input's rows."""
    own = vectors.select(vec).schema[0].dataType
    kind = "float" if isinstance(own, T.ArrayType) and own.elementType == T.FloatType() else "double"
    plain = F.transform(F.col(vec).cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind))  # -0.0 becomes 0.0
    return vectors.select(F.col(id_col).cast("long").alias("id"),
                          (usable(vec) & F.col(id_col).isNotNull()).alias("ok"), plain.alias("vector"))


def _buckets(classes: DataFrame, tables: int, depth: int, probes: int, kind: str) -> DataFrame:
    """rep, copies, vector, codes (tables x (1 + probes), row by row)."""
    def run(batches):
        for pdf in slices(batches):
            sizes = pdf["vector"].map(len)
            codes = np.empty(len(pdf), object)
            for d in sizes.unique():
                at = np.flatnonzero(sizes == d)
                x = cp.unit_rows(np.stack(pdf["vector"].iloc[at].tolist()), int(d))
                c = cp.codes(x, tables, depth, probes).reshape(len(at), -1).astype(np.int32 if kind == "int" else np.int64)
                for k, i in enumerate(at):
                    codes[i] = c[k]
            yield pdf.assign(codes=codes)

    own = classes.schema["vector"].dataType.simpleString()
    return classes.mapInPandas(run, f"rep long, copies long, vector {own}, codes array<{kind}>")


class _Unit:
    """Counts and forest of the linked pairs of some rows, pair by pair only
    where rows are linked."""

    def __init__(self, pdf: pd.DataFrame, tables: int, width: int, least: float):
        self.x = cp.unit_rows(np.stack(pdf["vector"].tolist()), len(pdf["vector"].iat[0]))
        self.codes = np.stack(pdf["codes"].tolist()).reshape(len(pdf), tables, width)
        self.block, self.lo, self.hi, self.table, self.bucket, self.ids, self.copies = (
            pdf[c].to_numpy() for c in ("block", "lo", "hi", "table", "bucket", "rep", "copies"))
        self.least, self.count, self.root = least, np.zeros(len(pdf), np.int64), {}

    def pairs_of_two(self, first: np.ndarray) -> None:
        """Runs of two rows, all at once."""
        i, j = first, first + 1
        meet = (self.block[i] == self.lo[i]) & (self.block[j] == self.hi[i]) \
            | (self.block[j] == self.lo[i]) & (self.block[i] == self.hi[i])
        close = meet & (np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.least)
        self.link(i[close], j[close])

    def pairs_of_run(self, at: int, stop: int) -> None:
        """A longer run: one matrix of cosines."""
        block, lo, hi = self.block[at:stop], self.lo[at], self.hi[at]
        left, right = at + np.flatnonzero(block == lo), at + np.flatnonzero(block == hi)
        close = self.x[left] @ self.x[right].T >= self.least
        if lo == hi:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        self.link(left[i], right[j])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count the pairs whose first shared bucket is this one."""
        for at in range(0, len(i), _PAIRS):
            a, b = i[at:at + _PAIRS], j[at:at + _PAIRS]
            left, right = self.codes[a], self.codes[b]
            same = left[:, :, :, None] == right[:, :, None, :]
            first = same.any((2, 3)).argmax(1)
            pair = np.arange(len(a))
            met = np.where(same[pair, first], left[pair, first][:, :, None], np.iinfo(left.dtype).max).min((1, 2))
            mine = (first == self.table[a]) & (met == self.bucket[a])
            a, b = a[mine], b[mine]
            np.add.at(self.count, a, self.copies[b])
            np.add.at(self.count, b, self.copies[a])
            for p, q in zip(self.ids[a].tolist(), self.ids[b].tolist()):
                p, q = self.find(p), self.find(q)
                if p != q:
                    self.root[max(p, q)] = min(p, q)

    def find(self, i: int) -> int:
        while (up := self.root.get(i, i)) != i:
            self.root[i] = self.root.get(up, up)
            i = up
        return i

    def rows(self) -> pd.DataFrame | None:
        out = [(int(self.ids[k]), None, int(self.count[k])) for k in np.flatnonzero(self.count)]
        out += [(i, self.find(i), None) for i in list(self.root) if self.find(i) != i]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("Int64") if out else None


def _links(cells: DataFrame, tables: int, width: int, least: float) -> DataFrame:
    """a, b, n: counts (b NULL) and forest edges (n NULL) of sorted cells.  Each
    linked pair is taken up in one cell only, so the forests join all links."""
    entries = _ENTRIES

    def run(batches):
        for pdf, starts in whole_runs(batches, ["table", "bucket", "dims", "lo", "hi"]):
            for dims in pdf["dims"].unique():
                rows = np.flatnonzero(pdf["dims"] == dims)
                own = np.searchsorted(rows, starts[np.isin(starts, rows)])
                size = np.diff(np.append(own, len(rows)))
                # runs side by side while their vectors stay below _ENTRIES
                for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own * int(dims) // entries)) + 1):
                    at, n = own[part] - own[part[0]], size[part]
                    unit = _Unit(pdf.iloc[rows[own[part[0]]:own[part[0]] + n.sum()]], tables, width, least)
                    unit.pairs_of_two(at[n == 2])
                    for k in np.flatnonzero(n > 2):
                        unit.pairs_of_run(at[k], at[k] + n[k])
                    out = unit.rows()
                    if out is not None:
                        yield out

    return cells.mapInPandas(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                    least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    ship(vectors.sparkSession)
    rows = _classes(vectors, id_col, vec)
    usable_rows = rows.where("ok").select("id", "vector").distinct()
    # A class is named by a 128-bit digest of its components.
    keyed = usable_rows.withColumn("key", F.md5(F.to_json(F.struct("vector")).cast("binary")))
    members = written(keyed.select("id", "key"), "members")
    classes = written(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                               F.first("vector").alias("vector")), "classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    tables, depth, probes = shape(size["n"], size["d"] or 1)
    width = 1 + probes
    kind = "int" if cp.axes(size["d"] or 1) ** depth < 2 ** 31 else "bigint"
    coded = written(_buckets(classes.select("rep", "copies", "vector"), tables, depth, probes, kind), "codes")

    spots = coded.select("rep", F.size("vector").alias("dims"), F.posexplode("codes").alias("at", "bucket")).select(
        "rep", "dims", F.floor(F.col("at") / width).cast("int").alias("table"), "bucket").distinct()
    key = ["table", "bucket", "dims"]
    shared = spots.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
                                     F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    dealt = spots.join(shared, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", each).select(
        *key, "rep", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    order = [*key, "lo", "hi"]
    cells = (dealt.join(coded, "rep").select(*order, "block", "rep", "copies", "vector", "codes")
             .repartition(*order).sortWithinPartitions(*order))
    found = written(_links(cells, tables, width, least), "links")

    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("near"))
    labels = components(found.where("b is not null"))
    named = (classes.select("key", "rep", "copies").join(counts, F.col("rep") == F.col("a"), "left")
             .join(labels, F.col("rep") == F.col("node"), "left")
             .select("key", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    # An id that repeats with several vectors has the links of all and the least component.
    by_id = (members.join(named, "key").groupBy(F.col("id").alias("_id"))
             .agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    out = rows.select("id", "ok").join(by_id, (F.col("id") == F.col("_id")) & F.col("ok"), "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"))
