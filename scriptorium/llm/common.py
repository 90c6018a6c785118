"""Helpers shared by the operators: tables, written intermediates, components, worker memories."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship

__all__ = ["begin", "blocks_of", "components", "remembers", "runs", "ship", "slices", "table", "whole_runs", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared scratch folder and read
    back: the lineage ends here, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_of(rows: int, size: int) -> int:
    """Number of blocks of about ``size`` rows, at least one."""
    return max(1, -(-int(rows) // size))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node reachable over ``edges`` (undirected),
    for every node that has an edge to another node.

    Rounds of: take the least label among the neighbours, then follow labels
    twice (pointer jumping), until no label changes.  A round is an equi-join
    and a ``min`` that combines map-side, so a hub with millions of edges is
    an ordinary skewed join key, which adaptive execution splits.  Every round
    is written; only the number of changed labels reaches the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = written(e.union(e.select("v", "u")).distinct(), "edges")
    labels = written(e.groupBy("u").agg(F.least("u", F.min("v")).alias("label"))
                     .withColumnRenamed("u", "node"), "labels")
    while True:
        near = (e.join(labels, e["v"] == labels["node"])
                .groupBy("u").agg(F.min("label").alias("near")))
        step = (labels.join(near, labels["node"] == near["u"], "left")
                .select("node", F.col("label").alias("old"),
                        F.least("label", F.coalesce("near", "label")).alias("label")))
        step = written(step, "labels")
        up = step.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = (step.join(up, step["label"] == up["_n"], "left")
                  .select("node", "old", F.least("label", F.coalesce("_up", "label")).alias("label")))
        jumped = written(jumped, "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


_memories: list[tuple[str, Callable[[], None]]] = []
_holder: str | None = None


def remembers(holder: str, clear: Callable[[], None]) -> None:
    """A module's memory in a Python worker, and how to empty it."""
    _memories.append((holder, clear))


def begin(holder: str) -> None:
    """Called by every task's function first.  Spark uses its Python workers
    again for later stages; what an earlier stage's function remembered there
    is dropped when another one starts, so memories do not pile up."""
    global _holder
    if holder == _holder:
        return
    for owner, clear in _memories:
        if owner != holder:
            clear()
    _holder = holder
    gc.collect()
    import pyarrow
    pyarrow.default_memory_pool().release_unused()


def slices(batches, rows: int = 500):
    """Cut the pandas batches of a task into small ones, so that what is built
    for one slice stays small whatever the batch size is."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at:at + rows].reset_index(drop=True)


def runs(batches, keys: list[str]):
    """Rows of one key after another, as pandas frames, from the sorted
    batches of a task.  Only one key's rows (and a batch) are held."""
    import pandas as pd
    parts, current = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        starts = [*change.nonzero()[0].tolist(), len(pdf)]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(pdf[k].iat[lo] for k in keys)
            if key != current:
                if parts:
                    yield current, pd.concat(parts) if len(parts) > 1 else parts[0]
                parts, current = [], key
            parts.append(pdf.iloc[lo:hi])
    if parts:
        yield current, pd.concat(parts) if len(parts) > 1 else parts[0]


def whole_runs(batches, keys: list[str]):
    """(rows, starts) from the sorted batches of a task: pandas frames that hold
    whole runs of equal keys, and where each run starts.  For many short runs:
    they come a batch at a time.  A run that a batch cuts waits for the next."""
    import numpy as np
    import pandas as pd
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
        last = starts[-1]
        if last:
            yield pdf.iloc[:last].reset_index(drop=True), starts[:-1]
        rest = pdf.iloc[last:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), np.zeros(1, np.int64)
