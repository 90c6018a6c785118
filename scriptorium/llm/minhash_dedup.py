"""MinHash near-duplicates: one-permutation signatures with optimal
densification, banded buckets, star-shaped candidate edges, exact confirmation.

Steps (each intermediate is a written table, so nothing is computed twice and
a lost executor repeats only its own tasks):

1. One pass over the texts gives each document the size of its shingle set,
   a 128-bit key of the whole set and its band keys.
2. Documents with the same set key form a class (a ``min`` that combines
   map-side).  Only one document per class goes on, so a group of exact
   copies of any size costs one row.
3. Band keys are exploded into buckets.  Each bucket of two or more classes
   sends out a star: every member paired with one centre, never all pairs.
   The centre is the member that shares buckets with the most others, which
   in a group of near copies is the text the others were made from.
4. Pairs are confirmed on the full sets (``100 * inter >= percent * union``)
   and confirmed links joined into components.
5. A star can miss a link between two members that both differ from the
   centre.  So the members of every bucket that still spans several
   components are compared by signature: dealt into blocks, one pair of blocks
   per task unit, only pairs of different components whose estimated
   similarity comes within ``margin`` of the threshold (or one of whose sets is
   small, where the estimate says little) leave the unit, each
   from the first bucket it shares, and they are confirmed like the others.  A bucket of any size is spread over
   the cluster, none is cut short, and its pairs are never written out.

A pair at exactly 85 % shares a bucket with probability 1 - 3e-7; with sets of
64 shingles or more it comes 4.7 standard deviations above the least estimate
(512 parts, margin 0.075; 4.2 at 80 %).

Defined results: a NULL, empty or blank text has the empty set, links with
nothing and is kept.  A row without id takes no part in links
(``component_id`` NULL, kept).  Rows that repeat an id are one document.
Other columns of the input are not read.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import begin, components, runs, ship, slices, written

BANDS, ROWS = 32, 6
PARTS = 512  # of the signature that estimates similarity within a bucket
MARGIN = 0.075  # below the threshold, for those estimates: over four standard deviations at 80 %
SMALL = 64  # sets of fewer shingles are confirmed without an estimate
BLOCK = 512  # members of a bucket compared in one unit
STAR_BLOCK = 512  # members compared with one shipped copy of a centre's set


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = BANDS,
             rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (NULL for the empty set), bands."""
    def run(batches):
        begin("shingles")
        for pdf in slices(batches):
            with np.errstate(over="ignore"):
                sets = [sh.shingle_set(t) for t in pdf["text"]]
                full = [s for s in sets if len(s)]
                keys = iter(sh.band_hashes(sh.signatures(full, bands * rows), rows)) if full else iter(())
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [sh.set_key(s) if len(s) else None for s in sets],
                    "bands": [next(keys) if len(s) else None for s in sets]})

    # Ids pass pandas as text: a column of numbers with a NULL would become floating there.
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return (src.mapInPandas(run, "doc_id string, n_shingles long, set_key binary, bands array<long>")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def shingle_table(docs: DataFrame, ids: DataFrame, id_col: str, text: str, bands: int, rows: int) -> DataFrame:
    """doc, shingles (the whole set as uint64 bytes), signature (the low byte
    of each of ``PARTS`` parts), bands (int64 bytes) of ``ids``."""
    def run(batches):
        begin("shingles")
        for pdf in slices(batches):
            with np.errstate(over="ignore"):
                sets = [sh.shingle_set(t) for t in pdf["text"]]
                low = sh.signatures(sets, PARTS).astype(np.uint8)
                keys = sh.band_hashes(sh.signatures(sets, bands * rows), rows)
            yield pd.DataFrame({"doc": pdf["doc"], "shingles": [s.tobytes() for s in sets],
                                "signature": [r.tobytes() for r in low], "bands": [k.tobytes() for k in keys]})

    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return src.join(ids, "doc", "left_semi").mapInPandas(
        run, "doc long, shingles binary, signature binary, bands binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre, member) whose full sets are similar.

    A centre's members are dealt into blocks of about ``STAR_BLOCK``; each
    block gets the centre's set once and streams the members' sets past it.
    """
    pairs = written(pairs, "pairs")
    size = written(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).alias("blocks")), "stars")
    dealt = (pairs.join(size, "centre")
             .select("centre", "member", F.pmod(F.xxhash64("member"), F.col("blocks")).alias("block")))
    sets = sets.select("doc", "shingles")
    members = (dealt.join(sets, dealt["member"] == sets["doc"])
               .select("centre", "block", "member", "shingles"))
    heads = size.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    heads = (heads.join(sets, heads["centre"] == sets["doc"])
             .select("centre", "block", F.lit(0).cast("long").alias("member"), "shingles"))
    together = (heads.withColumn("head", F.lit(True)).unionByName(members.withColumn("head", F.lit(False)))
                .repartition("centre", "block").sortWithinPartitions("centre", "block", F.desc("head")))

    def run(batches):
        begin("shingles")
        head = None
        for pdf in batches:
            out = []
            for c, m, s, first in zip(pdf["centre"], pdf["member"], pdf["shingles"], pdf["head"]):
                s = np.frombuffer(s, np.uint64)
                if first:
                    head = s
                elif sh.similar(head, s, percent):
                    out.append((c, m))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return together.mapInPandas(run, "a long, b long")


def alike(cells: DataFrame, percent: int, margin: float) -> DataFrame:
    """Pairs (centre, member) of different components with similar signatures,
    from sorted cells (bucket, lo, hi)."""
    def run(batches):
        begin("shingles")
        for (bucket, lo, hi), pdf in runs(batches, ["bucket", "lo", "hi"]):
            sig = np.stack([np.frombuffer(s, np.uint8) for s in pdf["signature"]])
            keys = np.stack([np.frombuffer(s, np.int64) for s in pdf["bands"]])
            doc, comp = pdf["doc"].to_numpy(), pdf["component"].to_numpy()
            size, block = pdf["n_shingles"].to_numpy(), pdf["block"].to_numpy()
            right = np.flatnonzero(block == hi)
            least = (percent / 100 - margin) * sig.shape[1]
            a, b = [], []
            for i in np.flatnonzero(block == lo):
                others = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i])
                                                           >= percent * np.maximum(size[right], size[i]))]
                if lo == hi:
                    others = others[others > i]
                close = others[(np.minimum(size[others], size[i]) < SMALL) | ((sig[others] == sig[i]).sum(1) >= least)]
                close = close[keys[i][(keys[close] == keys[i]).argmax(1)] == bucket]
                a += np.minimum(doc[i], doc[close]).tolist()
                b += np.maximum(doc[i], doc[close]).tolist()
            if a:
                yield pd.DataFrame({"centre": a, "member": b})

    return cells.mapInPandas(run, "centre long, member long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85,
                    bands: int = BANDS, rows: int = ROWS, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    ship(docs.sparkSession)
    sketch = written(sketches(docs, id_col, text, bands, rows), "sketches")
    usable = sketch.where("set_key is not null and doc_id is not null")
    # Both sides of a join are plain tables wherever a key can be hot, so that
    # adaptive execution can split it.
    classes = written(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    of_class = written(usable.select("doc_id", "set_key").join(classes, "set_key")
                       .select("doc_id", "rep").distinct(), "members")
    # An id that repeats with another text is one document: it ties its classes together.
    first = of_class.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    same = written(of_class.join(first, "doc_id").select("a", F.col("rep").alias("b")), "links")

    # Buckets over one document per class.
    reps = sketch.join(classes.select("rep", F.col("set_key").alias("_key")),
                       (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("_key")), "left_semi")
    rows_ = reps.select(F.col("doc_id").alias("doc"), "n_shingles", F.explode("bands").alias("bucket")).distinct()
    shared = written(rows_.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    in_shared = written(rows_.join(shared, "bucket"), "buckets")
    weight = written(in_shared.groupBy("doc").agg(F.sum("size").alias("weight")), "weights")
    members = written(in_shared.join(weight, "doc")
                      .select("bucket", "doc", "n_shingles", "weight"), "buckets")
    sets = written(shingle_table(docs, weight.select("doc"), id_col, text, bands, rows), "sets")

    def can_link(a, b):  # the smaller set must reach percent of the larger one
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    centre = written(members.groupBy("bucket").agg(
        F.max(F.struct("weight", (-F.col("doc")).alias("neg"), "n_shingles")).alias("c")), "centres")
    stars = (members.join(centre, "bucket").where((F.col("doc") != -F.col("c.neg"))
                                                  & can_link(F.col("n_shingles"), F.col("c.n_shingles")))
             .select((-F.col("c.neg")).alias("centre"), F.col("doc").alias("member")).distinct())
    links = written(confirmed(stars, sets, percent), "links").unionByName(same)
    labels = components(links)
    placed = written(members.join(labels, members["doc"] == labels["node"], "left")
                     .select("bucket", "doc", "n_shingles", F.coalesce("component", "doc").alias("component")), "placed")
    open_ = written(placed.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        .where("least <> most").select("bucket", "blocks"), "open")
    dealt = placed.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = (dealt.join(sets.select(F.col("doc").alias("_doc"), "signature", "bands"), F.col("doc") == F.col("_doc"))
             .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     "block", "doc", "component", "n_shingles", "signature", "bands")
             .repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"))
    more = written(confirmed(alike(cells, percent, margin), sets, percent), "links")
    labels = components(links.unionByName(more))
    # rep is the least id of its class, so the least rep of a component is its least id.
    named = (of_class.join(labels, of_class["rep"] == labels["node"], "left")
             .groupBy(F.col("doc_id").alias("_id"))
             .agg(F.min(F.coalesce("component", "rep")).alias("_component")))
    out = sketch.join(named, sketch["doc_id"] == named["_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"),
                      (F.coalesce("_component", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
