"""Cross-site line removal by distinct-site spread.

A line that stands in documents of many sites is boilerplate: a licence, a
menu, a banner.  DataFrame functions only:

1. Lines (split at ``\\n``, white space trimmed) become 64-bit hashes, written
   once per document.  Each (line, site) is one row: this aggregation combines
   map-side and shrinks hot lines before the next shuffle.  A line that one text
   alone has is spared, on however many sites its copies stand: those are
   whole-text duplicates, for a dedup stage.
2. A HyperLogLog sketch of the sites per line, merged by aggregation, and the
   least document id that has the line.
3. Estimates clearly above or below the threshold decide at once; lines whose
   estimate lies within ``margin`` of it get an exact distinct count.
4. Boilerplate lines are removed everywhere but in the document with the least
   id that has them, so no line leaves the collection altogether.

Defined results: NULL and empty texts stay as they are; blank lines are never
boilerplate.  A NULL site is a site of its own.  Rows without id come last
when the first document of a line is chosen.  Repeated rows have the same
result.  An empty table gives an empty one.  Columns of the input are kept by
``remove_boilerplate``, whatever their names, but for two named like its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SITES = 10
MARGIN = 0.1  # over four standard errors of a sketch with 2**12 registers
LOG2_REGISTERS = 12
_LAST = (1 << 63) - 1
_SPACE = " \t\r\x0b\x0c"


def _line_hash(line):
    return F.xxhash64(F.trim(line, F.lit(_SPACE)))


def _hashed(docs: DataFrame, id_col: str, site: str, text: str) -> DataFrame:
    """id, site, text hash and the hashes of its lines (NULL for blank ones), per document."""
    return docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"),
        F.xxhash64(text).alias("text_hash"),
        F.transform(F.split(text, "\n"),
                    lambda x: F.when(F.trim(x, F.lit(_SPACE)) != "", _line_hash(x))).alias("hashes"))


def _lines(hashed: DataFrame) -> DataFrame:
    """One row per non-blank line: text hash, id, site, position, line hash."""
    return hashed.select("id", "site", "text_hash", F.posexplode_outer("hashes").alias("pos", "line")).where(
        "line is not null")


def _standing(lines: DataFrame) -> DataFrame:
    """line, site, first, and the least and the greatest text that has the line there."""
    return lines.groupBy("line", "site").agg(
        F.min("id").alias("first"), F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """line, first (the least id that has it) of lines of several texts on ``min_sites`` sites or more."""
    spread = _standing(lines).groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LOG2_REGISTERS)).alias("sketch"), F.min("first").alias("first"),
        (F.min("least") < F.max("most")).alias("several")).where("several")
    spread = written(spread.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
                     .where(F.col("sites") >= min_sites * (1 - margin)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("line", "first")
    exact = (lines.join(near.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites))
    return (spread.where(F.col("sites") > min_sites * (1 + margin)).select("line", "first")
            .unionByName(near.join(exact.select("line"), "line", "left_semi")))


def cleaned(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text",
            min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, whatever their names), the
    cleaned ``text``, ``lines`` and ``removed`` (how many the text has, how many went).

    Only positions travel: the flags of a document's lines are gathered by
    (id, hash of the text) and joined to the texts once; a document none of
    whose lines goes has no flags."""
    lines = _lines(written(_hashed(docs, id_col, site, text), "lines"))
    common = written(boilerplate(lines, min_sites, margin), "boilerplate")
    gone = (lines.join(common, "line").where("id <> first")
            .groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone")))
    # Sorted positions become one flag per line, so that a text of n lines takes n steps.
    flags = gone.select("id", "text_hash", F.array_sort("gone").alias("gone")).withColumn(
        "flags", F.expr("split(concat_ws('', transform(gone, (p, i) -> concat(repeat('0', p - "
                        "if(i = 0, 0, get(gone, i - 1) + 1)), '1'))), '')")).drop("gone")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
                        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"))
    joined = keyed.join(flags, ["id", "text_hash"], "left")
    whole = F.col(f"row.`{text}`")
    kept = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: F.coalesce(
        F.get(F.col("flags"), i) != "1", F.lit(True))), "\n")
    removed = F.coalesce(F.size(F.filter("flags", lambda x: x == "1")), F.lit(0))
    return joined.select(
        "row", F.when(F.col("flags").isNull(), whole).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.split(whole, "\n")), F.lit(0)).cast("long").alias("lines"),
        F.when(F.col("flags").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("removed"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text",
                       min_sites: int = MIN_SITES, margin: float = MARGIN, prefix: str = "_spread_") -> DataFrame:
    """All columns of ``docs`` (but those named like the results) with the
    cleaned text, plus ``<prefix>lines`` and ``<prefix>removed``."""
    results = (f"{prefix}lines", f"{prefix}removed")
    return cleaned(docs, id_col, site, text, min_sites, margin).select(
        *[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in results],
        F.col("lines").alias(results[0]), F.col("removed").alias(results[1]))
