"""Joins: skipping processed inputs, one input per key, pairing papers.  No
hints and no size checks: Spark's own size limit and adaptive execution choose
the strategy.  Wide rows that certainly have no partner skip a join altogether
(see ``prefilter``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefilter import BITS, anti_join


def skip_processed(files: DataFrame, done: DataFrame | None, key: str = "stem", bits: int = BITS) -> DataFrame:
    """Inputs whose key has no output yet; ``done=None`` (no output
    location) keeps every input, as the original does.  An input without key
    is never done.

    A bitmap of the done keys (``bits`` bits) lets every input that is
    certainly new pass without a shuffle; the others meet the done keys in an
    exact anti join, of which ``distinct`` keeps one row per key.
    """
    if done is None:
        return files
    return anti_join(files, done.select(key).where(F.col(key).isNotNull()), [key], bits)


def first_per_key(files: DataFrame, key: str = "stem", order: str = "paper_name", row: str = "doc_id",
                  bits: int = BITS) -> DataFrame:
    """One input per key within a run: the first by ``order`` (then ``row``).
    The others would find its output and be skipped, as in the original.

    A pass over the three key columns finds the inputs that lose, which are
    few; those are taken out, and all other rows, with their texts, stay where
    they are.  Rows equal in all three columns are all first."""
    keys = files.select(key, order, row)
    first = keys.groupBy(F.col(key).alias("_k")).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(row).alias("r"))).alias("_f"),
        F.max(F.struct(F.col(order).alias("o"), F.col(row).alias("r"))).alias("_l")).where(
        ~F.col("_f").eqNullSafe(F.col("_l"))).select("_k", "_f")
    losing = keys.join(first, keys[key].eqNullSafe(first["_k"])).where(
        ~(F.col(order).eqNullSafe(F.col("_f.o")) & F.col(row).eqNullSafe(F.col("_f.r")))).select(key, order, row)
    return anti_join(files, losing, [key, order, row], bits)


def pair_papers(pairs: DataFrame, docs: DataFrame, a: str = "a_id", b: str = "b_id",
                key: str = "doc_id", text: str = "text", on: list[str] | None = None,
                keep_missing: bool = False) -> DataFrame:
    """Attach both texts to each requested pair (a_id, b_id).

    ``keep_missing`` keeps a pair whose paper is not in ``docs`` with a NULL
    text instead of leaving it out.

    Pairs are given, never enumerated: no all-pairs blow-up.  Two equi-joins
    against the documents; a paper in very many pairs is a skewed join key,
    which AQE's skew-join splitting handles.  ``on`` adds columns both papers must share.
    """
    on = on or []
    d = docs.select(key, text, *on)
    da, db = d.alias("_pa"), d.alias("_pb")
    p = pairs.alias("_pairs")
    first = p.join(da, [F.col(f"_pairs.{a}") == F.col(f"_pa.{key}")]
                   + [F.col(f"_pairs.{c}") == F.col(f"_pa.{c}") for c in on], "left" if keep_missing else "inner")
    both = first.join(db, [F.col(f"_pairs.{b}") == F.col(f"_pb.{key}")]
                      + [F.col(f"_pairs.{c}") == F.col(f"_pb.{c}") for c in on], "left" if keep_missing else "inner")
    return both.select(F.col(f"_pairs.{a}").alias(a), F.col(f"_pairs.{b}").alias(b),
                       *[F.col(f"_pairs.{c}").alias(c) for c in on],
                       F.col(f"_pa.{text}").alias("a_text"), F.col(f"_pb.{text}").alias("b_text"))
