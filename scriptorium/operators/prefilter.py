"""Bitmap prefilter: rows that certainly have no partner skip a join.

The keys of the small side are hashed to bits of one bitmap.  A row whose bit
is not set has no partner for sure; it needs no join, so it is not shuffled.
Rows whose bit is set may have one (or share a bit with another key) and are
joined exactly.  The bitmap has a fixed size, so it can always be broadcast;
with many more keys than bits it lets every row through to the join, which
stays right and only saves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_PAGE = 32768  # bits of one bitmap value


def _bit(key, bits: int) -> Column:
    """1 .. bits, from the key's hash."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def key_bitmap(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``_page``, ``_bits`` of the distinct non-NULL keys: at most ``bits`` / 32768 rows of 4 KB."""
    hashed = keys.where(F.col(key).isNotNull()).select(_bit(F.col(key), bits).alias("_h"))
    return hashed.groupBy(F.bitmap_bucket_number("_h").alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))


def with_may_match(rows: DataFrame, bitmap: DataFrame, key: str, bits: int = BITS,
                   name: str = "_may_match") -> DataFrame:
    """``rows`` plus a boolean: false where ``key`` is certainly not among the bitmap's keys.

    The broadcast is bounded by ``bits``: ``bits`` / 8 bytes whatever the input."""
    bit = _bit(F.col(key), bits)
    page = F.when(F.col(key).isNotNull(), F.bitmap_bucket_number(bit))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (rows.join(F.broadcast(bitmap), page == F.col("_page"), "left")
            .select(*[F.col(f"`{c}`") for c in rows.columns], found.alias(name)))


def anti_join(rows: DataFrame, others: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` without a partner in ``others`` (NULL equals NULL in ``on``).

    Rows whose bit is not set pass at once, with all their columns where they
    are; only the others take part in the exact join."""
    probe, place = "_prefilter_key", "_prefilter_may"
    hashed = others.select(*[F.col(c).alias(f"_other_{c}") for c in on], F.xxhash64(*on).alias(probe)).distinct()
    told = with_may_match(rows.withColumn(probe, F.xxhash64(*on)), key_bitmap(hashed, probe, bits), probe, bits, place)
    sure = told.where(~F.col(place)).drop(probe, place)
    maybe = told.where(F.col(place)).drop(place)
    same = maybe[probe] == hashed[probe]
    for c in on:
        same = same & maybe[c].eqNullSafe(hashed[f"_other_{c}"])
    return sure.unionByName(maybe.join(hashed, same, "left_anti").drop(probe))
