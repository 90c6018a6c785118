"""Chunking: fixed windows and the section-aware chunker.

A document is one row; its chunks are an array built inside the row and
exploded at the end, so chunking has no shuffle.  ``total_chunks`` comes from
the array size before the explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import col_of, compute_once, explode_array, let, token_estimate
from .sections import cascade_array

def chunk_geometry(chunk_size: int) -> tuple[int, int, int]:
    """(chars per chunk, overlap, step) for a chunk size in tokens."""
    cpc = chunk_size * fixed.CHARS_PER_TOKEN
    overlap = min(fixed.MAX_OVERLAP, cpc // 10)
    return cpc, overlap, cpc - overlap


def _windows(text: Column, size: int, step: int, section: Column, numbered: bool) -> Column:
    """array<struct<text, section, chunk_part>> of windows at 0, step, ... < len."""
    n = F.length(text)
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)),
        lambda o: F.struct(
            F.substring(text, o + 1, F.lit(size)).alias("text"),
            section.alias("section"),
            (F.floor(o / F.lit(step)) + 1).cast("string").alias("chunk_part") if numbered
            else F.lit(None).cast("string").alias("chunk_part")))


def window_chunks(df: DataFrame, size: int, overlap: int, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Overlapping fixed windows: (key, part, offset, text), part from 1."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    t = col_of(text)
    offsets = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    staged = df.select(key, t.alias("_t"), offsets.alias("_o"))
    return (explode_array(staged, F.col("_o"), [key, "_t"], pos="_i", item="offset")
            .select(key, (F.col("_i") + 1).alias("part"), F.col("offset").cast("bigint"),
                    F.substring("_t", F.col("offset") + 1, F.lit(size)).alias("text")))


def ordered_sections(text: Column, chunk_size: int) -> Column:
    """Cascade sections in chunk order: abstract then conclusion when each
    fits in one chunk, then the others in cascade order."""
    cpc, _, _ = chunk_geometry(chunk_size)

    def body(secs):
        small = lambda s, name: (s["section"] == F.lit(name)) & (F.length(s["text"]) <= cpc)
        first = F.filter(secs, lambda s: small(s, "abstract"))
        second = F.filter(secs, lambda s: small(s, "conclusion"))
        rest = F.filter(secs, lambda s: ~(small(s, "abstract") | small(s, "conclusion")))
        return F.concat(first, second, rest)

    return let(cascade_array(text), body)


def chunk_array(text, chunk_size: int = fixed.DEFAULT_CHUNK_SIZE) -> Column:
    """array<struct<text, section, chunk_part>> of a document's chunks.

    Short texts (estimated tokens <= chunk_size) are one chunk without
    section; others are split by cascade sections, long sections into
    overlapping windows numbered from 1.
    """
    return let(col_of(text), lambda t: _chunk_array(t, chunk_size))


def _chunk_array(t: Column, chunk_size: int) -> Column:
    cpc, _, step = chunk_geometry(chunk_size)
    single = F.array(F.struct(t.alias("text"), F.lit(None).cast("string").alias("section"),
                              F.lit(None).cast("string").alias("chunk_part")))
    pieces = F.flatten(F.transform(ordered_sections(t, chunk_size), lambda s: F.when(
        F.length(s["text"]) <= cpc,
        F.array(F.struct(s["text"].alias("text"), s["section"].alias("section"),
                         F.lit(None).cast("string").alias("chunk_part"))))
        .otherwise(_windows(s["text"], cpc, step, s["section"], True))))
    return F.when(token_estimate(t) <= chunk_size, single).otherwise(pieces)


def split_chunks(df: DataFrame, chunk_size: int = fixed.DEFAULT_CHUNK_SIZE, key: str = "doc_id",
                 text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: (key, chunk_index, text, section, chunk_part,
    total_chunks).  ``total_chunks`` is NULL for a document that fits in one
    chunk (the original metadata has no such field then)."""
    t = col_of(text)
    arr = chunk_array(t, chunk_size)
    multi = token_estimate(t) > chunk_size
    staged = df.select(key, *keep, arr.alias("_c"), multi.alias("_multi"))
    staged = staged.select(key, *keep, "_c", F.when(F.col("_multi"), F.size("_c")).alias("total_chunks"))
    return (explode_array(staged, F.col("_c"), [key, *keep, "total_chunks"], pos="chunk_index")
            .select(key, *keep, "chunk_index", "_x.text", "_x.section", "_x.chunk_part",
                    "total_chunks"))


def first_chunk_struct(text, chunk_size: int = fixed.DEFAULT_CHUNK_SIZE) -> Column:
    """struct<text, section, chunk_part, total_chunks> of the first chunk,
    computed without building the other chunks (their count is arithmetic)."""
    return let(col_of(text), lambda t: _first_chunk(t, chunk_size))


def _first_chunk(t: Column, chunk_size: int) -> Column:
    cpc, _, step = chunk_geometry(chunk_size)

    def body(secs):
        head = secs[0]
        count = F.aggregate(secs, F.lit(0), lambda acc, s: acc + F.when(
            F.length(s["text"]) <= cpc, F.lit(1)).otherwise(
            F.floor((F.length(s["text"]) + F.lit(step - 1)) / F.lit(step)).cast("int")))
        long_head = F.length(head["text"]) > cpc
        return F.struct(
            F.when(long_head, F.substring(head["text"], 1, cpc)).otherwise(head["text"]).alias("text"),
            head["section"].alias("section"),
            F.when(long_head, F.lit("1")).alias("chunk_part"),
            count.alias("total_chunks"))

    single = F.struct(t.alias("text"), F.lit(None).cast("string").alias("section"),
                      F.lit(None).cast("string").alias("chunk_part"),
                      F.lit(None).cast("int").alias("total_chunks"))
    return F.when(token_estimate(t) <= chunk_size, single).otherwise(
        let(ordered_sections(t, chunk_size), body))


def fits_one_chunk_rows(df: DataFrame, chunk_size: int = fixed.DEFAULT_CHUNK_SIZE, key: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """Documents whose estimated tokens fit in one chunk: (key, est_tokens)."""
    est = compute_once(df, [key], est_tokens=token_estimate(text))
    return est.filter(F.col("est_tokens") <= chunk_size)


def chunk_role(chunks: DataFrame) -> DataFrame:
    """initial / middle / final by position (one chunk: initial)."""
    idx, total = F.col("chunk_index"), F.coalesce(F.col("total_chunks"), F.lit(1))
    role = (F.when(idx == 0, "initial").when(idx == total - 1, "final").otherwise("middle"))
    return chunks.withColumn("role", role)


def number_chunks(chunks: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("start", "text")) -> DataFrame:
    """``chunk_index`` and ``total_chunks`` of chunks that come without them:
    the place by ``order`` (NULL first) and the count, within their document.

    One exchange by document serves both windows.  A document's chunks are one
    group, bounded by the document."""
    place = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    whole = Window.partitionBy(key)
    return chunks.withColumns({
        "chunk_index": (F.row_number().over(place) - 1).cast("int"),
        "total_chunks": F.count(F.lit(1)).over(whole).cast("int")})


def chunk_counts(df: DataFrame, chunk_size: int = fixed.DEFAULT_CHUNK_SIZE, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Chunks per document, by arithmetic on section lengths: no chunk text
    is built, nothing is exploded, no shuffle.  A NULL text has none."""
    c = first_chunk_struct(text, chunk_size)["total_chunks"]
    return df.select(key, F.when(F.col(text).isNull(), 0).otherwise(F.coalesce(c, F.lit(1))).alias("n_chunks"))
