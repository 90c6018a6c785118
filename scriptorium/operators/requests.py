"""Request tables: preprocessing, prompts and chat requests.

The model call is outside the pipeline: these functions produce the rows a
responder consumes (``request_id``, prompt, request struct).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import prompts as pr
from ..functions.text import clean_text, col_of, paper_metadata, reclean
from .chunks import first_chunk_struct


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """What extraction returns: one cleaning pass plus the paper metadata of
    the cleaned text (columns ``text``, ``title``, ``authors``, ``arxiv_id``)."""
    # A paper without text is still a paper (the original's extractor returns
    # a string, possibly empty): keep the row, never drop it.
    cleaned = df.withColumn(text, clean_text(F.coalesce(F.col(text), F.lit(""))))
    return (cleaned.withColumn("_m", paper_metadata(text))
            .select(*[c for c in cleaned.columns], "_m.title", "_m.authors", "_m.arxiv_id"))


def preprocess(df: DataFrame, chunk_size: int = fixed.DEFAULT_CHUNK_SIZE, text: str = "text",
               out: str = "structured", cleaned: bool = False, count: str | None = None) -> DataFrame:
    """Clean (one pass), chunk, and structure the first chunk.

    One chunk: header from the paper metadata.  Several: header from the
    first chunk's metadata (paper metadata + section, part, total).  Only
    the first chunk is built; the rest are counted.  ``cleaned`` says the
    text comes from ``extract`` (already cleaned once), which allows the
    cheap form of the pass; ``count`` names a column for the number of
    chunks (all but the first are left out).
    """
    t = reclean(text) if cleaned else clean_text(text)
    staged = df.withColumn("_fc", first_chunk_struct(t, chunk_size))
    fc = F.col("_fc")
    multi = fc["total_chunks"].isNotNull()
    structured = pr.structure_text(
        fc["text"], "title", "authors", "arxiv_id",
        section=F.when(multi, fc["section"]),
        chunk_part=F.when(multi, fc["chunk_part"]),
        total_chunks=F.when(multi, fc["total_chunks"]))
    if count:
        staged = staged.withColumn(count, F.coalesce(fc["total_chunks"], F.lit(1)))
    return staged.withColumn(out, structured).drop("_fc")


def merge_metadata(df: DataFrame, base: str, override: str, out: str = "metadata") -> DataFrame:
    """``{**base, **override}`` for two struct columns: every field of
    ``override`` replaces or extends ``base``; a NULL override field stands
    for an absent key and keeps the base value."""
    base_fields = {f.name for f in df.schema[base].dataType.fields}
    merged = F.col(base)
    for f in df.schema[override].dataType.fields:
        o = F.col(override)[f.name]
        merged = merged.withField(f.name, F.coalesce(o, F.col(base)[f.name]) if f.name in base_fields else o)
    return df.withColumn(out, merged)


def chunk_prompts(chunks: DataFrame, limit: int = fixed.PROMPT_CHAR_LIMIT) -> DataFrame:
    """Label + initial/middle/final prompt per chunk, truncated.

    Expects split_chunks output; a document that fits in one chunk counts
    as one part.
    """
    total = F.coalesce(F.col("total_chunks"), F.lit(1))
    idx = F.col("chunk_index")
    role = F.when(idx == 0, "initial").when(idx == total - 1, "final").otherwise("middle")
    label = pr.chunk_label(idx, total, F.col("section"), F.col("chunk_part"))
    return (chunks.withColumn("role", role).withColumn("label", label)
            .withColumn("prompt", pr.truncate_prompt(pr.chunk_prompt(F.col("text"), F.col("label"),
                                                                      F.col("role")), limit)))


def chat_requests(df: DataFrame, prompt: str = "prompt", model: str = fixed.DEFAULT_MODEL,
                  temperature: float = fixed.DEFAULT_TEMPERATURE,
                  max_tokens: int = fixed.DEFAULT_MAX_TOKENS) -> DataFrame:
    return df.withColumn("request", pr.chat_request(col_of(prompt), model, temperature, max_tokens))

