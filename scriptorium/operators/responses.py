"""Answers: attempts, join to requests, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import fixed


def first_success(attempts: DataFrame, key: str = "request_id",
                  max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Outcome of retried calls: the first successful attempt within
    ``max_attempts``, else the last failed one.

    One aggregate (``max_by`` on an ordering struct), so partial aggregation
    runs map-side and a request with very many attempt rows never gathers
    them in one place.
    """
    a = attempts.filter(F.col("attempt") <= max_attempts)
    rank = F.struct(F.col("ok"), F.when(F.col("ok"), -F.col("attempt")).otherwise(F.col("attempt")))
    best = F.max_by(F.struct("attempt", "ok", "content"), rank)
    return (a.groupBy(key).agg(best.alias("_b"), F.count(F.lit(1)).alias("attempts"))
            .select(key, "_b.attempt", "_b.ok", "_b.content", "attempts"))


def response_join(requests: DataFrame, responses: DataFrame, key: str = "request_id",
                  content: str = "content") -> DataFrame:
    """Attach each request's answer; requests without one keep a NULL
    content (which parses to an error record)."""
    r = responses.select(key, F.col(content).alias("content"), F.lit(True).alias("_answered"))
    return (requests.join(r, key, "left")
            .withColumn("answered", F.coalesce(F.col("_answered"), F.lit(False))).drop("_answered"))


def parse_response(df: DataFrame, content: str = "content", name: str = "paper_name") -> DataFrame:
    """Add ``branch`` (parsed / fallback / error) and ``analysis``."""
    p = an.parse_answer(F.col(content), F.col(name))
    return df.withColumn("_p", p).select("*", "_p.branch", "_p.analysis").drop("_p")


def analysis_columns(df: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Typed view of the known keys (strings raw, others as JSON text)."""
    m = F.col(analysis)
    return df.select(
        "*",
        an.json_text(an.field(m, fixed.KEY_NAME)).alias("nombre"),
        an.json_text(an.field(m, fixed.KEY_SUMMARY)).alias("resumen"),
        an.json_text(an.field(m, fixed.KEY_RESULTS)).alias("resultados"),
        an.json_bool(an.field(m, fixed.KEY_SUCCESS)).alias("exito"),
        an.json_text(an.field(m, fixed.KEY_PERFORMANCE)).alias("performance"),
        an.json_text(an.field(m, fixed.KEY_ERROR)).alias("error"),
        F.array_join(F.map_keys(m), ",").alias("keys"))
