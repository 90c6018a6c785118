"""Analysis sink: one table, one write per batch.

A row is the outcome of one paper in one batch: ``stem``, ``source_file``,
``status``, ``error``, ``processed_at`` (a real timestamp), the record as JSON
text (the analysis keys in answer order plus ``__metadata__``), and the folder
column ``batch``.  A batch is written once, by one job, replacing whatever an
earlier attempt of the same batch left behind (dynamic partition overwrite),
so a replay neither repeats nor loses records.  Keys and records are read from
the same rows: there is no moment at which one is there without the other.

A paper written by several batches has several rows; readers take the latest
(``latest_analyses``), which is what overwriting the paper's file does in the
original.  Failed papers are rows with status ``error``: they are in the
batch's report, but not among the processed keys, so the next run tries them
again.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.answers import ANALYSIS_TYPE
from ..functions.text import base_name, paper_stem
from ..operators.merge import latest_by_key

SCHEMA = ("stem string, source_file string, status string, error string, processed_at timestamp, "
          "value string, batch string")


def record_json(analysis, source_file, processed_at) -> F.Column:
    """The record; ``__metadata__`` holds processed_date and source_file."""
    meta = F.to_variant_object(F.struct(
        F.date_format(processed_at, "yyyy-MM-dd'T'HH:mm:ss").alias("processed_date"),
        F.col(source_file).alias("source_file")))
    m = F.col(analysis) if isinstance(analysis, str) else analysis
    return F.to_json(F.map_concat(
        F.map_filter(m, lambda k, v: k != F.lit(fixed.METADATA_KEY)),
        F.create_map(F.lit(fixed.METADATA_KEY), meta)))


def batch_name(run_ts: str) -> str:
    """A new batch's name: the timestamp and a unique ending."""
    return re.sub(r"[^0-9A-Za-z.-]", "_", run_ts) + "-" + uuid.uuid4().hex[:8]


def save_outcomes(df: DataFrame, path: str, run_ts: str, batch: str | None = None, analysis: str = "analysis",
                  source_file: str = "paper_name", status: str = "status", error: str = "error") -> str:
    """Write one row per paper under ``path`` as ``batch`` (by default a new
    one named after ``run_ts``, an ISO timestamp); returns the batch's name.

    The rows are evaluated once.  ``rebalance`` lets file counts follow the
    data, not the number of tasks."""
    batch = batch or batch_name(run_ts)
    at = F.lit(run_ts).cast("timestamp")
    done = F.col(status) == fixed.STATUS_SUCCESS
    out = df.select(
        paper_stem(base_name(source_file)).alias("stem"), F.col(source_file).alias("source_file"),
        F.col(status).alias("status"), F.col(error).alias("error"), at.alias("processed_at"),
        F.when(done, record_json(analysis, source_file, at)).alias("value"), F.lit(batch).alias("batch"))
    (out.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(path))
    return batch


def save_analyses(df: DataFrame, path: str, run_ts: str, batch: str | None = None, analysis: str = "analysis",
                  source_file: str = "paper_name") -> str:
    """``save_outcomes`` of papers that all succeeded."""
    ok = df.withColumn("_status", F.lit(fixed.STATUS_SUCCESS)).withColumn("_error", F.lit(None).cast("string"))
    return save_outcomes(ok, path, run_ts, batch, analysis, source_file, "_status", "_error")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the sink; no rows when nothing was ever written."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Every saved record: stem, source_file, processed_at, batch, analysis."""
    rows = read_outcomes(spark, path).where(F.col("status") == fixed.STATUS_SUCCESS)
    return rows.select("stem", "source_file", "processed_at", "batch", "value",
                       F.from_json("value", ANALYSIS_TYPE).alias("analysis"))


def latest_analyses(spark: SparkSession, path: str) -> DataFrame:
    """The current record per paper: the latest timestamp wins; equal ones go
    to the later batch name, then file name, then record text."""
    rows = read_outcomes(spark, path).where(F.col("status") == fixed.STATUS_SUCCESS)
    latest = latest_by_key(rows.select("stem", "source_file", "processed_at", "batch", "value"), "stem",
                           "processed_at", "batch", "source_file", "value")
    return latest.withColumn("analysis", F.from_json("value", ANALYSIS_TYPE))


def processed_keys(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Stems that already have an output; ``None`` when there is no output
    location (then nothing counts as processed).  Two columns of the table
    are read."""
    if path is None:
        return None
    return read_outcomes(spark, path).where(F.col("status") == fixed.STATUS_SUCCESS).select("stem")
