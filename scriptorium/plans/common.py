"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread(scan: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal a scanned table of few row groups to all cores.

    The driver's small tables are one row group, so one split, so one task.
    Only for scans (a scan's partitions are known without running anything);
    the library's operators never call it and take inputs as they come.
    """
    try:
        cores = scan.sparkSession.sparkContext.defaultParallelism
        parts = scan.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a Spark Connect session): leave as is
        return scan
    return scan if parts >= cores else scan.repartition(cores, key)


def widen_ints(df: DataFrame) -> DataFrame:
    """Integer columns as bigint (stable result schema across engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
