"""Input listing: the papers of a directory and their file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, paper_stem


def scan_files(spark: SparkSession, directory: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files of one directory (not recursive) matching ``glob``
    (case-insensitive ``.pdf`` by default): path, size, modified.

    ``binaryFile`` lists in parallel; the ``content`` column is never
    selected, so no file body is read.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "false").load(directory)
            .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def doc_manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """PDF inputs (extension test ignores case): path, name, stem."""
    p = F.col(path)
    return (files.filter(F.lower(base_name(p)).endswith(".pdf"))
            .select(p.alias("path"), base_name(p).alias("name"), paper_stem(p).alias("stem")))


def file_metadata(files: DataFrame, path: str = "path", size: str = "size",
                  modified: str = "modified") -> DataFrame:
    """name, base_name, size, modified, path; when the file could not be
    examined (no size) only name and path are filled."""
    known = F.col(size).isNotNull()
    return files.select(
        base_name(path).alias("name"),
        F.when(known, paper_stem(path)).alias("base_name"),
        F.when(known, F.col(size)).alias("size"),
        F.when(known, F.col(modified)).alias("modified"),
        F.col(path).alias("path"))
