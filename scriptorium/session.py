"""Session and scratch-space helpers.

The library itself never creates a session; these helpers serve tests,
``bench.py`` and small jobs.  Scratch data (materialised tables, sinks used
by checks) lives below ``spark.checkpoint.dir`` — the shared folder a cluster
names for this purpose.  A default under ``/tmp`` is set only when the
session has none (local runs and tests); on a cluster it must be named.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "scriptorium") -> SparkSession:
    master = master or os.environ.get("SCRIPTORIUM_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared scratch folder; set a local one only when unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        sc = None
    root = spark.conf.get(_CHECKPOINT_KEY, None) or (sc.getCheckpointDir() if sc else None)
    if not root:
        if sc is None or not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, root)
        if sc:
            sc.setCheckpointDir(root)
    elif sc and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name below this application's scratch folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """``df`` written once, in columns, to the shared scratch folder and read
    back: later steps read only the columns they use, and repeat no work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch_root(spark: SparkSession) -> str:
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        app = "shared"
    return f"{checkpoint_root(spark)}/scriptorium/{app}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to its scratch folder.  Results are
    lazy and may still read it: call this once they are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, once per application.

    Functions sent to the executors refer to its modules by name.  Where the
    package is not installed on the workers, Spark's own file server hands
    them a zip of its sources (some kilobytes)."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    name = os.path.basename(PACKAGE)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    sc._scriptorium_shipped = True
