"""Incremental ingestion with Structured Streaming.

The original skips a paper when its output file exists.  Here a file stream
over the input folder (explicit schema, ``Trigger.AvailableNow``) hands each
new batch to ``foreachBatch``, which is ``run_batch``: skip what the sink
already holds, run the flow, store every outcome in one write.  The sink's
batch is named after the stream's id and the batch number, so a batch that is
replayed replaces its own rows; a stream with a new checkpoint has a new id
and finds the stored papers by their keys.

Failed papers wait in a queue, with their texts, beside the sink.  Every batch
takes the queue with its new files, and the papers that fail (again) are the
next queue; a run starts with a batch of the queue alone, so an outage is made
good without any new file.  A queue entry is dropped only after the batch that
took it has stored its outcomes and its own failures: a crash in between leaves
the entry, and the sink's keys keep a stored paper from being called again.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.flows import Responder, run_batch
from ..plans.settings import JobSettings
from ..sources import sink

DOC_SCHEMA = "doc_id bigint, paper_name string, text string"


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, respond: Responder,
                  chunk_size: int | None = None, run_ts: str | None = None,
                  schema: str = DOC_SCHEMA, flow: str = "first_chunk",
                  max_files_per_trigger: int | None = None, settings: JobSettings | None = None) -> None:
    """Process every new parquet file of ``in_dir`` once and store the
    outcomes in ``out_dir``; returns when all available input is done.
    ``max_files_per_trigger`` bounds each micro-batch when a large backlog
    arrives (AvailableNow still drains all of it).  ``run_ts`` stamps the
    records (by default the time of the batch).  Papers that failed before are
    tried again, first on their own and then with every batch."""
    queue_dir = f"{out_dir.rstrip('/')}_queue"

    def run(docs: DataFrame | None, name: str) -> None:
        """One batch: new documents (if any) and the queue."""
        session = spark if docs is None else docs.sparkSession
        queued, entries = read_queue(session, queue_dir, schema, name)
        if docs is None and not entries:
            return
        both = queued if docs is None else docs.unionByName(queued) if entries else docs
        at = run_ts or datetime.now(timezone.utc).isoformat(timespec="microseconds")
        run_batch(both, respond, out_dir, at, chunk_size, flow=flow, settings=settings, batch=name)
        _enqueue(both, out_dir, queue_dir, name)
        _drop(session, [f"{queue_dir}/batch={e}" for e in entries])

    run(None, f"retry-{uuid.uuid4().hex}")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(in_dir)

    def batch(df: DataFrame, epoch_id: int) -> None:
        session = df.sparkSession
        stream_id = session.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        run(df, f"{stream_id}-{epoch_id:012d}")

    query = (stream.writeStream.foreachBatch(batch)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_queue(spark: SparkSession, queue_dir: str, schema: str = DOC_SCHEMA,
               but: str = "") -> tuple[DataFrame, list[str]]:
    """The queued papers of all entries but ``but``, one row per paper, and the entries' names."""
    none = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(f"{schema}, batch string").parquet(queue_dir).where(F.col("batch") != but)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none, []
    entries = [r["batch"] for r in rows.select("batch").distinct().collect()]  # one per unfinished batch: few
    if not entries:
        return none, []
    papers = rows.drop("batch")
    # Several entries hold a paper twice only where a batch was cut off before it dropped the entry it took.
    return (papers if len(entries) == 1 else papers.dropDuplicates(["doc_id", "paper_name"])), entries


def _enqueue(docs: DataFrame, out_dir: str, queue_dir: str, name: str) -> None:
    """Store the papers of ``docs`` that batch ``name`` holds as errors as the queue's entry ``name``."""
    failed = sink.read_outcomes(docs.sparkSession, out_dir).where(
        (F.col("batch") == name) & (F.col("status") == fixed.STATUS_ERROR)).select("source_file").distinct()
    if failed.isEmpty():
        return
    papers = docs.join(failed, F.col("paper_name").eqNullSafe(F.col("source_file")), "left_semi")
    (papers.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(queue_dir))


def _drop(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stage_documents(docs: DataFrame, in_dir: str, parts: int | None = None) -> None:
    """Write documents as parquet input files for the stream: ``parts`` of
    them, by default as many as ``docs`` has partitions (a scan's follow its
    size, so that a task writes about one split) and at least two."""
    papers = docs.select("doc_id", "paper_name", "text")
    parts = parts or max(2, papers.rdd.getNumPartitions())
    papers.repartition(parts, "doc_id").write.mode("append").parquet(in_dir)

