"""Training-order materialisation: token sequences in a keyed global order,
as fixed-stride binary shards.

1. Every document's ids and an end id are laid end to end within a task's
   rows and cut into sequences of ``length`` ids; the last one of a task may
   be shorter.  The sequences are written once (compressed), so everything
   after derives from one fixed table.
2. A sequence's number is its task's start (counts per task, one row each, are
   all that reaches the driver) plus its place in the task.
3. A keyed Feistel network over the next power of four, walked along its cycle
   until it falls below the number of sequences, maps numbers to slots: a
   bijection on 0..n-1 that any reader can compute, with no shuffle file, no
   sort key and no state.
4. Sequences move once, to the task that owns their range of slots.  A task
   owns neighbouring shards, as many as keep the number of tasks at ``writers``
   or below, and writes them in slot order through Spark's commit protocol: a
   lost executor leaves no partial shard.

A record has ``length`` little-endian ids (unsigned 16 bit if the ids and the
padding fit, else 32 bit), padded with the largest value, and one closing
newline byte, so slot s of a shard starts at byte ``(s % per_shard) * stride``.
``manifest`` holds the numbers a reader needs; ``read_slots`` opens only the
shards of the slots asked for, so training resumes at any slot.  Spark's binary
reader hands over a shard as one value, so ``per_shard * stride`` bytes (8 MB
by default; larger shards make fewer files and need that much more memory) is also what a reading task holds.

Defined results: a NULL or empty text contributes its end id.  Repeated rows
and repeated or NULL ids contribute row by row.  An empty table gives no
shards and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import chunk_ids
from .common import begin, blocks_of, ship, slices, written

LENGTH = 2048
PER_SHARD = 2048
WRITERS = 8192  # tasks that write shards, at most
ROUNDS = 6
KEY = 0x5EED0F7A11A9C0DE
SEPARATOR = "\n"


def _round(right: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    x = right ^ np.uint64((key + number * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def slots(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slot of each sequence number: a keyed bijection on 0..n-1."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = numbers.astype(np.uint64)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):  # walk the cycle until every number is back below n
            left, right = x >> shift, x & mask
            for r in range(ROUNDS):
                left, right = right, left ^ _round(right, key, r, mask)
            x = (left << shift) | right
            inside = x < np.uint64(n)
            out[todo[inside]] = x[inside]
            x, todo = x[~inside], todo[~inside]
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", length: int = LENGTH,
              code: str = "H") -> DataFrame:
    """part, place, n_tokens, ids (zstd) of every sequence of every task."""
    ship(docs.sparkSession)

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        begin("chunks")
        part, place, width = TaskContext.get().partitionId(), 0, length * array(code).itemsize
        pack = zstandard.ZstdCompressor(level=3).compress
        end, stream = array(code, [end_id]).tobytes(), bytearray()
        for pdf in slices(batches):
            for ids in chunk_ids.encode(pdf["text"].tolist(), tokenizer, "words", code):
                stream += ids
                stream += end
            full = len(stream) // width
            if full:
                cut = [pack(bytes(stream[k * width:(k + 1) * width])) for k in range(full)]
                del stream[:full * width]
                yield pd.DataFrame({"part": part, "place": range(place, place + full),
                                    "n_tokens": length, "ids": cut})
                place += full
        if stream:
            yield pd.DataFrame({"part": part, "place": [place], "n_tokens": [len(stream) * length // width],
                                "ids": [pack(bytes(stream))]})

    return docs.select(F.col(text).alias("text")).mapInPandas(
        run, "part int, place long, n_tokens int, ids binary")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text",
                 length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, writers: int = WRITERS) -> dict:
    """Write ``docs`` as shards under ``path``; returns the manifest."""
    if sys.byteorder != "little":
        raise RuntimeError("shards are little-endian")
    spark = docs.sparkSession
    vocabulary = chunk_ids.library(tokenizer).get_vocab_size(with_added_tokens=True)
    code = "H" if max(vocabulary, end_id + 1) < 0xFFFF else "I"
    size = array(code).itemsize
    made = written(sequences(docs, tokenizer, end_id, text, length, code), "sequences")

    sizes = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, n = [], 0
    for part, count in sizes:
        starts.append((part, n))
        n += count
    manifest = {"sequences": n, "length": length, "bytes_per_id": size, "stride": length * size + len(SEPARATOR),
                "per_shard": per_shard, "shards": blocks_of(n, per_shard) if n else 0, "key": key,
                "end_id": end_id, "padding": (1 << 8 * size) - 1}
    if n:
        @F.pandas_udf("long")
        def slot_of(numbers: pd.Series) -> pd.Series:
            return pd.Series(slots(numbers.to_numpy(), n, key))

        def records(batches):
            import pyarrow as pa
            begin("records")
            import zstandard
            unpack = zstandard.ZstdDecompressor().decompress
            for whole in batches:
                for at in range(0, whole.num_rows, 500):  # a few megabytes of records at a time
                    batch = whole.slice(at, 500)
                    rows = [unpack(x).ljust(length * size, b"\xff") for x in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())],
                                                     names=["shard", "record"])

        each = blocks_of(manifest["shards"], writers)  # shards of a task
        # One row per task of step 1, as a table: Spark sees its size and chooses the join by it.
        start = written(spark.createDataFrame(starts, "part int, start long").coalesce(1), "starts")
        (made.join(start, "part")
         .withColumn("slot", slot_of(F.col("start") + F.col("place")))
         .select(F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), "slot", "ids")
         .repartitionById(blocks_of(manifest["shards"], each), F.floor(F.col("shard") / each).cast("int"))
         .sortWithinPartitions("shard", "slot")
         .select("shard", "ids").mapInArrow(records, "shard long, record binary")
         .select("shard", F.col("record").cast("string").alias("record"))
         .write.partitionBy("shard").option("lineSep", SEPARATOR).option("compression", "none").text(f"{path}/shards"))
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, shard, n_tokens, ids (bytes without padding) of slots start..stop-1.

    Only the shards that hold them are opened; a shard is one value of at most
    ``per_shard * stride`` bytes."""
    ship(spark)
    m = read_manifest(spark, path)
    stop = m["sequences"] if stop is None else min(stop, m["sequences"])
    schema = "slot long, shard long, n_tokens long, ids binary"
    if start >= stop:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])
    first, last = start // m["per_shard"], (stop - 1) // m["per_shard"]
    whole = first == 0 and last == m["shards"] - 1
    paths = [f"{path}/shards"] if whole else [f"{path}/shards/shard={k}" for k in range(first, last + 1)]
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
             .load(paths))

    def run(batches):
        import pyarrow as pa
        begin("slots")
        size, width, dtype = m["bytes_per_id"], m["length"] * m["bytes_per_id"], np.dtype(f"<u{m['bytes_per_id']}")
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                shard = int(file.as_py().rsplit("shard=", 1)[1].split("/", 1)[0])
                data = np.frombuffer(content.as_buffer(), np.uint8)
                records = data.reshape(-1, m["stride"])[:, :width]
                base = shard * m["per_shard"]
                lo, hi = max(0, start - base), min(len(records), stop - base)
                for at in range(lo, hi, 500):  # a few megabytes of records at a time
                    block = np.ascontiguousarray(records[at:min(at + 500, hi)])
                    n = (block.view(dtype) != m["padding"]).sum(1)
                    ids = [row[:k * size].tobytes() for row, k in zip(block, n.tolist())]
                    slot = base + at + np.arange(len(block))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot, pa.int64()), pa.array(np.full(len(block), shard), pa.int64()),
                         pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["slot", "shard", "n_tokens", "ids"])

    return files.select("path", "content").mapInArrow(run, schema)


def materialise(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", length: int = LENGTH,
                per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None) -> DataFrame:
    """Write the shards (by default in the shared scratch folder) and read them back."""
    path = path or scratch_path(docs.sparkSession, "training")
    write_shards(docs, path, tokenizer, end_id, text, length, per_shard, key)
    return read_slots(docs.sparkSession, path)
