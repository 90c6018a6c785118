"""Responders: how answers enter the pipeline.

A responder takes the request rows (``prompt``, ``request`` struct, keys)
and returns the same rows with a ``content`` column.

* ``table_responder`` (in flows.py): answers from a table, joined on keys.
* ``from_settings``: ``call_responder`` with a job's retry settings.
* ``stored_responder``: any of these behind a store of answers addressed by
  the request's content.
* ``call_responder``: calls a user-supplied function per request inside the
  executors (``mapInPandas``), with the original retry rule: up to
  ``max_attempts`` calls, the first success wins, a request whose calls all
  fail gets NULL content (which parses to an error record) plus the last
  error text.  Spark partitions the requests, so calls run in parallel over
  the cluster; the function sees one request at a time.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators.prefilter import anti_join
from ..session import ship, stored
from .settings import JobSettings

Call = Callable[[dict], str]


def call_responder(call: Call, max_attempts: int = fixed.MAX_ATTEMPTS, retry_delay: float = 0.0,
                   concurrency: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Responder that calls ``call(request) -> content`` for every row.

    ``request`` is the chat request as a dict (model, messages, temperature,
    max_tokens).  Adds ``content``, ``ok``, ``attempts`` and ``call_error``.
    A task keeps up to ``concurrency`` calls in flight (threads: the calls
    wait for a service) and holds one batch of rows at a time.
    """
    def respond(requests: DataFrame) -> DataFrame:
        ship(requests.sparkSession)
        schema = (T.StructType(list(requests.schema.fields))
                  .add("content", T.StringType()).add("ok", T.BooleanType())
                  .add("attempts", T.IntegerType()).add("call_error", T.StringType()))

        def attempt(request):
            request, error = _plain(request), None
            for n in range(1, max_attempts + 1):
                try:
                    return call(request), True, n, None
                except Exception as e:  # the attempt failed: keep its message
                    error = str(e)
                    if n < max_attempts and retry_delay:
                        time.sleep(retry_delay)
            return None, False, max_attempts, error

        def run(batches: Iterator) -> Iterator:
            with ThreadPoolExecutor(max(1, concurrency)) as pool:
                for pdf in batches:
                    done = list(pool.map(attempt, pdf["request"]))
                    yield pdf.assign(content=[d[0] for d in done], ok=[d[1] for d in done],
                                     attempts=[d[2] for d in done], call_error=[d[3] for d in done])

        return requests.mapInPandas(run, schema)

    return respond


def from_settings(call: Call, settings: JobSettings) -> Callable[[DataFrame], DataFrame]:
    """``call_responder`` with the attempts, delay and concurrency of a job."""
    return call_responder(call, settings.max_attempts, settings.retry_delay, settings.concurrency)


STORE = "digest string, content string, ok boolean, call_error string, run string, wave int"


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """Every stored outcome; no rows when nothing was ever stored."""
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def request_digest() -> F.Column:
    """What a request says, as a digest: equal requests have equal ones."""
    return F.sha2(F.to_json("request").cast("binary"), 256)


def stored_responder(respond: Callable[[DataFrame], DataFrame], store: str, per_task: int = 64,
                     per_wave: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """``respond`` behind a table of answers addressed by content.

    A request is known by the digest of its ``request``.  Equal requests, in a
    batch or in any earlier one, are called once.  Calls go out in waves of
    about ``per_wave`` requests, dealt into tasks of about ``per_task``; a
    wave's outcomes are committed to ``store`` before the next wave starts.
    So a lost task repeats its own ``per_task`` calls at most, and a new run
    after a crash repeats at most what the open wave had not committed.
    Failed calls are stored as such and asked again by the next batch.

    ``respond`` sees the column ``request`` only.  Adds ``content``, ``ok`` and
    ``call_error``; requests that repeat share one outcome.
    """
    def answer(requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        keyed = requests.withColumn("_digest", request_digest())
        asked = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first("request").alias("request"))
        known = read_answers(spark, store).where("ok").select("digest")
        missing = stored(anti_join(asked, known, ["digest"]), "asked")
        count, run = missing.count(), uuid.uuid4().hex
        waves = -(-count // per_wave)
        for wave in range(waves):
            part = missing.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
            dealt = part.repartition(max(1, -(-count // (waves * per_task))), "digest")
            out = respond(dealt)
            ok = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in out.columns else F.lit(True)
            error = F.col("call_error") if "call_error" in out.columns else F.lit(None).cast("string")
            (out.select("digest", "content", ok.alias("ok"), error.alias("call_error"), F.lit(run).alias("run"),
                        F.lit(wave).alias("wave")).write.mode("append").parquet(store))
        found = read_answers(spark, store).where(F.col("ok") | (F.col("run") == run))
        best = found.groupBy(F.col("digest").alias("_digest")).agg(
            F.max_by(F.struct("content", "ok", "call_error"), F.struct("ok", "run", "content")).alias("_a"))
        return keyed.join(best, "_digest", "left").select(
            *[F.col(f"`{c}`") for c in requests.columns], "_a.content", F.coalesce("_a.ok", F.lit(False)).alias("ok"),
            "_a.call_error")

    return answer


def _plain(value):
    """Arrow/pandas nested values as plain dicts and lists."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        return [_plain(v) for v in value.tolist()]
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value
