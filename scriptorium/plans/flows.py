"""End-to-end flows.

The model is a *responder*: a function ``requests DataFrame -> the same rows
with ``content`` (and, where calls can fail, ``ok`` and ``call_error``)`` that
the caller supplies: ``call_responder`` over their own endpoint, or a join
with a table of answers.  The flows only build requests and consume answers.

A call that fails is never an answer.  Every flow carries ``ok`` and
``call_error``; a failed paper has branch ``failed`` and no analysis, and in
the map-reduce flow one failed chunk makes the paper fail without a second
request.

* ``flow_direct``      -- the command-line flow: extract, preprocess (first
  chunk, structured), one analysis prompt per paper.
* ``flow_first_chunk`` -- the library pipeline as it really behaves: the text
  is replaced by its first chunk, which then always fits in one prompt.
* ``flow_map_reduce``  -- the intended flow: one request per chunk, answers
  parsed, one consolidation request per paper, final answer parsed.
* ``run_batch``        -- skip what is done, run one of these flows, store
  every outcome once, report.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import prompts as pr
from ..functions.text import base_name, paper_stem, reclean
from ..operators import chunks as ch
from ..operators import joins as jn
from ..operators import merge as mg
from ..operators import report as rp
from ..operators import requests as rq
from ..operators import responses as rs
from ..session import checkpoint_root, stored
from ..sources import sink
from .settings import JobSettings

Responder = Callable[[DataFrame], DataFrame]
FAILED = "failed"


def table_responder(answers: DataFrame, keys: list[str], content: str = "content") -> Responder:
    """Responder backed by a table of answers (left join on ``keys``); columns
    ``ok`` and ``call_error`` of the table say which calls failed."""
    status = [c for c in ("ok", "call_error") if c in answers.columns]
    a = answers.select(*keys, F.col(content).alias("content"), *status)
    return lambda requests: requests.join(a, keys, "left")


def _settings(chunk_size: int | None, settings: JobSettings | None) -> JobSettings:
    settings = settings or JobSettings()
    return settings if chunk_size is None else JobSettings(**{**settings.__dict__, "chunk_size": chunk_size})


def _requests(df: DataFrame, prompt, s: JobSettings) -> DataFrame:
    """``df`` plus the (possibly cut) prompt, whether it was cut, the request."""
    cut = df.withColumn("_whole", prompt)
    cut = cut.withColumn("truncated", F.length("_whole") > s.prompt_limit).withColumn(
        "prompt", pr.truncate_prompt("_whole", s.prompt_limit)).drop("_whole")
    return rq.chat_requests(cut, model=s.model, temperature=s.temperature, max_tokens=s.max_tokens)


def _call(requests: DataFrame, respond: Responder) -> DataFrame:
    """The answered requests with ``ok`` and ``call_error``."""
    out = respond(requests)
    ok = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in out.columns else F.lit(True)
    error = F.col("call_error") if "call_error" in out.columns else F.lit(None).cast("string")
    return out.withColumns({"ok": ok, "call_error": F.when(~ok, F.coalesce(error, F.lit("")))})


def _parsed(answered: DataFrame, name: str) -> DataFrame:
    """branch and analysis; a failed call is branch ``failed`` without one."""
    out = rs.parse_response(answered, name=name)
    return out.withColumns({"branch": F.when(F.col("ok"), F.col("branch")).otherwise(FAILED),
                            "analysis": F.when(F.col("ok"), F.col("analysis"))})


def _single_flow(requests: DataFrame, respond: Responder, name: str) -> DataFrame:
    return _parsed(_call(requests, respond), name).select(
        "doc_id", name, "prompt", "truncated", "n_chunks", "ok", "call_error", "branch", "analysis")


def flow_direct(docs: DataFrame, respond: Responder, chunk_size: int | None = None,
                name: str = "paper_name", settings: JobSettings | None = None) -> DataFrame:
    """doc_id, paper_name, prompt, truncated, n_chunks, ok, call_error,
    branch, analysis.  Only the first of ``n_chunks`` chunks is sent."""
    s = _settings(chunk_size, settings)
    e = rq.extract(docs)
    pre = rq.preprocess(e, s.chunk_size, cleaned=True, count="n_chunks")
    req = _requests(pre.select("doc_id", name, "n_chunks", "structured"), pr.analysis_prompt("structured"), s)
    return _single_flow(req.drop("structured"), respond, name)


def flow_first_chunk(docs: DataFrame, respond: Responder, chunk_size: int | None = None,
                     name: str = "paper_name", settings: JobSettings | None = None) -> DataFrame:
    """As ``flow_direct``, but the text is first replaced by the (cleaned)
    first chunk of the cleaned text, and the header carries the paper
    metadata only: that chunk always fits in one prompt."""
    s = _settings(chunk_size, settings)
    e = rq.extract(docs).withColumn("_fc", ch.first_chunk_struct(reclean("text"), s.chunk_size))
    structured = pr.structure_text(reclean(F.col("_fc.text")), "title", "authors", "arxiv_id")
    n = F.coalesce(F.col("_fc.total_chunks"), F.lit(1)).alias("n_chunks")
    req = _requests(e.select("doc_id", name, n, structured.alias("_s")), pr.analysis_prompt("_s"), s)
    return _single_flow(req.drop("_s"), respond, name)


def map_requests(docs: DataFrame, settings: JobSettings, name: str = "paper_name") -> DataFrame:
    """First-stage requests of the map-reduce flow, one pass over the
    documents: a paper's analysis prompt if it fits in one chunk (``_single``),
    else one request per chunk."""
    e = rq.extract(docs)
    chunks = ch.split_chunks(e.withColumn("_t", reclean("text")), settings.chunk_size, text="_t",
                             keep=(name, "title", "authors", "arxiv_id"))
    single = F.col("total_chunks").isNull()
    total = F.coalesce(F.col("total_chunks"), F.lit(1))
    idx = F.col("chunk_index")
    role = F.when(idx == 0, "initial").when(idx == total - 1, "final").otherwise("middle")
    label = pr.chunk_label(idx, total, F.col("section"), F.col("chunk_part"))
    whole = pr.analysis_prompt(pr.structure_text("text", "title", "authors", "arxiv_id"))
    prompt = F.when(single, whole).otherwise(pr.chunk_prompt("text", label, role))
    return _requests(chunks.select("doc_id", "chunk_index", name, single.alias("_single"), prompt.alias("_p")),
                     F.col("_p"), settings).drop("_p")


def flow_map_reduce(docs: DataFrame, respond: Responder, chunk_size: int | None = None,
                    name: str = "paper_name", settings: JobSettings | None = None) -> DataFrame:
    """doc_id, paper_name, n_parts, prompt, truncated, ok, call_error, branch, analysis.

    ``prompt`` is the paper's last request: the consolidation request, or the
    only one of a paper that fits in one chunk.

    The call is eager: building the result makes the model calls, each once.
    The answers of both stages are stored in columns, the first stage's
    without the prompts of chunks, so no action on the result repeats a call
    and a step reads only what it uses.  Papers of one chunk are finished in
    their own rows; only the consolidation blocks of longer papers are shuffled.
    """
    s = _settings(chunk_size, settings)
    answered = _call(map_requests(docs, s, name), respond)
    first = stored(answered.select("doc_id", "chunk_index", name, "_single", "truncated", "ok", "call_error", "content",
                                   F.when(F.col("_single"), F.col("prompt")).alias("prompt")), "answers")
    chunk_name = F.concat(F.col(name), F.lit("_chunk_"), (F.col("chunk_index") + 1).cast("string"))
    columns = ("doc_id", name, "n_parts", "prompt", "truncated", "ok", "call_error", "branch", "analysis")

    done = _parsed(first.where("_single"), name).withColumn("n_parts", F.lit(1).cast("long")).select(*columns)

    parts = _parsed(first.where("not _single").withColumn("_chunk_name", chunk_name), "_chunk_name")
    papers = stored(parts.select(
        "doc_id", name, "chunk_index", "truncated", "ok", "call_error",
        F.when(F.col("ok"), mg.consolidation_block("chunk_index", "analysis")).alias("_block"),
    ).groupBy("doc_id").agg(
        F.first(name).alias(name), F.count(F.lit(1)).alias("n_parts"), F.bool_or("truncated").alias("_cut"),
        F.bool_and("ok").alias("ok"),
        F.min_by("call_error", F.when(~F.col("ok"), F.col("chunk_index"))).alias("call_error"),
        F.expr("listagg(_block, '') WITHIN GROUP (ORDER BY chunk_index)").alias("_blocks")), "papers")

    failed = papers.where("not ok").select(
        "doc_id", name, "n_parts", F.lit(None).cast("string").alias("prompt"), F.col("_cut").alias("truncated"), "ok",
        "call_error", F.lit(FAILED).alias("branch"), F.lit(None).cast("map<string,variant>").alias("analysis"))
    ask = _requests(papers.where("ok").select("doc_id", name, "n_parts", "_cut", pr.consolidation_prompt_text(
        F.col(name), F.col("_blocks")).alias("_p")), F.col("_p"), s).drop("_p")
    second = stored(_call(ask, respond).withColumn("truncated", F.col("truncated") | F.col("_cut")).select(
        "doc_id", name, "n_parts", "prompt", "truncated", "ok", "call_error", "content"), "answers")
    final = _parsed(second, name).select(*columns)
    return done.unionByName(final).unionByName(failed)


FLOWS = {"direct": flow_direct, "first_chunk": flow_first_chunk, "map_reduce": flow_map_reduce}


def outcomes(analysed: DataFrame, name: str = "paper_name") -> DataFrame:
    """A flow's rows plus ``status`` and ``error``: a paper whose call failed
    is an error, a malformed answer still a success (as in the original)."""
    return analysed.withColumns({
        "status": F.when(F.col("ok"), fixed.STATUS_SUCCESS).otherwise(fixed.STATUS_ERROR),
        "error": F.when(~F.col("ok"), F.concat(F.lit(fixed.PAPER_ERROR_PREFIX),
                                               F.coalesce(F.col("call_error"), F.lit(""))))})


def run_batch(docs: DataFrame, respond: Responder, out_dir: str | None, run_ts: str,
              chunk_size: int | None = None, skip_done: bool = True, name: str = "paper_name",
              flow: str = "first_chunk", settings: JobSettings | None = None,
              done: DataFrame | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The library pipeline over a batch of papers: (results, summary).

    ``docs``: doc_id, paper_name, text.  Papers whose stem already has an
    output (in ``out_dir``, or in ``done``) are skipped, and of several
    papers with one stem the first is taken; the others would find its output.
    ``flow`` names one of ``FLOWS``.  Every outcome is stored once (in the
    sink, or checkpointed when there is no ``out_dir``); results and summary
    read it back, so no call is made twice.  A named ``batch`` that the sink
    already holds is not run again (its one write was complete): it is only
    reported.

    results: stem, paper_name, nombre, resumen, resultados, exito,
    performance, status, output_path (the sink's table, for stored
    successes), error.
    """
    spark = docs.sparkSession
    stored_before = bool(out_dir and batch) and not sink.read_outcomes(spark, out_dir).where(
        F.col("batch") == batch).isEmpty()
    if not stored_before:
        files = docs.withColumn("stem", paper_stem(base_name(name)))
        if done is None and skip_done and out_dir:
            done = sink.processed_keys(spark, out_dir)
        todo = jn.first_per_key(jn.skip_processed(files, done), "stem", name)
        analysed = outcomes(FLOWS[flow](todo.drop("stem"), respond, chunk_size, name, settings), name)
        if out_dir:
            batch = sink.save_outcomes(analysed, out_dir, run_ts, batch, source_file=name)
    if out_dir:
        kept = sink.read_outcomes(spark, out_dir).where(F.col("batch") == batch).select(
            "stem", F.col("source_file").alias(name), "status", F.col("error").alias("_error"),
            F.from_json("value", "map<string,variant>").alias("analysis"))
    else:
        checkpoint_root(spark)
        kept = analysed.select(paper_stem(base_name(name)).alias("stem"), name, "status",
                                 F.col("error").alias("_error"), "analysis").checkpoint(eager=True)
    failed = F.col("status") == fixed.STATUS_ERROR
    results = rs.analysis_columns(kept).select(
        "stem", name, F.when(failed, base_name(name)).otherwise(F.col("nombre")).alias("nombre"), "resumen",
        "resultados", "exito", "performance", "status",
        F.when(~failed, F.lit(out_dir)).alias("output_path"), F.col("_error").alias("error"))
    return results, rp.processing_summary(results)
