"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB
oracle statement per operator of the inventory.

Every query reads whole driver tables (or inputs Spark derives from them,
see ``fixtures``); nothing is sampled or capped.  Chunk queries use
``chunk_size=250`` (1,000 chars per chunk, overlap 100, step 900) because
the driver's documents are short.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import fixed
from ..functions import prompts as pr
from ..functions import text as tx
from ..operators import chunks as ch
from ..operators import joins as jn
from ..operators import merge as mg
from ..operators import report as rp
from ..operators import requests as rq
from ..operators import responses as rs
from ..operators import sections as se
from ..session import scratch_path
from ..sources import files as src_files
from ..sources import pages as src_pages
from ..sources import sink
from . import duck as dk
from . import fixtures as fx
from . import flows as fl
from .common import spread, table, widen_ints
from .settings import JobSettings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CHUNK_SIZE = 250


def register(name: str, sql: str | None = None, widen: bool = True):
    """``widen``: int columns come out as long; off where the statement declares int."""
    def deco(fn):
        QUERIES[name] = (lambda spark, sf_dir: widen_ints(fn(spark, sf_dir))) if widen else fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- inputs --

_NAME_SQL = "'paper_' || CAST(doc_id AS VARCHAR) || '.pdf'"


def paper_name(doc_id) -> F.Column:
    """File name of a paper, as the listing would give it."""
    return F.concat(F.lit("paper_"), F.col(doc_id).cast("string"), F.lit(".pdf"))


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def papers(spark, sf_dir) -> DataFrame:
    """F-PAPERS, cleaned as the pipeline cleans (two passes)."""
    return fx.papers(spark, sf_dir).select(
        "doc_id", tx.normalize_text("text").alias("text"))


D_PAPERS = f"(SELECT doc_id, {dk.normalize('text')} AS text FROM ({fx.duck_sql_text(fx.F_PAPERS)}))"


# ------------------------------------------------------------- text ops --

@register("clean_text", f"SELECT doc_id, {dk.clean('text')} AS text FROM documents")
def q_clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("text"))


@register("normalize_text", f"SELECT doc_id, {dk.normalize('text')} AS text FROM documents")
def q_normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.normalize_text("text").alias("text"))


_LAYOUT_SQL = ("regexp_replace(regexp_replace(text, '\\n" + tx.WS_CLASS + "*\\p{Nd}+" + tx.WS_CLASS
               + "*\\n', chr(10), 'g'), '\\n[^\\n]{1,50}arXiv[^\\n]{1,50}\\n', chr(10), 'g')")


@register("layout_clean", f"SELECT doc_id, {_LAYOUT_SQL} AS text FROM documents")
def q_layout_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.layout_clean("text").alias("text"))


@register("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens FROM documents")
def q_token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.token_estimate("text").alias("est_tokens"))


@register("fits_one_chunk",
          f"SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens FROM {D_PAPERS} "
          f"WHERE length(text) // 4 <= {CHUNK_SIZE}")
def q_fits_one_chunk(spark, sf_dir):
    return ch.fits_one_chunk_rows(papers(spark, sf_dir), CHUNK_SIZE)


_STEM_SQL = ("CASE WHEN regexp_matches(name, '^(\\.*[^.].*)\\.[^.]*$', 's') "
             "THEN regexp_extract(name, '^(\\.*[^.].*)\\.[^.]*$', 1, 's') ELSE name END")
_FILES_SQL = fx.duck_sql_text(fx.F_FILES)


@register("paper_stem",
          f"SELECT path, name, {_STEM_SQL} AS stem FROM "
          f"(SELECT path, regexp_extract(path, '[^/]*$', 0) AS name FROM ({_FILES_SQL}))")
def q_paper_stem(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    return f.select("path", tx.base_name("path").alias("name"), tx.paper_stem("path").alias("stem"))


_TITLE_SQL = dk.py_strip(
    "regexp_extract(array_to_string(string_split(t1, chr(10))[1:3], ' '), "
    + dk.lit("^(.*?)" + tx.WS_CLASS + "*(?:Abstract|\\.)") + ", 1, 's')")


@register("paper_metadata",
          f"SELECT doc_id, {_TITLE_SQL} AS title, '' AS authors, "
          f"regexp_extract(t1, 'arXiv:(\\p{{Nd}}+\\.\\p{{Nd}}+v\\p{{Nd}}+)', 1) AS arxiv_id "
          f"FROM (SELECT doc_id, {dk.clean('text')} AS t1 FROM ({fx.duck_sql_text(fx.F_PAPERS)}))")
def q_paper_metadata(spark, sf_dir):
    p = fx.papers(spark, sf_dir)
    return (p.select("doc_id", tx.paper_metadata(tx.clean_text("text")).alias("m"))
            .select("doc_id", "m.title", "m.authors", "m.arxiv_id"))


# ------------------------------------------------------------- sections --

@register("section_cascade",
          f"SELECT doc_id, section, start_pos, text FROM ({dk.cascade_sql(D_PAPERS)})")
def q_section_cascade(spark, sf_dir):
    return se.section_cascade(papers(spark, sf_dir))


@register("section_segments", dk.segments_sql(D_PAPERS))
def q_section_segments(spark, sf_dir):
    return se.section_segments(papers(spark, sf_dir))


@register("paper_sections",
          f"SELECT doc_id, section, arg_max(text, seq) AS text FROM ({dk.segments_sql(D_PAPERS)}) "
          f"GROUP BY doc_id, section")
def q_paper_sections(spark, sf_dir):
    return se.paper_sections(papers(spark, sf_dir))


# --------------------------------------------------------------- chunks --

def _chunks_sql(chunk_size: int) -> str:
    cpc, _, step = ch.chunk_geometry(chunk_size)
    return f"""
WITH d AS (SELECT doc_id, text FROM {D_PAPERS}),
s AS ({dk.cascade_sql('d')}),
o AS (SELECT s.*, CASE WHEN section IN ('abstract', 'conclusion') AND length(text) <= {cpc}
                       THEN (CASE section WHEN 'abstract' THEN 0 ELSE 1 END) ELSE 1 + ord END AS prio
      FROM s),
w AS (SELECT doc_id, prio, section, text, NULL AS off, CAST(NULL AS VARCHAR) AS chunk_part
      FROM o WHERE length(text) <= {cpc}
      UNION ALL
      SELECT doc_id, prio, section, substr(text, off + 1, {cpc}) AS text, off,
             CAST(off // {step} + 1 AS VARCHAR) AS chunk_part
      FROM (SELECT o.*, unnest(range(0, length(text), {step})) AS off FROM o WHERE length(text) > {cpc})),
multi AS (SELECT doc_id,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY prio, off) - 1 AS BIGINT) AS chunk_index,
             text, section, chunk_part, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS total_chunks
          FROM w WHERE doc_id IN (SELECT doc_id FROM d WHERE length(text) // 4 > {chunk_size}))
SELECT * FROM multi
UNION ALL
SELECT doc_id, CAST(0 AS BIGINT) AS chunk_index, text, CAST(NULL AS VARCHAR) AS section,
       CAST(NULL AS VARCHAR) AS chunk_part, CAST(NULL AS BIGINT) AS total_chunks
FROM d WHERE length(text) // 4 <= {chunk_size}"""


@register("split_chunks", _chunks_sql(CHUNK_SIZE))
def q_split_chunks(spark, sf_dir):
    return ch.split_chunks(papers(spark, sf_dir), CHUNK_SIZE)


@register("chunk_counts",
          f"SELECT doc_id, count(*) AS n_chunks FROM ({_chunks_sql(CHUNK_SIZE)}) GROUP BY doc_id")
def q_chunk_counts(spark, sf_dir):
    return ch.chunk_counts(papers(spark, sf_dir), CHUNK_SIZE)


@register("first_chunk",
          f"SELECT doc_id, text, section, chunk_part, total_chunks FROM ({_chunks_sql(CHUNK_SIZE)}) "
          f"WHERE chunk_index = 0")
def q_first_chunk(spark, sf_dir):
    return (papers(spark, sf_dir)
            .select("doc_id", ch.first_chunk_struct("text", CHUNK_SIZE).alias("c"))
            .select("doc_id", "c.text", "c.section", "c.chunk_part", "c.total_chunks"))


@register("chunk_role",
          f"SELECT doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN 'initial' "
          f"WHEN chunk_index = coalesce(total_chunks, 1) - 1 THEN 'final' ELSE 'middle' END AS role "
          f"FROM ({_chunks_sql(CHUNK_SIZE)})")
def q_chunk_role(spark, sf_dir):
    return (ch.chunk_role(ch.split_chunks(papers(spark, sf_dir), CHUNK_SIZE))
            .select("doc_id", "chunk_index", "role"))


@register("chunk_role_unnumbered",
          f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section NULLS FIRST, text) - 1 AS INTEGER) "
          f"AS chunk_index, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY section NULLS FIRST, text) = 1 "
          f"THEN 'initial' WHEN row_number() OVER (PARTITION BY doc_id ORDER BY section NULLS FIRST, text) = "
          f"count(*) OVER (PARTITION BY doc_id) THEN 'final' ELSE 'middle' END AS role, length(text) AS n_chars "
          f"FROM ({_chunks_sql(CHUNK_SIZE)})", widen=False)
def q_chunk_role_unnumbered(spark, sf_dir):
    """Chunks that come without index and total: numbered by a stated order."""
    bare = ch.split_chunks(papers(spark, sf_dir), CHUNK_SIZE).select("doc_id", "section", "text")
    out = ch.chunk_role(ch.number_chunks(bare, order=("section", "text")))
    return out.select("doc_id", "chunk_index", "role", F.length("text").cast("long").alias("n_chars"))


_WIN_SIZE, _WIN_OVERLAP = 1000, 100


@register("window_chunks",
          f"SELECT doc_id, CAST(off // {_WIN_SIZE - _WIN_OVERLAP} + 1 AS BIGINT) AS part, "
          f"CAST(off AS BIGINT) AS offset, substr(t, off + 1, {_WIN_SIZE}) AS text "
          f"FROM (SELECT doc_id, t, unnest(range(0, length(t), {_WIN_SIZE - _WIN_OVERLAP})) AS off "
          f"FROM (SELECT doc_id, {dk.normalize('text')} AS t FROM documents))")
def q_window_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", tx.normalize_text("text").alias("text"))
    return ch.window_chunks(d, _WIN_SIZE, _WIN_OVERLAP)



# ------------------------------------------------------- prompts, requests --

def extracted_papers(spark, sf_dir) -> DataFrame:
    """F-PAPERS as extraction returns them: one cleaning pass + metadata."""
    return rq.extract(fx.papers(spark, sf_dir))


D_EXTRACTED = (f"(SELECT doc_id, t1 AS text, {_TITLE_SQL} AS title, '' AS authors, "
               f"regexp_extract(t1, 'arXiv:(\\p{{Nd}}+\\.\\p{{Nd}}+v\\p{{Nd}}+)', 1) AS arxiv_id "
               f"FROM (SELECT doc_id, {dk.clean('text')} AS t1 FROM ({fx.duck_sql_text(fx.F_PAPERS)})))")


def _header_sql(section="NULL", part="NULL", total="NULL") -> str:
    def line(label, value, cond):
        return f"CASE WHEN {cond} THEN {dk.lit(label)} || {value} || chr(10) ELSE '' END"
    return " || ".join([
        line(fixed.HEADER_TITLE, "title", "coalesce(title, '') <> ''"),
        line(fixed.HEADER_AUTHORS, "authors", "coalesce(authors, '') <> ''"),
        line(fixed.HEADER_ARXIV, "arxiv_id", "coalesce(arxiv_id, '') <> ''"),
        line(fixed.HEADER_SECTION, f"{section}", f"{section} IS NOT NULL"),
        line(fixed.HEADER_PART, f"{part}", f"{part} IS NOT NULL"),
        line(fixed.HEADER_TOTAL, f"CAST({total} AS VARCHAR)", f"{total} IS NOT NULL")])


def _structured_sql(text, header) -> str:
    return f"CASE WHEN ({header}) <> '' THEN ({header}) || chr(10) || chr(10) || {text} ELSE {text} END"


@register("structure_text", f"""
SELECT c.doc_id, c.chunk_index,
       {_structured_sql('c.text', _header_sql('c.section', 'c.chunk_part', 'c.total_chunks'))} AS structured
FROM ({_chunks_sql(CHUNK_SIZE)}) c JOIN {D_EXTRACTED} m ON c.doc_id = m.doc_id""")
def q_structure_text(spark, sf_dir):
    d = extracted_papers(spark, sf_dir).withColumn("text", tx.reclean("text"))
    c = ch.split_chunks(d, CHUNK_SIZE, keep=("title", "authors", "arxiv_id"))
    return c.select("doc_id", "chunk_index", pr.structure_text(
        "text", "title", "authors", "arxiv_id", "section", "chunk_part", "total_chunks").alias("structured"))


_PRE_SQL = f"""
SELECT c.doc_id, {_structured_sql('c.text', _header_sql('c.section', 'c.chunk_part', 'c.total_chunks'))} AS structured
FROM (SELECT * FROM ({_chunks_sql(CHUNK_SIZE)}) WHERE chunk_index = 0) c JOIN {D_EXTRACTED} m ON c.doc_id = m.doc_id"""


@register("preprocess", _PRE_SQL)
def q_preprocess(spark, sf_dir):
    return rq.preprocess(extracted_papers(spark, sf_dir), CHUNK_SIZE, cleaned=True).select("doc_id", "structured")


def _analysis_prompt_sql(x) -> str:
    return f"({dk.lit(pr.ANALYSIS_HEAD)} || {x} || {dk.lit(pr.ANALYSIS_TAIL)})"


@register("analysis_prompt",
          f"SELECT doc_id, {_analysis_prompt_sql('structured')} AS prompt FROM ({_PRE_SQL})")
def q_analysis_prompt(spark, sf_dir):
    return (rq.preprocess(extracted_papers(spark, sf_dir), CHUNK_SIZE, cleaned=True)
            .select("doc_id", pr.analysis_prompt("structured").alias("prompt")))


def _truncate_sql(p: str, limit: int) -> str:
    parts = f"string_split({p}, '-----')"
    p1, p0, p2 = f"{parts}[2]", f"{parts}[1]", f"{parts}[3]"
    avail = f"({limit} - length({p0}) - length({p2}) - 10)"
    keep = f"(CASE WHEN {avail} >= 0 THEN least({avail}, length({p1})) ELSE greatest(length({p1}) + {avail}, 0) END)"
    return (f"CASE WHEN length({p}) <= {limit} THEN {p} WHEN len({parts}) < 3 THEN substr({p}, 1, {limit}) "
            f"ELSE {p0} || '-----' || substr({p1}, 1, {keep}) || {dk.lit(fixed.TRUNCATION_MARKER)} "
            f"|| '-----' || {p2} END")


_TRUNC_LIMIT = 1000


@register("truncate_prompt",
          f"SELECT doc_id, {_truncate_sql('p', _TRUNC_LIMIT)} AS prompt FROM "
          f"(SELECT doc_id, {_analysis_prompt_sql(dk.normalize('text'))} AS p FROM documents)")
def q_truncate_prompt(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", pr.truncate_prompt(pr.analysis_prompt(tx.normalize_text("text")),
                                                 _TRUNC_LIMIT).alias("prompt"))


def _section_prompt_sql(text, section) -> str:
    focus = f"{dk.lit(pr.SECTION_GENERIC[0])} || {section} || {dk.lit(pr.SECTION_GENERIC[1])}"
    cases = " ".join(f"WHEN {dk.lit(k)} THEN {dk.lit(v)}" for k, v in pr.SECTION_FOCUS.items())
    return (f"(CASE {section} {cases} ELSE {focus} END || {dk.lit(pr.SECTION_BODY)} || {text} "
            f"|| {dk.lit(pr.SECTION_TAIL)})")


@register("section_prompt",
          f"SELECT doc_id, section, {_section_prompt_sql('text', 'section')} AS prompt FROM "
          f"(SELECT doc_id, section, arg_max(text, seq) AS text FROM ({dk.segments_sql(D_PAPERS)}) "
          f"GROUP BY doc_id, section)")
def q_section_prompt(spark, sf_dir):
    s = se.paper_sections(papers(spark, sf_dir))
    return s.select("doc_id", "section", pr.section_prompt("text", "section").alias("prompt"))


_PAIRS_SQL = ("(SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.text AS a_text, b.text AS b_text "
              f"FROM (SELECT doc_id, lang, {dk.normalize('text')} AS text FROM documents) a "
              f"JOIN (SELECT doc_id, lang, {dk.normalize('text')} AS text FROM documents) b "
              "ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang)")


def _pairs(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", tx.normalize_text("text").alias("text"))
    pairs = (d.select(F.col("doc_id").alias("a_id"), "lang")
             .withColumn("b_id", F.col("a_id") + 1))
    return jn.pair_papers(pairs, d, on=["lang"])


@register("comparison_pairs",
          f"SELECT a_id, b_id, CAST(length(a_text) AS BIGINT) AS a_chars, "
          f"CAST(length(b_text) AS BIGINT) AS b_chars FROM {_PAIRS_SQL}")
def q_comparison_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a_id", "b_id", F.length("a_text").alias("a_chars"),
                                        F.length("b_text").alias("b_chars"))


@register("comparison_prompt",
          f"SELECT a_id, b_id, {dk.lit(pr.COMPARISON_HEAD)} || a_text || {dk.lit(pr.COMPARISON_MID)} "
          f"|| b_text || {dk.lit(pr.COMPARISON_TAIL)} AS prompt FROM {_PAIRS_SQL}")
def q_comparison_prompt(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a_id", "b_id",
                                        pr.comparison_prompt("a_text", "b_text").alias("prompt"))


def _pick_sql(role, table) -> str:
    return (f"CASE {role} WHEN 'initial' THEN {dk.lit(table['initial'])} WHEN 'final' THEN "
            f"{dk.lit(table['final'])} ELSE {dk.lit(table['middle'])} END")


_LABEL_SQL = ("'Parte ' || CAST(chunk_index + 1 AS VARCHAR) || '/' || CAST(coalesce(total_chunks, 1) AS VARCHAR) "
              f"|| {dk.lit(fixed.CHUNK_LABEL_SECTION)} || coalesce(section, {dk.lit(fixed.DEFAULT_CHUNK_SECTION)}) "
              f"|| CASE WHEN coalesce(chunk_part, '') <> '' THEN {dk.lit(fixed.CHUNK_LABEL_SUBPART)} || chunk_part "
              "|| ')' ELSE '' END")
_ROLE_SQL = ("CASE WHEN chunk_index = 0 THEN 'initial' WHEN chunk_index = coalesce(total_chunks, 1) - 1 "
             "THEN 'final' ELSE 'middle' END")
_CHUNK_PROMPTS_SQL = f"""
SELECT doc_id, chunk_index, role, label,
       {_truncate_sql(f"({_pick_sql('role', pr.CHUNK_HEAD)} || label || {_pick_sql('role', pr.CHUNK_FOCUS)} || text || {_pick_sql('role', pr.CHUNK_TAIL)})", fixed.PROMPT_CHAR_LIMIT)} AS prompt
FROM (SELECT *, {_ROLE_SQL} AS role, {_LABEL_SQL} AS label FROM ({_chunks_sql(CHUNK_SIZE)}))"""


@register("chunk_prompts", _CHUNK_PROMPTS_SQL)
def q_chunk_prompts(spark, sf_dir):
    c = rq.chunk_prompts(ch.split_chunks(papers(spark, sf_dir), CHUNK_SIZE))
    return c.select("doc_id", "chunk_index", "role", "label", "prompt")


@register("chat_requests",
          f"SELECT doc_id AS request_id, {dk.lit(fixed.DEFAULT_MODEL)} AS model, CAST(2 AS BIGINT) AS n_messages, "
          f"{dk.lit(pr.SYSTEM_MESSAGE)} AS system, {_truncate_sql(_analysis_prompt_sql('structured'), fixed.PROMPT_CHAR_LIMIT)} AS prompt, "
          f"CAST({fixed.DEFAULT_TEMPERATURE} AS DOUBLE) AS temperature, CAST({fixed.ANSWER_TOKEN_CAP} AS BIGINT) AS max_tokens "
          f"FROM ({_PRE_SQL})")
def q_chat_requests(spark, sf_dir):
    d = rq.preprocess(extracted_papers(spark, sf_dir), CHUNK_SIZE, cleaned=True)
    r = rq.chat_requests(d.withColumn("prompt", pr.truncate_prompt(pr.analysis_prompt("structured"))),
                         max_tokens=8000)
    return r.select(F.col("doc_id").alias("request_id"), "request.model",
                    F.size("request.messages").alias("n_messages"),
                    F.col("request.messages")[0]["content"].alias("system"),
                    F.col("request.messages")[1]["content"].alias("prompt"),
                    "request.temperature", "request.max_tokens")


# ---------------------------------------------------------------- answers --

_ATT_SQL = fx.duck_sql_text(fx.F_ATT)


@register("first_success", f"""
SELECT request_id, CAST(attempt AS BIGINT) AS attempt, ok, content, attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ok DESC,
                               CASE WHEN ok THEN attempt ELSE -attempt END) AS rn,
         count(*) OVER (PARTITION BY request_id) AS attempts
  FROM ({_ATT_SQL}) WHERE attempt <= {fixed.MAX_ATTEMPTS}) WHERE rn = 1""")
def q_first_success(spark, sf_dir):
    return rs.first_success(fx.attempts(spark, sf_dir))


_RESP_SQL = fx.duck_sql_text(fx.F_RESP)


@register("response_join", f"""
SELECT d.doc_id AS request_id, r.content, r.doc_id IS NOT NULL AS answered
FROM documents d LEFT JOIN (SELECT * FROM ({_RESP_SQL}) WHERE doc_id IN (SELECT doc_id FROM labels)) r
  ON d.doc_id = r.doc_id""")
def q_response_join(spark, sf_dir):
    reqs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"))
    resp = (fx.responses(spark, sf_dir)
            .join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
            .select(F.col("doc_id").alias("request_id"), "content"))
    return rs.response_join(reqs, resp).select("request_id", "content", "answered")


def _fenced_sql(c: str) -> str:
    return (f"CASE WHEN strpos({c}, '```json') > 0 THEN {dk.py_strip(f'split_part(split_part({c}, {dk.lit(chr(96) * 3 + 'json')}, 2), {dk.lit(chr(96) * 3)}, 1)')} "
            f"WHEN strpos({c}, '```') > 0 THEN {dk.py_strip(f'split_part({c}, {dk.lit(chr(96) * 3)}, 2)')} ELSE {c} END")


@register("fenced_json", f"SELECT doc_id, kind, {_fenced_sql('content')} AS js FROM ({_RESP_SQL})")
def q_fenced_json(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("doc_id", "kind", an.fenced_json("content").alias("js"))


def _parse_sql(src: str, name: str) -> str:
    """Parse branches in DuckDB (json_valid is strict about trailing text)."""
    kn = f"json_extract(js, '$.nombre')::VARCHAR"
    falsy = (f"(json_type(js, '$.nombre') IS NULL OR {kn} IN ('null', '\"\"', 'false', '[]', '{{}}') "
             f"OR (json_type(js, '$.nombre') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {kn}::DOUBLE = 0))")
    fb = dk.lit(fixed.FALLBACK_NOT_AVAILABLE)
    err = lambda msg: dk.lit(fixed.ERROR_PREFIX) + " || " + msg
    type_msg = (f"CASE t WHEN 'ARRAY' THEN {dk.lit(fixed.ERROR_LIST)} "
                f"WHEN 'VARCHAR' THEN CASE WHEN strpos(js::JSON->>'$', 'nombre') > 0 THEN {dk.lit(fixed.ERROR_STR_INDEX)} ELSE {dk.lit(fixed.ERROR_STR_ASSIGN)} END "
                f"WHEN 'NULL' THEN {dk.lit(fixed.ERROR_NOT_ITERABLE.format('NoneType'))} "
                f"WHEN 'BOOLEAN' THEN {dk.lit(fixed.ERROR_NOT_ITERABLE.format('bool'))} "
                f"WHEN 'DOUBLE' THEN {dk.lit(fixed.ERROR_NOT_ITERABLE.format('float'))} "
                f"ELSE {dk.lit(fixed.ERROR_NOT_ITERABLE.format('int'))} END")
    return f"""
SELECT *,
  CASE branch WHEN 'parsed' THEN CASE WHEN {falsy} THEN {name} ELSE json_extract_string(js, '$.nombre') END
              ELSE {name} END AS nombre,
  CASE branch WHEN 'parsed' THEN json_extract_string(js, '$.resumen')
              WHEN 'fallback' THEN {dk.py_strip('content')} ELSE {dk.lit(fixed.ERROR_SUMMARY)} END AS resumen,
  CASE branch WHEN 'parsed' THEN json_extract_string(js, '$.resultados')
              WHEN 'fallback' THEN {fb} ELSE {dk.lit(fixed.ERROR_RESULTS)} END AS resultados,
  CASE WHEN branch = 'parsed' THEN CASE json_extract(js, '$.exito')::VARCHAR WHEN 'true' THEN true
       WHEN 'false' THEN false END END AS exito,
  CASE branch WHEN 'parsed' THEN json_extract_string(js, '$.performance')
              WHEN 'fallback' THEN {fb} ELSE {dk.lit(fixed.ERROR_PERFORMANCE)} END AS performance,
  CASE branch WHEN 'parsed' THEN json_extract_string(js, '$.error')
              WHEN 'error' THEN {err(f"CASE WHEN content IS NULL THEN {dk.lit(fixed.ERROR_NONE_CONTENT)} ELSE {type_msg} END")} END AS error,
  CASE branch WHEN 'parsed' THEN array_to_string(json_keys(js), ',')
                   || CASE WHEN json_type(js, '$.nombre') IS NULL THEN ',nombre' ELSE '' END
              WHEN 'fallback' THEN 'nombre,resumen,resultados,exito,performance'
              ELSE 'nombre,error,resumen,resultados,exito,performance' END AS keys
FROM (
  SELECT *, CASE WHEN content IS NULL THEN 'error' WHEN NOT valid THEN 'fallback'
                 WHEN t = 'OBJECT' THEN 'parsed' ELSE 'error' END AS branch
  FROM (SELECT *, json_type(js) AS t
        FROM (SELECT * EXCLUDE (js0), CASE WHEN json_valid(js0) THEN js0 END AS js, js0 IS NOT NULL AND json_valid(js0) AS valid
              FROM (SELECT *, {_fenced_sql('content')} AS js0 FROM {src}))))"""


_PARSE_COLS = "doc_id, kind, branch, nombre, resumen, resultados, exito, performance, error, keys"


@register("parse_response",
          f"SELECT {_PARSE_COLS} FROM ({_parse_sql(f'(SELECT *, {_NAME_SQL} AS paper_name FROM ({_RESP_SQL}))', 'paper_name')})")
def q_parse_response(spark, sf_dir):
    r = fx.responses(spark, sf_dir).withColumn("paper_name", paper_name("doc_id"))
    return rs.analysis_columns(rs.parse_response(r)).select(*_PARSE_COLS.split(", "))



# ------------------------------------------------------ merge and reports --

_PART_SQL = fx.duck_sql_text(fx.F_PART)


@register("merge_results", f"""
WITH w AS (SELECT *, max(CASE WHEN NOT is_str THEN seq END) OVER (PARTITION BY conv_id, k) AS L,
                  max(seq) OVER (PARTITION BY conv_id, k) AS last FROM ({_PART_SQL}))
SELECT conv_id, k,
  CASE WHEN coalesce(max(L) = max(last), false) THEN arg_max(v, seq) FILTER (WHERE NOT is_str)
       ELSE string_agg(v, chr(10) || chr(10) ORDER BY seq) FILTER (WHERE is_str AND seq > coalesce(L, -1)) END AS merged,
  NOT coalesce(max(L) = max(last), false) AS merged_is_str
FROM w GROUP BY conv_id, k""")
def q_merge_results(spark, sf_dir):
    return mg.merge_results(fx.partials(spark, sf_dir))


def _render_sql(js: str, key: str) -> str:
    """str(value) of a present key (NULL when the key is missing)."""
    path = f"'$.\"' || {key} || '\"'" if not key.startswith("'") else f"'$.{key[1:-1]}'"
    return (f"CASE json_type({js}, {path}) WHEN 'VARCHAR' THEN json_extract_string({js}, {path}) "
            f"WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN json_extract({js}, {path})::VARCHAR = 'true' "
            f"THEN 'True' ELSE 'False' END WHEN 'ARRAY' THEN '[' || array_to_string(list_transform("
            f"TRY_CAST(json_extract({js}, {path}) AS VARCHAR[]), lambda x: chr(39) || x || chr(39)), ', ') || ']' "
            f"ELSE json_extract({js}, {path})::VARCHAR END")


def _known_sql(key: str, default: str, fallback: str, error: str) -> str:
    return (f"CASE branch WHEN 'parsed' THEN coalesce({_render_sql('js', dk.lit(key))}, {dk.lit(default)}) "
            f"WHEN 'fallback' THEN {fallback} ELSE {error} END")


_KNOWN_LIST = ", ".join(dk.lit(k) for k in fixed.KNOWN_KEYS)


def _block_sql() -> str:
    extras = (f"CASE branch WHEN 'parsed' THEN array_to_string(list_transform(list_filter(json_keys(js), "
              f"lambda k: k NOT IN ({_KNOWN_LIST})), lambda k: k || ': ' || {_render_sql('js', 'k')} || chr(10)), '') "
              f"WHEN 'fallback' THEN '' ELSE 'error: ' || error || chr(10) END")
    fb = dk.lit(fixed.FALLBACK_NOT_AVAILABLE)
    summary = _known_sql(fixed.KEY_SUMMARY, fixed.NOT_AVAILABLE, dk.py_strip("content"), dk.lit(fixed.ERROR_SUMMARY))
    results = _known_sql(fixed.KEY_RESULTS, fixed.NOT_AVAILABLE, fb, dk.lit(fixed.ERROR_RESULTS))
    return (f"(chr(10) || {dk.lit(fixed.CONSOLIDATION_PART)} || CAST(chunk_index + 1 AS VARCHAR) || ':' || chr(10) "
            f"|| {dk.lit(fixed.CONSOLIDATION_SUMMARY)} || {summary} || chr(10) "
            f"|| {dk.lit(fixed.CONSOLIDATION_RESULTS)} || {results} || chr(10) || {extras})")


_CHUNK_NAME_SQL = "'paper_' || CAST(doc_id AS VARCHAR) || '.pdf_chunk_' || CAST(chunk_index + 1 AS VARCHAR)"
_CHUNK_ANSWERS_SQL = _parse_sql(
    f"(SELECT *, {_CHUNK_NAME_SQL} AS paper_name FROM "
    f"({fx.duck_sql_text(fx.F_CHUNK_RESP, chunks='(' + _chunks_sql(CHUNK_SIZE) + ')')}))", "paper_name")


def chunk_answers(spark, sf_dir) -> DataFrame:
    """Parsed answers to every chunk request of F-PAPERS (chunk_size 250)."""
    chunks = ch.split_chunks(papers(spark, sf_dir), CHUNK_SIZE)
    resp = fx.chunk_responses(chunks)
    named = resp.withColumn("paper_name", F.concat(paper_name("doc_id"), F.lit("_chunk_"),
                                                   (F.col("chunk_index") + 1).cast("string")))
    return rs.parse_response(named)


_CONSOLIDATION_SQL = f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_parts,
       {dk.lit(pr.CONSOLIDATION_HEAD[0])} || 'paper_' || CAST(doc_id AS VARCHAR) || '.pdf' || {dk.lit(pr.CONSOLIDATION_HEAD[1])}
       || string_agg(block, '' ORDER BY chunk_index) || {dk.lit(pr.CONSOLIDATION_TAIL)} AS prompt
FROM (SELECT doc_id, chunk_index, {_block_sql()} AS block FROM ({_CHUNK_ANSWERS_SQL})) GROUP BY doc_id"""


@register("consolidation_prompt", _CONSOLIDATION_SQL)
def q_consolidation_prompt(spark, sf_dir):
    answers = chunk_answers(spark, sf_dir).withColumn("paper_name", paper_name("doc_id"))
    return mg.consolidation_prompt(answers).select("doc_id", "n_parts", "prompt")


_RUN_SQL = fx.duck_sql_text(fx.F_RUN)


@register("status_filter", f"SELECT doc_id, nombre, error FROM ({_RUN_SQL}) WHERE status = 'error'")
def q_status_filter(spark, sf_dir):
    return rp.with_status(fx.run_results(spark, sf_dir), fixed.STATUS_ERROR).select("doc_id", "nombre", "error")


@register("result_union", f"""
SELECT doc_id, nombre, status, '/out/paper_' || CAST(doc_id AS VARCHAR) || '.json' AS output_path, NULL AS error
FROM ({_RUN_SQL}) WHERE status = 'success'
UNION ALL
SELECT doc_id, nombre, status, NULL AS output_path, error FROM ({_RUN_SQL}) WHERE status = 'error'""")
def q_result_union(spark, sf_dir):
    run = fx.run_results(spark, sf_dir)
    ok = (rp.with_status(run, fixed.STATUS_SUCCESS)
          .select("doc_id", "nombre", "status",
                  F.concat(F.lit("/out/paper_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("output_path")))
    err = rp.with_status(run, fixed.STATUS_ERROR).select("doc_id", "nombre", "status", "error")
    return mg.result_union(ok, err)


@register("processing_summary", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successes,
       count(*) FILTER (WHERE status = 'error') AS errors FROM ({_RUN_SQL})""")
def q_processing_summary(spark, sf_dir):
    return rp.processing_summary(fx.run_results(spark, sf_dir))


def _summary_sql() -> str:
    def row(block, n, line):
        return (f"SELECT CAST({block} AS BIGINT) AS block, CAST(NULL AS VARCHAR) AS sort_key, "
                f"CAST({n} AS BIGINT) AS n, {line} AS line FROM c")
    L = dk.lit
    head = [row(0, 0, f"CASE WHEN total = 0 THEN {L(fixed.SUMMARY_EMPTY)} ELSE {L(fixed.SUMMARY_DONE)} END")]
    head += [row(0, i, f"{L(lbl)} || CAST({col} AS VARCHAR)") + " WHERE total > 0"
             for i, (lbl, col) in enumerate([(fixed.SUMMARY_TOTAL, "total"), (fixed.SUMMARY_OK, "successes"),
                                             (fixed.SUMMARY_ERR, "errors")], start=1)]
    head += [row(0, 4, "''") + " WHERE total > 0",
             row(1, 0, L(fixed.SUMMARY_OK_HEAD)) + " WHERE successes > 0",
             row(3, 0, "''") + " WHERE errors > 0",
             row(3, 1, L(fixed.SUMMARY_ERR_HEAD)) + " WHERE errors > 0"]
    name = f"coalesce(nombre, {L(fixed.SUMMARY_UNKNOWN_NAME)})"
    names = [f"SELECT CAST(2 AS BIGINT) AS block, {name} AS sort_key, CAST(0 AS BIGINT) AS n, '- ' || {name} AS line "
             f"FROM r WHERE status = 'success'",
             f"SELECT CAST(4 AS BIGINT) AS block, {name} AS sort_key, CAST(0 AS BIGINT) AS n, '- ' || {name} || ': ' || "
             f"coalesce(error, {L(fixed.SUMMARY_UNKNOWN_ERROR)}) AS line FROM r WHERE status = 'error'"]
    return (f"WITH r AS ({_RUN_SQL}), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') "
            f"AS successes, count(*) FILTER (WHERE status = 'error') AS errors FROM r)\n"
            + "\nUNION ALL\n".join(head + names))


@register("summary_listing", _summary_sql())
def q_summary_listing(spark, sf_dir):
    return rp.summary_listing(fx.run_results(spark, sf_dir))


_ANSWERS_SQL = _parse_sql(f"(SELECT *, {_NAME_SQL} AS paper_name FROM ({_RESP_SQL}))", "paper_name")


def answers(spark, sf_dir) -> DataFrame:
    r = fx.responses(spark, sf_dir).withColumn("paper_name", paper_name("doc_id"))
    return rs.parse_response(r)


def _defaults_sql() -> str:
    fb = dk.lit(fixed.FALLBACK_NOT_AVAILABLE)
    return (f"nombre AS title, "
            f"{_known_sql(fixed.KEY_SUMMARY, fixed.REPORT_DEFAULT_SUMMARY, dk.py_strip('content'), dk.lit(fixed.ERROR_SUMMARY))} AS summary, "
            f"{_known_sql(fixed.KEY_RESULTS, fixed.REPORT_DEFAULT_RESULTS, fb, dk.lit(fixed.ERROR_RESULTS))} AS results, "
            f"{_known_sql(fixed.KEY_PERFORMANCE, fixed.REPORT_DEFAULT_PERFORMANCE, fb, dk.lit(fixed.ERROR_PERFORMANCE))} AS performance_text")


@register("result_defaults", f"SELECT doc_id, {_defaults_sql()} FROM ({_ANSWERS_SQL})")
def q_result_defaults(spark, sf_dir):
    return rp.result_defaults(answers(spark, sf_dir)).select("doc_id", "title", "summary", "results",
                                                             "performance_text")


def _report_sql() -> str:
    ex = "json_extract(js, '$.exito')::VARCHAR"
    label = (f"CASE WHEN branch <> 'parsed' OR json_type(js, '$.exito') IS NULL OR json_type(js, '$.exito') = 'NULL' "
             f"THEN {dk.lit(fixed.REPORT_UNDETERMINED)} WHEN {ex} IN ('false', '\"\"', '[]', '{{}}') OR "
             f"(json_type(js, '$.exito') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {ex}::DOUBLE = 0) "
             f"THEN {dk.lit(fixed.REPORT_NO)} ELSE {dk.lit(fixed.REPORT_YES)} END")
    L = dk.lit
    return (f"SELECT doc_id, {L(chr(10) + fixed.REPORT_TITLE)} || title || "
            f"{L(chr(10) + fixed.REPORT_RULE + chr(10) * 2 + fixed.REPORT_SUMMARY + chr(10))} || summary || "
            f"{L(chr(10) * 2 + fixed.REPORT_RESULTS + chr(10))} || results || {L(chr(10) * 2 + fixed.REPORT_SUCCESS)} || "
            f"label || {L(chr(10) * 2 + fixed.REPORT_PERFORMANCE + chr(10))} || performance_text || chr(10) AS report "
            f"FROM (SELECT doc_id, {_defaults_sql()}, {label} AS label FROM ({_ANSWERS_SQL}))")


@register("human_report", _report_sql())
def q_human_report(spark, sf_dir):
    return rp.human_report(answers(spark, sf_dir)).select("doc_id", "report")


@register("strip_internal", f"SELECT doc_id, keys FROM ({_ANSWERS_SQL})")
def q_strip_internal(spark, sf_dir):
    a = answers(spark, sf_dir)
    meta = F.to_variant_object(F.struct(F.col("paper_name").alias("source_file")))
    with_meta = a.withColumn("analysis", F.map_concat("analysis", F.create_map(F.lit(fixed.METADATA_KEY), meta)))
    out = rp.strip_internal(with_meta, "analysis")
    return out.select("doc_id", F.array_join(F.map_keys("analysis"), ",").alias("keys"))


# -------------------------------------------------------- sources, sinks --

@register("doc_manifest",
          f"SELECT path, name, {_STEM_SQL} AS stem FROM (SELECT path, regexp_extract(path, '[^/]*$', 0) AS name "
          f"FROM ({_FILES_SQL})) WHERE lower(name) LIKE '%.pdf'")
def q_doc_manifest(spark, sf_dir):
    return src_files.doc_manifest(fx.files(spark, sf_dir))


@register("file_metadata",
          f"SELECT name, CASE WHEN size IS NOT NULL THEN {_STEM_SQL} END AS base_name, size, "
          f"CASE WHEN size IS NOT NULL THEN modified_epoch END AS modified_epoch, path FROM "
          f"(SELECT *, regexp_extract(path, '[^/]*$', 0) AS name FROM ({_FILES_SQL}))")
def q_file_metadata(spark, sf_dir):
    f = fx.files(spark, sf_dir).withColumn("modified", F.timestamp_seconds("modified_epoch"))
    m = src_files.file_metadata(f)
    return m.select("name", "base_name", "size", F.unix_seconds("modified").alias("modified_epoch"), "path")


@register("page_assembly", """
SELECT conv_id AS doc_id, string_agg(text || chr(10), '' ORDER BY turn) AS text, count(*) AS n_pages
FROM conversations GROUP BY conv_id""")
def q_page_assembly(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.col("text").alias("page_text"))
    return src_pages.assemble_pages(pages)


@register("latest_by_stem", """
SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars
FROM documents GROUP BY source""")
def q_latest_by_stem(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return mg.latest_by_key(d, "source", "doc_id")


@register("skip_processed", """
SELECT '/in/paper_' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, 'paper_' || CAST(doc_id AS VARCHAR) AS stem
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_skip_processed(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), paper_name("doc_id")).alias("path"))
    files = files.withColumn("stem", tx.paper_stem("path"))
    done = table(spark, sf_dir, "labels").select(tx.paper_stem(paper_name("doc_id")).alias("stem"))
    return jn.skip_processed(files, done)


_SAVE_COLS = "stem, source_file, branch, nombre, resumen, resultados, exito, performance, error, keys"


@register("save_analysis", f"""
SELECT 'paper_' || CAST(doc_id AS VARCHAR) AS stem, paper_name AS source_file, branch, nombre, resumen, resultados,
       exito, performance, error, keys || ',__metadata__' AS keys FROM ({_ANSWERS_SQL})""")
def q_save_analysis(spark, sf_dir):
    path = scratch_path(spark, "save_analysis")
    a = answers(spark, sf_dir)
    sink.save_analyses(a.select("paper_name", "analysis"), path, run_ts="2026-01-01T00:00:00")
    back = sink.latest_analyses(spark, path)
    typed = rs.analysis_columns(back)
    branch = (F.when(F.map_contains_key("analysis", F.lit(fixed.KEY_ERROR))
                     & (F.col("resumen") == F.lit(fixed.ERROR_SUMMARY)), F.lit("error"))
              .when(F.col("resultados") == F.lit(fixed.FALLBACK_NOT_AVAILABLE), F.lit("fallback"))
              .otherwise(F.lit("parsed")))
    return typed.withColumn("branch", branch).select(*_SAVE_COLS.split(", "))


@register("processed_keys", "SELECT DISTINCT 'paper_' || CAST(doc_id AS VARCHAR) AS stem FROM labels")
def q_processed_keys(spark, sf_dir):
    path = scratch_path(spark, "processed_keys")
    done = table(spark, sf_dir, "labels").select(
        paper_name("doc_id").alias("paper_name"),
        F.create_map(F.lit(fixed.KEY_NAME), paper_name("doc_id").cast("variant")).alias("analysis"))
    sink.save_analyses(done, path, run_ts="2026-01-01T00:00:00")
    return sink.processed_keys(spark, path).distinct()



# ------------------------------------------------------------------ flows --

FLOW_COLS = "doc_id, prompt, branch, nombre, resumen, resultados, exito, performance, error, keys"


def named_papers(spark, sf_dir) -> DataFrame:
    return fx.papers(spark, sf_dir).withColumn("paper_name", paper_name("doc_id"))


def _table_responder(spark, sf_dir):
    return fl.table_responder(fx.responses(spark, sf_dir), ["doc_id"])


def _flow_out(df: DataFrame, extra=()) -> DataFrame:
    return rs.analysis_columns(df).select(*FLOW_COLS.split(", "), *extra)


def _flow_sql(requests_sql: str, extra: str = "") -> str:
    src = (f"(SELECT q.*, r.kind, r.content, {_NAME_SQL.replace('doc_id', 'q.doc_id')} AS paper_name "
           f"FROM ({requests_sql}) q LEFT JOIN ({_RESP_SQL}) r ON q.doc_id = r.doc_id)")
    return f"SELECT {FLOW_COLS}{extra} FROM ({_parse_sql(src, 'paper_name')})"


_PROMPT_OF = lambda x: _truncate_sql(_analysis_prompt_sql(x), fixed.PROMPT_CHAR_LIMIT)


@register("flow_direct", _flow_sql(f"SELECT doc_id, {_PROMPT_OF('structured')} AS prompt FROM ({_PRE_SQL})"))
def q_flow_direct(spark, sf_dir):
    return _flow_out(fl.flow_direct(named_papers(spark, sf_dir), _table_responder(spark, sf_dir), CHUNK_SIZE))


_FIRST_SQL = (f"SELECT c.doc_id, {_PROMPT_OF(_structured_sql(dk.clean('c.text'), _header_sql()))} AS prompt "
              f"FROM (SELECT * FROM ({_chunks_sql(CHUNK_SIZE)}) WHERE chunk_index = 0) c "
              f"JOIN {D_EXTRACTED} m ON c.doc_id = m.doc_id")


@register("flow_first_chunk", _flow_sql(_FIRST_SQL))
def q_flow_first_chunk(spark, sf_dir):
    return _flow_out(fl.flow_first_chunk(named_papers(spark, sf_dir), _table_responder(spark, sf_dir),
                                         CHUNK_SIZE))


_MULTI_DOCS = f"(SELECT doc_id FROM {D_PAPERS} WHERE length(text) // 4 > {CHUNK_SIZE})"
_MR_REQUESTS = (f"SELECT doc_id, CAST(1 AS BIGINT) AS n_parts, {_PROMPT_OF('structured')} AS prompt FROM ({_PRE_SQL}) "
                f"WHERE doc_id NOT IN {_MULTI_DOCS} "
                f"UNION ALL SELECT doc_id, n_parts, {_truncate_sql('prompt', fixed.PROMPT_CHAR_LIMIT)} AS prompt "
                f"FROM ({_CONSOLIDATION_SQL}) WHERE doc_id IN {_MULTI_DOCS}")


def _chunk_text(prompt: str) -> F.Column:
    """The chunk in a chunk request, read back from its prompt."""
    out = F.lit(None).cast("string")
    for role in ("initial", "middle", "final"):
        focus, tail = pr.CHUNK_FOCUS[role], pr.CHUNK_TAIL[role]
        begin = F.instr(prompt, focus) + len(focus)
        out = F.when(F.instr(prompt, focus) > 0, F.substr(
            F.col(prompt), begin, F.length(prompt) - begin + 1 - len(tail))).otherwise(out)
    return out


def _fixture_model(spark, sf_dir):
    """Deterministic stand-in for the model in both stages: chunk requests
    get F-CHUNK-RESP answers, whole-paper and consolidation requests the
    paper's F-RESP answer."""
    per_paper = fl.table_responder(fx.responses(spark, sf_dir), ["doc_id"])

    def respond(requests: DataFrame) -> DataFrame:
        if "_single" not in requests.columns:
            return per_paper(requests)
        c = fx.chunk_responses(requests.withColumn("text", _chunk_text("prompt"))).withColumnRenamed(
            "content", "_cc").drop("kind", "j", "s", "text")
        f = per_paper(c).withColumnRenamed("content", "_fc")
        return (f.withColumn("content", F.when(F.col("_single"), F.col("_fc")).otherwise(F.col("_cc")))
                .drop("_cc", "_fc"))
    return respond


@register("flow_map_reduce", _flow_sql(_MR_REQUESTS, ", n_parts"))
def q_flow_map_reduce(spark, sf_dir):
    """With each paper's last request."""
    return _flow_out(fl.flow_map_reduce(named_papers(spark, sf_dir), _fixture_model(spark, sf_dir), CHUNK_SIZE),
                     ["n_parts"])


_FS_SQL = ORACLE["first_success"]


def _called(spark, sf_dir) -> DataFrame:
    """F-ATT as the outcome of each paper's call: doc_id, ok, content, call_error."""
    fs = rs.first_success(fx.attempts(spark, sf_dir))
    return fs.select(F.col("request_id").alias("doc_id"), "ok", F.when(F.col("ok"), F.col("content")).alias("content"),
                     F.when(~F.col("ok"), F.col("content")).alias("call_error"))


@register("flow_call_failures", f"""
SELECT q.doc_id, CASE WHEN ok THEN 'parsed' ELSE 'failed' END AS branch,
       CASE WHEN ok THEN json_extract_string(content, '$.nombre') END AS nombre,
       CASE WHEN ok THEN json_extract_string(content, '$.resumen') END AS resumen,
       CASE WHEN NOT ok THEN content END AS call_error, sha256(prompt) AS prompt_sha256
FROM ({_FS_SQL}) JOIN ({_FIRST_SQL}) q ON request_id = q.doc_id""")
def q_flow_call_failures(spark, sf_dir):
    """Papers whose calls all failed keep their row, without an analysis."""
    respond = fl.table_responder(_called(spark, sf_dir), ["doc_id"])
    out = rs.analysis_columns(fl.flow_first_chunk(named_papers(spark, sf_dir), respond, CHUNK_SIZE))
    return out.select("doc_id", "branch", "nombre", "resumen", "call_error",
                      F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


@register("flow_chunk_failures", f"""
SELECT doc_id, count(*) AS n_parts, bool_and(NOT bad) AS ok,
       'down ' || CAST(min(CASE WHEN bad THEN chunk_index END) AS VARCHAR) AS call_error
FROM (SELECT doc_id, chunk_index, (doc_id + chunk_index) % 11 = 3 AS bad FROM ({_chunks_sql(CHUNK_SIZE)}))
GROUP BY doc_id""")
def q_flow_chunk_failures(spark, sf_dir):
    """One failed chunk call makes the paper fail, with the first one's error."""
    model = _fixture_model(spark, sf_dir)

    def respond(requests: DataFrame) -> DataFrame:
        out = model(requests)
        if "chunk_index" not in requests.columns:
            return out
        bad = (F.col("doc_id") + F.col("chunk_index")) % 11 == 3
        return out.withColumns({"ok": ~bad, "call_error": F.when(bad, F.concat(
            F.lit("down "), F.col("chunk_index").cast("string")))})

    out = fl.flow_map_reduce(named_papers(spark, sf_dir), respond, CHUNK_SIZE)
    return out.select("doc_id", "n_parts", "ok", "call_error")


def _batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = named_papers(spark, sf_dir).select("doc_id", "text", "paper_name")
    done = table(spark, sf_dir, "labels").select(tx.paper_stem(paper_name("doc_id")).alias("stem"))
    called = fl.table_responder(_called(spark, sf_dir).select("doc_id", "ok", "call_error", F.lit("").alias("content")),
                                ["doc_id"])

    def respond(requests: DataFrame) -> DataFrame:
        """Answers with the digest of the whole prompt as the summary."""
        said = F.concat(F.lit('{"nombre":"P'), F.col("doc_id").cast("string"), F.lit('","resumen":"'),
                        F.sha2(F.col("prompt").cast("binary"), 256), F.lit('"}'))
        return called(requests).withColumn("content", F.when(F.col("ok"), said))

    return fl.run_batch(docs, respond, scratch_path(spark, "batch"), "2026-01-01T00:00:00", CHUNK_SIZE, done=done)


_TODO_SQL = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


@register("flow_batch_report", f"""
SELECT 'paper_' || CAST(t.doc_id AS VARCHAR) AS stem,
       CASE WHEN fs.ok THEN 'P' || CAST(t.doc_id AS VARCHAR)
            ELSE 'paper_' || CAST(t.doc_id AS VARCHAR) || '.pdf' END AS nombre,
       CASE WHEN fs.ok THEN sha256(q.prompt) END AS resumen,
       CASE WHEN fs.ok THEN 'success' ELSE 'error' END AS status, fs.ok AS saved,
       CASE WHEN NOT fs.ok THEN {dk.lit(fixed.PAPER_ERROR_PREFIX)} || content END AS error
FROM ({_TODO_SQL}) t JOIN ({_FS_SQL}) fs ON t.doc_id = fs.request_id
JOIN ({_FIRST_SQL}) q ON q.doc_id = t.doc_id""")
def q_flow_batch_report(spark, sf_dir):
    """The whole batch: skip, first-chunk flow, store, result rows."""
    results, _ = _batch(spark, sf_dir)
    return results.select("stem", "nombre", "resumen", "status", F.col("output_path").isNotNull().alias("saved"), "error")


@register("batch_summary", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE fs.ok) AS successes, count(*) FILTER (WHERE NOT fs.ok) AS errors
FROM ({_TODO_SQL}) t JOIN ({_FS_SQL}) fs ON t.doc_id = fs.request_id""")
def q_batch_summary(spark, sf_dir):
    return _batch(spark, sf_dir)[1]


_LISTED_SQL = f"""
SELECT f.doc_id, regexp_extract(f.path, '[^/]*$', 0) AS paper_name, g.text AS text, coalesce(n_pages, 0) AS n_pages
FROM ({_FILES_SQL}) f LEFT JOIN (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text, count(*) AS n_pages
                                 FROM conversations GROUP BY conv_id) g ON f.doc_id = g.conv_id
WHERE lower(regexp_extract(f.path, '[^/]*$', 0)) LIKE '%.pdf'"""


@register("listed_papers", f"SELECT paper_name, {_STEM_SQL.replace('name', 'paper_name')} AS stem, "
                           f"{dk.normalize('text')} AS text, n_pages FROM ({_LISTED_SQL})")
def q_listed_papers(spark, sf_dir):
    """Listing -> manifest -> page texts -> cleaned papers."""
    files = fx.files(spark, sf_dir)
    pages = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("page_no"), F.col("text").alias("page_text"))
    pages = files.select("path", "doc_id").join(pages, F.col("doc_id") == F.col("conv_id"))
    out = src_pages.listed_papers(files, pages)
    return out.select("paper_name", "stem", tx.normalize_text("text").alias("text"), "n_pages")


@register("incremental_ingest", f"""
SELECT 'paper_' || CAST(doc_id AS VARCHAR) AS stem, branch, nombre, resumen, resultados, exito, performance,
       error, keys || ',__metadata__' AS keys FROM ({_parse_sql(f'(SELECT *, {_NAME_SQL} AS paper_name FROM ({_RESP_SQL}))', 'paper_name')})""")
def q_incremental_ingest(spark, sf_dir):
    """Stage the documents as input files (two or more), stream them in twice:
    the second run finds nothing new, so each paper appears once."""
    from ..streaming import ingest
    base = scratch_path(spark, "ingest")
    in_dir, out_dir, ckpt = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    docs = table(spark, sf_dir, "documents").select("doc_id", paper_name("doc_id").alias("paper_name"), "text")
    ingest.stage_documents(docs, in_dir)
    answers = _table_responder(spark, sf_dir)

    def respond(requests: DataFrame) -> DataFrame:
        """The paper's answer, to a request that has a prompt."""
        return answers(requests).withColumn("content", F.when(F.length("prompt") > 0, F.col("content")))

    for _ in range(2):
        ingest.ingest_stream(spark, in_dir, out_dir, ckpt, respond, CHUNK_SIZE)
    back = rs.analysis_columns(sink.read_analyses(spark, out_dir))
    branch = (F.when(F.map_contains_key("analysis", F.lit(fixed.KEY_ERROR))
                     & (F.col("resumen") == F.lit(fixed.ERROR_SUMMARY)), F.lit("error"))
              .when(F.col("resultados") == F.lit(fixed.FALLBACK_NOT_AVAILABLE), F.lit("fallback"))
              .otherwise(F.lit("parsed")))
    return back.withColumn("branch", branch).select(
        "stem", "branch", "nombre", "resumen", "resultados", "exito", "performance", "error", "keys")



# ------------------------------------------- parts of other operators --

@register("nonblank_preamble",
          f"SELECT doc_id, text FROM ({dk.cascade_sql(D_PAPERS)}) WHERE section = 'preambulo'")
def q_nonblank_preamble(spark, sf_dir):
    return se.section_cascade(papers(spark, sf_dir)).filter(
        F.col("section") == fixed.PREAMBLE_SECTION).select("doc_id", "text")


@register("last_section_wins",
          f"SELECT doc_id, section, arg_max(text, seq) AS text, CAST(count(*) AS BIGINT) AS n_segments "
          f"FROM ({dk.segments_sql(D_PAPERS)}) GROUP BY doc_id, section")
def q_last_section_wins(spark, sf_dir):
    """The library's last segment per name, beside how many there were."""
    p = papers(spark, sf_dir)
    n = se.section_segments(p).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_segments"))
    return se.paper_sections(p).join(n, ["doc_id", "section"]).select("doc_id", "section", "text", "n_segments")


@register("section_order",
          f"SELECT doc_id, seq, start_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) AS BIGINT) "
          f"AS rank FROM ({dk.segments_sql(D_PAPERS)})")
def q_section_order(spark, sf_dir):
    segs = se.section_segments(papers(spark, sf_dir)).select("doc_id", "seq", "start_pos")
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    return segs.withColumn("rank", F.row_number().over(w))


@register("chunk_order",
          f"SELECT doc_id, chunk_index, section, chunk_part FROM ({_chunks_sql(CHUNK_SIZE)})")
def q_chunk_order(spark, sf_dir):
    return ch.split_chunks(papers(spark, sf_dir), CHUNK_SIZE).select("doc_id", "chunk_index", "section", "chunk_part")


@register("merge_metadata", f"""
SELECT c.doc_id, c.chunk_index, m.title, m.authors, m.arxiv_id, c.section, c.chunk_part, c.total_chunks
FROM ({_chunks_sql(CHUNK_SIZE)}) c JOIN {D_EXTRACTED} m ON c.doc_id = m.doc_id""")
def q_merge_metadata(spark, sf_dir):
    d = extracted_papers(spark, sf_dir).withColumn("text", tx.reclean("text"))
    c = ch.split_chunks(d, CHUNK_SIZE, keep=("title", "authors", "arxiv_id"))
    both = c.select("doc_id", "chunk_index",
                    F.struct("title", "authors", "arxiv_id").alias("paper"),
                    F.struct("section", "chunk_part", "total_chunks").alias("chunk"))
    merged = rq.merge_metadata(both, "paper", "chunk")
    return merged.select("doc_id", "chunk_index", "metadata.*")


# ------------------------------------------------------------- flagship --

def flagship(spark, sf_dir):
    """The intended end-to-end flow: chunk requests, parsed answers,
    consolidation, final analyses."""
    return QUERIES["flow_map_reduce"](spark, sf_dir)
