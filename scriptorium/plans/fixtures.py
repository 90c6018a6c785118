"""Derived inputs, written once as SQL and run by both engines.

The driver's tables carry no headings, fences or page structure, so the
inputs each operator needs are derived from them by the statements below
(Spark and DuckDB run the same text; ``{S}`` is the string type).  Each
statement reads whole tables, so its work grows with the data.

Table placeholders are ``{documents}``, ``{conversations}``, ``{labels}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "labels", "pages")
PLACEHOLDERS = TABLES + ("chunks",)

# F-PAPERS: documents with headings, four layouts by doc_id % 4.
F_PAPERS = r"""
with b as (select doc_id, text, CAST(floor(length(text)/7) AS INT) as k, doc_id % 4 as v from {documents}),
p as (select doc_id, v, substr(text,1,k) as s0, substr(text,k+1,k) as s1, substr(text,2*k+1,k) as s2,
             substr(text,3*k+1,k) as s3, substr(text,4*k+1,k) as s4, substr(text,5*k+1,k) as s5,
             substr(text,6*k+1) as s6 from b)
select doc_id, CASE v
 WHEN 0 THEN s0 || ' arXiv:2401.' || lpad(CAST(doc_id AS {S}),5,'0') || 'v1 Abstract ' || s1 || ' 1. Introduction ' || s2
          || ' 2. Methodology ' || s3 || ' 3. Results ' || s4 || ' 4. Conclusion ' || s5 || ' References ' || s6
 WHEN 1 THEN s0 || ' Conclusion ' || s1 || ' Results ' || s2 || ' Method ' || s3 || ' Introduction ' || s4
          || ' Abstract ' || s5 || ' Bibliography ' || s6
 WHEN 2 THEN s0 || ' Introduction ' || s1 || s2 || ' Evaluation ' || s3 || s4 || ' Discussion ' || s5
          || ' Experiment ' || s6
 ELSE s0 || s1 || s2 || s3 || s4 || s5 || s6 END as text
from p
"""

def _json_string(text: str) -> str:
    """The inside of a JSON string holding ``text`` (SQL of both engines)."""
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for code, letter in ((34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        out = f"replace({out}, chr({code}), chr(92) || {letter})"
    return out


# F-RESP: model answers that carry the document's whole text, one kind per
# parse branch (doc_id % 9).
F_RESP = r"""
select doc_id, doc_id % 9 as kind, CASE doc_id % 9
 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```'
 WHEN 1 THEN j
 WHEN 2 THEN '```' || chr(10) || j || chr(10) || '```'
 WHEN 3 THEN 'Here you go: ```json' || j || '``` hope it helps ```json {{}} ```'
 WHEN 4 THEN ' plain prose, no json: ' || text || ' '
 WHEN 5 THEN '{{"nombre":"","resumen":"' || s || '","exito":false}}'
 WHEN 6 THEN '[1,"' || s || '"]'
 WHEN 7 THEN '```python' || chr(10) || j || '```'
 ELSE NULL END as content
from (select doc_id, text, s, '{{"nombre":"P' || CAST(doc_id AS {S}) || '","resumen":"' || s
      || '","exito":true,"performance":0.5,"extra":["a","b"]}}' as j
      from (select doc_id, text, @TEXT@ as s from {documents}) d) t
""".replace("@TEXT@", _json_string("text"))

# F-CHUNK-RESP: answers to chunk requests, one kind per parse branch by
# (doc_id + chunk_index) % 9, with the chunk's text and extra keys of every JSON type.
F_CHUNK_RESP = r"""
select t.*, (doc_id + chunk_index) % 9 as kind, CASE (doc_id + chunk_index) % 9
 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```'
 WHEN 1 THEN j
 WHEN 2 THEN '```' || chr(10) || j || chr(10) || '```'
 WHEN 3 THEN 'Here you go: ```json' || j || '``` hope it helps ```json {{}} ```'
 WHEN 4 THEN ' plain prose, no json: ' || text || ' '
 WHEN 5 THEN '{{"nombre":"","resumen":"' || s || '","exito":false}}'
 WHEN 6 THEN '[1,"' || s || '"]'
 WHEN 7 THEN '```python' || chr(10) || j || '```'
 ELSE NULL END as content
from (select *, '{{"resumen":"R' || CAST(doc_id AS {S}) || '.' || CAST(chunk_index AS {S}) || ' ' || s
      || '","resultados":"S' || CAST(chunk_index AS {S}) || '","conceptos_clave":["a","b"],"score":0.5,'
      || '"ok":true,"none":null}}' as j from (select *, @TEXT@ as s from {chunks}) c) t
""".replace("@TEXT@", _json_string("text"))

# F-FILES: a directory listing; extension by doc_id % 4; size unknown for
# every seventh file (stat failed).
F_FILES = r"""
select '/in/' || source || '.' || CAST(doc_id AS {S}) || CASE doc_id % 4
         WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '' END as path,
       CASE WHEN doc_id % 7 = 3 THEN NULL ELSE n_chars END as size,
       CASE WHEN doc_id % 7 = 3 THEN NULL ELSE 1700000000 + doc_id * 60 END as modified_epoch,
       doc_id
from {documents}
"""

# F-PART: partial results; key = role, order = turn; every third turn of an
# even conversation holds a non-string value.
F_PART = r"""
select conv_id, role as k, turn as seq, NOT (turn % 3 = 1 AND conv_id % 2 = 0) as is_str,
       text as v
from {conversations}
"""

# F-ATT: up to four attempts per request; attempt a succeeds when
# a > doc_id % 5 (so kinds succeed at 1, 2, 3, only at 4, never in time).
F_ATT = r"""
select doc_id as request_id, attempt, attempt > doc_id % 5 as ok,
       CASE WHEN attempt > doc_id % 5
            THEN '{{"nombre":"P' || CAST(doc_id AS {S}) || '","resumen":"attempt ' || CAST(attempt AS {S})
                 || ': ' || s || '"}}'
            ELSE 'timeout ' || CAST(attempt AS {S}) END as content
from (select doc_id, @TEXT@ as s, 1 as attempt from {documents}
      union all select doc_id, @TEXT@ as s, 2 as attempt from {documents}
      union all select doc_id, @TEXT@ as s, 3 as attempt from {documents}
      union all select doc_id, @TEXT@ as s, 4 as attempt from {documents}) a
""".replace("@TEXT@", _json_string("text"))

# F-RUN: run results; quality 1 -> success, 0 -> error, no label -> error.
F_RUN = r"""
select d.doc_id, 'paper_' || CAST(d.doc_id AS {S}) || '.pdf' as nombre,
       CASE WHEN l.quality = 1 THEN 'success' ELSE 'error' END as status,
       CASE WHEN l.doc_id IS NULL THEN 'no answer' WHEN l.quality = 1 THEN NULL
            ELSE 'rejected' END as error
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""


def spark_sql_text(sql: str) -> str:
    return sql.replace("{S}", "STRING")


def duck_sql_text(sql: str, **sources: str) -> str:
    """Fixture text for DuckDB: tables are the registered views, other
    placeholders are given as SQL text."""
    out = sql.replace("{S}", "VARCHAR")
    for t in PLACEHOLDERS:
        out = out.replace("{" + t + "}", sources.get(t, t))
    return out.replace("{{", "{").replace("}}", "}")


SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id"}


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    """The driver tables; the text tables get enough partitions first, so
    the fixture statements themselves run in parallel."""
    from .common import spread
    out = {}
    for n in names:
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
        out[n] = spread(df, SPREAD_KEYS[n]) if n in SPREAD_KEYS else df
    return out


def run_fixture(spark: SparkSession, sql: str, sf_dir: str) -> DataFrame:
    """Run a fixture statement on Spark over the tables of ``sf_dir``."""
    tables = load_tables(spark, sf_dir, [t for t in TABLES if "{" + t + "}" in sql])
    return spark.sql(spark_sql_text(sql), **tables)


def papers(spark, sf_dir):
    return run_fixture(spark, F_PAPERS, sf_dir)


def responses(spark, sf_dir):
    return run_fixture(spark, F_RESP, sf_dir)


def files(spark, sf_dir):
    return run_fixture(spark, F_FILES, sf_dir)


def partials(spark, sf_dir):
    return run_fixture(spark, F_PART, sf_dir)


def attempts(spark, sf_dir):
    return run_fixture(spark, F_ATT, sf_dir)


def run_results(spark, sf_dir):
    return run_fixture(spark, F_RUN, sf_dir)


def chunk_responses(chunks: DataFrame) -> DataFrame:
    """F-CHUNK-RESP over a (doc_id, chunk_index) frame."""
    return chunks.sparkSession.sql(spark_sql_text(F_CHUNK_RESP), chunks=chunks)
