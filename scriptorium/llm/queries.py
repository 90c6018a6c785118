"""Registered queries of the numbered operators, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (chat_format, cross_alignment, embedding_dedup, language_id, line_spread, minhash_dedup, packing,
               sentencepiece_viterbi, token_counts, topk_threshold, training_order, warc, whitening)
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids of every whole text, and the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_viterbi.encode(docs, model).drop("text")
    return sentencepiece_viterbi.decode(ids, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text without cross-site boilerplate."""
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("_spread_lines").alias("n_lines"),
                      F.col("_spread_removed").alias("n_removed"), "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.learn(language_id.train_rows(docs))
    out = language_id.predict(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, shard, n_tokens and checksum of every sequence, read back from the shards."""
    out = training_order.materialise(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), end_id=49407)
    return out.select("slot", "shard", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but conv_id is read back from the formatted output."""
    probe = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_chat(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))
    read = out.select("conv_id", "formatted", "segments",
                      chat_format.read_turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.unescape(F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"),
                       loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens, groups and links of every text, and corpus-wide counts of its linked pairs."""
    aligned = cross_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs")
    return cross_alignment.link_scores(aligned)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is read back from the written archives."""
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.read_archive(spark, path)
    kind = warc.field("WARC-Type")
    stored = kind == "response"
    return records.select(
        warc.page_of("WARC-Record-ID").alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(warc.field("Content-Length", "http")).cast("long")
        .alias("payload_bytes"),
        F.when(stored, warc.base32_sha1(F.col("payload")))
        .otherwise(F.regexp_replace(warc.field("WARC-Payload-Digest"), "^sha1:", "")).alias("payload_digest"),
        kind.alias("record_type"), warc.page_of("WARC-Refers-To").alias("refers_to"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_embedding_dedup, op3_topk_search, op4_minhash_dedup,
                                   op5_best_fit_packing, op6_token_counts, op7_line_dedup, op8_language_id,
                                   op9_training_order, op10_chat_formatting, op11_cross_alignment, op12_warc,
                                   op13_whitening)}

_COMPONENT = """
reach as (
  select {id}, {id} as node from {nodes}
  union
  select r.{id}, l.b from reach r join links l on l.a = r.node),
c as (select {id}, min(node) as component_id from reach group by {id})"""

ORACLE: dict[str, str] = {
    "op2_embedding_dedup": f"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from v
      where len(v) > 0 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x)))),
links as (
  select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where x.norm > 0 and y.norm > 0 and list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.95),
{_COMPONENT.format(id='vec_id', nodes='embeddings')}
select c.vec_id, (select count(*) from links l where l.a = c.vec_id) as n_links, component_id,
       c.vec_id = component_id as kept
from c
""",
    "op3_topk_search": """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (
  select q.vec_id as query_id, e.vec_id, cast(list_inner_product(q.v, e.v) as bigint) as score
  from e q join e on q.vec_id <> e.vec_id and len(q.v) = len(e.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
""",
    "op4_minhash_dedup": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') as w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from w),
x as (select doc_id, len(s) as n, unnest(s) as shingle from s),
p as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as total, count(*) as common
  from x a join x b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p where 100 * common >= 85 * (total - common)),
{_COMPONENT.format(id='doc_id', nodes='documents')}
select c.doc_id, cast(len(s.s) as bigint) as n_shingles, component_id, c.doc_id = component_id as kept
from c join s on c.doc_id = s.doc_id
""",
    "op7_line_dedup": f"""
with l as (
  select doc_id, coalesce('s' || source, '') as site, text, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents),
k as (select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t from l),
b as (select t, min(doc_id) as first from k where t <> '' group by t
      having count(distinct site) >= {line_spread.MIN_SITES} and count(distinct text) > 1),
j as (select k.doc_id, k.pos, k.line, coalesce(k.doc_id <> b.first, false) as gone
      from k left join b on k.t = b.t)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
       coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
from j group by doc_id
""",
    "op10_chat_formatting": r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length('<turn ') + length(role) + 2 + length(text) + length('</turn>') + 1
             + length(text) - length(replace(replace(replace(replace(text, '\', ''), '<', ''), '>', ''), '#', ''))) as formatted_chars
  from t group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars,
       sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from s
""",
    "op12_warc": """
with p as (select page_id, coalesce(html, '') as payload from pages),
f as (select *, min(page_id) over (partition by payload) as first, sha1(payload) as hex from p)
select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((cast('0x' || substr(hex, 5 * cast(i // 4 as int) + 1, 5) as bigint)
               >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), '') as payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to
from f
""",
}
