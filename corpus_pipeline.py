"""Corpus preparation in four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read back as the next stage's documents.  All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import language_id, line_spread, minhash_dedup, packing
from scriptorium.llm.common import table, written
from scriptorium.operators.prefilter import anti_join, key_bitmap, with_may_match

MIN_LANGUAGE_SCORE = 0.06  # cosine with the nearest prototype: two standard deviations of chance at 1024 dimensions
MIN_LETTERS = 64  # one 3-gram each; with fewer the cosine says more about length than about language
NEAR_PERCENT = 80
TOKENIZER = "word_bpe_49k.json"


def _row(docs: DataFrame) -> Column:
    """All columns of a document as one value, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _columns(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled documents.

    Documents without a letter (NULL and empty texts too) go, and those of 64
    letters or more that are unlike every language.  Where no document has a
    label and a text, nothing is learned and every document with a letter
    stays.  Labels, ids and sources may be NULL; repeated rows share a result."""
    prototypes = language_id.learn(language_id.train_rows(docs))
    places = [f"c{i}" for i in range(len(docs.columns))]  # no name of theirs can clash
    text = places[docs.columns.index("text")]
    told = language_id.predict(docs.toDF(*places), prototypes, text=text, pred="language", score="score")
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    kept = F.col("language") != language_id.UNDETERMINED if prototypes else letters > 0
    if prototypes:
        kept = kept & ((F.col("score") >= MIN_LANGUAGE_SCORE) | (letters < MIN_LETTERS))
    return told.where(kept).select(*places).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that several texts have on many sites.

    ``n_chars`` follows the text.  A document that loses all its lines goes:
    every one of them stays in the document that has it first.  NULL and empty
    texts stay; repeated rows share a result."""
    out = line_spread.cleaned(docs)
    out = out.where(~((F.col("removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return _columns(out, docs, **changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id
    (NULL last, then the least hash of id and text).

    What is grouped is an id with its text, so rows that repeat an id with
    other texts are documents of their own; of rows equal in both, one stays.
    NULL, empty and blank texts are near nothing: each id keeps its own."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = docs.select(_row(docs).alias("row"), key.alias("key"))
    found = minhash_dedup.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key", percent=NEAR_PERCENT)
    ids = rows.groupBy("key").agg(F.min("row.doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    named = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    first = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "n")).alias("first"))
    first = written(first.select("first.key", "first.n"), "first")
    # Most documents are the only row of their key and stay: a bitmap lets them pass without a shuffle.
    again = first.where("n > 1").select("key")
    leaving = ids.select("key").join(first, "key", "left_anti")
    single = anti_join(rows, written(leaving.unionByName(again), "leaving"), ["key"])
    repeated = with_may_match(rows, key_bitmap(again, "key"), "key").where("_may_match").drop("_may_match")
    repeated = repeated.join(again, "key", "left_semi").dropDuplicates(["key"])
    return _columns(single.unionByName(repeated), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its place in the packed sequences.  NULL and empty
    texts are one piece with the end id; rows are packed one by one."""
    return packing.packed_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_dedup", near_duplicates),
          ("best_fit_packing", pack)]
#: SQL cannot express learned profiles, shingle components or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
