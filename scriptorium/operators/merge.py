"""Combining answers: merge of partial results, consolidation prompt, union
of run results, latest record per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import fixed
from ..functions import prompts as pr


def merge_results(partials: DataFrame, group: str = "conv_id", seq: str = "seq", key: str = "k",
                  value: str = "v", is_str: str = "is_str", bucket_width: int = 1024) -> DataFrame:
    """Per (group, key) left fold of partial results: a string onto a string
    is joined with a blank line, anything else replaces.

    Parts are taken in the order of ``seq``; at one ``seq`` other values come
    first (the greatest of several counts), then strings by their hash, equal
    ones side by side.

    Closed form: with L the last non-string part, its value if it is the last
    part, else the strings after L joined in order.

    First L and the last part per key (``max`` combines map-side), then only
    the strings after L travel, equal ones counted before the shuffle.  They
    are joined in blocks and the blocks in order.  A block is ``bucket_width``
    positions of ``seq``; where those hold many more strings, it is cut by
    ``seq`` and then, by counts, into even ranges of the hash.  So a key with
    very many parts is spread over its blocks, also when they share one
    ``seq``; the last step sees one row per block.
    """
    order = F.struct(F.col(seq).alias("s"), F.col(is_str).alias("t"), F.col(value).alias("v"))
    ends = partials.groupBy(group, key).agg(
        F.max(F.struct(F.col(seq).alias("s"), F.col(is_str).alias("t"))).alias("_last"),
        F.max(F.when(~F.col(is_str), order)).alias("_L"))
    tail = (partials.where(F.col(is_str)).join(ends.select(group, key, F.col("_L.s").alias("_from")), [group, key])
            .where(F.col("_from").isNull() | (F.col(seq) >= F.col("_from")))
            .select(group, key, F.floor(F.col(seq) / F.lit(bucket_width)).alias("_b"), F.col(seq).alias("_s"),
                    F.xxhash64(value).alias("_h"), F.col(value).alias("_v")))
    blocks = _cut(tail, [group, key], bucket_width).groupBy(group, key, "_b", "_at", "_range").agg(
        F.array_sort(F.collect_list(F.struct("_s", "_h", "_v", "_n"))).alias("_p"))
    many = F.flatten(F.transform("_p", lambda x: F.array_repeat(x["_v"], x["_n"].cast("int"))))
    joined = (blocks.select(group, key, F.struct("_b", "_at", "_range").alias("_place"),
                            F.array_join(many, fixed.MERGE_JOIN).alias("_t"))
              .groupBy(group, key).agg(F.array_sort(F.collect_list(F.struct("_place", "_t"))).alias("_p"))
              .select(group, key, F.array_join(F.transform("_p", lambda x: x["_t"]), fixed.MERGE_JOIN).alias("_joined")))
    last_is_value = ~F.col("_last.t")
    return ends.join(joined, [group, key], "left").select(
        group, key, F.when(last_is_value, F.col("_L.v")).otherwise(F.col("_joined")).alias("merged"),
        (~last_is_value).alias("merged_is_str"))


def _cut(tail: DataFrame, key: list[str], width: int) -> DataFrame:
    """Distinct strings (``_n`` of each) with their block: ``_b``, and ``_at``
    and ``_range`` where ``_b`` holds more than twice ``width`` strings."""
    one = tail.groupBy(*key, "_b", "_s", "_h", "_v").agg(F.count(F.lit(1)).alias("_n"))
    per_seq = tail.groupBy(*key, "_b", "_s").agg(F.count(F.lit(1)).alias("_many"))
    full = per_seq.groupBy(*key, "_b").agg(F.sum("_many").alias("_all")).where(F.col("_all") > 2 * width)
    cuts = per_seq.join(full, [*key, "_b"]).select(
        *key, "_b", "_s", F.ceil(F.col("_many") / F.lit(width)).alias("_ranges"))
    # The hash is even over its 2**64 values: its share of them times the number of ranges.
    share = F.col("_h").cast("double") / F.lit(2.0 ** 64) + 0.5
    return one.join(cuts, [*key, "_b", "_s"], "left").withColumns({
        "_at": F.when(F.col("_ranges").isNotNull(), F.col("_s")),
        "_range": F.when(F.col("_ranges").isNotNull(), F.floor(share * F.col("_ranges")))})


def consolidation_block(index, analysis) -> F.Column:
    """One part of the consolidation prompt: part number, summary, results
    (default "No disponible" when the key is missing), then every other key
    in the answer's order."""
    m = F.col(analysis) if isinstance(analysis, str) else analysis

    def known(k):
        return F.when(F.map_contains_key(m, F.lit(k)), an.py_str(an.field(m, k))).otherwise(
            F.lit(fixed.NOT_AVAILABLE))

    extras = F.array_join(F.transform(
        F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*fixed.KNOWN_KEYS)),
        lambda e: F.concat(e["key"], F.lit(": "), an.py_str(e["value"]), F.lit("\n"))), "")
    idx = F.col(index) if isinstance(index, str) else index
    return F.concat(F.lit("\n" + fixed.CONSOLIDATION_PART), (idx + 1).cast("string"), F.lit(":\n"),
                    F.lit(fixed.CONSOLIDATION_SUMMARY), known(fixed.KEY_SUMMARY), F.lit("\n"),
                    F.lit(fixed.CONSOLIDATION_RESULTS), known(fixed.KEY_RESULTS), F.lit("\n"), extras)


def consolidation_prompt(results: DataFrame, doc: str = "doc_id", index: str = "chunk_index",
                         analysis: str = "analysis", name: str = "paper_name") -> DataFrame:
    """One prompt per document from its chunk answers in chunk order.

    Blocks are built row-locally, then one aggregate per document orders
    and concatenates them (a document's answers are one group; its size is
    bounded by the paper).
    """
    blocks = results.select(doc, name, index, consolidation_block(index, analysis).alias("_block"))
    agg = blocks.groupBy(doc).agg(
        F.first(name).alias(name),
        F.expr(f"listagg(_block, '') WITHIN GROUP (ORDER BY {index})").alias("blocks"),
        F.count(F.lit(1)).alias("n_parts"))
    return agg.select(doc, name, "n_parts",
                      pr.consolidation_prompt_text(F.col(name), F.col("blocks")).alias("prompt"))


def result_union(ok: DataFrame, err: DataFrame) -> DataFrame:
    """Success and error rows in one result although their columns differ."""
    return ok.unionByName(err, allowMissingColumns=True)


def latest_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the highest ``order`` columns per key (the last write
    wins; further columns break ties).

    ``max_by`` is a partial aggregate: each map task reduces its rows to one
    per key before the shuffle, so a key with a huge number of versions
    costs one row per task.
    """
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col("_r." + c).alias(c) for c in cols])
