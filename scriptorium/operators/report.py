"""Run summary and readable reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import fixed


def with_status(results: DataFrame, status: str) -> DataFrame:
    return results.filter(F.col("status") == status)


def processing_summary(results: DataFrame) -> DataFrame:
    """total, successes, errors (one global aggregate; combines map-side)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == fixed.STATUS_SUCCESS).alias("successes"),
        F.count_if(F.col("status") == fixed.STATUS_ERROR).alias("errors"))


def summary_listing(results: DataFrame) -> DataFrame:
    """The run report as ordered lines: (block, sort_key, line).

    Reading ``line`` ordered by (block, sort_key) gives the report text.
    ``results`` is read twice (counts, lines): hand in a stored table.  The counts come from one global aggregate; the name lines are one row
    per result, so the report never gathers all names in one task or
    string.  Names are listed in name order (the original lists them in
    directory order).
    """
    counts = processing_summary(results)

    def line(block, n, text):
        return F.struct(F.lit(block).alias("block"), F.lit(n).alias("n"), text.alias("line"))

    total, ok_n, err_n = F.col("total"), F.col("successes"), F.col("errors")
    lines = F.when(total == 0, F.array(line(0, 0, F.lit(fixed.SUMMARY_EMPTY)))).otherwise(F.filter(F.array(
        line(0, 0, F.lit(fixed.SUMMARY_DONE)),
        line(0, 1, F.concat(F.lit(fixed.SUMMARY_TOTAL), total.cast("string"))),
        line(0, 2, F.concat(F.lit(fixed.SUMMARY_OK), ok_n.cast("string"))),
        line(0, 3, F.concat(F.lit(fixed.SUMMARY_ERR), err_n.cast("string"))),
        line(0, 4, F.lit("")),
        F.when(ok_n > 0, line(1, 0, F.lit(fixed.SUMMARY_OK_HEAD))),
        F.when(err_n > 0, line(3, 0, F.lit(""))),
        F.when(err_n > 0, line(3, 1, F.lit(fixed.SUMMARY_ERR_HEAD)))), lambda x: x.isNotNull()))
    head = counts.select(F.explode(lines).alias("h")).select(
        F.col("h.block").alias("block"), F.lit(None).cast("string").alias("sort_key"), F.col("h.n").alias("n"),
        F.col("h.line").alias("line"))
    name = F.coalesce(F.col("nombre"), F.lit(fixed.SUMMARY_UNKNOWN_NAME))
    ok = F.col("status") == fixed.STATUS_SUCCESS
    entries = results.where(F.col("status").isin(fixed.STATUS_SUCCESS, fixed.STATUS_ERROR)).select(
        F.when(ok, 2).otherwise(4).alias("block"), name.alias("sort_key"), F.lit(0).alias("n"),
        F.when(ok, F.concat(F.lit("- "), name)).otherwise(
            F.concat(F.lit("- "), name, F.lit(": "),
                     F.coalesce(F.col("error"), F.lit(fixed.SUMMARY_UNKNOWN_ERROR)))).alias("line"))
    return head.unionByName(entries)


def human_report(df: DataFrame, analysis: str = "analysis", out: str = "report") -> DataFrame:
    """Readable report per analysis.  Defaults apply only to missing keys; a
    key holding null prints as None.  Success: truthy -> yes, non-null
    falsy -> no, null or missing -> undetermined."""
    m = F.col(analysis)

    def get(k, default):
        return F.when(F.map_contains_key(m, F.lit(k)), an.py_str(an.field(m, k))).otherwise(F.lit(default))

    ok = an.field(m, fixed.KEY_SUCCESS)
    label = (F.when(ok.isNull() | (F.to_json(ok) == "null"), F.lit(fixed.REPORT_UNDETERMINED))
             .when(an.is_falsy(ok), F.lit(fixed.REPORT_NO)).otherwise(F.lit(fixed.REPORT_YES)))
    text = F.concat(
        F.lit("\n" + fixed.REPORT_TITLE), get(fixed.KEY_NAME, fixed.REPORT_DEFAULT_TITLE),
        F.lit("\n" + fixed.REPORT_RULE + "\n\n" + fixed.REPORT_SUMMARY + "\n"),
        get(fixed.KEY_SUMMARY, fixed.REPORT_DEFAULT_SUMMARY),
        F.lit("\n\n" + fixed.REPORT_RESULTS + "\n"), get(fixed.KEY_RESULTS, fixed.REPORT_DEFAULT_RESULTS),
        F.lit("\n\n" + fixed.REPORT_SUCCESS), label,
        F.lit("\n\n" + fixed.REPORT_PERFORMANCE + "\n"),
        get(fixed.KEY_PERFORMANCE, fixed.REPORT_DEFAULT_PERFORMANCE), F.lit("\n"))
    return df.withColumn(out, text)


def strip_internal(df: DataFrame, analysis: str | None = None) -> DataFrame:
    """Drop the internal ``__metadata__`` column (or map key)."""
    out = df.drop(fixed.METADATA_KEY)
    if analysis:
        out = out.withColumn(analysis, F.map_filter(F.col(analysis),
                                                    lambda k, v: k != F.lit(fixed.METADATA_KEY)))
    return out


def result_defaults(df: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Known keys with the report's defaults for *missing* keys only."""
    m = F.col(analysis)

    def get(k, default):
        return F.when(F.map_contains_key(m, F.lit(k)), an.py_str(an.field(m, k))).otherwise(F.lit(default))

    return df.select("*", get(fixed.KEY_NAME, fixed.REPORT_DEFAULT_TITLE).alias("title"),
                     get(fixed.KEY_SUMMARY, fixed.REPORT_DEFAULT_SUMMARY).alias("summary"),
                     get(fixed.KEY_RESULTS, fixed.REPORT_DEFAULT_RESULTS).alias("results"),
                     get(fixed.KEY_PERFORMANCE, fixed.REPORT_DEFAULT_PERFORMANCE).alias("performance_text"))
