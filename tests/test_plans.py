"""Plan regression tests: the physical-plan properties the design relies on."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def nodes(txt):
    body = txt.split("\n\n", 1)[1] if "\n\n" in txt else txt
    return re.split(r"\n\(\d+\) ", body)


@pytest.mark.parametrize("name,replaces", [
    ("normalize_text", 2), ("clean_text", 2), ("split_chunks", 2), ("section_cascade", 2),
    ("section_segments", 4), ("fits_one_chunk", 2), ("preprocess", 3), ("flow_first_chunk", 4),
    ("paper_metadata", 2)])
def test_text_regexes_run_once(spark, name, replaces):
    txt = plan_text(entry.queries()[name](spark, SF))
    assert txt.count("regexp_replace(") == replaces
    assert not [n for n in nodes(txt) if n.startswith("Filter") and "regexp_replace" in n]


def test_chunking_adds_no_shuffle(spark):
    tree = plan_text(entry.queries()["split_chunks"](spark, SF)).split("\n\n")[0]
    # the only exchange is the input spread (one row group -> all cores)
    assert len(re.findall(r"\bExchange\b", tree)) == 1


def test_skip_processed_has_no_single_partition_limit(spark):
    txt = plan_text(entry.queries()["skip_processed"](spark, SF))
    assert "LeftAnti" in txt and "Limit" not in txt and "SinglePartition" not in txt


@pytest.mark.parametrize("name", ["section_cascade", "normalize_text", "skip_processed", "merge_results"])
def test_building_a_query_runs_no_job(spark, name):
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    entry.queries()[name](spark, SF)  # the tables' footers are read here
    spark.sparkContext.setJobGroup(group, group)
    try:
        entry.queries()[name](spark, SF)
        jobs = tracker.getJobIdsForGroup(group)
        stages = sum(len(tracker.getJobInfo(j).stageIds) for j in jobs)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages <= 3  # schema reads only, one small stage each
