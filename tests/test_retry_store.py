"""Stream retries, the answer store, prefiltered joins, chunks without numbers, ranks of large keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunks as ch
from scriptorium.operators import joins as jn
from scriptorium.operators import merge as mg
from scriptorium.operators import prefilter
from scriptorium.plans import flows as fl
from scriptorium.plans import responders as rp
from scriptorium.plans.settings import JobSettings
from scriptorium.session import scratch_path
from scriptorium.sources import sink
from scriptorium.streaming import ingest

PAPERS = "doc_id bigint, paper_name string, text string"


def papers(spark, ids):
    return spark.createDataFrame([(i, f"paper_{i}.pdf", f"Text {i}. body") for i in ids], PAPERS)


def down(requests):
    return requests.withColumns({"content": F.lit(None).cast("string"), "ok": F.lit(False), "call_error": F.lit("down")})


def well(requests):
    return requests.withColumns({"content": F.concat(F.lit('{"resumen":"'), F.col("doc_id").cast("string"), F.lit('"}')),
                                 "ok": F.lit(True)})


def stems(spark, out_dir):
    return sorted(r.stem for r in sink.processed_keys(spark, out_dir).collect())


def test_an_outage_is_made_good_with_the_same_checkpoint(spark):
    base = scratch_path(spark, "test-retry")
    ingest.stage_documents(papers(spark, range(8)), f"{base}/in")
    run = lambda model, **k: ingest.ingest_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", model, 100, **k)
    run(down)
    assert stems(spark, f"{base}/out") == []
    queued, entries = ingest.read_queue(spark, f"{base}/out_queue")
    assert sorted(r.doc_id for r in queued.collect()) == list(range(8)) and len(entries) == 1
    run(down)  # still down: one entry again, nothing lost
    queued, entries = ingest.read_queue(spark, f"{base}/out_queue")
    assert sorted(r.doc_id for r in queued.collect()) == list(range(8)) and len(entries) == 1
    run(well)
    assert stems(spark, f"{base}/out") == sorted(f"paper_{i}" for i in range(8))
    assert ingest.read_queue(spark, f"{base}/out_queue")[1] == []
    before = sink.read_outcomes(spark, f"{base}/out").count()
    run(well)
    assert sink.read_outcomes(spark, f"{base}/out").count() == before


def test_the_queue_goes_with_new_files_and_survives_a_crash(spark):
    base = scratch_path(spark, "test-queue")
    half = lambda r: well(r).withColumn("ok", F.col("doc_id") % 2 == 0).withColumn(
        "call_error", F.when(F.col("doc_id") % 2 == 1, "down"))
    ingest.stage_documents(papers(spark, range(4)), f"{base}/in", parts=4)
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", half, 100, max_files_per_trigger=1)
    assert stems(spark, f"{base}/out") == ["paper_0", "paper_2"]
    queued, entries = ingest.read_queue(spark, f"{base}/out_queue")
    assert sorted(r.doc_id for r in queued.collect()) == [1, 3] and len(entries) == 1
    # a batch that stored its outcomes but was cut off before it dropped the entry it took
    queued.withColumn("batch", F.lit("cut-off")).write.mode("append").partitionBy("batch").parquet(f"{base}/out_queue")
    assert sorted(r.doc_id for r in ingest.read_queue(spark, f"{base}/out_queue")[0].collect()) == [1, 3]
    ingest.stage_documents(papers(spark, [9]), f"{base}/in", parts=1)
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", well, 100)
    assert stems(spark, f"{base}/out") == ["paper_0", "paper_1", "paper_2", "paper_3", "paper_9"]
    assert ingest.read_queue(spark, f"{base}/out_queue")[1] == []


def _counting(folder, fail=""):
    def call(request):
        text = request["messages"][-1]["content"]
        with open(f"{folder}/calls", "a") as f:
            f.write(text + "\n")
        if fail and fail in text:
            raise RuntimeError("refused")
        return f"answer to {text}"
    return call


def _asked(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select(
        "id", F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
                       .alias("messages")).alias("request"))


def test_equal_requests_are_called_once_and_finished_ones_never_again(spark, tmp_path):
    store = scratch_path(spark, "answers")
    calls = lambda: sorted(open(f"{tmp_path}/calls").read().split("\n")[:-1])
    respond = rp.stored_responder(rp.call_responder(_counting(str(tmp_path), fail="bad"), max_attempts=1), store,
                                  per_task=2, per_wave=3)
    rows = _asked(spark, ["a", "b", "a", "bad", "c", "d", "b", "e"])
    got = {r.id: (r.content, r.ok, r.call_error) for r in respond(rows).collect()}
    assert got == {**{i: (f"answer to {t}", True, None) for i, t in enumerate("abaXcdbe") if t != "X"},
                   3: (None, False, "refused")}
    assert calls() == ["a", "b", "bad", "c", "d", "e"]
    os.remove(f"{tmp_path}/calls")
    mended = rp.stored_responder(rp.call_responder(_counting(str(tmp_path)), max_attempts=1), store)
    got = {r.id: (r.content, r.ok) for r in mended(_asked(spark, ["a", "bad", "new"])).collect()}
    assert got == {0: ("answer to a", True), 1: ("answer to bad", True), 2: ("answer to new", True)}
    assert calls() == ["bad", "new"]
    assert respond(rows.limit(0)).count() == 0


def test_a_crash_between_waves_keeps_what_was_committed(spark, tmp_path):
    store, seen = scratch_path(spark, "answers"), []

    def breaks(requests):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        return rp.call_responder(_counting(str(tmp_path)), max_attempts=1)(requests)

    texts = [f"t{i}" for i in range(30)]
    with pytest.raises(KeyboardInterrupt):
        rp.stored_responder(breaks, store, per_task=4, per_wave=8)(_asked(spark, texts))
    done = rp.read_answers(spark, store).count()
    assert 0 < done < 30
    out = rp.stored_responder(rp.call_responder(_counting(str(tmp_path)), max_attempts=1), store)(_asked(spark, texts))
    assert sorted(r.content for r in out.collect()) == sorted(f"answer to {t}" for t in texts)
    assert sorted(open(f"{tmp_path}/calls").read().split("\n")[:-1]) == sorted(texts)


def test_flows_run_on_the_answer_store(spark, tmp_path):
    store = scratch_path(spark, "answers")
    respond = rp.stored_responder(rp.call_responder(_counting(str(tmp_path)), max_attempts=1), store)
    docs = papers(spark, range(3))
    for _ in range(2):
        assert fl.flow_first_chunk(docs, respond, 100).where("ok").count() == 3
    assert rp.read_answers(spark, store).count() == 3


def test_retry_settings_reach_the_calls(spark, tmp_path):
    assert JobSettings().retry_delay == 5 and JobSettings().max_attempts == 3
    settings = JobSettings(max_attempts=2, retry_delay=0.01, concurrency=2)
    out = rp.from_settings(_counting(str(tmp_path), fail="x"), settings)(_asked(spark, ["x", "y"])).collect()
    assert {(r.id, r.ok, r.attempts) for r in out} == {(0, False, 2), (1, True, 1)}


@pytest.mark.parametrize("bits", [1 << 15, 1 << 23])
def test_anti_join_keeps_exactly_the_rows_without_partner(spark, bits):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(3000)]), rng.choice([None, "a", "b"]), i) for i in range(4000)]
    others = [(rng.choice([None, *range(3000)]), rng.choice([None, "a", "b"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, s string, n long")
    got = prefilter.anti_join(df, spark.createDataFrame(others, "k long, s string"), ["k", "s"], bits)
    assert got.columns == df.columns
    assert sorted(r.n for r in got.collect()) == [n for k, s, n in rows if (k, s) not in set(others)]
    assert prefilter.anti_join(df, spark.createDataFrame([], "k long, s string"), ["k", "s"]).count() == 4000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_inputs_and_first_papers_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 3000
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id") % (n - 5)).alias("stem"),
                                     F.concat(F.lit("paper"), "id").alias("paper_name"), F.repeat(F.lit("text "), 50).alias("text"))
        docs.write.parquet(path := scratch_path(spark, "docs"))
        docs = spark.read.parquet(path)
        done = spark.createDataFrame([("p7",), ("p9",), (None,)], "stem string")
        for got, kept in ((jn.skip_processed(docs, done), n - 2), (jn.first_per_key(docs), n - 5)):
            assert got.count() == kept
            assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
        first = {r.stem: r.doc_id for r in jn.first_per_key(docs).collect()}
        assert first["p0"] == 0 and len(first) == n - 5
        told = prefilter.with_may_match(docs, prefilter.key_bitmap(done, "stem"), "stem")
        assert told.where("_may_match").count() <= 5
        kept = told.where("not _may_match").drop("_may_match")
        assert "hashpartitioning(stem" not in _plan(kept) and "SortMergeJoin" not in _plan(kept)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_per_key_with_nulls_and_ties(spark):
    rows = [("s", "b", 1), ("s", "a", 3), ("s", "a", 2), ("t", None, 4), ("t", "z", 5), (None, "n", 6), (None, "m", 7),
            ("u", "a", None), ("u", "a", 8), ("v", "q", 9), ("v", "q", 9)]
    df = spark.createDataFrame(rows, "stem string, paper_name string, doc_id long")
    got = sorted((tuple(r) for r in jn.first_per_key(df).collect()), key=str)
    assert got == sorted([("s", "a", 2), ("t", None, 4), (None, "m", 7), ("u", "a", None), ("v", "q", 9), ("v", "q", 9)],
                         key=str)


def test_chunks_without_numbers(spark):
    rows = [(1, 500, "b"), (1, None, "z"), (1, 20, "a"), (1, 20, "a"), (2, 5, "only"), (None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, start long, text string")
    got = ch.chunk_role(ch.number_chunks(df))
    assert sorted(((r.doc_id, r.chunk_index, r.total_chunks, r.role, r.text) for r in got.collect()), key=str) == sorted([
        (1, 0, 4, "initial", "z"), (1, 1, 4, "middle", "a"), (1, 2, 4, "middle", "a"), (1, 3, 4, "final", "b"),
        (2, 0, 1, "initial", "only"), (None, 0, 2, "initial", "x"), (None, 1, 2, "final", "y")], key=str)


def _fold(parts, digest):
    """The left fold in the stated order: others before strings, strings by hash."""
    merged, is_str = None, True
    for n, (_, text, value) in enumerate(sorted(parts, key=lambda p: (p[0], p[1], digest[p[2]] if p[1] else 0, p[2]))):
        merged, is_str = (f"{merged}\n\n{value}" if n and is_str and text else value), text
    return merged, is_str


def test_merge_of_large_keys_in_blocks(spark):
    rng = random.Random(8)
    rows = [(1, "k", 5, True, f"v{i % 900:04d}") for i in range(2500)]  # one seq, repeated values
    rows += [(2, "k", rng.randrange(4), rng.random() < .9, f"w{rng.randrange(50)}") for _ in range(400)]
    rows += [(3, k, rng.randrange(3), rng.random() < .5, f"x{rng.randrange(9)}") for k in "abc" for _ in range(6)]
    rows += [(4, "k", rng.randrange(3000), True, f"y{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, k string, seq long, is_str boolean, v string").repartition(5)
    digest = {r.v: r.h for r in df.select("v", F.xxhash64("v").alias("h")).distinct().collect()}
    parts = {}
    for c, k, s, t, v in rows:
        parts.setdefault((c, k), []).append((s, t, v))
    want = {key: _fold(p, digest) for key, p in parts.items()}
    for width in (16, 100, 1024):
        got = {(r.conv_id, r.k): (r.merged, r.merged_is_str) for r in mg.merge_results(df, bucket_width=width).collect()}
        assert got == want
    tail = df.where("conv_id = 1").select("conv_id", "k", F.lit(0).alias("_b"), F.col("seq").alias("_s"),
                                          F.xxhash64("v").alias("_h"), F.col("v").alias("_v"))
    sizes = [r["count"] for r in mg._cut(tail, ["conv_id", "k"], 100).groupBy("_at", "_range").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 80  # 900 values over 25 ranges
