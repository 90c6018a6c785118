from pyspark.sql import functions as F

from scriptorium.operators import joins as jn
from scriptorium.session import scratch_path
from scriptorium.sources import files as src_files
from scriptorium.sources import pages as src_pages
from scriptorium.sources import sink


def _analyses(spark, rows):
    df = spark.createDataFrame(rows, "paper_name string, js string")
    return df.select("paper_name", F.from_json("js", "map<string,variant>").alias("analysis"))


def test_sink_latest_wins_and_keys(spark):
    path = scratch_path(spark, "test-sink")
    sink.save_analyses(_analyses(spark, [("/in/a.pdf", '{"resumen":"old","z":1}'),
                                         ("/in/b.PDF", '{"resumen":"b"}')]), path, "2026-01-01T00:00:00")
    sink.save_analyses(_analyses(spark, [("/in/a.pdf", '{"resumen":"new","k":[1]}')]), path,
                       "2026-01-02T00:00:00")
    assert sink.read_analyses(spark, path).count() == 3
    by = {r.stem: r.value for r in sink.latest_analyses(spark, path).collect()}
    assert set(by) == {"a", "b"}
    assert by["a"].startswith('{"resumen":"new","k":[1],"__metadata__":')
    assert '"processed_date":"2026-01-02T00:00:00"' in by["a"]
    assert sorted(r.stem for r in sink.processed_keys(spark, path).distinct().collect()) == ["a", "b"]


def test_sink_ties_replays_and_missing_folder(spark):
    path = scratch_path(spark, "test-sink")
    assert sink.processed_keys(spark, path).count() == 0 and sink.latest_analyses(spark, path).count() == 0
    rows = [("/in/a.pdf", '{"resumen":"1"}'), ("/x/a.pdf", '{"resumen":"2"}')]
    for _ in range(2):  # a replayed batch replaces its own rows
        sink.save_analyses(_analyses(spark, rows), path, "2026-01-01T00:00:00", batch="b1")
    assert sink.read_analyses(spark, path).count() == 2
    # equal timestamps: the later file name wins, whatever the order of the rows
    assert [r.source_file for r in sink.latest_analyses(spark, path).collect()] == ["/x/a.pdf"]
    # a stream's record does not beat a later one by its spelling
    sink.save_analyses(_analyses(spark, [("/in/a.pdf", '{"resumen":"3"}')]), path, "2027-01-01T00:00:00", batch="a0")
    assert ['"resumen":"3"' in r.value for r in sink.latest_analyses(spark, path).collect()] == [True]


def test_no_output_location_keeps_everything(spark):
    files = spark.createDataFrame([("x",), ("y",)], "stem string")
    assert sink.processed_keys(spark, None) is None
    assert jn.skip_processed(files, None).count() == 2
    done = spark.createDataFrame([("x",), (None,)], "stem string")
    assert [r.stem for r in jn.skip_processed(files, done).collect()] == ["y"]


def test_pages_in_order(spark):
    pages = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")],
                                  "doc_id bigint, page_no int, page_text string")
    got = {r.doc_id: (r.text, r.n_pages) for r in src_pages.assemble_pages(pages).collect()}
    assert got == {1: ("a\nb\nc\n", 3), 2: ("z\n", 1)}


def test_manifest_extension_case(spark):
    files = spark.createDataFrame([("/d/a.pdf",), ("/d/b.PDF",), ("/d/c.txt",), ("/d/pdf",)], "path string")
    got = sorted((r.name, r.stem) for r in src_files.doc_manifest(files).collect())
    assert got == [("a.pdf", "a"), ("b.PDF", "b")]


def test_skip_processed_repeated_and_null_keys(spark):
    files = spark.createDataFrame([(s,) for s in "abcde"], "stem string")
    done = spark.createDataFrame([("a",)] * 50 + [("c",), (None,)], "stem string")
    assert sorted(r.stem for r in jn.skip_processed(files, done).collect()) == ["b", "d", "e"]


def test_pairs_with_a_missing_paper(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 9)], "a_id bigint, b_id bigint")
    assert jn.pair_papers(pairs, docs).count() == 1
    got = {(r.a_id, r.b_id): (r.a_text, r.b_text) for r in jn.pair_papers(pairs, docs, keep_missing=True).collect()}
    assert got == {(1, 2): ("a", "b"), (2, 9): ("b", None)}


def test_scan_files_lists_pdfs_without_reading_them(spark, tmp_path):
    for name, body in [("a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF-22"), ("c.txt", b"x"), ("d.pdf.bak", b"y")]:
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.pdf").write_bytes(b"%PDF")
    files = src_files.scan_files(spark, str(tmp_path))
    assert "content" not in files.columns
    got = sorted((r.path.rsplit("/", 1)[1], r.size) for r in files.collect())
    assert got == [("a.pdf", 6), ("b.PDF", 7)]
    meta = src_files.file_metadata(files).collect()
    assert sorted(r.base_name for r in meta) == ["a", "b"]


def test_stream_in_small_batches_writes_each_paper_once(spark):
    from scriptorium.plans import flows as fl
    from scriptorium.streaming import ingest
    base = scratch_path(spark, "test-stream")
    docs = spark.createDataFrame([(i, f"paper_{i}.pdf", f"Text {i}. body") for i in range(8)],
                                 "doc_id bigint, paper_name string, text string")
    ingest.stage_documents(docs, f"{base}/in", parts=4)
    answers = spark.createDataFrame([(i, '{"resumen":"r"}') for i in range(8)], "doc_id bigint, content string")
    respond = fl.table_responder(answers, ["doc_id"])
    for _ in range(2):
        ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", respond, 100,
                             max_files_per_trigger=1)
    stems = sorted(r.stem for r in sink.read_analyses(spark, f"{base}/out").collect())
    assert stems == [f"paper_{i}" for i in range(8)]


def test_staged_files_follow_the_partitions_of_the_documents(spark):
    from scriptorium.streaming import ingest
    docs = spark.range(0, 400, 1, 6).select(F.col("id").alias("doc_id"), F.lit("p.pdf").alias("paper_name"),
                                            F.lit("a text").alias("text"))
    for rows, files in ((docs, 6), (docs.coalesce(1), 2)):
        in_dir = scratch_path(spark, "test-stage")
        ingest.stage_documents(rows, in_dir)
        back = spark.read.parquet(in_dir)
        assert back.select("doc_id").distinct().count() == back.count() == 400
        assert back.select(F.input_file_name()).distinct().count() == files


def test_replayed_input_is_not_written_twice(spark):
    """A lost stream checkpoint replays every input file; the anti join
    against the sink's keys keeps each paper's record single."""
    from scriptorium.plans import flows as fl
    from scriptorium.streaming import ingest
    base = scratch_path(spark, "test-replay")
    docs = spark.createDataFrame([(i, f"paper_{i}.pdf", f"Text {i}. body") for i in range(6)],
                                 "doc_id bigint, paper_name string, text string")
    ingest.stage_documents(docs, f"{base}/in", parts=2)
    answers = spark.createDataFrame([(i, '{"resumen":"r"}') for i in range(6)], "doc_id bigint, content string")
    respond = fl.table_responder(answers, ["doc_id"])
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt-1", respond, 100)
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt-2", respond, 100)
    stems = sorted(r.stem for r in sink.read_analyses(spark, f"{base}/out").collect())
    assert stems == [f"paper_{i}" for i in range(6)]


def test_failed_papers_are_not_keys_and_are_tried_again(spark):
    from scriptorium.plans import flows as fl
    from scriptorium.streaming import ingest
    base = scratch_path(spark, "test-outage")
    docs = spark.createDataFrame([(i, f"paper_{i}.pdf", f"Text {i}. body") for i in range(4)],
                                 "doc_id bigint, paper_name string, text string")
    ingest.stage_documents(docs, f"{base}/in", parts=2)
    outcome = [(i, '{"resumen":"r"}' if i % 2 else None, bool(i % 2), None if i % 2 else "down") for i in range(4)]
    answers = spark.createDataFrame(outcome, "doc_id bigint, content string, ok boolean, call_error string")
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c1", fl.table_responder(answers, ["doc_id"]), 100)
    assert sorted(r.stem for r in sink.processed_keys(spark, f"{base}/out").collect()) == ["paper_1", "paper_3"]
    assert sink.read_outcomes(spark, f"{base}/out").where("status = 'error'").count() == 2
    well = answers.withColumn("ok", F.lit(True)).withColumn("content", F.lit('{"resumen":"late"}'))
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c2", fl.table_responder(well, ["doc_id"]), 100)
    latest = {r.stem: r.value for r in sink.latest_analyses(spark, f"{base}/out").collect()}
    assert sorted(latest) == [f"paper_{i}" for i in range(4)]
    assert '"r"' in latest["paper_1"] and '"late"' in latest["paper_2"]
