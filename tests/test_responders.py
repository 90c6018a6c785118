from pyspark.sql import functions as F

from scriptorium.operators import requests as rq
from scriptorium.operators import responses as rs
from scriptorium.plans import flows as fl
from scriptorium.plans.responders import call_responder


def _docs(spark):
    rows = [(i, f"paper_{i}.pdf", f"Title {i}. Abstract text {i} " + "word " * (i * 40)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id bigint, paper_name string, text string")


def fake_model(request):
    """Fails the first call for odd-sized prompts, always fails for 'never'."""
    prompt = request["messages"][1]["content"]
    assert request["messages"][0]["role"] == "system" and request["max_tokens"] == 1000
    if "word word word word word word word word word word word word word word word word" in prompt \
            and len(prompt) % 7 == 0:
        raise RuntimeError("transient")
    return '{"resumen": "%d chars", "exito": true}' % len(prompt)


def test_call_responder_in_flow(spark):
    out = fl.flow_direct(_docs(spark), call_responder(fake_model), chunk_size=50)
    rows = rs.analysis_columns(out).orderBy("doc_id").collect()
    assert len(rows) == 6
    for r in rows:
        assert r.branch == "parsed"
        assert r.nombre == r.paper_name
        assert r.resumen == "%d chars" % len(r.prompt)


def test_call_responder_retries(spark):
    seen = {}

    def flaky(request):
        prompt = request["messages"][1]["content"]
        if prompt == "never":
            raise RuntimeError("down")
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "second" and seen[prompt] % 2 == 1:
            raise RuntimeError("first try fails")
        return "ok"

    df = spark.createDataFrame([(1, "fine"), (2, "never"), (3, "second")], "doc_id bigint, prompt string")
    req = rq.chat_requests(df).coalesce(1)
    got = {r.doc_id: (r.content, r.ok, r.attempts, r.call_error)
           for r in call_responder(flaky, max_attempts=3)(req).collect()}
    assert got[1] == ("ok", True, 1, None)
    assert got[2] == (None, False, 3, "down")
    assert got[3] == ("ok", True, 2, None)
    parsed = rs.parse_response(call_responder(flaky)(req).withColumn("paper_name", F.lit("p")))
    assert {r.doc_id: r.branch for r in parsed.collect()} == {1: "fallback", 2: "error", 3: "fallback"}


def test_null_text_keeps_the_paper(spark):
    docs = spark.createDataFrame([(1, "paper_1.pdf", None), (2, "paper_2.pdf", "Some text. More.")],
                                 "doc_id bigint, paper_name string, text string")
    answers = spark.createDataFrame([(1, '{"resumen":"x"}'), (2, '{"resumen":"y"}')], "doc_id bigint, content string")
    for flow in (fl.flow_direct, fl.flow_first_chunk):
        out = flow(docs, fl.table_responder(answers, ["doc_id"]), 10)
        assert sorted(r.doc_id for r in out.collect()) == [1, 2]
    out = fl.flow_map_reduce(docs, fl.table_responder(answers, ["doc_id"]), 2)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_map_reduce_with_callable_model(spark):
    """Two stages against one model function: chunk answers, then the
    consolidation request, whose prompt lists every part in order."""
    docs = _docs(spark)
    seen = []

    def model(request):
        prompt = request["messages"][1]["content"]
        if "PARTE 1:" in prompt:
            parts = prompt.count("\nPARTE ")
            return '{"nombre": "", "resumen": "%d parts", "exito": false}' % parts
        return '{"resumen": "chunk", "resultados": "r", "extra": 1}'

    out = fl.flow_map_reduce(docs, call_responder(model), chunk_size=40)
    rows = {r.doc_id: r for r in rs.analysis_columns(out).collect()}
    assert sorted(rows) == list(range(6))
    for i, r in rows.items():
        assert r.branch == "parsed"
        assert r.nombre == f"paper_{i}.pdf"
        if r.n_parts > 1:
            assert r.resumen == f"{r.n_parts} parts"
            assert r.prompt.index("PARTE 1:") < r.prompt.index(f"PARTE {r.n_parts}:")
            assert "extra: 1" in r.prompt
        else:
            assert r.resumen == "chunk"


def test_run_batch_saves_successes_and_skips_them_next_time(spark):
    from scriptorium.session import scratch_path
    from scriptorium.sources import sink
    out = scratch_path(spark, "run-batch")
    docs = _docs(spark)

    def model(request):
        if "Title 3\n" in request["messages"][1]["content"]:
            raise RuntimeError("service down")
        return '{"resumen": "ok"}'

    results, summary = fl.run_batch(docs, call_responder(model, concurrency=4), out, "2026-01-01T00:00:00",
                                    chunk_size=50)
    s = summary.collect()[0]
    assert (s.total, s.successes, s.errors) == (6, 5, 1)
    err = results.filter("status = 'error'").collect()
    assert [(r.stem, r.nombre, r.error, r.output_path) for r in err] == [
        ("paper_3", "paper_3.pdf", "Error: service down", None)]
    assert {r.output_path for r in results.filter("status = 'success'").collect()} == {out}
    assert sorted(r.stem for r in sink.processed_keys(spark, out).collect()) == \
        ["paper_0", "paper_1", "paper_2", "paper_4", "paper_5"]
    results2, summary2 = fl.run_batch(docs, call_responder(lambda r: '{"resumen": "again"}'), out,
                                      "2026-01-02T00:00:00", chunk_size=50, flow="map_reduce")
    assert [r.stem for r in results2.collect()] == ["paper_3"]


def test_run_batch_takes_one_paper_per_stem_and_a_named_batch_once(spark):
    from scriptorium.session import scratch_path
    out = scratch_path(spark, "run-batch")
    docs = spark.createDataFrame([(1, "/x/a.pdf", "One."), (2, "/x/a.PDF", "Two."), (3, "/x/b.pdf", "Three.")],
                                 "doc_id bigint, paper_name string, text string")
    answer = call_responder(lambda r: '{"resumen": "ok"}')
    for stamp in ("2026-01-01T00:00:00", "2026-01-02T00:00:00"):
        results, _ = fl.run_batch(docs, answer, out, stamp, batch="only")
        assert sorted(r.paper_name for r in results.collect()) == ["/x/a.PDF", "/x/b.pdf"]


def test_settings_reach_the_requests_and_cuts_are_told(spark):
    from scriptorium.plans.settings import JobSettings

    def model(request):
        return '{"resumen": "%s %.1f %d"}' % (request["model"], request["temperature"], request["max_tokens"])

    s = JobSettings(model="m", temperature=0.7, max_tokens=50, chunk_size=1000, prompt_limit=700)
    rows = rs.analysis_columns(fl.flow_direct(_docs(spark), call_responder(model), settings=s)).collect()
    assert {r.resumen for r in rows} == {"m 0.7 50"}
    assert {r.doc_id: r.truncated for r in rows}[0] is False and {r.doc_id: r.truncated for r in rows}[5] is True
    assert all(len(r.prompt) <= 700 + 40 for r in rows)


def test_a_failed_chunk_fails_the_paper_without_a_second_request(spark):
    def model(request):
        prompt = request["messages"][1]["content"]
        assert "PARTE 1:" not in prompt or "paper_5" not in prompt
        if "Title 5" in prompt:
            raise RuntimeError("down")
        return '{"resumen": "r"}'

    out = {r.doc_id: r for r in fl.flow_map_reduce(_docs(spark), call_responder(model, 1), chunk_size=40).collect()}
    assert sorted(out) == list(range(6))
    assert (out[5].ok, out[5].branch, out[5].call_error, out[5].analysis) == (False, "failed", "down", None)
    assert out[4].ok and out[4].branch == "parsed"
