"""Property tests (hypothesis) of parser, truncation, merge and attempts."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import prompts as pr
from scriptorium.operators import merge as mg
from scriptorium.operators import responses as rs

scalars = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from(["x", "0", "nombre"]))
values = st.recursive(scalars, lambda inner: st.one_of(
    st.lists(inner, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "nombre"]), inner, max_size=3)), max_leaves=6)
objects = st.dictionaries(st.sampled_from(["resumen", "resultados", "exito", "performance", "k1", "k2"]), values,
                          max_size=5)
FENCES = ["{}", "```json\n{}\n```", "```\n{}\n```", "Answer: ```json {} ``` done"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(FENCES), objects, st.sampled_from(["", " tail", "]"])), min_size=1, max_size=10))
def test_objects_survive_any_fence_and_nothing_else_parses(spark, cases):
    """An object comes back key by key under every fence, with the paper's
    name appended; the same text with a tail is no JSON."""
    rows = [(i, f.replace("{}", json.dumps(o) + tail, 1)) for i, (f, o, tail) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, content string").withColumn("paper_name", F.lit("p"))
    out = rs.parse_response(df).withColumn("js", F.to_json("analysis")).orderBy("i").collect()
    for r, (_, o, tail) in zip(out, cases):
        if tail:
            assert r.branch == "fallback"
        else:
            assert r.branch == "parsed" and list(json.loads(r.js).items()) == [*o.items(), ("nombre", "p")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab-", max_size=60), min_size=1, max_size=10), st.sampled_from([5, 20, 40]))
def test_truncation_keeps_short_prompts_and_head_and_tail(spark, prompts, limit):
    df = spark.createDataFrame(list(enumerate(prompts)), "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(pr.truncate_prompt("p", limit)).collect()]
    for p, g in zip(prompts, got):
        parts = p.split("-----")
        if len(p) <= limit:
            assert g == p
        elif len(parts) < 3:
            assert g == p[:limit]
        else:
            assert g.startswith(parts[0] + "-----") and g.endswith("... [texto truncado]-----" + parts[2])
            body = g[len(parts[0]) + 5:-len("... [texto truncado]-----" + parts[2])]
            assert parts[1].startswith(body)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.booleans(), st.sampled_from(["u", "v", "w"])), min_size=1, max_size=6),
                min_size=1, max_size=6))
def test_merge_closed_form(spark, groups):
    rows = [(g, "k", i, is_str, v) for g, items in enumerate(groups) for i, (is_str, v) in enumerate(items)]
    df = spark.createDataFrame(rows, "conv_id bigint, k string, seq bigint, is_str boolean, v string")
    got = {r.conv_id: (r.merged, r.merged_is_str) for r in mg.merge_results(df).collect()}
    assert {r.conv_id: (r.merged, r.merged_is_str) for r in mg.merge_results(df, bucket_width=2).collect()} == got
    for g, items in enumerate(groups):
        others = [i for i, (is_str, _) in enumerate(items) if not is_str]
        tail = items[others[-1] + 1:] if others else items
        assert got[g] == (("\n\n".join(v for _, v in tail), True) if tail else (items[-1][1], False))


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.lists(st.booleans(), min_size=1, max_size=6), min_size=1, max_size=8))
def test_first_success_matches_brute_force(spark, histories):
    rows = [(rid, a + 1, ok, f"{rid}:{a + 1}") for rid, oks in histories.items() for a, ok in enumerate(oks)]
    df = spark.createDataFrame(rows, "request_id bigint, attempt int, ok boolean, content string")
    got = {r.request_id: (r.attempt, r.ok, r.content) for r in rs.first_success(df, max_attempts=3).collect()}
    for rid, oks in histories.items():
        tried = oks[:3]
        wins = [i for i, ok in enumerate(tried) if ok]
        pick = wins[0] if wins else len(tried) - 1
        assert got[rid] == (pick + 1, tried[pick], f"{rid}:{pick + 1}")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.integers(-10 ** 9, 10 ** 9)), min_size=1,
                max_size=30))
def test_latest_by_key_is_the_greatest_row(spark, rows):
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    got = {r.k: (r.seq, r.v) for r in mg.latest_by_key(df, "k", "seq", "v").collect()}
    assert got == {k: max((s, v) for q, s, v in rows if q == k) for k in {r[0] for r in rows}}
