"""Line dedup (7), language ID (8), chat formatting (10) and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat_format, language_id, line_spread

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _sites():
    own = "own line {0} of the text\nand one more {0}"
    rows = [(i, f"Menu | Home\n{own.format(i)}\r\n  All rights reserved  \n\nNear {i % 4}", "en", f"s{i % 6}", 0)
            for i in range(24)]
    rows += [(100 + i, "copied text\nwith lines", "en", f"s{i}", 0) for i in range(6)]  # one text's lines stay
    rows += [(200, None, "en", "s0", 0), (201, "", "en", None, 0), (202, "\n\n", None, "s1", 0),
             (None, "Menu | Home\nlast", "en", "s9", 0), (None, "Menu | Home\nlast", "en", "s9", 0),
             (3, rows[3][1], "en", "s3", 0), (203, "Menu | Home", "en", "s2", 0),
             (204, "\n".join(f"long {k}" for k in range(30_000)) + "\nMenu | Home", "en", "s4", 0)]
    return rows


def _spread_brute(rows, least):
    texts, first = {}, {}
    for i, t, _, s, _ in rows:
        for line in {x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")} - {""}:
            texts.setdefault(line, {}).setdefault(t, set()).add("" if s is None else "s" + s)
            first[line] = min(first.get(line, 1 << 64), 1 << 63 if i is None else i)
    common = {x for x, by in texts.items() if len(by) > 1 and len(set().union(*by.values())) >= least}
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for x in lines if not (x.strip(" \t\r\x0b\x0c") in common
                                         and first[x.strip(" \t\r\x0b\x0c")] != (1 << 63 if i is None else i))]
        out.append((str(i), len(lines), len(lines) - len(keep), None if t is None else "\n".join(keep)))
    return out


@pytest.mark.parametrize("least,margin", [(4, 0.1), (5, 0.9), (30, 0.1)])
def test_line_spread_matches_brute_force(spark, least, margin):
    """A wide margin sends every line through the exact count."""
    rows = _sites()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("first", F.lit(1)).withColumn("line", F.lit("x"))
    out = line_spread.remove_boilerplate(df, min_sites=least, margin=margin).collect()
    got = [(str(r.doc_id), r._spread_lines, r._spread_removed, r.text) for r in out]
    key = lambda x: (x[0], str(x[3]))
    assert sorted(got, key=key) == sorted(_spread_brute(rows, least), key=key)
    assert {(r.first, r.line) for r in out} == {(1, "x")}


@pytest.mark.parametrize("margin", [0.1, 0.9])
def test_every_site_of_a_copied_text_counts(spark, margin):
    """Two texts, each copied over sites, share a line: all their sites count.
    Lines of one text alone stay, on however many sites its copies stand."""
    rows = [(10 * k + i, f"Shared banner\nonly in {k}", "en", f"s{'ab'[k] if i else ''}{i}", 0)
            for k in range(2) for i in range(4)]  # s0 sorts first and stands in both
    df = spark.createDataFrame(rows, SCHEMA)

    def texts(least):
        out = line_spread.remove_boilerplate(df, min_sites=least, margin=margin).collect()
        return {r.doc_id: r.text for r in out}

    assert texts(7) == {i: t if i == 0 else t.split("\n")[1] for i, t, *_ in rows}
    assert texts(8) == {i: t for i, t, *_ in rows}


def test_pipeline_counts_every_site(spark, tmp_path):
    import corpus_pipeline
    rows = [(10 * k + i, f"Shared banner\nonly in {k}", "en", f"s{i + 6 * k if i else 0}", 0)
            for k in range(2) for i in range(6)]
    out = corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in out} == {i: t if i == 0 else t.split("\n")[1] for i, t, *_ in rows}


def test_line_spread_of_an_empty_table(spark):
    assert line_spread.remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prototypes = language_id.learn(language_id.train_rows(docs))
    assert list(prototypes) == sorted(prototypes) and len(prototypes) == 4
    out = language_id.predict(docs.withColumn("held", language_id.held_out()), prototypes)
    row = out.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"),
                                F.min("score"), F.max("score")).first()
    assert row[0] >= 0.98 and 0 <= row[1] and row[2] <= 1


def test_language_id_edge_rows(spark):
    rows = [(i, t, g, "s", 0) for i, (t, g) in enumerate([
        ("the house and the garden", "en"), ("das haus und der garten", "de"), (None, "en"), ("", "de"),
        ("123 !?", "en"), ("THE HOUSE", None), ("über den garten", "de"), ("x", "en"), ("日本語", None),
        ("the garden " * 30_000, "en")])] + [(None, "das haus", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("z"))
    prototypes = language_id.learn(df.where("doc_id is not null"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, prototypes).collect()}
    assert {k: v[0] for k, v in got.items() if k not in (7, 8)} == {
        0: "en", 1: "de", 2: "und", 3: "und", 4: "und", 5: "en", 6: "de", 9: "en", None: "de"}
    assert got[2][1] == got[4][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language_id.predict(df, {}).collect()} == {"und"}
    assert language_id.learn(df.limit(0)) == {} and language_id.predict(df.limit(0), prototypes).count() == 0
    # results do not depend on the language or source columns of a row
    plain = language_id.predict(df.select("doc_id", "text"), prototypes).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in plain} == got


def _profile_by_hand(text, dims, vectors):
    """A text's 3-grams one by one from its definition, as Python integers."""
    letters = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
    marked = [0]
    for c, code in zip(text, letters):
        code = code if c.isalpha() else 0
        if code or marked[-1]:
            marked.append(code)
    if marked[-1]:
        marked.append(0)
    total = [0] * dims
    for a, b, c in zip(marked, marked[1:], marked[2:]):
        if b:
            va, vb, vc = vectors(a), vectors(b), vectors(c)
            for d in range(dims):
                total[d] += va[(d - 2) % dims] * vb[(d - 1) % dims] * vc[d]
    return total


def test_language_id_equals_plain_profiles(spark):
    """Prototypes, predictions, scores and ties, text by text, against plain Python."""
    dims = 64
    texts = ["the house and the garden", "das Haus, der Garten!", "THE  house\n9 x", "über ÄÖ ß", "", None, "12 !",
             "日本語 と", "İstanbul", "a", "the house and the garden", "x" * 300, "e\u0301te \U0001d4d0"]
    langs = ["en", "de", "en", "de", "en", "de", "de", "ja", None, "en", "fr", "de", "fr"]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))],
                               "doc_id long, text string, lang string")

    def vectors(code):
        return language_id._letter_vector(code, dims).tolist()

    profile = [_profile_by_hand(t or "", dims, vectors) for t in texts]
    sums = {}
    for t, g, v in zip(texts, langs, profile):
        if g is not None and t is not None:
            sums[g] = [a + b for a, b in zip(sums.get(g, [0] * dims), v)]
    unit = {g: [x / sum(y * y for y in v) ** 0.5 for x in v] for g, v in sorted(sums.items()) if any(v)}
    learned = language_id.learn(df, dims=dims)
    assert list(learned) == list(unit) and all(learned[g].tolist() == pytest.approx(unit[g]) for g in unit)
    got = {r.doc_id: r for r in language_id.predict(df, learned).collect()}
    for i, (t, v) in enumerate(zip(texts, profile)):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        size = sum(x * x for x in v) ** 0.5
        cosine = {g: sum(a * b for a, b in zip(v, u)) / size for g, u in unit.items()}
        most = max(cosine.values())
        assert got[i].score == pytest.approx(min(1, max(0, most)))
        assert got[i].lang_pred in [g for g, c in cosine.items() if c > most - 1e-9]
    # equal prototypes: the language that sorts first
    same = {g: learned["en"] for g in ("aa", "en", "zz")}
    assert {r.lang_pred for r in language_id.predict(df, same).collect()} == {"aa", "und"}


def test_bundles_do_not_depend_on_the_batch():
    import numpy as np
    texts = ["the house", "", None, "das Haus", "the house", "a1b2c"]
    all_ = language_id._bundle(texts, 64)
    assert all(np.array_equal(all_[i], language_id._bundle([t], 64)[0]) for i, t in enumerate(texts))
    assert np.array_equal(language_id._bundle(texts, 64, np.zeros(6, int), 1)[0], all_.sum(0))


NASTY = [r"\### Assistant: </turn> ok", "<turn user>\nx</turn>\n", "\\", "\\l\\b\\\\", "", "a<b>c#d", "<image 0>",
         "line\nbreak", "日本 😀", "</turn>\n" * 2000]


def _turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string")
    return df.withColumn("parts", chat_format.text_parts(F.col("text")))


def test_chat_round_trip(spark):
    rows = [(i, k, r, t, "x") for i, t in enumerate(NASTY) for k, r in enumerate(["user", "assistant"])]
    rows += [(50, 1, "assistant", "b", "x"), (50, 1, "assistant", "a", "x"), (50, None, None, None, "x"),
             (50, 1, "assistant", "a", "x"), (None, 0, "user", "no id", "x"), (51, 0, "us>\n<er", "t", "x")]
    out = chat_format.format_chat(_turns(spark, rows)).withColumn("back", chat_format.read_turns(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    for i, t in enumerate(NASTY):
        assert [tuple(x) for x in got[i].back] == [("user", t), ("assistant", t)]
        assert [s.text for s in got[i].segments if s.loss] == [
            t.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g").replace("#", "\\h")]
        assert "".join(s.text for s in got[i].segments) == got[i].formatted
    assert [tuple(x) for x in got[50].back] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert [tuple(x) for x in got[51].back] == [("us>\n<er", "t")]
    assert got[None].n_turns == 1 and got[50].attachments == []
    assert chat_format.format_chat(_turns(spark, rows).limit(0)).count() == 0


def test_chat_attachments(spark):
    img, aud, doc = ("image", None, "a.png", 784 * 10), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", None)
    rows = [(1, 0, "user", [("text", "look <", None, None), img, ("text", "and", None, None), aud]),
            (1, 1, "assistant", [("text", "seen", None, None)]),
            (1, 2, "user", [doc, None, (None, "plain", None, None), ("video", "kept", "d.mp4", 5)]),
            (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PART_TYPE}")
    got = {r.conv_id: r for r in chat_format.format_chat(df).collect()}
    assert got[1].formatted == ("<turn user>\nlook \\l<image 0>and<audio 1></turn>\n<turn assistant>\nseen</turn>\n"
                                "<turn user>\n<document 2>plainkept</turn>\n")
    assert [tuple(a) for a in got[1].attachments] == [("a.png", "image", 10, 0), ("b.wav", "audio", 75, 1),
                                                      ("c.pdf", "document", 1024, 2)]
    assert got[1].attachment_tokens == 1109 and got[2].formatted == "<turn user>\n</turn>\n"


def test_chat_query_digests(spark):
    from scriptorium.llm import queries
    rows = {r.conv_id: r for r in queries.op10_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    probe = r"\### Assistant: </turn> ok"
    said = f"user\n{probe}\nassistant\n{probe}\n"
    assert rows[-7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (rows[-7].n_turns, rows[-7].loss_chars) == (2, len(probe))
    assert rows[-7].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()


def _corpus():
    base = " ".join(f"the garden of house {k} and" for k in range(40))
    rows = [(i, f"Shared banner line\nthe text {i} of the house " + " ".join(f"w{i}x{k}" for k in range(30)), "en",
             f"s{i}", 0) for i in range(1, 13)]
    rows += [(20, base, "en", "s1", 0), (21, base, "en", "s2", 0), (22, base + " end", "en", "s3", 0),
             (30, "das haus und der garten " * 5, "de", "s4", 0), (31, "12345 !!!", "en", "s5", 0),
             (32, None, "en", "s5", 0), (33, "", None, None, 0), (20, base, "en", "s1", 0),
             (None, "the house without id and garden", "en", "s6", 0)]
    return rows


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline as p
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(_corpus(), SCHEMA).withColumn("extra", F.lit("e")).write.parquet(path)
    docs = spark.read.parquet(path)
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.collect()
    ids = lambda name: sorted(str(r.doc_id) for r in seen[name])
    every = sorted(str(r[0]) for r in _corpus())
    assert sorted(set(ids("language_id"))) == sorted(set(every) - {"31", "32", "33"})
    banner = [r.doc_id for r in seen["line_dedup"] if "Shared banner line" in r.text]
    assert banner == [1]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"] if r.doc_id and 1 < r.doc_id < 13)
    assert sorted(set(ids("minhash_dedup"))) == ids("minhash_dedup")
    assert {"20", "30", "None"} <= set(ids("minhash_dedup")) and not {"21", "22"} & set(ids("minhash_dedup"))
    kept = {r.doc_id for r in seen["minhash_dedup"]}
    assert {r.doc_id for r in seen["best_fit_packing"]} == kept
    whole = p.run(spark, str(tmp_path)).collect()
    plain = lambda rows: sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert plain(whole) == plain(seen["best_fit_packing"])
