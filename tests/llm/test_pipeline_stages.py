"""The pipeline's stages on rows that break things: nulls, ties, clashes, no labels, nothing at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from scriptorium.llm import chunk_ids, common, packing, shingles

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _spread_flags string, _lang_pred string, "
          "row string, key string, score string, language string")
CLASH = ("mine",) * 6
WORDS = [f"word{k}" for k in range(400)]
BASE = "the garden and the house of the street with a door and some windows "


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def labelled():
    return [(1000 + i, BASE + f"number {i}", "en", "s", 0) for i in range(5)] + [
        (2000 + i, "der garten und das haus an der strasse mit einer tuer und fenstern " + str(i), "de", "s", 0)
        for i in range(5)]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES[:3]])
def test_stages_keep_columns_and_take_empty_tables(spark, stage):
    df = frame(spark, labelled())
    assert stage(spark, df.limit(0), "").collect() == []
    out = stage(spark, df, "")
    assert out.columns == df.columns
    assert {r[5:] for r in plain(out)} == {CLASH}
    assert p.pack(spark, df.limit(0), "").collect() == []


def test_short_texts_in_a_learned_language_stay(spark):
    short = [(1, "Yes.", None, "s", 0), (2, "Avec.", None, "s", 0), (3, "Gut.", "de", "s", 0), (4, "A.", None, "s", 0),
             (5, "123 !", "en", "s", 0), (6, None, "en", "s", 0), (7, "", None, None, 0), (None, "Das.", None, None, 0),
             (8, "日本語の文章です。" * 40, None, "s", 0), (9, BASE * 20_000, "en", "s", 0)]
    got = {r.doc_id for r in p.language(spark, frame(spark, labelled() + short), "").collect()}
    assert got >= {1, 2, 3, 4, 9, None, 1000, 2000} and not got & {5, 6, 7, 8}


def test_without_labels_every_document_with_letters_stays(spark):
    rows = [(i, t, None, "s", 0) for i, t in enumerate([BASE, "Yes.", "12", None, "", "ЖЖ"])]
    assert {r.doc_id for r in p.language(spark, frame(spark, rows), "").collect()} == {0, 1, 5}


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    near = " ".join(WORDS[:200])
    rows = [(1, BASE * 3, None, "a", 0), (1, near, None, "b", 0), (1, near, None, "b", 0), (2, near + " end", None, "c", 0),
            (0, "quite another text of its own with words", None, "d", 0), (3, None, None, "e", 0), (4, "", None, "f", 0),
            (5, " ", None, "g", 0), (None, near, None, "h", 0), (None, BASE + "alone", None, "i", 0),
            (2 ** 62 + 1, " ".join(WORDS[200:]), None, "j", 0), (2 ** 62 + 3, " ".join(WORDS[200:]), None, "k", 0),
            (6, "long " + " ".join(WORDS * 300), None, "l", 0)]
    got = sorted((str(r.doc_id), r.source) for r in p.near_duplicates(spark, frame(spark, rows), "").collect())
    assert got == sorted((str(i), s) for i, s in [
        (1, "a"), (1, "b"), (0, "d"), (3, "e"), (4, "f"), (5, "g"), (None, "i"), (2 ** 62 + 1, "j"), (6, "l")])


def test_lines_stage_counts_sites_and_follows_n_chars(spark):
    rows = [(i, f"Banner\n{WORDS[i]}", "en", f"s{i}", 99) for i in range(12)] + [
        (20, "Banner", "en", "s0", 99), (21, None, "en", None, 99), (22, "", "en", "s", 99)]
    got = {r.doc_id: (r.text, r.n_chars) for r in p.lines(spark, frame(spark, rows), "").collect()}
    assert got == {0: ("Banner\nword0", 99), 21: (None, 99), 22: ("", 99),
                   **{i: (WORDS[i], len(WORDS[i])) for i in range(1, 12)}}


def test_a_worker_forgets_what_another_stage_remembered():
    common.begin("shingles")
    shingles.shingle_set("some words that are hashed here")
    assert shingles._words
    common.begin("shingles")
    assert shingles._words
    common.begin("chunks")
    assert not shingles._words
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    chunk_ids.encode(["some words"], path, "words")
    assert chunk_ids._remembered(path, "words", "I")
    common.begin("packing")
    assert not chunk_ids._remembered(path, "words", "I")


def test_chunk_memory_is_bounded_in_bytes(monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(chunk_ids, "MEMORY", 5000)
    text = " ".join(f"wort{k}" for k in range(500))
    want = chunk_ids.library(path).encode(text, add_special_tokens=False).ids
    got = chunk_ids.encode([text, text], path, "words")
    import numpy as np
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [want, want]
    assert chunk_ids._remembered(path, "words", "I").held < 6000


def test_levels_end_when_mixing_saves_nothing(spark):
    items = spark.range(600).select(F.lit(60).cast("long").alias("length"))  # no two fit together
    out = packing.best_fit(items, capacity=100, group=50)
    assert out.select("sequence_id").distinct().count() == 600
    some = spark.range(600).select((F.lit(21) + F.col("id") % 43).cast("long").alias("length"))
    rows = packing.best_fit(some, capacity=64, group=30).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(n for _, n in b) <= 64
