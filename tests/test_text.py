"""Text functions: written-out expectations and properties."""

import os
import string

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

# input -> (one cleaning pass, two passes)
CLEANED = {
    "": ("", ""),
    "   ": ("", ""),
    "aéb": ("ab", "ab"),
    "a é b": ("a  b", "a b"),
    "a\x1cb": ("a b", "a b"),
    "a\xa0b": ("a b", "a b"),
    "x \U0001F600 y": ("x  y", "x y"),
    "\ta\n\nb\r\n": ("a b", "a b"),
    "a b　c": ("a b c", "a b c"),
    "a\x85b": ("a b", "a b"),
    "\x7f\x00z": ("z", "z"),
    "  lead and trail  ": ("lead and trail", "lead and trail"),
}
ODD = st.text(alphabet=st.sampled_from(list("ab .\t\n\xa0 \x1cé\x7f\x01")), max_size=30)


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


def _scan(t):
    """Cleaning as one walk over the characters."""
    out, gap = [], False
    for ch in t:
        if ch.isspace():
            gap = True
            continue
        if gap:
            out.append(" ")
            gap = False
        if ch in string.printable[:95]:
            out.append(ch)
    return "".join(out).strip(" ")


def test_clean_and_normalize_tables(spark):
    assert _apply(spark, tx.clean_text, [*CLEANED, None]) == [a for a, _ in CLEANED.values()] + [None]
    assert _apply(spark, tx.normalize_text, list(CLEANED)) == [b for _, b in CLEANED.values()]


@settings(max_examples=15, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=20))
def test_clean_is_a_character_scan_and_normalize_its_fixpoint(spark, values):
    once = _apply(spark, tx.clean_text, values)
    assert once == [_scan(v) for v in values]
    twice = _apply(spark, tx.normalize_text, values)
    assert twice == _apply(spark, tx.clean_text, once) == _apply(spark, tx.reclean, once)
    assert _apply(spark, tx.clean_text, twice) == twice


def test_layout_clean(spark):
    rows = {"intro\n 12 \nnext page": "intro\nnext page",
            "a\n3\n4\nb": "a\n4\nb",
            "top\nPaper arXiv:2401.00001v1 preprint\nbody": "top\nbody",
            "x\n" + "h" * 60 + "arXivt\ny": "x\n" + "h" * 60 + "arXivt\ny",
            "no newline 5 here": "no newline 5 here",
            "p\n٣\nq": "p\nq"}
    assert _apply(spark, tx.layout_clean, list(rows)) == list(rows.values())


def test_paper_metadata(spark):
    rows = {"no dot here": ("", "", ""), ".starts with dot": ("", "", ""),
            "Title words Abstract then. more": ("Title words", "", ""), "lower abstract. x": ("lower abstract", "", ""),
            "T. arXiv:2401.00001 no version": ("T", "", ""),
            "Head arXiv:2401.00012v3. rest": ("Head arXiv:2401", "", "2401.00012v3"),
            "L1\nL2\nL3.\nL4": ("L1 L2 L3", "", ""), "L1\nL2\nL3\nL4.": ("", "", ""),
            "A. arXiv:1.2v3 arXiv:4.5v6": ("A", "", "1.2v3"), "": ("", "", "")}
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(tx.paper_metadata("t").alias("m"))
           .select("m.title", "m.authors", "m.arxiv_id").collect()]
    assert got == list(rows.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="./ab", max_size=8), min_size=1, max_size=12))
def test_stem_matches_os_path(spark, paths):
    paths = [*paths, "/in/a.pdf", "/in/a.b.PDF", "/in/.bashrc", "/in/...", "/in/noext", "rel/x.", "/in/..a.pdf"]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, p string")
    got = [tuple(r) for r in df.orderBy("i").select(tx.base_name("p"), tx.paper_stem("p")).collect()]
    assert got == [(os.path.basename(p), os.path.splitext(os.path.basename(p))[0]) for p in paths]


def test_preprocess_is_one_pass_on_raw_text(spark):
    from scriptorium.operators import requests as rq
    df = spark.createDataFrame([(1, "a é b.", "", "", "")], "doc_id bigint, text string, title string, "
                               "authors string, arxiv_id string")
    row = rq.preprocess(df, 10, count="n_chunks").collect()[0]
    assert (row.structured, row.n_chunks) == ("a  b.", 1)


def test_running_sums_of_any_size(spark):
    arrays = [list(range(-3, n - 3)) for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 99, 100, 101, 5000)] + [None]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, a array<int>")
    got = [r[0] for r in df.orderBy("i").select(tx.exclusive_sums(F.col("a"))).collect()]
    assert got == [a and [sum(a[:i]) for i in range(len(a))] if a is not None else None for a in arrays]
