"""Section splitters and chunking: written-out expectations and properties."""

import re

from hypothesis import given, settings, strategies as st

from scriptorium.operators import chunks as ch
from scriptorium.operators import sections as se

WORDS = ["abstract", "Abstract", "introduction", "1. Introduction", "method", "methodology", "approach",
         "discussion", "methodiscussion", "results", "evaluation", "experiment", "conclusion", "references",
         "bibliography", "2 ", "3.", "4 ", "12 ", "x", "text", " ", "  "]
TEXTS = st.lists(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), min_size=1, max_size=12)


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def _by_doc(rows, *cols):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols))
    return out


def test_cascade_table(spark):
    texts = ["pre abstract one 1. introduction two results three conclusion four",
             "conclusion a results b method c introduction d abstract e",
             "no heading", "   ", "abstract", "Evaluation of abstract things",
             "abstract a abstract b"]
    got = _by_doc(se.section_cascade(_docs(spark, texts)).collect(), "section", "start_pos", "text")
    assert got == {
        0: [("abstract", 4, "abstract one 1. introduction two results three conclusion four"),
            ("preambulo", 0, "pre ")],
        1: [("abstract", 47, "abstract e"), ("introduction", 32, "introduction d "), ("methodology", 23, "method c "),
            ("results", 13, "results b "), ("conclusion", 0, "conclusion a ")],
        2: [("preambulo", 0, "no heading")],
        4: [("abstract", 0, "abstract")],
        5: [("abstract", 14, "abstract things"), ("results", 0, "Evaluation of ")],
        6: [("abstract", 0, "abstract a abstract b")]}


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_cascade_pieces_rebuild_the_text(spark, texts):
    got = _by_doc(se.section_cascade(_docs(spark, texts)).collect(), "start_pos", "text")
    for i, t in enumerate(texts):
        pieces = sorted(got.get(i, []))
        assert all(t[p:p + len(s)] == s for p, s in pieces)
        joined = "".join(s for _, s in pieces)
        assert t.endswith(joined) and not t[:len(t) - len(joined)].strip()  # only a blank preamble is left out


def test_segments_table(spark):
    texts = ["pre abstract one method two abstract three", "nothing here", "methodiscussion",
             "Results r 3. more References z", "2 4 x"]
    got = _by_doc(se.section_segments(_docs(spark, texts)).orderBy("doc_id", "seq").collect(),
                  "section", "start_pos", "text")
    assert got == {
        0: [("abstract", 4, "abstract one"), ("methodology", 17, "method two"), ("abstract", 28, "abstract three")],
        2: [("methodology", 0, "metho"), ("conclusion", 5, "discussion")],
        3: [("results", 0, "Results r"), ("results", 10, "3. more"), ("references", 18, "References z")],
        4: [("methodology", 0, "2"), ("conclusion", 2, "4 x")]}
    last = _by_doc(se.paper_sections(_docs(spark, texts)).collect(), "section", "text")
    assert {k: sorted(v) for k, v in last.items()} == {
        0: [("abstract", "abstract three"), ("methodology", "method two")],
        2: [("conclusion", "discussion"), ("methodology", "metho")],
        3: [("references", "References z"), ("results", "3. more")], 4: [("conclusion", "4 x"), ("methodology", "2")]}


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_segments_start_at_their_headings(spark, texts):
    rows = _by_doc(se.section_segments(_docs(spark, texts)).orderBy("doc_id", "seq").collect(),
                   "section", "start_pos", "text")
    last = _by_doc(se.paper_sections(_docs(spark, texts)).collect(), "section", "text")
    for i, t in enumerate(texts):
        mine = rows.get(i, [])
        starts = [p for _, p, _ in mine]
        assert starts == sorted(set(starts))
        for (name, p, s), end in zip(mine, [*starts[1:], len(t)]):
            assert re.match(se.SEGMENT_PATTERNS[name], t[p:], re.IGNORECASE)
            assert t[p:end].strip() == s
        for name, pattern in se.SEGMENT_PATTERNS.items():
            assert {m.start() for m in re.finditer(pattern, t, re.IGNORECASE)} == {p for n, p, _ in mine if n == name}
        assert dict(last.get(i, [])) == {n: s for n, _, s in mine}


def _chunks(spark, texts, size):
    rows = ch.split_chunks(_docs(spark, texts), size).orderBy("doc_id", "chunk_index").collect()
    return _by_doc(rows, "chunk_index", "text", "section", "chunk_part", "total_chunks")


def test_split_chunks_table(spark):
    n = 10  # 40 characters per chunk, windows of 40 every 36
    q = "".join(chr(97 + i % 26) for i in range(100))
    texts = ["a" * 40, "b" * 43, "z" * 44, "conclusion " + "w" * 20 + " abstract " + "y" * 25, q]
    assert _chunks(spark, texts, n) == {
        0: [(0, "a" * 40, None, None, None)],
        1: [(0, "b" * 43, None, None, None)],  # 43 characters are 10 tokens
        2: [(0, "z" * 40, "preambulo", "1", 2), (1, "z" * 8, "preambulo", "2", 2)],
        3: [(0, "abstract " + "y" * 25, "abstract", None, 2), (1, "conclusion " + "w" * 20 + " ", "conclusion", None, 2)],
        4: [(0, q[:40], "preambulo", "1", 3), (1, q[36:76], "preambulo", "2", 3), (2, q[72:], "preambulo", "3", 3)]}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS + ["lorem ipsum dolor"] * 4), max_size=40).map(" ".join),
                min_size=1, max_size=8), st.sampled_from([3, 10, 25]))
def test_split_chunks_properties(spark, texts, size):
    rows = _chunks(spark, texts, size)
    sections = _by_doc(se.section_cascade(_docs(spark, texts)).collect(), "section", "text")
    counts = {r.doc_id: r.n_chunks for r in ch.chunk_counts(_docs(spark, texts), size).collect()}
    firsts = {r.doc_id: r.c for r in _docs(spark, texts).select(
        "doc_id", ch.first_chunk_struct("text", size).alias("c")).collect()}
    width = 4 * size
    step = width - min(500, width // 10)
    for i, t in enumerate(texts):
        mine = rows[i] if i in rows else []
        assert counts[i] == len(mine)
        if not mine:
            continue
        assert tuple(firsts[i][c] for c in ("text", "section", "chunk_part", "total_chunks")) == mine[0][1:]
        if len(t) // 4 <= size:
            assert mine == [(0, t, None, None, None)]
            continue
        assert [m[0] for m in mine] == list(range(len(mine))) and {m[4] for m in mine} == {len(mine)}
        short = [(n, s) for n, s in sections[i] if n in ("abstract", "conclusion") and len(s) <= width]
        assert [(m[2], m[1]) for m in mine[:len(short)]] == sorted(short)  # these come first
        for name, s in sections[i]:
            parts = [m for m in mine if m[2] == name]
            if len(s) <= width:
                assert [(m[1], m[3]) for m in parts] == [(s, None)]
            else:  # windows overlap and cover the section
                assert [m[3] for m in parts] == [str(k + 1) for k in range(len(parts))]
                assert all(m[1] == s[k * step:][:width] for k, m in enumerate(parts))
                assert len(parts) == -(-len(s) // step)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="xy ", max_size=60), min_size=1, max_size=8), st.integers(2, 12), st.integers(0, 5))
def test_windows_cover_text(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    rows = _by_doc(ch.window_chunks(_docs(spark, texts), size, overlap).collect(), "offset", "text", "part")
    step = size - overlap
    for i, t in enumerate(texts):
        mine = sorted(rows.get(i, []))
        assert [(o, p) for o, _, p in mine] == [(k * step, k + 1) for k in range(-(-len(t) // step))]
        assert all(t[o:o + size] == s for o, s, _ in mine)
