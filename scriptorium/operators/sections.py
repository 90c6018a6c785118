"""Section splitting, row-local (no shuffle).

Two splitters exist, with different patterns and semantics:

* ``section_segments`` / ``paper_sections`` — every heading hit of every
  pattern; a segment runs to the next hit; for a repeated name the last
  segment wins.
* ``section_cascade`` — patterns in a fixed order; each one takes its first
  hit in the text *before* the previous hit, from there to the end of that
  prefix; the rest becomes the preamble.

Both expect cleaned text (printable ASCII), as the pipeline produces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import WS_CLASS, col_of, exclusive_sums, explode_array, let, py_strip

# fixed values: heading patterns of the segment splitter, in this order
SEGMENT_PATTERNS = {
    "abstract": r"abstract",
    "introduction": r"introduction|1\.?\s+introduction",
    "methodology": r"methodology|method|approach|2\.?\s+",
    "results": r"results|evaluation|experiment|3\.?\s+",
    "conclusion": r"conclusion|discussion|4\.?\s+",
    "references": r"references|bibliography",
}

# fixed values: heading patterns of the cascade, in this order
CASCADE_PATTERNS = {
    "abstract": r"abstract",
    "introduction": r"introduction|1\.?\s+introduction",
    "methodology": r"methodology|method|2\.?\s+",
    "results": r"results|evaluation|3\.?\s+",
    "conclusion": r"conclusion|discussion|4\.?\s+",
}


_MARK = "\x01"  # cannot occur in cleaned text
# Every heading alternative except "discussion": no hit of one of them can
# start inside a hit of another, so one scan finds them all.  "discussion"
# may start on the last letter of "method" and gets a scan of its own.
_PASS1 = "(?i)(?:" + "|".join(
    alt for p in SEGMENT_PATTERNS.values() for alt in p.split("|") if alt != "discussion"
).replace(r"\s", WS_CLASS) + ")"
_PASS2 = "(?i)discussion"


def mark_headings(c) -> Column:
    """Insert a marker before every heading hit."""
    marked = F.regexp_replace(col_of(c), _PASS1, _MARK + "$0")
    return F.regexp_replace(marked, _PASS2, _MARK + "$0")


def segment_name(seg: Column) -> Column:
    """Section name from the first letters of a segment (its heading)."""
    h = F.lower(F.substring(seg, 1, 3))
    h1 = F.substring(h, 1, 1)
    return (F.when(h == "abs", "abstract")
            .when(h == "app", "methodology")
            .when(h1.isin("m", "2"), "methodology")
            .when(h1.isin("i", "1"), "introduction")
            .when(h == "res", "results")
            .when(h1.isin("e", "3"), "results")
            .when(h == "ref", "references")
            .when(h1 == "b", "references")
            .when(h1.isin("c", "d", "4"), "conclusion"))


def _named(name):
    return lambda s: s["section"] == F.lit(name)


def _segments(c) -> Column:
    """array<struct<seq, section, start_pos, text>> of all heading segments."""
    parts = F.split(mark_headings(c), _MARK, -1)

    def with_starts(p):
        starts = exclusive_sums(F.transform(p, lambda s: F.length(s)))
        return let(starts, lambda st: F.slice(F.transform(p, lambda s, i: F.struct(
            i.alias("seq"), segment_name(s).alias("section"),
            st[i].alias("start_pos"), py_strip(s).alias("text"))),
            2, F.greatest(F.size(p) - 1, F.lit(0))))

    return let(parts, with_starts)


def section_segments(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per heading hit: (key, seq, section, start_pos, text)."""
    return (explode_array(df, _segments(text), [key])
            .select(key, "_x.seq", "_x.section", F.col("_x.start_pos").cast("bigint").alias("start_pos"),
                    "_x.text"))


def paper_sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section name present: the text of its last segment.

    Chosen inside the row (last element of a per-name filter), so there is
    no group-by and no shuffle.
    """
    def body(p):
        segs = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                           lambda s: F.struct(segment_name(s).alias("section"), s.alias("seg")))
        picks = [F.try_element_at(F.filter(segs, _named(name)), F.lit(-1)) for name in SEGMENT_PATTERNS]
        return F.filter(F.array(*picks), lambda x: x.isNotNull())

    parts = F.split(mark_headings(text), _MARK, -1)
    return (explode_array(df, let(parts, body), [key], item="s")
            .select(key, F.col("s.section").alias("section"), py_strip(F.col("s.seg")).alias("text")))


def cascade_array(c) -> Column:
    """array<struct<section, start_pos, text>>: the cascade's sections in
    insertion order (abstract, introduction, methodology, results,
    conclusion, preambulo), present ones only.

    Each pattern's first hit inside the shrinking prefix equals its first hit
    in the whole text when that hit starts before the prefix end: no pattern
    contains a letter that can start an earlier pattern's hit, so a hit that
    starts before the cut also ends before it.  Hence five independent
    searches and a running minimum; no prefix copies.
    """
    return let(col_of(c), _cascade)


def _first_hit(low: Column, pattern: str) -> Column:
    """1-based position of a pattern's first hit in lower-cased text, NULL if
    none: the least over its alternatives.  Plain words are found by a byte
    search, the rest by a regex that begins with a digit; either is several
    times cheaper than one case-insensitive alternation."""
    found = [F.instr(low, alt) if alt.isalpha() else F.regexp_instr(low, F.lit(alt.replace(r"\s", WS_CLASS)))
             for alt in pattern.split("|")]
    hits = [F.nullif(f, F.lit(0)) for f in found]
    return F.least(*hits) if len(hits) > 1 else hits[0]


def _cascade(t: Column) -> Column:
    firsts = let(F.lower(t), lambda low: F.array(
        *[F.coalesce(_first_hit(low, p), F.lit(0)) for p in CASCADE_PATTERNS.values()]))

    def body(s):
        n = F.length(t)
        starts = [F.when(s[k] > 0, s[k] - 1) for k in range(len(CASCADE_PATTERNS))]
        ends = [n]
        for k in range(len(CASCADE_PATTERNS)):
            ends.append(F.least(n, *[x for x in starts[:k + 1]]))
        entries = []
        for k, name in enumerate(CASCADE_PATTERNS):
            hit = starts[k] < ends[k]
            entries.append(F.when(hit, F.struct(
                F.lit(name).alias("section"), starts[k].alias("start_pos"),
                F.substring(t, starts[k] + 1, ends[k] - starts[k]).alias("text"))))
        rest = F.substring(t, 1, ends[-1])
        entries.append(F.when(py_strip(rest) != "", F.struct(
            F.lit(fixed.PREAMBLE_SECTION).alias("section"), F.lit(0).alias("start_pos"),
            rest.alias("text"))))
        return F.filter(F.array(*entries), lambda x: x.isNotNull())

    return let(firsts, body)


def section_cascade(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Long form of the cascade: (key, section, start_pos, text)."""
    return (explode_array(df, cascade_array(text), [key])
            .select(key, "_x.section", F.col("_x.start_pos").cast("bigint").alias("start_pos"), "_x.text"))
