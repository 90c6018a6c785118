"""SQL spellings for the DuckDB oracle.

The oracle re-states each rule literally (e.g. two cleaning passes, the
cascade searching inside the shrinking prefix) so that it cross-checks the
Spark formulation instead of repeating it.
"""

from __future__ import annotations

from ..functions.text import WS_CHARS, WS_CLASS
from ..operators.sections import CASCADE_PATTERNS, SEGMENT_PATTERNS


def lit(s: str) -> str:
    """A DuckDB string literal (newlines and quotes kept)."""
    return "'" + s.replace("'", "''") + "'"


WS_LIT = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def py_strip(x: str) -> str:
    return f"trim({x}, {WS_LIT})"


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'), "
            r"'[^\x20-\x7E]', '', 'g'))")


def normalize(x: str) -> str:
    return clean(clean(x))


def pattern(p: str) -> str:
    return "(?:" + p.replace(r"\s", WS_CLASS) + ")"


def first_hit(x: str, p: str) -> str:
    """0-based offset of the first case-insensitive hit, NULL if none."""
    pat = pattern(p)
    return (f"CASE WHEN regexp_matches({x}, '{pat}', 'i') "
            f"THEN length(regexp_extract({x}, '^(.*?){pat}', 1, 'is')) END")


def cascade_sql(src: str, key: str = "doc_id", text: str = "text") -> str:
    """Long-form cascade: key, section, start_pos, text (literal prefix search)."""
    names = list(CASCADE_PATTERNS)
    steps = [f"c0e AS (SELECT {key}, {text} AS t, length({text}) AS e0 FROM {src})"]
    for i, name in enumerate(names, start=1):
        hit = first_hit(f"substr(t, 1, e{i - 1})", CASCADE_PATTERNS[name])
        steps.append(f"c{i} AS (SELECT *, {hit} AS p{i} FROM c{i - 1}e)")
        steps.append(f"c{i}e AS (SELECT *, coalesce(p{i}, e{i - 1}) AS e{i} FROM c{i})")
    last = f"c{len(names)}e"
    parts = []
    for i, name in enumerate(names, start=1):
        parts.append(f"SELECT {key}, '{name}' AS section, CAST(p{i} AS BIGINT) AS start_pos, "
                     f"substr(t, p{i} + 1, e{i - 1} - p{i}) AS text, {i} AS ord FROM {last} "
                     f"WHERE p{i} IS NOT NULL")
    n = len(names)
    parts.append(f"SELECT {key}, 'preambulo' AS section, CAST(0 AS BIGINT) AS start_pos, "
                 f"substr(t, 1, e{n}) AS text, {n + 1} AS ord FROM {last} "
                 f"WHERE {py_strip(f'substr(t, 1, e{n})')} <> ''")
    return "WITH " + ",\n".join(steps) + "\n" + "\nUNION ALL\n".join(parts)


def segments_sql(src: str, key: str = "doc_id", text: str = "text") -> str:
    """All heading segments: key, seq, section, start_pos, text.

    Stated per pattern: its hits one after another, each starting after the
    texts between the hits and the hits before it; of two patterns that hit at
    one place the later one names the segment, which runs to the next start."""
    hits = "\nUNION ALL\n".join(
        f"SELECT {key}, {text} AS t, '{name}' AS section, {i} AS ord, "
        f"string_split_regex({text}, '(?i){pattern(p)}') AS gaps, "
        f"regexp_extract_all({text}, '(?i){pattern(p)}') AS hits FROM docs"
        for i, (name, p) in enumerate(SEGMENT_PATTERNS.items()))
    before = ("list_transform(range(1, len(hits) + 1), lambda k: "
              "list_sum(list_transform(gaps[1:k], lambda x: length(x))) "
              "+ coalesce(list_sum(list_transform(hits[1:k - 1], lambda y: length(y))), 0))")
    return f"""
WITH docs AS MATERIALIZED (SELECT {key}, {text} FROM {src}),
h AS ({hits}),
p AS (SELECT {key}, t, section, ord, unnest({before}) AS start_pos FROM h),
d AS (SELECT {key}, start_pos, any_value(t) AS t, arg_max(section, ord) AS section FROM p GROUP BY {key}, start_pos),
s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_pos) AS seq,
             lead(start_pos) OVER (PARTITION BY {key} ORDER BY start_pos) AS stop FROM d)
SELECT {key}, CAST(seq AS BIGINT) AS seq, section, CAST(start_pos AS BIGINT) AS start_pos,
       {py_strip('substr(t, CAST(start_pos AS BIGINT) + 1, CAST(coalesce(stop, length(t)) - start_pos AS BIGINT))')} AS text
FROM s"""
