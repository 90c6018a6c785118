"""Column functions on text: cleaning, estimates, names, metadata.

All of them are built-in Spark expressions (JVM side, inside whole-stage
codegen); no Python runs per row.

Regex dialect notes.  The original rules use Python's Unicode ``\\s``, which
Java's ``\\s`` does not match (it is ASCII-only and ``(?U)\\s`` misses
``\\x1c-\\x1f``).  The class is therefore spelled out; the ``\\x{..}`` form is
understood by Java and by RE2 alike, so the oracle SQL uses the same text.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Python str.isspace() set, spelled for Java/RE2 regex character classes.
WS_CLASS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same set as a literal string, for btrim()/trim(chars).
WS_CHARS = "".join(chr(c) for c in (
    [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
     0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Characters kept by the cleaner: printable ASCII.
NON_PRINTABLE = r"[^\x20-\x7E]"
DIGIT = r"\p{Nd}"
# Non-ASCII whitespace; mapped to a space first, so the regexes below need
# ASCII classes only (a negated class with wide Unicode ranges is tested
# char by char and was 3x slower on the whole corpus).
NON_ASCII_WS = "".join(c for c in WS_CHARS if ord(c) > 0x7F)
ASCII_WS_RUN = r"[\t-\r\x1c-\x20]+"


def ascii_ws(c) -> Column:
    """Replace every non-ASCII whitespace char by a space (a run stays a run)."""
    return F.translate(c, NON_ASCII_WS, " " * len(NON_ASCII_WS))


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    Spark has no LET; a one-element ``transform`` evaluates the value once,
    which keeps nested expressions linear instead of duplicating sub-trees.
    """
    return F.transform(F.array(value), body)[0]


def _scan(numbers: Column, start: Column) -> Column:
    """``start``, ``start`` + first, ...: one entry per number."""
    return F.aggregate(numbers, F.struct(start.alias("total"), F.array().cast("array<int>").alias("sums")),
                       lambda s, x: F.struct((s["total"] + x).alias("total"),
                                             F.array_append(s["sums"], s["total"]).alias("sums")),
                       lambda s: s["sums"])


def exclusive_sums(numbers: Column) -> Column:
    """Exclusive running sums of an int array of any size, in two levels.

    Spark has no scan over arrays, and appending inside ``aggregate`` copies
    what is there.  With k numbers in blocks of sqrt(k), the blocks' sums are
    scanned first and every block then from its start, so no appended array is
    longer than sqrt(k) and the copies are k * sqrt(k) entries."""
    def run(a):
        width = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")),
                             lambda b: F.slice(a, b * width + 1, width))

        def from_starts(bs):
            totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
            return let(_scan(totals, F.lit(0)), lambda st: F.flatten(F.transform(bs, lambda b, i: _scan(b, st[i]))))

        return F.when(F.size(a) == 0, a).otherwise(let(blocks, from_starts))

    return let(numbers, run)


def explode_array(df, arr: Column, keep: list, pos: str | None = None, item: str = "_x"):
    """One row per array element, without re-evaluating ``arr``.

    ``explode``/``inline`` make Catalyst infer a ``size(arr) > 0`` filter and
    push it below the projection, which evaluates an expensive array
    expression twice.  The ``_outer`` form has no inferred filter; the one
    row it emits for an empty or NULL array is dropped right after.
    """
    if pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos, item))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(item))
    return out.filter(F.col(item).isNotNull())


def compute_once(df, keep: list, **exprs):
    """Add computed columns that later filters cannot be pushed beneath.

    A filter on a computed column is normally pushed below the projection
    with the expression substituted, so an expensive expression (a regex
    over the whole text) runs in the filter and again in the projection.
    Produced by a one-row generator, the columns are evaluated once and a
    filter on them stays above.
    """
    row = F.struct(*[v.alias(k) for k, v in exprs.items()])
    return (df.select(*keep, F.inline_outer(F.array(row)))
            .select(*keep, *exprs))


def py_strip(c) -> Column:
    """Python ``str.strip()``: trim every Unicode whitespace char at both ends."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def clean_text(c) -> Column:
    """One cleaning pass: whitespace runs -> one space, drop non-printable, trim.

    The newline rules of the original cleaner can never fire, because the
    whitespace collapse runs first and removes every newline.
    """
    x = F.regexp_replace(ascii_ws(col_of(c)), ASCII_WS_RUN, " ")
    x = F.regexp_replace(x, NON_PRINTABLE + "+", "")
    return F.trim(x)


def normalize_text(c) -> Column:
    """Two cleaning passes (the extractor's, then the preprocessor's).

    Two passes equal: drop every char that is neither printable ASCII nor
    whitespace, collapse whitespace runs to one space, trim.  (A run of
    whitespace and dropped chars with at least one whitespace char becomes
    one space either way; a run of dropped chars only disappears.)  That is
    two regex scans instead of four, both on ASCII classes.
    """
    x = F.regexp_replace(ascii_ws(col_of(c)), r"[^\t-\r\x1c-\x7E]+", "")
    x = F.regexp_replace(x, ASCII_WS_RUN, " ")
    return F.trim(x)


def reclean(c) -> Column:
    """Another cleaning pass over text that ``clean_text`` already produced.

    Such text is printable ASCII, where the only whitespace is the space and
    nothing is left to delete, so the pass reduces to collapsing space runs
    and trimming: one cheap regex instead of three scans.  Equal to
    ``clean_text`` on that input (tested).
    """
    return F.trim(F.regexp_replace(col_of(c), "  +", " "))


def layout_clean(c) -> Column:
    """Page-number lines and short running-header lines out of raw text.

    Applies the two layout rules of the preprocessor to text that still has
    its newlines (in the original they run after the whitespace collapse and
    never match).
    """
    x = F.regexp_replace(col_of(c), r"\n" + WS_CLASS + "*" + DIGIT + "+" + WS_CLASS + r"*\n", "\n")
    return F.regexp_replace(x, r"\n[^\n]{1,50}arXiv[^\n]{1,50}\n", "\n")


def token_estimate(c) -> Column:
    """Estimated tokens: characters div 4."""
    return F.floor(F.length(col_of(c)) / F.lit(fixed.CHARS_PER_TOKEN)).cast("bigint")


def base_name(c) -> Column:
    """``os.path.basename``: everything after the last ``/``."""
    return F.substring_index(col_of(c), "/", -1)


_STEM_RE = r"(?s)^(\.*[^.].*)\.[^.]*$"


def paper_stem(c) -> Column:
    """``os.path.splitext(os.path.basename(p))[0]``.

    The extension starts at the last dot, but only if a non-dot char comes
    before it in the name (``.bashrc`` and ``...`` keep their dots).
    """
    name = base_name(c)
    return F.when(name.rlike(_STEM_RE), F.regexp_extract(name, _STEM_RE, 1)).otherwise(name)


_TITLE_RE = r"(?s)^(.*?)" + WS_CLASS + r"*(?:Abstract|\.)"
_ARXIV_RE = r"arXiv:(" + DIGIT + r"+\." + DIGIT + r"+v" + DIGIT + r"+)"


def paper_metadata(c) -> Column:
    """struct<title, authors, arxiv_id>, '' when not found.

    Title: text before the first ``Abstract`` or ``.`` within the first three
    lines (lines joined by a space), trimmed.  Authors are never filled.
    """
    def body(text):
        first_lines = F.translate(F.substring_index(text, "\n", 3), "\n", " ")
        title = py_strip(F.regexp_extract(first_lines, _TITLE_RE, 1))
        arxiv = F.regexp_extract(text, _ARXIV_RE, 1)
        return F.struct(title.alias("title"), F.lit("").alias("authors"), arxiv.alias("arxiv_id"))

    return let(col_of(c), body)

