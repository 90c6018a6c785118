"""Model answers as column expressions.

An analysis is a ``map<string, variant>``: keys keep the order of the JSON
object (``from_json`` keeps it; VARIANT objects would sort them) and values
keep their JSON types.  ``to_json`` of the map is the saved record.

Parser strictness: the original parser rejects trailing text after the
value, accepts duplicate keys (last wins) and NaN.  Spark's
``try_parse_json`` accepts trailing text, so validity is checked on two
wrappings (see ``json_kind``); it rejects duplicate keys and NaN, so an
object or array that it rejects is looked at token by token (``relaxed``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col_of, exclusive_sums, let, py_strip

JSON_WS = " \t\n\r"
ANALYSIS_TYPE = "map<string,variant>"


def fenced_json(content) -> Column:
    """JSON text out of an answer: inside the first ```json fence, else the
    first plain fence, else the answer as is; fenced text is stripped."""
    c = col_of(content)
    # Python's split() finds each delimiter after the end of the previous
    # one, so the n-th piece is cut from the remainder after a delimiter
    # (substring_index with a count > 1 would also see overlapping hits).
    after_json = F.substr(c, F.instr(c, "```json") + F.lit(7))
    json_piece = F.substring_index(F.substring_index(after_json, "```json", 1), "```", 1)
    after_fence = F.substr(c, F.instr(c, "```") + F.lit(3))
    fence_piece = F.substring_index(after_fence, "```", 1)
    return (F.when(F.instr(c, "```json") > 0, py_strip(json_piece))
            .when(F.instr(c, "```") > 0, py_strip(fence_piece))
            .otherwise(c))


def json_kind(js) -> Column:
    """Type of the single JSON value in ``js``: object, array, string, bool,
    null, int, float; NULL when ``js`` is not exactly one JSON value."""
    j = col_of(js)

    def items(suffix):
        return F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), j, F.lit(suffix))), "$",
                                        "array<variant>"))

    # Exactly one JSON value: "[js]" has one element and "[js,0]" two.  Any
    # text after the value closes one of the two arrays early (the parser
    # ignores what follows a complete value), so both hold only for a
    # single value.
    single = (items("]") == 1) & (items(",0]") == 2)
    head = F.substring(F.ltrim(j, F.lit(JSON_WS)), 1, 1)
    number_kind = F.when(F.btrim(j, F.lit(JSON_WS)).rlike(r"[.eE]"), "float").otherwise("int")
    return F.when(single, F.when(head == "{", "object").when(head == "[", "array")
                  .when(head == '"', "string").when(head.isin("t", "f"), "bool")
                  .when(head == "n", "null").otherwise(number_kind))


# Strings, words and numbers, and every other character but JSON's blanks.
_ANY_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^ \t\n\r"\[\]{},:]++|[^ \t\n\r]'
_CONSTANTS = ("NaN", "Infinity", "-Infinity")
_KEY, _COMMA, _CLOSE = 0, 1, 2


def _container_kind(j: Column) -> Column:
    head = F.substring(F.ltrim(j, F.lit(JSON_WS)), 1, 1)
    return F.when(head == "{", "object").when(head == "[", "array")


def relaxed(js) -> Column:
    """struct<text, names> of an object or array that may repeat keys and hold
    NaN, Infinity or -Infinity; NULL when it is no JSON otherwise.

    ``text`` is strict JSON: of the members of one object with equal names, at
    any depth, the last stays, and the constants are strings of their name.
    ``names`` are the names of the outermost object in the order of their first
    members.  All steps are sorts and running sums over the tokens, none
    compares them pairwise."""

    def body(t):
        def is_key(x, i):
            return F.startswith(x, F.lit('"')) & F.coalesce(F.get(t, i + 1) == ":", F.lit(False))

        # With a number added to each name no name repeats, and the strict parser judges the rest.
        numbered = F.array_join(F.transform(t, lambda x, i: F.when(is_key(x, i), F.concat(
            F.substr(x, F.lit(1), F.length(x) - 1), F.lit("#"), i.cast("string"), F.lit('"'))).otherwise(x)), " ")
        depth = exclusive_sums(F.transform(t, lambda x: F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1)
                                           .otherwise(0)))
        return F.when(let(numbered, lambda n: json_kind(n).isNotNull()), let(depth, lambda d: let(_marks(t, d, is_key),
                                                                                lambda m: _last_members(t, m))))

    def constants_as_strings(raw):  # as values only: a bare name is no JSON
        return F.transform(raw, lambda x, i: F.when(
            x.isin(*_CONSTANTS) & ~F.coalesce(F.get(raw, i + 1) == ":", F.lit(False)),
            F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))

    tokens = let(F.regexp_extract_all(col_of(js), F.lit(_ANY_TOKEN), F.lit(0)), constants_as_strings)
    return let(tokens, body)


def _marks(t: Column, depth: Column, is_key) -> Column:
    """Names, commas and closing brackets, those of one object after another:
    within a depth, an object ends before the next one begins."""
    def mark(x, i):
        key = is_key(x, i)
        kind = F.when(key, _KEY).when(x == ",", _COMMA).when(x.isin("}", "]"), _CLOSE)
        name = F.when(key, F.try_variant_get(F.try_parse_json(x), "$", "string"))
        return F.struct(depth[i].alias("depth"), i.alias("pos"), kind.alias("kind"), name.alias("name"))

    return F.array_sort(F.filter(F.transform(t, mark), lambda m: m["kind"].isNotNull()))


def _last_members(t: Column, m: Column) -> Column:
    def members(closed):
        # A name's next mark is the comma or bracket that ends its member.
        return F.array_sort(F.transform(F.filter(F.transform(m, lambda x, i: F.struct(
            closed[i].alias("object"), x["name"].alias("name"), x["pos"].alias("pos"),
            F.get(m, i + 1)["pos"].alias("end"), x["kind"].alias("kind"))), lambda x: x["kind"] == _KEY),
            lambda x: x.dropFields("kind")))

    def earlier(s):
        def again(x, i):
            following = F.get(s, i + 1)
            return (following["object"] == x["object"]) & (following["name"] == x["name"])

        return F.filter(F.transform(s, lambda x, i: F.struct(
            x["pos"].alias("pos"), x["end"].alias("end"), again(x, i).alias("again"))), lambda x: x["again"])

    def event(pos, place, change, token):
        return F.struct(pos.alias("pos"), F.lit(place).alias("place"), F.lit(change).alias("change"),
                        token.alias("token"))

    def kept(gone):
        none = F.lit(None).cast("string")
        events = F.array_sort(F.concat(F.transform(t, lambda x, i: event(i, 1, 0, x)),
                                       F.transform(gone, lambda g: event(g["pos"], 0, 1, none)),
                                       F.transform(gone, lambda g: event(g["end"], 2, -1, none))))
        return let(events, lambda e: let(
            exclusive_sums(F.transform(e, lambda x: x["change"])),
            lambda inside: F.array_join(F.transform(F.filter(
                e, lambda x, i: (x["place"] == 1) & (inside[i] == 0)), lambda x: x["token"]), " ")))

    closed = exclusive_sums(F.transform(m, lambda x: F.when(x["kind"] == _CLOSE, 1).otherwise(0)))
    text = let(let(let(closed, members), earlier), kept)
    names = F.array_distinct(F.transform(F.filter(m, lambda x: (x["kind"] == _KEY) & (x["depth"] == 1)),
                                         lambda x: x["name"]))
    return F.struct(text.alias("text"), names.alias("names"))


def as_variant(c) -> Column:
    return col_of(c).cast("variant")


def null_variant() -> Column:
    return F.parse_json(F.lit("null"))


def is_falsy(v) -> Column:
    """Python truthiness of a JSON value held in a variant; SQL NULL
    (missing key) counts as falsy too."""
    v = col_of(v)
    j = F.to_json(v)
    head = F.substring(j, 1, 1)
    return (v.isNull() | j.isin("null", '""', "false", "[]", "{}")
            | (~head.isin('"', "[", "{") & (F.try_variant_get(v, "$", "double") == 0)))


# A compact JSON text's tokens: strings, numbers and words, single signs.
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[-+.0-9A-Za-z]+|[\[\]{},:]'


def _py_string(token: Column) -> Column:
    """Python's repr of a JSON string token: single quotes unless only a
    single quote stands inside."""
    inner = F.replace(F.substr(token, F.lit(2), F.length(token) - 2), F.lit('\\"'), F.lit('"'))
    inner = F.replace(inner, F.lit("\\/"), F.lit("/"))
    single, double = F.contains(inner, F.lit("'")), F.contains(inner, F.lit('"'))
    quoted = F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(quoted)


def py_repr(json_text) -> Column:
    """Compact JSON text of a container as Python prints it: ``['a', 1, None]``.
    Backslash escapes of newline, tab and backslash are the same in both;
    other control characters and exponents keep JSON's spelling."""
    tokens = F.regexp_extract_all(col_of(json_text), F.lit(_JSON_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit('"')), _py_string(t))
                                    .when(t == "null", "None").when(t == "true", "True").when(t == "false", "False")
                                    .when(t == ",", ", ").when(t == ":", ": ").otherwise(t)), "")


def py_str(v) -> Column:
    """``str(value)`` for a JSON value: strings as they are, null as None,
    booleans as True/False, arrays and objects as Python prints them."""
    v = col_of(v)
    j = F.to_json(v)
    head = F.substring(j, 1, 1)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(head == '"', F.try_variant_get(v, "$", "string"))
            .when(head.isin("[", "{"), py_repr(j))
            .when(j == "null", F.lit("None"))
            .when(j == "true", F.lit("True"))
            .when(j == "false", F.lit("False"))
            .otherwise(j))


def json_text(v) -> Column:
    """Typed-column rendering: strings raw, JSON null as NULL, others JSON."""
    v = col_of(v)
    j = F.to_json(v)
    return (F.when(v.isNull() | (j == "null"), F.lit(None).cast("string"))
            .when(F.substring(j, 1, 1) == '"', F.try_variant_get(v, "$", "string"))
            .otherwise(j))


def json_bool(v) -> Column:
    j = F.to_json(col_of(v))
    return F.when(j == "true", F.lit(True)).when(j == "false", F.lit(False))


def _record(*pairs) -> Column:
    args = []
    for k, v in pairs:
        args += [F.lit(k), v]
    return F.create_map(*args)


def fallback_record(name, content) -> Column:
    return _record((fixed.KEY_NAME, as_variant(name)),
                   (fixed.KEY_SUMMARY, as_variant(py_strip(content))),
                   (fixed.KEY_RESULTS, as_variant(F.lit(fixed.FALLBACK_NOT_AVAILABLE))),
                   (fixed.KEY_SUCCESS, null_variant()),
                   (fixed.KEY_PERFORMANCE, as_variant(F.lit(fixed.FALLBACK_NOT_AVAILABLE))))


def error_record(name, message) -> Column:
    return _record((fixed.KEY_NAME, as_variant(name)),
                   (fixed.KEY_ERROR, as_variant(F.concat(F.lit(fixed.ERROR_PREFIX), col_of(message)))),
                   (fixed.KEY_SUMMARY, as_variant(F.lit(fixed.ERROR_SUMMARY))),
                   (fixed.KEY_RESULTS, as_variant(F.lit(fixed.ERROR_RESULTS))),
                   (fixed.KEY_SUCCESS, null_variant()),
                   (fixed.KEY_PERFORMANCE, as_variant(F.lit(fixed.ERROR_PERFORMANCE))))


def _type_error(kind: Column, js: Column) -> Column:
    """The message the original gets when the answer is valid JSON but not
    an object (its name check fails with a type error)."""
    decoded = F.try_variant_get(F.try_parse_json(js), "$", "string")
    return (F.when(kind == "array", F.lit(fixed.ERROR_LIST))
            .when(kind == "string", F.when(F.instr(decoded, fixed.KEY_NAME) > 0,
                                           F.lit(fixed.ERROR_STR_INDEX))
                  .otherwise(F.lit(fixed.ERROR_STR_ASSIGN)))
            .otherwise(F.format_string(fixed.ERROR_NOT_ITERABLE.replace("{}", "%s"),
                                       F.when(kind == "null", "NoneType").otherwise(kind))))


def with_name(m, name) -> Column:
    """Fill ``nombre`` when missing or falsy; an existing key keeps its place,
    a missing one is appended."""
    name = col_of(name)

    def body(mm):
        filled = F.when(~F.map_contains_key(mm, F.lit(fixed.KEY_NAME)),
                        F.map_concat(mm, F.create_map(F.lit(fixed.KEY_NAME), as_variant(name)))).otherwise(
            F.transform_values(mm, lambda k, v: F.when(k == F.lit(fixed.KEY_NAME), as_variant(name))
                               .otherwise(v)))
        return F.when(is_falsy(F.element_at(mm, F.lit(fixed.KEY_NAME))), filled).otherwise(mm)

    return let(col_of(m), body)


def parse_answer(content, name) -> Column:
    """struct<branch, analysis>: 'parsed' (the object, name filled),
    'fallback' (not JSON) or 'error' (no content, or JSON that is not an
    object)."""
    c = col_of(content)

    def body(js):
        def with_kind(strict):
            again = F.when(strict.isNull() & _container_kind(js).isNotNull(), relaxed(js))
            return let(again, lambda r: outcome(strict, r))

        def outcome(strict, r):
            constant = F.when(F.btrim(js, F.lit(JSON_WS)).isin(*_CONSTANTS), "float")
            return let(F.coalesce(strict, F.when(r.isNotNull(), _container_kind(js)), constant),
                       lambda kind: record(kind, r))

        def record(kind, r):
            branch = (F.when(c.isNull(), F.lit("error")).when(kind.isNull(), F.lit("fallback"))
                      .when(kind == "object", F.lit("parsed")).otherwise(F.lit("error")))
            message = F.when(c.isNull(), F.lit(fixed.ERROR_NONE_CONTENT)).otherwise(_type_error(kind, js))
            found = F.when(r.isNull(), F.from_json(js, ANALYSIS_TYPE)).otherwise(let(
                F.from_json(r["text"], ANALYSIS_TYPE),
                lambda m: F.map_from_arrays(r["names"], F.transform(r["names"], lambda n: F.element_at(m, n)))))
            return let(branch, lambda b: F.struct(b.alias("branch"), (
                F.when(b == "parsed", with_name(found, name))
                .when(b == "fallback", fallback_record(name, c))
                .otherwise(error_record(name, message))).alias("analysis")))

        return let(json_kind(js), with_kind)

    return let(fenced_json(c), body)


def field(m, key: str) -> Column:
    return F.element_at(col_of(m), F.lit(key))
