"""Chat formatting over typed content parts, with DataFrame functions only.

A turn holds an ordered array of parts: ``kind`` (text, image, audio,
document), ``text``, ``ref`` (the attachment's address) and ``size`` (pixels,
seconds or pages).  A visitor flattens every turn: text is escaped; any other
part becomes a numbered placeholder, its reference and the tokens it will
expand to are recorded in order.

Template (one conversation is one string)::

    <turn assistant>\n ... escaped text and placeholders ... </turn>\n

``\\``, ``<``, ``>`` and ``#`` inside texts and roles become ``\\b``, ``\\l``,
``\\g`` and ``\\h``, so escaped text has no sign that a marker could begin with
and unescaping gives the text back.  Loss counts on the assistant's turns: the
formatted string also comes as ordered segments, each with its loss flag.

Defined results: NULL text is empty; a NULL part or kind is a text part; a
NULL or unknown kind with text keeps its text; a NULL role is an empty role;
a conversation id of NULL is one conversation.  Turns with equal numbers are
ordered by role, then content; NULL numbers come first; repeated rows stay
repeated.  A conversation is one output row, so its turns meet in one task;
a value cannot exceed 2 GB in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TYPE = "array<struct<kind:string,text:string,ref:string,size:bigint>>"
#: Tokens per attachment: one per so many pixels, seconds, pages, and the least number.
EXPANSION = {"image": (784, 1, 4), "audio": (1, 25, 1), "document": (1, 1024, 1024)}
END = "</turn>\n"


#: Sign -> letter after the backslash; the backslash comes first when
#: escaping and last when reading back.
ESCAPES = {"\\": "b", "<": "l", ">": "g", "#": "h"}


def escape(text):
    for sign, letter in ESCAPES.items():
        text = F.replace(text, F.lit(sign), F.lit("\\" + letter))
    return text


def unescape(text):
    for sign, letter in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit("\\" + letter), F.lit(sign))
    return text


def part_tokens(kind, size):
    """Tokens an attachment expands to: ceil(size / unit) * per_unit, at least the minimum."""
    out = F.lit(0).cast("long")
    for name, (unit, per_unit, least) in EXPANSION.items():
        out = F.when(kind == name, F.greatest(
            (F.ceil(F.coalesce(size, F.lit(0)) / unit) * per_unit).cast("long"),
            F.lit(least).cast("long"))).otherwise(out)
    return out


def text_parts(text):
    """A plain text as the one part of its turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """conv_id, segments (text, loss), formatted, attachments (ref, kind,
    tokens, placeholder number from 0), n_turns, attachment_tokens."""
    attached = F.array(*[F.lit(k) for k in EXPANSION])

    def is_attachment(p):
        return F.coalesce(F.array_contains(attached, p["kind"]), F.lit(False))

    all_parts = F.coalesce(F.col(parts).cast(PART_TYPE), F.array().cast(PART_TYPE))
    src = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), all_parts.alias("parts"))
    pieces = F.transform("parts", lambda p: F.when(
        is_attachment(p), F.struct(p["kind"].alias("kind"), F.lit("").alias("text"), p["ref"].alias("ref"),
                                   part_tokens(p["kind"], p["size"]).alias("tokens")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"),
                            escape(F.coalesce(p["text"], F.lit(""))).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))))
    one = src.select("conv_id", F.struct("turn", "role", pieces.alias("pieces")).alias("t"))
    conv_rows = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    found = F.filter(F.flatten(F.transform("turns", lambda t: t["pieces"])), lambda p: p["kind"].isNotNull())
    conv_rows = conv_rows.withColumn("attachments", F.transform(found, lambda p, i: F.struct(
        p["ref"].alias("ref"), p["kind"].alias("kind"), p["tokens"].alias("tokens"), i.alias("number"))))
    # Where each turn's placeholders start: attachments of the turns before it.
    counts = F.transform("turns", lambda t: F.size(F.filter(t["pieces"], lambda p: p["kind"].isNotNull())))
    starts = F.when(F.size("attachments") == 0, F.lit(None).cast("array<int>")).otherwise(
        F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)))
    conv_rows = conv_rows.withColumn("starts", starts)

    def body(t, i):
        def place(p, k):
            before = F.size(F.filter(F.slice(t["pieces"], F.lit(1), k), lambda q: q["kind"].isNotNull()))
            number = F.coalesce(F.get(F.col("starts"), i), F.lit(0)) + before
            return F.when(p["kind"].isNotNull(), F.concat(
                F.lit("<"), p["kind"], F.lit(" "), number.cast("string"), F.lit(">"))).otherwise(p["text"])
        return F.array_join(F.transform(t["pieces"], place), "")

    segments = F.flatten(F.transform("turns", lambda t, i: F.array(
        F.struct(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(body(t, i).alias("text"), (t["role"] == loss_role).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))))
    return conv_rows.select(
        "conv_id", segments.alias("segments"), "attachments",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens")
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted):
    """(role, text) of every turn, parsed from the formatted string: turns end
    at the end marker, the header at its first ``>``.  Placeholders are left
    as they stand."""
    def one(t):
        header = F.substring_index(t, ">\n", 1)
        return F.struct(unescape(F.substr(header, F.lit(len("<turn ") + 1))).alias("role"),
                        unescape(F.substr(t, F.length(header) + len(">\n") + 1)).alias("text"))

    return F.transform(F.filter(F.split(formatted, END), lambda t: t != ""), one)
