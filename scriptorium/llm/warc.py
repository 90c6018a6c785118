"""WARC archives: records written as text files, read back by their chain.

Writing.  Equal payloads are found by digest.  The row with the least id is a
``response`` record; the others are ``revisit`` records that name it and keep
the HTTP head (and so the length) but no payload.  A bitmap of the digests that
occur more than once lets all other rows pass without a join; the most frequent
digests are broadcast, at most ``HOT_DIGESTS`` of them; only the rest is joined
by digest.  Every task writes one archive file with Spark's text writer.

Reading.  Spark's text reader splits the files at the magic ``WARC/1.1``, so
that an archive of any size is read in byte ranges.  As a payload may hold the
magic, each piece is only a *candidate*: a task emits its offset and that of
the successor it claims by its Content-Length, contracted to where the chain of
claims leaves the task's byte range.  Pointer jumping over those exits, from
the file's start, keeps the candidates that are reached; it takes as many rounds
as the logarithm of the number of ranges of a file.  A second pass over the
files then cuts records at the reached offsets; pieces between them are payload.
Payloads are never shuffled, but for records that continue in another range
after a magic inside them.

What the driver gathers is the place and the first record of each byte range,
32 bytes a range, at most ``MAX_RANGES`` (128 TB of archive at Spark's 128 MB a
range); beyond, an error asks for fewer files a call.

Defined results: a NULL payload is an empty one.  Empty payloads equal each
other.  Rows that repeat the least id with an equal payload are each a
response.  Rows without id are revisits of the least id of an equal payload
and responses if there is none.  White space and control characters in a URL
are escaped; a NULL URL has no header.  An empty table gives an empty archive
and no rows.  The input's other columns do not matter: id, URL and payload
alone are read.  A file whose chain does not end with the file (cut off, or
bytes between records) raises an error.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.prefilter import key_bitmap, with_may_match
from .common import runs, ship, written

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
HOT_DIGESTS = 4096  # most frequent payloads that are broadcast, at most
MAX_RANGES = 1_000_000  # byte ranges of one reading call
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

LENGTH = r"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)"
FIELDS = ["file", "offset", "head", "http", "payload"]
PARTS = "file string, offset long, head string, http string, payload binary, part binary"


def base32_sha1(data) -> F.Column:
    """SHA-1 in base 32: 15 hexadecimal digits are 12 digits of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, at, n), 16, 32), n * 4 // 5, "0")
             for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), *_B32)


# --- writing ---------------------------------------------------------------

def with_revisits(pages: DataFrame, at_least: int = 0, hot: int = HOT_DIGESTS) -> DataFrame:
    """``page``, ``url``, ``payload`` rows plus ``digest`` and ``refers_to`` (the
    id whose equal payload of ``at_least`` bytes or more is stored, or NULL)."""
    keyed = pages.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    seen = written(keyed.where(F.octet_length("payload") >= at_least).groupBy("digest").agg(
        F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "repeated")
    total = pages.count()
    is_hot = F.col("n") * hot >= total  # at most ``hot`` digests: their rows add up to the total
    repeated = F.coalesce(F.octet_length("payload") >= at_least, F.lit(False)) & F.col("_may_match")
    told = with_may_match(keyed, key_bitmap(seen, "digest"), "digest")
    once = told.where(~repeated).drop("_may_match").withColumn("first", F.lit(None).cast("long"))
    several = told.where(repeated).drop("_may_match")
    frequent = F.broadcast(seen.where(is_hot).select("digest", "first"))
    rare = seen.where(~is_hot).select("digest", "first")
    all_rows = (once.unionByName(several.join(frequent, "digest"))
                .unionByName(several.join(F.broadcast(seen.where(is_hot).select("digest")), "digest", "left_anti")
                             .join(rare, "digest", "left")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return all_rows.withColumn("refers_to", refers).drop("first")


def _identity(page, digest) -> F.Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _header(name: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def record(date: str) -> F.Column:
    """The whole record of a row of ``with_revisits``, but for the blank lines behind it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(BLANK))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit(MAGIC), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _identity(F.col("page"), F.col("digest"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(_PROFILE)),
                                 _header("WARC-Refers-To", _identity(F.col("refers_to"), F.col("digest")))))
        .otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), size.cast("string"), F.lit(BLANK))
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
                  at_least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row, in the files of the folder ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    with_revisits(rows, at_least).select(record(date).alias("value")).write.option("lineSep", BLANK).text(path)


# --- reading ---------------------------------------------------------------

def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    "value"))


def _in_order(batches):
    """(file, block) and rows, batch by batch, of the byte ranges of a task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lo = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (files[i], blocks[i]) != (files[lo], blocks[lo]):
                yield (files[lo], blocks[lo]), batch.slice(lo, i - lo)
                lo = i


def _contracted(start: np.ndarray, claimed: np.ndarray) -> np.ndarray:
    """Where the chain of claims from each candidate leaves the range (-1: a
    candidate without a length).  ``start`` rises; places are relative."""
    after = np.where(claimed >= 0, start + claimed, -1)
    at = np.minimum(np.searchsorted(start, after), len(start) - 1)
    inside = (start[at] == after) & (after >= 0)
    step = np.where(inside, at, np.arange(len(start)))
    while True:
        further = step[step]
        if (further == step).all():
            return after[step]
        step = further


def _candidates(batches):
    """file, block, start, exit of every candidate, relative to the range, and
    the range's length."""
    import pyarrow as pa
    key, sizes, claims = None, [], []

    def close():
        size, claimed = np.concatenate(sizes), np.concatenate(claims)
        end = np.cumsum(size + len(MAGIC))
        start = end - size - 2 * len(MAGIC)  # of the magic before each piece
        n = len(start)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(start),
             pa.array(_contracted(start, claimed)), pa.array(np.full(n, end[-1]))],
            names=["file", "block", "start", "exit", "span"])

    for here, part in _in_order(batches):
        if here != key and sizes:
            yield close()
            sizes, claims = [], []
        key = here
        sizes.append(part.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
        claims.append(part.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
    if sizes:
        yield close()


def _reached(nodes: DataFrame) -> DataFrame:
    """file, start of the nodes that pointer jumping reaches from offset 0.

    After i rounds ``found`` holds the first 2**i nodes of each file's chain
    and ``jump`` leads 2**i nodes on."""
    found = written(nodes.where("start = 0").select("file", "start"), "reached")
    jump = nodes.select("file", "start", F.col("exit").alias("to"))
    known = found.count()
    while True:
        ahead = (found.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
                 .join(nodes.select("file", "start"), ["file", "start"], "left_semi"))
        found = written(found.unionByName(ahead).distinct(), "reached")
        now = found.count()
        if now == known:
            return found
        known = now
        onward = jump.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(onward, ["file", "to"]).select("file", "start", F.col("far").alias("to")), "jump")


def chain(spark: SparkSession, path: str) -> DataFrame:
    """file, block, base, first, size, complete: per byte range, where its pieces
    begin in the file, the offset of the first record of the file's chain that
    starts in it (NULL if none does), and whether the file's chain ends with
    the file."""
    ship(spark)
    head = F.substring_index("value", BLANK, 1)
    has_head = F.octet_length(head) < F.octet_length("value")
    length = F.when(has_head, F.regexp_extract(head, LENGTH, 1))
    claimed = F.when(F.coalesce(length, F.lit("")) != "",
                     len(MAGIC) + F.octet_length(head) + len(BLANK) + length.cast("long") + len(BLANK))
    narrow = _pieces(spark, path).select("file", "block", F.octet_length("value").cast("long").alias("size"),
                                         F.coalesce(claimed.cast("long"), F.lit(-1)).alias("claimed"))
    found = written(narrow.mapInArrow(_candidates, "file string, block long, start long, exit long, span long"),
                    "candidates")
    ranges = found.groupBy("file", "block").agg(F.first("span").alias("span"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    ranges = written(ranges.select(
        "file", "block", F.coalesce(F.sum("span").over(before), F.lit(0)).alias("base"),
        (F.sum("span").over(whole) - len(MAGIC)).alias("size")), "ranges")
    placed = found.join(ranges, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("start")).alias("start"),
        F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")).alias("exit"))
    exits = placed.where("exit is not null").select("file", F.col("exit").alias("start")).distinct()
    nodes = written(placed.where("start = 0").unionByName(
        placed.where("start > 0").join(exits, ["file", "start"], "left_semi")), "nodes")
    reached = nodes.join(_reached(nodes), ["file", "start"], "left_semi")
    first = reached.groupBy("file", "block").agg(F.min("start").alias("first"))  # a chain enters a range once
    ended = (reached.join(ranges.select("file", "size").distinct(), "file").where("exit = size")
             .select("file").distinct().withColumn("complete", F.lit(True)))
    return (ranges.join(first, ["file", "block"], "left").join(ended, "file", "left")
            .withColumn("complete", F.coalesce("complete", F.lit(False))))


def _length(head: bytes) -> int:
    return int(re.search(LENGTH.encode(), head)[1])


def _record(file: str, offset: int, data: bytes) -> tuple:
    """Headers, HTTP head and payload from a record's bytes behind the magic."""
    head, _, rest = data.partition(b"\r\n\r\n")
    block = rest[:_length(head)]
    http, payload = b"", block
    if re.search(rb"(?i)(?:^|\r\n)content-type:[ \t]*application/http", head):
        http, _, payload = block.partition(b"\r\n\r\n")
    return file, offset, head.decode("utf-8", "replace"), http.decode("utf-8", "replace"), payload, None


def _cut_records(batches, places: dict):
    """Records of the byte ranges of a task.  A record that goes on in another
    range comes as parts: the one with its start, and those without a record."""
    import pyarrow as pa
    magic = MAGIC.encode()
    names = [f.split()[0] for f in PARTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    key = owner = None
    at = wanted = begun = 0
    parts: list[bytes] = []
    out: list[tuple] = []
    held = 0

    def close():
        data = magic.join(parts)
        if owner is not None and owner + len(magic) + len(data) == wanted:
            return _record(key[0], owner, data)
        return key[0], begun, "" if owner is None else None, None, None, data

    for here, part in _in_order(batches):
        if here != key:
            if parts:
                out.append(close())
            if here not in places:
                raise RuntimeError(f"the byte ranges of {here[0]} changed between two reads; read it again")
            base, wanted = places[here]
            key, at, owner, parts = here, base - len(magic), None, []
        for value in part.column(2):
            piece = value.as_buffer().to_pybytes()
            if at == wanted:
                if parts:
                    out.append(close())
                head, _, _ = piece.partition(b"\r\n\r\n")
                owner = begun = at
                wanted = at + len(magic) + len(head) + len(BLANK) + _length(head) + len(BLANK)
                parts = [piece]
            elif at >= 0:  # what stands before a file's first magic is empty
                if not parts:
                    begun = at
                parts.append(piece)
            at += len(magic) + len(piece)
            held += len(piece)
        if out and held > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out, held = [], 0
    if parts:
        out.append(close())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _joined(batches):
    import pandas as pd
    for _, rows in runs(batches, ["file", "owner"]):
        rows = rows.sort_values("offset")
        whole = _record(rows["file"].iat[0], int(rows["owner"].iat[0]), MAGIC.encode().join(rows["part"]))
        yield pd.DataFrame([whole[:5]], columns=["file", "offset", "head", "http", "payload"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, head (the WARC headers), http (the HTTP head, if the block
    has one) and payload (bytes) of every record."""
    ranges = written(chain(spark, path), "chain")
    if ranges.where("not complete").limit(1).count():
        raise ValueError("an archive's chain of records does not end with its file")
    if ranges.count() > MAX_RANGES:
        raise ValueError(f"more than {MAX_RANGES} byte ranges: read fewer archives a call")
    places = spark.sparkContext.broadcast({
        (r["file"], r["block"]): (r["base"], -1 if r["first"] is None else r["first"])
        for r in ranges.select("file", "block", "base", "first").toLocalIterator()})
    cut = (_pieces(spark, path).select("file", "block", F.col("value").cast("binary").alias("value"))
           .mapInArrow(lambda batches: _cut_records(batches, places.value), PARTS))
    if not ranges.groupBy("file").count().where("count > 1").limit(1).count():
        return cut.select(*FIELDS)  # every file is one range: no record goes on elsewhere
    parts = cut.where("part is not null").select(
        "file", "offset", "part", F.when(F.col("head").isNull(), F.col("offset")).alias("_own"))
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = parts.withColumn("owner", F.last("_own", ignorenulls=True).over(upto)).drop("_own")
    whole = owned.repartition("file", "owner").sortWithinPartitions("file", "owner").mapInPandas(
        _joined, "file string, offset long, head string, http string, payload binary")
    return cut.where("part is null").select(*FIELDS).unionByName(whole)


def field(name: str, head: str = "head") -> F.Column:
    """Value of a header, NULL if there is none."""
    value = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def page_of(name: str) -> F.Column:
    """The page id in a header that names a record of ``write_archive``."""
    number = F.regexp_extract(F.coalesce(field(name), F.lit("")), r"^<urn:x-page:(-?[0-9]+):", 1)
    return F.when(number != "", number.cast("long"))
