"""Packing documents into fixed-length sequences by swap-based local search.

A document is its token ids plus an end id; one longer than a sequence is cut
into full pieces and a rest.  Full pieces are sequences of their own.  All
other pieces are dealt evenly into groups of bounded size (by row number, so
neither a source nor copies can fill a group), and each group is packed in one
task:

* best-fit decreasing gives the first packing;
* then pieces are exchanged between underfull bins - moved, swapped one for
  one, or two for one - from an emptier to a fuller bin, which raises the sum
  of squared fills, in passes over all of them, until a whole pass finds no
  exchange or the group has as few bins as its token total allows.

Bins that a group leaves underfull are opened again and their pieces dealt
into other, mixed groups, level after level, until a level saves no more than
one of 500 of the bins it opened; the better of its packing and the one before stays.

Defined results: a NULL or empty text is one piece holding the end id.
Repeated rows and repeated or NULL ids are packed row by row.  An empty table
gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_ids
from .common import begin, blocks_of, ship, slices, written

CAPACITY = 4096
END_ID = 1
GROUP = 20_000  # pieces packed in one task
OPEN_BELOW = 0.97  # bins filled less are opened again on the next level
LEAST_SAVING = 0.002  # part of the opened bins that a level must save for another one to follow


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    ship(docs.sparkSession)

    def run(batches):
        begin("chunks")
        tail = np.array([end_id], "<u4").tobytes()
        for pdf in slices(batches):
            rows = []
            encoded = chunk_ids.encode(pdf["text"].tolist(), tokenizer, "words")
            for i, ids in zip(pdf["doc_id"], encoded):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    rows.append((i, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out

    # Ids pass pandas as text: a column of numbers with a NULL would become floating there.
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return (src.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of positions in ``lengths``) of at most ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free room, bin), sorted
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            bisect.insort(free, (room - n, b))
    least = -(-int(lengths.sum()) // capacity)
    if len(bins) > least:
        _exchange(bins, lengths, capacity, least)
    return [b for b in bins if b]


def _exchange(bins: list[list[int]], lengths: np.ndarray, capacity: int, least: int) -> None:
    """Local search in place: raise the sum of squared fills until bins empty.

    In a pass over all underfull bins, from the emptiest up, each gives to
    bins at least as full, of which all are looked at.  Every exchange moves a
    positive amount to such a bin, so the sum of squared fills rises and the
    search ends: with a pass that makes no exchange, or at ``least`` bins."""
    fill = [int(sum(lengths[i] for i in b)) for b in bins]
    left = sum(1 for b in bins if b)
    takers, changed = _Takers(bins, lengths, fill, capacity), True
    while changed and left > least:
        changed = False
        order = [(fill[b], b) for b in range(len(bins)) if bins[b] and fill[b] < capacity]
        for _, b in order:
            takers.add(b)
        heapq.heapify(order)
        level, equals = 0, set()  # bins that have given and still take from equally full ones
        while order and left > least:
            f, giver = heapq.heappop(order)
            if f != fill[giver]:
                continue  # it has taken since, and stands further back
            if f > level:
                for b in equals:
                    takers.remove(b)
                level, equals = f, set()
            takers.remove(giver)
            while bins[giver] and (found := takers.best(bins[giver])):
                out, taker, back = found
                takers.remove(taker)
                n = sum(int(lengths[i]) for i in out) - sum(int(lengths[i]) for i in back)
                bins[giver] = [i for i in bins[giver] if i not in out] + list(back)
                bins[taker] = [i for i in bins[taker] if i not in back] + list(out)
                fill[giver] -= n
                fill[taker] += n
                if fill[taker] < capacity:
                    takers.add(taker)
                    heapq.heappush(order, (fill[taker], taker))
                equals.discard(taker)
                changed = True
            left -= not bins[giver]
            if fill[giver] == f and order and order[0][0] == f:
                takers.add(giver)
                equals.add(giver)
        for b in equals:
            takers.remove(b)


class _Takers:
    """Underfull bins by what they can give back: for no, one and two of a
    bin's pieces, the bins that have pieces of that sum, by free room."""

    def __init__(self, bins, lengths: np.ndarray, fill: list[int], capacity: int):
        self.bins, self.lengths, self.fill, self.capacity = bins, lengths, fill, capacity
        self.rooms = [[[] for _ in range(capacity)] for _ in range(2)]  # 0 or 1 piece back, 2 pieces back
        self.reach = [np.full(capacity, -1, np.int64) for _ in range(2)]  # most that fits for this much back
        self.most = [None, None]  # running maximum of reach

    def _sums(self, b: int):
        n = np.sort(self.lengths[self.bins[b]])
        twos = n[:, None] + n
        return [0, *np.unique(n).tolist()], np.unique(twos[np.triu_indices(len(n), 1)]).tolist()

    def add(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        for k, sums in enumerate(self._sums(b)):
            for s in sums:
                bisect.insort(self.rooms[k][s], (room, b))
                if s + room > self.reach[k][s]:
                    self.reach[k][s], self.most[k] = s + room, None

    def remove(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        for k, sums in enumerate(self._sums(b)):
            for s in sums:
                at = self.rooms[k][s]
                del at[bisect.bisect_left(at, (room, b))]
                now = s + at[-1][0] if at else -1
                if now < self.reach[k][s]:
                    self.reach[k][s], self.most[k] = now, None

    def best(self, giver: list[int]):
        """(out, taker, back) of the exchange that moves most tokens; of the
        bins that can make it, the fullest takes."""
        own = self.lengths[giver]
        x, y = np.triu_indices(len(own), 1)
        ones, twos = own, own[x] + own[y]
        found = (0, None, None, 0)
        for k, sums, pair in ((0, ones, False), (0, twos, True), (1, ones, False)):
            if not len(sums):
                continue
            if self.most[k] is None:
                self.most[k] = np.maximum.accumulate(self.reach[k])
            back = np.searchsorted(self.most[k], sums)  # the least that makes room
            gain = np.where(back < self.capacity, sums - back, 0)
            at = int(gain.argmax())
            if gain[at] > found[0]:
                found = (int(gain[at]), k, (x[at], y[at]) if pair else (at,), int(back[at]))
        gain, k, places, back = found
        if not gain:
            return None
        at = self.rooms[k][back]
        taker = at[bisect.bisect_left(at, (gain, -1))][1]
        return [giver[p] for p in places], taker, self._pick(self.bins[taker], back, k)

    def _pick(self, pieces: list[int], total: int, k: int) -> tuple[int, ...]:
        if not total:
            return ()
        where: dict[int, int] = {}
        for i in pieces:
            n = int(self.lengths[i])
            if k == 0 and n == total:
                return (i,)
            if k == 1 and total - n in where:
                return (where[total - n], i)
            where[n] = i
        raise AssertionError("no such pieces")


def best_fit(items: DataFrame, length: str = "length", capacity: int = CAPACITY,
             group: int = GROUP) -> DataFrame:
    """``items`` (one row per piece, ``length`` from 1 to ``capacity``) plus
    sequence_id and offset: pieces of a sequence lie side by side from 0."""
    spark = items.sparkSession
    ship(spark)
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    numbered = written(items.select(*[F.col(f"`{c}`") for c in kept],
                                    F.monotonically_increasing_id().alias("_row")), "pieces")
    small = numbered.where(F.col(length) < capacity).select("_row", F.col(length).cast("long").alias("_length"))

    def run(level: int):
        def one(pdf):
            begin("packing")
            lengths = pdf["_length"].to_numpy()
            base = (level << 56) + (int(pdf["_group"].iloc[0]) << 20)
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            full = np.ones(len(pdf), bool)
            for k, b in enumerate(pack(lengths, capacity)):
                n = lengths[b]
                seq[b], off[b] = base + k, np.cumsum(n) - n
                full[b] = n.sum() >= OPEN_BELOW * capacity
            return pd.DataFrame({"_row": pdf["_row"], "_length": lengths, "_seq": seq, "_off": off, "_done": full})
        return one

    def dealt(rows, groups: int, level: int):
        return written(
            rows.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
            .groupBy("_group").applyInPandas(run(level), "_row long, _length long, _seq long, _off long, _done boolean"),
            "packed")

    def bins(rows) -> int:
        return rows.agg(F.count_if(F.col("_off") == 0)).first()[0]  # every bin has one piece at its start

    placed, level, opened = None, 1, None
    packed = dealt(small, blocks_of(small.count(), group), level)
    while True:
        done, rest = packed.where("_done"), packed.where("not _done").drop("_done")
        place = done.select("_row", "_seq", "_off")
        placed = place if placed is None else placed.unionByName(place)
        opened = bins(rest)
        if not opened:
            break
        level += 1
        again = dealt(rest.select("_row", "_length"), blocks_of(rest.count(), group), level)
        saved = opened - bins(again)
        if saved < LEAST_SAVING * opened:  # mixing them anew hardly helps: the better of both stays
            placed = placed.unionByName((again if saved > 0 else rest).select("_row", "_seq", "_off"))
            break
        packed = again
    out = numbered.join(placed.withColumnRenamed("_row", "_at"), numbered["_row"] == F.col("_at"), "left")
    return out.select(*[F.col(f"`{c}`") for c in kept],
                      F.coalesce("_seq", -1 - F.col("_row")).alias("sequence_id"),
                      F.coalesce("_off", F.lit(0).cast("long")).alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(pieces(docs, tokenizer, id_col, text, capacity, end_id), "length", capacity)
