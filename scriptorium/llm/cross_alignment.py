"""Alignment of two tokenizers over the same bytes by lockstep merging.

Both tokenizers cut the bytes of a space and the text into tokens.  Offsets at
which a token of either ends are *cuts*; the tokens between two cuts are a
*group*, and every A token of a group is linked with every B token of it.

The merge runs for all texts of a batch at once.  One NumPy state array holds,
per lane, the pointers into the A and the B tokens and where the open group
began; a step compares the ends under all pointers, advances the lesser (both
where they are equal), emits the groups that close and drops the lanes that are
done.  A text is one lane; a long one enters as several, parted at offsets
where tokens of both end, so that a batch never waits for its longest text.

Corpus-wide counts of linked pairs (``link_scores``) are aggregations that
combine map-side.  Scores go back to the texts by a join in which the most
frequent pairs are broadcast, at most ``HOT_PAIRS`` of them whatever the input,
and the others are shuffled; none of those has more than its share of one
in ``HOT_PAIRS`` of the rows.

Defined results: NULL and empty texts, and texts whose tokens do not spell a
space and the text (the B normaliser changed them), have no tokens and no
groups.  Repeated rows are texts of their own and count each; ids may repeat
or be NULL.  An empty table gives an empty result.  Names of the input's
other columns do not matter: only the id and the text are read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_ids
from .common import begin, remembers, ship, written

LANE = 192  # A tokens per lane, about
HOT_PAIRS = 20_000  # most frequent pairs that are broadcast, at most
SLICE_CHARS = 600_000  # text held as tokens at a time (a single longer text is held whole)
SLICE_ROWS = 400
LARGE_GROUP = 4096  # links of one group from which ids are counted before they are crossed

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, cuts array<int>, "
           "pairs array<struct<a:int,b:int,times:int>>")


class Side:
    """One tokenizer's vocabulary as bytes, byte lengths and decimal text."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        decimal = [f"{i}{mark}" for i in range(len(spelled)) for mark in ",|;"]
        self.decimal_size = np.array([len(x) for x in decimal], np.int64)
        self.decimal = np.frombuffer("".join(decimal).encode("ascii"), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens in a row."""
        return chunk_ids.laid(self.flat, self.size, ids)


@functools.lru_cache(2)
def _byte_level(path: str) -> Side:
    """The bytes of a byte-level vocabulary."""
    alphabet = chunk_ids.byte_alphabet()
    vocab = chunk_ids.library(path).get_vocab(with_added_tokens=True)
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode("utf-8")
    return Side(spelled)


@functools.lru_cache(2)
def _plain_specials(path: str):
    """The library's tokenizer, told to read special strings as plain text: an
    own instance, as the setting must not reach other operators."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.lru_cache(2)
def _pieces(path: str) -> tuple[object, Side]:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                       else piece.replace("▁", " ").encode("utf-8"))
    return model, Side(spelled)


def _forget() -> None:
    for memory in (_byte_level, _plain_specials, _pieces):
        memory.cache_clear()


remembers("chunks", _forget)


def _lanes(a_end: np.ndarray, b_end: np.ndarray, lane: int) -> list[tuple[int, int, int, int]]:
    """(first A, past A, first B, past B) of the lanes of one text: from every
    ``lane``-th A token on, the next end that B shares parts two lanes."""
    cuts = [(0, 0)]
    while len(a_end) - cuts[-1][0] > 2 * lane:
        at, found = cuts[-1][0] + lane, None
        while at < len(a_end) and found is None:
            ends = a_end[at:at + 64]
            near = np.searchsorted(b_end, ends)
            same = np.flatnonzero(b_end[np.minimum(near, len(b_end) - 1)] == ends)
            if len(same):
                found = (at + int(same[0]) + 1, int(near[same[0]]) + 1)
            at += 64
        if found is None or found[0] >= len(a_end):
            break
        cuts.append(found)
    cuts.append((len(a_end), len(b_end)))
    return [(a0, a1, b0, b1) for (a0, b0), (a1, b1) in zip(cuts, cuts[1:])]


def lockstep(a_ends: list[np.ndarray], b_ends: list[np.ndarray], lane: int = LANE):
    """Groups of all texts: text, first A, past A, first B, past B, in order.

    ``a_ends`` and ``b_ends`` hold each text's increasing end offsets, the last
    of both equal; texts without tokens have none."""
    a_base = np.concatenate(([0], np.cumsum([len(x) for x in a_ends]))).astype(np.int64)
    b_base = np.concatenate(([0], np.cumsum([len(x) for x in b_ends]))).astype(np.int64)
    a_all = np.concatenate([*a_ends, np.empty(0, np.int64)])
    b_all = np.concatenate([*b_ends, np.empty(0, np.int64)])
    lanes = [(t, a_base[t] + a0, a_base[t] + a1, b_base[t] + b0)
             for t in range(len(a_ends)) if len(a_ends[t])
             for a0, a1, b0, _ in _lanes(a_ends[t], b_ends[t], lane)]
    if not lanes:
        return np.empty((5, 0), np.int64)
    start = np.array(lanes, np.int64).T
    # state rows: text, end of the lane, A pointer, B pointer, open group's first A, first B
    state = np.stack([start[0], start[2], start[1], start[3], start[1], start[3]])
    emitted = []
    while state.shape[1]:
        a_at, b_at = a_all[state[2]], b_all[state[3]]
        cut = a_at == b_at
        here = np.flatnonzero(cut)
        state[2] += a_at <= b_at
        state[3] += b_at <= a_at
        if len(here):
            closed = state[:, here]
            emitted.append(closed[[0, 4, 2, 5, 3]])
            state[4, here], state[5, here] = closed[2], closed[3]
            going = state[2] < state[1]
            if not going.all():
                state = state[:, going]  # compact: finished lanes leave
    groups = np.concatenate(emitted, axis=1)
    groups = groups[:, np.argsort(groups[1], kind="stable")]
    groups[1:3] -= a_base[groups[0]]
    groups[3:5] -= b_base[groups[0]]
    return groups


def _crossed(first_a, n_a, first_b, n_b):
    """Indices of the A and the B token of every link of the groups, and the group."""
    size = n_a * n_b
    group = np.repeat(np.arange(len(size)), size)
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return first_a[group] + k // n_b[group], first_b[group] + k % n_b[group], group


def _link_counts(text, first_a, n_a, first_b, n_b, a_ids, b_ids):
    """Distinct (text, a id, b id) of the groups' links and how often each occurs.
    Large groups are counted by id before they are crossed."""
    large = n_a * n_b > LARGE_GROUP
    small = ~large
    at_a, at_b, group = _crossed(first_a[small], n_a[small], first_b[small], n_b[small])
    parts = [(text[small][group], a_ids[at_a], b_ids[at_b], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(large):
        a, many_a = np.unique(a_ids[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        b, many_b = np.unique(b_ids[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        parts.append((np.full(len(a) * len(b), text[g]), np.repeat(a, len(b)), np.tile(b, len(a)),
                      np.outer(many_a, many_b).ravel()))
    t, a, b, times = (np.concatenate(x) for x in zip(*parts))
    width = int(b_ids.max()) + 1 if len(b_ids) else 1
    height = int(a_ids.max()) + 1 if len(a_ids) else 1
    key = (t * height + a) * width + b
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    times = np.add.reduceat(times, starts) if len(starts) else times
    key = key[starts]
    return key // width // height, key // width % height, key % width, times


def _rendered(groups, a_ids, b_ids, a: Side, b: Side) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: ids of each group in order, and where each token's part ends."""
    _, a0, a1, b0, b1 = groups
    mark_a, mark_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    mark_a[a1 - 1], mark_b[b1 - 1] = 1, 2
    which = np.empty(len(a_ids) + len(b_ids), np.int64)
    which[np.arange(len(a_ids)) + np.repeat(b0, a1 - a0)] = a_ids * 3 + mark_a
    which[np.arange(len(b_ids)) + np.repeat(a1, b1 - b0)] = b_ids * 3 + mark_b + len(a.decimal_size)
    size = np.concatenate([a.decimal_size, b.decimal_size])
    return chunk_ids.laid(np.concatenate([a.decimal, b.decimal]), size, which), np.cumsum(size[which])


def _encode_a(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of a space and each text.  Texts that hold a special string go to the
    library, told to read it as plain text; the others use remembered chunks."""
    special = chunk_ids.specials(path)
    plain = [not any(s in t for s in special) for t in texts]
    known = iter(chunk_ids.encode([" " + t for t, ok in zip(texts, plain) if ok], path, "spaced"))
    return [np.frombuffer(next(known), np.uint32).astype(np.int64) if ok
            else np.array(_plain_specials(path).encode(" " + t, add_special_tokens=False).ids, np.int64)
            for t, ok in zip(texts, plain)]


def align_texts(texts: list[str | None], path_a: str, path_b: str, lane: int = LANE) -> dict[str, object]:
    """Columns of ``ALIGNED`` but the id, for a list of whole texts."""
    import pyarrow as pa
    a = _byte_level(path_a)
    model, b = _pieces(path_b)
    full = [t or "" for t in texts]
    tokens_a = _encode_a(full, path_a)
    tokens_b = [np.array(x, np.int64) for x in model.encode(full, num_threads=1)]
    none = np.empty(0, np.int64)
    spelled_a, spelled_b = a.spell(np.concatenate([*tokens_a, none])), b.spell(np.concatenate([*tokens_b, none]))
    at_a = at_b = 0
    for i, t in enumerate(full):
        raw = (" " + t).encode("utf-8")
        to_a, to_b = at_a + int(a.size[tokens_a[i]].sum()), at_b + int(b.size[tokens_b[i]].sum())
        if not t or spelled_a[at_a:to_a] != raw or spelled_b[at_b:to_b] != raw:
            tokens_a[i] = tokens_b[i] = none
        at_a, at_b = to_a, to_b
    n_a, n_b = np.array([len(x) for x in tokens_a], np.int64), np.array([len(x) for x in tokens_b], np.int64)
    base_a, base_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    ends_a = [np.cumsum(a.size[x]) for x in tokens_a]
    groups = lockstep(ends_a, [np.cumsum(b.size[x]) for x in tokens_b], lane)
    flat_a, flat_b = np.concatenate([*tokens_a, none]), np.concatenate([*tokens_b, none])
    text = groups[0]
    groups[1:3] += base_a[text]  # from here on, places in the flat arrays
    groups[3:5] += base_b[text]
    _, a0, a1, b0, b1 = groups
    t, pair_a, pair_b, times = _link_counts(text, a0, a1 - a0, b0, b1 - b0, flat_a, flat_b)
    n = len(full)
    first = np.searchsorted(text, np.arange(n + 1))
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, text, (a1 - a0) * (b1 - b0))
    said, said_ends = _rendered(groups, flat_a, flat_b, a, b)
    at = np.append(0, said_ends)[np.append(base_a + base_b, len(said_ends))].tolist()
    flat_ends = np.concatenate([*ends_a, none])
    pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pair_a, pair_b, times)],
                                       names=["a", "b", "times"])
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(first), "n_links": n_links,
        "groups": [said[lo:max(lo, hi - 1)].decode("ascii") for lo, hi in zip(at, at[1:])],
        "cuts": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat_ends[a1 - 1].astype(np.int32))),
        "pairs": pa.ListArray.from_arrays(pa.array(np.searchsorted(t, np.arange(n + 1)).astype(np.int32)), pairs),
    }


def _cut(sizes: list[int]):
    """(first, past) of runs of rows of bounded text."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and (held + size > SLICE_CHARS or i - lo >= SLICE_ROWS):
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text",
          lane: int = LANE) -> DataFrame:
    """One row per text: numbers of tokens, groups and links, the groups'
    ids, their byte ends (in a space and the text), and the distinct linked id
    pairs with how often each is linked."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        begin("chunks")
        for batch in batches:
            sizes = batch.column(1).fill_null("")
            sizes = pa.compute.binary_length(sizes).to_pylist()
            for lo, hi in _cut(sizes):
                part = batch.slice(lo, hi - lo)
                cols = align_texts(part.column(1).to_pylist(), path_a, path_b, lane)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols.values())],
                                                 names=["doc_id", *cols])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, ALIGNED)


def link_scores(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """All columns of ``aligned`` but the pairs, plus ``n_best`` (links whose
    pair is linked in as many texts as any pair of its A id) and ``count_sum``
    (over links, the number of texts that hold the pair linked)."""
    rows = written(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("_row", F.explode("pairs").alias("p")).select("_row", "p.a", "p.b", "p.times")
    counts = written(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("texts")), "pairs")
    top = counts.groupBy("a").agg(F.max("texts").alias("top"))
    scored = written(counts.join(top, "a").select("a", "b", "texts", (F.col("texts") == F.col("top")).alias("best")),
                     "scored")
    total = scored.agg(F.sum("texts")).first()[0] or 0
    hot = F.col("texts") * hot_pairs >= total  # holds for hot_pairs pairs at most: their texts add up to the total
    frequent = F.broadcast(scored.where(hot))
    rare = links.join(F.broadcast(scored.where(hot).select("a", "b")), ["a", "b"], "left_anti")
    found = links.join(frequent, ["a", "b"]).unionByName(rare.join(scored.where(~hot), ["a", "b"]))
    sums = found.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("texts") * F.col("times")).alias("count_sum"))
    return (rows.drop("pairs").join(sums, "_row", "left").drop("_row")
            .withColumn("n_best", F.coalesce("n_best", F.lit(0)).cast("long"))
            .withColumn("count_sum", F.coalesce("count_sum", F.lit(0)).cast("long")))
