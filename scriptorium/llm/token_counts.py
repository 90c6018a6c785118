"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is encoded by itself; those that come
back as the one token they name are proved *whole*.  In a text, a pre-token
that is such a string counts as one token without any merging; only the rest
is merged, by the library's BPE model.  Counts of parts already met are
remembered (bounded) by each Python worker.

Counts equal those of the library on the whole text, special strings inside
texts included (the library's default: each is one token).  Chunks
outside Latin letters and ASCII signs go to the library whole (see
``chunk_ids``).

Defined results: NULL and empty texts have 0 bytes and 0 tokens.  Repeated
rows and repeated or NULL ids are counted row by row.
"""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_ids
from .common import begin, remembers, ship, slices


def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, their own."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = chunk_ids.byte_alphabet()
    strings = []
    for token, i in vocab.items():
        if all(c in alphabet for c in token):
            raw = bytes(alphabet[c] for c in token)
            try:
                strings.append((raw.decode("utf-8"), i))
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
    encoded = chunk_ids.library(path).encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, i), e in zip(strings, encoded) if e.ids == [i])


CHUNKS = 350_000  # remembered per Python worker, and as many pre-tokens


@functools.lru_cache(2)
def _caches(path: str) -> tuple[dict[str, int], dict[str, int]]:
    return {}, {}


remembers("chunks", _caches.cache_clear)


def count(texts: list[str | None], path: str, whole: frozenset[str]) -> list[int]:
    """Tokens of each whole text."""
    chunks, merged = _caches(path)
    if len(chunks) > CHUNKS:
        chunks.clear()
    if len(merged) > CHUNKS:
        merged.clear()
    special = chunk_ids.specials(path)

    def tokens(chunk: str) -> int:
        if not chunk_ids.plain(chunk, path):
            return len(chunk_ids.library(path).encode(chunk, add_special_tokens=False).ids)
        n = 0
        for p in chunk_ids.BYTE_PATTERN.findall(chunk):
            if p in whole:
                n += 1
                continue
            k = merged.get(p)
            if k is None:
                k = merged[p] = len(chunk_ids.merge(p, path))
            n += k
        return n

    def segment(text: str) -> int:
        """A text without special strings, but for its first chunk."""
        first, *rest = chunk_ids.spaced(text)
        for c in rest:
            if c not in chunks:
                chunks[c] = tokens(" " + c)
        return tokens(first) + sum(map(chunks.__getitem__, rest))

    out = []
    for t in texts:
        if t and any(s in t for s in special):  # special strings stand between ordinary texts
            parts = re.split("(" + "|".join(map(re.escape, special)) + ")", t)
            out.append(sum(1 if p in special else segment(p) for p in parts if p))
        else:
            out.append(segment(t) if t else 0)
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    The proved strings go to the executors once; they are part of the
    vocabulary and so bounded by it."""
    ship(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(tokenizer))

    def run(batches):
        begin("chunks")
        for pdf in slices(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"],
                                "n_tokens": count(pdf["text"].tolist(), tokenizer, whole.value)})

    # Ids pass pandas as text: a column of numbers with a NULL would become floating there.
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"),
                      F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = src.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
