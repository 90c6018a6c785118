"""Language identification with hyperdimensional profiles.

Every letter (Unicode letter, lower-cased) and the word boundary own a random
vector of +1/-1 drawn from a hash of the code point, so any alphabet works and
every worker draws the same vectors.  A 3-gram is bound by multiplying its
letters' vectors, each rotated by its place; a text is bundled by adding its
3-gram vectors; a language's prototype is the sum over its training texts.
A text gets the language whose prototype has the largest cosine.

Learning reads every text whose language is known, whole, and adds up one
vector per language and task; Spark adds those up, so the driver receives
(languages x dimensions) numbers whatever the input.  Prediction is row-local.

Defined results: a NULL text, or one without a letter, is ``und`` with score
0; so is every text when nothing was learned.  Rows without language or id are
not learned from; a row without id counts as not held out.  Equal cosines go
to the language that sorts first.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, remembers, ship, slices

DIMENSIONS = 1024
FOLDS = 5
UNDETERMINED = "und"
PRODUCT = 4_000_000  # entries of a matrix that a batch builds, at most
_SHIFT = np.uint64(21)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.lru_cache(20_000)
def _letter_vector(code: int, dims: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, dims, dtype=np.int8)
    return bits * 2 - 1


def _forget() -> None:
    _letters.cache_clear()
    _letter_vector.cache_clear()


remembers("letters", _forget)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 3-gram code) of every 3-gram of the texts.

    Runs of other characters become one boundary; a boundary also stands
    before and after each text.  3-grams with a boundary in the middle say
    nothing about a language and are left out."""
    joined = "\x00\x00".join(t or "" for t in texts)
    codes = np.frombuffer(("\x00" + joined + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    x = _letters()[codes]
    keep = (x != 0) | np.concatenate(([True], x[:-1] != 0)) | np.concatenate(([True], owner[1:] != owner[:-1]))
    x, owner = x[keep].astype(np.uint64), owner[keep]
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ok = (x[1:-1] != 0) & (owner[2:] == owner[:-2])
    return owner[:-2][ok], ((x[:-2] << (_SHIFT + _SHIFT)) | (x[1:-1] << _SHIFT) | x[2:])[ok]


def _gram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """(grams, dims) float32 of +1/-1: rotate twice, once, not at all; multiply."""
    mask = np.uint64((1 << 21) - 1)
    parts = []
    for place in range(3):
        code = (grams >> (_SHIFT * np.uint64(2 - place))) & mask
        letters, at = np.unique(code, return_inverse=True)
        rows = np.stack([np.roll(_letter_vector(int(c), dims), 2 - place) for c in letters])
        parts.append(rows[at])
    return (parts[0] * parts[1] * parts[2]).astype(np.float32)


def _bundle(texts: list[str | None], dims: int, group: np.ndarray | None = None, groups: int = 0):
    """Bundled vectors, one per text, or one per group of texts."""
    owner, gram = _grams(texts)
    n = groups if group is not None else len(texts)
    if not len(gram):
        return np.zeros((n, dims))
    if group is not None:
        owner = group[owner]
    distinct, at = np.unique(gram, return_inverse=True)
    out = np.zeros((n, dims))
    step = max(1, PRODUCT // max(n, dims))  # bounds both matrices of a product
    counts = np.bincount(owner * len(distinct) + at, minlength=n * len(distinct)) \
        if n * len(distinct) <= PRODUCT else None
    for lo in range(0, len(distinct), step):
        hi = min(lo + step, len(distinct))
        if counts is not None:
            c = counts.reshape(n, -1)[:, lo:hi]
        else:
            here = (at >= lo) & (at < hi)
            c = np.bincount(owner[here] * (hi - lo) + at[here] - lo, minlength=n * (hi - lo)).reshape(n, -1)
        out += c.astype(np.float32) @ _gram_vectors(distinct[lo:hi], dims)
    return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype per language, learned from all rows of ``docs`` that
    have a language and a text with letters."""
    ship(docs.sparkSession)

    def run(batches):
        begin("letters")
        total: dict[str, np.ndarray] = {}
        for pdf in slices(batches, 400):
            names, group = np.unique(pdf["lang"].to_numpy(str), return_inverse=True)
            sums = _bundle(pdf["text"].tolist(), dims, group, len(names))
            for name, s in zip(names.tolist(), sums):
                total[name] = total.get(name, 0) + s
        for name, s in total.items():
            yield pd.DataFrame({"lang": name, "dim": np.arange(dims), "value": s.astype(np.int64)})

    rows = (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
            .mapInPandas(run, "lang string, dim long, value long")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect())
    sums: dict[str, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r["lang"], np.zeros(dims))[r["dim"]] = r["value"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` (but those named like the results), plus the
    predicted language and the cosine with its prototype (0 if negative)."""
    ship(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (pred, score)])
    names = list(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else 1
    matrix = np.stack([prototypes[n] for n in names]).T if names else np.zeros((1, 0))
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()),
                           T.StructField(score, T.DoubleType())])

    def run(batches):
        begin("letters")
        import pyarrow as pa
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                lang, cosine = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if names:
                    v = _bundle(texts, dims)
                    norm = np.sqrt((v * v).sum(1))
                    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                    cos = (v @ matrix) / np.where(norm > 0, norm, 1)[:, None]
                    best = cos.argmax(1)
                    for i, ok in enumerate(lettered):
                        if ok:
                            lang[i] = names[best[i]]
                            cosine[i] = min(1.0, max(0.0, cos[i, best[i]]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(cosine, pa.float64())],
                    names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id's text falls into fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
