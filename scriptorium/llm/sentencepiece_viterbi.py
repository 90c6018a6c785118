"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words (``▁`` for a space; no piece of the vocabulary
reaches from one marked word into the next, which is checked on loading).  The
distinct new words of a batch are sorted, which lays them out as a trie read
depth-first: a word keeps the forward states of the prefix it shares with the
word before and computes only the rest.  A bounded cache per Python worker
remembers finished words.

The forward state of a prefix depends on the model's kind:

* unigram: the best sum of piece scores, and the piece it ends in;
* BPE: the piece that the merged prefix ends in.  Maximising scores would not
  give a BPE model's ids.  There an edge (piece ``b`` after a prefix ending in
  ``a``) is open only if merging the two pieces' text gives back ``a, b``; of
  the edges into a prefix exactly one is open, so the forward step is the same
  with scores 0 and minus infinity.  (An encoding is what merging yields if
  and only if each pair of neighbours is.)

Characters outside the vocabulary become byte pieces, or the unknown piece if
the model has none.  Ids equal those of the sentencepiece library.

Defined results: NULL and empty texts have no ids and decode to the empty
text.  Repeated rows and repeated or NULL ids are encoded row by row.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, remembers, ship

MARK = "▁"
CACHE = 350_000  # words kept per Python worker, about 200 bytes each
PAIRS = 300_000  # pairs of pieces kept per Python worker
SLICE = 500  # texts whose new words share one trie
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields."""
    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at
    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and rules of a SentencePiece model file."""

    def __init__(self, path: str):
        import struct
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds = []
        self.kind, self.prefix, self.squeeze, charsmap = _UNIGRAM, True, True, b""
        for number, value in fields:
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, 1))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models have pieces to search")
        if any(k in (4, 5) for k in kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.normaliser = None
        if charsmap or self.squeeze:
            import sentencepiece
            self.normaliser = sentencepiece.SentencePieceNormalizer(model_file=path)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.unknown = kinds.index(2) if 2 in kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.by_word = not any(crossing.search(p) for p in self.ids)
        # Lengths of the pieces that end in given one or two characters, longest first.
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self.worst = min(self.scores, default=0.0) - 10.0  # the library's penalty for an unknown character
        self.fits: dict[int, bool] = {}  # by a * pieces + b
        self.surface = [p.replace(MARK, " ").encode("utf-8") if k == 1 else bytes([int(p[3:5], 16)]) if k == 6
                        else " ⁇ ".encode("utf-8") if k == 2 else b"" for p, k in zip(self.pieces, kinds)]

    def normal(self, text: str) -> str:
        if self.normaliser is not None:
            text = self.normaliser.normalize(text).replace(" ", MARK)
            return text
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: merge the best-scored neighbours, leftmost
        first, until none merge.  For the short texts of one or two pieces."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, -1) for p in parts]

    def _open(self, a: int, b: int) -> bool:
        """May piece ``b`` follow piece ``a`` (-1: the start or an unknown character)?"""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        if a < 0:
            ok = self.merged(self.pieces[b]) == [b]
        else:
            ok = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        self.fits[a * len(self.pieces) + b] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (int32 bytes) of distinct words: one walk over their trie."""
        out: dict[str, bytes] = {}
        ids, ends, fits, scores = self.ids, self.ends, self.fits, self.scores
        bpe, none, many = self.kind == _BPE, (), len(self.pieces)
        # By prefix length: the piece that the prefix ends in (-1 unknown character), where it starts, its score.
        last, back, best = [-1], [0], [0.0]
        before = ""
        for word in sorted(words):
            n, same = len(word), 0
            limit = min(n, len(before))
            while same < limit and word[same] == before[same]:
                same += 1
            del last[same + 1:], back[same + 1:], best[same + 1:]
            for i in range(same + 1, n + 1):
                piece, start, score = -1, i - 1, None
                two = ends.get(word[i - 2:i], none) if i > 1 else none
                for size in (*two, *ends.get(word[i - 1], none)):
                    if size > i:
                        continue
                    p = ids.get(word[i - size:i])
                    if p is None:
                        continue
                    if bpe:
                        a = last[i - size]
                        ok = fits.get(a * many + p)
                        if ok is None:
                            ok = self._open(a, p)
                        if ok:
                            piece, start = p, i - size
                            break
                    else:
                        s = best[i - size] + scores[p]
                        if score is None or s > score:
                            piece, start, score = p, i - size, s
                if not bpe and word[i - 1] not in ids:
                    s = best[i - 1] + self.worst
                    if score is None or s > score:
                        piece, start, score = -1, i - 1, s
                last.append(piece)
                back.append(start)
                best.append(score or 0.0)
            before = word
            found, i = [], n
            while i:
                found.append((last[i], back[i], i))
                i = back[i]
            ids_of = array("i")
            unknown = False
            for p, start, stop in reversed(found):
                if p >= 0:
                    ids_of.append(p)
                elif self.bytes:
                    ids_of.extend(self.bytes[b] for b in word[start:stop].encode("utf-8", "replace"))
                elif not unknown:  # neighbouring unknown characters are one unknown piece
                    ids_of.append(self.unknown)
                unknown = p < 0
            out[word] = ids_of.tobytes()
        return out


@functools.lru_cache(2)
def load(path: str) -> tuple[Model, dict[str, bytes], dict[str, bytes]]:
    """The model, and the remembered words: those between single spaces
    without their mark, all others as they are marked."""
    return Model(path), {}, {}


remembers("pieces", load.cache_clear)


def _unknown(known: dict[str, bytes], texts: list[list[str]]) -> set[str]:
    """Words not remembered.  A full memory keeps what these texts use, which
    are the frequent words, and drops the rest."""
    here = set().union(*texts)
    if len(known) > CACHE:
        kept = {w: known[w] for w in here if w in known}
        known.clear()
        known.update(kept)
    return here.difference(known)


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each whole text, as int32 bytes."""
    model, spaced, marked = load(path)
    cut, plain = [], []
    for t in texts:
        simple = bool(t) and model.by_word and model.normaliser is None and model.prefix and "  " not in t \
            and MARK not in t and t[0] != " " and t[-1] != " "
        plain.append(simple)
        if not t:
            cut.append([])
        elif simple:
            cut.append(t.split(" "))
        else:
            m = model.normal(t)
            cut.append(_WORD.findall(m) if model.by_word else [m])
    new = _unknown(spaced, [c for c, p in zip(cut, plain) if p])
    if new:
        found = model.encode_words([MARK + w for w in new])
        spaced.update((w[1:], ids) for w, ids in found.items())
    new = _unknown(marked, [c for c, p in zip(cut, plain) if not p])
    if new:
        marked.update(model.encode_words(list(new)))
    return [b"".join(map((spaced if p else marked).__getitem__, c)) for c, p in zip(cut, plain)]


def decode_ids(ids, path: str) -> str:
    """Text of one id sequence; the mark that stands before the first word goes."""
    model = load(path)[0]
    text = b"".join(map(model.surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text[:1] == " " else text


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` (but one named like the result) plus the ids."""
    ship(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != ids])

    def run(batches):
        begin("pieces")
        import pyarrow as pa
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                parts = encode_texts(batch.column(batch.schema.get_field_index(text)).to_pylist(), model)
                at = np.cumsum([0, *[len(p) // 4 for p in parts]])
                values = pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)],
                    names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``rows`` (but one named like the result) plus the text."""
    ship(rows.sparkSession)
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != text])

    def run(batches):
        begin("pieces")
        import pyarrow as pa
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                lists = batch.column(batch.schema.get_field_index(ids))
                values = lists.values.fill_null(load(model)[0].unknown).to_numpy(zero_copy_only=False)
                at = lists.offsets.to_numpy()
                # one document's ids at a time become Python numbers
                out = pa.array([decode_ids(values[lo:hi].tolist(), model) for lo, hi in zip(at, at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
