"""Token ids of whole texts from remembered ids of their parts.

A text is cut where its tokenizer would cut it anyway, so that the ids of the
text are the ids of its chunks in a row.  A chunk is cut further into the
tokenizer's pre-tokens, and those are merged by the tokenizers library's BPE
model, many new ones in one call.  Each Python worker remembers
chunks and pre-tokens it has met, both in dictionaries of a bounded number of
bytes that start anew when full.  Texts are taken together up to a bounded
number of characters: Arrow cuts them and finds their distinct chunks, each is
looked up once, and NumPy lays the ids out in the order of the texts.

Pre-tokens are found here for chunks in Latin letters, ASCII signs and white
space, where this pattern and the library's name the same characters; a chunk
with any other character, or with a special string, goes to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

from .common import remembers

MEMORY = 55_000_000  # bytes of chunks, and of pre-tokens, remembered per Python worker, as estimated
_ENTRY = 150  # of them, for an entry's objects and its place in the dictionary
AT_ONCE = 10_000  # pre-tokens merged in one call of the library, at most
TOGETHER = 1_000_000  # characters of texts that are cut together; a longer text is cut alone, chunk by chunk

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}]*")
# The tokenizers' pre-token patterns (fixed), for plain chunks.
_WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+")
BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")

_TWO_SPACES = re.compile(r"\s\s")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def words(text: str) -> list[str]:
    """Cuts for tokenizers that drop white space: at every space and newline.
    Neither their normaliser nor their merges look across white space."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def spaced(text: str) -> list[str]:
    """Cuts for byte-level tokenizers that keep a space with the next word:
    at each space that stands between two other characters, where their
    pattern always starts a new pre-token.  All chunks but the first stand
    for themselves with that space before."""
    if _TWO_SPACES.search(text) or text[0] == " " or text[-1] == " ":
        return _SAFE_SPACE.split(text)
    return text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for
    themselves, the others for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


_CHAR_OF = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]


@functools.lru_cache(4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def plain(chunk: str, path: str) -> bool:
    return _PLAIN.fullmatch(chunk) is not None and not ("<" in chunk and any(s in chunk for s in specials(path)))


def _byte_spelled(pretoken: str) -> str:
    """The pre-token in the alphabet of a byte-level vocabulary."""
    if not pretoken.isascii() or " " in pretoken or "\n" in pretoken or "\t" in pretoken or "\r" in pretoken:
        return "".join([_CHAR_OF[b] for b in pretoken.encode("utf-8")])
    return pretoken


def merge(pretoken: str, path: str) -> list[int]:
    """Ids of one pre-token by the library's BPE model."""
    return [t.id for t in _model(path).tokenize(_byte_spelled(pretoken))]


def merge_all(pretokens: list[str], path: str, code: str = "I") -> list[bytes]:
    """Ids of each pre-token as integers of array type ``code``: one call of
    the library's BPE model for all of them, parted by where their characters end."""
    if not pretokens:
        return []
    spelled = [_byte_spelled(p) for p in pretokens]
    split, width = _splitter(path)
    ids = np.array(split.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, np.int64)
    ends = np.cumsum(width[ids])
    past = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
    cut = np.searchsorted(ends, past)
    if not len(ends) or ends[-1] != past[-1] or not np.array_equal(ends[cut], past):
        return [array(code, merge(p, path)).tobytes() for p in pretokens]  # a sign the vocabulary does not have
    data, size = ids.astype(code).tobytes(), array(code).itemsize
    at = [0, *((cut + 1) * size).tolist()]
    return [data[lo:hi] for lo, hi in zip(at, at[1:])]


@functools.lru_cache(4)
def _model(path: str):
    return library(path).model


@functools.lru_cache(4)
def _splitter(path: str):
    """The model behind a cut at spaces only, and the number of characters of each of its tokens."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit
    split = Tokenizer(_model(path))
    split.pre_tokenizer = WhitespaceSplit()
    vocab, suffix = split.get_vocab(), getattr(_model(path), "end_of_word_suffix", None) or ""
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        width[i] = len(token.removesuffix(suffix))
    return split, width


class _Chunks(dict):
    """Chunk -> ids as bytes, worked out when first asked for."""

    def __init__(self, path: str, kind: str, code: str):
        self.path, self.kind, self.code = path, kind, code
        self.pretokens: dict[str, bytes] = {}
        self.pattern = _WORD_PATTERN if kind == "words" else BYTE_PATTERN
        self.held = self.held_pretokens = 0  # bytes of either dictionary

    def ids(self, chunk: str) -> bytes:
        if not plain(chunk, self.path):
            return array(self.code, library(self.path).encode(chunk, add_special_tokens=False).ids).tobytes()
        found = self.pattern.findall(chunk.lower() if self.kind == "words" else chunk)
        self.meet(found)
        known = self.pretokens
        return known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])

    def meet(self, pretokens: list[str]) -> None:
        """Remember the ids of pre-tokens."""
        new = list({p: None for p in pretokens if p not in self.pretokens})
        for lo in range(0, len(new), AT_ONCE):
            some = new[lo:lo + AT_ONCE]
            for p, b in zip(some, merge_all(some, self.path, self.code)):
                self.pretokens[p] = b
                self.held_pretokens += len(p) + len(b) + _ENTRY

    def bound(self) -> None:
        if self.held > MEMORY:
            self.clear()
            self.held = 0
        if self.held_pretokens > MEMORY:
            self.pretokens.clear()
            self.held_pretokens = 0

    def all_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, their new pre-tokens merged together."""
        self.bound()
        ids = list(map(self.get, chunks))
        new = [i for i, b in enumerate(ids) if b is None]
        together = "".join([chunks[i] for i in new])
        if "<" in together or not _PLAIN.fullmatch(together):
            for i in new:
                if not plain(chunks[i], self.path):
                    ids[i] = self[chunks[i]]
            new = [i for i in new if ids[i] is None]
        lead, lower = ("", str.lower) if self.kind == "words" else (" ", str)
        for lo in range(0, len(new), AT_ONCE):
            self.bound()
            some = new[lo:lo + AT_ONCE]
            found = [self.pattern.findall(lead + lower(chunks[i])) for i in some]
            self.meet([p for f in found for p in f])
            known = self.pretokens
            for i, f in zip(some, found):
                c = chunks[i]
                if self.held > MEMORY:
                    self.clear()
                    self.held = 0
                b = ids[i] = self[c] = known[f[0]] if len(f) == 1 else b"".join([known[p] for p in f])
                self.held += len(c) + len(b) + _ENTRY
        return ids

    def __missing__(self, chunk: str) -> bytes:
        self.bound()
        b = self[chunk] = self.ids(chunk if self.kind == "words" else " " + chunk)
        self.held += len(chunk) + len(b) + _ENTRY
        return b


@functools.lru_cache(8)
def _remembered(path: str, kind: str, code: str) -> _Chunks:
    return _Chunks(path, kind, code)


def _forget() -> None:
    for memory in (library, specials, _model, _splitter, _remembered):
        memory.cache_clear()


remembers("chunks", _forget)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def laid(flat: np.ndarray, size: np.ndarray, which: np.ndarray, block: int = 1 << 15) -> bytes:
    """The entries ``which`` of a table in a row.  ``flat`` holds the entries end
    to end, ``size`` how many elements each has; a block of them at a time."""
    first, parts = np.cumsum(size) - size, []
    for lo in range(0, len(which), block):
        w = which[lo:lo + block]
        n = size[w]
        past = np.cumsum(n)
        parts.append(flat[np.arange(int(past[-1])) + np.repeat(first[w] - (past - n), n)].tobytes())
    return b"".join(parts)


def _together(texts: list[str], known: _Chunks) -> list[bytes]:
    """Ids of texts whose chunks stand between any two spaces."""
    import pyarrow as pa
    import pyarrow.compute as pc
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = cut.flatten().dictionary_encode()
    chunks, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    ids = known.all_of(chunks)
    size, width = np.fromiter(map(len, ids), np.int64, len(ids)), array(known.code).itemsize
    data = laid(np.frombuffer(b"".join(ids), known.code), size // width, place)
    ends = np.append(0, np.cumsum(size[place]))[cut.offsets.to_numpy()].tolist()
    return [data[lo:hi] for lo, hi in zip(ends, ends[1:])]


def encode(texts: list[str | None], path: str, kind: str, code: str = "I") -> list[bytes]:
    """Ids of each whole text as integers of array type ``code`` (little-endian
    on the machines Spark runs on).  ``kind``: ``words`` or ``spaced``."""
    known = _remembered(path, kind, code)
    out = [b""] * len(texts)
    waiting: list[tuple[int, bytes, str]] = []  # place, ids of what stands before, text
    held = 0

    def flush():
        for (i, head, _), ids in zip(waiting, _together([t for _, _, t in waiting], known)):
            out[i] = head + ids if head else ids
        waiting.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        head, simple = b"", len(t) <= TOGETHER
        if kind == "words":
            # In Latin-1 the tokenizer's lower-casing is Python's, sign by sign.
            # Special strings are matched before lower-casing: a text with "<" waits.
            if "<" not in t and _latin(t):
                t = t.lower()
            if not simple:
                out[i] = b"".join(map(known.__getitem__, words(t)))
                continue
            t = t.replace("\n", " ")
        else:
            simple = simple and len(t) > 1 and t[-1] != " " and not _TWO_SPACES.search(t)
            if not simple:
                first, *tail = spaced(t)
                out[i] = (known.ids(first) if first else b"") + b"".join(map(known.__getitem__, tail))
                continue
            first, _, t = t.partition(" ")  # a space at the start goes with the chunk after it
            head = known.ids(first) if first else b""
            if not t:
                out[i] = head
                continue
        waiting.append((i, head, t))
        held += len(t)
        if held > TOGETHER:
            flush()
            held = 0
    if waiting:
        flush()
    return out
