"""Shingle sets and one-permutation MinHash signatures of a batch of texts.

Plain numpy helpers that run inside Spark tasks; nothing here holds more than
one batch.  A word is a run of bytes without ASCII white space
(``[^\\x20\\x09-\\x0D]+``), A-Z lower-cased.  A document's set holds its
distinct 5-word shingles; with fewer words the whole sequence is the one
shingle; without words the set is empty.

Shingles are represented by 64-bit hashes.  Two different shingles of one
document pair collide with probability below 1e-10 for sets of 30,000, so set
sizes and intersections are those of the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import remembers

WIDTH = 5
WORD_CACHE = 200_000  # word hashes kept per Python worker

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()
remembers("shingles", _words.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection with full avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64) of one whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < WIDTH:
        one = np.uint64(len(h))
        with np.errstate(over="ignore"):
            for k in range(len(h)):
                one = one + h[k] * _POWERS[k]
            return mix(np.array([one], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    n = len(h) - WIDTH + 1
    s = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        s += h[k:k + n] * _POWERS[k]
    return np.unique(mix(s))


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit key of a whole set: equal keys mean equal sets."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signature per set, shape (len(sets), bins); zeros for
    the empty set.

    The hash range is cut into ``bins`` equal parts and each keeps its least
    hash.  An empty part copies the part named by a universal hash of
    (part, attempt), trying again until it meets a filled one: the optimal
    densification, which keeps P(equal) = Jaccard for every part.
    """
    out = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for row, s in enumerate(sets):
        b = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(b, prepend=np.uint64(bins)))  # s is sorted: the first of a part is its least
        at = b[first].astype(np.int64)
        out[row, at] = s[first]
        filled[row, at] = True
    attempt, (r, c) = 0, np.nonzero(~filled & filled.any(1, keepdims=True))
    while len(r):
        seed = np.uint64(attempt) * np.uint64(0x9E3779B97F4A7C15)
        donor = (mix(c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed) % np.uint64(bins)).astype(np.int64)
        ok = filled[r, donor]
        out[r[ok], c[ok]] = out[r[ok], donor[ok]]
        r, c, attempt = r[~ok], c[~ok], attempt + 1
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) int64 bucket keys from ``rows`` consecutive parts."""
    n, bins = sig.shape
    bands = bins // rows
    g = sig[:, :bands * rows].reshape(n, bands, rows)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    key = np.broadcast_to(key, (n, bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + g[:, :, k])
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets."""
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (low + high - both)
