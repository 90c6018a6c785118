"""Cross-polytope codes of unit vectors after fast Hadamard rotations (numpy)."""

from __future__ import annotations

import functools

import numpy as np

ROUNDS = 3  # sign flips and Hadamard transforms per pseudo-random rotation


def unit_rows(rows: list, dims: int) -> np.ndarray:
    """Double-precision unit vectors of rows already known to be usable."""
    x = np.asarray(rows, np.float64).reshape(len(rows), dims)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        half *= 2
    return x


def axes(dims: int) -> int:
    """Signed axes of rotated vectors of up to ``dims`` components, at least: a
    code of ``depth`` axes is below this to the power of ``depth``."""
    return 2 * (1 << max(1, (max(dims, 2) - 1).bit_length()))


@functools.lru_cache(512)
def _signs(seed: int, size: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=seed + 1)).integers(0, 2, (ROUNDS, size), dtype=np.int8)
    return (bits * 2 - 1).astype(np.float32)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows under pseudo-random rotation number ``seed`` (up to scale)."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size), np.float32)
    y[:, :x.shape[1]] = x
    for s in _signs(seed, size):
        y = hadamard(y * s) / np.float32(np.sqrt(size))
    return y


def codes(x: np.ndarray, tables: int, depth: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) int64 bucket codes.

    A hash is the signed axis nearest to the rotated vector; ``depth`` of
    them make a table's code.  Place 0 is the vector's own bucket; the probes
    replace the axes whose runner-up is nearest, cheapest first."""
    n = len(x)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        own = np.zeros((n, depth), np.int64)
        options = []  # (cost, function, axis) of the best alternatives of each function
        for f in range(depth):
            y = rotated(x, t * depth + f)
            size = y.shape[1]
            a = np.abs(y)
            want = min(size, probes + 1)
            top = np.argpartition(-a, want - 1, axis=1)[:, :want] if want < size else np.argsort(-a, 1)[:, :want]
            height = np.take_along_axis(a, top, 1)
            order = np.argsort(-height, 1, kind="stable")
            top, height = np.take_along_axis(top, order, 1), np.take_along_axis(height, order, 1)
            axis = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            own[:, f] = axis[:, 0]
            for k in range(1, want):
                options.append((height[:, 0] - height[:, k], np.full(n, f), axis[:, k]))
        base = 2 * size
        place = base ** np.arange(depth, dtype=np.int64)
        out[:, t, 0] = (own * place).sum(1)
        if probes:
            cost = np.stack([o[0] for o in options], 1)
            function = np.stack([o[1] for o in options], 1)
            axis = np.stack([o[2] for o in options], 1)
            best = np.argsort(cost, 1, kind="stable")[:, :probes]
            rows = np.arange(n)
            for k in range(probes):
                pick = best[:, min(k, best.shape[1] - 1)]
                f = function[rows, pick]
                out[:, t, 1 + k] = out[:, t, 0] + (axis[rows, pick] - own[rows, f]) * place[f]
    return out
