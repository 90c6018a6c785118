"""Embedding dedup (2), top-k search (3), MinHash dedup (4) against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import cross_polytope as cp, embedding_dedup, minhash_dedup, shingles as sh, topk_threshold


def _components(ids, linked):
    """Least id reachable, by repeated relabelling (brute force)."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def _vectors(seed=0, n=150):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(scale=rng.choice([0.0, 0.05, 0.15]), size=16)).astype(np.float32).tolist())
            for i in range(n)]
    rows += [(1000 + i, base[0].astype(np.float32).tolist()) for i in range(40)]  # exact copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None] * 8),
             (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, base[0].tolist()),
             (2008, [-0.0] + [1e-30] * 15), (2009, [0.0] + [1e30] * 15), (2009, [0.0] + [1e30] * 15)]
    return rows


def _usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_dedup_matches_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {}
    for r in embedding_dedup.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    good = {i: np.array(np.float32(v), float) for i, v in rows if i is not None and _usable(v)}
    unit = {i: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for i, v in good.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label = _components([i for i, _ in rows if i is not None], linked)
    for i, _ in rows:
        if i is None:
            assert got[None] == [(0, None, True)]
        else:
            n = sum(i in p for p in linked)
            assert set(got[i]) == {(n, label[i], label[i] == i)}, i
    assert len(got[2009]) == 2 and sum(map(len, got.values())) == len(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1_000, 10_000_000, 10_000_000_000])
def test_cross_polytope_recall(rows):
    tables, depth, probes = embedding_dedup.shape(rows, 64)
    rng = np.random.default_rng(1)
    x = cp.unit_rows(rng.normal(size=(2000, 64)).tolist(), 64)
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951 ** 2) * n
    a, b = cp.codes(x, tables, depth, probes), cp.codes(y, tables, depth, probes)
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() >= 0.999


def test_codes_do_not_depend_on_the_batch():
    rows = np.random.default_rng(3).normal(size=(700, 24)).astype(np.float32)
    x = cp.unit_rows(rows.tolist(), 24)
    whole = cp.codes(x, 8, 3, 4)
    assert all(np.array_equal(whole[i:i + n], cp.codes(x[i:i + n], 8, 3, 4)) for i, n in [(0, 1), (5, 2), (100, 333)])
    assert all(np.array_equal(x[i], cp.unit_rows(rows[i:i + 1], 24)[0]) for i in range(50))


@pytest.mark.parametrize("entries", [1, 40, 10_000])
def test_small_units_find_the_same_links(spark, monkeypatch, entries):
    df = spark.createDataFrame([r for r in _vectors(7) if r[0] is not None], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "_ENTRIES", entries)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == want


def test_hadamard_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(50, 24))
    y = cp.rotated(x, 5)
    assert y.shape == (50, 32)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-3)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(scale=0.02, size=8)).tolist()) for i in range(60)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


@pytest.mark.parametrize("row_block", [5, 4096])
def test_topk_matches_brute_force(spark, row_block):
    rows = _vectors(2)
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, rank int, v string")
    out = topk_threshold.top_k(df, F.col("id") % 10 == 0, k=5, row_block=row_block, query_block=4).collect()
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    want = {}
    for q, x in good.items():
        if q % 10 == 0:
            scores = sorted((-min((1 << 63) - 1, max(-(1 << 63) + 1, sum(a * b for a, b in zip(x, y)))), i)
                            for i, y in good.items() if i != q and len(y) == len(x))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == want
    assert topk_threshold.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_threshold_stops_early_and_keeps_ties():
    ids = np.arange(5000)
    x = np.zeros((5000, 3), np.int64)
    x[4990:] = [100, 100, 100]
    lists = topk_threshold.Lists(ids, x)
    best, score = lists.top(-1, np.array([1, 2, 3]), 5)
    assert lists.ids[best].tolist() == [4990, 4991, 4992, 4993, 4994] and set(score) == {600}
    best, score = lists.top(4990, np.array([0, 0, 0]), 3)
    assert lists.ids[best].tolist() == [0, 1, 2]


def _texts(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 14])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(t).replace("w1", rng.choice(["w1", "W1"]))))
            n += 1
    same = " ".join(words[:50])
    rows += [(500 + i, same) for i in range(30)]
    rows += [(600, None), (601, ""), (602, " \n\t"), (603, "one two"), (604, "ONE  two"), (605, "a b c d"),
             (606, "a b c d e"), (607, "é ü"), (608, "É ü"), (609, "\xa0x y"), (None, same), (500, same)]
    rows.append((700, " ".join(rng.choice(words) for _ in range(60_000))))
    return rows


def _sets(text):
    """Shingle sets as tuples of words, from the definition."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
             .translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_matches_brute_force(spark, percent):
    rows = _texts(percent)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bands string, rep int")
    got = minhash_dedup.near_duplicates(df, percent=percent).collect()
    sets = {i: _sets(t) for i, t in rows if i is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = _components(sets, linked)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id), r
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_that_no_star_has(spark, monkeypatch):
    """A chain: neighbours link, the ends do not, whichever member is the centre."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    words = [f"u{i}" for i in range(200)]
    rows = []
    for i in range(12):
        t = list(words)
        t[:i * 8] = [f"v{k}" for k in range(i * 8)]
        rows.append((i, " ".join(t)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_densified_signatures_agree_like_the_sets():
    rng = np.random.default_rng(0)
    for size in (8, 60, 3000):
        a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[:int(0.9 * size)], rng.integers(0, 2 ** 63, size // 10, dtype=np.uint64))))
        with np.errstate(over="ignore"):
            s = sh.signatures([a, b], 512)
        true = sh.overlap(a, b) / (len(a) + len(b) - sh.overlap(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.13
