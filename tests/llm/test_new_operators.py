"""Alignment, WARC and whitening against plain statements of what they compute."""

from __future__ import annotations

import base64
import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chunk_ids, cross_alignment, queries, warc, whitening
from scriptorium.session import scratch_path

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- cross-tokenizer alignment ----------------------------------------------

def spelled_tokens(text):
    """(ids, byte ends) of both tokenizers, or None where a side does not spell a space and the text."""
    tokenizer, a = cross_alignment._plain_specials(A), cross_alignment._byte_level(A)
    model, b = cross_alignment._pieces(B)
    if not text:
        return None
    raw = (" " + text).encode()
    out = []
    for ids, side in ((tokenizer.encode(" " + text, add_special_tokens=False).ids, a), (model.encode(text), b)):
        if b"".join(side.spelled[i] for i in ids) != raw:
            return None
        ends, at = [], 0
        for i in ids:
            at += len(side.spelled[i])
            ends.append(at)
        out.append((ids, ends))
    return out


def plain_groups(text):
    found = spelled_tokens(text)
    if found is None:
        return []
    (a, a_ends), (b, b_ends) = found
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        left, right = [], []
        while i < len(a) and a_ends[i] <= cut:
            left.append(a[i])
            i += 1
        while j < len(b) and b_ends[j] <= cut:
            right.append(b[j])
            j += 1
        groups.append((left, right))
    return groups


def plain_alignment(texts):
    groups = [plain_groups(t) for t in texts]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    texts_with = collections.Counter(p for c in links for p in c)
    top = {}
    for (a, _), n in texts_with.items():
        top[a] = max(top.get(a, 0), n)
    rows = []
    for g, c in zip(groups, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                     sum(m for p, m in c.items() if texts_with[p] == top[p[0]]),
                     sum(m * texts_with[p] for p, m in c.items()),
                     hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


TEXTS = [None, "", " ", "a", "The cat sat on the mat.", "The cat sat on the mat.", "  two spaces", "tab\tand\nline",
         "<s> </s> <|endoftext|> <0x41> <unk>", "日本語のテキスト" * 50, "é▁x", "ﬁne", "\U0001f600" * 40, "x" * 5000,
         " ".join(f"wort{i % 97} été{i % 13}" for i in range(4000)), "0123456789" * 300]


@pytest.mark.parametrize("hot", [1, 20_000])
def test_alignment_equals_plain_merging(spark, tmp_path, hot):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs string")
    aligned = cross_alignment.align(df, A, B, lane=16).withColumn("said", F.sha2(F.col("groups").cast("binary"), 256))
    got = cross_alignment.link_scores(aligned, hot_pairs=hot).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    have = sorted((r["doc_id"] if r["doc_id"] is not None else 3, *[r[n] for n in names],
                   r["said"] if r["groups"] else "") for r in got)
    assert have == [(i, *r) for i, r in enumerate(plain_alignment(TEXTS))]
    ends = {r["doc_id"]: r["cuts"] for r in got}
    assert ends[4] == sorted(set.intersection(*[set(e) for _, e in spelled_tokens(TEXTS[4])]))


def test_lanes_do_not_change_groups():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = [np.unique(np.append(rng.integers(1, n, n // 2), n)) for n in rng.integers(2, 400, 7)]
        b = [np.unique(np.append(rng.integers(1, x[-1] + 1, x[-1] // 3 + 1), x[-1])) for x in a]
        for lane in (1, 3, 10_000):
            text, a0, a1, b0, b1 = cross_alignment.lockstep([*a, np.empty(0, int)], [*b, np.empty(0, int)], lane)
            for t in range(len(a)):
                here = text == t
                cuts = np.intersect1d(a[t], b[t])
                assert (a[t][a1[here] - 1] == cuts).all() and (b[t][b1[here] - 1] == cuts).all()
                assert (a0[here] == np.append(0, a1[here][:-1])).all() and (b0[here] == np.append(0, b1[here][:-1])).all()
        assert 7 not in text


def test_large_groups_count_ids_before_crossing(monkeypatch):
    monkeypatch.setattr(cross_alignment, "LARGE_GROUP", 3)
    text = np.array([0, 0, 2])
    out = cross_alignment._link_counts(text, np.array([0, 3, 4]), np.array([3, 1, 2]), np.array([0, 2, 3]),
                                       np.array([2, 1, 1]), np.array([5, 5, 6, 7, 8, 9]), np.array([1, 1, 2, 3]))
    assert list(zip(*[x.tolist() for x in out])) == [(0, 5, 1, 4), (0, 6, 1, 2), (0, 7, 2, 1), (2, 8, 3, 1), (2, 9, 3, 1)]


def test_alignment_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cross_alignment.link_scores(cross_alignment.align(empty, A, B)).collect() == []


def test_op11_equals_plain_merging(spark, tmp_path):
    texts = [t for t in TEXTS if t is None or len(t) < 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                      "groups_sha256")) for r in queries.op11_cross_alignment(spark, str(tmp_path)).collect())
    assert got == [(i, *r) for i, r in enumerate(plain_alignment(texts))]


# --- WARC -------------------------------------------------------------------

EMBEDDED = warc.MAGIC + "WARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
PAGES = [(i, f"http://x/{i}", f"payload {i % 7}") for i in range(40)] + [
    (100, None, None), (101, "a b\r\nWARC-Type: x", ""), (102, "u", EMBEDDED), (103, "u", "pre" + EMBEDDED[:-4]),
    (104, "u", warc.MAGIC * 5), (105, "u", warc.MAGIC + "Content-Length: 7\r\n\r\n"), (106, "u", "é" * 50 + warc.MAGIC),
    (7, "u", "payload 0"), (7, "u", "payload 0"), (None, "u", "payload 1"), (None, "u", "alone"),
    (107, "u", "x" * 3000 + warc.MAGIC + "y" * 3000 + EMBEDDED + "z" * 5000)]


def plain_pages(pages, at_least=0):
    least = {}
    for p, _, h in pages:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        first = least.get(h or "")
        again = first is not None and p != first and len(raw) >= at_least
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def write_pages(spark, path, rows, parts=3):
    (spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("head", F.lit("clash"))
     .withColumn("digest", F.lit("clash")).repartition(parts).write.parquet(f"{path}/pages.parquet"))


@pytest.mark.parametrize("size", ["128m", "701"])
def test_op12_reads_back_what_was_written(spark, tmp_path, small_ranges, size):
    write_pages(spark, tmp_path, PAGES)
    small_ranges(size)
    got = [tuple(r) for r in queries.op12_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == plain_pages(PAGES)


def test_payloads_come_back_whole_from_any_ranges(spark, tmp_path, small_ranges):
    rows = spark.createDataFrame(PAGES[40:], "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "archive")
    warc.write_archive(rows, path, at_least=10**6)
    small_ranges("97")
    got = warc.read_archive(spark, path)
    assert sorted(bytes(r["payload"]).decode() for r in got.collect()) == sorted(h or "" for _, _, h in PAGES[40:])
    assert got.where(warc.field("WARC-Type") != "response").count() == 0


def test_only_long_enough_payloads_are_revisited(spark, tmp_path):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch_path(spark, "archive")
    warc.write_archive(rows, path, at_least=9)
    got = [(r["t"], r["p"]) for r in warc.read_archive(spark, path).select(
        warc.field("WARC-Type").alias("t"), warc.page_of("WARC-Refers-To").alias("p")).collect()]
    assert sorted(got, key=str) == sorted([(x[3], x[4]) for x in plain_pages(PAGES, 9)], key=str)


def test_hot_and_rare_digests_are_told_alike(spark):
    rows = [(i, "u", "hot" if i % 3 else f"cold {i % 12}") for i in range(300)]
    df = spark.createDataFrame(rows, "page long, url string, payload string")
    want = sorted((p, x) for (p, _, _, _, x) in plain_pages(rows))
    for hot in (1, 4, 4096):
        assert sorted((r["page"], r["refers_to"]) for r in warc.with_revisits(df, hot=hot).collect()) == \
            sorted(want, key=lambda x: x[0])


def test_empty_and_damaged_archives(spark, tmp_path):
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).collect() == []
    for i, damaged in enumerate([EMBEDDED[:-6], EMBEDDED + "junk", "junk" + EMBEDDED, EMBEDDED.replace("4", "3")]):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "a.warc").write_bytes(damaged.encode())
        with pytest.raises(ValueError):
            warc.read_archive(spark, f"{tmp_path}/{i}")


def test_one_long_payload(spark, tmp_path):
    write_pages(spark, tmp_path, [(1, "u", "long " * 400_000)], 1)
    assert [tuple(r)[1:4] for r in queries.op12_warc(spark, str(tmp_path)).collect()] == \
        [x[1:4] for x in plain_pages([(1, "u", "long " * 400_000)])]


# --- whitening --------------------------------------------------------------

def plain_whitening(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    spread = np.array(x, object) * n - np.array(sums, object)
    centred = spread.astype(float) / n
    v = centred.T @ centred / n
    values, vecs = np.linalg.eigh(v)
    return n, [int(s) for s in (spread * spread).sum(1)], centred, v, values[::-1], vecs[:, ::-1]


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 7)
                                  for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x int")


RNG = np.random.default_rng(5)
SHAPES = {"full": RNG.standard_normal((300, 48)), "scaled": RNG.standard_normal((400, 40)) * np.logspace(2, -1, 40),
          "few": RNG.standard_normal((15, 60)) * 9, "one dimension": RNG.standard_normal((9, 1)) * 4,
          "pairs": RNG.standard_normal((500, 3)) @ RNG.standard_normal((3, 30)) * 5}


@pytest.mark.parametrize("shape", SHAPES)
def test_whitening_equals_an_eigensolver(spark, shape):
    vectors = SHAPES[shape]
    got = whitening.whiten(embeddings(spark, vectors)).collect()
    n, deviation, centred, v, values, vecs = plain_whitening(vectors)
    k = max(r["component"] for r in got)
    assert k == min(32, int((values > values[0] * 1e-12).sum()))
    w = np.zeros((n, k))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-6
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-6
    assert len(got) == n * k
    want = centred @ (vecs[:, :k] / np.sqrt(values[:k]))
    signs = np.sign((w * want).sum(0))
    assert np.abs(w - want * signs).max() < 1e-6


def test_equal_eigenvalues_still_whiten(spark):
    cross = np.concatenate([np.eye(40) * 3, -np.eye(40) * 3])
    got = whitening.whiten(embeddings(spark, cross)).collect()
    w = np.zeros((80, 32))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / 80 - np.eye(32)).max() < 1e-10


def test_vectors_that_take_no_part(spark):
    good = RNG.standard_normal((20, 3))
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    got = whitening.whiten(embeddings(spark, [*odd, *good])).collect()
    assert {r["vec_id"] for r in got} == set(range(6, 26)) and {r["n"] for r in got} == {20}
    for none in (odd[:2], [], [[1.0, 2.0]] * 4):
        assert whitening.whiten(embeddings(spark, none)).collect() == []


def test_repeated_rows_count(spark):
    vectors = np.concatenate([SHAPES["few"][:, :5]] * 3)
    got = whitening.whiten(embeddings(spark, vectors)).collect()
    assert len(got) == 45 * 5 and {r["n"] for r in got} == {45}
    assert [r["deviation"] for r in sorted(got, key=lambda r: (r["component"], r["vec_id"]))][:45] == plain_whitening(vectors)[1]


def test_inertia_counts_eigenvalues():
    for shape in ("full", "scaled", "pairs"):
        _, _, _, v, values, _ = plain_whitening(SHAPES[shape])
        shifts = [values[0] * 1.1, (values[0] + values[1]) / 2, values[5] * (1 + 1e-6), values[5] * (1 - 1e-6), -1.0]
        assert whitening.inertia(*whitening.tridiagonal(v), shifts).tolist() == [int((values < s).sum()) for s in shifts]


def test_an_eigenvalue_is_never_missed(spark):
    """A start without any part along one eigenvector, which inertia tells."""
    values = np.array([9.0, 7.5, 6.0, 4.0, 2.0, 1.0])
    q, _ = np.linalg.qr(RNG.standard_normal((6, 6)))
    found, vecs = whitening.feast(spark, q @ np.diag(values) @ q.T, 4, per_interval=2)
    assert np.abs(found - values[:4]).max() < 1e-12
    assert np.abs(np.abs(vecs.T @ q[:, :4]) - np.eye(4)).max() < 1e-10


def test_op13_on_the_smallest_table(spark):
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r["identity_error"] for r in got) < 1e-4
    assert sum(r["explained"] for r in got if r["vec_id"] == got[0]["vec_id"]) <= 1 + 1e-9


def test_entries_are_laid_in_a_row_by_blocks():
    """The bytes of tokens come from one table, a block at a time, not token by token."""
    words = [b"ab", b"", b"cde", b"f"]
    side = cross_alignment.Side(words)
    which = np.array([2, 1, 0, 3, 3, 2, 1])
    expected = b"".join(words[k] for k in which)
    assert side.spell(which) == expected and side.spell(which[:0]) == b""
    for block in (1, 2, 3, 100):
        assert chunk_ids.laid(side.flat, side.size, which, block) == expected
