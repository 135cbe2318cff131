"""Hard negatives against brute force, whitening against plain linear algebra."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from alertmill.llm import hard_negatives as hn
from alertmill.llm import whitening as wh

ROWS = "vec_id long, label int, v array<long>, rank string, row string"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """Every anchor against every row, in plain whole numbers."""
    d = max({len(r[2]) for r in rows if r[2]}, key=lambda n: (sum(len(r[2] or []) == n for r in rows), n), default=0)
    live = [r for r in rows if r[1] is not None and r[2] and len(r[2]) == d and None not in r[2] and max(map(abs, r[2])) < hn.MOST]
    out = []
    for a in live:
        if not is_anchor(a):
            continue
        first = sorted(((sum(x * y for x, y in zip(a[2], b[2])), b) for b in live if b is not a), key=lambda s: (-s[0], math.inf if s[1][0] is None else s[1][0]))
        for score, p in [s for s in first if s[1][1] == a[1]][:positives]:
            near = [s for s in first if s[1][1] != a[1] and low * score <= 100 * s[0] <= high * score][:negatives]
            out += [(a[0], p[0], i, n[0], score, s) for i, (s, n) in enumerate(near, 1)]
    return sorted(out, key=str)


def mined(spark, rows, condition="vec_id % 5 = 0", **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)
    return sorted(map(tuple, hn.mine(df, F.expr(condition), **more).collect()), key=str)


def clustered(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, d)) * 100
    return [(i, int(rng.integers(labels)), [int(x) for x in np.floor(centers[rng.integers(6)] + rng.normal(size=d) * 30)]) for i in range(n)]


def test_mining_is_exact(spark, monkeypatch):
    """Small blocks and leaves, so that trees have levels and labels are split over parts."""
    for name, value in (("BLOCK_ROWS", 40), ("LEAF_ROWS", 4), ("ANCHOR_ROWS", 7)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(300, 6, 1) + [(i, 9, [1] * 6) for i in range(1000, 1090)]  # one label holds many equal vectors
    assert mined(spark, rows) == brute(rows, lambda r: r[0] % 5 == 0)


def test_mining_odd_rows(spark):
    one = [1, 2, 3]
    rows = [(0, 1, [5, 5, 5]), (5, None, one), (10, 1, None), (15, 1, [1, None, 2]), (None, 1, [6, 5, 5]), (20, 1, [4, 4]), (25, 1, [1 << 30, 0, 0])]
    rows += [(3, 2, [5, 5, 4]), (4, 2, [5, 5, 4]), (4, 3, [5, 4, 5]), (7, 1, [5, 5, 6]), (8, 1, [0, 0, 0]), (11, 1, [-5, -5, -5])]
    assert mined(spark, rows) == brute(rows, lambda r: r[0] is not None and r[0] % 5 == 0)
    assert mined(spark, rows, "vec_id is null") == brute(rows, lambda r: r[0] is None)
    assert mined(spark, [rows[1]]) == [] == mined(spark, [])
    twice = [(0, 1, [3, 3]), (0, 1, [3, 3]), (1, 2, [2, 2]), (1, 2, [2, 2])]
    assert mined(spark, twice) == [(0, 0, 1, 1, 18, 12), (0, 0, 1, 1, 18, 12), (0, 0, 2, 1, 18, 12), (0, 0, 2, 1, 18, 12)]


def test_wide_numbers_stay_exact(spark):
    big = (1 << 26) + 1
    rows = [(i, i % 2, [big + i, big - 3 * i, i]) for i in range(40)]
    assert mined(spark, rows, low=1, high=100) == brute(rows, lambda r: r[0] % 5 == 0, low=1, high=100)


def test_tree_prunes(monkeypatch):
    """On clustered rows, most leaves lie out of the window or beneath the kth score and are never read."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(32, 16)) * 1000
    v = np.floor(np.repeat(centers, 64, axis=0) + rng.normal(size=(2048, 16))).astype(np.int64)
    order, c, r = hn.ball_tree(v)
    one = lambda x: pa.array([x.tolist()])
    batch = pa.RecordBatch.from_arrays([one(order), one(order), one(np.zeros(len(v), np.int64)), one(v[order].ravel()), one(c.ravel()), one(r)], names=["rows", "ids", "labels", "v", "centers", "radii"])
    block, q = hn.Block(batch, 0, 16), v[:20]
    read = []
    fits = lambda who, own: read.append(len(who) * (own.stop - own.start)) or np.ones((len(who), own.stop - own.start), bool)
    free = np.full(20, np.iinfo(np.int64).max)
    who, at, score = block.search(q, 5, -free, free, fits)
    s = q @ v.T
    assert score.reshape(20, 5).tolist() == np.sort(s, axis=1)[:, ::-1][:, :5].tolist()
    assert sum(read) < 0.3 * s.size
    read.clear()
    base = np.sort(s, axis=1)[:, -1]
    least, most = base // 2, base * 95 // 100
    who, at, score = block.search(q, 3, least, most, fits)
    want = [sorted((int(x) for x in row if a <= x <= b), reverse=True)[:3] for row, a, b in zip(s, least, most)]
    assert [score[who == i].tolist() for i in range(20)] == want and sum(read) < 0.3 * s.size


# -- whitening


def reference(x, keep=16):
    u = np.unique(x, axis=0)
    y = u - u.sum(0) / len(u)
    e, q = np.linalg.eigh(y.T @ y / len(u))
    return u, e[::-1], q[:, ::-1]


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, parts, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 3)
    monkeypatch.setattr(wh, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 20)) * (10.0 ** -np.linspace(0, 1.5, 20)) * 3
    rows = [(i, data[i % 390].tolist(), "x") for i in range(400)]  # ten vectors twice
    odd = [(1000, None, "x"), (1001, [math.nan] * 20, "x"), (1002, [math.inf] + [0.0] * 19, "x"), (1003, [None] + [0.0] * 19, "x"), (1004, [1.0], "x"), (1005, [], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n string").repartition(parts)
    got = wh.whitened(df).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    u, e, q = reference(x)
    assert set(got.id) == set(range(400)) and len(got) == 400 * 16 and (got.n == len(u)).all()
    w = got.pivot(index="id", columns="component", values="whitened").to_numpy()
    b = (x - u.sum(0) / len(u)) @ q[:, :16] / np.sqrt(e[:16])
    assert np.abs(w * np.sign((w * b).sum(0)) - b).max() < 1e-8
    share = got.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (e[:16] / e.sum()) - 1).max() < 1e-9
    n, s = len(u), [int(t) for t in u.sum(0)]
    exact = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x]
    assert got[got.component == 1].sort_values("id").deviation.tolist() == exact
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_small_tables(spark):
    kinds = "vec_id long, embedding array<float>"
    assert wh.whitened(spark.createDataFrame([], kinds)).count() == 0
    assert wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kinds)).count() == 0  # no variance
    line = wh.whitened(spark.createDataFrame([(None, [0.0, 0.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])], kinds)).collect()
    assert len(line) == 3 and {r.component for r in line} == {1} and all(abs(abs(r.whitened) - 1) < 1e-12 and r.n == 2 for r in line)
    far = wh.whitened(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 5e9])], "vec_id long, embedding array<double>")).collect()
    top = 64 * 10**9
    want = {1: (2 * top) ** 2 * 0 + (3 * (top + 10**6) - 3 * 10**6) ** 2 + (5 * top) ** 2}
    assert all(r.deviation == (want[1] if want[1] < 1 << 63 else None) for r in far if r.id == 1) and len(far) == 6


def test_jacobi_keeps_small_values():
    """Columns of very different size: eigenvalues of the squared matrix would lose the small ones."""
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(50, 12)))
    r = np.linalg.qr(rng.normal(size=(12, 12)))[0] @ np.diag(10.0 ** -np.arange(0, 12))
    sigma, v = wh.jacobi(np.triu(np.linalg.qr(q @ r)[1]))
    assert np.allclose(sigma / 10.0 ** -np.arange(0, 12), 1, rtol=1e-9) and np.allclose(v.T @ v, np.eye(12), atol=1e-13)
