import math

import numpy as np
import pytest

from geoloom.llm import queries, whitening


def whole(spark, rows, kind="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, x string, n string").select("vec_id", whitening.quantised("embedding").alias("x"))
    return df, whitening.whiten(df, whitening.fit_whitening(df))


def expected(x):
    """n, sums, eigenvalues falling and eigenvectors as columns, of the distinct rows of x."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], vectors[:, ::-1]


def check(got, ids, x):
    n, sums, values, vectors = expected(x)
    k = min(16, x.shape[1], int((values > values[0] * 1e-20).sum()))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in ids for c in range(k))
    signs = {}
    by_id = dict(zip(ids, x, strict=True))
    for r in got:
        apart = n * by_id[r.vec_id].astype(object) - sums
        want = float((apart / n).astype(float) @ vectors[:, r.component - 1]) / math.sqrt(values[r.component - 1])
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(bool(want * r.whitened > 0))
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        assert (r.n, r.deviation) == (n, int((apart**2).sum()))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("d", [1, 3, 24])
def test_same_as_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(400, d)) * np.linspace(1, 9, d) + rng.normal(size=(400, 1))
    v[200:300] = v[0]  # one vector on a quarter of the rows
    df, out = whole(spark, [(k, r.tolist(), "a", "b") for k, r in enumerate(v)])
    check(out.collect(), list(range(400)), np.floor(64 * v).astype(np.int64) + 1_000_000)


def test_whole_table(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000
    check(got.collect(), [r.vec_id for r in rows], x)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.5, 0.25]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, []), (9, [1e300, 0.0]), (2, [3.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    _, out = whole(spark, [(*r, "a", "b") for r in rows])
    got = out.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == [(False, 1, 1), (False, 1, 2), (False, 2, 1), (False, 2, 1), (False, 2, 2), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    assert {r.n for r in got} == {3}


def test_lengths_are_fits_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(5)
    short, long = rng.normal(size=(60, 4)), rng.normal(size=(80, 7))
    rows = [(k, r.tolist(), "", "") for k, r in enumerate([*short, *long])]
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)  # a pass for each length
    got = whole(spark, rows)[1].collect()
    check([r for r in got if r.vec_id < 60], list(range(60)), np.floor(64 * short).astype(np.int64) + 1_000_000)
    check([r for r in got if r.vec_id >= 60], list(range(60, 140)), np.floor(64 * long).astype(np.int64) + 1_000_000)


def test_empty_constant_and_deficient(spark):
    assert whole(spark, [])[1].collect() == []
    assert whole(spark, [(1, [2.0, 2.0], "", ""), (2, [2.0, 2.0], "", "")])[1].collect() == []
    line = whole(spark, [(k, [float(k), 2.0 * k, 5.0], "", "") for k in range(30)])[1].collect()
    assert len(line) == 30 and {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)


def test_large_numbers_stay_exact(spark):
    rows = [(k, [2.0**49 + 64.0 * k, float(k % 3)], "", "") for k in range(50)]
    got = whole(spark, rows)[1].collect()
    x = [[math.floor(64 * r[1][0]) + 1_000_000, math.floor(64 * r[1][1]) + 1_000_000] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in got:
        assert r.deviation == sum((50 * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    norms, axes = whitening.jacobi((rng.normal(size=(200, 12)) * 10.0 ** -np.arange(12)) @ q)
    assert np.allclose(axes @ axes.T, np.eye(12), atol=1e-13)
    assert norms[-1] / norms[0] < 1e-10 and (np.diff(norms) <= 0).all()
    r = rng.normal(size=(50, 9))
    assert np.allclose(whitening.jacobi(r)[0], np.linalg.svd(r, compute_uv=False), rtol=1e-13)


def test_blocks_and_merges_do_not_change_the_fit():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, size=(700, 5)) + 1_000_000
    parts = [whitening.block(x[a : a + 97]) for a in range(0, 700, 97)]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.merged(total, p)
    centred = x - x.mean(0)
    assert total.n == 700 and total.sums == x.sum(0).tolist()
    assert np.allclose(total.r.T @ total.r, centred.T @ centred, rtol=1e-12)
