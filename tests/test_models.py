"""Tree ensembles, kriging, weighted regression and nearest sites against brute force."""

import datetime as dt
import itertools
import math
from dataclasses import replace
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import downscale, forests, gwr, kriging, neighbourhood, quantiles, spatial, stations, trees

T0 = dt.datetime(2025, 7, 1)


def scene_of(spark, n, factor, seed, gaps=0.0):
    """(coarse rows, fine rows, arrays): a temperature that two predictors explain in part."""
    rng = np.random.default_rng(seed)
    big = n * factor
    a, b = rng.uniform(0, 1, (2, big, big))
    a = np.kron(rng.uniform(0, 1, (n, n)), np.ones((factor, factor))) * 0.7 + a * 0.3
    truth = 300 + 8 * a - 5 * b * (a > 0.5) + np.linspace(0, 3, big)[:, None]
    mean = lambda g: g.reshape(n, factor, n, factor).mean((1, 3))
    coarse = [(T0, i, j, float(mean(truth)[i, j]), float(mean(a)[i, j]), float(mean(b)[i, j])) for i in range(n) for j in range(n)]
    coarse = [(*r[:3], None, *r[4:]) if rng.random() < gaps else r for r in coarse]
    fine = [(T0, i, j, float(a[i, j]), float(b[i, j])) for i in range(big) for j in range(big)]
    return spark.createDataFrame(coarse, "scene timestamp, iy int, ix int, lst double, a double, b double"), spark.createDataFrame(fine, "scene timestamp, iy int, ix int, a double, b double"), truth


def error(y, w):
    return (w * (y - np.average(y, weights=w)) ** 2).sum() if len(y) and w.sum() > 0 else 0.0


#: Leaves that hold a mean, split by split.
PLAIN = trees.Shape(leaves=1 << 10, depth=10, least=1, linear=False)


def test_histograms_grow_the_same_trees():
    """Where bins are single values, a level at a time gives what split by split gives."""
    rng = np.random.default_rng(6)
    for n, distinct, depth in ((60, 60, 10), (200, 12, 2), (150, 150, 3), (400, 255, 4), (3, 3, 4)):
        x = rng.choice(rng.normal(size=distinct), (n, 3)) if distinct < n else rng.normal(size=(n, 3))
        y, w = rng.normal(size=n) + x[:, 0], rng.uniform(0.2, 2, n)
        drawn = forests.bootstrap(n, w, range(4), 42)
        grown, leaf = forests.grow(forests.binned(x), y, drawn, depth)
        new = rng.normal(size=(500, 3))
        for m in range(4):
            rows = np.random.default_rng([42, m]).integers(0, n, n)
            tree = trees.grow(x[rows], y[rows], w[rows], replace(PLAIN, depth=depth))
            # in nodes of two or three rows cuts by different predictors tie; grown to the end both give each row's own value
            assert np.isclose(grown(new)[m], tree(new)).mean() > (0.9 if depth < 5 and n > 3 else 0)
            assert depth < 10 or np.allclose(grown(x[rows])[m], tree(x[rows]))
            assert np.array_equal(np.unique(rows), np.flatnonzero(leaf[m] >= 0)) and np.allclose(grown.value[leaf[m][leaf[m] >= 0]], grown(x)[m][leaf[m] >= 0])


def test_sparse_and_dense_sums_find_the_same_cuts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        nodes, size, n = int(rng.integers(1, 6)), int(rng.integers(1, 9)), int(rng.integers(1, 40))
        local, code = np.append(np.arange(nodes), rng.integers(0, nodes, n)), rng.integers(0, size, n + nodes)
        w, y = rng.integers(0, 3, n + nodes).astype(float), rng.normal(size=n + nodes)
        low = np.sort(rng.normal(size=(nodes, size)), 1)
        dense = forests.cuts_of(np.repeat(local, 8), np.repeat(code, 8), np.repeat(w, 8) / 8, np.repeat(w * y, 8) / 8, low, low)  # eightfold, so that it is dense
        sparse = forests.sparse_cuts(local * size + code, w, w * y, low, low)
        assert np.allclose(dense[0], sparse[0])
        cut = sparse[0] > 1e-9
        assert np.array_equal(dense[1][cut], sparse[1][cut]) and np.allclose(dense[2][cut], sparse[2][cut])


def test_quantile_bins_hold_like_many_rows():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=5000), rng.integers(0, 5, 5000), np.full(5000, 2.0), rng.exponential(size=5000) * (rng.uniform(size=5000) < 0.3)])
    data = forests.binned(x, 32)
    for f in range(4):
        low, high, code = data.low[f][0], data.high[f][0], data.code[:, f]
        assert len(low) <= 32 and (low <= high).all() and (high[:-1] < low[1:]).all()
        assert ((x[:, f] >= low[code]) & (x[:, f] <= high[code])).all() and set(code) == set(range(len(low)))
    assert np.bincount(data.code[:, 0]).max() < 2 * 5000 / 32


def test_splits_equal_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, least = int(rng.integers(2, 25)), int(rng.integers(1, 4))
        x, y, w = rng.integers(0, 6, (n, 3)).astype(float), rng.normal(size=n), rng.uniform(0.1, 2, n)
        gain, feature, cut = trees.split_gain(x, y, w, least)
        best = 0.0
        for f in range(3):
            for c in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= c
                if low.sum() >= least and (~low).sum() >= least:
                    best = max(best, error(y, w) - error(y[low], w[low]) - error(y[~low], w[~low]))
        assert gain == pytest.approx(best, abs=1e-9)
        if gain > 1e-9:
            low = x[:, feature] <= cut
            assert error(y, w) - error(y[low], w[low]) - error(y[~low], w[~low]) == pytest.approx(gain, abs=1e-9)


def test_leaves_hold_ridge_regressions():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(40, 2)), rng.uniform(0.5, 2, 40)
    y = 2 + x @ [1.0, -3.0] + rng.normal(0, 0.1, 40)
    b, low, high = trees.leaf_fit(x, y, w, trees.SCENE_TREES)
    loss = lambda c: (w * (y - c[0] - x @ c[1:]) ** 2).sum() + (c[1:] ** 2).sum()
    assert all(loss(b) <= loss(b + d) for d in rng.normal(0, 1e-3, (200, 3)))
    assert high - low == pytest.approx(1.5 * (y.max() - y.min()))
    tree = trees.grow(np.repeat([[0.0], [1.0]], 30, 0), np.repeat([5.0, 9.0], 30), np.ones(60), PLAIN)
    assert tree(np.array([[0.0], [1.0]])).tolist() == [5.0, 9.0] and len(tree.cut) == 3


def test_boosting_follows_its_rule():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(80, 2))
    y = np.sin(6 * x[:, 0]) + x[:, 1]
    growth = forests.Growth(members=30, depth=3, rate=0.1)
    [(model, base, rest)] = forests.boosted(x, y, np.ones(80), growth)
    left, errors = y - y.mean(), []
    for tree in model(x):
        errors.append((left**2).mean())
        left = left - 0.1 * tree
    assert base == pytest.approx(y.mean()) and len(errors) == 30
    assert all(b < a for a, b in itertools.pairwise(errors)) and errors[-1] < 0.1 * errors[0]
    one = trees.grow(x, y - base, np.ones(80), replace(PLAIN, leaves=8, depth=3))
    assert np.allclose(model(x)[0], one(x)) and np.allclose(rest, left)
    # side by side, each group comes out as by itself
    group = rng.integers(0, 3, 80)
    weight = rng.uniform(0.5, 2, 80) * (group > 0)  # a group of no weight counts alike
    both = forests.boosted(x, y, weight, growth, group)
    for g in range(3):
        [(alone, start, _)] = forests.boosted(x[group == g], y[group == g], weight[group == g], growth)
        assert both[g][1] == pytest.approx(start) and np.isclose(both[g][0](x), alone(x)).mean() > 0.98
        assert np.allclose(both[g][2], y[group == g] - start - 0.1 * both[g][0](x[group == g]).sum(0))


def test_spread_is_that_of_the_trees(spark):
    coarse, fine, _ = scene_of(spark, 8, 3, 4, gaps=0.1)
    growth = forests.Growth(members=60, depth=4)  # three blocks
    out = {(r.iy, r.ix): r for r in forests.scene_ensemble(coarse, fine, "lst", ["a", "b"], 3, growth, tile=3).collect()}
    rows = sorted((r.iy, r.ix, r.a, r.b, r.lst) for r in coarse.collect() if r.lst is not None)
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    each = [forests.grow(forests.binned(x), y, forests.bootstrap(len(y), np.ones(len(y)), [m], 42), 4)[0] for m in range(60)]
    residual = np.std(y - np.mean([t(x)[0] for t in each], 0))
    cells = fine.collect()
    predictions = np.array([t(np.array([[r.a, r.b] for r in cells]))[0] for t in each])
    for k, r in enumerate(cells):
        got = out[r.iy, r.ix]
        assert got.lst_downscaled == pytest.approx(predictions[:, k].mean()) and got.lst_downscaled_spread == pytest.approx(predictions[:, k].std(ddof=1)) and got.lst_downscaled_uncertainty == pytest.approx(residual)


def test_ensembles_keep_cells_and_skip_scenes(spark):
    coarse, fine, truth = scene_of(spark, 8, 3, 4, gaps=0.1)
    few = coarse.withColumn("scene", F.lit(dt.datetime(2025, 7, 2))).where("iy = 0")
    holes = fine.withColumn("a", F.when((F.col("iy") == 5) & (F.col("ix") == 5), None).otherwise(F.col("a")))
    both = coarse.unionByName(few)
    for kind in ("forest", forests.Growth(members=40, depth=3, rate=0.1)):
        out = forests.scene_ensemble(both, holes, "lst", ["a", "b"], 3, kind, tile=2).collect()
        assert len(out) == 24 * 24 and {r.scene for r in out} == {T0}
        got = {(r.iy, r.ix): r.lst_downscaled for r in out}
        assert got[5, 5] is None and all(v is not None for k, v in got.items() if k != (5, 5))
        flat = np.std(truth)
        assert np.sqrt(np.mean([(v - truth[k]) ** 2 for k, v in got.items() if v is not None])) < 0.85 * flat
    assert [(r.scene, r.samples) for r in trees.skipped_scenes(both, "lst", ["a", "b"]).collect()] == [(dt.datetime(2025, 7, 2), few.where("lst is not null").count())]


def test_local_trees_against_a_whole_scene_in_numpy(spark):
    n, factor, window = 12, 2, 5
    coarse, fine, _ = scene_of(spark, n, factor, 5, gaps=0.15)
    weights = downscale.homogeneity_weights(fine, ["a", "b"], factor)
    out = {(r.iy, r.ix): r for r in trees.local_trees(coarse, fine, "lst", ["a", "b"], factor, (n, n), window=window, min_window=12, members=4, weights=weights, kelvin_offset=0.0).collect()}
    rows = sorted((r.iy, r.ix, r.a, r.b, r.lst) for r in coarse.collect() if r.lst is not None)
    w = {(r.iy, r.ix): r.weight for r in weights.collect()}
    fit = lambda own, shape: trees.fit_ensemble(np.array([r[2:4] for r in own]), np.array([r[4] for r in own]), np.array([w[r[:2]] for r in own]), shape)
    whole = fit(rows, trees.Shape(members=4))
    trust, local = np.zeros((n, n)), {}
    for wy in range(-(-n // window)):
        for wx in range(-(-n // window)):
            own = [r for r in rows if window * wy - 1 <= r[0] < window * (wy + 1) + 1 and window * wx - 1 <= r[1] < window * (wx + 1) + 1]
            inside = [r for r in own if (r[0] // window, r[1] // window) == (wy, wx)]
            if len(own) < 12:
                continue
            local[wy, wx] = fit(own, trees.Shape(members=4, leaves=10))
            if not inside:
                continue
            e, s = (np.maximum(np.abs(m(np.array([r[2:4] for r in inside])) - [r[4] for r in inside]), 1e-6) ** -2.0 for m in (local[wy, wx], whole))
            trust[window * wy : window * (wy + 1), window * wx : window * (wx + 1)] = (e / (e + s)).mean()
            for r, t in zip(inside, e / (e + s)):
                trust[r[0], r[1]] = t
    known = {(r.iy, r.ix): np.array([[r.a, r.b]]) for r in fine.collect()}
    place = lambda k: min(max((k + 0.5) / factor - 0.5, 0), n - 1)
    for (i, j), r in out.items():
        y, x = place(i), place(j)
        a, b = int(y), int(x)
        c, d = min(a + 1, n - 1), min(b + 1, n - 1)
        t = (trust[a, b] * (1 - x + b) + trust[a, d] * (x - b)) * (1 - y + a) + (trust[c, b] * (1 - x + b) + trust[c, d] * (x - b)) * (y - a)
        key = (i // (window * factor), j // (window * factor))
        overall = whole(known[i, j])[0]
        near = local[key](known[i, j])[0] if key in local else overall
        assert r.lst_downscaled == pytest.approx((t * near**4 + (1 - t) * overall**4) ** 0.25, rel=1e-9)


def krige_by_hand(grid, factor):
    """Dense loops: lags, ranges, and one system for every fine cell."""
    n, m = grid.shape
    most = max(1, min(8, max(n, m) // 2))
    cells = [(i, j) for i in range(n) for j in range(m) if np.isfinite(grid[i, j])]
    lags = {}
    for (i, j), (p, q) in itertools.combinations(cells, 2):
        if (p - i) ** 2 + (q - j) ** 2 <= most * most:
            lags.setdefault((p - i, q - j), []).append((grid[i, j] - grid[p, q]) ** 2)
    lags = {k: (np.mean(v) / 2, len(v)) for k, v in lags.items() if len(v) >= 5}
    at = (np.arange(5) + 0.5) / 5 - 0.5
    inner = [(y, x) for y in at for x in at]
    cov = lambda r, s, pts: np.mean([[np.exp(-np.hypot(s[0] + b[0] - a[0], s[1] + b[1] - a[1]) / r) for b in inner] for a in pts])
    best = None
    for r in kriging.RANGES:
        own = cov(r, (0, 0), inner)
        shape = {k: own - cov(r, k, inner) for k in lags}
        ss = sum(c * shape[k] ** 2 for k, (_, c) in lags.items())
        sill = sum(c * g * shape[k] for k, (g, c) in lags.items()) / ss
        loss = sum(c * (g - sill * shape[k]) ** 2 for k, (g, c) in lags.items())
        if sill > 0 and (best is None or loss < best[0]):
            best = (loss, r)
    r = best[1]
    out = np.zeros((n * factor, m * factor))
    for i in range(n):
        for j in range(m):
            near = [(p, q) for p, q in cells if abs(p - i) <= 2 and abs(q - j) <= 2]
            if near:
                k = np.array([[cov(r, (c - a, d - b), inner) for c, d in near] for a, b in near])
                for u in range(factor):
                    for v in range(factor):
                        point = [((u + 0.5) / factor - 0.5, (v + 0.5) / factor - 0.5)]
                        to = np.array([cov(r, (a - i, b - j), point) for a, b in near])
                        out[i * factor + u, j * factor + v] = np.linalg.solve(k, to) @ [grid[c] for c in near]
    return r, out


def test_kriging_equals_dense_loops(spark):
    rng = np.random.default_rng(6)
    n, m, factor = 5, 6, 3
    grid = np.add.outer(np.linspace(0, 2, n), np.sin(np.arange(m))) + rng.normal(0, 0.2, (n, m))
    grid[1, 2] = grid[4, 5] = np.nan
    rows = [(T0, i, j, None if np.isnan(grid[i, j]) else float(grid[i, j])) for i in range(n) for j in range(m)]
    residuals = spark.createDataFrame(rows, "scene timestamp, iy int, ix int, r double")
    reach, expected = krige_by_hand(grid, factor)
    assert kriging.fit_ranges(residuals, "r", (n, m)).first().reach == pytest.approx(reach)
    cells = spark.createDataFrame([(T0, i, j) for i in range(n * factor) for j in range(m * factor)], "scene timestamp, iy int, ix int")
    out = kriging.at_fine_cells(cells, kriging.kriged(residuals, "r", factor, (n, m)), factor, "f").collect()
    got = np.zeros_like(expected)
    for r in out:
        got[r.iy, r.ix] = r.f
    assert np.abs(got - expected).max() < 1e-6


def test_kriged_correction_conserves(spark):
    coarse, fine, truth = scene_of(spark, 6, 4, 7)
    flat = fine.select("scene", "iy", "ix", F.lit(300.0).alias("lst_downscaled"))
    holes = coarse.where("not (iy = 2 and ix = 3)")
    still = coarse.withColumn("scene", F.lit(dt.datetime(2025, 7, 2))).withColumn("lst", F.lit(301.0))
    out = kriging.conserve_kriged(flat.unionByName(flat.withColumn("scene", F.lit(dt.datetime(2025, 7, 2)))), holes.unionByName(still), "lst", 4, (6, 6)).collect()
    got = np.zeros((24, 24))
    for r in out:
        if r.scene == T0:
            got[r.iy, r.ix] = r.lst_downscaled
        else:
            assert r.lst_downscaled == pytest.approx(301.0)  # no variance: the block correction alone
    means = got.reshape(6, 4, 6, 4).mean((1, 3))
    for r in holes.collect():
        assert means[r.iy, r.ix] == pytest.approx(r.lst)
    smooth = truth.reshape(6, 4, 6, 4).mean((1, 3))
    assert np.abs(got - np.kron(smooth, np.ones((4, 4)))).max() > 0.01 and abs(means[2, 3] - smooth[2, 3]) < 3


def test_gwr_against_numpy(spark):
    rng = np.random.default_rng(8)
    sites = [(float(rng.uniform(0, 10)), float(rng.uniform(0, 10))) for _ in range(60)]
    rows = [(T0, k, 0, x, y, float(rng.normal()), float(rng.normal())) for k, (x, y) in enumerate(sites) for _ in range(1 + k % 3)]
    rows = [(*r, 1 + r[3] * r[5] - 2 * r[6] + float(rng.normal(0, 0.1))) for r in rows]
    train = spark.createDataFrame(rows, "scene timestamp, iy int, ix int, x double, y double, a double, b double, lst double")
    cells = [(T0, 0, k, float(k % 5) * 2 + 1, float(k // 5) * 3 + 0.5, 0.3, -0.7) for k in range(15)]
    fine = spark.createDataFrame(cells, "scene timestamp, iy int, ix int, x double, y double, a double, b double")
    t = np.array([r[3:] for r in rows])

    def fit(x, y, kernel, k, width, own):
        d2 = (t[:, 0] - x) ** 2 + (t[:, 1] - y) ** 2
        place = sorted({(float(d), p, q) for d, p, q in zip(d2, t[:, 0], t[:, 1]) if not own or d > 0})
        place = [p for p in place if kernel != "bisquare" or p[0] < width**2][:k]
        use = np.array([(d, p, q) in set(place) for d, p, q in zip(d2, t[:, 0], t[:, 1])])
        w = (1 - d2 / width**2) ** 2 if kernel == "bisquare" else np.exp(-d2 / width**2 / 2)
        z = np.column_stack([np.ones(len(t)), t[:, 2:4]])[use]
        return use.sum(), np.linalg.solve((z * w[use, None]).T @ z, (z * w[use, None]).T @ t[use, 4]) if use.sum() >= 10 else None

    for kernel, k, width in (("bisquare", 200, 4.0), ("bisquare", 9, 4.0), ("gaussian", 12, 3.0)):
        model = {r.ix: r for r in gwr.gwr(fine, train, "lst", ["a", "b"], bandwidth=width, k=k, kernel=kernel, keys=["scene"]).collect()}
        for *_, ix, x, y, _, _ in cells:
            n, beta = fit(x, y, kernel, k, width, False)
            assert (ix in model) == (beta is not None)
            if beta is not None:
                assert model[ix].local_samples == n and np.allclose([model[ix].b0, model[ix].b1, model[ix].b2], beta)
    out = gwr.predict_gwr(fine, train, "lst", ["a", "b"], bandwidth=4.0).collect()
    left = [r[7] - np.array([1, *r[5:7]]) @ beta for r in rows if (beta := fit(r[3], r[4], "bisquare", 200, 4.0, True)[1]) is not None]
    assert out[0].lst_downscaled_uncertainty == pytest.approx(np.std(left, ddof=1))
    n, beta = fit(cells[7][3], cells[7][4], "bisquare", 200, 4.0, False)
    assert next(r for r in out if r.ix == 7).lst_downscaled == pytest.approx(beta @ [1, 0.3, -0.7])


def test_nearest_sites_equal_brute_force(spark):
    rng = random.Random(9)
    for case in range(4):
        spread = (lambda: rng.uniform(0, 100), lambda: rng.gauss(0, 1) ** 5, lambda: float(rng.randrange(4)), lambda: 5.0)[case]
        sites = [(k, k % 2, spread(), spread()) for k in range(120)] + [(500, 0, 1e4, -1e4)]
        cells = [(k, k % 3 % 2, rng.uniform(-20, 120), spread()) for k in range(25)]
        s = spark.createDataFrame(sites, "id long, g int, sx double, sy double")
        c = spark.createDataFrame(cells, "cell long, g int, x double, y double")
        for k in (1, 7, 200):
            plan = spatial.nearest_sites(c, s, "x", "y", k, cell_keys=["cell"], site_key="id", keys=["g"])
            got = sorted((r.cell, r["rank"], r.id) for r in plan.collect())
            expected = []
            for cell, g, x, y in cells:
                near = sorted(((x - p) * (x - p) + (y - q) * (y - q), i) for i, h, p, q in sites if h == g)[:k]
                expected += [(cell, n, i) for n, (_, i) in enumerate(near, 1)]
            assert got == sorted(expected)
        assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
    assert spatial.nearest_sites(c, s.limit(0), "x", "y", 3, cell_keys=["cell"], site_key="id").count() == 0


def test_readings_at_times_equal_brute_force(spark):
    rng = random.Random(10)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    readings = [(rng.randrange(3), at(rng.choice([0, 7, 20, 21, 60, 61, 62, 300, 301, 700])), float(k), k) for k in range(40)] + [(0, at(30), None, 99)]
    times = [at(m) for m in (-40, 0, 3, 13, 14, 41, 200, 330, 500, 731, 900)]
    r = spark.createDataFrame(readings, "station_id long, ts timestamp, value double, n int")
    t = spark.createDataFrame([(x,) for x in times], "scene timestamp")
    first = {}
    for s, ts, v, n in readings:
        if v is not None and (s, ts) not in first:
            first[s, ts] = v
    for minutes in (1, 30, 200):
        expected = {}
        for s in range(3):
            for x in times:
                near = min((abs(ts - x), ts) for q, ts in first if q == s)
                if near[0] <= dt.timedelta(minutes=minutes):
                    expected[s, x] = first[s, near[1]]
        got = {(o.station_id, o.scene): o.value for o in stations.reading_at(r, t, minutes * 60_000_000, order="n").collect()}
        assert got == expected
        own = spark.createDataFrame([(1, times[3]), (2, times[5]), (7, times[5])], "station_id long, scene timestamp")
        asked = {(o.station_id, o.scene): o.value for o in stations.reading_at(r, own, minutes * 60_000_000, order="n").collect()}
        assert asked == {k: v for k, v in expected.items() if k in {(1, times[3]), (2, times[5])}}


def test_stations_left_out_equal_brute_force(spark):
    """Many stations at a place, ties, silent ones that make more rounds, one that is listed twice."""
    rng = random.Random(12)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    sites = [(k, float(rng.choice([0, 0, 0, 300, 400, 2000])), float(rng.choice([0, 300, 400]))) for k in range(90)] + [(5, 0.0, 0.0), (95, None, 1.0)]
    talking = rng.sample(range(90), 16) + [5, 95, 200]
    readings = [(s, at(60 * rng.randrange(12)), rng.uniform(0, 9)) for s in talking for _ in range(5)]
    r = spark.createDataFrame(readings, "station_id long, ts timestamp, value double")
    s = spark.createDataFrame(sites, "station_id long, x double, y double")
    least, tolerance, reach = {}, dt.timedelta(minutes=90), 500.0
    for q, ts, v in readings:
        least[q, ts] = min(v, least.get((q, ts), v))
    expected = {}
    for (q, ts), v in least.items():
        found = []
        for a in sites:
            for b in sites:
                if a[0] == q != b[0] and a[1] is not None and b[1] is not None and math.hypot(a[1] - b[1], a[2] - b[2]) <= reach:
                    near = min(((abs(t - ts), t) for o, t in least if o == b[0]), default=(tolerance * 2, ts))
                    if near[0] <= tolerance:
                        found.append((math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), b[0], least[b[0], near[1]]))
        found = sorted(found)[:4]
        if len(found) >= 2:
            w = [1 / max(d, 1) ** 2 for d, _, _ in found]
            expected[q, ts] = (sum(a * f[2] for a, f in zip(w, found)) / sum(w), v)
    rows = stations.leave_one_out(r, s, tolerance_us=90 * 60_000_000, max_distance=reach, min_neighbours=2, max_neighbours=4).collect()
    got = {(o.station_id, o.ts): (o.predicted, o.observed) for o in rows}
    assert len(got) == len(rows) and got.keys() == expected.keys() and len({k[0] for k in got}) > 10
    assert all(got[k] == pytest.approx(expected[k], rel=1e-12) for k in got)


def test_intervals_are_not_broadcast(spark):
    """Their rows are many more than estimates say; with scenes of its own for each station nothing is."""
    r = spark.createDataFrame([(1, T0, 1.0), (2, T0, 2.0)], "station_id long, ts timestamp, value double")
    known = quantiles.cut(stations.answers(r, 60_000_000))
    plan = lambda times: stations.answered(known, times, 60_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(r.select("station_id", F.col("ts").alias("scene")))
    assert "BuildRight" in plan(r.select(F.col("ts").alias("scene")))


def test_sites_of_a_place_are_listed_once(spark):
    """Rows are k a place, however many stations share it: 2000 of them here, 4 million pairs."""
    sites = spark.range(2000).select(F.col("id").alias("other"), (F.col("id") % 2 * 3.0).alias("sx"), F.lit(0.0).alias("sy"))
    lists = stations.near_lists(sites.selectExpr("sx AS px", "sy AS py").distinct(), sites, 5, 10.0).collect()
    assert {(o.px, tuple((e.other, e.d) for e in o.near)) for o in lists} == {(3.0 * b, tuple((2 * i + b, 0.0) for i in range(5))) for b in (0, 1)}
    assert not any(o.whole for o in lists)


def test_tiles_do_not_show(spark, monkeypatch):
    """Windows and lags across tile borders are those of one large tile."""
    rng = np.random.default_rng(11)
    rows = [(T0, i - 3, j - 2, *map(float, rng.normal(size=5))) for i in range(14) for j in range(11) if rng.random() > 0.15]
    rows = [(*r[:3], None, *r[4:]) if rng.random() < 0.1 else r for r in rows]
    cells = spark.createDataFrame(rows, "scene timestamp, iy int, ix int, fine0 double, fine2 double, coarse0 double, coarse2 double, coarse1 double")
    found = []
    for size in (64, 4, 1):
        monkeypatch.setattr(neighbourhood, "TILE", size)
        parts = [neighbourhood.starfm(cells, radius=3), neighbourhood.estarfm(cells, radius=2), neighbourhood.semivariogram(cells, "fine0", max_lag=5, min_pairs=1)]
        found.append([sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in p.collect()), key=str) for p in parts])
    assert found[0] == found[1] == found[2] and all(map(len, found[0]))
    known = {(r[1], r[2]): r[3] for r in rows if r[3] is not None}
    for r in found[0][2]:
        _, dy, dx, gamma, pairs = r
        both = [(v - known[i + dy, j + dx]) ** 2 for (i, j), v in known.items() if (i + dy, j + dx) in known]
        assert pairs == len(both) and gamma == pytest.approx(sum(both) / len(both) / 2, abs=1e-6)
