"""Polygons as tables of edges, and percentiles by selection."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalar as sc  # noqa: F401 - the package imports
from geoloom.operators import polygons, quantiles, spatial


def parity(x, y, rings):
    """Inside by crossings, for arrays of points that lie on no edge."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        p = np.array(ring, float)
        q = np.roll(p, -1, 0)
        for (x1, y1), (x2, y2) in zip(p, q):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (y - y1) * (x2 - x1) / (y2 - y1) + x1)
    return odd


def wavy(n, r, cx=0.0, cy=0.0):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = r * (1 + 0.3 * np.sin(17 * t) + 0.01 * np.sin(4001 * t))
    return [(cx + a, cy + b) for a, b in zip(radius * np.cos(t), radius * np.sin(t))]


def test_a_ring_of_100000_vertices(spark):
    ring, hole = wavy(100_000, 10.0), wavy(3_000, 4.0)
    side = np.linspace(-13.01, 13.02, 60)
    points = [(float(a), float(b)) for a in side for b in side]
    df = spark.createDataFrame(points, "x double, y double")
    found = {(r.x, r.y) for r in polygons.labels(df, polygons.edges_of(spark, [[ring, hole]])).collect()}
    x, y = np.array(points).T
    want = parity(x, y, [ring, hole])
    assert found == {p for p, w in zip(points, want) if w} and 500 < len(found) < 3000


def test_five_thousand_zones_from_geojson(spark):
    n = 71
    made = []
    for k in range(n * n):
        i, j = divmod(k, n)
        ring = [[x, y] for x, y in wavy(12, 0.34, j + 0.5, i + 0.5)]
        other = [[j + 0.02, i + 0.02], [j + 0.1, i + 0.02], [j + 0.1, i + 0.1]]
        coordinates = [[[*ring, ring[0]]], [[*other, other[0]]]] if k % 2 else [[*ring, ring[0]]]
        made.append((k, json.dumps({"type": "MultiPolygon" if k % 2 else "Polygon", "coordinates": coordinates})))
    made += [(99_999, None), (99_998, '{"type": "Point", "coordinates": [1, 2]}')]
    edges = polygons.edges_from_geojson(spark.createDataFrame(made, "zone int, geometry string"))
    rng = np.random.default_rng(0)
    points = rng.uniform(-1, n + 1, (4000, 2))
    cells = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(points)], "k int, x double, y double")
    got = {r.k: r.zone for r in polygons.zone_labels(cells, edges, F.col("x"), F.col("y")).collect()}
    for k, (a, b) in enumerate(points):
        i, j = math.floor(b), math.floor(a)
        zone = -1
        if 0 <= i < n and 0 <= j < n:
            rings = [wavy(12, 0.34, j + 0.5, i + 0.5)] + ([[(j + 0.02, i + 0.02), (j + 0.1, i + 0.02), (j + 0.1, i + 0.1)]] if (i * n + j) % 2 else [])
            zone = i * n + j if parity(np.array([a]), np.array([b]), rings)[0] else -1
        assert got[k] == zone, (k, a, b)


def test_borders_are_outside_and_both_forms_agree(spark):
    rings = [[(0, 0), (6, 0), (6, 6), (4, 2), (2, 6), (0, 6)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(1, 3), (2, 3), (1, 4)]]
    points = [(a / 4, b / 4) for a in range(-2, 28) for b in range(-2, 28)] + [(None, 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    joined = {(r.x, r.y) for r in polygons.labels(df, polygons.edges_of(spark, [rings])).collect()}
    listed = {(r.x, r.y) for r in df.where(spatial.in_polygon(F.col("x"), F.col("y"), rings)).collect()}

    def border(x, y):
        return any((x - a[0]) * (b[1] - a[1]) == (y - a[1]) * (b[0] - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for r in rings for a, b in zip(r, [*r[1:], r[0]]))

    want = {(x, y) for x, y in points[:-1] if not border(x, y) and parity(np.array([x]), np.array([y]), rings)[0]}
    assert joined == want and listed == want


def test_a_constant_outline_of_many_edges(spark):
    ring = wavy(3_000, 10.0)
    points = [(float(a), float(b)) for a in np.linspace(-13, 13, 25) for b in np.linspace(-13, 13, 25)]
    df = spark.createDataFrame(points, "x double, y double")
    found = {(r.x, r.y) for r in df.where(spatial.in_polygon(F.col("x"), F.col("y"), [ring])).collect()}
    x, y = np.array(points).T
    assert found == {p for p, w in zip(points, parity(x, y, [ring])) if w}


def test_union_of_rotated_quadrilaterals(spark):
    rng = np.random.default_rng(4)
    area = [[(1.0, 1.0), (9.0, 2.0), (8.0, 9.0), (2.0, 8.0)]]
    rows, shapes = [], {}
    for key in range(4):
        for f in range(5):
            c, r, t = rng.uniform(0, 10, 2).tolist(), rng.uniform(1, 3), rng.uniform(0, 2)
            ring = [(c[0] + r * math.cos(t + k * math.pi / 2), c[1] + r * math.sin(t + k * math.pi / 2) * 0.6) for k in range(4)]
            ring = ring[::-1] if f % 2 else ring  # the direction does not matter
            shapes.setdefault(key, []).append(ring)
            rows += [(key, f, *a, *b) for a, b in zip(ring, [*ring[1:], ring[0]])]
    rows += [(8, 0, None, None, None, None), (9, 0, 20.0, 20.0, 21.0, 20.0), (9, 0, 21.0, 20.0, 20.0, 21.0), (9, 0, 20.0, 21.0, 20.0, 20.0)]
    out = {r.key: r.coverage for r in polygons.union_share(spark.createDataFrame(rows, "key int, zone int, x1 double, y1 double, x2 double, y2 double"), "key", area, digits=9).collect()}
    assert out[8] is None and out[9] == 0.0
    g = (np.arange(1500) + 0.5) / 150
    x, y = (v.ravel() for v in np.meshgrid(g, g))
    inside = parity(x, y, area)
    for key, rings in shapes.items():
        covered = np.zeros(len(x), bool)
        for ring in rings:
            covered |= parity(x, y, [ring])
        assert out[key] == pytest.approx((covered & inside).sum() / inside.sum(), abs=2e-3)
    two = [(0, f, *a, *b) for f, ring in enumerate([[(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)]]) for a, b in zip(ring, [*ring[1:], ring[0]])]
    exact = polygons.union_share(spark.createDataFrame([tuple(map(float, r)) for r in two], "key double, zone double, x1 double, y1 double, x2 double, y2 double"), "key", [[(0, 0), (8, 0), (8, 8), (0, 8)]], digits=12).first()
    assert exact.coverage == pytest.approx(28 / 64, abs=1e-12)


def test_slabs_are_dealt_out(spark):
    """A key's slabs are tasks of their own size, lines that footprints share are crossed once, a footprint without a name is one."""
    rings = [(f"long name {f}" if f else None, [(0, 0), (4, 1), (5, 5), (1, 4)]) for f in range(40)] + [("other", [(4, 0), (8, 0), (8, 3), (4, 3)])]
    rows = [(1, f, *map(float, (*a, *b))) for f, ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]
    out = polygons.union_share(spark.createDataFrame(rows, "key int, zone string, x1 double, y1 double, x2 double, y2 double"), "key", [[(0, 0), (8, 0), (8, 8), (0, 8)]], digits=9)
    # in common: above y = 0 and left of the line from (4, 1) to (5, 5), up to y = 3
    assert out.first().coverage == pytest.approx((15 + 12 - 0.5) / 64, abs=1e-9)
    assert re.search(r"hashpartitioning\(_key#\d+, _y#\d+, \d+\), REPARTITION_BY_COL", out._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("few", [3, 20_000])
def test_percentiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)  # 3: many rounds
    monkeypatch.setattr(quantiles, "BUCKETS", 4 if few == 3 else 256)
    rng = np.random.default_rng(7)
    groups = {
        "spread": rng.normal(size=700), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]),
        "far": np.array([-1e308, 1e308, 0.0, 1.0, 2.0, 3.0, 4.0]), "inf": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf, 4.0, 5.0]), "close": 1 + np.arange(50) * 2.0**-52,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("nan", float("nan")), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"p10": 0.1, "median": 0.5, "low": (0.33, "lower"), "high": (0.9, "higher"), "top": 1.0}
    out = {r.g: r for r in quantiles.percentiles(df, "v", wanted, ["g"]).collect()}
    assert out.keys() == groups.keys() | {None} and out[None].median == 3.5
    for g, vs in groups.items():
        r = out[g]
        assert r._n == len(vs) and r.low == np.quantile(vs, 0.33, method="lower") and r.high == np.quantile(vs, 0.9, method="higher") and r.top == vs.max()
        if g != "inf":
            assert (r.p10, r.median) == (pytest.approx(np.quantile(vs, 0.1), rel=1e-12), pytest.approx(np.median(vs), rel=1e-12))
    whole = quantiles.percentiles(df, "v", {"median": 0.5}).first()
    assert whole["_n"] == sum(map(len, groups.values())) + 2


def test_percentiles_of_a_large_group(spark):
    df = spark.range(3_000_000).select((F.pmod(F.col("id") * 7919, F.lit(2_000_003)) / 10).alias("v"))
    r = quantiles.percentiles(df, "v", {"median": 0.5, "p90": 0.9}).first()
    vs = (np.arange(3_000_000) * 7919) % 2_000_003 / 10
    assert (r.median, r.p90) == (pytest.approx(np.median(vs)), pytest.approx(np.quantile(vs, 0.9)))
