"""Closed forms, invariants and edge cases that the star-schema queries do not show."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import grid as g
from geoloom.functions import projection
from geoloom.functions import scalar as sc
from geoloom.operators import binning, catalogue, downscale, gwr, neighbourhood, polygons, spatial, stations, temporal, trees, validation, zonal
from geoloom.plans import contracts, request, workflow
from geoloom.sources import readers, sinks

DAY = dt.datetime


def cube(spark, rows, schema="scene timestamp, iy int, ix int, lst double"):
    return spark.createDataFrame(rows, schema)


# --- grids -------------------------------------------------------------------------------------


def test_grid_snaps_and_counts(spark):
    grid = g.Grid.from_bounds((105.0, 95.0, 395.0, 210.0), "EPSG:32633", 100)
    assert (grid.left, grid.top, grid.width, grid.height) == (100, 300, 3, 3) and grid.bounds == (100, 0, 400, 300)
    cells = grid.cells(spark).select("iy", "ix", grid.x().alias("x"), grid.y().alias("y"))
    assert cells.count() == 9 and cells.where("x = 150 and y = 250").first().iy == 0
    back = cells.where((grid.row_of(F.col("y")) == F.col("iy")) & (grid.column_of(F.col("x")) == F.col("ix")))
    assert back.count() == 9
    assert len(grid.chips(2)) == 1
    with pytest.raises(ValueError):
        grid.chips(2, drop_partial=False)
    with pytest.raises(ValueError):
        g.Grid.from_bounds((1, 1, 0, 2), "EPSG:32633", 10)


def test_utm_zone_and_known_point():
    assert g.utm_crs(13.4, 52.5) == "EPSG:32633" and g.utm_crs(-70, -33) == "EPSG:32719"
    x, y = projection.project_point(15.0, 0.0, "EPSG:32633")
    assert abs(x - 500000) < 1e-6 and abs(y) < 1e-6
    # meridian arc from the equator to 45 degrees on WGS84: 4 984 944.378 m
    assert abs(projection.project_point(15.0, 45.0, "EPSG:32633")[1] / 0.9996 - 4984944.378) < 0.01
    for lon, lat in ((12.1, 52.4), (17.9, -80.0), (15.0, 0.1)):
        crs = g.utm_crs(15, lat)
        a, b = projection.unproject_point(*projection.project_point(lon, lat, crs), crs)
        assert abs(a - lon) < 1e-9 and abs(b - lat) < 1e-9


def test_area_checks():
    with pytest.raises(ValueError):
        g.Area(170, 0, -170, 1)
    ring = [[0, 0], [2, 0], [0, 2]]
    area = g.Area.from_geojson(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}))
    assert (area.west, area.north) == (0, 2) and g.Area.from_wkt(area.to_wkt()) == area
    assert g.city(" Mexico_City ")[2] == "EPSG:32614"
    with pytest.raises(KeyError):
        g.city("atlantis")


# --- masks and cells ---------------------------------------------------------------------------


def test_quality_and_statistics(spark):
    """Each reason for rejection once, beside pixels that pass."""
    t = DAY(2024, 2, 3)
    good = [(t, 0, k, 281.5 + 7 * k, 0, False) for k in range(4)] + [(t, 1, 0, 319.25, None, None)]
    bad = [(t, 2, 0, 290.0, 1 << 7, False), (t, 2, 1, 291.0, 0, True), (t, 2, 2, None, 0, False), (t, 2, 3, float("nan"), 0, False), (t, 2, 4, float("inf"), 0, False)]
    df = cube(spark, good + bad, "scene timestamp, iy int, ix int, lst double, exception_flags long, cloud_mask boolean")
    out = sc.to_celsius(sc.apply_quality(df), units="kelvin")
    assert {(r.iy, r.ix) for r in out.where("valid_mask").collect()} == {(r[1], r[2]) for r in good}
    s = binning.value_summary(out).first()
    values = [r[3] - 273.15 for r in good]
    assert (s.total, s.valid) == (10, 5) and all(abs(a - b) < 1e-9 for a, b in ((s.min, min(values)), (s.max, max(values)), (s.mean, sum(values) / 5), (s.median, sorted(values)[2])))
    with pytest.raises(ValueError):
        sc.to_celsius(df, units="furlong")


def test_cloud_buffer_grows_clouds(spark):
    t = DAY(2024, 2, 3)
    rows = [(t, r, c, 300.0, (r, c) in ((3, 3), (7, 0))) for r in range(9) for c in range(9)] + [(DAY(2024, 2, 4), 3, 3, 300.0, False)]
    df = cube(spark, rows, "scene timestamp, iy int, ix int, lst double, cloud_mask boolean")
    for n in (0, 1, 2):
        out = sc.apply_quality(df, sc.QualityPolicy(cloud_buffer=n))
        assert out.columns == [*df.columns, "valid_mask"]
        bad = {(r.iy, r.ix) for r in out.where("not valid_mask").collect()}
        assert bad == {(r, c) for r in range(9) for c in range(9) if any(max(abs(r - a), abs(c - b)) <= n for a, b in ((3, 3), (7, 0)))}


def test_zones_first_wins_and_empty_zone(spark):
    zones = [[[(0, 0), (4, 0), (0, 4)]], [[(1, 1), (3, 1), (3, 3), (1, 3)]], [[(50, 50), (51, 50), (51, 51)]]]
    cells = spatial.cells_table(spark, 4, 4)
    labels = polygons.zone_labels(cells, polygons.edges_of(spark, zones), F.col("ix") + 0.5, F.col("iy") + 0.5)
    found = {(r.iy, r.ix): r.zone for r in labels.collect()}
    assert found[0, 0] == 0 and found[2, 2] == 1 and found[3, 3] == -1 and found[1, 1] == 0
    data = cube(spark, [(DAY(2025, 1, 1), r, c, float(r + c) if (r, c) != (0, 0) else None) for r in range(4) for c in range(4)])
    out = {r.zone: r for r in zonal.zonal_statistics(data, labels, 3, statistics=tuple(zonal.STATISTICS)).collect()}
    inside = [r + c for (r, c), z in found.items() if z == 0 and (r, c) != (0, 0)]
    assert out[0]["count"] == len(inside) and abs(out[0]["std"] - np.std(inside)) < 1e-9 and abs(out[0].p90 - np.percentile(inside, 90)) < 1e-9
    assert out[2]["count"] == 0 and out[2]["mean"] is None


def test_polygon_against_parity(spark):
    rng = random.Random(1)
    ring = [(0, 0), (6, 1), (5, 5), (3, 2), (1, 6)]
    points = [(k, rng.uniform(-1, 7), rng.uniform(-1, 7)) for k in range(400)] + [(900, 0.0, 0.0), (901, 3.0, 0.5)]
    df = spark.createDataFrame(points, "k long, x double, y double")
    found = {r.k for r in df.where(spatial.in_polygon(F.col("x"), F.col("y"), [ring])).collect()}

    def winding(x, y):
        total = 0
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            total += (y1 <= y < y2 and side > 0) - (y2 <= y < y1 and side < 0)
        return total != 0

    assert found - {900, 901} == {k for k, x, y in points[:400] if winding(x, y)}
    assert 900 not in found and 901 not in found  # points on the border are outside


def test_daily_gaps(spark):
    df = cube(spark, [(DAY(2025, 1, 1, 9), 0, 0, 1.0), (DAY(2025, 1, 1, 21), 0, 0, 3.0), (DAY(2025, 1, 3), 0, 0, None)])
    out = {r.day.day: (r.lst, r.valid_count) for r in binning.daily_mean(df, fill_gaps=True).collect()}
    assert out == {1: (2.0, 2), 2: (None, 0), 3: (None, 0)}


def test_block_rule_and_conservation(spark):
    values = {(r, c): float(r * 6 + c) for r in range(6) for c in range(6)}
    df = cube(spark, [(DAY(2025, 1, 1), r, c, None if (r < 3 and c < 3 and r * 3 + c < 2) or (r < 3 <= c and r * 3 + c - 3 < 6 and r < 2) else v) for (r, c), v in values.items()])
    out = {(r.iy, r.ix): r.lst for r in binning.block_mean(df, 3, ["lst"], min_share=2 / 3, height=6, width=6).collect()}
    assert out[0, 0] is not None and out[0, 1] is None and out[1, 1] == np.mean([values[r, c] for r in range(3, 6) for c in range(3, 6)])
    with pytest.raises(ValueError):
        binning.block_mean(df, 1, ["lst"])


def scene(spark, factor=5, size=10, seed=1, slope=-12.0):
    """Fine NDVI and a coarse temperature that follows it, with noise from cell to cell."""
    rng = np.random.default_rng(seed)
    n = factor * size
    ndvi = 0.5 + 0.3 * np.sin(np.arange(n) / 7)[:, None] * np.cos(np.arange(n) / 5)[None] + rng.normal(0, 0.05, (n, n))
    fine = 40 + slope * ndvi + np.add.outer(np.arange(n), np.arange(n)) * 0.05
    coarse = fine.reshape(size, factor, size, factor).mean((1, 3))
    t = DAY(2025, 7, 1)
    f = cube(spark, [(t, int(r), int(c), float(ndvi[r, c])) for r in range(n) for c in range(n)], "scene timestamp, iy int, ix int, NDVI double")
    c = cube(spark, [(t, int(r), int(k), float(coarse[r, k])) for r in range(size) for k in range(size)])
    return f, c, fine, coarse


@pytest.mark.parametrize("correction", ["block", "smooth", "atpk"])
def test_sharpening_conserves(spark, correction):
    f, c, truth, coarse = scene(spark)
    spec = request.Downscaling(predictors=("NDVI",), model="linear", correction=correction, factor=5, min_samples=50)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    out = workflow.downscale_cube(c, f, spec, "lst", (10, 10))
    again = binning.block_mean(out, 5, ["lst_downscaled"]).withColumnRenamed("lst_downscaled", "b").join(c, ["scene", "iy", "ix"])
    error = again.select(F.max(F.abs(F.col("b") - F.col("lst"))).alias("m")).first().m
    assert error < (1e-6 if correction != "smooth" else 0.3)
    got = np.zeros_like(truth)
    for r in out.collect():
        got[r.iy, r.ix] = r.lst_downscaled
    flat = np.kron(coarse, np.ones((5, 5)))
    assert np.sqrt(((got - truth) ** 2).mean()) < np.sqrt(((flat - truth) ** 2).mean())


def test_smoothing_across_tiles_equals_whole_scene(spark):
    """Rounds on the fine grid of a scene wider than a tile, with gaps, against tiles with a halo."""
    height, width, factor, iterations = 7, neighbourhood.TILE + 9, 2, 4
    rng = np.random.default_rng(11)
    raw, coarse = rng.normal(20, 3, (height * factor, width * factor)), rng.normal(20, 3, (height, width))
    coarse[2, 5] = coarse[4, neighbourhood.TILE] = np.nan  # not observed
    raw[6, 2 * neighbourhood.TILE - 1] = np.nan  # not predicted
    t = DAY(2025, 7, 1)
    number = lambda v: None if np.isnan(v) else float(v)
    observed = cube(spark, [(t, r, c, number(coarse[r, c])) for r in range(height) for c in range(width)])
    predicted = cube(spark, [(t, r, c, number(raw[r, c])) for r in range(height * factor) for c in range(width * factor)], "scene timestamp, iy int, ix int, lst_downscaled double")
    out = downscale.conserve_smooth(predicted, observed, "lst", factor, height=height, width=width, iterations=iterations).collect()

    def up(field):
        place = lambda n: np.clip((np.arange(n * factor) + 0.5) / factor - 0.5, 0, n - 1)
        rows = np.array([np.interp(place(width), np.arange(width), row) for row in field])
        return np.array([np.interp(place(height), np.arange(height), column) for column in rows.T]).T

    now = raw.copy()
    total = np.zeros_like(raw)
    for _ in range(iterations):
        means = np.nanmean(now.reshape(height, factor, width, factor), axis=(1, 3))
        step = up(np.nan_to_num(coarse - means))
        now, total = now + step, total + step
    got = np.full_like(raw, np.nan)
    for r in out:
        got[r.iy, r.ix] = np.nan if r.lst_downscaled is None else r.lst_downscaled
    assert len(out) == raw.size
    np.testing.assert_allclose(got, now, atol=1e-9)


def test_local_trees_beat_one_line_on_two_regimes(spark):
    factor, size = 3, 20
    rng = np.random.default_rng(3)
    n = factor * size
    ndvi = rng.uniform(0.1, 0.9, (n, n))
    ndvi = np.kron(rng.uniform(0.1, 0.9, (size, size)), np.ones((factor, factor))) * 0.7 + ndvi * 0.3
    slope = np.where(np.arange(n) < n // 2, -20.0, 20.0)[None, :]
    truth = 30 + slope * ndvi
    coarse = truth.reshape(size, factor, size, factor).mean((1, 3))
    mean = ndvi.reshape(size, factor, size, factor).mean((1, 3))
    t = DAY(2025, 7, 1)
    train = cube(spark, [(t, r, c, float(coarse[r, c]), float(mean[r, c])) for r in range(size) for c in range(size)], "scene timestamp, iy int, ix int, lst double, NDVI double")
    fine = cube(spark, [(t, r, c, float(ndvi[r, c])) for r in range(n) for c in range(n)], "scene timestamp, iy int, ix int, NDVI double")
    out = trees.local_trees(train, fine, "lst", ["NDVI"], factor, (size, size)).collect()
    got = np.zeros_like(truth)
    for r in out:
        got[r.iy, r.ix] = r.lst_downscaled
    slope1, intercept = np.polyfit(mean.ravel(), coarse.ravel(), 1)
    assert np.sqrt(((got - truth) ** 2).mean()) < 0.6 * np.sqrt(((intercept + slope1 * ndvi - truth) ** 2).mean())


def test_linear_fit_equals_lstsq(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = 3 + x @ [1.5, -2.0, 0.25] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(DAY(2025, 1, 1), *map(float, (*a, b))) for a, b in zip(x, y)] + [(DAY(2025, 1, 1), None, 1.0, 1.0, 1.0)], "scene timestamp, a double, b double, c double, lst double")
    m = downscale.fit_linear(df, "lst", ["a", "b", "c"]).first()
    beta = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([m.b0, m.b1, m.b2, m.b3], beta) and m.samples == 200
    assert abs(m.residual_std - np.std(y - np.column_stack([np.ones(200), x]) @ beta, ddof=1)) < 1e-9
    same = df.withColumn("d", F.col("a") * 2)
    assert downscale.fit_linear(same, "lst", ["a", "d"]).count() == 0  # collinear
    assert downscale.fit_linear(df, "lst", ["a"], min_samples=500).count() == 0


def test_gaussian_gwr_follows_a_trend(spark):
    t = DAY(2025, 1, 1)
    rows = [(t, float(i), float(j), math.sin(i * j), (1 + i) * math.sin(i * j)) for i in range(12) for j in range(12)]
    train = spark.createDataFrame(rows, "scene timestamp, x double, y double, NDVI double, lst double")
    cells = spark.createDataFrame([(0, 0, 1.0, 6.0), (0, 1, 10.0, 6.0)], "iy int, ix int, x double, y double")
    for kernel in ("bisquare", "gaussian"):
        out = {r.ix: r.b1 for r in gwr.gwr(cells, train, "lst", ["NDVI"], bandwidth=2.5, kernel=kernel).collect()}
        assert 1 < out[0] < 4 and 9 < out[1] < 13


# --- time ----------------------------------------------------------------------------------------


def test_ties_edges_and_masks(spark):
    target = cube(spark, [(DAY(2025, 6, 10), 0, 0, 1.0), (DAY(2025, 6, 20), 0, 0, 2.0), (DAY(2025, 8, 1), 0, 0, 3.0)])
    rows = [(DAY(2025, 6, 21), 0, 0, 0.9, True), (DAY(2025, 6, 11), 0, 0, 0.1, True), (DAY(2025, 6, 9), 0, 0, 0.5, True)]
    features = cube(spark, rows, "scene timestamp, iy int, ix int, NDVI double, ok boolean")
    out = {r.scene.day: r for r in temporal.align(target, features, ["NDVI", "ok"], tolerance_us=86_400_000_000, name="s2").collect()}
    assert out[10].NDVI == 0.1 and out[10].s2_matched_time == DAY(2025, 6, 11)  # the later of two equally near
    assert out[20].NDVI == 0.9 and out[20].s2_time_delta_us == 86_400_000_000  # the tolerance counts
    assert out[1].NDVI is None and out[1].ok is False and out[1].s2_matched_time is None
    early = temporal.nearest_times(target, features, 86_400_000_000, tie="earlier").where("scene = '2025-06-10'").first()
    assert early.matched_time == DAY(2025, 6, 9)
    assert temporal.align(target, features.limit(0), ["NDVI", "ok"]).where("ok").count() == 0


def test_anchored_groups_and_mosaic(spark):
    minutes = [0, 4, 6, 9, 11, 30]
    tiles = spark.createDataFrame([(DAY(2025, 1, 1, 10, m), k, 0, 0, float(k) if k != 0 else None, k % 2 == 0) for k, m in enumerate(minutes)], "tile_time timestamp, rank int, iy int, ix int, v double, ok boolean")
    groups = temporal.pass_groups(tiles, 5 * 60_000_000)
    found = {r["rank"]: r.pass_time.minute for r in groups.collect()}
    assert found == {0: 0, 1: 0, 2: 6, 3: 6, 4: 6, 5: 30}
    m = {r.scene.minute: (r.v, r.ok) for r in temporal.mosaic(groups, ["v"], rank="rank", valid="ok").collect()}
    assert m == {0: (1.0, True), 6: (2.0, True), 30: (5.0, False)}


def test_forecast_prefers_short_leads(spark):
    rows = [(DAY(2025, 1, 1), h * 3_600_000_000, float(h)) for h in (0, 6, 12)] + [(DAY(2025, 1, 1, 6), h * 3_600_000_000, 100.0 + h) for h in (0, 6)]
    out = {r.valid_time.hour: r.v for r in temporal.freshest_forecast(spark.createDataFrame(rows, "run timestamp, lead_us long, v double"), ["v"]).collect()}
    assert out == {0: 0.0, 6: 100.0, 12: 106.0}


def test_merge_conflicts(spark):
    a, b = cube(spark, [(DAY(2025, 1, 1), 0, 0, 1.0)]), cube(spark, [(DAY(2025, 1, 1), 0, 0, 2.0)])
    with pytest.raises(Exception, match="conflicting"):
        temporal.merge_equal(a, b, ["lst"]).collect()
    assert temporal.merge_equal(a, a, ["lst"]).first().lst == 1.0


# --- neighbourhoods ----------------------------------------------------------------------------


def plane(spark, f, n=6):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(n) for c in range(n)], "iy int, ix int, z double")


@pytest.mark.parametrize("rise,aspect", [(lambda r, c: c * 10, 270), (lambda r, c: -c * 10, 90), (lambda r, c: -r * 10, 180), (lambda r, c: r * 10, 0)])
def test_slopes_of_planes(spark, rise, aspect):
    out = neighbourhood.slope_aspect(plane(spark, rise), "z", 100.0).collect()
    assert all(abs(r.slope - math.degrees(math.atan(0.1))) < 1e-9 and abs((r.aspect - aspect + 180) % 360 - 180) < 1e-9 for r in out)


def test_starfm_adds_a_uniform_change(spark):
    rng = np.random.default_rng(2)
    fine = rng.normal(300, 3, (7, 7))
    rows = [(DAY(2025, 1, 1), r, c, float(fine[r, c]) if (r, c) != (3, 3) else None, float(300 + r), float(305 + r)) for r in range(7) for c in range(7)]
    df = cube(spark, rows, "scene timestamp, iy int, ix int, fine0 double, coarse0 double, coarse1 double")
    out = neighbourhood.starfm(df, radius=2)
    assert out.where("not support").count() == 1 and out.where("support").count() == 48
    same = neighbourhood.starfm(df, radius=2, multiplier=1e-12).where("support").collect()
    assert all(abs(r.predicted - r.fine0 - 5) < 1e-6 for r in same)


def test_estarfm_uses_slopes(spark):
    rows = []
    for r in range(9):
        for c in range(9):
            gain = 2.0 if c < 4 else 0.5
            c0, c2, c1 = 10 + r + 0.1 * c, 14 + r * 1.3 + 0.1 * c, 12 + r
            base = 100 if c < 4 else 0
            rows.append((DAY(2025, 1, 1), r, c, base + gain * c0, c0, base + gain * c2, c2, float(c1)))
    df = cube(spark, rows, "scene timestamp, iy int, ix int, fine0 double, coarse0 double, fine2 double, coarse2 double, coarse1 double")
    out = neighbourhood.estarfm(df, radius=1, multiplier=0.5).where("support").collect()
    inner = [r for r in out if r.ix in (1, 2, 6, 7)]
    assert inner and all(abs(r.predicted - ((100 if r.ix < 4 else 0) + (2.0 if r.ix < 4 else 0.5) * r.coarse1)) < 1e-3 for r in inner)


def test_dilation_is_square(spark):
    df = cube(spark, [(DAY(2025, 1, 1), r, c, (r, c) == (4, 4)) for r in range(9) for c in range(9)], "scene timestamp, iy int, ix int, m boolean")
    out = {(r.iy, r.ix) for r in neighbourhood.grown(df.where("m"), 2).collect()}
    assert out == {(r, c) for r in range(2, 7) for c in range(2, 7)}


# --- spatial joins ------------------------------------------------------------------------------


def test_nearest_cell_outside_is_missing(spark):
    source = cube(spark, [(DAY(2025, 1, 1), r, c, float(r * 2 + c), True) for r in range(2) for c in range(2)], "scene timestamp, iy int, ix int, v double, ok boolean")
    targets = cube(spark, [(DAY(2025, 1, 1), 0, k, x) for k, x in enumerate([-0.1, 0.0, 1.0, 1.99, 2.0, 2.01])], "scene timestamp, iy int, ix int, x double")
    out = {r.ix: (r.v, r.ok) for r in spatial.nearest_cell(targets, source, F.col("x"), F.lit(-0.5), left=0.0, top=0.0, step=1.0, width=2, height=2, values=["v", "ok"]).collect()}
    assert out == {0: (None, False), 1: (0.0, True), 2: (1.0, True), 3: (1.0, True), 4: (1.0, True), 5: (None, False)}


def test_clipped_areas():
    square, diamond = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float), np.array([(1, 0), (2, 1), (1, 2), (0, 1)], float)
    cases = [(square, (1, 1, 3, 3), 1), (square, (5, 5, 6, 6), 0), (diamond, (0, 0, 1, 1), 0.5), (diamond, (-9, -9, 9, 9), 2), (diamond[::-1], (0, 0, 1, 1), 0.5), (square, (2, 0, 3, 1), 0)]
    areas = spatial.clipped_areas(np.array([c[0] for c in cases]), *(np.array([c[1][k] for c in cases], float) for k in range(4)))
    assert np.allclose(areas, [c[2] for c in cases])
    rng = np.random.default_rng(4)
    angles = np.sort(rng.uniform(0, 2 * np.pi, (40, 4)), 1)
    quads = np.stack([np.cos(angles), np.sin(angles)], 2)
    inside = lambda q, p: np.all([((q[(k + 1) % 4] - q[k])[0] * (p - q[k])[:, 1] - (q[(k + 1) % 4] - q[k])[1] * (p - q[k])[:, 0]) >= 0 for k in range(4)], 0)
    at = (np.arange(400) + 0.5) / 400 * 0.8 - 0.3  # the box -0.3..0.5
    grid = np.stack(np.meshgrid(at, at), -1).reshape(-1, 2)
    areas = spatial.clipped_areas(quads, *(np.full(40, v) for v in (-0.3, -0.3, 0.5, 0.5)))
    assert np.allclose(areas, [inside(q, grid).mean() * 0.64 for q in quads], atol=3e-3)


def test_area_weights_sum_to_the_quads(spark):
    rows = [(DAY(2025, 1, 1), *map(float, (x, y + 0.7, x + 0.7, y, x, y - 0.7, x - 0.7, y)), v) for x, y, v in ((2.3, -2.1, 1.0), (3.9, -3.2, 3.0))]
    names = ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]
    swath = spark.createDataFrame(rows, "scene timestamp, " + ", ".join(f"{n} double" for n in names) + ", value double")
    pieces = spatial.overlap_pieces(swath, left=0.0, top=0.0, step=1.0, width=6, height=6, corners=names, carry=["value"])
    assert abs(pieces.agg(F.sum("weight")).first()[0] - 2 * 0.98) < 1e-9
    out = binning.bin_weighted(pieces, "value", "weight")
    assert out.agg(F.sum(F.col("value") * F.col("coverage_fraction"))).first()[0] == pytest.approx(0.98 * 4)


# --- stations ------------------------------------------------------------------------------------


def test_idw_and_exact_hits(spark):
    sites = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate([0, 10, 20, 500])], "station_id long, x double, y double")
    at = spark.createDataFrame([(DAY(2025, 1, 1), k, v) for k, v in enumerate([1.0, 2.0, 4.0, 100.0])], "scene timestamp, station_id long, value double")
    cells = spark.createDataFrame([(0, 0, 10.0, 0.0), (0, 1, 5.0, 0.0), (0, 2, 490.0, 0.0)], "iy int, ix int, x double, y double")
    out = {r.ix: r for r in stations.interpolate(cells, sites, at, max_distance=50, min_neighbours=3).collect()}
    assert out[0].value == 2.0 and out[0].uncertainty == 0.0
    w = np.array([1 / 25, 1 / 25, 1 / 225, 1 / 495**2])
    assert abs(out[1].value - (w * [1, 2, 4, 100]).sum() / w.sum()) < 1e-9 and out[1].station_count == 3
    assert out[2].value is None and not out[2].valid


def test_collocation_keeps_every_station(spark):
    data = cube(spark, [(DAY(2025, 1, 1, h), 0, 0, 20.0 + h) for h in range(3)])
    sites = spark.createDataFrame([(1, 0, 0, True), (2, 0, 0, False)], "station_id long, r int, c int, inside boolean")
    readings = spark.createDataFrame([(1, DAY(2025, 1, 1, 0, 20), 21.0), (1, DAY(2025, 1, 1, 2, 50), 21.0), (2, DAY(2025, 1, 1), 1.0)], "station_id long, ts timestamp, value double")
    out = {r.station_id: r for r in stations.collocate(data, sites, readings, "lst", row=F.col("r"), col=F.col("c"), inside=F.col("inside")).collect()}
    assert out[1].samples == 3 and abs(out[1].mae - 2 / 3) < 1e-9
    assert out[2].samples == 0 and out[2].note == "outside the grid"


def test_station_json(spark):
    payload = json.dumps([{"parameter": {"name": "no2", "units": "ug"}, "value": 3.5, "period": {"datetimeFrom": {"local": "2025-01-01T10:00:00+02:00"}}}, {"parameter": {"name": "no2"}, "value": 4, "date": {"utc": "2025-01-01T08:00:00Z"}}])
    out = readers.station_readings(spark.createDataFrame([(7, payload)], "station_id long, payload string"))
    wide = stations.pivot_readings(out, ["no2"], order="ordinal").collect()
    assert len(wide) == 1 and wide[0].no2 == 4.0
    bad = spark.createDataFrame([(7, json.dumps([{"value": 1}]))], "station_id long, payload string")
    with pytest.raises(Exception, match="without a time"):
        readers.station_readings(bad).collect()


# --- catalogues, splits, quantiles -----------------------------------------------------------------


def products(spark, rows):
    return spark.createDataFrame(rows, "product_id string, start_ts timestamp, end_ts timestamp, online boolean, cloud double, coverage double")


def test_ranking_and_even_spread(spark):
    t = [DAY(2025, 1, d) for d in range(1, 9)]
    rows = [("a", t[0], t[0], False, 1.0, 1.0), ("b", t[1], t[1], True, None, 1.0), ("c", t[2], t[2], True, 5.0, None), ("d", t[3], t[3], True, 5.0, 0.2), ("e", t[4], t[4], True, 90.0, 1.0)]
    best = catalogue.best_products(products(spark, rows), 4, max_cloud=50).orderBy("rank")
    assert [r.product_id for r in best.collect()] == ["d", "c", "b", "a"]
    blind = [(f"p{k}", x, x, True, None, None) for k, x in enumerate(t)]
    assert [r.product_id for r in catalogue.best_products(products(spark, blind), 3).orderBy("rank").collect()] == ["p0", "p4", "p7"]  # 3.5 rounds to 4
    assert [r.product_id for r in catalogue.spread_in_time(products(spark, blind), 1).collect()] == ["p0"]


@pytest.mark.parametrize("limit", [1, 2, 7, 500])
def test_even_spread_over_days_equals_one_order(spark, limit):
    rng = random.Random(limit)
    rows = [(f"p{k:03}", rng.choice([None, *(DAY(2025, 1, d, h) for d in range(1, 5) for h in range(0, 24, 6))]), None, rng.choice([None, True, False]), None, None) for k in range(200)]
    expected = []
    for key in (None, True, False):
        own = sorted((r for r in rows if r[3] == key), key=lambda r: (r[1] is not None, r[1] or DAY(1, 1, 1), r[0]))
        places = sorted({round(i * (len(own) - 1) / (limit - 1)) for i in range(limit)} if limit > 1 else {0})
        expected += [(str(key), n + 1, own[p][0]) for n, p in enumerate(places)]
    out = catalogue.spread_in_time(products(spark, rows), limit, keys=["online"])
    assert sorted((str(r.online), r["rank"], r.product_id) for r in out.collect()) == sorted(expected)
    assert {"product_id", "rank"} <= set(out.columns) and len(out.columns) == 7
    alone = catalogue.spread_in_time(products(spark, rows[:50]), limit).count()
    assert alone == min(limit, 50)


def test_pairs_and_orbits(spark):
    day = dt.date(2025, 6, 30)
    at = lambda back: DAY(2025, 6, 30) - dt.timedelta(days=back)
    rows = [("x", at(1), at(1), True, 10.0, None), ("y", at(3), at(3), True, 10.0, None), ("z", at(5), at(5), True, 60.0, None), ("r", at(40), at(40), True, None, None), ("q", at(20), at(20), True, 0.0, None)]
    out = {r.role: r.product_id for r in catalogue.temporal_pair(products(spark, rows), day).collect()}
    assert out == {"detection": "x", "reference": "r"}
    names = ["S5P_NRTI_L2__NO2_20240101T000000_20240101T013000_00042_03", "S5P_OFFL_L2__NO2_20240101T000000_20240101T013000_00042_03", "odd"]
    df = spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")
    assert sorted(r.ordinal for r in catalogue.one_per_orbit(df).collect()) == [1, 2]


def test_split_and_quantile(spark):
    data = cube(spark, [(DAY(2025, 1, d + 1), r, c, 1.0) for d in range(10) for r in range(8) for c in range(8)])
    out = validation.blocked_split(data, block=4, period=2).groupBy("scene").agg(*(F.count_if(n).alias(n) for n in ("train", "validation", "calibration"))).orderBy("scene").collect()
    assert [r.train for r in out] == [32] * 8 + [0] * 2 and [r.validation for r in out] == [0] * 8 + [32] * 2 and out[0].calibration == 32
    rng = random.Random(1)
    for n in (1, 5, 57, 400):
        scores = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
        q = min(1.0, math.ceil((n + 1) * 0.9) / n)
        expected = np.quantile(scores, q, method="higher")
        got = validation.conformal_quantile(spark.createDataFrame([(s,) for s in scores], "s double"), "s").first()
        assert got.quantile == pytest.approx(expected) and got.samples == n


def test_metrics_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "e double, r double")
    m = validation.compare(df, "e", "r").first()
    assert m.samples == 2 and m.bias == -1.5 and m.correlation is None


# --- requests, contracts, stores -------------------------------------------------------------------


def test_request_round_trip_and_limits():
    r = request.Request(g.Area(13.2, 52.4, 13.5, 52.6), "2025-06-01", "2025-06-30", ("sentinel3", "sentinel2"), downscaling=request.Downscaling(("NDVI",), "linear"))
    assert request.Request.from_json(r.to_json()) == r and r.target_sensor == "sentinel3"
    assert [s.action for s in request.build_plan(r)][-2:] == ["fuse", "downscale"]
    request.check_limits(r)
    with pytest.raises(ValueError, match="area.*GiB"):
        request.check_limits(request.Request(g.Area(0, 0, 20, 20), "2025-06-01", "2025-06-30", ("sentinel2",), fine_resolution=10))
    with pytest.raises(ValueError):
        request.Request(g.Area(13.2, 52.4, 13.5, 52.6), "2025-07-01", "2025-06-30", ("sentinel3",))
    assert request.parse_bound("2025-01-01", end=True) == DAY(2025, 1, 1, 23, 59, 59, 999999)
    assert request.parse_bound("2025-01-01T02:00:00+02:00") == DAY(2025, 1, 1)


def test_execute_with_adapters(spark, tmp_path, monkeypatch):
    f, c, *_ = scene(spark)
    later = f.withColumn("scene", F.col("scene") + F.expr("interval 1 day"))
    items = spark.createDataFrame([("p1", DAY(2025, 7, 1), DAY(2025, 7, 1, 1), True, 1.0, 1.0, s) for s in ("sentinel3", "sentinel2")], "product_id string, start_ts timestamp, end_ts timestamp, online boolean, cloud double, coverage double, sensor string")
    monkeypatch.setattr(workflow, "ADAPTERS", {"sentinel3": lambda s, p, r: c, "sentinel2": lambda s, p, r: later})
    r = request.Request(g.Area(13.2, 52.4, 13.5, 52.6), "2025-06-01", "2025-07-30", ("sentinel3", "sentinel2"), downscaling=request.Downscaling(("NDVI",), "linear", factor=5, min_samples=50))
    out = workflow.execute(spark, r, items, shape=(10, 10))
    means = {(x.iy, x.ix): x.m for x in f.groupBy(F.expr("iy div 5").alias("iy"), F.expr("ix div 5").alias("ix")).agg(F.avg("NDVI").alias("m")).collect()}
    fused = {(x.iy, x.ix): x.NDVI for x in out.fused.collect()}
    assert fused == pytest.approx(means) and len(fused) == 100 and out.downscaled.count() == 2500
    out.save(f"file://{tmp_path}/result", r)
    assert request.Request.from_json((tmp_path / "result/request.json").read_text()) == r
    assert spark.read.parquet(f"file://{tmp_path}/result/downscaled").count() == 2500
    files = sinks.manifest(spark, f"file://{tmp_path}/result/fused")
    assert files.count() > 0 and sinks.changed_files(files, files).count() == 0
    with pytest.raises(ValueError, match="nest"):
        request.Request(r.area, r.start, r.end, r.sensors, fine_resolution=100.0, downscaling=r.downscaling)
    wrong = workflow.on_grid(later, r.grid())
    with pytest.raises(ValueError, match="is needed"):
        workflow.run({"sentinel3": c, "sentinel2": wrong}, r, shape=(10, 10))


def test_contracts(spark):
    df = contracts.attach(cube(spark, [(DAY(2025, 1, 1), 0, 0, 300.0)]), "sentinel3")
    assert df.schema["lst"].metadata["units"] == "K"
    contracts.validate(df)
    contracts.validate_cube(df, ["lst"])
    with pytest.raises(ValueError):
        contracts.validate_cube(df, ["missing"])
    with pytest.raises(ValueError):
        contracts.same_units(df, sc.to_celsius(df))
    assert sc.to_celsius(sc.to_celsius(df)).first().lst == pytest.approx(26.85)


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/cube"
    data = cube(spark, [(DAY(2025, 1, d), 0, 0, float(d)) for d in (1, 2)])
    sinks.write_cube(data, path)
    sinks.append_scene(cube(spark, [(DAY(2025, 1, 3, 4, 5, 6, 789), 0, 0, None)]), path)
    back = readers.open_cube(spark, path, ["scene", "lst"])
    assert {(r.scene, r.lst) for r in back.collect()} == {(DAY(2025, 1, 1), 1.0), (DAY(2025, 1, 2), 2.0), (DAY(2025, 1, 3, 4, 5, 6, 789), None)}
    stats = spark.createDataFrame([(DAY(2025, 1, 1), 0, 1.5), (DAY(2025, 1, 2), 0, float("inf"))], "scene timestamp, zone int, mean double")
    zones = spark.createDataFrame([(0, 'a"b', '{"type":"Point"}')], "zone int, zone_id string, geometry string")
    feature = json.loads(sinks.zonal_geojson(stats, zones, "mean").first().feature)
    assert feature["properties"] == {"id": 'a"b', "mean_2025-01-01T00:00": 1.5, "mean_2025-01-02T00:00": None}
    assert len(sinks.request_key({"b": 1, "a": [2]})) == 20 and sinks.request_key({"a": [2], "b": 1}) == sinks.request_key({"b": 1, "a": [2]})
    with pytest.raises(ValueError):
        sinks.AuxiliarySpec("era5", "x", options=(("api_key", "1"),))
    assert sinks.safe_attributes({"a": None, "b": True, "c": [1], "d": dt.date(2025, 1, 1)}) == {"b": 1, "c": [1], "d": "2025-01-01"}


def test_variable_discovery():
    known = [("LST", "land surface temperature"), ("T_air", "air temperature"), ("x", "")]
    assert readers.best_variable(known, ["air temperature", "temperature"]) == "T_air" and readers.best_variable(known, ["humidity"]) is None
    with pytest.raises(ValueError, match="2 masks for 3"):
        sc.flag_table([1, 2], "a b c")
    table = sc.flag_table([1, 2, 4, 64], "Thin_Cirrus land fog_low cloud")
    assert table == {"thin_cirrus": 1, "land": 2, "fog_low": 4, "cloud": 64} and sc.bits_about(table) == 69 and sc.bits_about(table, ["LAND"]) == 2 and sc.bits_about(table, ["ice"]) == 0


def test_stream_equals_batch(spark, tmp_path):
    from geoloom.streaming import arrivals

    rows = [(DAY(2025, 1, 1 + k % 3, k), 0, k % 2, float(k), f"p{k % 5}") for k in range(12)] + [(DAY(2025, 2, 1), 0, 0, 0.0, "end"), (DAY(2025, 2, 2), 0, 0, 0.0, "end2")]
    data = spark.createDataFrame(rows, "ts timestamp, iy int, ix int, lst double, product_id string")
    data.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"file://{tmp_path}/in")
    q = arrivals.daily_composite(stream, "lst", late="1 hour").writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.day, r.ix): r.valid_count for r in spark.table("daily").collect()}
    expected = {(r.day, r.ix): r.n for r in data.where("ts < '2025-01-20'").groupBy(F.date_trunc("day", "ts").alias("day"), "ix").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in got.items() if k in expected} == expected


def test_resampling_policy():
    assert spatial.resampling_for("cloud_mask", "double", 10, 100) == "nearest" and spatial.resampling_for("NDVI", "double", 10, 100) == "mean"
    assert spatial.resampling_for("NDVI", "double", 100, 10) == "nearest" and spatial.resampling_for("NDVI", "double", 10, 100, {"NDVI": "nearest"}) == "nearest"


def test_any_estimator(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(float(k), 3.0 + 2.0 * k) for k in range(20)] + [(None, 1.0)], "x double, y double")
    fitted, spread = downscale.fit_estimator(df, "y", ["x"], LinearRegression())
    assert spread < 1e-6 and abs(fitted.transform(df.where("x = 7")).first().prediction - 17) < 1e-6


def test_conformal_covers(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(0.5, 2), 0.0) for _ in range(600)]
    rows = [(s, rng.gauss(0, s), 0.0) for s, _ in rows]
    df = spark.createDataFrame(rows, "spread double, e double, r double")
    model = validation.fit_conformal(df, "e", "r", spread="spread")
    out = validation.conformal_interval(df, model, "e", spread="spread")
    share = out.agg(F.avg(F.col("r").between(F.col("e_lower"), F.col("e_upper")).cast("int"))).first()[0]
    assert 0.88 < share < 0.93
    with pytest.raises(ValueError):
        validation.fit_conformal(df.limit(5), "e", "r")


def test_cached_tables_are_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached(spark, f"file://{tmp_path}", {"aoi": 1}, make).count() == 3
    assert len(calls) == 1


def test_command_line(tmp_path, capsys):
    from geoloom.__main__ import main

    path = tmp_path / "r.json"
    path.write_text(request.Request(g.Area(13.2, 52.4, 13.5, 52.6), "2025-06-01", "2025-06-30", ("sentinel3",)).to_json())
    assert main(["plan", str(path)]) == 0 and "discover" in capsys.readouterr().out
    assert main(["check", str(path)]) == 0
    path.write_text(request.Request(g.Area(0, 0, 30, 30), "2025-06-01", "2025-06-30", ("sentinel3",)).to_json())
    assert main(["check", str(path)]) == 1
