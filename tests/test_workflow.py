"""Adapters, resampling, searches and the command line on small made tables."""

import datetime as dt
import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import __main__ as cli
from geoloom.functions import projection
from geoloom.grid import Area, Grid
from geoloom.operators import binning, catalogue, downscale, resample, temporal, validation
from geoloom.plans import workflow
from geoloom.plans.request import MODELS, Downscaling, Request
from geoloom.sources import readers, sinks

DAY = dt.datetime
BOX = Area(13.30, 52.45, 13.36, 52.49)


def request_for(sensors, **kw):
    return Request(BOX, "2024-05-01", "2024-05-31", sensors, resolution=1000.0, **kw)


def places(n=12):
    return [(BOX.west + (BOX.east - BOX.west) * (i + 0.5) / n, BOX.south + (BOX.north - BOX.south) * (j + 0.5) / n) for i in range(n) for j in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    """A scene of every sensor, two of them of no use, and a product far away."""
    t = DAY(2024, 5, 10, 10)
    made = lambda rows, ddl: spark.createDataFrame(rows, "product_id string, scene timestamp, lon double, lat double, " + ddl)
    at = places()
    return {
        "sentinel3": made([("p3", t, x, y, 300.0 + k % 5, 0, k == 3) for k, (x, y) in enumerate(at)] + [("other", t, *at[0], 999.0, 0, False), ("p3", t, 20.0, 52.4, 999.0, 0, False)], "lst double, exception_flags long, cloud_mask boolean"),
        "sentinel2": made([("p2", t, x, y, 1000 + k, 1200, 1500, 4000, 2500, 2000, 8 if k == 0 else 4, "5.09") for k, (x, y) in enumerate(at)], "B02 int, B03 int, B04 int, B08 int, B11 int, B12 int, SCL int, baseline string"),
        "sentinel1": made([("p1", t, x, y, 0.1, 0.02) for x, y in at], "VV double, VH double"),
        "sentinel5p": made([("p5", t, x, y, 2.0, 0.9 if k else 0.1) for k, (x, y) in enumerate(at)], "NO2 double, qa double"),
        "landsat": made([("pl", t, x, y, 44000, 0 if k else 1) for k, (x, y) in enumerate(at)], "dn int, qa_pixel long"),
        "ecostress": made([("pe", t, x, y, 301.0, 0 if k else 1) for k, (x, y) in enumerate(at)], "lst double, cloud int"),
    }


def products_of(spark, tables):
    ids = {"sentinel3": "p3", "sentinel2": "p2", "sentinel1": "p1", "sentinel5p": "p5", "landsat": "pl", "ecostress": "pe"}
    rows = [(i, s, DAY(2024, 5, 10, 10), DAY(2024, 5, 10, 11), True, 5.0, 1.0) for s, i in ids.items() if s in tables]
    return spark.createDataFrame(rows, "product_id string, sensor string, start_ts timestamp, end_ts timestamp, online boolean, cloud double, coverage double")


def test_six_adapters(spark, tables):
    registry = {}
    workflow.register_tables(tables, registry)
    grid = request_for(("sentinel3",)).grid()
    cells = {}
    for x, y in places():
        u, v = projection.project_point(x, y, grid.crs)
        cells.setdefault((int((grid.top - v) // 1000), int((u - grid.left) // 1000)), []).append((x, y))
    products = products_of(spark, tables)
    found = {s: {(r.iy, r.ix): r for r in registry[s](spark, workflow.discover(products, request_for((s,)), s), request_for((s,))).collect()} for s in tables}
    for s, rows in found.items():
        assert set(rows) == set(cells), s
    number = {p: k for k, p in enumerate(places())}
    for cell, own in cells.items():
        ks = [number[p] for p in own]
        assert found["sentinel3"][cell].lst == pytest.approx(np.mean([26.85 + k % 5 for k in ks if k != 3]))
        assert found["sentinel1"][cell].RVI == pytest.approx(4 * 0.02 / 0.12) and found["sentinel5p"][cell].NO2 == 2.0
        assert found["landsat"][cell].lst == pytest.approx(44000 * 0.00341802 + 149 - 273.15) and found["ecostress"][cell].lst == pytest.approx(27.85)
        assert found["sentinel2"][cell].NDVI == pytest.approx((0.3 - 0.05) / (0.3 + 0.05))
        assert found["landsat"][cell].lst_observation_count == len([k for k in ks if k])


def test_failing_products_are_named_and_left_out(spark, tables, monkeypatch):
    monkeypatch.setattr(workflow, "ADAPTERS", {})
    t = tables["sentinel2"].withColumn("B08", F.col("B08").cast("string"))
    more = [t.withColumn("product_id", F.lit(p)) for p in ("good", "bad", "late")]
    more[1] = more[1].withColumn("B08", F.when(F.col("B02") == 1003, "x17").otherwise(F.col("B08")))
    more[2] = more[2].withColumn("scene", F.when(F.col("B02") != 1005, F.col("scene")))
    workflow.register_tables({**tables, "sentinel2": t.unionByName(more[0]).unionByName(more[1]).unionByName(more[2])})
    request = request_for(("sentinel3", "sentinel2", "sentinel1"))
    products = products_of(spark, tables)
    own = products.where("sensor = 'sentinel2'")
    for p in ("good", "bad", "late", "gone"):
        products = products.unionByName(own.withColumn("product_id", F.lit(p)))
    out = workflow.execute(spark, request, products)
    failed = {f["product"]: f["error"] for f in out.provenance["failed_products"]}
    assert failed == {"bad": "B08 is no number: x17", "late": "no time", "gone": "no pixels"} and not out.provenance["errors"]
    assert out.fused.where("NDVI is not null").count() > 0 and "sigma0_VV" in out.fused.columns
    # all of one sensor: that sensor is left out; told to raise, or of the target: an error
    workflow.register_tables({"sentinel2": more[1], "sentinel1": tables["sentinel1"].drop("VH")})
    out = workflow.execute(spark, request, products)
    assert set(out.provenance["errors"]) == {"sentinel1", "sentinel2"} and "x17" in out.provenance["errors"]["sentinel2"] and "no VH" in out.provenance["errors"]["sentinel1"]
    assert "NDVI" not in out.fused.columns and out.fused.count() > 0
    with pytest.raises(Exception, match="no VH"):
        workflow.execute(spark, request_for(("sentinel3", "sentinel1"), on_product_error="raise"), products)
    workflow.register_tables({"sentinel3": tables["sentinel3"].drop("lst")})
    with pytest.raises(RuntimeError, match="target"):
        workflow.execute(spark, request, products)


def test_clear_products_are_chosen_by_their_flags(spark, tables, tmp_path):
    whole = tables["sentinel3"].where("product_id = 'p3' and lon < 14")
    share = {"a": 0.0, "b": 0.9, "c": 0.6, "d": 1.0}
    rows = [whole.withColumn("product_id", F.lit(p)).withColumn("cloud_mask", F.col("lat") >= BOX.south + (BOX.north - BOX.south) * s) for p, s in share.items()]
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    path = f"file://{tmp_path}/raw"
    table.write.partitionBy().parquet(path)
    registry = {}
    workflow.register_tables({"sentinel3": spark.read.parquet(path)}, registry)
    products = spark.createDataFrame([(p, "sentinel3", DAY(2024, 5, 10, k), DAY(2024, 5, 10, k), True, float(k), 1.0) for k, p in enumerate([*share, "far"])], "product_id string, sensor string, start_ts timestamp, end_ts timestamp, online boolean, cloud double, coverage double")
    request = request_for(("sentinel3",), min_clear_fraction=0.5, limit=2)
    notes = workflow.Notes()
    cube = workflow.acquire(spark, registry["sentinel3"], products, request, "sentinel3", notes)
    judged = {r.product_id: r for r in notes.probed["sentinel3"].collect()}
    assert {p for p, r in judged.items() if r.accepted} == {"b", "c"}  # d is clearer, but ranks after them
    assert {p: r.clear_fraction and round(r.clear_fraction, 1) for p, r in judged.items()} == {"a": 0.0, "b": 0.9, "c": 0.6, "d": 1.0, "far": None}
    # ids are a filter of the scan that reads values; the probe reads no values
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "In(product_id, [b,c])" in plan
    probe = notes.probed["sentinel3"]._jdf.queryExecution().executedPlan().toString()
    assert "exception_flags" not in probe and "cloud_mask" in probe
    known = spark.createDataFrame([("b", 0.1), ("other", 1.0)], "product_id string, clear_fraction double")
    again = workflow.Notes(known)
    workflow.acquire(spark, registry["sentinel3"], products, request, "sentinel3", again)
    assert {r.product_id for r in again.probed["sentinel3"].where("accepted").collect()} == {"c", "d"}


def test_auxiliary_data_join_the_run(spark, tables, monkeypatch):
    monkeypatch.setattr(workflow, "ADAPTERS", {})
    monkeypatch.setattr(workflow, "PROVIDERS", {})
    workflow.register_tables(tables)
    rows = [(DAY(2024, 5, 10, 11), lat, lon % 360, 280.0 + lat + lon) for lat in (52.25, 52.5, 52.75) for lon in (13.0, 13.25, 13.5)]
    workflow.register_provider("era5", spark.createDataFrame(rows, "valid_time timestamp, latitude double, longitude double, t2m double"))
    request = request_for(("sentinel3",), auxiliary=(sinks.AuxiliarySpec("era5", "hourly", ("temperature_2m",)),))
    assert Request.from_json(request.to_json()) == request
    out = {(r.iy, r.ix): r.temperature_2m for r in workflow.execute(spark, request, products_of(spark, tables)).fused.collect()}
    grid = request.grid()
    for (iy, ix), v in out.items():
        lon, lat = projection.unproject_point(grid.left + (ix + 0.5) * 1000, grid.top - (iy + 0.5) * 1000, grid.crs)
        assert v == pytest.approx(280 + round(lat * 4) / 4 + round(lon * 4) / 4)
    assert len(out) > 10


def swaths(spark, factor, n=1):
    """Raw pixels of two sensors, one a fine cell of the predictors, whose truth is known."""
    request = Request(Area(13.25, 52.43, 13.45, 52.55), "2024-05-01", "2024-05-31", ("sentinel3", "sentinel2"), resolution=1000.0, downscaling=Downscaling(("NDVI",), "linear", factor=factor, min_samples=50))
    grid = request.grid_of("sentinel2")
    rng = np.random.default_rng(1)
    red = np.clip(rng.uniform(0.05, 0.3, (grid.height, grid.width)) + 0.1 * np.sin(np.arange(grid.width) / 7), 0.02, 0.5)
    ndvi = (0.4 - red) / (0.4 + red)
    places = [(iy, ix, *projection.unproject_point(grid.left + (ix + 0.5) * grid.resolution, grid.top - (iy + 0.5) * grid.resolution, grid.crs)) for iy in range(grid.height) for ix in range(grid.width)]
    t, later = DAY(2024, 5, 10, 10), DAY(2024, 5, 11, 10)
    thermal = spark.createDataFrame([("p3", t, x, y, 300.0 - 8 * float(ndvi[i, j]), 0) for i, j, x, y in places], "product_id string, scene timestamp, lon double, lat double, lst double, exception_flags long")
    optical = spark.createDataFrame([("p2", later, x, y, float(red[i, j]) * 1e4 + 1000, 5000.0, "5.09") for i, j, x, y in places], "product_id string, scene timestamp, lon double, lat double, B04 double, B08 double, baseline string")
    return request, {"sentinel3": thermal, "sentinel2": optical}, ndvi


@pytest.mark.parametrize("model", MODELS)
def test_from_raw_swaths_to_a_sharpened_cube(spark, monkeypatch, model):
    factor = 4
    request, raw, ndvi = swaths(spark, factor)
    request = replace(request, downscaling=Downscaling(("NDVI",), model, factor=factor))  # the defaults: 100 samples, 10 of them near
    monkeypatch.setattr(workflow, "ADAPTERS", {})
    workflow.register_tables(raw)
    out = workflow.execute(spark, request, products_of(spark, raw))
    grid = request.grid()
    assert ndvi.shape == (grid.height * factor, grid.width * factor)
    means = ndvi.reshape(grid.height, factor, grid.width, factor).mean((1, 3))
    fused = {(r.iy, r.ix): r for r in out.fused.collect()}
    inner = [(i, j) for i in range(1, grid.height - 1) for j in range(1, grid.width - 1)]
    assert all(fused[k].NDVI == pytest.approx(means[k], abs=1e-9) and fused[k].lst == pytest.approx(26.85 - 8 * means[k], abs=1e-6) for k in inner)
    sharp = {(r.iy, r.ix): r.lst_downscaled for r in out.downscaled.collect()}
    got = np.array([[sharp.get((i, j), np.nan) for j in range(ndvi.shape[1])] for i in range(ndvi.shape[0])], float)
    assert np.isfinite(got).mean() > 0.99
    error = np.sqrt(np.nanmean((got - (26.85 - 8 * ndvi)) ** 2))
    coarse = np.kron(26.85 - 8 * means, np.ones((factor, factor)))
    assert error < 0.8 * np.sqrt(np.mean((coarse - (26.85 - 8 * ndvi)) ** 2))  # fine predictors are held to the range of coarse ones


def test_every_model_and_correction_conserves(spark):
    rng = np.random.default_rng(3)
    n, factor = 8, 3
    fine = rng.uniform(size=(n * factor, n * factor, 2))
    t = DAY(2024, 5, 10)
    f = spark.createDataFrame([(t, i, j, float(fine[i, j, 0]), float(fine[i, j, 1])) for i in range(n * factor) for j in range(n * factor)], "scene timestamp, iy int, ix int, a double, b double")
    truth = 20 + 5 * fine[..., 0] - 3 * fine[..., 1]
    coarse = truth.reshape(n, factor, n, factor).mean((1, 3)) + rng.normal(0, 0.05, (n, n))
    c = spark.createDataFrame([(t, i, j, float(coarse[i, j])) for i in range(n) for j in range(n)], "scene timestamp, iy int, ix int, lst double")
    for model, correction in [*((m, "block") for m in MODELS), ("linear", "smooth"), ("linear", "atpk")]:
        spec = Downscaling(("a", "b"), model=model, correction=correction, factor=factor, min_samples=20)
        out = workflow.downscale_cube(c, f, spec, "lst", (n, n)).collect()
        got = np.full(truth.shape, np.nan)
        for r in out:
            got[r.iy, r.ix] = r.lst_downscaled
        assert np.isfinite(got).all(), model
        means = got.reshape(n, factor, n, factor).mean((1, 3))
        assert np.abs(means - coarse).max() < (0.2 if correction == "smooth" else 1e-9), (model, correction)
        if model != "tsharp":
            assert np.sqrt(((got - truth) ** 2).mean()) < np.std(truth - np.kron(coarse, np.ones((factor, factor)))), model


def test_to_grid_and_policies(spark):
    a, b = Grid("EPSG:32633", 0.0, 400.0, 100.0, 4, 4), Grid("EPSG:32633", 0.0, 400.0, 200.0, 2, 2)
    rows = [(i, j, float(i * 4 + j), (i + j) % 2 == 0) for i in range(4) for j in range(4) if (i, j) != (0, 0)]
    cube = spark.createDataFrame(rows, "iy int, ix int, v double, ok_mask boolean").withColumn("scene", F.lit(DAY(2024, 1, 1)))
    assert resample.to_grid(cube, a, Grid("EPSG:32633", 0.0, 400.0, 100.0, 4, 4, "same"), ["v"]) is cube
    out = {(r.iy, r.ix): r for r in resample.to_grid(cube, a, b, ["v", "ok_mask"]).collect()}
    assert out[0, 0].v == pytest.approx((1 + 4 + 5) / 3) and out[1, 1].v == pytest.approx((10 + 11 + 14 + 15) / 4) and out[0, 1].ok_mask is True
    up = {(r.iy, r.ix): r.v for r in resample.resample(cube, a, Grid("EPSG:32633", 0.0, 400.0, 50.0, 8, 8), ["v"], "bilinear").collect()}
    assert up[4, 4] == pytest.approx(0.75**2 * 10 + 0.75 * 0.25 * (9 + 6) + 0.25**2 * 5) and up[0, 0] is None if (0, 0) in up else True
    with pytest.raises(ValueError):
        resample.resample(cube, a, b, ["v"], "cubic")


def test_item_search(spark):
    rows = [("s2", DAY(2024, 5, 1), {"cloud": "10.5", "kind": "a"}), ("s2", DAY(2024, 5, 2, 23, 59, 59), {"cloud": "9"}), ("s2", DAY(2024, 5, 3), {"kind": "b"}), ("l8", DAY(2024, 5, 2), {"cloud": "0"})]
    items = spark.createDataFrame([(k, c, t, 10.0 + k, 50.0, 11.0 + k, 51.0, p) for k, (c, t, p) in enumerate(rows)], "k int, collection string, datetime timestamp, west double, south double, east double, north double, properties map<string,string>")
    ids = lambda **kw: sorted(r.k for r in catalogue.search_items(items, **kw).collect())
    assert ids(collections=["s2"], end="2024-05-02") == [0, 1] and ids(query={"cloud": {"lt": 10}}) == [1, 3]
    assert ids(query={"kind": {"eq": "a"}}) == [0] and ids(box=(11.5, 0, 12.5, 90)) == [1, 2] and ids(start="2024-05-02T12:00:00") == [1, 2]


def test_gridded_products_and_inspection(spark):
    raw = spark.createDataFrame([(52.5, 350.0, DAY(2024, 1, 1), DAY(2024, 1, 2), float("nan"), 1.0)], "latitude double, longitude double, time timestamp, valid_time timestamp, t2m double, no2 double")
    out = readers.normalise_gridded(raw, {**readers.ERA5_NAMES, **readers.CAMS_NAMES}).first()
    assert (out.lat, out.lon, out.scene, out.temperature_2m, out.nitrogen_dioxide) == (52.5, -10.0, DAY(2024, 1, 2), None, 1.0)
    assert readers.snapped_box((13.2, 52.4, 13.55, 52.58), 0.75) == (12.75, 51.75, 14.25, 53.25)
    assert ("t2m", "double", None) in readers.inspect_table(raw)


def test_acquisitions_and_attributes(spark, tmp_path):
    t = DAY(2024, 1, 1)
    rows = [("a", t, 0, 0, 1.0, 2), ("b", t, 0, 0, 9.0, 5), ("b", t, 0, 1, 3.0, 1), ("c", DAY(2024, 1, 2), 0, 0, 4.0, 1)]
    g = spark.createDataFrame(rows, "product_id string, scene timestamp, iy int, ix int, lst double, n int")
    out = temporal.combine_acquisitions(g, "n")
    assert sorted((r.scene.day, r.ix, r.lst) for r in out.collect()) == [(1, 0, 9.0), (1, 1, 3.0), (2, 0, 4.0)]
    sinks.write_cube(out, f"file://{tmp_path}/cube", attributes={"crs": "EPSG:32633", "none": None, "flag": True, "at": t})
    assert json.loads((tmp_path / "cube" / "_attributes.json").read_text()) == {"at": str(t), "crs": "EPSG:32633", "flag": 1}
    assert spark.read.parquet(f"file://{tmp_path}/cube").count() == 3


def test_gas_on_edges_and_methane(spark):
    t = DAY(2024, 1, 1)
    pixels = spark.createDataFrame([(t, 1, 0.0, 2.0, 1.0, True), (t, 2, 2.0, 0.0, 5.0, True), (t, 3, 1.0, 1.0, 7.0, True), (t, 4, 0.5, 1.5, 100.0, False)], "scene timestamp, pixel_id int, lon double, lat double, value double, valid boolean")
    cells = spark.createDataFrame([(t, i, j, j + 0.5, 1.5 - i) for i in range(2) for j in range(2)], "scene timestamp, iy int, ix int, lon double, lat double")
    out = {(r.iy, r.ix): (r.value, r.filled) for r in binning.gridded_gas(pixels, cells, left=0.0, top=2.0, step=1.0, width=2, height=2, radius_km=85.0, mid_lat=1.0).collect()}
    assert out == {(0, 0): (1.0, False), (1, 1): (5.0, False), (0, 1): (7.0, False), (1, 0): (7.0, True)}
    p = spark.createDataFrame([(s, 0, k, float(k + 1), (k + 1) * (0.5 if s else 0.4) - (0.1 if s and k == 1 else 0)) for s in (0, 1) for k in range(3)], "scene int, iy int, ix int, B11 double, B12 double")
    signal = binning.methane_ratio(p, ["scene"])
    change = {r.ix: r.mbmp for r in binning.methane_change(signal.where("scene = 1"), signal.where("scene = 0")).collect()}
    assert min(change, key=change.get) == 1 and all(abs(r.mbsp) < 1e-12 for r in signal.where("scene = 0").collect())


def test_command_line(spark, tables, tmp_path, capsys):
    products_of(spark, tables).write.parquet(f"file://{tmp_path}/products")
    (tmp_path / "r.json").write_text(request_for(("sentinel3", "landsat")).to_json())
    assert cli.main(["discover", str(tmp_path / "r.json"), f"file://{tmp_path}/products"]) == 0
    assert [json.loads(x)["product_id"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["p3", "pl"]
    assert cli.main(["auxiliary", "cams", "reanalysis", "no2"]) == 0 and len(capsys.readouterr().out.strip()) == 20


def test_a_request_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(workflow, "ADAPTERS", {})
    request, raw, _ = swaths(spark, 3)
    for sensor, table in raw.items():
        table.write.parquet(f"file://{tmp_path}/raw/{sensor}")
    products_of(spark, raw).write.parquet(f"file://{tmp_path}/products")
    (tmp_path / "r.json").write_text(request.to_json())
    assert cli.main(["request", str(tmp_path / "r.json"), f"file://{tmp_path}/products", f"file://{tmp_path}/raw", f"file://{tmp_path}/out"]) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said == {"target": "sentinel3", "sensors": ["sentinel3", "sentinel2"], "errors": {}, "failed_products": []}
    assert spark.read.parquet(f"file://{tmp_path}/out/downscaled").where("lst_downscaled is not null").count() > 1000
    assert json.loads((tmp_path / "out/provenance.json").read_text())["target"] == "sentinel3"


def test_area_links_conserve(spark):
    a = Grid("EPSG:32633", 380_000.0, 5_830_000.0, 900.0, 8, 7)
    for b in (Grid("EPSG:32632", 786_000.0, 5_846_000.0, 1100.0, 12, 14), Grid("EPSG:3857", 1_466_000.0, 6_925_000.0, 1500.0, 24, 24)):
        links = resample.links(spark, a, b, "area").collect()
        sums = {}
        for r in links:
            sums[r._iy, r._ix] = sums.get((r._iy, r._ix), 0.0) + r._w
        assert len(sums) == a.width * a.height and len(links) > len(sums)
        for (iy, ix), got in sums.items():
            lonlat = [projection.unproject_point(a.left + (ix + dx) * a.resolution, a.top - (iy + dy) * a.resolution, a.crs) for dy, dx in ((0, 0), (0, 1), (1, 1), (1, 0))]
            p = [projection.project_point(*q, b.crs) for q in lonlat]
            p = [(u - p[0][0], v - p[0][1]) for u, v in p]
            assert got == pytest.approx(abs(sum(p[k][0] * p[(k + 1) % 4][1] - p[(k + 1) % 4][0] * p[k][1] for k in range(4))) / 2, rel=1e-9)


def test_long_projections_compile(spark):
    """No stage falls back to slow code: with the fallback off, one whose code is too long would fail."""
    from geoloom.plans import queries

    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("area_gridding", "adapter_sentinel1", "utm_round_trip"):
            queries.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_raw_layouts(spark):
    raw = spark.createDataFrame([("p", 1, 2, 52.0, 13.0, 300.0, float("inf"), "x")], "product_id string, scan_row int, scan_col int, lat double, lon double, LST double, err double, extra string")
    assert readers.best_variable([("LST", "surface temperature"), ("err", "temperature error")], ["lst", "error"]) == "LST"
    out = readers.thermal_pixels(raw, {"LST": "lst", "err": "lst_uncertainty", "absent": "ndvi"})
    assert out.columns == ["product_id", "scan_row", "scan_col", "lat", "lon", "lst", "lst_uncertainty"] and out.schema["lst"].metadata == {"units": "K"}
    assert (out.first().lst, out.first().lst_uncertainty) == (300.0, None)
    toa = readers.top_of_atmosphere(spark.createDataFrame([(2000, 0, 4.0), (2000, 500, 3.1)], "B11 int, B12 int, baseline double"), ["B11", "B12"]).collect()
    assert [(r.B11, r.B12) for r in toa] == [(0.1, None), (0.2, 0.05)]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": k}, "geometry": {"type": "Polygon", "coordinates": [[[k, 0], [k + 1, 0], [k, 1]]]}} for k in (3, 4)]})
    ids, rings, _ = readers.zones_from_geojson(text)
    assert ids == ["3", "4"] and rings[1][0][0] == (4.0, 0.0)
    with pytest.raises(ValueError):
        readers.zones_from_geojson(text.replace('"id": 4', '"id": 3'))


def test_reports(spark):
    t = DAY(2024, 1, 1)
    a = spark.createDataFrame([(t, 0, k, float(k)) for k in range(5)], "scene timestamp, iy int, ix int, lst double")
    b = spark.createDataFrame([(t, 0, k, float(k) + (2 if k == 1 else 0)) for k in range(1, 7)], "scene timestamp, iy int, ix int, lst double")
    m = validation.compare_cubes(a, b, "lst").first()
    assert m.samples == 4 and m.bias == -0.5 and m.rmse == 1.0
    joined = a.withColumns({"ref": F.col("lst") + F.when(F.col("ix") == 0, 3.0).otherwise(0.5), "sd": F.lit(1.0), "out": F.col("ix") > 2})
    r = validation.downscaling_report(joined, estimate="lst", reference="ref", uncertainty="sd", extrapolated="out").first()
    assert (r.samples, r.interval_coverage, r.interval_width, r.extrapolation_fraction) == (5, 0.8, 2.0, 0.4)
