"""Requests from raw swath tables to results, over the driver's tables, with the same questions in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Area, Grid
from ..operators import resample
from ..operators.quantiles import cut
from ..sources import chunks
from ..sources.stores import new_folder
from . import acquisition, workflow
from .queries import UTM_X, UTM_Y, query, rounded
from .request import SENSORS, Downscaling, Request, estimate_bytes
from .tables import cte, project, read

AREA = Area(13.22, 52.42, 13.52, 52.56)
REQUEST = Request(AREA, "2023-12-31", "2024-12-31", ("sentinel3", "sentinel2"), resolution=2000.0, limit=400, downscaling=Downscaling(("NDVI",), "linear", factor=4, min_samples=20))
COARSE, FINE = REQUEST.grid(), REQUEST.grid_of("sentinel2")

#: Samples all over the area, those of a day too.
PLACES = {
    "scene": "scene",
    "obs_id": "obs_id",
    "value": "value",
    "qa": "qa",
    "lon": "CAST(13.2 AS DOUBLE) + ((obs_id * 617) % 997) / CAST(997.0 AS DOUBLE) * CAST(0.35 AS DOUBLE)",
    "lat": "CAST(52.4 AS DOUBLE) + ((obs_id * 389) % 991) / CAST(991.0 AS DOUBLE) * CAST(0.18 AS DOUBLE)",
}
PLACED = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in PLACES.items()) + " FROM swath"


def placed(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "swath").selectExpr(*(f"{e} AS {c}" for c, e in PLACES.items()))


#: Raw pixels of each sensor: columns by SQL that both engines read alike.
RAW = {
    "sentinel1": {"VV": "(obs_id % 97 + 1) / CAST(500.0 AS DOUBLE)", "VH": "(obs_id % 89 + 1) / CAST(2000.0 AS DOUBLE)"},
    "sentinel2": {"B02": "CAST(400 + obs_id % 700 AS DOUBLE)", "B03": "CAST(500 + obs_id % 800 AS DOUBLE)", "B04": "CAST(500 + obs_id % 1500 AS DOUBLE)", "B08": "CAST(2000 + obs_id % 3001 AS DOUBLE)", "B11": "CAST(1500 + obs_id % 1999 AS DOUBLE)", "B12": "CAST(900 + obs_id % 1201 AS DOUBLE)", "SCL": "CAST(obs_id % 12 AS INT)"},
    "sentinel3": {"lst": "280 + value % 40", "cloud_mask": "obs_id % 7 = 0"},
    "sentinel5p": {"NO2": "value", "qa": "qa"},
    "landsat": {"dn": "CAST(40000 + obs_id % 8000 AS INT)", "qa_pixel": "CAST(CASE WHEN obs_id % 9 = 0 THEN 8 ELSE 21824 END AS BIGINT)"},
    "ecostress": {"lst": "290 + value % 25", "cloud": "CASE WHEN obs_id % 13 = 0 THEN NULL WHEN obs_id % 11 = 0 THEN 1 ELSE 0 END"},
}


def raw_pixels(spark: SparkSession, d: str, sensor: str) -> DataFrame:
    """A product a day."""
    return placed(spark, d).selectExpr(f"'{sensor}-' || scene AS product_id", "scene", "lon", "lat", "obs_id", *(f"{e} AS {c}" for c, e in RAW[sensor].items()))


def raw_sql(sensor: str, grid) -> str:
    """Those pixels with their cell, inside the grid."""
    columns = ", ".join(f"{e} AS {c}" for c, e in RAW[sensor].items())
    return f"""SELECT * FROM (SELECT scene, obs_id, {columns}, CAST(floor(({grid.top} - {UTM_Y}) / {grid.resolution}) AS INT) AS iy, CAST(floor(({UTM_X} - {grid.left}) / {grid.resolution}) AS INT) AS ix FROM ({PLACED}))
WHERE iy BETWEEN 0 AND {grid.height - 1} AND ix BETWEEN 0 AND {grid.width - 1}"""


def products_of(spark: SparkSession, d: str, *sensors: str) -> DataFrame:
    days = project(spark, d, "swath").select("scene").distinct()
    made = [days.select(F.concat(F.lit(f"{s}-"), F.col("scene").cast("string")).alias("product_id"), F.lit(s).alias("sensor"), F.col("scene").cast("timestamp_ntz").alias("start_ts"), F.col("scene").cast("timestamp_ntz").alias("end_ts"), F.lit(True).alias("online"), F.lit(None).cast("double").alias("cloud"), F.lit(1.0).alias("coverage")) for s in sensors]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def executed(spark: SparkSession, d: str, request: Request) -> workflow.Result:
    """The request over the raw tables, with adapters of its own."""
    before = dict(workflow.ADAPTERS)
    try:
        workflow.register_tables({s: raw_pixels(spark, d, s) for s in request.sensors})
        return workflow.execute(spark, request, products_of(spark, d, *request.sensors))
    finally:
        workflow.ADAPTERS.clear()
        workflow.ADAPTERS.update(before)


#: Vegetation, bare ground, water and unclassified pixels are clear.
CLEAR = "SCL IN (4, 5, 6, 7)"
NDVI = f"""t AS ({raw_sql("sentinel3", COARSE)}), o AS ({raw_sql("sentinel2", FINE)}),
coarse AS (SELECT scene, iy, ix, avg(CASE WHEN NOT cloud_mask THEN lst - 273.15 END) AS lst FROM t GROUP BY ALL),
fine AS (SELECT scene, iy, ix, CASE WHEN abs(b8 + b4) > 1e-12 THEN (b8 - b4) / (b8 + b4) END AS ndvi FROM (SELECT scene, iy, ix, avg(CASE WHEN {CLEAR} THEN B04 END) AS b4, avg(CASE WHEN {CLEAR} THEN B08 END) AS b8 FROM o GROUP BY ALL)),
mean AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, avg(ndvi) AS ndvi FROM fine GROUP BY ALL)"""


@query(f"WITH {cte('swath')}, {NDVI} SELECT c.scene, c.iy, c.ix, round(c.lst, 6) AS lst, round(m.ndvi, 6) AS NDVI FROM coarse c LEFT JOIN mean m USING (scene, iy, ix)")
def fuse_request(spark, d):
    """Raw swaths of two sensors, each on its own grid, fused on the coarse one."""
    out = executed(spark, d, REQUEST).fused
    return rounded(out.select(F.col("scene").cast("date").alias("scene"), "iy", "ix", "lst", "NDVI"), "lst", "NDVI")


@query(f"""WITH {cte('swath')}, {NDVI}, j AS (SELECT scene, lst, ndvi FROM coarse JOIN mean USING (scene, iy, ix) WHERE lst IS NOT NULL AND ndvi IS NOT NULL),
m AS (SELECT scene, regr_slope(lst, ndvi) AS b1, regr_intercept(lst, ndvi) AS b0, min(ndvi) AS lo, max(ndvi) AS hi FROM j GROUP BY ALL HAVING count(*) >= 20 AND regr_sxx(lst, ndvi) > 1e-12),
p AS (SELECT f.scene, f.iy, f.ix, b0 + b1 * least(greatest(f.ndvi, lo), hi) + CASE WHEN f.ndvi IS NULL THEN NULL ELSE 0 END AS v FROM fine f JOIN m USING (scene)),
a AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, avg(v) AS a FROM p GROUP BY ALL)
SELECT p.scene, p.iy, p.ix, round(v + coalesce(c.lst - a.a, 0), 4) AS lst_downscaled FROM p LEFT JOIN a ON a.scene = p.scene AND a.iy = p.iy // 4 AND a.ix = p.ix // 4 LEFT JOIN coarse c ON c.scene = p.scene AND c.iy = p.iy // 4 AND c.ix = p.ix // 4""")
def sharpen_request(spark, d):
    """Raw swaths of two sensors through discovery, adapters and grids to a sharpened cube."""
    out = executed(spark, d, REQUEST).downscaled
    return rounded(out.select(F.col("scene").cast("date").alias("scene"), "iy", "ix", "lst_downscaled"), "lst_downscaled", digits=4)


def by_adapter(spark: SparkSession, d: str, sensor: str, *values: str, digits: int = 6) -> DataFrame:
    adapters: dict[str, workflow.Adapter] = {}
    workflow.register_tables({sensor: raw_pixels(spark, d, sensor)}, adapters)
    request = Request(AREA, "2023-12-31", "2024-12-31", (sensor,), resolution=2000.0)
    out = adapters[sensor](spark, products_of(spark, d, sensor), request)
    return rounded(out.select("scene", "iy", "ix", *values), *(v for v in values if not v.endswith(("_count", "_mask"))), digits=digits)


@query(f"""WITH {cte('swath')}, r AS ({raw_sql("sentinel1", COARSE)}), m AS (SELECT scene, iy, ix, avg(VV) AS vv, avg(VH) AS vh FROM r GROUP BY ALL)
SELECT scene, iy, ix, round(vv, 6) AS sigma0_VV, round(vh, 6) AS sigma0_VH, round(4 * vh / (vv + vh), 6) AS RVI FROM m""")
def adapter_sentinel1(spark, d):
    return by_adapter(spark, d, "sentinel1", "sigma0_VV", "sigma0_VH", "RVI")


@query(f"""WITH {cte('swath')}, r AS ({raw_sql("sentinel2", COARSE)}), m AS (SELECT scene, iy, ix, {", ".join(f"avg(CASE WHEN {CLEAR} THEN {b} END) AS {b}" for b in ("B02", "B03", "B04", "B08", "B11", "B12"))} FROM r GROUP BY ALL)
SELECT scene, iy, ix, round((B08 - B04) / (B08 + B04), 6) AS NDVI, round((B08 - B11) / (B08 + B11), 6) AS NDMI, round((B03 - B11) / (B03 + B11), 6) AS MNDWI, B02 IS NOT NULL AS valid_mask FROM m""")
def adapter_sentinel2(spark, d):
    return by_adapter(spark, d, "sentinel2", "NDVI", "NDMI", "MNDWI", "valid_mask")


@query(f"WITH {cte('swath')}, r AS ({raw_sql('sentinel5p', COARSE)}) SELECT scene, iy, ix, round(avg(NO2), 6) AS NO2 FROM r WHERE qa >= 0.75 GROUP BY ALL")
def adapter_sentinel5p(spark, d):
    return by_adapter(spark, d, "sentinel5p", "NO2")


@query(f"WITH {cte('swath')}, r AS ({raw_sql('landsat', COARSE)}) SELECT scene, iy, ix, round(avg(CASE WHEN qa_pixel & 31 = 0 THEN dn * CAST(0.00341802 AS DOUBLE) + 149.0 - 273.15 END), 4) AS lst, count(*) FILTER (qa_pixel & 31 = 0) AS lst_observation_count FROM r GROUP BY ALL")
def adapter_landsat(spark, d):
    return by_adapter(spark, d, "landsat", "lst", "lst_observation_count", digits=4)


@query(f"WITH {cte('swath')}, r AS ({raw_sql('ecostress', COARSE)}) SELECT scene, iy, ix, round(avg(CASE WHEN cloud = 0 THEN lst - 273.15 END), 6) AS lst, count(*) FILTER (cloud = 0) AS lst_observation_count FROM r GROUP BY ALL")
def adapter_ecostress(spark, d):
    return by_adapter(spark, d, "ecostress", "lst", "lst_observation_count")


TEXT_RAW = "SELECT 'p' || CAST(obs_id % 40 AS VARCHAR) AS product_id, CASE WHEN obs_id % 1999 = 0 THEN NULL ELSE scene END AS scene, CASE WHEN obs_id % 1009 = 0 THEN 500.0 ELSE lon END AS lon, CASE WHEN obs_id % 997 = 0 THEN 'x' || CAST(obs_id AS VARCHAR) ELSE CAST(obs_id % 1000 AS VARCHAR) END AS B04 FROM swath"


@query(f"""WITH {cte('swath')}, r AS ({TEXT_RAW}), e AS (SELECT product_id, min(CASE WHEN scene IS NULL THEN 'no time' WHEN abs(lon) > 360 THEN 'a place off the globe' WHEN B04 LIKE 'x%' THEN 'B04 is no number: ' || B04 END) AS error FROM r GROUP BY ALL),
p AS (SELECT 'p' || CAST(s_suppkey % 50 AS VARCHAR) AS product_id FROM supplier GROUP BY ALL)
SELECT p.product_id, CASE WHEN e.product_id IS NULL THEN 'no pixels' ELSE error END AS error FROM p LEFT JOIN e ON e.product_id = p.product_id WHERE e.product_id IS NULL OR error IS NOT NULL""")
def product_failures(spark, d):
    """Products with an unreadable pixel, or none at all, and why."""
    raw = project(spark, d, "swath").selectExpr("'p' || cast(obs_id % 40 as string) AS product_id", "CASE WHEN obs_id % 1999 = 0 THEN NULL ELSE scene END AS scene", "CASE WHEN obs_id % 1009 = 0 THEN 500.0D ELSE lon END AS lon", "lat", "CASE WHEN obs_id % 997 = 0 THEN 'x' || cast(obs_id as string) ELSE cast(obs_id % 1000 as string) END AS B04", "1.0D AS B08")
    products = read(spark, d, "supplier").selectExpr("'p' || cast(s_suppkey % 50 as string) AS product_id").distinct()
    return acquisition.failures(raw, products)


@query(f"""WITH {cte('swath')}, r AS (SELECT CAST(scene AS VARCHAR) AS product_id, (obs_id % 10 < day(scene) % 10) AS hidden FROM swath WHERE lon BETWEEN {AREA.west} AND {AREA.east} AND lat BETWEEN {AREA.south} AND {AREA.north}),
c AS (SELECT product_id, 1 - avg(CAST(hidden AS INT)) AS clear FROM r GROUP BY ALL), p AS (SELECT CAST(scene AS VARCHAR) AS product_id, (day(scene) * 37) % 100 AS cloud FROM (SELECT DISTINCT scene FROM swath)),
k AS (SELECT product_id, row_number() OVER (ORDER BY cloud, product_id) AS k FROM p JOIN c USING (product_id) WHERE clear >= 0.45)
SELECT product_id, round(clear, 6) AS clear_fraction, coalesce(k <= 7, false) AS accepted FROM p LEFT JOIN c USING (product_id) LEFT JOIN k USING (product_id)""")
def clear_selection(spark, d):
    """The seven best products by catalogue of those clear enough over the area, by their flags."""
    raw = project(spark, d, "swath").selectExpr("cast(scene as string) AS product_id", "lon", "lat", "obs_id % 10 < day(scene) % 10 AS cloud_mask")
    days = project(spark, d, "swath").select("scene").distinct()
    products = days.selectExpr("cast(scene as string) AS product_id", "true AS online", "cast((day(scene) * 37) % 100 as double) AS cloud", "1.0D AS coverage", "timestamp'2024-01-01' AS start_ts")
    found = acquisition.select_clear(products, acquisition.measured_clear(raw, "sentinel3", products, AREA), 0.45, 7)
    return rounded(found.select("product_id", "clear_fraction", "accepted"), "clear_fraction")


_VARIABLES = {s: len(v) for s, v in SENSORS.items()}
_CELLS = 'CAST(floor({area} * 1e6 / (side * side)) AS BIGINT)'


def _estimates_sql() -> str:
    import math

    band = math.sin(math.radians(AREA.north)) - math.sin(math.radians(AREA.south))
    area = math.radians(AREA.east - AREA.west) * band * 6371.0088**2
    rows = ", ".join(f"('{s}', {k}, {n}, {1000.0 if s in ('sentinel3', 'landsat', 'ecostress', 'sentinel5p') else 100.0})" for k, (s, n) in enumerate(_VARIABLES.items()))
    return f"SELECT sensor, {_CELLS.format(area=repr(area))} * products * variables * 8 AS bytes FROM (VALUES {rows}) v(sensor, k, variables, side) JOIN (SELECT o_orderkey % 6 AS k, count(*) AS products FROM orders GROUP BY ALL) USING (k)"


@query(_estimates_sql())
def size_estimate(spark, d):
    """What requests for all products of a sensor would hold; a count a sensor comes to the driver."""
    counts = {r.k: r.n for r in read(spark, d, "orders").groupBy((F.col("o_orderkey") % 6).alias("k")).agg(F.count("*").alias("n")).collect()}
    base = Request(AREA, "2024-01-01", "2024-01-31", ("sentinel3",), resolution=1000.0, fine_resolution=100.0)
    rows = [(s, estimate_bytes(replace(base, sensors=(s,), limit=counts[k]))) for k, s in enumerate(SENSORS) if k in counts]
    return spark.createDataFrame(rows, "sensor string, bytes long")


#: A source of 100 m cells that start off the target's 300 m cells, between two systems whose axes are parallel.
OFF_SOURCE, OFF_TARGET = Grid("EPSG:32633", 0.0, 1000.0, 100.0, 10, 10), Grid("EPSG:32633", -147.3, 1061.7, 300.0, 4, 4)
SHARE = "greatest(0, least({a} + 100, {b} + 300) - greatest({a}, {b}))"


@query(f"""WITH {cte('obs')}, o AS (SELECT scene, iy % 10 AS iy, ix % 10 AS ix, avg(lst) AS v FROM obs GROUP BY ALL),
t AS (SELECT CAST(a AS INT) AS ty, CAST(b AS INT) AS tx FROM range(4) p(a), range(4) q(b)),
w AS (SELECT o.scene, ty, tx, v, {SHARE.format(a="(ix * 100)", b="(-147.3 + tx * 300)")} * {SHARE.format(a="(900 - iy * 100)", b="(761.7 - ty * 300)")} AS w FROM o, t)
SELECT scene, ty AS iy, tx AS ix, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 5) AS lst FROM w WHERE w > 0 GROUP BY ALL""")
def reproject_area(spark, d):
    """Cells weighted by the part of them that lies in a target cell, in closed form."""
    o = project(spark, d, "obs").groupBy("scene", (F.col("iy") % 10).alias("iy"), (F.col("ix") % 10).alias("ix")).agg(F.avg("lst").alias("lst"))
    return rounded(resample.resample(o, OFF_SOURCE, OFF_TARGET, ["lst"], "area"), "lst", digits=5)


#: Web Mercator and degrees have parallel axes: columns are proportional, rows are not.
DEGREES, MERCATOR = Grid("EPSG:4326", 13.2, 52.6, 0.02, 18, 10), Grid("EPSG:3857", 1_468_000.0, 6_896_000.0, 7000.0, 6, 6)
RADIUS = 6378137.0
NORTHING = "(ln(tan(radians({lat}) / 2 + pi() / 4)) * 6378137.0)"


@query(f"""WITH {cte('swath')}, o AS (SELECT scene, CAST(floor((52.6 - lat) / 0.02) AS INT) AS iy, CAST(floor((lon - 13.2) / 0.02) AS INT) AS ix, avg(value) AS v FROM swath GROUP BY ALL),
e AS (SELECT *, radians(13.2 + ix * 0.02) * {RADIUS} AS x0, radians(13.2 + (ix + 1) * 0.02) * {RADIUS} AS x1, {NORTHING.format(lat="52.6 - (iy + 1) * 0.02")} AS y0, {NORTHING.format(lat="52.6 - iy * 0.02")} AS y1 FROM o WHERE iy BETWEEN 0 AND 9 AND ix BETWEEN 0 AND 17),
t AS (SELECT CAST(a AS INT) AS ty, CAST(b AS INT) AS tx, 1468000.0 + b * 7000.0 AS left_, 6896000.0 - a * 7000.0 AS top FROM range(6) p(a), range(6) q(b)),
w AS (SELECT scene, ty, tx, v, greatest(0, least(x1, left_ + 7000) - greatest(x0, left_)) * greatest(0, least(y1, top) - greatest(y0, top - 7000)) AS w FROM e, t)
SELECT scene, ty AS iy, tx AS ix, round(sum(v * w) / sum(w), 5) AS value FROM w WHERE w > 0.01 GROUP BY ALL""")
def reproject_area_mercator(spark, d):
    """From degrees to web Mercator with partial weights; the SQL intersects the projected boxes."""
    s = project(spark, d, "swath")
    at = s.groupBy("scene", F.floor((F.lit(52.6) - F.col("lat")) / 0.02).cast("int").alias("iy"), F.floor((F.col("lon") - 13.2) / 0.02).cast("int").alias("ix")).agg(F.avg("value").alias("value"))
    return rounded(resample.resample(at, DEGREES, MERCATOR, ["value"], "area"), "value", digits=5)


@query(f"WITH {cte('obs')} SELECT scene, iy, ix, round(avg(lst), 6) AS lst, count(*) FILTER (cloud_mask) > 0 AS cloud_mask FROM obs WHERE day(scene) % 3 = 0 GROUP BY ALL HAVING iy >= 4 AND ix < 8")
def chunk_store(spark, d):
    """A cube written as chunked arrays, in two goes along time, and read back in part."""
    o = cut(project(spark, d, "obs").groupBy("scene", "iy", "ix").agg(F.avg("lst").alias("lst"), F.max("cloud_mask").alias("cloud_mask")))  # read five times
    most = o.agg(F.max("iy"), F.max("ix")).first()
    grid = Grid("EPSG:32633", 0.0, 0.0, 1000.0, most[1] + 1, most[0] + 1)
    path = new_folder(spark, "chunks")
    for part in ("day(scene) % 2 = 1", "day(scene) % 2 = 0"):
        chunks.write_chunks(o.where(part), path, grid, chunk=4)
    back = chunks.read_chunks(spark, path)
    return rounded(back.where("day(scene) % 3 = 0 and iy >= 4 and ix < 8"), "lst")
