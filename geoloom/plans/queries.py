"""Every operator over the driver's tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..functions import scalar as sc
from ..grid import Area, Grid
from ..operators import binning, catalogue, downscale, forests, gwr, kriging, neighbourhood, polygons, resample, spatial, stations, temporal, trees, validation, zonal
from ..sources import readers, sinks
from . import workflow
from .request import Request
from .tables import cte, project, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- cells of the daily cube -------------------------------------------------------------------

VALID = """(lst IS NOT NULL AND NOT cloud_mask AND (exception_flags & 2047) = 0 AND (confidence_flags & 800) = 0 AND coalesce(sat_zenith, 90) <= 45)"""
CELLS_SQL = f"WITH {cte('obs')}, good AS (SELECT *, {VALID} AS valid_mask FROM obs), cells AS (SELECT scene, iy, ix, avg(CASE WHEN valid_mask THEN lst - 273.15 END) AS lst, count(CASE WHEN valid_mask THEN lst END) AS n, bit_or(CAST(exception_flags AS BIGINT)) AS exception_flags FROM good GROUP BY ALL)"


def obs(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "obs")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Masked, converted and binned daily cells: scene, iy, ix, lst, lst_count, exception_flags."""
    masked = sc.to_celsius(sc.apply_quality(obs(spark, d)), units="K")
    return binning.bin_points(masked, ["lst"], ["exception_flags"])


@query(f"WITH {cte('obs')} SELECT scene, iy, ix, round(avg(lst), 6) AS lst, count(lst) AS lst_count FROM obs GROUP BY ALL")
def bin_mean(spark, d):
    return rounded(binning.bin_points(obs(spark, d), ["lst"]), "lst")


@query(f"WITH {cte('obs')} SELECT scene, iy, ix, CAST(bit_or(exception_flags) AS BIGINT) AS exception_flags, CAST(bit_or(confidence_flags) AS BIGINT) AS confidence_flags FROM obs GROUP BY ALL")
def bin_flags_or(spark, d):
    return binning.bin_points(obs(spark, d), [], ["exception_flags", "confidence_flags"])


@query(f"WITH {cte('obs')} SELECT event_id, coalesce({VALID}, false) AS valid_mask FROM obs")
def quality_mask(spark, d):
    o = obs(spark, d)
    return o.select("event_id", sc.valid_pixel(o.columns).alias("valid_mask"))


@query(f"WITH {cte('obs')} SELECT event_id, lst IS NOT NULL AS valid_mask FROM obs")
def quality_permissive(spark, d):
    o = obs(spark, d)
    return o.select("event_id", sc.valid_pixel(o.columns, sc.QualityPolicy.permissive()).alias("valid_mask"))


@query(f"WITH {cte('obs')} SELECT event_id, round(CASE WHEN {VALID} THEN lst - 273.15 END, 6) AS lst, round(CASE WHEN {VALID} THEN lst_uncertainty END, 6) AS lst_uncertainty FROM obs")
def mask_and_celsius(spark, d):
    out = sc.to_celsius(sc.apply_quality(obs(spark, d)), units="K")
    return rounded(out.select("event_id", "lst", "lst_uncertainty"), "lst", "lst_uncertainty")


@query(f"WITH {cte('obs')}, b AS (SELECT unnest({list(sc.EXCEPTION_BITS)}) AS flag, unnest({list(sc.EXCEPTION_BITS.values())}) AS bit) SELECT flag, CAST(bit AS BIGINT) AS bit, count(*) FILTER (exception_flags & bit <> 0) AS pixels FROM obs, b GROUP BY ALL")
def exception_counts(spark, d):
    return longs(binning.flag_counts(obs(spark, d)), "bit")


@query(f"WITH {cte('obs')} SELECT count(*) AS total, count(*) FILTER (coalesce({VALID}, false)) AS valid, count(*) FILTER (NOT coalesce({VALID}, false)) AS invalid, round(avg(CAST(coalesce({VALID}, false) AS INT)), 6) AS valid_fraction FROM obs")
def quality_summary(spark, d):
    return rounded(binning.quality_summary(sc.apply_quality(obs(spark, d))), "valid_fraction")


@query(f"WITH {cte('obs')} SELECT count(*) AS total, count(lst) AS valid, round(avg(lst), 6) AS mean, round(median(lst), 6) AS median, round(min(lst), 6) AS min, round(max(lst), 6) AS max FROM obs")
def stats_summary(spark, d):
    return rounded(binning.value_summary(obs(spark, d)), "mean", "median", "min", "max")


@query(f"WITH {cte('obs')}, good AS (SELECT *, {VALID} AS ok FROM obs) SELECT scene AS day, iy, ix, round(avg(CASE WHEN ok THEN lst - 273.15 END), 6) AS lst, count(CASE WHEN ok THEN lst END) AS valid_count FROM good GROUP BY ALL")
def daily_mean(spark, d):
    masked = sc.to_celsius(sc.apply_quality(obs(spark, d)), units="K")
    return rounded(binning.daily_mean(masked), "lst")


@query(f"WITH {cte('obs')}, o AS (SELECT CAST(date_trunc('week', scene) AS DATE) AS scene, iy, ix, lst FROM obs), m AS (SELECT scene AS day, iy, ix, avg(lst) AS lst, count(lst) AS n FROM o GROUP BY ALL), days AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(scene) AS TIMESTAMP) FROM o), (SELECT CAST(max(scene) AS TIMESTAMP) FROM o), INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT DISTINCT iy, ix FROM o) SELECT day, iy, ix, round(lst, 6) AS lst, coalesce(n, 0) AS valid_count FROM days CROSS JOIN c LEFT JOIN m USING (day, iy, ix)")
def daily_mean_gaps(spark, d):
    """All pixels on the Monday of their week: six days of seven are gaps."""
    mondays = obs(spark, d).withColumn("scene", F.trunc("scene", "week"))
    return rounded(binning.daily_mean(mondays, fill_gaps=True), "lst")


@query(f"{CELLS_SQL} SELECT iy, ix, round(avg(lst), 6) AS mean, round(quantile_cont(lst, 0.95), 6) AS p95, round(max(lst), 6) AS max, count(*) FILTER (lst >= 35) AS hot_count, count(lst) AS observation_count FROM cells GROUP BY ALL")
def heat_hazard(spark, d):
    return rounded(binning.heat_metrics(cells(spark, d)), "mean", "p95", "max")


@query(f"WITH {cte('obs')}, x AS (SELECT *, {VALID} AS v FROM obs) SELECT iy, ix, round(median(CASE WHEN v THEN lst END), 6) AS lst, count(*) FILTER (v) AS clear_observation_count, count(*) FILTER (v) >= 2 AS valid_mask FROM x GROUP BY ALL")
def composite_median(spark, d):
    return rounded(binning.composite(sc.apply_quality(obs(spark, d)), ["lst"], min_observations=2), "lst")


@query(f"WITH {cte('obs')}, x AS (SELECT *, {VALID} AS v FROM obs) SELECT iy, ix, round(avg(CASE WHEN v THEN lst END), 6) AS lst, count(*) FILTER (v) AS clear_observation_count, count(*) FILTER (v) >= 1 AS valid_mask FROM x GROUP BY ALL")
def composite_mean(spark, d):
    return rounded(binning.composite(sc.apply_quality(obs(spark, d)), ["lst"], method="mean"), "lst")


@query(f"WITH {cte('obs')} SELECT scene, count(*) FILTER ({VALID}) AS clear_pixel_count, round(count(*) FILTER ({VALID}) / count(*), 6) AS clear_fraction FROM obs GROUP BY ALL")
def scene_coverage(spark, d):
    return rounded(binning.scene_coverage(sc.apply_quality(obs(spark, d))), "clear_fraction")


@query(f"WITH {cte('obs')} SELECT scene, round(1 - avg(CAST(cloud_mask OR coalesce(sat_zenith, 90) > 45 AS INT)), 6) AS clear_fraction, count(*) AS pixels FROM obs WHERE iy BETWEEN 2 AND 8 GROUP BY ALL")
def cloud_probe(spark, d):
    unusable = F.col("cloud_mask") | (F.coalesce("sat_zenith", F.lit(90.0)) > 45)
    return rounded(binning.clear_fraction(obs(spark, d), unusable, F.col("iy").between(2, 8), ["scene"]), "clear_fraction")


@query(f"{CELLS_SQL} SELECT scene, round((count(lst) + count(n) FILTER (n > 0)) / CAST(2 * count(*) AS DOUBLE), 6) AS feature_availability FROM cells GROUP BY ALL")
def fusion_availability(spark, d):
    c = cells(spark, d).withColumn("seen", F.when(F.col("lst_count") > 0, F.col("lst_count")))
    return rounded(binning.availability(c, ["lst", "seen"]), "feature_availability")


@query(f"WITH {cte('obs')}, m AS (SELECT scene, iy, ix, bool_or(cloud_mask) AS cloud FROM obs GROUP BY ALL) SELECT a.scene, a.iy, a.ix, bool_or(b.cloud) AS cloud FROM m a JOIN m b ON a.scene = b.scene AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 GROUP BY ALL")
def dilate_mask(spark, d):
    m = obs(spark, d).groupBy("scene", "iy", "ix").agg(F.bool_or("cloud_mask").alias("cloud"))
    near = neighbourhood.grown(m.where("cloud"), 1).withColumn("near", F.lit(True))
    return m.select("scene", "iy", "ix").join(near, ["scene", "iy", "ix"], "left").select("scene", "iy", "ix", F.coalesce("near", F.lit(False)).alias("cloud"))


# --- zones ------------------------------------------------------------------------------------

#: A triangle, an overlapping square and an empty zone, in (column, row) space.
ZONES = [[[(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)]], [[(2.5, 2.5), (7.5, 2.5), (7.5, 12.5), (2.5, 12.5)]], [[(900.0, 900.0), (901.0, 900.0), (901.0, 901.0)]]]
ZONE_CASE = "CASE WHEN ix > 0 AND iy > 0 AND ix + iy < 8 THEN 0 WHEN ix > 2.5 AND ix < 7.5 AND iy > 2.5 AND iy < 12.5 THEN 1 ELSE -1 END"


def labels(spark, d):
    grid = cells(spark, d).select("iy", "ix").distinct()
    return polygons.zone_labels(grid, polygons.edges_of(spark, ZONES), F.col("ix"), F.col("iy"))


@query(f"{CELLS_SQL} SELECT DISTINCT iy, ix, CAST({ZONE_CASE} AS INT) AS zone FROM cells")
def zone_labels(spark, d):
    return labels(spark, d)


@query(f"""{CELLS_SQL}, z AS (SELECT *, {ZONE_CASE} AS zone FROM cells), s AS (SELECT DISTINCT scene FROM cells),
k AS (SELECT scene, CAST(zone AS INT) AS zone FROM s, range(3) r(zone))
SELECT k.scene, k.zone, count(lst) AS count, round(avg(lst), 6) AS mean, round(stddev_pop(lst), 6) AS std, round(min(lst), 6) AS min, round(max(lst), 6) AS max, round(median(lst), 6) AS median, round(quantile_cont(lst, 0.1), 6) AS p10, round(quantile_cont(lst, 0.9), 6) AS p90
FROM k LEFT JOIN z ON k.scene = z.scene AND k.zone = z.zone GROUP BY ALL""")
def zonal_stats(spark, d):
    out = zonal.zonal_statistics(cells(spark, d), labels(spark, d), 3, statistics=tuple(zonal.STATISTICS))
    return rounded(out, "mean", "std", "min", "max", "median", "p10", "p90")


@query(f"{CELLS_SQL} SELECT scene, iy, ix, round(CASE WHEN ix > 0 AND iy > 0 AND ix + iy < 8 THEN lst END, 6) AS lst, (n > 0) AND ix > 0 AND iy > 0 AND ix + iy < 8 AS valid FROM cells")
def clip_to_area(spark, d):
    inside = spatial.in_polygon(F.col("ix").cast("double"), F.col("iy").cast("double"), ZONES[0])
    c = cells(spark, d).withColumn("valid", F.col("lst_count") > 0).select("scene", "iy", "ix", "lst", "valid")
    return rounded(spatial.clip_to(c, inside, ["lst", "valid"]), "lst")


@query(f"WITH {cte('swath')} SELECT obs_id, ((lon > 13.25 AND lat > 52.45 AND lon < 13.45 AND lat < 52.55) AND NOT (lon > 13.3 AND lat > 52.48 AND lon < 13.35 AND lat < 52.52)) AS inside FROM swath")
def aoi_mask_polygon(spark, d):
    """A square with a hole."""
    rings = [[(13.25, 52.45), (13.45, 52.45), (13.45, 52.55), (13.25, 52.55)], [(13.3, 52.48), (13.35, 52.48), (13.35, 52.52), (13.3, 52.52)]]
    return project(spark, d, "swath").select("obs_id", spatial.in_polygon(F.col("lon"), F.col("lat"), rings).alias("inside"))


@query(f"{CELLS_SQL}, z AS (SELECT *, {ZONE_CASE} AS zone FROM cells) SELECT CAST(zone AS INT) AS zone, 'mean_' || strftime(scene, '%Y-%m-%dT%H:%M') AS property, round(avg(lst), 6) AS value FROM z WHERE zone >= 0 GROUP BY zone, scene")
def zonal_geojson(spark, d):
    """Names and values of the properties of each zone's feature."""
    stats = zonal.zonal_statistics(cells(spark, d), labels(spark, d), 2, statistics=("count", "mean"))
    present = cells(spark, d).join(labels(spark, d), ["iy", "ix"]).where("zone >= 0").select("scene", "zone").distinct()
    zones = spark.createDataFrame([(0, "triangle", "{}"), (1, "square", "{}")], "zone int, zone_id string, geometry string")
    features = sinks.zonal_geojson(stats.join(present, ["scene", "zone"]), zones, "mean")
    props = F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>")
    found = features.select("zone", F.explode(props).alias("property", "value")).where("property like 'mean\\_%'")
    return rounded(found, "value")


# --- scalars ----------------------------------------------------------------------------------

INDEX_SQL = """round((B08 - B04) / nullif(B08 + B04, 0), 6) AS NDVI, round(2.5 * (B08 - B04) / nullif(B08 + 6 * B04 - 7.5 * B02 + 1, 0), 6) AS EVI,
round((B08 - B11) / nullif(B08 + B11, 0), 6) AS NDMI, round((B11 - B08) / nullif(B11 + B08, 0), 6) AS NDBI, round((B03 - B11) / nullif(B03 + B11, 0), 6) AS MNDWI"""


@query(f"WITH {cte('bands')} SELECT pixel, {INDEX_SQL} FROM bands")
def spectral_indices(spark, d):
    found = sc.spectral_indices()
    return rounded(project(spark, d, "bands").select("pixel", *(c.alias(n) for n, c in found.items())), *found)


@query(f"WITH {cte('bands')} SELECT pixel, SCL NOT IN (0, 1, 2, 3, 8, 9, 10, 11) AS clear FROM bands")
def scene_class_mask(spark, d):
    return project(spark, d, "bands").select("pixel", sc.clear_class(F.col("SCL")).alias("clear"))


@query(f"WITH {cte('bands')} SELECT pixel, round(CASE WHEN B08 > 0 AND B11 > 0 THEN 10 * log10(B11 / B08) END, 6) AS VH_VV_ratio_dB, round(CASE WHEN B08 + B11 > 0 THEN 4 * B11 / (B08 + B11) END, 6) AS RVI, round(B08 + B11, 6) AS radar_span FROM bands")
def radar_indices(spark, d):
    found = sc.radar_indices(F.col("B08"), F.col("B11"))
    return rounded(project(spark, d, "bands").select("pixel", *(c.alias(n) for n, c in found.items())), *found)


@query(f"WITH {cte('bands')} SELECT pixel, round(pow(10, B02 / 10), 6) AS vv, round(10 * log10(greatest(B08 * B08, 1e-10)), 6) AS vh_db FROM bands")
def backscatter_scales(spark, d):
    b = project(spark, d, "bands")
    vv = readers.radar_bands(b.select("pixel", F.col("B02").alias("vv"), F.col("B08").alias("vh_db")), ["vv"], scale="db")
    return rounded(readers.radar_bands(vv, ["vh_db"], scale="amplitude", output="dB"), "vv", "vh_db")


@query(f"WITH {cte('bands')} SELECT pixel, round(CASE WHEN SCL NOT IN (0, 1, 2, 3, 8, 9, 10, 11) AND B08 <> 0 THEN (B08 * 10000 - 1000) / 10000 END, 6) AS B08, round(CASE WHEN SCL NOT IN (0, 1, 2, 3, 8, 9, 10, 11) AND B04 <> 0 THEN B04 * 10000 / 10000 END, 6) AS B04 FROM bands")
def radiometric_offsets(spark, d):
    raw = project(spark, d, "bands").select("pixel", "SCL", (F.col("B08") * 10000).alias("B08"), (F.col("B04") * 10000).alias("B04"))
    return rounded(readers.optical_bands(raw, ["B08", "B04"], {"B08": -1000.0}).select("pixel", "B08", "B04"), "B08", "B04")


@query(f"WITH {cte('bands')} SELECT pixel, round(CASE WHEN (CAST(SCL AS BIGINT) & 3) = 0 THEN B02 * 100000 * 0.00341802 + 149.0 - 273.15 END, 6) AS lst FROM bands")
def thermal_from_dn(spark, d):
    raw = project(spark, d, "bands").select("pixel", (F.col("B02") * 100000).alias("dn"), F.col("SCL").cast("long").bitwiseAND(F.lit(3)).alias("qa_pixel"))
    return rounded(readers.surface_temperature(raw, scale=0.00341802, offset=149.0).select("pixel", "lst"), "lst")


@query(f"WITH {cte('swath')} SELECT obs_id, round(CASE WHEN qa > 0 THEN value * 1e-6 * 46.0055 * 1e6 / (qa * 999) END, 6) AS NO2 FROM swath")
def column_to_surface(spark, d):
    s = project(spark, d, "swath")
    return rounded(s.select("obs_id", sc.surface_concentration(F.col("value") * 1e-6, "NO2", F.col("qa") * 999).alias("NO2")), "NO2")


@query(f"WITH {cte('swath')} SELECT obs_id, qa >= 0.75 AS valid, CASE WHEN qa >= 0.75 THEN value END AS value FROM swath")
def gas_quality_filter(spark, d):
    return readers.gas_pixels(project(spark, d, "swath")).select("obs_id", "valid", "value")


HOUR_SQL = "(hour(ts) + minute(ts) / 60.0 + CAST(floor(second(ts)) AS DOUBLE) / 3600.0 + lon / 15.0)"
HOUR_MOD = f"({HOUR_SQL} - 24 * floor({HOUR_SQL} / 24))"


@query(f"WITH {cte('swath')} SELECT obs_id, round({HOUR_MOD}, 6) AS solar_hour FROM swath WHERE {HOUR_MOD} >= 6 AND {HOUR_MOD} < 18")
def overpass_day(spark, d):
    s = project(spark, d, "swath").withColumn("solar_hour", sc.solar_hour(F.col("ts"), F.col("lon")))
    return rounded(s.where((F.col("solar_hour") >= 6) & (F.col("solar_hour") < 18)).select("obs_id", "solar_hour"), "solar_hour")


NIGHT = "((hour(ts) + minute(ts) / 60.0 + CAST(floor(second(ts)) AS DOUBLE) / 3600.0 + 13.4 / 15.0) - 24 * floor((hour(ts) + minute(ts) / 60.0 + CAST(floor(second(ts)) AS DOUBLE) / 3600.0 + 13.4 / 15.0) / 24))"


@query(f"SELECT CAST(event_id AS VARCHAR) AS product_id FROM events WHERE NOT ({NIGHT} >= 6 AND {NIGHT} < 18)")
def overpass_night(spark, d):
    products = read(spark, d, "events").select(F.col("event_id").cast("string").alias("product_id"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"))
    return catalogue.by_overpass(products, F.lit(13.4), "night").select("product_id")


@query("SELECT s_suppkey, CAST((CASE WHEN s_acctbal >= 0 THEN 32600 ELSE 32700 END) + (CAST(floor((s_suppkey * 7 % 360 - 180 + 180) / 6.0) AS BIGINT) % 60) + 1 AS INT) AS epsg FROM supplier")
def utm_zone(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", projection.utm_zone((F.col("s_suppkey") * 7 % 360 - 180).cast("double"), F.col("s_acctbal")).alias("epsg"))


def utm_sql(lon: str, lat: str, meridian: float) -> tuple[str, str]:
    """Easting and northing in SQL: conformal latitude, then the series in the third flattening to its fourth order."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    terms = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e!r} * atanh({e!r} * {s}))"
    dl = f"(radians({lon}) - radians({meridian!r}))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))"
    north = " + ".join(f"{c!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, c in enumerate(terms, 1))
    east = " + ".join(f"{c!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, c in enumerate(terms, 1))
    return f"(500000 + {a!r} * ({eta} + {east}))", f"({a!r} * ({xi} + {north}))"


UTM_X, UTM_Y = utm_sql("lon", "lat", 15.0)


@query(f"WITH {cte('swath')} SELECT obs_id, round({UTM_X}, 2) AS x, round({UTM_Y}, 2) AS y FROM swath")
def utm_xy(spark, d):
    s = project(spark, d, "swath")
    x, y = projection.project(F.col("lon"), F.col("lat"), "EPSG:32633")
    return rounded(s.select("obs_id", x.alias("x"), y.alias("y")), "x", "y", digits=2)


@query(f"WITH {cte('swath')} SELECT obs_id, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS in_zone FROM swath")
def utm_round_trip(spark, d):
    """Projected to UTM and back; the projected point lies in the zone's strip."""
    s = project(spark, d, "swath")
    x, y = projection.project(F.col("lon"), F.col("lat"), "EPSG:32633")
    s = s.select("obs_id", x.alias("x"), y.alias("y"))
    lon, lat = projection.unproject(F.col("x"), F.col("y"), "EPSG:32633")
    return rounded(s.select("obs_id", lon.alias("lon"), lat.alias("lat"), (F.col("x").between(166_000, 834_000) & F.col("y").between(5_000_000, 6_500_000)).alias("in_zone")), "lon", "lat")


SUN_SQL = """
t AS (SELECT *, hour(ts) + minute(ts) / 60.0 + CAST(floor(second(ts)) AS DOUBLE) / 3600.0 AS h FROM swath),
g AS (SELECT *, 2 * pi() / 365 * (dayofyear(ts) - 1 + (h - 12) / 24) AS g FROM t),
e AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eqt,
  0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM g),
a AS (SELECT *, radians((h * 60 + eqt + 4 * lon) / 4 - 180) AS ha, radians(lat) AS phi FROM e),
sun AS (SELECT *, degrees(acos(greatest(-1, least(1, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha))))) AS zenith,
  degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180 AS az FROM a)
"""


@query(f"WITH {cte('swath')}, {SUN_SQL} SELECT obs_id, round(zenith, 5) AS zenith, round(az - 360 * floor(az / 360), 5) AS azimuth FROM sun")
def solar_position(spark, d):
    s = project(spark, d, "swath")
    zenith, azimuth = sc.solar_position(F.col("ts"), F.col("lat"), F.col("lon"))
    return rounded(s.select("obs_id", zenith.alias("zenith"), azimuth.alias("azimuth")), "zenith", "azimuth", digits=5)


@query(f"WITH {cte('swath')}, {SUN_SQL} SELECT obs_id, round(cos(radians(zenith)) * cos(radians(qa * 40)) + sin(radians(zenith)) * sin(radians(qa * 40)) * cos(radians(az) - radians(qa * 360)), 6) AS cos_incidence FROM sun")
def cos_incidence(spark, d):
    s = project(spark, d, "swath")
    zenith, azimuth = sc.solar_position(F.col("ts"), F.col("lat"), F.col("lon"))
    return rounded(s.select("obs_id", sc.cos_incidence(zenith, azimuth, F.col("qa") * 40, F.col("qa") * 360).alias("cos_incidence")), "cos_incidence")


@query(f"WITH {cte('swath')} SELECT obs_id FROM swath WHERE lon BETWEEN 13.25 AND 13.45 AND lat BETWEEN 52.45 AND 52.5")
def clip_bbox(spark, d):
    return spatial.clip_box(project(spark, d, "swath"), 13.25, 52.45, 13.45, 52.5).select("obs_id")


@query("""WITH s AS (SELECT l_suppkey AS product_id, l_linenumber AS scan_row, l_partkey % 50 AS scan_col, l_quantity > 45 AND l_partkey % 50 BETWEEN 10 AND 20 AS inside FROM lineitem),
w AS (SELECT product_id, min(scan_row) AS r0, max(scan_row) AS r1, min(scan_col) AS c0, max(scan_col) AS c1 FROM s WHERE inside GROUP BY ALL)
SELECT product_id, count(*) AS pixels, max(scan_row) AS last_row, max(scan_col) AS last_col FROM s JOIN w USING (product_id) WHERE scan_row BETWEEN r0 AND r1 AND scan_col BETWEEN c0 AND c1 GROUP BY ALL""")
def swath_crop(spark, d):
    s = read(spark, d, "lineitem").selectExpr("l_suppkey AS product_id", "l_linenumber AS scan_row", "l_partkey % 50 AS scan_col", "l_quantity")
    out = spatial.crop_window(s, (F.col("l_quantity") > 45) & F.col("scan_col").between(10, 20))
    return out.groupBy("product_id").agg(F.count("*").alias("pixels"), F.max("scan_row").alias("last_row"), F.max("scan_col").alias("last_col"))


@query("""WITH i AS (SELECT p_partkey, CAST(p_partkey // 50 AS INT) AS scan_row, CAST(p_partkey % 50 AS INT) AS scan_col FROM part),
t AS (SELECT scan_row, scan_col // 10 AS tie_col, avg(p_size) AS z FROM i JOIN part USING (p_partkey) WHERE scan_col % 10 = 0 GROUP BY ALL)
SELECT i.p_partkey, round(a.z + (b.z - a.z) * (scan_col / 10.0 - floor(scan_col / 10.0)), 6) AS sat_zenith FROM i
LEFT JOIN t a ON a.scan_row = i.scan_row AND a.tie_col = floor(i.scan_col / 10.0) LEFT JOIN t b ON b.scan_row = i.scan_row AND b.tie_col = ceil(i.scan_col / 10.0)""")
def tie_points(spark, d):
    i = read(spark, d, "part").selectExpr("p_partkey", "cast(p_partkey div 50 as int) AS scan_row", "cast(p_partkey % 50 as int) AS scan_col", "p_size")
    ties = i.where("scan_col % 10 = 0").groupBy("scan_row", F.expr("cast(scan_col div 10 as int)").alias("tie_col")).agg(F.avg("p_size").alias("sat_zenith"))
    return rounded(spatial.tie_point_lerp(i.drop("p_size"), ties, "sat_zenith", step=10).select("p_partkey", "sat_zenith"), "sat_zenith")


@query(f"WITH {cte('bands')} SELECT pixel, round(CASE WHEN B08 > 0 THEN pow(B02 * pow(B08 * 30 + 273.15, 4) + (1 - B02) * pow(B11 * 30 + 273.15, 4), 0.25) - 273.15 ELSE pow(B02 * pow(B11 * 30 + 273.15, 4) + (1 - B02) * pow(B11 * 30 + 273.15, 4), 0.25) - 273.15 END, 6) AS blended FROM bands")
def radiance_blend(spark, d):
    b = project(spark, d, "bands")
    local = F.when(F.col("B08") > 0, F.col("B08") * 30)
    return rounded(b.select("pixel", sc.radiance_blend(F.col("B02"), local, F.col("B11") * 30, 273.15).alias("blended")), "blended")


@query(f"WITH {cte('bands')}, c AS (SELECT SCL, sum(B11 * B12) / sum(B11 * B11) AS c FROM bands GROUP BY ALL) SELECT pixel, round((B12 - c * B11) / nullif(c * B11, 0), 6) AS mbsp FROM bands JOIN c USING (SCL)")
def methane_mbsp(spark, d):
    out = binning.methane_ratio(project(spark, d, "bands"), ["SCL"])
    return rounded(out.select("pixel", "mbsp"), "mbsp")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 7 >= 4 THEN -1000 ELSE 0 END AS DOUBLE) AS boa_offset, CAST(CASE WHEN o_custkey % 9 <> 0 THEN (o_custkey % 9) * CASE WHEN o_orderkey > 0 THEN 0.5 ELSE 1 END - 3 END AS DOUBLE) AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'a' WHEN o_orderkey % 3 = 0 THEN 'b' END AS asset FROM orders")
def band_scaling(spark, d):
    """Offsets by processing baseline, digital numbers to values, and assets under several names."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    assets = F.when(key % 2 == 0, F.create_map(F.lit("red"), F.lit("a"), F.lit("B04"), F.lit("b"))).when(key % 3 == 0, F.create_map(F.lit("B04"), F.lit("b"))).otherwise(F.create_map(F.lit("nir"), F.lit("c")))
    offset = readers.baseline_offset((key % 7).cast("string"), key % 5 == 0)
    value = readers.scaled_values(F.col("o_custkey") % 9, F.when(key > 0, 0.5), -3.0, nodata=0)
    return o.select("o_orderkey", offset.alias("boa_offset"), value.alias("value"), readers.asset_of(assets, ["red", "B04"]).alias("asset"))


@query(f"WITH {cte('obs')} SELECT event_id, NOT cloud_mask AND lst IS NOT NULL AS valid_mask, round(CASE WHEN NOT cloud_mask THEN lst - 273.15 END, 6) AS lst FROM obs")
def cloudless_temperature(spark, d):
    raw = obs(spark, d).select("event_id", "lst", F.when(F.col("cloud_mask"), 1).otherwise(0).alias("cloud"))
    return rounded(readers.cloudless_temperature(raw).select("event_id", "valid_mask", "lst"), "lst")


@query(f"WITH {cte('bands')} SELECT pixel, round(CASE WHEN SCL <= 3 THEN 10 * log10(greatest(B08, 1e-10)) END, 6) AS vv FROM bands")
def masked_backscatter(spark, d):
    b = project(spark, d, "bands").select("pixel", F.col("B08").alias("vv"), F.when(F.col("SCL") <= 3, 1).otherwise(0).alias("data_mask"))
    return rounded(readers.masked_radar(b, ["vv"], output="dB").select("pixel", "vv"), "vv")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_props_extract(spark, d):
    return read(spark, d, "events").select("event_id", readers.json_number(F.col("props"), "$.k").alias("k"))


@query("SELECT event_id, event_type IN ('error', 'click') AS flagged FROM events")
def flag_meanings(spark, d):
    """Flag bits selected by their meaning."""
    mask = sc.bits_about(sc.flag_table([1, 2, 4], "Summary_Cloud cirrus_test land"))
    bits = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 2).otherwise(4)
    return read(spark, d, "events").select("event_id", sc.has_flag(bits, mask).alias("flagged"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d') || 'T' || '101530', '%Y%m%dT%H%M%S') AS sensed FROM orders")
def name_times(spark, d):
    name = F.concat(F.lit("S3A_SL_2_LST____"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T101530_x"))
    return read(spark, d, "orders").select("o_orderkey", readers.name_time(name).cast("timestamp_ntz").alias("sensed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS cloud, o_orderpriority AS prio FROM orders")
def attribute_maps(spark, d):
    """Attribute lists to maps, the last value of a name winning."""
    pair = lambda n, v: F.struct(F.lit(n).alias("Name"), v.alias("Value"))
    listed = F.array(pair("cloud", F.col("o_orderstatus")), pair("prio", F.col("o_orderpriority")))
    more = F.when(F.col("o_orderkey") % 3 == 0, F.array_append(listed, pair("cloud", F.col("o_orderpriority")))).otherwise(listed)
    m = read(spark, d, "orders").select("o_orderkey", readers.attribute_map(more).alias("m"))
    return m.select("o_orderkey", F.col("m")["cloud"].alias("cloud"), F.col("m")["prio"].alias("prio"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Polygon' WHEN o_orderkey % 3 = 0 THEN 'MultiPolygon' END AS kind FROM orders")
def footprints(spark, d):
    geo = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"GeoFootprint":{"type":"Polygon"}}')).when(F.col("o_orderkey") % 3 == 0, F.lit('{"geometry":{"type":"MultiPolygon"}}')).otherwise(F.lit('{"geometry":{"coordinates":[]}}'))
    return read(spark, d, "orders").select("o_orderkey", F.get_json_object(readers.footprint(geo), "$.type").alias("kind"))


# --- the monthly fine grid --------------------------------------------------------------------

FINE_SQL = f"WITH {cte('pixel')}, fine AS (SELECT scene, iy, ix, round(avg(lst), 9) AS lst, round(avg(ndvi), 9) AS ndvi, round(avg(ndbi), 9) AS ndbi FROM pixel GROUP BY ALL)"
COARSE_SQL = f"{FINE_SQL}, coarse AS (SELECT scene, CAST(iy // 4 AS INT) AS iy, CAST(ix // 4 AS INT) AS ix, avg(lst) AS lst, avg(ndvi) AS ndvi, avg(ndbi) AS ndbi FROM fine GROUP BY ALL)"


def fine(spark, d):
    """Monthly cells of a 16 x 16 grid; some are absent."""
    binned = binning.bin_points(project(spark, d, "pixel"), ["lst", "ndvi", "ndbi"])
    return rounded(binned.select("scene", "iy", "ix", "lst", "ndvi", "ndbi"), "lst", "ndvi", "ndbi", digits=9)


def coarse(spark, d):
    return binning.block_mean(fine(spark, d), 4, ["lst", "ndvi", "ndbi"])


@query(f"{COARSE_SQL} SELECT scene, iy, ix, round(lst, 6) AS lst, round(ndvi, 13) AS ndvi FROM coarse")
def mean_regrid(spark, d):
    return rounded(rounded(coarse(spark, d).select("scene", "iy", "ix", "lst", "ndvi"), "lst"), "ndvi", digits=13)


@query(f"{FINE_SQL} SELECT scene, CAST(iy // 3 AS INT) AS iy, CAST(ix // 3 AS INT) AS ix, round(CASE WHEN count(lst) >= 6 THEN avg(lst) END, 6) AS lst FROM fine WHERE iy < 15 AND ix < 15 GROUP BY ALL")
def block_aggregate(spark, d):
    return rounded(binning.block_mean(fine(spark, d), 3, ["lst"], min_share=2 / 3, height=16, width=16), "lst")


@query(f"{COARSE_SQL} SELECT f.scene, f.iy, f.ix, round(c.lst, 6) AS lst_coarse FROM fine f LEFT JOIN coarse c ON f.scene = c.scene AND c.iy = f.iy // 4 AND c.ix = f.ix // 4")
def broadcast_down(spark, d):
    f = fine(spark, d)
    return rounded(spatial.spread_down(f, binning.block_mean(f, 4, ["lst"]), 4, ["lst"], suffix="_coarse").select("scene", "iy", "ix", "lst_coarse"), "lst_coarse")


@query(f"""{COARSE_SQL}, p AS (SELECT scene, iy, ix, greatest(0, least(3, (iy + 0.5) / 4 - 0.5)) AS py, greatest(0, least(3, (ix + 0.5) / 4 - 0.5)) AS px FROM fine),
k AS (SELECT p.*, dy, dx, (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM p, range(2) a(dy), range(2) b(dx))
SELECT k.scene, k.iy, k.ix, round(CASE WHEN count(c.lst) = count(*) THEN sum(c.lst * w) END, 6) AS up FROM k LEFT JOIN coarse c ON c.scene = k.scene AND c.iy = floor(py) + dy AND c.ix = floor(px) + dx WHERE w > 0 GROUP BY ALL""")
def bilinear_up(spark, d):
    f = fine(spark, d).select("scene", "iy", "ix")
    return rounded(spatial.bilinear_up(f, coarse(spark, d), 4, "lst", height=4, width=4, out="up"), "up")


@query(f"""{FINE_SQL}, t AS (SELECT DISTINCT scene FROM fine), c AS (SELECT scene, iy, ix, 1.7 + ix * 2.3 AS x, -0.45 - iy * 1.1 AS y FROM t, range(8) a(iy), range(8) b(ix))
SELECT c.scene, c.iy, c.ix, round(f.ndvi, 8) AS ndvi FROM c LEFT JOIN fine f ON f.scene = c.scene AND f.ix = floor(x) AND f.iy = ceil(-y) - 1""")
def nearest_cell_regrid(spark, d):
    f = fine(spark, d)
    targets = f.select("scene").distinct().crossJoin(F.broadcast(spatial.cells_table(spark, 8, 8)))
    out = spatial.nearest_cell(targets, f, F.lit(1.7) + F.col("ix") * 2.3, F.lit(-0.45) - F.col("iy") * 1.1, left=0.0, top=0.0, step=1.0, width=16, height=16, values=["ndvi"])
    return rounded(out.select("scene", "iy", "ix", "ndvi"), "ndvi", digits=8)


#: A grid in degrees over the swath, and one in metres of another system.
GEO = Grid("EPSG:4326", 13.2, 52.6, 0.02, 18, 10)
MERCATOR = Grid("EPSG:3857", 1_469_000.0, 6_899_000.0, 1_700.0, 24, 18)
RADIUS_M = 6378137.0
GEO_SQL = f"""WITH {cte('swath')}, g AS (SELECT scene, CAST(floor(({GEO.top} - lat) / {GEO.resolution}) AS INT) AS iy, CAST(floor((lon - {GEO.left}) / {GEO.resolution}) AS INT) AS ix, avg(value) AS v FROM swath WHERE lat <= {GEO.top} AND lat > {GEO.top - GEO.height * GEO.resolution} GROUP BY ALL),
t AS (SELECT CAST(a AS INT) AS iy, CAST(b AS INT) AS ix, degrees(({MERCATOR.left} + (b + 0.5) * {MERCATOR.resolution}) / {RADIUS_M}) AS lon, degrees(2 * atan(exp(({MERCATOR.top} - (a + 0.5) * {MERCATOR.resolution}) / {RADIUS_M})) - pi() / 2) AS lat FROM range({MERCATOR.height}) p(a), range({MERCATOR.width}) q(b)),
n AS (SELECT iy, ix, (lon - {GEO.left}) / {GEO.resolution} AS px, ({GEO.top} - lat) / {GEO.resolution} AS py FROM t), h AS (SELECT * FROM n WHERE px BETWEEN 0 AND {GEO.width} AND py BETWEEN 0 AND {GEO.height})"""


def geographic(spark, d):
    """Daily means of the swath on the grid in degrees."""
    s = project(spark, d, "swath")
    return resample.grid_points(s, GEO, ["value"]).select("scene", "iy", "ix", "value")


def reprojected(spark, d, method):
    return rounded(resample.resample(geographic(spark, d), GEO, MERCATOR, ["value"], method), "value")


@query(f"{GEO_SQL} SELECT g.scene, h.iy, h.ix, round(v, 6) AS value FROM h JOIN g ON g.iy = least(floor(py), {GEO.height - 1}) AND g.ix = least(floor(px), {GEO.width - 1})")
def reproject_nearest(spark, d):
    """Grid centres in metres take the cell in degrees that holds them."""
    return reprojected(spark, d, "nearest")


@query(f"""{GEO_SQL}, k AS (SELECT h.iy, h.ix, floor(py - 0.5) + dy AS sy, floor(px - 0.5) + dx AS sx, (CASE WHEN dy = 1 THEN py - 0.5 - floor(py - 0.5) ELSE 1 - (py - 0.5 - floor(py - 0.5)) END) * (CASE WHEN dx = 1 THEN px - 0.5 - floor(px - 0.5) ELSE 1 - (px - 0.5 - floor(px - 0.5)) END) AS w FROM h, range(2) a(dy), range(2) b(dx))
SELECT scene, k.iy, k.ix, round(sum(v * w) / sum(w), 6) AS value FROM k JOIN g ON g.iy = sy AND g.ix = sx WHERE w > 0 GROUP BY ALL""")
def reproject_bilinear(spark, d):
    return reprojected(spark, d, "bilinear")


@query(f"""{GEO_SQL}, c AS (SELECT scene, v, floor(({MERCATOR.top} - {RADIUS_M} * ln(tan(pi() / 4 + radians({GEO.top} - iy * {GEO.resolution} - {GEO.resolution / 2}) / 2))) / {MERCATOR.resolution}) AS ty, floor(({RADIUS_M} * radians({GEO.left} + ix * {GEO.resolution} + {GEO.resolution / 2}) - {MERCATOR.left}) / {MERCATOR.resolution}) AS tx FROM g)
SELECT scene, CAST(ty AS INT) AS iy, CAST(tx AS INT) AS ix, round(avg(v), 6) AS value FROM c WHERE ty BETWEEN 0 AND {MERCATOR.height - 1} AND tx BETWEEN 0 AND {MERCATOR.width - 1} GROUP BY ALL""")
def reproject_mean(spark, d):
    return reprojected(spark, d, "mean")


@query(f"{FINE_SQL} SELECT CAST(iy // 5 AS INT) AS chip_row, CAST(ix // 5 AS INT) AS chip_col, count(*) AS cells FROM fine WHERE iy < 15 AND ix < 15 GROUP BY ALL")
def chips(spark, d):
    """Cells of the whole 5 x 5 tiles of the grid, by the bounds of the tiles."""
    grid = Grid("EPSG:32633", 0.0, 1600.0, 100.0, 16, 16)
    tiles = [(*map(int, c.grid_id.split("/")[-2:]), c.left, c.top) for c in grid.chips(5)]
    side = 5 * grid.resolution
    placed = fine(spark, d).select((F.floor(grid.x() / side) * side).alias("left"), (F.lit(grid.top) - F.floor((F.lit(grid.top) - grid.y()) / side) * side).alias("top"))
    known = spark.createDataFrame(tiles, "chip_row int, chip_col int, left double, top double")
    return placed.join(known, ["left", "top"]).groupBy("chip_row", "chip_col").agg(F.count("*").alias("cells"))


@query(f"{FINE_SQL}, e AS (SELECT min(scene) AS a, max(scene) AS b FROM fine), p AS (SELECT scene, iy, ix, ndvi + 0.02 AS x, ndbi + 0.05 AS y FROM fine), c AS (SELECT scene, sum(x * y) / sum(x * x) AS c FROM p GROUP BY ALL), m AS (SELECT scene, iy, ix, (y - c * x) / (c * x) AS s FROM p JOIN c USING (scene)) SELECT d.iy, d.ix, round(d.s - r.s, 6) AS mbmp FROM m d JOIN m r ON d.iy = r.iy AND d.ix = r.ix, e WHERE d.scene = b AND r.scene = a")
def methane_mbmp(spark, d):
    """The last scene against the first."""
    p = fine(spark, d).select("scene", "iy", "ix", (F.col("ndvi") + 0.02).alias("B11"), (F.col("ndbi") + 0.05).alias("B12"))
    signal = binning.methane_ratio(p, ["scene"])
    ends = p.agg(F.min("scene").alias("first"), F.max("scene").alias("last")).first()
    out = binning.methane_change(signal.where(F.col("scene") == ends["last"]), signal.where(F.col("scene") == ends["first"]))
    return rounded(out.select("iy", "ix", "mbmp"), "mbmp")


SPLIT_SQL = """, t AS (SELECT scene, row_number() OVER (ORDER BY scene) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT scene FROM fine)),
s AS (SELECT f.*, k >= greatest(1, floor(n * 0.8 + 1e-9)) AS late, (iy // 2 + ix // 2) % 5 = 0 AS held FROM fine f JOIN t USING (scene))"""


def split(spark, d):
    return validation.blocked_split(fine(spark, d), block=2)


@query(f"{FINE_SQL}{SPLIT_SQL} SELECT scene, iy, ix FROM s WHERE NOT late AND NOT held")
def holdout_train(spark, d):
    return split(spark, d).where("train").select("scene", "iy", "ix")


@query(f"{FINE_SQL}{SPLIT_SQL} SELECT scene, iy, ix FROM s WHERE late AND held")
def holdout_validation(spark, d):
    return split(spark, d).where("validation").select("scene", "iy", "ix")


@query(f"{FINE_SQL}{SPLIT_SQL} SELECT scene, iy, ix FROM s WHERE NOT late AND held")
def holdout_calibration(spark, d):
    return split(spark, d).where("calibration").select("scene", "iy", "ix")


@query(f"{COARSE_SQL}, j AS (SELECT f.lst AS e, c.lst AS r FROM fine f JOIN coarse c ON f.scene = c.scene AND c.iy = f.iy // 4 AND c.ix = f.ix // 4) SELECT count(*) AS samples, round(avg(e - r), 6) AS bias, round(avg(abs(e - r)), 6) AS mae, round(sqrt(avg((e - r) * (e - r))), 6) AS rmse, round(corr(e, r), 6) AS correlation FROM j")
def compare_metrics(spark, d):
    f = fine(spark, d)
    joined = spatial.spread_down(f, binning.block_mean(f, 4, ["lst"]), 4, ["lst"], suffix="_ref")
    return rounded(validation.compare(joined, "lst", "lst_ref"), "bias", "mae", "rmse", "correlation")


FIT_SQL = ", m AS (SELECT scene, count(*) AS samples, regr_slope(lst, ndvi) AS b1, regr_intercept(lst, ndvi) AS b0, min(ndvi) AS lo, max(ndvi) AS hi FROM coarse GROUP BY ALL HAVING count(*) >= 10 AND regr_sxx(lst, ndvi) > 1e-9)"


@query(f"{COARSE_SQL}{FIT_SQL} SELECT scene, samples, round(b1, 4) AS b1, round(b0, 4) AS b0 FROM m")
def tsharp_fit(spark, d):
    m = downscale.fit_linear(coarse(spark, d), "lst", ["ndvi"], min_samples=10)
    return rounded(m.select("scene", "samples", "b1", "b0"), "b1", "b0", digits=4)


#: Predictors rounded before they are compared, as sums differ in their last digit between engines.
NINE_SQL = COARSE_SQL + ", nine AS (SELECT scene, lst, round(ndvi, 9) AS ndvi FROM coarse)" + FIT_SQL.replace("FROM coarse", "FROM nine")


@query(f"{NINE_SQL} SELECT f.scene, f.iy, f.ix, round(b0 + b1 * least(greatest(round(ndvi, 9), lo), hi), 4) AS lst_downscaled, round(ndvi, 9) < lo OR round(ndvi, 9) > hi AS downscaled_extrapolation FROM fine f JOIN m USING (scene)")
def tsharp_predict(spark, d):
    nine = lambda df: df.withColumn("ndvi", F.round("ndvi", 9))
    m = downscale.fit_linear(nine(coarse(spark, d)), "lst", ["ndvi"], min_samples=10)
    out = downscale.predict_linear(nine(fine(spark, d)).select("scene", "iy", "ix", "ndvi"), m, ["ndvi"])
    return rounded(out.select("scene", "iy", "ix", "lst_downscaled", "downscaled_extrapolation"), "lst_downscaled", digits=4)


@query(f"""{COARSE_SQL}, c AS (SELECT scene, count(*) AS n, covar_pop(ndvi, ndvi) AS xx, covar_pop(ndbi, ndbi) AS zz, covar_pop(ndvi, ndbi) AS xz, covar_pop(ndvi, lst) AS xy, covar_pop(ndbi, lst) AS zy FROM coarse GROUP BY ALL HAVING count(*) >= 10)
SELECT scene, n AS samples, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 3) AS b1, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 3) AS b2 FROM c WHERE xx * zz - xz * xz > xx * zz * 1e-12 AND xx * zz > 0""")
def ols2_fit(spark, d):
    m = downscale.fit_linear(coarse(spark, d), "lst", ["ndvi", "ndbi"], min_samples=10)
    return rounded(m.select("scene", "samples", "b1", "b2"), "b1", "b2", digits=3)


SHARP_SQL = f"""{COARSE_SQL}{FIT_SQL}, p AS (SELECT f.scene, f.iy, f.ix, b0 + b1 * least(greatest(f.ndvi, lo), hi) AS v FROM fine f JOIN m USING (scene)),
r AS (SELECT p.scene, p.iy // 4 AS cy, p.ix // 4 AS cx, avg(v) AS a FROM p GROUP BY ALL)"""


@query(f"{SHARP_SQL} SELECT p.scene, p.iy, p.ix, round(v + c.lst - a, 4) AS lst_downscaled FROM p JOIN r ON p.scene = r.scene AND r.cy = p.iy // 4 AND r.cx = p.ix // 4 JOIN coarse c ON c.scene = p.scene AND c.iy = cy AND c.ix = cx")
def block_conservation(spark, d):
    m = downscale.fit_linear(coarse(spark, d), "lst", ["ndvi"], min_samples=10)
    out = downscale.conserve_blocks(downscale.predict_linear(fine(spark, d).select("scene", "iy", "ix", "ndvi"), m, ["ndvi"]), coarse(spark, d), "lst", 4)
    return rounded(out.select("scene", "iy", "ix", "lst_downscaled"), "lst_downscaled", digits=4)


@query(f"{SHARP_SQL} SELECT p.scene, p.iy, p.ix, round(v + c.lst - a, 4) AS lst_downscaled, true AS coarse_observed FROM p JOIN r ON p.scene = r.scene AND r.cy = p.iy // 4 AND r.cx = p.ix // 4 JOIN coarse c ON c.scene = p.scene AND c.iy = cy AND c.ix = cx")
def per_scene_linear(spark, d):
    out = downscale.sharpen_linear(coarse(spark, d).select("scene", "iy", "ix", "lst"), fine(spark, d), "lst", ["ndvi"], 4, min_samples=10)
    return rounded(out.select("scene", "iy", "ix", "lst_downscaled", "coarse_observed"), "lst_downscaled", digits=4)


@query(f"""{FINE_SQL}, coarse AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, CASE WHEN count(lst) >= 16 * 2 / 3.0 - 1e-9 THEN avg(lst) END AS lst FROM fine GROUP BY ALL), x AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, avg(ndvi) AS ndvi FROM fine GROUP BY ALL),
m AS (SELECT scene, regr_slope(lst, ndvi) AS b1, regr_intercept(lst, ndvi) AS b0, min(ndvi) FILTER (lst IS NOT NULL) AS lo, max(ndvi) FILTER (lst IS NOT NULL) AS hi FROM coarse JOIN x USING (scene, iy, ix) GROUP BY ALL HAVING count(lst) >= 5 AND regr_sxx(lst, ndvi) > 1e-12),
p AS (SELECT f.scene, f.iy, f.ix, b0 + b1 * least(greatest(f.ndvi, lo), hi) AS v FROM fine f JOIN m USING (scene)), r AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, avg(v) AS a FROM p GROUP BY ALL)
SELECT p.scene, p.iy, p.ix, round(v + coalesce(c.lst - a, 0), 4) AS lst_downscaled FROM p JOIN r ON p.scene = r.scene AND r.iy = p.iy // 4 AND r.ix = p.ix // 4 LEFT JOIN coarse c ON c.scene = p.scene AND c.iy = r.iy AND c.ix = r.ix""")
def sharpen_blocks(spark, d):
    f = fine(spark, d)
    out = downscale.sharpen_blocks(f, f, "lst", ["ndvi"], 4, min_samples=5)
    return rounded(out.select("scene", "iy", "ix", "lst_downscaled"), "lst_downscaled", digits=4)


def predicted(spark, d):
    m = downscale.fit_linear(coarse(spark, d), "lst", ["ndvi"], min_samples=10)
    return downscale.predict_linear(fine(spark, d).select("scene", "iy", "ix", "ndvi"), m, ["ndvi"])


def smooth_sql(rounds: int) -> str:
    """Residuals interpolated and added again and again, each round in the open."""
    weight = "(CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END)"
    parts = [f"{COARSE_SQL}{FIT_SQL}, c0 AS (SELECT f.scene, f.iy, f.ix, b0 + b1 * least(greatest(f.ndvi, lo), hi) AS v, CAST(0 AS DOUBLE) AS corr FROM fine f JOIN m USING (scene))"]
    parts.append(f"k AS (SELECT *, {weight} AS w FROM (SELECT scene, iy, ix, greatest(0, least(3, (iy + 0.5) / 4 - 0.5)) AS py, greatest(0, least(3, (ix + 0.5) / 4 - 0.5)) AS px FROM c0), range(2) a(dy), range(2) b(dx))")
    for n in range(1, rounds + 1):
        parts.append(f"a{n} AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, avg(v + corr) AS a FROM c{n - 1} GROUP BY ALL)")
        parts.append(f"r{n} AS (SELECT c.scene, c.iy, c.ix, coalesce(c.lst - a.a, 0) AS r FROM coarse c LEFT JOIN a{n} a ON a.scene = c.scene AND a.iy = c.iy AND a.ix = c.ix)")
        parts.append(f"u{n} AS (SELECT k.scene, k.iy, k.ix, CASE WHEN count(r.r) = count(*) THEN sum(r.r * w) END AS u FROM k LEFT JOIN r{n} r ON r.scene = k.scene AND r.iy = floor(py) + dy AND r.ix = floor(px) + dx WHERE w > 0 GROUP BY ALL)")
        parts.append(f"c{n} AS (SELECT c.scene, c.iy, c.ix, v, corr + coalesce(u, 0) AS corr FROM c{n - 1} c JOIN u{n} u USING (scene, iy, ix))")
    return ", ".join(parts) + f" SELECT scene, iy, ix, round(v + corr, 4) AS lst_downscaled FROM c{rounds}"


@query(smooth_sql(10))
def smooth_conservation(spark, d):
    out = downscale.conserve_smooth(predicted(spark, d), coarse(spark, d), "lst", 4, height=4, width=4)
    return rounded(out.select("scene", "iy", "ix", "lst_downscaled"), "lst_downscaled", digits=4)


@query()
def atpk_field(spark, d):
    return rounded(kriging.conserve_kriged(predicted(spark, d), coarse(spark, d), "lst", 4, (4, 4)), "lst_downscaled", "coarse_consistency_correction")


@query()
def thermal_sharpening(spark, d):
    """Block means of a thermal band, a linear fit and kriged residuals."""
    f = fine(spark, d)
    return rounded(kriging.sharpen_thermal(f, f, "lst", ["ndvi"], 4, (4, 4), min_samples=5), "lst_downscaled", "coarse_consistency_correction")


@query()
def local_trees(spark, d):
    f = fine(spark, d)
    weights = downscale.homogeneity_weights(f, ["ndvi", "ndbi"], 4)
    out = trees.local_trees(coarse(spark, d), f, "lst", ["ndvi", "ndbi"], 4, (4, 4), min_samples=10, weights=weights)
    return rounded(out, "lst_downscaled", "lst_downscaled_uncertainty")


def by_ensemble(spark, d, kind):
    out = forests.scene_ensemble(coarse(spark, d), fine(spark, d), "lst", ["ndvi", "ndbi"], 4, kind, min_samples=10)
    return rounded(out, "lst_downscaled", "lst_downscaled_uncertainty")


@query()
def random_forest(spark, d):
    return by_ensemble(spark, d, "forest")


@query()
def gradient_boosting(spark, d):
    return by_ensemble(spark, d, "boosted")


@query(f"{COARSE_SQL} SELECT scene, count(CASE WHEN ndvi >= 0.04871 THEN lst END) AS samples FROM coarse GROUP BY scene HAVING count(CASE WHEN ndvi >= 0.04871 THEN lst END) < 9")
def skipped_scenes(spark, d):
    """Scenes in which too few cells have a target, where low values of the predictor hide it."""
    hidden = coarse(spark, d).withColumn("lst", F.when(F.col("ndvi") >= 0.04871, F.col("lst")))
    return trees.skipped_scenes(hidden, "lst", ["ndvi"], 9).select("scene", "samples")


GWR_SQL = f"""{COARSE_SQL}, s AS (SELECT iy AS py, ix AS px, count(*) AS n, sum(ndvi) AS sx, sum(lst) AS sy, sum(ndvi * ndvi) AS sxx, sum(ndvi * lst) AS sxy FROM coarse GROUP BY ALL),
c AS (SELECT DISTINCT iy, ix FROM fine), j AS (SELECT c.iy, c.ix, s.*, pow((c.ix + 0.5) / 4 - 0.5 - px, 2) + pow((c.iy + 0.5) / 4 - 0.5 - py, 2) AS d2 FROM c, s),
w AS (SELECT *, pow(1 - d2 / 4, 2) AS w FROM j WHERE d2 < 4), a AS (SELECT iy, ix, sum(n) AS ls, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * sxy) AS sxy FROM w GROUP BY ALL HAVING sum(n) >= 10)
SELECT iy, ix, CAST(ls AS BIGINT) AS local_samples, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 3) AS b1 FROM a"""


@query(GWR_SQL)
def gwr_fit(spark, d):
    c = coarse(spark, d).withColumn("x", F.col("ix").cast("double")).withColumn("y", F.col("iy").cast("double"))
    cells_xy = fine(spark, d).select("iy", "ix").distinct().withColumn("x", (F.col("ix") + 0.5) / 4 - 0.5).withColumn("y", (F.col("iy") + 0.5) / 4 - 0.5)
    out = gwr.gwr(cells_xy, c, "lst", ["ndvi"], bandwidth=2.0)
    return rounded(longs(out.select("iy", "ix", "local_samples", "b1"), "local_samples"), "b1", digits=3)


@query(f"""{FINE_SQL}, cv AS (SELECT scene, iy // 4 AS iy, ix // 4 AS ix, CASE WHEN abs(avg(ndvi)) > 1e-6 THEN stddev_pop(ndvi) / abs(avg(ndvi)) END AS cv FROM fine GROUP BY ALL),
w AS (SELECT *, CASE WHEN cv > 1e-6 THEN 1 / cv END AS w FROM cv), e AS (SELECT scene, min(w) AS lo, max(w) AS hi FROM w GROUP BY ALL)
SELECT scene, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(CASE WHEN hi IS NULL OR hi <= lo THEN 1 WHEN w IS NULL THEN 0.05 ELSE least(greatest((w - lo) / (hi - lo), 0.05), 1) END, 8) AS weight FROM w JOIN e USING (scene)""")
def homogeneity_weights(spark, d):
    return rounded(downscale.homogeneity_weights(fine(spark, d), ["ndvi"], 4), "weight", digits=8)


def semivariogram_sql(lag: int) -> str:
    return f"{FINE_SQL} SELECT a.scene, CAST(b.iy - a.iy AS INT) AS dy, CAST(b.ix - a.ix AS INT) AS dx, round(avg((a.lst - b.lst) * (a.lst - b.lst)) / 2, 5) AS gamma, count(*) AS pairs FROM fine a JOIN fine b ON a.scene = b.scene AND b.iy - a.iy BETWEEN 0 AND {lag} AND b.ix - a.ix BETWEEN -{lag} AND {lag} AND (b.iy > a.iy OR b.ix > a.ix) GROUP BY ALL HAVING count(*) >= 5"


@query(semivariogram_sql(8))
def semivariogram(spark, d):
    return rounded(neighbourhood.semivariogram(fine(spark, d), "lst"), "gamma", digits=5)


@query(f"WITH {cte('obs')}, s AS (SELECT abs(lst - 300) AS s, row_number() OVER (ORDER BY abs(lst - 300)) AS k, count(*) OVER () AS n FROM obs WHERE lst IS NOT NULL) SELECT round(s, 9) AS quantile, n AS samples FROM s WHERE k = ceil((n - 1) * least(1.0, ceil((n + 1) * CAST(0.9 AS DOUBLE)) / CAST(n AS DOUBLE))) + 1")
def conformal_quantile(spark, d):
    out = validation.conformal_quantile(obs(spark, d).select(F.abs(F.col("lst") - 300).alias("s")), "s")
    return rounded(out.select("quantile", "samples"), "quantile", digits=9)


CONFORMAL_SQL = f"""WITH {cte('bands')}, c AS (SELECT *, greatest(B03 + 0.05, (SELECT greatest(quantile_cont(B03 + 0.05, 0.05), 1e-6) FROM bands)) AS sp FROM bands),
s AS (SELECT abs(B08 - B11) / sp AS s, row_number() OVER (ORDER BY abs(B08 - B11) / sp) AS k, count(*) OVER () AS n FROM c), q AS (SELECT s AS q FROM s WHERE k = ceil((n - 1) * least(1.0, ceil((n + 1) * CAST(0.9 AS DOUBLE)) / CAST(n AS DOUBLE))) + 1)"""


@query(f"{CONFORMAL_SQL} SELECT pixel, round(B08 - q * sp, 6) AS B08_lower, round(B08 + q * sp, 6) AS B08_upper FROM c, q")
def conformal_interval(spark, d):
    b = project(spark, d, "bands").withColumn("sp", F.col("B03") + 0.05)
    model = validation.fit_conformal(b, "B08", "B11", spread="sp")
    return rounded(validation.conformal_interval(b, model, "B08", spread="sp").select("pixel", "B08_lower", "B08_upper"), "B08_lower", "B08_upper")


@query(f"WITH {cte('obs')}, n AS (SELECT scene, iy, count(lst) AS n FROM obs GROUP BY ALL), b AS (SELECT scene, arg_max(iy, n * 1000000 - iy) AS iy FROM n GROUP BY ALL) SELECT scene, iy, event_id FROM obs JOIN b USING (scene, iy)")
def fullest_tiles(spark, d):
    """Rows of the grid stand for tiles; each day keeps the one with most valid pixels."""
    return temporal.fullest_tile(obs(spark, d), "lst", tile="iy", group="scene").select("scene", "iy", "event_id")


@query(f"WITH {cte('bands')} SELECT pixel, round(sqrt((pow(B02 - (B02 + B03 + B04) / 3, 2) + pow(B03 - (B02 + B03 + B04) / 3, 2) + pow(B04 - (B02 + B03 + B04) / 3, 2)) / 2), 6) AS spread FROM bands")
def ensemble_spread(spark, d):
    return rounded(downscale.ensemble_spread(project(spark, d, "bands"), ["B02", "B03", "B04"]).select("pixel", "spread"), "spread")


def triples(spark, d):
    """Fine cells with two coarse dates derived from them."""
    f = fine(spark, d).select("scene", "iy", "ix", F.col("lst").alias("fine0"), (F.col("lst") + F.col("ndbi") * 10).alias("fine2"), (F.col("lst") * 0.5 + F.col("iy")).alias("coarse0"), (F.col("lst") * 0.4 + F.col("ndvi") * 5).alias("coarse2"), (F.col("lst") * 0.6 + F.col("ix")).alias("coarse1"))
    return f


TRIPLE_SQL = f"{FINE_SQL}, t AS (SELECT scene, iy, ix, lst AS fine0, lst + ndbi * 10 AS fine2, lst * 0.5 + iy AS coarse0, lst * 0.4 + ndvi * 5 AS coarse2, lst * 0.6 + ix AS coarse1 FROM fine), l AS (SELECT scene, 2 * stddev_pop(fine0) AS lim FROM t GROUP BY ALL)"


def starfm_sql(radius: int) -> str:
    scale = f" / {radius}" if radius > 1 else ""
    return f"""{TRIPLE_SQL}, j AS (SELECT a.scene, a.iy, a.ix, b.fine0 + b.coarse1 - b.coarse0 AS p, 1 / ((abs(b.fine0 - a.fine0) + 1e-6) * (abs(b.coarse1 - b.coarse0) + 1e-6) * (1 + sqrt(pow(a.iy - b.iy, 2) + pow(a.ix - b.ix, 2)){scale})) AS w
FROM t a JOIN l USING (scene) JOIN t b ON a.scene = b.scene AND abs(a.iy - b.iy) <= {radius} AND abs(a.ix - b.ix) <= {radius} AND abs(b.fine0 - a.fine0) <= lim)
SELECT scene, iy, ix, round(sum(w * p) / sum(w), 2) AS predicted FROM j GROUP BY ALL"""


@query(starfm_sql(10))
def starfm(spark, d):
    return rounded(neighbourhood.starfm(triples(spark, d)).select("scene", "iy", "ix", "predicted"), "predicted", digits=2)


def regression_sql(k: int, radius: int) -> str:
    return f"""r{k} AS (SELECT scene, iy, ix, CASE WHEN ok THEN (sxy / n - mx * my) / v ELSE 1 END AS slope, CASE WHEN ok THEN greatest(syy - (my - (sxy / n - mx * my) / v * mx) * sy - (sxy / n - mx * my) / v * sxy, 0) / greatest(n - 2, 1) END AS rv FROM
(SELECT *, sx / n AS mx, sy / n AS my, sxx / n - pow(sx / n, 2) AS v, n >= 3 AND sxx / n - pow(sx / n, 2) > 1e-9 AS ok FROM
(SELECT a.scene, a.iy, a.ix, count(*) AS n, sum(b.coarse{k}) AS sx, sum(b.fine{k}) AS sy, sum(b.coarse{k} * b.coarse{k}) AS sxx, sum(b.coarse{k} * b.fine{k}) AS sxy, sum(b.fine{k} * b.fine{k}) AS syy
FROM t a JOIN l USING (scene) JOIN t b ON a.scene = b.scene AND abs(a.iy - b.iy) <= {radius} AND abs(a.ix - b.ix) <= {radius} AND abs(b.fine0 - a.fine0) <= lim GROUP BY ALL)))"""


def estarfm_sql(radius: int) -> str:
    return f"""{TRIPLE_SQL}, {regression_sql(0, radius)}, {regression_sql(2, radius)}, q AS (SELECT t.scene, t.iy, t.ix, coalesce(1 / (r0.rv + 1e-6), 1) AS w0, coalesce(1 / (r2.rv + 1e-6), 1) AS w2, fine0 + r0.slope * (coarse1 - coarse0) AS p0, fine2 + r2.slope * (coarse1 - coarse2) AS p2
FROM t JOIN r0 USING (scene, iy, ix) JOIN r2 ON t.scene = r2.scene AND t.iy = r2.iy AND t.ix = r2.ix) SELECT scene, iy, ix, round((w0 * p0 + w2 * p2) / (w0 + w2), 3) AS predicted FROM q"""


@query(estarfm_sql(10))
def estarfm(spark, d):
    return rounded(neighbourhood.estarfm(triples(spark, d)).select("scene", "iy", "ix", "predicted"), "predicted", digits=3)


@query(f"""WITH {cte('dem')}, g AS (SELECT a.iy, a.ix, CASE WHEN e.z IS NOT NULL AND w.z IS NOT NULL THEN (e.z - w.z) / 2 WHEN e.z IS NOT NULL THEN e.z - a.z WHEN w.z IS NOT NULL THEN a.z - w.z END / 100 AS dx,
-(CASE WHEN s.z IS NOT NULL AND n.z IS NOT NULL THEN (s.z - n.z) / 2 WHEN s.z IS NOT NULL THEN s.z - a.z WHEN n.z IS NOT NULL THEN a.z - n.z END) / 100 AS dy
FROM dem a LEFT JOIN dem e ON e.iy = a.iy AND e.ix = a.ix + 1 LEFT JOIN dem w ON w.iy = a.iy AND w.ix = a.ix - 1 LEFT JOIN dem s ON s.ix = a.ix AND s.iy = a.iy + 1 LEFT JOIN dem n ON n.ix = a.ix AND n.iy = a.iy - 1),
h AS (SELECT iy, ix, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, degrees(atan2(-dx, -dy)) + 360 AS a FROM g) SELECT iy, ix, round(slope, 5) AS slope, round(a - 360 * floor(a / 360), 4) AS aspect FROM h""")
def slope_aspect(spark, d):
    out = neighbourhood.slope_aspect(project(spark, d, "dem"), "z", 100.0).select("iy", "ix", "slope", "aspect")
    return rounded(rounded(out, "slope", digits=5), "aspect", digits=4)


# --- matching in time ---------------------------------------------------------------------------

ASOF_SQL = f"""{COARSE_SQL}, f AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) + 20 AS f FROM orders), t AS (SELECT DISTINCT scene FROM coarse),
r AS (SELECT scene, f, abs(epoch_us(CAST(scene AS TIMESTAMP)) - epoch_us(CAST(f AS TIMESTAMP))) AS us, row_number() OVER (PARTITION BY scene ORDER BY abs(epoch_us(CAST(scene AS TIMESTAMP)) - epoch_us(CAST(f AS TIMESTAMP))), f DESC) AS k FROM t, f WHERE abs(epoch_us(CAST(scene AS TIMESTAMP)) - epoch_us(CAST(f AS TIMESTAMP))) <= 1036800000000),
m AS (SELECT t.scene, r.f AS matched_time, r.us AS time_delta_us FROM t LEFT JOIN r ON r.scene = t.scene AND r.k = 1)"""


def feature_scenes(spark, d):
    """A feature scene on day 20 of every quarter with an order, on the coarse grid: nearer to some months than to others."""
    times = read(spark, d, "orders").select(F.date_add(F.trunc("o_orderdate", "quarter"), 20).alias("scene")).distinct()
    grid = spatial.cells_table(spark, 4, 4)
    return times.crossJoin(F.broadcast(grid)).withColumn("feature", (F.dayofyear("scene") * 100 + F.col("iy") * 10 + F.col("ix")).cast("double")).withColumn("valid_mask", F.col("ix") % 2 == 0)


@query(f"{ASOF_SQL} SELECT scene, matched_time, time_delta_us FROM m")
def asof_time_delta(spark, d):
    return temporal.nearest_times(coarse(spark, d), feature_scenes(spark, d), 12 * 86_400_000_000)


@query(f"{ASOF_SQL} SELECT c.scene, c.iy, c.ix, round(c.lst, 6) AS lst, CAST(dayofyear(matched_time) * 100 + c.iy * 10 + c.ix AS DOUBLE) AS feature, matched_time IS NOT NULL AND c.ix % 2 = 0 AS valid_mask FROM coarse c JOIN m USING (scene)")
def asof_align(spark, d):
    out = temporal.align(coarse(spark, d).select("scene", "iy", "ix", "lst"), feature_scenes(spark, d), ["feature", "valid_mask"], tolerance_us=12 * 86_400_000_000, name="s2")
    return rounded(out.select("scene", "iy", "ix", "lst", "feature", "valid_mask"), "lst")


@query(f"{ASOF_SQL} SELECT c.scene, c.iy, c.ix, round(c.lst, 6) AS lst, CAST(dayofyear(matched_time) * 100 + c.iy * 10 + c.ix AS DOUBLE) AS feature, matched_time IS NOT NULL AND c.ix % 2 = 0 AS sentinel2_valid_mask, time_delta_us AS sentinel2_time_delta_us, round(avg(CAST(matched_time IS NOT NULL AS INT)) OVER (PARTITION BY c.scene), 6) AS feature_availability FROM coarse c JOIN m USING (scene)")
def fuse_workflow(spark, d):
    """The whole fusion: nearest scenes, cell join, masks, availability."""
    cubes = {"sentinel3": coarse(spark, d).select("scene", "iy", "ix", "lst"), "sentinel2": feature_scenes(spark, d)}
    out = workflow.fuse(cubes, "sentinel3", {"sentinel2": 12.0})
    return rounded(out.select("scene", "iy", "ix", "lst", "feature", "sentinel2_valid_mask", "sentinel2_time_delta_us", "feature_availability"), "lst", "feature_availability")


@query(f"""{FINE_SQL}, g AS (SELECT scene FROM fine GROUP BY scene HAVING count(ndvi) >= 0.5 * count(*)), t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS scene FROM orders),
r AS (SELECT t.scene, g.scene AS f, row_number() OVER (PARTITION BY t.scene ORDER BY abs(t.scene - g.scene), g.scene) AS k FROM t JOIN g ON abs(t.scene - g.scene) <= 10) SELECT t.scene, f AS matched_time FROM t LEFT JOIN r ON r.scene = t.scene AND k = 1""")
def match_fine_scenes(spark, d):
    targets = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("scene"))
    return downscale.match_scenes(targets, fine(spark, d), index="ndvi", max_gap_us=10 * 86_400_000_000)


@query(f"WITH {cte('forecast')} SELECT valid_time, key, lead_us, run, value FROM (SELECT *, run + to_microseconds(lead_us) AS valid_time, row_number() OVER (PARTITION BY run + to_microseconds(lead_us), key ORDER BY lead_us, run, value) AS k FROM forecast) WHERE k = 1")
def freshest_forecast(spark, d):
    out = temporal.freshest_forecast(project(spark, d, "forecast"), ["value"], keys=["key"])
    return out.withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT epoch_us(date_trunc('minute', ts)) AS t, event_type FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k FROM t),
g AS (SELECT event_type, t, k, t AS a FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.t, o.k, CASE WHEN o.t - g.a > 1800000000 THEN o.t ELSE g.a END FROM g JOIN o ON o.event_type = g.event_type AND o.k = g.k + 1)
SELECT event_type, make_timestamp(a) AS pass_time, count(*) AS tiles FROM g GROUP BY ALL""")
def pass_groups(spark, d):
    """Anchored groups of tile times, half an hour long."""
    tiles = read(spark, d, "events").select("event_type", F.date_trunc("minute", "ts").alias("tile_time")).distinct()
    out = temporal.pass_groups(tiles, 1_800_000_000, keys=["event_type"])
    return out.groupBy("event_type", F.col("pass_time").cast("timestamp_ntz").alias("pass_time")).agg(F.count("*").alias("tiles"))


@query(f"WITH {cte('obs')} SELECT scene, iy, ix, round(arg_min(lst, event_id) FILTER (lst IS NOT NULL), 6) AS lst, bool_or(cloud_mask) AS cloud_mask FROM obs GROUP BY ALL")
def mosaic_tiles(spark, d):
    out = temporal.mosaic(obs(spark, d).withColumnRenamed("scene", "pass_time"), ["lst"], rank="event_id", valid="cloud_mask")
    return rounded(out, "lst")


@query(f"WITH {cte('obs')} SELECT iy, ix, round(arg_min(lst, event_id) FILTER (lst IS NOT NULL), 6) AS lst FROM obs GROUP BY ALL")
def first_finite_tile(spark, d):
    return rounded(binning.first_finite(obs(spark, d), "lst", "event_id"), "lst")


@query(f"WITH {cte('obs')}, {cte('pixel')} SELECT scene, iy, ix, round(lst, 9) AS lst, CAST(NULL AS DOUBLE) AS ndvi FROM obs UNION ALL SELECT scene, iy, ix, round(lst, 9), ndvi FROM pixel")
def union_scenes(spark, d):
    out = temporal.union_scenes([obs(spark, d).select("scene", "iy", "ix", "lst"), project(spark, d, "pixel").select("scene", "iy", "ix", "lst", "ndvi")])
    return rounded(out, "lst", digits=9)


# --- catalogues ---------------------------------------------------------------------------------


@query(f"WITH {cte('products')} SELECT sensor, product_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY online DESC, cloud IS NULL, cloud, coalesce(coverage, -1) DESC, start_ts, product_id) AS k FROM products WHERE cloud IS NULL OR cloud <= 60) WHERE k <= 25")
def topk_products(spark, d):
    return catalogue.best_products(project(spark, d, "products"), 25, max_cloud=60.0, keys=["sensor"]).select("sensor", "product_id", "rank")


@query(f"WITH {cte('products')}, o AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY start_ts, product_id) - 1 AS k, count(*) OVER (PARTITION BY sensor) AS n FROM products), w AS (SELECT DISTINCT sensor, round_even(i * (n - 1) / CAST(7 AS DOUBLE), 0) AS k FROM o, range(8) r(i)) SELECT sensor, product_id FROM o JOIN w USING (sensor, k)")
def spread_in_time(spark, d):
    return catalogue.spread_in_time(project(spark, d, "products"), 8, keys=["sensor"]).select("sensor", "product_id")


@query("""WITH p AS (SELECT o_orderkey AS ordinal, o_orderkey % 500 AS orbit, CASE o_orderkey % 3 WHEN 0 THEN 'NRTI' WHEN 1 THEN 'OFFL' ELSE 'RPRO' END AS stream, o_orderkey % 7 = 0 AS odd FROM orders)
SELECT ordinal FROM (SELECT *, row_number() OVER (PARTITION BY orbit ORDER BY CASE stream WHEN 'RPRO' THEN 0 WHEN 'OFFL' THEN 1 ELSE 2 END, ordinal) AS k FROM p WHERE NOT odd) WHERE k = 1 UNION ALL SELECT ordinal FROM p WHERE odd""")
def dedupe_orbits(spark, d):
    key = F.col("o_orderkey")
    stream = F.when(key % 3 == 0, "NRTI").when(key % 3 == 1, "OFFL").otherwise("RPRO")
    name = F.concat(F.lit("S5P_"), stream, F.when(key % 7 == 0, "_L2__NO2").otherwise(F.concat(F.lit("_L2__NO2_20240101T000000_20240101T013000_"), F.lpad((key % 500).cast("string"), 5, "0"), F.lit("_03"))))
    products = read(spark, d, "orders").select(key.alias("ordinal"), name.alias("name"))
    return catalogue.one_per_orbit(products).select("ordinal")


@query(f"""WITH {cte('products')}, r AS (SELECT *, CASE WHEN start_ts BETWEEN TIMESTAMP '1998-06-08' AND TIMESTAMP '1998-06-15' THEN 'detection' WHEN start_ts BETWEEN TIMESTAMP '1998-02-15' AND TIMESTAMP '1998-05-16' THEN 'reference' END AS role FROM products WHERE cloud IS NULL OR cloud <= 25)
SELECT role, product_id FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY coalesce(cloud, 101), start_ts DESC, product_id) AS k FROM r WHERE role IS NOT NULL) WHERE k = 1""")
def temporal_pair(spark, d):
    return catalogue.temporal_pair(project(spark, d, "products"), date(1998, 6, 15)).select("role", "product_id")


@query(f"WITH {cte('products')} SELECT product_id FROM products WHERE start_ts < TIMESTAMP '1999-01-01' AND end_ts > TIMESTAMP '1998-01-01' AND sensor = '2-HIGH'")
def catalogue_search(spark, d):
    found = catalogue.search(project(spark, d, "products"), start=F.lit("1998-01-01").cast("timestamp_ntz"), end=F.lit("1999-01-01").cast("timestamp_ntz"), sensor="2-HIGH")
    return found.select("product_id")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS product_id, arg_max(l_quantity, l_linenumber) AS q, min(l_linenumber) AS ordinal FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def distinct_products(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).select(F.col("l_orderkey").cast("string").alias("product_id"), "q", F.col("l_linenumber").alias("ordinal"))
    return catalogue.distinct_products(rows)


AREA_12 = [[(0.0, 0.0), (12.0, 0.0), (12.0, 12.0), (0.0, 12.0)]]


def footprint_edges(rows: DataFrame, key: str, corners: list[tuple[str, str]]) -> DataFrame:
    """An edge a row of footprints whose corners are expressions, in order around; a row's columns name its footprint."""
    ends = [(a, b) for a, b in zip(corners, [*corners[1:], corners[0]])]
    structs = [F.struct(*(F.expr(f"cast({e} as double)").alias(n) for e, n in zip((*a, *b), polygons.ENDS))) for a, b in ends]
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("zone"), F.explode(F.array(*structs)).alias("e")).select(key, "zone", "e.*")


@query("""WITH b AS (SELECT o_orderdate AS acquired, o_orderkey % 9 AS w, o_orderkey % 8 AS s FROM orders), c AS (SELECT a + 0.5 AS cx, b + 0.5 AS cy FROM range(12) x(a), range(12) y(b)),
h AS (SELECT DISTINCT acquired, cx, cy FROM b, c WHERE cx BETWEEN w AND w + 4 AND cy BETWEEN s AND s + 3) SELECT acquired, round(count(*) / 144, 4) AS coverage FROM h GROUP BY ALL""")
def aoi_coverage(spark, d):
    """Boxes. The SQL counts unit cells, which boxes with whole corners cover or miss entirely."""
    boxes = read(spark, d, "orders").selectExpr("o_orderdate AS acquired", "o_orderkey % 9 AS w", "o_orderkey % 8 AS s").distinct()
    return polygons.union_share(footprint_edges(boxes, "acquired", [("w", "s"), ("w + 4", "s"), ("w + 4", "s + 3"), ("w", "s + 3")]), "acquired", AREA_12)


@query("""WITH b AS (SELECT o_orderdate AS acquired, o_orderkey % 13 AS cx, o_custkey % 13 AS cy, 2 + o_orderkey % 3 AS r, o_orderkey % 5 = 0 AS missing FROM orders WHERE o_orderkey % 4 = 0),
t AS (SELECT a + 0.5 + dx AS px, b + 0.5 + dy AS py FROM range(12) x(a), range(12) y(b), (VALUES (0.3, 0.0), (-0.3, 0.0), (0.0, 0.3), (0.0, -0.3)) v(dx, dy)),
h AS (SELECT DISTINCT acquired, px, py FROM b, t WHERE NOT missing AND abs(px - cx) + abs(py - cy) < r AND NOT abs(px - cx) + abs(py - cy) < r - 1)
SELECT acquired, CASE WHEN bool_and(missing) THEN NULL ELSE round(coalesce((SELECT count(*) FROM h WHERE h.acquired = b.acquired), 0) / 576, 4) END AS coverage FROM b GROUP BY acquired""")
def aoi_coverage_rings(spark, d):
    """Square rings that stand on a corner. The SQL counts quarters of unit cells, which such rings cover or miss entirely."""
    rows = read(spark, d, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderdate AS acquired", "o_orderkey % 13 AS cx", "o_custkey % 13 AS cy", "if(o_orderkey % 5 = 0, null, 2 + o_orderkey % 3) AS r")
    corners = lambda r: [("cx", f"cy - ({r})"), (f"cx + ({r})", "cy"), ("cx", f"cy + ({r})"), (f"cx - ({r})", "cy")]
    outer, inner = (footprint_edges(rows.distinct(), "acquired", corners(r)) for r in ("r", "r - 1"))  # two rings of one footprint
    return polygons.union_share(outer.unionByName(inner), "acquired", AREA_12)


# --- swaths and stations ------------------------------------------------------------------------


SENSOR_REQUEST = Request(Area(13.22, 52.42, 13.52, 52.56), "2024-01-01", "2024-01-31", ("sentinel3",), resolution=1000.0)
SENSOR_GRID = SENSOR_REQUEST.grid()


@query(f"""WITH {cte('swath')}, p AS (SELECT scene, CASE WHEN obs_id % 7 <> 0 THEN 280 + value % 40 - 273.15 END AS lst, CAST(floor(({SENSOR_GRID.top} - {UTM_Y}) / 1000) AS INT) AS iy, CAST(floor(({UTM_X} - {SENSOR_GRID.left}) / 1000) AS INT) AS ix FROM swath)
SELECT scene, iy, ix, round(avg(lst), 6) AS lst, count(lst) AS lst_observation_count FROM p WHERE iy BETWEEN 0 AND {SENSOR_GRID.height - 1} AND ix BETWEEN 0 AND {SENSOR_GRID.width - 1} GROUP BY ALL""")
def sensor_adapter(spark, d):
    """Raw swath pixels of one product through a registered adapter: crop, mask, Celsius, cells of the request's grid."""
    raw = project(spark, d, "swath").selectExpr("'p' AS product_id", "scene", "lon", "lat", "280 + value % 40 AS lst", "obs_id % 7 = 0 AS cloud_mask")
    adapters: dict[str, workflow.Adapter] = {}
    workflow.register_tables({"sentinel3": raw}, adapters)
    products = spark.createDataFrame([("p",)], "product_id string")
    out = adapters["sentinel3"](spark, products, SENSOR_REQUEST)
    return rounded(out.select("scene", "iy", "ix", "lst", "lst_observation_count"), "lst")


def triangle_sql(u: str, half: str) -> str:
    """Area left of u under a triangle of this half width and height around 0."""
    return f"(CASE WHEN {u} <= -({half}) THEN 0 WHEN {u} <= 0 THEN pow({u} + ({half}), 2) / 2 WHEN {u} < ({half}) THEN pow({half}, 2) - pow(({half}) - {u}, 2) / 2 ELSE pow({half}, 2) END)"


def diamond_sql(u: str, v: str, r: float) -> str:
    """Area of the diamond |x| + |y| <= r where x <= u and y <= v."""
    inner = f"greatest({r} - abs({v}), 0)"
    return f"(CASE WHEN {v} < 0 THEN {triangle_sql(u, inner)} ELSE 2 * {triangle_sql(u, str(r))} - {triangle_sql(u, inner)} END)"


_BOX = [(sx * sy, f"({376000.0} + (jx + {dx}) * 2000 - x)", f"({5828000.0} - (jy + {1 - dy}) * 2000 - y)") for dx, sx in ((1, 1), (0, -1)) for dy, sy in ((1, 1), (0, -1))]
AREA_SQL = f"""WITH {cte('swath')}, p AS (SELECT scene, value, {UTM_X} AS x, {UTM_Y} AS y FROM swath), n AS (SELECT *, floor((x - 376000) / 2000) AS hx, floor((5828000 - y) / 2000) AS hy FROM p),
c AS (SELECT scene, value, x, y, hx + dx AS jx, hy + dy AS jy FROM n, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE hx + dx BETWEEN 0 AND 13 AND hy + dy BETWEEN 0 AND 11),
w AS (SELECT *, ({" + ".join(f"{sign} * {diamond_sql(u, v, 700.0)}" for sign, u, v in _BOX)}) / 4e6 AS w FROM c)
SELECT scene, CAST(jy AS INT) AS iy, CAST(jx AS INT) AS ix, round(sum(value * w) / sum(w), 5) AS value, round(least(1, sum(w)), 5) AS coverage_fraction FROM w WHERE w > 1e-10 GROUP BY ALL"""


@query(AREA_SQL)
def area_gridding(spark, d):
    """Swath quadrilaterals (diamonds here) to 2 km cells, weighted by overlap."""
    s = project(spark, d, "swath")
    x, y = projection.project(F.col("lon"), F.col("lat"), "EPSG:32633")
    s = s.withColumn("x", x).withColumn("y", y)
    corners = {"x1": ("x", 700), "y1": ("y", 0), "x2": ("x", 0), "y2": ("y", 700), "x3": ("x", -700), "y3": ("y", 0), "x4": ("x", 0), "y4": ("y", -700)}
    s = s.withColumns({k: F.col(c) + by for k, (c, by) in corners.items()})
    pieces = spatial.overlap_pieces(s, left=376000.0, top=5828000.0, step=2000.0, width=14, height=12, corners=list(corners), carry=["value"])
    out = binning.bin_weighted(pieces, "value", "weight")
    return rounded(out.select("scene", "iy", "ix", "value", "coverage_fraction"), "value", "coverage_fraction", digits=5)


FILL_SQL = f"""WITH {cte('swath')}, g AS (SELECT scene, CAST(floor((52.6 - lat) / 0.02) AS INT) AS iy, CAST(floor((lon - 13.2) / 0.02) AS INT) AS ix, avg(value) AS value FROM swath WHERE qa >= 0.75 GROUP BY ALL),
c AS (SELECT scene, CAST(a AS INT) AS iy, CAST(b AS INT) AS ix, 13.2 + (b + 0.5) * 0.02 AS lon, 52.6 - (a + 0.5) * 0.02 AS lat FROM (SELECT DISTINCT scene FROM swath), range(10) x(a), range(18) y(b)),
e AS (SELECT c.* FROM c ANTI JOIN g USING (scene, iy, ix)), j AS (SELECT e.scene, e.iy, e.ix, s.value, s.obs_id, pow((e.lon - s.lon) * 111.320 * cos(radians(52.5)), 2) + pow((e.lat - s.lat) * 110.574, 2) AS d2 FROM e JOIN swath s ON s.scene = e.scene AND s.qa >= 0.75),
f AS (SELECT scene, iy, ix, value, true AS filled FROM (SELECT *, row_number() OVER (PARTITION BY scene, iy, ix ORDER BY d2, obs_id) AS k FROM j WHERE d2 <= 1.5 * 1.5) WHERE k = 1)
SELECT scene, iy, ix, round(value, 6) AS value, filled FROM (SELECT scene, iy, ix, value, false AS filled FROM g UNION ALL SELECT * FROM f)"""


@query(FILL_SQL)
def footprint_fill(spark, d):
    s = readers.gas_pixels(project(spark, d, "swath"))
    row, col = F.floor((F.lit(52.6) - F.col("lat")) / 0.02).cast("int"), F.floor((F.col("lon") - 13.2) / 0.02).cast("int")
    gridded = binning.bin_points(s.where("valid").withColumn("iy", row).withColumn("ix", col), ["value"])
    grid = s.select("scene").distinct().crossJoin(F.broadcast(spatial.cells_table(spark, 10, 18))).withColumn("lon", F.lit(13.2) + (F.col("ix") + 0.5) * 0.02).withColumn("lat", F.lit(52.6) - (F.col("iy") + 0.5) * 0.02)
    out = spatial.footprint_fill(gridded, grid, s.withColumnRenamed("obs_id", "pixel_id"), "value", radius_km=1.5, mid_lat=52.5, bucket_deg=0.03)
    return rounded(out, "value")


@query(FILL_SQL.replace("CAST(floor((52.6 - lat) / 0.02) AS INT) AS iy", "CAST(ceil((52.6 - lat) / 0.02) - 1 AS INT) AS iy").replace("WHERE qa >= 0.75 GROUP BY ALL)", "WHERE qa >= 0.75 AND ceil((52.6 - lat) / 0.02) BETWEEN 1 AND 10 GROUP BY ALL)"))
def gas_gridding(spark, d):
    """Histogram means of a gas column, then the nearest footprint for empty cells."""
    s = readers.gas_pixels(project(spark, d, "swath")).withColumnRenamed("obs_id", "pixel_id")
    frame = s.select("scene").distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(17)))).withColumns({"lon": F.lit(13.2) + (F.col("ix") + 0.5) * 0.02, "lat": F.lit(52.6) - (F.col("iy") + 0.5) * 0.02})
    out = binning.gridded_gas(s, frame, left=13.2, top=52.6, step=0.02, width=18, height=10, radius_km=1.5, mid_lat=52.5)
    return rounded(out, "value")


def hourly(spark, d):
    """Readings: events of each user belong to the station of that number; of an hour's the first counts."""
    e = read(spark, d, "events").select(F.col("user_id").alias("station_id"), F.date_trunc("hour", "ts").alias("ts"), "value", "event_id")
    return stations.first_readings(e, "event_id")


READ_SQL = "readings AS (SELECT user_id AS station_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS value FROM events GROUP BY ALL)"
DAYS_SQL = "days AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS scene FROM events)"
AT_SQL = f"""{READ_SQL}, {DAYS_SQL}, rd AS (SELECT station_id, scene, value FROM (SELECT r.station_id, scene, value, row_number() OVER (PARTITION BY r.station_id, scene ORDER BY abs(epoch_us(ts) - epoch_us(scene)), ts) AS k FROM readings r JOIN days ON abs(epoch_us(ts) - epoch_us(scene)) <= 21600000000) WHERE k = 1)"""


def days(spark, d):
    return read(spark, d, "events").select(F.col("ts").cast("date").cast("timestamp_ntz").alias("scene")).distinct()


def at_days(spark, d):
    return stations.reading_at(hourly(spark, d), days(spark, d), 21_600_000_000)


@query(f"WITH {AT_SQL} SELECT station_id, scene, value FROM rd")
def station_readings_at(spark, d):
    return at_days(spark, d)


@query(f"""WITH {cte('stations')}, {AT_SQL}, c AS (SELECT CAST(a AS INT) AS iy, CAST(b AS INT) AS ix, b * 3000.0 + 100 AS x, a * 3000.0 + 50 AS y FROM range(6) p(a), range(6) q(b)),
j AS (SELECT scene, iy, ix, value, station_id, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS d FROM c, rd JOIN stations s USING (station_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, iy, ix ORDER BY d, station_id) AS k, count(*) FILTER (d <= 5000) OVER (PARTITION BY scene, iy, ix) AS within FROM j),
a AS (SELECT scene, iy, ix, max(within) AS n, sum(1 / (d * d)) AS w, sum(value / (d * d)) AS wv, sum(value * value / (d * d)) AS wvv FROM k WHERE k <= 12 GROUP BY ALL)
SELECT scene, iy, ix, round(CASE WHEN n >= 3 THEN wv / w END, 5) AS value, n AS station_count, n >= 3 AS valid FROM a""")
def idw_grid(spark, d):
    grid = spatial.cells_table(spark, 6, 6).withColumn("x", F.col("ix") * 3000.0 + 100).withColumn("y", F.col("iy") * 3000.0 + 50)
    out = stations.interpolate(grid, project(spark, d, "stations"), at_days(spark, d), max_distance=5000.0)
    return rounded(out.select("scene", "iy", "ix", "value", "station_count", "valid"), "value", digits=5)


@query(f"""WITH {cte('stations')}, {READ_SQL}, near AS (SELECT station_id AS other, ts, value AS v FROM (SELECT o.station_id, t.ts, o.value, row_number() OVER (PARTITION BY o.station_id, t.ts ORDER BY abs(epoch_us(o.ts) - epoch_us(t.ts)), o.ts) AS k FROM readings o JOIN (SELECT DISTINCT ts FROM readings) t ON abs(epoch_us(o.ts) - epoch_us(t.ts)) <= 10800000000) WHERE k = 1),
p AS (SELECT a.station_id, b.station_id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM stations a JOIN stations b ON a.station_id <> b.station_id),
j AS (SELECT r.station_id, r.ts, r.value AS o, v, d, row_number() OVER (PARTITION BY r.station_id, r.ts ORDER BY d, p.other) AS k FROM readings r JOIN p USING (station_id) JOIN near n ON n.other = p.other AND n.ts = r.ts WHERE d <= 5000),
q AS (SELECT station_id, ts, any_value(o) AS o, sum(v / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2)) AS e FROM j WHERE k <= 12 GROUP BY ALL HAVING count(*) >= 3), n AS (SELECT station_id, count(*) AS n FROM readings GROUP BY ALL)
SELECT n.station_id, count(e) AS samples, round(avg(e - o), 5) AS bias, round(avg(abs(e - o)), 5) AS mae, round(sqrt(avg(pow(e - o, 2))), 5) AS rmse, round(count(e) / any_value(n), 6) AS coverage_fraction FROM n LEFT JOIN q USING (station_id) GROUP BY n.station_id""")
def loso_validation(spark, d):
    r = hourly(spark, d)
    predictions = stations.leave_one_out(r, project(spark, d, "stations"), tolerance_us=10_800_000_000, max_distance=5000.0)
    return rounded(rounded(stations.station_metrics(predictions, r), "bias", "mae", "rmse", digits=5), "coverage_fraction")


@query(f"""WITH {cte('stations')}, {AT_SQL}, {cte('obs')}, c AS (SELECT CAST(scene AS TIMESTAMP) AS scene, iy, ix, avg(lst) AS lst FROM obs GROUP BY ALL), s AS (SELECT station_id, floor(y / 2000) AS iy, floor(x / 2000) AS ix FROM stations),
j AS (SELECT s.station_id, c.lst AS e, a.value AS o FROM s JOIN c ON c.iy = s.iy AND c.ix = s.ix JOIN rd a ON a.station_id = s.station_id AND a.scene = c.scene WHERE c.lst IS NOT NULL)
SELECT s.station_id, count(e) AS samples, round(avg(e - o), 5) AS bias, round(sqrt(avg(pow(e - o, 2))), 5) AS rmse FROM s LEFT JOIN j USING (station_id) GROUP BY s.station_id""")
def collocate_stations(spark, d):
    cube = binning.bin_points(obs(spark, d), ["lst"]).withColumn("scene", F.col("scene").cast("timestamp_ntz"))
    out = stations.collocate(cube, project(spark, d, "stations"), hourly(spark, d), "lst", row=F.floor(F.col("y") / 2000), col=F.floor(F.col("x") / 2000), inside=F.lit(True), tolerance_us=21_600_000_000)
    return rounded(out.select("station_id", "samples", "bias", "rmse"), "bias", "rmse", digits=5)


@query("SELECT user_id AS station_id, date_trunc('day', ts) AS ts, arg_max(value, event_id) FILTER (event_type = 'view') AS view, arg_max(value, event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY ALL")
def station_pivot(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("station_id"), F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("parameter"), "value", "event_id")
    out = stations.pivot_readings(e, ["view", "click"], order="event_id")
    return out.select("station_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "view", "click")


@query("SELECT user_id AS station_id, ts, event_type AS parameter, value FROM (SELECT user_id, date_trunc('second', ts) AS ts, event_type, value FROM events)")
def station_json(spark, d):
    """Readings through JSON payloads and back."""
    when = F.concat(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    r = F.struct(F.struct(F.col("event_type").alias("name"), F.lit("K").alias("units")).alias("parameter"), F.col("value"), F.struct(when.alias("utc")).alias("date"))
    payloads = read(spark, d, "events").select(F.col("user_id").alias("station_id"), F.to_json(F.array(r)).alias("payload"))
    return readers.station_readings(payloads).select("station_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "parameter", "value")


@query("""WITH {stations}, c AS (SELECT CAST(a AS INT) AS iy, CAST(b AS INT) AS ix, b * 3000.0 AS x, a * 3000.0 AS y FROM range(6) p(a), range(6) q(b))
SELECT iy, ix, station_id, CAST(k AS INT) AS rank FROM (SELECT iy, ix, station_id, row_number() OVER (PARTITION BY iy, ix ORDER BY pow(c.x - s.x, 2) + pow(c.y - s.y, 2), station_id) AS k FROM c, stations s) WHERE k <= 4""".replace("{stations}", cte("stations")))
def nearest_stations(spark, d):
    grid = spatial.cells_table(spark, 6, 6).withColumn("x", F.col("ix") * 3000.0).withColumn("y", F.col("iy") * 3000.0)
    return stations.nearest_stations(grid, project(spark, d, "stations"), 4).select("iy", "ix", "station_id", "rank")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Swath to cells to zones: quality mask, Celsius, binning, zonal statistics."""
    return zonal_stats(spark, d)



from . import workflow_queries  # noqa: E402, F401 - registers its queries
