"""The star-schema tables as cubes, swaths, products and stations.

Each projection is a list of SQL expressions that Spark and DuckDB read alike
(`div` is written `//` there), so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cells of a day: temperature in kelvin with gaps, flags, cloud, view angle.
OBS = {
    "scene": "CAST(ts AS DATE)",
    "iy": "CAST(user_id div 10 AS INT)",
    "ix": "CAST(user_id % 10 AS INT)",
    "event_id": "event_id",
    "lst": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 280 + value % 40 END",
    "lst_uncertainty": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value % 3 END",
    "exception_flags": "CASE WHEN event_id % 5 = 0 THEN event_id % 2048 ELSE 0 END",
    "cloud_mask": "event_type = 'error'",
    "confidence_flags": "CASE WHEN event_id % 11 = 0 THEN CAST(32 AS BIGINT) ELSE CAST(8 AS BIGINT) END",
    "sat_zenith": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 60 AS DOUBLE) END",
}
#: Geolocated samples with a quality value.
SWATH = {
    "scene": "CAST(ts AS DATE)",
    "ts": "ts",
    "obs_id": "event_id",
    "lon": "CAST(13.2 AS DOUBLE) + (event_id % 997) / CAST(997.0 AS DOUBLE) * CAST(0.35 AS DOUBLE)",
    "lat": "CAST(52.4 AS DOUBLE) + (event_id % 991) / CAST(991.0 AS DOUBLE) * CAST(0.18 AS DOUBLE)",
    "qa": "(event_id % 100) / CAST(100.0 AS DOUBLE)",
    "value": "value",
}
#: Order lines as pixels of monthly scenes.
PIXEL = {
    "scene": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "iy": "CAST((l_partkey div 16) % 16 AS INT)",
    "ix": "CAST(l_partkey % 16 AS INT)",
    "lst": "l_extendedprice / l_quantity / 100",
    "ndvi": "l_discount",
    "ndbi": "l_tax",
}
#: Reflectances in six bands; some denominators are zero.
BANDS = {
    "pixel": "l_orderkey * 10 + l_linenumber",
    "B02": "CAST(l_linenumber AS DOUBLE) / 10",
    "B03": "l_tax",
    "B04": "l_discount",
    "B08": "CAST(l_quantity % 10 AS DOUBLE) / 10",
    "B11": "CAST(l_quantity % 7 AS DOUBLE) / 10",
    "B12": "CAST(l_quantity % 5 AS DOUBLE) / 10 + CAST(0.1 AS DOUBLE)",
    "SCL": "CAST(l_suppkey % 12 AS INT)",
}
#: Catalogue records.
PRODUCTS = {
    "product_id": "CAST(o_orderkey AS VARCHAR(20))",
    "ordinal": "o_orderkey",
    "start_ts": "o_orderdate",
    "end_ts": "o_orderdate",
    "online": "o_orderstatus <> 'P'",
    "cloud": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice % 100 END",
    "coverage": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_custkey % 100) / CAST(100 AS DOUBLE) END",
    "sensor": "o_orderpriority",
}
#: Forecasts: a run a day, leads of six hours.
FORECAST = {
    "run": "l_shipdate",
    "lead_us": "CAST(l_linenumber - 1 AS BIGINT) * 21600000000",
    "key": "l_suppkey % 5",
    "value": "CAST(l_quantity AS DOUBLE)",
}
#: An elevation model, 40 columns wide.
DEM = {
    "iy": "CAST(p_partkey div 40 AS INT)",
    "ix": "CAST(p_partkey % 40 AS INT)",
    "z": "p_retailprice",
}
#: Stations on a lattice, in degrees and metres.
STATIONS = {
    "station_id": "s_suppkey",
    "lon": "CAST(13.2 AS DOUBLE) + (s_suppkey % 10) * CAST(0.03 AS DOUBLE)",
    "lat": "CAST(52.4 AS DOUBLE) + ((s_suppkey div 10) % 10) * CAST(0.02 AS DOUBLE)",
    "x": "CAST(s_suppkey % 10 AS DOUBLE) * 2000",
    "y": "CAST((s_suppkey div 10) % 10 AS DOUBLE) * 2000 + CAST(s_suppkey % 7 AS DOUBLE) * 10",
}
SOURCES = {"obs": ("events", OBS), "swath": ("events", SWATH), "pixel": ("lineitem", PIXEL), "bands": ("lineitem", BANDS), "products": ("orders", PRODUCTS), "forecast": ("lineitem", FORECAST), "dem": ("part", DEM), "stations": ("supplier", STATIONS)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection of its whole table; only the columns it names are read."""
    table, columns = SOURCES[name]
    return read(spark, sf_dir, table).selectExpr(*(f"{e.replace('VARCHAR(20)', 'STRING')} AS {c}" for c, e in columns.items()))


def cte(*names: str) -> str:
    """The projections as DuckDB common table expressions."""
    parts = []
    for name in names:
        table, columns = SOURCES[name]
        listed = ", ".join(f"{e.replace(' div ', ' // ')} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {listed} FROM {table})")
    return ", ".join(parts)
