"""Raw sensor tables to standard variables, and JSON payloads to rows.

Raw pixels arrive as Parquet (a row a pixel, bands as columns): the file formats
of the agencies need native libraries, which a plug-in turns into such tables.
Every reader is a projection, so filters and column selections reach the scan.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import KELVIN, clean, clear_class, dn_to_temperature, reflectance

#: Gases with a level-2 column, and the quality a pixel needs. Fixed values.
GASES = ("NO2", "SO2", "CO", "O3", "HCHO", "CH4", "AER_AI")
MIN_QA = 0.75


def best_variable(described: Sequence[tuple[str, str]], terms: Sequence[str]) -> str | None:
    """The variable whose name or description matches the terms best: 100 - i for the i-th term, highest first, first on ties."""
    best, top = None, 0
    for name, text in described:
        score = sum(100 - i for i, t in enumerate(terms) if t.lower() in f"{name} {text}".lower())
        if score > top:
            best, top = name, score
    return best


def standard_columns(df: DataFrame, names: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Renamed and cleaned measurement columns beside the kept ones."""
    types = dict(df.dtypes)
    value = lambda c: clean(F.col(c).cast("double")) if types[c] in ("float", "double") else F.col(c)
    return df.select(*keep, *(value(raw).alias(std) for raw, std in names.items() if raw in types))


def thermal_pixels(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Land-surface temperature swath in kelvin; missing units mean kelvin."""
    out = standard_columns(raw, names, [c for c in ("product_id", "scene", "scan_row", "scan_col", "lat", "lon") if c in raw.columns])
    units = raw.schema[next(k for k, v in names.items() if v == "lst")].metadata.get("units", "K")
    return out.withColumn("lst", F.col("lst").alias("lst", metadata={"units": units}))


def optical_bands(raw: DataFrame, bands: Sequence[str], offsets: dict[str, float] | None = None, *, classes: str | None = "SCL") -> DataFrame:
    """Reflectance of each band by its radiometric offset, masked by scene class."""
    ok = clear_class(F.col(classes)) if classes else F.lit(True)
    keep = [c for c in raw.columns if c not in bands]
    return raw.select(*keep, *(F.when(ok, reflectance(F.col(b).cast("double"), F.lit((offsets or {}).get(b)).cast("double"))).alias(b) for b in bands), ok.alias("valid_mask"))


#: Processing baseline from which digital numbers carry an offset, and that offset. Fixed values.
OFFSET_BASELINE, BASELINE_OFFSET = 4.0, -1000.0


def baseline_offset(baseline: Column, scaled: Column | None = None) -> Column:
    """Radiometric offset of a scene: that of newer baselines, unless its asset publishes a scale (then values are ready)."""
    ready = F.coalesce(scaled, F.lit(False)) if scaled is not None else F.lit(False)
    return F.when(~ready & (baseline.cast("double") >= OFFSET_BASELINE), BASELINE_OFFSET).otherwise(0.0)


def scaled_values(dn: Column, scale: Column | float = 1.0, offset: Column | float = 0.0, nodata: float | None = None) -> Column:
    """Digital numbers of a raster band as values; no data and non-finite numbers become NULL."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    value = clean(dn.cast("double"))
    value = value if nodata is None else F.when(value != nodata, value)
    return value * F.coalesce(lit(scale), F.lit(1.0)) + F.coalesce(lit(offset), F.lit(0.0))


def asset_of(assets: Column, names: Sequence[str]) -> Column:
    """The first asset of a map (name to location) that goes by one of several names."""
    return F.coalesce(*(F.element_at(assets, F.lit(n)) for n in names))


def top_of_atmosphere(raw: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Reflectance at the top of the atmosphere, by each row's baseline; there are no scene classes to mask by."""
    offset = baseline_offset(F.col("baseline"))
    keep = [c for c in raw.columns if c not in bands]
    return raw.select(*keep, *(reflectance(F.col(b).cast("double"), offset).alias(b) for b in bands))


def masked_radar(raw: DataFrame, bands: Sequence[str], *, mask: str = "data_mask", valid: Sequence[int] = (1,), **scales) -> DataFrame:
    """Terrain-corrected backscatter where the data mask says so; elsewhere NULL."""
    ok = F.coalesce(F.col(mask).isin(*valid), F.lit(False))
    return radar_bands(raw.withColumns({b: F.when(ok, F.col(b)) for b in bands}), bands, **scales)


def radar_bands(raw: DataFrame, bands: Sequence[str], *, scale: str = "power", output: str = "linear") -> DataFrame:
    """Backscatter from power, amplitude or dB to linear power or dB."""
    linear = {"power": lambda c: c, "amplitude": lambda c: c * c, "db": lambda c: F.pow(F.lit(10.0), c / 10.0)}[scale]
    tiny = 1e-10
    out = lambda c: F.when(c.isNotNull(), F.lit(10.0) * F.log10(F.greatest(c, F.lit(tiny)))) if output == "dB" else c
    return raw.withColumns({b: out(linear(F.col(b).cast("double"))) for b in bands})


def gas_pixels(raw: DataFrame, value: str = "value", *, min_qa: float = MIN_QA) -> DataFrame:
    """Swath of a gas column: values of enough quality, others NULL."""
    v = clean(F.col(value).cast("double"))
    return raw.withColumn("valid", F.coalesce((F.col("qa") >= min_qa) & v.isNotNull(), F.lit(False))).withColumn(value, F.when(F.col("valid"), v))


def surface_temperature(raw: DataFrame, *, scale: float, offset: float, dn: str = "dn", qa: str = "qa_pixel") -> DataFrame:
    """Scaled temperature in Celsius where the pixel quality rejects nothing."""
    return raw.withColumn("lst", dn_to_temperature(F.col(dn).cast("double"), scale, offset, F.col(qa)))


def cloudless_temperature(raw: DataFrame, *, value: str = "lst", cloud: str = "cloud") -> DataFrame:
    """Surface temperature in Celsius from kelvin where the cloud band is 0; unknown cloud counts as cloud."""
    clear = F.coalesce(F.col(cloud).cast("int") == 0, F.lit(False))
    return raw.withColumn("valid_mask", clear & clean(F.col(value).cast("double")).isNotNull()).withColumn(value, F.when(F.col("valid_mask"), F.col(value).cast("double") - KELVIN))


def inspect_table(df: DataFrame) -> list[tuple[str, str, str | None]]:
    """(name, type, units) of every column of a raw table whose layout isn't known; reads no rows."""
    return [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("units")) for f in df.schema]


#: Names of coordinates in gridded products. Fixed values.
COORDINATES = {"latitude": "lat", "longitude": "lon", "valid_time": "scene", "time": "scene", "forecast_reference_time": "run"}


def normalise_gridded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A gridded product's columns by standard names; longitudes from 0..360 to -180..180; measurements cleaned."""
    known = {k: v for k, v in COORDINATES.items() if k in df.columns and v not in df.columns}
    if "valid_time" in known:
        known.pop("time", None)
    out = df.withColumnsRenamed({**known, **{k: v for k, v in names.items() if k in df.columns}})
    if "lon" in out.columns:
        out = out.withColumn("lon", F.pmod(F.col("lon").cast("double") + 180.0, F.lit(360.0)) - 180.0)
    return out.withColumns({v: clean(F.col(v).cast("double")) for k, v in names.items() if k in df.columns})


def snapped_box(box: tuple[float, float, float, float], step: float) -> tuple[float, float, float, float]:
    """The box grown outward to multiples of a provider's grid step."""
    west, south, east, north = box
    return math.floor(west / step) * step, math.floor(south / step) * step, math.ceil(east / step) * step, math.ceil(north / step) * step


#: Short names of hourly reanalysis variables. Fixed values.
ERA5_NAMES = {
    "t2m": "temperature_2m",
    "d2m": "dewpoint_2m",
    "u10": "wind_u_10m",
    "v10": "wind_v_10m",
    "sp": "surface_pressure",
    "tp": "total_precipitation",
    "ssrd": "solar_radiation_down",
    "strd": "thermal_radiation_down",
    "blh": "boundary_layer_height",
    "skt": "skin_temperature",
    "swvl1": "soil_water_layer_1",
}

#: Short names of atmospheric-composition variables, and the grid steps of reanalysis and forecast. Fixed values.
CAMS_NAMES = {
    "no2": "nitrogen_dioxide",
    "go3": "ozone",
    "so2": "sulphur_dioxide",
    "co": "carbon_monoxide",
    "pm2p5": "particulate_matter_2.5um",
}
CAMS_STEPS = {"reanalysis": 0.75, "forecast": 0.4}

READING_SCHEMA = "struct<parameter: struct<name: string, units: string>, value: double, datetime: string, date: struct<utc: string, local: string>, period: struct<datetimeFrom: struct<utc: string, local: string>>>"


def reading_time(r: Column) -> Column:
    """Time of a reading: its own, its date's or its period's start; UTC first. Missing times fail."""
    text = F.coalesce(r["datetime"], r["date"]["utc"], r["date"]["local"], r["period"]["datetimeFrom"]["utc"], r["period"]["datetimeFrom"]["local"])
    return F.when(text.isNull(), F.raise_error(F.lit("a reading without a time"))).otherwise(F.to_timestamp(text))


def station_readings(payloads: DataFrame, json_col: str = "payload", station: str = "station_id") -> DataFrame:
    """station_id, ts, parameter, value, units and ordinal from JSON arrays of measurements."""
    rows = payloads.select(station, F.posexplode(F.from_json(json_col, f"array<{READING_SCHEMA}>")).alias("ordinal", "r"))
    return rows.select(F.col(station).alias("station_id"), reading_time(F.col("r")).alias("ts"), F.col("r.parameter.name").alias("parameter"), clean(F.col("r.value")).alias("value"), F.col("r.parameter.units").alias("units"), "ordinal")


def attribute_map(attributes: Column) -> Column:
    """Map of an array of (Name, Value) structs; the last of a name wins."""
    names = F.array_distinct(F.transform(attributes, lambda a: a["Name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(attributes, lambda a: a["Name"] == n), -1)["Value"]))


def footprint(product: Column) -> Column:
    """GeoJSON of a product record: GeoFootprint, else geometry; NULL without a type."""
    text = F.coalesce(F.get_json_object(product, "$.GeoFootprint"), F.get_json_object(product, "$.geometry"))
    return F.when(F.get_json_object(text, "$.type").isNotNull(), text)


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("double")


#: Time in product names: YYYYMMDDTHHMMSS. Fixed value.
NAME_TIME = r"(\d{8}T\d{6})"


def name_time(name: Column) -> Column:
    """Sensing start in a product's name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, NAME_TIME, 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def zones_from_geojson(text: str, id_field: str = "id") -> tuple[list[str], list[tuple], list[dict]]:
    """(ids, rings of each, properties) of a FeatureCollection; ids must be unique."""
    from ..grid import geometry_rings

    features = json.loads(text)["features"]
    ids = [str(f.get("properties", {}).get(id_field, f.get("id", k))) for k, f in enumerate(features)]
    if len(set(ids)) != len(ids):
        raise ValueError("zone ids must be unique")
    return ids, [geometry_rings(f) for f in features], [f.get("properties", {}) for f in features]


def open_cube(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored cube, lazily; only the columns asked for are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df

