"""Column expressions: temperatures, masks, spectral and radar indices, sun and gases.

NULL stands for a missing value; `clean` turns NaN and infinities into it.
Divisions by zero give NULL.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KELVIN = 273.15
#: Units that mean kelvin or degrees Celsius. Fixed values.
KELVIN_UNITS = {"k", "kelvin", "degree_kelvin", "degrees_kelvin"}
CELSIUS_UNITS = {"c", "°c", "degc", "celsius", "degree_celsius", "degrees_celsius"}

#: Bits of exception flags of land-surface-temperature pixels. Fixed values.
EXCEPTION_BITS = {
    "ISP_ABSENT": 1 << 0,
    "PIXEL_ABSENT": 1 << 1,
    "NOT_DECOMPRESSED": 1 << 2,
    "NO_SIGNAL": 1 << 3,
    "SATURATION": 1 << 4,
    "INVALID_RADIANCE": 1 << 5,
    "NO_PARAMETERS": 1 << 6,
    "UNFILLED_PIXEL": 1 << 7,
    "LST_UNDERFLOW": 1 << 8,
    "LST_OVERFLOW": 1 << 9,
    "BIOME": 1 << 10,
}
#: Confidence bits of pixels that are no observation of their own: unfilled, cosmetic, duplicate. Fixed value.
CONFIDENCE_REJECT = 1 << 5 | 1 << 8 | 1 << 9
#: Scene classes without a clear view of the ground. Fixed values.
UNCLEAR_CLASSES = (0, 1, 2, 3, 8, 9, 10, 11)
#: Grams in a mole of each gas. Fixed values.
MOLAR_MASS = {"NO2": 46.0055, "SO2": 64.066, "CO": 28.0101, "O3": 47.9982, "HCHO": 30.026}


def clean(x: Column) -> Column:
    """NULL instead of NaN or an infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def to_celsius(df: DataFrame, name: str = "lst", units: str | None = None) -> DataFrame:
    """The temperature column in degrees Celsius; units from the column's metadata unless given."""
    units = (units or df.schema[name].metadata.get("units", "")).strip().lower()
    if units in CELSIUS_UNITS:
        return df
    if units not in KELVIN_UNITS:
        raise ValueError(f"{name} has neither kelvin nor Celsius as units: {units!r}")
    return df.withColumn(name, (F.col(name) - KELVIN).alias(name, metadata={**df.schema[name].metadata, "units": "degC"}))


@dataclass(frozen=True)
class QualityPolicy:
    """Which pixels are valid; a term applies only if its column is there."""

    reject_exceptions: int = sum(EXCEPTION_BITS.values())
    reject_cloud: bool = True
    reject_missing: bool = True
    cloud_bits: int | None = None
    reject_confidence: int = CONFIDENCE_REJECT
    max_view_zenith: float | None = 45.0
    cloud_buffer: int = 0

    @classmethod
    def permissive(cls) -> QualityPolicy:
        return cls(reject_exceptions=0, reject_cloud=False, reject_confidence=0, max_view_zenith=None)


def no_bits(flags: str, mask: int) -> Column:
    """None of the mask's bits is set; missing flags have none."""
    return F.coalesce(F.col(flags).cast("long"), F.lit(0)).bitwiseAND(F.lit(mask)) == 0


def cloudy(columns: Sequence[str], policy: QualityPolicy) -> Column:
    """Cloud by mask or bits, before any buffer."""
    found = F.lit(False)
    if policy.reject_cloud and "cloud_mask" in columns:
        found = found | F.coalesce(F.col("cloud_mask"), F.lit(False))
    if policy.reject_cloud and "cloud_flags" in columns and policy.cloud_bits:
        found = found | ~no_bits("cloud_flags", policy.cloud_bits)
    return found


def valid_pixel(columns: Sequence[str], policy: QualityPolicy | None = None, *, value: str = "lst", cloud: Column | None = None) -> Column:
    """Validity of a pixel under a policy; `cloud` overrides the cloud term (a buffered mask)."""
    policy = policy or QualityPolicy()
    terms = [~(cloud if cloud is not None else cloudy(columns, policy))]
    if policy.reject_missing:
        terms.append(clean(F.col(value).cast("double")).isNotNull())
    if policy.reject_exceptions and "exception_flags" in columns:
        terms.append(no_bits("exception_flags", policy.reject_exceptions))
    if policy.reject_confidence and "confidence_flags" in columns:
        terms.append(no_bits("confidence_flags", policy.reject_confidence))
    if policy.max_view_zenith is not None and "sat_zenith" in columns:
        terms.append(F.coalesce(F.col("sat_zenith"), F.lit(90.0)) <= policy.max_view_zenith)
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def apply_quality(df: DataFrame, policy: QualityPolicy | None = None, *, value: str = "lst", uncertainty: str = "lst_uncertainty", keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Adds valid_mask; masks the value and its uncertainty only.

    A policy with a cloud buffer needs cells (keys, iy, ix): clouds grow by that many of them.
    """
    policy = policy or QualityPolicy()
    cloud, rows = None, df
    if policy.cloud_buffer > 0:
        from ..operators.neighbourhood import grown

        found = df.where(cloudy(df.columns, policy)).select(*keys, "iy", "ix")
        near = grown(found, policy.cloud_buffer, keys).withColumn("_cloud", F.lit(True))
        rows = df.join(near, [*keys, "iy", "ix"], "left")
        cloud = F.coalesce("_cloud", F.lit(False))
    out = rows.withColumn("valid_mask", valid_pixel(df.columns, policy, value=value, cloud=cloud)).drop("_cloud")
    return out.withColumns({c: F.when(F.col("valid_mask"), F.col(c)) for c in (value, uncertainty) if c in df.columns})


#: Parts of a flag's meaning that speak of cloud. Fixed values.
CLOUD_TERMS = ("cloud", "cirrus", "fog", "stratus")


def flag_table(masks: Sequence[int], meanings: str) -> dict[str, int]:
    """Bits by meaning, from the two attributes of a flag variable; they must name the same number of flags."""
    names = meanings.lower().split()
    if len(names) != len(masks):
        raise ValueError(f"{len(masks)} masks for {len(names)} meanings")
    return {name: int(bit) for name, bit in zip(names, masks, strict=True)}


def bits_about(table: Mapping[str, int], terms: Sequence[str] = CLOUD_TERMS) -> int:
    """All bits of a flag table whose meaning speaks of one of the terms, as one mask."""
    about = re.compile("|".join(re.escape(t.lower()) for t in terms))
    mask = 0
    for meaning in filter(about.search, table):
        mask |= table[meaning]
    return mask


def has_flag(flags: Column, mask: int) -> Column:
    return F.coalesce(flags.cast("long"), F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def clear_class(scl: Column) -> Column:
    """A scene class with a clear view; a missing class has none."""
    return F.coalesce(~scl.isin(*UNCLEAR_CLASSES), F.lit(False))


def spectral_indices(b: dict[str, Column] | None = None) -> dict[str, Column]:
    """NDVI, EVI, NDMI, NDBI and MNDWI of reflectance bands."""
    b = b or {k: F.col(k) for k in ("B02", "B03", "B04", "B08", "B11", "B12")}
    nd = lambda x, y: ratio(b[x] - b[y], b[x] + b[y])
    return {
        "NDVI": nd("B08", "B04"),
        "EVI": F.lit(2.5) * ratio(b["B08"] - b["B04"], b["B08"] + b["B04"] * 6.0 - b["B02"] * 7.5 + 1.0),
        "NDMI": nd("B08", "B11"),
        "NDBI": nd("B11", "B08"),
        "MNDWI": nd("B03", "B11"),
    }


def linear_power(x: Column, units: str) -> Column:
    return F.pow(F.lit(10.0), x / 10.0) if units == "dB" else x


def radar_indices(vv: Column, vh: Column, units: str = "linear") -> dict[str, Column]:
    """Ratio in dB, radar vegetation index and span of two polarisations."""
    vv, vh = linear_power(vv, units), linear_power(vh, units)
    quotient = F.when(vv > 0, vh / vv)
    return {"VH_VV_ratio_dB": F.when(quotient > 0, F.lit(10.0) * F.log10(quotient)), "RVI": F.when(vv + vh > 0, F.lit(4.0) * vh / (vv + vh)), "radar_span": vv + vh}


def surface_concentration(column: Column, gas: str, boundary_layer: Column) -> Column:
    """Micrograms per cubic metre if a column density is mixed through the boundary layer."""
    return F.when(boundary_layer > 0, column * MOLAR_MASS[gas.upper()] * 1e6 / boundary_layer)


def solar_hour(ts: Column, lon: Column) -> Column:
    """Local solar hour, 0 to 24."""
    return F.pmod(F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0 + lon / 15.0, F.lit(24.0))


def solar_position(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Zenith and azimuth of the sun in degrees, by the NOAA equations."""
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    g = (F.dayofyear(ts) - 1 + (hours - 12.0) / 24.0) * (2 * math.pi / 365)
    minutes = (F.lit(0.000075) + F.cos(g) * 0.001868 - F.sin(g) * 0.032077 - F.cos(g * 2) * 0.014615 - F.sin(g * 2) * 0.040849) * 229.18
    decl = F.lit(0.006918) - F.cos(g) * 0.399912 + F.sin(g) * 0.070257 - F.cos(g * 2) * 0.006758 + F.sin(g * 2) * 0.000907 - F.cos(g * 3) * 0.002697 + F.sin(g * 3) * 0.00148
    angle = F.radians((hours * 60.0 + minutes + lon * 4.0) / 4.0 - 180.0)
    phi = F.radians(lat)
    cosine = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle)
    zenith = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    azimuth = F.degrees(F.atan2(F.sin(angle), F.cos(angle) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180.0
    return zenith, F.pmod(azimuth, F.lit(360.0))


def cos_incidence(zenith: Column, azimuth: Column, slope: Column, aspect: Column) -> Column:
    """Cosine of the sun's angle on a tilted surface; all in degrees."""
    z, a, s, q = F.radians(zenith), F.radians(azimuth), F.radians(slope), F.radians(aspect)
    return F.cos(z) * F.cos(s) + F.sin(z) * F.sin(s) * F.cos(a - q)


def radiance_blend(weight: Column, local: Column, overall: Column, offset: float | None) -> Column:
    """Blend of two temperatures by radiance (fourth power of kelvin); linear if the unit is unknown."""
    local = F.coalesce(local, overall)
    if offset is None:
        return weight * local + (F.lit(1.0) - weight) * overall
    return F.pow(weight * F.pow(local + offset, F.lit(4.0)) + (F.lit(1.0) - weight) * F.pow(overall + offset, F.lit(4.0)), F.lit(0.25)) - offset


def dn_to_temperature(dn: Column, scale: float, offset: float, qa: Column, reject_bits: int = 31) -> Column:
    """Scaled digital numbers in Celsius where no reject bit is set; missing quality is rejected."""
    return F.when(qa.cast("long").bitwiseAND(F.lit(reject_bits)) == 0, dn * scale + offset - KELVIN)


def reflectance(dn: Column, offset: Column) -> Column:
    """(DN + offset) / 10000, NULL for no data (0)."""
    return F.when(dn != 0, (dn + F.coalesce(offset, F.lit(0.0))) / 10000.0)
