"""Which discovered products are read: clear ones first found by their flags, unreadable ones named and left out.

Both decisions are made from narrow scans (flags and places; the columns that must
be numbers) with a row a product as the result, before any product is read whole.
The ids that stay are a filter on the raw table, which Parquet scans take down to
row groups, so value columns of other products are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import QualityPolicy, clear_class, cloudy
from ..grid import Area
from ..operators import binning
from ..operators.catalogue import quality_order

#: Columns without which a sensor's pixels mean nothing, by sensor; of gases one is enough. Fixed values.
REQUIRED = {
    "sentinel1": ("VV", "VH"),
    "sentinel2": ("B04", "B08"),
    "sentinel3": ("lst",),
    "sentinel5p": ("qa",),
    "landsat": ("dn", "qa_pixel"),
    "ecostress": ("lst", "cloud"),
}
PLACED = ("product_id", "scene", "lon", "lat")
#: Columns that are no numbers.
OTHERS = {"product_id", "scene", "baseline", "cloud_mask"}
#: Landsat pixel quality: fill, dilated cloud, cirrus, cloud and cloud shadow. Fixed value.
LANDSAT_UNCLEAR = 0b11111


class ProductError(RuntimeError):
    """All products of a sensor failed."""


def missing_columns(sensor: str, columns: Sequence[str]) -> list[str]:
    return [c for c in (*PLACED, *REQUIRED[sensor]) if c not in columns]


def numbers(raw: DataFrame) -> list[str]:
    """Text columns that stand for numbers: raw layouts that were never parsed."""
    return [c for c, t in raw.dtypes if t == "string" and c not in OTHERS]


def parsed(raw: DataFrame) -> DataFrame:
    """Numbers that stand as text become doubles; what is no number becomes NULL (see `fault`)."""
    return raw.withColumns({c: F.col(c).try_cast("double") for c in numbers(raw)})


def fault(raw: DataFrame) -> Column:
    """Why a row of raw pixels cannot be read, or NULL.

    No value is evaluated that could fail: texts are cast by `try_cast`.
    """
    lon, lat = (F.col(c).try_cast("double") for c in ("lon", "lat"))
    reasons = [F.when(F.col("scene").isNull(), "no time"), F.when((F.abs(lon) > 360) | (F.abs(lat) > 90), "a place off the globe")]
    reasons += [F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.concat(F.lit(f"{c} is no number: "), F.left(F.col(c), F.lit(40)))) for c in numbers(raw)]
    return F.coalesce(*reasons)


def failures(raw: DataFrame, products: DataFrame) -> DataFrame:
    """product_id and error of the products with a faulty row, or without any row.

    One pass over the raw table; a row a product comes back.
    """
    seen = raw.groupBy("product_id").agg(F.min(fault(raw)).alias("error"), F.lit(True).alias("_seen"))
    joined = products.select("product_id").distinct().join(seen, "product_id", "left")
    return joined.select("product_id", F.when(F.col("_seen").isNull(), "no pixels").otherwise(F.col("error")).alias("error")).where("error is not null")


def unusable(sensor: str, columns: Sequence[str]) -> Column | None:
    """What hides the ground at a pixel, from flags alone; None for sensors that see through clouds."""
    if sensor == "sentinel3":
        policy = QualityPolicy()
        aslant = F.coalesce(F.col("sat_zenith").cast("double"), F.lit(90.0)) > policy.max_view_zenith if "sat_zenith" in columns else F.lit(False)
        return cloudy(columns, policy) | aslant
    if sensor == "sentinel2" and "SCL" in columns:
        return ~clear_class(F.col("SCL"))
    if sensor == "landsat":
        return F.coalesce(F.col("qa_pixel").cast("long").bitwiseAND(F.lit(LANDSAT_UNCLEAR)) != 0, F.lit(True))
    if sensor == "ecostress":
        return F.coalesce(F.col("cloud").cast("int") != 0, F.lit(True))
    return None


def within(area: Area) -> Column:
    return F.col("lon").between(area.west, area.east) & F.col("lat").between(area.south, area.north)


def measured_clear(raw: DataFrame, sensor: str, products: DataFrame, area: Area, known: DataFrame | None = None) -> DataFrame:
    """product_id and clear_fraction over the area of products that have pixels there; those in `known` are not looked at again."""
    hidden = unusable(sensor, raw.columns)
    asked = products.select("product_id").distinct()
    if known is not None:
        asked = asked.join(known.select("product_id"), "product_id", "left_anti")
    found = binning.clear_fraction(raw.join(asked, "product_id", "left_semi"), hidden, within(area)).select("product_id", "clear_fraction")
    return found if known is None else found.unionByName(known.select("product_id", "clear_fraction").join(products.select("product_id").distinct(), "product_id", "left_semi"))


def select_clear(products: DataFrame, measured: DataFrame, least: float, limit: int) -> DataFrame:
    """products with clear_fraction and accepted: of those that are clear enough, the `limit` best by catalogue.

    Products without a pixel in the area have no fraction and are not accepted.
    """
    joined = products.join(measured, "product_id", "left")
    clear = F.coalesce(F.col("clear_fraction") >= least, F.lit(False))
    first = joined.where(clear).orderBy(*quality_order()).limit(limit).select("product_id", F.lit(True).alias("_first"))
    return joined.join(first, "product_id", "left").withColumn("accepted", F.coalesce("_first", F.lit(False))).drop("_first")


@dataclass(frozen=True)
class TableAdapter:
    """Reads a sensor's products from one raw table (product_id, scene, lon, lat and raw columns)."""

    sensor: str
    table: DataFrame

    def of(self, ids: Sequence[str]) -> DataFrame:
        """The pixels of products; the ids reach the scan as a filter."""
        lacking = missing_columns(self.sensor, self.table.columns)
        if lacking:
            raise ProductError(f"the table of {self.sensor} has no {', '.join(lacking)}")
        return self.table.where(F.col("product_id").isin(list(ids)))

    @property
    def probes(self) -> bool:
        return unusable(self.sensor, self.table.columns) is not None

    def clear(self, products: DataFrame, area: Area, known: DataFrame | None = None) -> DataFrame:
        return measured_clear(self.table, self.sensor, products, area, known)

    def failures(self, products: DataFrame, ids: Sequence[str]) -> DataFrame:
        return failures(self.of(ids), products)

    def __call__(self, spark, products: DataFrame, request) -> DataFrame:
        from .workflow import from_pixels

        return from_pixels(self.sensor, self.table.join(products.select("product_id"), "product_id", "left_semi"), request)

    def read(self, ids: Sequence[str], request) -> DataFrame:
        from .workflow import from_pixels

        return from_pixels(self.sensor, self.of(ids), request)

