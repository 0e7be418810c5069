"""Statistics of cubes by zone and scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import cut, percentiles

PERCENTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}
STATISTICS = {
    "count": lambda v: F.count(v),
    "mean": lambda v: F.avg(v),
    "std": lambda v: F.stddev_pop(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
} | PERCENTILES
DEFAULT = ("count", "mean", "std", "min", "max")


def zonal_statistics(cube: DataFrame, labels: DataFrame, n_zones: int, *, value: str = "lst", statistics: Sequence[str] = DEFAULT, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """scene, zone and statistics; every zone has a row for every scene (count 0 if empty).

    `labels` gives each cell's zone (iy, ix, zone; -1 outside). Empty pairs come from
    the product of zones and scenes, both a row each, not from cells. Percentiles are
    selected in rounds (see `quantiles`), so a zone may have any number of cells.
    """
    unknown = set(statistics) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    v: Column = F.col(value)
    by = [*keys, "zone"]
    inside = cube.select(*keys, "iy", "ix", value).join(labels.where("zone >= 0").select("iy", "ix", "zone"), ["iy", "ix"])
    if any(s in PERCENTILES for s in statistics):
        inside = cut(inside.select(*by, value))  # read in every round
    plain = [s for s in statistics if s not in PERCENTILES]
    found = inside.groupBy(*by).agg(F.count("*").alias("_rows"), *(STATISTICS[s](v).alias(s) for s in plain)).drop("_rows")
    selected = {s: q for s, q in PERCENTILES.items() if s in statistics}
    if selected:
        found = found.join(percentiles(inside, value, selected, by).drop("_n"), by, "left")
    zones = cube.sparkSession.range(n_zones).select(F.col("id").cast("int").alias("zone"))
    every = cube.select(*keys).distinct().crossJoin(F.broadcast(zones))
    out = every.join(found, by, "left").select(*by, *statistics)
    return out.withColumn("count", F.coalesce("count", F.lit(0))) if "count" in statistics else out
