"""Observations to cells: binning, gridding, composites and summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EXCEPTION_BITS, clean
from .quantiles import percentiles

CELL = ["scene", "iy", "ix"]


def bin_points(points: DataFrame, values: Sequence[str], flags: Sequence[str] = (), keys: Sequence[str] = CELL) -> DataFrame:
    """Mean and count of finite values, and OR of flags (0 if none), by cell.

    One shuffle on the cell with partial aggregation before it.
    """
    aggs = [a for v in values for a in (F.avg(clean(F.col(v).cast("double"))).alias(v), F.count(clean(F.col(v).cast("double"))).alias(f"{v}_count"))]
    aggs += [F.coalesce(F.bit_or(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags]
    return points.groupBy(*keys).agg(*aggs)


def bin_weighted(pieces: DataFrame, value: str, weight: str, keys: Sequence[str] = CELL, flags: Sequence[str] = ()) -> DataFrame:
    """Area-weighted mean of swath pieces by cell, with coverage and counts."""
    v, w = clean(F.col(value).cast("double")), F.col(weight)
    used = F.when(v.isNotNull(), w)
    return pieces.groupBy(*keys).agg(
        (F.sum(v * w) / F.nullif(F.sum(used), F.lit(0.0))).alias(value),
        F.least(F.lit(1.0), F.sum(w)).alias("coverage_fraction"),
        F.count(v).alias("valid_observation_count"),
        F.count_if(v.isNull()).alias("invalid_observation_count"),
        F.count("*").alias("source_footprint_count"),
        F.lit(False).alias("no_observation_mask"),
        (F.count(v) > 0).alias("valid_mask"),
        *(F.coalesce(F.bit_or(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags),
    )


def block_mean(fine: DataFrame, factor: int, values: Sequence[str], *, min_share: float | None = None, height: int | None = None, width: int | None = None, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Mean over factor x factor blocks of cells.

    With `min_share`, blocks with a smaller share of finite cells are NULL, and
    blocks that reach beyond height or width are dropped. Absent cells count as
    missing, since the share is of factor * factor.
    """
    if factor < 2:
        raise ValueError("a block has at least two cells a side")
    rows = fine
    if height is not None:
        rows = rows.where(F.col("iy") < height // factor * factor)
    if width is not None:
        rows = rows.where(F.col("ix") < width // factor * factor)
    by = [*keys, F.expr(f"iy div {factor}").cast("int").alias("iy"), F.expr(f"ix div {factor}").cast("int").alias("ix")]
    types = dict(fine.dtypes)
    aggs = []
    for v in values:
        x = F.col(v).cast("int").cast("double") if types[v] == "boolean" else clean(F.col(v).cast("double"))
        enough = F.lit(True) if min_share is None else F.count(x) >= min_share * factor * factor - 1e-9
        aggs.append(F.when(enough, F.avg(x)).alias(v))
    return rows.groupBy(*by).agg(*aggs)


def composite(cube: DataFrame, values: Sequence[str], *, method: str = "median", min_observations: int = 1, valid: str = "valid_mask") -> DataFrame:
    """Median or mean over scenes of clear values by cell, with the clear count."""
    if method not in ("median", "mean"):
        raise ValueError("method is median or mean")
    if min_observations < 1:
        raise ValueError("min_observations must be positive")
    pick = {"median": F.median, "mean": F.avg}[method]
    ok = F.coalesce(F.col(valid), F.lit(False))
    count = F.count_if(ok)
    return cube.groupBy("iy", "ix").agg(*(pick(F.when(ok, F.col(v))).alias(v) for v in values), count.alias("clear_observation_count"), (count >= min_observations).alias("valid_mask"))


def scene_coverage(cube: DataFrame, valid: str = "valid_mask", cells: int | None = None) -> DataFrame:
    """Clear cells and their share by scene; absent cells are not clear if `cells` is the grid's size."""
    clear = F.count_if(F.coalesce(F.col(valid), F.lit(False)))
    return cube.groupBy("scene").agg(clear.alias("clear_pixel_count"), (clear / (F.lit(cells) if cells else F.count("*"))).alias("clear_fraction"))


def daily_mean(cube: DataFrame, values: Sequence[str] = ("lst",), *, fill_gaps: bool = False, day: Column | None = None) -> DataFrame:
    """Mean by day and cell, with valid_count of the first value.

    `fill_gaps` adds the days without any scene between the first and last, with
    count 0 for every cell seen; that is a left join from a calendar of days.
    """
    day = (day if day is not None else F.col("scene")).cast("date")
    means = cube.groupBy(day.alias("day"), "iy", "ix").agg(*(F.avg(v).alias(v) for v in values), F.count(values[0]).alias("valid_count"))
    if not fill_gaps:
        return means
    span = cube.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    cells = cube.select("iy", "ix").distinct()
    return F.broadcast(days).crossJoin(cells).join(means, ["day", "iy", "ix"], "left").withColumn("valid_count", F.coalesce("valid_count", F.lit(0)))


def heat_metrics(cube: DataFrame, value: str = "lst", threshold: float = 35.0) -> DataFrame:
    """Mean, 95th percentile, maximum, hot and observed counts over time by cell."""
    v = F.col(value)
    return cube.groupBy("iy", "ix").agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.95)).alias("p95"), F.max(v).alias("max"), F.count_if(v >= threshold).alias("hot_count"), F.count(v).alias("observation_count"))


def value_summary(df: DataFrame, value: str = "lst") -> DataFrame:
    """total, valid, mean, median, min and max of a column; the median is selected in rounds, whatever the number of rows."""
    v = F.col(value)
    plain = df.agg(F.count("*").alias("total"), F.count(v).alias("valid"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = percentiles(df, value, {"median": 0.5}).agg(F.max("median").alias("median"))  # a row also where there is no value
    return plain.crossJoin(F.broadcast(middle)).select("total", "valid", "mean", "median", "min", "max")


def quality_summary(df: DataFrame, valid: str = "valid_mask") -> DataFrame:
    ok = F.coalesce(F.col(valid), F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.avg(ok.cast("int")).alias("valid_fraction"))


def flag_counts(df: DataFrame, flags: str = "exception_flags", bits: dict[str, int] = EXCEPTION_BITS) -> DataFrame:
    """flag, bit and pixels with it: one pass of counts, then unpivoted."""
    x = F.coalesce(F.col(flags).cast("long"), F.lit(0))
    counts = df.agg(*(F.count_if(x.bitwiseAND(F.lit(b)) != 0).alias(n) for n, b in bits.items()))
    entries = F.array(*(F.struct(F.lit(n).alias("flag"), F.lit(b).alias("bit"), F.col(n).alias("pixels")) for n, b in bits.items()))
    return counts.select(F.inline(entries))


def availability(cube: DataFrame, values: Sequence[str], cells: int | None = None) -> DataFrame:
    """Mean over variables of the finite share by scene.

    Without `cells` the share is of the rows present; with it absent cells count as missing.
    """
    finite = reduce(lambda a, b: a + b, (F.col(v).isNotNull().cast("int") for v in values))
    share = F.sum(finite) / (F.lit(cells) if cells else F.count("*")) / len(values)
    return cube.groupBy("scene").agg(share.alias("feature_availability"))


def clear_fraction(pixels: DataFrame, unusable: Column, in_area: Column, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Usable share of the pixels inside an area, by product; products without any are left out."""
    return pixels.where(in_area).groupBy(*keys).agg((F.lit(1.0) - F.avg(F.coalesce(unusable, F.lit(True)).cast("int"))).alias("clear_fraction"), F.count("*").alias("pixels"))


def first_finite(tiles: DataFrame, value: str, rank: str, keys: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """The value of the lowest-ranked tile that has one (overlapping elevation tiles, mosaics)."""
    return tiles.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(rank))).alias(value))


def methane_ratio(pixels: DataFrame, keys: Sequence[str], *, strong: str = "B12", weak: str = "B11", out: str = "mbsp") -> DataFrame:
    """Adds the single-pass methane signal (strong - c weak) / (c weak), c the regression of a scene through the origin."""
    x, y = F.col(weak).cast("double"), F.col(strong).cast("double")
    both = x.isNotNull() & y.isNotNull()
    slopes = pixels.where(both).groupBy(*keys).agg((F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("_c"))
    joined = pixels.join(slopes, list(keys), "left")
    expected = F.col("_c") * x
    return joined.withColumn(out, (y - expected) / F.nullif(expected, F.lit(0.0))).drop("_c")


def methane_change(detection: DataFrame, reference: DataFrame, keys: Sequence[str] = ("iy", "ix"), *, value: str = "mbsp", out: str = "mbmp") -> DataFrame:
    """Multi-pass signal: a plume scene's single-pass signal less that of a plume-free scene, cell by cell."""
    before = reference.select(*keys, F.col(value).alias("_before"))
    return detection.join(before, list(keys)).withColumn(out, F.col(value) - F.col("_before")).drop("_before")


def gridded_gas(pixels: DataFrame, cells: DataFrame, *, value: str = "value", left: float, top: float, step: float, width: int, height: int, radius_km: float, mid_lat: float) -> DataFrame:
    """scene, iy, ix, value, filled: means of valid pixels on a lon/lat grid whose last edges belong to it, then the footprint fill.

    `cells` has scene, iy, ix, lon, lat of every cell that may be filled. A scene
    without a valid pixel has no row.
    """
    from .spatial import footprint_fill

    lon, lat = F.col("lon"), F.col("lat")
    col = F.when(lon == left + width * step, width - 1).otherwise(F.floor((lon - left) / step))
    row = F.when(lat == top, 0).otherwise(F.ceil((F.lit(top) - lat) / step) - 1)
    good = pixels.where(F.coalesce("valid", F.lit(False)) & F.col(value).isNotNull())
    placed = good.withColumn("ix", col.cast("int")).withColumn("iy", row.cast("int"))
    placed = placed.where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))
    means = bin_points(placed, [value]).select("scene", "iy", "ix", value)
    seen = means.select("scene").distinct()
    bucket = radius_km / (110.574 * math.cos(math.radians(mid_lat))) * 1.01
    return footprint_fill(means, cells.join(seen, "scene", "left_semi"), good, value, radius_km=radius_km, mid_lat=mid_lat, bucket_deg=bucket)
