"""Matching in time: nearest scene within a tolerance, forecasts, tiles of one pass.

Pairs are resolved on tables of scene times (a row a scene), then one equi-join
brings the cells together. The nearest time is found with two window functions
over the union of both time tables, so it is a sort, not a product of the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def nearest_times(targets: DataFrame, features: DataFrame, tolerance_us: int, *, target: str = "scene", feature: str = "scene", keys: Sequence[str] = (), tie: str = "later") -> DataFrame:
    """keys, target time, matched_time and time_delta_us (absolute) of every distinct target time.

    The last feature time at or before and the first at or after each target are
    carried along the sorted union; the nearer wins, a tie goes to the `later` or
    `earlier`. Beyond the tolerance (inclusive) both results are NULL. Distinct times
    are sorted by key; without keys in one task, which holds a row a scene and no cell.
    """
    a = targets.select(*keys, F.col(target).alias("t")).distinct().select(*keys, "t", F.lit(None).cast(dict(features.dtypes)[feature]).alias("f"), F.lit(1).alias("is_target"))
    b = features.select(*keys, F.col(feature).alias("t"), F.col(feature).alias("f"), F.lit(0).alias("is_target")).where("t is not null").distinct()
    both = a.unionByName(b)
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    back = order.orderBy("t", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.orderBy(F.desc("t"), "is_target").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("prev", F.last("f", ignorenulls=True).over(back)).withColumn("next", F.last("f", ignorenulls=True).over(ahead)).where("is_target = 1")
    d_prev, d_next = micros("t") - micros("prev"), micros("next") - micros("t")
    take_next = (d_next <= d_prev) if tie == "later" else (d_next < d_prev)
    chosen = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull(), F.col("prev")).when(take_next, F.col("next")).otherwise(F.col("prev"))
    near = near.withColumn("m", chosen).withColumn("d", F.abs(micros("t") - micros("m")))
    ok = F.col("d") <= tolerance_us
    return near.select(*keys, F.col("t").alias(target), F.when(ok, F.col("m")).alias("matched_time"), F.when(ok, F.col("d")).alias("time_delta_us"))


def align(target: DataFrame, features: DataFrame, values: Sequence[str], *, tolerance_us: int = 3 * 86_400_000_000, name: str = "", tie: str = "later") -> DataFrame:
    """Every target cell with the features of the nearest scene within the tolerance.

    Left outer: no match leaves NULL, or false for masks. Adds `<name>_matched_time`
    and `<name>_time_delta_us`.
    """
    prefix = f"{name}_" if name else ""
    pairs = nearest_times(target, features, tolerance_us, tie=tie).select("scene", F.col("matched_time").alias(f"{prefix}matched_time"), F.col("time_delta_us").alias(f"{prefix}time_delta_us"))
    types = dict(features.dtypes)
    right = features.select(F.col("scene").alias(f"{prefix}matched_time"), "iy", "ix", *values)
    out = target.join(pairs, "scene", "left").join(right, [f"{prefix}matched_time", "iy", "ix"], "left")
    return out.withColumns({v: F.coalesce(v, F.lit(False)) for v in values if types[v] == "boolean"})


#: Days within which a sensor's scene may be matched; others take the default. Fixed values.
DEFAULT_TOLERANCE_DAYS = 3.0


def tolerance_us(sensor: str | None, by_sensor: dict[str, float] | None = None, default_days: float = DEFAULT_TOLERANCE_DAYS) -> int:
    """Tolerance of a sensor in microseconds."""
    return int((by_sensor or {}).get(sensor or "", default_days) * 86_400_000_000)


def freshest_forecast(forecast: DataFrame, values: Sequence[str], *, run: str = "run", lead_us: str = "lead_us", keys: Sequence[str] = ()) -> DataFrame:
    """One forecast for each valid time: the shortest lead, then the earliest run."""
    valid = F.timestamp_micros(micros(run) + F.col(lead_us))
    pick = F.struct(F.col(lead_us).alias("lead_us"), F.col(run).alias("run"), *values)
    best = forecast.withColumn("valid_time", valid).groupBy("valid_time", *keys).agg(F.min(pick).alias("p"))
    return best.select("valid_time", *keys, F.col("p.lead_us").alias("lead_us"), F.col("p.run").alias("run"), *(F.col(f"p.{v}").alias(v) for v in values))


def pass_groups(tiles: DataFrame, tolerance_us: int, *, time: str = "tile_time", keys: Sequence[str] = ()) -> DataFrame:
    """Adds pass_time: a tile belongs to the group whose first tile is at most the tolerance before it.

    Groups are anchored at their first tile, unlike sessions by gaps. A gap of more
    than the tolerance starts a group whatever came before, so times are cut there
    first; only within such a run, a unit of work of its own, is the chain followed.
    """
    times = tiles.select(*keys, micros(time).alias("_t")).where("_t is not null").distinct()
    by_time = Window.partitionBy(*keys).orderBy("_t") if keys else Window.orderBy("_t")  # a row a tile time
    cut = (F.col("_t") - F.lag("_t").over(by_time) > tolerance_us).cast("int")
    runs = times.withColumn("_run", F.sum(F.coalesce(cut, F.lit(0))).over(by_time))
    types = dict(runs.dtypes)

    def follow(run: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(run["_t"].to_numpy())
        anchors, at = np.empty_like(t), 0
        while at < len(t):
            stop = int(np.searchsorted(t, t[at] + tolerance_us, side="right"))
            anchors[at:stop] = t[at]
            at = stop
        return run.sort_values("_t").assign(_g=anchors)[[*keys, "_t", "_g"]]

    groups = runs.groupBy(*keys, "_run").applyInPandas(follow, ", ".join([*(f"{k} {types[k]}" for k in keys), "_t long", "_g long"]))
    groups = groups.select(*keys, "_t", F.timestamp_micros("_g").alias("pass_time"))
    return tiles.withColumn("_t", micros(time)).join(groups, [*keys, "_t"], "left").drop("_t")


def mosaic(tiles: DataFrame, values: Sequence[str], *, rank: str, group: str = "pass_time", valid: str | None = None) -> DataFrame:
    """First finite value by tile rank in each group's cell; masks are ORed."""
    aggs = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(rank))).alias(v) for v in values]
    if valid:
        aggs.append(F.coalesce(F.bool_or(valid), F.lit(False)).alias(valid))
    return tiles.groupBy(F.col(group).alias("scene"), "iy", "ix").agg(*aggs)


def fullest_tile(tiles: DataFrame, value: str, *, tile: str, group: str = "pass_time") -> DataFrame:
    """Of tiles of a group that lie on different grids, the one with most valid cells; the first tile on ties.

    Cells are counted before anything is compared, so a group costs a row a tile.
    """
    counts = tiles.groupBy(group, tile).agg(F.count(value).alias("_n"))
    best = counts.groupBy(group).agg(F.max_by(F.col(tile), F.struct(F.col("_n"), -F.col(tile))).alias(tile))
    return tiles.join(best, [group, tile], "left_semi")


def union_scenes(cubes: Sequence[DataFrame]) -> DataFrame:
    """Scenes of several cubes one after the other, by column name; columns a cube lacks are NULL."""
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def combine_acquisitions(gridded: DataFrame, count: str, *, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Cells gridded acquisition by acquisition as scenes in time.

    Where two acquisitions of one time have a cell, the one with more observations
    stays, then the one whose keys sort first.
    """
    best = F.row_number().over(Window.partitionBy("scene", "iy", "ix").orderBy(F.desc(count), *keys))
    return gridded.withColumn("_k", best).where("_k = 1").drop("_k", *keys)


def merge_equal(left: DataFrame, right: DataFrame, shared: Sequence[str], keys: Sequence[str] = ("scene", "iy", "ix")) -> DataFrame:
    """Equi-join of two cubes whose shared variables must agree where both have them; a conflict fails the query."""
    renamed = right.select(*keys, *(F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c not in keys))
    out = left.join(renamed, list(keys), "left")
    for c in shared:
        clash = F.col(c).isNotNull() & F.col(f"_r_{c}").isNotNull() & (F.col(c) != F.col(f"_r_{c}"))
        out = out.withColumn(c, F.when(clash, F.raise_error(F.lit(f"conflicting values of {c}"))).otherwise(F.coalesce(c, f"_r_{c}"))).drop(f"_r_{c}")
    return out
