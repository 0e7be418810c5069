"""Spatial joins on derived integer keys: cells, polygons, footprints and neighbours.

Range predicates are turned into equi-joins on cells or buckets, so no plan
compares every row with every other.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .polygons import ENDS

Ring = Sequence[tuple[float, float]]


def in_polygon(x: Column, y: Column, rings: Sequence[Ring]) -> Column:
    """Strictly inside by ray-crossing parity; holes are rings, points on an edge are outside.

    The edges are one constant array, which a row goes through if it lies in the
    bounding box: right for the outline of an area. Many zones, or outlines of very
    many edges, are joined as a table of edges (`polygons`).
    """
    edges = [tuple(map(float, (*a, *b))) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if tuple(a) != tuple(b)]
    xs, ys = [v for e in edges for v in e[::2]], [v for e in edges for v in e[1::2]]
    box = (x > min(xs)) & (x < max(xs)) & (y > min(ys)) & (y < max(ys))
    held = F.from_json(F.lit(json.dumps([dict(zip(ENDS, e, strict=True)) for e in edges])), "array<struct<x1: double, y1: double, x2: double, y2: double>>")

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (y - e["y1"]) * ((e["x2"] - e["x1"]) / (e["y2"] - e["y1"])) + e["x1"])

    def touches(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return box & (F.size(F.filter(held, crosses)) % 2 == 1) & ~F.exists(held, touches)


def computed_once(df: DataFrame, columns: dict[str, Column], kept: Column) -> DataFrame:
    """The columns added, and of the rows those that `kept`, a condition on them, keeps.

    A filter would be pushed below long expressions and repeat them, until no method
    holds the code; the row number that it asks for holds it back.
    """
    return df.withColumns({**columns, "_row": F.monotonically_increasing_id()}).where(kept & (F.col("_row") >= 0)).drop("_row")


def clip_to(df: DataFrame, inside: Column, values: Sequence[str]) -> DataFrame:
    """Values outside become NULL, masks outside become false."""
    types = dict(df.dtypes)
    inside = F.coalesce(inside, F.lit(False))
    return df.withColumns({v: (F.coalesce(F.col(v), F.lit(False)) & inside) if types[v] == "boolean" else F.when(inside, F.col(v)) for v in values})


def clip_box(df: DataFrame, west: float, south: float, east: float, north: float, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside a box, borders included; the filter reaches the scan."""
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def crop_window(swath: DataFrame, inside: Column, *, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """The smallest row and column window of each product that holds the pixels inside."""
    window = swath.where(inside).groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in ("scan_row", "scan_col") for n, f in (("lo", F.min), ("hi", F.max))))
    joined = swath.join(window, list(keys))
    kept = joined.where(F.col("scan_row").between(F.col("_lo_scan_row"), F.col("_hi_scan_row")) & F.col("scan_col").between(F.col("_lo_scan_col"), F.col("_hi_scan_col")))
    return kept.select(swath.columns)


def tie_point_lerp(image: DataFrame, ties: DataFrame, value: str, *, step: int, offset: float = 0.0) -> DataFrame:
    """Linear interpolation along columns of values known every `step` columns; NULL outside."""
    at = (F.col("scan_col") - offset) / step
    rows = image.withColumn("_at", at).withColumn("_left", F.floor("_at").cast("int")).withColumn("_right", F.ceil("_at").cast("int"))
    left = ties.select("scan_row", F.col("tie_col").alias("_left"), F.col(value).alias("_a"))
    right = ties.select("scan_row", F.col("tie_col").alias("_right"), F.col(value).alias("_b"))
    out = rows.join(left, ["scan_row", "_left"], "left").join(right, ["scan_row", "_right"], "left")
    return out.withColumn(value, F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_left"))).select(*image.columns, value)


def nearest_cell(cells: DataFrame, source: DataFrame, x: Column, y: Column, *, left: float, top: float, step: float, width: int, height: int, values: Sequence[str], by_scene: bool = True) -> DataFrame:
    """Each cell takes the source cell whose centre is nearest to (x, y), on one CRS.

    The key is computed, so the join is an equi-join; centres beyond half a source
    cell match nothing, which leaves NULL, or false for masks. On a border between
    two source cells the later one is taken.
    """
    keyed = cells.withColumn("_ix", F.floor((x - left) / step).cast("int")).withColumn("_iy", F.ceil((F.lit(top) - y) / step).cast("int") - 1)
    keyed = keyed.withColumn("_ix", F.when((F.col("_ix") == width) & (x == left + width * step), width - 1).otherwise(F.col("_ix"))).withColumn("_iy", F.when((F.col("_iy") == -1) & (y == top), 0).otherwise(F.col("_iy")))
    types = dict(source.dtypes)
    right = source.select(*(["scene"] if by_scene else []), F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), *values)
    out = keyed.join(right, ["scene", "_iy", "_ix"] if by_scene else ["_iy", "_ix"], "left").drop("_iy", "_ix")
    return out.withColumns({v: F.coalesce(v, F.lit(False)) for v in values if types[v] == "boolean"})


def spread_down(fine: DataFrame, coarse: DataFrame, factor: int, values: Sequence[str], keys: Sequence[str] = ("scene",), suffix: str = "") -> DataFrame:
    """Every fine cell gets the values of its coarse cell."""
    right = coarse.select(*keys, F.col("iy").alias("_cy"), F.col("ix").alias("_cx"), *(F.col(v).alias(f"{v}{suffix}") for v in values))
    return fine.withColumn("_cy", F.expr(f"iy div {factor}").cast("int")).withColumn("_cx", F.expr(f"ix div {factor}").cast("int")).join(right, [*keys, "_cy", "_cx"], "left").drop("_cy", "_cx")


def bilinear_corners(fine: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """Each fine cell with the coarse cells (_cy, _cx) around its centre that have a weight (_w)."""
    pos = lambda c: (F.col(c) + 0.5) / factor - 0.5
    py, px = (F.least(F.greatest(pos(c), F.lit(0.0)), F.lit(float(n - 1))) for c, n in (("iy", height), ("ix", width)))
    rows = fine.withColumn("_py", py).withColumn("_px", px)
    corners = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))
    exploded = rows.withColumn("_k", F.explode(corners)).withColumn("_cy", (F.floor("_py") + F.col("_k.dy")).cast("int")).withColumn("_cx", (F.floor("_px") + F.col("_k.dx")).cast("int"))
    fy, fx = F.col("_py") - F.floor("_py"), F.col("_px") - F.floor("_px")
    weight = F.when(F.col("_k.dy") == 1, fy).otherwise(F.lit(1.0) - fy) * F.when(F.col("_k.dx") == 1, fx).otherwise(F.lit(1.0) - fx)
    return exploded.withColumn("_w", weight).where("_w > 0").drop("_py", "_px", "_k")


def bilinear_up(fine: DataFrame, coarse: DataFrame, factor: int, value: str, *, height: int, width: int, keys: Sequence[str] = ("scene",), out: str | None = None) -> DataFrame:
    """Bilinear interpolation of coarse centres at fine centres; beyond the outer centres the outer value.

    Missing corners make the result NULL unless their weight is zero. Height and
    width are those of the coarse grid.
    """
    out = out or value
    by = [*keys, "iy", "ix"]
    right = coarse.select(*keys, F.col("iy").alias("_cy"), F.col("ix").alias("_cx"), F.col(value).alias("_v"))
    joined = bilinear_corners(fine.select(*by), factor, height, width).join(right, [*keys, "_cy", "_cx"], "left")
    mixed = joined.groupBy(*by).agg(F.sum(F.col("_v") * F.col("_w")).alias("_sum"), F.count_if(F.col("_v").isNull()).alias("_missing"))
    result = mixed.select(*by, F.when(F.col("_missing") == 0, F.col("_sum")).alias(out))
    return fine.drop(out).join(result, by, "left")


def footprint_fill(gridded: DataFrame, cells: DataFrame, pixels: DataFrame, value: str, *, radius_km: float, mid_lat: float, bucket_deg: float) -> DataFrame:
    """Cells without a value take the nearest pixel's within a radius (equirectangular kilometres).

    `gridded` has (scene, iy, ix, value); `cells` all (scene, iy, ix, lon, lat);
    `pixels` (scene, pixel_id, lon, lat, value). Pixels are keyed by buckets at
    least as wide as the radius, so a cell meets nine buckets; ties go to the
    smaller pixel_id.
    """
    ky, kx = 110.574, 111.320 * math.cos(math.radians(mid_lat))
    if bucket_deg * min(ky, kx) < radius_km:
        raise ValueError("buckets must be at least as wide as the radius")
    bucket = lambda c: F.floor(F.col(c) / bucket_deg).cast("long")
    have = gridded.where(F.col(value).isNotNull())
    empty = cells.join(have, ["scene", "iy", "ix"], "left_anti")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = empty.withColumn("_k", F.explode(around)).withColumn("_by", bucket("lat") + F.col("_k.i")).withColumn("_bx", bucket("lon") + F.col("_k.j")).drop("_k")
    offered = pixels.where(F.col(value).isNotNull()).select("scene", F.col("pixel_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col(value).alias("_v"), bucket("lat").alias("_by"), bucket("lon").alias("_bx"))
    d2 = F.pow((F.col("lon") - F.col("_lon")) * kx, F.lit(2)) + F.pow((F.col("lat") - F.col("_lat")) * ky, F.lit(2))
    found = asked.join(offered, ["scene", "_by", "_bx"]).withColumn("_d2", d2).where(F.col("_d2") <= radius_km**2)
    filled = found.groupBy("scene", "iy", "ix").agg(F.min_by("_v", F.struct("_d2", "pixel_id")).alias(value)).withColumn("filled", F.lit(True))
    return have.select("scene", "iy", "ix", value, F.lit(False).alias("filled")).unionByName(filled)


def halved(polygons: np.ndarray, axis: int, limit: np.ndarray, below: bool) -> np.ndarray:
    """Convex polygons (n, corners, 2), each cut by its own line across an axis; the side below or above stays.

    A cut adds a corner at most; unused places repeat the last corner, which has no area.
    """
    here = polygons
    following = np.roll(here, -1, axis=1)
    sign = 1.0 if below else -1.0
    a, b = (sign * (limit[:, None] - p[:, :, axis]) for p in (here, following))  # >= 0: this side
    with np.errstate(divide="ignore", invalid="ignore"):
        crossing = here + (following - here) * (a / (a - b))[:, :, None]
    n, corners = a.shape
    slots = np.stack([here, crossing], 2).reshape(n, 2 * corners, 2)
    used = np.stack([a >= 0, (a >= 0) != (b >= 0)], 2).reshape(n, 2 * corners)
    order = np.argsort(~used, axis=1, kind="stable")[:, : corners + 1]
    count = used.sum(1)
    order = np.where(np.arange(corners + 1) < count[:, None], order, np.take_along_axis(order, np.maximum(count - 1, 0)[:, None], 1))
    out = np.take_along_axis(slots, order[:, :, None], 1)
    out[count == 0] = 0.0
    return out


def clipped_areas(polygons: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Areas of convex polygons (n, corners, 2) within their boxes, all at once."""
    for axis, limit, below in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        polygons = halved(polygons, axis, limit, below)
    x, y = polygons[:, :, 0], polygons[:, :, 1]
    x, y = x - x[:, :1], y - y[:, :1]
    return np.abs((x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1)) / 2


def overlap_pieces(swath: DataFrame, *, left: float, top: float, step: float, width: int, height: int, corners: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Pieces (scene, iy, ix, weight, carried columns) of swath quadrilaterals over cells.

    `corners` are eight columns x1, y1 .. x4, y4. Candidate cells follow from the
    quadrilateral's box, so there is no join; weight is the overlap over the cell's
    area, and slivers below max(1e-8, 1e-10 cell) are left out.
    """
    xs, ys = [F.col(c) for c in corners[::2]], [F.col(c) for c in corners[1::2]]
    lo = lambda v, n: F.greatest(F.lit(0), F.least(v, F.lit(n - 1)))
    col = lambda x: F.floor((x - left) / step).cast("int")
    row = lambda y: F.floor((F.lit(top) - y) / step).cast("int")
    touches = (F.greatest(*xs) >= left) & (F.least(*xs) <= left + width * step) & (F.greatest(*ys) >= top - height * step) & (F.least(*ys) <= top)
    # what touches nothing has no rows to explode; as a filter it would repeat the corners' expressions below, beyond what a method may hold
    rows = F.when(touches, F.sequence(lo(row(F.greatest(*ys)), height), lo(row(F.least(*ys)), height)))
    cells = swath.withColumn("iy", F.explode(rows)).withColumn("ix", F.explode(F.sequence(lo(col(F.least(*xs)), width), lo(col(F.greatest(*xs)), width))))

    @F.pandas_udf("double")
    def area(iy: pd.Series, ix: pd.Series, *points: pd.Series) -> pd.Series:
        quads = np.stack([p.to_numpy(float) for p in points], 1).reshape(-1, 4, 2)
        x0, y1 = left + ix.to_numpy() * step, top - iy.to_numpy() * step
        return pd.Series(clipped_areas(quads, x0, y1 - step, x0 + step, y1))

    cut = cells.withColumn("_area", area("iy", "ix", *corners)).where(F.col("_area") > max(1e-8, 1e-10 * step * step))
    return cut.select("scene", "iy", "ix", (F.col("_area") / (step * step)).alias("weight"), *carry)


def around(cells: DataFrame, sites: DataFrame, reach: float, *, keys: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Cells with every site (sx, sy) of the same keys in the nine buckets about them, and d2, the squared distance.

    Buckets are as wide as `reach`, so no site within it is missed; farther ones may be there.
    """
    bucket = lambda c: F.floor(F.col(c) / reach).cast("long")
    nine = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = cells.withColumn("_k", F.explode(nine)).withColumns({"_by": bucket(y) + F.col("_k.i"), "_bx": bucket(x) + F.col("_k.j")}).drop("_k")
    offered = sites.withColumns({"_by": bucket("sy"), "_bx": bucket("sx")})
    met = asked.join(offered, [*keys, "_by", "_bx"]).drop("_by", "_bx")
    return met.withColumn("d2", (F.col(x) - F.col("sx")) * (F.col(x) - F.col("sx")) + (F.col(y) - F.col("sy")) * (F.col(y) - F.col("sy")))


def nearest_sites(cells: DataFrame, sites: DataFrame, x: str, y: str, k: int, *, cell_keys: Sequence[str], site_key: str | Sequence[str], keys: Sequence[str] = (), places: DataFrame | None = None) -> DataFrame:
    """Cells with rank and distance of the k nearest sites (sx, sy) of the same `keys`, all if there are fewer.

    Sites are counted in square buckets whose side doubles from level to level. A
    cell looks on the first level where the nine buckets about it hold k sites:
    its k-th is within 2 * sqrt(2) sides, so the nine buckets two levels up hold all
    that may be nearer, and only those are joined. Ties go to the smaller site key.
    `places` is a table whose x and y span those of the cells, if the cells cost
    much to make: its extent is looked up when the plan is built, as is the sites'.
    """
    site_key = [site_key] if isinstance(site_key, str) else list(site_key)
    ends = sites.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("sx", "sy") for name, f in (("lo", F.min), ("hi", F.max)))).first()
    mine = (cells if places is None else places).agg(*(f(c).alias(f"{name}_{d}") for c, d in ((x, "sx"), (y, "sy")) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    known = [(ends[f"lo_{c}"], ends[f"hi_{c}"], mine[f"lo_{c}"], mine[f"hi_{c}"]) for c in ("sx", "sy")]
    nothing = not ends["n"] or any(v is None for vs in known for v in vs)
    (x0, x1), (y0, y1) = [(0.0, 1.0)] * 2 if nothing else [(min(v), max(v)) for v in known]
    extent = max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)
    level_sites = max(1.0, (ends["n"] or 1) * 4 / k)
    side = max(extent / 2**20, extent / math.sqrt(level_sites))  # about k / 4 sites in a bucket of level 0
    top = max(0, math.ceil(math.log2(extent / side)))  # there the nine buckets hold everything
    home = lambda c, low: F.floor((F.col(c) - low) / side).cast("long")
    up = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))
    nine = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))

    offered = sites.withColumns({"_hx": home("sx", x0), "_hy": home("sy", y0)}).withColumn("_level", levels)
    offered = offered.withColumns({"_bx": up("_hx", F.col("_level")), "_by": up("_hy", F.col("_level"))}).drop("_hx", "_hy")
    counts = offered.groupBy(*keys, "_level", "_bx", "_by").agg(F.count("*").alias("_n"))
    placed = cells.withColumns({"_hx": home(x, x0), "_hy": home(y, y0)})
    homes = placed.select(*keys, "_hx", "_hy").distinct()
    asked = homes.withColumn("_level", levels).withColumn("_k", nine).withColumns({"_bx": up("_hx", F.col("_level")) + F.col("_k.i"), "_by": up("_hy", F.col("_level")) + F.col("_k.j")}).drop("_k")
    held = asked.join(counts, [*keys, "_level", "_bx", "_by"]).groupBy(*keys, "_hx", "_hy", "_level").agg(F.sum("_n").alias("_n"))
    found = held.groupBy(*keys, "_hx", "_hy").agg(F.least(F.coalesce(F.min(F.when(F.col("_n") >= k, F.col("_level"))) + 2, F.lit(top)), F.lit(top)).alias("_level"))
    looking = placed.join(found, [*keys, "_hx", "_hy"]).withColumn("_k", nine).withColumns({"_bx": up("_hx", F.col("_level")) + F.col("_k.i"), "_by": up("_hy", F.col("_level")) + F.col("_k.j")}).drop("_k", "_hx", "_hy")
    met = looking.join(offered, [*keys, "_level", "_bx", "_by"]).drop("_level", "_bx", "_by")
    d2 = (F.col(x) - F.col("sx")) * (F.col(x) - F.col("sx")) + (F.col(y) - F.col("sy")) * (F.col(y) - F.col("sy"))
    near = Window.partitionBy(*cell_keys).orderBy("_d2", *site_key)
    return met.withColumn("_d2", d2).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).withColumn("distance", F.sqrt("_d2")).drop("_d2")


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over as many tasks as shuffles have, for groups with much work and few bytes.

    Adaptive execution merges small shuffles, and would give all such groups to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cells_table(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select(F.expr(f"cast(id div {width} as int)").alias("iy"), (F.col("id") % width).cast("int").alias("ix"))



def resampling_for(name: str, dtype: str, source_step: float, target_step: float, explicit: dict[str, str] | None = None) -> str:
    """`nearest` or `mean` for a variable: what is asked for, nearest for masks and flags, mean if the source is finer."""
    if explicit and name in explicit:
        return explicit[name]
    if dtype == "boolean" or name.endswith("mask") or name.endswith("flags"):
        return "nearest"
    return "mean" if source_step < target_step else "nearest"
