"""Cubes from one grid to another, also across coordinate systems.

Grids are values on the driver, so the link between two of them is a table of cell
numbers, made in parallel; a cube then takes one equi-join or one aggregation. Cells
without a source are absent from the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..functions.scalar import clean
from ..grid import Grid
from .spatial import computed_once, overlap_pieces, resampling_for


def moved(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """x and y of one coordinate system in another."""
    if source == target:
        return x, y
    lon, lat = projection.unproject(x, y, source)
    return projection.project(lon, lat, target)


def grid_points(points: DataFrame, grid: Grid, values: Sequence[str], *, keys: Sequence[str] = ("scene",), lon: str = "lon", lat: str = "lat", flags: Sequence[str] = ()) -> DataFrame:
    """Mean by cell of geolocated points, with counts, and OR of flags."""
    from .binning import bin_points

    x, y = projection.project(F.col(lon), F.col(lat), grid.crs)
    placed = computed_once(points, {"iy": grid.row_of(y), "ix": grid.column_of(x)}, grid.inside(F.col("iy"), F.col("ix")))
    return bin_points(placed, values, flags, keys=[*keys, "iy", "ix"])


def links(spark: SparkSession, source: Grid, target: Grid, method: str) -> DataFrame:
    """iy, ix of the target, _iy, _ix of the source, and _w: which source cells a target cell takes, and how much of each.

    nearest: the cell that holds the target's centre. bilinear: up to four cells
    about it. mean: all source cells whose centre lies in the target cell. area: all
    that overlap it, weighted by the area of the overlap (see `area_links`).
    """
    if method == "area":
        return area_links(spark, source, target)
    if method == "mean":
        x, y = moved(source.x(), source.y(), source.crs, target.crs)
        placed = source.cells(spark).select(F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), target.row_of(y).alias("iy"), target.column_of(x).alias("ix"), F.lit(1.0).alias("_w"))
        return placed.where(target.inside(F.col("iy"), F.col("ix")))
    x, y = moved(target.x(), target.y(), target.crs, source.crs)
    px, py = (x - source.left) / source.resolution, (F.lit(source.top) - y) / source.resolution
    held = target.cells(spark).select("iy", "ix", px.alias("_px"), py.alias("_py")).where(F.col("_px").between(0, source.width) & F.col("_py").between(0, source.height))
    limit = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    if method == "nearest":
        return held.select("iy", "ix", limit(F.floor("_py"), source.height).alias("_iy"), limit(F.floor("_px"), source.width).alias("_ix"), F.lit(1.0).alias("_w"))
    if method != "bilinear":
        raise ValueError(f"{method} is not nearest, bilinear, mean or area")
    corner = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1))))
    each = held.withColumns({"_px": F.col("_px") - 0.5, "_py": F.col("_py") - 0.5}).withColumn("_k", corner)
    share = lambda c, d: F.when(F.col(d) == 1, F.col(c) - F.floor(c)).otherwise(1 - F.col(c) + F.floor(c))
    each = each.withColumn("_w", share("_py", "_k.dy") * share("_px", "_k.dx"))
    each = each.select("iy", "ix", (F.floor("_py") + F.col("_k.dy")).cast("int").alias("_iy"), (F.floor("_px") + F.col("_k.dx")).cast("int").alias("_ix"), "_w")
    return each.where((F.col("_w") > 0) & source.inside(F.col("_iy"), F.col("_ix")))


def area_links(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """iy, ix, _iy, _ix and _w, the area in the target's units of a source cell's part of a target cell.

    A source cell is a quadrilateral once its corners are projected. Corners are
    shared, so each is projected once and joined to the four cells about it; cells
    of the target that a quadrilateral may meet follow from its box. The parts of a
    cell inside the target add up to the cell.
    """
    edge = lambda c: c * source.resolution
    corner = spark.range((source.width + 1) * (source.height + 1)).select(F.expr(f"cast(id div {source.width + 1} as int)").alias("j"), (F.col("id") % (source.width + 1)).cast("int").alias("i"))
    x, y = moved(F.lit(source.left) + edge(F.col("i")), F.lit(source.top) - edge(F.col("j")), source.crs, target.crs)
    ways = [(0, 0), (0, 1), (1, 1), (1, 0)]  # in order around the cell
    about = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dj).alias("dj"), F.lit(di).alias("di")) for k, (dj, di) in enumerate(ways))))
    of_cell = corner.withColumns({"x": x, "y": y}).withColumn("c", about).select((F.col("j") - F.col("c.dj")).alias("_iy"), (F.col("i") - F.col("c.di")).alias("_ix"), "c.k", "x", "y").where(source.inside(F.col("_iy"), F.col("_ix")))
    names = [f"{a}{k + 1}" for k in range(4) for a in "xy"]
    quads = of_cell.groupBy("_iy", "_ix").agg(*(F.max(F.when(F.col("k") == int(n[1]) - 1, F.col(n[0]))).alias(n) for n in names))
    pieces = overlap_pieces(quads.withColumn("scene", F.lit(None).cast("int")), left=target.left, top=target.top, step=target.resolution, width=target.width, height=target.height, corners=names, carry=["_iy", "_ix"])
    return pieces.select("iy", "ix", "_iy", "_ix", (F.col("weight") * target.resolution**2).alias("_w"))


def resample(cube: DataFrame, source: Grid, target: Grid, values: Sequence[str], method: str, *, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """keys, iy, ix and values on the target grid; missing cells have no weight, and a cell without a known one is NULL.

    Masks are taken from the nearest cell, by any method but `mean` and `area`, which give the share that is true.
    """
    linked = links(cube.sparkSession, source, target, method)
    types = dict(cube.dtypes)
    joined = cube.select(*keys, F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), *values).join(linked, ["_iy", "_ix"])
    if method == "nearest":
        return joined.select(*keys, "iy", "ix", *values)
    number = lambda v: F.col(v).cast("int").cast("double") if types[v] == "boolean" else clean(F.col(v).cast("double"))
    mixed = [(F.sum(number(v) * F.col("_w")) / F.sum(F.when(number(v).isNotNull(), F.col("_w")))).alias(v) for v in values]
    return joined.groupBy(*keys, "iy", "ix").agg(*mixed)


def from_lattice(table: DataFrame, grid: Grid, values: Sequence[str], step: float, *, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """keys, iy, ix and values: each cell takes the point of a regular lon/lat lattice that is nearest to its centre.

    Lattice points are whole multiples of `step` (values of points that share one are
    averaged), so a cell's point is a computed key and the join an equi-join. Cells
    without a point are absent.
    """
    place = lambda c: F.floor(c / step + 0.5).cast("long")
    lon, lat = projection.unproject(grid.x(), grid.y(), grid.crs)
    cells = grid.cells(table.sparkSession).select("iy", "ix", place(lat).alias("_by"), place(lon).alias("_bx"))
    points = table.groupBy(*keys, place(F.col("lat")).alias("_by"), place(F.col("lon")).alias("_bx")).agg(*(F.avg(clean(F.col(v).cast("double"))).alias(v) for v in values))
    return cells.join(points, ["_by", "_bx"]).select(*keys, "iy", "ix", *values)


def to_grid(cube: DataFrame, source: Grid, target: Grid, values: Sequence[str], *, methods: Mapping[str, str] | None = None, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The cube on a grid: itself if it is there, else each variable by its own policy (see `resampling_for`)."""
    geometry = lambda g: (g.crs, g.left, g.top, g.resolution, g.width, g.height)
    if geometry(source) == geometry(target):
        return cube
    types = dict(cube.dtypes)
    by_method: dict[str, list[str]] = {}
    for v in values:
        by_method.setdefault(resampling_for(v, types[v], source.resolution, target.resolution, dict(methods or {})), []).append(v)
    parts = [resample(cube, source, target, names, method, keys=keys) for method, names in by_method.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, [*keys, "iy", "ix"], "full")
    return out
