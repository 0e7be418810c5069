"""Windows around cells: dilation, gradients, spatio-temporal fusion, semivariograms.

Masks grow along one axis, then the other. Small windows explode each cell to its
neighbours' positions and sum them with one equi-join; wide weighted windows run
within tiles that carry a halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import apart

EPSILON = 1e-6


def grown(cells: DataFrame, pixels: int, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """keys, iy, ix of all cells within `pixels` rows and columns of the given ones, along one axis, then the other."""
    steps = F.explode(F.sequence(F.lit(-pixels), F.lit(pixels)))
    out = cells.select(*keys, "iy", "ix").distinct()
    for axis in ("iy", "ix"):
        out = out.withColumn("_d", steps).withColumn(axis, F.col(axis) + F.col("_d")).drop("_d").distinct()
    return out


def slope_aspect(dem: DataFrame, z: str, resolution: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Slope and aspect in degrees: central differences, one-sided at edges; rows run south, columns east.

    Neighbours count only if they are the adjacent cell.
    """

    def gradient(by: str, order: str, sign: float) -> Column:
        w = Window.partitionBy(*keys, by).orderBy(order)
        prev = F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag(z).over(w))
        following = F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead(z).over(w))
        rise = F.when(prev.isNotNull() & following.isNotNull(), (following - prev) / 2).when(following.isNotNull(), following - F.col(z)).when(prev.isNotNull(), F.col(z) - prev)
        return rise * (sign / resolution)

    out = dem.withColumn("_dx", gradient("iy", "ix", 1.0)).withColumn("_dy", gradient("ix", "iy", -1.0))
    slope = F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("_dx"), -F.col("_dy"))) + 360.0, F.lit(360.0))
    return out.withColumn("slope", slope).withColumn("aspect", aspect).drop("_dx", "_dy")


def neighbours(cells: DataFrame, radius: int, values: list[str], keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """(keys, iy, ix, dy, dx, values of the neighbour) for neighbours that exist."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    moved = cells.select(*keys, "iy", "ix", *values).withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    return moved.select(*keys, (F.col("iy") - F.col("dy")).alias("iy"), (F.col("ix") - F.col("dx")).alias("ix"), "dy", "dx", *(F.col(v).alias(f"n_{v}") for v in values))


#: Rows and columns of a tile.
TILE = 64


def in_tiles(cells: DataFrame, radius: int, values: Sequence[str], keys: Sequence[str], out: Sequence[str], run: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]) -> DataFrame:
    """keys, iy, ix and `out` of every cell, by a function of the windows about the cells of one tile.

    A cell goes to its own tile and to those whose halo of `radius` it lies in, so a
    group is a tile with its halo, whatever the scene's size. `run` gets arrays of
    the tile with its halo (NaN where there is nothing) and returns arrays of the tile.
    """
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / TILE), F.floor((F.col(c) + radius) / TILE)))
    rows = cells.select(*keys, "iy", "ix", *(F.col(v).cast("double").alias(v) for v in values)).withColumn("_ty", near("iy")).withColumn("_tx", near("ix"))
    columns = [*keys, "iy", "ix", *out]

    def tile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        iy, ix = group.iy.to_numpy(), group.ix.to_numpy()
        own = (iy // TILE == key[-2]) & (ix // TILE == key[-1])
        if not own.any():
            return pd.DataFrame(columns=columns)
        top, left = iy[own].min() - radius, ix[own].min() - radius  # no more of the tile than has cells
        shape = (iy[own].max() + radius - top + 1, ix[own].max() + radius - left + 1)
        near = (iy >= top) & (iy < top + shape[0]) & (ix >= left) & (ix < left + shape[1])
        arrays = {}
        for v in values:
            arrays[v] = np.full(shape, np.nan)
            arrays[v][iy[near] - top, ix[near] - left] = group[v].to_numpy(float)[near]
        made = run(arrays, radius)
        inner = (iy[own] - top - radius, ix[own] - left - radius)
        return group.loc[own, [*keys, "iy", "ix"]].assign(**{c: made[c][inner] for c in out})

    types = dict(cells.dtypes)
    ddl = ", ".join([f"{c} {types[c]}" for c in (*keys, "iy", "ix")] + [f"{c} double" for c in out])
    made = apart(rows, *keys, "_ty", "_tx").groupBy(*keys, "_ty", "_tx").applyInPandas(tile, ddl)
    return made.select(*keys, "iy", "ix", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in out))


def middle(a: np.ndarray, r: int, dy: int = 0, dx: int = 0) -> tuple[slice, slice]:
    """Where the tile lies in an array with a halo, or where its cells' neighbours at a shift do."""
    return slice(r + dy, a.shape[0] - r + dy), slice(r + dx, a.shape[1] - r + dx)


def shifted(a: np.ndarray, r: int) -> Iterator[tuple[int, int, tuple[slice, slice]]]:
    """Every shift of the window, and where the neighbours at that shift lie."""
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            yield dy, dx, middle(a, r, dy, dx)


def with_limit(cells: DataFrame, column: str, multiplier: float, keys: Sequence[str]) -> DataFrame:
    """Adds _limit: how far similar cells may lie from a centre, in population deviations of the scene."""
    spread = cells.groupBy(*keys).agg((F.stddev_pop(column) * multiplier).alias("_limit"))
    return cells.join(spread, list(keys))


def starfm(cells: DataFrame, *, fine: str = "fine0", coarse0: str = "coarse0", coarse1: str = "coarse1", radius: int = 10, multiplier: float = 2.0, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Fine map at a second date from a fine map and the coarse change (one pair).

    Adds predicted (NULL without support) and support. Similar neighbours differ
    from the centre by at most `multiplier` population deviations of the scene.
    """

    def run(a: dict[str, np.ndarray], r: int) -> dict[str, np.ndarray]:
        f, before, after = a[fine], a[coarse0], a[coarse1]
        known = np.isfinite(f) & np.isfinite(before) & np.isfinite(after)
        value, change = f + after - before, np.abs(after - before) + EPSILON
        centre, limit = f[middle(f, r)], a["_limit"][middle(f, r)]
        total, weights = np.zeros_like(centre), np.zeros_like(centre)
        with np.errstate(invalid="ignore"):
            for dy, dx, at in shifted(f, r):
                apart = np.abs(f[at] - centre)
                w = np.where(known[at] & (apart <= limit), 1.0 / ((apart + EPSILON) * change[at] * (1.0 + np.hypot(dy, dx) / max(r, 1))), 0.0)
                weights += w
                total += np.where(w > 0, w * value[at], 0.0)
            return {"predicted": np.where(weights > 0, total / weights, np.nan)}

    found = in_tiles(with_limit(cells, fine, multiplier, keys), radius, [fine, coarse0, coarse1, "_limit"], keys, ["predicted"], run)
    return cells.join(found, [*keys, "iy", "ix"], "left").withColumn("support", F.col("predicted").isNotNull())


def regressed(x: np.ndarray, y: np.ndarray, c: np.ndarray, limit: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and residual variance of y on x over the similar cells of every window."""
    known = np.isfinite(x) & np.isfinite(y) & np.isfinite(c)
    x0, y0, c0 = (np.where(known, v, 0.0) for v in (x, y, c))
    inner = middle(x, r)
    n, sx, sy, sxx, sxy, syy = (np.zeros_like(c[inner]) for _ in range(6))
    with np.errstate(invalid="ignore", divide="ignore"):
        for _, _, at in shifted(x, r):
            use = (known[at] & (np.abs(c0[at] - c[inner]) <= limit[inner])).astype(float)
            u, v = x0[at] * use, y0[at] * use
            n += use
            sx += u
            sy += v
            sxx += u * x0[at]
            sxy += u * y0[at]
            syy += v * y0[at]
        mx, my = sx / n, sy / n
        var = sxx / n - mx * mx
        ok = (n >= 3) & (var > 1e-9)
        slope = np.where(ok, (sxy / n - mx * my) / var, 1.0)
        intercept = np.where(ok, my - slope * mx, 0.0)
        left = np.where(ok, np.maximum(syy - intercept * sy - slope * sxy, 0.0) / np.maximum(n - 2, 1.0), np.nan)
    return tuple(np.where(n > 0, v, np.nan) for v in (slope, intercept, left))


def local_regression(cells: DataFrame, x: str, y: str, *, radius: int, centre: str, multiplier: float = 2.0, keys: tuple[str, ...] = ("scene",), suffix: str = "") -> DataFrame:
    """slope, intercept and residual variance of y on x in each cell's window of similar cells.

    With fewer than three cells or no variance of x: slope 1, intercept 0, variance NULL.
    """
    names = [f"{c}{suffix}" for c in ("slope", "intercept", "resvar")]
    run = lambda a, r: dict(zip(names, regressed(a[x], a[y], a[centre], a["_limit"], r), strict=True))
    return in_tiles(with_limit(cells, centre, multiplier, keys), radius, list(dict.fromkeys([x, y, centre, "_limit"])), keys, names, run)


def estarfm(cells: DataFrame, *, radius: int = 10, multiplier: float = 2.0, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Fine map between two dates from two pairs: columns fine0, coarse0, fine2, coarse2, coarse1.

    Each pair's coarse change is scaled by its local slope; pairs are weighted by
    the inverse residual variance (1 where there is none). Adds predicted, support.
    """
    made = [f"{c}{k}" for k in "02" for c in ("slope", "intercept", "resvar")]

    def run(a: dict[str, np.ndarray], r: int) -> dict[str, np.ndarray]:
        both = [v for k in "02" for v in regressed(a[f"coarse{k}"], a[f"fine{k}"], a["fine0"], a["_limit"], r)]
        return dict(zip(made, both, strict=True))

    fitted = in_tiles(with_limit(cells, "fine0", multiplier, keys), radius, ["fine0", "coarse0", "fine2", "coarse2", "_limit"], keys, made, run)
    out = cells.join(fitted, [*keys, "iy", "ix"], "left")
    w = {k: F.when(F.col(f"resvar{k}").isNotNull(), F.lit(1.0) / (F.col(f"resvar{k}") + EPSILON)).otherwise(1.0) for k in "02"}
    p = {k: F.col(f"fine{k}") + F.coalesce(F.col(f"slope{k}"), F.lit(1.0)) * (F.col("coarse1") - F.col(f"coarse{k}")) for k in "02"}
    out = out.withColumn("predicted", (w["0"] * p["0"] + w["2"] * p["2"]) / (w["0"] + w["2"]))
    return out.drop(*made).withColumn("support", F.col("predicted").isNotNull())


def semivariogram(cells: DataFrame, value: str, *, max_lag: int = 8, min_pairs: int = 5, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, dy, dx, gamma and pairs: half the mean squared difference at every lag, each pair once.

    Tiles with a halo below and to both sides give sums a lag, which are added up by scene.
    """
    span = lambda c, low: F.explode(F.sequence(F.floor((F.col(c) - low) / TILE), F.floor((F.col(c) + max_lag * (c == "ix")) / TILE)))
    rows = cells.where(F.col(value).isNotNull()).select(*keys, "iy", "ix", F.col(value).cast("double").alias("v")).withColumn("_ty", span("iy", max_lag)).withColumn("_tx", span("ix", max_lag))
    lags = [(dy, dx) for dy in range(max_lag + 1) for dx in range(-max_lag, max_lag + 1) if dy or dx > 0]
    columns = [*keys, "dy", "dx", "ss", "n"]

    def tile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        iy, ix, v = group.iy.to_numpy(), group.ix.to_numpy(), group.v.to_numpy(float)
        own = (iy // TILE == key[-2]) & (ix // TILE == key[-1])
        if not own.any():
            return pd.DataFrame(columns=columns)
        top, left = iy[own].min(), ix[own].min() - max_lag
        height, width = iy[own].max() - top + 1, ix[own].max() - left - max_lag + 1
        near = (iy >= top) & (iy < top + height + max_lag) & (ix >= left) & (ix < left + width + 2 * max_lag)
        grid = np.full((height + max_lag, width + 2 * max_lag), np.nan)
        grid[iy[near] - top, ix[near] - left] = v[near]
        here = np.full_like(grid[:height, max_lag : max_lag + width], np.nan)
        here[iy[own] - top, ix[own] - left - max_lag] = v[own]
        found = []
        for dy, dx in lags:
            d = grid[dy : dy + height, max_lag + dx : max_lag + dx + width] - here
            known = np.isfinite(d)
            if known.any():
                found.append((*key[:-2], dy, dx, float((d[known] ** 2).sum()), int(known.sum())))
        return pd.DataFrame(found, columns=columns)

    types = dict(cells.dtypes)
    sums = apart(rows, *keys, "_ty", "_tx").groupBy(*keys, "_ty", "_tx").applyInPandas(tile, ", ".join([*(f"{k} {types[k]}" for k in keys), "dy int, dx int, ss double, n long"]))
    return sums.groupBy(*keys, "dy", "dx").agg((F.sum("ss") / F.sum("n") / 2).alias("gamma"), F.sum("n").alias("pairs")).where(F.col("pairs") >= min_pairs)
