"""Area-to-point kriging of coarse residuals, as joins and aggregates.

The semivariogram of the residuals is a self-join of coarse cells. For each of a
fixed set of ranges, the exponential covariance averaged over pairs of cells gives
the variogram that such residuals would show; a weighted least-squares fit of each
to the lags is closed sums by scene, and the best range wins. A coarse cell then
meets the observed neighbours of its window; the kriging systems, one for each
range and pattern of neighbours in a batch, give its values at sub-cell positions,
which fine cells take by an equi-join. No step holds a whole scene.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binning import block_mean
from .downscale import conserve_blocks, fit_linear, predict_linear
from .neighbourhood import neighbours, semivariogram

#: Points a side that stand for a cell, radius of the kriging window, positions a side in a cell, largest lag.
POINTS, RADIUS, POSITIONS, MAX_LAG = 5, 2, 16, 8
#: Ranges that are tried, in coarse cells: evenly spaced in the logarithm.
RANGES = tuple(np.geomspace(0.25, 30.0, 48).tolist())
#: Residuals, lags and pairs a lag that a fit needs, variance below which there is nothing to spread.
LEAST_CELLS, LEAST_LAGS, LEAST_PAIRS, FLAT = 10, 3, 5, 1e-12


def centres(n: int) -> np.ndarray:
    """Places along one side of a cell, from its middle: the middles of n equal parts."""
    return (np.arange(n) - (n - 1) / 2) / n


@lru_cache(maxsize=256)
def cell_covariances(reach: float, span: int) -> np.ndarray:
    """Covariance of two cells by their shift (0..span in each direction): the mean over their points.

    Along a side the parts of two cells lie k parts apart in POINTS - |k| ways, so
    the mean over all pairs of points is one over pairs of such distances.
    """
    k = np.arange(1 - POINTS, POINTS)
    ways = (POINTS - np.abs(k)) / POINTS**2
    along = np.arange(span + 1)[:, None] + k / POINTS
    apart = np.hypot(along[:, None, :, None], along[None, :, None, :])
    return np.einsum("yxab,a,b->yx", np.exp(-apart / reach), ways, ways)


def variogram_shapes(spark: SparkSession, max_lag: int = MAX_LAG) -> DataFrame:
    """reach, dy, dx, shape: the semivariogram of a unit sill at every lag, for every range tried."""
    rows = []
    for reach in RANGES:
        c = cell_covariances(reach, max_lag)
        rows += [(reach, dy, dx, float(c[0, 0] - c[dy, abs(dx)])) for dy in range(max_lag + 1) for dx in range(-max_lag, max_lag + 1) if dy or dx > 0]
    return spark.createDataFrame(rows, "reach double, dy int, dx int, shape double")


def fit_ranges(residuals: DataFrame, value: str, shape: tuple[int, int]) -> DataFrame:
    """scene, reach and sill of scenes whose residuals a covariance fits; `shape` bounds the lags."""
    most = max(1, min(MAX_LAG, max(shape) // 2))
    enough = residuals.groupBy("scene").agg(F.count(value).alias("n"), F.var_pop(value).alias("v")).where((F.col("n") >= LEAST_CELLS) & (F.col("v") > FLAT)).select("scene")
    lags = semivariogram(residuals, value, max_lag=most, min_pairs=LEAST_PAIRS).where(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= most * most)
    w, g, s = F.col("pairs").cast("double"), F.col("gamma"), F.col("shape")
    sums = lags.join(enough, "scene").join(variogram_shapes(residuals.sparkSession, most), ["dy", "dx"]).groupBy("scene", "reach").agg(F.count("*").alias("lags"), F.sum(w * s * g).alias("sg"), F.sum(w * s * s).alias("ss"), F.sum(w * g * g).alias("gg"))
    sums = sums.where((F.col("lags") >= LEAST_LAGS) & (F.col("ss") > 0) & (F.col("sg") > 0)).withColumn("sill", F.col("sg") / F.col("ss"))
    error = F.col("gg") - F.col("sill") * F.col("sg")
    return sums.groupBy("scene").agg(F.min_by(F.struct("reach", "sill"), F.struct(error, "reach")).alias("best")).select("scene", "best.reach", "best.sill")


def spread_weights(reach: float, seen: tuple[int, ...], positions: int) -> np.ndarray:
    """Weights (positions² x observed cells of the window) of simple kriging from cells to points."""
    side = 2 * RADIUS + 1
    shifts = np.array([divmod(k, side) for k in seen]) - RADIUS
    c = cell_covariances(reach, 2 * RADIUS)
    between = c[np.abs(shifts[:, None, 0] - shifts[None, :, 0]), np.abs(shifts[:, None, 1] - shifts[None, :, 1])]
    # by position and part of each cell seen, first along one side, then along the other
    along = centres(positions)[:, None, None] - (shifts.T[:, None, :, None] + centres(POINTS))
    apart = np.hypot(along[0][:, None, :, :, None], along[1][None, :, :, None, :])
    to_points = np.exp(-apart / reach).mean((3, 4)).reshape(positions**2, len(seen))
    lower = np.linalg.cholesky(between + 1e-10 * np.eye(len(seen)))
    return np.linalg.solve(lower.T, np.linalg.solve(lower, to_points.T)).T


def kriged(residuals: DataFrame, value: str, factor: int, shape: tuple[int, int]) -> DataFrame:
    """scene, iy, ix (coarse) and field: kriged values at positions² places of every coarse cell near an observation.

    Sills cancel in the weights. Scenes without a fitted range have no rows.
    """
    positions = min(POSITIONS, factor)
    kind = dict(residuals.dtypes)["scene"]
    known = residuals.where(F.col(value).isNotNull())
    side = 2 * RADIUS + 1
    around = neighbours(known, RADIUS, [value]).where(F.col("iy").between(0, shape[0] - 1) & F.col("ix").between(0, shape[1] - 1))
    place = (F.col("dy") + RADIUS) * side + F.col("dx") + RADIUS
    windows = around.groupBy("scene", "iy", "ix").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.col(f"n_{value}").alias("v")))).alias("seen"))  # 25 at most
    rows = windows.join(fit_ranges(residuals, value, shape), "scene").select("scene", "iy", "ix", "reach", F.col("seen.k").alias("k"), F.col("seen.v").alias("v"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = lru_cache(maxsize=4096)(spread_weights)
        for batch in batches:
            fields = [(solved(reach, tuple(k), positions) @ np.array(v)).tolist() for reach, k, v in zip(*(batch.column(c).to_pylist() for c in ("reach", "k", "v")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scene", "iy", "ix")), pa.array(fields, pa.list_(pa.float64()))], ["scene", "iy", "ix", "field"])

    return rows.mapInArrow(solve, f"scene {kind}, iy int, ix int, field array<double>")


def at_fine_cells(cells: DataFrame, field: DataFrame, factor: int, out: str) -> DataFrame:
    """Adds the kriged value at each fine cell's position in its coarse cell; 0 where there is none."""
    positions = min(POSITIONS, factor)
    slot = lambda c: F.floor((F.pmod(F.col(c), F.lit(factor)) + 0.5) / factor * positions).cast("int")
    by = cells.withColumn("_cy", F.expr(f"iy div {factor}").cast("int")).withColumn("_cx", F.expr(f"ix div {factor}").cast("int"))
    near = by.join(field.withColumnsRenamed({"iy": "_cy", "ix": "_cx"}), ["scene", "_cy", "_cx"], "left")
    return near.withColumn(out, F.coalesce(F.get("field", slot("iy") * positions + slot("ix")), F.lit(0.0))).drop("_cy", "_cx", "field")


def conserve_kriged(predicted: DataFrame, coarse: DataFrame, target: str, factor: int, shape: tuple[int, int], value: str = "lst_downscaled") -> DataFrame:
    """scene, iy, ix, value and coarse_consistency_correction: kriged residuals, then an exact fix of each observed coarse cell.

    A scene whose residuals fit no covariance gets the block correction alone.
    """
    cells = predicted.select("scene", "iy", "ix", value)
    means = block_mean(cells, factor, [value])
    residuals = coarse.select("scene", "iy", "ix", F.col(target).alias("_t")).join(means, ["scene", "iy", "ix"]).select("scene", "iy", "ix", (F.col("_t") - F.col(value)).alias("r"))
    spread = at_fine_cells(cells, kriged(residuals, "r", factor, shape), factor, "_field")
    fixed = conserve_blocks(spread.withColumn(value, F.col(value) + F.col("_field")), coarse, target, factor, value=value)
    return fixed.select("scene", "iy", "ix", value, (F.col("coarse_consistency_correction") + F.col("_field")).alias("coarse_consistency_correction"))


def sharpen_thermal(fine_thermal: DataFrame, fine: DataFrame, target: str, predictors: Sequence[str], factor: int, shape: tuple[int, int], *, min_samples: int = 100) -> DataFrame:
    """A thermal band sampled finer than it was measured, sharpened: block means with the two-thirds rule, a linear fit, kriged residuals."""
    observed = block_mean(fine_thermal, factor, [target], min_share=2 / 3)
    means = block_mean(fine, factor, predictors)
    training = observed.select("scene", "iy", "ix", target).join(means, ["scene", "iy", "ix"])
    model = fit_linear(training, target, predictors, min_samples=min_samples)
    raw = predict_linear(fine.select("scene", "iy", "ix", *predictors), model, predictors)
    return conserve_kriged(raw, observed.where(F.col(target).isNotNull()), target, factor, shape)
