"""Geographically weighted regression on any number of predictors, as moments and joins.

Training rows of one location are reduced to their moments first. A cell meets the
locations in reach (or its k nearest), the weighted moments are summed by cell, and
small systems are solved in Arrow batches. The leave-one-out fit at a location is
the same join without that location.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .downscale import usable
from .spatial import around, nearest_sites


def moments(training: DataFrame, target: str, predictors: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """keys, sx, sy (location), n and the sums of products of (1, predictors, target); and those sums' names."""
    terms = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors)]
    y = F.col(target).cast("double")
    sums = {f"m{i}_{j}": F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))} | {f"r{i}": F.sum(t * y) for i, t in enumerate(terms)}
    rows = usable(training, [target, *predictors]).groupBy(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"))
    return rows.agg(F.count("*").alias("n"), *(s.alias(c) for c, s in sums.items())), list(sums)


def solved(sums: DataFrame, keep: Sequence[str], p: int) -> DataFrame:
    """`keep` columns with b0..bp; NULL where the system is singular."""
    names = [f"b{i}" for i in range(p + 1)]
    types = dict(sums.dtypes)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            a = np.zeros((batch.num_rows, p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    a[:, i, j] = a[:, j, i] = column(f"m{i}_{j}")
            r = np.stack([column(f"r{i}") for i in range(p + 1)], 1)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            sound = np.abs(np.linalg.det(a / scale[:, :, None] / scale[:, None, :])) > 1e-12
            b = np.full((batch.num_rows, p + 1), np.nan)
            if sound.any():
                b[sound] = np.linalg.solve(a[sound], r[sound][:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(b[:, i], pa.float64(), mask=~sound) for i in range(p + 1))], [*keep, *names])

    return sums.mapInArrow(solve, ", ".join([f"{c} {types[c]}" for c in keep] + [f"{c} double" for c in names]))


def gwr(cells: DataFrame, training: DataFrame, target: str, predictors: Sequence[str], *, bandwidth: float, k: int = 200, min_local: int = 10, kernel: str = "bisquare", keys: Sequence[str] = (), apart: bool = False) -> DataFrame:
    """keys, iy, ix, b0.., local_samples of every cell with at least `min_local` samples near.

    Cells and training have x, y. At most the `k` nearest locations count, with all
    their rows; beyond the bandwidth the bisquare weight is zero, the gaussian
    kernel has no end. `apart` leaves out the location at the cell's own place.
    """
    sites, sums = moments(training, target, predictors, keys)
    by = [*keys, "iy", "ix"]
    if kernel == "bisquare":
        near = around(cells.select(*by, "x", "y"), sites, bandwidth, keys=keys).where(F.col("d2") < bandwidth * bandwidth)
    else:
        near = nearest_sites(cells.select(*by, "x", "y"), sites, "x", "y", k + apart, cell_keys=by, site_key=("sx", "sy"), keys=keys).withColumn("d2", F.col("distance") * F.col("distance"))
    if apart:
        near = near.where((F.col("x") != F.col("sx")) | (F.col("y") != F.col("sy")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("d2", "sx", "sy"))
    near = near.withColumn("_k", rank).where(F.col("_k") <= k)
    share = F.col("d2") / (bandwidth * bandwidth)
    w = (F.lit(1.0) - share) * (F.lit(1.0) - share) if kernel == "bisquare" else F.exp(share * -0.5)
    fitted = near.groupBy(*by).agg(F.sum("n").alias("local_samples"), *(F.sum(w * F.col(c)).alias(c) for c in sums)).where(F.col("local_samples") >= min_local)
    return solved(fitted, [*by, "local_samples"], len(predictors))


def at(model: DataFrame, predictors: Sequence[str]):
    value = F.col("b0")
    for i, p in enumerate(predictors):
        value = value + F.col(f"b{i + 1}") * F.col(p)
    return value


def left_out_residuals(training: DataFrame, target: str, predictors: Sequence[str], *, keys: Sequence[str] = (), **how) -> DataFrame:
    """keys, iy, ix, residual of every training row against the fit without its location."""
    rows = usable(training, [target, *predictors])
    sites = rows.select(*keys, "iy", "ix", "x", "y").distinct()
    model = gwr(sites, training, target, predictors, keys=keys, apart=True, **how)
    joined = rows.select(*keys, "iy", "ix", target, *predictors).join(model, [*keys, "iy", "ix"])
    return joined.select(*keys, "iy", "ix", (F.col(target) - at(joined, predictors)).alias("residual")).where("residual is not null")


def predict_gwr(fine: DataFrame, training: DataFrame, target: str, predictors: Sequence[str], *, keys: Sequence[str] = ("scene",), **how) -> DataFrame:
    """keys, iy, ix, lst_downscaled, its uncertainty (the deviation of leave-one-out residuals), support and extrapolation.

    `fine` and `training` have x, y on one scale; cells without a fit or a predictor
    are NULL. Predictors are held to the range of the training rows, as local fits
    are linear too; cells where that matters are marked.
    """
    by = [*keys, "iy", "ix"]
    model = gwr(fine, training, target, predictors, keys=keys, **how)
    residuals = left_out_residuals(training, target, predictors, keys=keys, **how)
    ends = [f(F.col(p)).alias(f"_{name}{i}") for i, p in enumerate(predictors) for name, f in (("lo", F.min), ("hi", F.max))]
    by_group = lambda df, *aggs: df.groupBy(*keys).agg(*aggs)
    ranges = by_group(usable(training, [target, *predictors]), *ends)
    deviation = by_group(residuals, F.stddev_samp("residual").alias("_sd"))
    out = fine.select(*by, *predictors).join(model, by, "left")
    for group in (ranges, deviation):  # a row a group, or one row
        out = out.join(group, list(keys), "left") if keys else out.crossJoin(F.broadcast(group))
    value, outside = F.col("b0"), F.lit(False)
    for i, p in enumerate(predictors):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        value = value + F.col(f"b{i + 1}") * F.least(F.greatest(F.col(p), low), high)
        outside = outside | (F.col(p) < low) | (F.col(p) > high)
    for p in predictors:
        value = F.when(F.col(p).isNotNull(), value)
    support = value.isNotNull()
    return out.select(*by, value.alias("lst_downscaled"), F.when(support, F.col("_sd")).alias("lst_downscaled_uncertainty"), support.alias("downscaled_support"), F.coalesce(outside & support, F.lit(False)).alias("downscaled_extrapolation"))
