"""Sharpening coarse temperature with fine predictors, scene by scene.

Linear models are sums by scene (one shuffle of partial sums) and coefficients
joined back, so scenes of any size fit and predict in parallel. Trees, kriging and
weighted regression are in `trees.py`, `kriging.py` and `gwr.py`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binning import block_mean
from .neighbourhood import in_tiles, middle
from .spatial import bilinear_corners, bilinear_up, spread_down


def usable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))


def fit_linear(training: DataFrame, target: str, predictors: Sequence[str], *, keys: Sequence[str] = ("scene",), min_samples: int = 100) -> DataFrame:
    """keys, samples, b0, b1.., residual_std (ddof 1), and lo/hi of each predictor, by least squares.

    One aggregation gives means and covariances of each group; their systems, a row
    a group, are solved in Arrow batches. Groups with too few samples or predictors
    that depend on each other have no row.
    """
    if not predictors:
        raise ValueError("at least one predictor")
    n = len(predictors)
    x, y = [F.col(p).cast("double") for p in predictors], F.col(target).cast("double")
    rows = usable(training, [target, *predictors])
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.avg(y).alias("my"), F.array(*map(F.avg, x)).alias("m"), F.var_pop(y).alias("yy"),
        F.array(*(F.covar_pop(a, b) for a in x for b in x)).alias("xx"), F.array(*(F.covar_pop(a, y) for a in x)).alias("xy"),
        *(f(p).alias(f"{name}{k}") for k, p in enumerate(predictors) for name, f in (("lo", F.min), ("hi", F.max))),
    ).where(F.col("samples") >= min_samples)
    ends = [f"{e}{k}" for k in range(n) for e in ("lo", "hi")]
    kept = [*keys, "samples", "my", "m", "yy", "xy", *ends]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xx, xy = (np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, n, -1) for c in ("xx", "xy"))
            scale = np.sqrt(np.maximum(np.einsum("gii->gi", xx), 0.0))
            outer = scale[:, :, None] * scale[:, None, :]
            sound = (scale > 0).all(1)
            sound[sound] = np.linalg.det(xx[sound] / outer[sound]) > 1e-12
            b = np.zeros((batch.num_rows, n))
            b[sound] = np.linalg.solve(xx[sound], xy[sound])[:, :, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(b.tolist(), pa.list_(pa.float64()))], [*kept, "b"]).filter(pa.array(sound))

    schema = T.StructType([*(sums.schema[c] for c in kept), T.StructField("b", T.ArrayType(T.DoubleType()))])
    out = sums.mapInArrow(solve, schema)
    dot = lambda c: F.aggregate(F.zip_with("b", c, lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
    std = F.sqrt(F.greatest(F.col("yy") - dot("xy"), F.lit(0.0)) * F.col("samples") / (F.col("samples") - 1))
    return out.select(*keys, "samples", (F.col("my") - dot("m")).alias("b0"), *(F.get("b", F.lit(k)).alias(f"b{k + 1}") for k in range(n)), std.alias("residual_std"), *ends)


def predict_linear(fine: DataFrame, model: DataFrame, predictors: Sequence[str], *, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Adds lst_downscaled, uncertainty, support and extrapolation.

    Predictors are held to the training range; a missing one leaves NULL.
    """
    joined = fine.join(model, list(keys)) if keys else fine.crossJoin(F.broadcast(model))
    value, outside = F.col("b0"), F.lit(False)
    for k, p in enumerate(predictors):
        value = value + F.col(f"b{k + 1}") * F.least(F.greatest(F.col(p), F.col(f"lo{k}")), F.col(f"hi{k}"))
        outside = outside | (F.col(p) < F.col(f"lo{k}")) | (F.col(p) > F.col(f"hi{k}"))
    support = reduce(lambda a, b: a & b, (F.col(p).isNotNull() for p in predictors))
    return joined.select(*fine.columns, F.when(support, value).alias("lst_downscaled"), F.when(support, F.col("residual_std")).alias("lst_downscaled_uncertainty"), support.alias("downscaled_support"), F.coalesce(outside & support, F.lit(False)).alias("downscaled_extrapolation"))


def conserve_blocks(predicted: DataFrame, coarse: DataFrame, target: str, factor: int, *, keys: Sequence[str] = ("scene",), value: str = "lst_downscaled") -> DataFrame:
    """Adds the residual of each coarse cell to all of its fine cells: exact conservation.

    lst_downscaled_raw keeps the prediction; cells without a coarse observation are not corrected.
    """
    mean = block_mean(predicted, factor, [value], keys=keys)
    residual = coarse.select(*keys, "iy", "ix", F.col(target).alias("_t")).join(mean, [*keys, "iy", "ix"]).select(*keys, "iy", "ix", (F.col("_t") - F.col(value)).alias("coarse_consistency_correction"))
    out = spread_down(predicted, residual, factor, ["coarse_consistency_correction"], keys).withColumn("coarse_consistency_correction", F.coalesce("coarse_consistency_correction", F.lit(0.0)))
    return out.withColumn(f"{value}_raw", F.col(value)).withColumn(value, F.col(value) + F.col("coarse_consistency_correction"))


def conserve_smooth(predicted: DataFrame, coarse: DataFrame, target: str, factor: int, *, height: int, width: int, iterations: int = 10, value: str = "lst_downscaled") -> DataFrame:
    """Adds bilinearly interpolated residuals, again and again: no steps between coarse cells.

    Height and width are the coarse grid's. Interpolating and averaging over blocks
    are linear, so their product is at most nine weights a coarse cell; rounds run on
    coarse cells alone, and the fine cells are touched twice whatever their number.
    A round reaches one cell further, so a tile with a halo of `iterations` cells has
    the values that the whole scene gives. Cells without an observation add nothing;
    a fine cell next to an absent coarse cell is not corrected.
    """
    base = coarse.select("scene", "iy", "ix", F.col(target).cast("double").alias("t"))
    cells = predicted.where(F.col(value).isNotNull()).select("scene", "iy", "ix")
    corners = bilinear_corners(cells, factor, height, width).join(base.select("scene", F.col("iy").alias("_cy"), F.col("ix").alias("_cx"), F.lit(True).alias("_there")), ["scene", "_cy", "_cx"], "left")
    whole = corners.groupBy("scene", "iy", "ix").agg(F.collect_list(F.struct("_cy", "_cx", "_w")).alias("k"), F.count_if(F.col("_there").isNull()).alias("missing"))  # four corners a cell
    block = [F.expr(f"iy div {factor}").cast("int").alias("iy"), F.expr(f"ix div {factor}").cast("int").alias("ix")]
    means = predicted.groupBy("scene", *block).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    weights = whole.where("missing = 0").select("scene", *block, F.inline("k")).groupBy("scene", "iy", "ix", "_cy", "_cx").agg(F.sum("_w").alias("w"))
    spread = weights.join(means.select("scene", "iy", "ix", "n"), ["scene", "iy", "ix"]).select("scene", "iy", "ix", "_cy", "_cx", (F.col("w") / F.col("n")).alias("w"))
    start = base.join(means, ["scene", "iy", "ix"], "left").select("scene", "iy", "ix", (F.col("t") - F.col("m")).alias("r"))

    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    names = [f"_w{k}" for k in range(len(near))]
    share = [F.sum(F.when((F.col("_cy") - F.col("iy") == dy) & (F.col("_cx") - F.col("ix") == dx), F.col("w"))).alias(c) for (dy, dx), c in zip(near, names, strict=True)]
    cells = start.join(spread.groupBy("scene", "iy", "ix").agg(*share), ["scene", "iy", "ix"], "left")

    def rounds(a: dict[str, np.ndarray], r: int) -> dict[str, np.ndarray]:
        known = np.isfinite(a["r"])
        first, weights = np.where(known, a["r"], 0.0), [np.nan_to_num(a[c]) for c in names]
        total = np.zeros_like(first)
        for _ in range(iterations):
            about = np.pad(total, 1)
            mixed = sum(w * about[1 + dy : 1 + dy + total.shape[0], 1 + dx : 1 + dx + total.shape[1]] for (dy, dx), w in zip(near, weights, strict=True))
            total = total + np.where(known, first - mixed, 0.0)
        return {"_r": total[middle(total, r)]}

    field = in_tiles(cells, iterations, ["r", *names], ["scene"], ["_r"], rounds)
    out = bilinear_up(predicted, field, factor, "_r", height=height, width=width, out="coarse_consistency_correction")
    out = out.withColumn("coarse_consistency_correction", F.coalesce("coarse_consistency_correction", F.lit(0.0)))
    return out.withColumn(f"{value}_raw", F.col(value)).withColumn(value, F.col(value) + F.col("coarse_consistency_correction"))


def homogeneity_weights(fine: DataFrame, predictors: Sequence[str], factor: int, *, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Weight of each coarse cell: inverse mean coefficient of variation of its fine predictors, scaled to 0.05..1.

    Predictors with a mean of about 0 have no coefficient; one of about 0 gives no weight of its own (0.05).
    """
    cv = [F.when(F.abs(F.avg(p)) > 1e-6, F.stddev_pop(p) / F.abs(F.avg(p))) for p in predictors]
    blocks = fine.groupBy(*keys, F.expr(f"iy div {factor}").cast("int").alias("iy"), F.expr(f"ix div {factor}").cast("int").alias("ix")).agg(F.array_compact(F.array(*cv)).alias("_c"))
    mean = F.when(F.size("_c") > 0, F.aggregate("_c", F.lit(0.0), lambda a, c: a + c) / F.size("_c"))
    blocks = blocks.withColumn("_w", F.when(mean > 1e-6, F.lit(1.0) / mean)).drop("_c")
    scene = Window.partitionBy(*keys)
    low, high = F.min("_w").over(scene), F.max("_w").over(scene)  # a row a coarse cell
    held = F.least(F.greatest((F.col("_w") - low) / (high - low), F.lit(0.05)), F.lit(1.0))
    return blocks.select(*keys, "iy", "ix", F.when(high.isNull() | (high <= low), 1.0).when(F.col("_w").isNull(), 0.05).otherwise(held).alias("weight"))


def match_scenes(coarse: DataFrame, fine: DataFrame, *, index: str, max_gap_us: int, min_valid: float = 0.5) -> DataFrame:
    """scene and matched_time: the nearest fine scene with enough valid index values; the earlier on ties."""
    from .temporal import nearest_times

    good = fine.groupBy("scene").agg(F.avg(F.col(index).isNotNull().cast("int")).alias("share")).where(F.col("share") >= min_valid)
    return nearest_times(coarse, good, max_gap_us, tie="earlier").select("scene", "matched_time")


def sharpen_linear(coarse: DataFrame, fine: DataFrame, target: str, predictors: Sequence[str], factor: int, *, min_samples: int = 100, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Fit on coarse means of the fine predictors, predict the fine cells, conserve by block, scene by scene."""
    means = block_mean(fine, factor, predictors, keys=keys)
    training = coarse.select(*keys, "iy", "ix", target).join(means, [*keys, "iy", "ix"])
    model = fit_linear(training, target, predictors, keys=keys, min_samples=min_samples)
    predicted = predict_linear(fine.select(*keys, "iy", "ix", *predictors), model, predictors, keys=keys)
    observed = coarse.where(F.col(target).isNotNull())
    out = conserve_blocks(predicted, observed, target, factor, keys=keys)
    mark = observed.select(*keys, F.col("iy").alias("_cy"), F.col("ix").alias("_cx"), F.lit(True).alias("coarse_observed"))
    out = out.withColumn("_cy", F.expr(f"iy div {factor}").cast("int")).withColumn("_cx", F.expr(f"ix div {factor}").cast("int")).join(mark, [*keys, "_cy", "_cx"], "left").drop("_cy", "_cx")
    return out.withColumn("coarse_observed", F.coalesce("coarse_observed", F.lit(False)))


def sharpen_blocks(fine_thermal: DataFrame, fine: DataFrame, target: str, predictors: Sequence[str], factor: int, **how) -> DataFrame:
    """Sharpen a thermal band sampled finer than it was measured: block means first, with the two-thirds rule."""
    coarse = block_mean(fine_thermal, factor, [target], min_share=2 / 3)
    return sharpen_linear(coarse, fine, target, predictors, factor, **how)


def ensemble_spread(predictions: DataFrame, members: Sequence[str], out: str = "spread") -> DataFrame:
    """Sample deviation over the members' predictions in each row."""
    a = F.array(*(F.col(m) for m in members))
    mean = reduce(lambda x, y: x + y, (F.col(m) for m in members)) / len(members)
    ss = F.aggregate(F.transform(a, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda x, v: x + v)
    return predictions.withColumn(out, F.sqrt(ss / (len(members) - 1)))


def fit_estimator(training: DataFrame, target: str, predictors: Sequence[str], estimator):
    """(fitted Spark ML pipeline, residual deviation with ddof 1) of any regressor with `featuresCol` features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = usable(training, [target, *predictors])
    fitted = Pipeline(stages=[VectorAssembler(inputCols=list(predictors), outputCol="features"), estimator.setLabelCol(target)]).fit(rows)
    return fitted, fitted.transform(rows).agg(F.stddev_samp(F.col(target) - F.col("prediction"))).first()[0]
