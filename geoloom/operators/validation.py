"""Metrics against a reference, holdout splits and conformal quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles


def metric_columns(estimate: Column, reference: Column) -> list[Column]:
    """samples, bias, mae, rmse and correlation (NULL for one sample or no variance) as aggregates."""
    e = estimate - reference
    both = e.isNotNull()
    a, b = F.when(both, estimate), F.when(both, reference)
    varied = (F.count(e) > 1) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return [F.count(e).alias("samples"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(varied, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).alias("correlation")]


def compare(joined: DataFrame, estimate: str, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of two columns, overall or by keys."""
    return joined.groupBy(*keys).agg(*metric_columns(F.col(estimate), F.col(reference)))


def compare_cubes(estimate: DataFrame, reference: DataFrame, value: str, keys: Sequence[str] = ("scene", "iy", "ix")) -> DataFrame:
    """Metrics of two cubes over the cells and scenes both have."""
    return compare(estimate.select(*keys, F.col(value).alias("_e")).join(reference.select(*keys, F.col(value).alias("_r")), list(keys)), "_e", "_r")


def downscaling_report(joined: DataFrame, *, estimate: str, reference: str, uncertainty: str | None = None, extrapolated: str | None = None) -> DataFrame:
    """Metrics with the share of extrapolated cells, and coverage and width of one-deviation intervals."""
    e = F.abs(F.col(estimate) - F.col(reference))
    more = []
    if extrapolated:
        more.append(F.avg(F.coalesce(F.col(extrapolated), F.lit(False)).cast("int")).alias("extrapolation_fraction"))
    if uncertainty:
        more += [F.avg((e <= F.col(uncertainty)).cast("int")).alias("interval_coverage"), F.avg(F.col(uncertainty) * 2).alias("interval_width")]
    return joined.agg(*metric_columns(F.col(estimate), F.col(reference)), *more)


def blocked_split(cube: DataFrame, *, validation_fraction: float = 0.2, period: int = 5, block: int = 1) -> DataFrame:
    """Adds train, validation and calibration.

    Scenes are split in time order; blocks of cells with (iy/block + ix/block) a
    multiple of the period are held. Train: early and not held; validation: late
    and held; calibration: early and held.
    """
    if not 0 < validation_fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    scenes = cube.select("scene").distinct()
    ranked = scenes.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("scene")) - 1)  # a row a scene
    total = scenes.agg(F.greatest(F.lit(1), F.floor(F.count("*") * (1 - validation_fraction) + 1e-9)).alias("_cut"))
    late = ranked.crossJoin(F.broadcast(total)).select("scene", (F.col("_k") >= F.col("_cut")).alias("_late"))
    held = (F.expr(f"iy div {block}") + F.expr(f"ix div {block}")) % period == 0
    out = cube.join(late, "scene").withColumn("_held", held)
    return out.withColumns({"train": ~F.col("_late") & ~F.col("_held"), "validation": F.col("_late") & F.col("_held"), "calibration": ~F.col("_late") & F.col("_held")}).drop("_late", "_held")


def conformal_quantile(scores: DataFrame, score: str, *, alpha: float = 0.1) -> DataFrame:
    """The ceil((n-1) q) + 1 smallest score, q = min(1, ceil((n+1)(1-alpha)) / n): one row."""
    n = scores.where(F.col(score).isNotNull()).count()
    if not n:
        raise ValueError("no scores")
    q = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    found = percentiles(scores, score, {"quantile": (q, "higher")})
    return found.select("quantile", F.col("_n").alias("samples"), F.lit(q).alias("level"))


@dataclass(frozen=True)
class Conformal:
    """A calibrated half-width, in units of the spread if there is one."""

    quantile: float
    samples: int
    alpha: float
    spread_floor: float | None = None


def fit_conformal(calibration: DataFrame, estimate: str, reference: str, *, spread: str | None = None, alpha: float = 0.1, min_samples: int = 30) -> Conformal:
    """Split-conformal calibration on rows that the model was not trained on.

    With `spread`, scores are errors over the spread, held to at least its 5th percentile.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    floor = None
    score = F.abs(F.col(estimate) - F.col(reference))
    if spread:
        low = percentiles(calibration, spread, {"low": 0.05}).first()
        floor = max(low["low"] if low else 0.0, 1e-6)
        score = score / F.greatest(F.col(spread), F.lit(floor))
    found = conformal_quantile(calibration.select(score.alias("s")), "s", alpha=alpha).first()
    if found["samples"] < min_samples:
        raise ValueError(f"{found['samples']} calibration samples; {min_samples} are needed")
    return Conformal(found["quantile"], found["samples"], alpha, floor)


def conformal_interval(predicted: DataFrame, model: Conformal, estimate: str, *, spread: str | None = None) -> DataFrame:
    """Adds <estimate>_lower, _upper and _uncertainty (the half-width)."""
    half = F.lit(model.quantile) if model.spread_floor is None else F.lit(model.quantile) * F.greatest(F.col(spread), F.lit(model.spread_floor))
    half = F.when(F.col(estimate).isNotNull(), half)
    return predicted.withColumns({f"{estimate}_uncertainty": half, f"{estimate}_lower": F.col(estimate) - half, f"{estimate}_upper": F.col(estimate) + half})
