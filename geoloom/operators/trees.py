"""Linear-leaf trees for each scene, in moving windows and over the whole scene (other ensembles: `forests`).

A model is a row of arrays, not an object: one DataFrame row for each (scene,
window) ensemble. Training groups are the coarse cells of one window or scene,
which membership in overlapping windows, a join by derived keys, makes; fine cells
meet their models in groups of one window, so no task holds a whole fine scene.
Trees are flat arrays grown split by split where the squared error falls most;
every sum a split or a leaf needs comes from running moments of sorted columns.

Scenes with fewer complete cells than `min_samples` have no model and no rows;
fine cells with a missing predictor stay, with NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import radiance_blend
from .quantiles import cut
from .spatial import apart, bilinear_up

WHOLE = -1  #: window number of a scene's own ensemble


@dataclass(frozen=True)
class Shape:
    """How an ensemble grows. Leaves hold a ridge regression if `linear`, else a mean."""

    members: int = 20
    leaves: int = 30
    depth: int = 64
    least: int = 10  #: samples in a leaf
    linear: bool = True
    slack: float = 0.25  #: a linear leaf may leave its range by this share of it
    penalty: float = 1.0
    seed: int = 42


SCENE_TREES, WINDOW_TREES = Shape(), Shape(leaves=10)


@dataclass
class Tree:
    """Flat arrays by node; `feature` is -1 in leaves. Leaf values are b0 + b . x held to low..high."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  #: the low side; the high side is the next
    slope: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = self.child[node] + (x[inner, self.feature[node]] > self.cut[node])
        b = self.slope[at]
        return np.clip(b[:, 0] + (x * b[:, 1:]).sum(1), self.low[at], self.high[at])


def split_gain(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int) -> tuple[float, int, float]:
    """(fall of the squared error, feature, cut) of the best split of one node; a fall of 0 if there is none."""
    n = len(y)
    if n < 2 * least:
        return 0.0, 0, 0.0
    order = np.argsort(x, axis=0, kind="stable")
    xs = np.take_along_axis(x, order, 0)
    weight, moment = np.cumsum(w[order], 0), np.cumsum((w * y)[order], 0)
    left_w, left_m, all_w, all_m = weight[:-1], moment[:-1], weight[-1], moment[-1]
    here = (xs[1:] > xs[:-1]) & (left_w > 0) & (all_w > left_w)
    here[: least - 1] = False
    here[n - least :] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = np.where(here, left_m**2 / left_w + (all_m - left_m) ** 2 / (all_w - left_w) - all_m**2 / all_w, 0.0)
    place, feature = np.unravel_index(np.argmax(fall), fall.shape)
    below, above = xs[place, feature], xs[place + 1, feature]
    middle = below + (above - below) / 2
    return float(fall[place, feature]), int(feature), float(middle if middle < above else below)


def leaf_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, shape: Shape) -> tuple[np.ndarray, float, float]:
    """Coefficients and range of a leaf, by the moments of (1, x, y); the intercept carries no penalty."""
    p = x.shape[1]
    w = w if w.sum() > 0 else np.ones_like(w)
    b = np.zeros(p + 1)
    mean = float((w * y).sum() / w.sum())
    b[0] = mean
    if shape.linear and len(y) > p + 1:
        rows = np.column_stack([np.ones(len(y)), x, y])
        m = (rows * w[:, None]).T @ rows
        b = np.linalg.solve(m[:-1, :-1] + shape.penalty * np.diag([0.0] + [1.0] * p), m[:-1, -1])
        room = shape.slack * (y.max() - y.min())
        return b, float(y.min() - room), float(y.max() + room)
    return b, mean, mean


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, shape: Shape) -> Tree:
    """One tree: the open node whose split lowers the error most is split next."""
    least = min(shape.least, max(1, len(y) // 4))
    rows, depth, feature, cut, child = [np.arange(len(y))], [0], [-1], [0.0], [0]
    best = [split_gain(x, y, w, least)]
    gains = np.zeros(2 * min(shape.leaves, len(y)) + 1)  # of open nodes
    gains[0] = best[0][0]
    while (len(rows) + 1) // 2 < min(shape.leaves, len(y)):
        node = int(np.argmax(gains))
        if gains[node] <= 1e-12:
            break
        _, feature[node], cut[node] = best[node]
        child[node], gains[node] = len(rows), 0.0
        low = x[rows[node], feature[node]] <= cut[node]
        for side in (rows[node][low], rows[node][~low]):
            deep = depth[node] + 1 >= shape.depth
            best.append((0.0, 0, 0.0) if deep else split_gain(x[side], y[side], w[side], least))
            gains[len(rows)] = best[-1][0]
            rows.append(side)
            depth.append(depth[node] + 1)
            feature.append(-1)
            cut.append(0.0)
            child.append(0)
    fits = [leaf_fit(x[r], y[r], w[r], shape) if f < 0 else (np.zeros(x.shape[1] + 1), 0.0, 0.0) for r, f in zip(rows, feature, strict=True)]
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array([b for b, _, _ in fits]), np.array([a for _, a, _ in fits]), np.array([c for _, _, c in fits]))


@dataclass
class Ensemble:
    """Mean of bootstrapped trees."""

    trees: list[Tree]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sum((t(x) for t in self.trees), np.zeros(len(x))) / len(self.trees)

    def columns(self) -> list[list]:
        """The trees as arrays of numbers: how many nodes each has, and the nodes of all, one after the other."""
        joined = [np.concatenate([getattr(t, f) for t in self.trees]).ravel().tolist() for f in ("feature", "cut", "child", "slope", "low", "high")]
        return [[len(t.cut) for t in self.trees], *joined]

    @classmethod
    def of(cls, sizes, feature, cut, child, slope, low, high) -> Ensemble:
        ends = np.cumsum(sizes)[:-1]
        parts = [np.split(np.asarray(c), ends) for c in (feature, cut, child, np.asarray(slope).reshape(len(cut), -1), low, high)]
        return cls([Tree(*nodes) for nodes in zip(*parts, strict=True)])


def fit_ensemble(x: np.ndarray, y: np.ndarray, w: np.ndarray, shape: Shape) -> Ensemble:
    trees = []
    for member in range(shape.members):
        drawn = np.random.default_rng([shape.seed, member]).integers(0, len(y), len(y))
        trees.append(grow(x[drawn], y[drawn], w[drawn], shape))
    return Ensemble(trees)


#: An ensemble's columns (see `Ensemble.columns`).
NODES = ("sizes", "feature", "cut", "child", "slope", "low", "high")
NODE_TYPES = "sizes array<int>, feature array<int>, cut array<double>, child array<int>, slope array<double>, low array<double>, high array<double>"


def memberships(training: DataFrame, window: int, overlap: float) -> DataFrame:
    """Coarse cells with every window (wy, wx) they train, their own among them (`inside`), and the scene's (-1)."""
    more = max(1, round(window * overlap))
    near = lambda c: F.sequence(F.expr(f"(({c} - {more}) - pmod({c} - {more}, {window})) div {window}"), F.expr(f"({c} + {more}) div {window}"))
    tiles = training.withColumn("wy", F.explode(near("iy"))).withColumn("wx", F.explode(near("ix"))).where("wy >= 0 and wx >= 0")
    inside = (F.expr(f"iy div {window}") == F.col("wy")) & (F.expr(f"ix div {window}") == F.col("wx"))
    whole = training.withColumns({"wy": F.lit(WHOLE).cast("long"), "wx": F.lit(WHOLE).cast("long"), "inside": F.lit(True)})
    return tiles.withColumns({"wy": F.col("wy").cast("long"), "wx": F.col("wx").cast("long"), "inside": inside}).unionByName(whole)


def fit_groups(rows: DataFrame, target: str, names: Sequence[str], least: int, scene_least: int, local: Shape, whole: Shape) -> DataFrame:
    """scene, wy, wx, an ensemble's nodes, deviation, and for the group's own cells their absolute errors: a row a group."""
    kind = dict(rows.dtypes)["scene"]

    def fit(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        own = key[1] == WHOLE
        columns = ["scene", "wy", "wx", *NODES, "deviation", "iys", "ixs", "errors"]
        if len(cells) < (scene_least if own else least):
            return pd.DataFrame(columns=columns)
        cells = cells.sort_values(["iy", "ix"])
        x, y, w = cells[list(names)].to_numpy(float), cells[target].to_numpy(float), cells["weight"].to_numpy(float)
        ensemble = fit_ensemble(x, y, w, whole if own else local)
        left = y - ensemble(x)
        mine = cells["inside"].to_numpy(bool)
        return pd.DataFrame([(key[0], key[1], key[2], *ensemble.columns(), float(left.std()), cells.iy[mine].tolist(), cells.ix[mine].tolist(), np.abs(left[mine]).tolist())], columns=columns)

    return apart(rows, "scene", "wy", "wx").groupBy("scene", "wy", "wx").applyInPandas(fit, f"scene {kind}, wy long, wx long, {NODE_TYPES}, deviation double, iys array<int>, ixs array<int>, errors array<double>")


def complete(training: DataFrame, target: str, names: Sequence[str], weights: DataFrame | None) -> DataFrame:
    """Training rows without gaps, and their weight (1, or from a table by coarse cell; a cell absent there has 1)."""
    rows = training.select("scene", "iy", "ix", target, *names).dropna()
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    return rows.join(weights.select("scene", "iy", "ix", F.col("weight").cast("double").alias("weight")), ["scene", "iy", "ix"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def predicted(fine: DataFrame, models: DataFrame, names: Sequence[str], side: int) -> DataFrame:
    """scene, iy, ix, local, overall and deviation of fine cells, a window of `side` fine cells a task's group."""
    kind = dict(fine.dtypes)["scene"]
    cells = fine.select("scene", "iy", "ix", *names, F.expr(f"iy div {side}").cast("long").alias("wy"), F.expr(f"ix div {side}").cast("long").alias("wx"))
    whole = models.where(f"wy = {WHOLE}").select("scene", *NODES, "deviation", F.lit(True).alias("whole"))
    asked = cells.select("scene", "wy", "wx").distinct().join(whole, "scene")
    both = asked.unionByName(models.where(f"wy <> {WHOLE}").select("scene", "wy", "wx", *NODES, "deviation", F.lit(False).alias("whole")))
    both = both.toDF(*both.columns)  # columns of its own, for the cogroup

    def predict(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = own[["scene", "iy", "ix"]].copy()
        if not len(own) or not known["whole"].any():
            return out.iloc[:0].assign(local=0.0, overall=0.0, deviation=0.0)
        x = own[list(names)].to_numpy(float)
        sound = ~np.isnan(x).any(1)
        for name, rows in (("overall", known[known.whole]), ("local", known[~known.whole])):
            values = np.full(len(own), np.nan)
            if len(rows):
                values[sound] = Ensemble.of(*(rows[c].iloc[0] for c in NODES))(x[sound])
            out[name] = values
        return out.assign(deviation=np.where(sound, known[known.whole].deviation.iloc[0], np.nan))[["scene", "iy", "ix", "local", "overall", "deviation"]]

    keys = ["scene", "wy", "wx"]
    found = apart(cells, *keys).groupBy(*keys).cogroup(apart(both, *keys).groupBy(*keys)).applyInPandas(predict, f"scene {kind}, iy int, ix int, local double, overall double, deviation double")
    return found.select("scene", "iy", "ix", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("local", "overall", "deviation")))


def trusted(models: DataFrame, window: int) -> DataFrame:
    """scene, iy, ix, trust of coarse cells: the inverse squared error of the window's model against the scene's.

    Cells of a window that were not trained take the mean of those that were;
    windows without a model, or without a cell of their own, have no trust.
    """
    errors = models.select("scene", "wy", "wx", F.explode(F.arrays_zip("iys", "ixs", "errors")).alias("e")).select("scene", "wy", "wx", F.col("e.iys").alias("iy"), F.col("e.ixs").alias("ix"), F.greatest("e.errors", F.lit(1e-6)).alias("e"))
    whole = errors.where(f"wy = {WHOLE}").select("scene", "iy", "ix", F.col("e").alias("scene_e"))
    inverse = lambda c: F.lit(1.0) / (F.col(c) * F.col(c))
    each = errors.where(f"wy <> {WHOLE}").join(whole, ["scene", "iy", "ix"]).select("scene", "wy", "wx", "iy", "ix", (inverse("e") / (inverse("e") + inverse("scene_e"))).alias("own"))
    means = each.groupBy("scene", "wy", "wx").agg(F.avg("own").alias("mean"))
    steps = F.sequence(F.lit(0), F.lit(window - 1))
    grid = means.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).select("scene", (F.col("wy") * window + F.col("dy")).cast("int").alias("iy"), (F.col("wx") * window + F.col("dx")).cast("int").alias("ix"), "mean")
    return grid.join(each.select("scene", "iy", "ix", "own"), ["scene", "iy", "ix"], "left").select("scene", "iy", "ix", F.coalesce("own", "mean").alias("trust"))


def local_trees(training: DataFrame, fine: DataFrame, target: str, predictors: Sequence[str], factor: int, shape: tuple[int, int], *, window: int = 10, overlap: float = 0.25, min_window: int = 10, min_samples: int = 30, members: int = 20, weights: DataFrame | None = None, kelvin_offset: float | None = None) -> DataFrame:
    """scene, iy, ix, lst_downscaled, lst_downscaled_uncertainty by trees of moving windows and of the whole scene.

    Predictions are blended by trust, interpolated between coarse centres, by
    radiance if `kelvin_offset` tells the unit. `weights` (scene, iy, ix, weight),
    as of `downscale.homogeneity_weights`, weigh the coarse cells.
    """
    rows = memberships(complete(training, target, predictors, weights), window, overlap)
    local, whole = (replace(s, members=members) for s in (WINDOW_TREES, SCENE_TREES))
    models = fit_groups(rows, target, predictors, min_window, min_samples, local, whole)
    models = cut(models)  # trees are read three times
    scenes = models.where(f"wy = {WHOLE}").select("scene")
    found = predicted(fine.join(scenes, "scene", "left_semi"), models, predictors, window * factor)
    height, width = shape
    grid = found.select("scene").distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    trust = grid.join(trusted(models, window), ["scene", "iy", "ix"], "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
    blended = bilinear_up(found, trust, factor, "trust", height=height, width=width)
    value = radiance_blend(F.coalesce("trust", F.lit(0.0)), F.col("local"), F.col("overall"), kelvin_offset)
    return blended.select("scene", "iy", "ix", value.alias("lst_downscaled"), F.col("deviation").alias("lst_downscaled_uncertainty"))


def skipped_scenes(training: DataFrame, target: str, predictors: Sequence[str], min_samples: int = 30) -> DataFrame:
    """scene, samples and reason of scenes that get no model."""
    sound = F.col(target).isNotNull()
    for p in predictors:
        sound = sound & F.col(p).isNotNull()
    counts = training.groupBy("scene").agg(F.count_if(sound).alias("samples"))
    return counts.where(F.col("samples") < min_samples).withColumn("reason", F.concat(F.col("samples").cast("string"), F.lit(f" complete cells; {min_samples} are needed")))
