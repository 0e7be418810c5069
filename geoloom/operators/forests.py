"""Random forests and boosted trees for each scene, grown level by level from histograms.

Predictors are cut into at most `BINS` bins at quantiles (a bin a value where there
are few). A level of all trees of a group is a handful of sums over (node, bin): the
best cut of every node follows from running sums along its bins. A forest's members
are fitted in blocks, each a task's group of its own; a group holds one byte or two
for each coarse cell and predictor, so that a scene of a million coarse cells takes
some tens of megabytes, and never the fine cells. A model is a row of arrays a block.
Fine cells meet the models of their scene in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import cut
from .spatial import apart
from .trees import complete

BINS = 256
#: Members of a forest that a group fits; coarse cells, of whole scenes, that are boosted side by side.
BLOCK, SIDE_BY_SIDE = 25, 20_000


@dataclass(frozen=True)
class Growth:
    """How an ensemble grows: `members` bootstrapped trees, or with a rate trees that each fit what is left, times it."""

    members: int = 200
    depth: int = 10
    rate: float | None = None
    seed: int = 42


FOREST, BOOSTED = Growth(), Growth(members=300, depth=6, rate=0.05)


class Nodes(NamedTuple):
    """Trees as flat arrays: roots of the trees; by node feature (-1 in leaves), cut, the child on its low side (the other is the next) and value."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every tree (rows) for every row of x (columns)."""
        at = np.repeat(self.roots[:, None], len(x), 1)
        rows = np.broadcast_to(np.arange(len(x)), at.shape)
        while (inner := self.feature[at] >= 0).any():
            node, row = at[inner], rows[inner]
            at[inner] = self.child[node] + (x[row, self.feature[node]] > self.cut[node])
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


class Binned(NamedTuple):
    """Bin of every row and predictor; for each predictor the least and largest value of each bin, a row a group of rows."""

    code: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]


def binned(x: np.ndarray, bins: int = BINS) -> Binned:
    code, low, high = np.empty(x.shape, np.int32), [], []
    for f in range(x.shape[1]):
        values, inverse = np.unique(x[:, f], return_inverse=True)
        if len(values) > bins:
            ends = np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower"))
            of_value = np.searchsorted(ends, values, "left")  # a bin ends with its quantile
        else:
            of_value = np.arange(len(values))
        first = np.flatnonzero(np.diff(of_value, prepend=-1))
        of_value = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
        code[:, f] = of_value[inverse]
        low.append(values[first][None, :])
        high.append(values[np.append(first[1:] - 1, len(values) - 1)][None, :])
    return Binned(code, low, high)


def together(parts: Sequence[Binned]) -> Binned:
    """Groups of rows with bins of their own, one after the other."""
    def padded(arrays: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(arrays), max(a.shape[1] for a in arrays)))
        for row, a in zip(out, arrays, strict=True):
            row[: a.shape[1]] = a[0]
        return out

    columns = range(parts[0].code.shape[1])
    return Binned(np.concatenate([p.code for p in parts]), *([padded([getattr(p, end)[f] for p in parts]) for f in columns] for end in ("low", "high")))


def cuts_of(local: np.ndarray, code: np.ndarray, w: np.ndarray, wy: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node: how much the best cut of one predictor lowers the squared error, its last bin below, and its value.

    low and high have a row a node.
    """
    nodes, size = low.shape
    at = local * size + code
    if nodes * size > 4 * len(at):
        return sparse_cuts(at, w, wy, low, high)
    table = lambda weights=None: np.bincount(at, weights, nodes * size).reshape(nodes, size)
    here, weight, moment = table(), table(w), table(wy)
    count, left_w, left_m = (np.cumsum(t, 1) for t in (here, weight, moment))
    all_w, all_m = left_w[:, -1:], left_m[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = left_m**2 / left_w + (all_m - left_m) ** 2 / (all_w - left_w) - all_m**2 / all_w
    fall[(here == 0) | (count == count[:, -1:]) | ~np.isfinite(fall)] = 0.0
    last = fall.argmax(1)
    row = np.arange(nodes)
    after = ((here > 0) & (np.arange(size) > last[:, None])).argmax(1)
    below, above = high[row, last], low[row, after]
    middle = below + (above - below) / 2
    return fall[row, last], last, np.where(middle < above, middle, below)


def sparse_cuts(at: np.ndarray, w: np.ndarray, wy: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`cuts_of` where most bins of most nodes are empty: sums along the sorted (node, bin) that there are."""
    nodes, size = low.shape
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    node, own = np.divmod(at[order][first], size)
    weight, moment = (np.add.reduceat(v[order], first) for v in (w, wy))
    begin = np.flatnonzero(np.diff(node, prepend=-1))
    lengths = np.diff(np.append(begin, len(node)))
    segment = np.repeat(np.arange(len(begin)), lengths)
    ends = begin + lengths - 1
    left_w, left_m = (np.cumsum(v) - (np.cumsum(v)[begin] - v[begin])[segment] for v in (weight, moment))
    all_w, all_m = left_w[ends][segment], left_m[ends][segment]
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = left_m**2 / left_w + (all_m - left_m) ** 2 / (all_w - left_w) - all_m**2 / all_w
    fall[~np.isfinite(fall)] = 0.0
    fall[ends] = 0.0
    most = np.maximum.reduceat(fall, begin)
    there = np.flatnonzero(fall == most[segment])
    place = there[np.unique(segment[there], return_index=True)[1]]
    following = np.minimum(place + 1, ends)
    found, last, value = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes)
    seen = node[begin]
    below, above = high[seen, own[place]], low[seen, own[following]]
    middle = below + (above - below) / 2
    found[seen], last[seen], value[seen] = most, own[place], np.where(middle < above, middle, below)
    return found, last, value


def grow_trees(data: Binned, y: np.ndarray, tree: np.ndarray, row: np.ndarray, w: np.ndarray, group: np.ndarray, depth: int) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """Trees from (tree, row, weight), each in its group's bins: nodes, each one's tree, and the leaf of each (tree, row)."""
    trees = len(group)
    weight = np.bincount(tree, w, trees)
    centre = np.divide(np.bincount(tree, w * y[row], trees), weight, out=np.zeros(trees), where=weight > 0)
    apart_ = y[row] - centre[tree]
    wy = w * apart_
    tolerance = np.zeros(trees)
    np.maximum.at(tolerance, tree, wy * apart_)
    tolerance = 1e-10 * np.maximum(1.0, tolerance)  # running sums over all nodes round
    node, of_tree = tree.copy(), [np.arange(trees)]
    feature, at_value, child = [np.full(trees, -1)], [np.zeros(trees)], [np.zeros(trees, np.int64)]
    start, stop = 0, trees
    live = np.arange(len(node))
    for _ in range(depth):
        if not len(live):
            break
        local, bins = node[live] - start, group[of_tree[-1]]
        found = [cuts_of(local, data.code[row[live], f], w[live], wy[live], data.low[f][bins], data.high[f][bins]) for f in range(data.code.shape[1])]
        gains = np.stack([f[0] for f in found])
        best = gains.argmax(0)
        split = gains.max(0) > tolerance[of_tree[-1]]
        place = np.arange(stop - start)
        last, value = (np.stack([f[k] for f in found])[best, place] for k in (1, 2))
        ids = np.flatnonzero(split)
        feature[-1][ids], at_value[-1][ids], child[-1][ids] = best[ids], value[ids], stop + 2 * np.arange(len(ids))
        going = split[local]
        live, local = live[going], local[going]
        node[live] = child[-1][local] + (data.code[row[live], best[local]] > last[local])
        of_tree.append(np.repeat(of_tree[-1][ids], 2))
        start, stop = stop, stop + 2 * len(ids)
        feature.append(np.full(stop - start, -1))
        at_value.append(np.zeros(stop - start))
        child.append(np.zeros(stop - start, np.int64))
    owner = np.concatenate(of_tree)
    total = np.bincount(node, w, stop)
    means = np.divide(np.bincount(node, wy, stop), total, out=np.zeros(stop), where=total > 0) + centre[owner]
    return Nodes(np.arange(trees), *(np.concatenate(c) for c in (feature, at_value, child)), means), owner, node


def grow(data: Binned, y: np.ndarray, weights: np.ndarray, depth: int) -> tuple[Nodes, np.ndarray]:
    """Trees for each row of `weights` (trees x rows; 0: not drawn), and each row's leaf in each (-1: not drawn)."""
    tree, row = np.nonzero(weights)
    nodes, _, at = grow_trees(data, y, tree, row, weights[tree, row], np.zeros(len(weights), np.int64), depth)
    leaf = np.full(weights.shape, -1)
    leaf[tree, row] = at
    return nodes, leaf


def bootstrap(n: int, weight: np.ndarray, members: Sequence[int], seed: int) -> np.ndarray:
    """By member, the weight of each row times how often it is drawn."""
    return np.stack([np.bincount(np.random.default_rng([seed, m]).integers(0, n, n), minlength=n) for m in members]) * weight


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, growth: Growth, group: np.ndarray | None = None) -> list[tuple[Nodes, float, np.ndarray]]:
    """For each group of rows (0, 1, ...; all are one without): all its trees, the value they start from, and what they leave.

    Groups are boosted side by side, a tree each in every round, as each round is a few short sums.
    """
    group = np.zeros(len(y), np.int64) if group is None else group
    groups = int(group.max()) + 1
    data = together([binned(x[group == g]) for g in range(groups)]) if groups > 1 else binned(x)
    order = np.argsort(group, kind="stable")  # as `together` has the rows
    y, weight, own = y[order], weight[order], group[order]
    empty = np.bincount(own, weight, groups) <= 0
    weight = np.where(empty[own], 1.0, weight)
    base = np.bincount(own, weight * y, groups) / np.bincount(own, weight, groups)
    left, rows = y - base[own], np.arange(len(y))
    parts, owners, size = [], [], 0
    for _ in range(growth.members):
        trees, owner, leaf = grow_trees(data, left, own, rows, weight, np.arange(groups), growth.depth)
        left = left - growth.rate * trees.value[leaf]
        parts.append(Nodes(trees.roots + size, trees.feature, trees.cut, trees.child + size, trees.value))
        owners.append(owner)
        size += len(owner)
    every, owner = Nodes(*(np.concatenate(c) for c in zip(*parts, strict=True))), np.concatenate(owners)
    by_group = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=groups)
    begins = np.cumsum(counts) - counts
    place = np.empty(size, np.int64)
    place[by_group] = np.arange(size) - np.repeat(begins, counts)  # number of a node among its group's
    out = []
    for g in range(groups):
        ids = by_group[begins[g] : begins[g] + counts[g]]
        inner = every.feature[ids] >= 0
        child = np.where(inner, place[np.where(inner, every.child[ids], 0)], 0)
        out.append((Nodes(place[every.roots.reshape(-1, groups)[:, g]], every.feature[ids], every.cut[ids], child, every.value[ids]), float(base[g]), left[own == g]))
    return out


COLUMNS = ("roots", "feature", "cut", "child", "value")
MODEL = "block int, members int, base double, rate double, roots array<int>, feature array<int>, cut array<double>, child array<int>, value array<double>"


def fit_scenes(training: DataFrame, target: str, names: Sequence[str], growth: Growth, min_samples: int, weights: DataFrame | None = None) -> DataFrame:
    """scene, block and a block's trees as arrays (see `Nodes`), with the deviation of the whole ensemble's residuals."""
    rows = complete(training, target, names, weights)
    kind = dict(rows.dtypes)["scene"]
    return fit_boosted(rows, target, names, growth, min_samples, kind) if growth.rate is not None else fit_forests(rows, target, names, growth, min_samples, kind)


def fit_boosted(rows: DataFrame, target: str, names: Sequence[str], growth: Growth, min_samples: int, kind: str) -> DataFrame:
    """Whole scenes, as many as make up about `SIDE_BY_SIDE` rows at a time."""
    made = ["scene", "block", "members", "base", "rate", *COLUMNS, "deviation"]

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        enough = cells.groupby("scene")["iy"].transform("size") >= min_samples
        cells = cells[enough].sort_values(["scene", "iy", "ix"])
        if not len(cells):
            return pd.DataFrame(columns=made)
        group, scenes = pd.factorize(cells.scene)
        x, y, w = cells[list(names)].to_numpy(float), cells[target].to_numpy(float), cells["weight"].to_numpy(float)
        found = boosted(x, y, w, growth, group)
        return pd.DataFrame([(scene, 0, len(trees.roots), base, growth.rate, *(c.tolist() for c in trees), float(left.std())) for scene, (trees, base, left) in zip(scenes, found, strict=True)], columns=made)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= SIDE_BY_SIDE:
                cells = pd.concat(held)
                last = cells.scene == cells.scene.iloc[-1]  # may go on
                if not last.all():
                    yield fit(cells[~last])
                held = [cells[last]]
        if held:
            yield fit(pd.concat(held))

    return apart(rows, "scene").sortWithinPartitions("scene", "iy", "ix").mapInPandas(batches, f"scene {kind}, {MODEL}, deviation double")


def fit_forests(rows: DataFrame, target: str, names: Sequence[str], growth: Growth, min_samples: int, kind: str) -> DataFrame:
    blocks = -(-growth.members // BLOCK)
    made = ["scene", "block", "members", "base", "rate", *COLUMNS, "fitted", "truth"]

    def fit(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        if len(cells) < min_samples:
            return pd.DataFrame(columns=made)
        cells = cells.sort_values(["iy", "ix"])
        x, y, w = cells[list(names)].to_numpy(float), cells[target].to_numpy(float), cells["weight"].to_numpy(float)
        own = range(key[1] * BLOCK, min(growth.members, (key[1] + 1) * BLOCK))
        drawn = bootstrap(len(y), w if w.sum() > 0 else np.ones_like(w), own, growth.seed)
        drawn[drawn.sum(1) == 0] = 1.0
        trees = grow(binned(x), y, drawn, growth.depth)[0]
        truth = y.tolist() if key[1] == 0 else []
        return pd.DataFrame([(key[0], key[1], len(trees.roots), 0.0, None, *(c.tolist() for c in trees), trees(x).sum(0).tolist(), truth)], columns=made)

    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = apart(spread, "scene", "block").groupBy("scene", "block").applyInPandas(fit, f"scene {kind}, {MODEL}, fitted array<double>, truth array<double>")
    found = cut(found)  # read twice: for the residuals of all blocks, and for the trees

    def residual(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        truth = np.asarray(next(t for t in parts.truth if len(t)))
        left = truth - np.sum([np.asarray(f) for f in parts.fitted], 0) / parts.members.sum()
        return pd.DataFrame({"scene": [key[0]], "deviation": [float(left.std())]})

    # a number a coarse cell and block
    deviation = found.select("scene", "members", "fitted", "truth").groupBy("scene").applyInPandas(residual, f"scene {kind}, deviation double")
    return found.drop("fitted", "truth").join(deviation, "scene")


def scene_ensemble(training: DataFrame, fine: DataFrame, target: str, predictors: Sequence[str], factor: int, kind: str | Growth, *, min_samples: int = 30, weights: DataFrame | None = None, tile: int = 50) -> DataFrame:
    """scene, iy, ix, lst_downscaled, its uncertainty (deviation of residuals) and lst_downscaled_spread.

    `kind` is forest, boosted or a Growth. The spread is the sample deviation over a
    forest's members at the cell; boosted trees have none. Scenes with fewer complete
    cells than `min_samples` have no rows; cells with a missing predictor are NULL.
    """
    growth = {"forest": FOREST, "boosted": BOOSTED}[kind] if isinstance(kind, str) else kind
    models = fit_scenes(training, target, predictors, growth, min_samples, weights)
    return predicted(fine, models, predictors, tile * factor)


def predicted(fine: DataFrame, models: DataFrame, names: Sequence[str], side: int) -> DataFrame:
    """Tiles of `side` x `side` fine cells with all the blocks of their scene."""
    kind = dict(fine.dtypes)["scene"]
    keys = ["scene", "wy", "wx"]
    cells = fine.select("scene", "iy", "ix", *names, F.expr(f"iy div {side}").cast("long").alias("wy"), F.expr(f"ix div {side}").cast("long").alias("wx"))
    known = cells.select(*keys).distinct().join(models, "scene")
    known = known.toDF(*known.columns)  # columns of its own, for the cogroup
    made = ["scene", "iy", "ix", "lst_downscaled", "lst_downscaled_uncertainty", "lst_downscaled_spread"]

    def predict(own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = own[["scene", "iy", "ix"]].copy()
        if not len(own) or not len(blocks):
            return out.iloc[:0].assign(**dict.fromkeys(made[3:], 0.0))
        x = own[list(names)].to_numpy(float)
        sound = ~np.isnan(x).any(1)
        n, total, squares = 0, np.zeros(sound.sum()), np.zeros(sound.sum())
        rate, base = blocks.rate.iloc[0], float(blocks.base.iloc[0])
        single = rate is not None and not np.isnan(rate)
        for b in blocks.sort_values("block").itertuples():
            trees = Nodes(*(np.asarray(getattr(b, c)) for c in COLUMNS))
            for k in range(0, len(total), 1 << 14):  # some 2 ** 14 cells x trees at once
                each = trees(x[sound][k : k + (1 << 14)])
                if single:
                    total[k : k + (1 << 14)] += each.sum(0)
                else:  # mean and sum of squared distances from it, block by block
                    mean, m = each.mean(0), len(each)
                    apart_ = mean - total[k : k + (1 << 14)]
                    squares[k : k + (1 << 14)] += ((each - mean) ** 2).sum(0) + apart_**2 * n * m / (n + m)
                    total[k : k + (1 << 14)] += apart_ * m / (n + m)
            n += b.members
        values = base + rate * total if single else total
        spread = np.sqrt(squares / (n - 1)) if not single and n > 1 else np.full(len(total), np.nan)
        for name, v in zip(made[3:], (values, np.full(len(total), float(blocks.deviation.iloc[0])), spread), strict=True):
            column = np.full(len(own), np.nan)
            column[sound] = v
            out[name] = column
        return out[made]

    found = apart(cells, *keys).groupBy(*keys).cogroup(apart(known, *keys).groupBy(*keys)).applyInPandas(predict, f"scene {kind}, iy int, ix int, {', '.join(f'{c} double' for c in made[3:])}")
    return found.select("scene", "iy", "ix", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in made[3:]))

