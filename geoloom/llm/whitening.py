"""Whiten integer vectors by principal components from an orthogonal factorisation.

The fit list is each distinct vector once. Tasks compress blocks of its rows, each
centred on its own mean, to triangles R by QR; two triangles meet with one row more
for the difference of their means, so that nothing is multiplied before it is
centred and no second pass is needed. The last triangle has V = R'R / n. One-sided
Jacobi rotates pairs of its columns until all are orthogonal: their norms are the
standard deviations (times sqrt(n)), the accumulated rotations the components, both
accurate for small deviations too, as V is never formed. The covariance of the
whitened fit list is then measured from its rows.

Vectors of each length are a fit of their own. Components are those of a deviation
above rounding (a constant vector has none), at most `components`; rows of a length
without any give no result rows. Null vectors, vectors with null, NaN, infinite or
far too large entries (2**50 and more) take no part. Null ids are kept; rows that
repeat give results each and count once in the fit; an empty table gives no rows.
Other columns are left out, whatever their names. A deviation beyond a long is null.

How it scales: distinct vectors are found with partial aggregates, so a vector on a
third of the rows costs nothing; they are written once to the shared folder and read
by the fit and by the measurement. A task holds a block of rows and a d x d triangle;
triangles are merged eight at a time. The driver holds n, sums and 16 components of
each length. For vectors of some thousand dimensions a merge holds about 1 GB.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, scratch

#: Triangles that one task merges, rows of a block, bytes of models that travel with a task.
FAN_IN = 8
BLOCK_ROWS = 2048
MODEL_BYTES = 64 << 20
#: Entries below this in size are whole numbers of 1/64 in a long with room to spare.
LARGEST = float(1 << 50)
SWEEPS = 60

DECIMALS = pa.decimal128(38, 0)
PARTS = "d int, part int, n long, sums array<decimal(38,0)>, r binary"
MODEL = "d int, n long, sums array<decimal(38,0)>, sd array<double>, axes binary, trace double"


def quantised(vector: Column | str) -> Column:
    """floor(64 c) + 1000000 of every entry c as a double; null for a vector that takes no part."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda c: F.floor(c.cast("double") * 64).cast("long") + F.lit(1_000_000).cast("long")))


def by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the lists of each length but 0."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == d)
        yield int(d), places, flat[offsets[places][:, None] + np.arange(d)]


def times_less(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: as 64-bit integers where they suffice, else as Python's."""
    reach = int(np.abs(x).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    if reach < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


class Part(NamedTuple):
    """Of some rows: how many, their sums and the triangle of what is left about their mean."""

    n: int
    sums: list[int]
    r: np.ndarray


def block(x: np.ndarray) -> Part:
    n = len(x)
    sums = [int(s) for s in (x.sum(0) if int(np.abs(x).max()) * n < 1 << 62 else x.astype(object).sum(0))]
    return Part(n, sums, np.linalg.qr((times_less(x, n, sums) / n).astype(float), mode="r"))


def merged(a: Part, b: Part) -> Part:
    """Of the rows of both: their triangles and the difference of their means, weighted, on top of each other."""
    apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    weight = math.sqrt(a.n / (a.n + b.n) * b.n)
    return Part(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], np.linalg.qr(np.vstack([a.r, b.r, weight * apart]), mode="r"))


def compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part for each length that the task has seen."""
    from pyspark import TaskContext

    parts: dict[int, Part] = {}
    for batch in batches:
        for d, _, x in by_length(batch.column(0)):
            for k in range(0, len(x), max(BLOCK_ROWS, d)):
                part = block(x[k : k + max(BLOCK_ROWS, d)])
                parts[d] = merged(parts[d], part) if d in parts else part
    task = TaskContext.get().partitionId()
    for d, part in parts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([task], pa.int32()), pa.array([part.n]), pa.array([[Decimal(s) for s in part.sums]], pa.list_(DECIMALS)), pa.array([part.r.tobytes()], pa.binary())],
            ["d", "part", "n", "sums", "r"],
        )


def of_row(row) -> Part:
    return Part(int(row.n), [int(s) for s in row.sums], np.frombuffer(row.r).reshape(-1, int(row.d)))


def merge_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """The parts of one group, in order, as one."""
    total = None
    for row in rows.sort_values("part").itertuples():
        total = of_row(row) if total is None else merged(total, of_row(row))
    return pd.DataFrame({"d": [rows.d.iloc[0]], "part": [int(rows.part.min()) // FAN_IN], "n": [total.n], "sums": [[Decimal(s) for s in total.sums]], "r": [total.r.tobytes()]})


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as rows.

    In each round of a sweep disjoint pairs of columns are rotated at once, dealt
    like the rounds of a tournament.
    """
    d = r.shape[1]
    columns = np.ascontiguousarray(r.T)
    start = np.argsort(-(columns**2).sum(1), kind="stable")  # large ones first: fewer sweeps
    columns, axes = columns[start], np.eye(d)[start]
    players = list(range(d)) + [-1] * (d % 2)
    half = len(players) // 2
    enough = np.finfo(float).eps * math.sqrt(max(r.shape))
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(max(len(players) - 1, 0)):
            pairs = np.array([(min(p, q), max(p, q)) for p, q in zip(players[:half], players[:half - 1:-1], strict=True) if min(p, q) >= 0], int).reshape(-1, 2)
            players = [players[0], players[-1], *players[1:-1]]
            i, j = pairs[:, 0], pairs[:, 1]
            a, b, c = ((columns[u] * columns[v]).sum(1) for u, v in ((i, i), (j, j), (i, j)))
            off = np.abs(c) > enough * np.sqrt(a) * np.sqrt(b)
            if not off.any():
                continue
            rotated = True
            i, j, a, b, c = i[off], j[off], a[off], b[off], c[off]
            with np.errstate(over="ignore"):
                slope = (b - a) / (2 * c)
                tangent = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(1, slope))
            cosine = 1 / np.hypot(1, tangent)
            sine = cosine * tangent
            for m in (columns, axes):
                left, right = m[i], m[j]
                m[i] = cosine[:, None] * left - sine[:, None] * right
                m[j] = sine[:, None] * left + cosine[:, None] * right
        if not rotated:
            break
    norms = np.sqrt((columns**2).sum(1))
    order = np.argsort(-norms, kind="stable")
    return norms[order], axes[order]


def solved(rows: pd.DataFrame, components: int) -> pd.DataFrame:
    part = of_row(next(rows.itertuples()))
    d = part.r.shape[1]
    norms, axes = jacobi(part.r)
    real = int((norms[:components] > norms[0] * np.finfo(float).eps * max(d, 16)).sum())
    sd = norms[:real] / math.sqrt(part.n)
    return pd.DataFrame({"d": [d], "n": [part.n], "sums": [[Decimal(s) for s in part.sums]], "sd": [sd], "axes": [axes[:real].tobytes()], "trace": [float((part.r**2).sum()) / part.n]})


class Model(NamedTuple):
    """Of one length: rows fitted, sums, deviations, unit axes as rows, total variance, what the measured covariance lacks."""

    n: int
    sums: list[int]
    sd: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """Rows of n x - sums on the axes, over the deviations."""
        return (apart / self.n).astype(float) @ (self.axes.T / self.sd)


def measured(batches: Iterable[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """Sums and products of the whitened fit list, a row for each length that the task has seen."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, x in by_length(batch.column(0)):
            if d in models:
                w = models[d].whitened(times_less(x, models[d].n, models[d].sums))
                w = np.hstack([w, np.ones((len(w), 1))])
                found[d] = found.get(d, 0) + w.T @ w
    for d, m in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], ["d", "products"])


def lacking(rows: pd.DataFrame) -> pd.DataFrame:
    """The largest entry of covariance less identity, in absolute value."""
    total = np.stack(rows.products.to_list()).sum(0)
    k = math.isqrt(len(total)) - 1
    m = total.reshape(k + 1, k + 1) / total[-1]
    covariance = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
    return pd.DataFrame({"d": [rows.d.iloc[0]], "identity_error": [float(np.abs(covariance - np.eye(k)).max(initial=0))]})


def fit_whitening(rows: DataFrame, vec_col: str = "x", *, components: int = 16) -> dict[int, Model]:
    """A model for each length of the integer vectors in `vec_col` that has a component."""
    spark = rows.sparkSession
    with scratch(spark):
        fit = materialise(rows.where(F.size(vec_col) > 0).select(F.col(vec_col).alias("x")).distinct(), "fit")
        parts = materialise(fit.mapInArrow(compressed, PARTS), "triangles")
        most = parts.agg(F.max("part")).first()[0]
        while most:  # groups of FAN_IN tasks, then of their results
            parts = parts.groupBy("d", F.expr(f"part div {FAN_IN}")).applyInPandas(merge_rows, PARTS)
            most //= FAN_IN
        solutions = materialise(parts.groupBy("d").applyInPandas(lambda g: solved(g, components), MODEL), "models")
        models = {r.d: Model(r.n, [int(s) for s in r.sums], np.array(r.sd), np.frombuffer(r.axes).reshape(-1, r.d), r.trace, 0.0) for r in solutions.where(F.size("sd") > 0).collect()}
        for some in in_passes(models):
            products = fit.mapInArrow(lambda batches, some=some: measured(batches, some), "d int, products array<double>")
            for r in products.groupBy("d").applyInPandas(lacking, "d int, identity_error double").collect():
                models[r.d] = models[r.d]._replace(identity_error=r.identity_error)
    return models


def in_passes(models: dict[int, Model]) -> Iterator[dict[int, Model]]:
    """The models in parts that may travel with a task: one part but for very many lengths."""
    some: dict[int, Model] = {}
    size = 0
    for d, m in models.items():
        own = m.axes.nbytes + 32 * d
        if some and size + own > MODEL_BYTES:
            yield some
            some, size = {}, 0
        some[d] = m
        size += own
    if some:
        yield some


def exact_squares(apart: np.ndarray) -> list[int | None]:
    """Sums of squares by row; None beyond a long."""
    if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 1 << 63:
        return (apart * apart).sum(1).tolist()
    squares = (apart.astype(object) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in squares]


RESULTS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def projected(batches: Iterable[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and component; the batches hold an id and a vector."""
    for batch in batches:
        for d, places, x in by_length(batch.column(1)):
            if d not in models:
                continue
            m = models[d]
            for begin in range(0, len(x), BLOCK_ROWS):
                apart = times_less(x[begin : begin + BLOCK_ROWS], m.n, m.sums)
                rows, k = len(apart), len(m.sd)
                ids = batch.column(0).take(pa.array(np.repeat(places[begin : begin + BLOCK_ROWS], k)))
                every = lambda v, rows=rows, k=k: pa.array(np.full(rows * k, v))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        every(m.n),
                        pa.array(exact_squares(apart), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(m.whitened(apart).ravel()),
                        pa.array(np.tile(m.sd**2 / m.trace, rows)),
                        every(m.identity_error),
                    ],
                    [batch.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )


def whiten(rows: DataFrame, models: dict[int, Model], id_col: str = "vec_id", vec_col: str = "x") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error for every row and component."""
    kept = rows.where(F.size(vec_col) > 0).select(F.col(id_col).alias(id_col), F.col(vec_col).alias("x"))
    schema = f"`{id_col}` {kept.schema[0].dataType.simpleString()}, {RESULTS}"
    results = [kept.mapInArrow(lambda batches, some=some: projected(batches, some), schema) for some in in_passes(models)]
    if not results:
        return kept.mapInArrow(lambda batches: projected(batches, {}), schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
