"""Exact top-k inner-product search with ball trees, by branch and bound.

Candidates are dealt into regions by the splits of a tree over a bounded pilot
sample, so a region holds close vectors; a region of more than `shard_rows` is
dealt on into shards by a hash of the id. The driver knows a centre, radius and
count for each region, `REGIONS` of them at most for each vector length.

Queries search in rounds. In the first each goes to the region whose upper bound
q.centre + |q| * radius is highest, in the next to those that follow, in the last to
all others; before every round a query's current k-th score, over all regions it
has met, drops the regions whose bound is below it, and with them the shuffle of
the query to their shards. Within a shard a ball tree keeps its inner nodes: a
batch of queries takes nodes in order of their highest bound, passes whole
subtrees by where no query's bound reaches its k-th score, and raises those scores
at every leaf. Bounds and scores are exact in integers, so nothing is lost.

Memory per task is one shard, its tree and the queries of one block. Work is by
nature queries x candidates in the worst case; pruning only lowers it.

Vectors that are null or hold a null or non-finite component take no part, nor
do rows with a null id. Vectors of different lengths are never compared. A row
is no candidate for queries with its own id. Scores are 64-bit integers. Rows
that repeat an id are separate candidates (ties between them by place); query
rows that repeat an id ask together: the k best of all their scores are returned
under that id. With fewer than k candidates all are returned; without candidates
a query has no row. An empty table gives no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, scratch

#: Candidates in a shard, vectors in a leaf, vectors in the pilot sample, regions of a vector length.
SHARD_ROWS, LEAF_ROWS, PILOT_ROWS, REGIONS = 16_384, 256, 4_096, 128
#: Queries that descend a shard's tree together, regions that a query meets in the first rounds.
QUERY_BLOCK, ROUNDS = 256, (1, 4)
#: Vector lengths whose regions are told apart; rarer lengths are dealt by hash alone.
LENGTHS = 8
LOWEST = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, dim and v, the vector as floor(scale * x)."""
    x = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)


def exact(*parts: np.ndarray) -> bool:
    """Whether inner products of these integers are exact in float64."""
    top = max((int(np.abs(p).max()) if p.size else 0 for p in parts), default=0)
    dim = parts[0].shape[1] if parts else 0
    return top * top * max(dim, 1) < 1 << 53


def upper_bounds(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Queries x balls: no vector of the ball has a larger inner product (rounded up past float errors)."""
    bounds = queries.astype(np.float64) @ centres.T + norms[:, None] * radii
    return np.ceil(bounds + np.abs(bounds) * 1e-9 + norms[:, None] * np.sqrt((centres**2).sum(1)) * 1e-9 + 1e-6)


def halves(points: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction between two far points, and the median of the points along it."""
    far = points[np.argmax(((points - points.mean(0)) ** 2).sum(1))]
    other = points[np.argmax(((points - far) ** 2).sum(1))]
    return other - far, float(np.median(points @ (other - far)))


class BallTree:
    """Nodes with centre and radius around their vectors; leaves hold a range of the sorted rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        points = self.vectors.astype(np.float64)
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        centres, radii = [], []

        def add(rows: np.ndarray) -> int:
            centre = points[rows].mean(0)
            centres.append(centre)
            radii.append(np.sqrt(((points[rows] - centre) ** 2).sum(1).max()))
            self.rows.append(np.sort(rows))
            self.children.append(None)
            return len(centres) - 1

        waiting = [add(np.arange(len(ids)))] if len(ids) else []
        while waiting:
            node = waiting.pop()
            rows = self.rows[node]
            if len(rows) > leaf_rows and radii[node] > 0:
                axis, _ = halves(points[rows])
                split = np.argpartition(points[rows] @ axis, len(rows) // 2)
                self.children[node] = (add(rows[split[: len(rows) // 2]]), add(rows[split[len(rows) // 2 :]]))
                waiting += self.children[node]
                self.rows[node] = rows[:0]
        self.centres, self.radii = np.array(centres).reshape(len(centres), vectors.shape[1]), np.array(radii)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score) of the k best of each query that reach its threshold.

        `threshold` is a proven lower bound of each query's final k-th score.
        """
        as_float = exact(queries, self.vectors)
        q = queries.astype(np.float64 if as_float else np.int64)
        v = self.vectors.astype(q.dtype)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        best, owner = np.full((len(q), k), LOWEST, np.int64), np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        floor = threshold.copy()
        bounds = upper_bounds(queries, norms, self.centres, self.radii)
        heap = [(-bounds[:, 0].max(), 0)] if len(q) and len(self.radii) else []
        while heap:
            _, node = heapq.heappop(heap)
            own = np.flatnonzero(bounds[:, node] >= floor)
            if not len(own):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    reach = np.minimum(bounds[own, child], bounds[own, node])
                    bounds[own, child] = reach
                    if (reach >= floor[own]).any():
                        heapq.heappush(heap, (-reach.max(), child))
                continue
            rows = self.rows[node]
            for start in range(0, len(rows), 4 * LEAF_ROWS):  # a leaf of equal vectors may be large
                part = rows[start : start + 4 * LEAF_ROWS]
                scores = np.rint(q[own] @ v[part].T).astype(np.int64) if as_float else q[own] @ v[part].T
                ids = np.broadcast_to(self.ids[part], scores.shape)
                scores = np.where(ids == query_ids[own, None], LOWEST, scores)
                hit = np.flatnonzero((scores >= floor[own, None]).any(1))
                if len(hit):
                    at = own[hit]
                    all_scores, all_ids = np.concatenate([best[at], scores[hit]], 1), np.concatenate([owner[at], ids[hit]], 1)
                    top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
                    best[at], owner[at] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
                    floor[at] = np.maximum(floor[at], best[at, -1])
        row, at = np.nonzero((best > LOWEST) & (best >= threshold[:, None]))
        return row, owner[row, at], best[row, at]


class Regions:
    """Splits of a pilot sample: which region a vector falls into."""

    def __init__(self, points: np.ndarray, regions: int):
        self.splits: list[tuple[np.ndarray, float, int, int] | int] = []
        self.count = 0

        def grow(own: np.ndarray, share: int) -> int:
            place = len(self.splits)
            self.splits.append(0)
            if share > 1 and len(own) > 1:
                axis, cut = halves(own)
                low = own @ axis <= cut
                if low.any() and not low.all():
                    self.splits[place] = (axis, cut, grow(own[low], share // 2), grow(own[~low], share // 2))
                    return place
            self.splits[place] = self.count
            self.count += 1
            return place

        grow(points, regions)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        stack = [(0, np.arange(len(points)))]
        while stack:
            place, rows = stack.pop()
            split = self.splits[place]
            if isinstance(split, int):
                out[rows] = split
            else:
                axis, cut, low, high = split
                side = points[rows] @ axis <= cut
                stack += [(low, rows[side]), (high, rows[~side])]
        return out


def deal(vectors: DataFrame, regions: dict[int, Regions]) -> DataFrame:
    """Adds region, for lengths that have regions, else 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            region = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    rows = np.flatnonzero(dims == dim)
                    region[rows] = shared.value[dim].of(matrix(batch.column("v").take(pa.array(rows)), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v array<long>, region int")


def by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((dim, region), vectors) of each batch."""
    for batch in batches:
        dims, regions = batch.column("dim").to_numpy(), batch.column("region").to_numpy()
        for dim, region in np.unique(np.stack([dims, regions], 1), axis=0).tolist():
            rows = np.flatnonzero((dims == dim) & (regions == region))
            yield (dim, region), matrix(batch.column("v").take(pa.array(rows)), dim).astype(np.float64)


def region_balls(dealt: DataFrame, dims: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: numbers, centres and radii of its regions; two passes of partial sums, a row a region and coordinate."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for key, v in by_region(batches):
            total[key] = total.get(key, 0.0) + np.append(v.sum(0), len(v))
        for (dim, region), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, dim, np.int32)), pa.array(np.full(dim + 1, region, np.int32)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(x)], ["dim", "region", "i", "x"])

    rows = dealt.where(F.col("dim").isin(dims)).select("dim", "region", "v")
    centres: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.mapInArrow(sums, "dim int, region int, i int, x double").groupBy("dim", "region", "i").agg(F.sum("x").alias("x")).collect():
        centres.setdefault((r["dim"], r["region"]), np.zeros(r["dim"] + 1))[r["i"]] = r["x"]
    centres = {k: x[:-1] / x[-1] for k, x in centres.items()}
    shared = dealt.sparkSession.sparkContext.broadcast(centres)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[tuple[int, int], float] = {}
        for key, v in by_region(batches):
            far[key] = max(far.get(key, 0.0), float(((v - shared.value[key]) ** 2).sum(1).max()) ** 0.5)
        if far:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[n] for k in far], pa.int32()) for n in (0, 1)), pa.array(list(far.values()), pa.float64())], ["dim", "region", "r"])

    radii = {(r["dim"], r["region"]): r["r"] for r in rows.mapInArrow(reach, "dim int, region int, r double").groupBy("dim", "region").agg(F.max("r").alias("r")).collect()}
    out = {}
    for dim in dims:
        own = sorted(region for d, region in radii if d == dim)
        out[dim] = (np.array(own, np.int32), np.array([centres[dim, r] for r in own]).reshape(len(own), dim), np.array([radii[dim, r] for r in own]))
    return out


def with_plans(asked: DataFrame, balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds plan: the regions of the query's length, highest upper bound first."""
    shared = asked.sparkSession.sparkContext.broadcast(balls)

    def lists(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """A list of (region, bound) for each row of two matrices."""
        pairs = pa.StructArray.from_arrays([pa.array(numbers.ravel(), pa.int32()), pa.array(bounds.ravel(), pa.float64())], ["region", "bound"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * numbers.shape[1]), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            plans, places = [], []
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                numbers, bounds = np.zeros((len(rows), 1), np.int32), np.full((len(rows), 1), np.inf)
                if dim in shared.value:
                    known, centres, radii = shared.value[dim]
                    q = matrix(batch.column("v").take(pa.array(rows)), dim)
                    bounds = upper_bounds(q, np.sqrt((q.astype(np.float64) ** 2).sum(1)), centres, radii)
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    numbers, bounds = known[order], np.take_along_axis(bounds, order, 1)
                plans.append(lists(numbers, bounds))
                places.append(rows)
            if plans:
                plan = pa.concat_arrays(plans).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))
                yield pa.RecordBatch.from_arrays([*batch.columns, plan], [*batch.schema.names, "plan"])

    return asked.mapInArrow(run, "vec_id long, dim int, v array<long>, plan array<struct<region: int, bound: double>>")


def search_shard(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    names, out = ["query_id", "vec_id", "score"], []
    if candidates.num_rows and queries.num_rows:
        dim = candidates.column("dim")[0].as_py()
        tree = BallTree(candidates.column("vec_id").to_numpy(), matrix(candidates.column("v").combine_chunks(), dim))
        for start in range(0, queries.num_rows, QUERY_BLOCK):
            part = queries.slice(start, QUERY_BLOCK)
            ids = part.column("vec_id").to_numpy()
            row, found, score = tree.search(ids, matrix(part.column("v").combine_chunks(), dim), k, part.column("floor").to_numpy())
            out.append([ids[row], found, score])
    return pa.Table.from_arrays([pa.array(np.concatenate(x) if len(x) else np.zeros(0, np.int64)) for x in (zip(*out, strict=True) if out else ((), (), ()))], names)


def k_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(df: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query row.

    `is_query` marks the rows that ask; every row is a candidate. All tasks get the
    splits and balls of the regions (`REGIONS` for each of `LENGTHS` lengths at
    most). Candidates and queries meet in groups of at most about `shard_rows` and
    `query_rows` rows. The result is a written table; all others are deleted.
    """
    with scratch(df.sparkSession):
        return materialise(searched(df, is_query, k, id_col, vec_col, scale, shard_rows, query_rows), "top_k", last=True)


def searched(df: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, scale: int, shard_rows: int, query_rows: int) -> DataFrame:
    """The search of `exact_top_k`, round by round."""
    vectors = quantised(df, id_col, vec_col, scale)
    sizes = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    regions: dict[int, Regions] = {}
    for r in sizes:
        share = int(min(1.0, PILOT_ROWS / r["count"]) * 1_000_000)
        rows = vectors.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share)).select("v").limit(2 * PILOT_ROWS).toArrow()
        if rows.num_rows and r["dim"]:
            points = matrix(rows.column("v").combine_chunks(), r["dim"]).astype(np.float64)
            regions[r["dim"]] = Regions(points[np.lexsort(points.T)], min(REGIONS, max(1, r["count"] * 4 // shard_rows)))
    dealt = materialise(deal(vectors, regions), "vectors")
    balls = region_balls(dealt, list(regions))
    asked = materialise(with_plans(quantised(df.where(is_query), id_col, vec_col, scale), balls), "queries")
    shards = dealt.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    met: list[DataFrame] = []
    start = 1
    for width in (*ROUNDS, REGIONS):  # the last takes all that are left
        if met and start > max((len(numbers) for numbers, _, _ in balls.values()), default=1):
            break
        ahead = asked.select("vec_id", "dim", "v", F.inline(F.slice("plan", start, width)))
        if met:
            reached = k_best(reduce(DataFrame.unionByName, met), k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
            ahead = ahead.join(reached.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST))).where(F.col("bound") >= F.col("floor"))
        else:
            ahead = ahead.withColumn("floor", F.lit(LOWEST))
        met.append(materialise(meet(dealt, shards, ahead, k, query_rows), "found"))
        start += width
    return k_best(reduce(DataFrame.unionByName, met), k).select("query_id", "rank", "vec_id", "score")


def meet(dealt: DataFrame, shards: DataFrame, ahead: DataFrame, k: int, query_rows: int) -> DataFrame:
    """query_id, vec_id, score of queries (vec_id, dim, v, region, floor) against the shards of their regions."""
    asks = ahead.groupBy("dim", "region").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    groups = shards.join(asks, ["dim", "region"])  # a row a region that is still asked
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.join(groups, ["dim", "region"]).withColumn("shard", spread("shards", 1)).withColumn("block", each("blocks"))
    right = ahead.join(groups, ["dim", "region"]).withColumn("block", spread("blocks", 2)).withColumn("shard", each("shards"))
    keys = ["dim", "region", "shard", "block"]
    pick = lambda rows, more: rows.select(*keys, "vec_id", "v", *more).groupBy(*keys)
    return pick(left, []).cogroup(pick(right, ["floor"])).applyInArrow(lambda a, b: search_shard(a, b, k), "query_id long, vec_id long, score long")
