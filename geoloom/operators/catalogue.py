"""Choosing acquisitions from a table of products."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import solar_hour

#: Order of processing streams of one orbit; others come last. Fixed values.
STREAM_ORDER = {"RPRO": 0, "OFFL": 1, "NRTI": 2}
#: Orbit number in a product's name. Fixed value.
ORBIT_PATTERN = r"_\d{8}T\d{6}_\d{8}T\d{6}_(\d{5})_"
#: Local solar hours of a day pass, from and before. Fixed values.
DAY_HOURS = (6.0, 18.0)


def search(products: DataFrame, *, start: Column, end: Column, box: tuple[float, float, float, float] | None = None, **equal: str) -> DataFrame:
    """Products that overlap a time span (open at both ends) and a box, with equal attributes."""
    out = products.where((F.col("start_ts") < end) & (F.col("end_ts") > start))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    if box:
        w, s, e, n = box
        out = out.where((F.col("west") < e) & (F.col("east") > w) & (F.col("south") < n) & (F.col("north") > s))
    return out


#: Comparisons that a query on item properties may name. Fixed values.
COMPARISONS = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


def search_items(items: DataFrame, *, collections: Sequence[str] = (), box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None, query: dict[str, dict[str, object]] | None = None) -> DataFrame:
    """Items (collection, datetime, west, south, east, north, properties: map of text) by collections, box, time and properties.

    Bounds count; an end that is a bare date means its last second. Numbers are
    compared as numbers, text as text; an item without the property does not match.
    """
    out = items
    if collections:
        out = out.where(F.col("collection").isin(*collections))
    if box:
        west, south, east, north = box
        out = out.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    if start:
        out = out.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("datetime") <= F.lit(f"{end}T23:59:59" if len(end) == 10 else end).cast("timestamp"))
    for name, terms in (query or {}).items():
        for term, wanted in terms.items():
            held = F.element_at("properties", F.lit(name))
            held = held if isinstance(wanted, str) else held.try_cast("double")
            out = out.where(COMPARISONS[term](held, F.lit(wanted)))
    return out


def quality_order(cloud: str = "cloud", coverage: str = "coverage") -> list[Column]:
    """Online first, known cloud first, less cloud, more coverage (unknown last), earlier, by id."""
    return [
        F.coalesce(F.col("online"), F.lit(False)).desc(),
        F.col(cloud).isNull().asc(),
        F.col(cloud).asc(),
        F.coalesce(F.col(coverage), F.lit(-1.0)).desc(),
        F.col("start_ts").asc_nulls_first(),
        F.col("product_id").asc(),
    ]


def below_cloud(products: DataFrame, max_cloud: float | None) -> DataFrame:
    """Products with at most this much cloud; an unknown cloud cover passes."""
    return products if max_cloud is None else products.where(F.col("cloud").isNull() | (F.col("cloud") <= max_cloud))


def best_products(products: DataFrame, limit: int, *, max_cloud: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The `limit` best products of each key, with rank; unknown cloud passes the cloud limit.

    Where no product of a key has a cloud value and there are too many, the period
    is sampled evenly instead. Without keys each task keeps its own best, so only
    tasks x limit rows meet.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    kept = below_cloud(products, max_cloud)
    known = kept.groupBy(*keys).agg(F.count("cloud").alias("_known"), F.count("*").alias("_n"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    sized = kept.join(known, list(keys)) if keys else kept.crossJoin(F.broadcast(known))
    seen = sized.where("_known > 0 or _n <= " + str(int(limit))).drop("_known", "_n")
    if not keys:
        seen = seen.orderBy(*quality_order()).limit(limit)
    ranked = seen.withColumn("rank", F.row_number().over(by.orderBy(*quality_order()))).where(F.col("rank") <= limit)
    blind = spread_in_time(sized.where(f"_known = 0 and _n > {int(limit)}").drop("_known", "_n"), limit, keys=keys)
    return ranked.unionByName(blind)


def spread_in_time(products: DataFrame, limit: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """`limit` products evenly spaced in time order: places round-half-even(i (n-1) / (limit-1)), each once.

    Counts by day say on which days the places fall; only those days' products are
    put in order, a day by itself. Products without a time come first, as one day.
    """
    day = F.coalesce(F.floor(F.unix_micros(F.col("start_ts").cast("timestamp")) / 86_400_000_000), F.lit(-(1 << 40)))
    names = [f"_k{n}" for n in range(len(keys))]
    counts = products.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), day.alias("_on")).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*(names or [F.lit(0)]))  # a row a day
    places = F.array(F.lit(0.0)) if limit == 1 else F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / (limit - 1))))
    days = counts.withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.sum("_c").over(whole.orderBy("_on")) - F.col("_c")).withColumn("_places", places)
    days = days.where(F.exists("_places", lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_c")))).drop("_c", "_n")
    same = F.col("_day") == F.col("_on")
    for k, n in zip(keys, names, strict=True):
        same = same & products[k].eqNullSafe(F.col(n))
    met = products.withColumn("_day", day).join(days, same)
    placed = met.withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(*names, "_day").orderBy(F.col("start_ts").asc_nulls_first(), "product_id")) - 1)
    rank = F.array_position("_places", F.col("_at").cast("double")).cast("int")
    return placed.withColumn("rank", rank).where("rank > 0").select(*products.columns, "rank")


def one_per_orbit(products: DataFrame, *, name: str = "name", order: str = "ordinal") -> DataFrame:
    """One product for each orbit in its name, reprocessed before offline before near-real-time, first on ties; names without an orbit pass."""
    orbit = F.regexp_extract(F.col(name), ORBIT_PATTERN, 1)
    stream = F.substring(name, 5, 4)
    rank = F.lit(9)
    for s, k in STREAM_ORDER.items():
        rank = F.when(stream == s, k).otherwise(rank)
    keyed = products.withColumn("_orbit", orbit)
    first = keyed.where("_orbit <> ''").groupBy("_orbit").agg(F.min_by(F.struct(*products.columns), F.struct(rank, F.col(order))).alias("p")).select("p.*")
    return first.unionByName(keyed.where("_orbit = ''").drop("_orbit"))


def by_overpass(products: DataFrame, lon: Column, overpass: str = "any") -> DataFrame:
    """Products whose middle lies in a local solar day (6 to 18) or night; missing times only pass `any`."""
    if overpass == "any":
        return products
    middle = F.timestamp_micros(((F.unix_micros(F.col("start_ts").cast("timestamp")) + F.unix_micros(F.coalesce("end_ts", "start_ts").cast("timestamp"))) / 2).cast("long"))
    hour = solar_hour(middle, lon)
    day = (hour >= DAY_HOURS[0]) & (hour < DAY_HOURS[1])
    return products.where(day if overpass == "day" else ~day)


def temporal_pair(products: DataFrame, day: date, *, detection_days: int = 7, reference_days: tuple[int, int] = (30, 120), max_cloud: float | None = 25.0) -> DataFrame:
    """role (detection, reference) and product: the clearest of each window before a day, then the latest.

    Windows include both ends; an unknown cloud cover is kept and ranks last. A
    window without a product has no row.
    """
    near, far = reference_days
    if detection_days <= 0 or not 0 < near < far:
        raise ValueError("windows must be positive and ordered")
    kept = products if max_cloud is None else products.where(F.col("cloud").isNull() | (F.col("cloud") <= max_cloud))
    at = F.col("start_ts")
    lit = lambda d: F.lit(d.isoformat()).cast("timestamp")
    role = F.when(at.between(lit(day - timedelta(days=detection_days)), lit(day)), "detection").when(at.between(lit(day - timedelta(days=far)), lit(day - timedelta(days=near))), "reference")
    order = F.struct(F.coalesce("cloud", F.lit(101.0)), -F.unix_micros(at.cast("timestamp")), F.col("product_id"))
    return kept.withColumn("role", role).where("role is not null").groupBy("role").agg(F.min_by(F.struct(*products.columns), order).alias("p")).select("role", "p.*")


def distinct_products(products: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row for each product_id: the last one's values at the first one's place."""
    return products.groupBy("product_id").agg(F.max_by(F.struct(*(c for c in products.columns if c not in ("product_id", order))), order).alias("p"), F.min(order).alias(order)).select("product_id", "p.*", order)
