"""Polygons as tables of edges: labels of points, and areas of unions.

An edge is a row (zone, x1, y1, x2, y2), so zones of any number and outlines of any
length are joined, not written out as expressions. Rings are told apart by parity
alone: holes are rings, the direction of a ring does not matter, and edges of one
zone may come in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]
ENDS = ("x1", "y1", "x2", "y2")
EDGES = "zone int, x1 double, y1 double, x2 double, y2 double"
#: Bands and buckets into which the extent of all edges is cut.
BANDS, BUCKETS = 4096, 64


def edges_of(spark: SparkSession, zones: Sequence[Sequence[Ring]]) -> DataFrame:
    """Edges of zones that the driver holds; rings are closed if they aren't."""
    rows = [(k, *map(float, (*a, *b))) for k, rings in enumerate(zones) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if tuple(a) != tuple(b)]
    return spark.createDataFrame(rows, EDGES)


def edges_from_geojson(zones: DataFrame, zone: str = "zone", geometry: str = "geometry") -> DataFrame:
    """Edges of a table of zones, each a GeoJSON Polygon or MultiPolygon as text; other texts have none."""
    kind = F.get_json_object(geometry, "$.type")
    polygon = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>")
    several = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<array<double>>>>")
    rings = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", F.flatten(several))
    point = lambda ring, i: F.get(ring, i)
    each = zones.select(F.col(zone).alias("zone"), F.explode(rings).alias("_r")).where(F.size("_r") > 2)
    after = F.concat(F.slice("_r", F.lit(2), F.size("_r") - 1), F.slice("_r", 1, 1))
    pairs = each.select("zone", F.explode(F.arrays_zip(F.col("_r").alias("a"), after.alias("b"))).alias("e"))
    ends = pairs.select("zone", *(point(F.col(f"e.{p}"), F.lit(i)).alias(n) for n, (p, i) in zip(ENDS, (("a", 0), ("a", 1), ("b", 0), ("b", 1)), strict=True)))
    return ends.where("x1 <> x2 or y1 <> y2")


def labels(points: DataFrame, edges: DataFrame, *, x: str = "x", y: str = "y") -> DataFrame:
    """x, y, zone of the points strictly inside a zone: a row for each point and zone.

    Points that share a row (the same y) share its work: each zone's edges cross the
    row in places that, sorted, pair up to the stretches inside. Edges meet rows in
    bands, points meet stretches in buckets; both joins are on equal keys, and
    neither points nor edges meet all of the others. Points on an edge, tested
    exactly at the ends of a stretch, on level edges and on vertices, are outside.
    """
    ends = edges.agg(*(f(g(*cs)).alias(n) for n, f, g, cs in (("x0", F.min, F.least, ("x1", "x2")), ("x9", F.max, F.greatest, ("x1", "x2")), ("y0", F.min, F.least, ("y1", "y2")), ("y9", F.max, F.greatest, ("y1", "y2")))))
    sizes = ends.select("x0", "y0", F.greatest((F.col("y9") - F.col("y0")) / BANDS, F.lit(1e-12)).alias("band"), F.greatest((F.col("x9") - F.col("x0")) / BUCKETS, F.lit(1e-12)).alias("bucket"))
    sized = lambda df: df.crossJoin(F.broadcast(sizes))  # noqa: E731 - one row
    band = lambda c: F.floor((c - F.col("y0")) / F.col("band")).cast("int")
    bucket = lambda c: F.floor((c - F.col("x0")) / F.col("bucket")).cast("int")

    places = sized(points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null").distinct())
    places = places.where("_x >= x0 and _y >= y0").withColumns({"_band": band(F.col("_y")), "_bucket": bucket(F.col("_x"))}).where(f"_band <= {BANDS} and _bucket <= {BUCKETS}").select("_x", "_y", "_band", "_bucket")
    rows = places.select("_y", "_band").distinct()
    banded = sized(edges).select("zone", *ENDS, F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("_band"))
    met = rows.join(banded, "_band").where("_y between least(y1, y2) and greatest(y1, y2)").drop("_band")

    edge = F.struct(*ENDS)
    crossing = met.where("(y1 > _y) <> (y2 > _y)").select("zone", "_y", ((F.col("_y") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) + F.col("x1")).alias("_a"), edge.alias("_ea"))
    along = Window.partitionBy("zone", "_y").orderBy("_a", "_ea")
    paired = crossing.withColumns({"_k": F.row_number().over(along), "_b": F.lead("_a").over(along), "_eb": F.lead("_ea").over(along)}).where("_k % 2 = 1")
    inside = paired.select("zone", "_y", "_a", "_b", "_ea", "_eb")
    level = met.where("y1 = _y or y2 = _y").withColumn("_flat", F.expr("y1 = y2"))
    low, high = (F.when(F.col("_flat"), f("x1", "x2")).otherwise(F.when(F.col("y1") == F.col("_y"), F.col("x1")).otherwise(F.col("x2"))) for f in (F.least, F.greatest))
    touched = level.select("zone", "_y", low.alias("_a"), high.alias("_b"), F.lit(None).cast(inside.schema["_ea"].dataType).alias("_ea"), F.lit(None).cast(inside.schema["_eb"].dataType).alias("_eb"))

    spans = sized(inside.unionByName(touched)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_b"))))).select("zone", "_y", "_a", "_b", "_ea", "_eb", "_bucket")
    found = places.drop("_band").join(spans, ["_y", "_bucket"])
    on = lambda e: (F.col("_x") - F.col(f"{e}.x1")) * (F.col(f"{e}.y2") - F.col(f"{e}.y1")) - (F.col("_y") - F.col(f"{e}.y1")) * (F.col(f"{e}.x2") - F.col(f"{e}.x1")) == 0
    held = F.col("_ea").isNotNull() & (F.col("_x") >= F.col("_a")) & (F.col("_x") < F.col("_b"))
    border = F.when(F.col("_ea").isNull(), F.col("_x").between(F.col("_a"), F.col("_b"))).otherwise(held & (on("_ea") | on("_eb")))
    judged = found.where(held | border).groupBy("_x", "_y", "zone").agg(F.bool_or(held).alias("_in"), F.bool_or(border).alias("_on")).where("_in and not _on")
    return judged.select(F.col("_x").alias(x), F.col("_y").alias(y), "zone")


def zone_labels(cells: DataFrame, edges: DataFrame, x: Column, y: Column) -> DataFrame:
    """Adds zone: the first zone that holds the cell's centre, or -1."""
    placed = cells.withColumns({"_px": x.cast("double"), "_py": y.cast("double")})
    first = labels(placed, edges, x="_px", y="_py").groupBy("_px", "_py").agg(F.min("zone").alias("zone"))
    return placed.join(first, ["_px", "_py"], "left").select(*cells.columns, F.coalesce("zone", F.lit(-1)).cast("int").alias("zone"))


def union_share(footprints: DataFrame, key: str, area: Sequence[Ring], *, footprint: str = "zone", digits: int = 4) -> DataFrame:
    """key and coverage: the share of an area under at least one footprint of a key, rounded.

    `footprints` has key, footprint and the ends of an edge; a key whose footprints
    are all missing (ends NULL) has NULL, one without overlap 0. Exact: the heights
    of all ends and crossings of a key's edges, the area's among them, cut it into
    slabs in which no two edges cross. There the edges, in order, say how many
    footprints lie under each stretch; its area is its middle width times its height.
    Lines that several footprints share are crossed once. Edges are many more in their
    slabs than before, so slabs are dealt out anew, and windows hold the edges of one.
    """
    spark = footprints.sparkSession
    keys = footprints.select(key).distinct()
    own = footprints.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select(F.col(key).alias("_key"), F.dense_rank().over(Window.partitionBy(key).orderBy(F.col(footprint).cast("string"))).alias("_f"), *(F.col(c).cast("double").alias(c) for c in ENDS))
    frame = edges_of(spark, [area]).select(*ENDS)
    present = own.select("_key").distinct()
    edges = own.unionByName(present.crossJoin(F.broadcast(frame)).withColumn("_f", F.lit(None).cast("int")))  # the area is a parameter
    edges = edges.where("y1 <> y2").withColumns({"_lo": F.least("y1", "y2"), "_hi": F.greatest("y1", "y2"), "_slope": (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))}).withColumn("_x0", F.col("x1") - F.col("_slope") * F.col("y1"))
    lines = edges.select("_key", "_lo", "_hi", "_slope", "_x0").distinct()
    other = lines.select("_key", F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"), F.col("_slope").alias("_slope2"), F.col("_x0").alias("_x02"))
    crossing = lines.join(other, "_key").where("_slope < _slope2 and _lo < _hi2 and _lo2 < _hi").select("_key", ((F.col("_x02") - F.col("_x0")) / (F.col("_slope") - F.col("_slope2"))).alias("_y"), "_lo", "_hi", "_lo2", "_hi2")
    crossing = crossing.where("_y > greatest(_lo, _lo2) and _y < least(_hi, _hi2)").select("_key", "_y")
    heights = edges.select("_key", F.explode(F.array("_lo", "_hi")).alias("_y")).unionByName(crossing).distinct()
    slabs = heights.withColumn("_y1", F.lead("_y").over(Window.partitionBy("_key").orderBy("_y"))).where("_y1 is not null")
    parts = slabs.join(edges.select("_key", "_f", "_lo", "_hi", "_slope", "_x0"), "_key").where("_lo <= _y and _hi >= _y1").select("_key", "_y", "_f", (F.col("_y1") - F.col("_y")).alias("_h"), (F.col("_x0") + F.col("_slope") * (F.col("_y") + F.col("_y1")) / 2).alias("_x"))
    parts = parts.repartition("_key", "_y")
    slab = Window.partitionBy("_key", "_y")
    entering = F.when(F.row_number().over(Window.partitionBy("_key", "_y", "_f").orderBy("_x")) % 2 == 1, 1).otherwise(-1)
    along = slab.orderBy("_x", F.col("_f").asc_nulls_first())
    parts = parts.withColumn("_d", entering)
    under = parts.withColumns({
        "_in": F.sum(F.when(F.col("_f").isNull(), F.col("_d")).otherwise(0)).over(along),
        "_n": F.sum(F.when(F.col("_f").isNotNull(), F.col("_d")).otherwise(0)).over(along),
        "_w": (F.lead("_x").over(along) - F.col("_x")) * F.col("_h"),
    }).where("_in > 0")
    shares = under.groupBy(F.col("_key").alias(key)).agg(F.round(F.least(F.lit(1.0), F.sum(F.when(F.col("_n") > 0, F.col("_w")).otherwise(0.0)) / F.sum("_w")), digits).alias("coverage"))
    return keys.join(shares, keys[key].eqNullSafe(shares[key]), "left").select(keys[key], "coverage")
