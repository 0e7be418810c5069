"""Station readings: pivots, collocation, inverse-distance interpolation and its validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cut
from .spatial import around, nearest_sites
from .temporal import micros
from .validation import metric_columns


def pivot_readings(readings: DataFrame, parameters: Sequence[str], *, order: str) -> DataFrame:
    """station_id, ts and a column for each parameter; the last reading of a time wins."""
    last = [F.max_by("value", F.when(F.col("parameter") == p, F.col(order))).alias(p) for p in parameters]
    return readings.groupBy("station_id", "ts").agg(*last)


def first_readings(readings: DataFrame, order: str | None = None) -> DataFrame:
    """station_id, ts, value: of several readings at one time the first by `order` (without one the smallest value)."""
    good = readings.where("value is not null")
    return good.groupBy("station_id", "ts").agg((F.min_by("value", order) if order else F.min("value")).alias("value"))


def answers(readings: DataFrame, tolerance_us: int, *, order: str | None = None) -> DataFrame:
    """station_id, value, _low, _high and _bucket: the interval of times for which a reading is the nearest of its station's.

    Of two readings equally near the earlier answers. An interval is a row in each
    of the buckets, an eighth of the tolerance wide, that it meets.
    """
    t = F.col("_t")
    by_time = Window.partitionBy("station_id").orderBy("_t")
    rows = first_readings(readings, order).withColumn("_t", micros("ts"))
    low = F.greatest(F.coalesce(F.floor((F.lag(t).over(by_time) + t) / 2).cast("long") + 1, t - tolerance_us), t - tolerance_us)
    high = F.least(F.coalesce(F.floor((t + F.lead(t).over(by_time)) / 2).cast("long"), t + tolerance_us), t + tolerance_us)
    bucket = lambda c: F.floor(F.col(c) / bucket_width(tolerance_us)).cast("long")
    return rows.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_bucket", F.explode(F.sequence(bucket("_low"), bucket("_high")))).select("station_id", "value", "_low", "_high", "_bucket")


def bucket_width(tolerance_us: int) -> int:
    return max(1, tolerance_us // 8)


def answered(known: DataFrame, times: DataFrame, tolerance_us: int) -> DataFrame:
    """station_id, scene, value of `answers` at times (scene, or station_id and scene); a station and time meet in one row.

    Intervals in buckets are many more than their readings, which Spark's estimates
    don't see: they are never what is broadcast. Scenes by themselves are few.
    """
    own = ["station_id"] if "station_id" in times.columns else []
    asked = times.select(*own, "scene").where("scene is not null").distinct().withColumn("_s", micros("scene")).withColumn("_bucket", F.floor(F.col("_s") / bucket_width(tolerance_us)).cast("long"))
    asked = asked.hint("merge") if own else F.broadcast(asked)
    return known.join(asked, [*own, "_bucket"]).where(F.col("_s").between(F.col("_low"), F.col("_high"))).select("station_id", "scene", "value")


def reading_at(readings: DataFrame, times: DataFrame, tolerance_us: int, *, order: str | None = None) -> DataFrame:
    """station_id, scene, value: each station's nearest reading to each scene time within a tolerance, the earlier on ties.

    `times` has scene, or station_id and scene where each station is asked for its
    own times.
    """
    return answered(answers(readings, tolerance_us, order=order), times, tolerance_us)


def interpolate(cells: DataFrame, stations: DataFrame, at_times: DataFrame, *, max_distance: float, min_neighbours: int = 3, max_neighbours: int = 12, power: float = 2.0) -> DataFrame:
    """scene, iy, ix, value, station_count, uncertainty, valid by inverse distance weighting, for scenes with a reading.

    The radius decides how many stations support a cell; the weights are those of
    the nearest `max_neighbours` of all stations with a reading. A cell at a station
    takes the mean of the stations there, with uncertainty 0. Stations in reach are
    counted first, by buckets; nearest ones are looked for only where enough are.
    """
    by = ["scene", "iy", "ix"]
    sites = at_times.join(stations.select("station_id", F.col("x").alias("sx"), F.col("y").alias("sy")), "station_id").select("scene", "station_id", "sx", "sy", "value")
    sites = cut(sites)  # a row a station and scene, read several times
    scenes = sites.groupBy("scene").agg(F.count("*").alias("_sites"))
    frame = scenes.crossJoin(cells.select("iy", "ix", "x", "y")).drop("_sites")  # the rows of the result
    support = around(frame, sites, max_distance, keys=["scene"]).where(F.col("d2") <= max_distance * max_distance).groupBy(*by).agg(F.count("*").alias("station_count"))
    enough = frame.join(support.where(F.col("station_count") >= min_neighbours).select(*by), by, "left_semi")
    near = nearest_sites(enough, sites, "x", "y", max_neighbours, cell_keys=by, site_key="station_id", keys=["scene"], places=cells)
    d, v = F.col("distance"), F.col("value")
    w = F.when(d > 0, F.lit(1.0) / F.pow(d, F.lit(power)))
    sums = near.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"), F.avg(F.when(d == 0, v)).alias("here"))
    mean = F.col("wv") / F.col("w")
    spread = F.sqrt(F.greatest(F.col("wvv") / F.col("w") - mean * mean, F.lit(0.0)))
    out = frame.select(*by).join(support, by, "left").join(sums, by, "left").withColumn("station_count", F.coalesce("station_count", F.lit(0)))
    return out.select(*by, F.coalesce("here", mean).alias("value"), "station_count", F.when(F.col("here").isNotNull(), 0.0).otherwise(spread).alias("uncertainty"), (F.col("station_count") >= min_neighbours).alias("valid"))


def near_lists(places: DataFrame, sites: DataFrame, k: int, reach: float) -> DataFrame:
    """px, py, near and whole: the first k sites (other, sx, sy) within reach of each place, by distance and name.

    `whole` says that there are no more. Sites that share a place are as near as each
    other: of a place the first k names count, and only of places that have fewer
    than k sites before them. So the rows are k a place, not sites times sites.
    """
    by_name = Window.partitionBy("sx", "sy").orderBy("other")
    members = sites.where("sx is not null and sy is not null").withColumn("_m", F.row_number().over(by_name)).where(F.col("_m") <= k).drop("_m")
    spots = members.groupBy("sx", "sy").agg(F.min("other").alias("_name"), F.count("*").alias("_c"))
    dx, dy = F.col("px") - F.col("sx"), F.col("py") - F.col("sy")
    met = nearest_sites(places, spots, "px", "py", k, cell_keys=["px", "py"], site_key="_name", places=spots.select(F.col("sx").alias("px"), F.col("sy").alias("py")))
    met = met.where(dx * dx + dy * dy <= reach * reach).select("px", "py", "sx", "sy", "_c", F.sqrt(dx * dx + dy * dy).alias("d"))
    upto = Window.partitionBy("px", "py").orderBy("d")  # with those as near
    met = met.withColumn("_before", F.sum("_c").over(upto) - F.sum("_c").over(Window.partitionBy("px", "py", "d"))).where(F.col("_before") < k)
    order = Window.partitionBy("px", "py").orderBy("d", "other")
    ranked = met.join(members, ["sx", "sy"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.groupBy("px", "py").agg(F.array_sort(F.collect_list(F.struct("place", "other", "d"))).alias("near")).withColumn("whole", F.size("near") < k)


def leave_one_out(readings: DataFrame, stations: DataFrame, *, tolerance_us: int, max_distance: float, min_neighbours: int = 3, max_neighbours: int = 12, power: float = 2.0, order: str | None = None) -> DataFrame:
    """station_id, ts, predicted, observed: each reading predicted from the other stations in the radius.

    Stations at one place have the same neighbours but for themselves, so places and
    times ask, once for all readings there. Most find enough among the nearest
    stations; the others, and only they, ask four times as many in the next round,
    until enough answer or all in the radius were asked.
    """
    good = first_readings(readings, order)
    at = stations.select("station_id", F.col("x").alias("px"), F.col("y").alias("py")).where("px is not null and py is not null")
    sites = at.select(F.col("station_id").alias("other"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    listed = at.groupBy("station_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # rows of one station, usually one
    spare = max_neighbours + listed  # one's own rows go
    by = ["px", "py", "ts"]
    left, k, done = good.join(at, "station_id").select(*by).distinct(), 3 * max_neighbours + listed, []
    while True:
        lists = near_lists(left.select("px", "py").distinct() if done else at.select("px", "py").distinct(), sites, k, max_distance)
        asked = left.join(lists, ["px", "py"]).select(*by, "whole", F.explode("near").alias("e")).select(*by, "whole", "e.*")
        times = asked.select(F.col("other").alias("station_id"), F.col("ts").alias("scene"))
        known = answers(good.join(lists.select(F.explode("near.other").alias("station_id")).distinct(), "station_id", "left_semi"), tolerance_us)
        found = answered(known, times, tolerance_us).select(F.col("station_id").alias("other"), F.col("scene").alias("ts"), F.col("value").alias("v"))
        # counted by whether they answer: those without an answer come last
        first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("v").isNull(), "place"))
        ranked = asked.join(found.hint("merge"), ["other", "ts"], "left").withColumn("_r", first).where(F.col("_r") <= spare)
        near = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("d", "other", "place", "v"))))
        top = cut(ranked.groupBy(*by).agg(near.alias("near"), F.first("whole").alias("whole")).withColumn("_enough", F.col("whole") | (F.size("near") >= spare)))
        done.append(top.where("_enough").select(*by, "near"))
        left, k = top.where("not _enough").select(*by), 4 * k
        if left.isEmpty():
            break
    answers_at = done[0]
    for more in done[1:]:
        answers_at = answers_at.unionByName(more)
    others = F.filter("near", lambda e: e["other"] != F.col("station_id"))
    out = good.join(at, "station_id").join(answers_at.hint("merge"), by).select("station_id", "ts", F.col("value").alias("observed"), others.alias("near"))
    if listed > 1:
        out = out.groupBy("station_id", "ts").agg(F.first("observed").alias("observed"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    out = out.withColumn("near", F.slice("near", 1, max_neighbours)).where(F.size("near") >= min_neighbours)
    w = lambda e: F.lit(1.0) / F.pow(F.greatest(e["d"], F.lit(1.0)), F.lit(power))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda acc, e: acc + f(e))
    return out.select("station_id", "ts", (total(lambda e: w(e) * e["v"]) / total(w)).alias("predicted"), "observed")


def station_metrics(predictions: DataFrame, readings: DataFrame) -> DataFrame:
    """Metrics and coverage by station; stations without a supported reading have samples 0."""
    total = readings.where("value is not null").groupBy("station_id").agg(F.countDistinct("ts").alias("readings"))
    found = predictions.groupBy("station_id").agg(*metric_columns(F.col("predicted"), F.col("observed")))
    out = total.join(found, "station_id", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return out.withColumn("coverage_fraction", F.col("samples") / F.col("readings")).drop("correlation", "readings")


def collocate(cube: DataFrame, stations: DataFrame, readings: DataFrame, value: str, *, row: Column, col: Column, inside: Column, tolerance_us: int = 3_600_000_000) -> DataFrame:
    """Metrics of a cube at stations: nearest cell, nearest reading; a row for every station.

    `row` and `col` are the station's cell; stations outside have samples 0 and a note.
    """
    placed = stations.withColumn("_in", inside).withColumn("iy", row.cast("int")).withColumn("ix", col.cast("int"))
    values = cube.select("scene", "iy", "ix", F.col(value).alias("estimate")).join(placed.where("_in").select("station_id", "iy", "ix"), ["iy", "ix"]).where("estimate is not null")
    at = reading_at(readings, cube.select("scene"), tolerance_us)
    metrics = values.join(at.withColumnRenamed("value", "observed"), ["station_id", "scene"]).groupBy("station_id").agg(*metric_columns(F.col("estimate"), F.col("observed")))
    note = F.when(~F.col("_in"), "outside the grid").when(F.coalesce("samples", F.lit(0)) == 0, "no matching reading")
    return placed.select("station_id", "_in").join(metrics, "station_id", "left").select("station_id", F.coalesce("samples", F.lit(0)).alias("samples"), "bias", "mae", "rmse", "correlation", note.alias("note"))


def nearest_stations(cells: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """The k nearest stations of every cell."""
    return nearest_sites(cells, stations.select("station_id", F.col("x").alias("sx"), F.col("y").alias("sy")), "x", "y", k, cell_keys=["iy", "ix"], site_key="station_id")

