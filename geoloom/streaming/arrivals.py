"""Streams of arriving observations, beyond what batch requests need.

Windows close by watermark; results equal the batch operators' once they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_scene


def daily_composite(stream: DataFrame, value: str, *, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Mean and count by day and cell, final once the watermark has passed the day."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), "iy", "ix").agg(F.avg(value).alias(value), F.count(value).alias("valid_count")).select(F.col("day.start").alias("day"), "iy", "ix", value, "valid_count")


def first_arrivals(stream: DataFrame, key: str = "product_id", *, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each product once, with state bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def match_arrivals(target: DataFrame, features: DataFrame, tolerance: str, *, late: str = "1 day") -> DataFrame:
    """All feature scenes within the tolerance of each target scene (columns t_ts and f_ts); the nearest is picked downstream."""
    t, f = target.withWatermark("t_ts", late), features.withWatermark("f_ts", late)
    span = F.expr(f"f_ts >= t_ts - interval {tolerance} and f_ts <= t_ts + interval {tolerance} and t_iy = f_iy and t_ix = f_ix")
    return t.join(f, span)


def store_scenes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every finished micro-batch to a stored cube."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_scene(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
