"""Chunked arrays and the cache."""

import datetime as dt
import json
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.grid import Grid
from geoloom.sources import chunks, sinks, stores

DAY = dt.datetime
GRID = Grid("EPSG:32633", 1000.0, 9000.0, 100.0, 37, 23)


def cube(spark, days, kind="timestamp"):
    rng = np.random.default_rng(len(days))
    rows = []
    for d in days:
        for i in range(GRID.height):
            for j in range(GRID.width):
                u = rng.uniform()
                if u > 0.3:
                    rows.append((DAY(2024, 1, d, 5, 6, 7, 891), i, j, None if u < 0.35 else float(u), bool(u > 0.6), int(u * 1000), None if u < 0.9 else 7))
    return spark.createDataFrame(rows, "scene timestamp, iy int, ix int, lst double, valid_mask boolean, flags bigint, rare int").withColumn("scene", F.col("scene").cast(kind))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_round_trip_and_append(spark, tmp_path, kind):
    path = f"file://{tmp_path}/store"
    first, second = cube(spark, [3, 1], kind), cube(spark, [2], kind)
    assert chunks.write_chunks(first, path, GRID, chunk=16) == 2
    assert chunks.write_chunks(second, path, GRID) == 3
    back = chunks.read_chunks(spark, path)
    assert back.dtypes == first.dtypes
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, first.unionByName(second).collect()), key=str)
    with pytest.raises(ValueError, match="has some"):
        chunks.write_chunks(second, path, GRID)
    with pytest.raises(ValueError, match="holds"):
        chunks.write_chunks(cube(spark, [9], kind).drop("rare"), path, GRID)
    assert chunks.read_chunks(spark, path, ["lst"]).columns == ["scene", "iy", "ix", "lst"]


def test_whole_numbers_are_exact(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    t = DAY(2024, 1, 1)
    rows = [(t, 0, 0, (1 << 63) - 1, -(1 << 31), -(1 << 15), -128, 0.5), (t, 0, 1, (1 << 53) + 1, (1 << 31) - 1, (1 << 15) - 1, 127, None), (t, 3, 2, 1 - (1 << 63), None, None, None, None), (t, 4, 4, None, None, 0, None, None)]
    wide = spark.createDataFrame(rows, "scene timestamp, iy int, ix int, a bigint, b int, c smallint, d tinyint, e float")
    chunks.write_chunks(wide, path, GRID, chunk=16)
    back = chunks.read_chunks(spark, path)
    assert back.dtypes == wide.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert json.loads((tmp_path / "store/a/.zarray").read_text())["dtype"] == "<i8"
    with pytest.raises(Exception, match="missing value of a"):
        chunks.write_chunks(wide.withColumns({"scene": F.lit(DAY(2024, 1, 2)), "a": F.lit(-(1 << 63))}), path, GRID)
    assert chunks.read_chunks(spark, path).count() == len(rows)  # a failed append adds no scene


def test_layout_is_the_public_one(spark, tmp_path):
    chunks.write_chunks(cube(spark, [1, 2]).select("scene", "iy", "ix", "lst"), f"file://{tmp_path}/s", GRID, chunk=16, attributes={"title": "x", "none": None})
    about = json.loads((tmp_path / "s/lst/.zarray").read_text())
    assert (about["zarr_format"], about["shape"], about["chunks"], about["dtype"], about["fill_value"], about["compressor"]["id"]) == (2, [2, 23, 37], [1, 16, 16], "<f8", "NaN", "zlib")
    assert json.loads((tmp_path / "s/lst/.zattrs").read_text()) == {"_ARRAY_DIMENSIONS": ["time", "y", "x"]} and json.loads((tmp_path / "s/.zgroup").read_text()) == {"zarr_format": 2}
    assert json.loads((tmp_path / "s/.zattrs").read_text())["title"] == "x"
    assert sorted(p.name for p in (tmp_path / "s/lst").iterdir() if p.name[0] != ".") == [f"{t}.{a}.{b}" for t in range(2) for a in range(2) for b in range(3)]
    x = np.frombuffer(zlib.decompress((tmp_path / "s/x/0").read_bytes()))
    assert len(x) == 37 and x[0] == 1050.0
    whole = np.frombuffer(zlib.decompress((tmp_path / "s/lst/0.0.0").read_bytes())).reshape(16, 16)
    rows = {(r.iy, r.ix): r.lst for r in cube(spark, [1, 2]).where("day(scene) = 1").collect()}
    assert all(rows.get((i, j)) == (None if np.isnan(whole[i, j]) else whole[i, j]) for i in range(16) for j in range(16))


def test_filters_drop_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    chunks.write_chunks(cube(spark, [1, 2, 3]).select("scene", "iy", "ix", "lst"), path, GRID, chunk=8)
    reader = chunks.FilteredReader(path, chunks.ChunkSource({"path": path}).about())
    assert len(reader.partitions()) == 3 * 3 * 5
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    kept = list(reader.pushFilters([EqualTo(("scene",), DAY(2024, 1, 2, 5, 6, 7, 891)), GreaterThan(("iy",), 9), LessThanOrEqual(("ix",), 15)]))
    assert len(kept) == 3 and {(p.t, p.cy, p.cx) for p in reader.partitions()} == {(1, a, b) for a in (1, 2) for b in (0, 1)}
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = chunks.read_chunks(spark, path).where("iy >= 16 and ix < 8")
        assert some.rdd.getNumPartitions() == 3
        assert {(r.iy, r.ix) for r in some.collect()} <= {(i, j) for i in range(16, 23) for j in range(8)}
        assert some.count() == cube(spark, [1, 2, 3]).where("iy >= 16 and ix < 8 and lst is not null").count()
        assert chunks.read_chunks(spark, path).where("scene > '2030-01-01'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_many_chunks_share_partitions(spark, tmp_path, monkeypatch):
    """3 scenes of 23 * 37 chunks of a cell: runs of chunks that end within rows and scenes."""
    path = f"file://{tmp_path}/store"
    days = cube(spark, [1, 2, 3]).select("scene", "iy", "ix", "lst", "flags")
    chunks.write_chunks(days, path, GRID, chunk=1)
    reader = chunks.FilteredReader(path, chunks.ChunkSource({"path": path}).about())
    assert len(reader.partitions()) <= chunks.PARTS and sum(p.n for p in reader.partitions()) == 3 * 23 * 37
    back = chunks.read_chunks(spark, path)
    assert back.rdd.getNumPartitions() <= chunks.PARTS
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, days.collect()), key=str)
    from pyspark.sql.datasource import GreaterThan, In

    monkeypatch.setattr(chunks, "PARTS", 7)
    list(reader.pushFilters([GreaterThan(("iy",), 4), In(("ix",), (1, 5, 30, 36)), In(("scene",), (DAY(2024, 1, 1, 5, 6, 7, 891), DAY(2024, 1, 3, 5, 6, 7, 891)))]))
    assert len(reader.partitions()) == 7
    found = [c for p in reader.partitions() for c in reader.chunks_of(*stores.open_store(path), p)]
    assert [(t, cy, cx) for t, _, cy, cx in found] == [(t, i, j) for t in (0, 2) for i in range(5, 23) for j in (1, 5, 30, 36)]


def test_two_writers_one_table(spark, tmp_path):
    folder, made, results = f"file://{tmp_path}/cache", [], []
    gate = threading.Barrier(2)

    def make(k):
        made.append(k)
        gate.wait(60)
        return spark.range(1000).withColumn("by", F.lit(k))

    def run(k):
        results.append(sinks.cached(spark, folder, {"a": 1}, lambda: make(k)).groupBy("by").count().collect())

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [0, 1] and results[0] == results[1] and results[0][0]["count"] == 1000 and len(results[0]) == 1
    assert len([p for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")]) == 1
    assert sinks.cached(spark, folder, {"a": 1}, lambda: 1 / 0).count() == 1000


def test_manifest_is_replaced_in_one_step(spark, tmp_path):
    spark.range(10).write.parquet(f"file://{tmp_path}/t")
    now = sinks.manifest(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        sinks.record(spark, f"file://{tmp_path}", now)
    assert sinks.changed_files(now, sinks.recorded(spark, f"file://{tmp_path}")).count() == 0
    assert sinks.changed_files(now, sinks.recorded(spark, f"file://{tmp_path}").withColumn("sha256", F.lit("x"))).count() == now.count() > 0
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []
    assert stores.qualified(spark, "/a") == "file:/a"
