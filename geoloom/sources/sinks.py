"""Writers: cubes, scenes as they come, zonal GeoJSON, result trees and manifests."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import publish


def safe_attributes(attributes: dict[str, Any]) -> dict[str, Any]:
    """Attributes a file can hold: None goes, booleans become 0 or 1, lists stay, the rest becomes text."""
    out: dict[str, Any] = {}
    for k, v in attributes.items():
        if v is None:
            continue
        out[k] = int(v) if isinstance(v, bool) else v if isinstance(v, int | float | str | list | tuple) else str(v)
    return out


def write_cube(cube: DataFrame, path: str, *, mode: str = "errorifexists", attributes: dict[str, Any] | None = None) -> None:
    """Parquet partitioned by the scenes' dates; times keep microseconds, NULL stays NULL.

    Attributes go to `_attributes.json` in the folder, in a form that any file can hold.
    """
    cube.withColumn("scene_date", F.col("scene").cast("date")).repartition("scene_date", F.pmod(F.hash("iy", "ix"), F.lit(16))).sortWithinPartitions("scene", "iy", "ix").write.partitionBy("scene_date").mode(mode).parquet(path)
    if attributes is not None:
        write_text(cube.sparkSession, f"{path}/_attributes.json", json.dumps(safe_attributes(attributes), sort_keys=True))


def append_scene(scene: DataFrame, path: str) -> None:
    """One more scene of a stored cube."""
    write_cube(scene, path, mode="append")


def zonal_geojson(statistics: DataFrame, zones: DataFrame, value: str) -> DataFrame:
    """One GeoJSON feature a row: properties `<value>_<minute>` of each scene; missing and non-finite are null.

    `zones` has zone, zone_id, geometry (GeoJSON text).
    """
    name = F.concat(F.lit(f"{value}_"), F.date_format("scene", "yyyy-MM-dd'T'HH:mm"))
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    pairs = statistics.select("zone", F.struct(name.alias("name"), finite.alias("v")).alias("p")).groupBy("zone").agg(F.array_sort(F.collect_list("p")).alias("p"))
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'^\{"x":(.*)\}$', 1)
    body = F.array_join(F.transform("p", lambda p: F.concat(quoted(p["name"]), F.lit(":"), F.coalesce(p["v"].cast("string"), F.lit("null")))), ",")
    props = F.concat(F.lit('{"id":'), quoted(F.col("zone_id")), F.when(F.size("p") > 0, F.concat(F.lit(","), body)).otherwise(""), F.lit("}"))
    joined = zones.join(pairs, "zone", "left")
    return joined.select("zone", F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.col("geometry"), F.lit("}")).alias("feature"))


def save_result(spark: SparkSession, cubes: dict[str, DataFrame], request: dict, provenance: dict, path: str) -> None:
    """One Parquet folder a cube, and request.json and provenance.json beside them."""
    for name, cube in cubes.items():
        cube.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, value in (("request", request), ("provenance", provenance)):
        write_text(spark, f"{path}/{name}.json", json.dumps(value, indent=1, sort_keys=True, default=str))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop's file system, so any store works; it takes the place of an older one in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target, staged = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), over)


def request_key(request: dict) -> str:
    """First 20 hex digits of SHA-256 of the request as sorted compact JSON."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:20]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified and sha256 of every file below a folder, computed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose digest is new or other than in an earlier manifest."""
    return now.join(before.select("path", F.col("sha256").alias("_old")), "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("sha256"))).drop("_old")


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table stored under the digest of its key; made and written on the first request only.

    It is written beside its place and gets its name when it is whole. Of two that
    write at a time one wins, and both read that one's table.
    """
    path = f"{folder}/{hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:40]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        staged = f"{path}.{uuid.uuid4().hex}.staged"
        make().write.parquet(staged)
        publish(spark, staged, path)
    return spark.read.parquet(path)


def record(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    """Replace a folder's manifest (`manifest`'s rows) in one step: readers see the old one or the new one."""
    rows = entries.toJSON().collect()  # a line a file
    write_text(spark, f"{folder}/manifest.json", "\n".join(sorted(rows)))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that `record` wrote."""
    return spark.read.schema("path string, length long, modified timestamp, sha256 string").json(f"{folder}/manifest.json")


#: Option names that may hold credentials and never reach a manifest. Fixed values.
SECRET_WORDS = ("password", "token", "secret", "key", "credential")


@dataclass(frozen=True)
class AuxiliarySpec:
    """What to ask of an auxiliary provider."""

    provider: str
    dataset: str
    variables: tuple[str, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()

    def __post_init__(self):
        named: Iterable[str] = (k.lower() for k, _ in self.options)
        if any(w in k for k in named for w in SECRET_WORDS):
            raise ValueError("options must not hold credentials")

    @property
    def key(self) -> str:
        return request_key({"provider": self.provider, "dataset": self.dataset, "variables": self.variables, "options": dict(self.options)})
