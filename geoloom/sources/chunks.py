"""Cubes as chunked arrays (Zarr, format 2): written, appended to and read in parallel, a chunk a file.

A store is a folder an array and small JSON files beside them. Arrays have the
dimensions time, y and x, chunks one scene deep; chunks are zlib-compressed, the last
of a row or column is padded. Chunks of a scene are written before the metadata that
counts it, so a reader sees whole scenes only, and a task that runs again writes the
same files. Cells without any value are not rows when read.
"""

from __future__ import annotations

import datetime as dt
import json
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..grid import Grid
from ..operators.spatial import apart
from .sinks import safe_attributes
from .stores import get, open_store, put, qualified

DIMENSIONS = ("time", "y", "x")
COMPRESSOR = {"id": "zlib", "level": 1}
EPOCH = dt.datetime(1970, 1, 1)
MICROSECOND = dt.timedelta(microseconds=1)
#: Spark types that arrays hold, with the array's type and what stands for a missing value: no value of a narrower type.
LEAST = -(1 << 63)
KINDS = {"double": ("<f8", "NaN"), "float": ("<f4", "NaN"), "boolean": ("|i1", -1), "tinyint": ("<i2", -(1 << 15)), "smallint": ("<i4", -(1 << 31)), "int": ("<i8", LEAST), "bigint": ("<i8", LEAST)}
#: Up to so many chunks a partition each is read; of more, a partition reads several, of so many cells and files at most.
PARTS, PART_CELLS, PART_FILES = 256, 1 << 20, 4096
#: Cells that are made rows at once.
BATCH = 1 << 16


def kinds_of(fs, root: str, types: dict[str, str]) -> dict[str, tuple]:
    """Each variable's array type and missing value, as the store has them, or else as its Spark type asks."""
    out = {}
    for v, kind in types.items():
        about = get(fs, f"{root}/{v}/.zarray")
        out[v] = KINDS[kind] if about is None else (json.loads(about)["dtype"], json.loads(about)["fill_value"])
    return out


def filled(name: str, dtype: str, fill) -> Column:
    """A column as numbers of the array, without NULL; a value that means a missing one is an error."""
    if "f" in dtype:
        return F.coalesce(F.col(name).cast("double"), F.lit(float("nan"))).alias(name)
    value = F.col(name).cast("bigint")
    return F.when(value == fill, F.raise_error(F.lit(f"{fill} stands for a missing value of {name}")).cast("bigint")).otherwise(F.coalesce(value, F.lit(fill))).alias(name)


def missing(values: np.ndarray, fill) -> np.ndarray:
    return np.isnan(values) if values.dtype.kind == "f" else values == fill


def encoded(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), COMPRESSOR["level"])


def metadata(shape: Sequence[int], chunks: Sequence[int], dtype: str, fill) -> bytes:
    return json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": COMPRESSOR, "fill_value": fill, "order": "C", "filters": None}).encode()


def times_of(fs, root: str) -> np.ndarray:
    """Scenes of a store in microseconds since 1970, in the store's order."""
    about = get(fs, f"{root}/time/.zarray")
    if about is None:
        return np.zeros(0, np.int64)
    n = json.loads(about)["shape"][0]
    return np.frombuffer(zlib.decompress(get(fs, f"{root}/time/0")), "<i8")[:n]


def micros_of(scene) -> int:
    if isinstance(scene, dt.datetime):
        return (scene.replace(tzinfo=None) - EPOCH) // MICROSECOND
    return (dt.datetime(scene.year, scene.month, scene.day) - EPOCH) // MICROSECOND


def write_chunks(cube: DataFrame, path: str, grid: Grid, values: Sequence[str] | None = None, *, chunk: int = 256, attributes: dict | None = None) -> int:
    """Write a cube's scenes (scene, iy, ix, values) to a store, after those that it has; the number of scenes there.

    A scene that the store has is refused, as is a store on another grid or with
    other variables, and the least bigint, which stands for a missing value. The driver sees the scenes' times; a task holds a chunk.
    """
    spark = cube.sparkSession
    types = dict(cube.dtypes)
    values = list(values or (c for c in cube.columns if c not in ("scene", "iy", "ix")))
    unknown = [v for v in values if types[v] not in KINDS]
    if unknown:
        raise ValueError(f"arrays cannot hold {unknown}")
    uri = qualified(spark, path)
    fs, root = open_store(uri)
    had = times_of(fs, root)
    about = get(fs, f"{root}/.zattrs")
    if about is not None:
        known = json.loads(about)
        if known["grid"] != grid.grid_id or sorted(known["variables"]) != sorted(values):
            raise ValueError(f"the store holds {sorted(known['variables'])} on {known['grid']}")
        chunk = known["chunk"]
    else:
        known = {"grid": grid.grid_id, "crs": grid.crs, "resolution": grid.resolution, "chunk": chunk, "variables": {v: types[v] for v in values}, "scene": types["scene"], **safe_attributes(attributes or {})}
    at = F.col("scene")
    # a time without a zone, or a date, counts as it reads
    micros = F.unix_micros(at) if types["scene"] == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), at.cast("timestamp_ntz"))
    rows = cube.withColumn("_micros", micros)
    new = np.array(sorted(r[0] for r in rows.select("_micros").distinct().collect()), np.int64)  # a number a scene
    if np.isin(new, had).any():
        raise ValueError("the store has some of these scenes")
    fs.create_dir(root, recursive=True)
    for v in values:
        fs.create_dir(f"{root}/{v}", recursive=True)
    place = spark.createDataFrame([(int(m), len(had) + k) for k, m in enumerate(new)], "_micros long, _t int")
    kinds = kinds_of(fs, root, {v: types[v] for v in values})
    keyed = rows.join(F.broadcast(place), "_micros").select("_t", F.expr(f"iy div {chunk}").cast("int").alias("_cy"), F.expr(f"ix div {chunk}").cast("int").alias("_cx"), "iy", "ix", *(filled(v, *kinds[v]) for v in values))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their chunks; one chunk is held, which may go on in the next batch."""
        store, at = open_store(uri)
        here, blocks = None, {}

        def close() -> None:
            for v, block in blocks.items():
                put(store, f"{at}/{v}/{'.'.join(map(str, here))}", encoded(block))

        for batch in batches:
            t, cy, cx, iy, ix = (batch.column(c).to_numpy() for c in ("_t", "_cy", "_cx", "iy", "ix"))
            cells = {v: batch.column(v).to_numpy() for v in kinds}
            starts = np.flatnonzero((np.diff(t) != 0) | (np.diff(cy) != 0) | (np.diff(cx) != 0)) + 1
            for lo, hi in zip([0, *starts], [*starts, len(t)]) if len(t) else ():
                if here != (key := (int(t[lo]), int(cy[lo]), int(cx[lo]))):
                    close()
                    here, blocks = key, {v: np.full((chunk, chunk), float(fill) if "f" in dtype else fill, dtype) for v, (dtype, fill) in kinds.items()}
                for v, block in blocks.items():
                    block[iy[lo:hi] - key[1] * chunk, ix[lo:hi] - key[2] * chunk] = cells[v][lo:hi]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(t)], pa.int64())})
        close()

    by = ["_t", "_cy", "_cx"]
    apart(keyed, *by).sortWithinPartitions(*by).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    every = np.append(had, new)
    put(fs, f"{root}/.zgroup", b'{"zarr_format": 2}')
    coordinates = {"y": grid.top - (np.arange(grid.height) + 0.5) * grid.resolution, "x": grid.left + (np.arange(grid.width) + 0.5) * grid.resolution}
    for name, at in coordinates.items():
        fs.create_dir(f"{root}/{name}", recursive=True)
        put(fs, f"{root}/{name}/0", encoded(at.astype("<f8")))
        put(fs, f"{root}/{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": [name]}).encode())
        put(fs, f"{root}/{name}/.zarray", metadata([len(at)], [len(at)], "<f8", "NaN"))
    for v in values:
        put(fs, f"{root}/{v}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": list(DIMENSIONS)}).encode())
        put(fs, f"{root}/{v}/.zarray", metadata([len(every), grid.height, grid.width], [1, chunk, chunk], *kinds[v]))
    put(fs, f"{root}/.zattrs", json.dumps(known).encode())
    fs.create_dir(f"{root}/time", recursive=True)
    put(fs, f"{root}/time/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": ["time"], "units": "microseconds since 1970-01-01"}).encode())
    put(fs, f"{root}/time/0", encoded(every.astype("<i8")))
    put(fs, f"{root}/time/.zarray", metadata([len(every)], [max(1, len(every))], "<i8", None))  # last: it says how many scenes there are
    return len(every)


@dataclass
class Chunk(InputPartition):
    """The chunk (t, cy, cx) of a scene and, of those wanted, the n - 1 after it, which may go on in the scenes (t, micros) of `more`."""

    t: int
    micros: int
    cy: int
    cx: int
    n: int = 1
    more: tuple[tuple[int, int], ...] = ()


class ChunkSource(DataSource):
    """Format `geoloom_zarr`; options path and columns (comma-separated; without it all)."""

    @classmethod
    def name(cls) -> str:
        return "geoloom_zarr"

    def about(self) -> dict:
        fs, root = open_store(self.options["path"])
        found = get(fs, f"{root}/.zattrs")
        if found is None:
            raise ValueError(f"no store in {self.options['path']}")
        known = json.loads(found)
        if self.options.get("columns"):
            known["variables"] = {v: known["variables"][v] for v in self.options["columns"].split(",")}
        known["arrays"] = kinds_of(fs, root, known["variables"])
        return known

    def schema(self) -> str:
        known = self.about()
        return f"scene {known['scene']}, iy int, ix int, " + ", ".join(f"`{v}` {t}" for v, t in known["variables"].items())

    def reader(self, schema) -> ChunkReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else ChunkReader)(self.options["path"], self.about())


class ChunkReader(DataSourceReader):
    """Plans the chunks that filters on scene, iy and ix leave; a partition is a chunk, or a run of them if there are many."""

    def __init__(self, path: str, known: dict):
        self.path, self.known = path, known
        #: By column, the least and largest value asked for (times in microseconds), and the values if they are listed.
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.listed: dict[str, set[int]] = {}

    def wanted(self, column: str, first: int, last: int) -> bool:
        """Whether values from first to last may pass."""
        if self.low.get(column, first) > last or self.high.get(column, last) < first:
            return False
        return column not in self.listed or any(first <= v <= last for v in self.listed[column])

    def sides(self, fs, root: str) -> tuple[list[int], list[int]]:
        """Rows and columns of the wanted chunks."""
        side = self.known["chunk"]
        _, height, width = json.loads(get(fs, f"{root}/{next(iter(self.known['variables']))}/.zarray"))["shape"]
        rows, columns = ([k for k in range(-(-n // side)) if self.wanted(c, k * side, (k + 1) * side - 1)] for c, n in (("iy", height), ("ix", width)))
        return rows, columns

    def partitions(self) -> list[Chunk]:
        fs, root = open_store(self.path)
        rows, columns = self.sides(fs, root)
        scenes = [(t, int(m)) for t, m in enumerate(times_of(fs, root)) if self.wanted("scene", int(m), int(m))]
        each = len(rows) * len(columns)
        total = each * len(scenes)
        run = max(1, min(-(-total // PARTS), PART_CELLS // self.known["chunk"] ** 2, PART_FILES))
        out = []
        for first in range(0, total, run):
            n = min(run, total - first)
            within = scenes[first // each : (first + n - 1) // each + 1]
            out.append(Chunk(*within[0], rows[first % each // len(columns)], columns[first % len(columns)], n, tuple(within[1:])))
        return out or [Chunk(-1, 0, 0, 0)]

    def chunks_of(self, fs, root: str, part: Chunk) -> Iterator[tuple[int, int, int, int]]:
        """t, micros, cy and cx of a partition's chunks."""
        if part.n == 1:
            yield part.t, part.micros, part.cy, part.cx
            return
        rows, columns = self.sides(fs, root)
        each, scenes = len(rows) * len(columns), [(part.t, part.micros), *part.more]
        first = rows.index(part.cy) * len(columns) + columns.index(part.cx)
        for k in range(first, first + part.n):
            yield *scenes[k // each], rows[k % each // len(columns)], columns[k % len(columns)]

    def read(self, part: Chunk) -> Iterator[pa.RecordBatch]:
        if part.t < 0:
            return
        fs, root = open_store(self.path)
        side, kinds, stored = self.known["chunk"], self.known["variables"], self.known["arrays"]
        held: list[tuple[int, int, int, list[np.ndarray]]] = []
        for t, micros, cy, cx in self.chunks_of(fs, root, part):
            raw = []
            for v in kinds:
                raw.append(get(fs, f"{root}/{v}/{t}.{cy}.{cx}"))
                if raw[-1] is None:
                    break  # a chunk without a cell
            else:
                held.append((micros, cy, cx, [np.frombuffer(zlib.decompress(r), stored[v][0]).reshape(side, side) for v, r in zip(kinds, raw)]))
            if len(held) * side * side >= BATCH:
                yield self.rows_of(held)
                held = []
        if held:
            yield self.rows_of(held)

    def rows_of(self, held: list[tuple[int, int, int, list[np.ndarray]]]) -> pa.RecordBatch:
        """The cells of some chunks (micros, cy, cx, an array a variable) that have a value."""
        side, kinds, stored = self.known["chunk"], self.known["variables"], self.known["arrays"]
        arrays = {v: np.stack([h[3][k] for h in held]) for k, v in enumerate(kinds)}
        there = np.zeros((len(held), side, side), bool)
        for v in kinds:
            there |= ~missing(arrays[v], stored[v][1])
        which, iy, ix = np.nonzero(there)
        micros, cy, cx = (np.array([h[k] for h in held], np.int64)[which] for k in range(3))
        if self.known["scene"] == "date":
            scene = pa.array((micros // 86_400_000_000).astype(np.int32)).cast(pa.date32())
        else:
            scene = pa.array(micros).cast(pa.timestamp("us", "UTC") if self.known["scene"] == "timestamp" else pa.timestamp("us"))
        columns = [scene, pa.array((iy + cy * side).astype(np.int32)), pa.array((ix + cx * side).astype(np.int32))]
        to = {"double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}
        for v, kind in kinds.items():
            own = arrays[v][which, iy, ix]
            absent = missing(own, stored[v][1])
            columns.append(pa.array(np.where(absent, own.dtype.type(0), own), mask=absent).cast(to[kind]))
        return pa.RecordBatch.from_arrays(columns, ["scene", "iy", "ix", *kinds])


class FilteredReader(ChunkReader):
    """Takes filters; Spark lets a reader have the method only if it may push."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        number = lambda v: micros_of(v) if isinstance(v, dt.date) else int(v)
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("scene", "iy", "ix"):
                if isinstance(f, EqualTo | In):
                    asked = {number(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                    self.listed[column] = self.listed.get(column, asked) & asked
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):  # whole numbers, times in microseconds too
                    least = number(f.value) + isinstance(f, GreaterThan)
                    self.low[column] = max(self.low.get(column, least), least)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    most = number(f.value) - isinstance(f, LessThan)
                    self.high[column] = min(self.high.get(column, most), most)
            yield f  # chunks are dropped here, rows by Spark


def read_chunks(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The cells of a store; filters on scene, iy and ix drop chunks if `spark.sql.python.filterPushdown.enabled` is set."""
    spark.dataSource.register(ChunkSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("geoloom_zarr").option("path", qualified(spark, path)).option("pushdown", pushdown)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
