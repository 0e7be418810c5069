"""Analysis grids and areas of interest: small frozen values on the driver.

A cube is a DataFrame keyed by (scene, iy, ix): a scene's time and the integer
row and column of a cell, counted from the north-west corner. A missing cell is
a cell without values. Coordinates are expressions of the grid, never join keys.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import projection


def utm_crs(lon: float, lat: float) -> str:
    """EPSG code of the UTM zone at a longitude and latitude."""
    zone = math.floor((lon + 180) / 6) % 60 + 1
    return f"EPSG:{(32600 if lat >= 0 else 32700) + zone}"


def extent(bounds: tuple[float, float, float, float], within: tuple[float, float, float, float] | None = None) -> tuple[float, float, float, float]:
    """(left, bottom, right, top), if it is finite, holds something and lies within what is given."""
    left, bottom, right, top = bounds
    if not all(map(math.isfinite, bounds)):
        raise ValueError(f"bounds must be finite: {bounds}")
    if left >= right or bottom >= top:
        raise ValueError(f"bounds are left, bottom, right, top with something between them: {bounds}")
    if within and (left < within[0] or bottom < within[1] or right > within[2] or top > within[3]):
        raise ValueError(f"{bounds} reaches beyond {within}; an area across the antimeridian is two")
    return bounds


#: West, south, east and north of the globe.
GLOBE = (-180.0, -90.0, 180.0, 90.0)


@dataclass(frozen=True)
class Area:
    """A WGS84 bounding box, with rings of a polygon if it has one."""

    west: float
    south: float
    east: float
    north: float
    rings: tuple[tuple[tuple[float, float], ...], ...] = ()

    def __post_init__(self):
        extent((self.west, self.south, self.east, self.north), GLOBE)

    @classmethod
    def from_geometry(cls, geometry: dict) -> Area:
        """From a GeoJSON Polygon, MultiPolygon, Feature or FeatureCollection."""
        rings = geometry_rings(geometry)
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        return cls(min(xs), min(ys), max(xs), max(ys), rings)

    @classmethod
    def from_geojson(cls, text: str) -> Area:
        return cls.from_geometry(json.loads(text))

    @classmethod
    def from_wkt(cls, text: str) -> Area:
        return cls.from_geometry({"type": "Polygon", "coordinates": wkt_rings(text)})

    def to_wkt(self) -> str:
        rings = self.rings or (((self.west, self.south), (self.east, self.south), (self.east, self.north), (self.west, self.north), (self.west, self.south)),)
        ring = lambda r: "(" + ", ".join(f"{x:.15g} {y:.15g}" for x, y in r) + ")"
        return "POLYGON (" + ", ".join(map(ring, rings)) + ")"


def wkt_rings(text: str) -> list[list[tuple[float, float]]]:
    """Rings of a POLYGON or MULTIPOLYGON in well-known text."""
    if not re.match(r"\s*(MULTI)?POLYGON\b", text, re.I):
        raise ValueError("only POLYGON and MULTIPOLYGON are understood")
    rings = re.findall(r"\(([^()]+)\)", text)
    return [[tuple(float(v) for v in p.split()[:2]) for p in r.split(",")] for r in rings]


def geometry_rings(geometry: dict) -> tuple[tuple[tuple[float, float], ...], ...]:
    """All rings of a GeoJSON geometry, closed; holes count by parity."""
    kind = geometry.get("type")
    if kind == "FeatureCollection":
        return tuple(r for f in geometry["features"] for r in geometry_rings(f))
    if kind == "Feature":
        return geometry_rings(geometry["geometry"])
    if kind == "Polygon":
        polygons = [geometry["coordinates"]]
    elif kind == "MultiPolygon":
        polygons = geometry["coordinates"]
    else:
        raise ValueError(f"not a polygon: {kind}")
    rings = []
    for polygon in polygons:
        for ring in polygon:
            points = [(float(p[0]), float(p[1])) for p in ring]
            if len(points) < 3:
                raise ValueError("a ring needs three points")
            rings.append(tuple(points if points[0] == points[-1] else [*points, points[0]]))
    return tuple(rings)


@dataclass(frozen=True)
class Grid:
    """A north-up grid whose bounds are multiples of its resolution."""

    crs: str
    left: float
    top: float
    resolution: float
    width: int
    height: int
    name: str = ""

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.left, self.top - self.height * self.resolution, self.left + self.width * self.resolution, self.top

    @property
    def grid_id(self) -> str:
        return self.name or f"{self.crs}:{self.resolution:g}m:" + ",".join(f"{v:g}" for v in self.bounds)

    @classmethod
    def from_bounds(cls, bounds: tuple[float, float, float, float], crs: str, resolution: float, name: str = "") -> Grid:
        """The smallest grid of whole cells, counted from the origin, that covers (left, bottom, right, top)."""
        if not resolution > 0:
            raise ValueError(f"a cell of {resolution} has no size")
        left, bottom, right, top = (v / resolution for v in extent(bounds))
        first, last = (math.floor(left), math.floor(bottom)), (math.ceil(right), math.ceil(top))
        return cls(crs, first[0] * resolution, last[1] * resolution, float(resolution), last[0] - first[0], last[1] - first[1], name)

    @classmethod
    def for_area(cls, area: Area, resolution: float, crs: str | None = None, name: str = "") -> Grid:
        """Grid around an area, in the UTM zone of its centre unless told otherwise."""
        crs = crs or utm_crs((area.west + area.east) / 2, (area.south + area.north) / 2)
        return cls.from_bounds(projection.project_bounds((area.west, area.south, area.east, area.north), crs), crs, resolution, name)

    def cells(self, spark: SparkSession) -> DataFrame:
        """iy, ix of every cell, made in parallel."""
        return spark.range(self.width * self.height).select(F.expr(f"cast(id div {self.width} as int)").alias("iy"), (F.col("id") % self.width).cast("int").alias("ix"))

    def x(self, ix: Column | str = "ix") -> Column:
        return F.lit(self.left) + (F.col(ix) if isinstance(ix, str) else ix) * self.resolution + self.resolution / 2

    def y(self, iy: Column | str = "iy") -> Column:
        return F.lit(self.top) - (F.col(iy) if isinstance(iy, str) else iy) * self.resolution - self.resolution / 2

    def column_of(self, x: Column) -> Column:
        return F.floor((x - self.left) / self.resolution).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.top) - y) / self.resolution).cast("int")

    def inside(self, iy: Column, ix: Column) -> Column:
        return iy.between(0, self.height - 1) & ix.between(0, self.width - 1)

    def chips(self, size: int, *, drop_partial: bool = True) -> list[Grid]:
        """Tiles of size x size cells, row by row; cells outside whole tiles are dropped or refused."""
        if not drop_partial and (self.width % size or self.height % size):
            raise ValueError("the grid is no whole multiple of the chip")
        return [Grid(self.crs, self.left + j * size * self.resolution, self.top - i * size * self.resolution, self.resolution, size, size, f"{self.grid_id}/{i}/{j}") for i in range(self.height // size) for j in range(self.width // size)]


#: Presets: area, time zone, UTM zone, default resolution in metres. Fixed values.
CITIES = {
    "berlin": (Area(13.20, 52.40, 13.55, 52.58), "Europe/Berlin", "EPSG:32633", 100),
    "guadalajara": (Area(-103.60, 20.50, -103.20, 20.85), "America/Mexico_City", "EPSG:32613", 100),
    "mexico-city": (Area(-99.35, 19.15, -98.95, 19.60), "America/Mexico_City", "EPSG:32614", 100),
    "lagos": (Area(2.70, 6.35, 3.70, 6.80), "Africa/Lagos", "EPSG:32631", 100),
    "nairobi": (Area(36.55, -1.45, 37.15, -1.05), "Africa/Nairobi", "EPSG:32737", 100),
}


def city(name: str) -> tuple[Area, str, str, int]:
    """Preset by name; case, blanks and underscores do not matter."""
    key = re.sub(r"[\s_]+", "-", name.strip().lower())
    if key not in CITIES:
        raise KeyError(f"unknown city {name!r}; known: {', '.join(CITIES)}")
    return CITIES[key]
