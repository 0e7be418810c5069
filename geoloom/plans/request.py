"""Declarative requests: what area, time, sensors and grid; validated when made, JSON both ways."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any

from ..grid import Area, Grid
from ..operators.temporal import DEFAULT_TOLERANCE_DAYS
from ..sources.sinks import AuxiliarySpec

#: Known sensors and the variables each gives. Fixed values.
SENSORS = {
    "sentinel1": ("sigma0_VV", "sigma0_VH", "VH_VV_ratio_dB", "RVI"),
    "sentinel2": ("NDVI", "EVI", "NDMI", "NDBI", "MNDWI"),
    "sentinel3": ("lst", "lst_uncertainty"),
    "sentinel5p": ("NO2", "SO2", "CO", "O3", "HCHO", "CH4"),
    "landsat": ("lst",),
    "ecostress": ("lst",),
}
THERMAL = ("sentinel3", "landsat", "ecostress")
OVERPASSES = ("any", "day", "night")
MODELS = ("linear", "tsharp", "random_forest", "gradient_boosting", "gwr", "local_trees")
CORRECTIONS = ("block", "smooth", "atpk")
#: Limits a request must keep: bytes, square kilometres. Fixed values.
MAX_BYTES, MAX_AREA_KM2 = 16 << 30, 10_000.0


def parse_bound(text: str, *, end: bool = False) -> datetime:
    """Naive UTC; a bare date as an end means its last microsecond."""
    value = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if value.tzinfo:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return value + timedelta(days=1, microseconds=-1) if end and len(text) == 10 else value


@dataclass(frozen=True)
class Downscaling:
    """How to sharpen the thermal cube."""

    predictors: tuple[str, ...] = ("NDVI",)
    model: str = "local_trees"
    correction: str = "block"
    factor: int = 10
    min_samples: int = 100
    sensor: str = "sentinel2"
    bandwidth: float = 5.0  #: of gwr, in coarse cells
    min_local: int = 10  #: of gwr, samples within the bandwidth

    def __post_init__(self):
        if self.model not in MODELS or self.correction not in CORRECTIONS:
            raise ValueError("unknown model or correction")
        if not self.predictors or self.factor < 2:
            raise ValueError("predictors and a factor of two or more are needed")


@dataclass(frozen=True)
class Request:
    area: Area
    start: str
    end: str
    sensors: tuple[str, ...]
    resolution: float = 1000.0
    fine_resolution: float | None = None  #: of sensors that see finer than the target; without one that of the grid the sharpening needs, else `resolution`
    target: str | None = None
    tolerance_days: dict[str, float] = field(default_factory=dict)
    overpass: str = "any"
    max_cloud: float | None = None
    min_coverage: float = 0.3
    min_clear_fraction: float = 0.0
    limit: int = 100
    downscaling: Downscaling | None = None
    on_product_error: str = "skip"
    auxiliary: tuple[AuxiliarySpec, ...] = ()

    def __post_init__(self):
        unknown = [s for s in self.sensors if s not in SENSORS]
        if unknown or not self.sensors:
            raise ValueError(f"unknown or no sensors: {unknown}")
        if parse_bound(self.start) > parse_bound(self.end, end=True):
            raise ValueError("the start lies after the end")
        if self.overpass not in OVERPASSES or self.resolution <= 0 or (self.fine_resolution or 1) <= 0 or self.limit < 1 or not 0 <= self.min_coverage <= 1 or not 0 <= self.min_clear_fraction <= 1:
            raise ValueError("a setting is out of range")
        if self.on_product_error not in ("skip", "raise"):
            raise ValueError("on_product_error is skip or raise")
        if self.target and self.target not in self.sensors:
            raise ValueError("the target is not among the sensors")
        if self.downscaling and self.downscaling.sensor not in self.sensors:
            raise ValueError("the predictors' sensor is not among the sensors")
        if self.downscaling and self.downscaling.sensor == self.target_sensor:
            raise ValueError("the predictors come from another sensor than the target")
        if self.downscaling and self.fine_resolution and abs(self.fine_resolution * self.downscaling.factor - self.resolution) > 1e-6 * self.resolution:
            raise ValueError(f"cells of {self.fine_resolution} do not nest {self.downscaling.factor} times in cells of {self.resolution}")

    @property
    def target_sensor(self) -> str:
        """The one asked for, else a thermal one, else the first."""
        return self.target or next((s for s in THERMAL if s in self.sensors), self.sensors[0])

    def tolerance(self, sensor: str) -> float:
        return self.tolerance_days.get(sensor, DEFAULT_TOLERANCE_DAYS)

    def grid(self) -> Grid:
        """The grid of the target and of what is fused."""
        return Grid.for_area(self.area, self.resolution)

    @property
    def nested_resolution(self) -> float:
        return self.resolution / self.downscaling.factor if self.downscaling else self.fine_resolution or self.resolution

    def grid_of(self, sensor: str) -> Grid:
        """The grid that a sensor's cube is on: that of the target, or for the predictors of a sharpening one nested in it."""
        coarse = self.grid()
        if not self.downscaling or sensor != self.downscaling.sensor:
            return coarse
        factor = self.downscaling.factor
        return Grid(coarse.crs, coarse.left, coarse.top, coarse.resolution / factor, coarse.width * factor, coarse.height * factor)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Request:
        data = dict(data)
        area = data.pop("area")
        rings = tuple(tuple(tuple(p) for p in r) for r in area.get("rings", ()))
        down = data.pop("downscaling", None)
        if down:
            down = Downscaling(**{**down, "predictors": tuple(down.get("predictors", ("NDVI",)))})
        data["sensors"] = tuple(data["sensors"])
        data["auxiliary"] = tuple(AuxiliarySpec(a["provider"], a["dataset"], tuple(a.get("variables", ())), tuple(map(tuple, a.get("options", ())))) for a in data.get("auxiliary", ()))
        return cls(area=Area(area["west"], area["south"], area["east"], area["north"], rings), downscaling=down, **data)

    @classmethod
    def from_json(cls, text: str) -> Request:
        return cls.from_dict(json.loads(text))


@dataclass(frozen=True)
class Step:
    sensor: str
    action: str
    variables: tuple[str, ...]


def build_plan(request: Request) -> list[Step]:
    """Steps in order: find and read each sensor, match it to the target, then fuse and sharpen."""
    steps = []
    for s in request.sensors:
        steps += [Step(s, "discover", ()), Step(s, "acquire", SENSORS[s]), Step(s, "grid", SENSORS[s])]
        if s != request.target_sensor:
            steps.append(Step(s, "align", SENSORS[s]))
    steps.append(Step(request.target_sensor, "fuse", ()))
    if request.downscaling:
        steps.append(Step(request.target_sensor, "downscale", request.downscaling.predictors))
    return steps


def area_km2(area: Area) -> float:
    """Area of the bounding box on the sphere."""
    import math

    band = math.sin(math.radians(area.north)) - math.sin(math.radians(area.south))
    return abs(math.radians(area.east - area.west) * band) * 6371.0088**2


def estimate_bytes(request: Request) -> int:
    """cells x products x variables x 8 over the sensors, each on its grid."""
    total = 0
    for s in request.sensors:
        side = request.resolution if s in THERMAL or s == "sentinel5p" else request.nested_resolution
        total += int(area_km2(request.area) * 1e6 / side**2) * request.limit * len(SENSORS[s]) * 8
    return total


def check_limits(request: Request, *, max_bytes: int = MAX_BYTES, max_area: float = MAX_AREA_KM2) -> None:
    """One error that lists every limit the request breaks."""
    broken = []
    if area_km2(request.area) > max_area:
        broken.append(f"area {area_km2(request.area):.0f} km2 is over {max_area:.0f}")
    if estimate_bytes(request) > max_bytes:
        broken.append(f"about {estimate_bytes(request) / 2**30:.1f} GiB is over {max_bytes / 2**30:.1f}")
    if broken:
        raise ValueError("; ".join(broken))
