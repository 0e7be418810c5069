"""Requests to results: discover products, fuse sensors onto the target, sharpen, describe.

Everything returned is a lazy DataFrame; no cell reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import apply_quality, clear_class, radar_indices, reflectance, spectral_indices, to_celsius
from ..grid import Grid
from ..operators import binning, catalogue, downscale, forests, gwr, kriging, resample, temporal, trees
from ..sources import readers
from ..sources.sinks import AuxiliarySpec, save_result
from . import acquisition
from .acquisition import TableAdapter
from .request import Downscaling, Request, build_plan, check_limits

#: Columns that describe a cube and do not count as features.
DIAGNOSTICS = {"valid_mask", "feature_availability", "clear_observation_count", "lst_observation_count", "lst_invalid_observation_count", "source_footprint_count", "coverage_fraction", "no_observation_mask"}
TARGETS = {"lst", "surface_temperature"}
SUFFIXES = ("_time_delta_us", "_matched_time", "_station_count", "_interpolation_uncertainty", "_interpolation_valid")
KEYS = ("scene", "iy", "ix")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")

Adapter = Callable[[SparkSession, DataFrame, Request], DataFrame]
#: Readers by sensor: (spark, products, request) -> cube. `register_tables` fills them; plug-ins register here too.
ADAPTERS: dict[str, Adapter] = {}
#: Auxiliary providers: (spark, spec) -> table with scene, lon, lat and standard names. `register_provider` fills them.
PROVIDERS: dict[str, Callable[[SparkSession, Any], DataFrame]] = {}


def from_pixels(sensor: str, pixels: DataFrame, request: Request) -> DataFrame:
    """Raw pixels of one sensor (product_id, scene, lon, lat, raw columns) as a cube on the grid the request has for it."""
    grid = request.grid_of(sensor)
    return on_grid(pixels_to_cells(sensor, acquisition.parsed(pixels), request, grid), grid)


def on_grid(cube: DataFrame, grid: Grid) -> DataFrame:
    """The cube with its grid's id in the metadata of iy."""
    return cube.withColumn("iy", F.col("iy").alias("iy", metadata={"grid": grid.grid_id}))


def check_grid(sensor: str, cube: DataFrame, request: Request) -> None:
    """A cube that says which grid it is on must be on the one that the request has for its sensor."""
    said, due = cube.schema["iy"].metadata.get("grid"), request.grid_of(sensor).grid_id
    if said is not None and said != due:
        raise ValueError(f"the cube of {sensor} is on {said}; {due} is needed")


def pixels_to_cells(sensor: str, pixels: DataFrame, request: Request, grid: Grid) -> DataFrame:
    area = request.area
    raw = pixels.where(F.col("lon").between(area.west - SWATH_MARGIN, area.east + SWATH_MARGIN) & F.col("lat").between(area.south - SWATH_MARGIN, area.north + SWATH_MARGIN))
    if sensor == "sentinel3":
        masked = to_celsius(apply_quality(raw), units=raw.schema["lst"].metadata.get("units", "K"))
        flags = [c for c in ("exception_flags", "confidence_flags") if c in raw.columns]
        return resample.grid_points(masked, grid, [c for c in ("lst", "lst_uncertainty") if c in raw.columns], flags=flags).withColumnRenamed("lst_count", "lst_observation_count").drop("lst_uncertainty_count")
    if sensor == "sentinel2":
        bands = [b for b in ("B02", "B03", "B04", "B08", "B11", "B12") if b in raw.columns]
        offset = readers.baseline_offset(F.col("baseline")) if "baseline" in raw.columns else F.lit(0.0)
        clear = clear_class(F.col("SCL")) if "SCL" in raw.columns else F.lit(True)
        ready = raw.withColumns({b: F.when(clear, reflectance(F.col(b).cast("double"), offset)) for b in bands})
        means = resample.grid_points(ready, grid, bands)
        found = spectral_indices({b: F.col(b) if b in bands else F.lit(None).cast("double") for b in ("B02", "B03", "B04", "B08", "B11", "B12")})
        return means.select(*KEYS, *(c.alias(n) for n, c in found.items()), (F.col(f"{bands[0]}_count") > 0).alias("valid_mask"))
    if sensor == "sentinel1":
        means = resample.grid_points(readers.radar_bands(raw, ["VV", "VH"], scale="power"), grid, ["VV", "VH"])  # mean power before any logarithm
        found = radar_indices(F.col("VV"), F.col("VH"))
        return means.select(*KEYS, F.col("VV").alias("sigma0_VV"), F.col("VH").alias("sigma0_VH"), *(c.alias(n) for n, c in found.items()))
    if sensor == "sentinel5p":
        gas = next(g for g in readers.GASES if g in raw.columns)
        good = readers.gas_pixels(raw.withColumnRenamed(gas, "value")).where("valid")
        return resample.grid_points(good, grid, ["value"]).select(*KEYS, F.col("value").alias(gas))
    if sensor == "landsat":
        ready = readers.surface_temperature(raw, scale=LANDSAT_SCALE, offset=LANDSAT_OFFSET)
    else:
        ready = readers.cloudless_temperature(raw)
    return resample.grid_points(ready, grid, ["lst"]).withColumnRenamed("lst_count", "lst_observation_count")


#: Degrees about the area that a swath's pixels may lie in; scale and offset of surface temperature. Fixed values.
SWATH_MARGIN, LANDSAT_SCALE, LANDSAT_OFFSET = 0.1, 0.00341802, 149.0


def register_tables(tables: Mapping[str, DataFrame], registry: dict[str, Adapter] | None = None) -> None:
    """Adapters that read the discovered products' pixels from raw tables, one a sensor."""
    for sensor, table in tables.items():
        (ADAPTERS if registry is None else registry)[sensor] = TableAdapter(sensor, table)


def register_provider(provider: str, table: DataFrame, registry: dict[str, Callable] | None = None) -> None:
    """A provider of gridded auxiliary data (era5 or cams names) over a raw table; specs choose variables."""
    names = {"era5": readers.ERA5_NAMES, "cams": readers.CAMS_NAMES}.get(provider, {})

    def provide(spark: SparkSession, spec: AuxiliarySpec) -> DataFrame:
        out = readers.normalise_gridded(table, names)
        return out.select("scene", "lon", "lat", *(spec.variables or [v for v in names.values() if v in out.columns]))

    (PROVIDERS if registry is None else registry)[provider] = provide


#: Steps in degrees of providers' grids. Fixed values.
STEPS = {"era5": 0.25, "cams": readers.CAMS_STEPS["reanalysis"]}


def auxiliary_cubes(spark: SparkSession, request: Request) -> dict[str, DataFrame]:
    """The auxiliary data of a request on its grid, by provider."""
    out = {}
    for spec in request.auxiliary:
        table = PROVIDERS[spec.provider](spark, spec)
        step = float(dict(spec.options).get("step") or (readers.CAMS_STEPS.get(spec.dataset) if spec.provider == "cams" else None) or STEPS.get(spec.provider, 0.25))
        values = [c for c in table.columns if c not in ("scene", "lon", "lat")]
        out[spec.provider] = on_grid(resample.from_lattice(table, request.grid(), values, step), request.grid())
    return out


@dataclass
class Notes:
    """What an acquisition leaves out, and the clear shares that it knows and finds."""

    known_clear: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)
    failed_products: list[dict[str, str]] = field(default_factory=list)
    probed: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Result:
    fused: DataFrame
    thermal: DataFrame
    downscaled: DataFrame | None = None
    provenance: dict[str, Any] = field(default_factory=dict)
    probed: dict[str, DataFrame] = field(default_factory=dict)  #: by sensor, clear shares of the candidates and which were accepted

    def save(self, path: str, request: Request) -> None:
        cubes = {"fused": self.fused, "thermal": self.thermal} | ({"downscaled": self.downscaled} if self.downscaled is not None else {}) | {f"probed_{s}": df for s, df in self.probed.items()}
        save_result(self.fused.sparkSession, cubes, request.to_dict(), self.provenance, path)


def features_of(cube: DataFrame) -> list[str]:
    """Numeric columns that are features: no keys, targets or diagnostics."""
    return [c for c, t in cube.dtypes if t in NUMERIC and c not in KEYS and c not in DIAGNOSTICS and c not in TARGETS and not c.endswith(SUFFIXES)]


def fuse(cubes: Mapping[str, DataFrame], target: str, tolerances_days: Mapping[str, float] | None = None, *, cells: int | None = None) -> DataFrame:
    """The target cube with every other sensor's variables at the nearest time, and feature_availability.

    Clashing names get the sensor as prefix. Scene matching runs on scene times;
    each sensor adds one equi-join on (time, cell).
    """
    if target not in cubes:
        raise ValueError(f"no cube for the target {target}")
    out = cubes[target]
    for sensor, cube in cubes.items():
        if sensor == target:
            continue
        taken = set(out.columns) - set(KEYS)
        renamed = cube.select(*KEYS, *(F.col(c).alias(f"{sensor}_{c}" if c in taken or c == "valid_mask" else c) for c in cube.columns if c not in KEYS))
        values = [c for c in renamed.columns if c not in KEYS]
        out = temporal.align(out, renamed, values, tolerance_us=temporal.tolerance_us(sensor, dict(tolerances_days or {})), name=sensor)
    names = features_of(out)
    if not names:
        return out.withColumn("feature_availability", F.lit(None).cast("double"))
    return out.join(binning.availability(out, names, cells), "scene", "left")


def candidates(products: DataFrame, request: Request, sensor: str) -> DataFrame:
    """A sensor's products of the request's span, overpass and coverage."""
    from .request import parse_bound

    found = catalogue.search(products, start=F.lit(parse_bound(request.start)), end=F.lit(parse_bound(request.end, end=True)), sensor=sensor)
    found = catalogue.by_overpass(found, F.lit((request.area.west + request.area.east) / 2), request.overpass)
    if request.min_coverage > 0:
        found = found.where(F.coalesce("coverage", F.lit(0.0)) >= request.min_coverage)
    return found


def discover(products: DataFrame, request: Request, sensor: str) -> DataFrame:
    """The request's best products of a sensor, ranked."""
    return catalogue.best_products(candidates(products, request, sensor), request.limit, max_cloud=request.max_cloud)


Model = Callable[[DataFrame, DataFrame, Downscaling, str, tuple[int, int]], DataFrame]


def _linear(training: DataFrame, fine: DataFrame, spec: Downscaling, target: str, shape: tuple[int, int]) -> DataFrame:
    names = list(spec.predictors[:1] if spec.model == "tsharp" else spec.predictors)
    return downscale.predict_linear(fine.select(*KEYS, *names), downscale.fit_linear(training, target, names, min_samples=spec.min_samples), names)


def _local(training: DataFrame, fine: DataFrame, spec: Downscaling, target: str, shape: tuple[int, int]) -> DataFrame:
    weights = downscale.homogeneity_weights(fine, spec.predictors, spec.factor)
    return trees.local_trees(training, fine, target, spec.predictors, spec.factor, shape, min_samples=spec.min_samples, weights=weights)


def _ensemble(kind: str) -> Model:
    return lambda training, fine, spec, target, shape: forests.scene_ensemble(training, fine, target, spec.predictors, spec.factor, kind, min_samples=spec.min_samples)


def _weighted(training: DataFrame, fine: DataFrame, spec: Downscaling, target: str, shape: tuple[int, int]) -> DataFrame:
    at = lambda df, scale: df.withColumns({c: (F.col(i) + 0.5) / scale for c, i in (("x", "ix"), ("y", "iy"))})  # noqa: E731 - in coarse cells
    enough = downscale.usable(training, [target, *spec.predictors]).groupBy("scene").agg(F.count("*").alias("_n")).where(F.col("_n") >= spec.min_samples).select("scene")
    kept = training.join(enough, "scene", "left_semi")
    return gwr.predict_gwr(at(fine, spec.factor).join(enough, "scene", "left_semi"), at(kept, 1), target, spec.predictors, bandwidth=spec.bandwidth, min_local=spec.min_local)


#: Models by name, each fitted scene by scene; plug-ins register here.
PER_SCENE_MODELS: dict[str, Model] = {"linear": _linear, "tsharp": _linear, "local_trees": _local, "random_forest": _ensemble("forest"), "gradient_boosting": _ensemble("boosted"), "gwr": _weighted}
CORRECTIONS: dict[str, Callable] = {
    "block": lambda predicted, observed, target, factor, shape: downscale.conserve_blocks(predicted, observed, target, factor),
    "smooth": lambda predicted, observed, target, factor, shape: downscale.conserve_smooth(predicted, observed, target, factor, height=shape[0], width=shape[1]),
    "atpk": kriging.conserve_kriged,
}


def downscale_cube(coarse: DataFrame, fine: DataFrame, spec: Downscaling, target: str, shape: tuple[int, int]) -> DataFrame:
    """Sharpen scene by scene; fine scenes carry the coarse scene's time. Shape is the coarse grid's."""
    means = binning.block_mean(fine, spec.factor, list(spec.predictors))
    training = coarse.select(*KEYS, target).join(means, list(KEYS))
    predicted = PER_SCENE_MODELS[spec.model](training, fine, spec, target, shape)
    return CORRECTIONS[spec.correction](predicted, coarse.where(F.col(target).isNotNull()), target, spec.factor, shape)


def coarsened(cube: DataFrame, factor: int) -> DataFrame:
    """A fine cube on the grid it is nested in: means of numbers, and masks that are true where any cell's is."""
    names = [c for c in cube.columns if c not in KEYS]
    masks = {c for c, t in cube.dtypes if t == "boolean"}
    out = binning.block_mean(cube, factor, [c for c in names if dict(cube.dtypes)[c] in NUMERIC or c in masks])
    return out.withColumns({c: F.coalesce(F.col(c) > 0, F.lit(False)) for c in masks})


def run(cubes: Mapping[str, DataFrame], request: Request, *, shape: tuple[int, int] | None = None) -> Result:
    """Fusion on the target's grid and sharpening of cubes already on their grids (see `Request.grid_of`).

    The predictors' cube is `factor` times finer than the others; it is averaged for
    the fusion. `shape` is that of the target's grid, if it is not the request's.
    """
    target = request.target_sensor
    for sensor in request.sensors:
        if sensor in cubes:
            check_grid(sensor, cubes[sensor], request)
    down = request.downscaling
    shape = shape or (request.grid().height, request.grid().width)
    fused = fuse({s: coarsened(c, down.factor) if down and s == down.sensor else c for s, c in cubes.items()}, target, request.tolerance_days)
    sharp = None
    if down:
        if down.sensor not in cubes:
            raise ValueError(f"sharpening needs cells of {down.sensor}, which gave none")
        fine = cubes[down.sensor]
        pairs = temporal.nearest_times(cubes[target], fine, temporal.tolerance_us(down.sensor, request.tolerance_days)).where("matched_time is not null").select("scene", "matched_time")
        timed = fine.withColumnRenamed("scene", "matched_time").join(pairs, "matched_time").drop("matched_time")
        sharp = downscale_cube(cubes[target], timed, down, "lst", shape)
    return Result(fused, cubes[target], sharp, {"plan": [s.__dict__ for s in build_plan(request)], "target": target, "sensors": list(cubes)})


def acquire(spark: SparkSession, adapter: Adapter, products: DataFrame, request: Request, sensor: str, result: Notes) -> DataFrame:
    """One sensor's cube from its discovered products; what was left out is noted.

    Over a raw table, the ids and errors of at most `limit` products come to the
    driver. Clear shares of all candidates stay a table.
    """
    if not isinstance(adapter, TableAdapter):
        return adapter(spark, discover(products, request, sensor), request)
    if request.min_clear_fraction > 0 and adapter.probes:
        found = catalogue.below_cloud(candidates(products, request, sensor), request.max_cloud)
        judged = acquisition.select_clear(found, adapter.clear(found, request.area, result.known_clear), request.min_clear_fraction, request.limit)
        result.probed[sensor] = judged.select("product_id", "clear_fraction", "accepted")
        chosen = judged.where("accepted")
    else:
        chosen = discover(products, request, sensor)
    ids = [r.product_id for r in chosen.select("product_id").collect()]
    if not ids:
        raise acquisition.ProductError(f"no products of {sensor} for this area and time")
    if request.on_product_error == "skip":
        failed = {r.product_id: r.error for r in adapter.failures(spark.createDataFrame([(p,) for p in ids], "product_id string"), ids).collect()}
        result.failed_products += [{"sensor": sensor, "product": p, "error": failed[p]} for p in sorted(failed)]
        ids = [p for p in ids if p not in failed]
        if not ids:
            raise acquisition.ProductError(f"all products of {sensor} failed: {'; '.join(f'{p}: {e}' for p, e in sorted(failed.items()))}")
    return adapter.read(ids, request)


def execute(spark: SparkSession, request: Request, products: DataFrame, *, shape: tuple[int, int] | None = None, known_clear: DataFrame | None = None) -> Result:
    """Check limits, get auxiliary data, discover, read with the registered adapters, then run.

    With `on_product_error` "skip" a product that cannot be read is left out and
    named in the provenance, and so is a sensor of which none can; with "raise" both
    are errors. Without the target there is an error. `known_clear` has clear shares
    of an earlier run (product_id, clear_fraction).
    """
    check_limits(request)
    notes = Notes(known_clear)
    auxiliary = auxiliary_cubes(spark, request)
    cubes: dict[str, DataFrame] = {}
    for sensor in request.sensors:
        try:
            cubes[sensor] = acquire(spark, ADAPTERS[sensor], products, request, sensor, notes)
        except Exception as e:
            if request.on_product_error == "raise":
                raise
            notes.errors[sensor] = str(e)
    if request.target_sensor not in cubes:
        raise RuntimeError(f"no data for the target: {notes.errors}")
    out = run(cubes | auxiliary, request, shape=shape)
    out.provenance |= {"errors": notes.errors, "failed_products": notes.failed_products}
    out.probed = notes.probed
    return out
