"""Variable contracts kept in column metadata: units, role and source of every variable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contract of well-known variables. Fixed values.
CONTRACTS = {
    "lst": {"units": "K", "standard_name": "surface_temperature", "role": "target"},
    "lst_uncertainty": {"units": "K", "role": "diagnostic"},
    "NDVI": {"units": "1", "role": "feature"},
    "EVI": {"units": "1", "role": "feature"},
    "NDMI": {"units": "1", "role": "feature"},
    "NDBI": {"units": "1", "role": "feature"},
    "MNDWI": {"units": "1", "role": "feature"},
    "slope": {"units": "degree", "role": "feature"},
    "aspect": {"units": "degree", "role": "feature"},
    "cos_incidence": {"units": "1", "role": "feature"},
}


def attach(df: DataFrame, sensor: str, extra: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Contract metadata for the variables that have one; what a column already says stays."""
    out = {}
    for f in df.schema:
        known = {**CONTRACTS.get(f.name, {}), **(extra or {}).get(f.name, {})}
        if known:
            out[f.name] = F.col(f.name).alias(f.name, metadata={**known, "sensor": sensor, **f.metadata})
    return df.withColumns(out) if out else df


def validate(df: DataFrame, required: Sequence[str] = ("units",)) -> None:
    """Every contracted variable has the required entries."""
    missing = {f.name: [r for r in required if r not in f.metadata] for f in df.schema if f.name in CONTRACTS}
    missing = {k: v for k, v in missing.items() if v}
    if missing:
        raise ValueError(f"incomplete contracts: {missing}")


def same_units(left: DataFrame, right: DataFrame) -> None:
    """Variables of one name have one unit in both cubes."""
    units = {f.name: f.metadata.get("units") for f in left.schema}
    clash = [f.name for f in right.schema if units.get(f.name) and f.metadata.get("units") and units[f.name] != f.metadata["units"]]
    if clash:
        raise ValueError(f"units differ: {clash}")


def validate_cube(df: DataFrame, variables: Sequence[str] = (), *, time: bool = True) -> None:
    """The keys and variables are there, with integer cells."""
    need = [*(["scene"] if time else []), "iy", "ix", *variables]
    lacking = [c for c in need if c not in df.columns]
    if lacking:
        raise ValueError(f"a cube lacks {lacking}")
    kinds = dict(df.dtypes)
    if kinds["iy"] not in ("int", "bigint") or kinds["ix"] not in ("int", "bigint"):
        raise ValueError("rows and columns of a cube are integers")


def validate_observations(df: DataFrame, variables: Sequence[str] = ()) -> None:
    """A swath has coordinates for each observation and its variables."""
    lacking = [c for c in ("scene", "lat", "lon", *variables) if c not in df.columns]
    if lacking:
        raise ValueError(f"an observation set lacks {lacking}")
