"""Attributes of mapped power features, lattice cells and chips as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import DEGREE_M

#: Degrees in a lattice cell.
CELL = 0.1


def voltage(text: Column) -> Column:
    """The largest number in a voltage tag; null where there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda v: v.cast("double")))


def voltage_class(v: Column) -> Column:
    return F.when(v >= 400000, "400+").when(v >= 220000, "220-400").when(v >= 100000, "100-220").when(v >= 0, "0-100")


def voltage_bucket(v: Column) -> Column:
    return F.when(v >= 220000, ">=220kV").when(v >= 66000, "66-220kV").otherwise("<66kV/unknown")


def area_bucket(a: Column) -> Column:
    return F.when(a >= 20000, "20k+").when(a >= 5000, "5k-20k").when(a >= 2000, "2k-5k").when(a >= 1000, "1k-2k")


def role(area: Column, status: Column, v: Column, floor: float, voltage_only: bool = False) -> Column:
    """pos from the area floor on, else small; rejected outlines are small, and so are those without voltage if asked for."""
    unsure = status.isin("no_signal", "village")
    if voltage_only:
        unsure = unsure | v.isNull() | (v <= 0)
    return F.when((area >= floor) & ~F.coalesce(unsure, F.lit(False)), "pos").otherwise("small")


def snap_origin(least: Column, origin: float, cell: float = CELL) -> Column:
    return F.lit(origin) + F.floor((least - origin) / cell) * cell


def cell_index(coord: Column, origin: Column | float, cell: float = CELL) -> Column:
    return F.floor((coord - origin) / cell)


def cell_name(ix: Column, iy: Column, digits: int = 4) -> Column:
    return F.format_string(f"%0{digits}d_%0{digits}d", ix, iy)


def chip_id(lon: Column, lat: Column) -> Column:
    return F.substring(F.sha1(F.format_string("%.5f_%.5f", lon, lat)), 1, 12)


def chip_box(lon: Column, lat: Column, half_m: float = 1120.0) -> list[Column]:
    dlat, dlon = half_m / DEGREE_M, F.lit(half_m) / (F.cos(F.radians(lat)) * DEGREE_M)
    return [(lon - dlon).alias("xmin"), (lat - dlat).alias("ymin"), (lon + dlon).alias("xmax"), (lat + dlat).alias("ymax")]


def split(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return F.when(lon.between(box[0], box[2]) & lat.between(box[1], box[3]), "val").otherwise("train")


def round_key(lon: Column, lat: Column, step: float) -> Column:
    """Deduplication key by the nearest multiple of step, half to even."""
    part = lambda c: F.bround(c / step).cast("long").cast("string")
    return F.concat_ws("_", part(lon), part(lat))


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on an integer key and the seed only: a step of a multiplicative generator."""
    return F.pmod(F.pmod(key.cast("long") * 48271 + seed * 69621, F.lit(2147483647)) * 16807, F.lit(2147483647)) / 2147483647.0


def jittered(lon: Column, lat: Column, key: Column, seed: int, metres: float) -> tuple[Column, Column]:
    """lon and lat moved by up to so many metres either way along both axes."""
    off = lambda s: (2 * uniform(key, s) - 1) * (metres / DEGREE_M)
    return lon + off(seed) / F.cos(F.radians(lat)), lat + off(seed + 1)


def window_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> list[Column]:
    """A box with a margin of half its longer side and 0.0015 degrees."""
    m = F.greatest(xmax - xmin, ymax - ymin) * 0.5 + 0.0015
    return [(xmin - m).alias("xmin"), (ymin - m).alias("ymin"), (xmax + m).alias("xmax"), (ymax + m).alias("ymax")]
