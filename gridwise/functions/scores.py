"""Priors, encodings and fusions as column expressions. Results that rank or are compared are rounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(d: Column, scale: float) -> Column:
    return F.exp(-d / scale)


def half_prior(d: Column, scale: float = 2000.0) -> Column:
    """From 1 at no distance down to a half; a negative distance stands for none at all."""
    return 0.5 + 0.5 * decay(F.when(d < 0, 1e6).otherwise(d), scale)


def line_rank(confidence: Column, d: Column) -> Column:
    return F.round(F.coalesce(confidence * half_prior(d), F.lit(0.0)), 4)


def regional_rank(confidence: Column, endpoint: Column, line: Column, line_scale: float = 500.0) -> Column:
    """An unknown line distance costs nothing."""
    return F.round(F.coalesce(confidence, F.lit(0.0)) * decay(endpoint, 2000.0) * decay(F.coalesce(line, F.lit(0.0)), line_scale), 4)


def convergence(n: Column) -> Column:
    return 0.75 + 0.25 * F.least(n, F.lit(3))


def isolated(n: Column) -> Column:
    return 0.75 + 0.25 * F.least(n, F.lit(4)) / 4.0


def metal(vh_db: Column) -> Column:
    """Logistic in the backscatter; a half where it is unknown."""
    return F.coalesce(1 / (1 + F.exp(-(vh_db + 13.6) / 1.5)), F.lit(0.5))


def penalised(base: Column, *flags: Column, factor: float = 0.3) -> Column:
    return reduce(lambda s, f: s * F.when(f, factor).otherwise(1.0), flags, base)


def encode_db(power: Column) -> Column:
    """Decibels in 1/500 from -50 up, within 16 bits; 0 where there is no signal."""
    return F.when(power > 0, F.least(F.lit(65535.0), F.greatest(F.lit(1.0), F.floor(F.round((F.log10(power) * 10 + 50) * 500, 6))))).otherwise(0.0).cast("int")


def decode_db(dn: Column) -> Column:
    return F.when(dn > 0, dn / 500.0 - 50.0)


def fusions(a: Column, b: Column) -> dict[str, Column]:
    """Each alone and four ways to fuse them; where b is missing, a stands alone."""
    both = {"geometric": F.sqrt(a * b), "mean": (a + b) / 2, "max": F.greatest(a, b), "gated": a * (0.5 + 0.5 * b)}
    return {"first": a, "second": b} | {k: F.coalesce(c, a) for k, c in both.items()}


def ndvi(nir: Column, red: Column, guard: str = "null") -> Column:
    """(nir - red) / (nir + red). Against a sum of 0: null, ``add`` 1e-6 to it, or take ``one`` or a ``tiny`` 1e-6 where it is less."""
    total = nir + red
    under = {"add": total + 1e-6, "one": F.greatest(total, F.lit(1.0)), "tiny": F.greatest(total, F.lit(1e-6))}
    return F.try_divide(nir - red, total) if guard == "null" else (nir - red) / under[guard]


def brightness(*bands: Column) -> Column:
    return reduce(lambda s, b: s + b, bands) / float(len(bands))


def reflectance(dn: Column, offset: float = 0.0) -> Column:
    """Share of light from a digital number, cut to 0..1 if an offset is taken off."""
    return F.least(F.greatest((dn - offset) / 10000.0, F.lit(0.0)), F.lit(1.0)) if offset else dn / 10000.0


def standardised(db: Column, mean: float, std: float) -> Column:
    """Deviations from the mean; 0 where there is no signal."""
    return F.coalesce((db - mean) / std, F.lit(0.0))


def positive_class(first: Column, second: Column) -> Column:
    """Probability of the second of two classes from their logits."""
    return 1 / (1 + F.exp(first - second))


def solar_day(ts: Column, lon: Column) -> Column:
    """Date at a place's solar time: an hour for each 15 degrees."""
    return (ts + F.make_dt_interval(secs=F.floor(lon * 240))).cast("date")


def quantise(p: Column) -> Column:
    return F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
