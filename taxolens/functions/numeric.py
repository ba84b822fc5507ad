"""Column expressions: scaling, safe arithmetic, array reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def clean(c: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return a / (b + F.lit(eps))


def signed_root(c: Column) -> Column:
    return F.sqrt(F.abs(c))


def yeo_johnson(c: Column, lam: Column | float) -> Column:
    """The power transform of a column for a given exponent, before standardising; nulls stay null."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lam) < 1e-12, F.log1p(F.greatest(c, F.lit(0.0)))).otherwise((F.pow(F.greatest(c, F.lit(0.0)) + 1, lam) - 1) / F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam))
    two = F.lit(2.0) - lam
    low = F.least(c, F.lit(0.0))
    down = F.when(F.abs(two) < 1e-12, -F.log1p(-low)).otherwise(-(F.pow(1 - low, two) - 1) / F.when(F.abs(two) < 1e-12, 1.0).otherwise(two))
    return F.when(c >= 0, up).when(c < 0, down)


def unit_range(c: Column, low: Column, high: Column, flat: float = 0.5) -> Column:
    """(c - low) / (high - low); `flat` where all are equal."""
    return F.when(high > low, (c - low) / F.when(high > low, high - low)).otherwise(F.lit(flat))


def eps_range(c: Column, low: Column, high: Column, invert: bool = False, eps: float = 1e-12) -> Column:
    out = (c - low) / (high - low + F.lit(eps))
    return F.lit(1.0) - out if invert else out


def percent_band(c: Column, p5: Column, p95: Column) -> Column:
    """100 (c - p5) / (p95 - p5), held within 0 and 100; 50 where the percentiles meet."""
    flat = F.abs(p95 - p5) < 1e-12
    return F.when(flat, F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (c - p5) / F.when(flat, 1.0).otherwise(p95 - p5))))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def argmax(a: Column) -> Column:
    """Place of the first largest item, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def xlogx(p: Column, base: str = "e") -> Column:
    """p log p, 0 at 0."""
    log = F.log2 if base == "2" else F.log
    return F.when(p > 0, p * log(F.when(p > 0, p))).otherwise(F.lit(0.0))
