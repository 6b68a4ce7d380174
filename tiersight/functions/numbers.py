"""Arithmetic as Column expressions: rounding, changes, ratios, intervals and agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded to places, halves towards positive infinity."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def divided(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is zero or either is null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def change(after: Column, before: Column, places: int = 2) -> Column:
    return half_up(after - before, places)


def change_percent(after: Column, before: Column, places: int = 1) -> Column:
    """Relative change in percent; null where the base isn't positive."""
    return F.when(before > 0, half_up((after - before) / before * F.lit(100.0), places))


def per(count: Column, base: Column, unit: float = 1000.0, places: int = 1) -> Column:
    """count for each `unit` of base; null without a base or with a base of zero."""
    return half_up(divided(count, base) * F.lit(unit), places)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the Wilson score interval; 0 to 1 for no trials."""
    n, zz = n.cast("double"), z * z
    p = successes.cast("double") / F.nullif(n, F.lit(0.0))
    denominator = F.lit(1.0) + F.lit(zz) / F.nullif(n, F.lit(0.0))
    centre = (p + F.lit(zz) / (F.lit(2.0) * F.nullif(n, F.lit(0.0)))) / denominator
    spread = F.sqrt(p * (F.lit(1.0) - p) / F.nullif(n, F.lit(0.0)) + F.lit(zz) / (F.lit(4.0) * F.nullif(n * n, F.lit(0.0))))
    half = F.lit(z) * spread / denominator
    return F.struct(F.coalesce(centre - half, F.lit(0.0)).alias("low"), F.coalesce(centre + half, F.lit(1.0)).alias("high"))


#: Abramowitz and Stegun 7.1.26, fixed values: five coefficients and p.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, within 1.5e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def kappa(observed: Column, expected: Column) -> Column:
    """Agreement beyond chance; 0 where chance agreement is total."""
    return F.when(expected == 1, F.lit(0.0)).otherwise((observed - expected) / (F.lit(1.0) - expected))


def log_position(x: Column, lo: float, hi: float) -> Column:
    """Where x lies between lo and hi on a logarithmic axis, 0 to 1."""
    return (F.log(x) - F.log(F.lit(lo))) / (F.log(F.lit(hi)) - F.log(F.lit(lo)))


def banded(x: Column, breaks: list[float], unknown: str = "n") -> Column:
    """Number of the first break above x as text; `unknown` for null, the last band beyond all."""
    out = F.lit(str(len(breaks)))
    for k in range(len(breaks) - 1, -1, -1):
        out = F.when(x < breaks[k], str(k)).otherwise(out)
    return F.when(x.isNull(), unknown).otherwise(out)


#: Tops of axes that split into round steps, as multiples of a power of ten; fixed values.
NICE = [1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0]


def nice_top(x: Column) -> Column:
    """The smallest round number at or above a value, 1 for none above zero."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    fits = F.filter(F.array(*map(F.lit, NICE)), lambda n: n * power >= x - 1e-9)
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.floor(F.element_at(fits, 1) * power * 1e6 + 0.5) / 1e6)


def decade_ticks(lo: Column, hi: Column) -> Column:
    """Every power of ten from one to another, as a logarithmic axis shows."""
    powers = F.sequence(F.round(F.log10(lo)).cast("int"), F.round(F.log10(hi)).cast("int"))
    return F.transform(powers, lambda p: F.floor(F.pow(F.lit(10.0), p) * 1e6 + 0.5) / 1e6)
