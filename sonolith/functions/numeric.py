"""Scalar formulas as Column functions. Values that are not measurable are NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference points of the Bark, ERB and absolute-threshold formulas; fixed values.
BARK_A, BARK_B, BARK_HZ_A, BARK_HZ_B = 13.0, 3.5, 0.00076, 7500.0
ERB_SLOPE, ERB_BASE, ERB_NUMBER = 4.37, 24.7, 21.4
WILSON_Z = 1.959963985


def r6(x: Column) -> Column:
    """Rounded to six decimals by the same IEEE steps in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def db20(x: Column, floor: float = -300.0) -> Column:
    """20 log10 of a magnitude, not below `floor`; that for 0 and less."""
    return F.when(x <= 0, F.lit(floor)).otherwise(F.greatest(F.lit(floor), 20 * F.log10(x)))


def db10(x: Column, least: float = 1e-30) -> Column:
    """10 log10 of a power, which is taken as `least` at least."""
    return 10 * F.log10(F.greatest(x, F.lit(least)))


def ratio_db(x: Column, y: Column) -> Column:
    """10 log10(x / y), NULL where either has no power."""
    return F.when((x > 0) & (y > 0), 10 * F.log10(x / y))


def erb_bandwidth(hz: Column) -> Column:
    return ERB_BASE * (ERB_SLOPE * hz / 1000 + 1)


def erb_number(hz: Column) -> Column:
    return ERB_NUMBER * F.log10(ERB_SLOPE * hz / 1000 + 1)


def erb_to_hz(number: Column) -> Column:
    return (F.pow(F.lit(10.0), number / ERB_NUMBER) - 1) / ERB_SLOPE * 1000


def bark(hz: Column) -> Column:
    return BARK_A * F.atan(BARK_HZ_A * hz) + BARK_B * F.atan(F.pow(hz / BARK_HZ_B, 2))


def spreading_db(delta_bark: Column) -> Column:
    """Schroeder's spreading function."""
    x = delta_bark + 0.474
    return 15.81 + 7.5 * x - 17.5 * F.sqrt(1 + x * x)


def threshold_in_quiet(hz: Column) -> Column:
    """Terhardt's absolute threshold in dB SPL, with the frequency held at 20 Hz or more."""
    k = F.greatest(hz, F.lit(20.0)) / 1000
    return 3.64 * F.pow(k, -0.8) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, 2)) + 0.001 * F.pow(k, 4)


def hann(i: Column, n: int) -> Column:
    """Periodic Hann window at sample i of n."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / n)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n - F.lit(0.5))))).cast("long")


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval for k of n, (0, 1) without trials."""
    p = k / F.when(n > 0, n)
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)


def sidak(alpha: float, comparisons: Column) -> Column:
    return F.when(comparisons <= 1, F.lit(alpha)).otherwise(1 - F.pow(F.lit(1 - alpha), 1.0 / comparisons))


def wald_bounds(alpha: float = 0.05, beta: float = 0.10, p0: float = 0.5, p1: float = 0.75) -> tuple[float, float, float, float]:
    """Upper and lower bound, step for a right and for a wrong answer of a sequential test."""
    return math.log((1 - beta) / alpha), math.log(beta / (1 - alpha)), math.log(p1 / p0), math.log((1 - p1) / (1 - p0))


def combined_floor(floors: list[Column]) -> Column:
    """Power sum of noise floors in dB; NULL if one is unknown."""
    return -10 * F.log10(sum((F.pow(F.lit(10.0), -f / 10) for f in floors[1:]), F.pow(F.lit(10.0), -floors[0] / 10)))
