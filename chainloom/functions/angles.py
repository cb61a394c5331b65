"""Columns for angles: wrapping, losses, circular statistics. Radians throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi


def wrap(value: Column, lo: float = -PI, hi: float = PI) -> Column:
    """``value`` moved by whole turns into [lo, hi); ``lo`` may be at most 0 and ``hi`` at least 0."""
    if lo > 0 or hi < 0 or lo >= hi:
        raise ValueError("the range must hold 0")
    return F.pmod(value - F.lit(lo), F.lit(hi - lo)) + F.lit(lo)


def radian_l1(value: Column, target: Column) -> Column:
    """Absolute difference around the circle; average it for the loss."""
    return F.abs(wrap(target - value))


def radian_smooth_l1(value: Column, target: Column, beta: float = 1.0, circle_penalty: float = 0.0) -> Column:
    """Quadratic below ``beta`` and linear above, plus a penalty for each full half turn of the raw value."""
    d = F.abs(wrap(target - value))
    loss = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    if circle_penalty > 0:
        loss = loss + F.lit(circle_penalty) * F.floor(F.abs(value) / PI)
    return loss


def circular_mean(value: Column) -> Column:
    """Aggregate: the mean direction; NaN and null are left out."""
    clean = F.when(~F.isnan(value), value)
    return F.atan2(F.avg(F.sin(clean)), F.avg(F.cos(clean)))


def circular_rmse(value: Column, reference: Column) -> Column:
    """Aggregate: root mean square of wrapped differences."""
    return F.sqrt(F.avg(F.pow(wrap(value - reference), F.lit(2))))


def angle_between(v1: list[Column], v2: list[Column]) -> Column:
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    cos = dot(v1, v2) / F.sqrt(dot(v1, v1) * dot(v2, v2))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
