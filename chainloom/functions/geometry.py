"""Columns for points in space: three columns are a vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def sub(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def scale(a: Vector, k: Column | float) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return a[0] / n, a[1] / n, a[2] / n


def rotate(v: Vector, axis: Vector, angle: Column) -> Vector:
    """``v`` turned by ``angle`` about ``axis`` (Rodrigues' formula)."""
    k = unit(axis)
    c, s = F.cos(angle), F.sin(angle)
    turned = add(scale(v, c), scale(cross(k, v), s))
    return add(turned, scale(k, dot(k, v) * (1 - c)))


def bond_angle(a: Vector, b: Vector, c: Vector) -> Column:
    """The angle at ``b``, null where a point is."""
    u, w = sub(a, b), sub(c, b)
    cos = dot(u, w) / (norm(u) * norm(w))
    return F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def dihedral(p0: Vector, p1: Vector, p2: Vector, p3: Vector) -> Column:
    """The signed angle between the planes p0 p1 p2 and p1 p2 p3."""
    b0, b1, b2 = sub(p1, p0), sub(p2, p1), sub(p3, p2)
    n1, n2 = cross(b0, b1), cross(b1, b2)
    return F.atan2(dot(cross(n1, n2), unit(b1)), dot(n1, n2))


def frame(n: Vector, ca: Vector, c: Vector) -> tuple[Vector, Vector, Vector]:
    """Right-handed axes at CA: x towards C, z across the plane with N, y completing them."""
    x = unit(sub(c, ca))
    z = unit(cross(x, sub(n, ca)))
    return x, cross(z, x), z


def rotation_geodesic(a: list[Column], b: list[Column]) -> Column:
    """The angle between two rotations given as nine columns each, row by row."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))


def c_beta(n: Vector, ca: Vector, c: Vector) -> Vector:
    """Where a tetrahedral CB would stand, 1.53 away from CA."""
    a, b = unit(sub(n, ca)), unit(sub(c, ca))
    middle, out = unit(add(a, b)), unit(cross(a, b))
    return add(ca, scale(add(scale(middle, -0.5773502691896258), scale(out, 0.816496580927726)), 1.53))
