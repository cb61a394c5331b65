"""Rotation-invariant descriptors from sums of powers of coordinates, which add up along a chain.

The square of a Zernike descriptor (n, l) is a double sum over points of a kernel in their lengths and their inner product.
Written out, it is a sum of squares of combinations of the moments sum x^a y^b z^c with a + b + c <= n, with the
coefficients of Legendre's polynomial as weights. Moments about another origin and in another unit follow from binomials, so a
span's descriptors need only its own moments, the difference of two running sums.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, factorial, pi

import numpy as np

from chainloom.functions.numeric import jacobi

#: A ball filled evenly has this radius where its radius of gyration is one.
BALL = (5 / 3) ** 0.5


def powers(points: np.ndarray, order: int) -> np.ndarray:
    """(points, order + 1, order + 1, order + 1): x^a y^b z^c of each point."""
    x, y, z = (points[:, i : i + 1] ** np.arange(order + 1) for i in range(3))
    return x[:, :, None, None] * y[:, None, :, None] * z[:, None, None, :]


def moved(moments: np.ndarray, origin: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Moments about another origin, in another unit of length; one of each for every row."""
    order = moments.shape[1] - 1
    shift = np.zeros((len(moments), 3, order + 1, order + 1))
    for i in range(order + 1):
        for j in range(i + 1):
            shift[:, :, i, j] = comb(i, j) * (-origin) ** (i - j) / unit[:, None] ** i
    out = np.einsum("nai,nibc->nabc", shift[:, 0], moments)
    out = np.einsum("nbi,naic->nabc", shift[:, 1], out)
    return np.einsum("nci,nabi->nabc", shift[:, 2], out)


def names(order: int) -> list[tuple[int, int]]:
    """(n, l) of each descriptor, in order."""
    return [(n, l) for n in range(order + 1) for l in range(n % 2, n + 1, 2)]  # noqa: E741


def _length_power(t: int) -> list[tuple[tuple[int, int, int], int]]:
    """(x^2 + y^2 + z^2)^t as exponents and coefficients."""
    return [((2 * a, 2 * b, 2 * (t - a - b)), factorial(t) // factorial(a) // factorial(b) // factorial(t - a - b)) for a in range(t + 1) for b in range(t + 1 - a)]


@lru_cache(4)
def combinations(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations of moments (rows, (order + 1)^3), the weight of each one's square, and which descriptor it belongs to."""
    rows, weights, of = [], [], []
    for d, (n, l) in enumerate(names(order)):  # noqa: E741
        k = (n - l) // 2
        # The radial polynomial in the squared length, from its values.
        at = (1 - np.cos(pi * (np.arange(k + 1) + 0.5) / (k + 1))) / 2
        radial = np.linalg.solve(at[:, None] ** np.arange(k + 1), jacobi(k, l + 0.5, 2 * at - 1)) * np.sqrt(2 * n + 3)
        for j in range(l // 2 + 1):
            legendre = (-1) ** j * comb(l, j) * comb(2 * l - 2 * j, l) / 2**l
            m = l - 2 * j
            for a in range(m + 1):
                for b in range(m + 1 - a):
                    row = np.zeros((order + 1,) * 3)
                    for s, c in enumerate(radial):
                        for (x, y, z), times in _length_power(j + s):
                            row[a + x, b + y, m - a - b + z] += c * times
                    rows.append(row.reshape(-1))
                    weights.append((2 * l + 1) / (4 * pi) * legendre * factorial(m) / factorial(a) / factorial(b) / factorial(m - a - b))
                    of.append(d)
    return np.array(rows), np.array(weights), np.array(of)


def descriptors(moments: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, descriptors) of point sets, each point weighing one by their number, about their centre and scaled by BALL times
    their radius of gyration; and that radius. Points beyond the unit ball count as the polynomials go on. Sets of no
    extent, to a hundred-thousandth of their distance from the origin, are a point."""
    n = moments[:, 0, 0, 0]
    centre = np.stack([moments[:, 1, 0, 0], moments[:, 0, 1, 0], moments[:, 0, 0, 1]], 1) / n[:, None]
    about = moved(moments / n[:, None, None, None], centre, np.ones(len(moments)))
    radius = np.sqrt(np.maximum(0, about[:, 2, 0, 0] + about[:, 0, 2, 0] + about[:, 0, 0, 2])) if order > 1 else np.zeros(len(n))
    point = (n == 1) | (radius <= 1e-5 * (1 + np.abs(centre).max(1)))  # what is left of it is rounding
    radius = np.where(point, 0.0, radius)
    flat = moved(about, np.zeros((len(n), 3)), np.where(point, 1.0, BALL * radius))
    flat[point] = 0
    flat[:, 0, 0, 0] = 1
    rows, weights, of = combinations(order)
    squares = (flat.reshape(len(n), -1) @ rows.T) ** 2 * weights
    out = np.zeros((len(n), len(names(order))))
    np.add.at(out.T, of, squares.T)
    return np.sqrt(np.maximum(0, out)), radius
