"""Descriptors from running moments against direct double sums over points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions import moments
from chainloom.functions.numeric import jacobi, zernike_invariants
from chainloom.operators import spans


def direct(points, order):
    """Every pair of points by the kernel, about the centre, scaled by the radius of gyration."""
    p = points - points.mean(0)
    radius = np.sqrt((p**2).sum(1).mean())
    p = p / (moments.BALL * radius) if radius > 1e-9 else p * 0
    r = np.linalg.norm(p, axis=1)
    unit = p / np.where(r > 0, r, 1)[:, None]
    cosine = np.where(np.outer(r, r) > 0, unit @ unit.T, 1.0)
    out = []
    for n, l in moments.names(order):
        radial = np.sqrt(2 * n + 3) * r**l * jacobi((n - l) // 2, l + 0.5, 2 * r**2 - 1) / len(p)
        out.append(np.sqrt(max(0, radial @ ((2 * l + 1) / (4 * np.pi) * jacobi(l, 0.0, cosine)) @ radial)))
    return out, radius


def test_moments_give_the_invariants():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60):
        x = 4 * rng.normal(size=(n, 3)) + 50
        got, radius = moments.descriptors(moments.powers(x - x[0], 8).sum(0)[None], 8)
        want, r = direct(x, 8)
        assert np.allclose(got[0], want, atol=1e-6) and abs(radius[0] - r) < 1e-8
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    both = [moments.descriptors(moments.powers(p, 6).sum(0)[None], 6)[0] for p in (x - 50, (x - 50) @ turn.T + 3)]
    assert np.allclose(*both, atol=1e-6)
    small = x[:5] - x[:5].mean(0)
    small = small / (moments.BALL * np.sqrt((small**2).sum(1).mean()))
    if np.linalg.norm(small, axis=1).max() <= 1:  # no point beyond the ball: the same as the descriptors of points
        assert np.allclose(moments.descriptors(moments.powers(x[:5], 8).sum(0)[None], 8)[0][0], zernike_invariants(small, 8, np.full(5, 0.2)), atol=1e-6)


def test_spans_over_blocks_against_direct_sums(spark):
    rng = np.random.default_rng(1)
    points = {"a": np.cumsum(rng.normal(size=(40, 3)) * 2, 0) + 100, "b": rng.normal(size=(3, 3)), "c": np.ones((5, 3))}
    rows = [(c, i, *map(float, p), float(rng.normal()), float(i % 3)) for c, x in points.items() for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "chain string, pos int, x double, y double, z double, u double, v double").repartition(3)
    u = {(r[0], r[1]): r[5:] for r in rows}
    for block in (6, 17, 256):
        got = spans.span_shapes(df, "chain", "pos", ["u", "v"], 6, 5, block).collect()
        assert len({(r.chain, r.lo, r.hi) for r in got}) == len(got) == sum(min(6, len(x) - i) for x in points.values() for i in range(len(x)))
        for r in got:
            want, radius = direct(points[r.chain][r.lo : r.hi], 5)
            own = np.array([u[r.chain, i] for i in range(r.lo, r.hi)])
            assert np.allclose(r.descriptor, want, atol=1e-6) and abs(r.radius - radius) < 1e-7
            assert np.allclose(r.means, own.mean(0)) and np.allclose(r.variances, own.var(0), atol=1e-12)
    size = len(moments.names(5)) + 1 + 2 + 2 + 2
    layers = [(rng.normal(size=(3, size)).tolist(), [0.1, 0.2, 0.3]), (rng.normal(size=(1, 3)).tolist(), [0.5])]
    scored = {(r.chain, r.lo, r.hi): r.score for r in spans.score_shapes(spans.span_shapes(df, "chain", "pos", ["u", "v"], 6, 5), layers, 0.1).collect()}
    for r in got:
        n = r.hi - r.lo
        f = np.concatenate([r.descriptor, [r.radius], r.means, r.variances, [n / 500, np.log(n + 1e-6) / 6]])
        want = (np.array(layers[1][0]) @ np.maximum(0, np.array(layers[0][0]) @ f + layers[0][1]) + layers[1][1])[0] - 0.1
        assert abs(scored[r.chain, r.lo, r.hi] - want) < 1e-7
    assert spans.span_shapes(df.filter(F.lit(False)), "chain", "pos", ["u"], 3).count() == 0
    with pytest.raises(ValueError, match="longest span"):
        spans.span_shapes(df, "chain", "pos", [], 9, 5, 8)
