"""Chains of bonds as products of rigid motions, many chains at once.

A bond turns the frame at its first atom about the bond before it (dihedral), bends it (angle), and moves it along itself
(length). Products of such motions are associative, and so are the sums that a superposition needs, so blocks of a chain can
be summed up by themselves and put together later. All arrays have the rows first: rotations (n, 3, 3), moves (n, 3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np

MICRO = 1_000_000


def bond_motions(lens: np.ndarray, angs: np.ndarray, dihs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and move of each bond; a missing angle is no bend, a missing dihedral no turn."""
    a, d = np.where(np.isnan(angs), np.pi, angs), np.nan_to_num(dihs)
    ca, sa, cd, sd = -np.cos(a), np.sin(a), np.cos(d), np.sin(d)
    zero = np.zeros_like(ca)
    turn = np.stack([np.stack([ca, -sa, zero], -1), np.stack([cd * sa, cd * ca, -sd], -1), np.stack([sd * sa, sd * ca, cd], -1)], -2)
    return turn, turn[..., 0] * lens[..., None]


def walk(lens: np.ndarray, angs: np.ndarray, dihs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Atoms behind each bond of every row (rows, bonds, 3), in the row's first frame, and its last frame."""
    n, width = lens.shape
    turn, move = bond_motions(lens, angs, dihs)
    r, t, atoms = np.broadcast_to(np.eye(3), (n, 3, 3)), np.zeros((n, 3)), np.zeros((n, width, 3))
    for k in range(width):
        t = t + np.einsum("nij,nj->ni", r, move[:, k])
        r = r @ turn[:, k]
        atoms[:, k] = t
    return atoms, r, t


@dataclass
class Summary:
    """What a block adds to a chain: its motion, and sums over its atoms l (in its first frame) and their originals q."""

    r: np.ndarray
    t: np.ndarray
    n: np.ndarray
    l: np.ndarray  # noqa: E741
    q: np.ndarray
    ql: np.ndarray
    ll: np.ndarray
    qq: np.ndarray

    def then(self, other: Summary) -> Summary:
        """Both blocks as one; associative."""
        moved = np.einsum("nij,nj->ni", self.r, other.l)
        return Summary(
            self.r @ other.r, self.t + np.einsum("nij,nj->ni", self.r, other.t), self.n + other.n, self.l + moved + other.n[:, None] * self.t, self.q + other.q,
            self.ql + np.einsum("nij,nkj->nik", other.ql, self.r) + other.q[:, :, None] * self.t[:, None, :],
            self.ll + other.ll + 2 * (self.t * moved).sum(1) + other.n * (self.t**2).sum(1), self.qq + other.qq,
        )

    def flat(self) -> np.ndarray:
        """30 numbers a row."""
        k = len(self.n)
        return np.concatenate([x.reshape(k, -1) for x in (self.r, self.t, self.n, self.l, self.q, self.ql, self.ll, self.qq)], 1)

    @staticmethod
    def of_flat(x: np.ndarray) -> Summary:
        k = len(x)
        return Summary(x[:, :9].reshape(k, 3, 3), x[:, 9:12], x[:, 12], x[:, 13:16], x[:, 16:19], x[:, 19:28].reshape(k, 3, 3), x[:, 28], x[:, 29])

    def rmsd(self) -> np.ndarray:
        """After the best superposition."""
        h = self.ql - self.q[:, :, None] * self.l[:, None, :] / self.n[:, None, None]
        left = self.ll - (self.l**2).sum(1) / self.n + self.qq - (self.q**2).sum(1) / self.n
        return np.sqrt(np.maximum(0, left - 2 * _overlap(h)) / self.n)


def summary(lens: np.ndarray, angs: np.ndarray, dihs: np.ndarray, q: np.ndarray) -> Summary:
    """Of rows of bonds and the originals (rows, bonds, 3) of the atoms behind them."""
    atoms, r, t = walk(lens, angs, dihs)
    n = np.full(len(lens), float(lens.shape[1]))
    return Summary(r, t, n, atoms.sum(1), q.sum(1), np.einsum("nai,naj->nij", q, atoms), (atoms**2).sum((1, 2)), (q**2).sum((1, 2)))


def start_summary(q: np.ndarray) -> Summary:
    """The first atom of each chain, at the origin."""
    k = len(q)
    zero = np.zeros((k, 3))
    return Summary(np.broadcast_to(np.eye(3), (k, 3, 3)), zero, np.ones(k), zero, q, np.zeros((k, 3, 3)), np.zeros(k), (q**2).sum(1))


def _overlap(h: np.ndarray) -> np.ndarray:
    """:func:`_overlap_of` of matrices (..., 3, 3)."""
    return _overlap_of([[h[..., i, j] for j in range(3)] for i in range(3)])


def _overlap_of(h: list[list[np.ndarray]]) -> np.ndarray:
    """The largest trace of a rotation times each matrix, given as its nine cells: the sum of its singular values, the last
    with the sign of its determinant. Eigenvalues of h'h come from the characteristic polynomial, the last singular value
    from the determinant; where two vanish, as for points on a line, the decomposition is computed."""
    (x1, x2, x3), (y1, y2, y3), (z1, z2, z3) = h
    a, b, c = x1 * x1 + y1 * y1 + z1 * z1, x2 * x2 + y2 * y2 + z2 * z2, x3 * x3 + y3 * y3 + z3 * z3
    d, e, f = x1 * x2 + y1 * y2 + z1 * z2, x1 * x3 + y1 * y3 + z1 * z3, x2 * x3 + y2 * y3 + z2 * z3
    m = (a + b + c) / 3
    a, b, c = a - m, b - m, c - m
    r = np.sqrt((a * a + b * b + c * c + 2 * (d * d + e * e + f * f)) / 6)
    det_k = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    t = np.arccos(np.minimum(1, np.maximum(-1, det_k / np.maximum(2 * r * r * r, 1e-300)))) / 3
    along, across = r * np.cos(t), np.sqrt(3) * r * np.sin(t)
    s1, s2 = np.sqrt(np.maximum(0, m + 2 * along)), np.sqrt(np.maximum(0, m - along + across))
    det = x1 * (y2 * z3 - y3 * z2) - x2 * (y1 * z3 - y3 * z1) + x3 * (y1 * z2 - y2 * z1)
    out = s1 + s2 + det / np.maximum(s1 * s2, 1e-300)
    if (thin := s2 <= 1e-5 * s1).any():
        s = np.linalg.svd(np.stack([np.stack([v[thin] for v in row], -1) for row in h], -2), compute_uv=False)
        out[thin] = s[..., 0] + s[..., 1] + np.where(det[thin] < 0, -1.0, 1.0) * s[..., 2]
    return out


def superposed_pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Root mean square distance of each pair of rows of (n, atoms, 3) after superposition."""
    p, q = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
    left = (p**2).sum((1, 2)) + (q**2).sum((1, 2)) - 2 * _overlap(np.einsum("nai,naj->nij", p, q))
    return np.sqrt(np.maximum(0, left) / p.shape[1])


def superposed(p: np.ndarray, q: np.ndarray, cached: int = 8192) -> np.ndarray:
    """(n, m) root mean square distances of superposed point sets (n, atoms, 3) and (m, atoms, 3), in pieces of about
    ``cached`` pairs, whose numbers stay in a core's own memory."""
    p, q = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
    of_p, of_q = (p**2).sum((1, 2)), (q**2).sum((1, 2))
    first, second = [np.ascontiguousarray(p[..., i]) for i in range(3)], [np.ascontiguousarray(q[..., i].T) for i in range(3)]
    out, wide = np.zeros((len(p), len(q))), max(1, min(len(q), cached))
    high = max(1, cached // wide)
    for lo in range(0, len(p), high):
        for at in range(0, len(q), wide):
            h = [[x[lo : lo + high] @ y[:, at : at + wide] for y in second] for x in first]
            left = of_p[lo : lo + high, None] + of_q[None, at : at + wide] - 2 * _overlap_of(h)
            out[lo : lo + high, at : at + wide] = np.sqrt(np.maximum(0, left) / p.shape[1])
    return out


def rmsd_table(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same in whole millionths, so that sums don't depend on their order and ties are ties."""
    return np.rint(MICRO * superposed(p, q)).astype(np.int64)


#: Rounding of single numbers that bounds allow for: of a form of unit shapes, and of what is summed up in a block.
FORM_SLACK, SUM_SLACK = np.float32(2e-6), 3e-5
#: Shapes of more atoms have too many forms: their bounds are the distances themselves.
MOST_ATOMS = 10


class Floors:
    """Point sets (n, atoms, 3), ready for :func:`floor_blocks`.

    The largest trace l of a rotation times h = p'q is the largest root of (l^2 - f)^2 = 4 g + 8 d l, where f and g are the sums
    of the squares of h and of its minors, and d its determinant. All three are inner products of what belongs to p and to q
    alone (minors by the rule of Cauchy and Binet), so a table of pairs takes three products of matrices and no decomposition."""

    def __init__(self, x: np.ndarray):
        self.x, self.atoms = x, x.shape[1]
        z = x - x.mean(1, keepdims=True)
        own = (z**2).sum((1, 2))
        size = np.sqrt(own)
        z = z / np.where(size > 0, size, 1)[:, None, None]
        # Next to a line, where the squares of the minors vanish, :func:`superposed` itself is off by more.
        thin = ((z**2).sum((1, 2)) ** 2 - ((z.transpose(0, 2, 1) @ z) ** 2).sum((1, 2))) / 2 < 4e-4
        self.size, self.own, self.off = size.astype(np.float32), (own * (1 - 4e-6 - 4e-3 * thin)).astype(np.float32), own * (4e-6 + 4e-3 * thin) / self.atoms
        if self.atoms > MOST_ATOMS:
            return
        base = np.zeros((max(3, self.atoms - 1), self.atoms))  # rows that are orthogonal to each other and to a move
        for r in range(1, self.atoms):
            base[r - 1, :r], base[r - 1, r] = 1 / np.sqrt(r * (r + 1)), -r / np.sqrt(r * (r + 1))
        z = np.einsum("rk,nki->nri", base, z)
        pairs, triples = (np.array(list(combinations(range(len(base)), k))) for k in (2, 3))
        m = np.cross(z[:, pairs[:, 0]], z[:, pairs[:, 1]])
        self.f, self.g, self.d = (v.astype(np.float32) for v in (_gram(z), _gram(m), np.linalg.det(z[:, triples])))


def _gram(z: np.ndarray) -> np.ndarray:
    """Inner products of a row's vectors with each other, so weighed that those of two rows multiply to a sum of squares."""
    i, j = np.triu_indices(z.shape[1])
    return (z @ z.transpose(0, 2, 1))[:, i, j] * np.where(i == j, 1, np.sqrt(2))


def floor_blocks(p: Floors, q: Floors, cached: int = 8192) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks (rows of p, rows of q, bounds) of lower bounds of :func:`superposed`, most of them less than a hundredth below it;
    a block is overwritten by the next one.

    Newton's steps come down to the largest root from above, and as rounding is taken off each, never below it."""
    n, m = len(p.x), len(q.x)
    wide = max(1, min(m, 256))
    high = max(1, cached // wide)
    if p.atoms > MOST_ATOMS:
        for lo in range(0, n, high):
            d = superposed(p.x[lo : lo + high], q.x)
            yield slice(lo, min(n, lo + high)), slice(0, m), np.sqrt(np.maximum(0, d * d - p.off[lo : lo + high, None] - q.off))
        return
    one, least, root = np.float32(1), np.float32(1e-3), np.float32(1 / np.sqrt(p.atoms))
    of_f, of_g, of_d = np.ascontiguousarray(q.f.T), np.ascontiguousarray(q.g.T), np.ascontiguousarray(2 * q.d.T)
    held = [np.empty((high, wide), np.float32) for _ in range(7)]
    for lo in range(0, n, high):
        rows = slice(lo, min(n, lo + high))
        own, size = p.own[rows, None], 2 * p.size[rows, None]
        for at in range(0, m, wide):
            columns = slice(at, min(m, at + wide))
            f, g, d, top, t, u, v = (b[: rows.stop - lo, : columns.stop - at] for b in held)
            np.matmul(p.f[rows], of_f[:, columns], out=f), np.matmul(p.g[rows], of_g[:, columns], out=g), np.matmul(p.d[rows], of_d[:, columns], out=d)
            g += FORM_SLACK
            np.maximum(d, 0, out=top)
            top += g
            np.sqrt(np.maximum(top, FORM_SLACK, out=top), out=top)
            top *= 2
            top += f
            np.sqrt(np.maximum(top, 0, out=top), out=top)
            top += FORM_SLACK
            for _ in range(2):
                np.multiply(top, top, out=t)
                t -= f
                np.multiply(t, t, out=u)
                u *= np.float32(0.25)
                u -= g
                t *= top
                t -= d
                u -= np.multiply(d, top, out=v)
                np.maximum(u, 0, out=u)
                u /= np.maximum(t, least, out=t)
                top -= u
            np.minimum(top, one, out=top)
            top *= size
            top *= q.size[columns]
            np.add(own, q.own[columns], out=t)
            t -= top
            np.sqrt(np.maximum(t, 0, out=t), out=t)
            t *= root
            yield rows, columns, t


def floor_sums(p: Floors, q: Floors, weights: np.ndarray) -> np.ndarray:
    """Lower bounds of the weighted sums of the distances of each of ``p`` to all of ``q``."""
    out, w = np.zeros(len(p.x)), weights.astype(np.float32)
    for rows, columns, d in floor_blocks(p, q):
        out[rows] += d @ w[columns]
    return out * (1 - SUM_SLACK)
