"""Sequential numerics on arrays of coordinates, for grouped functions: rebuilding, superposition, scores."""

from __future__ import annotations

import numpy as np

#: Mean backbone geometry: bond lengths in Angstrom and angles in degrees (fixed values).
LENGTHS = {"N:CA": 1.46, "CA:C": 1.54, "C:N": 1.34}
ANGLES = {"N:CA:C": 109.0, "CA:C:N": 116.0, "C:N:CA": 121.0}


def place_atom(a: np.ndarray, b: np.ndarray, c: np.ndarray, length: float, angle: float, torsion: float) -> np.ndarray:
    """The atom d with |cd| = length, angle bcd and torsion abcd.

    >>> d = place_atom(np.array([1.0, 1, 0]), np.array([1.0, 0, 0]), np.zeros(3), 1.0, np.pi / 2, 0.0)
    >>> np.allclose(d, [0, 1, 0])
    True
    """
    bc = c - b
    bc = bc / np.linalg.norm(bc)
    n = np.cross(b - a, bc)
    n = n / np.linalg.norm(n)
    m = np.cross(n, bc)
    local = length * np.array([-np.cos(angle), np.sin(angle) * np.cos(torsion), np.sin(angle) * np.sin(torsion)])
    return c + local[0] * bc + local[1] * m + local[2] * n


def rebuild_chain(lengths: np.ndarray, angles: np.ndarray, torsions: np.ndarray) -> np.ndarray:
    """Coordinates of a chain from internal coordinates: n lengths, n - 1 angles, n - 2 torsions, n + 1 points."""
    n = len(lengths)
    points = np.zeros((n + 1, 3))
    if n:
        points[1] = [lengths[0], 0, 0]
    if n > 1:
        points[2] = points[1] + lengths[1] * np.array([-np.cos(angles[0]), np.sin(angles[0]), 0])
    for k in range(3, n + 1):
        points[k] = place_atom(points[k - 3], points[k - 2], points[k - 1], lengths[k - 1], angles[k - 2], torsions[k - 3])
    return points


def kabsch(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that bring ``p`` onto ``q``; a reflection is never used."""
    cp, cq = p.mean(axis=0), q.mean(axis=0)
    u, _, vt = np.linalg.svd((p - cp).T @ (q - cq))
    sign = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ np.diag([1.0, 1.0, sign]) @ u.T
    return r, cq - r @ cp


def rmsd(p: np.ndarray, q: np.ndarray) -> float:
    """Root mean square distance after superposition of equally many points."""
    if len(p) != len(q):
        raise ValueError("both sets need equally many points")
    r, t = kabsch(p, q)
    return float(np.sqrt((((p @ r.T + t) - q) ** 2).sum(axis=1).mean()))


def lddt(model: np.ndarray, reference: np.ndarray, radius: float = 15.0) -> float:
    """Share of reference distances below ``radius`` that the model keeps within 0.5, 1, 2 and 4; NaN without any."""
    d, e = (np.linalg.norm(x[:, None] - x[None], axis=2) for x in (reference, model))
    near = (d < radius) & ~np.eye(len(d), dtype=bool)
    if not near.any():
        return float("nan")
    off = np.abs(d - e)[near]
    return float(np.mean([(off < t).mean() for t in (0.5, 1.0, 2.0, 4.0)]))


def aligned_tm_score(p: np.ndarray, q: np.ndarray) -> float:
    """TM-score of two chains whose residues correspond one by one, superposed once over all of them."""
    n = len(q)
    d0 = max(0.5, 1.24 * np.cbrt(max(n - 15, 0)) - 1.8)
    r, t = kabsch(p, q)
    d = np.linalg.norm(p @ r.T + t - q, axis=1)
    return float((1 / (1 + (d / d0) ** 2)).mean())


def k_medoids(cost: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Medoids and assignment from a full cost matrix; ties go to the lower index, an empty cluster is reseeded."""
    n = len(cost)
    k = min(n, k)
    rng = np.random.default_rng(seed)
    medoids = np.arange(n) if k == n else np.sort(rng.choice(n, k, replace=False))
    for _ in range(rounds):
        own = cost[:, medoids].argmin(axis=1)
        new = medoids.copy()
        for c in range(k):
            inside = np.flatnonzero(own == c)
            new[c] = inside[cost[np.ix_(inside, inside)].sum(axis=1).argmin()] if len(inside) else rng.integers(n)
        if (new == medoids).all():
            break
        medoids = new
    return medoids, cost[:, medoids].argmin(axis=1)


def best_segmentation(score: np.ndarray) -> tuple[float, float, list[tuple[int, int]]]:
    """Log-partition, best score and best segments of a span table: score[i, l] is that of the l + 1 items from i."""
    n, most = score.shape
    log_z, best, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.zeros(n + 1, int)
    log_z[0] = best[0] = 0.0
    for end in range(1, n + 1):
        length = np.arange(1, min(most, end) + 1)
        own = score[end - length, length - 1]
        z, b = log_z[end - length] + own, best[end - length] + own
        top = z.max()
        log_z[end] = top + np.log(np.exp(z - top).sum()) if np.isfinite(top) else top
        back[end] = length[b.argmax()]
        best[end] = b.max()
    segments, end = [], n
    while end:
        segments.append((end - int(back[end]), end))
        end -= int(back[end])
    return float(log_z[n]), float(best[n]), segments[::-1]


def best_segmentation_2d(unary: np.ndarray, edge: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Best segments where edge[i, a, b] scores a segment of length b + 1 from i behind one of length a + 1."""
    n, most = unary.shape
    best, back = np.full((n + 1, most + 1), -np.inf), np.zeros((n + 1, most + 1), int)
    best[0, 0] = 0.0
    for end in range(1, n + 1):
        for length in range(1, min(most, end) + 1):
            begin = end - length
            before = best[begin].copy()
            before[1:] += edge[begin, :, length - 1] if begin else 0
            back[end, length] = before.argmax()
            best[end, length] = before.max() + unary[begin, length - 1]
    length, end, segments = int(best[n].argmax()), n, []
    while end:
        segments.append((end - length, end))
        length, end = int(back[end, length]), end - length
    return float(best[n].max()), segments[::-1]


def best_hierarchy(unary: np.ndarray, split: np.ndarray) -> tuple[float, float, list[tuple[int, int]]]:
    """Inside score, best score and best leaves over binary trees: unary[i, l] for leaves, split[i, j] for nodes i..j."""
    n, most = unary.shape
    inside, best = np.full((n, n + 1), -np.inf), np.full((n, n + 1), -np.inf)
    cut = np.zeros((n, n + 1), int)
    for width in range(1, n + 1):
        for i in range(n - width + 1):
            j = i + width
            k = np.arange(i + 1, j)
            z, b = inside[i, k] + inside[k, j] + split[i, j - 1], best[i, k] + best[k, j] + split[i, j - 1]
            if width <= most:
                z, b, k = np.append(unary[i, width - 1], z), np.append(unary[i, width - 1], b), np.append(0, k)
            if len(k):
                top = z.max()
                inside[i, j] = top + np.log(np.exp(z - top).sum()) if np.isfinite(top) else top
                best[i, j], cut[i, j] = b.max(), k[b.argmax()]
    leaves, todo = [], [(0, n)]
    while todo:
        i, j = todo.pop()
        if cut[i, j]:
            todo += [(cut[i, j], j), (i, cut[i, j])]
        else:
            leaves.append((i, j))
    return float(inside[0, n]), float(best[0, n]), leaves


def best_hierarchies(unary: np.ndarray, sizes: np.ndarray, node: float) -> list[tuple[float, float, list[tuple[int, int]]]]:
    """:func:`best_hierarchy` of many chains side by side, where every inner node scores ``node``: unary[c, i, l] for leaves of
    chain c, of which the first sizes[c] items count."""
    count, n, most = unary.shape
    # By first item and width, and by end and width: the parts of a span lie in a row of each.
    inside, best = np.full((count, n + 1, n + 1), -np.inf), np.full((count, n + 1, n + 1), -np.inf)
    inside_to, best_to, cut = inside.copy(), best.copy(), np.zeros((count, n + 1, n + 1), np.int32)
    for width in range(1, n + 1):
        i = np.arange(n - width + 1)
        z = inside[:, i, 1:width] + inside_to[:, i + width, width - 1 : 0 : -1] + node
        b = best[:, i, 1:width] + best_to[:, i + width, width - 1 : 0 : -1] + node
        first = 1
        if width <= most:
            own = unary[:, i, width - 1, None]
            z, b, first = np.concatenate([own, z], 2), np.concatenate([own, b], 2), 0
        at = b.argmax(2)
        top = z.max(2)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            total = np.where(np.isfinite(top), safe + np.log(np.exp(z - safe[:, :, None]).sum(2)), top)
        inside[:, i, width] = inside_to[:, i + width, width] = total
        best[:, i, width] = best_to[:, i + width, width] = b.max(2)
        cut[:, i, width] = at + first
    found = []
    for c, size in enumerate(sizes):
        leaves, todo = [], [(0, int(size))]
        while todo:
            i, j = todo.pop()
            k = int(cut[c, i, j - i])
            if k:
                todo += [(i + k, j), (i, i + k)]
            else:
                leaves.append((i, j))
        found.append((float(inside[c, 0, size]), float(best[c, 0, size]), leaves))
    return found


def best_segmentations_2d(unary: np.ndarray, edge: np.ndarray, sizes: np.ndarray) -> list[tuple[float, list[tuple[int, int]]]]:
    """:func:`best_segmentation_2d` of many chains side by side, of which the first sizes[c] items count."""
    count, n, most = unary.shape
    best, back = np.full((count, n + 1, most + 1), -np.inf), np.zeros((count, n + 1, most + 1), np.int32)
    best[:, 0, 0] = 0.0
    for end in range(1, n + 1):
        for length in range(1, min(most, end) + 1):
            begin = end - length
            before = best[:, begin].copy()
            if begin:
                before[:, 1:] += edge[:, begin, :, length - 1]
            back[:, end, length] = before.argmax(1)
            best[:, end, length] = before.max(1) + unary[:, begin, length - 1]
    found = []
    for c, size in enumerate(sizes):
        length, end, segments = int(best[c, size].argmax()), int(size), []
        while end:
            segments.append((end - length, end))
            length, end = int(back[c, end, length]), end - length
        found.append((float(best[c, size].max()), segments[::-1]))
    return found


def end_frame(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes and origin at the last three points."""
    a, b, c = points[-3:]
    x = (c - b) / np.linalg.norm(c - b)
    z = np.cross(x, a - b)
    z = z / np.linalg.norm(z)
    return np.stack([x, np.cross(z, x), z], axis=1), b


def fit_glue(lengths, angles, torsions, slots: list[tuple[str, int]], choices: list[np.ndarray], target: tuple[np.ndarray, np.ndarray], weight_r: float = 0.5, weight_t: float = 0.1, rounds: int = 5, brute: int = 5) -> list[int]:
    """Bins for some angles of a chain, so that its end comes nearest to a target frame.

    ``slots`` name what is free, ("ang" or "dih", index); ``choices`` are the bin centres of each. Few bins are tried in
    all combinations; otherwise one slot after another is set to its best bin until nothing changes.
    """
    import itertools

    angles, torsions = np.array(angles, float), np.array(torsions, float)

    def loss(pick) -> float:
        for (kind, at), options, k in zip(slots, choices, pick, strict=True):
            (angles if kind == "ang" else torsions)[at] = options[k]
        r, t = end_frame(rebuild_chain(np.asarray(lengths, float), angles, torsions))
        return weight_r * float(((r - target[0]) ** 2).sum()) + weight_t * float(((t - target[1]) ** 2).sum())

    if all(len(c) <= brute for c in choices):
        return list(min(itertools.product(*(range(len(c)) for c in choices)), key=loss))
    start = [int(np.abs(np.angle(np.exp(1j * (c - (angles if k == "ang" else torsions)[at])))).argmin()) for (k, at), c in zip(slots, choices, strict=True)]
    pick, best = start, loss(start)
    for _ in range(rounds):
        before = best
        for s in range(len(slots)):
            for k in range(len(choices[s])):
                trial = [*pick[:s], k, *pick[s + 1 :]]
                if (now := loss(trial)) < best - 1e-12:
                    pick, best = trial, now
        if best >= before - 1e-12:
            break
    return pick


def monotone_path(score: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j), both increasing, with the largest sum of non-negative scores; gaps cost nothing.

    >>> monotone_path(np.array([[0.0, 2.0, 0.0], [3.0, 0.0, 0.0], [0.0, 0.0, 1.0]]))
    [(1, 0), (2, 2)]
    """
    n, m = score.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, :-1] + score[i], best[i, 1:]))
    path, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            path.append((i, j))
    return path[::-1]


def tm_align(p: np.ndarray, q: np.ndarray, starts: int = 5, rounds: int = 20, least: int = 3) -> tuple[float, list[tuple[int, int]]]:
    """TM-score by the length of ``q`` and the residue pairs found by a search; NaN for chains of under ``least`` points.

    Every gapless threading is scored, whole and by halves. From the best ``starts`` of them, the superposition on the
    pairs and the pairs from superposed distances follow each other until the score stops growing. The best pairs count.
    """
    n, m = len(p), len(q)
    if min(n, m) < least:
        return float("nan"), []
    d0 = max(0.5, 1.24 * np.cbrt(max(m - 15, 0)) - 1.8)

    def scores(pairs: np.ndarray) -> np.ndarray:
        r, t = kabsch(p[pairs[:, 0]], q[pairs[:, 1]])
        off = ((p @ r.T + t)[:, None] - q[None]) ** 2
        return 1 / (1 + off.sum(axis=2) / d0**2)

    threads = []
    for shift in range(least - n, m - least + 1):
        i = np.arange(max(0, -shift), min(n, m - shift))
        whole = np.stack([i, i + shift], axis=1)
        for pairs in (whole, whole[: len(i) // 2], whole[len(i) // 2 :]):
            if len(pairs) >= least:
                table = scores(pairs)
                threads.append((float(table[whole[:, 0], whole[:, 1]].sum()) / m, table))
    best, found = -1.0, []
    for _, table in sorted(threads, key=lambda x: -x[0])[:starts]:
        last = -1.0
        for _ in range(rounds):
            pairs = monotone_path(table)
            now = sum(table[i, j] for i, j in pairs) / m
            if now > best:
                best, found = now, pairs
            if now <= last + 1e-9 or len(pairs) < least:
                break
            last, table = now, scores(np.array(pairs))
    return float(best), found


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of each join of the two clusters with the least mean distance; ties to the lower numbers.
    Points are 0 to n - 1, the k-th join makes cluster n + k.

    >>> average_linkage(np.array([[0, 1, 4], [1, 0, 6], [4, 6, 0.0]]))
    [(0, 1, 1.0, 2), (2, 3, 5.0, 3)]
    """
    n = len(distance)
    d = np.full((2 * n, 2 * n), np.inf)
    d[:n, :n] = distance
    np.fill_diagonal(d, np.inf)
    size = np.concatenate([np.ones(n), np.zeros(n)])
    joins = []
    for new in range(n, 2 * n - 1):
        a, b = sorted(int(x) for x in np.unravel_index(d.argmin(), d.shape))
        height = float(d[a, b])
        mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        d[new], d[:, new] = mean, mean
        d[[a, b, new], [a, b, new]] = np.inf
        d[[a, b]], d[:, [a, b]] = np.inf, np.inf
        joins.append((a, b, height, int(size[new])))
    return joins


def flat_clusters(joins: list[tuple[int, int, float, int]], n: int, cut: float) -> list[int]:
    """The cluster of each point after all joins up to height ``cut``, named by its smallest point."""
    inside: dict[int, list[int]] = {i: [i] for i in range(n)}
    for k, (a, b, height, _) in enumerate(joins):
        if height <= cut:
            inside[n + k] = inside.pop(a) + inside.pop(b)
    name = {point: min(points) for points in inside.values() for point in points}
    return [name[i] for i in range(n)]


def zernike_invariants(points: np.ndarray, order: int = 8, weights: np.ndarray | None = None) -> list[float]:
    """Rotation-invariant 3-D Zernike descriptors of points in the unit ball: for every n up to ``order`` and every l of
    its parity up to n, the norm over m of the moments. Points beyond the ball count for nothing.

    The radial part is the orthonormal polynomial r^l P_k^(0, l + 1/2)(2 r^2 - 1) with k = (n - l) / 2; the norm over m of
    the spherical harmonics is taken by the addition theorem from pairs of directions, in blocks.
    """
    r = np.linalg.norm(points, axis=1)
    weights = np.ones(len(points)) if weights is None else weights
    inside = r <= 1
    r, w = r[inside], weights[inside]
    unit = points[inside] / np.where(r > 0, r, 1.0)[:, None]
    radial = {}
    for l in range(order + 1):  # noqa: E741
        for n in range(l, order + 1, 2):
            radial[n, l] = np.sqrt(2 * n + 3) * r**l * jacobi((n - l) // 2, l + 0.5, 2 * r**2 - 1) * w
    squared = dict.fromkeys(radial, 0.0)
    for at in range(0, len(r), 1024):
        cosine = np.clip(unit[at : at + 1024] @ unit.T, -1, 1)
        for l in range(order + 1):  # noqa: E741
            legendre = (2 * l + 1) / (4 * np.pi) * jacobi(l, 0.0, cosine)
            for n in range(l, order + 1, 2):
                squared[n, l] += float(radial[n, l][at : at + 1024] @ legendre @ radial[n, l])
    return [float(np.sqrt(max(squared[n, l], 0.0))) for n in range(order + 1) for l in range(n % 2, n + 1, 2)]


def jacobi(k: int, beta: float, x: np.ndarray) -> np.ndarray:
    """The Jacobi polynomial P_k^(0, beta); Legendre's for beta = 0."""
    before, here = np.ones_like(x), (beta + 2) / 2 * x - beta / 2
    if k == 0:
        return before
    for j in range(2, k + 1):
        s = 2 * j + beta
        a = (s - 1) * (s * (s - 2) * x - beta**2)
        b = 2 * (j - 1) * (j + beta - 1) * s
        before, here = here, (a * here - b * before) / (2 * j * (j + beta) * (s - 2))
    return here


def fit_glue_smoothly(lengths, angles, torsions, slots: list[tuple[str, int]], target: tuple[np.ndarray, np.ndarray], prior: list[tuple[float, float]], weight_r: float = 0.5, weight_t: float = 0.1, weight_p: float = 1.0, rounds: int = 20) -> tuple[list[float], float]:
    """Angles for the free slots, and their loss, by quasi-Newton steps (BFGS) on the loss of :func:`fit_glue` plus a von
    Mises prior of (mean, kappa) on each slot; a caller snaps them to bin centres."""
    angles, torsions, lengths = np.array(angles, float), np.array(torsions, float), np.asarray(lengths, float)

    def loss(x: np.ndarray) -> float:
        own, turns = angles.copy(), torsions.copy()
        for (kind, at), v in zip(slots, x, strict=True):
            (own if kind == "ang" else turns)[at] = v
        r, t = end_frame(rebuild_chain(lengths, own, turns))
        held = sum(kappa * (1 - np.cos(v - mean)) for v, (mean, kappa) in zip(x, prior, strict=True))
        return weight_r * float(((r - target[0]) ** 2).sum()) + weight_t * float(((t - target[1]) ** 2).sum()) + weight_p * float(held)

    def slope(x: np.ndarray) -> np.ndarray:
        steps = 1e-6 * np.eye(len(x))
        return np.array([(loss(x + h) - loss(x - h)) / 2e-6 for h in steps])

    x = np.array([(angles if kind == "ang" else torsions)[at] for kind, at in slots])
    now, g, inverse = loss(x), slope(x), np.eye(len(x))
    for _ in range(rounds):
        step = -inverse @ g
        if g @ step >= 0:
            inverse, step = np.eye(len(x)), -g
        size = 1.0
        while size > 1e-8 and loss(x + size * step) > now + 1e-4 * size * (g @ step):
            size /= 2
        if size <= 1e-8:
            break
        s = size * step
        x, before = x + s, g
        now, g = loss(x), slope(x)
        y = g - before
        if (sy := s @ y) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
        if np.abs(g).max() < 1e-6:
            break
    return [float(v) for v in x], now


def rebuild_chains(lengths: np.ndarray, angles: np.ndarray, torsions: np.ndarray) -> np.ndarray:
    """:func:`rebuild_chain` of rows of chains with equally many bonds, side by side."""
    n = lengths.shape[1]
    points = np.zeros((len(lengths), n + 1, 3))
    if n:
        points[:, 1, 0] = lengths[:, 0]
    if n > 1:
        points[:, 2, 0] = points[:, 1, 0] - lengths[:, 1] * np.cos(angles[:, 0])
        points[:, 2, 1] = lengths[:, 1] * np.sin(angles[:, 0])
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    for k in range(3, n + 1):
        a, b, c = points[:, k - 3], points[:, k - 2], points[:, k - 1]
        along = unit(c - b)
        up = unit(np.cross(b - a, along))
        side, bend, turn, length = np.cross(up, along), angles[:, k - 2], torsions[:, k - 3], lengths[:, k - 1]
        parts = (-np.cos(bend), np.sin(bend) * np.cos(turn), np.sin(bend) * np.sin(turn))
        points[:, k] = c + sum((length * p)[:, None] * v for p, v in zip(parts, (along, side, up), strict=True))
    return points


def end_frames(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`end_frame` of each row of points."""
    a, b, c = points[:, -3], points[:, -2], points[:, -1]
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(c - b)
    z = unit(np.cross(x, a - b))
    return np.stack([x, np.cross(z, x), z], axis=-1), b


def fit_glue_rows(lengths: np.ndarray, angles: np.ndarray, torsions: np.ndarray, slots: list[tuple[str, int]], choices: list[np.ndarray], target: tuple[np.ndarray, np.ndarray], weight_r: float = 0.5, weight_t: float = 0.1, rounds: int = 5) -> np.ndarray:
    """The steps of :func:`fit_glue` from slot to slot for many chains of equally many bonds: (rows, slots) bins."""
    angles, torsions = angles.copy(), torsions.copy()
    held = [(angles if kind == "ang" else torsions)[:, at] for kind, at in slots]  # views
    pick = np.stack([np.abs(np.angle(np.exp(1j * (c - v[:, None])))).argmin(1) for v, c in zip(held, choices, strict=True)], 1)

    def loss(rows: np.ndarray, trial: np.ndarray) -> np.ndarray:
        for s, c in enumerate(choices):
            held[s][rows] = c[trial[:, s]]
        r, t = end_frames(rebuild_chains(lengths[rows], angles[rows], torsions[rows]))
        return weight_r * ((r - target[0][rows]) ** 2).sum((1, 2)) + weight_t * ((t - target[1][rows]) ** 2).sum(1)

    rows = np.arange(len(lengths))
    best = loss(rows, pick)
    for _ in range(rounds):
        before = best[rows].copy()
        for s, c in enumerate(choices):
            for k in range(len(c)):
                trial = pick[rows].copy()
                trial[:, s] = k
                now = loss(rows, trial)
                better = now < best[rows] - 1e-12
                pick[rows[better]], best[rows[better]] = trial[better], now[better]
        rows = rows[best[rows] < before - 1e-12]
        if not len(rows):
            break
    return pick


def fit_glue_smoothly_rows(lengths: np.ndarray, angles: np.ndarray, torsions: np.ndarray, slots: list[tuple[str, int]], target: tuple[np.ndarray, np.ndarray], means: np.ndarray, kappa: float, weight_r: float = 0.5, weight_t: float = 0.1, weight_p: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The steps of :func:`fit_glue_smoothly` for many chains of equally many bonds: (rows, slots) angles and losses."""

    def loss(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        own, turns = angles[rows], torsions[rows]  # copies
        for s, (kind, at) in enumerate(slots):
            (own if kind == "ang" else turns)[:, at] = x[:, s]
        r, t = end_frames(rebuild_chains(lengths[rows], own, turns))
        held = (kappa * (1 - np.cos(x - means[rows]))).sum(1)
        return weight_r * ((r - target[0][rows]) ** 2).sum((1, 2)) + weight_t * ((t - target[1][rows]) ** 2).sum(1) + weight_p * held

    def slope(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([(loss(rows, x + h) - loss(rows, x - h)) / 2e-6 for h in 1e-6 * np.eye(len(slots))], 1)

    rows, eye = np.arange(len(lengths)), np.eye(len(slots))
    x = np.stack([(angles if kind == "ang" else torsions)[:, at] for kind, at in slots], 1)
    now, g, inverse = loss(rows, x), slope(rows, x), np.tile(eye, (len(x), 1, 1))
    for _ in range(rounds):
        step = -np.einsum("nij,nj->ni", inverse[rows], g[rows])
        back = (g[rows] * step).sum(1) >= 0
        inverse[rows[back]], step[back] = eye, -g[rows[back]]
        fall, size = (g[rows] * step).sum(1), np.ones(len(rows))
        search = np.arange(len(rows))
        while len(search):
            search = search[size[search] > 1e-8]
            at = rows[search]
            search = search[loss(at, x[at] + size[search, None] * step[search]) > now[at] + 1e-4 * size[search] * fall[search]]
            size[search] /= 2
        moves = size > 1e-8
        rows, s = rows[moves], (size[:, None] * step)[moves]
        if not len(rows):
            break
        x[rows] += s
        before = g[rows]
        now[rows], g[rows] = loss(rows, x[rows]), slope(rows, x[rows])
        y = g[rows] - before
        sy = (s * y).sum(1)
        up = sy > 1e-12
        s, y, sy, of = s[up], y[up], sy[up], rows[up]
        left = eye - s[:, :, None] * y[:, None, :] / sy[:, None, None]
        inverse[of] = left @ inverse[of] @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / sy[:, None, None]
        rows = rows[~(np.abs(g[rows]).max(1) < 1e-6)]
        if not len(rows):
            break
    return x, now
