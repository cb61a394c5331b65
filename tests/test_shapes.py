"""Shapes, medoids and scans against sequential code that rebuilds everything."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions.numeric import place_atom, rebuild_chain, rmsd
from chainloom.functions.rigid import Summary, rmsd_table, start_summary, summary
from chainloom.operators import medoids, shapes, structures
from chainloom.operators.bins import equal_width_edges
from chainloom.operators.clusters import fit_ends, rebuild
from chainloom.operators.scans import products, rebuild_long
from chainloom.plans.shapes import classes_for, encode_shapes, learn_shapes

EDGES = {"omega": equal_width_edges(0.0, 2 * np.pi, 3), "c_n_ca": equal_width_edges(1.0, 3.0, 3), "phi": equal_width_edges(0.0, 2 * np.pi, 3)}
CENTRES = [(np.array(e[1:]) + np.array(e[:-1])) / 2 for e in EDGES.values()]


def random_chains(n=10, residues=7, seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for c in range(n):
        k = 3 * (residues + c % 3) - 1
        angles, turns = 1.9 + 0.3 * rng.normal(size=k - 1), rng.choice([-1.0, 0.9, 2.6], size=k - 2) + 0.1 * rng.normal(size=k - 2)
        points = rebuild_chain(1.4 + 0.1 * rng.random(k), angles, turns)
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        out[f"c{c:02}"] = points @ (q * np.sign(np.linalg.det(q))).T + rng.normal(size=3) * 5
    return out


def tables(spark, chains):
    rows = [(c, k, *map(float, p)) for c, points in chains.items() for k, p in enumerate(points)]
    atoms = spark.createDataFrame(rows, "chain_id string, k int, x double, y double, z double")
    return structures.bonds(atoms), atoms


def internal(points):
    """Lengths, angles (from the second bond) and dihedrals (from the third), None before."""
    v = np.diff(points, axis=0)
    out = []
    for k in range(len(v)):
        ang = dih = None
        if k:
            ang = float(np.arccos(np.dot(-v[k - 1], v[k]) / np.linalg.norm(v[k - 1]) / np.linalg.norm(v[k])))
        if k > 1:
            a, b = np.cross(v[k - 2], v[k - 1]), np.cross(v[k - 1], v[k])
            dih = float(np.arctan2(np.dot(np.cross(a, b), v[k - 1] / np.linalg.norm(v[k - 1])), np.dot(a, b)))
        out.append([float(np.linalg.norm(v[k])), ang, dih])
    return out


class Plain:
    """The same learning, one list of tokens for each chain, everything rebuilt whenever it is needed."""

    def __init__(self, chains, classes, original, refit):
        self.points, self.classes, self.original, self.refit = chains, classes, original, refit
        self.bonds = {c: internal(p) for c, p in chains.items()}
        self.tokens, self.glue, self.sets, self.names = {}, {}, {}, {}
        for c, bonds in self.bonds.items():
            self.tokens[c] = [(s, min(3, len(bonds) - s), f"r{min(3, len(bonds) - s)}") for s in range(0, len(bonds), 3)]
            for s, _, _ in self.tokens[c][1:]:
                values = (bonds[s][2], bonds[s][1], bonds[s + 1][2])
                self.snap(c, s, [sum(v % (2 * np.pi) >= x for x in e[1:-1]) for v, e in zip(values, EDGES.values(), strict=True)])
        for name in ("r2", "r3"):
            where = [(c, i) for c in sorted(chains) for i, t in enumerate(self.tokens[c]) if t[2] == name]
            if where:
                self.part(name, where)

    def snap(self, c, s, bins):
        self.glue[c, s] = tuple(bins)
        self.bonds[c][s][2], self.bonds[c][s][1], self.bonds[c][s + 1][2] = (float(x[b]) for x, b in zip(CENTRES, bins, strict=True))

    def shape(self, c, s, w):
        if self.original:
            return self.points[c][s : s + w + 1]
        own = self.bonds[c][s : s + w]
        return rebuild_chain(np.array([b[0] for b in own]), np.array([b[1] for b in own[1:]]), np.array([b[2] for b in own[2:]]))

    def part(self, name, where, known=False):
        """Deal occurrences to classes, learning these first, and set their geometry."""
        places = [(c, *self.tokens[c][i][:2]) for c, i in where]
        own = [self.shape(*p) for p in places]
        if not known:
            chosen = plain_medoids(own, classes_for(places[0][2], self.classes))
            self.sets[name] = [(own[i], [list(b) for b in self.bonds[places[i][0]][places[i][1] : places[i][1] + places[i][2]]]) for i in chosen]
        sets = self.sets[name]
        for (c, i), (_, s, w), x in zip(where, places, own, strict=True):
            p = min(range(len(sets)), key=lambda p: (round(rmsd(x, sets[p][0]), 6), p))
            self.tokens[c][i] = (s, w, f"{name}.{p}")
            before = [list(b) for b in self.bonds[c][s : s + w]]
            for j, b in enumerate(sets[p][1]):
                self.bonds[c][s + j] = [b[0], b[1] if j else self.bonds[c][s][1], b[2] if j > 1 else self.bonds[c][s + j][2]]
            if self.refit and s and not name.startswith("r"):
                self.fit(c, s, w, before)

    def fit(self, c, s, w, before):
        goal = exit_frame(before)
        best = None
        for a in range(3):
            for b in range(3):
                for d in range(3):
                    self.snap(c, s, (a, b, d))
                    r, t = exit_frame(self.bonds[c][s : s + w])
                    loss = round(0.5 * ((r - goal[0]) ** 2).sum() + 0.1 * ((t - goal[1]) ** 2).sum(), 9)
                    if best is None or loss < best[0]:
                        best = loss, (a, b, d)
        self.snap(c, s, best[1])

    def counts(self):
        return Counter((a[2], b[2], *self.glue[c, b[0]]) for c, own in self.tokens.items() for a, b in zip(own, own[1:], strict=False))

    def step(self, least=2):
        found = {k: n for k, n in self.counts().items() if k in self.names or n >= least}
        if not found:
            return False
        key = min(found, key=lambda k: (k not in self.names, -found[k], k))
        known = key in self.names
        name = self.names.setdefault(key, f"m{len(self.names) + 1}")
        where = []
        for c in sorted(self.tokens):
            out, own, i = [], self.tokens[c], 0
            while i < len(own):
                if i + 1 < len(own) and (own[i][2], own[i + 1][2], *self.glue[c, own[i + 1][0]]) == key:
                    where.append((c, len(out)))
                    out.append((own[i][0], own[i][1] + own[i + 1][1], name))
                    i += 2
                else:
                    out.append(own[i])
                    i += 1
            self.tokens[c] = out
        self.part(name, where, known)
        return True

    def rmsd(self, c):
        b = self.bonds[c]
        return rmsd(rebuild_chain(np.array([x[0] for x in b]), np.array([x[1] for x in b[1:]]), np.array([x[2] for x in b[2:]])), self.points[c])


def exit_frame(bonds):
    """Direction and place of the end of some bonds behind a fixed start."""
    points = [np.array([-1.0, -1.0, 0.0]), np.array([-1.0, 0.0, 0.0]), np.zeros(3)]
    for length, ang, dih in bonds:
        points.append(place_atom(*points[-3:], length, ang, dih))
    x = points[-1] - points[-2]
    z = np.cross(points[-2] - points[-3], x)
    x, z = x / np.linalg.norm(x), z / np.linalg.norm(z)
    start = np.stack([np.array([1.0, 0, 0]), np.array([0, -1.0, 0]), np.array([0, 0, -1.0])], 1)  # the frame at the start
    return start.T @ np.stack([x, np.cross(z, x), z], 1), start.T @ points[-1]


def plain_medoids(own, k):
    d = np.array([[round(rmsd(a, b), 6) for b in own] for a in own])
    chosen = [int(d.sum(1).round(6).argmin())]
    while len(chosen) < k and d[:, chosen].min(1).max() > 0:
        chosen.append(int(d[:, chosen].min(1).argmax()))
    for _ in range(10 if len(chosen) > 1 else 0):
        to = d[:, chosen].argmin(1)
        new = [chosen[c] if not (to == c).any() else min(np.flatnonzero(to == c).tolist(), key=lambda i: (round(d[i, to == c].sum(), 6), i)) for c in range(len(chosen))]
        if new == chosen:
            break
        chosen = new
    return chosen


@pytest.mark.parametrize(("original", "refit", "local"), [(True, False, 1024), (False, True, 1024), (False, True, 4)])
def test_learning_against_plain_lists(spark, original, refit, local):
    chains = random_chains(8 if local < 100 else 12)
    classes, steps = {2: 2, 6: 2, 9: 1}, 2 if local < 100 else 4
    plain = Plain(chains, classes, original, refit)
    bonds, atoms = tables(spark, chains)
    residues = shapes.residue_shapes(bonds, atoms, EDGES)
    errors = {(c, 0): plain.rmsd(c) for c in chains}
    seen = []

    def watch(event, held, counts):
        assert plain.step()
        got = {(r.chain, r.pos): (r.start, r.width, r.token) for r in held.collect()}
        assert got == {(c, i): t for c, own in plain.tokens.items() for i, t in enumerate(own)}
        assert {tuple(r[:5]): r.n for r in counts.select("left", "right", "g1", "g2", "g3", "n").collect()} == plain.counts()
        assert {tuple(r[:5]): r.n for r in shapes.shape_pair_counts(held).collect()} == plain.counts()
        errors.update({((c), event): plain.rmsd(c) for c in chains})
        seen.append(event)

    vocabulary, held = learn_shapes(residues, steps, classes, EDGES, original, refit, local=local, watch=watch)
    assert len(seen) >= steps
    coded, found = encode_shapes(residues, vocabulary, EDGES, original, refit)
    assert sorted((r.chain, r.pos, r.token) for r in coded.collect()) == sorted((r.chain, r.pos, r.token) for r in held.collect())
    rows = found.collect()
    assert {(r.chain, r.event) for r in rows} == set(errors)
    for r in rows:
        assert abs(r.rmsd - errors[r.chain, r.event]) < 1e-5
    assert {r.chain: r.tokens for r in rows if r.event == seen[-1]} == {c: len(t) for c, t in plain.tokens.items()}


def test_no_chains_and_short_ones(spark):
    bonds, atoms = tables(spark, {"a": random_chains(1)["c00"][:3]})
    none = shapes.residue_shapes(bonds.filter("false"), atoms.filter("false"), EDGES)
    vocabulary, held = learn_shapes(none, 3, {1: 2}, EDGES)
    assert vocabulary.count() == held.count() == 0
    vocabulary, held = learn_shapes(shapes.residue_shapes(bonds, atoms, EDGES), 3, {1: 2}, EDGES)
    assert [(r.token, r.width) for r in held.collect()] == [("r2.0", 2)] and vocabulary.count() == 1
    other = shapes.residue_shapes(*tables(spark, random_chains(1)), EDGES)
    with pytest.raises(Exception, match="no prototype for r3"):
        encode_shapes(other, vocabulary, EDGES)[0].collect()


def test_medoids_without_a_cap(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 5, 3))
    own = [base[i % 3] + 0.2 * rng.normal(size=(5, 3)) for i in range(150)] + [base[0]] * 5
    keys = [("x", i) for i in range(len(own))]
    rows = spark.createDataFrame([("x", i, p.reshape(-1).tolist()) for i, p in enumerate(own)], "chain string, start bigint, shape array<double>").repartition(5)
    for k in (1, 3):
        want = [("x", i) for i in plain_medoids(own, k)]
        assert [m[0] for m in medoids.lloyd(medoids.Here(keys, [p.reshape(-1) for p in own]), k)] == want
        assert [m[0] for m in medoids.find_medoids(rows, k)] == want
        assert [m[0] for m in medoids.find_medoids(rows, k, local=10)] == want
        bounded = [m[0] for m in medoids.find_medoids(rows, k, budget=40)]
        assert len(bounded) == k and bounded == [m[0] for m in medoids.find_medoids(rows, k, local=10, budget=40)]
    assert medoids.find_medoids(rows.filter("false"), 2) == []
    same = rows.filter("start >= 150")
    assert [m[0] for m in medoids.find_medoids(same, 3)] == [m[0] for m in medoids.find_medoids(same, 3, local=1)] == [("x", 150)]


def test_sums_are_associative_and_give_the_rmsd(spark):
    chains = random_chains(3)
    for c, points in chains.items():
        bonds = np.array([[np.nan if v is None else v for v in b] for b in internal(points)])
        other = points + np.random.default_rng(1).normal(size=points.shape)
        cut = [0, 4, 5, 11, len(bonds)]
        parts = [summary(*(bonds[None, a:b, i] for i in range(3)), other[None, a + 1 : b + 1]) for a, b in zip(cut, cut[1:], strict=False)]
        whole = start_summary(other[:1]).then(parts[0].then(parts[1]).then(parts[2].then(parts[3])))
        assert abs(whole.rmsd()[0] - rmsd(points, other)) < 1e-9
        assert abs(rmsd_table(points[None], other[None])[0, 0] / 1e6 - rmsd(points, other)) < 1e-6
        rows = spark.createDataFrame([("c", i, p.flat()[0].tolist()) for i, p in enumerate(parts)], "chain string, pos bigint, sums array<double>")
        for block in (2, 3, 256):
            got = Summary.of_flat(np.array([products(rows, block=block).first()["sums"]]))
            assert abs(start_summary(other[:1]).then(got).rmsd()[0] - rmsd(points, other)) < 1e-9


def test_long_chains_are_dealt_over_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(c, k, 1.4, 2.0 + 0.1 * rng.random(), 3 * rng.random()) for c, n in (("a", 300), ("b", 1), ("c", 17)) for k in range(n)]
    df = spark.createDataFrame(rows, "chain string, pos int, len double, ang double, dih double").repartition(4)
    want = {(r.chain, r.pos): (r.x, r.y, r.z) for r in rebuild(df, "chain", "pos", "len", "ang", "dih").collect()}
    for block in (4, 16, 1000):
        got = {(r.chain, r.pos): (r.x, r.y, r.z) for r in rebuild_long(df, "chain", "pos", "len", "ang", "dih", block).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-7) for k in want)
    assert rebuild_long(df.filter("false"), "chain", "pos", "len", "ang", "dih").count() == 0
    long = spark.range(20_000).select(F.lit("z").alias("chain"), F.col("id").alias("pos"), F.lit(1.4).alias("len"), (2 + 0.1 * F.sin("id")).alias("ang"), F.cos("id").alias("dih"))
    got = np.array([(r.x, r.y, r.z) for r in rebuild_long(long, "chain", "pos", "len", "ang", "dih").orderBy("pos").collect()])
    flat = np.array([(r.len, r.ang, r.dih) for r in long.orderBy("pos").collect()])
    assert np.allclose(got, rebuild_chain(flat[:, 0], flat[1:, 1], flat[2:, 2]), atol=1e-5)


def test_lddt_by_cells_and_fits_by_row(spark):
    from chainloom.functions.numeric import lddt

    rng = np.random.default_rng(6)
    chains = {c: rng.normal(size=(30, 3)) * 8 for c in "ab"} | {"far": np.array([[0.0, 0, 0], [100.0, 0, 0]])}
    models = {c: p + rng.normal(size=p.shape) for c, p in chains.items()}
    rows = lambda of: spark.createDataFrame([(c, k, *map(float, x)) for c, p in of.items() for k, x in enumerate(p)], "chain string, k int, x double, y double, z double")
    got = {r.chain: r.lddt for r in structures.lddt(rows(chains), rows(models), 10.0).collect()}
    assert set(got) == {"a", "b"} and all(abs(got[c] - lddt(models[c], chains[c], 10.0)) < 1e-12 for c in got)
    part = structures.lddt(rows(chains), rows(models).filter("k < 20"), 10.0).collect()
    assert all(r.lddt < got[r.chain] for r in part)
    assert structures.lddt(rows(chains).filter("false"), rows(models)).count() == 0
    goal = [0.5, 1.0, -1.0, 2.0, 0.3, -0.7, 1.1, 0.2, 0.9]
    df = spark.createDataFrame([(1, [1.5] * 11, [1.9] * 10, [*goal[:3], *(g + 0.3 for g in goal[3:6]), *goal[6:]], goal)], "id int, lens array<double>, angs array<double>, dihs array<double>, goal array<double>")
    free = [("dih", 3), ("dih", 4), ("dih", 5)]
    r = fit_ends(df, "id", free).first()
    assert r.loss < 1e-4
    grid = [[g - 1.0, g, g + 1.0] for g in goal[3:6]]
    assert fit_ends(df, "id", free, grid).first()["values"] == [1.0, 1.0, 1.0]


def test_unknown_ids_raise_or_are_named(spark):
    from chainloom.operators.chains import decode_ids

    ids = spark.createDataFrame([("a", 0, 7), ("a", 1, 9)], "chain string, pos int, id bigint")
    vocabulary = spark.createDataFrame([("x", 7)], "token string, id bigint")
    assert sorted(r.token for r in decode_ids(ids, vocabulary, "?").collect()) == ["?", "x"]
    with pytest.raises(Exception, match="unknown id: 9"):
        decode_ids(ids, vocabulary).collect()


def test_medoids_where_bounds_rule_nothing_out(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4, 3))
    rows = [("c" + str(i % 7), i, v.reshape(-1).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "chain string, start long, shape array<double>").repartition(3)
    asked = []
    least = medoids.Spread._least
    monkeypatch.setattr(medoids, "PART", 64), monkeypatch.setattr(medoids, "CANDIDATES", 4)
    monkeypatch.setattr(medoids.Spread, "_least", lambda self, *a: asked.append(a[1:]) or least(self, *a))
    assert medoids.find_medoids(df, 2, local=10) == medoids.find_medoids(df, 2, local=1000) and asked


def test_bounds_without_decompositions_stay_below_distances():
    from chainloom.functions.rigid import Floors, floor_blocks, floor_sums, superposed

    rng = np.random.default_rng(13)
    for atoms in (1, 2, 3, 4, 7, 11):
        base = rng.normal(size=(60, atoms, 3))
        flat, thin, twin = base.copy(), base.copy(), base * np.array([1, 1, -1])
        flat[..., 2], thin[..., 1:] = 0, 1e-5 * thin[..., 1:]
        x = np.concatenate([base, flat, thin, twin, 1e-3 * base, 300 * base, base + 1e-6, np.zeros((1, atoms, 3))])
        d, f = superposed(x, x), Floors(x)
        for rows, columns, low in floor_blocks(f, f):
            assert (low <= d[rows, columns] * (1 + 1e-6)).all()
        own, w = Floors(base), rng.integers(1, 9, len(base))
        sums = superposed(base, base) @ w
        assert (floor_sums(own, own, w) <= sums).all() and (atoms < 3 or (floor_sums(own, own, w) >= 0.95 * sums).all())


def test_medoids_of_open_classes_meet_shares(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 4, 3))
    x[400:] = x[:100]  # copies count, and the smaller key of equal shapes comes first
    df = spark.createDataFrame([("c" + str(i % 7), i, v.reshape(-1).tolist()) for i, v in enumerate(x)], "chain string, start long, shape array<double>")
    want = medoids.lloyd(medoids.Here([("c" + str(i % 7), i) for i in range(500)], [v.reshape(-1) for v in x]), 1)
    monkeypatch.setattr(medoids, "CANDIDATES", 4), monkeypatch.setattr(medoids, "AT_ONCE", 0), monkeypatch.setattr(medoids, "PER_PIVOT", 8)
    monkeypatch.setattr(medoids, "SHARES", (1, 3)), monkeypatch.setattr(medoids, "CHECKED", 2), monkeypatch.setattr(medoids, "TASKS", 4)
    assert medoids.lloyd(medoids.Spread(df), 1) == want


def test_fits_of_many_rows_are_those_of_each(monkeypatch):
    from chainloom.functions import numeric

    rng = np.random.default_rng(12)
    lens, angs, goal = np.full((30, 11), 1.5), np.full((30, 10), 1.9), rng.uniform(0, 3, (30, 9))
    dihs, slots = goal.copy(), [("dih", 3), ("ang", 4), ("dih", 5)]
    dihs[:, 3:6] += 0.3
    targets = numeric.end_frames(numeric.rebuild_chains(lens, angs, goal))
    one = [numeric.end_frame(rebuild_chain(*v)) for v in zip(lens, angs, goal, strict=True)]
    assert np.allclose(targets[0], [r for r, _ in one]) and np.allclose(targets[1], [t for _, t in one])
    grid = [np.linspace(-3, 3, 8)] * 3
    want = [numeric.fit_glue(*v, slots, grid, t) for *v, t in zip(lens, angs, dihs, one, strict=True)]
    assert numeric.fit_glue_rows(lens, angs, dihs, slots, grid, targets).tolist() == want
    x, loss = numeric.fit_glue_smoothly_rows(lens, angs, dihs, slots, targets, goal[:, 3:6], 0.2)
    each = [numeric.fit_glue_smoothly(*v[:3], slots, v[4], [(m, 0.2) for m in v[3][3:6]]) for v in zip(lens, angs, dihs, goal, one, strict=True)]
    assert np.allclose(x, [e[0] for e in each], atol=1e-6) and np.allclose(loss, [e[1] for e in each], atol=1e-9)
