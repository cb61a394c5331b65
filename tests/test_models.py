import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom import __main__ as command
from chainloom.functions import numeric
from chainloom.operators import chains, clusters, models, spans, stats
from chainloom.plans import queries
from chainloom.plans.learn import learn

RNG = np.random.default_rng(5)


def turned(points, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return points @ (q * np.sign(np.linalg.det(q))).T + [4.0, -2.0, 7.0]


def walk(n, seed=2):
    return np.cumsum(np.random.default_rng(seed).normal(size=(n, 3)) * 2, axis=0)


def test_tm_align_finds_gaps():
    q = walk(40)
    kept = [i for i in range(40) if i not in (7, 8, 20)]
    score, pairs = numeric.tm_align(turned(q[kept]), q)
    assert math.isclose(score, 37 / 40, abs_tol=1e-9) and pairs == list(enumerate(kept))
    assert math.isnan(numeric.tm_align(q[:2], q)[0])
    assert numeric.tm_align(walk(40, 9), q)[0] < 0.7


def test_monotone_path_against_all():
    for seed in range(20):
        table = np.random.default_rng(seed).random((4, 5))
        best = max(sum(table[i, j] for i, j in zip(a, b)) for k in range(5) for a in itertools.combinations(range(4), k) for b in itertools.combinations(range(5), k))
        assert math.isclose(sum(table[i, j] for i, j in numeric.monotone_path(table)), best)


def test_average_linkage_against_means():
    x = RNG.normal(size=(12, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    inside = {i: [i] for i in range(12)}
    for k, (a, b, height, size) in enumerate(numeric.average_linkage(d)):
        mean = {pair: d[np.ix_(inside[pair[0]], inside[pair[1]])].mean() for pair in itertools.combinations(sorted(inside), 2)}
        assert math.isclose(height, min(mean.values())) and math.isclose(mean[a, b], height)
        inside[12 + k] = inside.pop(a) + inside.pop(b)
        assert size == len(inside[12 + k])
    joins = numeric.average_linkage(d)
    assert numeric.flat_clusters(joins, 12, -1.0) == list(range(12)) and set(numeric.flat_clusters(joins, 12, 99.0)) == {0}
    assert numeric.average_linkage(np.zeros((1, 1))) == []


def test_zernike_is_orthonormal_and_invariant():
    r = np.linspace(0, 1, 4001)
    for l in (0, 1, 4):  # noqa: E741
        radial = [np.sqrt(2 * n + 3) * r**l * numeric.jacobi((n - l) // 2, l + 0.5, 2 * r**2 - 1) for n in (l, l + 2, l + 4)]
        gram = [[np.trapezoid(a * b * r * r, r) for a in radial] for b in radial]
        assert np.allclose(gram, np.eye(3), atol=1e-4)
    p = RNG.normal(size=(300, 3)) * 0.2
    a, b = numeric.zernike_invariants(p), numeric.zernike_invariants(turned(p) - [4.0, -2.0, 7.0])
    assert len(a) == 25 and np.allclose(a, b) and not np.allclose(a, numeric.zernike_invariants(p * [2, 1, 1]))


def test_zernike_takes_single_points(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0, 1.0, 1.0, 1.0])], "k int, flat array<double>")
    found = {r.key: r.descriptor for r in clusters.zernike(rows, "k", "flat", 4).collect()}
    assert all(len(v) == 9 and np.isfinite(v).all() for v in found.values())


def test_smooth_glue_reaches_its_target():
    turn = np.random.default_rng(3).uniform(-2, 2, 9)
    lengths, bend, bent = np.full(11, 1.5), np.full(10, 1.9), turn.copy()
    bent[3:6] += [0.3, -0.2, 0.25]
    slots = [("dih", 3), ("dih", 4), ("dih", 5)]
    target = numeric.end_frame(numeric.rebuild_chain(lengths, bend, turn))
    found, loss = numeric.fit_glue_smoothly(lengths, bend, bent, slots, target, [(0.0, 0.0)] * 3, rounds=60)
    assert loss < 1e-6
    held, _ = numeric.fit_glue_smoothly(lengths, bend, bent, slots, target, [(float(b), 1e6) for b in bent[3:6]])
    assert np.allclose(held, bent[3:6], atol=1e-3)


def cuts(n, most):
    for k in range(n):
        for inner in itertools.combinations(range(1, n), k):
            edges = [0, *inner, n]
            if all(b - a <= most for a, b in itertools.pairwise(edges)):
                yield list(itertools.pairwise(edges))


def test_segmentations_by_scores_against_all(spark):
    n, most = 6, 3
    own = {(a, b): float(RNG.normal()) for a in range(n) for b in range(a + 1, min(n, a + most) + 1)}
    edge = {(a, m, b): float(RNG.normal()) for a, m in own for m2, b in own if m == m2}
    rows = spark.createDataFrame([("x", a, b, s) for (a, b), s in own.items()], "chain string, lo long, hi long, score double")
    pairs = spark.createDataFrame([("x", a, m, b, s) for (a, m, b), s in edge.items()], "chain string, lo long, mid long, hi long, score double")
    total = lambda segments: sum(own[s] for s in segments) + sum(edge[a, m, b] for (a, m), (_, b) in itertools.pairwise(segments))
    best = max(cuts(n, most), key=total)
    found = clusters.segment_pairs(rows, pairs, most).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in found] == best and math.isclose(found[0].best, total(best))
    # with one score for every inner node, a tree's score is that of its leaves
    by_leaves = lambda segments: sum(own[s] for s in segments) - 0.3 * (len(segments) - 1)
    best = max(cuts(n, most), key=by_leaves)
    tree = clusters.segment_tree(rows, most, -0.3).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in tree] == best and math.isclose(tree[0].best, by_leaves(best))


def test_hierarchy_sums_over_all_trees():
    n, most = 5, 2
    unary, split = RNG.normal(size=(n, most)), RNG.normal(size=(n, n))

    def trees(i, j):
        if j - i <= most:
            yield unary[i, j - i - 1]
        for k in range(i + 1, j):
            for a in trees(i, k):
                for b in trees(k, j):
                    yield a + b + split[i, j - 1]

    every = np.array(list(trees(0, n)))
    log_z, best, _ = numeric.best_hierarchy(unary, split)
    assert math.isclose(log_z, np.log(np.exp(every).sum())) and math.isclose(best, every.max())


def test_span_scores(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 2.0, 1.0])], "chain string, pos long, v double")
    layers = [([[1.0, 2.0, 3.0, 4.0]], [0.5])]
    table = spans.spans(rows, "chain", "pos", "v", 2)
    found = {(r.lo, r.hi): r.score for r in spans.score_spans(table, 0.7, layers, 0.25).collect()}
    assert set(found) == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    w = np.exp(0.7 * np.array([0.5, 2.0]))
    wanted = (w @ [0.5, 2.0]) / w.sum() + 2 * 1.25 + 3 * 0.5625 + 4 * 2 / 500 + 0.5 - 0.25
    assert math.isclose(found[0, 2], wanted)
    assert spans.score_neighbours(table, 0.7, [([[0.0] * 4 + [0.0, 1.0, 0.0, 0.0]], [0.0])]).filter("lo = 0 AND mid = 1 AND hi = 3").first().score == 1.5
    assert spans.spans(rows.limit(0), "chain", "pos", "v", 2).count() == 0


def test_angle_kmeans(spark):
    rows = [(i, float(c + e)) for i, (c, e) in enumerate(itertools.product((3.1, 0.0), (-0.2, -0.1, 0.0, 0.1, 0.2)))]
    rows = [(i, math.remainder(v, 2 * math.pi)) for i, v in rows] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, phi double")
    centres, found = clusters.angle_kmeans(df, ["phi"], [[2.0], [1.0], [-1.5]], 10)
    assert abs(math.remainder(centres[0][0] - 3.1, 2 * math.pi)) < 1e-6 or abs(math.remainder(centres[2][0] - 3.1, 2 * math.pi)) < 0.2
    by = {r.i: r.cluster for r in found.collect()}
    assert by[99] is None and len({by[i] for i in range(5, 10)}) == 1


@pytest.mark.parametrize("hidden", [None, [8]])
def test_probe_learns_labels_of_any_numbers(spark, hidden):
    rows = [(i, [float(RNG.normal() + 4 * (i % 3)), float(RNG.normal())], [7, -2, 30][i % 3]) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 7), (901, [1.0, 1.0], None)], "k int, v array<double>, y int")
    found = models.probe(df, "k", "v", "y", F.col("k") % 5 == 0, hidden=hidden, rounds=100).collect()
    assert len(found) == 300
    found = [r for r in found if r.held_out]
    assert len(found) == 60 and all(r.k % 5 == 0 for r in found)
    assert {r.predicted for r in found} <= {7, -2, 30}
    assert sum(r.predicted == r.label for r in found) >= 52


def macro_f1_of(rows):
    classes = {c for r in rows for c in (r.label, r.predicted)}
    parts = [2 * sum(r.label == r.predicted == c for r in rows) / sum((r.label == c) + (r.predicted == c) for r in rows) for c in classes]
    return sum(parts) / len(parts)


@pytest.mark.parametrize("metric", ["macro_f1", "auroc"])
def test_a_watched_probe_stops_and_keeps_its_best(spark, metric):
    names = [7, -2, 30] if metric == "macro_f1" else [5, 9]
    rows = [(i, [float(RNG.normal() + 1.5 * (i % len(names))), float(RNG.normal())], names[i % len(names)]) for i in range(240)]
    df = spark.createDataFrame([*rows, (900, None, 7), (901, [1.0, 1.0], None)], "k int, v array<double>, y int")
    part = F.when(F.col("k") % 5 == 0, "valid").when(F.col("k") % 5 == 1, "test").otherwise("train")
    history, found = models.watched_probe(df, "k", "v", "y", part, metric, burst=2, patience=2, most=6)
    history, found = history.orderBy("burst").collect(), found.collect()
    assert len(found) == 240 and [r.burst for r in history] == list(range(1, len(history) + 1)) and sum(r.best for r in history) == 1
    at = next(r.burst for r in history if r.best)
    # The first of the best counts, and training ends `patience` bursts behind it, or at the last one allowed.
    assert [r.value for r in history].index(max(r.value for r in history)) + 1 == at and len(history) == min(6, at + 2)
    valid = [r for r in found if r.part == "valid"]
    assert len(valid) == 48
    if metric == "macro_f1":
        value = macro_f1_of(valid)
    else:
        pairs = [(a.score, b.score) for a in valid for b in valid if a.label == 9 and b.label == 5]
        value = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert math.isclose(value, history[at - 1].value, abs_tol=1e-9)


def test_a_watched_probe_says_what_it_lacks(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 2), (3, [2.0], 3)], "k int, v array<double>, y int")
    for part, metric in ((F.lit("train"), "macro_f1"), (F.lit("valid"), "macro_f1"), (F.when(F.col("k") < 9, "train"), "other")):
        with pytest.raises(ValueError):
            models.watched_probe(df, "k", "v", "y", part, metric)


def test_tm_scores_of_pairs(spark):
    p = RNG.normal(size=(20, 3)) * 8
    turn = np.linalg.qr(RNG.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    rows = [(0, (p @ turn.T + 3).ravel().tolist(), p.ravel().tolist()), (1, None, p.ravel().tolist()), (2, p[:2].ravel().tolist(), p.ravel().tolist()), (3, (p + RNG.normal(size=p.shape)).ravel().tolist(), p.ravel().tolist())]
    found = {r.key: r.tm for r in clusters.tm_pairs(spark.createDataFrame(rows, "k int, a array<double>, b array<double>"), "k", "a", "b").collect()}
    assert math.isclose(found[0], 1.0, abs_tol=1e-9) and found[1] is None and found[2] is None
    assert math.isclose(found[3], numeric.tm_align(np.array(rows[3][1]).reshape(-1, 3), p)[0], abs_tol=1e-12)


def test_generation_metrics(spark):
    designs = spark.createDataFrame([(1, 0.7), (1, 0.2), (2, 0.4), (3, None)], "b int, score double")
    held = stats.designability(designs, "b", "score", 0.5)
    assert {(r.b, r.n_designs, r.best, r.designable) for r in held.collect()} == {(1, 2, 0.7, True), (2, 1, 0.4, False), (3, 1, None, False)}
    known = spark.createDataFrame([(1, 0.3), (2, 0.9)], "b int, score double")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "b int, cluster int")
    r = stats.generation_metrics(held, known, groups, "b", 0.5).first()
    assert (r.n, r.n_clusters) == (3, 2) and np.allclose([r.designable, r.novel, r.both, r.diversity], [1 / 3, 2 / 3, 1 / 3, 2 / 3])


def test_command_line(spark, tmp_path):
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate("ababcab")], "chain string, at int, token string")
    rows.write.parquet(str(tmp_path / "in"))
    same = ["--input", str(tmp_path / "in"), "--chain", "chain", "--order", "at", "--token", "token"]
    command.main(["learn", *same, "--steps", "1", "--out", str(tmp_path / "vocabulary")])
    command.main(["encode", *same, "--vocabulary", str(tmp_path / "vocabulary"), "--out", str(tmp_path / "coded")])
    wanted = learn(chains.chains(rows, "chain", ["at"], "token"), 1)[1].select("pos", "token").orderBy("pos").collect()
    assert spark.read.parquet(str(tmp_path / "coded")).select("pos", "token").orderBy("pos").collect() == wanted
    with pytest.raises(SystemExit):
        command.main(["learn", *same, "--steps", "0", "--out", str(tmp_path / "x")])


def test_many_hierarchies_side_by_side(spark):
    sizes, most = np.array([9, 7, 7, 1, 2]), 3
    unary = RNG.normal(size=(5, 9, most))
    for c, n in enumerate(sizes):
        for i in range(9):
            unary[c, i, max(0, n - i) :] = -np.inf
    want = [numeric.best_hierarchy(unary[c, :n], np.full((n, n), -0.2)) for c, n in enumerate(sizes)]
    for got, (log_z, best, leaves) in zip(numeric.best_hierarchies(unary, sizes, -0.2), want, strict=True):
        assert got[2] == leaves and got[1] == best and math.isclose(got[0], log_z)
    rows = [(c, i, i + w + 1, float(unary[c, i, w])) for c, n in enumerate(sizes) for i in range(n) for w in range(min(most, n - i))]
    found = clusters.segment_tree(spark.createDataFrame(rows, "chain int, lo long, hi long, score double").repartition(3), most, -0.2).collect()
    assert sorted((r.chain, r.lo, r.hi) for r in found) == sorted((c, *s) for c, w in enumerate(want) for s in w[2])


@pytest.mark.parametrize("sizes", [[3, 1, 3, 2], [9, 1, 4, 3, 0, 6]])
def test_segmentations_from_a_row_for_each_place(spark, sizes):
    # 0: six values of no chain, whose spans have no neighbours
    rows = [(c if n else None, i, float(RNG.normal())) for c, n in enumerate(sizes) for i in range(n or 6)]
    rows = spark.createDataFrame(rows, "chain int, pos long, v double").repartition(3)
    own, pair = [([[3.0, -2.0, 1.0, 60.0]], [-0.3])], [([[1.0, -2.0, 0.5, 9.0, -1.0, 2.0, -0.5, 40.0], [0.3] * 8], [0.1, 0.2]), ([[1.0, -0.7]], [0.05])]
    table, lists = spans.spans(rows, "chain", "pos", "v", 4), spans.span_lists(rows, "chain", "pos", "v", 4, 0.7)
    pairs = spans.score_neighbours(table, 0.7, pair)
    assert sorted(spans.neighbour_rows(lists, pair).collect()) == sorted(pairs.collect())
    want = clusters.segment_pairs(spans.score_spans(table, 0.7, own, 0.1), pairs, 4).collect()
    found = clusters.segment_pair_lists(spans.score_lists(lists, own, 0.1, pair), 4)
    by = lambda r: (str(r.chain), r.lo)
    assert sorted(found.collect(), key=by) == sorted(want, key=by) and max(r.hi - r.lo for r in want) > 1
    assert clusters.segment_pair_lists(spans.score_lists(lists.limit(0), own, 0.1, pair), 4).count() == 0


@pytest.mark.parametrize("name", ["segmentation_pairs", "span_pair_scores"])
def test_neighbouring_spans_are_not_shuffled(spark, tmp_path, name):
    rows = [(i, i // 20 % 3, f"2024-01-01 00:00:{i:02}", "view", i * 0.7) for i in range(60)]
    rows = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    found = queries.QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "CoGroup" not in plan and found.count() >= 60 / 4
