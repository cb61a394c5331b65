import doctest
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.functions import angles, numeric
from chainloom.operators import bins, chains, clusters, intervals, lookups, sequences, splits, stats, structures
from chainloom.plans import learn as learning
from chainloom.sources import sinks, text


def chain_table(spark, rows):
    return spark.createDataFrame([(c, p, t) for c, ts in rows.items() for p, t in enumerate(ts)], "chain string, pos bigint, token string")


def greedy(tokens, left, right):
    return learning.encode_chain(tokens, [(left, right, f"{left}+{right}")])


@pytest.mark.parametrize("module", [numeric, learning])
def test_doctests(module):
    assert doctest.testmod(module).failed == 0


def test_incremental_learning_equals_naive(spark):
    rng = random.Random(3)
    rows = {f"c{i}": [rng.choice("aab" if i % 2 else "abc") for _ in range(rng.randrange(1, 30))] for i in range(12)}
    table = chain_table(spark, rows)
    fast, slow = learning.learn(table, 6), learning.learn(table, 6, incremental=False)
    assert fast[0].orderBy("step").collect() == slow[0].orderBy("step").collect()
    got = {(r.chain, r.pos): r.token for r in fast[1].collect()}
    assert got == {(r.chain, r.pos): r.token for r in slow[1].collect()}
    for c, tokens in rows.items():
        for r in fast[0].orderBy("step").collect():
            tokens = greedy(tokens, r.left, r.right)
        assert tokens == [t for (chain, _), t in sorted(got.items()) if chain == c]


def test_merge_takes_every_second_of_a_run(spark):
    table = chain_table(spark, {"x": list("aaaaab"), "y": ["b"]})
    pair = spark.createDataFrame([("a", "a")], "left string, right string")
    assert [r.token for r in chains.merge_pair(table, pair).orderBy("chain", "pos").collect()] == ["a+a", "a+a", "a", "b", "b"]


def test_learning_empty_and_single(spark):
    assert learning.learn(chain_table(spark, {"x": ["a"]}), 3)[0].count() == 0


def test_encode_with_nothing_learned(spark):
    table = chain_table(spark, {"x": list("ab")})
    assert learning.encode(table, learning.empty_vocabulary(spark)).count() == 2


@given(st.floats(-50, 50))
@settings(max_examples=30, deadline=None)
def test_place_and_wrap_by_hand(x):
    y = (x + math.pi) % (2 * math.pi) - math.pi
    assert -math.pi <= y <= math.pi


def test_wrap_columns(spark):
    rows = spark.createDataFrame([(x / 3,) for x in range(-40, 40)], "v double")
    for v, w in rows.select("v", angles.wrap(F.col("v")).alias("w")).collect():
        assert -math.pi <= w < math.pi and math.isclose(math.cos(v), math.cos(w), abs_tol=1e-9)
    with pytest.raises(ValueError):
        angles.wrap(F.col("v"), 1, 2)


def test_rebuild_gives_the_internal_coordinates_back():
    rng = np.random.default_rng(0)
    n = 40
    lengths, bend, turn = rng.uniform(1.3, 1.6, n), rng.uniform(1.6, 2.2, n - 1), rng.uniform(-3, 3, n - 2)
    p = numeric.rebuild_chain(lengths, bend, turn)
    assert np.allclose(np.linalg.norm(np.diff(p, axis=0), axis=1), lengths)
    for k in range(1, n):
        u, v = p[k - 1] - p[k], p[k + 1] - p[k]
        assert math.isclose(math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), bend[k - 1], abs_tol=1e-9)
    for k in range(n - 2):
        b0, b1, b2 = p[k + 1] - p[k], p[k + 2] - p[k + 1], p[k + 3] - p[k + 2]
        n1, n2 = np.cross(b0, b1), np.cross(b1, b2)
        assert math.isclose(math.atan2(np.cross(n1, n2) @ b1 / np.linalg.norm(b1), n1 @ n2), turn[k], abs_tol=1e-9)


def test_superposition_scores():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(30, 3)) * 10
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = p @ q.T + [1, 2, 3]
    assert numeric.rmsd(p, moved) < 1e-9 and numeric.lddt(p, moved) == 1 and numeric.aligned_tm_score(p, moved) > 0.999
    mirrored = p * [1, 1, -1]
    assert numeric.rmsd(p, mirrored) > 0.5
    with pytest.raises(ValueError):
        numeric.rmsd(p, p[:5])


def segmentations(n, most):
    if n == 0:
        yield []
    for w in range(1, min(n, most) + 1):
        for rest in segmentations(n - w, most):
            yield rest + [(n - w, n)]


def test_segmentation_against_all_of_them():
    rng = np.random.default_rng(2)
    score = rng.normal(size=(7, 3))
    all_ = [(sum(score[a, b - a - 1] for a, b in s), s) for s in segmentations(7, 3)]
    z, best, spans = numeric.best_segmentation(score)
    assert math.isclose(z, math.log(sum(math.exp(x) for x, _ in all_))) and math.isclose(best, max(all_)[0]) and spans == max(all_)[1]
    edge = rng.normal(size=(7, 3, 3))
    total = lambda s: sum(score[a, b - a - 1] for a, b in s) + sum(edge[a, q - p - 1, b - a - 1] for (p, q), (a, b) in itertools.pairwise(s))
    want = max((total(s), s) for s in segmentations(7, 3))
    got = numeric.best_segmentation_2d(score, edge)
    assert math.isclose(got[0], want[0]) and got[1] == want[1]


def test_hierarchy_of_two():
    unary, split = np.array([[1.0, 0.5], [2.0, -9.0]]), np.zeros((2, 2))
    inside, best, leaves = numeric.best_hierarchy(unary, split)
    assert math.isclose(best, 3) and leaves == [(0, 1), (1, 2)] and math.isclose(inside, math.log(math.exp(3) + math.exp(0.5)))


def test_medoids():
    x = np.array([0, 0.1, 0.2, 9, 9.1, 9.2])
    medoids, own = numeric.k_medoids(np.abs(x[:, None] - x[None]), 2, seed=1)
    assert sorted(medoids) == [1, 4] and len(set(own[:3])) == 1 and len(set(own[3:])) == 1


def test_bins(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 1, 1.5, 2, 4)] + [(None,)], "v double")
    edges = [0.0, 1.0, 2.0, 4.0]
    assert [r[0] for r in rows.select(bins.bin_of(F.col("v"), edges)).collect()] == [0, 1, 1, 2, 2, None]
    with pytest.raises(Exception, match="out of range"):
        rows.select(bins.bin_of(F.col("v") + 1, edges)).collect()
    assert [r[0] for r in rows.select(bins.bin_of(F.col("v") + 1, edges, "clamp")).collect()][:5] == [1, 2, 2, 2, 2]
    assert rows.select(bins.snap(F.col("v") + 3, edges)).collect()[4][0] == 4.0
    assert bins.clean(rows, "v").count() == 4


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    make = lambda: [("c", a, a + rng.randrange(1, 30)) for a in rng.sample(range(300), 25)]
    a, b = make(), make()
    df = lambda x: spark.createDataFrame(x, "chain string, lo bigint, hi bigint")
    got = sorted((r.a_lo, r.a_hi, r.b_lo, r.b_hi, r.common) for r in intervals.overlap_join(df(a), df(b), 16).collect())
    want = sorted((p, q, s, t, min(q, t) - max(p, s)) for _, p, q in a for _, s, t in b if t > p and s < q)
    assert got == want


def test_ranks_run_over_cells(spark):
    keys = random.Random(1).sample(range(100_000), 500)
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert {r.k: r.rank for r in splits.with_rank(rows, "k", 64).collect()} == {k: i for i, k in enumerate(sorted(keys))}


def test_random_cuts_are_partitions(spark):
    rows = spark.createDataFrame([("a", 10, 3), ("b", 1, 5), ("c", 4, 1)], "c string, n bigint, k bigint")
    out = {}
    for r in splits.random_cuts(rows, "c", "n", "k", 20, 1).collect():
        out.setdefault((r.chain, r.round), []).append((r.lo, r.hi))
    for (c, _), spans in out.items():
        n, k = {"a": (10, 3), "b": (1, 1), "c": (4, 1)}[c]
        spans.sort()
        assert len(spans) == k and spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in itertools.pairwise(spans))


def test_schedules(spark):
    for kind in ("linear", "cosine", "sigmoid"):
        rows = sequences.alpha_terms(sequences.beta_schedule(spark, kind, 20)).orderBy("t").collect()
        assert all(0 < r.beta < 1 for r in rows) and math.isclose(rows[-1].alpha_bar, math.prod(1 - r.beta for r in rows))


def test_prefix_join_cuts_at_separators(spark):
    keys = spark.createDataFrame([("a",), ("a-b",)], "k string")
    names = spark.createDataFrame([("a",), ("a-b_1",), ("ab",), ("a_2",)], "n string")
    assert sorted(map(tuple, lookups.prefix_join(keys, "k", names, "n").collect())) == [("a", "a"), ("a", "a-b_1"), ("a", "a_2"), ("a-b", "a-b_1")]


def test_pareto_three_axes(spark):
    rng = random.Random(0)
    points = [(i, rng.randrange(6), rng.randrange(6), rng.randrange(6)) for i in range(60)]
    df = spark.createDataFrame(points, "k bigint, a bigint, b bigint, c bigint")
    want = {p[0] for p in points if not any(q[1] <= p[1] and q[2] <= p[2] and q[3] >= p[3] and (q[1:3] != p[1:3] or q[3] > p[3]) for q in points)}
    assert {r.k for r in stats.pareto_front(df, "k", {"a": "min", "b": "min", "c": "max"}).collect()} == want


LINE = "ATOM  {:5d}  {:<3s} {:3s} A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  5.00           {:1s}"


def structure_lines(points):
    names = ("N", "CA", "C")
    return [LINE.format(k + 1, names[k % 3], "GLY", k // 3 + 1, *p, names[k % 3][0]) for k, p in enumerate(points)]


def test_structures_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 30
    points = numeric.rebuild_chain(np.full(n - 1, 1.5), np.full(n - 2, 1.95), rng.uniform(-3, 3, n - 3))
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "x_A.pdb").write_text("\n".join(["HEADER", *structure_lines(points), "TER"]))
    atoms = text.atoms(text.lines(spark, str(tmp_path), "*.pdb"))
    assert {(r.chain_id, r.split) for r in atoms.select("chain_id", "split").distinct().collect()} == {("x_A", "train")}
    back = structures.backbone(atoms)
    assert [tuple(r) for r in structures.valid_chains(back).collect()] == [("x_A", n // 3, True)]
    bonds = structures.bonds(back).orderBy("k").collect()
    assert len(bonds) == n - 1 and all(abs(b.len - 1.5) < 2e-3 for b in bonds)
    rows = structures.bonds(back).select("chain_id", "k", "len", F.coalesce("ang", F.lit(0.0)).alias("ang"), F.coalesce("dih", F.lit(0.0)).alias("dih"))
    rebuilt = clusters.rebuild(rows, "chain_id", "k", "len", "ang", "dih").orderBy("pos").collect()
    assert numeric.rmsd(np.array([(r.x, r.y, r.z) for r in rebuilt]), points) < 0.02
    assert structures.sequences(atoms).collect()[0].seq == "G" * (n // 3)
    lines = sinks.backbone_lines(spark.createDataFrame([("x", k, *map(float, p)) for k, p in enumerate(points)], "chain string, pos bigint, x double, y double, z double"))
    again = [r.value.rstrip() for r in lines.orderBy("pos").collect()]
    assert [x[:54] for x in again] == [x[:54] for x in structure_lines(points)]


def test_fasta_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("a", "ACDE" * 30), ("b", "GG")], "name string, seq string")
    path = tmp_path / "x.fasta"
    path.write_text("\n".join(r.value for r in sinks.fasta_lines(records).collect()))
    assert sorted(map(tuple, text.fasta(spark, str(path)).collect())) == sorted(map(tuple, records.collect()))
    assert text.duplicate_names(records.union(records)).count() == 2


def test_resolved_hits_need_all_columns(spark):
    bad = spark.createDataFrame([("#FIELDS query-id score",), ("q1",)], "value string")
    with pytest.raises(Exception, match="wrong number"):
        text.resolved_hits(bad).collect()


def test_catalog():
    c = text.Catalog({"toy": "/x/toy"})
    assert c.resolve("toy") == ["/x/toy"] and c.resolve("/a/b") == ["/a/b"]
    with pytest.raises(KeyError):
        c.resolve("nothing")


def test_chains_stay_whole_in_batches(spark):
    import pyarrow as pa

    from chainloom.operators.chains import whole_chains

    nth = np.concatenate([np.arange(1, n + 1) for n in (5, 1, 12, 3)])
    batches = [pa.RecordBatch.from_arrays([pa.array(nth[lo : lo + 4])], names=["nth"]) for lo in range(0, len(nth), 4)]
    found = [np.split(t["nth"].to_numpy(), s[1:]) for t, s in whole_chains(batches, 6)]
    assert len(found) > 1 and [len(x) for part in found for x in part] == [5, 1, 12, 3]
    rng = np.random.default_rng(3)
    bonds = [(c, k, 1.5, 1.9 + 0.1 * rng.random(), rng.uniform(-3, 3)) for c, n in ((None, 4), ("b", 1), ("c", 9), ("d", 2)) for k in range(n)]
    out = clusters.rebuild(spark.createDataFrame(bonds, "chain string, k int, len double, ang double, dih double").repartition(3), "chain", "k", "len", "ang", "dih").collect()
    for c in (None, "b", "c", "d"):
        own = np.array([b[2:] for b in bonds if b[0] == c])
        got = np.array([(r.x, r.y, r.z) for r in sorted((r for r in out if r.chain == c), key=lambda r: r.pos)])
        assert np.allclose(got, numeric.rebuild_chain(own[:, 0], own[1:, 1], own[2:, 2]), atol=1e-9)


def test_word_pairs_are_counted_in_their_texts(spark):
    rows = [(1, "a b a b  c"), (2, "a b"), (None, "a b"), (4, None), (5, ""), (6, "x"), (7, " a b ")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    found = chains.word_pair_counts(docs, "id", "text")
    want = chains.pair_counts(chains.word_chains(docs, "id", "text"))
    assert found.dtypes == want.dtypes and sorted(found.collect()) == sorted(want.collect())
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    again = docs.union(spark.createDataFrame([(6, "a b")], "id int, text string"))
    assert chains.word_pair_counts(again, "id", "text").filter("left = 'a' AND right = 'b'").first()["n_chains"] == 4
