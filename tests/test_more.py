import doctest
import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom import schema, storage
from chainloom.functions import features, numeric
from chainloom.operators import align, filters, motifs, sequences, stats, structures
from chainloom.plans import learn, runs
from chainloom.sources import cif, text


def chain_points(n=24, seed=3):
    rng = np.random.default_rng(seed)
    return numeric.rebuild_chain(np.full(n - 1, 1.5), np.full(n - 2, 1.95), rng.uniform(-3, 3, n - 3))


def atom_rows(spark, chains):
    rows = []
    for name, points in chains.items():
        for k, (x, y, z) in enumerate(points):
            rows.append((name, k + 1, ("N", "CA", "C")[k % 3], "GLY", "A", k // 3 + 1, "", float(x), float(y), float(z)))
    return spark.createDataFrame(rows, "chain_id string, atom_id int, atom string, res string, chain string, res_id int, ins_code string, x double, y double, z double")


@pytest.mark.parametrize("module", [cif, align])
def test_doctests(module):
    assert doctest.testmod(module).failed == 0


def test_structures_more(spark):
    atoms = atom_rows(spark, {"a": chain_points(), "b": chain_points(12, 5)})
    back = structures.backbone(atoms)
    counts = {r.chain_id: (r.n_residues, r.last) for r in filters.atom_count_check(atoms).collect()}
    assert counts == {"a": (8, 8), "b": (4, 4)}
    assert structures.c_betas(atoms).filter("x IS NULL").count() == 12
    frames = structures.residue_frames(back).collect()
    for r in frames:
        m = np.array([[r[f"{p}{i}"] for i in (1, 2, 3)] for p in "xyz"])
        assert np.allclose(m @ m.T, np.eye(3)) and math.isclose(np.linalg.det(m), 1)
    cb = spark.createDataFrame([("a", 99, "CB", "ALA", "A", 1, "", 1.0, 2.0, 3.0)], atoms.schema)
    local = structures.local_side_chains(atoms.union(cb), back).collect()
    first = next(r for r in frames if (r.chain_id, r.r) == ("a", 0))
    d = np.array([1.0, 2, 3]) - [first.ox, first.oy, first.oz]
    assert len(local) == 1 and math.isclose(np.linalg.norm([local[0].u, local[0].v, local[0].w]), np.linalg.norm(d))
    oxygens = structures.oxygens(back).collect()
    assert len(oxygens) == 7 + 3
    points = {(r.chain_id, r.atom, r.res_id): np.array([r.x, r.y, r.z]) for r in atoms.collect()}
    for o in oxygens:
        c = points[o.chain_id, "C", o.res_id]
        assert math.isclose(np.linalg.norm(np.array([o.x, o.y, o.z]) - c), 1.2359, abs_tol=1e-9)
    partners = structures.nearest_partners(back.select("chain_id", "k", "x", "y", "z"), "chain_id", "k").collect()
    for r in partners:
        own = chain_points() if r.chain_id == "a" else chain_points(12, 5)
        dist = np.linalg.norm(own - own[r.i], axis=1)
        dist[r.i] = np.inf
        assert math.isclose(dist[r.j], dist.min(), abs_tol=1e-9)
    assert structures.voxels(back, "chain_id").filter("vx < 0 OR vx > 63").count() == 0


def test_side_chains_go_back_where_they_were(spark):
    atoms = atom_rows(spark, {"a": chain_points(), "b": chain_points(12, 5)})
    add = [("a", 99, "CB", "GLY", "A", 1, "", 1.0, 2.0, 3.0), ("a", 98, "OG", "GLY", "A", 1, "", 0.5, -2.0, 1.0), ("b", 97, "CB", "GLY", "A", 1, "", 7.0, 7.0, 7.0)]
    full = atoms.union(spark.createDataFrame([*add, ("a", 100, "CB", "GLY", "A", 1, "", 9.0, 9.0, 9.0)], atoms.schema))
    back = structures.backbone(full)
    library = structures.side_chain_library(full, back)
    # The first residue of the letter counts, and of two atoms with one name the first.
    assert sorted(r.atom for r in library.collect()) == ["CB", "OG"]
    residues = structures.whole_residues(back)
    placed = {(r.chain_id, r.r, r.atom): (r.x, r.y, r.z) for r in structures.side_chains(residues, library).collect()}
    assert len(placed) == 2 * (8 + 4)
    assert np.allclose(placed["a", 0, "CB"], (1, 2, 3)) and np.allclose(placed["a", 0, "OG"], (0.5, -2, 1))
    # Every other residue keeps the distances to CA and C, which bonds of one length allow.
    points = {(r.chain_id, r.res_id - 1, r.atom): np.array([r.x, r.y, r.z]) for r in atoms.collect()}
    for (chain, r, atom), p in placed.items():
        for bone in ("C", "CA"):
            far = np.linalg.norm(np.array(placed["a", 0, atom]) - points["a", 0, bone])
            assert math.isclose(np.linalg.norm(np.array(p) - points[chain, r, bone]), far, abs_tol=1e-9)
    other = residues.withColumn("aa", F.lit("W"))
    assert structures.side_chains(other, library).count() == 0  # a letter that the library lacks
    empty = structures.side_chain_library(full.filter("false"), back.filter("false"))
    assert structures.side_chains(residues, empty).count() == 0


def test_broken_chains_are_invalid(spark):
    good = atom_rows(spark, {"a": chain_points(9)})
    shifted = good.withColumn("res_id", F.when(F.col("atom_id") == 2, 9).otherwise(F.col("res_id"))).withColumn("chain_id", F.lit("b"))
    short = good.filter("atom_id < 9").withColumn("chain_id", F.lit("c"))
    valid = {r.chain_id: r.valid for r in structures.valid_chains(structures.backbone(good.union(shifted).union(short))).collect()}
    assert valid == {"a": True, "b": False, "c": False}


def test_clashes_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 6, (60, 3))
    rows = spark.createDataFrame([("x", i, *map(float, q), 1.7) for i, q in enumerate(p)], "chain_id string, k int, x double, y double, z double, radius double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    far = np.abs(np.arange(60)[:, None] - np.arange(60)[None]) > 1
    assert structures.clashes(rows).collect()[0].n == ((d <= 0.63 * 3.4) & far).any(axis=1).sum()


def test_residue_tokens(spark):
    bonds = structures.bonds(structures.backbone(atom_rows(spark, {"a": chain_points(30), "b": chain_points(30), "c": chain_points(15, 9)})))
    for strategy in ("width", "quantile"):
        edges = motifs.feature_edges(bonds, 6, strategy)
        first = motifs.residue_tokens(bonds, edges)
        rows = {}
        for r in first.orderBy("chain", "pos").collect():
            rows.setdefault(r.chain, []).append(r)
        assert [len(rows[c]) for c in "abc"] == [10, 10, 5] and [r.width for r in rows["c"]] == [3, 3, 3, 3, 2]
        assert rows["c"][-1].g1 is None and [r.token for r in rows["a"]] == [r.token for r in rows["b"]]
        vocabulary, found = motifs.learn_motifs(first, 4)
        assert vocabulary.count() > 0 and found.agg(F.sum("width")).first()[0] == 29 + 29 + 14
        ids = motifs.motif_ids(found)
        back = motifs.from_sequence(motifs.id_sequence(found, ids, (6, 6, 6)), ids, (6, 6, 6))
        key = lambda df: sorted(map(tuple, df.select("chain", "pos", "token", *motifs.GLUE).collect()), key=str)
        assert key(back) == key(found) and key(motifs.unfold(back, vocabulary)) == key(first)
        assert key(motifs.encode_motifs(first, vocabulary)) == key(found)
        assert motifs.glue_values(found, edges).filter("omega IS NULL").count() == 0


def test_slices(spark):
    bonds = structures.bonds(structures.backbone(atom_rows(spark, {"a": chain_points()})))
    r = motifs.slice_geometry(bonds, "chain_id", 3, 5).collect()[0]
    assert (len(r.lens), len(r.angs), len(r.dihs)) == (5, 4, 3)
    new = spark.createDataFrame([("a", 4, None, 1.0, None)], "chain_id string, k int, len double, ang double, dih double")
    changed = motifs.set_geometry(bonds, "chain_id", new)
    assert changed.filter("ang = 1.0").count() == 1 and changed.count() == bonds.count()


def test_bins_by_size():
    rows = motifs.edges_by_size({"psi": [0.0, 1.0]}, {2: 2, 4: 4}, 5)
    assert [sum(r[0] == s for r in rows) for s in range(1, 6)] == [0, 2, 2, 4, 4]


def test_cif(spark, tmp_path):
    head = "loop_\n" + "\n".join(f"_atom_site.{n}" for n in "group_PDB label_atom_id label_comp_id label_asym_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z B_iso_or_equiv pdbx_PDB_model_num".split())
    body = ["ATOM CA MSE A X 5 ? 1.0 2.0 3.0 10.0 1", "ATOM SE MSE A X 5 ? 1.5 2.0 3.0 10.0 1", "ATOM CA GLY B Y 1 A 4.0 5.0 6.0 . 1"]
    path = tmp_path / "x.cif"
    path.write_text("\n".join(["data_x", "#", head, *body, "#"]))
    sites = cif.atom_sites(spark, str(path))
    got = [(r.res, r.atom, r.label_chain, r.auth_chain, r.ins_code, r.b_factor) for r in sites.orderBy("x").collect()]
    assert got == [("MET", "CA", "A", "X", "", 10.0), ("MET", "SD", "A", "X", "", 10.0), ("GLY", "CA", "B", "Y", "A", None)]
    assert {(r.auth_chain, r.label_chain, r.changed) for r in cif.chain_names(sites).collect()} == {("X", "A", True), ("Y", "B", True)}
    p = sites.first().path
    wanted = spark.createDataFrame([(p, "X"), (p, "B"), (p, "Q")], "path string, chain string")
    assert sorted((r.chain, r.atom or "-") for r in cif.chains_of(sites, wanted).collect()) == [("B", "CA"), ("Q", "-"), ("X", "CA"), ("X", "SD")]


def test_cif_texts_without_atoms(spark):
    files = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "loop_\n_atom_site.x\n#", 3)], "path string, value string, model int")
    assert cif.file_atoms(files).count() == 0
    assert cif.file_atoms(files.filter("false")).count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "set_fold_test.jsonl"
    path.write_text(json.dumps({"prot1_pdb_id": "1abc", "tm_score": 0.5}) + "\n")
    r = text.json_lines(spark, str(path), schema.PAIRS).collect()[0]
    assert r.prot1_pdb_id == "1abc" and r.tm_score == 0.5 and r.prot2_pdb_id is None and r.split == "fold"


def test_jobs_side_by_side_sweep_their_own(spark):
    before, other = storage.settled(), {}
    worker = threading.Thread(target=lambda: other.update(df=storage.settle(spark.range(3)), n=storage.settled()))
    worker.start()
    mine = [storage.settle(spark.range(5)) for _ in range(2)]
    worker.join()
    assert other["n"] == 1 and storage.settled() == before + 2
    assert storage.sweep(spark, before, keep=1) == 1
    assert other["df"].count() == 3 and mine[1].count() == 5
    with pytest.raises(Exception, match="(?i)does not exist|not_exist|file"):
        mine[0].count()
    assert storage.sweep(spark, before, keep=5) == 0
    assert storage.sweep(spark, before, everyone=True) >= 1 and storage.settled() == before


def test_training_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("epoch,train_loss,val_loss,lr\n0,2.0,,0.1\n1,1.0,1.5,0.1\n")
    assert sorted(map(tuple, text.training_log(spark, str(path)).collect())) == [(0, "train_loss", 2.0), (1, "train_loss", 1.0), (1, "val_loss", 1.5)]


def test_resume(spark, tmp_path):
    rows = [(c, p, t) for c, ts in {"x": "abababcab", "y": "babab"}.items() for p, t in enumerate(ts)]
    tokens = spark.createDataFrame(rows, "chain string, pos bigint, token string")
    folder = str(tmp_path / "run")
    assert runs.latest_snapshot(spark, folder, "chains") is None
    runs.learn_resumably(tokens, folder, 1, every=1)
    assert runs.latest_snapshot(spark, folder, "chains") == 1
    whole = runs.learn_resumably(tokens, folder, 3, every=1).orderBy("step").collect()
    assert whole == learn.learn(tokens, 3)[0].orderBy("step").collect()
    out = str(tmp_path / "out")
    assert runs.still_to_do(tokens, "chain", out).count() == tokens.count()
    runs.append_split(tokens.filter("chain = 'x'"), out, "one")
    assert {r.chain for r in runs.still_to_do(tokens, "chain", out).collect()} == {"y"}
    assert runs.version_key(tokens, ["chain", "token"], "1") == runs.version_key(tokens.orderBy("token"), ["chain", "token"], "1")
    runs.check_options({"a": 1, "b": 2}, {"a": 1, "b": 3}, frozenset({"b"}))
    with pytest.raises(ValueError):
        runs.check_options({"a": 1}, {"a": 2})


def test_features(spark):
    row = spark.createDataFrame([("1-100:2-20", "ACDE", "ACXE", "W")], "m string, a string, b string, aa string")
    r = row.select(features.parse_map(F.col("m")).alias("m"), features.identity_percent(F.col("a"), F.col("b")).alias("i"), features.residue_features(F.col("aa")).alias("f"), features.geometry_key([F.lit(3), F.lit(12)]).alias("k")).collect()[0]
    assert r.m == {1: 100, 2: 20} and r.i == 75.0 and sum(r.f[:20]) == 1 and r.f[20] == -0.9 and r.k == "0003-0012"


def test_pair_descriptors(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(8, 3)) * 5
    rows = spark.createDataFrame([("a", i, (i + 3) % 8, *map(float, q)) for i, q in enumerate(p)], "chain_id string, r int, j int, x double, y double, z double")
    got = {(r.i, r.j): r for r in features.partner_descriptors(rows).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    r = got[1, 4]
    assert math.isclose(r.d1, unit(p[1] - p[0]) @ unit(p[2] - p[1])) and math.isclose(r.d8, np.linalg.norm(p[4] - p[1]))
    assert math.isclose(r.d7, unit(p[1] - p[0]) @ unit(p[4] - p[3])) and r.d9 == -3 and math.isclose(r.d10, -math.log(4))


def test_glue_is_found_again():
    rng = np.random.default_rng(0)
    for size in (4, 9):
        centres = np.linspace(-math.pi, math.pi, size, endpoint=False)
        lengths, bend, turn = np.full(9, 1.5), np.full(8, 1.9), rng.choice(centres, 7)
        target = numeric.end_frame(numeric.rebuild_chain(lengths, bend, turn))
        start = turn.copy()
        if size == 4:  # few bins are tried in all combinations, so any start will do
            start[2:5] = centres[0]
        pick = numeric.fit_glue(lengths, bend, start, [("dih", 2), ("dih", 3), ("dih", 4)], [centres] * 3, target)
        turn2 = turn.copy()
        turn2[2:5] = centres[pick]
        r, t = numeric.end_frame(numeric.rebuild_chain(lengths, bend, turn2))
        assert np.allclose(r, target[0], atol=1e-6) and np.allclose(t, target[1], atol=1e-6)


def test_divergences(spark):
    counts = lambda rows: spark.createDataFrame(rows, "k int, n bigint")
    assert stats.kl(counts([(1, 1), (2, 1)]), counts([(1, 1)]), ["k"]).first()[0] == math.inf
    assert math.isclose(stats.kl(counts([(1, 1), (2, 1)]), counts([(1, 1), (2, 3)]), ["k"]).first()[0], 0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    grid = stats.floored_density(spark.createDataFrame([(0, 0, 5)], "bx bigint, by bigint, n bigint"), 3, 2)
    assert math.isclose(grid.agg(F.sum("p")).first()[0], 1) and grid.count() == 6


def test_patience(spark):
    rows = [("a", e, v) for e, v in enumerate([5, 4, 4.5, 4.2, 4.1, 3, 1])] + [("b", 0, 1.0)]
    df = spark.createDataFrame([(r, e, float(v)) for r, e, v in rows], "run string, epoch int, loss double")
    assert {tuple(r) for r in sequences.patience_stop(df, "run", "epoch", "loss", 3).collect()} == {("a", 4, 4.0), ("b", None, 1.0)}


def test_sweep_deletes_what_was_settled(spark):
    from chainloom import storage

    storage.sweep(spark)
    kept = storage.settle(spark.range(3))
    assert kept.count() == 3 and storage.sweep(spark) == 1 and storage.sweep(spark) == 0


def test_quantiles_and_running_sums_over_ranges(spark):
    import numpy as np
    from chainloom.operators import splits

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=501).round(1), "b": np.full(300, 2.0), None: rng.normal(size=7)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(wanted))] for r in splits.quantiles(df, "v", wanted, ["g"]).collect()}
    assert set(got) == set(groups)
    assert all(np.allclose(got[g], np.quantile(values, wanted)) for g, values in groups.items())
    whole = splits.quantiles(df, "v", wanted).first()
    assert np.allclose(list(whole), np.quantile(np.concatenate(list(groups.values())), wanted))
    sums = splits.running_sum(spark.createDataFrame([(f"k{i:03}", i) for i in range(200)], "k string, w bigint").repartition(7), "k", "w", "s")
    assert {r.k: r.s for r in sums.collect()} == {f"k{i:03}": i * (i - 1) // 2 for i in range(200)}


def test_unknown_tokens_raise_or_become_an_id(spark):
    import pytest
    from chainloom.operators import chains

    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "chain bigint, pos bigint, token string")
    vocabulary = chains.token_ids(tokens.filter("token = 'a'"))
    assert [r.id for r in chains.encode_ids(tokens, vocabulary, unknown=-1).orderBy("pos").collect()] == [0, -1]
    with pytest.raises(Exception, match="unknown token"):
        chains.encode_ids(tokens, vocabulary).collect()


def test_longest_pieces_are_those_of_the_random_cuts(spark):
    from pyspark.sql import functions as F

    from chainloom.operators import splits

    chains = spark.createDataFrame([("a", 12, 4), ("b", 1, 1), ("c", 5, 9), ("d", 0, 1)], "chain string, n long, k long")
    want = {(r.chain, r.round): r.m for r in splits.random_cuts(chains, "chain", "n", "k", 6, 5).groupBy("chain", "round").agg(F.max(F.col("hi") - F.col("lo")).alias("m")).collect()}
    rows = splits.random_places(chains, "n", "k", 6, 5).select("chain", "round", splits.longest_piece(F.col("cuts")).alias("m"))
    assert {(r.chain, r.round): r.m for r in rows.collect()} == want and len(want) == 18
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_wanted_chains_read_their_files_once(spark):
    text = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in ("label_atom_id", "label_asym_id", "auth_asym_id", "auth_seq_id")) + "CA A B 1\nCA B C 2\n'C A' B C 3\n#"
    files = spark.createDataFrame([("f", text), ("g", None)], "path string, value string")
    wanted = spark.createDataFrame([("f", "B"), ("f", "A"), ("f", "C"), ("f", "C"), ("f", "Z"), ("g", "A"), ("f", None)], "path string, chain string")
    found = cif.chains_of(cif.file_atoms(files), wanted)
    got = sorted((r.path, r.chain or "", r.res_id or 0, r.atom or "-") for r in found.collect())
    c = [("f", "C", 2, "CA"), ("f", "C", 3, "C A")]
    assert got == sorted([("f", "B", 1, "CA"), ("f", "A", 1, "CA"), *c, *c, ("f", "Z", 0, "-"), ("g", "A", 0, "-"), ("f", "", 0, "-")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1
