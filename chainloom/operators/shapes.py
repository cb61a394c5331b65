"""Motifs with shapes: a merge of one key makes a token for each class of shapes among its occurrences.

A shape table has the columns chain, pos, token, start, width, the bins of the junction to the token before (g1, g2, g3:
omega, C-N-CA, phi; null at a chain's start), the token's own geometry (lens, angs, dihs of its bonds; the first angle and the
first two dihedrals are those of the junction), its original atoms (xyz, from its first atom to that behind its last bond)
and sums: what it adds to the superposition of its chain on the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.functions.rigid import MICRO, Summary, bond_motions, rmsd_table, start_summary, summary, walk
from chainloom.operators.bins import bin_of
from chainloom.operators.medoids import LOCAL, find_medoids
from chainloom.operators.motifs import GLUE, JUNCTION, by_chain, turned
from chainloom.operators.scans import products
from chainloom.storage import settle

COLUMNS = ("chain", "pos", "token", "start", "width", *GLUE, "lens", "angs", "dihs", "xyz", "sums")
#: How much a difference in direction and in place counts when a junction is fitted.
TURN_WEIGHT, MOVE_WEIGHT = 0.5, 0.1


@dataclass
class Shape:
    """A class's medoid: where it stands, its atoms, and its geometry."""

    chain: object
    start: int
    points: list[float]
    lens: list[float]
    angs: list[float]
    dihs: list[float]


def centres(edges: list[float]) -> np.ndarray:
    return (np.array(edges[:-1]) + np.array(edges[1:])) / 2


def residue_shapes(bonds: DataFrame, atoms: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """The table of residues before any class: token is "r" and the width; junctions stand at the centres of their bins.

    ``bonds`` has chain_id, k, len, ang, dih, and ``atoms`` chain_id, k, x, y, z."""
    ordered = lambda k, *c: F.sort_array(F.collect_list(F.struct(k, *c)))
    own = bonds.groupBy(F.col("chain_id").alias("chain"), F.floor(F.col("k") / 3).cast("long").alias("pos")).agg(ordered("k", "len", "ang", "dih").alias("b"))
    # An atom that ends a residue begins the next one.
    residue = F.floor(F.col("k") / 3).cast("long")
    places = F.when((F.col("k") % 3 == 0) & (F.col("k") > 0), F.array(residue, residue - 1)).otherwise(F.array(residue))
    points = atoms.select(F.col("chain_id").alias("chain"), F.explode(places).alias("pos"), "k", "x", "y", "z")
    points = points.groupBy("chain", "pos").agg(F.flatten(F.transform(ordered("k", "x", "y", "z"), lambda a: F.array(a["x"], a["y"], a["z"]))).alias("xyz"))
    of = lambda c: F.transform("b", lambda x: x[c])
    rows = own.join(points, ["chain", "pos"]).select("chain", "pos", F.size("b").cast("long").alias("width"), of("len").alias("lens"), of("ang").alias("angs"), of("dih").alias("dihs"), "xyz")
    first = F.col("pos") == 0
    value = {"omega": F.get("dihs", F.lit(0)), "c_n_ca": F.get("angs", F.lit(0)), "phi": F.get("dihs", F.lit(1))}
    glue = [F.when(~first, bin_of(turned(value[n]), edges[n], "clamp")).cast("int").alias(g) for g, (n, _, _) in zip(GLUE, JUNCTION, strict=True)]
    rows = rows.select("*", *glue)
    middle = [F.get(F.array(*[F.lit(float(v)) for v in centres(edges[n])]), F.col(g)) for g, (n, _, _) in zip(GLUE, JUNCTION, strict=True)]
    angs = F.when(first, F.col("angs")).otherwise(F.concat(F.array(middle[1]), F.slice("angs", 2, F.greatest(F.size("angs") - 1, F.lit(0)))))
    dihs = F.when(first, F.col("dihs")).otherwise(F.slice(F.concat(F.array(middle[0], middle[2]), F.slice("dihs", 3, F.greatest(F.size("dihs") - 2, F.lit(0)))), 1, F.size("dihs")))
    token = F.concat(F.lit("r"), F.col("width").cast("string")).alias("token")
    return rows.select("chain", "pos", token, (F.col("pos") * 3).alias("start"), "width", *GLUE, "lens", angs.alias("angs"), dihs.alias("dihs"), "xyz", F.lit(None).cast("array<double>").alias("sums"))


def shape_of(rows: DataFrame, original: bool = True) -> DataFrame:
    """(chain, start, shape): the original atoms of each row, or those of its current geometry."""
    if original:
        return rows.select("chain", "start", F.col("xyz").alias("shape"))
    kind = rows.schema["chain"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            flat = [_atoms(*(np.array([x], float) for x in g))[0].reshape(-1) for g in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.float64()))], names=["chain", "start", "shape"])

    return rows.select("chain", "start", "lens", "angs", "dihs").mapInArrow(run, f"chain {kind}, start bigint, shape array<double>")


def _atoms(lens: np.ndarray, angs: np.ndarray, dihs: np.ndarray) -> np.ndarray:
    """Atoms of rows of equal width, from the first, whatever their junctions."""
    angs, dihs = angs.copy(), dihs.copy()
    angs[:, 0], dihs[:, :2] = np.nan, np.nan
    return np.concatenate([np.zeros((len(lens), 1, 3)), walk(lens, angs, dihs)[0]], 1)


def shape_classes(rows: DataFrame, k: int, original: bool = True, local: int = LOCAL, budget: int | None = None) -> list[Shape]:
    """At most ``k`` classes of rows of one width, as their medoids."""
    found = find_medoids(shape_of(rows, original), k, local, budget=budget)
    if not found:
        return []
    spark = rows.sparkSession
    keys = spark.createDataFrame([(m[0][0], int(m[0][1])) for m in found], f"chain {rows.schema['chain'].dataType.simpleString()}, start bigint")
    held = {(r["chain"], r["start"]): r for r in rows.join(F.broadcast(keys), ["chain", "start"], "left_semi").select("chain", "start", "lens", "angs", "dihs").collect()}  # k rows
    out = []
    for key, points in found:
        r = held[key]
        out.append(Shape(r["chain"], r["start"], points, *([float("nan") if v is None else v for v in r[c]] for c in ("lens", "angs", "dihs"))))
    return out


def take_shapes(rows: DataFrame, classes: dict[str, list[Shape]], edges: dict[str, list[float]], original: bool = True, refit: bool = False) -> DataFrame:
    """Rows whose token names a set of classes, as the nearest of them (ties to the first): token is "name.p", the inner
    geometry is the class's, ``dev`` the distance to it. With ``refit``, the junction before a row moves to those bins
    that bring the row's end closest to where it was."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    sets = {n: (np.array([s.points for s in c]).reshape(len(c), -1, 3), *(np.array([getattr(s, f) for s in c], float) for f in ("lens", "angs", "dihs"))) for n, c in classes.items() if c}
    grid = [centres(edges[n]) for n, _, _ in JUNCTION]
    schema = ", ".join(f"{c} {kinds[c]}" for c in COLUMNS) + ", dev double"

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, width = np.array(batch.column(2).to_pylist(), object), batch.column(4).to_numpy()
            for name in sorted(set(tokens.tolist())):
                for size in sorted(set(width[tokens == name].tolist())):
                    part = batch.take(pa.array(np.flatnonzero((tokens == name) & (width == size))))
                    lens, angs, dihs, xyz = (np.array(part.column(c).to_pylist(), float) for c in (8, 9, 10, 11))
                    xyz = xyz.reshape(len(lens), -1, 3)
                    points, *own = sets[name]
                    d = rmsd_table(xyz if original else _atoms(lens, angs, dihs), points)
                    p = d.argmin(1)
                    old = lens, angs, dihs
                    lens, angs, dihs = own[0][p], np.concatenate([angs[:, :1], own[1][p][:, 1:]], 1), np.concatenate([dihs[:, :2], own[2][p][:, 2:]], 1)
                    glue = [part.column(5 + g) for g in range(3)]
                    if refit:
                        inside = part.column(3).to_numpy() > 0
                        bins = fitted(tuple(x[inside] for x in old), (lens[inside], angs[inside], dihs[inside]), grid)
                        for g in range(3):
                            values = np.zeros(len(p), np.int32)
                            values[inside] = bins[:, g]
                            glue[g] = pa.array(values, pa.int32(), mask=~inside)
                        dihs[inside, 0], angs[inside, 0], dihs[inside, 1] = (grid[g][bins[:, g]] for g in range(3))
                    sums = summary(lens, angs, dihs, xyz[:, 1:]).flat()
                    lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (lens, angs, dihs)]
                    names = pa.array([f"{name}.{i}" for i in p.tolist()], pa.string())
                    columns = [part.column(0), part.column(1), names, part.column(3), part.column(4), *glue, *lists, part.column(11), pa.array(list(sums), pa.list_(pa.float64())), pa.array(d[np.arange(len(p)), p] / MICRO)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*COLUMNS, "dev"])

    return rows.select(*COLUMNS).mapInArrow(run, schema)


def fitted(old: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...], grid: list[np.ndarray]) -> np.ndarray:
    """Bins (rows, 3) of the junction that bring the end of the new geometry closest to that of the old one: the best of
    all combinations, ties to the first."""
    out = np.zeros((len(new[0]), 3), np.int64)
    n1, n2, n3 = map(len, grid)
    for lo in range(0, len(out), 64):
        lens, angs, dihs = (x[lo : lo + 64] for x in new)
        k = len(lens)
        _, goal, place = walk(*(x[lo : lo + 64] for x in old))
        _, rest, rest_move = walk(lens[:, 2:], angs[:, 2:], dihs[:, 2:])
        flat = np.array([(o, c) for o in grid[0] for c in grid[1]])
        a, am = bond_motions(np.broadcast_to(lens[:, :1], (k, n1 * n2)), np.broadcast_to(flat[:, 1], (k, n1 * n2)), np.broadcast_to(flat[:, 0], (k, n1 * n2)))
        b, bm = bond_motions(np.broadcast_to(lens[:, 1:2], (k, n3)), np.broadcast_to(angs[:, 1:2], (k, n3)), np.broadcast_to(grid[2], (k, n3)))
        tail, tail_move = b @ rest[:, None], bm + np.einsum("nbij,nj->nbi", b, rest_move)
        r = a[:, :, None] @ tail[:, None]
        t = am[:, :, None] + np.einsum("naij,nbj->nabi", a, tail_move)
        turn = 6 - 2 * np.einsum("nabij,nij->nab", r, goal)
        loss = TURN_WEIGHT * turn + MOVE_WEIGHT * ((t - place[:, None, None]) ** 2).sum(-1)
        best = np.rint(loss.reshape(k, -1) * 1e9).argmin(1)
        out[lo : lo + 64] = np.stack([best // n3 // n2, best // n3 % n2, best % n3], 1)
    return out


def shape_pairs(rows: DataFrame) -> DataFrame:
    """(chain, pos, left, right, g1, g2, g3) of each junction."""
    by = by_chain()
    return rows.select("chain", "pos", F.col("token").alias("left"), F.lead("token").over(by).alias("right"), *[F.lead(g).over(by).alias(g) for g in GLUE]).filter("right IS NOT NULL")


def shape_pair_counts(rows: DataFrame) -> DataFrame:
    return shape_pairs(rows).groupBy("left", "right", *GLUE).agg(F.count(F.lit(1)).alias("n"))


def mark(rows: DataFrame, left: str, right: str, glue: tuple[int, int, int]) -> DataFrame:
    """Rows with ``take`` (the first half of an occurrence, greedily from the left) and ``dead`` (the second half)."""
    by = by_chain()
    same = (F.col("token") == left) & (F.lead("token").over(by) == right)
    for g, v in zip(GLUE, glue, strict=True):
        same = same & F.lead(g).over(by).eqNullSafe(F.lit(v))
    rows = rows.withColumn("hit", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("chain", "hit").orderBy("pos")))
    nth = F.row_number().over(W.partitionBy("chain", "hit", "run").orderBy("pos")) - 1
    rows = rows.withColumn("take", F.col("hit") & (nth % 2 == 0)).drop("hit", "run")
    return rows.withColumn("dead", F.lag("take", 1, False).over(by))


def occurrences(marked: DataFrame, name: str) -> DataFrame:
    """Taken rows joined to their second halves, under the new name."""
    by = by_chain()
    joined = {c: F.concat(F.col(c), F.lead(c).over(by)) for c in ("lens", "angs", "dihs")}
    after = F.lead("xyz").over(by)
    rows = marked.select(
        "chain", "pos", F.lit(name).alias("token"), "start", (F.col("width") + F.lead("width").over(by)).alias("width"), *GLUE, *[joined[c].alias(c) for c in joined],
        F.concat(F.col("xyz"), F.slice(after, 4, F.size(after))).alias("xyz"), F.lit(None).cast("array<double>").alias("sums"), "take",
    )
    return rows.filter("take").drop("take")


def renumbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(by_chain()) - 1).cast("long"))


def merged(marked: DataFrame, new: DataFrame) -> DataFrame:
    """The table after a merge, with ``fresh`` and ``dev`` of the rows that are new."""
    stay = marked.filter("NOT take AND NOT dead").select(*COLUMNS, F.lit(False).alias("fresh"), F.lit(None).cast("double").alias("dev"))
    return renumbered(stay.unionByName(new.withColumn("fresh", F.lit(True))))


def changed_counts(marked: DataFrame, after: DataFrame) -> DataFrame:
    """(left, right, g1, g2, g3, n): new keys minus old ones, of the junctions beside what a merge has touched only."""
    by = by_chain()

    def keys(rows: DataFrame, touched, sign: int) -> DataFrame:
        near = touched | F.coalesce(F.lead(touched).over(by), F.lit(False))
        rows = rows.select(near.alias("near"), F.col("token").alias("left"), F.lead("token").over(by).alias("right"), *[F.lead(g).over(by).alias(g) for g in GLUE])
        return rows.filter("near AND right IS NOT NULL").drop("near").withColumn("n", F.lit(sign).cast("long"))

    old = keys(marked, F.col("take") | F.col("dead"), -1)
    return old.unionByName(keys(after, F.col("fresh"), 1)).groupBy("left", "right", *GLUE).agg(F.sum("n").alias("n")).filter("n <> 0")


def chain_errors(rows: DataFrame) -> DataFrame:
    """(chain, tokens, rmsd): how far each chain, as its tokens have it, is from the original after superposition. Put
    together from the tokens' sums; no chain is rebuilt."""
    kind = rows.schema["chain"].dataType.simpleString()
    counts = rows.groupBy("chain").agg(F.count(F.lit(1)).alias("tokens"), F.max(F.when(F.col("pos") == 0, F.slice("xyz", 1, 3))).alias("first"))
    each = products(rows.select("chain", "pos", "sums")).join(counts, "chain")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                sums, first = (np.array(batch.column(c).to_pylist(), float) for c in (1, 3))
                rmsd = start_summary(first).then(Summary.of_flat(sums)).rmsd()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rmsd)], names=["chain", "tokens", "rmsd"])

    return each.select("chain", "sums", "tokens", "first").mapInArrow(run, f"chain {kind}, tokens bigint, rmsd double")


def settled_shapes(rows: DataFrame) -> DataFrame:
    return settle(rows.select(*COLUMNS))
