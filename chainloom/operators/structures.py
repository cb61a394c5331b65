"""Chains of atoms: validity, internal coordinates, sequences, clashes, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.functions.geometry import Vector, add, bond_angle, cross, dihedral, dot, frame, norm, scale, sub, unit
from chainloom.sources.text import one_letter

BACKBONE = ("N", "CA", "C")
#: Van der Waals radii in Angstrom (fixed values).
RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}


def backbone(atoms: DataFrame) -> DataFrame:
    """Backbone atoms with ``k``, their number in the chain from 0."""
    kept = atoms.filter(F.col("atom").isin(*BACKBONE))
    return kept.withColumn("k", F.row_number().over(W.partitionBy("chain_id").orderBy("atom_id")) - 1)


def valid_chains(backbone_atoms: DataFrame) -> DataFrame:
    """(chain_id, n_residues, valid): three atoms to each residue and residue numbers that strictly rise."""
    r = F.floor(F.col("k") / 3)
    residues = backbone_atoms.withColumn("r", r).groupBy("chain_id", "r").agg(
        F.count(F.lit(1)).alias("n"), F.min("res_id").alias("lo"), F.max("res_id").alias("hi")
    )
    before = F.lag("hi").over(W.partitionBy("chain_id").orderBy("r"))
    good = (F.col("n") == 3) & (F.col("lo") == F.col("hi")) & (before.isNull() | (F.col("lo") > before))
    return residues.withColumn("good", good).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_residues"), F.bool_and("good").alias("valid"))


def bonds(backbone_atoms: DataFrame) -> DataFrame:
    """(chain_id, k, kind, len, ang, dih): bond k joins atoms k and k + 1; the angle is at atom k, the dihedral about
    bond k - 1 ends at atom k + 1. Values that need atoms before the chain are null."""
    order = W.partitionBy("chain_id").orderBy("k")
    at = lambda shift: tuple(F.lag(c, shift).over(order) if shift > 0 else F.lead(c, -shift).over(order) if shift < 0 else F.col(c) for c in "xyz")
    two, one, here, after = at(2), at(1), at(0), at(-1)
    rows = backbone_atoms.select(
        "chain_id", "k", (F.col("k") % 3).alias("kind"), norm(sub(after, here)).alias("len"),
        bond_angle(one, here, after).alias("ang"), dihedral(two, one, here, after).alias("dih"),
    )
    return rows.filter("len IS NOT NULL")


def named_dihedrals(bond_rows: DataFrame) -> DataFrame:
    """(chain_id, r, psi, omega, phi) of each residue junction: bond kinds 2, 0 and 1 end those angles."""
    dih = bond_rows.filter("dih IS NOT NULL").withColumn("r", F.floor((F.col("k") - 2) / 3))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("dih")))
    return dih.groupBy("chain_id", "r").agg(pick(2).alias("psi"), pick(0).alias("omega"), pick(1).alias("phi"))


def sequences(atoms: DataFrame) -> DataFrame:
    """(chain_id, seq): one letter for each residue, the first atom of a (chain, number, insertion) wins."""
    first = atoms.groupBy("chain_id", "chain", "res_id", "ins_code").agg(F.min(F.struct("atom_id", "res")).alias("m"))
    letters = first.select("chain_id", F.col("m.atom_id").alias("at"), one_letter(F.col("m.res")).alias("aa"))
    return letters.groupBy("chain_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "aa"))), lambda x: x["aa"]), "").alias("seq"))


def c_betas(atoms: DataFrame) -> DataFrame:
    """One row for each backbone residue with its first CB atom, null without one."""
    cb = atoms.filter("atom = 'CB'").groupBy("chain_id", "res_id", "ins_code").agg(F.min(F.struct("atom_id", "x", "y", "z")).alias("m"))
    residues = atoms.filter("atom = 'CA'").select("chain_id", "res_id", "ins_code").distinct()
    return residues.join(cb, ["chain_id", "res_id", "ins_code"], "left").select("chain_id", "res_id", "ins_code", "m.x", "m.y", "m.z")


def clashes(points: DataFrame, chain: str = "chain_id", index: str = "k", radius: str = "radius", factor: float = 0.63) -> DataFrame:
    """(chain, n): atoms that come closer to some atom beyond their neighbours than the radii allow.

    Points fall into cells as wide as the largest reach, so only neighbouring cells meet.
    """
    reach = 2 * max(RADII.values()) * factor
    cell = lambda c: F.floor(F.col(c) / reach)
    a = points.select(F.col(chain).alias("chain"), F.col(index).alias("i"), "x", "y", "z", F.col(radius).alias("r"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    b = a.withColumn("d", F.explode(around)).select(
        "chain", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), F.col("r").alias("r2"),
        (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), (F.col("cz") + F.col("d.k")).alias("cz"),
    )
    dist = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 + (F.col("z") - F.col("z2")) ** 2)
    met = a.join(b, ["chain", "cx", "cy", "cz"]).filter((F.abs(F.col("i") - F.col("j")) > 1) & (dist <= factor * (F.col("r") + F.col("r2"))))
    counts = met.groupBy("chain").agg(F.countDistinct("i").alias("n"))
    return points.select(F.col(chain).alias("chain")).distinct().join(counts, "chain", "left").select("chain", F.coalesce("n", F.lit(0)).alias("n"))


def voxels(points: DataFrame, chain: str, grid: int = 64, padding: float = 2.0) -> DataFrame:
    """(chain, vx, vy, vz): occupied cells of a grid over each chain's box with padding; sparse. Each axis has its own
    spacing, so that ``grid`` points reach from one end of the box to the other."""
    box = points.groupBy(chain).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = points.join(box, chain)
    step = lambda c: (F.col(f"hi{c}") - F.col(f"lo{c}") + 2 * padding) / (grid - 1)
    return rows.select(F.col(chain).alias("chain"), *[F.floor((F.col(c) - F.col(f"lo{c}") + padding) / step(c)).alias(f"v{c}") for c in "xyz"]).distinct()


def place(a: Vector, b: Vector, c: Vector, length: float | Column, angle: float | Column, torsion: float | Column) -> Vector:
    """The point d with |cd| = length, angle bcd, torsion abcd, as columns."""
    bc = unit(sub(c, b))
    n = unit(cross(sub(b, a), bc))
    m = cross(n, bc)
    t, angle = F.lit(torsion), F.lit(angle)
    along, across = -length * F.cos(angle), length * F.sin(angle)
    return add(c, add(scale(bc, along), add(scale(m, across * F.cos(t)), scale(n, across * F.sin(t)))))


def oxygens(backbone_atoms: DataFrame, length: float = 1.2359, angle: float = 2.0993) -> DataFrame:
    """(chain_id, res_id, x, y, z): the oxygen of each residue but the last, opposite the next nitrogen."""
    by = W.partitionBy("chain_id").orderBy("k")
    nxt = lambda s: tuple(F.lead(c, s).over(by) for c in "xyz")
    rows = backbone_atoms.select("chain_id", "res_id", "k", *[F.col(c).alias(f"n{c}") for c in "xyz"], *[v.alias(f"{p}{c}") for p, s in (("a", 1), ("c", 2), ("m", 3)) for c, v in zip("xyz", nxt(s), strict=True)])
    rows = rows.filter((F.col("k") % 3 == 0) & F.col("mx").isNotNull())
    v = lambda p: tuple(F.col(f"{p}{c}") for c in "xyz")
    psi = dihedral(v("n"), v("a"), v("c"), v("m"))
    o = place(v("n"), v("a"), v("c"), length, angle, psi + F.lit(3.141592653589793))
    return rows.select("chain_id", "res_id", *[x.alias(c) for x, c in zip(o, "xyz", strict=True)])


def residue_frames(backbone_atoms: DataFrame) -> DataFrame:
    """(chain_id, r, ox, oy, oz, x1..x3, y1..y3, z1..z3): origin CA and axes of each whole residue."""
    pick = lambda atom, c: F.max(F.when(F.col("atom") == atom, F.col(c))).alias(f"{atom}{c}")
    wide = backbone_atoms.groupBy("chain_id", F.floor(F.col("k") / 3).alias("r")).agg(*[pick(a, c) for a in BACKBONE for c in "xyz"])
    v = lambda a: tuple(F.col(f"{a}{c}") for c in "xyz")
    axes = frame(v("N"), v("CA"), v("C"))
    named = [x.alias(f"{p}{i + 1}") for p, axis in zip("xyz", axes, strict=True) for i, x in enumerate(axis)]
    return wide.filter("Nx IS NOT NULL AND CAx IS NOT NULL AND Cx IS NOT NULL").select("chain_id", "r", *[F.col(f"CA{c}").alias(f"o{c}") for c in "xyz"], *named)


def local_side_chains(atoms: DataFrame, backbone_atoms: DataFrame) -> DataFrame:
    """(chain_id, res_id, atom, u, v, w): atoms beyond the backbone in their residue's frame."""
    frames = residue_frames(backbone_atoms)
    numbers = backbone_atoms.filter("atom = 'CA'").select("chain_id", "res_id", "ins_code", F.floor(F.col("k") / 3).alias("r"))
    side = atoms.filter(~F.col("atom").isin(*BACKBONE, "O", "OXT")).join(numbers, ["chain_id", "res_id", "ins_code"]).join(frames, ["chain_id", "r"])
    d = sub(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"o{c}") for c in "xyz"))
    axis = lambda p: tuple(F.col(f"{p}{i}") for i in (1, 2, 3))
    return side.select("chain_id", "res_id", "atom", *[dot(d, axis(p)).alias(n) for p, n in zip("xyz", "uvw", strict=True)])


def whole_residues(backbone_atoms: DataFrame) -> DataFrame:
    """(chain_id, r, res_id, ins_code, aa, a1..a3, b1..b3, c1..c3): residues with all of N, CA and C, and where those stand."""
    rows = backbone_atoms.groupBy("chain_id", F.floor(F.col("k") / 3).alias("r")).agg(
        *[F.min(F.when(F.col("atom") == "CA", F.col(c))).alias(c) for c in ("res_id", "ins_code", "res")],
        *[F.max(F.when(F.col("atom") == atom, F.col(c))).alias(f"{p}{i}") for p, atom in zip("abc", BACKBONE, strict=True) for i, c in enumerate("xyz", 1)],
    )
    spots = [f"{p}{i}" for p in "abc" for i in (1, 2, 3)]
    return rows.dropna(subset=spots).select("chain_id", "r", "res_id", "ins_code", one_letter(F.col("res")).alias("aa"), *spots)


def side_chain_library(atoms: DataFrame, backbone_atoms: DataFrame) -> DataFrame:
    """(aa, atom, dist, ang, dih): how the atoms beyond N, CA and C stand to them, in the first whole residue of each letter by
    chain and place; a letter whose first residue has none has no row. Of atoms with one name the first counts.

    The first residues come from one aggregate of a row for each letter, so a frequent letter is no burden."""
    spots = [f"{p}{i}" for p in "abc" for i in (1, 2, 3)]
    first = whole_residues(backbone_atoms).groupBy("aa").agg(F.min(F.struct("chain_id", "r", "res_id", "ins_code", *spots)).alias("m")).select("aa", "m.*")
    side = atoms.filter(~F.col("atom").isin(*BACKBONE)).join(F.broadcast(first), ["chain_id", "res_id", "ins_code"])  # a row for each letter
    side = side.groupBy("aa", "atom").agg(F.min(F.struct("atom_id", "x", "y", "z", *spots)).alias("m")).select("aa", "atom", "m.*")
    a, b, c = (tuple(F.col(f"{p}{i}") for i in (1, 2, 3)) for p in "abc")
    d = tuple(F.col(v) for v in "xyz")
    return side.select("aa", "atom", norm(sub(d, c)).alias("dist"), bond_angle(d, c, b).alias("ang"), dihedral(a, b, c, d).alias("dih"))


def side_chains(residues: DataFrame, library: DataFrame) -> DataFrame:
    """(chain_id, r, res_id, atom, x, y, z): the library's atoms set on whole residues by their letter ``aa``, which may be
    another one than the residue was read with. Letters that the library doesn't know get no atoms.

    The library holds one residue for each letter, so it is broadcast: joining by twenty letters would make hot keys."""
    a, b, c = (tuple(F.col(f"{p}{i}") for i in (1, 2, 3)) for p in "abc")
    rows = residues.join(F.broadcast(library), "aa")
    d = place(a, b, c, F.col("dist"), F.col("ang"), F.col("dih"))
    return rows.select("chain_id", "r", "res_id", "atom", *[v.alias(n) for v, n in zip(d, "xyz", strict=True)])


def nearest_partners(points: DataFrame, chain: str, index: str) -> DataFrame:
    """(chain, i, j): the nearest other point of the same chain, ties to the lower index; a chain bounds its pairs."""
    a = points.select(chain, F.col(index).alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = points.select(chain, F.col(index).alias("j"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = norm(sub(tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz")))
    best = a.join(b, chain).filter("i <> j").groupBy(chain, "i").agg(F.min(F.struct(d.alias("d"), "j")).alias("m"))
    return best.select(chain, "i", "m.j")


def lddt(reference: DataFrame, model: DataFrame, radius: float = 15.0, steps: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """(chain, n, lddt): the share of the reference's distances below ``radius`` that the model keeps within each of some
    steps, over all steps; both tables have chain, k, x, y, z.

    Near pairs meet in cells of the radius, each point in its own and the half of its neighbours that come later, so a chain's
    pairs are never all listed. A distance that the model lacks is not kept; a chain without near pairs has no row."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    rows = reference.select("chain", "k", "x", "y", "z", *[cell(c).alias(f"c{c}") for c in "xyz"])
    later = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    near = F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy"), (F.col("cz") + c).alias("cz"), F.lit((a, b, c) == (0, 0, 0)).alias("own")) for a, b, c in later])
    left = rows.select("chain", F.col("k").alias("i"), *[F.col(c).alias(f"{c}1") for c in "xyz"], F.explode(near).alias("to"))
    left = left.select("chain", "i", "x1", "y1", "z1", "to.cx", "to.cy", "to.cz", "to.own")
    pairs = left.join(rows.withColumnRenamed("k", "j"), ["chain", "cx", "cy", "cz"]).filter(~F.col("own") | (F.col("i") < F.col("j")))
    apart = norm((F.col("x1") - F.col("x"), F.col("y1") - F.col("y"), F.col("z1") - F.col("z")))
    pairs = pairs.select("chain", "i", "j", apart.alias("d")).filter(F.col("d") < radius)
    end = lambda name, p: model.select("chain", F.col("k").alias(name), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    both = pairs.join(end("i", "s"), ["chain", "i"], "left").join(end("j", "t"), ["chain", "j"], "left")
    off = F.abs(F.col("d") - norm(tuple(F.col(f"s{c}") - F.col(f"t{c}") for c in "xyz")))
    kept = sum((F.coalesce(off < s, F.lit(False)).cast("int") for s in steps), F.lit(0)) / len(steps)
    return both.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.avg(kept).alias("lddt"))
