"""Motifs with glue: tokens over a chain of bonds, joined by quantised junction angles.

A motif table has the columns chain, pos, token, start, width and the glue to the next token: three bins (g1, g2, g3),
null at the end of a chain. Two neighbouring tokens are the same pair only if their glue is the same too, so a merged
motif fixes its inner geometry. All steps are windows and equality joins; learning collects one row a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.functions.angles import TWO_PI
from chainloom.operators.bins import bin_centre, bin_of, equal_width_edges, quantile_edges
from chainloom.storage import settle

GLUE = ("g1", "g2", "g3")
#: Features of a residue and of its junction to the next one, as (name, bond column, bond number behind the start).
INNER = (("tau", "ang", 1), ("ca_c_n", "ang", 2), ("psi", "dih", 2))
JUNCTION = (("omega", "dih", 3), ("c_n_ca", "ang", 3), ("phi", "dih", 4))


def by_chain():
    return W.partitionBy("chain").orderBy("pos")


def feature_edges(bonds: DataFrame, bins: int, strategy: str = "width") -> dict[str, list[float]]:
    """Bin edges of the six features: equal widths over [0, 2 pi), or quantiles of what is there."""
    out = {}
    for name, column, at in (*INNER, *JUNCTION):
        if strategy == "width":
            out[name] = equal_width_edges(0.0, TWO_PI, bins)
        else:
            own = bonds.filter(F.col("kind") == at % 3).select(turned(F.col(column)).alias("v")).filter("v IS NOT NULL")
            out[name] = quantile_edges(own, "v", bins)
    return out


def edges_by_size(base: dict[str, list[float]], sizes: dict[int, int], most: int) -> DataFrame | list[tuple]:
    """Rows (size, feature, bin, lo, hi) for every size up to ``most``: each has the bins of the largest configured size
    that isn't above it, so a lookup by size is an equality join."""
    rows = []
    for size in range(1, most + 1):
        own = [s for s in sizes if s <= size]
        if not own:
            continue
        for feature, edges in base.items():
            grid = equal_width_edges(edges[0], edges[-1], sizes[max(own)])
            rows += [(size, feature, i, a, b) for i, (a, b) in enumerate(zip(grid, grid[1:], strict=False))]
    return rows


def turned(angle: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(TWO_PI))


def residue_tokens(bonds: DataFrame, edges: dict[str, list[float]], chain: str = "chain_id") -> DataFrame:
    """The first motif table: one token for each residue, named by the bins of its inner angles."""
    by = W.partitionBy(chain).orderBy("k")
    pick = lambda column, at: F.lead(column, at).over(by) if at else F.col(column)
    columns = [pick(column, at).alias(name) for name, column, at in (*INNER, *JUNCTION)]
    rows = bonds.select(F.col(chain).alias("chain"), "k", "kind", *columns, F.max("k").over(W.partitionBy(chain)).alias("last")).filter("kind = 0")
    inner = [F.coalesce(bin_of(turned(F.col(n)), edges[n], "clamp").cast("string"), F.lit("-")) for n, _, _ in INNER]
    glue = [bin_of(turned(F.col(n)), edges[n], "clamp").alias(g) for g, (n, _, _) in zip(GLUE, JUNCTION, strict=True)]
    width = F.least(F.lit(3), F.col("last") - F.col("k") + 1)
    return rows.select("chain", (F.col("k") / 3).cast("long").alias("pos"), F.concat_ws(",", *inner).alias("token"), F.col("k").cast("long").alias("start"), width.cast("long").alias("width"), *glue)


def bond_tokens(bonds: DataFrame, chain: str = "chain_id") -> DataFrame:
    """The plainest motif table: one token for each bond, named by its kind, without glue."""
    return bonds.select(F.col(chain).alias("chain"), F.col("k").cast("long").alias("pos"), F.col("kind").cast("string").alias("token"), F.col("k").cast("long").alias("start"), F.lit(1).cast("long").alias("width"), *[F.lit(0).alias(g) for g in GLUE])


def motif_pairs(motifs: DataFrame) -> DataFrame:
    """(chain, pos, left, right, g1, g2, g3) for each junction."""
    right = F.lead("token").over(by_chain())
    return motifs.select("chain", "pos", F.col("token").alias("left"), right.alias("right"), *GLUE).filter("right IS NOT NULL")


def motif_pair_counts(motifs: DataFrame) -> DataFrame:
    return motif_pairs(motifs).groupBy("left", "right", *GLUE).agg(F.count(F.lit(1)).alias("n"))


def merge_motifs(motifs: DataFrame, left: str, right: str, glue: tuple[int, int, int], name: str) -> DataFrame:
    """The motif table after every left-to-right occurrence of a pair with that glue became one token."""
    by = by_chain()
    same = (F.col("token") == left) & (F.lead("token").over(by) == right)
    for g, v in zip(GLUE, glue, strict=True):
        same = same & F.col(g).eqNullSafe(F.lit(v))
    rows = motifs.withColumn("hit", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("chain", "hit").orderBy("pos")))
    nth = F.row_number().over(W.partitionBy("chain", "hit", "run").orderBy("pos")) - 1
    rows = rows.withColumn("take", F.col("hit") & (nth % 2 == 0)).drop("hit", "run")
    after = {c: F.lead(c).over(by) for c in ("width", *GLUE)}
    rows = rows.withColumn("dead", F.lag("take", 1, False).over(by)).select(
        "chain", "pos", F.when(F.col("take"), F.lit(name)).otherwise(F.col("token")).alias("token"), "start", "dead",
        (F.col("width") + F.when(F.col("take"), after["width"]).otherwise(F.lit(0))).alias("width"),
        *[F.when(F.col("take"), after[g]).otherwise(F.col(g)).alias(g) for g in GLUE],
    )
    rows = rows.filter(~F.col("dead")).drop("dead")
    return rows.withColumn("pos", (F.row_number().over(by) - 1).cast("long")).select("chain", "pos", "token", "start", "width", *GLUE)


VOCABULARY = "step int, name string, left string, right string, g1 int, g2 int, g3 int, n bigint"


def learn_motifs(motifs: DataFrame, steps: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, motifs) after up to ``steps`` merges; ties go to the smaller key."""
    spark = motifs.sparkSession
    motifs, rows = settle(motifs), []
    for step in range(1, steps + 1):
        top = motif_pair_counts(motifs).orderBy(F.desc("n"), "left", "right", *GLUE).first()
        if top is None or top["n"] < least:
            break
        name = f"m{step}"
        rows.append((step, name, top["left"], top["right"], top["g1"], top["g2"], top["g3"], top["n"]))
        motifs = settle(merge_motifs(motifs, top["left"], top["right"], (top["g1"], top["g2"], top["g3"]), name))
    return spark.createDataFrame(rows, VOCABULARY), motifs


def encode_motifs(motifs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """New chains by the merges of a frozen vocabulary, in its order."""
    for i, r in enumerate(vocabulary.orderBy("step").collect(), 1):
        motifs = merge_motifs(motifs, r["left"], r["right"], (r["g1"], r["g2"], r["g3"]), r["name"])
        if i % 8 == 0:
            motifs = settle(motifs)
    return motifs


def motif_ids(motifs: DataFrame) -> DataFrame:
    """(token, id): learned motifs come first, in the order of learning, then the rest by name."""
    learned = F.regexp_extract("token", r"^m(\d+)$", 1)
    order = F.when(learned != "", learned.cast("int"))
    names = motifs.select("token").distinct().withColumn("o", order)
    return names.select("token", (F.row_number().over(W.orderBy(F.col("o").asc_nulls_last(), "token")) - 1).cast("long").alias("id"))


def id_sequence(motifs: DataFrame, ids: DataFrame, bins: tuple[int, int, int]) -> DataFrame:
    """(chain, ord, id): for each token its id and, but for the last, three glue ids: 4 m - 3 rows for m tokens.

    Glue ids lie behind the motif ids, feature after feature.
    """
    k = ids.agg(F.count(F.lit(1)).alias("k"))
    rows = motifs.join(ids, "token").crossJoin(F.broadcast(k))  # one row
    rows = rows.withColumn("end", F.lead("pos").over(by_chain()).isNull())
    at = [F.col("k"), F.col("k") + bins[0], F.col("k") + bins[0] + bins[1]]
    glue = [F.struct((F.col("pos") * 4 + j + 1).alias("ord"), (at[j] + F.col(g)).cast("long").alias("id")) for j, g in enumerate(GLUE)]
    own = F.struct((F.col("pos") * 4).alias("ord"), F.col("id").cast("long").alias("id"))
    items = F.when(F.col("end"), F.array(own)).otherwise(F.array(own, *glue))
    return rows.select("chain", F.explode(items).alias("x")).select("chain", "x.ord", "x.id")


def from_sequence(sequence: DataFrame, ids: DataFrame, bins: tuple[int, int, int]) -> DataFrame:
    """(chain, pos, token, g1, g2, g3) back from ids; a group is one token's own four rows."""
    k = ids.agg(F.count(F.lit(1)).alias("k"))
    rows = sequence.crossJoin(F.broadcast(k)).withColumn("pos", F.floor(F.col("ord") / 4)).withColumn("j", F.col("ord") % 4)
    shift = F.when(F.col("j") == 1, F.col("k")).when(F.col("j") == 2, F.col("k") + bins[0]).when(F.col("j") == 3, F.col("k") + bins[0] + bins[1]).otherwise(F.lit(0))
    rows = rows.withColumn("v", F.col("id") - shift)
    pick = lambda j: F.max(F.when(F.col("j") == j, F.col("v")))
    wide = rows.groupBy("chain", "pos").agg(pick(0).alias("id"), *[pick(j + 1).cast("int").alias(g) for j, g in enumerate(GLUE)])
    return wide.join(ids, "id").select("chain", "pos", "token", *GLUE)


def unfold(motifs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Motifs back to first tokens with all their glue: merges undone from the last to the first."""
    for r in vocabulary.orderBy(F.desc("step")).collect():
        is_it = F.col("token") == r["name"]
        glue = [F.struct(F.lit(r["left"]).alias("token"), *[F.lit(r[g]).cast("int").alias(g) for g in GLUE]), F.struct(F.lit(r["right"]).alias("token"), *[F.col(g).alias(g) for g in GLUE])]
        same = F.array(F.struct("token", *GLUE))
        parts = motifs.select("chain", "pos", F.posexplode(F.when(is_it, F.array(*glue)).otherwise(same)).alias("i", "x"))
        by = W.partitionBy("chain").orderBy("pos", "i")
        motifs = parts.select("chain", (F.row_number().over(by) - 1).cast("long").alias("pos"), "x.token", *[f"x.{g}" for g in GLUE])
    return motifs


def glue_values(motifs: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(chain, pos, omega, c_n_ca, phi): the centres of the glue bins."""
    return motifs.filter("g1 IS NOT NULL").select("chain", "pos", *[bin_centre(F.col(g), edges[n]).alias(n) for g, (n, _, _) in zip(GLUE, JUNCTION, strict=True)])


def slice_geometry(bonds: DataFrame, chain: str, first: int, width: int) -> DataFrame:
    """(chain, lens, angs, dihs): the lengths, angles and dihedrals of ``width`` bonds from ``first``; width, width - 1 and
    width - 2 of them. A group is one chain's own slice."""
    rows = bonds.filter(F.col("k").between(first, first + width - 1))
    of = lambda c, skip: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("k", F.col(c).alias("v")))), lambda x: x["k"] >= first + skip), lambda x: x["v"])
    return rows.groupBy(chain).agg(of("len", 0).alias("lens"), of("ang", 1).alias("angs"), of("dih", 2).alias("dihs"))


def set_geometry(bonds: DataFrame, chain: str, values: DataFrame) -> DataFrame:
    """Bonds with the values of another table (chain, k, len, ang, dih) where it has any."""
    new = values.select(F.col(chain), "k", *[F.col(c).alias(f"new_{c}") for c in ("len", "ang", "dih")])
    out = bonds.join(new, [chain, "k"], "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("len", "ang", "dih") else F.col(c) for c in bonds.columns])
