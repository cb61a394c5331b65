"""Learning motifs with classes of shapes and fitted junctions, and encoding with a frozen vocabulary.

A step takes the most frequent key (two tokens and the bins between them), parts its occurrences by shape, gives each class a
token, and sets the class's geometry everywhere. Fitted junctions may bring a known key back; such keys come first, as
occurrences of their known classes, and are events of their own. Counts follow by what changed. The driver sees the
key of an event and the medoids of its classes; everything else stays in tables.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.medoids import LOCAL
from chainloom.operators.motifs import GLUE
from chainloom.operators.shapes import COLUMNS, Shape, chain_errors, changed_counts, mark, merged, occurrences, settled_shapes, shape_classes, shape_pair_counts, take_shapes
from chainloom.storage import settle

VOCABULARY = "event int, step int, name string, left string, right string, g1 int, g2 int, g3 int, n bigint, classes array<struct<chain:{0},start:bigint,points:array<double>,lens:array<double>,angs:array<double>,dihs:array<double>>>"


def classes_for(width: int, classes: dict[int, int]) -> int:
    """How many classes tokens of a width get: those of the largest configured size that isn't above it, else one.

    >>> [classes_for(w, {2: 3, 6: 2}) for w in (1, 3, 7)]
    [1, 3, 2]
    """
    own = [s for s in classes if s <= width]
    return classes[max(own)] if own else 1


def first_shapes(residues: DataFrame, vocabulary: dict[str, list[Shape]], edges: dict[str, list[float]], original: bool) -> DataFrame:
    return settled_shapes(take_shapes(residues, vocabulary, edges, original))


def learn_shapes(
    residues: DataFrame, steps: int, classes: dict[int, int], edges: dict[str, list[float]], original: bool = True, refit: bool = False,
    least: int = 2, local: int = LOCAL, watch=None, budget: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, shapes) after up to ``steps`` new keys of at least ``least`` occurrences; ties go to the smaller key.

    ``residues`` is a table of ``residue_shapes``. ``watch(event, shapes, counts)`` is called after each event; ``budget`` is that of
    ``find_medoids``. An empty
    table has an empty vocabulary; a chain of one residue is never merged; repeated (chain, start) are not allowed."""
    spark = residues.sparkSession
    residues = settle(residues)
    kind = residues.schema["chain"].dataType.simpleString()
    known: dict[str, list[Shape]] = {}
    rows: list[tuple] = []
    for r in residues.groupBy("token", "width").agg(F.count(F.lit(1)).alias("n")).orderBy("token").collect():  # widths of residues
        known[r["token"]] = shape_classes(residues.filter(F.col("token") == r["token"]), classes_for(r["width"], classes), original, local, budget)
        rows.append((0, 0, r["token"], None, None, None, None, None, r["n"], [asdict(s) for s in known[r["token"]]]))
    held = first_shapes(residues, known, edges, original)
    counts = settle(shape_pair_counts(held))
    names: dict[tuple, str] = {}
    step = event = 0
    while True:
        seen = spark.createDataFrame([(*k, 1) for k in names], "left string, right string, g1 int, g2 int, g3 int, seen int")
        ranked = counts.join(F.broadcast(seen), ["left", "right", *GLUE], "left")  # one row for each event
        top = ranked.orderBy(F.desc(F.coalesce("seen", F.lit(0))), F.desc("n"), "left", "right", *GLUE).first()
        if top is None or top["seen"] is None and (step == steps or top["n"] < least):
            break
        key = (top["left"], top["right"], *(top[g] for g in GLUE))
        event += 1
        if new := key not in names:
            step += 1
            names[key] = f"m{step}"
        name = names[key]
        marked = settle(mark(held, key[0], key[1], key[2:]))
        found = settle(occurrences(marked, name))
        if new:
            width = found.select("width").first()["width"]
            known[name] = shape_classes(found, classes_for(width, classes), original, local, budget)
        rows.append((event, step, name, *key, top["n"], [asdict(s) for s in known[name]]))
        after = settle(merged(marked, take_shapes(found, {name: known[name]}, edges, original, refit)))
        counts = settle(counts.unionByName(changed_counts(marked, after)).groupBy("left", "right", *GLUE).agg(F.sum("n").alias("n")).filter("n > 0"))
        held = after.select(*COLUMNS)
        if watch:
            watch(event, held, counts)
    return spark.createDataFrame(rows, VOCABULARY.format(kind)), held


def encode_shapes(residues: DataFrame, vocabulary: DataFrame, edges: dict[str, list[float]], original: bool = True, refit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(shapes, errors) of chains under a frozen vocabulary: each residue as its nearest prototype, then all events in
    their order. errors has chain, event, step, k (tokens known by then), tokens and rmsd, after the prototypes (event 0)
    and after each event; sums of the tokens are put together, nothing is rebuilt.

    Residues of a width that the vocabulary lacks raise; a chain in which nothing merges keeps its residues."""
    rows = vocabulary.orderBy("event", "name").collect()  # one for each event
    sets = {r["name"]: [Shape(*(c[f] for f in ("chain", "start", "points", "lens", "angs", "dihs"))) for c in r["classes"]] for r in rows}
    base = [r["name"] for r in rows if r["event"] == 0]
    checked = residues.withColumn("token", F.when(F.col("token").isin(base), F.col("token")).otherwise(F.raise_error(F.concat(F.lit("no prototype for "), F.col("token")))))
    held = first_shapes(checked, {n: sets[n] for n in base}, edges, original)
    seen, errors = {n: len(sets[n]) for n in base}, []

    def note(event: int, step: int) -> None:
        found = chain_errors(held).select("chain", F.lit(event).alias("event"), F.lit(step).alias("step"), F.lit(sum(seen.values())).cast("long").alias("k"), "tokens", "rmsd")
        errors.append(settle(found))

    note(0, 0)
    for r in rows:
        if r["event"]:
            marked = settle(mark(held, r["left"], r["right"], tuple(r[g] for g in GLUE)))
            held = settled_shapes(merged(marked, take_shapes(occurrences(marked, r["name"]), {r["name"]: sets[r["name"]]}, edges, original, refit)))
            seen[r["name"]] = len(sets[r["name"]])
            note(r["event"], r["step"])
    out = errors[0]
    for e in errors[1:]:
        out = out.unionByName(e)
    return held, out
