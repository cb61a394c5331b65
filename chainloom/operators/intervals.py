"""Runs, segments and intervals: half-open [lo, hi) rows with a group column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def runs(rows: DataFrame, chain: str, order: list[str], kind: str) -> DataFrame:
    """(chain, kind, lo, hi): maximal runs of equal ``kind`` in order; positions from 0."""
    by = W.partitionBy(chain).orderBy(*order)
    pos = F.row_number().over(by) - 1
    numbered = rows.select(F.col(chain).alias("chain"), F.col(kind).alias("kind"), pos.alias("pos"))
    island = F.col("pos") - F.row_number().over(W.partitionBy("chain", "kind").orderBy("pos"))
    grouped = numbered.withColumn("island", island).groupBy("chain", "kind", "island")
    return grouped.agg(F.min("pos").cast("long").alias("lo"), (F.max("pos") + 1).cast("long").alias("hi")).drop("island")


def group_segments(rows: DataFrame, chain: str, pos: str, kind: str) -> DataFrame:
    """(chain, kind, lo, hi): a position extends a segment if it follows the last one by 1 and has the same kind."""
    by = W.partitionBy(chain).orderBy(pos)
    same = (F.lag(kind).over(by) == F.col(kind)) & (F.lag(pos).over(by) == F.col(pos) - 1)
    flagged = rows.select(F.col(chain).alias("chain"), F.col(kind).alias("kind"), F.col(pos).alias("pos"), F.when(same, 0).otherwise(1).alias("new"))
    segment = F.sum("new").over(W.partitionBy("chain").orderBy("pos"))
    grouped = flagged.withColumn("seg", segment).groupBy("chain", "seg", "kind")
    return grouped.agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi")).drop("seg")


def sessions(events: DataFrame, chain: str, ts: str, gap_seconds: int) -> DataFrame:
    """(chain, session, lo, hi, n): events closer than the gap; lo and hi in seconds, hi beyond the last event."""
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = events.select(F.col(chain).alias("chain"), sec.alias("s"))
    by = W.partitionBy("chain").orderBy("s")
    new = F.when(F.col("s") - F.lag("s").over(by) < gap_seconds, 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("session", F.sum("new").over(by))
    return rows.groupBy("chain", "session").agg(F.min("s").alias("lo"), (F.max("s") + 1).alias("hi"), F.count(F.lit(1)).alias("n"))


def overlap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi, hi2) - F.greatest(lo, lo2))


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Overlapping pairs (chain, a_lo, a_hi, b_lo, b_hi, common) within a chain.

    Each interval is listed in the cells of ``width`` it touches; a pair is found in the cell where the later one
    begins, so it comes out once and rows meet only within a cell.
    """
    cells = lambda df, p: df.select("chain", F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    both = cells(a, "a").join(cells(b, "b"), ["chain", "cell"])
    both = both.filter((F.col("b_hi") > F.col("a_lo")) & (F.col("b_lo") < F.col("a_hi")) & (F.floor(F.greatest("a_lo", "b_lo") / width) == F.col("cell")))
    return both.withColumn("common", overlap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))).drop("cell")


def max_overlap(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(chain, lo, hi, common): each interval of ``a`` with its largest overlap, 0 without one."""
    best = overlap_join(a, b, width).groupBy("chain", F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).agg(F.max("common").alias("common"))
    return a.select("chain", "lo", "hi").join(best, ["chain", "lo", "hi"], "left").withColumn("common", F.coalesce("common", F.lit(0)))


def best_iou(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(chain, lo, hi, iou, b_lo, b_hi): the segment with the largest intersection over union, ties to the first."""
    both = overlap_join(a, b, width)
    union = (F.col("a_hi") - F.col("a_lo")) + (F.col("b_hi") - F.col("b_lo")) - F.col("common")
    both = both.withColumn("iou", F.col("common") / union)
    best = both.groupBy("chain", F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).agg(F.max(F.struct("iou", (-F.col("b_lo")).alias("first"), "b_hi")).alias("m"))
    found = best.select("chain", "lo", "hi", F.col("m.iou").alias("iou"), (-F.col("m.first")).alias("b_lo"), F.col("m.b_hi").alias("b_hi"))
    return a.select("chain", "lo", "hi").join(found, ["chain", "lo", "hi"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def best_block(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(chain, lo, hi, b_lo, b_hi, iou): the best block of contiguous overlapping segments, trimmed by 0 or 1 segment at
    each end. A group is one interval's own segments."""
    both = overlap_join(a, b, width)
    arrays = both.groupBy("chain", F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).agg(F.sort_array(F.collect_list(F.struct("b_lo", "b_hi"))).alias("s"))
    options = []
    for i in (0, 1):
        for j in (0, 1):
            left, right = F.get("s", F.lit(i))["b_lo"], F.get("s", F.size("s") - 1 - j)["b_hi"]
            common = overlap(F.col("lo"), F.col("hi"), left, right)
            union = F.col("hi") - F.col("lo") + right - left - common
            block = F.struct((common / union).alias("iou"), (-left).alias("first"), right.alias("b_hi"))
            options.append(F.when(F.size("s") > i + j, block))
    best = F.array_max(F.array(*options))
    return arrays.select("chain", "lo", "hi", (-best["first"]).alias("b_lo"), best["b_hi"].alias("b_hi"), best["iou"].alias("iou"))


def domain_scores(a: DataFrame, b: DataFrame, width: int, threshold: float) -> DataFrame:
    """One row over all chains: mean recall, precision and IoU of domains ``a`` against segments ``b``, and precision,
    recall and F1 of segments at an IoU threshold."""
    best = best_iou(a, b, width)
    common = overlap(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi"))
    per = best.select("*", F.coalesce(common / (F.col("hi") - F.col("lo")), F.lit(0.0)).alias("rec"), F.coalesce(common / (F.col("b_hi") - F.col("b_lo")), F.lit(0.0)).alias("prec"))
    hit = F.col("iou") >= threshold
    sums = per.agg(
        F.avg("rec").alias("mean_recall"), F.avg("prec").alias("mean_precision"), F.avg("iou").alias("mean_iou"),
        F.countDistinct(F.when(hit, F.struct("chain", "b_lo", "b_hi"))).alias("hits"), F.sum(hit.cast("int")).alias("found"), F.count(F.lit(1)).alias("domains"),
    )
    out = sums.crossJoin(b.agg(F.count(F.lit(1)).alias("segments")))
    p, r = F.col("hits") / F.col("segments"), F.col("found") / F.col("domains")
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(F.lit(0.0))
    return out.select("mean_recall", "mean_precision", "mean_iou", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def boundary_scores(a: DataFrame, b: DataFrame, delta: int) -> DataFrame:
    """One row: precision, recall and F1 of the boundaries of ``b`` against those of ``a``, within ``delta``.

    Bands are cells of the width of delta, so the join is an equality on three cells, not a theta join.
    """
    ends = lambda df: df.select("chain", F.explode(F.array("lo", "hi")).alias("p")).distinct()
    x, y = ends(a), ends(b)
    w = max(delta, 1)

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        own = left.withColumn("c", F.floor(F.col("p") / w)).alias("l")
        other = right.select("chain", F.col("p").alias("q"), F.explode(F.sequence(F.floor(F.col("p") / w) - 1, F.floor(F.col("p") / w) + 1)).alias("c")).alias("r")
        return own.join(other, F.expr(f"l.chain = r.chain AND l.c = r.c AND abs(p - q) <= {delta}"), "left_semi")

    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(x, "a").crossJoin(n(y, "b")).crossJoin(n(near(y, x), "tp_b")).crossJoin(n(near(x, y), "tp_a"))
    p, r = F.col("tp_b") / F.col("b"), F.col("tp_a") / F.col("a")
    return out.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))
