"""Summaries: codebook use, divergences, correlations, classification, agreement, Pareto fronts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.operators.rounds import front
from chainloom.operators.splits import quantiles, running_sum


def codebook_utility(tokens: DataFrame, token: str, size: int | None = None, eps: float = 1e-8) -> DataFrame:
    """One row: perplexity, entropy, both by vocabulary size, and the share of tokens used. ``size`` counts unused ones."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("used"))
    p = F.col("c") / F.col("t")
    entropy = -F.sum(p * F.log(p + eps))
    out = counts.crossJoin(F.broadcast(total)).agg(entropy.alias("entropy"), F.max("used").alias("used"))  # one row
    k = F.lit(size) if size else F.col("used")
    return out.select(
        F.exp("entropy").alias("perplexity"), (F.exp("entropy") / k).alias("perplexity_normalized"), "entropy",
        (F.col("entropy") / k).alias("entropy_normalized"), (F.col("used") / k).alias("use_ratio"),
    )


def kl(p: DataFrame, q: DataFrame, keys: list[str], pseudo: float = 0.0, base: float = math.e) -> DataFrame:
    """One row, kl: the divergence of counts ``p`` (keys, n) from ``q``, over keys that either holds.

    ``pseudo`` is added to every count of both. A key that only ``p`` holds makes it infinite.
    """
    both = p.withColumnRenamed("n", "__p").join(q.withColumnRenamed("n", "__q"), keys, "full")
    both = both.select((F.coalesce("__p", F.lit(0)) + pseudo).alias("a"), (F.coalesce("__q", F.lit(0)) + pseudo).alias("b"))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    pa, pb = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    term = F.when(F.col("a") == 0, F.lit(0.0)).when(F.col("b") == 0, F.lit(float("inf"))).otherwise(pa * F.log(pa / pb) / math.log(base))
    return both.crossJoin(F.broadcast(total)).agg(F.sum(term).alias("kl"))


def symmetric_kl(p: DataFrame, q: DataFrame, keys: list[str], pseudo: float = 0.0, base: float = math.e) -> DataFrame:
    a, b = kl(p, q, keys, pseudo, base), kl(q, p, keys, pseudo, base).withColumnRenamed("kl", "back")
    return a.crossJoin(b).select((F.col("kl") + F.col("back")).alias("kl"))


def histogram_2d(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """(bx, by, n) of two bin columns."""
    return rows.select(x.alias("bx"), y.alias("by")).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def five_numbers(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., lowest, q1, median, q3, highest)."""
    names = dict(zip(("lowest", "q1", "median", "q3", "highest"), range(5), strict=True))
    out = quantiles(rows, value, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    return out.select(*(by or []), *[F.col(f"q{i}").alias(n) for n, i in names.items()])


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def average_ranks(rows: DataFrame, value: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """Ranks from 1, equal values share the mean of theirs. Values are counted first: ranks come from a running sum over
    ranges of distinct values, not over rows, and no task holds them all."""
    by = partition or []
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_sum(counts, value, "__c", "__before", by).select(*by, value, (F.col("__before") + (F.col("__c") + 1) / 2).alias(out))
    return rows.join(ranked, [*by, value])


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row, rho: the correlation of average ranks."""
    ranked = average_ranks(average_ranks(rows.select(x, y), x, "rx"), y, "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"))


def r_squared(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """One row, r2."""
    mean = rows.agg(F.avg(target).alias("m"))
    miss, spread = F.col(target) - F.col(predicted), F.col(target) - F.col("m")
    return rows.crossJoin(F.broadcast(mean)).agg((1 - F.sum(miss * miss) / F.sum(spread * spread)).alias("r2"))


def confusion(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """(predicted, target, n) without rows whose target is null, NaN or -100, which mean no label."""
    t = F.col(target)
    kept = rows.filter(t.isNotNull() & (t != -100))
    return kept.groupBy(F.col(predicted).alias("predicted"), t.alias("target")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(table: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("predicted") == F.col("target"), F.col("n")).otherwise(0))
    return table.agg((hit / F.sum("n")).alias("accuracy"))


def macro_f1(table: DataFrame) -> DataFrame:
    """One row, macro_f1: the mean over classes that occur as target or prediction."""
    tp = table.filter("predicted = target").select(F.col("target").alias("c"), F.col("n").alias("tp"))
    by_p = table.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("p"))
    by_t = table.groupBy(F.col("target").alias("c")).agg(F.sum("n").alias("t"))
    both = by_p.join(by_t, "c", "full").join(tp, "c", "left").fillna(0, ["p", "t", "tp"])
    return both.agg(F.avg(2 * F.col("tp") / (F.col("p") + F.col("t"))).alias("macro_f1"))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auroc, by the rank sum of the positives with average ranks."""
    ranked = average_ranks(rows.select(score, label), score, "r")
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    ranks = F.sum(F.when(F.col(label) == 1, F.col("r")).otherwise(0.0))
    return ranked.agg(((ranks - pos * (pos + 1) / 2) / (pos * neg)).alias("auroc"))


def clustering_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and variation of information (natural logarithm) of two labellings."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    ent = lambda df: df.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias("h"), F.sum(two(F.col("n"))).alias("c"))
    total = cells.agg(F.sum("n").alias("t"))
    joint = ent(cells).select(F.col("h").alias("hab"), F.col("c").alias("cab"))
    left = ent(cells.groupBy("a").agg(F.sum("n").alias("n"))).select(F.col("h").alias("ha"), F.col("c").alias("ca"))
    right = ent(cells.groupBy("b").agg(F.sum("n").alias("n"))).select(F.col("h").alias("hb"), F.col("c").alias("cb"))
    expected = F.col("ca") * F.col("cb") / two(F.col("t"))
    ari = (F.col("cab") - expected) / ((F.col("ca") + F.col("cb")) / 2 - expected)
    out = joint.crossJoin(left).crossJoin(right).crossJoin(total)
    return out.select(ari.alias("ari"), (2 * F.col("hab") - F.col("ha") - F.col("hb")).alias("vi"))


def pareto_front(points: DataFrame, key: str, axes: dict[str, str], eps: float = 1e-12) -> DataFrame:
    """Rows that no other row beats: ``axes`` maps a column to "min" or "max"."""
    return front(points, key, axes, eps)


def capacity_bits(n_prototypes: int, lengths: list[int], k: int, m: float, bins: int) -> float:
    """Bits to store the prototypes (32 for each of 3 n - 3 numbers) and one chain of ``m`` tokens with three glue values
    of ``bins`` bins at each junction."""
    return sum(32.0 * (3 * n - 3) for n in lengths[:n_prototypes]) + m * math.log2(max(k, 1)) + 3 * (m - 1) * math.log2(max(bins, 1))


def kl_by_group(p: DataFrame, q: DataFrame, group: list[str], keys: list[str], pseudo: float = 0.0) -> DataFrame:
    """(group, kl) as :func:`kl` within each group."""
    on = [*group, *keys]
    both = p.withColumnRenamed("n", "__p").join(q.withColumnRenamed("n", "__q"), on, "full")
    both = both.select(*group, (F.coalesce("__p", F.lit(0)) + pseudo).alias("a"), (F.coalesce("__q", F.lit(0)) + pseudo).alias("b"))
    w = W.partitionBy(*group)
    both = both.withColumn("pa", F.col("a") / F.sum("a").over(w)).withColumn("pb", F.col("b") / F.sum("b").over(w))
    term = F.when(F.col("a") == 0, F.lit(0.0)).when(F.col("b") == 0, F.lit(float("inf"))).otherwise(F.col("pa") * F.log(F.col("pa") / F.col("pb")))
    return both.groupBy(*group).agg(F.sum(term).alias("kl"))


def floored_density(counts: DataFrame, nx: int, ny: int, floor: float = 1e-8) -> DataFrame:
    """(bx, by, p): densities of a 2-D histogram over its whole grid, with a floor, summing to 1."""
    spark = counts.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).alias("bx"), F.floor(F.col("id") / nx).alias("by"))
    full = grid.join(counts, ["bx", "by"], "left").select("bx", "by", F.coalesce("n", F.lit(0)).alias("n"))
    total = full.agg(F.sum("n").alias("t"))
    scale = 1 + nx * ny * floor
    share = F.when(F.col("t") > 0, F.col("n") / F.col("t")).otherwise(F.lit(0.0))
    return full.crossJoin(F.broadcast(total)).select("bx", "by", ((share + floor) / scale).alias("p"))


def symmetric_grid_kl(p: DataFrame, q: DataFrame, base: float = math.e) -> DataFrame:
    """One row, kl: both divergences of two densities over the same grid, added."""
    both = p.withColumnRenamed("p", "a").join(q.withColumnRenamed("p", "b"), ["bx", "by"])
    return both.agg((F.sum((F.col("a") - F.col("b")) * F.log(F.col("a") / F.col("b"))) / math.log(base)).alias("kl"))


def torsion_divergence(a: DataFrame, b: DataFrame, bins: int = 36, units: str = "radians", base: float = math.e) -> DataFrame:
    """One row, kl, of two tables of (phi, psi): ``units`` says what the bins of a whole turn span."""
    turn = 2 * math.pi if units == "radians" else 360.0
    cell = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) + turn / 2) / (turn / bins)))).cast("bigint")
    density = lambda t: floored_density(histogram_2d(t, cell("phi"), cell("psi")), bins, bins)
    return symmetric_grid_kl(density(a), density(b), base)


def clipped_counts_divergence(a: DataFrame, b: DataFrame, x: str, y: str, most: int) -> DataFrame:
    """One row, kl in bits, of two tables of element counts, clipped to the last bin."""
    cell = lambda c: F.least(F.lit(most - 1).cast("bigint"), F.col(c).cast("bigint"))
    density = lambda t: floored_density(histogram_2d(t, cell(x), cell(y)), most, most)
    return symmetric_grid_kl(density(a), density(b), 2)


def mean_by_position(rows: DataFrame, array: str) -> DataFrame:
    """(pos, mean, n): element-wise means of arrays of any lengths."""
    return rows.select(F.posexplode(array).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def best_score(scores: DataFrame, key: str, ref: str, score: str) -> DataFrame:
    """(key, score, ref): the best score and its reference, NaN left out, ties to the smaller reference."""
    good = scores.filter(F.col(score).isNotNull() & ~F.isnan(score))
    first = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), ref))
    return good.withColumn("__r", first).filter("__r = 1").select(key, score, ref)


def pass_summary(scores: DataFrame, score: str, cutoff: float) -> DataFrame:
    """One row: mean score and the share at or above the cutoff."""
    return scores.agg(F.avg(score).alias("mean"), F.avg((F.col(score) >= cutoff).cast("double")).alias("pass_rate"))


def perplexity(losses: DataFrame, loss: str, n: str) -> DataFrame:
    """One row: the token-weighted mean loss and its exponential."""
    mean = F.sum(F.col(loss) * F.col(n)) / F.sum(n)
    return losses.agg(mean.alias("loss"), F.exp(mean).alias("perplexity"))


def designability(designs: DataFrame, backbone: str, score: str, cutoff: float) -> DataFrame:
    """(backbone, n_designs, best, designable): a backbone's best design, null scores being failures."""
    best = F.max(score)
    return designs.groupBy(backbone).agg(F.count(F.lit(1)).alias("n_designs"), best.alias("best"), F.coalesce(best >= cutoff, F.lit(False)).alias("designable"))


def generation_metrics(designable: DataFrame, known: DataFrame, clusters: DataFrame, backbone: str, cutoff: float) -> DataFrame:
    """One row on a generated set: (n, designable, novel, both, n_clusters, diversity).

    ``known`` holds (backbone, score) against known chains, and a backbone without a score of at least ``cutoff`` is novel;
    ``clusters`` holds (backbone, cluster), and diversity is the number of clusters by that of backbones.
    """
    near = known.groupBy(backbone).agg(F.max("score").alias("nearest"))
    rows = designable.select(backbone, "designable").join(near, backbone, "left").join(clusters.select(backbone, "cluster"), backbone, "left")
    rows = rows.withColumn("novel", F.coalesce(F.col("nearest") < cutoff, F.lit(True)))
    share = lambda c: F.avg(c.cast("double"))
    n, groups = F.count(F.lit(1)), F.countDistinct("cluster")
    return rows.agg(n.alias("n"), share(F.col("designable")).alias("designable"), share(F.col("novel")).alias("novel"), share(F.col("designable") & F.col("novel")).alias("both"), groups.alias("n_clusters"), (groups / n).alias("diversity"))
