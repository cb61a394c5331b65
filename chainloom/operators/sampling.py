"""Examples for sequence models, by hash so that reruns agree: prefixes, noise, lengths, and chains from an n-gram model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.functions.angles import wrap
from chainloom.operators.splits import running_sum, unit_hash
from chainloom.storage import settle


def normal_hash(key: Column, seed: int) -> Column:
    """A standard normal number for a key, from two uniform ones (Box and Muller)."""
    u = F.greatest(unit_hash(key, seed), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * unit_hash(key, seed + 1))


def prefix_examples(rows: DataFrame, chain: str, pos: str, value: str, seed: int) -> DataFrame:
    """(chain, cut, target): for each chain of two values or more, a random prefix length and the value behind it."""
    sizes = rows.groupBy(chain).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cuts = sizes.select(chain, (1 + F.floor(unit_hash(F.col(chain), seed) * (F.col("n") - 1))).cast("long").alias("cut"))
    return rows.join(cuts, chain).filter(F.col(pos) == F.col("cut")).select(chain, "cut", F.col(value).alias("target"))


def noised(rows: DataFrame, chain: str, pos: str, value: str, alphas: DataFrame, seed: int) -> DataFrame:
    """(chain, pos, t, noise, noised): each chain at a random step of a schedule (t, alpha_bar), its angles mixed with
    normal noise and wrapped."""
    steps = alphas.agg(F.count(F.lit(1))).first()[0]
    timed = rows.select(chain, pos, value, F.floor(unit_hash(F.col(chain), seed) * steps).cast("long").alias("t"))
    mixed = timed.join(alphas.select("t", "alpha_bar"), "t")
    noise = normal_hash(F.concat_ws(":", F.col(chain).cast("string"), F.col(pos).cast("string")), seed + 7)
    mixed = mixed.withColumn("noise", noise)
    out = wrap(F.sqrt("alpha_bar") * F.col(value) + F.sqrt(1 - F.col("alpha_bar")) * F.col("noise"))
    return mixed.select(chain, pos, "t", "noise", out.alias("noised"))


def sampled_lengths(sizes: DataFrame, length: str, n: int, seed: int) -> DataFrame:
    """(draw, length): ``n`` lengths drawn with replacement from those observed, by their cumulative counts."""
    counts = sizes.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("c"))
    ranges = running_sum(counts, "length", "c", "lo").withColumn("hi", F.col("lo") + F.col("c"))
    total = sizes.count()
    # Draws meet ranges by cell: a range lies in few of them unless it is long, and all ranges together in 4096 more than there are.
    width = max(1, total // 4096)
    cells = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    ranges = ranges.select("length", "lo", "hi", cells.alias("cell"))
    draws = sizes.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(unit_hash(F.col("id"), seed) * total).alias("at"))
    draws = draws.withColumn("cell", F.floor(F.col("at") / width))
    return draws.join(ranges, "cell").filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("draw", "length")


def next_token_model(tokens: DataFrame) -> DataFrame:
    """(state, token, lo, hi): for each token, and for the start (null), the shares of what comes next (null: the end)."""
    by = W.partitionBy("chain").orderBy("pos")
    inner = tokens.select(F.col("token").alias("state"), F.lead("token").over(by).alias("token"))
    first = tokens.filter("pos = 0").select(F.lit(None).cast("string").alias("state"), "token")
    counts = inner.unionByName(first).groupBy("state", "token").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy("state").orderBy(F.col("token").asc_nulls_last())
    upto = F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("c").over(W.partitionBy("state"))
    return counts.select("state", "token", ((upto - F.col("c")) / total).alias("lo"), (upto / total).alias("hi"))


def sample_chains(model: DataFrame, n: int, longest: int, seed: int) -> DataFrame:
    """(chain, pos, token): ``n`` chains drawn from a next-token model, all of them one step at a time."""
    spark = model.sparkSession
    model = settle(model.withColumn("start", F.col("state").isNull()))
    live = spark.range(n).select(F.col("id").alias("chain"), F.lit(None).cast("string").alias("state"))
    out = None
    for pos in range(longest):
        drawn = live.withColumn("u", unit_hash(F.concat_ws(":", F.col("chain").cast("string"), F.lit(pos)), seed)).alias("a")
        step = drawn.join(model.alias("m"), F.expr("a.state <=> m.state AND u >= lo AND u < hi")).select("chain", F.lit(pos).cast("long").alias("pos"), "token")
        step = settle(step.filter("token IS NOT NULL"))
        out = step if out is None else out.unionByName(step)
        live = step.select("chain", F.col("token").alias("state"))
        if step.isEmpty():
            break
    return out


def slot_ranges(k: int, bins: tuple[int, int, int]) -> list[tuple[int, int]]:
    """The ids allowed at places 0 to 3 modulo 4 of a sequence: motifs, then the glue of each feature.

    >>> slot_ranges(10, (4, 5, 6))
    [(0, 10), (10, 14), (14, 19), (19, 25)]
    """
    ends = [k, k + bins[0], k + bins[0] + bins[1], k + sum(bins)]
    return list(zip([0, *ends], ends, strict=False))


def grammatical(sequence: DataFrame, k: int, bins: tuple[int, int, int]) -> DataFrame:
    """(chain, ok): whether every id lies in its slot's range and the sequence ends with a motif."""
    fits = F.lit(False)
    for slot, (lo, hi) in enumerate(slot_ranges(k, bins)):
        fits = fits | ((F.col("ord") % 4 == slot) & (F.col("id") >= lo) & (F.col("id") < hi))
    return sequence.groupBy("chain").agg((F.bool_and(fits) & (F.max("ord") % 4 == 0)).alias("ok"))
