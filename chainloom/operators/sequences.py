"""Ordered scans over chains: prefix sums, schedules, patience, padding, labels of spans, consecutive values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def prefix_sums(rows: DataFrame, chain: str, pos: str, value: str) -> DataFrame:
    by = W.partitionBy(chain).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(chain, pos, F.sum(value).over(by).alias("total"))


def span_means(prefix: DataFrame, spans: DataFrame, chain: str, pos: str) -> DataFrame:
    """(chain, lo, hi, mean) of half-open spans from prefix sums: two joins by place, whatever the length of spans."""
    at = lambda name, shift: prefix.select(F.col(chain), (F.col(pos) + shift).alias(name), F.col("total").alias(f"t_{name}"))
    out = spans.join(at("hi", 1), [chain, "hi"]).join(at("lo", 1), [chain, "lo"], "left")
    mean = (F.col("t_hi") - F.coalesce("t_lo", F.lit(0.0))) / (F.col("hi") - F.col("lo"))
    return out.select(chain, "lo", "hi", mean.alias("mean"))


def glue(rows: DataFrame, chain: str, pos: str, value: str) -> DataFrame:
    """(chain, pos, before, here, after): three neighbouring values where all exist."""
    by = W.partitionBy(chain).orderBy(pos)
    out = rows.select(chain, pos, F.lag(value).over(by).alias("before"), F.col(value).alias("here"), F.lead(value).over(by).alias("after"))
    return out.filter("before IS NOT NULL AND after IS NOT NULL")


def beta_schedule(spark, kind: str, steps: int, first: float = 1e-4, last: float = 0.02, shift: float = 0.008) -> DataFrame:
    """(t, beta) of a noise schedule: linear, cosine, or the sigmoid one."""
    t = F.col("t").cast("double")
    if kind == "linear":
        beta = F.lit(first) + (last - first) * t / max(steps - 1, 1)
    elif kind == "sigmoid":
        beta = F.lit(first) + (last - first) / (1 + F.exp(-(F.lit(-6.0) + 12.0 * t / max(steps - 1, 1))))
    elif kind == "cosine":
        import math

        bar = lambda x: F.pow(F.cos((x / steps + shift) / (1 + shift) * (math.pi / 2)), F.lit(2))
        beta = F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), 1 - bar(t + 1) / bar(t)))
    else:
        raise ValueError(f"unknown schedule {kind}")
    return spark.range(steps).select(F.col("id").alias("t")).select("t", beta.alias("beta"))


def alpha_terms(betas: DataFrame) -> DataFrame:
    """(t, beta, alpha, alpha_bar, alpha_bar_before, posterior_variance); products as sums of logarithms."""
    upto = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    out = betas.withColumn("alpha", 1 - F.col("beta")).withColumn("alpha_bar", F.exp(F.sum(F.log("alpha")).over(upto)))
    out = out.withColumn("alpha_bar_before", F.lag("alpha_bar", 1, 1.0).over(W.orderBy("t")))
    return out.withColumn("posterior_variance", F.col("beta") * (1 - F.col("alpha_bar_before")) / (1 - F.col("alpha_bar")))


def patience_stop(losses: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """(run, stop, best): the first epoch after ``patience`` epochs without a new best, null if there is none."""
    by = W.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = losses.select(run, epoch, loss, (before.isNull() | (F.col(loss) < before)).cast("int").alias("better"))
    rows = rows.withColumn("since", F.sum("better").over(by.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("idle", F.row_number().over(W.partitionBy(run, "since").orderBy(epoch)) - 1)
    stop = F.min(F.when(F.col("idle") >= patience, F.col(epoch)))
    best = rows.groupBy(run).agg(stop.alias("stop")).alias("s")
    upto = rows.alias("r").join(best, run).filter(F.col("stop").isNull() | (F.col(epoch) <= F.col("stop")))
    return upto.groupBy(run).agg(F.min("stop").alias("stop"), F.min(loss).alias("best"))


def pad(values: Column, width: int, fill: float) -> Column:
    """An array cut or filled to a width."""
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(values))
    return F.concat(F.slice(values, 1, width), F.array_repeat(F.lit(fill), missing))


def pad_mask(values: Column, width: int) -> Column:
    """1 for what :func:`pad` kept and 0 for what it filled."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i < F.size(values), 1).otherwise(0))


def span_label(labels: DataFrame, spans: DataFrame, chain: str, pos: str, label: str) -> DataFrame:
    """(chain, lo, hi, label): the most frequent label inside each half-open span, ties to the smaller label."""
    inside = spans.withColumn(pos, F.explode(F.sequence("lo", F.col("hi") - 1))).join(labels.select(chain, pos, label), [chain, pos])
    counts = inside.groupBy(chain, "lo", "hi", label).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy(chain, "lo", "hi").orderBy(F.desc("n"), label))
    return counts.withColumn("r", first).filter("r = 1").select(chain, "lo", "hi", label)


def consecutive_pairs(rows: DataFrame, chain: str, pos: str, value: str) -> DataFrame:
    by = W.partitionBy(chain).orderBy(pos)
    return rows.select(F.col(value).alias("x"), F.lead(value).over(by).alias("y")).filter("y IS NOT NULL")
