"""Histograms, quantile edges, and quantisation of values into bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.angles import TWO_PI
from chainloom.operators.splits import quantiles


def clean(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null, NaN nor 0, which stands for a missing measurement."""
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) != 0))


def value_range(rows: DataFrame, value: str) -> tuple[float, float]:
    """Least and greatest value; one small row."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    return float(lo if lo is not None else 0), float(hi if hi is not None else 0)


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]


def quantile_edges(rows: DataFrame, value: str, bins: int) -> list[float]:
    """Edges that hold equally many values: exact quantiles with linear interpolation."""
    wanted = [i / bins for i in range(bins + 1)]
    return [float(x) for x in quantiles(rows.select(value), value, wanted).first()]


def bin_of(value: Column, edges: list[float], out_of_range: str = "error") -> Column:
    """The bin, from 0, of a value among contiguous half-open bins, the last one closed.

    The edges are a constant of the plan, so this is a projection, not a range join. Values outside raise an error,
    or go to the outer bin ("clamp"), or become null ("null").
    """
    last = len(edges) - 2
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    found = F.size(F.filter(inner, lambda e: value >= e)).cast("int") if last > 0 else F.lit(0)
    outside = (value < edges[0]) | (value > edges[-1])
    if out_of_range == "clamp":
        return F.when(value.isNotNull(), F.least(F.lit(last), found))
    if out_of_range == "null":
        return F.when(~outside, found)
    wrong = F.raise_error(F.concat(F.lit("out of range: "), value.cast("string")))
    return F.when(outside, wrong).otherwise(F.when(value.isNotNull(), found))


def bin_centre(number: Column, edges: list[float]) -> Column:
    centres = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)])
    return F.get(centres, number)


def snap(value: Column, edges: list[float]) -> Column:
    """The centre of a value's bin; the outer edge for values outside."""
    centre = bin_centre(bin_of(value, edges, "clamp"), edges)
    return F.when(value < edges[0], F.lit(edges[0])).when(value > edges[-1], F.lit(edges[-1])).otherwise(centre)


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, n) with empty bins; values outside are left out. Counting is partial before the shuffle."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    counts = rows.select(bin_of(F.col(value).cast("double"), edges, "null").alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def equal_width_histogram(rows: DataFrame, value: str, bins: int, circular: bool = False, cover: bool = False) -> DataFrame:
    """Bins from the least to the greatest value; ``circular`` values are first wrapped to [0, 2 pi), and ``cover``
    makes the bins span that whole range."""
    if circular:
        rows = rows.select(F.pmod(F.col(value).cast("double"), F.lit(TWO_PI)).alias(value))
    lo, hi = (0.0, TWO_PI) if cover else value_range(rows, value)
    return histogram(rows, value, equal_width_edges(lo, hi, bins))


def floor_lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Each row with the table row of the same or else the largest smaller key; null columns if there is none.

    The table is a configuration of a few sizes: its keys become a constant array, and an equality join follows.
    """
    keys = [float(r[0]) for r in table.select(F.col(table_key).cast("double")).distinct().orderBy(table_key).collect()]
    bounds = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<double>")
    found = rows.withColumn("__b", F.array_max(F.filter(bounds, lambda b: b <= F.col(key).cast("double"))))
    right = table.withColumn("__b", F.col(table_key).cast("double"))
    return found.join(right, "__b", "left").drop("__b")
