"""Scores of spans and of neighbouring spans by networks whose weights are given; all in array expressions.

Spans are half-open and at most ``most`` long, so their number grows with the rows times ``most``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Layer = tuple[list[list[float]], list[float]]


def spans(rows: DataFrame, chain: str, pos: str, value: str, most: int) -> DataFrame:
    """(chain, lo, hi, items): every span with its values; ``pos`` counts from 0 without gaps, values are not null."""
    ahead = F.collect_list(value).over(W.partitionBy(chain).orderBy(pos).rowsBetween(0, most - 1))
    held = rows.select(F.col(chain).alias("chain"), F.col(pos).alias("lo"), ahead.alias("ahead"))
    held = held.select("chain", "lo", "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("width"))
    return held.select("chain", "lo", (F.col("lo") + F.col("width")).alias("hi"), F.expr("slice(ahead, 1, width)").alias("items"))


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def attention_pool(items: Column, slope: float) -> Column:
    """The mean of the items weighted by the softmax of slope * item."""
    top = F.array_max(F.transform(items, lambda x: x * slope))
    weights = F.transform(items, lambda x: F.exp(x * slope - top))
    return total(F.zip_with(items, weights, lambda x, w: x * w)) / total(weights)


def span_features(items: Column, slope: float) -> Column:
    """Pooled value, mean, population variance and length / 500."""
    n = F.size(items)
    mean = total(items) / n
    return F.array(attention_pool(items, slope), mean, total(F.transform(items, lambda x: (x - mean) * (x - mean))) / n, n / 500)


def linear(vector: Column, layer: Layer) -> Column:
    """Weights, one row for each output, times a vector, plus biases."""
    rows = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(*layer, strict=True)])
    return F.transform(rows, lambda r: r["b"] + total(F.zip_with(vector, r["w"], lambda x, w: x * w)))


def network(vector: Column, layers: list[Layer]) -> Column:
    """Linear layers with rectified outputs between them; the last one's outputs."""
    for k, layer in enumerate(layers):
        vector = linear(F.transform(vector, lambda x: F.greatest(x, F.lit(0.0))) if k else vector, layer)
    return vector


def score_spans(table: DataFrame, slope: float, layers: list[Layer], gamma: float) -> DataFrame:
    """(chain, lo, hi, score): the first output of a network on each span's features, less ``gamma``."""
    held = table.select("chain", "lo", "hi", span_features(F.col("items"), slope).alias("f"))
    return held.select("chain", "lo", "hi", (F.get(network(F.col("f"), layers), F.lit(0)) - gamma).alias("score"))


def score_neighbours(table: DataFrame, slope: float, layers: list[Layer]) -> DataFrame:
    """(chain, lo, mid, hi, score): a network on the features of a span and of the span that begins where it ends."""
    held = table.select("chain", "lo", "hi", span_features(F.col("items"), slope).alias("f"))
    right = held.select("chain", F.col("lo").alias("mid"), "hi", F.col("f").alias("g"))
    pairs = held.withColumnRenamed("hi", "mid").join(right, ["chain", "mid"])
    return pairs.select("chain", "lo", "mid", "hi", F.get(network(F.concat("f", "g"), layers), F.lit(0)).alias("score"))


def span_lists(rows: DataFrame, chain: str, pos: str, value: str, most: int, slope: float) -> DataFrame:
    """(chain, lo, f, g): in a row for each place, the features of the spans that begin there by length, and for each of them
    those of the spans behind it by length; null beyond the chain's end, and in rows of no chain. As :func:`spans`, ``pos``
    counts from 0 without gaps and values are not null. The rows are dealt by chain once; spans and pairs get no rows."""
    order = W.partitionBy("chain").orderBy("lo")
    held = rows.select(F.col(chain).alias("chain"), F.col(pos).alias("lo"), F.col(value).alias("v"))
    held = held.select("chain", "lo", F.collect_list("v").over(order.rowsBetween(0, most - 1)).alias("ahead"))
    items = F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda n: F.slice("ahead", F.lit(1), n))
    held = held.select("chain", "lo", F.transform(items, lambda x: span_features(x, slope)).alias("f"))
    behind = F.array(*[F.lead("f", k).over(order) for k in range(1, most + 1)])
    return held.select("chain", "lo", "f", F.when(F.col("chain").isNotNull(), behind).alias("g"))


def score_lists(lists: DataFrame, layers: list[Layer], gamma: float, neighbours: list[Layer]) -> DataFrame:
    """(chain, lo, scores, edges): :func:`score_spans` and :func:`score_neighbours` of :func:`span_lists`, a row for each
    place: the scores of the spans that begin there by length, and for each of them those of the pairs with it by length."""
    scores = F.transform("f", lambda f: F.get(network(f, layers), F.lit(0)) - gamma)
    return lists.select("chain", "lo", scores.alias("scores"), neighbour_scores(neighbours).alias("edges"))


def neighbour_scores(layers: list[Layer]) -> Column:
    """For each span of a row of :func:`span_lists` the first outputs of a network on it and each span behind it."""
    return F.transform("f", lambda f, a: F.transform(F.get("g", a), lambda g: F.get(network(F.concat(f, g), layers), F.lit(0))))


def neighbour_rows(lists: DataFrame, layers: list[Layer]) -> DataFrame:
    """(chain, lo, mid, hi, score): :func:`score_neighbours` of :func:`span_lists`, without a join."""
    held = lists.select("chain", "lo", F.posexplode(neighbour_scores(layers)).alias("a", "scores"))
    held = held.select("chain", "lo", (F.col("lo") + F.col("a") + 1).alias("mid"), F.posexplode("scores").alias("b", "score"))
    return held.select("chain", "lo", "mid", (F.col("mid") + F.col("b") + 1).alias("hi"), "score")


def interleave(columns: list[Column]) -> Column:
    """Arrays of one length read across: first items of all, then second items of all."""
    return F.flatten(F.transform(F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(columns)]), lambda x: F.array(*[x[f"c{k}"] for k in range(len(columns))])))


def span_shapes(rows: DataFrame, chain: str, pos: str, values: list[str], most: int, order: int = 8, block: int = 256) -> DataFrame:
    """(chain, lo, hi, descriptor, radius, means, variances) of every span of up to ``most`` points: its Zernike descriptors
    and radius of gyration from running sums of moments, and of each value column the mean and population variance from
    running sums as well. ``rows`` has x, y, z; positions count from 0 without gaps, nothing is null.

    A chain is dealt by blocks of starts, each with the ``most`` - 1 points that follow it; sums begin anew at each block,
    about its first point, so they stay small however far a chain goes. Equal points have the descriptors of one."""
    from collections.abc import Iterator

    if block < most:
        raise ValueError("a block must hold the longest span")
    kind = rows.schema[chain].dataType.simpleString()
    at = F.floor(F.col(pos) / block).cast("long")
    own = rows.select(F.col(chain).alias("chain"), F.col(pos).cast("long").alias("pos"), F.array("x", "y", "z", *[F.col(v).cast("double") for v in values]).alias("p"))
    places = F.when((F.col("pos") % block < most - 1) & (F.col("pos") >= block), F.array(at, at - 1)).otherwise(F.array(at))
    each = own.select("chain", F.explode(places).alias("at"), "pos", "p").groupBy("chain", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("all"))
    each = each.select("chain", "at", F.transform("all", lambda x: x["p"]).alias("p"))

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from chainloom.functions.moments import descriptors, powers

        for batch in batches:
            held: list[tuple] = []  # of many chains: row, lo, hi, moments, means, variances

            def hand_on(batch=batch, held=held):
                row, lo, hi, moments, means, variances = (np.concatenate(v) for v in zip(*held, strict=True))
                d, radius = descriptors(moments, order)
                lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (d, means, variances)]
                held.clear()
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(lo), pa.array(hi), lists[0], pa.array(radius), *lists[1:]], names=["chain", "lo", "hi", "descriptor", "radius", "means", "variances"])

            for i, (first, points) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                x = np.array(points, float)
                n = min(block, len(x))
                moments = powers(x[:, :3] - x[0, :3], order)
                moments = np.concatenate([np.zeros_like(moments[:1]), np.cumsum(moments, 0)])
                shift = x[0, 3:]
                other = x[:, 3:] - shift
                sums, squares = (np.concatenate([np.zeros((1, other.shape[1])), np.cumsum(v, 0)]) for v in (other, other**2))
                for width in range(1, min(most, len(x)) + 1):
                    lo = np.arange(min(n, len(x) - width + 1))
                    mean = (sums[lo + width] - sums[lo]) / width
                    var = np.maximum(0, (squares[lo + width] - squares[lo]) / width - mean**2)
                    held.append((np.full(len(lo), i), first * block + lo, first * block + lo + width, moments[lo + width] - moments[lo], mean + shift, var))
                    if sum(len(h[0]) for h in held) > 2000:
                        yield hand_on()
            if held:
                yield hand_on()

    return each.mapInArrow(run, f"chain {kind}, lo bigint, hi bigint, descriptor array<double>, radius double, means array<double>, variances array<double>")


def score_shapes(table: DataFrame, layers: list[Layer], gamma: float) -> DataFrame:
    """(chain, lo, hi, score): a network on all features of ``span_shapes``: descriptors, radius, means, variances, length
    / 500 and ln(length + 1e-6) / 6; less ``gamma``."""
    n = F.col("hi") - F.col("lo")
    vector = F.concat("descriptor", F.array("radius"), "means", "variances", F.array(n / 500, F.log(n + 1e-6) / 6))
    held = table.select("chain", "lo", "hi", vector.alias("f"))
    return held.select("chain", "lo", "hi", (F.get(network(F.col("f"), layers), F.lit(0)) - gamma).alias("score"))
