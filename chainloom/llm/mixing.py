"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target number of words and a weight schedule over training time t in [0, 1]. The integral of
the schedule, scaled to the target, is the source's cumulative demand D(t). The source's documents stand in a
stream in the order of a hash, once for each pass over the source; a document that begins at word c of that
stream is trained on at the time t with D(t) = c, found by inverting D in closed form. Documents are then sorted by
that position, over ranges of positions, so that every source's share of each stretch of training follows its schedule.

A source may hold a third of all rows: its stream is therefore dealt into hash buckets. Sums of buckets come from a
map-side aggregate, their prefix sums run over the few buckets of a source, and only inside a bucket are rows
ordered one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.llm.common import SPACE, count_words, free_name, row_hash, settle, text_of
from chainloom.operators.splits import running_sum

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2.0
#: How the weight of the sources changes from the start to the end of training, by rank and repeating: a slope of
#: 0.5 means 0.5 to 1.5 times the mean weight; always over -1 and under 1.
SLOPES = (0.0, 0.5, -0.5)
#: Hash buckets of a source's stream. A bucket of the largest source is what one task orders.
BUCKETS = 1024


def _source_plan(sized: DataFrame, weights, slopes, share: float, most: float) -> DataFrame:
    """One row for each source: size, target, slope. Resharing looks at one row for each source, never at documents, and takes
    the same few jobs however many sources fill up: ranks and sums over sources run over ranges of them."""
    plan = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Rank by code point, null last; ties are impossible as a source has one row.
    at = F.struct(F.col("source").isNull().alias("none"), F.encode(F.col("source").cast("string"), "UTF-8").alias("bytes"))
    plan = running_sum(plan.select("source", "source_size", at.alias("at"), F.lit(1).alias("one")), "at", "one", "rank")
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.col("rank") % len(xs) + 1).cast("int"))
    plan = settle(plan.select("source", "source_size", pick(weights).alias("weight"), pick(slopes).alias("slope")))
    all_size, all_weight = plan.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = share * float(all_size or 0), float(all_weight or 0)
    # Water filling: sources fill up in the order of size / weight. At the level at which a source is just full, the fuller ones
    # hold their most and the others this level times their weight; the source is full if that is less than there is.
    level = plan.filter("weight > 0").groupBy((F.lit(most) * F.col("source_size") / F.col("weight")).alias("level")).agg(F.sum("source_size").alias("own_size"), F.sum("weight").alias("own_weight"))
    level = running_sum(running_sum(level, "level", "own_size", "size_before"), "level", "own_weight", "weight_before")
    held = F.lit(most) * (F.col("size_before") + F.col("own_size")) + F.col("level") * (F.lit(all_weight) - F.col("weight_before") - F.col("own_weight"))
    full = level.filter(held < total).agg(F.sum("own_size"), F.sum("own_weight")).first()
    full_size, rest = float(full[0] or 0), all_weight - float(full[1] or 0)
    unit = (total - most * full_size) / rest if rest > 1e-12 else math.inf
    return plan.withColumn("target", F.when(F.col("weight") > 0, F.least(F.col("weight") * F.lit(unit), F.lit(most) * F.col("source_size"))).otherwise(0.0))


def demand_time(done: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] at which the cumulative demand of a source reaches ``done`` words.

    With the weight w(t) = 1 + slope * (2 t - 1), demand is D(t) = target * (slope * t**2 + (1 - slope) * t).
    """
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(done, target), F.lit(0.0))))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part)
    return F.when(F.abs(slope) < 1e-9, part).otherwise((root - (1 - slope)) / (2 * slope))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
    seed: int = 7,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document, sorted by first position: ``id_col``, size, ``source_col``, source_size, target, taken,
    passes array<struct<pass int, words long, position double>>, position (the first pass's).

    A source's documents are taken in hash order until its target is met; a second pass follows only if the target
    exceeds the source. The document at the border counts with its first words alone, so a source's taken words equal
    its target rounded down. The order depends on the id and text only, so reruns agree.

    Edge cases: null or empty texts have size 0, are never taken and have no passes and a null position. A null source
    is a source of its own and comes last. Rows that repeat (same id and text) are separate documents; which of them
    the border cuts makes no difference to the result as a set. If all sizes are 0, all targets are 0. Null ids are
    ordered by their text. Other columns are not read.
    """
    placed = place(docs, id_col, text_col, source_col, _order(id_col, text_col, seed), F.lit(0), weights, slopes, share, max_repeats, buckets)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.alias("taken"),
        "passes", F.get("passes", F.lit(0))["position"].alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), id_col)


def _order(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(text_col))


def place(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, order: Column, tie: Column, weights, slopes, share: float, max_repeats: float, buckets: int
) -> DataFrame:
    """Rows (id, order, tie, size, source, source_size, target, passes), one for each document. A source's stream is
    ordered by ``order``, then ``tie``, id and size."""
    if not all(-1 < s < 1 for s in slopes):
        raise ValueError("slopes must lie between -1 and 1")
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        count_words(text_of(text_col)).alias("size"),
        order.alias("order"),
        tie.alias("tie"),
    ).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sized = settle(sized)
    plan = settle(_source_plan(sized, weights, slopes, share, max_repeats))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sums, plan = sums.alias("b"), plan.alias("p")
    offsets = sums.join(plan, F.expr("b.source <=> p.source")).select(
        F.col("b.source").alias("o_source"), F.col("bucket").alias("o_bucket"), "base", "source_size", "target", "slope"
    )
    inner = W.partitionBy("source", "bucket").orderBy("order", "tie", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(offsets, F.expr("source <=> o_source AND bucket = o_bucket"))
        .withColumn("start", F.col("base") + F.col("within"))
    )
    met = F.floor("target").cast("long")

    def one(p: int) -> Column:
        begin = F.lit(p) * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), met - begin))
        return F.struct(F.lit(p).alias("pass"), words.alias("words"), demand_time(begin, F.col("target"), F.col("slope")).alias("position"))

    passes = F.filter(F.array(*[one(p) for p in range(math.ceil(max_repeats))]), lambda x: x["words"] > 0)
    return placed.select("id", "order", "tie", "size", "source", "source_size", "target", passes.alias("passes"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    slopes: Sequence[float] = SLOPES, share: float = SHARE, max_repeats: float = MAX_REPEATS, seed: int = 7, buckets: int = BUCKETS,
) -> DataFrame:
    """The mix itself: the rows and columns of ``docs``, once for each pass that takes them, in ranges sorted by position.

    A document that is taken in part keeps its first words with their white space; documents not taken are left out.
    Rows are told apart by all their columns, so every row is taken as its own source's plan says. Rows equal in every
    column appear as often as their passes say together. Otherwise the edge cases are those of :func:`mix`; columns may
    have any name, an empty table gives no rows.
    """
    # The order is that of mix; a hash of the whole row beside it makes the key that finds the row again.
    order, tie, size, passes, one, position, o, t = (free_name(docs, x) for x in ("__order", "__tie", "__size", "__passes", "__pass", "__position", "__o", "__t"))
    keyed = docs.select("*", _order(id_col, text_col, seed).alias(order), row_hash(docs, seed).alias(tie))
    placed = place(keyed, id_col, text_col, source_col, F.col(order), F.col(tie), weights, slopes, share, max_repeats, buckets)
    placed = settle(placed.select("order", "tie", "size", "passes"))
    if not placed.groupBy("order", "tie").count().filter("count > 1").isEmpty():  # equal rows: one of them stands for all
        keyed = keyed.dropDuplicates([order, tie])
    used = placed.filter(F.size("passes") > 0).select(F.col("order").alias(o), F.col("tie").alias(t), F.col("size").alias(size), F.col("passes").alias(passes))
    joined = keyed.join(used, (F.col(order) == F.col(o)) & (F.col(tie) == F.col(t)))
    rows = joined.withColumn(one, F.explode(passes))
    # A cut behind every word keeps the white space before it.
    words = F.split(F.col(text_col), f"(?<=[^{SPACE}])(?=[{SPACE}])", -1)
    part = F.array_join(F.slice(words, F.lit(1), F.col(one)["words"].cast("int")), "")
    text = F.when(F.col(one)["words"] < F.col(size), part).otherwise(F.col(text_col))
    rows = rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(one)["position"].alias(position))
    return rows.repartitionByRange(position).sortWithinPartitions(position).drop(position)
