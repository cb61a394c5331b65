"""Seeded samples, splits and shards: by a hash of the key, so they need no sort of all rows and agree on reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.storage import settle


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5, which other engines can compute too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def hash_split(rows: DataFrame, key: str, parts: dict[str, float], seed: int) -> DataFrame:
    """Rows with ``split``, in proportion to ``parts``."""
    total, done = sum(parts.values()), 0.0
    u = unit_hash(F.col(key), seed)
    out = None
    for name, share in parts.items():
        done += share / total
        out = F.when(u < done, F.lit(name)) if out is None else out.when(u < done, F.lit(name))
    return rows.withColumn("split", out.otherwise(F.lit(list(parts)[-1])))


def nested_split(rows: DataFrame, outer: str, inner: str, key: str, outer_test: float, inner_test: float, seed: int) -> DataFrame:
    """Rows with ``split``: in each outer group a share of its inner groups is for the outer test, and in the others a
    share of the members for the inner test. Groups are ranked by hash; every row lands in one split."""
    groups = rows.select(outer, inner).distinct()
    by = W.partitionBy(outer).orderBy(unit_hash(F.col(inner), seed), inner)
    ranked = groups.withColumn("__r", F.row_number().over(by)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(outer)))
    ranked = ranked.withColumn("__out", F.col("__r") <= F.floor(F.col("__n") * outer_test)).select(outer, inner, "__out")
    split = F.when(F.col("__out"), F.lit("test_outer")).when(unit_hash(F.col(key), seed) < inner_test, F.lit("test_inner")).otherwise(F.lit("train"))
    return rows.join(ranked, [outer, inner]).withColumn("split", split).drop("__out")


def subsample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: the operator's own limit, as a top-k by hash."""
    return rows.orderBy(unit_hash(F.col(key), seed), key).limit(n)


def shards(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Rows with ``shard``: the i-th goes to i modulo n. Ranks run within ranges of ``order``, then add up."""
    return with_rank(rows, order).withColumn("shard", F.pmod("rank", F.lit(n))).drop("rank")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with ``chunk``: consecutive ones of ``size`` rows."""
    return with_rank(rows, order).withColumn("chunk", F.floor(F.col("rank") / size)).drop("rank")


def with_rank(rows: DataFrame, order: str, width: int = 4096) -> DataFrame:
    """Rows with their rank from 0 in the order of an integer key without nulls.

    Keys fall into cells; counts of cells are summed up, and only inside a cell rows are numbered: no task sees all rows.
    """
    cell = F.floor(F.col(order) / width)
    celled = rows.withColumn("__cell", cell)
    counts = celled.groupBy("__cell").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__super", F.floor(F.col("__cell") / width))
    supers = counts.groupBy("__super").agg(F.sum("__c").alias("__s"))
    before = W.orderBy("__super").rowsBetween(W.unboundedPreceding, -1)
    supers = supers.withColumn("__b", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inner = W.partitionBy("__super").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.join(supers, "__super").withColumn("__base", F.col("__b") + F.coalesce(F.sum("__c").over(inner), F.lit(0))).select("__cell", "__base")
    nth = F.row_number().over(W.partitionBy("__cell").orderBy(order)) - 1
    return celled.withColumn("__n", nth).join(bases, "__cell").withColumn("rank", F.col("__base") + F.col("__n")).drop("__cell", "__n", "__base")


def running_sum(rows: DataFrame, order: str, weight: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rows with ``out``: the sum of ``weight`` over the rows before them in ``order``, within ``by`` if given.

    Rows are dealt by ranges of the order, which need no single task even for one group; a range's sum comes first, and
    the sums of the ranges before it, one number for each range and group, are added to the sums inside it.
    """
    by = by or []
    placed = settle(rows.repartitionByRange(*by, order).withColumn("__cell", F.spark_partition_id()))
    sums = placed.groupBy(*by, "__cell").agg(F.sum(weight).alias("__s"))
    before = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("__base", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    bases = bases.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__cell").alias("__of"), "__base")
    met = F.col("__cell") == F.col("__of")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inner = W.partitionBy(*by, "__cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("__in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return inside.join(bases, met).select(*rows.columns, (F.col("__base") + F.col("__in")).alias(out))


def quantiles(rows: DataFrame, value: str, wanted: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles with linear interpolation, null for groups without values.

    Values are counted, their counts summed up over ranges; only the two values around each quantile are gathered.
    """
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = settle(running_sum(counts, "__v", "__n", "__lo", by))
    # A group's size is where its last value ends.
    sizes = ranked.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.max(F.col("__lo") + F.col("__n")).alias("__all"))
    met = F.lit(True)
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    rows_ = ranked.join(sizes, met) if by else ranked.crossJoin(F.broadcast(sizes))
    at = lambda q: F.lit(q) * (F.col("__all") - 1)
    held = lambda r: (F.col("__lo") <= r) & (r < F.col("__lo") + F.col("__n"))
    ends = [(F.max(F.when(held(F.floor(at(q))), F.col("__v"))), F.max(F.when(held(F.ceil(at(q))), F.col("__v")))) for q in wanted]
    part = [F.max(at(q) - F.floor(at(q))) for q in wanted]
    return rows_.groupBy(*by).agg(*[(a + (b - a) * t).alias(f"q{i}") for i, ((a, b), t) in enumerate(zip(ends, part, strict=True))])


def random_places(chains: DataFrame, length: str, pieces: str, rounds: int, seed: int, chain: str = "chain") -> DataFrame:
    """Rows with ``round`` and ``cuts``, a random partition into so many contiguous pieces by hashed cut points: 0, places
    in order, the length. Of the length - 1 places to cut, the pieces - 1 with the smallest hashes are taken; a row is one
    chain, and a chain without length has none."""
    n, k = F.col(length), F.col(pieces)
    rows = chains.filter(n > 0).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    places = F.when(n > 1, F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long") - 1), lambda p: F.struct(F.xxhash64(F.lit(seed), chain, "round", p).alias("h"), p.alias("p"))))
    chosen = F.slice(F.sort_array(F.coalesce(places, F.array().cast("array<struct<h:bigint,p:bigint>>"))), F.lit(1), F.greatest(F.least(k, n).cast("int") - 1, F.lit(0)))
    return rows.withColumn("cuts", F.sort_array(F.concat(F.array(F.lit(0).cast("long"), n.cast("long")), F.transform(chosen, lambda x: x["p"]))))


def longest_piece(cuts: Column) -> Column:
    """The length of the longest piece between cuts in order."""
    return F.array_max(F.zip_with(F.slice(cuts, 2, F.size(cuts) - 1), F.slice(cuts, 1, F.size(cuts) - 1), lambda hi, lo: hi - lo))


def random_cuts(chains: DataFrame, chain: str, length: str, pieces: str, rounds: int, seed: int) -> DataFrame:
    """(chain, round, lo, hi): the pieces of :func:`random_places`."""
    rows = random_places(chains.select(F.col(chain).alias("chain"), F.col(length).alias("n"), F.col(pieces).alias("k")), "n", "k", rounds, seed)
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("lo"), F.get("cuts", i + 1).alias("hi")))
    return rows.select("chain", "round", F.explode(spans).alias("s")).select("chain", "round", "s.lo", "s.hi")


def null_tail(observed: float | Column, null: Column, tail: str = "upper") -> Column:
    """Aggregate: (number of null values at least as extreme + 1) / (N + 1)."""
    hit = null >= observed if tail == "upper" else null <= observed
    return (F.sum(hit.cast("int")) + 1) / (F.count(F.lit(1)) + 1)
