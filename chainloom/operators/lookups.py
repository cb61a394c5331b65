"""Joins by name and key: stems, prefixes, masked lookups, label maps, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def stem(path: Column) -> Column:
    """A file's name without directories and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def stem_join(a: DataFrame, path_a: str, b: DataFrame, path_b: str) -> DataFrame:
    """Rows whose file stems are equal."""
    return a.withColumn("stem", stem(F.col(path_a))).join(b.withColumn("stem", stem(F.col(path_b))), "stem")


def prefix_join(a: DataFrame, key: str, b: DataFrame, name: str, separators: str = "-_") -> DataFrame:
    """Rows of ``b`` whose name is the key, or begins with it and a separator: each name is cut at its separators and
    joined on equality, so the join is no theta join."""
    cuts = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.when(F.lit(separators).contains(F.substring(F.col(name), i, F.lit(1))), F.substring(F.col(name), F.lit(1), i - 1))),
        lambda x: x.isNotNull() & (x != ""),
    )
    keys = F.array_distinct(F.concat(cuts, F.array(F.col(name))))
    return a.join(b.withColumn("__p", F.explode(keys)), F.col(key) == F.col("__p")).drop("__p")


def first_match(rows: DataFrame, table: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left join on several columns where the first matching table row wins; no match leaves nulls."""
    first = table.withColumn("__n", F.row_number().over(W.partitionBy(*on).orderBy(*order))).filter("__n = 1").drop("__n")
    return rows.join(first, on, "left")


def top_matches(pairs: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """At most so many candidates for each key: the operator's own cap, in a given order."""
    by = W.partitionBy(key).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def leakage(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """Test rows whose key occurs in training."""
    return test.join(train.select(*on).distinct(), on, "left_semi")


def dense_labels(rows: DataFrame, label: str, keep: list | None = None, out: str = "dense") -> DataFrame:
    """Rows of the labels to keep, with labels renumbered from 0 in their order; only the few labels are ranked."""
    if keep is not None:
        rows = rows.filter(F.col(label).isin(keep))
    names = rows.select(label).distinct().withColumn(out, F.row_number().over(W.orderBy(label)) - 1)
    return rows.join(names, label)


def in_ranges(rows: DataFrame, pos: str, ranges: list[str]) -> DataFrame:
    """Rows in any of the ranges "a-b", both ends inside; an empty range is everything."""
    test = F.lit(False)
    for r in ranges:
        if not r:
            return rows
        lo, _, hi = r.partition("-")
        test = test | F.col(pos).between(int(lo), int(hi or lo))
    return rows.filter(test)


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_anti")


def union_distinct(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).union(b.select(*on)).distinct()


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    """One table from several splits, with a column ``split``."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
