"""Which chains stay: gates by length, missing values, agreement of two readers, and skip lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_length(rows: DataFrame, n: str, least: int = 40, most: int | None = None) -> DataFrame:
    kept = rows.filter(F.col(n) >= least)
    return kept if most is None else kept.filter(F.col(n) <= most)


def without_gaps(dihedrals: DataFrame, chain: str, value: str, sizes: DataFrame, n: str) -> DataFrame:
    """Chains of ``sizes`` that miss at most one value; NaN counts as missing."""
    have = dihedrals.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(chain).agg(F.count(F.lit(1)).alias("__have"))
    return sizes.join(have, chain).filter(F.col("__have") >= F.col(n) - 1).drop("__have")


def readers_agree(a: DataFrame, b: DataFrame, chain: str, n: str) -> DataFrame:
    """Chains to which both readers give the same number of residues."""
    return a.join(b.select(F.col(chain), F.col(n).alias("__n")), chain).filter(F.col(n) == F.col("__n")).drop("__n")


def without_positions(rows: DataFrame, pos: str, skipped: list[int]) -> DataFrame:
    """Rows but for those at listed positions."""
    return rows.filter(~F.col(pos).isin(skipped)) if skipped else rows


def partial_domains(rows: DataFrame, lo: str, hi: str, n: str, most: int) -> DataFrame:
    """Domains that don't span their whole chain and aren't too long."""
    return rows.filter(((F.col(lo) > 1) | (F.col(hi) < F.col(n) - 1)) & (F.col(hi) - F.col(lo) + 1 <= most))


def same_element(first: Column, last: Column) -> Column:
    """Whether both ends of a span lie in one element; -1 is none."""
    return (first == last) & (first != -1)


def within(value: str, lo: float | None = None, hi: float | None = None, slack: float = 1e-5) -> Column:
    """Aggregate: whether all values respect the bounds, give or take; NaN is left out."""
    v = F.when(~F.isnan(value), F.col(value))
    ok = F.lit(True)
    if lo is not None:
        ok = ok & F.coalesce(F.min(v) >= lo - slack, F.lit(True))
    if hi is not None:
        ok = ok & F.coalesce(F.max(v) <= hi + slack, F.lit(True))
    return ok


def atom_count_check(atoms: DataFrame) -> DataFrame:
    """(chain_id, n_residues, last): residues by number against the number of the last one in the file."""
    return atoms.groupBy("chain_id").agg(F.countDistinct("res_id").alias("n_residues"), F.max_by("res_id", "atom_id").alias("last"))


def quarantine(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with ``reason``): the first reason that holds."""
    reason = None
    for name, test in reasons.items():
        reason = F.when(test, F.lit(name)) if reason is None else reason.when(test, F.lit(name))
    marked = rows.withColumn("reason", reason if reason is not None else F.lit(None).cast("string"))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
