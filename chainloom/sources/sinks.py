"""Writing structures and sequences as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_sequence(seq: Column, width: int = 80) -> Column:
    """A sequence in lines of ``width``."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: F.substring(seq, i, F.lit(width))), "\n")


def fasta_lines(rows: DataFrame, name: str = "name", seq: str = "seq", width: int = 80) -> DataFrame:
    """One text value for each record."""
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrap_sequence(F.col(seq), width)).alias("value"))


def backbone_lines(points: DataFrame, chain: str = "chain", pos: str = "pos") -> DataFrame:
    """(chain, pos, value): structure lines of backbone points, three to a residue, all of them glycines of chain A."""
    k = F.col(pos)
    atom = F.element_at(F.array(F.lit(" N  "), F.lit(" CA "), F.lit(" C  ")), (k % 3 + 1).cast("int"))
    element = F.element_at(F.array(F.lit("N"), F.lit("C"), F.lit("C")), (k % 3 + 1).cast("int"))
    line = F.format_string("ATOM  %5d %s GLY A%4d    %8.3f%8.3f%8.3f  1.00  5.00          %2s", k + 1, atom, F.floor(k / 3) + 1, "x", "y", "z", element)
    bad = F.isnan("x") | F.isnan("y") | F.isnan("z")
    return points.filter(~bad).select(F.col(chain).alias("chain"), k.alias("pos"), line.alias("value"))


def write_by_chain(lines: DataFrame, path: str) -> None:
    """A folder of text for each chain, lines in order."""
    lines.repartition("chain").sortWithinPartitions("chain", "pos").select("chain", "value").write.partitionBy("chain").text(path)
