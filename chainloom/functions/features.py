"""Columns for residues and records: names, parsers, identity, residue and segment features, pair descriptors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.functions.geometry import Vector, add, c_beta, cross, dot, norm, rotate, scale, sub, unit
from chainloom.sources.text import ALPHABET

#: Hydropathy of the amino acids by letter (fixed values, Kyte and Doolittle).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}


def code_and_chain(dataset_id: Column) -> tuple[Column, Column]:
    """Structure code and chain of an id such as 1abcA00, both in upper case."""
    return F.upper(F.substring(dataset_id, 1, 4)), F.upper(F.substring(dataset_id, 5, 1))


def parse_map(s: Column) -> Column:
    """"1-100:2-20" as a map of numbers."""
    pairs = F.transform(F.split(s, ":"), lambda x: F.struct(F.get(F.split(x, "-"), F.lit(0)).cast("int"), F.get(F.split(x, "-"), F.lit(1)).cast("int")))
    return F.map_from_entries(pairs)


def identity_percent(a: Column, b: Column) -> Column:
    """Equal letters at equal places, by the shorter length."""
    n = F.least(F.length(a), F.length(b))
    hits = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0))
    return F.when(n > 0, 100.0 * hits / n).otherwise(F.lit(0.0))


def residue_features(letter: Column) -> Column:
    """One-hot of the 20 letters, then hydropathy; zeros for an unknown letter."""
    table = F.create_map(*[F.lit(x) for kv in HYDROPATHY.items() for x in kv])
    one_hot = [F.when(letter == a, 1.0).otherwise(0.0) for a in ALPHABET]
    return F.array(*one_hot, F.coalesce(F.try_element_at(table, letter), F.lit(0.0)))


def segment_features(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, variance, length, log_length) of each segment: population variance, L / 500, ln(L + 1e-6) / 6."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), (n / 500).alias("length"), (F.log(n + 1e-6) / 6).alias("log_length"))


def geometry_key(bins: list[Column]) -> Column:
    """A key of a geometry that groups and orders alike everywhere: its bins as text of fixed width."""
    return F.concat_ws("-", *[F.lpad(b.cast("string"), 4, "0") for b in bins])


def virtual_centre(n: Vector, ca: Vector, c: Vector, first: float = 270.0, second: float = 0.0, reach: float = 2.0) -> Vector:
    """A point beside the CB: the CA-CB vector stretched and turned about two axes (angles in degrees)."""
    cb = c_beta(n, ca, c)
    v = scale(sub(cb, ca), reach)
    axis = cross(sub(cb, ca), sub(n, ca))
    v = rotate(v, axis, F.lit(math.radians(first)))
    return add(ca, rotate(v, sub(n, ca), F.lit(math.radians(second))))


def partner_descriptors(residues: DataFrame, chain: str = "chain_id", pos: str = "r") -> DataFrame:
    """(chain, i, j, d1..d10) from CA rows (chain, r, x, y, z) and partners j: seven cosines between the steps around both
    places and the line between them, the distance, and the separation, clamped and logarithmic."""
    by = W.partitionBy(chain).orderBy(pos)
    at = lambda s: tuple((F.lag(c, s) if s > 0 else F.lead(c, -s)).over(by) for c in "xyz")
    here = tuple(F.col(c) for c in "xyz")
    u1, u2 = sub(here, at(1)), sub(at(-1), here)
    name = lambda v, p: [x.alias(f"{p}{c}") for x, c in zip(v, "xyz", strict=True)]
    steps = residues.select(chain, F.col(pos).alias("i"), F.col("j"), *name(here, "p"), *name(unit(u1), "u"), *name(unit(u2), "w"))
    get = lambda p, side: tuple(F.col(f"{side}.{p}{c}") for c in "xyz")
    a, b = steps.alias("a"), steps.alias("b")
    both = a.join(b, (F.col(f"a.{chain}") == F.col(f"b.{chain}")) & (F.col("a.j") == F.col("b.i")))
    line = sub(get("p", "b"), get("p", "a"))
    far, e = norm(line), unit(line)
    ua, wa, ub, wb = get("u", "a"), get("w", "a"), get("u", "b"), get("w", "b")
    cosines = [dot(ua, wa), dot(ub, wb), dot(ua, e), dot(wa, e), dot(ub, e), dot(wb, e), dot(ua, ub)]
    gap = F.col("a.i") - F.col("a.j")
    clamped = F.greatest(F.lit(-4), F.least(F.lit(4), gap)).cast("double")
    values = [*cosines, far, clamped, F.signum(gap.cast("double")) * F.log(F.abs(gap) + 1)]
    return both.select(F.col(f"a.{chain}").alias(chain), F.col("a.i").alias("i"), F.col("a.j").alias("j"), *[v.alias(f"d{k + 1}") for k, v in enumerate(values)])
