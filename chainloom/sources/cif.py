"""Atom rows of macromolecular CIF files: whole files in Arrow batches, one file at a time in memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_WORD = re.compile(r"'((?:[^']|'(?=\S))*)'|\"((?:[^\"]|\"(?=\S))*)\"|(\S+)")
ATOM_SITE = "path string, model int, label_chain string, auth_chain string, res string, res_id int, ins_code string, atom string, x double, y double, z double, b_factor double"


def loop_rows(text: str, category: str) -> Iterator[dict[str, str]]:
    """Rows of the loop of one category; ? and . are missing.

    >>> list(loop_rows("loop_\\n_a.x\\n_a.y\\n1 'two words'\\n3 ?\\n#", "_a"))
    [{'x': '1', 'y': 'two words'}, {'x': '3', 'y': ''}]
    """
    names: list[str] = []
    inside = False
    for line in text.splitlines():
        if line.startswith("loop_"):
            names, inside = [], False
        elif line.startswith(category + "."):
            names.append(line.split(".", 1)[1].split()[0])
            inside = True
        elif inside and line and line[0] not in "#_":
            values = ["".join(m) for m in _WORD.findall(line)] if "'" in line or '"' in line else line.split()
            if len(values) == len(names):
                yield {n: "" if v in ("?", ".") else v for n, v in zip(names, values, strict=True)}
        elif line.startswith("#") or line.startswith("_"):
            inside = False


def atom_sites(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Atoms of all chains in the files of some paths."""
    return file_atoms(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def file_atoms(files: DataFrame) -> DataFrame:
    """Atoms of all chains in whole texts (path, value); selenium of selenomethionine counts as the sulphur of methionine. A
    null text or one without atoms gives no rows."""

    import pyarrow as pa

    fields = [c.split() for c in ATOM_SITE.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def table(rows: list[tuple]):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k], from_pandas=True) for v, (_, k) in zip(columns, fields, strict=True)], names=[c for c, _ in fields])

    def run(batches) -> Iterator:
        rows = []
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a in loop_rows(text or "", "_atom_site"):
                    mse = a.get("label_comp_id") == "MSE"
                    atom = a.get("label_atom_id", "")
                    number = lambda k, a=a: float(a[k]) if a.get(k) else None
                    rows.append((
                        path, int(a.get("pdbx_PDB_model_num") or 1), a.get("label_asym_id"), a.get("auth_asym_id") or a.get("label_asym_id"),
                        "MET" if mse else a.get("label_comp_id"), int(a.get("auth_seq_id") or a.get("label_seq_id") or 0), a.get("pdbx_PDB_ins_code", ""),
                        "SD" if mse and atom == "SE" else atom, number("Cartn_x"), number("Cartn_y"), number("Cartn_z"), number("B_iso_or_equiv"),
                    ))
                    if len(rows) >= 8192:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)

    return files.select("path", "value").mapInArrow(run, ATOM_SITE)


def chain_names(sites: DataFrame) -> DataFrame:
    """(path, auth_chain, label_chain, changed): author names to label names; several labels for one author give rows each."""
    names = sites.filter("atom = 'CA'").select("path", "auth_chain", "label_chain").distinct()
    return names.withColumn("changed", F.col("auth_chain") != F.col("label_chain"))


def chains_of(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """Atoms of wanted (path, chain) pairs, by author name or else by label; a pair without atoms gives one row of nulls.

    Files are read once: a pair meets its file's atoms of either name, then keeps those of the author's if there are any."""
    rows = sites.select(*[F.col(c).alias(f"s_{c}") for c in sites.columns])
    author, label = F.col("chain") == F.col("s_auth_chain"), F.col("chain") == F.col("s_label_chain")
    met = wanted.select("path", "chain").join(rows, (F.col("path") == F.col("s_path")) & (author | label), "left")
    named = F.coalesce(F.max(author).over(W.partitionBy("path", "chain")), F.lit(False))
    out = met.withColumn("named", named).filter(F.col("s_path").isNull() | F.when(F.col("named"), author).otherwise(label))
    return out.select("path", "chain", *[F.col(f"s_{c}").alias(c) for c in sites.columns if c != "path"])
