"""Text formats as DataFrames: structure files, domain tables, resolved hits, sequences, JSON lines, training logs.

Every reader is a projection of ``spark.read.text`` or ``.json``: splits, pushdown and compression are Spark's. Readers
that parse lines also take a DataFrame of lines (value, path), so streams use the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.schema import DOMAIN_FIELDS

#: Three-letter to one-letter codes of the amino acids (fixed values).
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(value, path) of text files, gzip or plain, folders included."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("path"))


class Catalog:
    """Names of corpora and their places; a name that isn't known is a folder or a file."""

    def __init__(self, places: dict[str, str | list[str]]):
        self.places = places

    def resolve(self, name: str | list[str]) -> list[str]:
        """Paths of a corpus; a bare word that the catalog doesn't know is an error."""
        if isinstance(name, list):
            return name
        if name in self.places:
            held = self.places[name]
            return held if isinstance(held, list) else [held]
        if "/" in name or "." in name:
            return [name]
        raise KeyError(f"unknown corpus {name}")


def atoms(text: DataFrame) -> DataFrame:
    """Atom rows of structure files: fixed columns, the first model only, in file order (atom numbers)."""
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    number = lambda a, b, kind: F.expr(f"try_cast(trim(substring(value, {a}, {b - a + 1})) AS {kind})")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.pdb(\.gz)?$", "")
    return text.filter(F.substring("value", 1, 6) == "ATOM  ").select(
        name.alias("chain_id"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("split"),
        number(7, 11, "int").alias("atom_id"), cut(13, 16).alias("atom"), cut(17, 17).alias("alt"), cut(18, 20).alias("res"),
        cut(22, 22).alias("chain"), number(23, 26, "int").alias("res_id"), cut(27, 27).alias("ins_code"),
        number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"), number(47, 54, "double").alias("z"),
        number(61, 66, "double").alias("b_factor"),
    )


def domain_table(text: DataFrame) -> DataFrame:
    """Rows of a whitespace-separated domain table; lines that begin with # are comments, the rest is the description."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("p"))
    fields = [F.get("p", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(DOMAIN_FIELDS)]
    n = len(DOMAIN_FIELDS)
    return rows.select(*fields, F.array_join(F.slice("p", n + 1, 1_000_000), " ").alias("description"))


def resolved_hits(text: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Rows of resolved hits: columns named by the header line (#FIELDS ...), with each range a-b as two numbers.

    A line with another number of columns raises an error when it is read.
    """
    if header is None:
        first = text.filter(F.col("value").startswith("#FIELDS")).select("value").first()
        header = first[0].split()[1:]
    rows = text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"), "value")
    wrong = F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("value")))
    rows = rows.withColumn("p", F.when(F.size("p") == len(header), F.col("p")).otherwise(wrong.cast("array<string>")))
    out: list[Column] = []
    for i, name in enumerate(header):
        value = F.get("p", F.lit(i))
        if name in ("boundaries", "resolved"):
            span = F.split(value, "-", 2)
            out += [F.get(span, F.lit(0)).cast("int").alias(f"{name}_from"), F.get(span, F.lit(1)).cast("int").alias(f"{name}_to")]
        else:
            kind = "double" if name in ("score", "cond-evalue", "indp-evalue", "cond_evalue", "indp_evalue") else "string"
            out.append(value.cast(kind).alias(name.replace("-", "_")))
    return rows.select(*out)


def fasta(spark: SparkSession, paths: str | list[str], alphabet: str | None = ALPHABET) -> DataFrame:
    """(name, seq) of multi-line records; sequences with letters beyond the alphabet are left out."""
    records = spark.read.option("lineSep", ">").text(paths).filter(F.trim("value") != "")
    return fasta_records(records, alphabet)


def fasta_records(records: DataFrame, alphabet: str | None = ALPHABET) -> DataFrame:
    name = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", ""))
    out = records.select(name.alias("name"), seq.alias("seq"))
    return out.filter(F.col("seq").rlike(f"^[{alphabet}]+$")) if alphabet else out


def duplicate_names(records: DataFrame) -> DataFrame:
    """Names that occur more than once: a correct file has none."""
    return records.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of JSON lines by an explicit schema, with ``split`` from the end of the file's name."""
    split = F.regexp_extract("path", r"_([a-z]+(?:_[a-z]+)*)_test\.jsonl$", 1)
    rows = spark.read.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.withColumn("split", split).drop("path")


def training_log(spark: SparkSession, path: str, pattern: str = r"_loss$") -> DataFrame:
    """(epoch, name, value) of a log in CSV: columns whose name matches, nulls left out."""
    import re

    rows = spark.read.option("header", "true").csv(path)
    wanted = [c for c in rows.columns if re.search(pattern, c)]
    numbers = rows.select(F.col("epoch").cast("int").alias("epoch"), *[F.col(c).cast("double").alias(c) for c in wanted])
    return numbers.unpivot("epoch", wanted, "name", "value").dropna(subset=["value"])


def one_letter(res: Column) -> Column:
    """One-letter code, X for unknown names."""
    table = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, res), F.lit("X"))
