"""What several corpus operators share: settling in the shared folder, and plain text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.storage import settle, shared_dir, sweep

__all__ = ["bind", "count_words", "free_name", "lower_ascii", "row_hash", "settle", "shared_dir", "small_batches", "split_words", "sweep", "table", "text_of"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: White space as all word rules here see it.
SPACE = r"\x20\x09-\x0D"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of few rows for what is written or collected inside: texts are long, and executors hold a batch
    several times over."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``docs`` has that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A 64-bit hash of whole rows; maps, which have no hash, count as JSON."""
    columns = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(F.lit(seed), *columns)


def text_of(text_col: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(text, UPPER, UPPER.lower())


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def split_words(text: Column) -> Column:
    """The words of a text: maximal runs without white space."""
    return F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words; splitting is linear, while each match of a counting pattern costs a copy of the text."""

    def count(parts: Column) -> Column:
        empty = lambda i: F.when(F.try_element_at(parts, F.lit(i)) == "", F.lit(1)).otherwise(F.lit(0))
        return F.when(F.size(parts) == 1, 1 - empty(1)).otherwise(F.size(parts) - empty(1) - empty(-1))

    return bind(F.split(text, f"[{SPACE}]+", -1), count).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
