"""A corpus from raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Each stage is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import free_name, settle, small_batches, table, text_of
from chainloom.llm.line_dedup import line_dedup
from chainloom.llm.mixing import mixed_documents
from chainloom.llm.near_dedup import near_dedup
from chainloom.llm.packing import pack
from chainloom.llm.queries import tokenizer
from chainloom.llm.toxicity import fit_toxicity, toxicity_of
from chainloom.storage import settled, sweep

REJECT_AT = 0.5
#: Near copies share this part of their word shingles; op10's contract of 0.85 binds only that query.
NEAR_PART, NEAR_WHOLE = 80, 100


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of REJECT_AT or more go. Null and empty texts have a score as well, very long ones
    are scored whole. Each row is judged by its text alone, so repeated rows go or stay together. Columns may have any name."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__toxicity")
    with small_batches(spark):
        return settle(docs.withColumn(score, toxicity_of(model, text_of("text"))["score"]).filter(F.col(score) < REJECT_AT).drop(score))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line passages are cut out; a document of which nothing is left goes. Null and empty texts
    stay as they are. Repeated rows are one document listed more than once and are cut alike."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}" if c in ("n_lines", "n_removed") else c) for c in docs.columns])
    kept = line_dedup(held).filter(~((F.col("n_removed") > 0) & (F.trim(text_of("text")) == ""))).drop("n_lines", "n_removed")
    return with_length(kept.select(*[F.col(f"`{h}`").alias(c) for h, c in zip(held.columns, docs.columns, strict=True)]), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more alike) stays: the one with the smallest id, null ids last,
    then by a hash of the text. Rows, not ids, are judged: different texts under one id stay or go each for itself, and
    of rows that repeat both id and text one stays. Documents without words (null, empty or blank) all stay."""
    key, mine = free_name(docs, "__key"), free_name(docs, "__mine")
    row = F.struct(F.col("doc_id").isNull().alias("nul"), F.col("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("text"))
    found = near_dedup(docs.select(row.alias("row"), "text"), "row", part=NEAR_PART, whole=NEAR_WHOLE)
    stay = settle(found.filter("kept").select(F.col("row").alias(key), "n_shingles"))
    kept = docs.withColumn(mine, row)
    held = lambda rows: kept.join(rows.select(key).distinct(), F.col(mine) == F.col(key), "left_semi")
    if stay.filter("n_shingles > 0").groupBy(key).count().filter("count > 1").isEmpty():
        return held(stay).drop(mine)
    copied = held(stay.filter("n_shingles > 0")).dropDuplicates([mine])
    return copied.unionByName(held(stay.filter("n_shingles = 0"))).drop(mine)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions, once for each pass, in training order. Null and empty texts have no words
    and are never taken; a null source is one of its own. Every row counts for itself, repeated rows as often as they stand."""
    return with_length(mixed_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and its place there. Repeated rows are packed each, an empty text is its closing id."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``, with n_chars following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return docs.select(*[f"`{c}`" for c in columns])


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing),
    ("packing", packing),
]

#: Scores, likeness and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage has settled goes when the next one's documents are
    written; the caller sweeps what the result itself reads."""
    docs, before = table(spark, sf_dir, "documents"), settled()
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        sweep(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
