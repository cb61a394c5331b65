"""Learning a vocabulary of merges, and encoding with a frozen one.

Only the best pair of each step, one row, comes to the driver. Lineage is cut through the shared folder every few steps.
The incremental plan recounts pairs only in chains that a merge has touched; both plans give the same merges.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators.chains import adjacent_pairs, best_pair, matched, merge_pair, pair_counts
from chainloom.storage import settle

VOCABULARY = "step int, left string, right string, token string, n bigint"


def learn(tokens: DataFrame, steps: int, joiner: str = "+", incremental: bool = True, settle_every: int = 4, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, chains) after up to ``steps`` merges of pairs that occur ``least`` times."""
    spark = tokens.sparkSession
    tokens = settle(tokens)
    counts = settle(pair_counts(tokens).select("left", "right", "n")) if incremental else None
    rows: list[tuple] = []
    for step in range(1, steps + 1):
        best = best_pair(counts if incremental else pair_counts(tokens)).first()
        if best is None or best["n"] < least:
            break
        pair = spark.createDataFrame([(best["left"], best["right"])], "left string, right string")
        rows.append((step, best["left"], best["right"], f"{best['left']}{joiner}{best['right']}", best["n"]))
        merged = merge_pair(tokens, pair, joiner)
        if incremental:
            merged = settle(merged)
            touched = matched(tokens, pair).filter("take").select("chain").distinct()
            old = _pairs_in(tokens, touched).withColumn("by", F.lit(-1))
            new = _pairs_in(merged, touched).withColumn("by", F.lit(1))
            delta = old.unionByName(new).groupBy("left", "right").agg(F.sum("by").alias("n"))
            counts = settle(counts.unionByName(delta).groupBy("left", "right").agg(F.sum("n").alias("n")).filter("n > 0"))
        elif step % settle_every == 0:
            merged = settle(merged)
        tokens = merged
    return spark.createDataFrame(rows, VOCABULARY), tokens


def _pairs_in(tokens: DataFrame, some: DataFrame) -> DataFrame:
    return adjacent_pairs(tokens.join(some, "chain", "left_semi")).select("left", "right")


def encode_chain(tokens: list[str], merges: list[tuple[str, str, str]]) -> list[str]:
    """A chain after merges in vocabulary order, each from left to right.

    >>> encode_chain(list("aaab"), [("a", "a", "aa"), ("aa", "a", "aaa")])
    ['aaa', 'b']
    """
    out = list(tokens)
    have = set(out)
    for left, right, token in merges:
        if left not in have or right not in have:
            continue
        k, merged = 0, []
        while k < len(out):
            if k + 1 < len(out) and out[k] == left and out[k + 1] == right:
                merged.append(token)
                k += 2
            else:
                merged.append(out[k])
                k += 1
        if len(merged) < len(out):
            have.add(token)
        out = merged
    return out


def encode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Chains encoded with a frozen vocabulary: each by itself, so a single shuffle by chain and no further one.

    The vocabulary is bounded by its number of steps and travels to the executors with the function.
    """
    merges = [(r["left"], r["right"], r["token"]) for r in vocabulary.orderBy("step").collect()]
    arrays = tokens.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("all"))
    arrays = arrays.select("chain", F.transform("all", lambda x: x["token"]).alias("tokens"))
    kind = arrays.schema["chain"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            done = [encode_chain(x, merges) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(pa.string()))], names=["chain", "tokens"])

    coded = arrays.mapInArrow(run, f"chain {kind}, tokens array<string>")
    return coded.select("chain", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def empty_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VOCABULARY)
