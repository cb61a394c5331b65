"""Token chains: adjacent pairs, the best pair, greedy merging, ids and trees.

A chain table has the columns chain, pos (from 0, without gaps) and token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.operators.splits import running_sum


def in_order():
    """Each chain by position."""
    return W.partitionBy("chain").orderBy("pos")



def chains(rows: DataFrame, chain: str, order: list[str], token: str, *carried: str) -> DataFrame:
    """A chain table from rows: one chain per value of ``chain``, in the order of some columns."""
    by = W.partitionBy(chain).orderBy(*order)
    pos = (F.row_number().over(by) - 1).cast("long")
    return rows.select(F.col(chain).alias("chain"), pos.alias("pos"), F.col(token).alias("token"), *carried)


def numbered(rows: DataFrame, chain: str, *order: str) -> DataFrame:
    """Rows with ``nth``, from 1 in each chain: a chain's rows stand together in its task, in order."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(chain).orderBy(*order)))


def whole_chains(batches, rows: int = 65536) -> Iterator:
    """Arrow tables of whole chains of :func:`numbered` rows, each with the places of its chains' first rows: about so many
    rows at a time, or one chain."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows and (batch["nth"].to_numpy() == 1).any():
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(table["nth"].to_numpy() == 1)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
                held, n = table.slice(starts[-1]).to_batches(), table.num_rows - int(starts[-1])
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.flatnonzero(table["nth"].to_numpy() == 1)


def word_chains(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words of a text as a chain: cut at single spaces."""
    return docs.select(F.col(id_col).alias("chain"), F.posexplode(F.split(text_col, " ")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def adjacent_pairs(tokens: DataFrame) -> DataFrame:
    """(chain, pos, left, right) for each token that has a successor."""
    return tokens.select("chain", "pos", F.col("token").alias("left"), F.lead("token").over(in_order()).alias("right")).filter(F.col("right").isNotNull())


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(left, right, n, n_chains); counting is partial before the shuffle."""
    return adjacent_pairs(tokens).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chain").alias("n_chains"))


def word_pair_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """:func:`pair_counts` of :func:`word_chains`. Where no id stands twice, a text is a chain, so its pairs are found, and
    told apart for ``n_chains``, in its own row; what is shuffled is the texts, to deal them evenly, and counts of pairs."""
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return pair_counts(word_chains(docs, id_col, text_col))
    words = docs.select(id_col, text_col).repartition(id_col).select(F.col(id_col).isNotNull().cast("long").alias("named"), F.split(text_col, " ").alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = words.select("named", F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)).alias("p"))  # no word has a space
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    every = F.transform("p", lambda p: F.struct(p.alias("pair"), one.alias("n"), zero.alias("c")))
    first = F.transform(F.array_distinct("p"), lambda p: F.struct(p.alias("pair"), zero.alias("n"), F.col("named").alias("c")))
    counts = pairs.select(F.explode(F.concat(every, first)).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n"), F.sum("x.c").alias("n_chains"))
    both = F.split("pair", " ")
    return counts.select(F.get(both, F.lit(0)).alias("left"), F.get(both, F.lit(1)).alias("right"), "n", "n_chains")


def best_pair(counts: DataFrame, known: DataFrame | None = None, secondary: str | None = None) -> DataFrame:
    """One row: the most frequent pair, ties by key. Pairs in ``known`` (left, right) come first, then, if a column of
    secondary counts is named, those with the most of it. A top-k plan: no sort of all pairs."""
    order: list[Column] = [F.desc("n"), F.asc("left"), F.asc("right")]
    if secondary:
        order.insert(0, F.desc(secondary))
    if known is not None:
        counts = counts.join(known.select("left", "right").distinct().withColumn("known", F.lit(1)), ["left", "right"], "left")
        order.insert(0, F.desc(F.coalesce("known", F.lit(0))))
    return counts.orderBy(*order).limit(1).select("left", "right", "n")


def matched(tokens: DataFrame, pair: DataFrame) -> DataFrame:
    """Tokens with ``take``: the first half of an occurrence that a greedy scan from the left replaces.

    Overlapping occurrences (x x x for the pair x x) form a run; in each run every second one is taken.
    """
    pair = pair.select(F.col("left").alias("l"), F.col("right").alias("r"))
    after = F.lead("token").over(in_order())
    flagged = tokens.withColumn("next", after).crossJoin(F.broadcast(pair))  # the pair is one row
    flagged = flagged.withColumn("hit", F.coalesce((F.col("token") == F.col("l")) & (F.col("next") == F.col("r")), F.lit(False)))
    run = F.col("pos") - F.row_number().over(W.partitionBy("chain", "hit").orderBy("pos"))
    flagged = flagged.withColumn("run", run)
    nth = F.row_number().over(W.partitionBy("chain", "hit", "run").orderBy("pos")) - 1
    return flagged.withColumn("take", F.col("hit") & (nth % 2 == 0)).drop("next", "hit", "run")


def merge_pair(tokens: DataFrame, pair: DataFrame, joiner: str = "+") -> DataFrame:
    """The chains after one merge: taken pairs become one token named left + joiner + right."""
    out = matched(tokens, pair).withColumn("dead", F.lag("take", 1, False).over(in_order())).filter(~F.col("dead"))
    name = F.when(F.col("take"), F.concat("l", F.lit(joiner), "r")).otherwise(F.col("token"))
    return out.select("chain", (F.row_number().over(in_order()) - 1).cast("long").alias("pos"), name.alias("token"))


def token_ids(tokens: DataFrame) -> DataFrame:
    """Vocabulary (token, id, n): dense ids from 0 in the order of the tokens."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    numbered = running_sum(counts.withColumn("__one", F.lit(1).cast("long")), "token", "__one", "id")
    return numbered.select("token", "n", F.col("id").cast("long").alias("id"))


def encode_ids(tokens: DataFrame, vocabulary: DataFrame, unknown: int | None = None) -> DataFrame:
    """(chain, pos, id); a token that the vocabulary doesn't hold becomes ``unknown``, or raises without it."""
    missing = F.lit(unknown).cast("long") if unknown is not None else F.raise_error(F.concat(F.lit("unknown token: "), F.col("token"))).cast("long")
    found = tokens.join(vocabulary.select("token", F.col("id").alias("__id")), "token", "left")
    return found.select("chain", "pos", F.when(F.col("__id").isNotNull(), F.col("__id")).otherwise(missing).alias("id"))


def decode_ids(ids: DataFrame, vocabulary: DataFrame, unknown: str | None = None) -> DataFrame:
    """(chain, pos, token); an id that the vocabulary doesn't hold becomes ``unknown``, or raises without it."""
    missing = F.lit(unknown) if unknown is not None else F.raise_error(F.concat(F.lit("unknown id: "), F.col("id").cast("string"))).cast("string")
    found = ids.join(vocabulary.select(F.col("token").alias("__token"), "id"), "id", "left")
    return found.select("chain", "pos", F.when(F.col("__token").isNotNull(), F.col("__token")).otherwise(missing).alias("token"))


def start_pointers(tokens: DataFrame, joiner: str = "+") -> DataFrame:
    """(chain, k, start): for each original position, where its token begins. A token's width is its number of parts."""
    width = F.size(F.split("token", rf"\{joiner}"))
    before = F.coalesce(F.sum("width").over(in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = tokens.withColumn("width", width).withColumn("start", before)
    return spans.select("chain", "start", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("k"))


def merge_edges(before: DataFrame, pair: DataFrame, step: int) -> DataFrame:
    """Tree edges of a merge: (chain, step, parent, child, side); nodes are named by step and position."""
    taken = matched(before, pair).filter("take")
    node = F.concat(F.lit(f"{step}:"), F.col("pos").cast("string"))
    left = taken.select("chain", F.lit(step).alias("step"), node.alias("parent"), F.col("pos").alias("child"), F.lit("l").alias("side"))
    right = taken.select("chain", F.lit(step).alias("step"), node.alias("parent"), (F.col("pos") + 1).alias("child"), F.lit("r").alias("side"))
    return left.unionByName(right)


def forest_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (chain, node) that are nobody's child."""
    return nodes.join(edges.select("chain", F.col("child").alias("node")), ["chain", "node"], "left_anti")


def tree_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, level) below the roots, by a recursive query over (parent, child)."""
    spark = edges.sparkSession
    return spark.sql(
        """WITH RECURSIVE t(node, level) AS (
             SELECT node, 0 FROM {roots} UNION ALL
             SELECT e.child, t.level + 1 FROM t JOIN {edges} e ON e.parent = t.node)
           SELECT node, level FROM t""",
        roots=roots, edges=edges,
    )


def chain_sizes(tokens: DataFrame) -> DataFrame:
    """One row: vocabulary size, chains, tokens and mean tokens per chain."""
    per = tokens.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = tokens.agg(F.countDistinct("token").alias("k"))
    return vocabulary.crossJoin(per.agg(F.count(F.lit(1)).alias("chains"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_tokens")))
