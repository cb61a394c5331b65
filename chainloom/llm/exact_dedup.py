"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Every block goes to one of 2**64 buckets by
its hash, the distinct blocks of a bucket are sorted, and the block's name is the integer pair (bucket,
rank in the bucket). Adjacent names are then named in pairs by the same rule until each document has a
single name. Two documents have equal names if and only if their texts are equal: the rank tells apart
whatever a hash cannot, so no collision is possible.

A bucket nearly always holds one block. Which ones hold more ("crowded") is found from the distinct blocks
alone, which a map-side aggregate has already thinned to one row for each copy group and task, so a block
that a third of the corpus shares never meets in one task. Ranks are joined back only where a bucket is crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.llm.common import bind, lower_ascii, settle, text_of

BLOCK_CHARS = 4096
#: Texts up to this length are cut by position, longer ones by one pass of a pattern.
CUT_BY_POSITION = 32768
NAMES = "array<struct<bucket:bigint,rank:int>>"
ENTRY = "struct<level:int,bucket:bigint,content:struct<left:struct<bucket:bigint,rank:int>,right:struct<bucket:bigint,rank:int>>>"


def _bucket(content: list[Column], level: int, bits: int) -> Column:
    """The bucket of a block (level 0) or a pair of names; fewer bits only serve tests of crowded buckets."""
    h = F.xxhash64(F.lit(level), *content)
    return h if bits >= 64 else F.shiftrightunsigned(h, 64 - bits)


def _pair_bucket(pair: Column, level: int, bits: int) -> Column:
    left, right = pair["left"], pair["right"]
    return _bucket([left["bucket"], left["rank"], right["bucket"], F.coalesce(right["rank"], F.lit(-1))], level, bits)


def _pair_entry(pair: Column, level: Column | int, bits: int) -> Column:
    return F.struct(
        F.lit(level).cast("int").alias("level"), _pair_bucket(pair, level, bits).alias("bucket"), pair.alias("content")
    )


def _level(names: Column, level: Column | int, bits: int) -> Column:
    """The names of the next level."""
    return F.transform(_pairs(names), lambda pair: _name(_pair_bucket(pair, level, bits)))


def _climb(names: Column, depth: int, bits: int, entries: bool) -> Column:
    """Names at the top level, or else all (level, bucket, pair) entries met on the way up."""
    nothing = F.array().cast(f"array<{ENTRY}>")

    def step(acc: Column, level: Column) -> Column:
        met = F.concat(acc["met"], F.transform(_pairs(acc["names"]), lambda p: _pair_entry(p, level, bits))) if entries else acc["met"]
        return F.struct(_level(acc["names"], level, bits).alias("names"), met.alias("met"))

    levels = F.sequence(F.lit(1), F.lit(depth))
    zero = F.struct(names.cast(NAMES).alias("names"), nothing.alias("met"))
    return F.aggregate(levels, zero, step, lambda acc: acc["met" if entries else "names"])


def _name(bucket: Column, rank: Column | None = None) -> Column:
    return F.struct(bucket.alias("bucket"), (F.lit(0) if rank is None else rank).cast("int").alias("rank"))


def _blocks(text: Column, chars: int) -> Column:
    return bind(text, lambda norm: _cut(norm, chars))


def _cut(norm: Column, chars: int) -> Column:
    n = F.length(norm)
    by_place = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / chars).cast("int")),
        lambda i: F.substring(norm, i * chars + 1, F.lit(chars)),
    )
    return F.when(n <= CUT_BY_POSITION, by_place).otherwise(F.filter(F.split(norm, r"(?<=\G(?s:.{%d}))" % chars, -1), lambda b: b != ""))


def _pairs(all_names: Column) -> Column:
    """Adjacent names two by two; a single last name stands with null."""

    def pairs(names: Column) -> Column:
        last = F.floor((F.size(names) - 1) / 2).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.get(names, i * 2).alias("left"), F.get(names, i * 2 + 1).alias("right")),
        )

    return bind(all_names, pairs)


def _ranks_in_crowded(entries: DataFrame) -> DataFrame | None:
    """(level, bucket, content, rank) where a bucket holds several distinct contents; None if none does."""
    distinct = entries.select("level", "bucket", "content").distinct()
    crowded = distinct.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    if crowded.isEmpty():
        return None
    by = W.partitionBy("level", "bucket").orderBy("content")
    return settle(distinct.join(crowded, ["level", "bucket"]).withColumn("rank", F.row_number().over(by) - F.lit(1)))


def _with_ranks(flat: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows (uid, id, sha, names) from one row for each position; a group is one document's own names."""
    one = F.struct("pos", _name(F.col("bucket"), F.coalesce("rank", F.lit(0))).alias("name"))
    return (
        flat.join(ranks, ["level", "bucket", "content"], "left")
        .groupBy("uid")
        .agg(F.first("id").alias("id"), F.first("sha").alias("sha"), F.sort_array(F.collect_list(one)).alias("all"))
        .select("uid", "id", "sha", F.transform("all", lambda x: x["name"]).alias("names"))
    )


def name_texts(keyed: DataFrame, block_chars: int = BLOCK_CHARS, bits: int = 64) -> DataFrame:
    """Rows (id, norm) to rows (uid, id, sha, name): equal names mean equal texts."""
    blocked = keyed.withColumn("blocks", _blocks(F.col("norm"), block_chars))
    ranks = _ranks_in_crowded(
        blocked.select(F.explode("blocks").alias("content")).select(
            F.lit(0).alias("level"), _bucket([F.col("content")], 0, bits).alias("bucket"), "content"
        )
    )
    with_sha = blocked.select(F.monotonically_increasing_id().alias("uid"), "id", F.sha2("norm", 256).alias("sha"), "blocks")
    if ranks is None:
        rows = with_sha.withColumn("names", F.transform("blocks", lambda b: _name(_bucket([b], 0, bits)))).drop("blocks")
    else:
        flat = settle(with_sha).select("uid", "id", "sha", F.posexplode("blocks").alias("pos", "content"))
        rows = _with_ranks(flat.select("*", F.lit(0).alias("level"), _bucket([F.col("content")], 0, bits).alias("bucket")), ranks)
    rows = settle(rows)
    longest = rows.agg(F.max(F.size("names"))).first()[0] or 1
    depth = (longest - 1).bit_length()
    # First all levels at once, as if no bucket of pairs were crowded; that is checked on the distinct pairs.
    if depth == 0:
        return rows.select("uid", "id", "sha", F.get("names", F.lit(0)).alias("name"))
    met = rows.select(F.explode(_climb(F.col("names"), depth, bits, True)).alias("e")).select("e.*")
    if _ranks_in_crowded(met) is None:
        top = _climb(F.col("names"), depth, bits, False)
        return rows.select("uid", "id", "sha", F.get(top, F.lit(0)).alias("name"))
    for level in range(1, depth + 1):
        flat = rows.select("uid", "id", "sha", F.posexplode(_pairs(F.col("names"))).alias("pos", "content")).select(
            "*", F.lit(level).alias("level"), _pair_bucket(F.col("content"), level, bits).alias("bucket")
        )
        ranks = _ranks_in_crowded(flat)
        if ranks is None:
            rows = rows.withColumn("names", _level(F.col("names"), level, bits))
        else:
            rows = settle(_with_ranks(flat, ranks))
    return rows.select("uid", "id", "sha", F.get("names", F.lit(0)).alias("name"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, bits: int = 64
) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the largest id stays.

    Edge cases: a null text counts as the empty text, and all empty texts are one group. A null id sorts below any
    other; it is kept only in a group of null ids (keep_id is null there). Rows that share id and text are counted
    each in group_size, and all of them are marked kept if their id is. An empty table gives no rows. Only the id
    and text columns are read, so other columns, whatever their names, change nothing.
    """
    keyed = docs.select(F.col(id_col).alias("id"), lower_ascii(text_of(text_col)).alias("norm"))
    named = name_texts(keyed, block_chars, bits).select("id", "sha", "name.bucket", "name.rank")
    groups = named.groupBy("bucket", "rank").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(groups)  # then both sides of the join are plain shuffles, and a group of a third of all rows can be split
    return named.join(groups, ["bucket", "rank"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
