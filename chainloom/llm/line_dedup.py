"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document form a window. Windows are hashed, the first occurrence of each hash over
the whole corpus is found, and every later occurrence marks its three lines as covered; a document keeps the lines
that no later occurrence covers. Overlapping windows merge by themselves, as what is kept is a set of positions.

One window may stand in a third of all documents: its first occurrence comes from a map-side minimum, windows that
occur once are dropped before the join, and the join back moves narrow rows without text, which an adaptive skew join
can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import bind, free_name, settle, text_of

WINDOW_LINES = 3


def _kept(lines: Column, gone: Column) -> Column:
    """The lines at other positions than ``gone``, joined; a map from position keeps a long document linear."""

    def without(held: Column) -> Column:
        numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
        return F.filter(numbered, lambda x: F.try_element_at(held, x["i"]).isNull())

    kept = bind(F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit(True))), without)
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def _windows(lines: Column, width: int) -> Column:
    """Structs (pos, h1, h2) of the windows with a line that isn't blank; two hashes of 64 bits make one key."""

    def one(i: Column) -> Column:
        inside = [F.get(lines, i + k) for k in range(width)]
        blank = F.lit(True)
        for line in inside:
            blank = blank & (F.trim(line) == "")
        hashed = F.struct(i.alias("pos"), F.xxhash64(*inside).alias("h1"), F.xxhash64(F.lit(1), *inside).alias("h2"))
        return F.when(~blank, hashed)

    starts = F.sequence(F.lit(0), F.size(lines) - width)
    return F.filter(F.transform(starts, one), lambda w: w.isNotNull())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_LINES) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` reduced to its kept lines, plus n_lines and n_removed.

    Lines are what newlines separate, compared as they are. The order of occurrence is by id (nulls first), then by a
    hash of the text, then by position. A later occurrence in the document of the first one covers only lines beyond
    the first one, so a line repeated many times keeps its first ``width`` copies.

    Edge cases: a null text stays null and has 0 lines; an empty text has one empty line. Texts with fewer than
    ``width`` lines have no window and stay whole. Windows of blank lines alone are no windows. Rows that share id and
    text are one document listed more than once: they all become the same. If every line goes, the text is empty.
    Columns of ``docs`` named n_lines or n_removed are replaced; others may have any name. An empty table gives no rows.
    """
    clear = docs.drop("n_lines", "n_removed")
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__hash")]
    lines = F.split(text_of(text_col), "\n", -1)
    none = F.array().cast("array<struct<pos:int,h1:bigint,h2:bigint>>")
    found = bind(lines, lambda held: F.when(F.size(held) >= width, _windows(held, width)).otherwise(none))
    windows = clear.select(*key, F.explode(found).alias("w")).select("__id", "__hash", "w.pos", "w.h1", "w.h2")
    place = F.struct("__id", "__hash", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = settle(first)  # then the join below is of two plain shuffles, and a hot window can be split
    same_doc = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__hash") == F.col("first.__hash"))
    later = (
        windows.join(first, ["h1", "h2"])
        .filter(~(same_doc & (F.col("pos") == F.col("first.pos"))))
        .withColumn("lo", F.when(same_doc, F.greatest("pos", F.col("first.pos") + width)).otherwise(F.col("pos")))
        .withColumn("hi", F.col("pos") + width - 1)
        .filter("lo <= hi")
    )
    # A set of a document's own positions: its size is bounded by its lines.
    covered = later.select("__id", "__hash", F.explode(F.sequence("lo", "hi")).alias("pos")).groupBy("__id", "__hash").agg(
        F.collect_set("pos").alias("__gone")
    )
    mine, hashed, gid, ghash, away = (free_name(clear, x) for x in ("__id", "__hash", "__gid", "__ghash", "__gone"))
    keyed = clear.select("*", F.col(id_col).alias(mine), F.xxhash64(text_of(text_col)).alias(hashed))
    gone = covered.select(F.col("__id").alias(gid), F.col("__hash").alias(ghash), F.col("__gone").alias(away))
    joined = keyed.join(gone, F.col(mine).eqNullSafe(F.col(gid)) & (F.col(hashed) == F.col(ghash)), "left")
    new_text = F.when(F.col(away).isNull(), F.col(text_col)).otherwise(_kept(lines, F.col(away)))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    return joined.select(
        *[new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in clear.columns],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(away).isNull(), F.lit(0)).otherwise(F.size(away)).cast("long").alias("n_removed"),
    )
