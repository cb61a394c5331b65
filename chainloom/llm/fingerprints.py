"""Document fingerprints by winnowing.

A text is read as tokens: runs without white space, but every character of a script without spaces, or of a run of
over TOKEN_CHARS characters, is a token of its own, so tokens don't depend on where a run begins. Every k consecutive
tokens have a rolling hash of 64 bits, a cyclic polynomial: the hashes of the tokens, each rotated by its distance to
the gram's end, under exclusive or. Of every w consecutive hashes the smallest is selected, the rightmost of equal
ones, and its position is kept. Any passage of w + k - 1 tokens that two texts share therefore shares a selected hash,
wherever it stands, and the positions say where.

All of it is array functions inside a row. The window minimum takes log2(w) passes: a number holds the hash's first 33
bits, by which hashes are compared, and the inverted position, so that a plain minimum prefers the rightmost of
equal ones; the whole hash is then looked up by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.llm.common import bind, settle, split_words, text_of

GRAM = 5
WINDOW = 8
TOKEN_CHARS = 64
#: Scripts written without spaces: Thai to Myanmar, Khmer, kana and Han with their extensions.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u312F\u31A0-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"
#: Low bits that hold a position: more tokens than a text of 2 GB can have.
PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1
#: Ids in one bucket of the search for the next document, and how many rows make a bucket a crowded one.
IDS_PER_BUCKET = 256
CROWDED = 65_536


def _tokens(text: Column) -> Column:
    """The tokens of a text."""
    ascii_ = F.octet_length(text) == F.length(text)
    apart = F.when(ascii_ | ~F.rlike(text, F.lit(UNSPACED)), text).otherwise(F.regexp_replace(text, f"({UNSPACED})", " $1 "))

    def cut(words: Column) -> Column:
        pieces = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > TOKEN_CHARS, F.split(w, "", -1)).otherwise(F.array(w))))
        pieces = F.filter(pieces, lambda w: w != "")
        return F.when(F.exists(words, lambda w: F.length(w) > TOKEN_CHARS), pieces).otherwise(words)

    return bind(split_words(apart), cut)


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def gram_hashes(tokens: Column, k: int = GRAM) -> Column:
    """The rolling hashes of all grams; a text of fewer than k tokens is one gram."""

    def grams(h: Column) -> Column:
        def one(i: Column) -> Column:
            out = _rotated(F.get(h, i), k - 1)
            for j in range(1, k):
                out = out.bitwiseXOR(_rotated(F.coalesce(F.get(h, i + j), F.lit(0).cast("long")), k - 1 - j))
            return out

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), one)

    return bind(F.transform(tokens, lambda t: F.xxhash64(t)), grams)


def winnowed(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The selected grams array<struct<hash, position>> of a text, in order; ``w`` is a power of two."""
    if w & (w - 1):
        raise ValueError("the window must be a power of two")

    def selected(hashes: Column) -> Column:
        def packed(h: Column, i: Column) -> Column:
            high = F.shiftrightunsigned(h, PLACE_BITS + 1)  # 33 bits, so the whole stays positive
            return F.shiftleft(high, PLACE_BITS).bitwiseOR(F.lit(PLACES).cast("long") - i)

        def minima(p: Column) -> Column:
            out, step = p, 1
            while step < w:
                # Beyond the end a window only has what is there; least() skips nulls.
                out = F.zip_with(out, F.slice(out, F.lit(1 + step), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(a, b))
                step *= 2
            full = F.greatest(F.size(p) - (w - 1), F.lit(1))
            return F.array_distinct(F.slice(out, F.lit(1), full))

        def looked_up(x: Column) -> Column:
            place = (F.lit(PLACES).cast("long") - x.bitwiseAND(F.lit(PLACES).cast("long"))).cast("int")
            return F.struct(F.get(hashes, place).alias("hash"), place.alias("position"))

        return F.transform(bind(F.transform(hashes, packed), minima), looked_up)

    some = bind(_tokens(text), lambda t: F.when(F.size(t) > 0, bind(gram_hashes(t, k), selected)))
    return F.coalesce(some, F.array().cast("array<struct<hash:long,position:int>>"))


def hashes_of(selected: Column) -> Column:
    """The distinct hashes of selected grams, sorted."""
    return F.array_sort(F.array_distinct(F.transform(selected, lambda x: x["hash"])))


def fingerprint_text(selected: Column) -> Column:
    """A fingerprint as a string: position:hash in hexadecimal, in order, joined by commas."""
    return F.array_join(F.transform(selected, lambda x: F.concat_ws(":", x["position"].cast("string"), F.lower(F.hex(x["hash"])))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """One row per document: ``id_col``, selected array<struct<hash, position>> in order of position.

    Edge cases: a null or blank text has no tokens and an empty array; a text of fewer than k tokens is one gram; with
    fewer than w grams there is one window. Very long texts are read whole. Repeated rows and null ids give a row each,
    an empty table none. Other columns are not read, so their names don't matter.
    """
    return docs.select(F.col(id_col), winnowed(text_of(text_col), k, w).alias("selected"))


def _next_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, next_bucket): the next lower bucket that has rows, null for the lowest; by levels of a thousandth each,
    so that no task ever holds all buckets."""
    up = buckets.select("bucket", F.floor(F.col("bucket") / 1024).alias("up"))
    by = W.partitionBy("up").orderBy(F.col("bucket").desc())
    inner = up.withColumn("next_bucket", F.lead("bucket").over(by))
    tops = up.groupBy("up").agg(F.max("bucket").alias("top"))
    if tops.limit(4097).count() <= 4096:
        linked = tops.withColumn("below", F.lead("top").over(W.orderBy(F.col("up").desc()))).select("up", "below")
    else:
        tops = settle(tops)
        chain = _next_buckets(tops.select(F.col("up").alias("bucket"))).select(F.col("bucket").alias("up"), F.col("next_bucket").alias("under"))
        linked = chain.join(tops.select(F.col("up").alias("under"), F.col("top").alias("below")), "under", "left").select("up", "below")
    return inner.join(linked, "up", "left").select("bucket", F.coalesce("next_bucket", "below").alias("next_bucket"))


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: dict[str, Column], ids_per_bucket: int = IDS_PER_BUCKET, crowded: int = CROWDED) -> DataFrame:
    """Rows (id, text, carried..., next_text, next_<carried>...) where next is the document with the next lower id, and
    the first one follows the last.

    Ids fall into buckets of consecutive ids; the text moves once, to its bucket, where the next row is at hand. Only
    the last row of each bucket takes its follower from a join with the first rows of the buckets. A bucket that
    repeated ids crowd is cut on along the same order, into cells of one id and a stretch of text hashes, and its rows
    that are equal in both travel as one with a count, so no id has to fit into one task.
    """
    bits = ids_per_bucket.bit_length() - 1
    bucket = F.shiftright(F.coalesce(F.col("id"), F.lit(-(1 << 62))), bits)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("tie"), F.struct("text", *[c.alias(n) for n, c in carried.items()]).alias("row"), bucket.alias("bucket"))
    sizes = settle(docs.select(F.col(id_col).cast("long").alias("id")).select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    full = sizes.filter(F.col("n") > crowded).select("bucket")
    buckets = settle(_next_buckets(sizes.select("bucket")))
    top = buckets.agg(F.max("bucket").alias("top"))
    after = buckets.crossJoin(top).select("bucket", F.coalesce("next_bucket", "top").alias("next_bucket"))
    key = ["bucket", "a", "b"]
    zero = [F.lit(0).cast("long").alias(x) for x in key[1:]]
    if full.isEmpty():
        rows = rows.select("*", *zero, F.lit(1).cast("long").alias("n"))
        cells = after.select("bucket", *zero, "next_bucket", *[z.alias(f"next_{x}") for x, z in zip(key[1:], zero, strict=True)])
    else:
        # At most one bucket in ``crowded`` rows is here, which bounds what is broadcast.
        marked = F.broadcast(full.select(F.col("bucket").alias("full")))
        split = [F.coalesce(-F.col("id"), F.lit((1 << 63) - 1)), F.shiftright("tie", 52)]  # ids go down, hashes up
        held = lambda df: df.join(marked, F.col("bucket") == F.col("full"), "left")
        deal = lambda df: held(df).select(*df.columns, *[F.when(F.col("full").isNull(), F.lit(0)).otherwise(x).cast("long").alias(n) for n, x in zip(key[1:], split, strict=True)])
        rows = deal(rows)
        slim = settle(rows.select(key).distinct())
        rows = rows.groupBy(*key, "id", "tie").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
        inside = slim.withColumn("then", F.lead(F.struct("a", "b")).over(W.partitionBy("bucket").orderBy("a", "b")))
        first = slim.groupBy(F.col("bucket").alias("of")).agg(F.min(F.struct("a", "b")).alias("first"))
        ends = inside.filter("then IS NULL").join(after, "bucket").join(first, F.col("next_bucket") == F.col("of"))
        cells = settle(
            inside.filter("then IS NOT NULL").select(*key, F.col("bucket").alias("next_bucket"), F.col("then").alias("t"))
            .unionByName(ends.select(*key, "next_bucket", F.col("first").alias("t")))
        ).select(*key, "next_bucket", *[F.col(f"t.{x}").alias(f"next_{x}") for x in key[1:]])
    # Rows of equal id stand in the order of their text's hash. All three parts below read one shuffle of the text.
    by = W.partitionBy(*key).orderBy(F.col("id").desc_nulls_last(), "tie")
    seen = rows.withColumn("next", F.lead("row").over(by)).withColumn("first", F.lag(F.lit(1)).over(by).isNull())
    inner = seen.filter("next IS NOT NULL").select("id", "row", "next", "n")
    lasts = seen.filter("next IS NULL").select("id", *key, "row", "n")
    heads = seen.filter("first").select(*[F.col(x).alias(f"next_{x}") for x in key], F.col("row").alias("next"))
    outer = lasts.join(cells, key).join(heads, [f"next_{x}" for x in key]).select("id", "row", "next", "n")
    names = ["text", *carried]
    pairs = inner.unionByName(outer)
    if not full.isEmpty():  # a copy is followed by the next copy, the last one by what follows them all
        copies = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        pairs = copies.select("id", "row", F.when(F.col("copy") < F.col("n"), F.col("row")).otherwise(F.col("next")).alias("next"))
    return pairs.select(
        "id", *[F.col(f"row.{n}").alias(n) for n in names], *[F.col(f"next.{n}").alias(f"next_{n}") for n in names]
    )


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and how alike they are.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes. The
    edited text has its last third of code points replaced by as many first ones, or all, of the next lower id's text.

    Edge cases: ids must be integers. Null texts count as empty; two empty fingerprints are alike with 1. A null id comes
    after all others. Rows of one id follow each other in the order of a hash of their text. A table of one row is its
    own next. Very long texts are read whole. An empty table gives no rows. Other columns are not read, so their names
    don't matter.
    """
    rows = with_next(docs, id_col, text_col, {"own": winnowed(F.col("text"), k, w)})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), n - cut), F.left(F.col("next_text"), cut))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "own", hashes_of(F.col("own")).alias("a"), hashes_of(F.col("next_own")).alias("c"), edited.alias("edited"))
    rows = rows.withColumn("new", winnowed(F.col("edited"), k, w)).withColumn("b", hashes_of(F.col("new")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.size("a").alias("n_hashes"),
    )
