"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles becomes registers: each register hashes every shingle to an exponential variate,
keeps the minimum, and stores its logarithm to a base, rounded and truncated to a byte. Registers of a union are the
maxima of registers, so sketches merge; equal registers grow likelier with similarity, so bands of registers are hash
buckets. Documents that share a bucket are candidates; the likelihood of the joint register order, given both exact set
sizes, discards pairs that cannot reach the threshold; the rest is verified on the full shingle sets.

No bucket emits all its pairs:

* documents with the same shingle set are one class, and only classes are compared;
* round one compares each member of a bucket with the bucket's most central member. That is enough where all members
  then hang together;
* round two takes the buckets that still hold several components beside that member and joins them by prefix filtering: two sets that
  similar must share one of each other's rarest shingles, so for each rare shingle the members of all but its largest
  component are paired with the members of other components. This loses no link, and within the large component of a
  group of copies no pair is made.

Components are minimal labels, passed along links with pointer jumping; every round is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import settle, small_batches, text_of

WORDS = 5
#: Links need WHOLE * intersection >= PART * union.
PART, WHOLE = 85, 100
#: Bands of registers; two sets at the threshold share none with a probability of about 2e-7.
BANDS, ROWS = 25, 5
#: Base of the logarithm and rate of the variates: registers of sets of up to 1e8 shingles stay inside a byte.
BASE, RATE = 1.1, 20.0
#: Candidates likelier to lie more than this below the threshold than above are not verified: about 8 standard errors of
#: the estimate from 125 registers.
ESTIMATE_BELOW = 0.25
CACHED_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: str, words: int, hashes: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; bytes know A-Z and ASCII white space only."""
    w = np.array(list(map(hashes.__getitem__, text.encode().lower().split())), np.uint64)
    if not len(w):
        return w
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mixed((h ^ w[k : k + len(h)]) + _MIX)
    return np.unique(h)


def registers(hashes: np.ndarray, m: int) -> bytes:
    """The sketch of a set of hashes: ``m`` bytes."""
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * odd[None, :]).min(axis=0), out=least)
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(BASE))
    return np.clip(k, 0, 255).astype(np.uint8).tobytes()


def likely_similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float) -> np.ndarray:
    """Whether the likelihood of the similarity, given registers (one row each) and set sizes, still rises at ``at``."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    j = np.minimum(at, np.minimum(u / v, v / u) - 1e-9)  # more similar than their sizes allow no sets can be
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * c) / math.log(BASE)
    d = lambda x: c / (1 - np.maximum(x, 1e-12) * c) / math.log(BASE)
    more, less = u - v * j, v - u * j
    slope = -up * v * d(more) / p(more) - down * u * d(less) / p(less) + same * (v * d(more) + u * d(less)) / np.maximum(1 - p(more) - p(less), 1e-12)
    return (slope >= 0) & (np.minimum(na, nb) / np.maximum(na, nb) >= at)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, m: int = BANDS * ROWS) -> DataFrame:
    """Rows (id, n, cid, regs): set size, a 128-bit name of the set, its registers; null where there is no word."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashes = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen: dict[str, tuple] = {}
                out = []
                for text in part.column(1).to_pylist():
                    if text not in seen:
                        h = shingle_hashes(text, words, hashes)
                        seen[text] = (len(h), xxhash.xxh3_128_digest(h.tobytes()), registers(h, m)) if len(h) else (0, None, None)
                    out.append(seen[text])
                n, cid, regs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(regs, pa.binary())],
                    names=["id", "n", "cid", "regs"],
                )

    return rows.mapInArrow(run, f"id {id_type}, n bigint, cid binary, regs binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows (id, cid, n, sh) from rows (id, text): full shingle sets."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashes = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t, words, hashes) for t in part.column(1).to_pylist()]
                cids = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cids, pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))],
                    names=["id", "cid", "n", "sh"],
                )

    return docs.mapInArrow(run, f"id {id_type}, cid binary, n bigint, sh array<bigint>")


def _estimated(pairs: DataFrame, regs: DataFrame, at: float) -> DataFrame:
    """Pairs (a, b) that the likelihood doesn't rule out."""
    side = lambda x: regs.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            kept = pa.array(likely_similar(ra, rb, na, nb, at))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sh").alias(f"s{x}"))
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.lit(whole) * inter >= F.lit(part) * (F.col("na") + F.col("nb") - inter)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, comp) for the nodes of ``links`` (a, b): comp is the smallest node of the connected component."""
    both = settle(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        next_ = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        next_ = settle(next_.join(up, "comp", "left").select("node", "old", F.least("comp", "above").alias("comp")))
        if next_.filter("old <> comp").isEmpty():
            return next_.select("node", "comp")
        labels = next_.select("node", "comp")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, part: int = PART, whole: int = WHOLE,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Documents are linked if whole * intersection >= part * union of their sets of word shingles, A-Z in lower case.
    component_id is the smallest id reachable over links, a document's own included; kept marks it.

    Edge cases: a text with fewer than ``words`` words is one shingle; a null, empty or blank text has none, links with
    nothing and is kept. Repeated rows form one class; those that carry the smallest id are all kept. A null id is above
    every other; a component of null ids alone has a null component_id and is kept. An empty table gives no rows. Only
    the id and text columns are read.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        sketched = settle(sketch(docs, id_col, text_col, words, bands * rows))
    some = sketched.filter("cid IS NOT NULL")
    classes = settle(some.groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("regs", j * rows + 1, rows)) for j in range(bands)])
    banded = classes.select("cid", F.explode(keys).alias("bucket"))
    # Aggregates are settled before they join their own rows: then a hot bucket, shingle or component can be split.
    sizes = settle(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = settle(banded.join(sizes, "bucket"))
    scores = members.groupBy("cid").agg(F.sum("size").alias("score"))
    members = settle(members.join(scores, "cid").select("cid", "bucket", "score"))
    leaders = members.groupBy("bucket").agg(F.max(F.struct("score", "cid")).alias("top")).select("bucket", F.col("top.cid").alias("a"))
    leaders = settle(leaders)
    stars = members.join(leaders, "bucket").filter("cid <> a").select("a", F.col("cid").alias("b"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    involved = scores.select("cid").join(classes, "cid")
    regs = settle(involved.select("cid", "n", "regs"))
    stars = settle(_estimated(stars, regs, part / whole - ESTIMATE_BELOW))
    # Full sets are needed only of classes with a candidate; their texts come by id, and the set's name picks the row.
    needed = settle(involved.select(F.col("rep").alias("id"), "cid"))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    texts = texts.join(needed.select(F.col("id").alias("need")).distinct(), F.expr("id <=> need"), "left_semi")
    full = _sets(texts, words).join(needed.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    with small_batches(spark):
        full = settle(full.select("cid", "n", "sh"))
    links = settle(_verified(stars, full, part, whole))
    comps = components(links)
    # Round two: buckets that hold several components beside their leader, with which all have been compared.
    placed = members.select("cid", "bucket").join(leaders, "bucket").filter("cid <> a").drop("a")
    placed = placed.join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    placed = settle(placed.select("cid", "bucket", F.coalesce("comp", "cid").alias("comp")))
    split = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    split = settle(split)
    rest = settle(placed.join(split, "bucket", "left_semi").select("cid", "comp").distinct())
    if not rest.isEmpty():
        found = _prefix_pairs(rest.join(full, "cid"), part, whole)
        more = settle(_verified(_estimated(found, regs, part / whole - ESTIMATE_BELOW), full, part, whole))
        links = links.union(more)
        comps = components(links)
    named = classes.select("cid", "rep").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    named = settle(named.select("cid", "rep", F.coalesce("comp", "cid").alias("comp")))
    lowest = settle(named.groupBy("comp").agg(F.min("rep").alias("component_id")))
    by_class = named.join(lowest, "comp").select("cid", "component_id")
    out = sketched.select("id", "n", "cid").join(by_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _prefix_pairs(sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) in different components that may be similar, from rows (cid, comp, n, sh).

    Sorted by how many of these sets hold a shingle, rarest first, two sets with at least part/whole in common share a
    shingle among the first n - ceil(n * part / whole) + 1 of each. At the first one they share, what both have left
    must be enough; that rules out a set whose own shingles, which no other holds, stand before it in its order.
    """
    flat = sets.select("cid", "comp", "n", F.explode("sh").alias("s"))
    held = settle(flat.groupBy("s").agg(F.count(F.lit(1)).alias("df")))
    # One set's own shingles are gathered, never those of a group.
    ranked = flat.join(held, "s").groupBy("cid").agg(
        F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all")
    )
    first = F.col("n") - F.ceil(F.col("n") * F.lit(part) / F.lit(whole)) + 1
    heads = ranked.select("cid", "comp", "n", F.posexplode(F.slice("all", F.lit(1), first.cast("int"))).alias("pos", "h"))
    # What is left of a set behind a place bounds what two sets can share from there on.
    heads = heads.filter("h.df > 1").select("cid", "comp", "n", F.col("h.s").alias("s"), (F.col("n") - F.col("pos")).alias("left"))
    heads = settle(heads)
    parts = heads.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = parts.groupBy("s").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    largest = settle(largest.select("s", F.col("top.comp").alias("big")))
    here = settle(heads.join(largest, "s"))
    x, y = here.filter("comp <> big").alias("x"), here.alias("y")
    fits = F.expr(
        f"x.s = y.s AND x.comp <> y.comp AND (y.comp = y.big OR x.cid < y.cid)"
        f" AND {whole} * least(x.left, y.left) >= {part} * (x.n + y.n - least(x.left, y.left))"
    )
    pairs = x.join(y, fits).select(F.col("x.cid").alias("p"), F.col("y.cid").alias("q"))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
