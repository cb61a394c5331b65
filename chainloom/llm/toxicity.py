"""Toxicity scores from the nearest labelled examples.

Examples are a bounded sample of the labelled documents, both classes in equal numbers. Terms are all words of the
examples; a document is a vector over them, (1 + ln tf) * idf * strength, with document frequencies counted over the
whole corpus. A term's strength grows with how much its presence depends on the label, and no term has none, so every
document that shares a word with an example has neighbours. The nearest examples by exact cosine vote, weighted by their distance and by
how frequent their class is among all labels; the vote becomes a probability by a monotone fit to the votes that the
examples give each other, each without itself. The nearest examples are returned as evidence.

The search is exact. Examples lie in blocks; for each term the index keeps the largest weight in each block that holds
it, so the sum over a document's terms bounds every score in a block. Blocks are read in the order of their bounds,
a few at first; then those that can still reach the k-th best score, if any can.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import settle, small_batches, text_of

#: The bound of the sample: labelled examples of each class.
EXAMPLES_PER_CLASS = 1500
NEIGHBOURS = 15
#: A term's strength is chi2^2 / (chi2^2 + HALF_CHI2^2), LEAST_STRENGTH at least: chi2 with Yates' correction, as words of one
#: or two examples look telling by chance.
HALF_CHI2, LEAST_STRENGTH = 15.0, 0.01
#: The weight of the prior in a vote, in neighbours of cosine 0.5 or so.
FAR = 0.2
BLOCK = 64
#: A median block bound of over this part of the largest one calls for whole lists at once.
FLAT = 0.25

_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters in lower case; all of ASCII but letters separates.

    >>> words_of("You IDIOT, you!")
    [b'you', b'idiot', b'you']
    """
    return text.lower().encode().translate(_TABLE).split()


def family_of(words: list[bytes]) -> int:
    """A number that near copies mostly share: the least hash of three words in a row."""
    import xxhash

    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def held_out(id_col: str) -> Column:
    """Rows whose labels must not be learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def strengths(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How telling terms are that a of n1 toxic and b of n0 other families hold.

    >>> strengths(np.array([0, 1, 4, 40]), np.array([1, 0, 0, 2]), 44, 265).round(2).tolist()
    [0.01, 0.01, 0.59, 1.0]
    """
    n = float(n1 + n0)
    apart = np.maximum(np.abs(a * float(n0) - b * float(n1)) - n / 2, 0.0)  # |ad - bc| without c and d
    chi2 = n * apart * apart / np.maximum((a + b) * (n - a - b) * float(n1) * float(n0), 1.0)
    return np.maximum(chi2**2 / (chi2**2 + HALF_CHI2**2), LEAST_STRENGTH)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last (exclusive), and which range each is from."""
    n = last - first
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return np.arange(len(of), dtype=np.int32) + np.repeat(first - (np.cumsum(n) - n).astype(np.int32), n), of


class BlockMaxIndex:
    """Exact cosine search over unit vectors given as {term: weight}."""

    def __init__(self, vectors: list[dict[int, float]], terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        size = np.array([len(v) for v in vectors], np.int64)
        term = np.fromiter((t for v in vectors for t in v), np.int64, int(size.sum()))
        ids = np.repeat(np.arange(self.n), size)
        order = np.lexsort((ids, term))
        term, ids = term[order], ids[order]
        self.ids = ids.astype(np.int32)
        self.weights = np.fromiter((w for v in vectors for w in v.values()), np.float64, len(order))[order]
        # A cell is a term in a block that holds it: cells of a term lie together, as do postings of a cell.
        cell = term * max(self.blocks, 1) + ids // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.first = np.append(first, len(cell)).astype(np.int32)
        self.block = (ids[first] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.start = np.searchsorted(term[first], np.arange(terms + 1)).astype(np.int32)

    def _whole_lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of all examples: whole lists are joined as they lie, without picking postings one by one."""
        first, last = self.first[self.start[terms]], self.first[self.start[terms + 1]]
        spans = [slice(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        parts = np.concatenate([self.weights[x] for x in spans])
        parts *= np.repeat(weights, last - first)
        return np.bincount(np.concatenate([self.ids[x] for x in spans]), parts, self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[int, float]]:
        """The k best (example, cosine) with a positive cosine, ties by example number."""
        cells, of = _ranges(self.start[terms], self.start[terms + 1])
        block, w = self.block[cells], weights[of]
        bound = np.bincount(block, w * self.most[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best_id, best, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        # Where most blocks promise about as much as the best one, no few of them can rule out the others.
        at, step = 0, self.blocks if np.median(bound) > FLAT * bound.max(initial=0.0) else 4
        while at < self.blocks:
            full = len(best) == k
            end = min(self.blocks, at + step, int((bound > 0).sum()), *([int((bound >= floor - 1e-12).sum())] if full else []))
            if end <= at:
                break
            if 2 * (end - at) > self.blocks:  # most blocks: whole lists lie together and need no picking
                score, best_id, best = self._whole_lists(terms, weights), best_id[:0], best[:0]
            else:
                read = np.zeros(self.blocks, bool)
                read[order[at:end]] = True
                here = np.flatnonzero(read[block])
                first, last = self.first[cells[here]], self.first[cells[here] + 1]
                posts, _ = _ranges(first, last)
                score = np.bincount(self.ids[posts], np.repeat(w[here], last - first) * self.weights[posts], self.n)
            if without >= 0:
                score[without] = 0.0
            found = np.flatnonzero((score > 0) & (score >= floor - 1e-12))
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            best_id, best = np.append(best_id, found), np.append(best, score[found])
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
            if len(best) == k:
                floor = float(best[-1])
            at, step = end, self.blocks
        return list(zip(best_id.tolist(), best.tolist(), strict=True))


def monotone_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression: knots and values."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # mean, weight, sum of x * weight
    for i in order.tolist():
        stack.append([y[i], w[i], x[i] * w[i]])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            total = a[1] + b[1]
            stack.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.array([s[2] / s[1] for s in stack]), np.array([s[0] for s in stack])


@dataclass
class ToxicityModel:
    """What scoring needs: bounded by the sample of examples."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray  # times the term's strength
    unseen: float  # the same of a word that no example holds: it has no neighbours, but a share in the norm
    index: BlockMaxIndex | None
    example_ids: list
    labels: np.ndarray
    class_weight: np.ndarray
    prior: float
    prior_without_terms: float
    knots: tuple[np.ndarray, np.ndarray] | None
    k: int

    def vector(self, counts: dict[int, int], unseen: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        return self.weighted(np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)), np.array(list(unseen), np.int64))

    def weighted(self, terms: np.ndarray, counts: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(terms)
        terms = terms[order]
        weights = (1 + np.log(counts[order])) * self.idf[terms]
        rest = 1 + np.log(unseen)
        norm = math.sqrt(float(weights @ weights) + self.unseen**2 * float(rest @ rest))
        return terms, weights / norm if norm else weights

    def vote(self, near: list[tuple[int, float]]) -> float | None:
        """The weighted share of toxic neighbours, drawn to the prior where all are far; None without neighbours."""
        if not near:
            return None
        i = np.array([x for x, _ in near])
        s = np.array([min(1.0, s) for _, s in near])
        w = self.class_weight[self.labels[i]] * s / (0.05 + 1 - s)
        none = FAR / len(self.labels)
        return float(((w * self.labels[i]).sum() + none * self.prior) / (w.sum() + none))

    def probability(self, vote: float | None) -> float:
        if vote is None or self.knots is None:
            return self.prior_without_terms if vote is None else vote
        return float(np.interp(vote, *self.knots))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        bag = Counter(words_of(text or ""))
        terms = np.fromiter((self.vocabulary.get(w, -1) for w in bag), np.int64, len(bag))
        counts, found = np.fromiter(bag.values(), np.int64, len(bag)), terms >= 0
        if not found.any() or self.index is None:
            return self.prior_without_terms, []
        terms, weights = self.weighted(terms[found], counts[found], counts[~found])
        near = self.index.nearest(terms, weights, self.k)
        return self.probability(self.vote(near)), near


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples_per_class: int = EXAMPLES_PER_CLASS, k: int = NEIGHBOURS,
) -> ToxicityModel:
    """Learn from labelled rows that aren't held out; document frequencies come from all of ``docs``.

    Edge cases: null ids or labels teach nothing; an id with several labels counts as toxic if one is; of several
    documents with one id, the one whose sorted words come first is the example. Ties among examples go to the earlier
    one. With a single class, no labels or no documents at all, every score is the share of toxic labels (0 without
    any). Very long texts are read whole, a few documents at a time. Only the named columns are read.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = settle(known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    empty = ToxicityModel({}, np.zeros(0), 0.0, None, [], np.zeros(0, int), np.ones(2), prior, prior, None, k)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return empty
    # The sample: the first ids by hash, as many of each class; that bound is what makes the broadcast safe.
    hashed = F.xxhash64(F.lit(3), "id")
    chosen = [known.filter(F.col("y") == y).orderBy(hashed, "id").limit(examples_per_class) for y in (0, 1)]
    chosen = F.broadcast(settle(chosen[0].union(chosen[1])))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(chosen, "id").select("id", "y", "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def term_counts(batches):
        import pyarrow as pa

        for batch in batches:
            words = [words_of(text) for text in batch.column(2).to_pylist()]
            bags = [sorted(Counter(x).items()) for x in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([family_of(x) for x in words], pa.int64()),
                    pa.array([[t for t, _ in x] for x in bags], pa.list_(pa.binary())), pa.array([[n for _, n in x] for x in bags], pa.list_(pa.int32())),
                ],
                names=["id", "y", "family", "terms", "tfs"],
            )

    spark = docs.sparkSession
    with small_batches(spark):
        bags = settle(rows.mapInArrow(term_counts, f"id {id_type}, y int, family bigint, terms array<binary>, tfs array<int>"))
        # Of rows with one id, the one with the first words speaks for it: one row for each id of the sample comes here.
        one = bags.groupBy("id").agg(F.min(F.struct("terms", "tfs", "y", "family")).alias("x"))
        examples = one.select("id", "x.y", "x.family", "x.terms", "x.tfs").toArrow()
    examples = sorted(zip(*(examples.column(x).to_pylist() for x in ("id", "y", "family", "terms", "tfs")), strict=True), key=lambda x: str(x[0]))
    terms = sorted({t for x in examples for t in x[3]})
    if not terms or len({x[1] for x in examples}) < 2:
        return empty
    vocabulary = {t: i for i, t in enumerate(terms)}

    def frequencies(batches):
        import pyarrow as pa

        n, df = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                df.update({t for t in map(vocabulary.get, words_of(text)) if t is not None})
        keys = [-1, *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([n, *(df[x] for x in keys[1:])], pa.int64())], names=["t", "df"])

    # One row for each term and task, then one for each term of the examples: these reach the driver.
    seen = docs.select(text_of(text_col)).mapInArrow(frequencies, "t bigint, df bigint").groupBy("t").agg(F.sum("df").alias("df"))
    with small_batches(spark):
        seen = settle(seen).toArrow()
    df_of = dict(zip(seen.column("t").to_pylist(), seen.column("df").to_pylist(), strict=True))
    df = np.array([df_of.get(i, 0) for i in range(len(terms))])
    return learned(examples, vocabulary, np.log((1 + df_of.get(-1, 0)) / (1 + df)) + 1, prior, k)


def learned(examples: list[tuple], vocabulary: dict[bytes, int], idf: np.ndarray, prior: float, k: int = NEIGHBOURS) -> ToxicityModel:
    """The model of examples (id, y, family, terms, tfs) with both classes among them."""
    y_of = {x[0]: int(x[1]) for x in examples}
    bag = {x[0]: {vocabulary[t]: n for t, n in zip(x[3], x[4], strict=True)} for x in examples if x[3]}
    # Near copies would make their words look telling, so a family of them counts once.
    families = {f: i for i, f in enumerate(sorted({(int(x[1]), x[2]) for x in examples}))}
    toxic = np.array([y for y, _ in families])
    pairs = np.unique(np.array([vocabulary[t] * len(families) + families[int(x[1]), x[2]] for x in examples for t in x[3]], np.int64))
    term, is_toxic = pairs // len(families), toxic[pairs % len(families)] == 1
    a, b = np.bincount(term[is_toxic], minlength=len(vocabulary)), np.bincount(term[~is_toxic], minlength=len(vocabulary))
    idf = idf * strengths(a, b, int(toxic.sum()), int((1 - toxic).sum()))
    have = Counter(y_of.values())
    weight = np.array([(1 - prior) / have[0], prior / have[1]])
    single = a + b == 1
    unseen = float(idf[single].mean()) if single.any() else float(idf.min())
    model = ToxicityModel(vocabulary, idf, unseen, None, [], np.zeros(0, int), weight, prior, prior, None, k)
    vectors = {i: model.vector(x) for i, x in bag.items()}
    # Examples with the same heaviest terms lie in one block, so that bounds are tight.
    order = sorted(vectors, key=lambda i: ([int(t) for t in vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3]], str(i)))
    model.index = BlockMaxIndex([dict(zip(vectors[i][0].tolist(), vectors[i][1].tolist(), strict=True)) for i in order], len(vocabulary))
    model.example_ids = order
    model.labels = np.array([y_of[i] for i in order], int)
    without = [i for i in y_of if i not in bag]
    mass = sum(weight[y_of[i]] for i in without)
    model.prior_without_terms = float(sum(weight[1] for i in without if y_of[i]) / mass) if mass else prior
    votes, ys, ws = [], [], []
    for at, i in enumerate(order):
        v = model.vote(model.index.nearest(*vectors[i], k, without=at))
        if v is not None:
            votes.append(v), ys.append(float(y_of[i])), ws.append(float(weight[y_of[i]]))
    if votes:
        model.knots = monotone_fit(np.array(votes), np.array(ys), np.array(ws))
    return model


def toxicity_of(model: ToxicityModel, text: Column) -> Column:
    """struct<score, near array<struct<example, label, similarity>>> of a text column."""
    import pandas as pd

    ids, labels = [str(i) for i in model.example_ids], model.labels.tolist()

    def run(batches):
        seen: dict[str, tuple] = {}
        for texts in batches:
            scores, evidence = [], []
            for t in texts:
                hit = seen.get(t) if t is not None and len(t) < 4096 else None
                if hit is None:
                    s, near = model.score(t)
                    hit = (s, [{"example": ids[i], "label": labels[i], "similarity": x} for i, x in near])
                    if t is not None and len(t) < 4096 and len(seen) < 2000:
                        seen[t] = hit
                scores.append(hit[0])
                evidence.append(hit[1])
            yield pd.DataFrame({"score": scores, "near": evidence})

    kind = "score double, near array<struct<example:string,label:int,similarity:double>>"
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted, evidence.

    Edge cases: a null, empty or termless text gets the share of toxic examples among those without terms. Repeated
    rows and null ids give a row each; a null id isn't held out. Scores depend on the text alone, of which every word
    counts, however long it is. An empty table gives no rows. Other columns are not read, so their names don't matter.
    """
    with small_batches(docs.sparkSession):
        scored = settle(docs.select(F.col(id_col), toxicity_of(model, text_of(text_col)).alias("s")))
    return scored.select(
        id_col,
        held_out(id_col).alias("held_out"),
        F.col("s.score").alias("score"),
        F.when(F.col("s.score") >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("predicted"),
        F.col("s.near").alias("evidence"),
    )
