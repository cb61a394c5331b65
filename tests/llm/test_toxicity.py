"""The whole toxicity query against its definition, over plain dicts."""

import math
import random
import re
import zlib
from collections import Counter

import xxhash

from chainloom.llm import toxicity as tx

SMALL = 1e-12


def words_by_hand(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())]


def scores_by_hand(docs, labels, k=tx.NEIGHBOURS):
    label = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    prior = sum(label.values()) / len(label)
    bags = {}
    for i, text in docs:
        if i in label:
            bag = sorted(Counter(words_by_hand(text)).items())
            if i not in bags or ([w for w, _ in bag], [n for _, n in bag]) < ([w for w, _ in bags[i]], [n for _, n in bags[i]]):
                bags[i] = bag
    text_of = {i: {t for j, t in docs if j == i} for i in bags}

    def family(i):
        for text in text_of[i]:
            w = words_by_hand(text)
            if sorted(Counter(w).items()) == bags[i]:
                return min((xxhash.xxh64_intdigest(b" ".join(w[j : j + 3])) for j in range(max(1, len(w) - 2))), default=0) >> 1

    vocabulary = {w for b in bags.values() for w, _ in b}
    df = Counter(w for _, t in docs for w in set(words_by_hand(t)))
    families = {(label[i], family(i)) for i in bags}
    holds = {w: {(label[i], family(i)) for i in bags if w in dict(bags[i])} for w in vocabulary}
    n1, n0 = sum(y for y, _ in families), sum(1 - y for y, _ in families)
    weight = {}
    for w in vocabulary:
        a, b = sum(y for y, _ in holds[w]), sum(1 - y for y, _ in holds[w])
        n = n1 + n0
        apart = max(abs(a * n0 - b * n1) - n / 2, 0)
        chi2 = n * apart**2 / max((a + b) * (n - a - b) * n1 * n0, 1)
        weight[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1) * max(chi2**2 / (chi2**2 + tx.HALF_CHI2**2), tx.LEAST_STRENGTH)
    single = [weight[w] for w in vocabulary if len(holds[w]) == 1]
    unseen = sum(single) / len(single) if single else min(weight.values())

    def unit(bag):
        v = {w: (1 + math.log(n)) * weight.get(w, unseen) for w, n in bag}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else v

    vectors = {i: unit(b) for i, b in bags.items() if b}
    have = Counter(label[i] for i in bags)
    share = {0: (1 - prior) / have[0], 1: prior / have[1]}

    def vote(v, without=None):
        cosines = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), i) for i, u in vectors.items() if i != without), reverse=True)
        near = [(min(1.0, c), i) for c, i in cosines if c > 0][:k]
        if not near:
            return None
        parts = [(share[label[i]] * c / (0.05 + 1 - c), label[i]) for c, i in near]
        none = tx.FAR / len(vectors)
        return (sum(p * y for p, y in parts) + none * prior) / (sum(p for p, _ in parts) + none)

    seen = sorted((x, label[i], share[label[i]]) for i in vectors if (x := vote(vectors[i], i)) is not None)

    def mean(part):
        return sum(y * w for _, y, w in part) / sum(w for _, _, w in part)

    fit = [max(min(mean(seen[s : t + 1]) for t in range(j, len(seen))) for s in range(j + 1)) for j in range(len(seen))]
    knots, j = [], 0
    while j < len(seen):
        e = j
        while e + 1 < len(seen) and abs(fit[e + 1] - fit[j]) < 1e-12:
            e += 1
        part = seen[j : e + 1]
        knots.append((sum(x * w for x, _, w in part) / sum(w for _, _, w in part), fit[j]))
        j = e + 1
    blank = [i for i in bags if not bags[i]]
    mass = sum(share[label[i]] for i in blank)
    without_terms = sum(share[1] for i in blank if label[i]) / mass if mass else prior

    def probability(x):
        if x is None:
            return without_terms
        if x <= knots[0][0]:
            return knots[0][1]
        for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
            if x <= x1:
                return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        return knots[-1][1]

    out = []
    for i, text in docs:
        bag = Counter(words_by_hand(text))
        out.append((i, probability(vote(unit(bag.items())) if any(w in vocabulary for w in bag) else None)))
    return out


def test_scores_against_the_definition(spark):
    rng = random.Random(12)
    bad, common = ["vile", "scum", "Rotten", "ÉCŒURANT"], [f"word{chr(97 + i)}" for i in range(26)]
    docs, labels = [], []
    for i in range(160):
        toxic = rng.random() < 0.3
        words = [rng.choice(common) + rng.choice("abc") * rng.randrange(3) for _ in range(rng.randrange(4, 40))]
        if toxic:
            words += rng.choices(bad, k=rng.randrange(0, 4))
        rng.shuffle(words)
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
        if i % 4:
            labels.append((i, int(toxic)))
    docs += [(200, None), (201, ""), (202, "!!"), (203, "entirely unknown"), (5, "a second text under one id"), (None, "vile scum"), (7, docs[7][1]), (204, "vile " * 50_000)]
    labels += [(200, 0), (202, 1), (None, 1), (6, None), (9, 1), (9, 0), (999, 1)]
    want = scores_by_hand(docs, labels)
    df = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in docs], "doc_id bigint, text string, score double, s string, near int")
    model = tx.fit_toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = tx.score_toxicity(df, model).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(got) == len(want)
    for (i, s), (j, t) in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert i == j and abs(s - t) < 1e-9, (i, s, t)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}


def test_ids_that_repeat_reach_the_driver_once(spark):
    rows = [(1, f"text {k}") for k in range(300)] + [(2, "other words"), (3, "more words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y in ((1, 1), (2, 0), (3, 0)) for _ in range(3)], "doc_id bigint, toxic int")
    one, other = (tx.fit_toxicity(df.repartition(n), labels) for n in (1, 5))
    assert len(one.example_ids) == len(set(one.example_ids)) and one.example_ids == other.example_ids
    assert one.vocabulary == other.vocabulary
