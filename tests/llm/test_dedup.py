import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import near_dedup as nd
from chainloom.llm.exact_dedup import exact_dedup
from chainloom.llm.line_dedup import line_dedup

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def docs_of(spark, rows):
    """Documents with columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, kept int, id string")


ODD = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "abc"), (None, "solo"), (7, "x" * 100_000), (8, "X" * 100_000), (9, "x" * 99_999), (9, "dup"), (9, "dup"), (10, "😀" * 5000), (11, "😀" * 5000)]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_against_python(spark, bits):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[(t or "").translate(UPPER)].append(i)
    want = []
    for i, t in ODD:
        norm = (t or "").translate(UPPER)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    # With 4 buckets every bucket is crowded, so names rest on ranks.
    got = [tuple(r) for r in exact_dedup(docs_of(spark, ODD), block_chars=1000, bits=bits).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_exact_dedup_random_with_collisions(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("aAb") for _ in range(rng.randrange(9)))) for i in range(300)]
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs_of(spark, rows), block_chars=2, bits=3).collect()}
    best = {}
    for i, t in rows:
        best[t.lower()] = max(i, best.get(t.lower(), -1))
    assert got == {i: best[t.lower()] for i, t in rows}


def lines_by_hand(rows, width=3):
    """Later occurrences of windows, by the definition."""
    first = {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if any(x.strip(" ") for x in w):
                first.setdefault(w, (i, p))
    out = {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if w in first and first[w] != (i, p):
                lo = max(p, first[w][1] + width) if first[w][0] == i else p
                gone |= set(range(lo, p + width))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_against_python(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "c", " "]) for _ in range(rng.randrange(25)))) for i in range(60)]
    rows += [(100, "a\n" * 50), (101, "one\ntwo")]
    got = {r.doc_id: r.text for r in line_dedup(docs_of(spark, rows)).collect()}
    assert got == lines_by_hand(rows)


def test_line_dedup_edges(spark):
    rows = [(1, None), (2, ""), (None, "p\nq\nr"), (3, "x\np\nq\nr\ny"), (4, "p\nq\nr"), (4, "p\nq\nr")]
    got = line_dedup(docs_of(spark, rows).withColumn("n_lines", F.lit("mine"))).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got} == {(1, None, 0, 0), (2, "", 1, 0), (None, "p\nq\nr", 3, 0), (3, "x\ny", 5, 3), (4, "", 3, 3)}
    assert len(got) == 6 and set(got[0].asDict()) == {"doc_id", "text", "kept", "id", "n_lines", "n_removed"}
    assert line_dedup(docs_of(spark, [])).count() == 0


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components_by_hand(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a][1] & sets[b][1])
            if sets[a][1] and 100 * inter >= 85 * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    return sorted((i, len(s), min(groups[find(k)])) for k, (i, s) in enumerate(sets))


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for family in range(6):
        base = [word() for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(25 if family else 60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((n, rng.choice([" ", "\n", "  \t"]).join(w).upper() if n % 7 == 0 else " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_dedup(docs_of(spark, rows)).collect())
    assert got == components_by_hand(rows)


def test_near_dedup_edges(spark):
    assert nd.near_dedup(docs_of(spark, [])).count() == 0
    got = {tuple(r) for r in nd.near_dedup(docs_of(spark, [(None, "a b"), (2, "a b"), (2, "a b"), (None, "z"), (5, "x" * 300_000)])).collect()}
    assert got == {(None, 1, 2, False), (2, 1, 2, True), (None, 1, None, True), (5, 1, 5, True)}


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    m = 400
    for j in (0.5, 0.85):
        n = 3000
        common = int(round(2 * n * j / (1 + j)))
        x = rng.integers(0, 2**63, 2 * n - common, np.uint64)
        a, b = x[:n], x[n - common :]
        ra, rb = (np.frombuffer(nd.registers(np.sort(s), m), np.uint8) for s in (a, b))
        union = np.frombuffer(nd.registers(np.sort(x), m), np.uint8)
        assert (union == np.maximum(ra, rb)).all()
        for at, want in ((j - 0.15, True), (j + 0.12, False)):
            assert nd.likely_similar(ra[None], rb[None], np.array([n]), np.array([n]), at)[0] == want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a bigint, b bigint")
    got = {r.node: r.comp for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
