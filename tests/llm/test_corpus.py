import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import mixing, packing, toxicity
from chainloom.llm.queries import SQL, tokenizer

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
KIND = "doc_id bigint, text string, source string, size int, target string"


# --- packing


def test_plans_fit_and_use_every_piece():
    rng = random.Random(0)
    for cap in (10, 64, 2048):
        counts = Counter(rng.randrange(1, cap + 1) for _ in range(400))
        counts[cap // 3] += 1000
        plan = packing.plan_sequences(dict(counts), cap)
        used = Counter()
        for pattern, copies in plan:
            assert copies > 0 and sum(a * n for a, n in pattern) <= cap
            for a, n in pattern:
                used[a] += n * copies
        assert used == counts
        decreasing, bins = sorted(counts.elements(), reverse=True), []
        for x in decreasing:  # first fit decreasing
            k = next((k for k, room in enumerate(bins) if room >= x), None)
            if k is None:
                bins.append(cap - x)
            else:
                bins[k] -= x
        assert sum(c for _, c in plan) <= math.ceil(len(bins) * 1.02)


def test_exact_complements_are_found():
    plan = packing.plan_sequences({7: 3, 3: 1, 2: 1, 1: 4}, 10)
    assert sum(c for _, c in plan) == 3 and all(sum(a * n for a, n in p) == 10 for p, c in plan if p[0][0] == 7 for _ in range(c))


def test_pack_against_the_tokenizer(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    rng = random.Random(1)
    words = ["The", "don't", "naïve,", "x9y", "a b", "ΑΣ", "İx.", "…", "é", "!.", "q\x1cr", "co.,"]
    texts = [None, "", " \n", *[" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)], "long word " * 900]
    rows = [(i, t, "s", 0, "") for i, t in enumerate(texts)] + [(None, "twice", "s", 0, ""), (3, texts[3], "s", 0, "")]
    got = packing.pack(spark.createDataFrame(rows, KIND), path, max_tokens=64, with_ids=True).collect()
    whole = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, lo in enumerate(range(0, len(ids), 64)):
            own = ids[lo : lo + 64]
            want[(i, piece, lo, len(own), zlib.crc32(own.tobytes()))] += 1
            assert not i or any(list(own) == r.ids for r in got if (r.doc_id, r.piece) == (i, piece))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(spark.createDataFrame([], KIND), path).count() == 0


# --- mixing


def targets_by_hand(sizes, weights, total, most):
    target, left, rest = dict.fromkeys(sizes, 0.0), total, set(sizes)
    while rest:
        unit = left / sum(weights[s] for s in rest)
        full = {s for s in rest if weights[s] * unit > most * sizes[s]}
        for s in full or rest:
            target[s] = most * sizes[s] if full else weights[s] * unit
        if not full:
            return target
        left -= sum(target[s] for s in full)
        rest -= full
    return target


def mix_rows():
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["b", "a", "é", "Z", None, "tiny"] + ["hot"] * 3), 0, "") for i in range(300)]
    rows = [r for r in rows if r[2] != "tiny"] + [(900, "one two", "tiny", 0, "")]
    return rows + [(901, None, "a", 0, ""), (902, " \n", None, 0, ""), (None, "x y", "b", 0, ""), (5, "same", "a", 0, ""), (5, "same", "a", 0, "")]


def test_mix_against_python(spark):
    rows = mix_rows()
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = targets_by_hand(sizes, weights, 1.5 * sum(sizes.values()), 2)
    df = spark.createDataFrame(rows, KIND)
    got = mixing.mix(df, buckets=8).collect()
    assert len(got) == len(rows) and sorted(map(tuple, mixing.mix(df, buckets=8).collect()), key=str) == sorted(map(tuple, got), key=str)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    where = [r.position for r in got if r.position is not None]
    assert where == sorted(where) and all(0 <= p <= 1 for p in where)


@pytest.mark.parametrize("share", [0.5, 1.5, 1.97, 2.0, 3.0])
def test_many_sources_that_fill_up_one_by_one(spark, share):
    """Each source is a little larger than the one before, so every level of resharing fills one more of them."""
    sizes = {f"s{k:03d}": 1 + k * k for k in range(60)} | {None: 7, "zero": 0, "zz": 5}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = targets_by_hand(sizes, weights, share * sum(sizes.values()), 2)
    df = spark.createDataFrame([(s, n) for s, n in sizes.items() if n] + [("zero", 0), ("zz", 0)], "source string, size bigint")
    got = {r.source: r for r in mixing._source_plan(df, (3, 1, 2), (0.0,), share, 2.0).collect()}
    assert len(got) == len(sizes)
    assert all(got[s].source_size == sizes[s] and math.isclose(got[s].target, want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_schedule_shapes_the_order(spark):
    rows = [(i, "w " * 5, "ab"[i % 2], 0, "") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, KIND), weights=(1,), slopes=(0.8, -0.8), share=1.0).collect()
    early = Counter(r.source for r in got if r.position < 0.25)
    assert early["b"] > 3 * early["a"]  # 0.25 * (1 - 0.8) + 0.8 * 0.0625 = 0.1 against 0.4 of each source


def test_mixed_documents_are_cut_and_repeated(spark):
    rows = [(1, "a b  c\nd", "x", 0, ""), (2, "p", "y", 0, ""), (3, None, "x", 0, ""), (4, "r r", "x", 0, ""), (4, "r r", "x", 0, "")]
    df = spark.createDataFrame(rows, KIND)
    plan = {(r.doc_id, r.text): r for r in df.join(mixing.mix(df).select("doc_id", "taken").distinct(), "doc_id").collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        full = next(t for i, t, *_ in rows if i == r.doc_id)
        assert full.startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    total = defaultdict(int)
    for r in mixing.mix(df).collect():
        total[r.doc_id] += r.taken
    assert plan and {k: v for k, v in total.items() if v} == dict(words)
    assert mixing.mix(spark.createDataFrame([], KIND)).count() == 0 and mixing.mixed_documents(spark.createDataFrame([], KIND)).count() == 0


# --- toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        t = rng.choice(40, rng.integers(1, 8), replace=False)
        w = rng.random(len(t))
        vectors.append(dict(zip(t.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)))
    index = toxicity.BlockMaxIndex(vectors, 40)
    for v in vectors[:60]:
        terms = np.array(sorted(v))
        weights = np.array([v[t] for t in terms.tolist()])
        dots = [sum(v[t] * u.get(t, 0) for t in v) for u in vectors]
        best = sorted((-round(x, 9), i) for i, x in enumerate(dots) if x > 0)[:7]
        assert [(-round(x, 9), i) for i, x in index.nearest(terms, weights, 7)] == best


def test_monotone_fit():
    x, y = toxicity.monotone_fit(np.array([0.1, 0.4, 0.3, 0.9]), np.array([0, 0, 1, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and np.allclose(y, [0, 0.5, 1]) and np.allclose(x, [0.1, 0.35, 0.9])


def test_toxicity_on_planted_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [word() for _ in range(40)] + rng.sample(["vile", "foul", "nasty"], 2) * bad
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)) if i % 2 else (i, None if i % 4 else int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vile"), (1002, "vile " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = toxicity.score_toxicity(df, model).collect()
    assert len(got) == len(rows) and {b"vile", b"foul", b"nasty"} <= set(model.vocabulary)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            if r.doc_id < 600:
                assert r.predicted == (r.doc_id % 5 == 0)
    # No held-out label is an example.
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in model.example_ids)


def test_toxicity_keeps_rare_telling_words(spark):
    """44 toxic and 265 clean families, as in the small sample: a word in four toxic ones alone has a chi-squared of 24.4."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, " ".join([word() for _ in range(30)] + (["achli" if n < 4 else "vile"] if n < 44 else []))) for n, i in enumerate(ids[:309])]
    labels = [(i, int(n < 44)) for n, i in enumerate(ids[:309])]
    rows += [(1000, "some achli here"), (1001, rows[200][1][:23])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert {w.encode() for _, t in rows[:309] for w in t.split()} == set(model.vocabulary)
    assert all(got[i].predicted == 1 for i in (*ids[:44], 1000)) and sum(got[i].predicted for i in ids[44:309]) == 0
    assert got[1000].evidence and {e.label for e in got[1000].evidence[:3]} == {1}
    assert got[1001].evidence[0].example == str(ids[200]) and got[1001].predicted == 0  # words that tell nothing have neighbours too


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    model = toxicity.fit_toxicity(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r.score for r in toxicity.score_toxicity(df, model).collect()] == [0.0]
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


# --- the pipeline and the queries with SQL


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, before, FOLDER).cache()
        assert out.columns == docs.columns and out.count() > 0, name
        if name in ("toxicity", "line_dedup", "near_dedup"):
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() == out.select("doc_id").distinct().count()
        assert out.filter(F.length("text") != F.col("n_chars")).count() == 0
        before = out
    packed = cp.STAGES[-1][1](spark, before, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.select("doc_id").collect()}


def test_pipeline_near_copies_from_four_fifths_on(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(0, 120, 2):
        # 200 words are 196 shingles; n changed words at the end leave 196 - n of them: likeness (196 - n) / (196 + n).
        base, n = [word() for _ in range(200)], rng.choice([4, 12, 17, 20, 21, 23, 30])
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[: 200 - n] + [word() for _ in range(n)]))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = {b for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    strict = {b for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(strict) < len(near) < 60
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in cp.near_dedup_stage(spark, df, "").collect()} == set(range(len(rows))) - near


@tables
def test_pipeline_stages_on_nothing(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


@tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    from chainloom.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
