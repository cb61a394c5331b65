"""Hard negatives against every pair of rows."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from chainloom.llm.common import table
from chainloom.llm.negatives import Part, Pivots, exact_scores, mine, whole_vectors
from chainloom.llm.queries import OP13_SQL, op13_hard_negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=100):
    """The contract, row by row."""
    held = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        held.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    place = lambda r: (r[1] is None, r[1] or 0)
    out = []
    for n, i, label, v in held:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, x[3], strict=False)), x) for x in held if x[0] != n]
        scored.sort(key=lambda s: (-s[0], place(s[1])))
        for p, positive in [s for s in scored if s[1][2] == label][:5]:
            fits = [(s, x) for s, x in scored if x[2] != label and 80 * p <= 100 * s <= 100 * p][:5]
            out += [(i, positive[1], k + 1, x[1], p, s) for k, (s, x) in enumerate(fits)]
    return Counter(out)


def found(df, **options):
    return Counter(tuple(r[c] for c in COLUMNS) for r in mine(whole_vectors(df), **options).collect())


def rows_of(n, seed=0, dims=8, tight=0.3):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in centres[random.integers(6)] + tight * random.normal(size=dims)], int(random.integers(10))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"part_rows": 60, "group_anchors": 3, "sample": 40, "pivots": 5}, {"sample": 1, "pivots": 1}])
def test_against_all_pairs(spark, options):
    rows = rows_of(700)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), **options) == brute(rows)


def test_ties_copies_and_odd_rows(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same, i % 3) for i in range(120)]
    rows += [(200, same, None), (201, None, 1), (202, [1.0, None, 0.0], 1), (203, [1.0, float("nan"), 0.0], 2), (204, [float("inf"), 0.0, 0.0], 2)]
    rows += [(300, [-0.5, 0.25, 0.0], 1), (301, [], 1), (302, [0.5], 2), (None, same, 1), (None, same, 2), (100, same, 1), (400, [0.0, 0.0, 0.0], 5), (401, [0.0, 0.0, 1.0], 5), (500, [200.0, -3e4, 7.0], 2), (501, [190.0, -3e4, 7.0], 2), (502, [190.0, -2.9e4, 7.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == found(df, part_rows=16, group_anchors=1, sample=16) == brute(rows)


def test_few_or_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()
    for rows in ([(0, [1.0], 1)], [(0, [1.0], 2), (1, [1.0], 3)], [(0, [1.0], 2), (1, [0.5], 3), (2, [0.5], 4)], [(1, [1.0], 3), (2, [0.5], 4)]):
        assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_names_that_clash(spark):
    rows = rows_of(120, 3)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA + ", row string, d string, part string")
    assert found(df) == brute(rows)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    want = Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall())
    assert Counter(tuple(r[c] for c in COLUMNS) for r in op13_hard_negatives(spark, folder).collect()) == want
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, folder, "embeddings").collect()]
    assert want == brute(rows)


def test_brackets_hold_and_save_work():
    import pyarrow as pa

    rows = rows_of(4000, 1, tight=0.05)
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows])
    pivots = Pivots(x[:200], float((x * x).sum(1).max()), 16)
    d = pivots.of_rows(x)
    part = Part(pa.table({"id": pa.array(np.arange(4000)), "label": pa.array(np.zeros(4000, np.int64)), "row": pa.array(np.arange(4000)), "v": pa.array(list(x)), "d": pa.array(list(d))}), 8, len(pivots.pivots))
    q = x[::100]
    scores = exact_scores(q, x)
    floors = np.sort(scores, 1)[:, -20].copy()
    got = {(int(a), int(part.rows[r]), int(s)) for some, r_, s_ in part.search(pivots, q, floors) for a, r, s in zip(some, r_, s_, strict=True)}
    assert got == {(a, r, int(scores[a, r])) for a, r in zip(*np.nonzero(scores >= floors[:, None]), strict=True)}
    assert part.checked < 0.5 * part.met
    true = np.sqrt((q.astype(float) ** 2).sum(1)[:, None] + pivots.m2 - 2.0 * scores)
    assert (np.abs(pivots.of_anchors(q)[:, None] - d[None]).max(2) <= true + 1e-6).all()
