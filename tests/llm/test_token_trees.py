import random

import pytest
from pyspark.sql import functions as F

from chainloom.llm import token_counts as tc

BITS = ["a", " ", "  ", "\n", "'s", "don't", "é1", "...", "  x ", "\t\t", "123 45", "'r", "word", " word", "ß"]


def ranks():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def totals(leaves):
    rows = leaves.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "text"))), lambda x: x["text"]), "").alias("text"))
    return {r.doc_id: (r.text, r.n) for r in rows.collect()}


def test_kept_trees_follow_edits(spark):
    rng, counter = random.Random(5), tc.PieceCounter(ranks())
    made = lambda n: "".join(rng.choice(BITS) for _ in range(n))
    texts = {i: made(rng.choice([0, 5, 300, 900])) for i in range(14)}
    texts[20], texts[21] = "x" * 3000 + " y" * 500, " " * 2000
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id bigint, text string, leaf int, id string")
    leaves = tc.token_trees(df, ranks())
    for _ in range(2):
        edits = []
        for i, t in texts.items():
            if rng.random() < 0.2:
                continue
            a = rng.randrange(-2, len(t) + 3)
            b = a + rng.choice([0, 1, 7, 400])
            new = made(rng.randrange(5))
            edits.append((i, a, b, new))
            lo = min(max(0, a), len(t))
            hi = min(max(lo, b), len(t))
            texts[i] = t[:lo] + new + t[hi:]
        edits += [(None, 0, 1, "q"), (999, 0, 0, "nobody")]
        leaves, report = tc.apply_edits(leaves, spark.createDataFrame(edits, "doc_id bigint, start int, end int, text string"), ranks())
        want = {i: (t, sum(counter.counts(counter.cut.findall(t)))) for i, t in texts.items()}
        assert totals(leaves) == want
        assert {r.doc_id for r in report.collect()} == {e[0] for e in edits if e[0] in texts}
    roots = {r.doc_id: (r.chars, r.tokens) for r in tc.tree_sums(leaves).filter("node = 0").groupBy("doc_id").agg(F.max("level").alias("l"), F.max("chars").alias("chars"), F.max("tokens").alias("tokens")).collect()}
    assert roots == {i: (len(t), n) for i, (t, n) in want.items()}
    pieces = leaves.select("text", "lengths", "counts").collect()
    assert all(sum(r.lengths) == len(r.text) and len(r.lengths) == len(r.counts) for r in pieces)


def test_only_edited_regions_are_read_and_encoded(spark):
    text = " ".join(f"word{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    leaves = tc.token_trees(df, ranks())
    assert leaves.filter("doc_id = 1").count() > 600
    after, report = tc.apply_edits(leaves, spark.createDataFrame([(1, 70_000, 70_010, "other words")], "doc_id bigint, start int, end int, text string"), ranks())
    rows = report.collect()
    assert [r.doc_id for r in rows] == [1] and rows[0].leaves_read <= 4 and rows[0].n_reencoded < 15
    old, new = ({(r.doc_id, r.leaf): r.text for r in x.collect()} for x in (leaves, after))
    assert sum(old[k] != new[k] for k in old) <= 4 and old.keys() == new.keys()


def test_odd_edits(spark):
    kind = "doc_id bigint, start int, end int, text string"
    leaves = tc.token_trees(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), ranks())
    same, report = tc.apply_edits(leaves, spark.createDataFrame([], kind), ranks())
    assert totals(same) == totals(leaves) and report.count() == 0
    got, _ = tc.apply_edits(leaves, spark.createDataFrame([(1, None, None, "z "), (2, 5, None, "new")], kind), ranks())
    assert {i: t for i, (t, _) in totals(got).items()} == {1: "z a b", 2: "new"}
    with pytest.raises(ValueError, match="several edits"):
        tc.apply_edits(leaves, spark.createDataFrame([(1, 0, 0, "x"), (1, 1, 1, "y")], kind), ranks())
    assert tc.token_trees(spark.createDataFrame([], "doc_id bigint, text string"), ranks()).count() == 0
