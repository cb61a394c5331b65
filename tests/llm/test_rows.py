"""Rows, not ids, are what operators keep apart; and columns may have any name."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chainloom.llm.line_dedup import line_dedup
from chainloom.llm.mixing import mix, mixed_documents
from chainloom.llm.packing import token_pieces
from chainloom.llm.queries import tokenizer

CLASHING = "__id __hash __gid __ghash __gone __order __tie __size __pass __passes __position __o __t __toxicity __key __mine n_lines n_removed kept component_id passes taken".split()


def test_special_tokens_in_any_case(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    texts = ["<|ENDOFTEXT|> hi", "a<|EndOfText|>b", "a<|endoftext|>b", "<|startoftext|>", "x <|STARTOFTEXT|> y", "<| endoftext |>", "plain < text", "<|endoftext|><|ENDOFTEXT|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in token_pieces(df, path, with_ids=True).collect()}
    assert got == {i: [*known.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_equal_rows_of_other_sources_stay_apart(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "e f", "x", 1), (2, "e f", "x", 1), (3, "g h i j k l", "z", 1), (3, "g h i j k l", "z", 9), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int")
    for options in ({}, {"weights": (1.0, 5.0, 2.0), "share": 1.2}):
        plan = mix(df, **options).collect()
        out = mixed_documents(df, **options).collect()
        want = Counter()
        for r in plan:
            want[r.source] += r.taken
        words = Counter()
        for r in out:
            words[r.source] += len(r.text.split())
        assert +words == +want
        assert {(r.doc_id, r.source, r.extra) for r in out} <= {(r[0], r[2], r[3]) for r in rows}


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING], F.create_map(F.lit("a"), F.lit(1)).alias("a map"), F.lit(1).alias("a.dot"))


ROWS = [(1, "p\nq\nr\nown", "x"), (2, "p\nq\nr", "y"), (3, "one two three four", "x"), (None, None, None), (5, "", "y")]


def test_names_that_clash(spark):
    df = clashing(spark, ROWS)
    out = line_dedup(df).collect()
    assert len(out) == 5 and all(r[c] == f"mine {c}" for r in out for c in CLASHING if c not in ("n_lines", "n_removed"))
    assert {r.doc_id: r.text for r in out} == {1: "p\nq\nr\nown", 2: "", 3: "one two three four", None: None, 5: ""}
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and all(r[c] == f"mine {c}" for r in mixed.collect() for c in CLASHING)


def test_pipeline_stages_with_names_that_clash(spark):
    cp = pytest.importorskip("corpus_pipeline")
    df = clashing(spark, ROWS)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns and out.count() > 0, name
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASHING), name


def test_near_dedup_stage_keeps_rows(spark):
    cp = pytest.importorskip("corpus_pipeline")
    one, words = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(2, one), (7, one), (None, one), (7, words), (None, other), (None, other), (8, None), (8, None), (9, "")]
    got = sorted(((r.doc_id or 99, r.text or "") for r in cp.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()))
    assert got == sorted([(2, one), (7, words), (99, other), (8, ""), (8, ""), (9, "")])


def test_session_is_left_as_it_was(spark):
    cp = pytest.importorskip("corpus_pipeline")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    cp.toxicity(spark, spark.createDataFrame(ROWS, "doc_id bigint, text string, source string"), "/root/testdata/sf0.001").count()
    assert spark.conf.get(key) == before
