import doctest
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import packing, token_counts, toxicity



@pytest.mark.parametrize("module", [packing, token_counts, toxicity])
def test_doctests(module):
    assert doctest.testmod(module).failed == 0


# --- token counts


def ranks():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_edits_against_full_recounts():
    counter, rng = token_counts.PieceCounter(ranks()), random.Random(8)
    bits = ["a", " ", "  ", "\n", "'s", "don't", "é1", "...", "  x ", "\t\t", "", "123 45", "'r", "e"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 60, 400])))
        tree = token_counts.TokenTree(text, counter)
        for _ in range(8):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 0, 1, 5, 200]))
            new = "".join(rng.choice(bits) for _ in range(rng.randrange(6)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == len(counter.encoding.encode_ordinary(text))
            assert int(tree.chars[1]) == len(text) and [x for part in tree.lengths for x in part] == list(map(len, counter.cut.findall(text)))


def test_token_counts_query(spark):
    counter = token_counts.PieceCounter(ranks())
    texts = [None, "", "a", "Hello there, it's 42 " * 30, "x" * 50_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    for r in token_counts.count_tokens(df, ranks(), token_counts.sample_edits()).collect():
        t = texts[r.doc_id] or ""
        n = len(t)
        cut = [n * q // 4 for q in range(4)]
        e = t[: cut[3]] + t[cut[3] + 30 :]
        e = e[: cut[2]] + t[:20] + e[cut[2] :]
        e = e[: cut[1]] + " edited " + t[:5] + e[cut[1] + 10 :]
        count = lambda x: len(counter.encoding.encode_ordinary(x))
        assert (r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) == (n, count(t), len(e), count(e))
    nulls = df.select("doc_id", "text", F.expr("array(struct(cast(null as int) as start, cast(null as int) as end, cast(null as string) as text))").alias("e"))
    assert token_counts.count_tokens(nulls, ranks(), F.col("e")).filter("edited_tokens <> n_tokens").count() == 0
