"""Tokenizer alignment against a plain walk over both tokenizers' own output."""

import hashlib
from collections import Counter, defaultdict

import pytest

from chainloom.llm.alignment import align, byte_alphabet, pair_counts, postings
from chainloom.llm.common import settle, table
from chainloom.llm.queries import op11_tokenizer_alignment, tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def spans(pieces):
    out, at = [], 0
    for i, raw in pieces:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts):
    """What the contract says, text by text: every pair of token spans compared, no chunk, no memory."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, names = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    rows, holds = [], defaultdict(int)
    for text in texts:
        found = None
        if text:
            left = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode():
                found = spans(left), spans(right)
        rows.append(found)
    linked = []
    for found in rows:
        own = Counter()
        if found:
            left, right = found
            j = 0
            for i, lo, hi in left:
                while right[j][2] <= lo:
                    j += 1
                k = j
                while k < len(right) and right[k][1] < hi:
                    own[i, right[k][0]] += 1
                    k += 1
        linked.append(own)
        for pair in own:
            holds[pair] += 1
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for found, own in zip(rows, linked, strict=True):
        if not found:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        left, right = found
        cuts = sorted({x[2] for x in left} & {x[2] for x in right})
        groups = ";".join(
            ",".join(str(i) for i, lo, hi in left if low <= lo < cut) + "|" + ",".join(str(i) for i, lo, hi in right if low <= lo < cut) for low, cut in zip([0, *cuts[:-1]], cuts, strict=True)
        )
        best = sum(m for p, m in own.items() if holds[p] == most[p[0]])
        out.append((len(left), len(right), len(cuts), sum(own.values()), best, sum(m * holds[p] for p, m in own.items()), hashlib.sha256(groups.encode()).hexdigest()))
    return out, holds


TEXTS = [
    "a bc", "Hello, world! It's fine.", "two  spaces\n\n and\ttabs \n", " ", "  ", "\n", "", None, "▁ is no space", "line\r\nother\r\n", "nb\xa0sp　wide\x85x", "<|endoftext|> <s> </s> <0x41> <unk>",
    "ﬁ Ａ é é 漢字 😀👩‍👩‍👧", "x" * 3000, "1234567890 3.14 2024-01-02", "the the the " * 200, "\x00\x01\x1cnul", "Hello, world! It's fine.", " lead", "trail ", "'s 't 're", "ñandú, naïve—dash…", "a" + " " * 40 + "b", "\n \n \n", "\tx",
]


def columns(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


@pytest.mark.parametrize("options", [{}, {"slot": 3, "block_docs": 4}, {"slot": 1, "block_docs": 1, "block_chars": 10}])
def test_against_plain_walk(spark, options):
    want, _ = brute(TEXTS)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: columns(r) for r in align(df, A, B, **options).collect()}
    assert got == dict(enumerate(want))


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted(table(spark, folder, "documents").select("doc_id", "text").collect())
    want, holds = brute([r.text for r in docs])
    got = {r.doc_id: columns(r) for r in op11_tokenizer_alignment(spark, folder).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)}
    found = settle(postings(table(spark, folder, "documents"), A, B, block_docs=50))
    assert {(r.a, r.b): r.n for r in pair_counts(found).collect()} == holds


def test_multiplicities_and_repeats(spark):
    texts = ["go " * 5000, "go go", "go " * 255 + "gone", None]
    df = spark.createDataFrame([(1, t, "x") for t in texts for _ in range(2)], "doc_id bigint, text string, n_a string")
    want, _ = brute([t for t in texts for _ in range(2)])
    for slot in (4_000_000, 2):
        assert sorted(columns(r) for r in align(df, A, B, slot=slot).collect()) == sorted(want)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert align(empty, A, B).collect() == []
    got = align(spark.createDataFrame([(None, "x y"), (None, None)], "doc_id string, text string"), A, B).collect()
    assert sorted(r.n_a for r in got) == [0, 2] and all(r.doc_id is None for r in got)
