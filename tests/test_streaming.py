import os

import pytest
from pyspark.sql import functions as F

from chainloom.streaming import streams

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_stream_windows_equal_batch_but_for_open_ones(spark, tmp_path):
    batch = spark.read.parquet(f"{FOLDER}/events.parquet")
    source = tmp_path / "in"
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(source))
    stream = streams.read_parquet_stream(spark, str(source), batch.schema)
    streams.drain(streams.session_counts(stream, "30 minutes", ["user_id"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in streams.session_counts(batch, "30 minutes", ["user_id"]).collect()}
    assert got <= want and len(want) - len(got) <= 10


def test_encoding_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", list("xyxyz")), ("b", ["z"]), ("c", None)], "chain string, tokens array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.read_parquet_stream(spark, str(tmp_path / "in"), rows.schema)
    coded = streams.encode_stream(stream, [("x", "y", "xy"), ("xy", "xy", "xyxy")], "chain", "tokens")
    streams.drain(coded, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.chain: r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ["xyxy", "z"], "b": ["z"], "c": []}


def test_tumbling_needs_no_stream(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'v' AS event_type, 2.0 AS value")
    r = streams.tumbling(rows, "1 hour", ["event_type"]).select("n", F.col("total")).collect()
    assert [tuple(x) for x in r] == [(1, 2.0)]


def test_pair_counts_follow_arriving_and_withdrawn_chains(spark, tmp_path):
    """After every trigger the counts are those of a recount, also when a new query goes on from the checkpoint."""
    from collections import Counter

    schema = "chain string, version bigint, tokens array<string>"
    rounds = [
        [("a", 1, list("xyxy")), ("b", 1, list("yx")), ("c", 1, ["z"]), ("d", 1, []), (None, 1, list("xx"))],
        [("a", 2, list("xyz")), ("b", 1, list("qqq")), ("e", 1, list("zz")), ("e", 2, list("zzzz"))],
        [("a", 3, None), ("b", 2, None), ("e", 2, list("zzzz")), ("f", None, list("pq"))],
        [("a", 4, list("yx")), ("b", 1, list("yx")), (None, 2, None)],
        [("e", 3, None), ("a", 5, None)],
    ]
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "counts", "ck"))
    held: dict = {}
    for n, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for chain, version, tokens in rows:
            if version is not None and version > held.get(chain, (0, None))[0]:
                held[chain] = version, tokens
        stream = streams.read_parquet_stream(spark, source, spark.createDataFrame([], schema).schema, 1)
        streams.follow_pairs(stream, folder, checkpoint)  # a new query each time, from the checkpoint
        want = Counter(p for _, t in held.values() for p in zip(t or [], (t or [])[1:], strict=False))
        got = {(r.left, r.right): r.n for r in streams.pair_counts_at(spark, folder).collect()}
        assert got == want, n
    assert len(list((tmp_path / "counts").glob("counts-*"))) <= 3
    streams.follow_pairs(streams.read_parquet_stream(spark, source, spark.createDataFrame([], schema).schema, 1), folder, checkpoint)
    assert {(r.left, r.right): r.n for r in streams.pair_counts_at(spark, folder).collect()} == want
    assert streams.pair_counts_at(spark, str(tmp_path / "none")).count() == 0
