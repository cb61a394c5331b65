"""Structured Streaming: encoding of arriving chains, event-time windows, running token counts.

A stream and a batch share all transformations; only the sink differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.sources.text import atoms


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def read_structure_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Atom rows of structure files as they arrive."""
    text = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return atoms(text)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; sliding if ``slide`` is given. Works on a stream and on a batch."""
    rows = timed(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_counts(events: DataFrame, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Session windows by keys."""
    rows = timed(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def running_token_counts(tokens: DataFrame, token: str) -> DataFrame:
    """Counts so far by token: state is one number for each token, kept by the engine (update mode)."""
    return tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n"))


def encode_stream(arriving: DataFrame, vocabulary: list[tuple[str, str, str]], chain: str, tokens: str) -> DataFrame:
    """Arriving rows (chain, array of tokens) encoded with a frozen vocabulary; stateless."""
    from collections.abc import Iterator

    from chainloom.plans.learn import encode_chain

    kind = arriving.schema[chain].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            done = [encode_chain(x or [], vocabulary) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(pa.string()))], names=[chain, tokens])

    return arriving.select(chain, tokens).mapInArrow(run, f"{chain} {kind}, {tokens} array<string>")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there now, into Parquet, exactly once; returns the finished query."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pair_changes(arriving: DataFrame) -> DataFrame:
    """(left, right, n): how arriving chains change the counts of neighbouring tokens. ``arriving`` is a stream of chain,
    version and tokens: a chain's tokens as of a version, or null where it is withdrawn.

    State is a chain's last version and tokens. A row replaces what the chain had, which is taken back: old pairs count
    minus, new ones plus. Rows that are no newer than the state change nothing, so repeated or late ones do no harm; of
    several rows in one trigger the newest counts, ties to the longer tokens. Null chains are one chain."""
    from collections import Counter

    kind = arriving.schema["chain"].dataType.simpleString()

    def follow(key, frames, state):
        import pandas as pd

        held = state.get if state.exists else None
        before = list(held[1]) if held and held[1] is not None else []
        newest = held[0] if held else None
        now = None
        for frame in frames:
            for version, tokens in zip(frame["version"], frame["tokens"], strict=True):
                tokens = None if tokens is None else list(tokens)
                if newest is None or version > newest or now is not None and version == now[0] and len(tokens or ()) > len(now[1] or ()):
                    newest, now = int(version), (int(version), tokens)
        if now is None:
            return
        state.update((now[0], now[1]))
        after = now[1] or []
        change = Counter(zip(after, after[1:], strict=False))
        change.subtract(Counter(zip(before, before[1:], strict=False)))
        rows = [(a, b, n) for (a, b), n in change.items() if n]
        if rows:
            yield pd.DataFrame(rows, columns=["left", "right", "n"])

    rows = arriving.select(F.col("chain").cast(kind).alias("chain"), F.col("version").cast("long").alias("version"), "tokens").filter("version IS NOT NULL")
    return rows.groupBy("chain").applyInPandasWithState(follow, "left string, right string, n bigint", "version bigint, tokens array<string>", "append", "NoTimeout")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("-")[1]) for p in done if p.getName().startswith("counts-"))


def pair_counts_at(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """(left, right, n) after a trigger, or the last one."""
    found = [v for v in _versions(spark, folder) if batch is None or v <= batch]
    if not found:
        return spark.createDataFrame([], "left string, right string, n bigint")
    return spark.read.parquet(f"{folder}/counts-{found[-1]}")


def follow_pairs(arriving: DataFrame, folder: str, checkpoint: str, keep: int = 3):
    """Run a stream of chains over what is there now; after every trigger, ``folder`` holds the counts of all pairs.

    A trigger's counts are those of the one before plus its changes, written under its own number, so a trigger that is run
    again after a failure writes the same once more. The last ``keep`` versions stay."""

    def merge(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        before = pair_counts_at(spark, folder, batch - 1)
        now = before.unionByName(changes).groupBy("left", "right").agg(F.sum("n").alias("n")).filter("n <> 0")
        now.write.mode("overwrite").parquet(f"{folder}/counts-{batch}")
        for old in _versions(spark, folder)[:-keep]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts-{old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    query = pair_changes(arriving).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
