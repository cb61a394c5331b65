"""Resumable learning and repeatable runs: numbered snapshots, saved options, work already done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_snapshot(rows: DataFrame, folder: str, name: str, step: int) -> None:
    """One snapshot in a folder of its own; Spark's _SUCCESS marks it complete."""
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/step={step}")


def latest_snapshot(spark: SparkSession, folder: str, name: str) -> int | None:
    """The highest step whose snapshot is complete."""
    jvm = spark.sparkContext._jvm
    if not _exists(spark, f"{folder}/{name}"):
        return None
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    steps = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("step=")]
    done = [s for s in steps if _exists(spark, f"{folder}/{name}/step={s}/_SUCCESS")]
    return max(done, default=None)


def load_snapshot(spark: SparkSession, folder: str, name: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/step={step}")


def learn_resumably(tokens: DataFrame, folder: str, steps: int, every: int = 4) -> DataFrame:
    """The vocabulary after ``steps`` merges, from the last complete snapshot on."""
    from chainloom.plans.learn import learn

    spark = tokens.sparkSession
    done = latest_snapshot(spark, folder, "chains") or 0
    vocabulary = load_snapshot(spark, folder, "vocabulary", done) if done else None
    if done:
        tokens = load_snapshot(spark, folder, "chains", done)
    while done < steps:
        more, tokens = learn(tokens, min(every, steps - done))
        n = more.count()
        if not n:
            break
        more = more.withColumn("step", F.col("step") + done)
        vocabulary = more if vocabulary is None else vocabulary.unionByName(more)
        done += n
        save_snapshot(vocabulary, folder, "vocabulary", done)
        save_snapshot(tokens, folder, "chains", done)  # last: its mark makes the step count
        vocabulary = load_snapshot(spark, folder, "vocabulary", done)
        tokens = load_snapshot(spark, folder, "chains", done)
    if vocabulary is None:
        from chainloom.plans.learn import empty_vocabulary

        return empty_vocabulary(spark)
    return vocabulary


def append_split(rows: DataFrame, path: str, split: str) -> None:
    """Rows added to a table as a split of their own."""
    rows.withColumn("split", F.lit(split)).write.mode("append").partitionBy("split").parquet(path)


def still_to_do(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Rows whose key isn't in the output yet, so a repeated run does only what is missing."""
    spark = rows.sparkSession
    return rows.join(spark.read.parquet(path).select(key), key, "left_anti") if _exists(spark, path) else rows


def check_options(now: dict, saved: dict, skip: frozenset[str] = frozenset()) -> None:
    """Every saved option must be what it is now, but for those to skip."""
    wrong = {k: (v, now.get(k)) for k, v in saved.items() if k not in skip and (k not in now or now[k] != v)}
    if wrong:
        raise ValueError(f"options differ: {wrong}")


def version_key(rows: DataFrame, columns: list[str], code: str) -> str:
    """A key of inputs and code for cached results: the same for the same rows in any order."""
    digest = rows.select(F.md5(F.concat_ws("|", *columns).cast("binary")).alias("h")).agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)"))).first()[0]
    import hashlib

    return hashlib.md5(f"{digest}:{code}".encode()).hexdigest()
