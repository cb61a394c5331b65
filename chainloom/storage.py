"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What each thread has settled, so that jobs side by side don't sweep each other's tables.
_SETTLED: dict[int, list[str]] = {}


def _own() -> list[str]:
    return _SETTLED.setdefault(threading.get_ident(), [])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without: a temporary one is made. On a
    cluster, executors would each write to their own disk, so a missing setting is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chainloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/chainloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _own().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def note(path: str) -> str:
    """A folder that a job has written beside its settled tables, for :func:`sweep` to delete with them."""
    _own().append(path)
    return path


def sweep(spark: SparkSession, since: int = 0, keep: int = 0, everyone: bool = False) -> int:
    """Delete what this thread has settled, but for the first ``since`` tables and the last ``keep``; for when no result that
    reads it is needed any more. Jobs in other threads keep theirs, unless ``everyone`` asks for all of the process."""
    lists = list(_SETTLED.values()) if everyone else [_own()]
    gone = []
    for own in lists:
        end = max(since, len(own) - keep)
        gone += own[since:end]
        own[since:end] = []
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def settled() -> int:
    """How many settled tables this thread has, as a mark for :func:`sweep`."""
    return len(_own())
