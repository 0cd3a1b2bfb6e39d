"""Durable cuts of lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is missing, a temporary folder is set if the session runs on one machine; on a
    cluster that is an error, as executors would not see the driver's folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="tallyloom-")
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/tallyloom-{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> int:
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def discard(spark: SparkSession) -> int:
    """Remove what this process has written to the shared folder, once no result that rests on it is needed; returns how many."""
    gone = _made[:]
    _made.clear()
    return _remove(spark, gone)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, what was written to the shared folder meanwhile.

    Results that rest on it must have been written elsewhere by then. Scopes may be nested; threads of one
    process share them.
    """
    before = set(_made)
    try:
        yield
    finally:
        own = [p for p in _made if p not in before]
        _made[:] = [p for p in _made if p in before]
        _remove(spark, own)


def durable(df: DataFrame, what: str = "cut") -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read that table.

    A lost executor then costs the tasks it ran, never the steps before this one. Column pruning
    and filters still reach the written table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
