"""Cutting the lineage of loops, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all run on one machine, as in tests, a local folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quiver-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. Results may be read at any time, so it is removed when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/quiver/{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return f"{folder}/{name}"


def _remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_all() -> None:
    for spark, folder in _made:
        try:
            _remove(spark, folder)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder. A checkpoint would make them twice, once to count and once to write."""
    path = _place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(df: DataFrame) -> DataFrame:
    """Like ``cut``; the shuffle files that led to the table go once it is written, so that steps don't add up on disk."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return cut(df)
    finally:
        spark.conf.set(key, before)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``step`` for tables that go at the end: no result may still need them."""
    own: list[tuple[SparkSession, str]] = []

    def one(df: DataFrame) -> DataFrame:
        out = step(df)
        own.append(_made[-1])
        return out

    try:
        yield one
    finally:
        for made in own:
            _remove(*made)
            _made.remove(made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, in files of a good size."""
    path = _place(df.sparkSession, name)
    df.hint("rebalance").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
