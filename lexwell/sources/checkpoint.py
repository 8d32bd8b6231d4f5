"""Intermediate tables, written once to the shared folder the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a single-machine session that names none gets one of its own."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder for one intermediate table; it is deleted when the session ends, or earlier inside ``scratch``."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if (written := _written.get()) is not None:
        written.append((spark, path))
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table, its lineage cut: lost executors cost no recomputation, and its size is known to the planner."""
    path = new_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that were saved inside; for calls whose result does not depend on them any more."""
    token = _written.set([])
    try:
        yield
    finally:
        for spark, path in _written.get():
            remove_folder(spark, path)
        _written.reset(token)
