"""Intermediate tables: written as Parquet where driver and executors both see them, removed when nobody needs them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which driver and executors share. Where it is unset and all run in one process, as in tests,
    a temporary folder; on a cluster it must be set, since executors would write where nobody reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="stringloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[tuple[SparkSession, str]] = []
#: The tables of the innermost `settled` that runs here; each thread has its own.
_scope: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("_scope", default=_written)


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the plan ends there, every reader sees the same rows,
    and lost executors lose none of them. The folders go when the driver ends, or with `settled`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stringloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scope.get().append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of `make()`, without the tables that were written on the way to it. What other threads write stays."""
    on_the_way: list[tuple[SparkSession, str]] = []
    outer = _scope.set(on_the_way)
    try:
        found = make()
        _scope.reset(outer)
        outer = None
        return stash(found, name)
    finally:
        if outer is not None:
            _scope.reset(outer)
        _remove(on_the_way)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_written() -> None:
    try:
        _remove(_written)
    except Exception:  # the session has ended already; nothing can be removed through it
        return
