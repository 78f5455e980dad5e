"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from stowage.session import scratch

_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, of known size, and safe from lost executors.

    Within ``passing_tables`` it goes with the others, unless it is to be kept.
    """
    spark, passing = df.sparkSession, _passing.get()
    path = scratch(spark, label)
    df.write.parquet(path)
    if passing is not None and not keep:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block are removed at its end; what is needed later must be written with ``keep``."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
