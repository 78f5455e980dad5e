"""Pages of a table in key order, each found by its place instead of by counting up to it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.columns import named
from stowage.operators.ranking import rank_within

INDEX = "part int, first long, rows long"


@dataclass(frozen=True)
class PagedTable:
    """A copy of a table in key order, and a sparse index with one row per range of it.

    A range is a folder of its own, and its rows carry their place in the whole order. The index tells which ranges a page lies in, one
    or two if pages are smaller than ranges; only these are opened, and within them the places reach the scan.
    """

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, df: DataFrame, keys: Sequence[str], path: str, range_rows: int = 1_000_000) -> PagedTable:
        """Order ``df`` by ``keys`` and write it. Rows with equal keys keep one order, but which one is open.

        Places come from a range partitioning with per-partition counts, so no task sees more than its range. The
        index is written last: without it the copy is unfinished.
        """
        clash = {"_place", "_part"} & set(df.columns)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are needed for places")
        placed = rank_within(df, [], [named(k) for k in keys], "_place", "long")
        placed = placed.withColumn("_place", F.col("_place") - 1).withColumn("_part", F.floor(F.col("_place") / range_rows).cast("int"))
        # Rows come in ranges already; dealing them by range again puts each into one file, in order.
        dealt = placed.repartition("_part").sortWithinPartitions("_part", "_place")
        dealt.write.partitionBy("_part").parquet(f"{path}/rows")
        stored = df.sparkSession.read.schema(_stored(df)).parquet(f"{path}/rows")
        found = stored.groupBy(F.col("_part").alias("part")).agg(F.min("_place").alias("first"), F.count("*").alias("rows"))
        found.coalesce(1).sortWithinPartitions("part").write.parquet(f"{path}/index")
        return cls(df.sparkSession, path)

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def _rows(self, parts: list[int]) -> DataFrame:
        """Ranges by their folders: no other folder is listed."""
        folders = [f"{self.path}/rows/_part={p}" for p in parts]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)

    def page(self, number: int, size: int) -> DataFrame:
        """The ``number``-th page (from 0) of ``size`` rows, in key order; empty behind the last one."""
        start, stop = number * size, (number + 1) * size
        within = (F.col("first") < stop) & (F.col("first") + F.col("rows") > start)
        parts = [r.part for r in self.index().filter(within).select("part").sort("part").collect()]
        if not parts:
            some = self.index().select("part").head()
            return self._rows([some.part]).limit(0).drop("_place", "_part") if some else self.spark.createDataFrame([], T.StructType())
        found = self._rows(parts).filter((F.col("_place") >= start) & (F.col("_place") < stop))
        return found.orderBy("_place").drop("_place", "_part")

    def pages(self, size: int) -> int:
        total = self.index().agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
        return -(-total // size)

    def each(self, size: int) -> Iterator[DataFrame]:
        """All pages in order, for consumers that take one at a time."""
        return (self.page(n, size) for n in range(self.pages(size)))


def _stored(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_part", T.IntegerType())])
