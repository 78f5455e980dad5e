"""Exact ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.session import checkpointed


def rank_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", kind: str = "int"
) -> DataFrame:
    """Row number within each group as a ``kind``, without bringing a whole group into one task.

    Rows are range-partitioned by group and order, so a large group spreads over neighbouring
    partitions. A row's number is its position in its partition plus the rows the group has in the
    partitions before. The partitioning is materialised once, as its bounds come from a sample and
    must be the same for both uses.
    """
    by = [F.col(g) for g in group]
    placed = checkpointed(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    spans = placed.groupBy(*group, "_part").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_rows")
    )
    before = (
        Window.partitionBy(*group)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = spans.select(
        *group,
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return (
        placed.join(offsets, [*group, "_part"])
        .withColumn(name, number.cast(kind))
        .drop("_part", "_row", "_first", "_before")
    )


def top_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group; each task keeps at most ``k`` per group before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, number).filter(F.col(name) <= k)
