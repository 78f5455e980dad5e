"""Shards along a Hilbert curve over metadata, for files that can be skipped by several columns.

Source, language and size are quantised to 256 steps each: text columns by the share of rows before their value (so a frequent
value takes many steps' room but one step), sizes by their logarithm. Rows are ordered by their place on the curve, equal texts
next to each other, and the order is cut into runs. The law is ``rows``: run lengths are at most one apart.

Ranks are exact and no group has to fit in a task: rows are range-partitioned along the curve, and a row's rank is its place in
its partition plus the rows before. Texts are not moved to assign shards.

Defined results: a NULL text counts as empty (size 1, CRC 0); NULL sources, languages and ids come first; repeated rows get slots of their
own; fewer rows than shards leave the last shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.ranking import rank_within

BITS = 8
STEPS = 1 << BITS


def hilbert_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with coordinates below ``2 ** bits``.

    From the highest bit down, the axes are reflected and exchanged as the curve turns in each cell; the Gray
    code of what remains, read across the axes, is the index.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            high = (axis >> bit & 1).astype(bool)
            turned = np.where(high, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, turned)
            if axis is not x[0]:
                axis ^= turned
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    index = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            index = index << 1 | ((axis ^ flip) >> bit & 1)
    return index


def on_curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()]))


def steps_of(rows: DataFrame, column: str) -> DataFrame:
    """Each value's step: the share of rows up to the middle of the value, with one row per distinct value."""
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("v").asc_nulls_first())
    upto, total = F.sum("n").over(order), F.sum("n").over(Window.partitionBy())
    return counts.select("v", (((2 * upto - F.col("n")) * STEPS) / (2 * total)).cast("long").alias("step"))


def sharded(docs: DataFrame, shards: int = 16, payload: Sequence[Column] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the payload of every row."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(
        "doc_id", "source", "lang", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), *payload
    )
    for column in ("source", "lang"):
        steps = steps_of(docs.select(column), column).withColumnRenamed("step", f"{column}_step")
        rows = rows.join(steps, F.col(column).eqNullSafe(F.col("v")), "left").drop("v")
    size_step = F.least(F.floor(F.log2("size") * 8), F.lit(STEPS - 1)).cast("long")
    rows = rows.withColumn("curve", F.pandas_udf(on_curve, "long")("source_step", "lang_step", size_step)).drop("source", "lang", "source_step", "lang_step")
    ranked = rank_within(rows, [], [F.col(c) for c in ("curve", "h", "doc_id", "size", "text_crc32")], "place", "long")
    total = ranked.agg(F.max("place")).first()[0] or 0
    short, longer = divmod(total, shards)
    # The first ``longer`` shards have one row more.
    edge = longer * (short + 1)
    place = F.col("place") - 1
    cut = f"CASE WHEN p < {edge} THEN p div {short + 1} ELSE {longer} + (p - {edge}) div {max(short, 1)} END"
    start = f"CASE WHEN shard < {longer} THEN shard * {short + 1} ELSE {edge} + (shard - {longer}) * {short} END"
    return (
        ranked.withColumn("p", place)
        .withColumn("shard", F.expr(f"CAST({cut} AS INT)"))
        .withColumn("slot", F.expr(f"CAST(p - ({start}) AS BIGINT)"))
        .withColumn("law", F.lit("rows"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("p", "place", "h", "curve")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """All columns of ``docs``, one folder per shard, rows in order of their slots."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = sharded(docs, shards, [row]).select("row", "shard", "slot")
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shards_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
