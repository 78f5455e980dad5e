"""Statements of SQL text files in any layout, found by many tasks per file.

A statement ends at a ``;`` outside of single quotes, where a backslash inside of quotes escapes the next byte. Whether a ``;`` ends one depends on all text
before it, so files are read in three steps. Spark cuts them at every ``;``, in as many splits as their size asks for. A first scan finds
for each split what it makes of text that starts outside, and inside, of quotes: two states in, one of two states out. These functions
are composed along each file, one row per split, which tells the state at the start of each split. The second scan puts the
statements together; those that reach over a split's end come out in parts and are joined after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import scratch

# What is trimmed from a statement's ends.
BLANK = " \t\n\r\0\x0b"

_OUTSIDE = re.compile(rb"(?:[^']++|'(?:[^'\\]++|\\.)*+')*+", re.DOTALL)
_TO_QUOTE = re.compile(rb"(?:[^'\\]++|\\.)*+'", re.DOTALL)

SPLIT = "file string, start long, after_outside boolean, after_inside boolean, ends_outside boolean, ends_inside boolean"
STATE = "file string, start long, inside boolean, owner long"
PART = "file string, owner long, start long, place long, whole boolean, sql binary"


def ends_inside(text: bytes, inside: bool) -> bool:
    """Whether quotes are open behind ``text`` and the ``;`` that follows it, which an escape may take."""
    if b"'" not in text:
        return inside
    at = 0
    if inside:
        found = _TO_QUOTE.match(text)
        if found is None:
            return True
        at = found.end()
    return _OUTSIDE.match(text, at).end() != len(text)


def fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, start, id, text)``: text between semicolons; ``start`` is the split's first byte, ``id`` the order within it."""
    read = spark.read.option("lineSep", ";").text(paths)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").cast("binary").alias("text"),
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes], list[int]]]:
    """``(columns before the last, texts, places of texts with a quote)`` for runs of rows of one split, in order."""
    for batch in batches:
        *columns, texts = batch.columns
        files, starts = columns[0].dictionary_encode().indices.to_numpy(), columns[1].to_numpy()
        changes = (files[1:] != files[:-1]) | (starts[1:] != starts[:-1])
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(starts)] if len(starts) else []
        quoted = pc.find_substring(texts, b"'").to_numpy() >= 0
        for a, b in zip(edges, edges[1:]):
            yield tuple(c[a].as_py() for c in columns), texts.slice(a, b - a).to_pylist(), np.flatnonzero(quoted[a:b]).tolist()


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for (file, start), texts, quoted in _by_split(batches):
        if not rows or rows[-1][:2] != [file, start]:
            rows.append([file, start, False, True, False, False])
        here = rows[-1]
        for was in (False, True):
            inside, at = here[2 + was], 0
            for place in quoted:
                here[4 + was] |= at < place and not inside  # texts without quotes leave the state as it is
                inside, at = ends_inside(texts[place], inside), place + 1
                here[4 + was] |= not inside
            here[4 + was] |= at < len(texts) and not inside
            here[2 + was] = inside
    names = ["file", "start", "after_outside", "after_inside", "ends_outside", "ends_inside"]
    types = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _compose(splits: pd.DataFrame) -> pd.DataFrame:
    """One file's splits in order: the state each starts in, and the split in which the statement began that is open there."""
    inside, owner, rows = False, None, []
    for s in splits.sort_values("start").itertuples(index=False):
        owner = s.start if owner is None else owner
        rows.append((s.file, s.start, inside, owner))
        if s.ends_inside if inside else s.ends_outside:
            owner = s.start
        inside = bool(s.after_inside if inside else s.after_outside)
    return pd.DataFrame(rows, columns=["file", "start", "inside", "owner"])


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of splits whose first state is known; what a split starts or ends with may be a part of one."""
    names = ["file", "owner", "start", "place", "whole", "sql"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    out: list[tuple] = []
    size = place = 0
    file = start = owner = None
    inside, first, pending = False, True, []

    def end() -> int:
        nonlocal pending, first, place
        sql = b";".join(pending)
        opened = owner if first else start
        out.append((file, opened, start, place, not first or owner == start, sql))
        pending, first, place = [], False, place + 1
        return len(sql)

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def leave() -> None:
        if pending:
            end()
            out[-1] = (*out[-1][:4], False, out[-1][5])

    for key, texts, quoted in _by_split(batches):
        if key[:2] != (file, start):
            leave()
            file, start, inside, owner = key
            first, pending, place = True, [], 0
        at = 0
        for there in [*quoted, len(texts)]:
            if inside:
                pending.extend(texts[at:there])
            else:
                for text in texts[at:there]:
                    pending.append(text)
                    size += end()
                    if size > 4 << 20:
                        yield batch()
                        out, size = [], 0
            if there < len(texts):
                pending.append(texts[there])
                inside = ends_inside(texts[there], inside)
                if not inside:
                    size += end()
            at = there + 1
            if size > 4 << 20:
                yield batch()
                out, size = [], 0
    leave()
    yield batch()


def tidy(sql: Column) -> Column:
    """A statement without its end; empty when only comment lines are left."""
    text = F.btrim(F.rtrim(F.btrim(sql, F.lit(BLANK)), F.lit(";")), F.lit(BLANK))
    bare = F.transform(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(BLANK)))
    comments = F.forall(bare, lambda line: (line == "") | F.startswith(line, F.lit("-- ")))
    return F.when(F.startswith(text, F.lit("-- ")) & comments, "").otherwise(text)


def read_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Statements of any dump as ``(file, start, place, sql)``; ``start`` and ``place`` order them within a file.

    Paths are Spark's own: any storage, globs, files compressed by suffix (one task each); names that begin with ``.`` or ``_`` are skipped. A
    statement is one cell, however many splits it reaches over. Bytes that are no UTF-8 stay as they are.
    """
    cut = fragments(spark, paths)
    found = cut.select("file", "start", "text").mapInArrow(_functions, SPLIT)
    # One row per split. Written, so that its size is known: it is broadcast when small, and joined by a shuffle otherwise.
    path = scratch(spark, "splits")
    found.groupBy("file").applyInPandas(_compose, STATE).write.parquet(path)
    states = spark.read.schema(STATE).parquet(path)
    known = cut.join(states, ["file", "start"]).sortWithinPartitions("file", "start", "id")
    parts = known.select("file", "start", "inside", "owner", "text").mapInArrow(_join_up, PART)
    parts = parts.select("file", "owner", "start", "place", "whole", F.col("sql").cast("string").alias("sql"))
    whole = parts.filter("whole").select("file", "start", "place", "sql")
    # At most two rows per split.
    pieces = F.array_sort(F.collect_list(F.struct("start", "place", "sql")))
    over = parts.filter("NOT whole").groupBy("file", F.col("owner").alias("start")).agg(pieces.alias("pieces"))
    joined = over.select(
        "file", "start", F.lit(2**62).alias("place"), F.array_join(F.transform("pieces", lambda p: p["sql"]), ";").alias("sql")
    )
    return whole.unionByName(joined).withColumn("sql", tidy(F.col("sql"))).filter("sql != ''")
