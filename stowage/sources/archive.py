"""Entry lists of packed archive files, from their headers alone, and an index that finds content without walking again."""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stowage.session import create_once

# An archive opens with the signature; then come, per entry, a four-byte big-endian
# header length, a JSON header with these keys, and the content. A length of zero ends it.
SIGNATURE = b"MIGR\x01"
HEADER_KEYS = {"path": "p", "size": "s", "mtime": "m", "type": "t", "crc": "c"}
LENGTH = ">I"

COLUMNS = ["archive", "ordinal", "path", "size", "mtime", "type", "crc", "offset"]
HEADERS = "archive string, ordinal long, path string, size long, mtime long, type string, crc string, offset long"
BYTES_PER_TASK = 128 << 20
LISTING = "archive string, bytes long, modified long"


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def matching(pattern: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, modification time)`` of all files that match, by the storage's own listing; ``*`` stays within a folder."""
    system, path = storage(pattern)
    scheme = pattern.removesuffix(path) if pattern.endswith(path) else ""
    parts = path.split("/")
    wild = next((i for i, part in enumerate(parts) if any(c in part for c in "*?[")), None)
    if wild is None:
        found = [system.get_file_info(path)]
    else:
        base = "/".join(parts[:wild]) or "/"
        deep = wild < len(parts) - 1
        listed = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=deep))
        found = [
            info
            for info in listed
            if len(names := info.path.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, names[wild:], parts[wild:]))
        ]
    files = [(scheme + info.path, info.size, (info.mtime_ns or 0) // 1000) for info in found if info.type == fs.FileType.File]
    return sorted(files)


def entry_headers(path: str, types: Iterable[str] | None = None) -> Iterator[tuple]:
    """Headers of one archive in order, with the place of their content, seeking past all content."""
    wanted = None if types is None else frozenset(types)
    system, inner = storage(path)
    with system.open_input_file(inner) as file:
        if file.read(len(SIGNATURE)) != SIGNATURE:
            raise ValueError(f"{path} does not start with the archive signature")
        ordinal = 0
        while len(prefix := file.read(4)) == 4:
            (length,) = struct.unpack(LENGTH, prefix)
            if not length:
                return
            try:
                header = json.loads(file.read(length))
            except ValueError:
                header = {}
            if not isinstance(header, dict):
                header = {}
            values = {name: header.get(key) for name, key in HEADER_KEYS.items()}
            size, crc, kind, offset = int(values["size"] or 0), values["crc"], str(values["type"] or "file"), file.tell()
            if wanted is None or kind in wanted:
                yield (
                    path,
                    ordinal,
                    str(values["path"] or ""),
                    size,
                    int(values["mtime"] or 0),
                    kind,
                    None if crc is None else str(crc),
                    offset,
                )
            end = offset + size
            if end > file.size():
                return
            file.seek(end)
            ordinal += 1


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _HeaderReader(DataSourceReader):
    def __init__(self, pattern: str, types: list[str] | None):
        self.pattern, self.types = pattern, types

    def partitions(self):
        found = [path for path, _, _ in matching(self.pattern)]
        if not found:
            raise FileNotFoundError(f"no archive matches {self.pattern}")
        return [_Archive(p) for p in found]

    def read(self, partition):
        yield from entry_headers(partition.path, self.types)


class ArchiveHeaders(DataSource):
    """``spark.read.format("archive_headers").load(pattern)``; option ``types`` is a JSON list.

    Conditions are given as an option: those that Spark pushes into a Python reader stay with a DataFrame that is used again under
    other conditions (Spark 4.1), which then gives the rows of the first use.
    """

    @classmethod
    def name(cls):
        return "archive_headers"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return _HeaderReader(self.options["path"], json.loads(self.options.get("types", "null")))


def archive_catalog(spark: SparkSession, pattern: str, types: Iterable[str] | None = None) -> DataFrame:
    """Entries of all archives that match, or those of some ``types``: one task per archive, reading headers only.

    Rows of other types are never made. A pattern that matches no archive is an error.
    """
    spark.dataSource.register(ArchiveHeaders)
    wanted = "null" if types is None else json.dumps(sorted(types))
    found = spark.read.format("archive_headers").option("types", wanted).load(pattern)
    return found.withColumn("mtime", F.timestamp_seconds("mtime"))


# ---------------------------------------------------------------- index


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            found = pd.DataFrame(list(entry_headers(row.archive)), columns=COLUMNS)
            yield found.assign(bytes=row.bytes, modified=row.modified)[[*COLUMNS, "bytes", "modified"]]


class ArchiveIndex:
    """Headers of many archives, stored with the place of each content.

    ``refresh`` walks only archives that are new, or have another size or time than when they were walked; entries of
    archives that are gone are left out. Each refresh is a generation of its own, so readers of the one before are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def generation(self) -> int:
        marks = matching(f"{self.path}/done/*")
        return max((int(os.path.basename(path)) for path, _, _ in marks), default=0)

    def entries(self) -> DataFrame:
        """``(archive, ordinal, path, size, mtime, type, crc, offset, bytes, modified)`` of the last refresh."""
        number = self.generation()
        if not number:
            return self.spark.createDataFrame([], f"{HEADERS}, bytes long, modified long")
        return self.spark.read.schema(f"{HEADERS}, bytes long, modified long").parquet(f"{self.path}/g={number}")

    def refresh(self, pattern: str) -> int:
        """Bring the index up to date with what is there; the number of archives walked."""
        now = self.spark.createDataFrame(matching(pattern), LISTING)
        known, same = self.entries(), ["archive", "bytes", "modified"]
        fresh = now.join(known.select(*same).distinct(), same, "left_anti")
        count, number = fresh.count(), self.generation() + 1
        kept = known.join(now, same, "left_semi").select(known.columns)
        # One archive is one task's work, as its headers are a chain.
        walked = fresh.repartition(max(1, count), "archive").mapInPandas(_walk, f"{HEADERS}, bytes long, modified long")
        kept.unionByName(walked).write.mode("overwrite").parquet(f"{self.path}/g={number}")
        create_once(self.spark, f"{self.path}/done/{number:012}", "")
        return count

    def contents(self, where: Column | None = None, chunk: int = 5 << 20) -> DataFrame:
        """Content of indexed entries in pieces: ``(archive, ordinal, path, chunk_no, content)``; headers are not read again.

        Pieces are spread by place, so a large entry is read by many tasks.
        """
        chosen = self.entries() if where is None else self.entries().filter(where)
        last = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / chunk).cast("int")
        pieces = chosen.select("archive", "ordinal", "path", "size", "offset", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
        spread = pieces.repartition(self._tasks(chosen), "archive", "ordinal", "chunk_no").sortWithinPartitions("archive", "offset")
        return spread.mapInPandas(_read_pieces(chunk), "archive string, ordinal long, path string, chunk_no int, content binary")

    def _tasks(self, chosen: DataFrame) -> int:
        """By the bytes to read: by their own size, rows of places would all be merged into one task."""
        total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
        return max(self.spark.sparkContext.defaultParallelism, total // BYTES_PER_TASK)

    def verify(self, where: Column | None = None) -> DataFrame:
        """``(archive, ordinal, path, status)``: whether content is as its header's checksum says; entries of one piece each are checked in the task."""
        chosen = self.entries() if where is None else self.entries().filter(where)
        spread = chosen.select("archive", "ordinal", "path", "size", "crc", "offset").repartition(self._tasks(chosen), "archive", "ordinal")
        return spread.mapInPandas(_check, "archive string, ordinal long, path string, status string")


class _Opened:
    """The archive that a task reads from, opened once for rows that follow each other."""

    def __init__(self):
        self.path: str | None = None
        self.file: BinaryIO | None = None

    def at(self, path: str, offset: int):
        if path != self.path:
            self.close()
            system, inner = storage(path)
            self.path, self.file = path, system.open_input_file(inner)
        self.file.seek(offset)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _read_pieces(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _Opened()
        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    want = max(0, min(chunk, row.size - row.chunk_no * chunk))
                    content = opened.at(row.archive, row.offset + row.chunk_no * chunk).read(want)
                    if len(content) != want:
                        raise OSError(f"{row.archive} ends within {row.path}")
                    yield pd.DataFrame([(row.archive, row.ordinal, row.path, row.chunk_no, content)], columns=["archive", "ordinal", "path", "chunk_no", "content"])
        finally:
            opened.close()

    return run


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checksums of whole entries, read in bounded steps."""
    opened = _Opened()
    try:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                file, left, crc = opened.at(row.archive, row.offset), row.size, 0
                while left and (step := file.read(min(left, 1 << 20))):
                    crc, left = zlib.crc32(step, crc), left - len(step)
                status = "corrupt" if left else "unverifiable" if row.crc is None else "ok" if f"{crc:08x}" == row.crc else "corrupt"
                rows.append((row.archive, row.ordinal, row.path, status))
            yield pd.DataFrame(rows, columns=["archive", "ordinal", "path", "status"])
    finally:
        opened.close()
