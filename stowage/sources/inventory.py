"""Files under a mounted folder: listing, reading in pieces, and a look at the first bytes."""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import checkpointed, local_path

NAMES = "rel string, kind string"
TREE = "rel string, kind string, size long, mtime long"
FILE, FOLDER, UNREADABLE = "file", "dir", "unreadable"
BATCH = 10_000
FOLDERS_PER_TASK = 200
BYTES_PER_TASK = 128 << 20

# Fixed value: the reversed polynomial of CRC-32.
CRC_POLYNOMIAL = 0xEDB88320


def _list_names(root: str, names: frozenset, prefixes: tuple):
    """Folders to the names in them; nothing is asked of a file but its kind, which the folder itself mostly knows."""

    def pruned(rel: str, name: str) -> bool:
        return name in names or any(rel == p or rel.startswith(p + "/") for p in prefixes)

    def entries(folder: str) -> Iterator[tuple[str, str]]:
        try:
            found = os.scandir(os.path.join(root, folder))
        except FileNotFoundError:
            if not folder:
                raise  # a root that is not there is an error, not an empty tree
            return
        except OSError:
            yield folder, UNREADABLE
            return
        with found:
            for entry in found:
                rel = f"{folder}/{entry.name}" if folder else entry.name
                if pruned(rel, entry.name):
                    continue
                try:
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        yield rel, FOLDER
                    elif entry.is_file(follow_symlinks=False):
                        yield rel, FILE
                except OSError:
                    yield rel, UNREADABLE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch["rel"]:
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["rel", "kind"])
                        rows = []
        yield pd.DataFrame(rows, columns=["rel", "kind"])

    return run


def _sizes(root: str):
    """Files to their size and time; one that is gone by now is left out, one that does not answer is unreadable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rel in batch["rel"]:
                try:
                    facts = os.lstat(os.path.join(root, rel))
                except (FileNotFoundError, NotADirectoryError):
                    continue
                except OSError:
                    found.append((rel, UNREADABLE, 0, None))
                    continue
                if stat.S_ISREG(facts.st_mode):
                    found.append((rel, FILE, facts.st_size, int(facts.st_mtime)))
            yield pd.DataFrame(found, columns=["rel", "kind", "size", "mtime"]).astype({"mtime": "Int64"})

    return run


def list_tree(
    spark: SparkSession, root: str, names: Sequence[str] = (), prefixes: Sequence[str] = ()
) -> DataFrame:
    """All that lies below ``root`` as ``(rel, kind, size, mtime)``; ``kind`` is file, dir or unreadable.

    Names come first, level by level: each level's folders are spread over the cluster, and pruned folders are never opened. Then files are asked for
    size and time, spread by name, so that a folder of any number of files is one task's work only as far as its list of names. Links are
    neither listed nor followed. A folder that cannot be opened, or a file that does not answer, is a row, not an error.
    """
    base = local_path(root)
    listing = _list_names(base, frozenset(names), tuple(p.strip("/") for p in prefixes if p.strip("/")))
    folders, count = spark.createDataFrame([("",)], "rel string"), 1
    levels = []
    while count:
        # A fixed number: by their size in bytes, folder names would all be merged into one task.
        tasks = min(count, max(spark.sparkContext.defaultParallelism, count // FOLDERS_PER_TASK))
        level = checkpointed(folders.repartition(tasks, "rel").mapInPandas(listing, NAMES))
        levels.append(level)
        folders = level.filter(F.col("kind") == FOLDER).select("rel")
        count = folders.count()
    found = reduce(DataFrame.unionByName, levels)
    files = found.filter(F.col("kind") == FILE)
    tasks = max(spark.sparkContext.defaultParallelism, files.count() // BATCH)
    sized = files.select("rel").repartition(tasks, "rel").mapInPandas(_sizes(base), TREE)
    others = found.filter(F.col("kind") != FILE).select("rel", "kind", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))
    both = checkpointed(sized).unionByName(others)
    return both.withColumn("mtime", F.timestamp_seconds("mtime"))


def file_inventory(
    spark: SparkSession,
    root: str,
    names: Sequence[str] = (),
    prefixes: Sequence[str] = (),
) -> DataFrame:
    """Regular files below ``root`` as ``(rel, size, mtime)``; links are neither listed nor followed.

    Dot-files are listed like any other. What cannot be read is passed over; ``list_tree`` names it.
    """
    return list_tree(spark, root, names, prefixes).filter(F.col("kind") == FILE).select("rel", "size", "mtime")


# ---------------------------------------------------------------- content in pieces


def _times(left: int, right: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, lowest power in the top bit."""
    product = 0
    for bit in range(31, -1, -1):
        if left >> bit & 1:
            product ^= right
        right = right >> 1 ^ (CRC_POLYNOMIAL if right & 1 else 0)
    return product


def crc_followed_by(crc: int, count: int) -> int:
    """What ``crc`` adds to the checksum of a whole in which ``count`` more bytes follow."""
    power, factor = 1 << 31, 1 << 23  # x**0 and x**8
    while count:
        if count & 1:
            power = _times(factor, power)
        factor = _times(factor, factor)
        count >>= 1
    return _times(power, crc)


PIECE = "rel string, size long, mtime timestamp, chunk_no int, start long, length long, content binary, crc long, share long"


def _read_pieces(root: str, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                start = row.chunk_no * chunk
                want = max(0, min(chunk, row.size - start))
                with open(os.path.join(root, row.rel), "rb") as file:
                    file.seek(start)
                    content = file.read(want)
                if len(content) != want:
                    raise OSError(f"{row.rel} became shorter while it was read")
                crc = zlib.crc32(content)
                share = crc_followed_by(crc, row.size - start - want)
                yield pd.DataFrame(
                    [(row.rel, row.size, row.mtime, row.chunk_no, start, want, content, crc, share)],
                    columns=["rel", "size", "mtime", "chunk_no", "start", "length", "content", "crc", "share"],
                )

    return run


def file_pieces(files: DataFrame, root: str, chunk: int = 5 << 20) -> DataFrame:
    """Content of listed files in pieces of at most ``chunk`` bytes, each with its checksum.

    Pieces are spread by path and number before anything is opened, so a huge file is read by many
    tasks, as many as its bytes ask for. ``share`` is the piece's part in the whole file's checksum: XOR-ing the shares of all
    pieces, in any order, gives it.
    """
    last = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / chunk).cast("int")
    pieces = files.select(
        "rel", "size", "mtime", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")
    )
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK)
    spread = pieces.repartition(tasks, "rel", "chunk_no")
    return spread.mapInPandas(_read_pieces(local_path(root), chunk), PIECE)


def files_still_there(files: DataFrame, root: str) -> DataFrame:
    """Listed files with their size and time as they are now; what is gone, or no longer a regular file, is left out."""
    now = files.select("rel").mapInPandas(_sizes(local_path(root)), TREE).filter(F.col("kind") == FILE)
    return checkpointed(now.select("rel", "size", F.timestamp_seconds("mtime").alias("mtime")))


def _first_bytes(root: str, count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for rel in batch["rel"]:
                with open(os.path.join(root, rel), "rb") as file:
                    heads.append(file.read(count))
            yield pd.DataFrame({"rel": batch["rel"], "head": heads})

    return run


def file_heads(files: DataFrame, root: str, count: int = 2) -> DataFrame:
    """The first bytes of each listed file, without reading the rest: ``(rel, head)``."""
    return files.select("rel").mapInPandas(
        _first_bytes(local_path(root), count), "rel string, head binary"
    )
