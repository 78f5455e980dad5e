"""Snapshots as folders: export, read, entries in pieces, and restore as a new version."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stowage.functions.columns import crc32_hex
from stowage.operators.files import (
    PRUNED_NAMES, SiteLayout, component_prefixes, excluded_prefixes, guard_paths, prune_paths, verify,
)
from stowage.operators.relational import ExportOptions, drop_disposable, select_tables
from stowage.operators.rewrite import rewrite_database
from stowage.plans.manifest import (
    FORMAT, FORMAT_VERSION, IDENTITY, MANIFEST_SCHEMA, supported,
)
from stowage.session import create_once
from stowage.sources.inventory import file_inventory, file_pieces

# Piece size of stored content, and folder of content in entry paths.
CHUNK_BYTES = 5 << 20
CONTENT_ROOT = "wp-content/"

# Reassembled content comes in cells of at most this size.
SEGMENT_BYTES = 64 << 20


# ---------------------------------------------------------------- entries


def _last_chunk(size: Column, chunk: int) -> Column:
    return F.floor(F.greatest(size - 1, F.lit(0)) / chunk).cast("int")


def cut_content(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``files(rel, mtime, content)`` cut into pieces of at most ``chunk`` bytes.

    Each piece has its own checksum and says where it lies, ``start`` and ``length``, so that any part of the content can be
    read without the rest. ``share`` holds the piece's part in the whole checksum; here
    the content is at hand, so the last piece carries all of it and the others zero.
    """
    sized = files.select(
        "rel",
        F.octet_length("content").cast("long").alias("size"),
        "mtime",
        "content",
        F.crc32("content").alias("whole"),
    )
    last = _last_chunk(F.col("size"), chunk)
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.substring(F.col("content"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return pieces.select(
        "rel",
        "size",
        "mtime",
        "chunk_no",
        (F.col("chunk_no").cast("long") * chunk).alias("start"),
        F.octet_length(piece).cast("long").alias("length"),
        piece.alias("content"),
        F.crc32(piece).alias("crc"),
        F.when(F.col("chunk_no") == last, F.col("whole")).otherwise(0).alias("share"),
    )


def write_entries(
    pieces: DataFrame, dest: str, type_name: str = "file", mode: str = "append"
) -> None:
    """Pieces as parquet, one folder per entry type.

    One call holds one type, so its folder is named here: ``partitionBy`` would sort all content.
    """
    pieces.write.mode(mode).parquet(f"{dest}/type={type_name}")


def entry_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(rel, size, mtime, type, crc, chunks)`` per entry, without reading content."""
    headers = spark.read.parquet(path).groupBy("rel", "type").agg(
        F.max("size").alias("size"),
        F.max("mtime").alias("mtime"),
        F.count("*").alias("chunks"),
        F.bit_xor("share").alias("whole"),
    )
    crc = F.lpad(F.lower(F.hex("whole")), 8, "0").alias("crc")
    return headers.select("rel", "size", "mtime", "type", crc, "chunks")


def joined_bytes(pieces: str, field: str) -> Column:
    """The bytes of an array of pieces in a row; the text casts only rename the type."""
    parts = F.transform(pieces, lambda p: p[field].cast("string"))
    return F.array_join(parts, "").cast("binary")


def read_entries(
    spark: SparkSession, path: str, where: Column | None = None, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """Content put together again: ``(rel, segment, content)``.

    An entry of up to ``segment_bytes`` is one row with segment 0. A larger one is several, in order, so that no task ever holds much more than
    one segment of it: a piece belongs to the segment in which it starts. The stored pieces say where they lie, whatever their size.
    """
    stored = spark.read.parquet(path)
    if where is not None:
        stored = stored.filter(where)
    return _segments(stored.select("rel", "start", "content"), F.lit(0), segment_bytes)


def read_range(
    spark: SparkSession, path: str, rel: str, first: int, count: int, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """``count`` bytes of one entry from byte ``first`` on, as ``(rel, segment, content)``.

    The conditions on path and place reach the scan, so only the pieces that hold these bytes are read.
    """
    stop = first + max(0, count)
    stored = spark.read.parquet(path).filter((F.col("rel") == rel) & (F.col("start") < stop) & (F.col("start") + F.col("length") > first))
    begin = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    taken = F.least(F.col("length"), stop - F.col("start")) - begin
    part = F.substring(F.col("content"), (begin + 1).cast("int"), taken.cast("int"))
    return _segments(stored.select("rel", "start", part.alias("content")), F.lit(first), segment_bytes)


def _segments(pieces: DataFrame, first: Column, segment_bytes: int) -> DataFrame:
    segment = F.floor(F.greatest(F.col("start") - first, F.lit(0)) / max(1, segment_bytes)).cast("int").alias("segment")
    ordered = F.array_sort(F.collect_list(F.struct("start", "content")))
    whole = pieces.groupBy("rel", segment).agg(ordered.alias("pieces"))
    return whole.select("rel", "segment", joined_bytes("pieces", "content").alias("content"))


def _broken() -> Column:
    """A piece that is not as its checksum or its length says."""
    return (F.crc32("content") != F.col("crc")) | (F.octet_length("content") != F.col("length"))


def _entry_facts(stored: DataFrame, *more: Column) -> DataFrame:
    """Per entry, whether its pieces cover it, each there once; without ``more`` no content is read."""
    facts = stored.groupBy("rel").agg(
        F.count("crc").alias("known"),
        F.count("*").alias("found"),
        F.count_distinct("chunk_no").alias("different"),
        (F.max("chunk_no") + 1).alias("expected"),
        F.sum("length").alias("bytes"),
        F.max(F.col("start") + F.col("length")).alias("reach"),
        F.max("size").alias("size"),
        *more,
    )
    once = (F.col("found") == F.col("different")) & (F.col("found") == F.col("expected"))
    covered = (F.col("bytes") == F.col("size")) & (F.col("reach") == F.col("size"))
    return facts.withColumn("whole", F.coalesce(once & covered, F.lit(False)))


def verify_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(rel, status)`` for stored entries: pieces as their checksums say, each there once, none missing."""
    facts = _entry_facts(spark.read.parquet(path), F.count_if(_broken()).alias("broken"))
    status = (
        F.when((F.col("broken") > 0) | ~F.col("whole"), "corrupt")
        .when(F.col("known") < F.col("found"), "unverifiable")
        .otherwise("ok")
    )
    return facts.select("rel", status.alias("status"))


# ---------------------------------------------------------------- export


def write_manifest(
    spark: SparkSession,
    dest: str,
    tables: Sequence[str],
    options: ExportOptions,
    rows: Mapping[str, int],
    files: int,
    size: int,
    prefix: str,
    identity: Mapping[str, object] | None = None,
) -> None:
    """The last step of an export: what the snapshot holds, and where it was made."""
    manifest = {
        "format": FORMAT,
        "formatVersion": FORMAT_VERSION,
        "generator": "stowage",
        "tablePrefix": prefix,
        **(identity or {}),
        "tables": list(tables),
        "excludes": options.excludes,
        "rows": dict(rows),
        "files": files,
        "bytes": size,
    }
    text = json.dumps(manifest, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{dest}/manifest")


def chosen_tables(
    tables: Mapping[str, DataFrame], prefix: str, options: ExportOptions
) -> dict[str, DataFrame]:
    """The tables an export takes."""
    spark = SparkSession.active()
    catalog = spark.createDataFrame([(t, "BASE TABLE") for t in tables], "name string, kind string")
    wanted = {r.name for r in select_tables(catalog, prefix, options).collect()}
    return {t: d for t, d in tables.items() if t in wanted}


def export_snapshot(
    tables: Mapping[str, DataFrame],
    files: DataFrame | str | None,
    dest: str,
    options: ExportOptions | None = None,
    identity: Mapping[str, object] | None = None,
    prefix: str = "wp_",
    layout: SiteLayout | None = None,
    inactive_themes: DataFrame | None = None,
    inactive_plugins: DataFrame | None = None,
    parallel: int = 4,
    post_export: Callable[[str], None] | None = None,
) -> DataFrame:
    """Write filtered tables, pruned files and a manifest; return one row ``(tables, files, bytes)``.

    ``files`` is a mounted folder, read in pieces, or a table ``(rel, mtime, content)``. Inactive
    components are given by ``name``, for the switches that leave them out. Counts come from the pass
    that writes. The manifest is written last, so a folder without one is unfinished.
    """
    spark = SparkSession.active()
    options, layout = options or ExportOptions(), layout or SiteLayout()
    chosen = chosen_tables(tables, prefix, options)

    def write(item: tuple[str, DataFrame]) -> int:
        name, df = item
        seen = Observation(name)
        kept = drop_disposable(df, name, options, prefix).observe(seen, F.count(F.lit(1)).alias("rows"))
        kept.write.parquet(f"{dest}/tables/{name}")
        return seen.get["rows"]

    def copy_files() -> tuple[int, int]:
        if files is None:
            return 0, 0
        pruned = excluded_prefixes(options, layout)
        if isinstance(files, str):
            kept = file_inventory(spark, files, PRUNED_NAMES, pruned)
        else:
            kept = prune_paths(files, PRUNED_NAMES, pruned)
        for unused in component_prefixes(options, layout, inactive_themes, inactive_plugins):
            kept = prune_paths(kept, (), unused)
        if isinstance(files, str):
            pieces = file_pieces(kept, files, CHUNK_BYTES)
        else:
            pieces = cut_content(kept)
        seen = Observation("entries")
        named = pieces.withColumn("rel", F.concat(F.lit(CONTENT_ROOT), "rel")).observe(
            seen,
            F.count_if(F.col("chunk_no") == 0).alias("files"),
            F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
        )
        write_entries(named, f"{dest}/entries", mode="errorifexists")
        return seen.get["files"], seen.get["bytes"]

    # Independent jobs, submitted together.
    with ThreadPoolExecutor(parallel) as pool:
        copied = pool.submit(copy_files)
        rows = dict(zip(chosen, pool.map(write, chosen.items()), strict=True))
        file_count, content_bytes = copied.result()

    write_manifest(spark, dest, list(chosen), options, rows, file_count, content_bytes, prefix, identity)
    if post_export is not None:
        post_export(dest)
    return spark.createDataFrame(
        [(len(chosen), file_count, content_bytes)], "tables long, files long, bytes long"
    )


# ---------------------------------------------------------------- read


def read_snapshot(
    spark: SparkSession, path: str, expected: str = FORMAT
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The manifest and the tables it lists; refused before any data is read if it does not fit."""
    manifest = if_present(lambda: spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest"))
    rows = [] if manifest is None else manifest.select("tables", supported(manifest, expected).alias("ok")).head(2)
    if len(rows) != 1 or not rows[0].ok:
        raise ValueError(f"{path} holds no manifest of a supported format and version")
    names = rows[0].tables or []
    return manifest, {name: spark.read.parquet(f"{path}/tables/{name}") for name in names}


# ---------------------------------------------------------------- restore


def if_present(load: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``load`` reads, or None where the path is not there."""
    try:
        return load()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _publications(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """``(number, version)`` of the last publication; empty before the first one."""
    log = if_present(lambda: spark.read.option("wholetext", True).text(f"{target}/published"))
    if log is None:
        return []
    entry = F.struct(F.regexp_extract("_metadata.file_name", "[0-9]+", 0).cast("long").alias("number"), F.col("value").cast("int").alias("version"))
    last = log.filter("value != ''").agg(F.max(entry).alias("last")).head().last
    return [] if last is None else [(last.number, last.version)]


def current_version(spark: SparkSession, target: str) -> int:
    """The published version of a target; 0 when there is none yet."""
    return next((version for _, version in _publications(spark, target)), 0)


def publish(spark: SparkSession, target: str, version: int) -> None:
    """Make a version the current one.

    Publications are numbered. The next number's file is created only if nobody has created it; whoever comes second takes the number after it, so each
    of several restores is published, one after the other.
    """
    number = next((n for n, _ in _publications(spark, target)), 0) + 1
    while not create_once(spark, f"{target}/published/{number:012}", str(version)):
        number += 1


def open_version(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A table of the published version."""
    version = current_version(spark, target)
    return spark.read.parquet(f"{target}/v={version}/tables/{table}")


def _staging_version(spark: SparkSession, target: str, snapshot: str) -> int:
    """A version whose folder nobody else has; a failed attempt leaves its own behind."""
    version = current_version(spark, target) + 1
    while not create_once(spark, f"{target}/v={version}/claimed", snapshot):
        version += 1
    return version


def identity_pairs(
    source: Mapping[str, str], target: Mapping[str, str]
) -> list[tuple[str, str]]:
    """The rewrite pairs for one site, under the rules of ``replacement_pairs``."""
    pairs: dict[str, str] = {}
    for field in IDENTITY:
        old, new = source.get(field) or "", target.get(field) or ""
        if old and old != new:
            pairs.setdefault(old, new)
    return list(pairs.items())


# Where the manifest keeps each identity field.
IDENTITY_FIELDS = {
    "home": "homeUrl",
    "siteurl": "siteUrl",
    "content": "contentDir",
    "abspath": "abspath",
}


def restore_snapshot(
    spark: SparkSession,
    snapshot: str,
    target: str,
    identity: Mapping[str, str],
    keys: Mapping[str, Sequence[str]],
    prefix: str = "wp_",
    include_files: bool = True,
    protected: Sequence[str] = (),
    hook: Callable[[dict[str, DataFrame]], None] | None = None,
    site_multisite: bool = False,
    allow_multisite: bool = False,
) -> DataFrame:
    """Restore as a new version and publish it only when everything is in place.

    Returns one row ``(tables, rows, replaced, files, unrewritten)``; the last lists tables that have no keys and were
    copied with their old identifiers. Rows, files and bytes must be those that the manifest counts. The published version is never modified,
    so an error at any point, the hook's included, leaves the target as it was. Restores that run at the same time have versions of
    their own and are published one after the other.
    """
    manifest, tables = read_snapshot(spark, snapshot)
    facts = manifest.head()
    if facts.tablePrefix and facts.tablePrefix != prefix:
        raise ValueError(f"table prefix mismatch: {facts.tablePrefix} in the snapshot, {prefix} here")
    if (facts.multisite or site_multisite) and not allow_multisite:
        raise ValueError("a network snapshot, or a network site, cannot be restored here")

    version = _staging_version(spark, target, snapshot)
    stage = f"{target}/v={version}"

    source = {field: facts[column] for field, column in IDENTITY_FIELDS.items()}
    pairs = identity_pairs(source, identity)
    rewritten = [t for t in tables if pairs and keys.get(t)]
    unchanged = [t for t in tables if t not in rewritten]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda t: tables[t].write.parquet(f"{stage}/tables/{t}"), unchanged))
    replaced = 0
    if rewritten:
        report = rewrite_database(
            {t: tables[t] for t in rewritten}, keys, pairs, dry_run=False, dest=f"{stage}/tables"
        )
        replaced = report.filter(F.col("table_name").isNull()).head().changes
    staged = {name: spark.read.parquet(f"{stage}/tables/{name}") for name in tables}
    rows, counted = 0, facts.rows or {}
    for name, df in staged.items():
        count, expected = df.count(), counted.get(name)  # row counts from file footers
        if expected is None:  # a manifest that does not count
            expected = tables[name].count()
        if count != expected:
            raise RuntimeError(f"{name}: {count} rows staged, {expected} in the snapshot")
        rows += count

    files = 0
    if include_files:
        files = _restore_files(spark, snapshot, stage, protected, facts.files, facts.bytes)
    if hook is not None:
        hook(staged)
    publish(spark, target, version)
    return spark.createDataFrame(
        [(len(rewritten), rows, replaced, files, unchanged if pairs else [])],
        "tables long, rows long, replaced long, files long, unrewritten array<string>",
    )


def _restore_files(
    spark: SparkSession,
    snapshot: str,
    stage: str,
    protected: Sequence[str],
    files: int | None,
    size: int | None,
) -> int:
    """Copy the entries that may be placed; the same pass checks every stored piece and counts for the manifest."""
    path = f"{snapshot}/entries"
    stored = if_present(lambda: spark.read.parquet(path))
    if stored is None:  # a snapshot of tables only
        if files:
            raise RuntimeError(f"no entries are there, {files} in the manifest")
        return 0
    partial = _entry_facts(stored).filter(~F.col("whole")).select("rel").head(1)
    if partial:
        raise RuntimeError(f"pieces are missing, or there twice, in {partial[0].rel}")
    seen, copied = Observation("stored"), Observation("placed")
    checked = stored.observe(
        seen,
        F.count_if(F.col("chunk_no") == 0).alias("files"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
        F.count_if(_broken()).alias("broken"),
    )
    guarded = guard_paths(checked.withColumnRenamed("rel", "path"), CONTENT_ROOT, protected)
    placed = guarded.filter(F.col("verdict") == "ok").select(
        F.substring("path", len(CONTENT_ROOT) + 1, 2**31 - 1).alias("rel"),
        "size", "mtime", "chunk_no", "start", "length", "content", "crc", "share",
    )
    counted = placed.observe(copied, F.count_if(F.col("chunk_no") == 0).alias("files"))
    write_entries(counted, f"{stage}/entries", mode="errorifexists")
    facts = seen.get
    if facts["broken"]:
        bad = verify_entries(spark, path).filter(F.col("status") == "corrupt").head()
        raise RuntimeError(f"checksum mismatch in {bad.rel}")
    if files is not None and (facts["files"], facts["bytes"]) != (files, size):
        raise RuntimeError(f"{facts['files']} files of {facts['bytes']} bytes are there, {files} of {size} in the manifest")
    return copied.get["files"]


def check_content(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Integrity of ``contents(rel, content)`` against ``entries(rel, crc)``."""
    actual = contents.select("rel", crc32_hex(F.col("content")).alias("crc"))
    return verify(entries.select("rel", "crc"), actual)
