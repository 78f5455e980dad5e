"""A snapshot written in slices that can be stopped, or die, at any point and gone on with."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stowage.operators.files import PRUNED_NAMES, SiteLayout, component_prefixes, excluded_prefixes, prune_paths
from stowage.operators.relational import ExportOptions, drop_disposable
from stowage.plans.snapshot import CHUNK_BYTES, CONTENT_ROOT, chosen_tables, cut_content, if_present, write_manifest
from stowage.sources.inventory import file_inventory, file_pieces, files_still_there
from stowage.streaming.streams import FILES_PER_SLICE

LEDGER = "kind string, name string, listed long, rows long, files long, bytes long"
LISTED = "rel string, size long, mtime timestamp"
CONTENT = "rel string, mtime timestamp, content binary"


class _Paused(Exception):
    """Ends a run between two slices."""


@dataclass
class ResumableExport:
    """One export job; made again with the same arguments, it goes on with what ``dest`` holds.

    Tables come first, then the files in slices, the manifest last. Each table and each slice has a folder of its own, which is
    overwritten as a whole, and one ledger entry, written after it: what a dead run left half done is done
    again, and what the ledger has is never touched. A snapshot without a manifest is unfinished.

    Content is given in one of two ways. ``folder`` is a mounted folder: its files are listed once, the list is kept in parts of
    ``slice_files``, and a slice copies one part. Files that are gone by then are left out. ``content`` is the path of a
    stored table ``(rel, mtime, content)``, of which a slice takes ``slice_parts`` data files.
    """

    spark: SparkSession
    dest: str
    tables: Mapping[str, DataFrame]
    folder: str | None = None
    content: str | None = None
    options: ExportOptions = field(default_factory=ExportOptions)
    identity: Mapping[str, object] | None = None
    prefix: str = "wp_"
    layout: SiteLayout = field(default_factory=SiteLayout)
    inactive_themes: DataFrame | None = None
    inactive_plugins: DataFrame | None = None
    slice_files: int = FILES_PER_SLICE
    slice_parts: int = 16
    before_slice: Callable[[int], None] | None = None

    def __post_init__(self):
        if self.folder is not None and self.content is not None:
            raise ValueError("give a folder or a content table, not both")
        self.job = f"{self.dest}/job"

    # ------------------------------------------------------------ ledger

    def ledger(self) -> DataFrame:
        """What is done: one row per table, for the list, and per slice."""
        found = if_present(lambda: self.spark.read.schema(LEDGER).parquet(f"{self.job}/ledger"))
        return self.spark.createDataFrame([], LEDGER) if found is None else found

    def _enter(self, kind: str, name: str, listed: int = 0, rows: int = 0, files: int = 0, size: int = 0) -> None:
        entry = self.spark.createDataFrame([(listed, rows, files, size)], "listed long, rows long, files long, bytes long")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.job}/ledger/kind={kind}/name={name}")

    def _done(self, kind: str) -> set[str]:
        return {r.name for r in self.ledger().filter(F.col("kind") == kind).select("name").collect()}

    def state(self) -> DataFrame:
        """One row ``(status, listed, done, slices, tables, files, bytes)``; ``listed`` is NULL for a content table until all is done."""
        of = lambda kind, column: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))
        finished = if_present(lambda: self.spark.read.text(f"{self.dest}/manifest")) is not None
        status = "done" if finished else "running"
        return self.ledger().agg(
            F.lit(status).alias("status"),
            F.max(F.when(F.col("kind") == "list", F.col("listed"))).alias("listed"),
            of("slice", "listed").alias("done"),
            F.count_if(F.col("kind") == "slice").alias("slices"),
            F.count_if(F.col("kind") == "table").alias("tables"),
            of("slice", "files").alias("files"),
            of("slice", "bytes").alias("bytes"),
        )

    # ------------------------------------------------------------ steps

    def run(self, max_slices: int | None = None, budget_s: float | None = None) -> DataFrame:
        """Do what is left, at most ``max_slices`` slices of it, and return the state.

        With ``budget_s``, no further slice is begun once so many seconds have gone by; at least one slice is done.
        """
        began = time.monotonic()
        if self.state().head().status == "done":
            return self.state()
        chosen = chosen_tables(self.tables, self.prefix, self.options)
        ready = self._done("table")
        for name in chosen:
            if name not in ready:
                self._write_table(name)
        over = lambda: budget_s is not None and time.monotonic() - began >= budget_s
        if self._files_are_done(max_slices, over):
            self._finish(list(chosen))
        return self.state()

    def _write_table(self, name: str) -> None:
        seen = Observation(name)
        kept = drop_disposable(self.tables[name], name, self.options, self.prefix).observe(seen, F.count(F.lit(1)).alias("rows"))
        kept.write.mode("overwrite").parquet(f"{self.dest}/tables/{name}")
        self._enter("table", name, rows=seen.get["rows"])

    def _pruned(self, files: DataFrame) -> DataFrame:
        files = prune_paths(files, PRUNED_NAMES, excluded_prefixes(self.options, self.layout))
        for unused in component_prefixes(self.options, self.layout, self.inactive_themes, self.inactive_plugins):
            files = prune_paths(files, (), unused)
        return files

    def _write_list(self) -> None:
        """The files to copy in path order, in parts of one slice each."""
        found = file_inventory(self.spark, self.folder, PRUNED_NAMES, excluded_prefixes(self.options, self.layout))
        listed = self._pruned(found).select("rel", "size", "mtime")
        parts = listed.repartitionByRange("rel").sortWithinPartitions("rel")
        parts.write.mode("overwrite").option("maxRecordsPerFile", self.slice_files).parquet(f"{self.job}/list")
        self._enter("list", "files", listed=self.spark.read.schema(LISTED).parquet(f"{self.job}/list").count())

    def _files_are_done(self, max_slices: int | None, over: Callable[[], bool]) -> bool:
        if self.folder is not None:
            if not self._done("list"):
                self._write_list()
            source, schema, parts, pieces = f"{self.job}/list", LISTED, 1, self._pieces_of_folder
        elif self.content is not None:
            source, schema, parts, pieces = self.content, CONTENT, self.slice_parts, self._pieces_of_content
        else:
            return True
        taken, paused = 0, False

        def copy(batch: DataFrame, number: int) -> None:
            nonlocal taken, paused
            if (max_slices is not None and taken >= max_slices) or (taken and over()):
                paused = True
                raise _Paused
            if self.before_slice is not None:
                self.before_slice(number)
            self._write_slice(pieces(batch), batch, number)
            taken += 1

        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(source)
        query = (
            stream.writeStream.foreachBatch(copy)
            .option("checkpointLocation", f"{self.job}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        try:
            query.awaitTermination()
        except PySparkException:
            if not paused:
                raise
        return not paused

    def _pieces_of_folder(self, batch: DataFrame) -> DataFrame:
        return file_pieces(files_still_there(batch, self.folder), self.folder, CHUNK_BYTES)

    def _pieces_of_content(self, batch: DataFrame) -> DataFrame:
        return cut_content(self._pruned(batch))

    def _write_slice(self, pieces: DataFrame, batch: DataFrame, number: int) -> None:
        seen = Observation(f"slice-{number}")
        named = pieces.withColumn("rel", F.concat(F.lit(CONTENT_ROOT), "rel")).observe(
            seen,
            F.count_if(F.col("chunk_no") == 0).alias("files"),
            F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
        )
        named.write.mode("overwrite").parquet(f"{self.dest}/entries/type=file/slice={number}")
        self._enter("slice", str(number), batch.count(), files=seen.get["files"], size=seen.get["bytes"])

    def _finish(self, chosen: list[str]) -> None:
        state = self.state().head()
        rows = {r.name: r.rows for r in self.ledger().filter("kind = 'table'").select("name", "rows").collect()}
        write_manifest(
            self.spark, self.dest, chosen, self.options, rows, state.files, state.bytes, self.prefix, self.identity
        )
