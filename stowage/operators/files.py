"""File lists: pruning, guarding, size roll-ups, catalogue and integrity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.columns import (
    base_name, depth, human_size, parent_dir, path_and_ancestors,
)
from stowage.operators.ranking import rank_within, top_within
from stowage.operators.relational import ExportOptions, difference

# Names never taken into a snapshot, wherever they occur in a path.
PRUNED_NAMES = ["node_modules", ".git", ".DS_Store"]


@dataclass
class SiteLayout:
    """Folders below the content root that the export switches refer to."""

    uploads: str = "uploads"
    themes: str = "themes"
    must_use_plugins: str = "mu-plugins"
    plugins: str = "plugins"
    cache: str = "cache"
    workspace: str = "snapshots"


def user_prefixes(paths: Sequence[str]) -> list[str]:
    """Excluded paths as users write them, made relative; those that climb out are ignored."""
    tidy = [p.replace("\\", "/").lstrip("/") for p in paths]
    return [p for p in tidy if p and ".." not in p]


def excluded_prefixes(options: ExportOptions, layout: SiteLayout = SiteLayout()) -> list[str]:
    """Prefixes the options name, without the inactive components (see ``component_prefixes``)."""
    folders = [getattr(layout, field) for field in options.folders()]
    return list(dict.fromkeys([layout.workspace, *folders, *user_prefixes(options.paths)]))


def component_prefixes(
    options: ExportOptions,
    layout: SiteLayout,
    inactive_themes: DataFrame | None = None,
    inactive_plugins: DataFrame | None = None,
) -> list[DataFrame]:
    """Inactive components as ``prefix`` rows, for the options that leave only these out."""
    names = {"themes": inactive_themes, "plugins": inactive_plugins}
    return [
        names[part].select(F.concat(F.lit(f"{getattr(layout, part)}/"), "name").alias("prefix"))
        for part in options.unused_parts()
        if names[part] is not None
    ]


def prune_paths(
    files: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] | DataFrame = ()
) -> DataFrame:
    """Files with no segment in ``names`` and not at or under a prefix (``cache`` spares ``cache2``).

    A list of prefixes is part of the filter; a table of them is joined, however many there are. Both are tidied
    alike: ``\\`` is ``/``, trailing slashes do not count, empty and NULL prefixes name nothing. A NULL path stays.
    """
    rel = F.col("rel")
    if names:
        segments = F.array(*[F.lit(n) for n in names])
        files = files.filter(~F.coalesce(F.arrays_overlap(F.split(rel, "/"), segments), F.lit(False)))
    if isinstance(prefixes, DataFrame):
        tidy = prefixes.select(F.rtrim(F.replace("prefix", F.lit("\\"), F.lit("/")), F.lit("/")).alias("prefix"))
        return prune_joined(files, tidy.filter("prefix != ''").distinct())
    tidy = {p.replace("\\", "/").rstrip("/") for p in prefixes if p} - {""}
    if not tidy:
        return files
    under = F.arrays_overlap(path_and_ancestors(rel), F.array(*[F.lit(p) for p in sorted(tidy)]))
    return files.filter(~F.coalesce(under, F.lit(False)))


def prune_joined(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """By equi-joins, on distinct folders instead of on files: no join sees one row per file for a wide prefix."""
    folders = files.select(parent_dir(F.col("rel")).alias("_dir")).distinct()
    hit = (
        folders.select("_dir", F.explode(path_and_ancestors(F.col("_dir"))).alias("prefix"))
        .join(prefixes, "prefix", "left_semi")
        .select("_dir")
    )
    by_folder = difference(files.withColumn("_dir", parent_dir(F.col("rel"))), hit, ["_dir"])
    itself = prefixes.select(F.col("prefix").alias("rel"))
    return difference(by_folder.drop("_dir"), itself, ["rel"])


def guard_paths(
    entries: DataFrame, root: str = "wp-content/", protected: Sequence[str] = ()
) -> DataFrame:
    """``verdict`` per entry path: ok, foreign, protected, empty, climbs or absolute."""
    path = F.col("path")
    relative = F.substring(path, len(root) + 1, 2**31 - 1)
    verdict = F.when(~F.startswith(path, F.lit(root)), "foreign")
    for prefix in protected:
        verdict = verdict.when(F.startswith(path, F.lit(prefix)), "protected")
    verdict = (
        verdict.when(relative == "", "empty")
        .when(F.contains(relative, F.lit("..")), "climbs")
        .when(F.startswith(relative, F.lit("/")), "absolute")
        .otherwise("ok")
    )
    return entries.withColumn("verdict", verdict)


# ---------------------------------------------------------------- sizes


def _folder_and_above(folder: Column) -> Column:
    above = F.concat(F.array(F.lit("")), path_and_ancestors(folder))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(above)


def dir_rollup(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Per folder: bytes beneath, and files plus folders beneath; the root row has path ``''``.

    Folders follow from the files in them; ``folders(rel)`` adds those that hold none.

    Files are read once and first summed per folder, before any path is spread over its ancestors,
    so what is exploded and shuffled grows with the number of folders only. The folders that come out
    of that then each count once for every folder above them.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    held = files.select(parent_dir(F.col("rel")).alias("folder"), F.col("size").cast("long").alias("size"), one.alias("nodes"))
    if folders is not None:
        held = held.unionByName(folders.select(F.col("rel").alias("folder"), none.alias("size"), none.alias("nodes")))
    direct = held.groupBy("folder").agg(F.sum("size").alias("size"), F.sum("nodes").alias("nodes"))
    totals = (
        direct.select(F.explode(_folder_and_above(F.col("folder"))).alias("rel"), "size", "nodes")
        .groupBy("rel")
        .agg(F.sum("size").alias("size"), F.sum("nodes").alias("nodes"))
    )
    itself = F.struct("rel", "size", "nodes")
    above = F.transform(
        F.when(F.col("rel") == "", F.array().cast("array<string>")).otherwise(
            _folder_and_above(parent_dir(F.col("rel")))
        ),
        lambda folder: F.struct(folder.alias("rel"), none.alias("size"), one.alias("nodes")),
    )
    return (
        totals.select(F.inline(F.concat(F.array(itself), above)))
        .groupBy("rel")
        .agg(F.sum("size").alias("size"), F.sum("nodes").alias("nodes"))
        .select(depth(F.col("rel")).alias("depth"), "rel", "size", "nodes")
    )


def size_tree(
    files: DataFrame,
    max_depth: int = 4,
    file_threshold: int = 1 << 20,
    skip: Sequence[str] = (),
    folders: DataFrame | None = None,
) -> DataFrame:
    """Folders, and large files, down to ``max_depth``, ranked among siblings by size then name.

    Whatever lies deeper, or is smaller, still counts in the sizes of the folders above it. ``folders(rel)`` adds those without files.
    """
    kept = prune_paths(files, PRUNED_NAMES, skip)
    folders = None if folders is None else prune_paths(folders, PRUNED_NAMES, skip)
    rel = F.col("rel")
    listed_folders = (
        dir_rollup(kept, folders)
        .filter((rel != "") & (F.col("depth") <= max_depth))
        .select("rel", F.lit(True).alias("dir"), "size", "nodes")
    )
    large = kept.filter((F.col("size") >= file_threshold) & (depth(rel) <= max_depth)).select(
        "rel", F.lit(False).alias("dir"), "size", F.lit(0).cast("long").alias("nodes")
    )
    listed = listed_folders.unionByName(large).select(
        parent_dir(rel).alias("parent"), "rel", base_name(rel).alias("name"), "dir", "size", "nodes"
    )
    return rank_within(listed, ["parent"], [F.desc("size"), F.asc("name")]).select(
        "parent", "rank", "rel", "name", "dir", "size", "nodes"
    )


def largest(
    files: DataFrame, group: str, k: int, threshold: int = 0, tie: str = "rel"
) -> DataFrame:
    """The ``k`` largest items per group, from a size on."""
    kept = files.filter(F.col("size") >= threshold)
    return top_within(kept, [group], [F.desc("size"), F.asc(tie)], k)


def export_summary(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tables, files and bytes of a set of entries, in total or rolled up by columns."""
    grouped = entries.rollup(*by) if by else entries.groupBy()
    return grouped.agg(
        F.count_if(F.col("type") == "table").alias("tables"),
        F.count_if(F.col("type") == "file").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


# ---------------------------------------------------------------- catalogue and integrity


def catalogue(
    files: DataFrame,
    suffix: str = ".snapshot",
    compressed_suffix: str = ".gz",
    hidden: Sequence[str] = ("upload-", "restore-"),
) -> DataFrame:
    """Finished snapshot files, newest first, with their date in UTC and a readable size."""
    name = base_name(F.col("rel"))
    packed = F.endswith(name, F.lit(suffix + compressed_suffix))
    kept = packed | F.endswith(name, F.lit(suffix))
    for prefix in hidden:
        kept = kept & ~F.startswith(name, F.lit(prefix))
    return (
        files.filter(kept)
        .select(
            name.alias("file"),
            "size",
            human_size(F.col("size")).alias("size_text"),
            F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("date"),
            packed.alias("compressed"),
        )
        .orderBy(F.desc("date"), F.asc("file"))
    )


def verify(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Stored against actual checksums: ``(rel, status)``.

    ``entries(rel, crc)`` says what should be there and ``contents(rel, crc)`` what is; take the
    checksum of content before calling, so that the content itself is not shuffled. Both sides meet
    in one aggregation, which combines repeated paths before its shuffle. An entry without a
    checksum cannot be verified, which is not an error.
    """
    stored = entries.select("rel", F.col("crc").alias("stored"), F.lit(True).alias("listed"))
    actual = contents.select("rel", F.col("crc").alias("actual"), F.lit(False).alias("listed"))
    both = stored.unionByName(actual, allowMissingColumns=True).groupBy("rel").agg(
        F.count_if("listed").alias("listed"),
        F.count_if(~F.col("listed")).alias("found"),
        F.min("stored").alias("stored_low"),
        F.max("stored").alias("stored_high"),
        F.min("actual").alias("actual_low"),
        F.max("actual").alias("actual_high"),
    )
    same = (
        (F.col("stored_low") == F.col("actual_low"))
        & (F.col("stored_high") == F.col("actual_high"))
        & (F.col("stored_low") == F.col("stored_high"))
    )
    status = (
        F.when(F.col("found") == 0, "missing")
        .when(F.col("listed") == 0, "extra")
        .when(F.col("stored_low").isNull() | F.col("actual_low").isNull(), "unverifiable")
        .when(same, "ok")
        .otherwise("corrupt")
    )
    return both.select("rel", status.alias("status"))
