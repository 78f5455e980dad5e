"""Manifests: what a snapshot says about itself, and checks before a restore."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.columns import human_size, manifest_supported, version_newer

FORMAT = "stowage-snapshot"
FORMAT_VERSION = 1

# The fields of a manifest.
MANIFEST_SCHEMA = """
    format string,
    formatVersion int,
    generator string,
    generatorVersion string,
    siteUrl string,
    homeUrl string,
    abspath string,
    contentDir string,
    uploadsDir string,
    tablePrefix string,
    wpVersion string,
    phpVersion string,
    multisite boolean,
    wooActive boolean,
    wooHpos boolean,
    tables array<string>,
    excludes map<string,boolean>,
    rows map<string,bigint>,
    files bigint,
    bytes bigint
"""

# Space a restore may need, as a multiple of the snapshot's size.
COMPRESSED_FACTOR = 3.5
RAW_FACTOR = 1.5


def parse_manifests(json_text: Column) -> Column:
    """Manifest fields from JSON; text that does not parse gives a manifest of NULLs."""
    return F.from_json(json_text, MANIFEST_SCHEMA, {"mode": "PERMISSIVE"})


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def manifest_summary(manifests: DataFrame, id_column: str) -> DataFrame:
    """Label and value rows per manifest, in display order."""

    def row(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"))

    def yes(col: Column) -> Column:
        return F.when(col, "Yes").otherwise("No")

    # The labels and their order.
    made_with = F.concat_ws(" ", _text(F.col("generator")), _text(F.col("generatorVersion")))
    shop = row("WooCommerce", F.when(F.col("wooHpos"), "Yes (HPOS)").otherwise("Yes"))
    rows = F.array(
        row("Source site", _text(F.col("siteUrl"))),
        row("Made with", made_with),
        row("WordPress", _text(F.col("wpVersion"))),
        row("PHP", _text(F.col("phpVersion"))),
        row("Table prefix", _text(F.col("tablePrefix"))),
        row("Tables", F.size(F.coalesce("tables", F.array())).cast("string")),
        row("Multisite", yes(F.col("multisite"))),
        F.when(F.col("wooActive"), shop),
    )
    kept = F.filter(rows, lambda r: r.isNotNull())
    return manifests.select(id_column, F.posexplode(kept).alias("ord", "row")).select(
        id_column, "ord", "row.label", "row.value"
    )


@dataclass
class Target:
    """The site a snapshot is to be restored on."""

    prefix: str = "wp_"
    multisite: bool = False
    free_bytes: int | None = None
    writable: bool = True
    php_version: str = "8.2"


def preflight(manifests: DataFrame, target: Target, id_column: str) -> DataFrame:
    """Check rows ``(id, level, label, message)`` per manifest; levels are error, warn and ok.

    ``manifests`` also holds ``archive_bytes`` and ``compressed``. The target is one site, so its
    facts become literals; no join is involved.
    """

    def check(condition: Column, level: str, label: str, message: Column) -> Column:
        found = F.struct(
            F.lit(level).alias("level"), F.lit(label).alias("label"), message.alias("message")
        )
        return F.when(condition, found)

    # Levels and labels of the checks.
    prefix = _text(F.col("tablePrefix"))
    foreign = (prefix != "") & (prefix != target.prefix)
    factor = F.when(F.col("compressed"), COMPRESSED_FACTOR).otherwise(RAW_FACTOR)
    needed = (F.col("archive_bytes") * factor).cast("long")
    free = F.lit(target.free_bytes).cast("long")
    known = free > 0
    php = _text(F.col("phpVersion"))
    checks = F.array(
        check(
            foreign,
            "error",
            "Table prefix",
            F.concat(
                F.lit("Snapshot tables start with "), prefix, F.lit(f", this site's with {target.prefix}.")
            ),
        ),
        check(~foreign, "ok", "Table prefix", F.lit(f"Matches ({target.prefix}).")),
        check(
            F.coalesce(F.col("multisite"), F.lit(False)) | F.lit(target.multisite),
            "warn",
            "Multisite",
            F.lit("Snapshot or site is a network; a restore will be refused."),
        ),
        check(
            known & (free < needed),
            "warn",
            "Disk space",
            F.concat(human_size(free), F.lit(" free, about "), human_size(needed), F.lit(" needed.")),
        ),
        check(known & (free >= needed), "ok", "Disk space", F.concat(human_size(free), F.lit(" free."))),
        check(
            F.lit(not target.writable), "error", "Writable files", F.lit("Content folder is read-only.")
        ),
        check(
            (php != "") & version_newer(php, F.lit(target.php_version)),
            "warn",
            "PHP version",
            F.concat(F.lit("Made on PHP "), php, F.lit(f", this site runs {target.php_version}.")),
        ),
    )
    found = F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("found")
    return manifests.select(id_column, found).select(
        id_column, "found.level", "found.label", "found.message"
    )


def supported(manifests: DataFrame, expected: str = FORMAT) -> Column:
    return manifest_supported(
        manifests["format"], manifests["formatVersion"], expected, FORMAT_VERSION
    )


def with_pairs(source: Sequence[Column], target: Sequence[Column]) -> Column:
    """Old and new identifiers as an ordered array of ``struct<from, to>``, ready to apply.

    An empty or unchanged source is left out, and a source listed before counts once, so that no
    value is rewritten twice. All within the row.
    """
    listed = F.array(
        *[
            F.struct(_text(old).alias("from"), _text(new).alias("to"))
            for old, new in zip(source, target, strict=True)
        ]
    )
    useful = F.filter(listed, lambda p: (p["from"] != "") & (p["from"] != p["to"]))
    first = F.transform(useful, lambda p: p["from"])
    return F.filter(
        useful, lambda p, at: F.array_position(first, p["from"]) == at.cast("long") + 1
    )


# Identity fields in the order their pairs apply.
IDENTITY = ["home", "siteurl", "content", "abspath"]


def replacement_pairs(identities: DataFrame, site: str) -> DataFrame:
    """Pairs ``(site, ord, from, to)`` from columns ``source_<field>`` and ``target_<field>``."""
    pairs = with_pairs(
        [F.col(f"source_{f}") for f in IDENTITY], [F.col(f"target_{f}") for f in IDENTITY]
    )
    return identities.select(site, F.posexplode(pairs).alias("ord", "pair")).select(
        site, "ord", "pair.from", "pair.to"
    )
