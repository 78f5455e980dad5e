"""Filters, set operations and paging over tables and table lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.columns import TRIM_CHARS, named


@dataclass(frozen=True)
class Rule:
    """What one switch leaves out: whole tables, rows of a table, a folder, or unused parts of a folder.

    ``rows`` is a table and the SQL condition of the rows that stay; a NULL in it drops the row, as in SQL.
    ``folder`` and ``unused`` name a field of ``SiteLayout``; ``everything`` is the whole database.
    """

    switch: str
    tables: tuple[str, ...] = ()
    rows: tuple[str, str] | None = None
    folder: str | None = None
    unused: str | None = None
    everything: bool = False


# The switches of an export and what each names. Tables are without their prefix.
RULES = (
    Rule("no_database", everything=True),
    Rule("no_media", folder="uploads"),
    Rule("no_themes", folder="themes"),
    Rule("no_inactive_themes", unused="themes"),
    Rule("no_muplugins", folder="must_use_plugins"),
    Rule("no_plugins", folder="plugins"),
    Rule("no_inactive_plugins", unused="plugins"),
    Rule("no_cache", folder="cache"),
    Rule("no_spam_comments", rows=("comments", "comment_approved != 'spam'")),
    Rule("no_post_revisions", rows=("posts", "post_type != 'revision'")),
    Rule(
        "no_transients",
        rows=("options", r"NOT startswith(option_name, '_transient_') AND NOT startswith(option_name, '_site_transient_')"),
    ),
    Rule("no_sessions", tables=("woocommerce_sessions",)),
    Rule(
        "no_action_scheduler",
        tables=("actionscheduler_logs", "actionscheduler_actions", "actionscheduler_claims", "actionscheduler_groups"),
    ),
)


@dataclass(frozen=True)
class ExportOptions:
    """The rules in force, and further tables and paths to leave out."""

    rules: tuple[Rule, ...] = ()
    tables: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict) -> ExportOptions:
        """From decoded JSON: a switch is on unless empty, zero or ``"0"``; lists of another type count as empty."""
        on = tuple(rule for rule in RULES if raw.get(rule.switch) and raw[rule.switch] != "0")
        lists = (raw.get(key) for key in ("exclude_tables", "exclude_paths"))
        return cls(on, *(tuple(distinct_names(x)) if isinstance(x, (list, tuple)) else () for x in lists))

    @property
    def excludes(self) -> dict[str, bool]:
        """Every switch and whether it is on, as a manifest records it."""
        return {rule.switch: rule in self.rules for rule in RULES}

    def folders(self) -> list[str]:
        return [rule.folder for rule in self.rules if rule.folder]

    def unused_parts(self) -> list[str]:
        """Folders of which only unused parts are left out; those left out as a whole need no such list."""
        return [rule.unused for rule in self.rules if rule.unused and rule.unused not in self.folders()]

    def takes_table(self, name: Column, prefix: str) -> Column:
        """Whether an export takes a table: it has the prefix and no rule or list names it."""
        if any(rule.everything for rule in self.rules):
            return F.lit(False)
        unwanted = [prefix + t for rule in self.rules for t in rule.tables] + list(self.tables)
        taken = F.startswith(name, F.lit(prefix))
        return taken & ~name.isin(unwanted) if unwanted else taken


def distinct_names(items: Sequence[object]) -> list[str]:
    texts = [str(item).strip(TRIM_CHARS) for item in items if item is not None]
    return sorted({t for t in texts if t}, key=texts.index)


def drop_disposable(
    df: DataFrame, table: str, options: ExportOptions, prefix: str = "wp_"
) -> DataFrame:
    """Rows of one table without the disposable ones; the filter reaches the scan."""
    for rule in options.rules:
        if rule.rows and table == prefix + rule.rows[0]:
            df = df.filter(rule.rows[1])
    return df


def where_filters(df: DataFrame, table: str, filters: dict[str, Column]) -> DataFrame:
    """The general form: caller-supplied condition per table."""
    return df.filter(filters[table]) if table in filters else df


def select_tables(
    catalog: DataFrame, prefix: str, options: ExportOptions, include_views: bool = False
) -> DataFrame:
    """Names from ``catalog(name, kind)`` that an export takes: prefixed, not skipped.

    The options are values, so they become part of the filter instead of a join.
    """
    kinds = ["BASE TABLE", "VIEW"] if include_views else ["BASE TABLE"]
    return catalog.filter(options.takes_table(F.col("name"), prefix) & F.col("kind").isin(kinds))


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; duplicates stay, unlike in EXCEPT.

    The right side is cut to distinct keys before its shuffle, so a frequent key weighs nothing
    there, and adaptive execution may split a frequent key of the left side.
    """
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def union_distinct(*lists: DataFrame) -> DataFrame:
    """Merged one-column lists without empty values and duplicates."""
    merged = reduce(DataFrame.unionByName, lists)
    return merged.filter(named(merged.columns[0]) != "").distinct()


def entry_union(*parts: DataFrame) -> DataFrame:
    """Entries of several kinds as one set; columns a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def inactive(components: DataFrame, active: DataFrame, always: Sequence[str] = ()) -> DataFrame:
    """Components, by ``name``, that are neither active nor always kept."""
    kept = components.filter(~F.col("name").isin(list(always))) if always else components
    return difference(kept, active, ["name"])


def page(df: DataFrame, keys: Sequence[str], number: int, size: int) -> DataFrame:
    """The ``number``-th page (from 0) in key order, for the first pages of a table; ``operators.paging`` seeks to any page."""
    return df.orderBy(*[named(k) for k in keys]).offset(number * size).limit(size)
