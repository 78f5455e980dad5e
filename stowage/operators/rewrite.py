"""Search-and-replace over whole tables, with dry-run counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.columns import check_pairs, named, stage_hits
from stowage.functions.payload import PLAIN, STRUCTURED, payload_udf, route

HITS, CHANGED = "_hits", "_changed"
OPAQUE, MALFORMED = "_opaque", "_malformed"


def rewrite_table(
    df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], kinds: bool = False
) -> DataFrame:
    """Every text column but the keys rewritten, plus ``_hits`` and ``_changed``.

    A cell is taken over only when something matched and its text differs. Batch and streaming
    input alike; projections only, no shuffle. Each step is a projection of its own, so that a
    cell is classified once and each replacement is made once, though its result is used twice.

    ``kinds`` adds ``_opaque`` and ``_malformed``: how many of the row's cells hold a match but were left alone as a whole, and how many look
    serialized, do not decode, and got the plain replacement. Columns of these names in the input are refused.
    """
    pairs = check_pairs(pairs)
    keys = resolved_keys(df, keys)
    added = [HITS, CHANGED, *([OPAQUE, MALFORMED] if kinds else [])]
    _refuse(df, added)
    text = _text_columns(df, keys)
    staged, names = _staged(df, text, pairs)
    for stage, (old, new) in enumerate(pairs, start=1):
        staged = staged.withColumns(
            {
                names(stage, i): F.replace(named(names(stage - 1, i)), F.lit(old), F.lit(new))
                for i in range(len(text))
            }
        )

    columns, hits, changes = [named(c) for c in df.columns], [], []
    for i, c in enumerate(text):
        stages = [named(names(stage, i)) for stage in range(len(pairs) + 1)]
        plain_hits = sum(
            (
                stage_hits(before, after, old, new)
                for before, after, (old, new) in zip(stages, stages[1:], pairs, strict=False)
            ),
            F.lit(0).cast("long"),
        )
        payload = named(names("payload", i))
        value = F.coalesce(stages[-1], payload["value"])
        found = F.coalesce(plain_hits, payload["hits"], F.lit(0))
        changed = F.coalesce((found > 0) & (value != named(c)), F.lit(False))
        columns[df.columns.index(c)] = F.when(changed, value).otherwise(named(c)).alias(c)
        hits.append(found)
        changes.append(changed)

    def cells(kind: str) -> Column:
        of_kind = [F.when(named(names("payload", i))["kind"] == kind, 1).otherwise(0) for i in range(len(text))]
        return sum(of_kind, F.lit(0)).cast("long")

    return staged.select(
        *columns,
        sum(hits, F.lit(0).cast("long")).alias(HITS),
        reduce(Column.__or__, changes, F.lit(False)).alias(CHANGED),
        *([cells("opaque").alias(OPAQUE), cells("malformed").alias(MALFORMED)] if kinds else []),
    )


def _refuse(df: DataFrame, added: Sequence[str]) -> None:
    clash = sorted(set(added) & set(df.columns))
    if clash:
        raise ValueError(f"the table has columns of its own called {', '.join(clash)}; rename them first")


def _text_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keys]


def _staged(
    df: DataFrame, text: Sequence[str], pairs: Sequence[tuple[str, str]]
) -> tuple[DataFrame, Callable[[object, int], str]]:
    """Each text column's way, its replacement in Python if it goes that way, and its text if it goes the plain one.

    Helper columns begin with more underscores than any column of the table, so no name clashes.
    """
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"

    def names(what: object, number: int) -> str:
        return f"{mark}{what}_{number}"

    replace_payload = payload_udf(pairs)
    staged = df.withColumns({names("way", i): route(named(c), pairs) for i, c in enumerate(text)})
    only = lambda i, wanted: F.when(named(names("way", i)) == wanted, named(text[i]))
    return staged.withColumns(
        {names("payload", i): replace_payload(only(i, STRUCTURED)) for i in range(len(text))}
        | {names(0, i): only(i, PLAIN) for i in range(len(text))}
    ), names


def left_alone(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The cells behind a report's ``opaque`` and ``malformed``: ``(*keys, column_name, kind, cell)``, as they are in the input."""
    pairs = check_pairs(pairs)
    keys = resolved_keys(df, keys)
    text = _text_columns(df, keys)
    staged, names = _staged(df, text, pairs)
    cells = [
        F.struct(F.lit(c).alias("column_name"), named(names("payload", i))["kind"].alias("kind"), named(c).alias("cell"))
        for i, c in enumerate(text)
    ]
    listed = F.filter(F.array(*cells), lambda cell: cell["kind"].isin("opaque", "malformed"))
    own = F.struct(*[named(k) for k in keys]).alias("key")
    if not text:
        return df.limit(0).select(own, *[F.lit(None).cast("string").alias(c) for c in ("column_name", "kind", "cell")]).select("key.*", "column_name", "kind", "cell")
    return staged.select(own, F.explode(listed).alias("cell")).select("key.*", "cell.*")


def resolved_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys as the columns are spelled, under the session's rule for letter case; unknown keys are refused."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    spelled = {c if exact else c.lower(): c for c in df.columns}
    unknown = [k for k in keys if (k if exact else k.lower()) not in spelled]
    if unknown:
        raise ValueError(f"no such key columns: {', '.join(unknown)}")
    return [spelled[k if exact else k.lower()] for k in keys]


def apply_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows found in ``changes`` replaced, by key; NULL is a valid new value.

    ``changes`` holds the keys and any of the other columns. A key that it holds twice fails the job: neither row
    could be preferred. The check is an aggregate on the keys, which the join needs together anyway.
    """
    own = [c for c in changes.columns if c not in keys]
    once = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*map(named, own)) if own else F.lit(True))).otherwise(
        F.raise_error(F.lit("a key occurs twice in the changes"))
    )
    changes = changes.groupBy(*map(named, keys)).agg(once.alias("_row"))
    changes = changes.select(*map(named, keys), *[F.col("_row")[c].alias(c) for c in own])
    updated = [c for c in base.columns if c in changes.columns and c not in keys]
    new = changes.select(
        *[named(k) for k in keys],
        F.lit(True).alias("_found"),
        *[named(c).alias(f"_new_{c}") for c in updated],
    )
    joined = base.join(new, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("_found"), named(f"_new_{c}")).otherwise(named(c)).alias(c)
            if c in updated
            else named(c)
            for c in base.columns
        ]
    )


def usable_keys(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """One row ``(table_name, usable)``: keys are declared, never NULL and unique.

    Counts are combined before the shuffle, so one frequent key costs one row per task.
    """
    name = F.lit(table).alias("table_name")
    if not keys:
        return df.limit(0).agg(F.count("*")).select(name, F.lit(False).alias("usable"))
    counts = df.groupBy(*[named(k) for k in keys]).agg(F.count("*").alias("_rows"))
    bad = reduce(Column.__or__, [named(k).isNull() for k in keys], F.col("_rows") > 1)
    return counts.agg((F.count_if(bad) == 0).alias("usable")).select(name, "usable")


def _row_counts() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(CHANGED).alias("changes"),
        total(HITS).alias("hits"),
        total(OPAQUE).alias("opaque"),
        total(MALFORMED).alias("malformed"),
    ]


def _counts(table: str, rewritten: DataFrame) -> DataFrame:
    return rewritten.agg(*_row_counts()).select(
        F.lit(table).alias("table_name"),
        F.lit(1).cast("long").alias("tables"),
        "rows",
        "changes",
        "hits",
        F.lit(0).cast("long").alias("skipped"),
        "opaque",
        "malformed",
    )


REPORT = "table_name string, tables long, rows long, changes long, hits long, skipped long, opaque long, malformed long"


def _with_total(report: DataFrame) -> DataFrame:
    return report.rollup("table_name").agg(*[F.sum(c).alias(c) for c in report.columns[1:]])


def rewrite_database(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    pairs: Sequence[tuple[str, str]],
    dry_run: bool = True,
    dest: str | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Rewrite many tables and report per table, with the total in the row without a name.

    A table without declared keys is skipped and counted as such. ``opaque`` and ``malformed`` count cells with a match that were
    left alone, or do not decode; ``left_alone`` lists them. A dry run only counts. A live run
    writes each table once to ``dest/<table>`` and takes its counts from that same pass; the tables
    are independent jobs, submitted together.
    """
    pairs = check_pairs(pairs)
    spark = SparkSession.active()
    skipped = [(name, 0, 0, 0, 0, 1, 0, 0) for name in tables if not keys.get(name)]
    rewritten = {
        name: rewrite_table(df, keys[name], pairs, kinds=True) for name, df in tables.items() if keys.get(name)
    }
    if dry_run:
        parts = [_counts(name, df) for name, df in rewritten.items()]
        if skipped or not parts:
            parts.append(spark.createDataFrame(skipped, REPORT))
        return _with_total(reduce(DataFrame.unionByName, parts))
    if dest is None:
        raise ValueError("a live run needs a destination")

    def write(item: tuple[str, DataFrame]) -> tuple:
        name, df = item
        seen = Observation(f"rewrite-{name}")
        counted = df.observe(seen, *_row_counts())
        counted.drop(HITS, CHANGED, OPAQUE, MALFORMED).write.parquet(f"{dest}/{name}")
        row = seen.get
        return (name, 1, row["rows"], row["changes"], row["hits"], 0, row["opaque"], row["malformed"])

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(write, rewritten.items()))
    return _with_total(spark.createDataFrame(rows + skipped, REPORT))


def remap_names(name: Column, old_prefix: str, new_prefix: str) -> Column:
    """Names that start with the old prefix moved to the new one, others unchanged."""
    rest = F.substring(name, len(old_prefix) + 1, 2**31 - 1)
    return F.when(
        F.startswith(name, F.lit(old_prefix)), F.concat(F.lit(new_prefix), rest)
    ).otherwise(name)


def remap_tables(
    tables: Mapping[str, DataFrame],
    rename: Callable[[str], str],
    transform: Callable[[DataFrame], DataFrame | None] | None = None,
) -> dict[str, DataFrame]:
    """Tables under other names; ``transform`` may change a table, or drop it by returning None."""
    moved = {}
    for name, df in tables.items():
        result = df if transform is None else transform(df)
        if result is not None:
            moved[rename(name)] = result
    return moved
