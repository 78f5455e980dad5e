"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.functions.payload import structured_replace
from stowage.operators import files as files_ops
from stowage.operators import paging
from stowage.operators import relational as rel_ops
from stowage.operators import rewrite as rw
from stowage.plans import manifest as manifests
from stowage.plans import snapshot as snap
from stowage.session import checkpointed, configure, local_path, scratch
from stowage.sources import archive, inventory, sqldump
from stowage.streaming import export, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        QUERIES[name] = configured
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(text: str) -> Column:
    return F.lit(text)


def long(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")


# The second pair sees what the first one wrote.
HOSTS = [("example.com", "shop.example.com"), ("shop.example", "store.example")]
ONE_HOST = HOSTS[:1]


def sql_hits(expr: str, old: str) -> str:
    return f"cast((strlen({expr}) - strlen(replace({expr}, '{old}', ''))) // {len(old)} AS BIGINT)"


def sql_human_size(expr: str) -> str:
    whens = []
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        scaled = f"({expr} / {float(1024**power)!r})"
        whens.append(
            f"WHEN {expr} >= {1024**power} THEN CASE WHEN {scaled} < 10 "
            f"THEN printf('%.1f', round({scaled}, 1)) "
            f"ELSE cast(cast(round({scaled}, 0) AS BIGINT) AS VARCHAR) END || ' {unit}'"
        )
    return f"CASE {' '.join(whens)} ELSE cast({expr} AS VARCHAR) || ' B' END"


SQL_ONCE = "replace(url, 'example.com', 'shop.example.com')"
SQL_TWICE = f"replace({SQL_ONCE}, 'shop.example', 'store.example')"


# ================================================================ rewriting


@query(
    "r1_replace_pairs",
    f"""
    SELECT page_id, {SQL_TWICE} AS value,
           {sql_hits('url', 'example.com')} + {sql_hits(SQL_ONCE, 'shop.example')} AS hits
    FROM pages
    """,
)
def r1_replace_pairs(spark, sf_dir):
    found = C.replace_pairs(F.col("url"), HOSTS)
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", found.alias("r"))
        .select("page_id", "r.value", "r.hits")
    )


def _serialized_text(df: DataFrame) -> Column:
    whole = F.concat(lit("s:"), F.octet_length("text"), lit(':"'), F.col("text"), lit('";'))
    cut = F.concat(lit("s:"), F.octet_length("text"), lit(':"'), F.col("text"))
    return (
        F.when(F.col("lang") == "en", whole)
        .when(F.col("lang") == "fr", cut)
        .when(F.col("lang") == "de", F.concat(lit("  \n"), whole, lit("\t ")))
        .otherwise(F.col("text"))
    )


@query(
    "r2_is_serialized",
    r"""
    WITH cells AS (
        SELECT doc_id, CASE lang
            WHEN 'en' THEN 's:' || strlen(text) || ':"' || text || '";'
            WHEN 'fr' THEN 's:' || strlen(text) || ':"' || text
            WHEN 'de' THEN E'  \n' || 's:' || strlen(text) || ':"' || text || '";' || E'\t '
            ELSE text END AS cell
        FROM documents)
    SELECT doc_id,
           regexp_matches(regexp_replace(cell, '^[ \t\n\r]+', ''), '^s:[0-9]+:')
           AND regexp_matches(cell, '"[\x00-\x7f][ \t\n\r]*$') AS serialized
    FROM cells
    """,
)
def r2_is_serialized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.is_serialized(_serialized_text(docs)).alias("serialized"))


def _serialized_page(url: Column) -> Column:
    return F.concat(
        lit('a:2:{s:3:"url";s:'), F.octet_length(url), lit(':"'), url,
        lit('";s:4:"page";i:'), F.col("page_id"), lit(";}"),
    )


SQL_SERIALIZED = (
    """'a:2:{{s:3:"url";s:' || strlen({u}) || ':"' || {u} || '";s:4:"page";i:' || page_id || ';}}'"""
)


@query(
    "r3_serialized_replace",
    f"""
    SELECT page_id, {SQL_SERIALIZED.format(u=SQL_TWICE)} AS value,
           {sql_hits('url', 'example.com')} + {sql_hits(SQL_ONCE, 'shop.example')} AS hits,
           CASE WHEN contains(url, 'example.com') THEN 'serialized' ELSE 'unmatched' END AS kind
    FROM pages
    """,
)
def r3_serialized_replace(spark, sf_dir):
    cells = table(spark, sf_dir, "pages").select("page_id", _serialized_page(F.col("url")).alias("c"))
    return cells.select("page_id", structured_replace(F.col("c"), HOSTS).alias("r")).select(
        "page_id", "r.value", "r.hits", "r.kind"
    )


@query(
    "r3_serialized_text",
    """
    WITH new AS (SELECT *, replace(replace(text, 'e', 'é'), ' de ', ' von ') AS t FROM documents)
    SELECT doc_id, 's:' || strlen(t) || ':"' || t || '";' AS value FROM new
    """,
)
def r3_serialized_text(spark, sf_dir):
    """Whole multi-byte texts, where lengths in bytes and characters differ."""
    docs = table(spark, sf_dir, "documents")
    cell = F.concat(lit("s:"), F.octet_length("text"), lit(':"'), F.col("text"), lit('";'))
    cells = docs.select("doc_id", cell.alias("c"))
    value = structured_replace(F.col("c"), [("e", "é"), (" de ", " von ")])
    return cells.select("doc_id", value.alias("r")).select("doc_id", "r.value")


@query(
    "r3_nested_and_opaque",
    f"""
    WITH inner_cells AS (SELECT *, {SQL_SERIALIZED.format(u='url')} AS old,
                         {SQL_SERIALIZED.format(u=SQL_ONCE)} AS new FROM pages)
    SELECT page_id,
           CASE WHEN url LIKE 'https:%'
                THEN 'a:1:{{s:4:"blob";s:' || strlen(new) || ':"' || new || '";}}'
                ELSE 'a:2:{{i:0;s:' || strlen(url) || ':"' || url || '";i:1;O:7:"Unknown":0:{{}}}}'
           END AS value,
           CASE WHEN url LIKE 'https:%' THEN {sql_hits('url', 'example.com')} ELSE 0 END AS hits,
           CASE WHEN NOT contains(url, 'example.com') THEN 'unmatched'
                WHEN url LIKE 'https:%' THEN 'serialized' ELSE 'opaque' END AS kind
    FROM inner_cells
    """,
)
def r3_nested_and_opaque(spark, sf_dir):
    """Serialized text inside serialized text, and values that hold an unknown object."""
    inner = _serialized_page(F.col("url"))
    nested = F.concat(
        lit('a:1:{s:4:"blob";s:'), F.octet_length(inner), lit(':"'), inner, lit('";}')
    )
    opaque = F.concat(
        lit("a:2:{i:0;s:"), F.octet_length("url"), lit(':"'), F.col("url"),
        lit('";i:1;O:7:"Unknown":0:{}}'),
    )
    cell = F.when(F.startswith("url", lit("https:")), nested).otherwise(opaque)
    cells = table(spark, sf_dir, "pages").select("page_id", cell.alias("c"))
    return cells.select("page_id", structured_replace(F.col("c"), ONE_HOST).alias("r")).select(
        "page_id", "r.value", "r.hits", "r.kind"
    )


@query(
    "r4_json_replace",
    f"""
    SELECT page_id, '{{"u":"' || {SQL_ONCE} || '","id":' || page_id || '}}' AS value,
           {sql_hits('url', 'example.com')} AS hits, 'json' AS kind
    FROM pages WHERE contains(url, 'example.com')
    UNION ALL
    SELECT page_id, '{{"u":"' || replace(url, '/', '\\/') || '","id":' || page_id || '}}', 0, 'json'
    FROM pages WHERE NOT contains(url, 'example.com')
    """,
)
def r4_json_replace(spark, sf_dir):
    """Slashes are escaped on the way in; a cell with a match comes out re-encoded."""
    cell = F.concat(
        lit('{"u":"'), F.replace(F.col("url"), lit("/"), lit("\\/")), lit('","id":'),
        F.col("page_id"), lit("}"),
    )
    cells = table(spark, sf_dir, "pages").select("page_id", cell.alias("c"))
    return cells.select("page_id", structured_replace(F.col("c"), ONE_HOST).alias("r")).select(
        "page_id", "r.value", "r.hits", "r.kind"
    )


@query(
    "r5_rewrite_table",
    f"""
    SELECT conv_id, turn, replace(role, 'the', 'THE') AS role, replace(text, 'the', 'THE') AS text,
           {sql_hits('role', 'the')} + {sql_hits('text', 'the')} AS _hits,
           contains(role, 'the') OR contains(text, 'the') AS _changed
    FROM conversations
    """,
)
def r5_rewrite_table(spark, sf_dir):
    return rw.rewrite_table(
        table(spark, sf_dir, "conversations"), ["conv_id", "turn"], [("the", "THE")]
    )


@query(
    "r6_apply_changes",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved ' || c_name ELSE c_name END AS c_name,
           c_nationkey, c_acctbal,
           CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def r6_apply_changes(spark, sf_dir):
    base = table(spark, sf_dir, "customer")
    changes = base.filter(F.col("c_mktsegment") == "BUILDING").select(
        "c_custkey",
        F.concat(lit("moved "), "c_name").alias("c_name"),
        F.lit(None).cast("string").alias("c_mktsegment"),
    )
    return rw.apply_changes(base, changes, ["c_custkey"])


REWRITE_KEYS = {
    "pages": ["page_id"],
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "lineitem": [],
}
REWRITE_PAIRS = [("example.com", "shop.example.com"), ("the", "THE")]


def _sql_counts(name: str, cells: list[str]) -> str:
    changed = " OR ".join(f"contains({c}, 'example.com') OR contains({c}, 'the')" for c in cells)
    hits = " + ".join(
        f"{sql_hits(c, 'example.com')} + "
        + sql_hits(f"replace({c}, 'example.com', 'shop.example.com')", "the")
        for c in cells
    )
    return (
        f"SELECT '{name}' AS table_name, 1 AS tables, count(*) AS rows, "
        f"count(*) FILTER (WHERE {changed}) AS changes, sum({hits}) AS hits, 0 AS skipped FROM {name}"
    )


@query(
    "r7_rewrite_database",
    f"""
    WITH report AS (
        {_sql_counts('pages', ['url', 'html'])}
        UNION ALL {_sql_counts('documents', ['text', 'lang', 'source'])}
        UNION ALL {_sql_counts('conversations', ['role', 'text'])}
        UNION ALL SELECT 'lineitem', 0, 0, 0, 0, 1)
    SELECT table_name, cast(sum(tables) AS BIGINT) AS tables, cast(sum(rows) AS BIGINT) AS rows,
           cast(sum(changes) AS BIGINT) AS changes, cast(sum(hits) AS BIGINT) AS hits,
           cast(sum(skipped) AS BIGINT) AS skipped
    FROM report GROUP BY ROLLUP (table_name)
    """,
)
def r7_rewrite_database(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in REWRITE_KEYS}
    report = rw.rewrite_database(tables, REWRITE_KEYS, REWRITE_PAIRS)
    return report.select("table_name", "tables", "rows", "changes", "hits", "skipped")


def _payload_cells(spark, sf_dir) -> DataFrame:
    """Per page a cell with its address: an unknown object, a wrong length, or a whole value."""
    opaque = F.concat(lit("a:2:{i:0;s:"), F.octet_length("url"), lit(':"'), F.col("url"), lit('";i:1;O:7:"Unknown":0:{}}'))
    broken = F.concat(lit("s:"), F.octet_length("url") + 1, lit(':"'), F.col("url"), lit('";'))
    whole = F.concat(lit("s:"), F.octet_length("url"), lit(':"'), F.col("url"), lit('";'))
    cell = F.when(F.col("page_id") % 3 == 0, opaque).when(F.col("page_id") % 3 == 1, broken).otherwise(whole)
    return table(spark, sf_dir, "pages").select("page_id", cell.alias("meta"), F.col("url").alias("_way_meta"))


@query(
    "r7_rewrite_accounting",
    f"""
    WITH report AS (
        SELECT 'meta' AS table_name, count(*) AS rows,
               count(*) FILTER (contains(url, 'example.com')) AS changes,
               sum({sql_hits('url', 'example.com')} * CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END) AS hits,
               count(*) FILTER (contains(url, 'example.com') AND page_id % 3 = 0) AS opaque,
               count(*) FILTER (contains(url, 'example.com') AND page_id % 3 = 1) AS malformed FROM pages)
    SELECT table_name, cast(sum(rows) AS BIGINT) AS rows, cast(sum(changes) AS BIGINT) AS changes, cast(sum(hits) AS BIGINT) AS hits,
           cast(sum(opaque) AS BIGINT) AS opaque, cast(sum(malformed) AS BIGINT) AS malformed
    FROM report GROUP BY ROLLUP (table_name)
    """,
)
def r7_rewrite_accounting(spark, sf_dir):
    """Cells that cannot be rewritten are counted; a column has the name of a former helper."""
    tables = {"meta": _payload_cells(spark, sf_dir)}
    report = rw.rewrite_database(tables, {"meta": ["page_id"]}, ONE_HOST)
    return report.select("table_name", "rows", "changes", "hits", "opaque", "malformed")


@query(
    "r5_left_alone",
    """
    SELECT page_id, 'meta' AS column_name, CASE WHEN page_id % 3 = 0 THEN 'opaque' ELSE 'malformed' END AS kind
    FROM pages WHERE contains(url, 'example.com') AND page_id % 3 < 2
    """,
)
def r5_left_alone(spark, sf_dir):
    return rw.left_alone(_payload_cells(spark, sf_dir), ["page_id"], ONE_HOST).drop("cell")


@query(
    "r7_rewrite_database_live",
    f"""
    SELECT page_id, replace({SQL_ONCE}, 'the', 'THE') AS url,
           replace(replace(html, 'example.com', 'shop.example.com'), 'the', 'THE') AS html
    FROM pages
    """,
)
def r7_rewrite_database_live(spark, sf_dir):
    """The written result of a live run over several tables."""
    dest = scratch(spark, "rewrite")
    tables = {name: table(spark, sf_dir, name) for name in REWRITE_KEYS}
    rw.rewrite_database(tables, REWRITE_KEYS, REWRITE_PAIRS, dry_run=False, dest=dest)
    return spark.read.parquet(f"{dest}/pages")


def _sql_rewritten(column: str) -> str:
    return f"replace(replace({column}, 'example.com', 'shop.example.com'), 'the', 'THE')"


@query(
    "r7_rewrite_all_live",
    f"""
    SELECT 'pages' AS name, page_id AS id, 0 AS place, md5({_sql_rewritten('url')} || {_sql_rewritten('html')}) AS md5 FROM pages
    UNION ALL SELECT 'documents', doc_id, 0, md5({_sql_rewritten('text')} || {_sql_rewritten('lang')} || {_sql_rewritten('source')}) FROM documents
    UNION ALL SELECT 'conversations', conv_id, cast(turn AS INTEGER), md5({_sql_rewritten('role')} || {_sql_rewritten('text')}) FROM conversations
    """,
)
def r7_rewrite_all_live(spark, sf_dir):
    """All tables that a live run wrote."""
    dest = scratch(spark, "rewrite")
    tables = {name: table(spark, sf_dir, name) for name in REWRITE_KEYS}
    rw.rewrite_database(tables, REWRITE_KEYS, REWRITE_PAIRS, dry_run=False, dest=dest)
    found = {"pages": ("page_id", None, ["url", "html"]), "documents": ("doc_id", None, ["text", "lang", "source"]),
             "conversations": ("conv_id", "turn", ["role", "text"])}
    return rel_ops.entry_union(*[
        spark.read.parquet(f"{dest}/{name}").select(
            lit(name).alias("name"), long(key).alias("id"), (F.col(place) if place else F.lit(0)).cast("int").alias("place"),
            F.md5(F.concat(*cells)).alias("md5"),
        )
        for name, (key, place, cells) in found.items()
    ])


SQL_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]+')"


@query(
    "r8_replacement_pairs",
    f"""
    WITH ids AS (
        SELECT page_id, {SQL_HOST} AS host, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages),
    listed AS (
        SELECT page_id, unnest([
            {{'n': 0, 'f': host, 't': 'https://new.example/site'}},
            {{'n': 1, 'f': CASE WHEN host LIKE 'https:%' THEN host ELSE host || '/wp' END,
              't': 'https://new.example/site'}},
            {{'n': 2, 'f': CASE WHEN path LIKE '/en/%' THEN '' ELSE '/srv' || path END, 't': '/srv/content'}},
            {{'n': 3, 'f': '/srv', 't': CASE WHEN host LIKE '%.com' THEN '/srv' ELSE '/var' END}}]) AS p
        FROM ids),
    kept AS (
        SELECT page_id, p.n, p.f, p.t,
               row_number() OVER (PARTITION BY page_id, p.f ORDER BY p.n) AS k
        FROM listed WHERE p.f <> '' AND p.f <> p.t)
    SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS ord,
           f AS "from", t AS "to"
    FROM kept WHERE k = 1
    """,
)
def r8_replacement_pairs(spark, sf_dir):
    url = F.col("url")
    host = F.regexp_extract(url, "^[a-z]+://[^/?#]+", 0)
    path = F.regexp_extract(url, "://[^/]*(/[^?#]*)", 1)
    identities = table(spark, sf_dir, "pages").select(
        "page_id",
        host.alias("source_home"),
        F.when(F.startswith(host, lit("https:")), host)
        .otherwise(F.concat(host, lit("/wp")))
        .alias("source_siteurl"),
        F.when(~F.startswith(path, lit("/en/")), F.concat(lit("/srv"), path)).alias("source_content"),
        lit("/srv").alias("source_abspath"),
        lit("https://new.example/site").alias("target_home"),
        lit("https://new.example/site").alias("target_siteurl"),
        lit("/srv/content").alias("target_content"),
        F.when(F.endswith(host, lit(".com")), "/srv").otherwise("/var").alias("target_abspath"),
    )
    return manifests.replacement_pairs(identities, "page_id")


@query(
    "r9_usable_keys",
    """
    SELECT 'customer' AS table_name, count(*) = count(DISTINCT c_custkey) AS usable FROM customer
    UNION ALL
    SELECT 'conversations', count(*) = count(DISTINCT (conv_id, turn)) FROM conversations
    UNION ALL
    SELECT 'lineitem', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
    UNION ALL SELECT 'events', false
    """,
)
def r9_usable_keys(spark, sf_dir):
    declared = {
        "customer": ["c_custkey"],
        "conversations": ["conv_id", "turn"],
        "lineitem": ["l_orderkey", "l_linenumber"],
        "events": [],
    }
    return rel_ops.entry_union(
        *[rw.usable_keys(table(spark, sf_dir, name), name, keys) for name, keys in declared.items()]
    )


SQL_PART_TABLE = "CASE WHEN p_size < 25 THEN 'wp_2_' ELSE 'wp_' END || lower(p_type) || '_' || p_partkey"


def _part_tables(spark, sf_dir) -> DataFrame:
    name = F.concat(
        F.when(F.col("p_size") < 25, "wp_2_").otherwise("wp_"), F.lower("p_type"), lit("_"), "p_partkey"
    )
    kind = F.when(F.col("p_size") > 40, "VIEW").otherwise("BASE TABLE")
    return table(spark, sf_dir, "part").select("p_brand", name.alias("name"), kind.alias("kind"))


@query(
    "r10_remap_tables",
    f"""
    SELECT {SQL_PART_TABLE} AS name, regexp_replace({SQL_PART_TABLE}, '^wp_2_', 'wp_') AS new_name FROM part
    """,
)
def r10_remap_tables(spark, sf_dir):
    return _part_tables(spark, sf_dir).select(
        "name", rw.remap_names(F.col("name"), "wp_2_", "wp_").alias("new_name")
    )


@query(
    "r10_remap_transform",
    """
    SELECT 'wp_urls' AS name, page_id AS id, '* ' || url AS value FROM pages
    UNION ALL SELECT 'wp_texts', doc_id, '* ' || text FROM documents
    """,
)
def r10_remap_transform(spark, sf_dir):
    """Tables read under one name and passed on under another; one of them is dropped."""
    sources = {
        "wp_2_urls": table(spark, sf_dir, "pages").selectExpr("page_id AS id", "url AS value"),
        "wp_2_texts": table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS value"),
        "wp_2_nothing": table(spark, sf_dir, "nation"),
    }

    def transform(df: DataFrame) -> DataFrame | None:
        marked = F.concat(lit("* "), "value")
        return df.withColumn("value", marked) if "value" in df.columns else None

    moved = rw.remap_tables(sources, lambda n: n.replace("wp_2_", "wp_", 1), transform)
    return rel_ops.entry_union(
        *[df.select(lit(name).alias("name"), "id", "value") for name, df in moved.items()]
    )


@query(
    "r11_stream_rewrite",
    f"""
    SELECT event_id, replace(event_type, 'click', 'tap') AS event_type,
           replace(props, '"k"', '"key"') AS props,
           {sql_hits('event_type', 'click')} + {sql_hits('props', '"k"')} AS _hits,
           contains(event_type, 'click') OR contains(props, '"k"') AS _changed
    FROM events
    """,
)
def r11_stream_rewrite(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    base = scratch(spark, "stream-rewrite")
    events.repartition(12).write.parquet(f"{base}/in")
    stream = streams.file_stream(spark, f"{base}/in", events.schema, max_files=5)
    rewritten = streams.stream_rewrite(stream, ["event_id"], [("click", "tap"), ('"k"', '"key"')])
    streams.write_stream(rewritten, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


# ================================================================ filters


@query(
    "f1_disposable_rows",
    r"""
    SELECT event_id, option_name FROM (
        SELECT event_id, CASE event_type WHEN 'view' THEN '_transient_' || user_id
                   WHEN 'click' THEN '_site_transient_' || user_id
                   WHEN 'error' THEN NULL ELSE event_type || '_transient_' || user_id END AS option_name
        FROM events)
    WHERE option_name NOT LIKE '\_transient\_%' ESCAPE '\'
      AND option_name NOT LIKE '\_site\_transient\_%' ESCAPE '\'
    """,
)
def f1_disposable_rows(spark, sf_dir):
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", F.concat(lit("_transient_"), "user_id"))
        .when(kind == "click", F.concat(lit("_site_transient_"), "user_id"))
        .when(kind != "error", F.concat(kind, lit("_transient_"), "user_id"))
    )
    options = table(spark, sf_dir, "events").select("event_id", name.alias("option_name"))
    chosen = rel_ops.ExportOptions.from_dict({"no_transients": True})
    return rel_ops.drop_disposable(options, "wp_options", chosen)


@query(
    "f1_pushed_filter",
    "SELECT event_id, event_type AS comment_approved FROM events WHERE event_type <> 'error'",
)
def f1_pushed_filter(spark, sf_dir):
    """A general row filter; it reaches the scan."""
    comments = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("comment_approved")
    )
    return rel_ops.where_filters(
        comments, "wp_comments", {"wp_comments": F.col("comment_approved") != "error"}
    )


@query(
    "f2_table_select",
    f"""
    SELECT name FROM (SELECT {SQL_PART_TABLE} AS name, p_size FROM part)
    WHERE starts_with(name, 'wp_2_') AND p_size <= 40
      AND name NOT IN ('wp_2_economy_1', 'wp_2_small_4', 'wp_2_economy_0')
    """,
)
def f2_table_select(spark, sf_dir):
    options = rel_ops.ExportOptions.from_dict(
        {
            "no_sessions": 1,
            "exclude_tables": [" wp_2_economy_1", "wp_2_small_4", "wp_2_economy_0", "other_table"],
        }
    )
    return rel_ops.select_tables(_part_tables(spark, sf_dir), "wp_2_", options).select("name")


SQL_PATH = "regexp_extract(url, '://(.*)', 1)"


def _page_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(
            F.regexp_extract("url", "://([^?#]*[^?#/])", 1), lit("/"), "page_id", lit(".html")
        ).alias("rel"),
        long(F.octet_length("html")).alias("size"),
    )


SQL_FILES = """
    files AS (SELECT regexp_extract(url, '://([^?#]*[^?#/])', 1) || '/' || page_id || '.html' AS rel,
                     strlen(html) AS size FROM pages)
"""

PRUNED = ["blog.tionsh.example.net/en", "thther.example.org", "m.ththth.example.ne"]
SQL_PRUNED = ", ".join(f"('{p}')" for p in PRUNED)


@query(
    "f3_path_prune",
    f"""
    WITH {SQL_FILES}, prefixes(p) AS (VALUES {SQL_PRUNED})
    SELECT rel, size FROM files
    WHERE NOT list_contains(string_split(rel, '/'), 'fr')
      AND NOT EXISTS (SELECT 1 FROM prefixes WHERE rel = p OR starts_with(rel, p || '/'))
    """,
)
def f3_path_prune(spark, sf_dir):
    return files_ops.prune_paths(_page_files(spark, sf_dir), ["fr"], PRUNED)


@query(
    "f3_path_prune_joined",
    f"""
    WITH {SQL_FILES}, prefixes AS (
        SELECT DISTINCT regexp_extract(url, '://([^/?#]*/[a-z]+)', 1) AS p FROM pages
        WHERE url LIKE 'https:%')
    SELECT rel, size FROM files
    WHERE regexp_extract(rel, '^([^/]*/[a-z]+)', 1) NOT IN (SELECT p FROM prefixes)
    """,
)
def f3_path_prune_joined(spark, sf_dir):
    """As many prefixes as the data has folders: the equi-join on distinct folders."""
    prefix = F.regexp_extract("url", "://([^/?#]*/[a-z]+)", 1).alias("prefix")
    prefixes = (
        table(spark, sf_dir, "pages").filter(F.startswith("url", lit("https:"))).select(prefix).distinct()
    )
    return files_ops.prune_joined(_page_files(spark, sf_dir), prefixes)


@query(
    "f4_inactive_components",
    """
    SELECT 'part-' || p_partkey AS name FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND p_partkey <> 7
    """,
)
def f4_inactive_components(spark, sf_dir):
    components = table(spark, sf_dir, "part").select(F.concat(lit("part-"), "p_partkey").alias("name"))
    active = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_quantity") >= 50)
        .select(F.concat(lit("part-"), "l_partkey").alias("name"))
    )
    return rel_ops.inactive(components, active, always=["part-7"])


@query(
    "f5_restore_guard",
    """
    WITH entries AS (
        SELECT page_id, CASE
            WHEN url LIKE '%/de/%' THEN 'wp-content/../' || page_id
            WHEN url LIKE '%/es/%' THEN 'wp-content//' || page_id
            WHEN url LIKE '%#top' THEN 'wp-content/plugins/own/' || page_id
            WHEN url LIKE '%.html' THEN 'wp-content/'
            WHEN url LIKE '%?%' THEN 'etc/' || page_id
            ELSE 'wp-content/uploads/' || page_id END AS path
        FROM pages)
    SELECT page_id, path, CASE
        WHEN NOT starts_with(path, 'wp-content/') THEN 'foreign'
        WHEN starts_with(path, 'wp-content/plugins/own/') THEN 'protected'
        WHEN path = 'wp-content/' THEN 'empty'
        WHEN contains(path, '..') THEN 'climbs'
        WHEN starts_with(path, 'wp-content//') THEN 'absolute' ELSE 'ok' END AS verdict
    FROM entries
    """,
)
def f5_restore_guard(spark, sf_dir):
    url = F.col("url")
    path = (
        F.when(url.like("%/de/%"), F.concat(lit("wp-content/../"), "page_id"))
        .when(url.like("%/es/%"), F.concat(lit("wp-content//"), "page_id"))
        .when(url.like("%#top"), F.concat(lit("wp-content/plugins/own/"), "page_id"))
        .when(url.like("%.html"), lit("wp-content/"))
        .when(url.like("%?%"), F.concat(lit("etc/"), "page_id"))
        .otherwise(F.concat(lit("wp-content/uploads/"), "page_id"))
    )
    entries = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return files_ops.guard_paths(entries, protected=["wp-content/plugins/own/"])


@query(
    "f6_manifest_supported",
    """
    SELECT s_suppkey, coalesce(s_nationkey <> 3 AND
           coalesce(CASE WHEN s_nationkey > 10 THEN s_nationkey - 12 END, 0) <= 1, false) AS supported
    FROM supplier
    """,
)
def f6_manifest_supported(spark, sf_dir):
    nation = F.col("s_nationkey")
    text = F.to_json(
        F.struct(
            F.when(nation != 3, manifests.FORMAT).otherwise("other").alias("format"),
            F.when(nation > 10, nation - 12).alias("formatVersion"),
        )
    )
    parsed = table(spark, sf_dir, "supplier").select(
        "s_suppkey", manifests.parse_manifests(text).alias("m")
    ).select("s_suppkey", "m.*")
    return parsed.select("s_suppkey", manifests.supported(parsed).alias("supported"))


# ================================================================ joins and integrity


@query(
    "j1_integrity_check",
    """
    SELECT cast(doc_id AS VARCHAR) AS rel, CASE
        WHEN lang = 'es' THEN 'missing' WHEN source = 'src1' THEN 'unverifiable'
        WHEN lang = 'de' THEN 'corrupt' ELSE 'ok' END AS status
    FROM documents
    UNION ALL SELECT DISTINCT 'extra-' || conv_id, 'extra' FROM conversations
    """,
)
def j1_integrity_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rel = F.col("doc_id").cast("string").alias("rel")
    stored = F.when(F.col("source") != "src1", C.md5_hex(F.col("text"))).alias("crc")
    tampered = F.when(F.col("lang") == "de", F.concat("text", lit("x"))).otherwise(F.col("text"))
    actual = docs.filter(F.col("lang") != "es").select(rel, C.md5_hex(tampered).alias("crc"))
    extra = table(spark, sf_dir, "conversations").select(
        F.concat(lit("extra-"), "conv_id").alias("rel"), C.md5_hex(F.col("text")).alias("crc")
    )
    return files_ops.verify(docs.select(rel, stored), actual.unionByName(extra))


FREE_BYTES = 2_000_000_000
SQL_NEEDED = (
    "cast(c_custkey * 1000000 * CASE WHEN c_mktsegment = 'BUILDING' THEN 3.5 ELSE 1.5 END AS BIGINT)"
)
SQL_PREFIX = "CASE WHEN c_nationkey < 5 THEN 'zz_' WHEN c_nationkey < 20 THEN 'wp_' ELSE '' END"


@query(
    "j2_restore_preflight",
    f"""
    SELECT c_custkey, 'error' AS level, 'Table prefix' AS label,
           'Snapshot tables start with zz_, this site''s with wp_.' AS message
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {SQL_PREFIX} NOT IN ('', 'wp_')
    UNION ALL SELECT c_custkey, 'ok', 'Table prefix', 'Matches (wp_).'
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {SQL_PREFIX} IN ('', 'wp_')
    UNION ALL SELECT c_custkey, 'warn', 'Multisite',
           'Snapshot or site is a network; a restore will be refused.'
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
    UNION ALL SELECT c_custkey, 'warn', 'Disk space',
           {sql_human_size(str(FREE_BYTES))} || ' free, about ' || {sql_human_size(SQL_NEEDED)} || ' needed.'
    FROM customer WHERE {SQL_NEEDED} > {FREE_BYTES}
    UNION ALL SELECT c_custkey, 'ok', 'Disk space', {sql_human_size(str(FREE_BYTES))} || ' free.'
    FROM customer WHERE {SQL_NEEDED} <= {FREE_BYTES}
    UNION ALL SELECT c_custkey, 'error', 'Writable files', 'Content folder is read-only.' FROM customer
    UNION ALL SELECT c_custkey, 'warn', 'PHP version',
           'Made on PHP 8.' || c_nationkey || ', this site runs 8.9.'
    FROM customer WHERE c_nationkey > 9
    """,
)
def j2_restore_preflight(spark, sf_dir):
    nation = F.col("c_nationkey")
    sites = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), nation == F.col("n_nationkey")
    )
    facts = sites.select(
        "c_custkey",
        F.when(nation < 5, "zz_").when(nation < 20, "wp_").alias("tablePrefix"),
        (F.col("n_regionkey") == 2).alias("multisite"),
        F.concat(lit("8."), nation).alias("phpVersion"),
        (F.col("c_custkey") * 1000000).alias("archive_bytes"),
        (F.col("c_mktsegment") == "BUILDING").alias("compressed"),
    )
    target = manifests.Target("wp_", False, FREE_BYTES, writable=False, php_version="8.9")
    return manifests.preflight(facts, target, "c_custkey")


# ================================================================ aggregation


SQL_ABOVE = """
    flat AS (SELECT rel, size, string_split(rel, '/') AS parts FROM files),
    above AS (
        SELECT rel, size, unnest(list_transform(range(0, len(parts)),
               lambda n: array_to_string(parts[1:n], '/'))) AS dir FROM flat),
    dirs AS (SELECT DISTINCT dir FROM above WHERE dir <> ''),
    dir_nodes AS (
        SELECT dir AS child, unnest(list_transform(range(0, len(string_split(dir, '/'))),
               lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS dir FROM dirs),
    totals AS (
        SELECT CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, dir AS rel,
               sum(size) AS size, sum(n) AS nodes
        FROM (SELECT dir, size, 1 AS n FROM above UNION ALL SELECT dir, 0, 1 FROM dir_nodes)
        GROUP BY dir)
"""


@query(
    "a1_dir_rollup",
    f"""
    WITH {SQL_FILES}, {SQL_ABOVE}
    SELECT cast(depth AS INTEGER) AS depth, rel, cast(size AS BIGINT) AS size,
           cast(nodes AS BIGINT) AS nodes FROM totals
    """,
)
def a1_dir_rollup(spark, sf_dir):
    return files_ops.dir_rollup(_page_files(spark, sf_dir))


@query(
    "a2_size_tree",
    f"""
    WITH {SQL_FILES}, {SQL_ABOVE},
    listed AS (
        SELECT rel, true AS dir, size, nodes FROM totals WHERE rel <> '' AND depth <= 3
        UNION ALL
        SELECT rel, false, size, 0 FROM flat WHERE size >= 2000 AND len(parts) <= 3),
    named AS (
        SELECT CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '' END AS parent,
               regexp_extract(rel, '[^/]*$') AS name, * FROM listed)
    SELECT parent, cast(row_number() OVER (PARTITION BY parent ORDER BY size DESC, name) AS INTEGER) AS rank,
           rel, name, dir, cast(size AS BIGINT) AS size, cast(nodes AS BIGINT) AS nodes
    FROM named
    """,
)
def a2_size_tree(spark, sf_dir):
    return files_ops.size_tree(_page_files(spark, sf_dir), max_depth=3, file_threshold=2000)


SQL_EMPTY = SQL_FILES.replace("FROM pages", "FROM pages UNION ALL SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) || '/drafts/old/.', 0 FROM pages")
SQL_ABOVE_EMPTY = SQL_ABOVE.replace("1 AS n FROM above", "CASE WHEN ends_with(rel, '/.') THEN 0 ELSE 1 END AS n FROM above")


def _empty_folders(spark, sf_dir) -> DataFrame:
    """Two folders per host that hold no file."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.concat(host, lit("/drafts/old")).alias("rel")).distinct()


@query(
    "a1_dir_rollup_empty",
    f"""
    WITH {SQL_EMPTY}, {SQL_ABOVE_EMPTY}
    SELECT cast(depth AS INTEGER) AS depth, rel, cast(size AS BIGINT) AS size,
           cast(nodes AS BIGINT) AS nodes FROM totals
    """,
)
def a1_dir_rollup_empty(spark, sf_dir):
    return files_ops.dir_rollup(_page_files(spark, sf_dir), _empty_folders(spark, sf_dir))


@query(
    "a2_size_tree_empty",
    f"""
    WITH {SQL_EMPTY}, {SQL_ABOVE_EMPTY},
    named AS (
        SELECT CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '' END AS parent,
               regexp_extract(rel, '[^/]*$') AS name, * FROM totals WHERE rel <> '' AND depth <= 3)
    SELECT parent, cast(row_number() OVER (PARTITION BY parent ORDER BY size DESC, name) AS INTEGER) AS rank,
           rel, name, true AS dir, cast(size AS BIGINT) AS size, cast(nodes AS BIGINT) AS nodes
    FROM named
    """,
)
def a2_size_tree_empty(spark, sf_dir):
    """Folders only, those without files among them."""
    files, folders = _page_files(spark, sf_dir), _empty_folders(spark, sf_dir)
    return files_ops.size_tree(files, max_depth=3, file_threshold=1 << 40, folders=folders)


@query(
    "a3_export_summary",
    """
    SELECT source, lang, cast(count(*) FILTER (WHERE n_chars >= 2000) AS BIGINT) AS tables,
           cast(count(*) FILTER (WHERE n_chars < 2000) AS BIGINT) AS files,
           cast(sum(strlen(text)) AS BIGINT) AS bytes
    FROM documents GROUP BY ROLLUP (source, lang)
    """,
)
def a3_export_summary(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(
        "source",
        "lang",
        F.when(F.col("n_chars") >= 2000, "table").otherwise("file").alias("type"),
        long(F.octet_length("text")).alias("size"),
    )
    return files_ops.export_summary(entries, ["source", "lang"])


@query(
    "a4_manifest_summary",
    """
    WITH rows AS (
        SELECT c_custkey, unnest([
            {'n': 0, 'label': 'Source site', 'value': 'https://' || lower(c_mktsegment) || '.example'},
            {'n': 1, 'label': 'Made with', 'value': 'stowage 1.' || c_nationkey},
            {'n': 2, 'label': 'WordPress', 'value': '6.' || c_nationkey},
            {'n': 3, 'label': 'PHP', 'value': ''},
            {'n': 4, 'label': 'Table prefix', 'value': 'wp_'},
            {'n': 5, 'label': 'Tables', 'value': cast(c_nationkey % 3 AS VARCHAR)},
            {'n': 6, 'label': 'Multisite', 'value': CASE WHEN c_nationkey = 4 THEN 'Yes' ELSE 'No' END},
            {'n': 7, 'label': CASE WHEN c_nationkey > 15 THEN 'WooCommerce' END,
             'value': CASE WHEN c_nationkey > 20 THEN 'Yes (HPOS)' ELSE 'Yes' END}]) AS r
        FROM customer)
    SELECT c_custkey, cast(r.n AS INTEGER) AS ord, r.label AS label, r.value AS value
    FROM rows WHERE r.label IS NOT NULL
    """,
)
def a4_manifest_summary(spark, sf_dir):
    nation = F.col("c_nationkey")
    listed = F.slice(F.array(lit("wp_posts"), lit("wp_options")), lit(1), nation % 3)
    text = F.to_json(
        F.struct(
            F.concat(lit("https://"), F.lower("c_mktsegment"), lit(".example")).alias("siteUrl"),
            lit("stowage").alias("generator"),
            F.concat(lit("1."), nation).alias("generatorVersion"),
            F.concat(lit("6."), nation).alias("wpVersion"),
            lit("wp_").alias("tablePrefix"),
            listed.alias("tables"),
            (nation == 4).alias("multisite"),
            (nation > 15).alias("wooActive"),
            (nation > 20).alias("wooHpos"),
        )
    )
    parsed = table(spark, sf_dir, "customer").select(
        "c_custkey", manifests.parse_manifests(text).alias("m")
    ).select("c_custkey", "m.*")
    return manifests.manifest_summary(parsed, "c_custkey")


# ================================================================ order, limits, sets


@query(
    "o1_backup_catalogue",
    f"""
    WITH listed AS (
        SELECT CASE event_type WHEN 'view' THEN 'upload-' WHEN 'click' THEN 'restore-' ELSE '' END
               || event_id || CASE event_type WHEN 'error' THEN '.zip' WHEN 'signup' THEN '.snapshot.gz'
                              ELSE '.snapshot' END AS file,
               ts, event_id * user_id AS size FROM events)
    SELECT file, size, {sql_human_size('size')} AS size_text, strftime(ts, '%Y-%m-%d %H:%M') AS date,
           file LIKE '%.gz' AS compressed
    FROM listed
    WHERE (file LIKE '%.snapshot' OR file LIKE '%.snapshot.gz')
      AND NOT starts_with(file, 'upload-') AND NOT starts_with(file, 'restore-')
    """,
)
def o1_backup_catalogue(spark, sf_dir):
    kind = F.col("event_type")
    name = F.concat(
        F.when(kind == "view", "upload-").when(kind == "click", "restore-").otherwise(""),
        F.col("event_id").cast("string"),
        F.when(kind == "error", ".zip").when(kind == "signup", ".snapshot.gz").otherwise(".snapshot"),
    )
    listed = table(spark, sf_dir, "events").select(
        name.alias("rel"), (F.col("event_id") * F.col("user_id")).alias("size"), F.col("ts").alias("mtime")
    )
    return files_ops.catalogue(listed)


@query(
    "o2_keyed_page",
    "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 500 OFFSET 500",
)
def o2_keyed_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rel_ops.page(docs, ["doc_id"], number=1, size=500)


@query("o2_deep_page", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 5 OFFSET 900")
def o2_deep_page(spark, sf_dir):
    """Page 180 of five rows, from the range that holds it."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return paging.PagedTable.build(events, ["event_id"], scratch(spark, "paged"), range_rows=250).page(180, 5)


@query(
    "o3_largest_items",
    """
    SELECT source, doc_id, size, cast(rank AS INTEGER) AS rank FROM (
        SELECT source, doc_id, strlen(text) AS size,
               row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS rank
        FROM documents WHERE strlen(text) >= 1000)
    WHERE rank <= 3
    """,
)
def o3_largest_items(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select(
        "source", "doc_id", long(F.octet_length("text")).alias("size")
    )
    return files_ops.largest(sized, "source", 3, threshold=1000, tie="doc_id")


@query(
    "u1_difference",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    """,
)
def u1_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel_ops.difference(orders, done, ["o_orderkey"])


@query(
    "u2_union_distinct",
    """
    SELECT source AS item FROM documents UNION SELECT lang FROM documents
    UNION SELECT role FROM conversations
    UNION SELECT event_type FROM events WHERE event_type <> 'error'
    """,
)
def u2_union_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return rel_ops.union_distinct(
        docs.select(F.col("source").alias("item")),
        docs.select(F.col("lang").alias("item")),
        table(spark, sf_dir, "conversations").select(F.col("role").alias("item")),
        table(spark, sf_dir, "events").select(kinds.alias("item")),
    )


@query(
    "u3_entry_union",
    """
    SELECT 'documents/' || doc_id AS path, strlen(text) AS size, 'file' AS type, md5(text) AS digest FROM documents
    UNION ALL SELECT 'pages/' || page_id, strlen(html), 'file', NULL FROM pages
    UNION ALL SELECT 'benchmark/' || item_id, strlen(text), 'manifest', md5(text) FROM benchmark
    """,
)
def u3_entry_union(spark, sf_dir):
    def entries(name: str, key: str, body: str, type_name: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(lit(name + "/"), key).alias("path"),
            long(F.octet_length(body)).alias("size"),
            lit(type_name).alias("type"),
            C.md5_hex(F.col(body)).alias("digest"),
        )

    return rel_ops.entry_union(
        entries("documents", "doc_id", "text", "file"),
        entries("pages", "page_id", "html", "file").drop("digest"),
        entries("benchmark", "item_id", "text", "manifest"),
    )


# ================================================================ scalar functions


SQL_BIG = "(o_orderkey * o_orderkey * o_custkey)"


@query("x1_human_size", f"SELECT o_orderkey, {sql_human_size(SQL_BIG)} AS size_text FROM orders")
def x1_human_size(spark, sf_dir):
    """The product of keys needs more than 64 bits from a few million orders on."""
    key = F.col("o_orderkey").cast("decimal(38,0)")
    size = key * F.col("o_orderkey") * F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.human_size(size).alias("size_text"))


SQL_LABEL = "coalesce(nullif(regexp_replace(regexp_extract({u}, '^[a-z]+://([^/?#:]*)', 1), '[^A-Za-z0-9.-]', '', 'g'), ''), 'site')"


@query(
    "x2_host_label",
    f"""
    SELECT page_id, {SQL_LABEL.format(u="CASE WHEN url LIKE 'https:%' THEN url ELSE substr(url, 8) END")} AS host
    FROM pages
    """,
)
def x2_host_label(spark, sf_dir):
    url = F.when(F.startswith("url", lit("https:")), F.col("url")).otherwise(F.substring("url", 8, 2**31 - 1))
    return table(spark, sf_dir, "pages").select("page_id", C.host_label(url).alias("host"))


@query(
    "x3_confine_path",
    r"""
    WITH raw AS (SELECT page_id, replace(url, '//', '\....//../') || './/x' AS p FROM pages)
    SELECT page_id, '/srv/work/' || array_to_string(
        list_filter(string_split(replace(p, '\', '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS path
    FROM raw
    """,
)
def x3_confine_path(spark, sf_dir):
    raw = F.concat(F.replace(F.col("url"), lit("//"), lit("\\....//../")), lit(".//x"))
    return table(spark, sf_dir, "pages").select("page_id", C.confine_path(raw, "/srv/work").alias("path"))


def sql_quoted(expr: str) -> str:
    for char, escape in [
        ("'\\'", "'\\\\'"), ("''''", "'\\'''"), ("'\"'", "'\\\"'"),
        ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(26)", "'\\Z'"),
    ]:
        expr = f"replace({expr}, {char}, {escape})"
    return f"'''' || {expr} || ''''"


@query(
    "x4_sql_literal",
    f"SELECT page_id, CASE WHEN url LIKE '%/de/%' THEN 'NULL' ELSE {sql_quoted('html')} END AS literal FROM pages",
)
def x4_sql_literal(spark, sf_dir):
    value = F.when(~F.col("url").like("%/de/%"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", C.sql_literal(value).alias("literal"))


@query(
    "x5_quote_ident",
    """
    SELECT p_partkey, '`' || replace(replace(p_name, ' ', '`'), '`', '``') || '`' AS ident FROM part
    """,
)
def x5_quote_ident(spark, sf_dir):
    name = F.replace(F.col("p_name"), lit(" "), lit("`"))
    return table(spark, sf_dir, "part").select("p_partkey", C.quote_ident(name).alias("ident"))


@query(
    "x6_clean_list",
    r"""
    WITH words AS (
        SELECT conv_id, turn, trim(w, E' \t\n\r') AS w, pos
        FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS w,
                     unnest(range(1, len(string_split(text, '.')) + 1)) AS pos FROM conversations)),
    firsts AS (SELECT conv_id, turn, w, min(pos) AS pos FROM words WHERE w <> '' GROUP BY ALL)
    SELECT c.conv_id, c.turn, coalesce(string_agg(w, '|' ORDER BY pos), '') AS items
    FROM conversations c LEFT JOIN firsts f USING (conv_id, turn) GROUP BY c.conv_id, c.turn
    """,
)
def x6_clean_list(spark, sf_dir):
    items = C.clean_list(F.split("text", r"\."))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(items, "|").alias("items")
    )


@query(
    "x7_version_newer",
    """
    SELECT p_partkey, [p_size, p_partkey] > [25, 100] AS newer FROM part
    """,
)
def x7_version_newer(spark, sf_dir):
    version = F.concat("p_size", lit("."), "p_partkey", lit("-rc1"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.version_newer(version, lit("25.100")).alias("newer")
    )


@query(
    "x8_is_gzip",
    "SELECT DISTINCT lang, lang = 'fr' AS gzipped FROM documents",
)
def x8_is_gzip(spark, sf_dir):
    """Two bytes per file: the documents as text files per language, one language compressed."""
    base = scratch(spark, "gzip")
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value"))
    for compression, wanted in (("gzip", F.col("lang") == "fr"), ("none", F.col("lang") != "fr")):
        docs.filter(wanted).write.mode("append").option("compression", compression).partitionBy(
            "lang"
        ).text(base)
    found = inventory.file_inventory(spark, base)
    found = found.filter(F.startswith(C.base_name(F.col("rel")), lit("part-")))
    heads = inventory.file_heads(found, base)
    lang = F.regexp_extract("rel", "lang=([a-z]+)/", 1).alias("lang")
    return heads.select(lang, C.is_gzip(F.col("head")).alias("gzipped")).distinct()


@query(
    "x9_crc32_hex",
    """
    WITH tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, [0,0,0,0,0,0,0,0]::BIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v
      FROM (SELECT unnest(range(0, 256))::BIGINT AS n)))
    SELECT doc_id, lpad(lower(to_hex(xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT))), 8, '0') AS crc FROM documents, tab
    """,
)
def x9_crc32_hex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.crc32_hex(F.col("text")).alias("crc"))


@query("x10_md5_hex", "SELECT doc_id, md5(text) AS digest FROM documents")
def x10_md5_hex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.md5_hex(F.col("text")).alias("digest"))


@query(
    "x11_top_segment",
    """
    SELECT page_id, list_filter(string_split(regexp_extract(url, ':(.*)', 1), '/'), lambda s: s <> '')[1] AS top
    FROM pages
    """,
)
def x11_top_segment(spark, sf_dir):
    path = F.regexp_extract("url", ":(.*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", C.top_segment(path).alias("top"))


@query(
    "x12_snapshot_name",
    """
    SELECT event_id, event_type || '.example.com-' || strftime(ts, '%Y%m%d-%H%M%S') || '-'
           || substr(sha256(cast(event_id AS VARCHAR)), 1, 8) AS name FROM events
    """,
)
def x12_snapshot_name(spark, sf_dir):
    url = F.concat(lit("https://"), "event_type", lit(".example.com/"))
    name = C.snapshot_name(url, F.col("ts"), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"))


@query(
    "x13_safe_charset",
    """
    SELECT p_partkey, coalesce(nullif(regexp_replace(
        CASE WHEN p_size < 10 THEN '#!-' ELSE p_brand || '-é' END, '[^A-Za-z0-9_]', '', 'g'), ''), 'utf8mb4') AS charset
    FROM part
    """,
)
def x13_safe_charset(spark, sf_dir):
    raw = F.when(F.col("p_size") < 10, "#!-").otherwise(F.concat("p_brand", lit("-é")))
    return table(spark, sf_dir, "part").select("p_partkey", C.safe_charset(raw).alias("charset"))


@query(
    "x14_percent_done",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 100
        ELSE cast(floor(o_custkey / greatest(1, o_orderkey) * 100) AS INTEGER) END AS percent FROM orders
    """,
)
def x14_percent_done(spark, sf_dir):
    percent = C.percent_done(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", percent.alias("percent"))


# ================================================================ sources and sinks


@query(
    "s1_export_snapshot",
    """
    SELECT 'wp_comments' AS name, count(*) AS rows FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'wp_posts', count(*) FROM conversations WHERE role <> 'user'
    UNION ALL SELECT 'wp_supplier', count(*) FROM supplier
    UNION ALL SELECT 'files', count(*) FROM documents WHERE lang <> 'de'
    UNION ALL SELECT 'bytes', sum(strlen(text))::BIGINT FROM documents WHERE lang <> 'de'
    """,
)
def s1_export_snapshot(spark, sf_dir):
    dest = scratch(spark, "snapshot")
    approved = F.when(F.col("event_type") == "error", "spam").otherwise("1").alias("comment_approved")
    kind = F.when(F.col("role") == "user", "revision").otherwise("post").alias("post_type")
    tables = {
        "wp_comments": table(spark, sf_dir, "events").select("event_id", approved),
        "wp_posts": table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind),
        "wp_supplier": table(spark, sf_dir, "supplier"),
        "wp_woocommerce_sessions": table(spark, sf_dir, "customer"),
        "other_part": table(spark, sf_dir, "part"),
    }
    options = rel_ops.ExportOptions.from_dict(
        {
            "no_spam_comments": True,
            "no_post_revisions": True,
            "no_sessions": True,
            "exclude_paths": ["/docs/de", "docs/../fr"],
        }
    )
    summary = snap.export_snapshot(tables, _document_files(spark, sf_dir), dest, options)
    _, stored = snap.read_snapshot(spark, dest)
    counts = [df.agg(F.count("*").alias("rows")).select(lit(n).alias("name"), "rows") for n, df in stored.items()]
    totals = summary.select(F.inline(F.array(
        F.struct(lit("files").alias("name"), F.col("files").alias("rows")),
        F.struct(lit("bytes").alias("name"), F.col("bytes").alias("rows")),
    )))
    return rel_ops.entry_union(*counts, totals)


def _document_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(lit("docs/"), "lang", lit("/"), "doc_id").alias("rel"),
        F.timestamp_seconds(F.lit(0)).alias("mtime"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query("s2_read_snapshot", "SELECT * FROM customer")
def s2_read_snapshot(spark, sf_dir):
    dest = scratch(spark, "snapshot")
    snap.export_snapshot({"wp_customer": table(spark, sf_dir, "customer")}, None, dest)
    _, stored = snap.read_snapshot(spark, dest)
    return stored["wp_customer"]


@query(
    "s3_sql_tuple_text",
    f"""
    SELECT doc_id, '(' || concat_ws(',', '''' || doc_id || '''', {sql_quoted('text')}, {sql_quoted('lang')}) || ')' AS row_text
    FROM documents
    """,
)
def s3_sql_tuple_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", sqldump.tuple_text(docs.schema).alias("row_text"))


@query("s3_sql_insert_sink", "SELECT page_id, url, html FROM pages")
def s3_sql_insert_sink(spark, sf_dir):
    """Statements of the sink, taken apart again without going through files."""
    pages = table(spark, sf_dir, "pages")
    statements = sqldump.to_sql_inserts(pages, "wp_pages", max_bytes=65_536)
    return sqldump.decode_inserts(statements, "wp_pages", pages.schema)


@query("s4_sql_dump_source", "SELECT * FROM orders")
def s4_sql_dump_source(spark, sf_dir):
    """One folder of dumps that holds two tables; one is read."""
    orders, dest = table(spark, sf_dir, "orders"), scratch(spark, "dump")
    sqldump.write_sql_dump(orders, "wp_orders", f"{dest}/a")
    sqldump.write_sql_dump(table(spark, sf_dir, "supplier"), "wp_supplier", f"{dest}/b", gzipped=True)
    return sqldump.read_sql_dumps(spark, f"{dest}/*/part-*", "wp_orders", orders.schema)


@query("s4_sql_dump_stream", "SELECT * FROM documents")
def s4_sql_dump_stream(spark, sf_dir):
    """The same through the reader for dumps of any layout, compressed."""
    docs, dest = table(spark, sf_dir, "documents"), scratch(spark, "dump")
    sqldump.write_sql_dump(docs, "wp_documents", dest, gzipped=True)
    return sqldump.read_sql_dumps(spark, f"{dest}/part-*", "wp_documents", docs.schema, layout="stream")


#: Heads as other tools write them; columns are named or in the order of the table.
HEADS = [
    "INSERT INTO `wp_orders` ({q}) VALUES ", "  insert into wp_orders ({b}) values", "INSERT IGNORE INTO `wp_orders`({q})VALUES", "REPLACE INTO `wp_orders` VALUES ",
    "insert low_priority into `wp_orders` ({q}) value ", "/* c */ INSERT INTO shop.wp_orders VALUES ", "INSERT INTO `shop` . `wp_orders` ({b}) VALUES ",
    "INSERT wp_orders VALUES ", "Replace Delayed wp_orders ({q}) VALUES\t", 'INSERT HIGH_PRIORITY INTO "wp_orders" ({b}) VALUES ',
]


@query("s4_sql_heads", "SELECT 'lines' AS layout, * FROM orders UNION ALL SELECT 'stream', * FROM orders")
def s4_sql_heads(spark, sf_dir):
    """Orders dumped under ten kinds of heads beside another table, read in both layouts."""
    orders, dest = table(spark, sf_dir, "orders"), scratch(spark, "heads")
    own = f"INSERT INTO `wp_orders` ({','.join(f'`{c}`' for c in orders.columns)}) VALUES "
    heads = [h.format(q=",".join(f"`{c}`" for c in orders.columns), b=", ".join(orders.columns).upper()) for h in HEADS]
    statements = sqldump.to_sql_inserts(orders, "wp_orders", max_bytes=2000)
    head = F.element_at(F.array(*map(lit, heads)), (F.col("stmt_no") % len(heads)).cast("int") + 1)
    other = sqldump.to_sql_inserts(table(spark, sf_dir, "supplier"), "wp_orders_old").select("sql")
    changed = statements.select(F.concat(head, F.substring("sql", len(own) + 1, 2**31 - 1)).alias("sql"))
    changed.unionByName(other).write.text(dest)
    read = {way: sqldump.read_sql_dumps(spark, f"{dest}/part-*", "wp_orders", orders.schema, way) for way in ("lines", "stream")}
    return rel_ops.entry_union(*[df.select(lit(way).alias("layout"), "*") for way, df in read.items()])


@query("s3_binary_values", "SELECT doc_id, md5(text) AS md5, lang FROM documents")
def s3_binary_values(spark, sf_dir):
    """Bytes as hexadecimal literals, there and back."""
    dest = scratch(spark, "dump")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"), "lang")
    sqldump.write_sql_dump(docs, "wp_files", dest)
    back = sqldump.read_sql_dumps(spark, f"{dest}/part-*", "wp_files", docs.schema)
    return back.select("doc_id", F.md5("body").alias("md5"), "lang")


@query("s5_file_inventory", "SELECT DISTINCT source, lang FROM documents")
def s5_file_inventory(spark, sf_dir):
    """Documents written as files per source and language, then found again in the folder."""
    base = scratch(spark, "tree")
    table(spark, sf_dir, "documents").write.partitionBy("source", "lang").parquet(base)
    found = inventory.file_inventory(spark, base, names=["_SUCCESS"])
    return (
        found.filter(F.endswith("rel", lit(".parquet")) & (F.col("size") > 0))
        .select(
            F.regexp_extract("rel", "source=([^/]*)/", 1).alias("source"),
            F.regexp_extract("rel", "lang=([^/]*)/", 1).alias("lang"),
        )
        .distinct()
    )


@query(
    "s5_folder_sizes",
    """
    SELECT 'source=' || source || '/lang=' || lang AS folder, sum(strlen(text) + 1)::BIGINT AS size,
           'source=' || source AS parent FROM documents GROUP BY source, lang
    """,
)
def s5_folder_sizes(spark, sf_dir):
    """Texts written as files, listed again: paths, sizes and folders of the listing."""
    base = scratch(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").option("lineSep", "\n").text(base)
    tree = inventory.list_tree(spark, base, names=["_SUCCESS"])
    files = tree.filter((F.col("kind") == "file") & F.col("rel").rlike("/part-[^/]*$"))
    sizes = files_ops.dir_rollup(files, tree.filter("kind = 'dir'").select("rel")).filter("depth = 2")
    return sizes.select(F.col("rel").alias("folder"), "size", F.substring_index("rel", "/", 1).alias("parent"))


@query("s6_entries", "SELECT doc_id, text FROM documents")
def s6_entries(spark, sf_dir):
    """Texts cut into pieces of 64 bytes, stored and put together again."""
    dest = scratch(spark, "entries")
    snap.write_entries(snap.cut_content(_document_files(spark, sf_dir), chunk=64), dest)
    whole = snap.read_entries(spark, dest, where=F.col("type") == "file")
    return whole.select(
        F.substring_index("rel", "/", -1).cast("long").alias("doc_id"),
        F.decode("content", "UTF-8").alias("text"),
    )


@query("s6_byte_ranges", "SELECT doc_id, md5(substr(text, 101, 5000)) AS md5 FROM documents WHERE doc_id = 42 AND length(text) = strlen(text)")
def s6_byte_ranges(spark, sf_dir):
    """A part of one stored text, from the pieces that hold it."""
    dest = scratch(spark, "entries")
    docs = table(spark, sf_dir, "documents").filter(F.length("text") == F.octet_length("text"))
    files = docs.select(F.col("doc_id").cast("string").alias("rel"), F.timestamp_seconds(lit(0)).alias("mtime"), F.encode("text", "UTF-8").alias("content"))
    snap.write_entries(snap.cut_content(files, chunk=1000), dest)
    part = snap.read_range(spark, dest, "42", 100, 5000)
    return part.select(long("rel").alias("doc_id"), F.md5("content").alias("md5"))


@query("s6_entry_headers", "SELECT 'docs/' || lang || '/' || doc_id AS rel, strlen(text) AS size, 'ok' AS status FROM documents")
def s6_entry_headers(spark, sf_dir):
    """Headers and verdicts of stored entries, and their checksums against the content's."""
    dest, files = scratch(spark, "entries"), _document_files(spark, sf_dir)
    snap.write_entries(snap.cut_content(files, chunk=1024), dest)
    headers = snap.entry_headers(spark, dest)
    checked = snap.check_content(headers, files)
    return headers.select("rel", "size").join(checked, "rel")


def _archive_writer(folder: str):
    """Writes each partition's texts as one packed archive and yields what it wrote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.part"
        count = 0
        with open(path, "wb") as file:
            file.write(archive.SIGNATURE)
            for batch in batches:
                for row in batch.itertuples(index=False):
                    body = row.text.encode()
                    header = (
                        f'{{"p":"{row.doc_id}","s":{len(body)},"m":0,"t":"file",'
                        f'"c":"{zlib.crc32(body):08x}"}}'
                    ).encode()
                    file.write(struct.pack(archive.LENGTH, len(header)) + header + body)
                    count += 1
            file.write(struct.pack(archive.LENGTH, 0))
        yield pd.DataFrame({"archive": [path], "entries": [count]})

    return run


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Archives of ``df(doc_id, text)``, one per partition: ``(archive, entries)`` of finished ones.

    Only for exercising the reader. A repeated task leaves a file that is not in the list.
    """
    writer = _archive_writer(local_path(folder))
    return checkpointed(df.select("doc_id", "text").mapInPandas(writer, "archive string, entries long"))


@query("s7_archive_catalog", "SELECT doc_id, strlen(text) AS size, 'file' AS type FROM documents")
def s7_archive_catalog(spark, sf_dir):
    folder = scratch(spark, "archives")
    docs = table(spark, sf_dir, "documents").repartition("source", "lang")
    finished = write_archives(docs, folder)
    entries = archive.archive_catalog(spark, f"{folder}/*.part").join(finished, "archive", "left_semi")
    return entries.select(long("path").alias("doc_id"), "size", "type")


@query("s7_archive_content", "SELECT doc_id, md5(text) AS md5, 'ok' AS status FROM documents WHERE strlen(text) > 2000")
def s7_archive_content(spark, sf_dir):
    """Content of the larger entries by a stored index of headers, with checksums verified."""
    folder = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id"), folder).count()
    index = archive.ArchiveIndex(spark, f"{folder}-index")
    index.refresh(f"{folder}/*.part")
    large = F.col("size") > 2000
    content = index.contents(large, chunk=1 << 20).groupBy("path").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda p: p["content"].cast("string")), "")).alias("md5")
    )
    checked = index.verify(large).select("path", "status")
    return content.join(checked, "path").select(long("path").alias("doc_id"), "md5", "status")


# ================================================================ streaming


@query("t1_resumable_export", "SELECT * FROM events")
def t1_resumable_export(spark, sf_dir):
    events, base = table(spark, sf_dir, "events"), scratch(spark, "export")
    events.repartition(12).write.parquet(f"{base}/in")
    streams.stream_export(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", events.schema, max_files=5
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("t1_resumable_snapshot", "SELECT 'docs/' || lang || '/' || doc_id AS rel, text FROM documents WHERE lang <> 'de'")
def t1_resumable_snapshot(spark, sf_dir):
    """Texts as files and a table, exported in slices: stopped after the first one, then gone on with by a new job."""
    base = scratch(spark, "sliced")
    _document_files(spark, sf_dir).repartition(12, "rel").write.parquet(f"{base}/files")

    def job():
        tables = {"wp_supplier": table(spark, sf_dir, "supplier"), "wp_woocommerce_sessions": table(spark, sf_dir, "customer")}
        options = rel_ops.ExportOptions.from_dict({"no_sessions": True, "exclude_paths": ["docs/de"]})
        return export.ResumableExport(spark, f"{base}/out", tables, content=f"{base}/files", options=options, slice_parts=4)

    if job().run(max_slices=1).head().status != "running" or job().run().head().status != "done":
        raise RuntimeError("the export did not stop after its first slice, or did not end")
    snap.read_snapshot(spark, f"{base}/out")
    whole = snap.read_entries(spark, f"{base}/out/entries")
    return whole.select(F.substring("rel", len(snap.CONTENT_ROOT) + 1, 2**31 - 1).alias("rel"), F.decode("content", "UTF-8").alias("text"))


@query(
    "t2_chunk_assembly",
    """
    SELECT conv_id AS upload_id, cast(turn // 16 AS INTEGER) AS segment, count(*) AS chunks,
           string_agg(text, '' ORDER BY turn) AS body
    FROM conversations GROUP BY conv_id, turn // 16
    """,
)
def t2_chunk_assembly(spark, sf_dir):
    """Each upload was tried before: the first attempt's chunks must leave no trace."""
    final = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("upload_id"),
        F.col("turn").cast("int").alias("idx"),
        (F.col("turn") + 100).alias("arrival"),
        F.col("text").alias("body"),
    )
    stale = final.select(
        "upload_id",
        (F.col("idx") + 3).alias("idx"),
        F.col("idx").cast("long").alias("arrival"),
        lit("stale").alias("body"),
    )
    return streams.assemble(final.unionByName(stale), arrival="arrival")


@query(
    "t2_chunk_assembly_stream",
    """
    SELECT conv_id AS upload_id, cast(turn // 2 AS INTEGER) AS segment, count(*) AS chunks,
           string_agg(text, '' ORDER BY turn) AS body
    FROM conversations GROUP BY conv_id, turn // 2
    """,
)
def t2_chunk_assembly_stream(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    totals = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("total"))
    chunks = turns.join(totals, "conv_id").select(
        F.col("conv_id").alias("upload_id"),
        F.col("turn").cast("int").alias("idx"),
        "total",
        F.lit(1).cast("long").alias("attempt"),
        F.col("turn").alias("arrival"),
        F.col("text").alias("body"),
    )
    base = scratch(spark, "uploads")
    chunks.repartition(4, "idx").write.parquet(f"{base}/in")
    stream = streams.file_stream(streams.stateful_session(spark), f"{base}/in", chunks.schema, max_files=2)
    whole = streams.assemble_stream(stream, segment_chunks=2)
    streams.write_stream(whole, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("attempt", "total")


UPLOAD_CHUNK = 4096


def _upload_chunks(spark, sf_dir) -> DataFrame:
    """The bytes of each text in chunks, out of order; of every seventh longer one the second chunk never came."""
    content = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    last = F.floor(F.greatest(F.octet_length("content") - 1, F.lit(0)) / UPLOAD_CHUNK).cast("int")
    cut = docs.select("doc_id", "content", (last + 1).alias("total"), F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    chunks = cut.select(
        F.col("doc_id").alias("upload_id"),
        "idx",
        "total",
        F.lit(2).cast("long").alias("attempt"),
        (F.lit(100) - F.col("idx")).cast("long").alias("arrival"),
        F.substring("content", F.col("idx") * UPLOAD_CHUNK + 1, F.lit(UPLOAD_CHUNK)).alias("body"),
    )
    return chunks.filter((F.col("upload_id") % 7 != 0) | (F.col("idx") != 1))


SQL_UPLOADS = f"""
    SELECT doc_id AS upload_id, cast(total - gap AS BIGINT) AS chunks, gap = 0 AS complete, CASE WHEN gap = 0 THEN md5(text) END AS md5
    FROM (SELECT doc_id, text, total, CASE WHEN doc_id % 7 = 0 AND total > 1 THEN 1 ELSE 0 END AS gap
          FROM (SELECT doc_id, text, greatest(strlen(text) - 1, 0) // {UPLOAD_CHUNK} + 1 AS total FROM documents))
"""


@query("t2_binary_uploads", SQL_UPLOADS)
def t2_binary_uploads(spark, sf_dir):
    """Uploads of bytes, cut within characters, with gaps: which are complete, and what the complete ones hold."""
    chunks = _upload_chunks(spark, sf_dir)
    largest = chunks.agg(F.max("total")).head()[0] or 1
    whole = streams.assemble(chunks, segment_chunks=largest, total="total")
    return whole.select("upload_id", "chunks", "complete", F.when(F.col("complete"), F.md5("body")).alias("md5"))


@query("t2_binary_uploads_stream", f"SELECT upload_id, chunks, md5 FROM ({SQL_UPLOADS}) WHERE complete")
def t2_binary_uploads_stream(spark, sf_dir):
    """The same on a stream, with all chunks sent again and an older attempt that comes late: each upload is put out once.

    An upload of several segments is one row when all of them are out, as the SQL has no segments.
    """
    chunks, base = _upload_chunks(spark, sf_dir), scratch(spark, "uploads")
    late = chunks.withColumn("attempt", F.lit(1).cast("long")).withColumn("body", F.encode(lit("late"), "UTF-8"))
    for name, df in {"a": chunks, "b": chunks.withColumn("arrival", F.col("arrival") + 1000), "c": late}.items():
        df.write.parquet(f"{base}/in/{name}", compression="zstd")  # bodies lie there twice, and once more in the result
    files = max(1, len(spark.read.schema(chunks.schema).parquet(f"{base}/in/a").inputFiles()))  # one batch for each sending
    stream = streams.file_stream(streams.stateful_session(spark), f"{base}/in/*", chunks.schema, max_files=files)
    streams.write_stream(streams.assemble_stream(stream), f"{base}/out", f"{base}/checkpoint", compression="zstd").awaitTermination()
    return streams.upload_digests(spark.read.parquet(f"{base}/out")).drop("attempt")


SQL_PROGRESS = """
    SELECT conv_id AS job, CASE WHEN max(turn) = 7 THEN 'done' ELSE 'running' END AS status,
           max(turn) + 1 AS idx, cast(8 AS BIGINT) AS total,
           CASE WHEN max(turn) = 7 THEN 100 ELSE cast(floor((max(turn) + 1) / 8 * 100) AS INTEGER) END AS percent,
           max(turn) = 7 AS done
    FROM conversations GROUP BY conv_id
"""


def _steps(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").alias("job"),
        (F.col("turn") + 1).alias("idx"),
        F.lit(8).cast("long").alias("total"),
        F.when(F.col("turn") == 7, "done").otherwise("running").alias("status"),
    )


@query("t3_job_progress", SQL_PROGRESS)
def t3_job_progress(spark, sf_dir):
    return streams.progress(_steps(table(spark, sf_dir, "conversations")))


@query("t3_job_progress_stream", SQL_PROGRESS)
def t3_job_progress_stream(spark, sf_dir):
    """The same on a stream: each batch's states are written, and the last state per job is kept."""
    turns, base = table(spark, sf_dir, "conversations"), scratch(spark, "progress")
    turns.repartition(6).write.parquet(f"{base}/in")
    stream = streams.file_stream(spark, f"{base}/in", turns.schema, max_files=3)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    (
        streams.progress(_steps(stream))
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
        .awaitTermination()
    )
    states = spark.read.parquet(f"{base}/out").drop("batch")
    return streams.progress(states.select("job", "idx", "total", "status"))


# ================================================================ lifecycle


@query(
    "l1_restore_snapshot",
    f"""
    SELECT page_id, replace({SQL_ONCE}, 'example.net', 'cdn.example.net') AS url,
           replace(replace(html, 'example.com', 'shop.example.com'), 'example.net', 'cdn.example.net') AS html
    FROM pages
    """,
)
def l1_restore_snapshot(spark, sf_dir):
    base = scratch(spark, "restore")
    source = {"homeUrl": "example.com", "siteUrl": "example.com", "contentDir": "example.net", "abspath": "/srv"}
    snap.export_snapshot(
        {"wp_pages": table(spark, sf_dir, "pages")}, _document_files(spark, sf_dir), f"{base}/snapshot", identity=source
    )
    snap.restore_snapshot(
        spark,
        f"{base}/snapshot",
        f"{base}/target",
        {"home": "shop.example.com", "siteurl": "shop.example.com", "content": "cdn.example.net", "abspath": "/srv"},
        {"wp_pages": ["page_id"]},
    )
    return snap.open_version(spark, f"{base}/target", "wp_pages")
