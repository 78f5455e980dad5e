import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.operators.relational import ExportOptions
from stowage.plans.registry import QUERIES


def values(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[e.alias(n) for n, e in exprs.items()]).collect()


def test_is_serialized(spark):
    cases = {
        "N;": True, " N;\n": True, 'a:0:{}': True, "a:1:": False, "b:1;": True, "i:5;": True,
        "d:1.5E+3;": True, 's:3:"abc";': True, 's:3:"abc"': False, 's:3:"abc";x': False,
        '\t s:1:"é";\x0b': True, 's:1:"é': False, 'O:8:"stdClass":0:{}': True, "x:1:{}": False,
        "E:3:\"A:B\";": True, "a:x:{}": False, "": False, "a": False, "s:3:abc;": False,
        'C:1:"x":0:{}': False, "i:;": False, "b:1": False, "a:1:}": True, "plain; text:": False,
    }
    rows = values(spark, [(c,) for c in cases], "c string", c=F.col("c"), r=C.is_serialized(F.col("c")))
    assert {r.c: r.r for r in rows} == cases


def test_replace_pairs_counts_and_checks(spark):
    found = C.replace_pairs(F.col("c"), [("aa", "b"), ("b", "cc"), ("zz", "yy")])
    rows = values(spark, [("aaaaa",), ("zzz",), (None,)], "c string", r=found)
    assert [(r.r.value, r.r.hits) for r in rows] == [("cccca", 4), ("yyz", 1), (None, None)]
    for bad in [("", "x"), ("x", "x")]:
        with pytest.raises(ValueError):
            C.replace_pairs(F.col("c"), [bad])


def test_paths(spark):
    rows = values(
        spark, [("a/b/c.txt",), ("top",), ("",)], "p string",
        parent=C.parent_dir(F.col("p")), name=C.base_name(F.col("p")),
        above=C.path_and_ancestors(F.col("p")), depth=C.depth(F.col("p")),
    )
    assert rows[0].asDict() == {"parent": "a/b", "name": "c.txt", "above": ["a", "a/b", "a/b/c.txt"], "depth": 3}
    assert rows[1].asDict() == {"parent": "", "name": "top", "above": ["top"], "depth": 1}
    assert rows[2].depth == 0


def test_confine_top_and_label(spark):
    rows = values(
        spark, [("..\\a/./....//../b",), ("///x/y",), ("/",)], "p string",
        confined=C.confine_path(F.col("p"), "/base/"), top=C.top_segment(F.col("p")),
    )
    assert [r.confined for r in rows] == ["/base/a/..../b", "/base/x/y", "/base/"]
    assert [r.top for r in rows] == ["..\\a", "x", None]
    labels = values(
        spark, [("https://a_b.example:8080/x",), ("not a url",), ("https://Ünï.example/",), (None,)],
        "u string", label=C.host_label(F.col("u")),
    )
    assert [r.label for r in labels] == ["ab.example", "site", "n.example", "site"]


def test_sizes(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 10239: "10.0 KB", 10240: "10 KB",
             1048576: "1.0 MB", 5 << 40: "5.0 TB", 5000 << 40: "5000 TB", None: "0 B"}
    rows = values(spark, [(c,) for c in cases], "n long", n=F.col("n"), t=C.human_size(F.col("n")))
    assert {r.n: r.t for r in rows} == cases


def test_sizes_beyond_64_bits(spark):
    cases = {9223372036854775807: "8388608 TB", 9_000_000**2 * 900_000: "66302164 TB", 10**20: "90949470 TB", 5 << 40: "5.0 TB", None: "0 B"}
    rows = values(spark, [(c if c is None else Decimal(c),) for c in cases], "n decimal(38,0)", n=F.col("n"), t=C.human_size(F.col("n")))
    assert {None if r.n is None else int(r.n): r.t for r in rows} == cases


def test_sizes_of_large_keys(spark, tmp_path):
    keys = [(1, 5), (9_000_000, 900_000), (None, 3)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["x1_human_size"](spark, str(tmp_path)).collect()
    assert {r.o_orderkey: r.size_text for r in found} == {1: "5 B", 9_000_000: "66302164 TB", None: "0 B"}


def test_versions(spark):
    cases = [("8.10", "8.9", True), ("8.1", "8.1.0", False), ("8.1.1", "8.1", True), ("8.2-rc1", "8.2", False)]
    rows = values(spark, cases, "a string, b string, w boolean", r=C.version_newer(F.col("a"), F.col("b")), w=F.col("w"))
    assert all(r.r == r.w for r in rows)


def test_sql_text(spark):
    raw = "a\\b'c\"d\0e\nf\rg\x1ah"
    row = values(spark, [(raw, None, 5)], "a string, b string, c int",
                 a=C.sql_literal(F.col("a")), b=C.sql_literal(F.col("b")), c=C.sql_literal(F.col("c")))[0]
    assert row.a == "'a\\\\b\\'c\\\"d\\0e\\nf\\rg\\Zh'"
    assert (row.b, row.c) == ("NULL", "'5'")


def test_small_functions(spark):
    row = values(
        spark, [(["  a", "b", "a ", "", None, "\x0bc"], "utf-8!", "0", b"\x1f\x8b\x08", 3, 0)],
        "l array<string>, c string, z string, g binary, i int, t int",
        l=C.clean_list(F.col("l")), c=C.safe_charset(F.col("c")), z=C.safe_charset(F.col("z")),
        g=C.is_gzip(F.col("g")), p=C.percent_done(F.col("i"), F.col("t"), F.lit(False)),
        q=C.percent_done(F.col("i"), F.lit(7), F.lit(False)), d=C.percent_done(F.col("i"), F.lit(7), F.lit(True)),
        x=C.crc32_hex(F.lit("123456789")), s=C.crc32_hex(F.lit("")),
    )[0]
    assert row.l == ["a", "b", "c"]
    assert (row.c, row.z, row.g) == ("utf8", "utf8mb4", True)
    assert (row.p, row.q, row.d) == (300, 42, 100)
    assert (row.x, row.s) == ("cbf43926", "00000000")


def test_snapshot_name(spark):
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    row = values(spark, [("https://a.example/", at)], "u string, t timestamp",
                 n=C.snapshot_name(F.col("u"), F.col("t"), F.lit(1)))[0]
    assert row.n == "a.example-20260102-030405-6b86b273"


def test_manifest_supported(spark):
    rows = values(
        spark, [("f", 1), ("f", None), ("f", 2), ("g", 1), (None, 1)], "f string, v int",
        ok=C.manifest_supported(F.col("f"), F.col("v"), "f"),
    )
    assert [r.ok for r in rows] == [True, True, False, False, False]


def test_options(spark):
    options = ExportOptions.from_dict(
        {"no_sessions": "1", "no_cache": 0, "unknown": 1, "no_action_scheduler": True,
         "exclude_tables": [" wp_x ", "other", "wp_x", ""], "exclude_paths": "no list"}
    )
    names = ["wp_x", "other", "wp_woocommerce_sessions", "wp_actionscheduler_groups", "wp_posts", "zz_posts"]
    taken = values(spark, [(n,) for n in names], "name string", ok=options.takes_table(F.col("name"), "wp_"))
    assert [n for n, r in zip(names, taken, strict=True) if r.ok] == ["wp_posts"]
    assert options.excludes["no_sessions"] and not options.excludes["no_cache"] and "unknown" not in options.excludes
    assert options.tables == ("wp_x", "other") and options.paths == () and options.folders() == []
