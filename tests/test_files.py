import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.functions.columns import is_gzip
from stowage.operators import files as ops
from stowage.operators.ranking import rank_within, top_within
from stowage.operators.relational import ExportOptions, difference, inactive, select_tables
from stowage.sources.inventory import crc_followed_by, file_heads, file_inventory, file_pieces, files_still_there, list_tree


@pytest.fixture
def tree(tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    contents = {
        "uploads/2026/a.jpg": b"a" * 100,
        "uploads/b.txt": b"bb",
        "themes/x/style.css": b"css",
        "node_modules/pkg/index.js": b"no",
        "backups/old.snapshot": b"no",
        ".DS_Store": b"no",
        ".keep": b"dot",
        "cache/x": b"no",
        "cache2/x": b"yes",
        "empty": b"",
        "with space/żółw.txt": b"utf",
        "packed.gz": b"\x1f\x8b\x08rest",
    }
    for rel, content in contents.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    outside.mkdir()
    (outside / "secret.txt").write_bytes(b"x")
    os.symlink(outside, root / "themes/linked")
    os.symlink(outside / "secret.txt", root / "uploads/link.txt")
    return str(root), contents


KEPT = {"uploads/2026/a.jpg", "uploads/b.txt", "themes/x/style.css", ".keep", "cache2/x", "empty",
        "with space/żółw.txt", "packed.gz"}


def test_inventory_prunes_while_it_walks(spark, tree):
    root, contents = tree
    found = file_inventory(spark, root, ops.PRUNED_NAMES, ["backups", "/cache/"]).collect()
    assert {r.rel: r.size for r in found} == {rel: len(contents[rel]) for rel in KEPT}
    assert all(r.mtime is not None for r in found)


def test_trees_hold_folders_and_what_cannot_be_read(spark, tree, monkeypatch):
    root, contents = tree
    os.makedirs(f"{root}/uploads/none/at/all")
    os.makedirs(f"{root}/cache/also/none")
    rows = list_tree(spark, root, ops.PRUNED_NAMES, ["backups", "cache"]).collect()
    assert {r.rel for r in rows if r.kind == "file"} == KEPT
    assert {r.rel for r in rows if r.kind == "dir"} == {
        "uploads", "uploads/2026", "uploads/none", "uploads/none/at", "uploads/none/at/all", "themes", "themes/x", "cache2", "with space",
    }
    with pytest.raises(Exception, match="FileNotFoundError"):
        list_tree(spark, f"{root}/nothing").collect()


def test_a_folder_that_does_not_open_is_a_row(tmp_path, monkeypatch):
    import pandas as pd

    from stowage.sources import inventory

    (tmp_path / "open").mkdir()
    for name in ("open/a", "b", "gone", "mute"):
        (tmp_path / name).write_bytes(b"xyz")
    real_scan, real_stat = os.scandir, os.lstat

    def scandir(path):
        if str(path).endswith("closed"):
            raise PermissionError(path)
        return real_scan(path)

    def lstat(path):
        if str(path).endswith("mute"):
            raise PermissionError(path)
        return real_stat(path)

    monkeypatch.setattr(inventory.os, "scandir", scandir)
    monkeypatch.setattr(inventory.os, "lstat", lstat)
    folders = pd.DataFrame({"rel": ["open", "closed", "vanished"]})
    names = pd.concat(inventory._list_names(str(tmp_path), frozenset(), ())([folders]))
    assert sorted(names.itertuples(index=False, name=None)) == [("closed", "unreadable"), ("open/a", "file")]
    (tmp_path / "gone").unlink()
    sizes = pd.concat(inventory._sizes(str(tmp_path))([pd.DataFrame({"rel": ["b", "gone", "mute", "open", "b/c"]})]))
    assert [tuple(r[:3]) for r in sizes.itertuples(index=False, name=None)] == [("b", "file", 3), ("mute", "unreadable", 0)]


def test_files_that_are_gone_are_left_out(spark, tree):
    root, contents = tree
    listed = file_inventory(spark, root)
    os.unlink(f"{root}/uploads/b.txt")
    with open(f"{root}/empty", "wb") as file:
        file.write(b"now more")
    now = {r.rel: r.size for r in files_still_there(listed, root).collect()}
    assert now == {rel: len(c) for rel, c in contents.items() if rel != "uploads/b.txt"} | {"empty": 8}


def test_inventory_then_prune_gives_the_same(spark, tree):
    root, contents = tree
    every = file_inventory(spark, root)
    assert {r.rel for r in every.collect()} == set(contents)
    pruned = ops.prune_paths(every, ops.PRUNED_NAMES, ["backups/", "cache"])
    assert {r.rel for r in pruned.collect()} == KEPT


def test_prefixes_inline_and_joined_agree(spark):
    rng = random.Random(3)
    paths = ["/".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    prefixes = ["a", "b/c", "d/d/d", "c/a/b/a", "bb"]
    files = spark.createDataFrame([(p,) for p in sorted(set(paths))], "rel string")
    listed = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    expected = {p for p in paths if not any(p == x or p.startswith(x + "/") for x in prefixes)}
    assert {r.rel for r in ops.prune_paths(files, (), prefixes).collect()} == expected
    assert {r.rel for r in ops.prune_paths(files, (), listed).collect()} == expected
    assert {r.rel for r in ops.prune_joined(files, listed).collect()} == expected


def test_prefixes_are_tidied_alike(spark):
    files = spark.createDataFrame([("top.txt",), ("plugins/old/a",), ("plugins/new/a",), (None,)], "rel string")
    prefixes = ["plugins\\old\\", ""]
    for more in ([], [f"none{i}" for i in range(1200)]):
        listed = spark.createDataFrame([(p,) for p in [*prefixes, *more, None]], "prefix string")
        for given in (prefixes + more, listed):
            assert {r.rel for r in ops.prune_paths(files, ["nope"], given).collect()} == {"top.txt", "plugins/new/a", None}


def test_user_prefixes_and_switches():
    assert ops.user_prefixes(["\\a\\b", "//x", "", "/", "a/../b"]) == ["a/b", "x"]
    options = ExportOptions.from_dict({"no_media": 1, "no_cache": 1, "exclude_paths": ["/docs"]})
    assert ops.excluded_prefixes(options) == ["snapshots", "uploads", "cache", "docs"]


def test_all_switch_wins_over_inactive(spark):
    names = spark.createDataFrame([("old",)], "name string")
    some = ExportOptions.from_dict({"no_inactive_plugins": 1, "no_inactive_themes": 1, "no_themes": 1})
    parts = ops.component_prefixes(some, ops.SiteLayout(), names, names)
    assert [r.prefix for p in parts for r in p.collect()] == ["plugins/old"]


def test_guard(spark):
    cases = {
        "wp-content/a.txt": "ok", "wp-content/": "empty", "wp-content/../x": "climbs",
        "wp-content/a..b": "climbs", "wp-content//etc": "absolute", "etc/passwd": "foreign",
        "wp-content/plugins/own/x": "protected", "wp-content/plugins/owner": "ok", "": "foreign",
    }
    entries = spark.createDataFrame([(c,) for c in cases], "path string")
    rows = ops.guard_paths(entries, protected=["wp-content/plugins/own/"]).collect()
    assert {r.path: r.verdict for r in rows} == cases


FILES = [("a/x", 5), ("a/b/y", 7), ("a/b/c/d/z", 11), ("top", 3), ("e/one", 2), ("e/two", 2)]


def test_rollup_and_tree(spark):
    files = spark.createDataFrame(FILES, "rel string, size long")
    rows = {r.rel: (r.depth, r["size"], r.nodes) for r in ops.dir_rollup(files).collect()}
    assert rows == {
        "": (0, 30, 11), "a": (1, 23, 6), "a/b": (2, 18, 4), "a/b/c": (3, 11, 2),
        "a/b/c/d": (4, 11, 1), "e": (1, 4, 2),
    }
    listed = ops.size_tree(files, max_depth=2, file_threshold=2, skip=["a/b/c"]).collect()
    assert {(r.parent, r["rank"], r.name, r.dir, r["size"], r.nodes) for r in listed} == {
        ("", 1, "a", True, 12, 3), ("", 2, "e", True, 4, 2), ("", 3, "top", False, 3, 0),
        ("a", 1, "b", True, 7, 1), ("a", 2, "x", False, 5, 0),
        ("e", 1, "one", False, 2, 0), ("e", 2, "two", False, 2, 0),
    }


def test_empty_folders_count(spark):
    files = spark.createDataFrame(FILES, "rel string, size long")
    folders = spark.createDataFrame([("a",), ("e/none/at",), ("e/none",), ("solo",), ("a/b/c/none",)], "rel string")
    rows = {r.rel: (r["size"], r.nodes) for r in ops.dir_rollup(files, folders).collect()}
    assert rows == {
        "": (30, 15), "a": (23, 7), "a/b": (18, 5), "a/b/c": (11, 3), "a/b/c/d": (11, 1), "a/b/c/none": (0, 0),
        "e": (4, 4), "e/none": (0, 1), "e/none/at": (0, 0), "solo": (0, 0),
    }
    listed = ops.size_tree(files, 2, 1 << 30, ["a/b/c"], folders).collect()
    assert {(r.rel, r["rank"], r["size"], r.nodes) for r in listed} == {
        ("a", 1, 12, 3), ("e", 2, 4, 4), ("solo", 3, 0, 0), ("a/b", 1, 7, 1), ("e/none", 1, 0, 1),
    }
    nothing = ops.dir_rollup(files.limit(0), folders.filter("rel = 'solo'")).collect()
    assert {(r.rel, r.nodes) for r in nothing} == {("", 1), ("solo", 0)}


def test_ranks_of_one_large_group(spark):
    rng = random.Random(5)
    rows = [("hot" if n % 3 else f"g{n % 7}", rng.randint(1, 20), f"n{n:05}") for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, size long, name string").repartition(6)
    order = [F.desc("size"), F.asc("name")]
    got = {(r.g, r.name): r["rank"] for r in rank_within(df, ["g"], order).collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        expected |= {(group, r[2]): at for at, r in enumerate(ordered, start=1)}
    assert got == expected
    top = {(r.g, r.name): r["rank"] for r in top_within(df, ["g"], order, 4).collect()}
    assert top == {k: v for k, v in expected.items() if v <= 4}


def test_pieces_and_their_checksums(spark, tmp_path):
    rng = random.Random(9)
    contents = {"big": rng.randbytes(70_001), "small": b"abc", "empty": b"", "exact": rng.randbytes(3000)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    pieces = file_pieces(file_inventory(spark, str(tmp_path)), str(tmp_path), chunk=1000)
    whole = pieces.groupBy("rel").agg(
        F.count("*").alias("n"), F.bit_xor("share").alias("crc"), F.sum(F.octet_length("content")).alias("size")
    )
    rows = {r.rel: (r.n, r.crc, r["size"]) for r in whole.collect()}
    assert rows == {n: (max(1, -(-len(c) // 1000)), zlib.crc32(c), len(c)) for n, c in contents.items()}


def test_checksum_of_joined_parts():
    a, b = b"hello ", b"spread world"
    assert crc_followed_by(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)
    assert crc_followed_by(123, 0) == 123


def test_heads(spark, tree):
    root, _ = tree
    heads = file_heads(file_inventory(spark, root), root)
    rows = heads.select("rel", is_gzip(F.col("head")).alias("z")).collect()
    assert [r.rel for r in rows if r.z] == ["packed.gz"]


def test_verify(spark):
    entries = spark.createDataFrame(
        [("ok", "1"), ("bad", "1"), ("gone", "1"), ("unknown", None), ("twice", "1")], "rel string, crc string"
    )
    contents = spark.createDataFrame(
        [("ok", "1"), ("bad", "2"), ("new", "1"), ("unknown", "5"), ("twice", "1"), ("twice", "2")],
        "rel string, crc string",
    )
    assert {r.rel: r.status for r in ops.verify(entries, contents).collect()} == {
        "ok": "ok", "bad": "corrupt", "gone": "missing", "unknown": "unverifiable", "new": "extra",
        "twice": "corrupt",
    }


def test_summary_and_catalogue(spark):
    entries = spark.createDataFrame([("table", 5), ("file", 7), ("file", 1)], "type string, size long")
    assert ops.export_summary(entries).head().asDict() == {"tables": 1, "files": 2, "bytes": 13}
    files = spark.sql(
        """SELECT * FROM VALUES ('d/b.snapshot', 1L, TIMESTAMP'2026-01-01 00:00:59'),
           ('a.snapshot', 2048L, TIMESTAMP'2026-01-01 00:00:01'),
           ('c.snapshot.gz', 3L, TIMESTAMP'2026-02-01 10:00:00'),
           ('upload-x.snapshot', 3L, TIMESTAMP'2026-02-01 10:00:00'),
           ('x.zip', 3L, TIMESTAMP'2026-02-01 10:00:00') AS t(rel, size, mtime)"""
    )
    rows = [tuple(r) for r in ops.catalogue(files).collect()]
    assert rows == [
        ("c.snapshot.gz", 3, "3 B", "2026-02-01 10:00", True),
        ("a.snapshot", 2048, "2.0 KB", "2026-01-01 00:00", False),
        ("b.snapshot", 1, "1 B", "2026-01-01 00:00", False),
    ]


def test_table_lists(spark):
    catalog = spark.createDataFrame(
        [("wp_a", "BASE TABLE"), ("wpXa", "BASE TABLE"), ("wp_v", "VIEW"), ("wp_b", "BASE TABLE"),
         ("wp_v2", "VIEW")], "name string, kind string",
    )
    options = ExportOptions.from_dict({"exclude_tables": ["wp_b", "wp_v2", "x_a"]})
    assert {r.name for r in select_tables(catalog, "wp_", options).collect()} == {"wp_a"}
    both = select_tables(catalog, "wp_", options, include_views=True)
    assert {r.name for r in both.collect()} == {"wp_a", "wp_v"}
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    right = spark.createDataFrame([("b",), ("b",)], "name string")
    assert [r.name for r in difference(left, right, ["name"]).collect()] == ["a", "a"]
    assert inactive(left, right, always=["a"]).count() == 0
