import os
import random
import threading
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stowage.operators import rewrite as rw
from stowage.operators.relational import ExportOptions
from stowage.plans import manifest as M
from stowage.plans import snapshot as S


def pages(spark, host="https://old.example"):
    return spark.createDataFrame(
        [(n, f"{host}/{n}", f's:{len(host) + 2}:"{host}/{n}";') for n in range(9)],
        "id long, url string, meta string",
    )


def content(spark, items):
    return spark.createDataFrame(
        [(rel, bytearray(body)) for rel, body in items.items()], "rel string, content binary"
    ).withColumn("mtime", F.timestamp_seconds(F.lit(1)))


IDENTITY = {"homeUrl": "https://old.example", "siteUrl": "https://old.example", "contentDir": "/old/c"}
HERE = {"home": "https://old.example/sub", "siteurl": "https://old.example/sub", "content": "/old/c"}
FILES = {"a/x.bin": b"\x00\xff" * 700, "empty": b"", "plugins/own/y": b"no", "cache/z": b"zz"}


@pytest.fixture
def snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    summary = S.export_snapshot(
        {"wp_pages": pages(spark), "wp_plain": spark.range(4).selectExpr("id", "'https://old.example' t"),
         "wp_woocommerce_sessions": spark.range(3)},
        content(spark, FILES), path, ExportOptions.from_dict({"no_sessions": 1, "no_cache": 1}), IDENTITY,
    )
    return path, summary.head().asDict()


def test_export_and_read(spark, snapshot):
    path, summary = snapshot
    assert summary == {"tables": 2, "files": 3, "bytes": 1402}
    manifest, tables = S.read_snapshot(spark, path)
    facts = manifest.head()
    assert facts.tables == ["wp_pages", "wp_plain"] and facts.excludes["no_sessions"] is True
    assert tables["wp_pages"].count() == 9
    headers = {r.rel: (r["size"], r.chunks) for r in S.entry_headers(spark, f"{path}/entries").collect()}
    assert headers == {"wp-content/a/x.bin": (1400, 1), "wp-content/empty": (0, 1), "wp-content/plugins/own/y": (2, 1)}


def test_export_without_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    done = []
    summary = S.export_snapshot(
        {"wp_pages": pages(spark)}, None, path, ExportOptions.from_dict({"no_database": 1}), post_export=done.append
    )
    assert summary.head()[:] == (0, 0, 0) and done == [path]
    assert S.read_snapshot(spark, path)[1] == {}


def test_export_of_files_only(spark, tmp_path):
    path = str(tmp_path / "s")
    assert S.export_snapshot({}, content(spark, {"a": b"1"}), path).head()[:] == (0, 1, 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.export_snapshot({}, content(spark, {"a": b"1"}), path)
    assert S.entry_headers(spark, f"{path}/entries").count() == 1
    assert rw.rewrite_database({}, {}, [("a", "b")]).isEmpty()


def test_export_of_a_folder(spark, tmp_path):
    root = tmp_path / "site"
    for rel, body in {"up/a": b"1" * 10, ".git/x": b"no", "themes/t/s.css": b"css"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(body)
    path = str(tmp_path / "s")
    unused = spark.createDataFrame([("t",), ("ta",)], "name string")
    options = ExportOptions.from_dict({"no_inactive_themes": 1})
    result = S.export_snapshot({"wp_p": pages(spark)}, str(root), path, options, inactive_themes=unused)
    assert result.head()[:] == (1, 1, 10)
    whole = S.read_entries(spark, f"{path}/entries").head()
    assert (whole.rel, bytes(whole.content)) == ("wp-content/up/a", b"1" * 10)


def test_entries_in_segments(spark, tmp_path):
    body = random.Random(2).randbytes(5000)
    path = str(tmp_path / "e")
    S.write_entries(S.cut_content(content(spark, {"big": body, "none": b""}), chunk=64), path)
    assert {bytes(r.content) for r in S.read_entries(spark, path).collect()} == {body, b""}
    parts = S.read_entries(spark, path, F.col("rel") == "big", segment_bytes=1024).orderBy("segment").collect()
    assert [len(r.content) for r in parts] == [1024] * 4 + [904]
    assert b"".join(bytes(r.content) for r in parts) == body
    assert {r.status for r in S.verify_entries(spark, path).collect()} == {"ok"}
    headers = S.entry_headers(spark, path)
    assert {r.status for r in S.check_content(headers, content(spark, {"big": body, "none": b""})).collect()} == {"ok"}
    changed = content(spark, {"big": body[:-1] + b"?", "none": b""})
    assert {r.rel: r.status for r in S.check_content(headers, changed).collect()} == {"big": "corrupt", "none": "ok"}


def test_byte_ranges_read_their_pieces_only(spark, tmp_path):
    body = random.Random(3).randbytes(5000)
    path = str(tmp_path / "e")
    S.write_entries(S.cut_content(content(spark, {"big": body, "none": b"", "other": b"x" * 9000}), chunk=64), path)
    for first, count, segment in ((0, 5000, 1 << 20), (63, 2, 1 << 20), (64, 64, 1 << 20), (100, 3000, 500), (4990, 100, 64), (5000, 5, 64), (7, 0, 64)):
        rows = S.read_range(spark, path, "big", first, count, segment).orderBy("segment").collect()
        assert b"".join(bytes(r.content) for r in rows) == body[first : first + count]
        assert all(len(r.content) <= segment + 64 for r in rows)
    plan = S.read_range(spark, path, "big", 100, 200)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rel,big)" in plan and "LessThan(start,300)" in plan


def test_two_restores_at_once_are_both_published(spark, snapshot, tmp_path):
    target, waiting = str(tmp_path / "target"), threading.Barrier(2, timeout=120)

    def one(_):
        return restore(spark, snapshot[0], target, include_files=False, hook=lambda tables: waiting.wait())

    with ThreadPoolExecutor(2) as pool:
        assert [r.head().rows for r in pool.map(one, range(2))] == [13, 13]
    entries = sorted((p.name, p.read_text()) for p in (tmp_path / "target/published").iterdir())
    assert [name for name, _ in entries] == ["000000000001", "000000000002"]
    assert sorted(version for _, version in entries) == ["1", "2"]
    assert S.current_version(spark, target) == int(entries[-1][1])
    # A writer that died between making its entry and filling it has published nothing.
    (tmp_path / "target/published/000000000003").write_text("")
    assert S.current_version(spark, target) == int(entries[-1][1])
    restore(spark, snapshot[0], target, include_files=False)
    assert S.current_version(spark, target) == 3
    assert S.open_version(spark, target, "wp_pages").count() == 9


def test_missing_pieces_stop_a_restore(spark, snapshot, tmp_path):
    path, target = snapshot[0], str(tmp_path / "target")
    half = spark.createDataFrame(
        [("wp-content/half", 6, 0, 0, 3, bytearray(b"abc"), zlib.crc32(b"abc"), 0)],
        "rel string, size long, chunk_no int, start long, length long, content binary, crc long, share long",
    ).withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    S.write_entries(half, f"{path}/entries")
    with pytest.raises(RuntimeError, match="pieces are missing, or there twice, in wp-content/half"):
        restore(spark, path, target)
    assert S.current_version(spark, target) == 0


def tampered(spark, path, change):
    df = spark.read.parquet(f"{path}/entries")
    change(df).write.mode("overwrite").partitionBy("type").parquet(f"{path}-bad/entries")
    return f"{path}-bad"


def test_changed_and_missing_pieces_are_found(spark, tmp_path):
    path = str(tmp_path / "e")
    S.write_entries(S.cut_content(content(spark, {"a": b"x" * 300, "b": b"y" * 300}), chunk=100), f"{path}/entries")
    flipped = tampered(spark, path, lambda df: df.withColumn(
        "content", F.when((F.col("rel") == "a") & (F.col("chunk_no") == 1), F.encode(F.lit("z" * 100), "UTF-8"))
        .otherwise(F.col("content"))))
    status = lambda p: {r.rel: r.status for r in S.verify_entries(spark, f"{p}/entries").collect()}
    assert status(flipped) == {"a": "corrupt", "b": "ok"}
    short = tampered(spark, path, lambda df: df.filter("NOT (rel = 'b' AND chunk_no = 2)"))
    assert status(short) == {"a": "ok", "b": "corrupt"}
    bare = tampered(spark, path, lambda df: df.withColumn("crc", F.when(F.col("rel") != "a", F.col("crc"))))
    assert status(bare) == {"a": "unverifiable", "b": "ok"}


def test_a_doubled_piece_does_not_stand_in_for_a_lost_one(spark, tmp_path):
    path = str(tmp_path / "e")
    S.write_entries(S.cut_content(content(spark, {"a": b"AAAABBBB"}), chunk=4), f"{path}/entries")
    mixed = tampered(spark, path, lambda df: df.filter("chunk_no = 0").union(df.filter("chunk_no = 0")))
    assert [r.status for r in S.verify_entries(spark, f"{mixed}/entries").collect()] == ["corrupt"]


def restore(spark, path, target, **more):
    return S.restore_snapshot(
        spark, path, target, HERE, {"wp_pages": ["id"]}, protected=["wp-content/plugins/own/"], **more
    )


def test_restore_rewrites_once_and_guards_files(spark, snapshot, tmp_path):
    target = str(tmp_path / "target")
    result = restore(spark, snapshot[0], target).head().asDict()
    assert result == {"tables": 1, "rows": 13, "replaced": 9, "files": 2, "unrewritten": ["wp_plain"]}
    row = S.open_version(spark, target, "wp_pages").filter("id = 3").head()
    assert row.url == "https://old.example/sub/3"
    assert row.meta == 's:25:"https://old.example/sub/3";'
    assert S.open_version(spark, target, "wp_plain").head().t == "https://old.example"
    placed = S.read_entries(spark, f"{target}/v=1/entries")
    assert {r.rel: bytes(r.content) for r in placed.collect()} == {"a/x.bin": FILES["a/x.bin"], "empty": b""}


def test_a_failing_hook_leaves_the_published_version(spark, snapshot, tmp_path):
    target = str(tmp_path / "target")
    restore(spark, snapshot[0], target, include_files=False)

    def hook(tables):
        assert set(tables) == {"wp_pages", "wp_plain"}
        raise RuntimeError("refused")

    with pytest.raises(RuntimeError, match="refused"):
        restore(spark, snapshot[0], target, hook=hook)
    assert S.current_version(spark, target) == 1
    assert S.open_version(spark, target, "wp_pages").count() == 9
    restore(spark, snapshot[0], target)  # the failed attempt's folder is in nobody's way
    assert S.current_version(spark, target) == 3


def test_a_corrupt_file_stops_a_restore(spark, snapshot, tmp_path):
    path, target = snapshot[0], str(tmp_path / "target")
    broken = spark.createDataFrame(
        [("wp-content/bad", 3, 0, 0, 3, bytearray(b"abc"), 1, 1)],
        "rel string, size long, chunk_no int, start long, length long, content binary, crc long, share long",
    ).withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    S.write_entries(broken, f"{path}/entries")
    with pytest.raises(RuntimeError, match="checksum mismatch in wp-content/bad"):
        restore(spark, path, target)
    assert S.current_version(spark, target) == 0


def test_lost_rows_and_files_stop_a_restore(spark, tmp_path):
    path, target = str(tmp_path / "s"), str(tmp_path / "target")
    S.export_snapshot({"wp_pages": pages(spark).repartition(4), "other": spark.range(2)}, content(spark, FILES), path)
    manifest, tables = S.read_snapshot(spark, path)
    assert list(tables) == ["wp_pages"] and manifest.head().rows == {"wp_pages": 9} and manifest.head().files == 4
    entries = f"{path}/entries"
    kept = spark.read.parquet(entries).filter("rel NOT LIKE '%empty'")
    kept.write.partitionBy("type").parquet(f"{path}-fewer")
    os.rename(entries, f"{path}-all")
    os.rename(f"{path}-fewer", entries)
    with pytest.raises(RuntimeError, match="3 files"):
        restore(spark, path, target)
    part = next(p for p in sorted(os.listdir(f"{path}/tables/wp_pages")) if p.startswith("part-"))
    os.rename(f"{path}/tables/wp_pages/{part}", str(tmp_path / part))
    with pytest.raises(RuntimeError, match="9 in the snapshot"):
        restore(spark, path, target, include_files=False)
    assert S.current_version(spark, target) == 0


def test_gates(spark, tmp_path):
    def made(name, **facts):
        S.export_snapshot({"wp_p": pages(spark)}, None, str(tmp_path / name), identity=facts)
        return str(tmp_path / name)

    target = str(tmp_path / "target")
    with pytest.raises(ValueError, match="prefix mismatch"):
        restore(spark, made("a", tablePrefix="zz_"), target)
    with pytest.raises(ValueError, match="network"):
        restore(spark, made("b", multisite=True), target)
    with pytest.raises(ValueError, match="supported format"):
        restore(spark, made("c", formatVersion=2), target)
    with pytest.raises(ValueError, match="supported format"):
        S.read_snapshot(spark, made("d", format="other"))
    assert restore(spark, made("e", multisite=True), target, allow_multisite=True).head().tables == 0


# ---------------------------------------------------------------- rewriting tables


def test_dry_run_and_live_run(spark, tmp_path):
    options = spark.createDataFrame([(1, "see https://old.example"), (2, None)], "id long, value string")
    tables, keys = {"wp_options": options, "wp_keyless": options}, {"wp_options": ["id"]}
    pairs = [("https://old.example", "https://new.example")]
    for live in (False, True):
        report = rw.rewrite_database(tables, keys, pairs, not live, str(tmp_path / "out") if live else None)
        rows = {r.table_name: (r.tables, r.rows, r.changes, r.hits, r.skipped) for r in report.collect()}
        assert rows == {"wp_options": (1, 2, 1, 1, 0), "wp_keyless": (0, 0, 0, 0, 1), None: (1, 2, 1, 1, 1)}
        assert (tmp_path / "out").exists() == live
    written = spark.read.parquet(str(tmp_path / "out/wp_options")).orderBy("id").collect()
    assert [r.value for r in written] == ["see https://new.example", None]


def test_keys_and_unchanged_cells(spark):
    df = spark.createDataFrame([("ab", "ab", "x", 1)], "k string, v string, `odd.name` string, n int")
    row = rw.rewrite_table(df, ["k"], [("a", "b"), ("bb", "ab")]).head()
    assert row[:] == ("ab", "ab", "x", 1, 2, False)  # two hits, yet the same text


def test_keys_are_found_in_any_case_and_unknown_ones_refused(spark):
    df = spark.createDataFrame([("ab", "ab")], "Id string, v string")
    assert rw.rewrite_table(df, ["id"], [("a", "b")]).head()[:2] == ("ab", "bb")
    with pytest.raises(ValueError, match="no such key columns: nope"):
        rw.rewrite_table(df, ["nope"], [("a", "b")])


def test_helper_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "ab", "xab", "b", "c")], "id long, v string, _way_v string, __0_0 string, `_payload_0` string")
    row = rw.rewrite_table(df, ["id"], [("a", "A"), ("b", "B")], kinds=True).head()
    assert row[:] == (1, "AB", "xAB", "B", "c", 5, True, 0, 0)
    for taken in ("_hits", "_changed", "_opaque"):
        with pytest.raises(ValueError, match=taken):
            rw.rewrite_table(df.withColumn(taken, F.lit(1)), ["id"], [("a", "A")], kinds=True)
    assert rw.rewrite_table(df.withColumn("_opaque", F.lit("a")), ["id"], [("a", "A")]).head()["_opaque"] == "A"


def test_cells_left_alone_are_counted_and_listed(spark, tmp_path):
    cells = {
        1: 's:3:"old";', 2: 's:9:"old";', 3: 'a:2:{i:0;s:3:"old";i:1;O:1:"X":0:{}}', 4: "old", 5: None, 6: 'O:1:"X":1:{s:1:"a";s:1:"b";}', 7: "[" * 5000 + "old",
    }
    df = spark.createDataFrame([(k, v, v) for k, v in cells.items()], "id long, a string, `b.c` string")
    pairs = [("old", "new!")]
    listed = {(r.id, r.column_name): (r.kind, r.cell) for r in rw.left_alone(df, ["id"], pairs).collect()}
    assert listed == {(n, c): (kind, cells[n]) for n, kind in ((2, "malformed"), (3, "opaque")) for c in ("a", "b.c")}
    for dest in (None, str(tmp_path / "out")):
        report = rw.rewrite_database({"t": df, "u": spark.range(3)}, {"t": ["id"], "u": ["id"]}, pairs, dest is None, dest)
        rows = {r.table_name: (r.rows, r.changes, r.hits, r.opaque, r.malformed) for r in report.collect()}
        assert rows == {"t": (7, 4, 8, 2, 2), "u": (3, 0, 0, 0, 0), None: (10, 4, 8, 2, 2)}
    assert rw.left_alone(spark.range(2), ["id"], pairs).collect() == []
    written = {r.id: r.a for r in spark.read.parquet(str(tmp_path / "out/t")).collect()}
    assert written[1] == 's:4:"new!";' and written[2] == 's:9:"new!";' and written[3] == cells[3] and written[7].endswith("new!")


def test_a_repeated_change_is_refused(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    once = spark.createDataFrame([(1, None)], "id long, v string")
    assert sorted(rw.apply_changes(base, once, ["id"]).collect()) == [(1, None), (2, "b")]
    with pytest.raises(Exception, match="occurs twice"):
        rw.apply_changes(base, once.union(once), ["id"]).collect()


def test_pairs(spark):
    columns = [f"{side}_{f} string" for f in M.IDENTITY for side in ("source", "target")]
    df = spark.createDataFrame(
        [(1, "a", "b", "a", "c", "", "x", None, "y"), (2, "a", "a", "a", "c", "d", "e", "d", "f")],
        "site int, " + ", ".join(columns),
    )
    rows = [tuple(r) for r in M.replacement_pairs(df, "site").orderBy("site", "ord").collect()]
    assert rows == [(1, 0, "a", "b"), (2, 0, "a", "c"), (2, 1, "d", "e")]
    plain = S.identity_pairs({"home": "a", "siteurl": "a", "content": "d"}, {"home": "a", "siteurl": "c", "content": "e"})
    assert plain == [("a", "c"), ("d", "e")]


def test_usable_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "a int, b string")
    found = [rw.usable_keys(df, "t", k).head().usable for k in (["a"], ["a", "b"], [])]
    assert found == [False, False, False]
    assert rw.usable_keys(df.filter("b IS NOT NULL"), "t", ["a", "b"]).head().usable is True


def test_preflight_levels(spark):
    facts = spark.createDataFrame(
        [(1, "wp_", False, "8.1", 100, True), (2, "zz_", True, "8.10", 100, False), (3, None, None, None, 10, False)],
        "id int, tablePrefix string, multisite boolean, phpVersion string, archive_bytes long, compressed boolean",
    )
    rows = M.preflight(facts, M.Target(free_bytes=200, php_version="8.9"), "id").collect()
    assert {(r.id, r.label, r.level) for r in rows} == {
        (1, "Table prefix", "ok"), (1, "Disk space", "warn"), (2, "Table prefix", "error"),
        (2, "Multisite", "warn"), (2, "Disk space", "ok"), (2, "PHP version", "warn"),
        (3, "Table prefix", "ok"), (3, "Disk space", "ok"),
    }
    silent = M.preflight(facts.filter("id = 3"), M.Target(writable=False), "id").collect()
    assert [(r.label, r.level) for r in silent] == [("Table prefix", "ok"), ("Writable files", "error")]
