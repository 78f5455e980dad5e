import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stowage.sources import sqldump, statements
from stowage.sources.sqldump import (
    decode_inserts, insert_cap, read_sql_dumps, to_sql_inserts, write_sql_dump,
)
from stowage.sources.statements import ends_inside, read_statements

SCHEMA = "id long, note string, price double, at timestamp, ok boolean"
NASTY = ["", "NULL", "a'b", "''", "'", "\\", "\\'", "\\\\n", "\n", "\r\n", "\0", "\x1a", "\\0", "\\Z", '"',
         "); INSERT INTO `t` VALUES (1);", "-- x", "(1,2),(3", "zażółć 日本", "\\\0\\", "x\\'';'", "\t\b%_", None]


def nasty(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice([n for n in NASTY if n]) for _ in range(6)) for _ in range(150)]
    rows = [(n, t, n * 1.5, None, n % 2 == 0) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("at", F.timestamp_seconds(F.col("id") * 86400 + 0.25))


def same(left, right):
    return sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def test_cap():
    assert [insert_cap(n) for n in (0, 1000, 100_000, 1 << 30)] == [1048576, 65536, 90000, 1048576]


def test_statements_fit_the_packet(spark, tmp_path):
    df = spark.range(6000).select("id", F.repeat(F.lit("x"), 40).alias("s")).coalesce(1)
    for packet, most in ((0, 1 << 20), (100_000, 90_000), (10, 65_536)):
        write_sql_dump(df, "t", f"{tmp_path}/{packet}", packet=packet)
        sizes = [r[0] for r in spark.read.text(f"{tmp_path}/{packet}").select(F.octet_length("value")).collect()]
        assert max(sizes) <= most + 60 and len(sizes) == -(-sum(sizes) // most)


def test_packing(spark):
    df = spark.range(5000).select(F.col("id"), F.repeat(F.lit("é"), (F.col("id") % 90).cast("int")).alias("s"))
    cap = 2000
    rows = to_sql_inserts(df.repartition(3), "t", cap).collect()
    head = len(b"INSERT INTO `t` (`id`,`s`) VALUES ")
    for row in rows:
        size = len(row.sql.encode()) - 1  # the closing semicolon is not counted
        last = [r for r in rows if r.part == row.part][-1].stmt_no == row.stmt_no
        assert last or cap <= size < cap + 200 + 1
        assert size > head
    assert {(r.part, r.stmt_no) for r in rows} == {(r.part, r.stmt_no) for r in rows} and len(rows) > 50
    back = decode_inserts(spark.createDataFrame(rows), "t", df.schema)
    assert same(back, df)


def test_a_cap_below_one_row(spark):
    rows = to_sql_inserts(spark.range(7).coalesce(1), "t`x", 1).collect()
    assert [r.sql for r in rows][0] == "INSERT INTO `t``x` (`id`) VALUES ('0');" and len(rows) == 7


@pytest.mark.parametrize("layout", ["lines", "stream"])
@pytest.mark.parametrize("gzipped", [False, True])
def test_round_trip(spark, tmp_path, layout, gzipped):
    df = nasty(spark).repartition(3)
    write_sql_dump(df, "t", f"{tmp_path}/d", max_bytes=3000, gzipped=gzipped)
    write_sql_dump(df.select("id"), "t2", f"{tmp_path}/e")
    back = read_sql_dumps(spark, f"{tmp_path}/*/part-*", "t", SCHEMA, layout)
    assert same(back, df)


FOREIGN = """-- Dump made elsewhere
-- second line; with 2 marks

SET NAMES utf8mb4;;
CREATE TABLE `t` (
  `id` int, note text COMMENT 'a;b'
);
-- data
INSERT INTO `t` VALUES (1,'line one
INSERT INTO `t` VALUES (9,''no'');', 1.5, NULL, 1),
  (2, 'b\\'s; ''q''', -2e3, '2026-01-01 00:00:00', 0);
INSERT INTO `t` (`note`, `id`) VALUES ('swapped', 3);
INSERT INTO `tt` (`id`) VALUES (4);
SELECT 1"""


def test_other_layouts(spark, tmp_path):
    (tmp_path / "x.sql").write_text(FOREIGN)
    statements = [r.sql for r in read_statements(spark, f"{tmp_path}/*.sql").orderBy("start", "place").collect()]
    assert len(statements) == 6
    assert statements[0] == "with 2 marks\n\nSET NAMES utf8mb4"
    assert statements[-1] == "SELECT 1"
    rows = read_sql_dumps(spark, f"{tmp_path}/*.sql", "t", SCHEMA, "stream").orderBy("id").collect()
    assert [(r.id, r.note, r.price, r.ok) for r in rows] == [
        (1, "line one\nINSERT INTO `t` VALUES (9,'no');", 1.5, True),
        (2, "b's; 'q'", -2000.0, False),
        (3, "swapped", None, None),
    ]
    with pytest.raises(PySparkException, match="layout='stream'"):
        read_sql_dumps(spark, f"{tmp_path}/*.sql", "t", SCHEMA).collect()


def test_comment_only_text_is_no_statement(spark, tmp_path):
    (tmp_path / "x.sql").write_text("-- only\n  -- comments\n;\n ; SELECT 'a;b\\';' ;\n-- end")
    assert [r.sql for r in read_statements(spark, f"{tmp_path}/x.sql").collect()] == ["SELECT 'a;b\\';'"]


def test_long_statements_cross_read_chunks(spark, tmp_path):
    df = spark.range(40).select("id", F.repeat(F.lit("x;'"), 30_000).alias("s"))
    write_sql_dump(df.coalesce(1), "t", f"{tmp_path}/d", max_bytes=900_000)
    back = read_sql_dumps(spark, f"{tmp_path}/d/part-*", "t", df.schema, "stream")
    assert back.agg(F.count("*"), F.sum(F.length("s"))).head()[:] == (40, 40 * 90_000)


# ---------------------------------------------------------------- splits


def by_hand(text):
    """Statements of a text, byte by byte."""
    out, now, quoted, escaped = [], b"", False, False
    for byte in (text[i : i + 1] for i in range(len(text))):
        if byte == b";" and not quoted:
            out.append(now)
            now = b""
            continue
        now += byte
        if escaped:
            escaped = False
        elif quoted:
            quoted, escaped = byte != b"'", byte == b"\\"
        else:
            quoted = byte == b"'"
    return [s for s in (s.strip(b" \t\n\r\0\x0b") for s in [*out, now]) if s]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_at_split_ends():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab'\\\n") for _ in range(rng.randrange(12))).encode()
        for inside in (False, True):
            # Quotes are open behind the semicolon if what follows it is no statement of its own.
            after = by_hand((b"'" if inside else b"") + text + b";x")
            assert ends_inside(text, inside) == (after[-1] != b"x")


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(8)
    pieces = ["INSERT INTO t VALUES ", "(1,'a;b')", "\n", "'\\';'", "'it''s; so'", ";", ";", "x" * 300, "'" + ";y" * 400 + "'", "\\", "é"]
    files = {}
    for name in ("a.sql", "b.sql"):
        text = "".join(rng.choice(pieces) for _ in range(900))
        if text.replace("\\'", "").count("'") % 2:
            text += "'"
        files[name] = text.encode()
        (tmp_path / name).write_bytes(files[name])
    found = read_statements(spark, f"{tmp_path}/*.sql")
    for name, text in files.items():
        rows = found.filter(F.endswith("file", F.lit(name))).orderBy("start", "place").collect()
        assert [r.sql.encode() for r in rows] == [s for s in by_hand(text) if s]
        assert len({r.start for r in rows}) > 5


def test_a_dump_of_another_layout_in_parallel(spark, tmp_path, small_splits):
    df = nasty(spark).coalesce(1)
    write_sql_dump(df, "t", f"{tmp_path}/d", max_bytes=400)
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    (tmp_path / "x.sql").write_text("-- made elsewhere; -- in parts\n" + text.replace(";\nINSERT", ";  insert").replace("`) VALUES (", "`)\nVALUES\n("))
    assert read_statements(spark, f"{tmp_path}/x.sql").select("start").distinct().count() > 3
    assert same(read_sql_dumps(spark, f"{tmp_path}/x.sql", "t", SCHEMA, "stream"), df)
    one = spark.read.option("lineSep", ";").text(f"{tmp_path}/x.sql")
    assert one.rdd.getNumPartitions() > 3


def test_texts_without_statements(spark, tmp_path):
    (tmp_path / "x.sql").write_text("")
    (tmp_path / "y.sql").write_text(" ;\n;; -- no; SET x = 'a;b'")
    assert [r.sql for r in read_statements(spark, f"{tmp_path}/*.sql").collect()] == ["SET x = 'a;b'"]
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        read_statements(spark, f"{tmp_path}/none*.sql")


# ---------------------------------------------------------------- heads

HEADS = [
    "INSERT INTO `t` (`id`,`note`) VALUES ", "  insert into t (id, note) values", "INSERT IGNORE INTO `t`(`id`,`note`)VALUES",
    "REPLACE INTO `t` (`note`,`id`) VALUES ", "insert low_priority ignore into `t` (ID, Note) value ", "/* c; */ INSERT INTO db.t (`id`,`note`) VALUES ",
    "# c\nINSERT INTO `d``b` . `t` (\"id\", note) VALUES\n", "INSERT t VALUES ", "-- c\n\nReplace Delayed `t` VALUES", 'INSERT HIGH_PRIORITY INTO "t"\n(id,\n note)\nVALUES\n',
]


def test_heads(spark):
    rows, expected = [], set()
    for n, head in enumerate(HEADS):
        pair = f"('n;{n}', {n})" if "(`note`" in head else f"({n} , 'n;{n}')"
        again = f"(_utf8 'x', '{n + 100}')" if "(`note`" in head else f"('{n + 100}',N'x')"
        rows.append((head + pair + ",\n " + again + (" ;" if n % 2 else ""),))
        expected |= {(n, f"n;{n}"), (n + 100, "x")}
    rows += [("INSERT INTO tt (id, note) VALUES (1, 2)",), ("INSERT INTO tt SELECT 1",), ("CREATE TABLE t (id int)",), ("(SELECT 1)",), ("/*!40101 SET x */",), ("",)]
    got = decode_inserts(spark.createDataFrame(rows, "sql string"), "t", "id long, note string").collect()
    assert {tuple(r) for r in got} == expected and len(got) == 2 * len(HEADS)


@pytest.mark.parametrize(
    "sql",
    ["INSERT INTO t SET id = 1", "INSERT INTO t SELECT 1, 'a'", "INSERT INTO t (id, note) VALUES (1)", "INSERT INTO t (id) VALUES (1, 2)",
     "INSERT INTO t (id, note) VALUES (1, 'a') ON DUPLICATE KEY UPDATE id = VALUES(id)", "INSERT INTO t VALUES (now(), 'a')", "INSERT INTO",
     "INSERT INTO t VALUES (1, \"a\")", "INSERT INTO t VALUES (1, 'a'", "replace into 't' values (1, 2)", "elsewhere\nINSERT INTO t VALUES (1, 2)", "INSERTS t", "INSERT INTO t VALUES (1)"],
)
def test_what_cannot_be_read_is_an_error(spark, sql):
    with pytest.raises(PySparkException, match="not a statement|no list of tuples|number of values|no table is named"):
        decode_inserts(spark.createDataFrame([(sql,)], "sql string"), "t", "id long, note string").collect()


def test_bytes_and_nested_values(spark, tmp_path):
    rng = random.Random(3)
    rows = [(n, bytearray(rng.randbytes(n * 7)), "t") for n in range(40)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "id int, body binary, note string")
    for layout in ("lines", "stream"):
        write_sql_dump(df.repartition(2), "t", f"{tmp_path}/{layout}", max_bytes=500)
        back = read_sql_dumps(spark, f"{tmp_path}/{layout}/part-*", "t", df.schema, layout)
        assert sorted((r.id, r.body and bytes(r.body), r.note) for r in back.collect()) == sorted((a, b and bytes(b), c) for a, b, c in rows)
    other = [("INSERT INTO t VALUES (1, 0xfF00, x'6162'), (2, 'a''b', 0x63), (3, X'', _binary 'd')",)]
    got = decode_inserts(spark.createDataFrame(other, "sql string"), "t", df.schema).collect()
    assert [(r.id, bytes(r.body), r.note) for r in got] == [(1, b"\xff\x00", "ab"), (2, b"a'b", "c"), (3, b"", "d")]
    with pytest.raises(ValueError, match="column tags of type array<int>"):
        to_sql_inserts(spark.sql("SELECT array(1) AS tags"), "t")


def test_a_failed_task_leaves_no_statements(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).withColumn("v", F.when(F.col("id") == 900, F.raise_error(F.lit("dies"))).otherwise("x"))
    with pytest.raises(PySparkException, match="dies"):
        write_sql_dump(df, "t", f"{tmp_path}/d", max_bytes=100)
    assert not list(tmp_path.glob("d/part-*")) and not list(tmp_path.glob("d/_SUCCESS"))


def test_python_holds_few_statements_at_once(monkeypatch):
    monkeypatch.setattr(sqldump.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    rows = [bytes([97 + i]) * (1 << 20) for i in range(24)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([len(r) for r in rows], pa.int64())], ["row_text", "row_bytes"])
    packed = list(sqldump._pack(b"H ", 1 << 20)(iter([batch])))
    assert max(b.nbytes for b in packed) < 8 << 20
    assert [s for b in packed for s in b["sql"].to_pylist()] == [b"H " + r + b";" for r in rows]
    assert [n for b in packed for n in b["stmt_no"].to_pylist()] == list(range(24))
    columns = [pa.array(["f"] * 24), pa.array([0] * 24, pa.int64()), pa.array([False] * 24), pa.array([0] * 24, pa.int64()), pa.array(rows, pa.binary())]
    joined = list(statements._join_up(iter([pa.RecordBatch.from_arrays(columns, ["file", "start", "inside", "owner", "text"])])))
    assert max(b.nbytes for b in joined) < 8 << 20
    assert [s for b in joined for s in b["sql"].to_pylist()] == rows
