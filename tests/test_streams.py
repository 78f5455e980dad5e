import hashlib
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stowage.plans.registry import QUERIES, UPLOAD_CHUNK
from stowage.streaming import streams as S


def put(spark, folder, start, count, name):
    df = spark.range(start, start + count).select("id", F.concat(F.lit("https://old/"), "id").alias("url"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


SCHEMA = "id long, url string"


def test_export_goes_on_after_a_dead_slice(spark, tmp_path):
    src, dest, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for n in range(4):
        put(spark, src, n * 10, 10, f"f{n}")

    def run():
        S.stream_export(spark, f"{src}/*", dest, checkpoint, SCHEMA, max_files=1).awaitTermination()

    run()
    batches = sorted(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    assert len(batches) == 4  # one file per slice
    # The last slice was written, but its end was not recorded; another died while it was writing.
    os.remove(f"{checkpoint}/commits/{batches[-1]}")
    crc = f"{checkpoint}/commits/.{batches[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    spark.range(5).select("id", F.lit("torn").alias("url")).coalesce(1).write.parquet(str(tmp_path / "torn"))
    torn = next(n for n in os.listdir(tmp_path / "torn") if n.startswith("part-"))
    os.link(tmp_path / "torn" / torn, f"{dest}/{torn}")
    put(spark, src, 40, 10, "f4")
    run()
    rows = spark.read.parquet(dest)
    assert rows.count() == 50 and rows.select("id").distinct().count() == 50
    assert rows.filter("url = 'torn'").isEmpty()


def test_rewrite_of_a_stream(spark, tmp_path):
    src, dest = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        put(spark, src, n * 10, 10, f"f{n}")
    stream = S.stream_rewrite(S.file_stream(spark, f"{src}/*", SCHEMA, 2), ["id"], [("old", "new")])
    S.write_stream(stream, dest, str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(dest).collect()
    assert {r.url for r in rows} == {f"https://new/{n}" for n in range(30)}
    assert all(r._changed and r._hits == 1 for r in rows)


def test_assembly_in_any_order(spark):
    rng = random.Random(4)
    bodies = {f"u{n}": [f"<{n}.{i}>" * rng.randint(0, 3) for i in range(rng.randint(1, 50))] for n in range(8)}
    rows = [(u, i, b) for u, parts in bodies.items() for i, b in enumerate(parts)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "upload_id string, idx int, body string")
    got = {}
    for r in S.assemble(chunks).orderBy("segment").collect():
        assert r.chunks <= S.SEGMENT_CHUNKS
        got[r.upload_id] = got.get(r.upload_id, "") + r.body
    assert got == {u: "".join(parts) for u, parts in bodies.items()}


def test_index_zero_starts_over(spark):
    rows = [
        ("a", 0, 1, "old0"), ("a", 1, 2, "old1"), ("a", 2, 3, "old2"),
        ("a", 0, 4, "new0"), ("a", 1, 5, "new1"), ("a", 1, 6, "again1"), ("b", 1, 1, "x"), ("b", 2, 2, "y"),
    ]
    chunks = spark.createDataFrame(rows, "upload_id string, idx int, arrival long, body string")
    got = {r.upload_id: (r.chunks, r.body) for r in S.assemble(chunks, "arrival").collect()}
    assert got == {"a": (2, "new0again1"), "b": (2, "xy")}


def test_uploads_say_whether_they_are_complete(spark):
    parts = {"whole": [b"\xff\x00", b"", b"\xc3"], "gap": [b"a", None, b"\x80"], "cut": [b"x", b"y", None, None, None], "over": [b"o"]}
    rows = [(u, i, len(p), i, bytearray(b)) for u, p in parts.items() for i, b in enumerate(p) if b is not None]
    rows += [("over", 5, 1, 9, bytearray(b"beyond")), ("gap", 0, 9, -1, bytearray(b"void")), ("gap", 1, 9, -2, bytearray(b"void"))]
    chunks = spark.createDataFrame(rows, "upload_id string, idx int, total int, arrival long, body binary")
    got = {(r.upload_id, r.segment): (r.chunks, r.complete, bytes(r.body)) for r in S.assemble(chunks, "arrival", 2, "total").collect()}
    assert got == {
        ("whole", 0): (2, True, b"\xff\x00"), ("whole", 1): (1, True, b"\xc3"), ("gap", 0): (1, False, b"a"),
        ("gap", 1): (1, True, b"\x80"), ("cut", 0): (2, True, b"xy"), ("over", 0): (1, True, b"o"),
    }
    status = {r.upload_id: (r.chunks, r.total, r.complete) for r in S.upload_status(chunks, "total", "arrival").collect()}
    assert status == {"whole": (3, 3, True), "gap": (2, 3, False), "cut": (2, 5, False), "over": (1, 1, True)}


def stream_uploads(spark, tmp_path, body_type, batches, ttl_ms=3_600_000):
    """All segments that a stream puts out, restarted for each batch."""
    schema = f"upload_id string, idx int, total int, attempt long, arrival long, body {body_type}"
    src, dest, own = str(tmp_path / "in"), str(tmp_path / "out"), S.stateful_session(spark)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f{n}")
        stream = S.assemble_stream(S.file_stream(own, f"{src}/*", schema), 2, ttl_ms)
        S.write_stream(stream, dest, str(tmp_path / "c")).awaitTermination()
    return sorted((r.upload_id, r.segment, r.attempt, r.chunks, r.body) for r in spark.read.parquet(dest).collect())


def test_assembly_on_a_stream(spark, tmp_path):
    batches = [
        [("a", 2, 5, 1, 1, "a2"), ("a", 0, 5, 1, 2, "a0"), ("b", 0, 2, 1, 1, "stale"), ("c", 0, 2, 1, 1, "c0")],
        [("a", 1, 5, 1, 3, "a1"), ("b", 0, 1, 2, 2, "b0"), ("a", 4, 5, 1, 4, "first"), ("a", 4, 5, 1, 5, "a4")],
        [("a", 3, 5, 1, 6, "a3"), ("b", 1, 2, 1, 3, "late")],
    ]
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled"), spark.conf.get(S.STATE_STORE)
    assert stream_uploads(spark, tmp_path, "string", batches) == [
        ("a", 0, 1, 2, "a0a1"), ("a", 1, 1, 2, "a2a3"), ("a", 2, 1, 1, "a4"), ("b", 0, 2, 1, "b0"),
    ]
    assert before == (spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled"), spark.conf.get(S.STATE_STORE))


def test_what_is_sent_again_after_the_end_puts_out_nothing(spark, tmp_path):
    a, b = bytearray(b"\xff\xfe"), bytearray(b"\x00\x80")
    batches = [
        [("u", 0, 2, 3, 1, a), ("u", 1, 2, 3, 2, b), ("beyond", 4, 2, 1, 1, a)],
        [("u", 0, 2, 3, 3, a), ("u", 1, 2, 3, 4, b)],  # the same attempt once more
        [("u", 0, 2, 1, 5, b), ("u", 1, 2, 2, 6, b)],  # older ones that come late
        [("u", 1, 2, 4, 7, b)],  # a newer one, in two batches
        [("u", 0, 2, 4, 8, b)],
    ]
    assert stream_uploads(spark, tmp_path, "binary", batches) == [
        ("u", 0, 3, 2, bytes(a + b)), ("u", 0, 4, 2, bytes(b + b)),
    ]


def test_abandoned_chunks_expire(spark, tmp_path):
    import time

    class Later(list):
        def __iter__(self):
            for n, rows in enumerate(list.__iter__(self)):
                time.sleep(2 * n)
                yield rows

    batches = Later([[("u", 0, 2, 1, 1, "old")], [("u", 1, 2, 1, 2, "new")]])
    assert stream_uploads(spark, tmp_path, "string", batches, ttl_ms=1000) == []


def test_digests_of_uploads_whose_segments_are_all_out(spark, tmp_path):
    a, none = [bytearray(bytes([i, 255])) for i in range(5)], None
    up = lambda name, bodies, total, attempt, start=0: [(name, start + i, total, attempt, i, b) for i, b in enumerate(bodies)]
    batches = [
        up("large", a[3:], 5, 1, 3) + up("small", a[:2], 2, 1) + up("gap", a[1:], 5, 1, 1) + up("empty", [none], 1, 1),
        up("large", a[:3], 5, 1) + up("void", [a[0], none, a[2]], 3, 1),
        up("large", a[:4], 4, 2) + up("large", a[4:], 5, 1, 4),  # a newer attempt with fewer segments
    ]
    stream_uploads(spark, tmp_path, "binary", batches)
    segments = spark.read.parquet(str(tmp_path / "out"))
    got = lambda df: sorted(tuple(r) for r in S.upload_digests(df).collect())
    md5 = lambda bodies: hashlib.md5(b"".join(bodies)).hexdigest()
    want = [("empty", 1, 1, None), ("large", 1, 5, md5(a)), ("large", 2, 4, md5(a[:4])), ("small", 1, 2, md5(a[:2])), ("void", 1, 3, md5(a[:3:2]))]
    assert got(segments) == want
    assert got(segments.unionByName(segments.filter("chunks < total"))) == want  # a segment put out once more


def test_uploads_of_several_segments_are_put_out(spark, tmp_path):
    """Texts of more than one segment, one of them without its second chunk, one cut within characters, one that is missing."""
    size = S.SEGMENT_CHUNKS * UPLOAD_CHUNK
    texts = {1: "x" * size, 2: "y" * size + "z", 3: "é€" * size, 7: "gap" * size, 8: "w" * (4 * size), 9: "", 10: None, 14: "short"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.upload_id: (r.chunks, r.md5) for r in QUERIES["t2_binary_uploads_stream"](spark, str(tmp_path)).collect()}
    content = {k: None if t is None else t.encode() for k, t in texts.items() if k != 7}
    assert got == {
        k: (max(1, -(-len(c or b"") // UPLOAD_CHUNK)), None if c is None else hashlib.md5(c).hexdigest()) for k, c in content.items()
    }


def test_state_needs_a_session_of_its_own(spark):
    chunks = spark.createDataFrame([], "upload_id string, idx int, total int, attempt long, arrival long, body string")
    with pytest.raises(ValueError, match="stateful_session"):
        S.assemble_stream(chunks)


def test_progress(spark):
    log = spark.createDataFrame(
        [("a", 1, 3, "running"), ("a", 2, 3, "running"), ("b", 3, 3, "running"), ("b", 3, 3, "done"),
         ("c", 0, 0, "running")], "job string, idx long, total long, status string",
    )
    rows = {r.job: (r.status, r.idx, r.percent, r.done) for r in S.progress(log).collect()}
    assert rows == {"a": ("running", 2, 66, False), "b": ("done", 3, 100, True), "c": ("running", 0, 0, False)}


class Entries:
    """A map and a value of the state store that count the calls for chunks."""

    def __init__(self):
        self.held, self.mark, self.calls = {}, None, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(get=lambda: self.mark, update=lambda value: setattr(self, "mark", value))

    def __getattr__(self, name):
        self.calls += 1
        return {
            "keys": lambda: list(self.held), "iterator": lambda: list(self.held.items()), "getValue": self.held.get,
            "updateValue": self.held.__setitem__, "clear": self.held.clear, "containsKey": self.held.__contains__,
        }[name]


def test_segments_that_come_at_once_need_no_entries():
    row = lambda idx, arrival, body, attempt=1, total=2: (7, 0, idx, total, attempt, arrival, body)
    state, assembler = Entries(), S.SegmentAssembler(16, 1000, True)
    assembler.init(state)
    run = lambda *rows: [r.body for r in assembler.handleInputRows((7, 0), iter(rows), None)]
    assert run(row(1, 1, b"old"), row(0, 2, b"a"), row(1, 3, b"b")) == [b"ab"] and state.calls == 0
    assert run(row(0, 9, b"again"), row(1, 9, b"late", 0)) == [] and state.calls == 0
    # what comes in parts is kept, an older copy changes nothing, and a newer attempt voids it
    assert run(row(0, 5, b"c", 2)) == [] and state.held == {(0,): (5, b"c")}
    assert run(row(0, 4, b"older", 2)) == [] and state.held == {(0,): (5, b"c")}
    assert run(row(1, 1, b"d", 2)) == [b"cd"] and not state.held
    assert run(row(0, 1, b"e", 3)) == [] and run(row(1, 1, b"f", 4)) == [] and state.held == {(1,): (1, b"f")}
