"""Packed archives: headers by type, and the stored index."""

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.sources.archive import SIGNATURE, ArchiveIndex, archive_catalog, entry_headers, matching


def entry(header, body):
    raw = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack(">I", len(raw)) + raw + body


def packed(files, kind="file"):
    parts = [entry({"p": p, "s": len(b), "m": 3, "t": kind, "c": f"{zlib.crc32(b):08x}"}, b) for p, b in files.items()]
    return SIGNATURE + b"".join(parts) + struct.pack(">I", 0)


@pytest.mark.parametrize("cut", ["header", "length", "none"])
def test_archive_headers(tmp_path, cut):
    full = SIGNATURE + entry({"p": "m.json", "s": 2, "m": 5, "t": "manifest", "c": "00ff00ff"}, b"{}")
    full += entry({"p": "x", "s": 3}, b"abc") + entry(b"not json", b"")
    tail = {"header": entry({"p": "y", "s": 9}, b"")[:9], "length": b"\0\0", "none": b"\0\0\0\0rest"}[cut]
    path = tmp_path / "a.bin"
    path.write_bytes(full + tail)
    rows = list(entry_headers(str(path)))[:3]
    assert [r[1:7] for r in rows] == [
        (0, "m.json", 2, 5, "manifest", "00ff00ff"), (1, "x", 3, 0, "file", None), (2, "", 0, 0, "file", None),
    ]
    assert [(full + tail)[r[7] : r[7] + r[3]] for r in rows] == [b"{}", b"abc", b""]
    assert [r[2] for r in entry_headers(f"file://{path}", ["manifest"])] == ["m.json"]
    (tmp_path / "bad").write_bytes(b"XXXXX")
    with pytest.raises(ValueError):
        list(entry_headers(str(tmp_path / "bad")))


@pytest.fixture
def archives(tmp_path):
    bodies = {f"{n}.part": {f"f{n}/{i}": bytes([i]) * (i * 400) for i in range(5)} for n in range(3)}
    for name, files in bodies.items():
        (tmp_path / name).write_bytes(packed(files))
    (tmp_path / "tables.part").write_bytes(packed({"t.sql": b"INSERT"}, "table"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/x.part").write_bytes(packed({"deep": b"d"}))
    return tmp_path, bodies


def test_patterns(archives):
    root, _ = archives
    names = lambda pattern: [os.path.relpath(p, root) for p, _, _ in matching(pattern)]
    assert names(f"{root}/*.part") == ["0.part", "1.part", "2.part", "tables.part"]
    assert names(f"{root}/[01].part") == ["0.part", "1.part"] and names(f"{root}/*/*.part") == ["deep/x.part"]
    assert names(f"{root}/0.part") == ["0.part"] and names(f"{root}/none") == names(f"{root}/none/*") == []
    assert matching(f"file://{root}/0.part")[0][0] == f"file://{root}/0.part"


def test_types_reach_the_reader(spark, archives):
    root, _ = archives
    catalog = archive_catalog(spark, f"{root}/*.part")
    assert catalog.count() == 16 and catalog.filter("type = 'table'").count() == 1 and catalog.count() == 16
    tables = archive_catalog(spark, f"{root}/*.part", ["table", "other"])
    assert [r.path for r in tables.collect()] == ["t.sql"]
    assert archive_catalog(spark, f"{root}/*.part", []).count() == 0
    with pytest.raises(Exception, match="no archive matches"):
        archive_catalog(spark, f"{root}/*.none").count()


def test_index(spark, archives):
    root, bodies = archives
    index, pattern = ArchiveIndex(spark, f"{root}/index"), f"{root}/*.part"
    assert index.entries().count() == 0
    assert index.refresh(pattern) == 4 and index.entries().count() == 16
    assert index.refresh(pattern) == 0 and index.entries().count() == 16
    (root / "1.part").write_bytes(packed({"new": b"1234"}))
    os.unlink(root / "2.part")
    assert index.refresh(pattern) == 1 and index.generation() == 3
    expected = bodies["0.part"] | {"new": b"1234", "t.sql": b"INSERT"}
    pieces = index.contents(chunk=300).orderBy("path", "chunk_no").collect()
    got = {p: b"".join(bytes(r.content) for r in pieces if r.path == p) for p in expected}
    assert got == expected and max(len(r.content) for r in pieces) == 300
    assert [bytes(r.content) for r in index.contents(F.col("type") == "table").collect()] == [b"INSERT"]
    assert {r.status for r in index.verify().collect()} == {"ok"}
    raw = bytearray((root / "0.part").read_bytes())
    place = index.entries().filter("path = 'f0/4'").head().offset
    raw[place + 7] ^= 1
    (root / "0.part").write_bytes(raw)
    assert {r.path: r.status for r in index.verify().collect() if r.status != "ok"} == {"f0/4": "corrupt"}
