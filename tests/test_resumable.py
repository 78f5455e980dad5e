"""An export in slices: stopped, killed and gone on with."""

import pytest
from pyspark.sql import functions as F

from stowage.operators.relational import ExportOptions
from stowage.plans import snapshot as S
from stowage.streaming.export import ResumableExport

FILES = {f"up/{n:02}.bin": bytes([n]) * (n * 100) for n in range(9)} | {"empty": b"", ".git/x": b"no", "cache/c": b"no"}
KEPT = {f"wp-content/{rel}": body for rel, body in FILES.items() if not rel.startswith((".git", "cache"))}
OPTIONS = ExportOptions.from_dict({"no_cache": 1, "no_post_revisions": 1})


def posts(spark):
    return spark.range(6).select("id", F.when(F.col("id") == 3, "revision").otherwise("post").alias("post_type"))


def stored(spark, dest):
    rows = S.read_entries(spark, f"{dest}/entries").collect()
    assert len({r.rel for r in rows}) == len(rows)
    return {r.rel: bytes(r.content) for r in rows}


@pytest.fixture
def site(tmp_path):
    for rel, body in FILES.items():
        path = tmp_path / "site" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return tmp_path / "site"


def job(spark, tmp_path, site, **more):
    tables = {"wp_posts": posts(spark), "other": posts(spark)}
    return ResumableExport(spark, str(tmp_path / "out"), tables, folder=str(site), options=OPTIONS, slice_files=2, **more)


def test_a_folder_in_slices(spark, tmp_path, site):
    dest = str(tmp_path / "out")
    state = job(spark, tmp_path, site).run(max_slices=1).head()
    assert (state.status, state.slices, state.tables, state.listed) == ("running", 1, 1, 10) and 0 < state.done <= 2
    assert S.if_present(lambda: spark.read.text(f"{dest}/manifest")) is None
    before = stored(spark, dest)
    with pytest.raises(ValueError, match="manifest"):
        S.restore_snapshot(spark, dest, str(tmp_path / "t"), {}, {})

    # The next slice dies after it has written half of its files; one listed file is deleted meanwhile.
    def die(number):
        torn = spark.createDataFrame([("wp-content/torn", 0, bytearray(b"x"))], "rel string, chunk_no int, content binary")
        torn.write.mode("overwrite").parquet(f"{dest}/entries/type=file/slice={number}")
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        job(spark, tmp_path, site, before_slice=die).run()
    assert job(spark, tmp_path, site).state().head().slices == 1
    gone = next(rel for rel in sorted(KEPT, reverse=True) if rel not in before)
    (site / gone.removeprefix("wp-content/")).unlink()
    seen = []
    state = job(spark, tmp_path, site, before_slice=seen.append).run().head()
    assert state.status == "done" and state.done == state.listed == 10 and 1 in seen and 0 not in seen
    expected = {rel: body for rel, body in KEPT.items() if rel != gone}
    assert stored(spark, dest) == expected
    assert (state.files, state.bytes) == (9, sum(map(len, expected.values())))
    assert {r.status for r in S.verify_entries(spark, f"{dest}/entries").collect()} == {"ok"}

    # The result is a snapshot like any other, and a finished job has nothing left to do.
    assert job(spark, tmp_path, site, before_slice=die).run().head() == state
    manifest, tables = S.read_snapshot(spark, dest)
    facts = manifest.head()
    assert list(tables) == ["wp_posts"] and facts.rows == {"wp_posts": 5} and facts.files == 9
    assert S.restore_snapshot(spark, dest, str(tmp_path / "t"), {}, {}).head()[:4] == (0, 5, 0, 9)


def test_a_content_table_in_slices(spark, tmp_path):
    dest, source = str(tmp_path / "out"), str(tmp_path / "content")
    rows = [(rel, bytearray(body)) for rel, body in FILES.items()]
    files = spark.createDataFrame(rows, "rel string, content binary").withColumn("mtime", F.timestamp_seconds(F.lit(7)))
    files.repartition(6, "rel").write.parquet(source)

    def made():
        return ResumableExport(spark, dest, {}, content=source, options=OPTIONS, slice_parts=1)

    steps = 0
    # By number of slices, and by time: a budget that is used up allows one slice.
    while made().run(**({"max_slices": 1} if steps % 2 else {"budget_s": 0.0})).head().status == "running":
        steps += 1
        assert steps < 20
    assert steps >= 3 and stored(spark, dest) == KEPT
    assert S.read_snapshot(spark, dest)[0].head().files == len(KEPT)


def test_an_export_without_files(spark, tmp_path):
    done = ResumableExport(spark, str(tmp_path / "out"), {"wp_posts": posts(spark)}).run().head()
    assert (done.status, done.tables, done.files) == ("done", 1, 0)
    with pytest.raises(ValueError, match="not both"):
        ResumableExport(spark, str(tmp_path / "x"), {}, folder="a", content="b")
