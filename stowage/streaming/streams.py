"""Restartable streams: export in slices, rewriting, upload assembly and job progress."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stowage.functions.columns import percent_done
from stowage.operators.rewrite import rewrite_table
from stowage.plans.snapshot import joined_bytes
from stowage.session import configure

# Fixed value: files taken per slice.
FILES_PER_SLICE = 1500

# Chunks put together into one cell. Uploads arrive in slices of 4 MiB, so a cell stays at 64 MiB.
SEGMENT_CHUNKS = 16

# Digests of uploads that Python hands on at once.
DIGESTS = 1000

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _drain(stream: DataFrame, dest: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Process everything at hand in bounded batches; the file sink's log makes it exactly-once."""
    return (
        stream.writeStream.format("parquet")
        .options(**options)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(dest)
    )


def file_stream(
    spark: SparkSession, src: str, schema: T.StructType | str, max_files: int = FILES_PER_SLICE
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)


def stream_export(
    spark: SparkSession,
    src: str,
    dest: str,
    checkpoint: str,
    schema: T.StructType | str,
    max_files: int = FILES_PER_SLICE,
) -> StreamingQuery:
    """Copy a folder of files in slices. Started again on the same checkpoint, it goes on where the
    last finished slice ended; what a dead slice left behind is not part of the result."""
    return _drain(file_stream(spark, src, schema, max_files), dest, checkpoint)


def stream_rewrite(
    stream: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """The table rewrite on unbounded input; it keeps no state."""
    return rewrite_table(stream, keys, pairs)


def write_stream(stream: DataFrame, dest: str, checkpoint: str, **options: str) -> StreamingQuery:
    """``options`` are those of the Parquet writer."""
    return _drain(stream, dest, checkpoint, **options)


# ---------------------------------------------------------------- uploads


def _segment(index: Column, segment_chunks: int) -> Column:
    return F.floor(index / segment_chunks).cast("int")


def _joined(body_type: T.DataType) -> Column:
    """The bodies of ``pieces`` in order, as bytes or as text."""
    if isinstance(body_type, T.BinaryType):
        return joined_bytes("pieces", "body")
    return F.array_join(F.transform("pieces", lambda p: p["body"]), "")


def assemble(
    chunks: DataFrame,
    arrival: str | None = None,
    segment_chunks: int = SEGMENT_CHUNKS,
    total: str | None = None,
) -> DataFrame:
    """Chunks ``(upload_id, idx, body)`` to ``(upload_id, segment, chunks, body)``, in index order.

    Bodies are text or bytes, and stay what they are. An upload of up to ``segment_chunks`` chunks is one row. A larger one
    is several, so that no task holds more than one segment of it, however large one upload grows. With an ``arrival``
    column, index 0 starts an upload over: what came before it is void, and of a chunk sent
    repeatedly the last one counts. Without it, each index must occur once.

    ``total`` names a column with the number of chunks an upload should have. The result then says whether a segment is
    ``complete``; the body of one with a gap is what there is. See ``upload_status`` for segments of which nothing came.
    """
    valid = _valid(chunks, arrival, segment_chunks, total)
    extra = [] if total is None else [F.max("total").alias("total")]
    pieces = F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("pieces")
    whole = valid.groupBy("upload_id", "segment").agg(F.count("*").alias("chunks"), pieces, *extra)
    body = _joined(chunks.schema["body"].dataType).alias("body")
    if total is None:
        return whole.select("upload_id", "segment", "chunks", body)
    due = F.least(F.lit(segment_chunks), F.col("total") - F.col("segment") * segment_chunks)
    return whole.select("upload_id", "segment", "chunks", (F.col("chunks") == due).alias("complete"), body)


def upload_status(chunks: DataFrame, total: str, arrival: str | None = None) -> DataFrame:
    """``(upload_id, chunks, total, complete)`` per upload, without touching bodies beyond choosing the last sent."""
    valid = _valid(chunks.withColumn("body", F.lit(None).cast("binary")), arrival, SEGMENT_CHUNKS, total)
    counted = valid.groupBy("upload_id").agg(F.count("*").alias("chunks"), F.max("total").cast("long").alias("total"))
    return counted.withColumn("complete", F.col("chunks") == F.col("total"))


def _valid(chunks: DataFrame, arrival: str | None, segment_chunks: int, total: str | None) -> DataFrame:
    """Chunks with their segment, each index once; those that lie outside of the total are left out."""
    segment = _segment(F.col("idx"), segment_chunks).alias("segment")
    kept = ["idx", "body"] if total is None else ["idx", "body", F.col(total).alias("total")]
    kept += [] if arrival is None else [F.col(arrival).alias("arrival")]
    valid = chunks.select("upload_id", segment, *kept)
    if arrival is not None:
        valid = _last_sent(valid, "arrival", [] if total is None else ["total"])
    return valid if total is None else valid.filter("idx >= 0 AND idx < total")


def _last_sent(chunks: DataFrame, arrival: str, also: Sequence[str] = ()) -> DataFrame:
    """Each chunk as it was sent last, unless its upload was started over since.

    Repeated chunks are combined before their shuffle. The start of an upload is handed to its
    segments first, so that chunks are joined by upload and segment: by upload alone, all of a large
    upload would meet in one task, and stay there for the grouping that follows.
    """
    last = chunks.groupBy("upload_id", "segment", "idx").agg(
        *[F.max_by(c, arrival).alias(c) for c in ("body", *also)], F.max(arrival).alias("_at")
    )
    starts = chunks.filter(F.col("idx") == 0).groupBy("upload_id").agg(F.max(arrival).alias("_start"))
    segments = chunks.select("upload_id", "segment").distinct().join(starts, "upload_id")
    return last.join(segments, ["upload_id", "segment"], "left").filter(
        F.col("_start").isNull() | (F.col("_at") >= F.col("_start"))
    )


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams that keep state; the settings of ``spark`` stay as they are.

    Without batches that bring no data, a run over what is at hand ends; expired state goes in the next batch that brings some.
    """
    own = configure(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


class SegmentAssembler(StatefulProcessor):
    """Holds the chunks of one segment until all are there, one state entry per chunk.

    A newer attempt voids the chunks of older ones. When a segment has been put out, its chunks go and a mark stays, so that
    what is sent again, or comes late, puts out nothing. Chunks and marks expire ``ttl_ms`` after they were written.
    A segment whose chunks come together is put out without a state entry for any of them: each entry costs a call to the store.
    """

    def __init__(self, segment_chunks: int, ttl_ms: int, binary: bool):
        self.segment_chunks, self.ttl_ms, self.binary = segment_chunks, ttl_ms, binary

    def init(self, handle: StatefulProcessorHandle) -> None:
        body = "binary" if self.binary else "string"
        self.chunks = handle.getMapState("chunks", "idx int", f"arrival long, body {body}", self.ttl_ms)
        self.about = handle.getValueState("about", "attempt long, ended boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        upload_id, segment = key
        known = self.about.get()
        attempt, ended = known if known is not None else (-1, False)
        stored = known is not None and not ended
        due, total, fresh = None, None, {}
        for _, _, idx, of, sent, arrival, body in rows:
            if sent < attempt or (sent == attempt and ended) or not 0 <= idx < of:
                continue
            if sent > attempt:
                attempt, ended, fresh = sent, False, {}
                if stored:
                    self.chunks.clear()
                    stored = False
            due, total = min(self.segment_chunks, of - segment * self.segment_chunks), of
            if idx not in fresh or arrival >= fresh[idx][0]:
                fresh[idx] = (arrival, body)
        if due is None:
            return
        places = {place for (place,) in self.chunks.keys()} if stored else set()
        for idx in places.intersection(fresh):
            if self.chunks.getValue((idx,))[0] > fresh[idx][0]:
                del fresh[idx]
        if len(places.union(fresh)) == due:
            held = {place: tuple(v) for (place,), v in self.chunks.iterator()} if stored else {}
            pieces = [body for _, (_, body) in sorted((held | fresh).items(), key=lambda piece: piece[0]) if body is not None]
            if stored:
                self.chunks.clear()
            ended = True
            whole = None if not pieces else b"".join(map(bytes, pieces)) if self.binary else "".join(pieces)
            yield Row(upload_id=upload_id, segment=segment, attempt=attempt, total=total, chunks=due, body=whole)
        else:
            for idx, chunk in fresh.items():
                self.chunks.updateValue((idx,), chunk)
        self.about.update((attempt, ended))

    def close(self) -> None:
        pass


def assemble_stream(
    chunks: DataFrame, segment_chunks: int = SEGMENT_CHUNKS, ttl_ms: int = 24 * 3600 * 1000
) -> DataFrame:
    """Chunks ``(upload_id, idx, total, attempt, arrival, body)`` to whole segments, each once, as they fill.

    ``chunks`` must come from a ``stateful_session``. State is kept per segment, so a single large upload spreads over many
    tasks, and a chunk that arrives writes its own entry only. Bodies are text or bytes, and stay what they are; a chunk without one counts and adds
    nothing, and a segment has none if no chunk has one. Chunks outside of an upload's total are left out. An upload is whole when its
    segments that are out hold ``total`` chunks; see ``upload_digests``.
    """
    if not chunks.sparkSession.conf.get(STATE_STORE).endswith("RocksDBStateStoreProvider"):
        raise ValueError("the stream must be read in a session made by stateful_session")
    segment = _segment(F.col("idx"), segment_chunks).alias("segment")
    types = {name: chunks.schema[name].dataType for name in ("upload_id", "total", "body")}
    named = {name: kind.simpleString() for name, kind in types.items()}
    return (
        chunks.select("upload_id", segment, "idx", "total", "attempt", "arrival", "body")
        .groupBy("upload_id", "segment")
        .transformWithState(
            SegmentAssembler(segment_chunks, ttl_ms, isinstance(types["body"], T.BinaryType)),
            f"upload_id {named['upload_id']}, segment int, attempt long, total {named['total']}, chunks long, body {named['body']}",
            "Append",
            "ProcessingTime",
        )
    )


def upload_digests(segments: DataFrame) -> DataFrame:
    """``(upload_id, attempt, chunks, md5)`` of each upload that is whole, from all the segments that ``assemble_stream`` has put out.

    An upload of one segment is hashed where it is. A larger one's segments are dealt out by upload and sorted, as MD5 goes through the
    bytes in order; a task takes one after the other and never holds an upload. Attempts are told apart.
    """
    one = segments.filter("chunks = total").select("upload_id", "attempt", "chunks", F.md5(F.col("body").cast("binary")).alias("md5"))
    parts = segments.filter("chunks < total").select(
        "upload_id", "attempt", "segment", "total", "chunks", F.col("body").cast("binary").alias("body")
    )
    ordered = parts.repartition("upload_id").sortWithinPartitions("upload_id", "attempt", "segment")
    return one.unionByName(ordered.mapInArrow(_digests, one.schema))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each upload whose segments, in order, hold all its chunks; a segment that is there again counts once."""
    if (first := next(batches, None)) is None:
        return
    schema = pa.schema([first.schema.field("upload_id"), ("attempt", pa.int64()), ("chunks", pa.int64()), ("md5", pa.string())])
    rows = (row for batch in itertools.chain([first], batches) for row in zip(*batch.to_pydict().values(), strict=True))

    def whole():
        for (upload_id, attempt), parts in itertools.groupby(rows, key=lambda row: row[:2]):
            md5, chunks, totals, last = None, 0, set(), None
            for _, _, segment, total, held, body in parts:
                if segment == last:
                    continue
                chunks, last = chunks + held, segment
                totals.add(total)
                if body is not None:
                    md5 = md5 or hashlib.md5(usedforsecurity=False)
                    md5.update(body)
            if totals == {chunks}:
                yield {"upload_id": upload_id, "attempt": attempt, "chunks": chunks, "md5": md5 and md5.hexdigest()}

    for some in itertools.batched(whole(), DIGESTS):
        yield pa.RecordBatch.from_pylist(list(some), schema=schema)


# ---------------------------------------------------------------- progress


def progress(log: DataFrame) -> DataFrame:
    """Latest state per job from ``log(job, idx, total, status)``, with its share done in percent.

    Batch, or streaming in update or complete mode: one combinable aggregate per job.
    """
    order = F.struct("idx", F.col("status") == "done")
    latest = log.groupBy("job").agg(
        F.max_by(F.struct("idx", "total", "status"), order).alias("latest")
    )
    done = F.col("latest.status") == "done"
    return latest.select(
        "job",
        F.col("latest.status").alias("status"),
        F.col("latest.idx").alias("idx"),
        F.col("latest.total").alias("total"),
        percent_done(F.col("latest.idx"), F.col("latest.total"), done).alias("percent"),
        done.alias("done"),
    )
