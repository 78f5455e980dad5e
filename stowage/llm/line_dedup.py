"""Lines that many documents share, found with two Bloom filters.

The first scan hashes lines and deals the 64-bit values, each once per chunk of a task, to slices of the hash space. Every slice fills a
filter of values seen once; a value that the filter already holds goes into a second filter, of values seen twice. Only lines that
the second filter may hold are suspected; only they are shuffled, as SHA-256 digests of their keys with the document's id, where
an exact count confirms or clears them and picks the document that keeps the line. What a filter wrongly holds costs a digest, nothing else.

The second filters are as large as the number of repeated lines asks (each is folded to half its size while it is nearly empty). If all of them
have at most ``filter_bytes``, tasks get them as one broadcast value. Beyond that the suspects are found where the filters are: the
second scan's hashes and digests are dealt to the slices instead. Both ways give the same suspects.

Defined results: a NULL or empty text is one empty line; rows count as documents one by one, also with the same id; rows that share the
largest id of a line all keep it. A NULL id is smaller than any other; a line that only such rows hold stays. Very long texts and lines are taken
whole; all hashes of a task's chunk have bounded room. An empty table gives an empty result. ``without_shared_lines`` keeps all columns of its input by
name; ``line_report`` has its own columns only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.tables import written
from stowage.llm.texts import BYTE_VALUE, IS_SPACE, LOWER, PIECE_BYTES, STEP, U64, mix, pieces
from stowage.llm.vocabulary import per_process

#: Slices of the hash space. A filter of one slice is what a task holds at a time.
SLICE_BITS = 12
#: Probes per value, and bits per value in the filter of values seen once.
PROBES = 6
BITS_PER_VALUE = 10
#: Tasks over which the documents that hold one line are dealt.
SALTS = 16
#: Hashes that a task gathers before it deals them out.
CHUNK = 1 << 20
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LineRules:
    """Lines whose key has ``min_chars`` code points or more, found in ``min_docs`` documents or more, are shared.

    ``filter_bytes`` is the most that is ever broadcast.
    """

    min_chars: int = 40
    min_docs: int = 5
    filter_bytes: int = 32 << 20


# ---------------------------------------------------------------- lines and their hashes


def lines(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all keys of ``least`` code points or more, and the text that each lies in."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((offsets[1:], breaks)))
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    row = np.repeat(np.arange(len(counts)), counts)
    filled = np.flatnonzero(~IS_SPACE[data])
    first, last = np.searchsorted(filled, starts), np.searchsorted(filled, ends) - 1
    some = first <= last
    starts, ends, row = filled[first[some]], filled[last[some]] + 1, row[some]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[ends] - points[starts] >= least
    return starts[long], ends[long], row[long]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``STEP`` and of its inverse; those of a usual piece are kept."""

    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        bases = (STEP, U64(pow(int(STEP), -1, 1 << 64)))
        return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(size - 1, b, U64)))) for b in bases)

    up, down = per_process("line_powers", lambda: make(PIECE_BYTES + 1)) if n <= PIECE_BYTES + 1 else make(n)
    return up[:n], down[:n]


def key_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of every key, from one prefix sum over the piece."""
    up, down = _powers(len(data) + 1)
    upto = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUE[LOWER[data]] * up[: len(data)], dtype=U64)))
    return mix((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(U64))


# ---------------------------------------------------------------- the filters


def _probes(hashes: np.ndarray, mask: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Bit numbers, the same but for their upper bits in a filter of twice the size."""
    step = mix(hashes ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    for k in range(PROBES):
        yield (hashes + U64(k) * step) & mask


def holds(bits: np.ndarray, hashes: np.ndarray, mask: np.ndarray | np.uint64, base: np.ndarray | int = 0) -> np.ndarray:
    """Which hashes a filter may hold; ``base`` is the first byte of each one's filter in ``bits``."""
    found = np.ones(len(hashes), bool)
    for bit in _probes(hashes, mask):
        found &= (bits[base + (bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def put(bits: np.ndarray, hashes: np.ndarray, mask: np.uint64) -> None:
    for bit in _probes(hashes, mask):
        np.bitwise_or.at(bits, (bit >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (bit & U64(7)).astype(np.uint8))


def folded(bits: np.ndarray) -> np.ndarray:
    """The same filter in as few bytes (a power of two) as leave at most a quarter of its bits set."""
    while len(bits) > 8:
        half = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        if int(np.bitwise_count(half).sum()) * 4 > len(half) * 8:
            break
        bits = half
    return bits


def _slices(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - SLICE_BITS)).astype(np.int64)


DEALT = "slice int, n long, once binary, more binary"
DEALT_ARROW = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])


def _deal(rules: LineRules):
    def packed(hashes: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        edges = np.searchsorted(_slices(values), np.arange((1 << SLICE_BITS) + 1))
        numbers = np.flatnonzero(np.diff(edges))
        columns = [[], [], [], []]
        for s in numbers:
            part, often = values[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]] > 1
            for column, value in zip(columns, (int(s), len(part), part.tobytes(), part[often].tobytes()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DEALT_ARROW, strict=True)], schema=DEALT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                starts, ends, row = lines(data, offsets, rules.min_chars)
                if not len(starts):
                    continue
                # Once per document: by text and value.
                hashes = key_hashes(data, starts, ends)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
                held.append(hashes[new])
                size += int(new.sum())
                if size >= CHUNK:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


FILTERS = "slice int, bits binary"
FILTERS_ARROW = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])


def _fill(size: int):
    """Both filters of each slice in turn, of ``size`` bytes; only the second one comes out."""

    def out(number: int, twice: np.ndarray) -> pa.RecordBatch:
        bits = folded(twice).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bits], pa.binary())], schema=FILTERS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = U64(size * 8 - 1)
        number, once, twice = None, None, None
        for batch in batches:
            for slice_, _, values, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slice_ != number:
                    if number is not None and twice.any():
                        yield out(number, twice)
                    number, once, twice = slice_, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                values = np.frombuffer(values, U64)
                put(twice, values[holds(once, values, mask)], mask)
                put(twice, np.frombuffer(more, U64), mask)
                put(once, values, mask)
        if number is not None and twice.any():
            yield out(number, twice)

    return run


def repeat_filters(docs: DataFrame, rules: LineRules, text: str = "text") -> DataFrame:
    """``(slice, bits)``: for every slice with repeated lines the filter of values seen twice."""
    dealt = written(docs.select(F.col(text)).mapInArrow(_deal(rules), DEALT), "line-hashes")
    values = dealt.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    # Hashes spread evenly, so all slices get filters of one size, from the number of values.
    per_slice = max(64, -(-BITS_PER_VALUE * values >> SLICE_BITS))
    size = 1 << (per_slice - 1).bit_length() - 3
    return written(dealt.repartition("slice").sortWithinPartitions("slice").mapInArrow(_fill(size), FILTERS), "line-filters")


def _directory(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All filters in one array, with each slice's first byte and bit mask; a slice without one has an empty filter."""
    base, mask = np.zeros(1 << SLICE_BITS, np.int64), np.full(1 << SLICE_BITS, 63, U64)
    parts, at = [bytes(8)], 8
    for slice_, bits in rows:
        base[slice_], mask[slice_] = at, len(bits) * 8 - 1
        parts.append(bytes(bits))
        at += len(bits)
    return np.frombuffer(b"".join(parts), np.uint8), base, mask


# ---------------------------------------------------------------- suspects

KEYS_ARROW = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("digest", pa.binary())])


def _suspects(rules: LineRules, directory):
    """Ids and digests of keys, each once per row; with a ``directory`` only of those that its filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(1)):
                starts, ends, row = lines(data, offsets, rules.min_chars)
                hashes = key_hashes(data, starts, ends)
                if directory is not None:
                    bits, base, mask = directory.value
                    slices = _slices(hashes)
                    found = holds(bits, hashes, mask[slices], base[slices])
                    starts, ends, row, hashes = starts[found], ends[found], row[found], hashes[found]
                lower = LOWER[data].tobytes()
                digests = [hashlib.sha256(lower[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                seen, keep = set(), []
                for i, one in enumerate(zip(row.tolist(), digests, strict=True)):
                    if one not in seen:
                        seen.add(one)
                        keep.append(i)
                ids = batch.column(0).slice(first, end - first).take(pa.array(row[keep], pa.int64()))
                columns = [ids, pa.array(hashes[keep].view(np.int64)), pa.array([digests[i] for i in keep], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=KEYS_ARROW)

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that come sorted by slice, each slice's filter first; those that it may hold go on."""
    number, bits = None, np.zeros(8, np.uint8)
    for batch in batches:
        slices, given = batch.column(0).to_numpy(), batch.column(1)
        edges = np.flatnonzero(np.concatenate(([True], slices[1:] != slices[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if slices[a] != number:
                number, bits = slices[a], np.zeros(8, np.uint8)
            if given[a].is_valid:
                bits, a = np.frombuffer(given[a].as_py(), np.uint8), a + 1
            keys = batch.slice(a, b - a).select([2, 3, 4])
            hashes = keys.column(1).to_numpy().view(U64)
            yield keys.filter(pa.array(holds(bits, hashes, U64(len(bits) * 8 - 1))))


def suspected(docs: DataFrame, filters: DataFrame, rules: LineRules, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, digest)``: for every row its keys that another row may hold too."""
    spark, schema = docs.sparkSession, "id long, hash long, digest binary"
    size = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).head()[0]
    narrow = docs.select(F.col(id).cast("long"), F.col(text))
    if size <= rules.filter_bytes:
        directory = spark.sparkContext.broadcast(_directory(filters.collect()))
        return narrow.mapInArrow(_suspects(rules, directory), schema).drop("hash")
    keys = narrow.mapInArrow(_suspects(rules, None), schema)
    keys = keys.select(F.shiftrightunsigned("hash", 64 - SLICE_BITS).cast("int").alias("slice"), F.lit(None).cast("binary").alias("bits"), "*")
    both = keys.unionByName(filters, allowMissingColumns=True)
    dealt = both.repartition("slice").sortWithinPartitions("slice", F.col("bits").isNull())
    return dealt.mapInArrow(_probe, schema).drop("hash")


# ---------------------------------------------------------------- confirmation and result


def shared_lines(docs: DataFrame, rules: LineRules, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(digest, docs, keeper)`` of all shared lines, and ``(id, digests)``: what each document loses."""
    found = written(suspected(docs, repeat_filters(docs, rules, text), rules, id, text), "line-suspects")
    shared = found.groupBy("digest").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).filter(F.col("docs") >= rules.min_docs)
    loses = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    # A line that many documents share is dealt over several tasks; shared lines are at most a fifth of the suspects.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    losses = salted.join(spread, ["digest", "salt"]).filter(loses).groupBy("id").agg(F.collect_set("digest").alias("digests"))
    return shared, losses


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare.rlike("[A-Z]"), F.translate(bare, UPPER, UPPER.lower())).otherwise(bare)


def _cut(docs: DataFrame, rules: LineRules, id: str, text: str) -> DataFrame:
    """``docs`` as one struct ``row``, with its lines before (``all_lines``) and after (``kept_lines``)."""
    _, losses = shared_lines(docs, rules, id, text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id).cast("long").alias("row_id"))
    joined = rows.join(losses, F.col("row_id").eqNullSafe(F.col("id")), "left").select("row", "digests")
    split = joined.select("row", "digests", F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n").alias("all_lines"))
    shared = lambda line: F.array_contains("digests", F.unhex(F.sha2(line_key(line), 256)))
    kept = F.when(F.col("digests").isNull(), F.col("all_lines")).otherwise(F.filter("all_lines", lambda line: ~shared(line)))
    return split.select("row", "all_lines", kept.alias("kept_lines"))


def line_report(docs: DataFrame, rules: LineRules = LineRules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)`` of every row."""
    n_lines, n_kept = F.size("all_lines").cast("long"), F.size("kept_lines").cast("long")
    return _cut(docs, rules, id, text).select(
        F.col("row").getField(id).alias("doc_id"),
        n_lines.alias("n_lines"),
        (n_lines - n_kept).alias("n_dropped"),
        F.array_join("kept_lines", "\n").alias("kept_text"),
    )


def without_shared_lines(docs: DataFrame, rules: LineRules = LineRules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the lines they keep; a text that loses none stays as it is, NULL included."""
    cut = _cut(docs, rules, id, text)
    left = F.size("all_lines") == F.size("kept_lines")
    new = F.when(left, F.col("row").getField(text)).otherwise(F.array_join("kept_lines", "\n"))
    return cut.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_report(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
single AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM single),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY r, doc_id"""
