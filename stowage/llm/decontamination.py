"""Benchmark items in documents: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

A window has as many words as the item (a shorter document is one window). Windows without any shingle of the item have
similarity 0 and need no fingerprint; the others get a 64-bit SimHash of their words. Fingerprints are looked up in tables of
24 blocks of 2 or 3 bits: fingerprints that differ in up to 23 bits are equal in some block, so every item within that radius
is found. Candidates are verified exactly by the weighted similarity of their 5-word shingles, the sum of the lesser counts over the sum of the
greater ones. A window of similarity 0.75 with single changed words differs in one or two words of an item, about 5 bits of 64; one that is a cut
of the item, or a document that holds no more than three quarters of it, lacks a quarter of its words and differs in about 11 bits, hardly ever in more than 20.

Items are taken in blocks of ``ITEMS_PER_BLOCK``; each block's index is broadcast, and documents pass once for each block. There
is no shuffle of documents.

Defined results: NULL or blank texts and items match nothing; a NULL doc_id is returned as NULL; repeated rows are
searched each; items with fewer than 5 words are one shingle and need a document with that run of words; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.texts import U64, mix, pieces, seeds, shingle_hashes, word_hashes, words

SHINGLE = 5
BLOCK_BITS = (3,) * 16 + (2,) * 8
BLOCKS = len(BLOCK_BITS)
RADIUS = BLOCKS - 1
ITEMS_PER_BLOCK = 20_000
#: Longer items would make a block's size depend on the data; they are still taken, alone if need be.
BYTES_PER_BLOCK = 16 << 20
WORD_SEED = seeds(1, 31)[0]
FILTER_BITS = 20


def signs(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 values, 1 or -1, for every word."""
    spread = mix(hashes ^ WORD_SEED)
    return np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    return np.packbits(totals > 0, axis=1).view(U64).ravel()


def block_values(prints: np.ndarray) -> np.ndarray:
    widths = np.array(BLOCK_BITS)
    shifts = (np.cumsum(widths) - widths).astype(U64)
    return (prints[:, None] >> shifts) & ((1 << widths) - 1).astype(U64)


def weighted_similarity(a: np.ndarray, b: Counter) -> float:
    mine = Counter(a.tolist())
    common = sum(min(n, b[x]) for x, n in mine.items() if x in b)
    return common / (len(a) + sum(b.values()) - common)


class Index:
    """The items of one block: shingles, fingerprints, and tables from block values to items."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float):
        self.threshold = threshold
        self.ids, self.lengths, self.shingles, prints = [], [], [], []
        self.holders: dict[int, list[int]] = defaultdict(list)
        column = pa.array([t for _, t in items], pa.string())
        for first_row, end_row, data, offsets in pieces(column):
            starts, ends, first = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            shingles, begin = shingle_hashes(hashes, first, SHINGLE)
            for k, row in enumerate(range(first_row, end_row)):
                if first[k] == first[k + 1]:
                    continue
                number = len(self.ids)
                self.ids.append(items[row][0])
                self.lengths.append(int(first[k + 1] - first[k]))
                self.shingles.append(Counter(shingles[begin[k] : begin[k + 1]].tolist()))
                prints.append(fingerprints(signs(hashes[first[k] : first[k + 1]]).sum(axis=0, keepdims=True))[0])
                for s in self.shingles[-1]:
                    self.holders[s].append(number)
        self.prints = np.array(prints, U64)
        # Which items have a value in a block, as the bits of an integer.
        self.tables: list[dict[int, int]] = [defaultdict(int) for _ in range(BLOCKS)]
        for number, row in enumerate(block_values(self.prints).tolist() if prints else []):
            for table, value in zip(self.tables, row):
                table[value] |= 1 << number
        self.short = sorted({n for n in self.lengths if n < SHINGLE})
        self.possible = np.zeros(1 << FILTER_BITS, bool)
        if self.holders:
            self.possible[np.array(list(self.holders), U64) >> U64(64 - FILTER_BITS)] = True

    def within_radius(self, prints: np.ndarray, among: int) -> Iterator[tuple[int, int]]:
        """``(window, item)`` for all fingerprints within the radius of an item of the set ``among``, by the block tables."""
        for window, (own, row) in enumerate(zip(prints, block_values(prints).tolist())):
            bits = 0
            for table, value in zip(self.tables, row):
                bits |= table.get(value, 0)
            bits &= among
            while bits:
                low = bits & -bits
                item = low.bit_length() - 1
                bits ^= low
                if int(self.prints[item] ^ own).bit_count() <= RADIUS:
                    yield window, item

    def hits(self, shingles: np.ndarray) -> dict[int, list[int]]:
        """For each item the places of its shingles in a text."""
        found: dict[int, list[int]] = defaultdict(list)
        for place in np.flatnonzero(self.possible[shingles >> U64(64 - FILTER_BITS)]).tolist():
            for item in self.holders.get(int(shingles[place]), ()):
                found[item].append(place)
        return found

    def matches(self, hashes: np.ndarray, shingles: np.ndarray) -> list[tuple[object, float, int]]:
        """``(item id, best similarity, first word)`` of the items in one text; the earliest window wins ties."""
        best: dict[int, tuple[float, int]] = {}
        hits = self.hits(shingles)
        for size in self.short:
            if len(hashes) >= size and len(hashes) >= SHINGLE:
                runs = np.concatenate([shingle_hashes(hashes[i : i + size], np.array([0, size]), SHINGLE)[0] for i in range(len(hashes) - size + 1)])
                for item, places in self.hits(runs).items():
                    if self.lengths[item] == size:
                        best[item] = (1.0, places[0])
        if hits:
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs(hashes), axis=0, dtype=np.int32)))
        by_length: dict[int, set[int]] = defaultdict(set)
        among: dict[int, int] = defaultdict(int)
        for item, places in hits.items():
            size = self.lengths[item]
            if size < SHINGLE and len(hashes) >= SHINGLE:
                continue
            among[size] |= 1 << item
            last = max(len(hashes) - size, 0)
            reach = max(size - SHINGLE, 0)
            for place in places:
                by_length[size].update(range(max(place - reach, 0), min(place, last) + 1))
        for size, windows in by_length.items():
            begin = np.array(sorted(windows), np.intp)
            end = np.minimum(begin + size, len(hashes))
            for window, item in self.within_radius(fingerprints(sums[end] - sums[begin]), among[size]):
                a = int(begin[window])
                part = shingles[a : a + max(min(size, len(hashes)) - SHINGLE + 1, 1)]
                got = weighted_similarity(part, self.shingles[item])
                if got >= self.threshold and got > best.get(item, (0.0, 0))[0]:
                    best[item] = (got, a)
        return [(self.ids[item], *best[item]) for item in sorted(best)]

    def of_column(self, column: pa.Array) -> Iterator[list[tuple[object, float, int]]]:
        for _, _, data, offsets in pieces(column):
            starts, ends, first = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            shingles, begin = shingle_hashes(hashes, first, SHINGLE)
            for k in range(len(offsets) - 1):
                if begin[k] == begin[k + 1]:
                    yield []
                else:
                    yield self.matches(hashes[first[k] : first[k + 1]], shingles[begin[k] : begin[k + 1]])


def blocks_of(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded number and size, one after the other on the driver."""
    items = items.select("item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-n // ITEMS_PER_BLOCK), -(-size // BYTES_PER_BLOCK))
    for block in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [tuple(r) for r in part.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``doc_id, item_id, similarity, start_word`` for every item that a document holds."""
    spark, results = docs.sparkSession, []
    docs = docs.select("doc_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    for block in blocks_of(items):
        shared = spark.sparkContext.broadcast(block)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, threshold)
            for batch in batches:
                per_row = list(index.of_column(batch.column(1)))
                rows = np.repeat(np.arange(len(per_row)), [len(m) for m in per_row])
                flat = [m for matches in per_row for m in matches]
                ids = pa.array([m[0] for m in flat]) if flat else pa.array([], pa.int64())
                columns = [batch.column(0).take(pa.array(rows)), ids, pa.array([m[1] for m in flat], pa.float64()), pa.array([m[2] for m in flat], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "start_word"])

        results.append(docs.mapInArrow(found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, similarity double, start_word long"))
    return reduce(DataFrame.union, results)


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows are judged in place, without a join."""
    columns = docs.columns
    for block in blocks_of(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, threshold)
            for batch in batches:
                keep = pa.array([not m for m in index.of_column(batch.column(batch.schema.names.index("text")))], pa.bool_())
                yield batch.filter(keep)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs.select(columns)


def contamination_query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
