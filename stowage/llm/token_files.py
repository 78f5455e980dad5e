"""Token files: one compressed wavelet matrix per shard.

The tokens of a shard are stored as bit planes, from the highest bit down. Below each plane the tokens are
dealt stably into those with bit 0 and those with bit 1, so rank and select on the planes answer access, counting and
the places of a token without unpacking the shard. Counts of ones before every block of 512 bits
are the directory.

A shard is one Parquet file of one row, written by Spark and so committed once however often a task runs.
Documents are in ascending order of id within and across shards (equal ids by text); a shard ends after the document that
reaches ``tokens_per_shard``, so its size is bounded by that and one document.

Defined results: NULL and empty texts have the end id only; a NULL doc_id sorts first; repeated rows are written
each; an empty table gives shards without rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.vocabulary import LETTER, NOT_PLAIN, NUMBER, SPACE, Filled, added_strings, byte_letters, forget, per_process, read_tokenizer
from stowage.session import scratch

BLOCK = 512
#: Tokens dealt at once, so that their indices stay in a processor's cache.
DEALT = 1 << 16
#: The word pattern of byte-level vocabularies over plain characters (fixed value).
WORDS = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: White space that meets a space, or a space at an end: such texts are not cut at spaces.
UNEVEN = re.compile(f"[{SPACE}] | [{SPACE}]|^ | $")
RARE_SPACES = "\t\x0b\x0c\r\x85\xa0"
#: None is a letter, a number or white space, so those behind a word are one pre-token.
MARKS = string.punctuation
#: The only characters below 128 that are not plain.
NOT_PLAIN_ASCII = "\x1c\x1d\x1e\x1f"
#: The letter that byte-level vocabularies write for a space.
SPACE_LETTER = "\u0120"
#: Entries that a worker keeps, about 200 bytes each.
PIECES_KEPT, PRE_TOKENS_KEPT = 690_000, 300_000
#: Texts are cut together up to this many characters; a longer text is cut alone.
TOGETHER = 1 << 22

SCHEMA = (
    "part int, shard int, n_tokens long, bits int, doc_ids array<long>, lengths array<long>, "
    "zeros array<long>, planes array<binary>, ones array<binary>"
)


class Encoder:
    """Token ids of whole texts, as bytes of a fixed width.

    The library encodes. What it gave for a piece between spaces, or for a pre-token, is kept within a fixed number
    of entries; a piece starts with its space, or with a line end, where a pre-token always begins, so pieces are independent. The merges of a
    pre-token are asked of the library's model, without its bookkeeping of positions. Texts that cannot be cut like
    this, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, content: str, kind: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        before = spec["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.cuts = bool(byte_level) and spec["normalizer"] is None
        self.library, self.code = Tokenizer.from_str(content), "H" if kind == "<u2" else "I"
        self.tokenize, self.letters = self.library.model.tokenize, {byte: letter for letter, byte in byte_letters().items()}
        self.special = added_strings(content)
        cut = re.compile(WORDS).findall
        pre_tokens = Filled(self.merge, PRE_TOKENS_KEPT)

        def first(piece: str) -> bytes:
            return pre_tokens[piece] if piece.isalpha() else b"".join(map(pre_tokens.__getitem__, cut(piece)))

        def after_space(piece: str) -> bytes:
            if piece.isalpha():
                return self.merge(" " + piece)
            if piece[:1] == "\n":
                return pre_tokens["\n"] + first(piece[1:])
            # A pre-token that starts with the space is a piece itself, so it is kept as one.
            head, *rest = cut(" " + piece)
            known = self.pieces[head[1:]] if rest else self.merge(head)
            return known + b"".join(map(pre_tokens.__getitem__, rest))

        def marked(piece: str) -> bytes:
            # Marks behind a letter or number are a pre-token, so the table need not hold a word with each of them.
            word = piece.rstrip(MARKS)
            if len(word) == len(piece) or not word[-1:].isalnum():
                return self.pieces[piece]
            return self.pieces[word] + pre_tokens[piece[len(word) :]]

        self.first, self.marked, self.pieces = first, marked, Filled(after_space, PIECES_KEPT)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def merge(self, pre_token: str) -> bytes:
        if pre_token.isascii() and pre_token.isprintable():
            spelled = pre_token.replace(" ", SPACE_LETTER)  # the other characters stand for themselves
        else:
            spelled = pre_token.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.tokenize(spelled)])

    @staticmethod
    def uneven(text: str) -> bool:
        """``UNEVEN``, by substring searches where only spaces and line ends occur."""
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return True
        return any(c in text for c in RARE_SPACES) and bool(UNEVEN.search(text))

    @staticmethod
    def plain(text: str) -> bool:
        """No character of ``NOT_PLAIN``."""
        return not any(c in text for c in NOT_PLAIN_ASCII) if text.isascii() else not NOT_PLAIN.search(text)

    @staticmethod
    def single_line_ends(text: str) -> bool:
        """Every line end of an even text is a pre-token: no run of them is taken together with what follows it."""
        return "\n\n\n" not in text and text[-2:] != "\n\n" and not any(c in text for c in RARE_SPACES)

    def begun(self, text: str) -> tuple[bytes, str | None]:
        """The ids before the first space, and the pieces behind it, if there are any. A text that is encoded whole has no pieces."""
        if not self.cuts or not self.plain(text) or self.uneven(text) or any(s in text for s in self.special):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids), None
        if "\n" in text and self.single_line_ends(text):
            text = text.replace("\n", " \n")  # a piece that starts with a line end has no space before it
        first, space, rest = text.partition(" ")
        return self.first(first), rest if space else None

    def together(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; a piece is looked up once, however often the texts hold it."""
        firsts, rests = zip(*map(self.begun, texts))
        rows = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        pieces = rows.flatten().dictionary_encode()
        found = pa.array(map(self.marked, pieces.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary())
        data = memoryview(found.take(pieces.indices).buffers()[2] or b"")
        sizes = pc.binary_length(found).to_numpy()[pieces.indices.to_numpy()]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())))]
        return [first + data[a:b] for first, a, b in zip(firsts, bounds, bounds[1:])]

    def each(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of every text of a column, NULL being empty. Texts are taken together up to a number of characters."""
        texts, size = [], 0
        for value in column:
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= TOGETHER:
                yield from self.together(texts)
                texts, size = [], 0
        if texts:
            yield from self.together(texts)

    def __call__(self, text: str) -> bytes:
        return self.together([text])[0]


@dataclass
class WaveletMatrix:
    """A sequence of ids below ``2 ** bits`` as bit planes with rank directories."""

    n: int
    bits: int
    zeros: list[int]
    planes: list[bytes]
    ones: list[bytes]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ones = [], [], []
        for bit in range(bits - 1, -1, -1):
            high = (ids & ids.dtype.type(1 << bit)) != 0
            packed = np.packbits(high)
            per_byte = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))))
            per_block = per_byte.reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            ones.append(np.concatenate(([0], np.cumsum(per_block))).astype("<u4").tobytes())
            dealt = np.empty_like(ids)
            zeros.append(len(ids) - int(per_block.sum()))
            planes.append(packed.tobytes())
            for run, at, below in cls.dealing(high, zeros[-1]):
                ids[run].take(at, out=dealt[below], mode="clip")
            ids = dealt
        return cls(len(ids), bits, zeros, planes, ones)

    @staticmethod
    def dealing(high: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice]]:
        """How a plane deals tokens: of a run of them, the places of those with one bit, and where these lie below the plane."""
        next_low, next_high = 0, zeros
        for start in range(0, len(high), DEALT):
            run = slice(start, start + DEALT)
            low, up = np.flatnonzero(~high[run]), np.flatnonzero(high[run])
            yield run, low, slice(next_low, next_low + len(low))
            yield run, up, slice(next_high, next_high + len(up))
            next_low, next_high = next_low + len(low), next_high + len(up)

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.planes[level], np.uint8), np.frombuffer(self.ones[level], "<u4")

    def ones_before(self, level: int, i: int) -> int:
        packed, directory = self.plane(level)
        block = i // BLOCK
        rest = np.unpackbits(packed[block * BLOCK // 8 : (i + 7) // 8], count=i - block * BLOCK)
        return int(directory[block]) + int(rest.sum())

    def place_of_bit(self, level: int, one: bool, k: int) -> int:
        """The position of the ``k``-th (from 0) one or zero of a plane."""
        packed, directory = self.plane(level)
        counts = directory if one else np.arange(len(directory)) * BLOCK - directory
        block = int(np.searchsorted(counts[:-1], k, side="right")) - 1
        bits = np.unpackbits(packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.bits):
            before = self.ones_before(level, i)
            bit = self.ones_before(level, i + 1) - before
            value = value << 1 | bit
            i = self.zeros[level] + before if bit else i - before
        return value

    def span(self, value: int, i: int) -> tuple[int, int]:
        """Where ``value`` lies below the last plane: the start, and the end of those before position ``i``."""
        start, end = 0, i
        for level in range(self.bits):
            if value >> (self.bits - 1 - level) & 1:
                start, end = (self.zeros[level] + self.ones_before(level, x) for x in (start, end))
            else:
                start, end = (x - self.ones_before(level, x) for x in (start, end))
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs before position ``i``."""
        start, end = self.span(value, i)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of the ``k``-th (from 0) occurrence of ``value``."""
        start, end = self.span(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - level) & 1)
            i = self.place_of_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """The whole sequence: the planes are followed upwards once."""
        kind = np.dtype(np.uint16 if self.bits <= 16 else np.uint32)
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            high = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n).view(bool)
            above, zeros = np.empty(self.n, kind), self.zeros[level]
            values[zeros:] |= kind.type(1 << (self.bits - 1 - level))
            for run, at, below in self.dealing(high, zeros):
                above[run][at] = values[below]
            values = above
        return values


def vocabulary_bits(content: str, *more: int) -> int:
    spec = json.loads(content)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), *more]
    return max(1, max(ids).bit_length())


def encoder_key(tokenizer_path: str) -> str:
    return f"encoder_{tokenizer_path}"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, tokens_per_shard: int = 1 << 21) -> None:
    """Writes the ids of ``docs`` (``doc_id``, ``text``) below ``path``, each document followed by ``end_id``.

    One shuffle orders the texts by id; encoding follows it, so each text is encoded once.
    """
    content = read_tokenizer(tokenizer_path)
    bits = vocabulary_bits(content, end_id)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = "<u2" if bits <= 16 else "<u4"
    end = np.array([end_id], kind).tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_process(encoder_key(tokenizer_path), lambda: Encoder(shared.value, kind))
        part, shard, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), kind), bits)
            row = {
                "part": part, "shard": shard, "n_tokens": matrix.n, "bits": bits, "doc_ids": ids,
                "lengths": [len(p) // len(end) for p in parts], "zeros": matrix.zeros, "planes": matrix.planes, "ones": matrix.ones,
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow_schema())

        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encoder.each(batch.column(1))):
                ids.append(doc_id)
                parts.append(encoded + end)
                size += len(parts[-1])
                if size >= tokens_per_shard * len(end):
                    yield closed()
                    shard, ids, parts, size = shard + 1, [], [], 0
        if ids:
            yield closed()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    written = ordered.mapInArrow(shards, SCHEMA).write
    written.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def arrow_schema() -> pa.Schema:
    long, whole = pa.list_(pa.int64()), pa.list_(pa.binary())
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), long, long, long, whole, whole]
    return pa.schema(list(zip([c.split()[0] for c in SCHEMA.split(", ")], kinds)))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def matrix_of(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["bits"], row["zeros"], row["planes"], row["ones"])


def over_rows(shards: DataFrame, each, schema: str) -> DataFrame:
    """``each(row)`` gives a pandas table for every shard; shards are taken one by one."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield pa.RecordBatch.from_pandas(each(row), preserve_index=False)

    return shards.mapInArrow(mapped, schema)


def index_rows(row: dict) -> pd.DataFrame:
    """The documents of a shard with their places in it."""
    ids, ends = matrix_of(row).ids().astype("<u4"), np.cumsum(row["lengths"])
    starts = ends - row["lengths"]
    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
    return pd.DataFrame({
        "part": np.int32(row["part"]), "shard": np.int32(row["shard"]), "doc_id": pd.array(row["doc_ids"], "Int64"),
        "offset": starts, "n_tokens": ends - starts, "ids_crc32": np.array(crcs, np.int64),
    })


def index_rows_after(tokenizer_path: str) -> Callable[[dict], pd.DataFrame]:
    """``index_rows`` in workers that have no more use for the tokenizer's encoder, which fills hundreds of MB."""

    def each(row: dict) -> pd.DataFrame:
        forget(encoder_key(tokenizer_path))
        return index_rows(row)

    return each


def document_index(spark: SparkSession, path: str, each: Callable[[dict], pd.DataFrame] = index_rows) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``start`` adds up counts: within a shard, over the shards of a write task, and over the tasks (one row each).
    """
    shards = read_shards(spark, path)
    found = over_rows(shards, each, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    tasks = tasks.select("part", before(Window.orderBy("part")).alias("task_start"))
    inner = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("shard_start"))
    starts = inner.join(tasks, "part").select("part", "shard", (F.col("task_start") + F.col("shard_start")).alias("shard_start"))
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Where a token occurs: ``doc_id`` and the position in the document, by rank and select on the planes."""

    def places(row: dict) -> pd.DataFrame:
        at = np.array(matrix_of(row).occurrences(token), np.int64)
        ends = np.cumsum(row["lengths"])
        doc = np.searchsorted(ends, at, side="right")
        ids = pd.array(row["doc_ids"], "Int64")
        return pd.DataFrame({"doc_id": ids[doc], "position": at - (ends - row["lengths"])[doc]})

    return over_rows(read_shards(spark, path), places, "doc_id long, position long")


def token_count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often a token occurs in each shard."""
    count = lambda row: pd.DataFrame({"part": np.int32([row["part"]]), "shard": np.int32([row["shard"]]), "n": [matrix_of(row).count(token)]})
    return over_rows(read_shards(spark, path), count, "part int, shard int, n long")


def token_output(docs: DataFrame, tokenizer_path: str, last: bool = False) -> DataFrame:
    """Writes token files to the shared folder and returns their index.

    ``last`` says that nothing is encoded after this, so reading the files back frees the workers' encoders.
    """
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write_token_files(docs, path, tokenizer_path)
    return document_index(spark, path, index_rows_after(tokenizer_path) if last else index_rows)


def output_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))
