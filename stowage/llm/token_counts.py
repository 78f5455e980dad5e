"""Token counts with a whole-token shortcut.

Before the job, every string of the vocabulary that ends a word is encoded alone once. Those that give exactly their
own token, from a single pre-token, are proven whole tokens. In the tasks, texts are cut into pre-tokens; a
proven one counts 1 without merging, and only the rest goes through the library's merges. Recent
results are kept per worker, within a fixed number of entries.

Texts of common Latin characters are normalised and cut with compiled patterns. Any other text is normalised and cut by the
library itself, and then takes the same shortcut. Special strings inside a text are one token each, and
cut it, as the library does by default. There is no shuffle.

Defined results: a NULL or empty text has 0 tokens; repeated rows and NULL ids are counted row by row; very
long texts are taken whole; an empty table gives an empty result. Other columns are not touched: the count and
the two derived columns are appended to ``keep`` only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.vocabulary import LETTER, NOT_PLAIN, NUMBER, SPACE, Filled, added_strings, byte_letters, per_process, read_tokenizer

#: The word pattern of the vocabulary file over plain characters (fixed value).
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
CACHED = 400_000


def tokenizer(content: str, normalised: bool = False):
    """The library's tokenizer; with ``normalised`` it takes texts that need no normalising any more."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(json.dumps(json.loads(content) | {"normalizer": None}) if normalised else content)
    made.encode_special_tokens = normalised
    return made


def whole_tokens(content: str) -> set[str]:
    """The proof: strings of the vocabulary that, encoded alone, are one pre-token and give one token, their own."""
    spec, letters = json.loads(content), byte_letters()
    suffix = spec["model"]["end_of_word_suffix"]
    claims = {}
    for entry, number in spec["model"]["vocab"].items():
        if entry.endswith(suffix):
            try:
                claims[bytes(letters[c] for c in entry[: -len(suffix)]).decode()] = number
            except (KeyError, UnicodeDecodeError):
                continue
    plain = tokenizer(content, normalised=True)
    encoded = plain.encode_batch(list(claims), add_special_tokens=False)
    return {
        text
        for (text, number), got in zip(claims.items(), encoded)
        if got.ids == [number] and len(plain.pre_tokenizer.pre_tokenize_str(text)) == 1
    }


class Counter:
    def __init__(self, content: str, whole: set[str]):
        self.full, self.merging = tokenizer(content), tokenizer(content, normalised=True)
        self.special = re.compile("|".join(map(re.escape, added_strings(content))) or "(?!)")
        self.cut = re.compile(WORDS).findall
        # Pre-tokens: the proven ones count 1; others are merged by the library.
        self.pre_tokens = Filled(self.merged, len(whole) + CACHED, dict.fromkeys(whole, 1))
        # White space always separates pre-tokens, so what stands between it can be looked up as a whole.
        self.chunks = Filled(lambda chunk: sum(map(self.pre_tokens.__getitem__, self.cut(chunk))), CACHED)

    def merged(self, pre_token: str) -> int:
        return len(self.merging.encode(pre_token, add_special_tokens=False).ids)

    def part(self, text: str) -> int:
        if not NOT_PLAIN.search(text):
            return sum(map(self.chunks.__getitem__, text.lower().split()))
        text = self.full.normalizer.normalize_str(text)
        return sum(self.pre_tokens[text[a:b]] for _, (a, b) in self.full.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.part, parts))


def count_tokens(docs: DataFrame, tokenizer_path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", limit: int = 2048) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    content = read_tokenizer(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((content, whole_tokens(content)))
    size = F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("k"), size.alias("n_bytes"), F.col(f"`{text}`").alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(f"counter_{tokenizer_path}", lambda: Counter(*shared.value))
        for batch in batches:
            counts = pa.array([counter.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts], ["k", "n_bytes", "n_tokens"])

    schema = rows.drop("t").schema.add("n_tokens", "long")
    return rows.mapInArrow(counted, schema).select("k.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counts_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
