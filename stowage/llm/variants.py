"""Groups of spelling variants: words one code point apart, found in bit-sliced position indexes.

The vocabulary is counted with combinable aggregates. Two words at distance one agree, but for one place, from both ends; so either the first or the last
half of the shorter one's letters but one is the same in both. Words are therefore grouped by such halves, for the length of the shorter word.
A group of more than ``block_words`` words is split by the same argument, applied to the letters that are not yet known to agree,
until groups are small or only one letter is left open. Nothing is dropped: every pair is in some group.

Each group gets a position index: for every place and letter the set of the group's words that have it there, as bits. A word is looked up in
all words of its group at once. Four sets move through its letters: words that agree so far, and words with one error, whose places
are the same (replaced), one further (a letter more) or one back (a letter less). Every step is a few operations on whole sets.

Defined results: a NULL or empty text has no words; a NULL id is written as an empty string in the hash; repeated rows count one by
one; ties for the form go to the smallest word in code-point order; very long texts and words are taken whole. An empty table, or a vocabulary
without near words, gives rows without forms or none. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.tables import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class VariantRules:
    """Words have ``min_chars`` code points and occur ``min_count`` times, or more.

    A form occurs at least ``ratio`` times as often as its variant. ``erase`` is the share (one in so many) of a document's words that lose a
    letter, 0 for none.
    """

    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10
    erase: int = 31
    block_words: int = 2048


# ---------------------------------------------------------------- vocabulary


def vocabulary(docs: DataFrame, rules: VariantRules, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of the words of ``docs``, counted before the shuffle."""
    # Shorter runs cannot become words, whether or not they lose a letter.
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"([A-Za-zÀ-ÿ]{{{rules.min_chars},}})"))
    run = F.col("run")
    found = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lower = F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, UPPER.lower())).otherwise(run)
    word = found.select("id", lower.alias("run"))
    if rules.erase:
        word = word.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
        at = (F.col("h") % F.length(run)).cast("int")
        less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        word = word.select(F.when(F.col("h") % rules.erase == 0, less).otherwise(run).alias("run"))
    counted = word.groupBy(run.alias("word")).agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= rules.min_count) & (F.length("word") >= rules.min_chars))


# ---------------------------------------------------------------- the index


class PositionIndex:
    """Which of some words have a letter at a place, as the bits of integers; word ``j`` is bit ``j``."""

    def __init__(self, words: Sequence[str]):
        self.words = words
        self.at: list[dict[str, int]] = []
        self.length: dict[int, int] = {}
        for j, word in enumerate(words):
            bit = 1 << j
            self.length[len(word)] = self.length.get(len(word), 0) | bit
            self.at.extend({} for _ in range(len(word) - len(self.at)))
            for place, letter in zip(self.at, word, strict=False):
                place[letter] = place.get(letter, 0) | bit
        self.all = (1 << len(words)) - 1

    def place(self, i: int, letter: str) -> int:
        return self.at[i].get(letter, 0) if 0 <= i < len(self.at) else 0

    def within_one(self, word: str) -> tuple[int, int, int]:
        """Words with exactly one letter replaced, one more, and one less than ``word``."""
        same, replaced, more, less = self.all, 0, 0, 0
        for i, letter in enumerate(word):
            here = self.place(i, letter)
            less = less & self.place(i - 1, letter) | same
            more = (more | same) & self.place(i + 1, letter)
            replaced = replaced & here | same & ~here
            same &= here
            if not (same | replaced | more | less):
                break
        n = len(word)
        # What ran past the end of a shorter word is sorted out by length; a word itself is in ``same`` only.
        return (
            replaced & self.length.get(n, 0),
            (more | same) & self.length.get(n + 1, 0),
            less & self.length.get(n - 1, 0),
        )

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low


PAIRS = "word string, n long, near string, near_n long"
PAIRS_AT_ONCE = 1 << 16
PAIRS_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups ``(shorter, words)`` to pairs of near words, in both directions."""
    pairs: list[tuple[str, int, str, int]] = []

    def out() -> pa.RecordBatch:
        columns = zip(*pairs, strict=True) if pairs else [()] * len(PAIRS_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIRS_ARROW, strict=True)], schema=PAIRS_ARROW)

    for batch in batches:
        for shorter, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words, counts = group.values.field(0).to_pylist(), group.values.field(1).to_pylist()
            index = PositionIndex(words)
            for j in index.members(index.length.get(shorter, 0)):
                replaced, more, _ = index.within_one(words[j])
                own = words[j], counts[j]
                for k in index.members(replaced):
                    pairs.append((*own, words[k], counts[k]))
                for k in index.members(more):
                    pairs.append((*own, words[k], counts[k]))
                    pairs.append((words[k], counts[k], *own))
            if len(pairs) >= PAIRS_AT_ONCE:
                yield out()
                pairs.clear()
    yield out()


# ---------------------------------------------------------------- groups

#: What a group has in common: the shorter word's length, how many first and last letters, and these letters.
GROUP = ["shorter", "head", "tail", "first", "last"]


def _halves(df: DataFrame) -> DataFrame:
    """Each row once with half of its open letters known to agree in front, and once behind."""
    half = F.floor((F.col("shorter") - F.col("head") - F.col("tail")) / 2).cast("int")
    sides = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail")),
    )
    cut = df.select("word", "n", "shorter", F.inline(F.array_distinct(sides)))
    first = F.substring("word", F.lit(1), F.col("head"))
    last = F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return cut.select("word", "n", "shorter", "head", "tail", first.alias("first"), last.alias("last"))


def near_words(words: DataFrame, rules: VariantRules) -> DataFrame:
    """``(word, n, near, near_n)`` of all words of ``words(word, n)`` at distance one, each pair in both directions."""
    length = F.length("word").cast("int")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    found, rows = [], _halves(rows)
    while True:
        rows = written(rows, "variant-groups")
        # Letters left open: with one or none a group has no more words than there are letters, and pairs of them.
        open_ = F.col("shorter") - F.col("head") - F.col("tail") > 1
        large = written(rows.filter(open_).groupBy(GROUP).agg(F.count("*").alias("words")).filter(F.col("words") > rules.block_words), "variant-large")
        groups = rows.join(large, GROUP, "left_anti").groupBy(GROUP).agg(
            F.collect_list(F.struct("word", "n")).alias("words"), F.count_if(F.length("word") == F.col("shorter")).alias("asking")
        )
        groups = groups.filter((F.col("asking") > 0) & (F.size("words") > 1)).select("shorter", "words")
        found.append(groups.mapInArrow(_look_up, PAIRS))
        if not large.head(1):
            break
        # A word may come to a smaller group by two ways.
        rows = _halves(rows.join(large, GROUP, "left_semi")).distinct()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _best(near: Column, n: Column) -> Column:
    """The largest ``n``, then the smallest word."""
    return F.min(F.struct((-n).alias("less"), near.alias("word")))


def spelling_groups(words: DataFrame, rules: VariantRules = VariantRules()) -> DataFrame:
    """``words(word, n)`` with ``form``, ``root``, ``n_near`` and ``form_n``.

    Along a chain of forms counts grow by ``ratio`` at each step, so a chain of long counts has fewer than 64 steps, and roots
    are known after six rounds in which every word's goal is replaced by its goal's goal.
    """
    if rules.ratio < 2:
        raise ValueError("the ratio must be 2 or more, so that chains of forms end")
    near = near_words(words, rules).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), _best(F.col("near"), F.col("near_n")).alias("best")
    )
    formed = F.when(-F.col("best.less") >= rules.ratio * F.col("n"), F.col("best"))
    near = written(near.select("word", "n_near", formed["word"].alias("form"), (-formed["less"]).alias("form_n")), "variant-near")
    links = near.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(6):
        goal = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(goal, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = written(stepped, "variant-roots")
        links = stepped.drop("moved")
        if not stepped.filter("moved").head(1):
            break
    return words.join(near, "word", "left").join(links, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )


def variants(docs: DataFrame, rules: VariantRules = VariantRules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return spelling_groups(written(vocabulary(docs, rules, id, text), "vocabulary"), rules)


def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


VARIANTS_SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted_runs AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM counted_runs),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2),
      lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h
  FROM bytes, crc_table),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k
  FROM hashed),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocab),
replaced AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
longer AS (SELECT DISTINCT a.word AS small, a.n AS small_n, b.word AS large, b.n AS large_n FROM vocab a JOIN less b ON a.word = b.rest),
near AS (SELECT * FROM replaced UNION ALL SELECT small, large, large_n FROM longer UNION ALL SELECT large, small, small_n FROM longer),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
    CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word AND place = 1),
chain AS (SELECT word, coalesce(form, word) AS root FROM formed
  UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN last USING (word)"""
