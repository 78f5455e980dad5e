"""What each filter of a chain removes, in every order of the chain.

A document that fails a set of filters (its mask) is removed by whichever of them comes first. In the lexicographic
list of all orders, the orders that share a beginning are neighbours; so a mask's removal step is constant on intervals of
order numbers (Lehmer ranks): one for each beginning of filters the document passes, followed by one that it fails. Documents are
therefore counted per part and mask only; each mask adds its counts at the interval's start and takes them away behind its end,
and prefix sums over the ranks give the removals of all orders at once.

Defined results: a NULL text is empty and has no words (it fails a minimum, not a share); a NULL source is the part ``''``, together
with empty sources; a NULL ``doc_id`` is never larger than another and never smaller, so it neither is a copy nor makes one, and has no
label; repeated rows are counted one by one, and rows that share the smallest id of a text are no copies of each other. Very
long texts are taken whole. An empty table has no parts and gives no rows. Columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.tables import written

#: Bound on the filters of a chain: six have 720 orders, and every part gets orders x filters rows.
MOST_FILTERS = 6
BLANK = " \t\n\x0b\x0c\r"


def removal_events(filters: int) -> list[tuple[int, int, int, int]]:
    """``(mask, step, rank, sign)`` of every mask's intervals: 1 where one starts, -1 behind its end.

    Filter ``i`` is bit ``i`` of a mask. Ends behind the last rank are left out.
    """
    events = []

    def descend(mask: int, left: list[int], step: int, rank: int) -> None:
        width = factorial(len(left) - 1)
        for place, one in enumerate(left):
            start = rank + place * width
            if not mask >> one & 1:
                descend(mask, left[:place] + left[place + 1 :], step + 1, start)
                continue
            events.append((mask, step, start, 1))
            if start + width < factorial(filters):
                events.append((mask, step, start + width, -1))

    for mask in range(1, 1 << filters):
        descend(mask, list(range(filters)), 1, 0)
    return events


def audit(counts: DataFrame, names: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """``counts(part, mask, n, *also)`` to one row per part, order and step.

    ``names`` are the filters, one character each, in lexicographic order; filter ``i`` is bit ``i`` of ``mask``. Each column of ``also``
    counts some of the ``n`` documents, and gets its own count of removals, ``<name>_lost``.
    """
    total = len(names)
    if not 0 < total <= MOST_FILTERS or sorted(set(names)) != list(names):
        raise ValueError(f"give 1 to {MOST_FILTERS} different names in order")
    spark, measures = counts.sparkSession, ["n", *also]
    orders = ["".join(p) for p in permutations(names)]
    events = spark.createDataFrame(removal_events(total), "mask int, step int, rank int, sign int")
    changes = (
        counts.join(events, "mask")
        .groupBy("part", "step", "rank")
        .agg(*[F.sum(F.col("sign") * F.col(m)).alias(f"d_{m}") for m in measures])
    )
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(total)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(total)]
    facts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = facts.select("*", F.explode(F.sequence(F.lit(1), F.lit(total))).alias("step"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"))
    # Windows of one part: as many rows as there are ranks, steps, or both.
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = grid.join(changes, ["part", "step", "rank"], "left").select(
        "part", "total", "fails", "alone", "step", "rank",
        *[F.sum(F.coalesce(F.col(f"d_{m}"), F.lit(0))).over(so_far).alias(f"r_{m}") for m in measures],
    )
    order = F.array(*[F.lit(o) for o in orders])[F.col("rank")]
    steps = removed.withColumn("filter_order", order).withColumn("name", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("place", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int"))
    earlier = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("r_n").over(earlier)).alias("kept"),
        F.col("r_n").alias("removed"),
        (F.element_at("fails", F.col("place")) - F.col("r_n")).alias("redundant"),
        F.element_at("alone", F.col("place")).alias("unique_fails"),
        *[F.col(f"r_{m}").alias(f"{m}_lost") for m in also],
        F.sum("r_n").over(Window.partitionBy("part", "name")).alias("shapley"),
    )


# ---------------------------------------------------------------- the filters of the query


def text_filters(text: Column) -> Mapping[str, Column]:
    """Failure conditions that a text decides alone."""
    bare = F.btrim(text, F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: the documents of a part by the filters that they fail.

    Texts are read once, into narrow rows with a SHA-256 digest in the text's place. A text's smallest id is a combinable
    minimum; it goes back to its own row by digest and id, so no group of copies meets in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = text_filters(text)
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own.values())), F.lit(0))
    copy_bit = 1 << len(own)
    rows = written(
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")),
        "audit",
    )
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counted = rows.groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("n"))
    copies = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (
        counted.join(firsts, ["digest", "doc_id"], "left")
        .join(known, "doc_id", "left")
        .groupBy("part", (F.col("own") + F.when(copies, copy_bit).otherwise(0)).alias("mask"))
        .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    )


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(filter_counts(docs, labels), "ABCDE", ["good", "toxic"])


AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
  FROM split LEFT JOIN known USING (doc_id)),
counted AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
cases AS (SELECT part, o, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS sole,
    failed <> '' AND regexp_matches(failed, '[' || before || '-]') AS gone FROM counted, steps),
sums AS (SELECT part, o, step, f, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN sole THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cases GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums"""
