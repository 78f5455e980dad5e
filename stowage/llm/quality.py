"""Quality rules whose cutoffs are read from the data: mergeable quantile sketches per language and source.

Every document gets integer metrics in one projection. A sketch is a histogram over log-linear buckets (64
per power of two, so a quantile is at most 1/32 too low); sketches merge by adding counts, which makes the result the
same for any partitioning and any retried task. A group with too few documents uses the merged sketch of
its language, then the one of the whole input. Everything is DataFrame work; no Python runs on executors.

Defined results: a NULL or blank text has no words and fails the base rules; NULL languages and sources
are groups of their own; repeated rows are judged one by one and count one by one; an empty table gives an
empty result. Input columns are kept by name in ``filter_quality``, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.tables import written
from stowage.session import scratch

WORD_BREAKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SUB_BUCKET_BITS = 6

#: Metric, its value per thousand (or per hundred) as SQL over the base counts, and the margin above the
#: fence. The margin keeps a metric that is constant in a group from rejecting at the first deviation. Ordinary prose repeats no line in most documents of a
#: group, so the fences of the two repetition rules are little more than their margins; these are as wide as clean documents need (see the README).
METRICS = (
    ("symbol", "1000 * n_symbols div greatest(n_chars, 1)", 30),
    ("dup_line", "1000 * n_dup_lines div greatest(n_lines, 1)", 500),
    ("repeat", "1000 * n_repeat_words div greatest(n_words, 1)", 400),
    ("capital", "1000 * n_capitals div greatest(n_chars, 1)", 20),
    ("length", "100 * word_chars div greatest(n_words, 1)", 100),
)


@dataclass(frozen=True)
class QualityRules:
    """``min_words`` and ``max_repeat_percent`` are the base; the rest shapes the adaptive fences.

    A metric is out of bounds above ``Q75 + spread * (Q75 - Q25) + margin`` of its group. A group needs
    ``min_docs`` documents for a sketch of its own.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 3
    min_docs: int = 200


def base_features(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` plus the counts of each text, without a shuffle.

    Three-word windows are compared by hash first: a window's hash and position share one long, so sorting
    longs brings equal hashes together. The few windows with an equal neighbour are then compared word by word.
    """
    df = docs.select(
        F.struct(*keep).alias("k"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    df = df.select(
        "k",
        "t",
        F.filter(F.split("t", WORD_BREAKS), lambda x: x != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_BLANK)).alias("lines"),
    )
    df = df.select("k", "t", "w", "lines", F.size("w").cast("long").alias("n"))
    df = df.select(
        "k", "t", "w", "lines", "n",
        F.expr(
            "CASE WHEN n >= 3 THEN sort_array(transform(sequence(0L, n - 3), i -> "
            "pmod(xxhash64(get(w, int(i)), get(w, int(i + 1)), get(w, int(i + 2))), 4611686018427387904L div n) * n + i)) "
            "ELSE array() END"
        ).alias("s"),
    )
    df = df.select(
        "k", "t", "w", "lines", "n",
        F.expr(
            "transform(filter(s, (x, i) -> x div n = get(s, i - 1) div n OR x div n = get(s, i + 1) div n), x -> int(x % n))"
        ).alias("like_another"),
    )
    df = df.select(
        "k", "t", "w", "lines", "n",
        F.expr(
            "sort_array(transform(like_another, p -> struct(get(w, p) AS a, get(w, p + 1) AS b, get(w, p + 2) AS c, p AS p)))"
        ).alias("g"),
    )
    same = " AND ".join(f"x.{c} = get(g, i {{0}} 1).{c}" for c in "abc")
    return df.select(
        "k.*",
        F.col("n").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CAST(size(array_distinct(flatten(transform("
            f"filter(g, (x, i) -> ({same.format('-')}) OR ({same.format('+')})), "
            "x -> array(x.p, x.p + 1, x.p + 2))))) AS BIGINT)"
        ).alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))).cast("long").alias("n_capitals"),
    )


def base_failed(rules: QualityRules) -> Column:
    few = F.col("n_words") < rules.min_words
    return few | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def bucket(value: str) -> str:
    """The lower end of the log-linear bucket that holds a non-negative integer, as SQL."""
    shift = f"greatest(length(bin({value})) - {SUB_BUCKET_BITS + 1}, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketches(features: DataFrame) -> DataFrame:
    """``(lang, source, metric, bucket, docs)``: one histogram per group and metric, added up map-side first."""
    values = ", ".join(f"named_struct('metric', '{name}', 'v', {sql})" for name, sql, _ in METRICS)
    return (
        features.select("lang", "source", F.expr(f"inline(array({values}))"))
        .select("lang", "source", "metric", F.expr(bucket("v")).alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("docs"))
    )


def fences(histograms: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per language and source with the upper bound of every metric."""
    levels = histograms.select(
        F.expr("inline(array(named_struct('level', 0, 'a', lang, 'b', source), "
               "named_struct('level', 1, 'a', lang, 'b', CAST(NULL AS STRING)), "
               "named_struct('level', 2, 'a', CAST(NULL AS STRING), 'b', CAST(NULL AS STRING))))"),
        "metric", "bucket", "docs",
    ).groupBy("level", "a", "b", "metric", "bucket").agg(F.sum("docs").alias("docs"))
    levels.createOrReplaceTempView(view := "stowage_quality_levels")
    spark = histograms.sparkSession
    quantiles = spark.sql(
        f"""SELECT level, a, b, metric, max(total) AS total,
                   min(CASE WHEN 4 * upto >= total THEN bucket END) AS q25,
                   min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q75
            FROM (SELECT *, sum(docs) OVER (PARTITION BY level, a, b, metric ORDER BY bucket) AS upto,
                         sum(docs) OVER (PARTITION BY level, a, b, metric) AS total FROM {view})
            GROUP BY level, a, b, metric"""
    )
    margin = F.create_map(*[F.lit(x) for name, _, m in METRICS for x in (name, m)])
    bounds = quantiles.select(
        "level", "a", "b", "metric", "total",
        (F.col("q75") + rules.spread * (F.col("q75") - F.col("q25")) + margin[F.col("metric")]).alias("bound"),
    )
    wide = bounds.groupBy("level", "a", "b").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("metric") == name, F.col("bound"))).alias(name) for name, _, _ in METRICS],
    )
    own, lang, whole = (wide.filter(F.col("level") == n).drop("level") for n in range(3))
    own, lang, whole = own.alias("o"), lang.alias("l"), whole.alias("w")
    joined = own.join(lang, F.col("o.a").eqNullSafe(F.col("l.a")), "left").join(whole, F.lit(True), "left")
    enough = lambda side: F.col(f"{side}.total") >= rules.min_docs
    return joined.select(
        F.col("o.a").alias("f_lang"),
        F.col("o.b").alias("f_source"),
        *[
            F.when(enough("o"), F.col(f"o.{m}")).when(enough("l"), F.col(f"l.{m}")).otherwise(F.col(f"w.{m}")).alias(f"max_{m}")
            for m, _, _ in METRICS
        ],
    )


def judged(features: DataFrame, rules: QualityRules) -> DataFrame:
    """``features`` with ``base_failed``, the bounds of their group and ``kept``.

    The bounds are written to the shared folder first, so the planner knows their size and broadcasts them
    only when they are small; otherwise it joins with a shuffle and splits frequent groups.
    """
    spark = features.sparkSession
    path = scratch(spark, "fences")
    fences(sketches(features), rules).write.parquet(path)
    bounds = spark.read.parquet(path)
    on = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    within = F.lit(True)
    for name, sql, _ in METRICS:
        within = within & (F.expr(sql) <= F.col(f"max_{name}"))
    return (
        features.join(bounds, on, "left")
        .withColumn("base_failed", base_failed(rules))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
        .drop("f_lang", "f_source")
    )


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The counts, the group's bounds and the verdict of every document; needs ``doc_id, text, lang, source``.

    Texts are counted once, into a narrow table in the shared folder that both the sketches and the verdicts read.
    """
    return judged(written(base_features(docs, [F.col("doc_id"), F.col("lang"), F.col("source")]), "quality"), rules)


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("lang"), F.col("source")]
    # A filter would be pushed below the projections and count each text again; unpacking an array is not.
    return judged(base_features(docs, whole), rules).select(F.expr("inline(filter(array(row), x -> kept))"))


def report_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_report(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[f"max_{name}" for name, _, _ in METRICS],
    )


def verdict_sql(columns: str) -> str:
    """The same verdicts for DuckDB over ``documents``; ``columns`` is what to select from ``judged``."""
    metric = {name: sql.replace(" div ", " // ") for name, sql, _ in METRICS}
    shift = f"greatest(length(bin(v)) - {SUB_BUCKET_BITS + 1}, 0)"
    rules = QualityRules()
    inlined = " UNION ALL ".join(
        f"SELECT lang, source, '{n}' AS metric, CAST({e} AS BIGINT) AS v FROM features" for n, e in metric.items()
    )
    margins = " ".join(f"WHEN '{n}' THEN {m}" for n, _, m in METRICS)
    wide = ", ".join(f"max(CASE WHEN metric = '{n}' THEN bound END) AS {n}" for n in metric)
    chosen = ", ".join(
        f"CAST(CASE WHEN o.total >= {rules.min_docs} THEN o.{n} WHEN l.total >= {rules.min_docs} THEN l.{n} "
        f"ELSE w.{n} END AS BIGINT) AS max_{n}"
        for n in metric
    )
    within = " AND ".join(f"({e}) <= max_{n}" for n, e in metric.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
words AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS p FROM split),
grams AS (SELECT r, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM grams WHERE c IS NOT NULL) WHERE k > 1),
repeats AS (SELECT r, count(DISTINCT p + i) AS n FROM twice, (SELECT unnest(range(3)) AS i) GROUP BY r),
features AS (SELECT s.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(length(t) AS BIGINT) AS n_chars,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM split s LEFT JOIN repeats USING (r)),
hist AS (SELECT lang, source, metric, (v >> {shift}) << {shift} AS bucket, count(*) AS docs FROM ({inlined}) GROUP BY ALL),
levels AS (SELECT level, a, b, metric, bucket, sum(docs) AS docs FROM (
    SELECT 0 AS level, lang AS a, source AS b, metric, bucket, docs FROM hist
    UNION ALL SELECT 1, lang, NULL, metric, bucket, docs FROM hist
    UNION ALL SELECT 2, NULL, NULL, metric, bucket, docs FROM hist) GROUP BY ALL),
quantiles AS (SELECT level, a, b, metric, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q25,
    min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q75
  FROM (SELECT *, sum(docs) OVER (PARTITION BY level, a, b, metric ORDER BY bucket) AS upto,
      sum(docs) OVER (PARTITION BY level, a, b, metric) AS total FROM levels) GROUP BY ALL),
bounds AS (SELECT level, a, b, total, metric, q75 + {rules.spread} * (q75 - q25) + CASE metric {margins} END AS bound FROM quantiles),
wide AS (SELECT level, a, b, max(total) AS total, {wide} FROM bounds GROUP BY level, a, b),
fences AS (SELECT o.a AS f_lang, o.b AS f_source, {chosen} FROM wide o
  LEFT JOIN wide l ON l.level = 1 AND l.a IS NOT DISTINCT FROM o.a LEFT JOIN wide w ON w.level = 2 WHERE o.level = 0),
failed AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed
  FROM features LEFT JOIN fences ON lang IS NOT DISTINCT FROM f_lang AND source IS NOT DISTINCT FROM f_source),
judged AS (SELECT *, NOT base_failed AND {within} AS kept FROM failed)
SELECT {columns} FROM judged"""


REPORT_SQL = verdict_sql(
    "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, "
    + ", ".join(f"max_{name}" for name, _, _ in METRICS)
)
