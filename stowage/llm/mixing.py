"""Mixing sources to target weights, as DataFrame work only.

The words of a source lie one after the other, in order of doc_id, and are packed into blocks of ``BLOCK`` words. Every
output shard has a number of slots and draws its source counts from a multinomial distribution: each slot draws a number below the
number of all slots, and the sources' shares divide that range. A source then numbers its slots over the shards. Draws beyond a
source's share go to sources that drew too few, matched by rank, so the shares hold exactly. Slot ``q`` of a source with ``n`` blocks
reads block ``permutation(q mod n)`` of pass ``q div n``, a swap-or-not shuffle, and blocks are joined to slots by index.
A target is at most twice its source's size, so no block is taken more than twice.

Defined results: a NULL text has size 0 and is never taken; a NULL source comes last and has the next weight; documents of size 0 belong
to their source; repeated rows are separate documents; equal ids are ordered by text; an empty table gives an empty result.
Reruns agree: all draws are hashes of fixed seeds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.tables import written
from stowage.operators.ranking import rank_within

WORD_BREAKS = r"[\x20\x09-\x0D]+"
WORD_AND_BREAK = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
BLOCK = 64
SLOTS_PER_SHARD = 16384
CELLS = 4096
ROUNDS = 16
SEED = 20240229

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_PASSES = 2


def word_count(text: str) -> Column:
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_BREAKS), lambda x: x != "")
    return F.size(words).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``s, source, source_size, target, blocks, slots, first_slot``: one row per source.

    The fair level is the words per unit of weight at which the capped targets add up to the share. Sources in order of
    the level at which they reach their cap: with the first ``k`` at their caps, the rest share what remains.
    The first ``k`` whose next source stays below its cap gives the level.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.select((F.row_number().over(by_name) - 1).cast("long").alias("s"), "source", "source_size").withColumn("weight", weight)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "s")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_PASSES
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (total * SHARE_PERCENT / 100 - capped) / left)
    fits = F.col("source_size") * MOST_PASSES >= F.col("level") * F.col("weight")
    rows = rows.withColumn("fair", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "s"))).over(everything))
    target = F.least(F.col("fair") * F.col("weight"), (F.col("source_size") * MOST_PASSES).cast("double"))
    rows = rows.withColumn("target", F.coalesce(target, F.lit(0.0)))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    share = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    rows = rows.withColumn("slots", F.least(share, F.col("blocks") * MOST_PASSES))
    first = F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("s", "source", "source_size", "target", "blocks", "slots", F.coalesce(first, F.lit(0)).alias("first_slot"))


def drawn(spark, targets: DataFrame) -> DataFrame:
    """``s, q, shard``: the slots of every source and the output shard that each is in."""
    total = targets.agg(F.sum("slots")).first()[0] or 0
    width = max(1, -(-total // CELLS))
    ranges = targets.filter("slots > 0").select("s", "first_slot", (F.col("first_slot") + F.col("slots")).alias("end_slot"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"first_slot div {width}"), F.expr(f"(end_slot - 1) div {width}"))))
    slots = spark.range(total).select(
        F.expr(f"id div {SLOTS_PER_SHARD}").alias("shard"), F.expr(f"pmod(xxhash64({SEED}, id), {max(total, 1)}L)").alias("draw")
    )
    counts = (
        slots.withColumn("cell", F.expr(f"draw div {width}"))
        .join(cells, "cell")
        .filter("draw >= first_slot AND draw < end_slot")
        .groupBy("s", "shard")
        .agg(F.count("*").alias("n"))
    )
    so_far = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("first", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "draws")
    shares = counts.join(targets.select("s", "slots"), "s").withColumn("good", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first"))))
    good = shares.filter("good > 0").select("s", F.explode(F.expr("sequence(first, first + good - 1)")).alias("q"), "shard")
    surplus = shares.filter("n > good").select("shard", "s", F.explode(F.expr("sequence(good, n - 1)")).alias("extra"))
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    missing = targets.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("slots > got")
    missing = missing.select("s", F.explode(F.expr("sequence(got, slots - 1)")).alias("q"))
    surplus = rank_within(surplus, [], [F.col("shard"), F.col("s"), F.col("extra")], "place", "long").select("place", "shard")
    missing = rank_within(missing, [], [F.col("s"), F.col("q")], "place", "long")
    return good.union(missing.join(surplus, "place").select("s", "q", "shard"))


def permuted(index: str, n: str, key: Sequence[str]) -> Column:
    """A pseudorandom permutation of ``0 .. n - 1``: rounds of swap-or-not, a bijection for any ``n``."""
    names = ", ".join(key)
    other = f"pmod(pmod(xxhash64({SEED}, {names}, r), {n}) - x, {n})"
    swap = f"xxhash64({names}, r, greatest(x, {other})) & 1 = 1"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {index}, (x, r) -> CASE WHEN {swap} THEN {other} ELSE x END)")


def block_copies(spark, targets: DataFrame) -> DataFrame:
    """``s, block, copies``: how often the mix takes each block that it takes."""
    slots = drawn(spark, targets).join(targets.select("s", "blocks"), "s")
    slots = slots.select("s", "shard", "blocks", F.expr("q div blocks").alias("pass"), F.expr("q % blocks").alias("i"))
    chosen = slots.select("s", "shard", permuted("i", "blocks", ["s", "pass"]).alias("block"))
    return chosen.groupBy("s", "block").agg(F.count("*").alias("copies"))


def placed(docs: DataFrame, payload: Sequence[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents, their places (number of the source, words of the source before them), and the sources.

    Documents are range-partitioned by source and order, so a frequent source spreads over many tasks. The place
    of a document is a running sum within its partition plus the sums of the partitions before.
    """
    sized = docs.select(
        F.col("doc_id").alias("d"), F.col("source").alias("o"), word_count("text").alias("size"), F.xxhash64("text").alias("tie"), *payload
    )
    order = [F.col("o"), F.col("d"), F.col("tie"), F.col("size")]
    rows = sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "placed")
    targets = written(source_targets(rows.groupBy(F.col("o").alias("source")).agg(F.sum("size").alias("source_size"))), "targets")
    rows = rows.join(targets.select("s", F.col("source").alias("o2")), F.col("o").eqNullSafe(F.col("o2"))).drop("o2")
    within = Window.partitionBy("s", "part").orderBy("d", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("s", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    narrow = rows.select("s", "part", "row", "d", "tie", "size")
    narrow = narrow.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["s", "part"])
    places = written(narrow.select("row", "s", "d", "size", (F.col("before") + F.col("inside")).alias("offset")), "places")
    return rows, places.join(targets.select("s", "source_size", "target"), "s"), targets


def copies_per_document(places: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's blocks with the copies that the mix takes and the words in common."""
    copies = written(block_copies(places.sparkSession, targets), "copies")
    touched = places.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(offset div {BLOCK}, (offset + size - 1) div {BLOCK})"))
    )
    return touched.join(copies, ["s", "block"]).withColumn(
        "common", F.expr(f"least(offset + size, (block + 1) * {BLOCK}) - greatest(offset, block * {BLOCK})")
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    _, places, targets = placed(docs, [])
    taken = copies_per_document(places, targets).groupBy("row").agg(F.sum(F.col("copies") * F.col("common")).alias("taken"))
    return places.join(taken, "row", "left").select(
        F.col("d").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each pass over a document that takes any of its words.

    A row holds the words of the blocks that the pass takes, with the white space behind them; a document whose blocks are all taken keeps its
    whole text. Other columns are those of the document; ``n_chars``, if there, follows the text.
    """
    rows, places, targets = placed(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")])
    chosen = copies_per_document(places, targets).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("block", "copies"))).alias("copies"))
    chosen = places.join(chosen, "row").select("row", "offset", "size", "copies")
    both = rows.select("row", "doc").join(chosen, "row").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(MOST_PASSES))))
    both = both.withColumn("kept", F.expr("map_filter(copies, (k, v) -> v >= pass)")).filter("cardinality(kept) > 0")
    whole = F.expr(f"cardinality(kept) = (offset + size - 1) div {BLOCK} - offset div {BLOCK} + 1")
    both = both.withColumn("words", F.when(~whole, F.regexp_extract_all(F.col("doc.text"), F.lit(WORD_AND_BREAK), F.lit(0))))
    part = F.expr(f"array_join(filter(words, (x, i) -> map_contains_key(kept, (offset + i) div {BLOCK})), '')")
    both = both.withColumn("new_text", F.when(whole, F.col("doc.text")).otherwise(part))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return both.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def mix_query(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
