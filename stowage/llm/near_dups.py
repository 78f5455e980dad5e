"""Near-duplicate documents: fast similarity sketches, banding, and exact verification.

A document's set is its distinct 5-word shingles. Its sketch has ``COORDINATES`` places. In round ``r`` every
element is put into one hashed place with a hashed value; a place keeps its least value, and earlier rounds win. A
sketch is ready when all places are filled, which takes a few rounds however small the set is; from round ``t`` on each round
fills one place from all elements, so ``2 t`` rounds always do. Two places are equal with the sets' similarity as
probability, with concentration as for sampling without replacement. With 32 bands of 4 places a pair of similarity 0.75 shares
no band with probability 5e-6, one of 0.8 with 5e-8.

Documents with equal sets become one *set* first, so copies never form pairs. Within a bucket (band and
value) the sets are compared with one leader only, that which shares most buckets with others. Where they are then not all
connected, sets of different components are compared by what they share with the leader and what they share beside it: a pair
that can be similar by the leader's elements alone is found by its counts, any other by a rare element (prefix filter). No
pair of a bucket is skipped unless its two sets are known to be connected or cannot be similar. Links are confirmed on full sets.

Defined results: a NULL text, an empty one or one without words has an empty set and is linked with nothing; rows with a NULL
doc_id are linked with nothing (``component_id`` NULL, ``kept``); rows that repeat a doc_id are one
document, linked if any of its texts is; an empty table gives an empty result. Other columns are never read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.tables import passing_tables, written
from stowage.llm.texts import U64, mix, pieces, seeds, shingle_hashes, word_hashes, words

COORDINATES, BANDS = 128, 32
ROWS = COORDINATES // BANDS
#: 4 MiB of bitmaps.
FILTER_BITS = 1 << 25
ROUND_SEEDS, BAND_FACTORS, SET_SEEDS = seeds(2 * COORDINATES, 21), seeds(ROWS, 22) | U64(1), seeds(2, 23)
BIN_SHIFT, VALUE_BITS = U64(57), U64(56)
VALUE_MASK = (U64(1) << VALUE_BITS) - U64(1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit values."""
    t = COORDINATES
    least = np.full(t, np.iinfo(np.uint64).max, U64)
    for r in range(2 * t):
        x = mix(elements ^ ROUND_SEEDS[r])
        value = (U64(r) << VALUE_BITS) | (x & VALUE_MASK)
        if r < t:
            np.minimum.at(least, (x >> BIN_SHIFT).astype(np.intp), value)
        else:
            least[r - t] = min(least[r - t], value.min())
        if least.max() >> VALUE_BITS <= U64(r) and least.max() != np.iinfo(np.uint64).max:
            break
    return least


def band_values(places: np.ndarray) -> np.ndarray:
    return mix((places.reshape(BANDS, ROWS) * BAND_FACTORS).sum(axis=1, dtype=U64)).view(np.int64)


def set_id(elements: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join(mix(elements ^ s).sum(dtype=U64).tobytes() for s in SET_SEEDS)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle values of every text."""
    for _, _, data, offsets in pieces(column):
        starts, ends, first = words(data, offsets)
        values, begin = shingle_hashes(word_hashes(data, starts, ends), first)
        for a, b in zip(begin[:-1], begin[1:]):
            yield np.unique(values[a:b])


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ids, bands = [], [], []
        for elements in sets_of(batch.column(1)):
            sizes.append(len(elements))
            ids.append(set_id(elements) if len(elements) else None)
            bands.append(band_values(sketch(elements)) if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_id", "bands"],
        )


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets = [], []
        for elements in sets_of(batch.column(0)):
            ids.append(set_id(elements))
            sets.append(elements.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "elements"])


def components(links: DataFrame) -> DataFrame:
    """``(id, label)``: the least id of every linked id's component, for links ``(a, b)``.

    Every step takes the least label around and then the label's own label, so chains shorten by half.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("id", "near").distinct()
    both = written(both, "links")
    state = both.groupBy("id").agg(F.min("near").alias("label")).select("id", F.least("id", "label").alias("label"))
    state = written(state, "labels")
    while True:
        near = both.join(state.select(F.col("id").alias("near"), F.col("label").alias("near_label")), "near").groupBy("id").agg(F.min("near_label").alias("least"))
        better = state.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        own = better.select(F.col("id").alias("label"), F.col("label").alias("label2"))
        state = written(better.join(own, "label", "left").select("id", "old", F.coalesce("label2", "label").alias("label")), "labels")
        if state.filter("old != label").isEmpty():
            return state.select("id", "label")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, by their full intersection."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("elements").alias(f"of_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    counted = both.select("a", "b", F.size("of_a").alias("m"), F.size("of_b").alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("i"))
    return counted.filter(100 * F.col("i") >= percent * (F.col("m") + F.col("n") - F.col("i"))).select("a", "b")


def can_be_similar(percent: int):
    """Sets whose sizes alone rule the similarity out are not compared."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return 100 * small >= percent * large


def mixed_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one label."""
    per = members.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    return members.join(per.select("band", "value"), ["band", "value"], "left_semi")


def overlap_needed(m, n, percent: int):
    """The least intersection of similar sets of ``m`` and ``n`` elements."""
    return F.ceil(percent * (m + n) / (100 + percent))


def with_leaders(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Sets against their leader: ``inside`` of their elements are the leader's, ``outside`` are the others, and ``least``
    have to be common with any set of the family that is similar."""
    own = sets.select("set_id", "elements")
    of_leader = sets.select(F.col("set_id").alias("leader"), F.col("elements").alias("led_by"))
    sizes = family.groupBy("leader").agg(F.min("n_shingles").alias("n_min"))
    smallest = F.greatest("n_min", F.ceil(percent * F.col("n_shingles") / 100))
    both = family.join(own, "set_id").join(of_leader, "leader").join(sizes, "leader")
    return both.select(
        "leader", "set_id", "label", "n_shingles", F.size(F.array_intersect("elements", "led_by")).alias("inside"),
        F.array_except("elements", "led_by").alias("outside"), overlap_needed(F.col("n_shingles"), smallest, percent).alias("least"),
    )


def as_side(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in rows.columns if c not in keys])


def sharing_outside(families: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different labels that share an element their leader lacks, and may be similar.

    What is common inside the leader is at most the smaller ``inside``, so the rest of the overlap needed is common outside.
    With elements in order of their holders, rarest first, the pair then shares one of those that come before the last ones of
    each set, as many as it needs less one. Elements that only one label holds are common to no such pair.
    """
    spread = written(families.select("leader", "set_id", "label", "n_shingles", "inside", "least", F.explode("outside").alias("element")), "outside")
    holders = spread.groupBy("leader", "element").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("holders"))
    known = spread.join(holders.filter("lo != hi").drop("lo", "hi"), ["leader", "element"])
    per = known.groupBy("leader", "set_id", "label", "n_shingles", "inside", "least")
    per = per.agg(F.sort_array(F.collect_list(F.struct("holders", "element"))).alias("rare")).withColumn("outside", F.size("rare"))
    count = (F.col("outside") + 1 - F.greatest(F.col("least") - F.col("inside"), F.lit(1))).cast("int")
    ahead = per.filter(count > 0).select("leader", "set_id", "label", "n_shingles", "inside", "outside", F.explode(F.slice("rare", F.lit(1), count)).alias("e"))
    ahead = written(ahead.withColumn("element", F.col("e.element")).drop("e"), "rare")
    keys = ["leader", "element"]
    most = F.least("inside_a", "inside_b") + F.least("outside_a", "outside_b")
    both = as_side(ahead, "a", keys).join(as_side(ahead, "b", keys), keys).filter("set_id_a < set_id_b AND label_a != label_b")
    return both.filter(most >= overlap_needed(F.col("n_shingles_a"), F.col("n_shingles_b"), percent)).select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))


def sharing_inside(families: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different labels that may be similar by elements of their leader alone.

    That depends on two counts of each set, so these are compared first, and sets only where they allow it.
    """
    able = families.filter("inside >= least").select("leader", "set_id", "label", "n_shingles", "inside")
    kinds = written(able.groupBy("leader", "n_shingles", "inside").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "kinds")
    both = as_side(kinds, "a", ["leader"]).join(as_side(kinds, "b", ["leader"]), "leader")
    both = both.filter(F.least("lo_a", "lo_b") != F.greatest("hi_a", "hi_b"))
    both = both.filter(F.least("inside_a", "inside_b") >= overlap_needed(F.col("n_shingles_a"), F.col("n_shingles_b"), percent))
    both = both.select("leader", "n_shingles_a", "inside_a", "n_shingles_b", "inside_b")
    found = both.join(as_side(able, "a", ["leader"]), ["leader", "n_shingles_a", "inside_a"])
    found = found.join(as_side(able, "b", ["leader"]), ["leader", "n_shingles_b", "inside_b"]).filter("set_id_a < set_id_b AND label_a != label_b")
    return found.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))


def only_likely(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hashed doc_id is one of those in ``needed``, so that few texts of others are shuffled.

    A bitmap of fixed size, so it lets the more through the more there are, and the join after it decides.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1  # places of bitmaps count from 1
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    filters = needed.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(bitmap)
    byte = F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))
    inside = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("bit") % 8).cast("int")) == 1
    placed = docs.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place))
    return placed.join(F.broadcast(filters), "bucket").filter(inside).select(docs.columns)


def set_links(sketches: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between set ids that connect all sets which verified pairs of any bucket connect."""
    spark = docs.sparkSession
    named = sketches.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    reps = named.groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    places = reps.select("set_id", "n_shingles", "rep", F.posexplode("bands").alias("band", "value"))
    shared = places.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(places.join(shared, ["band", "value"]), "met")
    # A set that meets many others is most likely the one that they are copies of.
    degrees = met.groupBy("set_id").agg(F.sum("n").alias("degree"))
    members = written(met.join(degrees, "set_id"), "buckets")

    needed = written(members.select(F.col("rep").alias("doc_id")).distinct(), "needed")
    likely = only_likely(docs, needed)
    whole = likely.join(needed, "doc_id", "left_semi").select("text").mapInArrow(with_sets, "set_id binary, elements array<long>")
    wanted = members.select("set_id").distinct()
    sets = written(whole.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")

    central = F.max(F.struct("degree", "set_id", "n_shingles"))
    leading = members.groupBy("band", "value").agg(central.alias("c")).select("band", "value", F.col("c.set_id").alias("leader"), F.col("c.n_shingles").alias("n_a"))
    led = written(members.join(leading, ["band", "value"]), "led")
    first = led.filter("set_id != leader").withColumnRenamed("n_shingles", "n_b").select("leader", "set_id", "n_a", "n_b").distinct()
    first = first.filter(can_be_similar(percent)).select(F.col("leader").alias("a"), F.col("set_id").alias("b"))
    links = written(verified(first, sets, percent), "links")
    # A bucket of two sets is done. Of the others, those that are not all connected are compared without their leaders.
    labels = components(links).withColumnRenamed("id", "set_id")
    labelled = written(led.filter("n > 2").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "labelled")
    family = written(mixed_buckets(labelled).select("leader", "set_id", "label", "n_shingles").distinct(), "family")
    compared = written(with_leaders(family, sets, percent), "families")
    pairs = written(sharing_outside(compared, percent).union(sharing_inside(compared, percent)).distinct(), "pairs")
    return links.union(written(verified(pairs, sets, percent), "links"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.select("doc_id", "text")
    sketches = written(docs.mapInArrow(sketched, "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketches")
    own = sketches.select("doc_id", "set_id").filter("set_id IS NOT NULL AND doc_id IS NOT NULL").distinct()
    with passing_tables(docs.sparkSession):
        links = set_links(sketches, docs, percent)
        # Sets of one repeated doc_id belong together.
        per_id = own.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
        links = links.union(own.join(per_id, "doc_id").filter("set_id != a").select("a", F.col("set_id").alias("b")))
        labels = written(components(links).withColumnRenamed("id", "set_id"), "labels", keep=True)
    classed = own.join(labels, "set_id", "left").select("doc_id", "set_id", F.coalesce("label", "set_id").alias("label"))
    classes = classed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = classed.select("set_id", "label").distinct().join(classes, "label").select("set_id", "component_id")
    return (
        sketches.join(of_set, "set_id", "left")
        .withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one_per_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with all their columns."""
    dropped = near_duplicates(docs, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def groups_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
