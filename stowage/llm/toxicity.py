"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

The chance that a document's grade exceeds ``k`` is ``sigmoid(score - threshold_k)``: one set of word weights is shared by all
thresholds, which are kept in order. Grades are 0 (not toxic), 1 and 2. ``labels`` says only whether a document is
toxic, so toxic training documents are graded by how many different tell-tale words they use: 2 from the median on, else 1.

The model is fitted on at most ``sample`` labelled documents, chosen by a hash of the id, a documented bound. Their
distinct word hashes go to the driver; words are kept as features if their document frequency differs clearly
between the classes. Scoring covers every document in its partition, without a shuffle.

Defined results: NULL, empty and wordless texts have the score of no features; repeated words count once; repeated rows and NULL ids
are scored row by row; without labels of both classes nothing is flagged and the severity is NULL; an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.texts import IS_SPACE, U64, pieces, word_hashes, words

SAMPLE, FEATURES, LEAST_DOCS = 16_000, 2_000, 4
STEPS, RATE, PENALTY = 400, 0.1, 1e-3
CHANCE = 0.5

BREAKS = IS_SPACE.copy()
BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True


@dataclass
class SeverityModel:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeds(self, scores: np.ndarray) -> np.ndarray:
        """The chances of a grade above 0, above 1, ..., one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -500, 500)))

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(bags))
        for i, bag in enumerate(bags):
            if len(bag) and len(self.features):
                at = np.minimum(np.searchsorted(self.features, bag), len(self.features) - 1)
                out[i] = self.weights[at[self.features[at] == bag]].sum()
        return out


def bags_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct word values of every text; words are runs of letters, digits and non-ASCII characters."""
    for _, _, data, offsets in pieces(column):
        starts, ends, first = words(data, offsets, BREAKS)
        hashes = word_hashes(data, starts, ends)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(hashes[a:b])


def telling_words(bags: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Words whose share of toxic documents is furthest from their share of the others, in standard errors."""
    values, index = np.unique(np.concatenate(bags), return_inverse=True)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    with_word = np.bincount(index, minlength=len(values))
    with_toxic = np.bincount(index, toxic[row], minlength=len(values))
    n, k = len(bags), toxic.sum()
    rate = with_word / n
    expected = rate * k
    error = np.sqrt(np.maximum(expected * (1 - k / n) * (1 - rate), 1e-9))
    z = np.where(with_word >= LEAST_DOCS, np.abs(with_toxic - expected) / error, 0)
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(values[best[z[best] > 4]])


def fit(bags: list[np.ndarray], toxic: np.ndarray) -> SeverityModel | None:
    """Full-batch gradient descent with momentum on the ordinal log-likelihood."""
    toxic = toxic.astype(float)
    if not len(bags) or not 0 < toxic.sum() < len(bags):
        return None
    features = telling_words(bags, toxic)
    at = [np.searchsorted(features, np.intersect1d(b, features, assume_unique=True)) for b in bags]
    row, col = np.repeat(np.arange(len(bags)), [len(a) for a in at]), np.concatenate(at).astype(np.intp)
    # Words that mark toxic documents count towards the grade.
    share = np.bincount(col, toxic[row], len(features)) / np.maximum(np.bincount(col, minlength=len(features)), 1)
    telling = np.bincount(row, (share > (1 + toxic.mean()) / 2)[col], len(bags))
    middle = np.median(telling[toxic > 0])
    grade = np.where(toxic > 0, 1 + (telling >= max(middle, 1)), 0).astype(int)
    n, levels = len(bags), 2
    weights, base, gap = np.zeros(len(features)), 2.0, 0.0
    state = [np.zeros(len(features) + 2), np.zeros(len(features) + 2)]
    for step in range(1, STEPS + 1):
        thresholds = np.array([base, base + np.exp(gap)])
        scores = np.bincount(row, weights[col], n)
        above = 1 / (1 + np.exp(np.clip(thresholds - scores[:, None], -500, 500)))
        bounded = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        upper, lower = bounded[np.arange(n), grade], bounded[np.arange(n), grade + 1]
        chance = np.maximum(upper - lower, 1e-9)
        slope = bounded * (1 - bounded)
        up, low = slope[np.arange(n), grade] / chance, slope[np.arange(n), grade + 1] / chance
        of_score = -(up - low) / n
        of_threshold = [((grade == k + 1) * up - (grade == k) * low).sum() / n for k in range(levels)]
        gradient = np.concatenate((
            np.bincount(col, of_score[row], len(features)) + PENALTY * weights / max(1, len(features)),
            [of_threshold[0] + of_threshold[1], of_threshold[1] * np.exp(gap)],
        ))
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, base, gap = weights - move[:-2], base - move[-2], gap - move[-1]
    return SeverityModel(features, weights, np.array([base, base + np.exp(gap)]))


def bags_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [b.view(np.int64) for b in bags_of(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.int64())), batch.column(1)], ["bag", "toxic"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SeverityModel | None:
    """A model from at most ``sample`` labelled documents, the same ones on every run."""
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    # Repeated ids could bring more rows; the bound holds for rows too.
    rows = texts.mapInArrow(bags_in, "bag array<long>, toxic int").limit(sample).toArrow()
    column = rows.column("bag").combine_chunks()
    bags = np.split(column.flatten().to_numpy().view(U64), np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []
    return fit(bags, rows.column("toxic").to_numpy())


def severity(docs: DataFrame, model: SeverityModel | None) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, grade, toxic`` of every row; ``grade`` is the most likely one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            if model is None:
                empty = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.array([False] * n)]
            else:
                above = model.exceeds(model.scores(list(bags_of(batch.column(1)))))
                steps = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
                likely = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
                empty = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(likely, pa.int32()), pa.array(above[:, 0] > CHANCE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *empty], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")


def severity_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return severity(docs, train(docs, labels))
