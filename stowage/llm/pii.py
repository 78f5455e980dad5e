"""Personal data: fixed formats first, then candidates judged by boosted trees.

The base finds e-mail addresses, IP addresses, card and phone numbers by their formats. Generators with high recall propose further
spans, which may overlap: long tokens, values behind ``=`` or ``:``, digit groups, written-out addresses. Boosted
trees score a candidate from its format (length, kinds of characters, variety, separators) and its context (words before it).
The threshold of each kind is calibrated on all candidates; accepted spans that do not touch a base span are
added, the higher score first. Base spans always stay.

Each text is scanned once, whole, without a shuffle, into a narrow table of base spans and described candidates. Everything else reads that table. The trees are
fitted on at most ``SAMPLE`` candidates of each kind and label, chosen by hash, so that a kind counts however rare it is; each task hands on no more than that. Thresholds
come from histograms of scores per kind and label, counted over all candidates and added up. There is a model whatever the candidates are.

Training needs no labels: a candidate is positive when its format is that of a known secret or identifier or a base format, or when a cue word names it, and
negative otherwise. To keep the cue from being everything, it is hidden from every second positive of the sample.

Defined results: NULL and empty texts have no spans; repeated rows and NULL ids are scanned row by row; ties between candidates go to the
earlier, then the longer one; very long texts and tokens take time in proportion to their length; an empty table gives an empty result. Positions count
code points, ends are exclusive. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.tables import written
from stowage.operators.ranking import top_within

Span = tuple[str, int, int]

KINDS = ("email", "ip", "card", "phone", "secret")
# The base formats (fixed values).
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# From the beginning of a run of digits only: from within one, it would match no more and no less.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates of each kind and label that the trees are fitted on, at most.
SAMPLE = 2_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, PENALTY = 40, 3, 0.3, 32, 3, 1.0
PRECISION, SCORE_BINS = 0.98, 1000


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(number: str) -> bool:
    values = [int(c) for c in reversed(number)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """A match is tied to its @, so the local part is found backwards from there."""
    done, at = 0, text.find("@")
    while at >= 0:
        rest = EMAIL_REST.match(text, at)
        start = at
        while start > done and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        if rest and start < at:
            yield "email", start, rest.end()
            done = rest.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base formats, kind by kind; failing matches are dropped without another try."""
    found = list(emails(text)) if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(n := digits_of(m[0])) <= 19 and passes_luhn(n)]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


GENERATORS: tuple[tuple[str, re.Pattern, tuple[str, ...]], ...] = (
    # kind, pattern, and texts of which one must be there for the pattern to match; all take linear time
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}"), ()),
    ("secret", re.compile(r"(?<=[=:])[\x20]?[\"']?([^\s\"'=:]{8,}+)"), ()),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+"), ("(at", "[at")),
    ("phone", re.compile(r"(?<![0-9.+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), ()),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"), ()),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), (":",)),
)
KNOWN = re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{20,}|[0-9a-f]{32,64}")
CUE = re.compile(r"(?i)(?:pass(?:word|wd)?|token|secret|api[_-]?key|access[_-]?key|auth|mail|phone|tel|call|card|iban|ssn)\W{0,8}$")
HAS_DIGIT = re.compile(r"[0-9]")


def candidates(text: str) -> list[Span]:
    """Proposed spans of all generators; they may overlap. A long token counts if it holds a digit."""
    found = set()
    for number, (kind, pattern, needs) in enumerate(GENERATORS):
        if not needs or any(n in text for n in needs):
            spans = (m.span(m.lastindex or 0) for m in pattern.finditer(text))
            found.update((kind, a, b) for a, b in spans if number or HAS_DIGIT.search(text, a, b))
    return sorted(found, key=lambda s: (s[1], -s[2], s[0]))


def describe(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    value, before = text[start:end], text[max(0, start - 24) : start]
    n = len(value)
    count = lambda test: sum(map(test, value)) / n
    return [
        KINDS.index(kind), n, count(str.isdigit), count(str.isupper), count(str.islower), len(set(value)) / n,
        sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:])) / n, sum(not c.isalnum() for c in value),
        len(digits_of(value)), max((len(x) for x in re.split(r"[0-9\W_]+", value)), default=0),
        float(n <= 64 and passes_luhn(digits_of(value) or "1")), float(bool(CUE.search(before))), float(before[-1:] in "=:\"'"), float("=" in before[-4:]),
    ]


CUE_AT, FEATURES = (11, 12, 13), 14


@dataclass
class Trees:
    """Gradient-boosted trees of fixed depth over binned features, and a threshold for each kind."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.binned(x), np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.intp)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(x)), features[node]] > cuts[node])
            total += leaves[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        bins, total = self.binned(x), np.full(len(x), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            features, cuts, node = np.zeros(2**DEPTH - 1, np.intp), np.full(2**DEPTH - 1, BINS + 1), np.zeros(len(x), np.intp)
            for level in range(DEPTH):
                for here in range(2**level - 1, 2 ** (level + 1) - 1):
                    self.split(bins, g, h, np.flatnonzero(node == here), here, features, cuts)
                node = 2 * node + 1 + (bins[np.arange(len(x)), features[node]] > cuts[node])
            leaf = node - (2**DEPTH - 1)
            sums = [np.bincount(leaf, v, 2**DEPTH) for v in (g, h)]
            leaves = -RATE * sums[0] / (sums[1] + PENALTY)
            self.trees.append((features, cuts, leaves))
            total += leaves[leaf]
        return self

    @staticmethod
    def split(bins, g, h, rows, here, features, cuts) -> None:
        """The best cut of a node by the gain of the second-order loss; none if no cut leaves enough rows on both sides."""
        best = 1e-6
        for j in range(bins.shape[1]):
            n, sg, sh = (np.cumsum(np.bincount(bins[rows, j], w, BINS + 1)) for w in (None, g[rows], h[rows]))
            gain = sg**2 / (sh + PENALTY) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + PENALTY) - sg[-1] ** 2 / (sh[-1] + PENALTY)
            gain[(n < LEAST_LEAF) | (n[-1] - n < LEAST_LEAF)] = 0
            if gain.max() > best:
                best, features[here], cuts[here] = gain.max(), j, gain.argmax()


def weak_label(text: str, span: Span, in_base: bool) -> bool:
    kind, start, end = span
    if in_base:
        return True
    if kind == "secret":
        return bool(KNOWN.fullmatch(text[start:end])) or bool(CUE.search(text[max(0, start - 24) : start]) and HAS_DIGIT.search(text[start:end]))
    return kind in ("email", "ip", "phone") or bool(CUE.search(text[max(0, start - 24) : start]))


# ---------------------------------------------------------------- the table of candidates

FOUND = "base array<int>, spans array<int>, x array<double>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its base spans (kind, start, end), its candidates (kind, start, end, label) and their features, each as one flat list."""
    for batch in batches:
        columns: list[list] = [[], [], []]
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            proposed = candidates(text)
            covered = _Cover(base)
            columns[0].append([v for k, a, b in base for v in (KINDS.index(k), a, b)])
            columns[1].append([v for s in proposed for v in (KINDS.index(s[0]), s[1], s[2], int(weak_label(text, s, covered.holds(s[1], s[2]))))])
            columns[2].append([v for s in proposed for v in describe(text, s)])
        types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "base", "spans", "x"])


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans, x`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, {FOUND}")


class _Cover:
    """Spans merged into disjoint ones, for quick tests."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] <= a and b <= self.ends[i]

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


# ---------------------------------------------------------------- the model


def train(found: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` candidates of each kind and label."""
    i = F.sequence(F.lit(0), (F.size("spans") / 4).cast("int") - 1)
    one = lambda n: F.struct(
        F.get("spans", 4 * n).alias("kind"), F.get("spans", 4 * n + 3).alias("label"),
        F.xxhash64("doc_id", F.get("spans", 4 * n + 1)).alias("h"), F.slice("x", FEATURES * n + 1, FEATURES).alias("x"),
    )
    rows = found.filter(F.size("spans") > 0).select(F.inline(F.transform(i, one)))
    rows = top_within(rows, ["kind", "label"], [F.col("h"), F.col("x")], sample).select("label", "x").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, FEATURES)
    y = rows.column("label").to_numpy().astype(float)
    if not len(x):  # no candidate anywhere, so nothing to score
        return Trees()
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    hidden = np.flatnonzero(y)[::2]
    x[np.ix_(hidden, CUE_AT)] = 0
    return Trees().fit(x, y)


def _scored(model: Trees, column: pa.Array) -> np.ndarray:
    """Scores of all candidates of a batch at once."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return model.scores(x) if len(x) else np.zeros(0)


def calibrated(found: DataFrame, model: Trees) -> Trees:
    """``model`` with a threshold for each kind: the lowest score from which on candidates are precise; certain ones only where there are none."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            bins = np.minimum((_scored(shared.value, batch.column(1)) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
            keys, n = np.unique(np.stack([spans[:, 0], bins, spans[:, 3]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, j], pa.int32()) for j in range(3)), pa.array(n)], ["kind", "bin", "label", "n"])

    counts = found.select("spans", "x").mapInArrow(counted, "kind int, bin int, label int, n long")
    histogram = np.zeros((len(KINDS), SCORE_BINS, 2))
    for r in counts.groupBy("kind", "bin", "label").agg(F.sum("n").alias("n")).collect():  # at most 2 x kinds x bins
        histogram[r.kind, r.bin, r.label] = r.n
    for number, kind in enumerate(KINDS):
        upto = np.cumsum(histogram[number, ::-1], axis=0)[::-1]
        precise = (upto[:, 1] >= PRECISION * upto.sum(axis=1)) & (upto[:, 1] > 0)
        model.thresholds[kind] = max(0.5, float(precise.argmax()) / SCORE_BINS) if precise.any() else 0.99
    return model


def fitted(found: DataFrame) -> Trees:
    return calibrated(found, train(found))


# ---------------------------------------------------------------- spans


def chosen(base: list[Span], proposed: list[Span], scores: np.ndarray, model: Trees) -> list[Span]:
    """Accepted candidates that touch neither a base span nor one with a higher score."""
    covered, out = _Cover(base), []
    for i in np.argsort(-scores, kind="stable"):
        kind, start, end = proposed[i]
        if scores[i] >= model.thresholds[kind] and not covered.touches(start, end):
            covered.add(start, end)
            out.append(proposed[i])
    return out


def added_spans(text: str, base: list[Span], model: Trees) -> list[Span]:
    """The spans that the model adds to one text."""
    proposed = candidates(text)
    if not proposed:
        return []
    return chosen(base, proposed, model.scores(np.array([describe(text, s) for s in proposed])), model)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans by kind, the hash of the base spans, and all spans, of every row."""
    found = written(found_spans(docs), "candidates")
    return with_model(found, fitted(found))


def with_model(found: DataFrame, model: Trees) -> DataFrame:
    """The result for texts whose candidates are ``found``."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"]

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts, hashes, spans, at = [[] for _ in KINDS[:4]], [], [], 0
            scores = _scored(model, batch.column(3))
            for flat_base, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base = [(KINDS[k], a, b) for k, a, b in zip(flat_base[::3], flat_base[1::3], flat_base[2::3])]
                proposed = [(KINDS[k], a, b) for k, a, b in zip(flat[::4], flat[1::4], flat[2::4])]
                own, at = scores[at : at + len(proposed)], at + len(proposed)
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in base))
                hashes.append(sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + chosen(base, proposed, own, model)))
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.mapInArrow(spans_of, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def personal_data_query(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
