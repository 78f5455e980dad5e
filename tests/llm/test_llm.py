"""The operators for training text against brute force, with edge cases in every column."""

import collections
import hashlib
import os
import random
import re
import time
import weakref
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from stowage.llm import decontamination, mixing, near_dups, pii, quality, repeats, sharding, texts, token_counts, token_files, toxicity, vocabulary
from stowage.llm.registry import ORACLES, QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = os.environ.get("STOWAGE_TESTDATA", "/root/testdata/sf0.001")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use for helpers of their own.
CLASHING = ["row", "k", "t", "kept", "slot", "shard", "size", "s", "part", "label", "n"]


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    base = words(120, 1, 10**6)
    copy = base.split()
    copy[60] = "other"
    long = words(30_000, 3, 5_000)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(copy), None, "a", 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 4),
        (7, "one two", "de", None, 7),
        (8, "ONE Two", "de", "b", 7),
        (9, long, "fr", "c", len(long)),
        (9, long, "fr", "c", len(long)),
        (None, base, "en", "a", 1),
        (10, "x " * 300, "en", "a", 600),
        (11, "日本語 é <|endoftext|> ½ 's  \n ok", "ja", "日", 30),
    ]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def byte_words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = byte_words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def test_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracles(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    df = QUERIES[name](spark, DATA)
    cursor = connection.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


# 1: token counts


def test_whole_tokens_are_proven():
    whole = token_counts.whole_tokens(token_counts.read_tokenizer(WORD))
    assert len(whole) > 10_000 and "the" in whole and "the cat" not in whole


def test_token_counts(spark, edge, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rng = random.Random(5)
    letters = [chr(i) for i in range(0x180)] + ["'s", "'re", "é", "İ", "<|endoftext|>", "日本", "Σ", "　", " ", "\n"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60))), "x", "y", 1) for i in range(500)]
    df = edge.union(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(with_clashes(df), WORD).collect()))
    want = []
    for r in df.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty, WORD).count() == 0


# 2: quality rules


def test_quality_edges(edge, empty):
    report = {r.doc_id: r for r in quality.quality_report(with_clashes(edge).withColumnRenamed("kept", "kept_")).collect()}
    assert report[4].n_words == 0 and report[4].base_failed and not report[4].kept
    assert report[10].n_repeat_words == 300 and report[10].base_failed
    assert report[9].n_words == 30_000
    kept = quality.filter_quality(with_clashes(edge))
    assert kept.columns == [*edge.columns, *CLASHING]
    assert {1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert quality.quality_report(empty).count() == 0 and quality.filter_quality(empty).count() == 0


def test_repeated_windows_are_exact(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "a\n", "  ", "d "]) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(150)]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        w = text.split()
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (got[i].n_repeat_words, got[i].n_dup_lines) == (len(covered), len(lines) - len(set(lines)))


# 3: sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index([grid[:, k] for k in range(dims)], bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("table", ["edge", "given", "empty"])
def test_shards(request, table):
    df = request.getfixturevalue(table)
    rows = sharding.sharded(df).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.law == "rows" and r.grown_shard is None
    assert len(rows) == df.count()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    texts_of = collections.Counter((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert collections.Counter((r["size"], r.text_crc32) for r in rows) == texts_of


def curve_by_hand(point, bits=8):
    """The place of one point, bit by bit: each step undoes the turns of the cell that the higher bits have chosen."""
    x = list(point)
    for bit in range(bits - 1, 0, -1):
        for i in range(len(x)):
            low = (1 << bit) - 1
            if x[i] >> bit & 1:
                x[0] ^= low
            else:
                both = (x[0] ^ x[i]) & low
                x[0] ^= both
                x[i] ^= both
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = 0
    for bit in range(bits - 1, 0, -1):
        flip ^= (1 << bit) - 1 if x[-1] >> bit & 1 else 0
    out = 0
    for bit in range(bits - 1, -1, -1):
        for value in x:
            out = out << 1 | ((value ^ flip) >> bit & 1)
    return out


def test_shards_follow_the_curve(given):
    rows = [(r.doc_id, r.text or "", r.source, r.lang) for r in given.collect()]
    n = len(rows)

    def steps(values):
        counts, upto, out = collections.Counter(values), 0, {}
        for v in sorted(counts, key=lambda v: (v is not None, v or "")):
            upto += counts[v]
            out[v] = (2 * upto - counts[v]) * 256 // (2 * n)
        return out

    by_source, by_lang = steps([r[2] for r in rows]), steps([r[3] for r in rows])

    def place(row):
        data = row[1].encode()
        size = len(data) + 1
        point = by_source[row[2]], by_lang[row[3]], min(int(np.floor(np.log2(size) * 8)), 255)
        h = xxhash.xxh64_intdigest(data, seed=42)
        return curve_by_hand(point), h - (h >> 63 << 64), row[0], size, zlib.crc32(data)

    expected, start = {}, 0
    order = sorted(rows, key=place)
    for shard in range(16):
        stop = start + n // 16 + (shard < n % 16)
        expected |= {row[0]: (shard, slot) for slot, row in enumerate(order[start:stop])}
        start = stop
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(given).collect()}
    assert got == expected


def test_shard_files(edge, tmp_path):
    sharding.write_shards(edge, str(tmp_path / "out"), 4)
    assert sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("shard=")) == [f"shard={i}" for i in range(4)]


# 4: near duplicates


def groups(rows):
    sets = {r.doc_id: set(shingles(r.text)) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(n, seed):
    """Copies of one text with more and more words changed, so that only neighbours are similar."""
    text, rng, out = words(200, seed, 10**6).split(), random.Random(seed), []
    for _ in range(n):
        out.append(" ".join(text))
        text[rng.randrange(len(text))] = f"new{rng.random()}"
        text[rng.randrange(len(text))] = f"new{rng.random()}"
    return out


def test_near_duplicates(spark, given):
    made = [t for f in range(3) for t in family(25, f)] + ["a b", "A  b", "c", None, "", "same words here now ok", "same words here now ok"]
    df = given.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == groups(df.collect())


def test_near_duplicate_edges(edge, empty):
    rows = near_dups.near_duplicates(with_clashes(edge)).collect()
    assert len(rows) == len(edge_rows())
    got = {r.doc_id: (r.component_id, r.kept) for r in rows}
    assert got[2] == got[3] == (1, False) and got[None] == (None, True) and got[8] == (7, False)
    assert got[4] == (4, True) and got[5] == (5, True) and got[9] == (9, True)
    kept = near_dups.keep_one_per_group(with_clashes(edge))
    assert kept.columns == [*edge.columns, *CLASHING] and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 9, 10, 11, None}
    assert near_dups.near_duplicates(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for common, own in ((1500, 250), (1000, 1000)):
        a, b = pool[: common + own], np.concatenate((pool[:common], pool[common + own : common + 2 * own]))
        equal = (near_dups.sketch(a) == near_dups.sketch(b)).mean()
        assert abs(equal - common / (common + 2 * own)) < 0.15
    assert (near_dups.sketch(pool[:1]) != np.iinfo(np.uint64).max).all()


# 5: toxicity


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = words(80, i).split()
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            w[rng.randrange(80)] = rng.choice(["Nasty!", "vile", "awful."])
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(with_clashes(docs.drop("n_chars")), toxicity.train(docs, known)).collect()}
    held = [i for i in range(900) if i % 2]
    truth = {i: bool(re.search("Nasty|vile|awful", rows[i][1])) for i in held}
    assert np.mean([got[i].toxic == truth[i] for i in held]) > 0.97
    assert all(0 <= r.expected_severity <= 2 for r in got.values())


def test_severity_by_hand(spark, edge):
    """Every score from single words and one logistic function per threshold."""
    vocabulary = [f"w{i}" for i in range(400)] + ["x", "ok", "日本語", "s"]
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    starts, ends, _ = texts.words(data, np.array([0, len(data)]), toxicity.BREAKS)
    hashes = texts.word_hashes(data, starts, ends)
    order = np.argsort(hashes)
    weights = np.random.default_rng(2).normal(size=len(hashes))
    model = toxicity.SeverityModel(hashes[order], weights[order], np.array([0.3, 1.1]))
    of_word = dict(zip(vocabulary, weights))
    rows = [(i, words(50, i)) for i in range(50)] + [(r[0], r[1]) for r in edge_rows()]
    got = toxicity.severity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    for (doc_id, text), r in zip(rows, got):
        found = {w.lower() for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text or "")}
        score = sum(of_word.get(w, 0.0) for w in found)
        above = [1 / (1 + np.exp(t - score)) for t in (0.3, 1.1)]
        chances = [1 - above[0], above[0] - above[1], above[1]]
        assert r.doc_id == doc_id and abs(r.expected_severity - sum(above)) < 1e-9 and abs(r.p_toxic - above[0]) < 1e-9
        assert r.grade == int(np.argmax(chances)) and r.toxic == (above[0] > toxicity.CHANCE)


def test_fit_is_at_the_most_likely_thresholds():
    """Without telling words only the thresholds are left; they must reproduce the grades' shares."""
    rng = np.random.default_rng(5)
    toxic = (rng.random(4000) < 0.2).astype(int)
    model = toxicity.fit([rng.integers(1, 1 << 40, 3).astype(np.uint64) for _ in toxic], toxic)
    above = model.exceeds(np.zeros(1))[0]
    assert not len(model.features) and model.thresholds[0] < model.thresholds[1]
    assert abs(above[0] - toxic.mean()) < 0.01 and above[1] < 0.01  # none has a word that counts towards the second grade


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    assert model is None and not any(r.toxic for r in toxicity.severity(edge, model).collect())
    assert toxicity.severity(empty, None).count() == 0
    model = toxicity.fit([np.array([1, 2], np.uint64)] * 10 + [np.array([3], np.uint64)] * 30, np.array([1] * 10 + [0] * 30))
    assert toxicity.severity(edge, model).count() == len(edge_rows())


# 6: mixing


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        for s in over:
            target[s] = 2.0 * sizes[s]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("table", ["edge", "given"])
def test_mix(request, table):
    df = request.getfixturevalue(table)
    rows = mixing.mix_report(df).collect()
    assert len(rows) == df.count()
    sizes, source = collections.Counter(), collections.defaultdict(set)
    for r in df.collect():
        sizes[r.source] += len(byte_words(r.text))
        source[r.doc_id].add(r.source)
    target, taken = fair_targets(sizes), collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert any(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) for s in source[r.doc_id])
        if len(source[r.doc_id]) == 1:
            taken[next(iter(source[r.doc_id]))] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK + 0.01 * t
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_report(df).collect()))
    documents = mixing.mixed(with_clashes(df))
    assert documents.columns == [*df.columns, *CLASHING]
    of = lambda pairs: {k: v for k, v in pairs.items() if v}
    per_doc, want = collections.Counter(), collections.Counter()
    for r in documents.collect():
        per_doc[r.doc_id] += len(byte_words(r.text))
    for r in rows:
        want[r.doc_id] += r.taken
    assert of(per_doc) == of(want)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_words_of_null_texts(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        texts_ = spark.createDataFrame([(None,), ("",), (" \n",), (" a b\tc",)], "text string")
        assert [r[0] for r in texts_.select(mixing.word_count("text")).collect()] == [0, 0, 0, 3]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_mix_of_nothing(empty):
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).selectExpr("id AS i", f"{n}L AS n", "3L AS s", "1L AS pass")
        assert sorted(r[0] for r in df.select(mixing.permuted("i", "n", ["s", "pass"])).collect()) == list(range(n))


# 7: decontamination


def best_windows(docs, items, threshold=0.75):
    found = {}
    for item_id, item in items:
        n, counts = len(byte_words(item)), collections.Counter(shingles(item))
        for doc_id, doc in docs:
            all_, size = shingles(doc), max(n - 4, 1)
            if n >= 5 and counts.keys().isdisjoint(all_):
                continue
            if n < 5:
                w = byte_words(doc)
                runs = [(tuple(w[i : i + n]),) for i in range(len(w) - n + 1)] if len(w) >= 5 else [tuple(all_)]
            else:
                runs = [all_[i : i + size] for i in range(max(len(all_) - size, 0) + 1)]
            for run in runs if counts and all_ else []:
                mine = collections.Counter(run)
                common = sum((mine & counts).values())
                got = common / (sum(mine.values()) + sum(counts.values()) - common)
                if got >= threshold:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), got)
    return found


def test_decontamination(spark, given):
    rng = random.Random(9)
    items = [(i, words(rng.randrange(12, 60), 100 + i, 300)) for i in range(20)] + [(20, "only three words"), (21, None), (22, " "), (23, words(30, 100, 300))]
    docs = [(r.doc_id, r.text) for r in given.select("doc_id", "text").limit(60).collect()]
    for i, (_, item) in enumerate(items[:20]):
        w = item.split()
        if i % 3 == 1:
            w[-1] = "changed"
        if i % 3 == 2:
            w[len(w) // 2] = w[len(w) // 3] = "changed"
        docs.append((1000 + i, f"{words(40, i)} {' '.join(w)} {words(30, i + 50)}"))
    docs += [(2000, "so only three words in it"), (2001, "Only three WORDS"), (2002, None), (2003, ""), (2003, items[0][1]), (2004, items[0][1] + " " + items[0][1])]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(with_clashes(frame), table).collect()}
    want = best_windows(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    clean = decontamination.without_contaminated(with_clashes(frame), table)
    assert clean.columns == ["doc_id", "text", *CLASHING]
    assert clean.filter("doc_id != 2003").count() == len({d for d, _ in docs} - {d for d, _ in want} - {2003})
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(frame, nothing).count() == 0
    assert decontamination.without_contaminated(frame, nothing).count() == len(docs)
    assert decontamination.contaminated(frame.limit(0), table).count() == 0


@pytest.mark.parametrize("size", [20, 40, 60, 100, 200])
@pytest.mark.parametrize("place", ["alone", "inside"])
def test_cut_items_are_found(size, place):
    """Documents with just over three quarters of an item's shingles, as one cut: none is missed."""
    rng, cases = random.Random(size), 400
    items = [(i, words(size, 7000 + i * 13 + size, 10**6)) for i in range(cases)]
    texts_ = []
    for _, item in items:
        w = item.split()
        # Alone, the document is its own window; inside another text, the window takes as many foreign words as are missing.
        need = -(-75 * (size - 4) // 100) + 4 if place == "alone" else -(-6 * (size - 4) // 7) + 4
        a = rng.randrange(size - need + 1)
        cut = w[a : a + need]
        texts_.append(" ".join(cut if place == "alone" else [*words(60, rng.random(), 10**6).split(), *cut, *words(60, rng.random(), 10**6).split()]))
    index = decontamination.Index(items, 0.75)
    found = list(index.of_column(pa.array(texts_)))
    missed = [i for i, m in enumerate(found) if i not in {item for item, _, _ in m}]
    assert [(i, texts_[i]) for i in missed if (i, i) in best_windows([(i, texts_[i])], [(i, items[i][1])])] == []
    assert len(missed) < cases / 20


# 8: personal data


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [("ip", *m.span())] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        total = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d))
        found += [("card", *m.span())] if 13 <= len(d) <= 19 and total % 10 == 0 else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [("phone", *m.span())] if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return found


def test_base_formats():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-+0129 ()Zé%_") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("card 4111 1111 1111 1111.") == [("card", 5, 24)]


def test_trees_learn_held_out_secrets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        plain = "".join(rng.choice("abcdefghij") for _ in range(20)) + "7"
        rows.append((i, f"{words(10, i)} token = \"{value}\" {words(5, i)} {plain} {words(5, i)}", "en", "s", 1))
    docs = spark.createDataFrame(rows[:200], SCHEMA)
    model = pii.fitted(pii.found_spans(docs))
    hits = false = 0
    for _, text, *_ in rows[200:]:
        spans = pii.added_spans(text, pii.base_spans(text), model)
        hits += any(len(text[a:b]) == 40 for _, a, b in spans)
        false += any(len(text[a:b]) == 21 for _, a, b in spans)
    assert hits > 190 and false < 5


def test_personal_data_edges(edge, empty):
    rows = pii.personal_data(with_clashes(edge)).collect()
    assert len(rows) == len(edge_rows())
    assert {r.base_sha256 for r in rows if r.doc_id in (4, 5)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(empty).count() == 0
    assert pii.redacted("mail a@b.c now", [("email", 5, 10)]) == "mail [email] now"


def spans_by_hand(rows, model):
    """All spans, text by text and candidate by candidate."""
    out = []
    for doc_id, text in rows:
        taken = list(pii.base_spans(text or ""))
        proposed = [(s, model.scores(np.array([pii.describe(text, s)]))[0]) for s in pii.candidates(text or "")]
        for s, score in sorted(proposed, key=lambda x: -x[1]):
            if score >= model.thresholds[s[0]] and all(s[2] <= a or b <= s[1] for _, a, b in taken):
                taken.append(s)
        out.append((doc_id, pii.joined(taken)))
    return out


def rare_rows():
    """Secrets in one of 500 documents, a kind that only one document has, and tokens that are none."""
    rng, rows = random.Random(9), []
    for i in range(2000):
        text = f"{words(30, i)} see {words(1, i)}-{''.join(rng.choice('abcdefghij') for _ in range(18))}4 {words(10, i + 7)}"
        if i % 500 == 3:
            text += " api_key = " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + " end"
        if i == 77:
            text += " write to jane (at) example (dot) org or 555-123-4567"
        rows.append((i, text))
    return rows + [(5000, None), (5001, ""), (5001, "mail a@b.cd 1.2.3.4"), (None, "4111 1111 1111 1111 token: abcdef0123456789abcdef")]


def test_rare_secrets_are_found(spark):
    rows = rare_rows()
    found = pii.found_spans(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).cache()
    model = pii.fitted(found)
    got = [(r.doc_id, r.spans) for r in pii.with_model(found, model).collect()]
    assert sorted(got, key=repr) == sorted(spans_by_hand(rows, model), key=repr)
    with_secret = {i for i, spans in got if "secret" in spans}
    assert {3, 503, 1003, 1503} <= with_secret and len(with_secret) <= 6
    assert "email:" in dict(got)[77] and "phone:" in dict(got)[77]


def test_candidates_of_one_label_still_give_a_model(spark):
    rows = [(i, f"token = {'0123456789abcdef' * 2}{i:08}") for i in range(30)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("secret" in r.spans for r in got)


@pytest.mark.parametrize("text", ["7" * 10**6, "a1" * 500_000, "1.2." * 250_000, "ab." * 300_000 + "(at) x.y", "+1 " * 300_000, "x=" * 500_000, "4111 " * 200_000])
def test_long_unbroken_texts_take_linear_time(text):
    start = time.perf_counter()
    base, proposed = pii.base_spans(text), pii.candidates(text)
    for s in proposed[:3]:
        pii.describe(text, s)
    assert time.perf_counter() - start < 4 and all(0 <= a < b <= len(text) for _, a, b in base + proposed)


# 9: repeated passages


def removed(rows):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49 if i is not None else 0):
            first[data[p : p + 50]] = min(first.get(data[p : p + 50], i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49 if i is not None else 0):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone) if not g)))
    return sorted(map(repr, out))


def test_repeats(spark, given):
    rng = random.Random(6)
    passage, unit = words(40, 77), "ab" * 400
    rows = [(r.doc_id, r.text) for r in given.select("doc_id", "text").limit(80).collect()]
    for i in range(30):
        a, b = sorted(rng.randrange(len(passage)) for _ in range(2))
        rows.append((1000 + rng.randrange(20), f"{words(8, i)}{passage[a:b]}{words(8, i + 500)}"))
    rows += [(2000, unit), (2001, "x" + unit[:333] + "y"), (2002, "é" * 60), (2003, "z" + "é" * 30), (2004, "é" * 24), (None, passage), (2005, None), (2006, ""), (2000, unit)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(with_clashes(df)).collect()]
    assert sorted(map(repr, got)) == removed(rows)


def test_repeats_of_edges(edge, empty):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(edge).collect()]
    assert sorted(map(repr, rows)) == removed([(r[0], r[1]) for r in edge_rows()])
    assert repeats.without_repeats(empty).count() == 0


def test_common_prefixes_come_from_the_transform():
    rng = random.Random(8)
    for round_ in range(40):
        size = 40 if round_ % 2 else 4
        strings = ["".join(rng.choice("ab"[: 1 + round_ % 3]) for _ in range(rng.randrange(size))).encode() for _ in range(6)]
        symbols = np.array([c for s in strings for c in [*(x + 1 for x in s), 0]])
        own = [symbols[i : i + 1 + symbols[i:].tolist().index(0)].tolist() for i in range(len(symbols))]  # to the string's end
        for least in (1, 3, 5, 20):
            order = repeats.suffix_array(symbols, least)
            assert sorted(order.tolist()) == list(range(len(symbols)))
            begins = [own[i][:least] for i in order]
            assert begins == sorted(begins)
            assert repeats.long_prefix_starts(symbols, order, least).tolist() == [True] + [a != b for a, b in zip(begins, begins[1:])]


def test_intervals_start_at_the_width_that_sorting_knows():
    rng = random.Random(9)
    for letters in ("a", "ab", "abcdefgh", bytes(range(1, 200)).decode("latin-1")):
        unit = [rng.choice(letters) for _ in range(90)]
        strings = ["".join(unit[rng.randrange(30) : rng.randrange(30, 90)] + [rng.choice(letters) for _ in range(rng.randrange(9))]) for _ in range(40)]
        symbols = np.array([c for s in strings for c in [*(x + 1 for x in s.encode("latin-1")), 0]], np.int16)
        own = [symbols[i : i + 1 + symbols[i:].tolist().index(0)].tolist() for i in range(len(symbols))]
        for least in (1, 17, 50):
            order, known, starts = repeats.sorted_suffixes(symbols, least)
            assert known < least and (known or least < 50)
            begins = [own[i][:least] for i in order]
            assert begins == sorted(begins)
            found = repeats.long_prefix_starts(symbols, order, least, known, starts)
            assert found.tolist() == [True] + [a != b for a, b in zip(begins, begins[1:])]


def test_least_ids_of_strings_with_common_anchors():
    rng = random.Random(10)
    anchors = [words(5, i, 10**6)[:24] for i in range(1200)]
    strings = [f"{words(5, 9 * i)[:26]}{anchors[i % 1200]}{words(5, 7 * i, 9000)[:26]}".encode() for i in range(14_000)]
    least = repeats.least_ids(strings, np.arange(len(strings)))
    first: dict[bytes, int] = {}
    for i, s in enumerate(strings):
        for p in range(len(s) - 49):
            first.setdefault(s[p : p + 50], i)
    for i in rng.sample(range(len(strings)), 500):
        assert list(least[i].as_py()) == [first[strings[i][p : p + 50]] for p in range(len(strings[i]) - 49)]


# 10: token files


def test_encoder_asks_for_a_word_once_whatever_follows_it(monkeypatch):
    """Words that no table of pre-tokens keeps are known as pieces; ASCII ones are spelled without a table."""
    monkeypatch.setattr(token_files, "PRE_TOKENS_KEPT", 0)
    encoder, asked = token_files.Encoder(token_files.read_tokenizer(BYTE), "<u2"), collections.Counter()
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda t: asked.update([t]) or merge(t))
    # The first pre-token after a space is asked for through the encoder, as pieces.
    text = "a zymurgy zymurgy, zymurgy; zymurgy's zymurgy's, x_y (zymurgy) é é, 12 12% 'ü' ''s"
    got = np.frombuffer(encoder(text), "<u2").tolist()
    assert got == encoder.library.encode(text, add_special_tokens=False).ids
    assert asked[" zymurgy"] == 1 and asked[" é"] == 1 and asked[" 12"] == 1


def test_encoder_looks_a_piece_up_once_for_texts_taken_together(monkeypatch):
    """A word is asked for once for all texts, also when the table has no room for it."""
    monkeypatch.setattr(token_files, "PIECES_KEPT", 0)
    encoder, asked = token_files.Encoder(token_files.read_tokenizer(BYTE), "<u2"), collections.Counter()
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda t: asked.update([t]) or merge(t))
    lines = "a zymurgy zymurgy\nzymurgy zymurgy\n\nthe zymurgy"
    texts = [lines, None, "", "zymurgy", " zymurgy ", "x  zymurgy", "日本 zymurgy", lines, "\nzymurgy", "zymurgy\n", "\n\n", "\n", "no zymurgy"]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in encoder.each(pa.array(texts))]
    assert got == [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked[" zymurgy"] == 1


def test_encoder_gives_the_ids_of_the_library_around_line_ends_and_marks():
    encoder, rng = token_files.Encoder(token_files.read_tokenizer(BYTE), "<u2"), random.Random(8)
    parts = ["zymurgy", "é", "ß's", "don't", "'ll", "'", "###", ".", "7", "a_b", " ", " ", "\n", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x85", "日", "<|endoftext|>"]
    plain = [p for p in parts if p not in ("\t", "\r\n", "\xa0", "\x85", "日", "<|endoftext|>")]
    texts = ["".join(rng.choice(parts if i % 3 == 0 else plain) for _ in range(rng.randrange(14))) for i in range(6_000)]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in encoder.each(pa.array(texts))]
    assert got == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 1000, 1024, 3001])
def test_wavelet_matrix_of_several_runs(n, monkeypatch):
    monkeypatch.setattr(token_files, "DEALT", 512)
    ids = np.random.default_rng(n).integers(0, 1 << 18, n).astype(np.uint32)
    matrix = token_files.WaveletMatrix.build(ids, 18)
    assert (matrix.ids() == ids).all()
    assert all(matrix.access(i) == ids[i] for i in range(0, n, 97))


def test_wavelet_matrix():
    ids = np.random.default_rng(3).integers(0, 700, 5_000).astype(np.uint16)
    matrix = token_files.WaveletMatrix.build(ids, 10)
    assert (matrix.ids() == ids).all()
    for value in (0, 5, 699):
        assert matrix.occurrences(value) == np.flatnonzero(ids == value).tolist()
        assert matrix.rank(value, 1234) == (ids[:1234] == value).sum()
    assert [matrix.access(i) for i in range(0, 5_000, 111)] == ids[::111].tolist()
    with pytest.raises(IndexError):
        matrix.select(5, matrix.count(5))


def test_token_files(spark, edge, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    rng = random.Random(5)
    letters = [chr(i) for i in range(0x180)] + [" ", " ", "\n", "a", "'re", "é", "<|endoftext|>", "日"]
    rows = [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(60))), "x", "y", 1) for i in range(300)]
    df = edge.union(spark.createDataFrame(rows, SCHEMA))
    path = str(tmp_path / "files")
    token_files.write_token_files(with_clashes(df), path, BYTE, tokens_per_shard=1000)
    got = sorted(token_files.document_index(spark, path).collect(), key=lambda r: r.start)
    ids = {(r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in df.collect()}
    crcs = {(d, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for d, t in ids}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == crcs
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ends = token_files.token_places(spark, path, 2)
    assert ends.count() >= df.count()
    assert sum(r.n for r in token_files.token_count(spark, path, 2).collect()) == ends.count()
    assert token_files.token_output(empty, BYTE).count() == 0


def test_pipeline_frees_the_encoders_when_files_are_read_back(spark, edge, monkeypatch):
    mapped, over_rows = [], token_files.over_rows
    monkeypatch.setattr(token_files, "over_rows", lambda shards, each, schema: mapped.append(each) or over_rows(shards, each, schema))
    result = corpus_pipeline.token_stage(spark, edge, "")
    kept = weakref.ref(vocabulary.per_process(f"encoder_{BYTE}", lambda: token_files.Encoder(token_files.read_tokenizer(BYTE), "<u2")))
    matrix = token_files.WaveletMatrix.build(np.array([5, 2, 7, 9, 2], np.uint16), 10)
    row = {"part": 0, "shard": 0, "n_tokens": 5, "bits": 10, "doc_ids": [3, None], "lengths": [2, 3], "zeros": matrix.zeros, "planes": matrix.planes, "ones": matrix.ones}
    index = mapped[0](row)
    assert kept() is None
    assert index.offset.tolist() == [0, 2] and index.n_tokens.tolist() == [2, 3]
    assert result.count() == edge.count()


# Shared parts and the pipeline


def test_shingle_values():
    values = {}
    column = [r[1] for r in edge_rows()]
    rows = []
    for _, _, data, offsets in texts.pieces(pa.array(column)):
        starts, ends, first = texts.words(data, offsets)
        got, begin = texts.shingle_hashes(texts.word_hashes(data, starts, ends), first)
        rows += [got[a:b].tolist() for a, b in zip(begin, begin[1:])]
    for text, got in zip(column, rows, strict=True):
        want = shingles(text)
        assert len(want) == len(got)
        assert all(values.setdefault(w, g) == g for w, g in zip(want, got))
    assert len(set(values.values())) == len(values)


def test_pipeline(spark, given, monkeypatch):
    inputs = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            inputs[name] = docs
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    result = corpus_pipeline.run(spark, DATA)
    assert result.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert all(docs.columns == given.columns for docs in inputs.values())
    rows = {name: docs.collect() for name, docs in inputs.items()}
    ids = {name: [r.doc_id for r in found] for name, found in rows.items()}
    kept = quality.quality_report(given).filter("kept").select("doc_id")
    assert sorted(ids["near_dups"]) == sorted(r.doc_id for r in kept.collect())
    firsts = [i for i, (_, first) in groups(rows["near_dups"]).items() if i == first]
    assert sorted(ids["decontamination"]) == sorted(firsts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {d for d, _ in best_windows([(r.doc_id, r.text) for r in rows["decontamination"]], items)}
    assert sorted(ids["mixing"]) == sorted(set(firsts) - leaks)
    assert set(ids["token_files"]) <= set(ids["mixing"]) and len(ids["token_files"]) > 0
    assert sorted(r.doc_id for r in result.collect()) == sorted(ids["token_files"])


@pytest.mark.parametrize("table", ["edge", "empty", "extra"])
def test_pipeline_on_edge_rows(request, spark, tmp_path, table):
    docs = request.getfixturevalue("edge" if table == "extra" else table)
    long = spark.createDataFrame([(100 + i, words(150, 40 + i, 10**6), "en", None if i % 3 else "a", i) for i in range(9)] * 2, SCHEMA)
    docs = docs if table == "empty" else docs.union(long)
    docs = with_clashes(docs) if table == "extra" else docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(150, 41, 10**6)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, left = left, spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == (before.columns if name != "token_files" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    ids = {r.doc_id for r in left.collect()}
    if table == "empty":
        assert ids == set()
    else:
        # Junk and the leaked item are gone; the others stay, copies of one id among them.
        assert {100, 102, 103, 104, 105, 106, 107, 108} <= ids and not ids & {4, 5, 6, 7, 8, 10, 11, 101}


def test_near_dups_shuffle_the_texts_of_few_others(spark):
    from stowage.llm.near_dups import only_likely

    docs = spark.range(-500, 5000).selectExpr("id AS doc_id", "concat('t', id) AS text").union(spark.sql("SELECT cast(NULL AS BIGINT), 'n'"))
    needed = docs.filter("doc_id % 10 = 0").select("doc_id")
    found = only_likely(docs, needed)
    assert found.columns == ["doc_id", "text"] and needed.join(found, "doc_id", "left_anti").isEmpty()
    assert 550 <= found.count() < 600 and only_likely(docs, needed.limit(0)).isEmpty()


def test_near_dups_of_a_large_family_make_few_pairs(spark, monkeypatch):
    """Copies of one text with words of their own, some beyond the limit: shared rare words must not lead to all pairs."""
    rng, base, made = random.Random(5), words(150, 50, 10**6).split(), []
    for i in range(240):
        text = list(base)
        for place in rng.sample(range(len(text)), 2 if i % 2 else 6):
            text[place] = f"v{rng.randrange(40)}"
        made.append(" ".join(text))
    # Similar to one another by elements that the base lacks, and not to the base.
    apart = made[0].split()
    apart[:40] = words(40, 51, 10**6).split()
    made += [" ".join(base), " ".join(apart), " ".join([*apart[:-1], "end"]), " ".join(base[:100]), " ".join(base[:84]), " ".join(base[:70])]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    counts, verified = [], near_dups.verified

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(near_dups, "verified", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == groups(df.collect())
    assert sum(counts) < 10 * len(made)
