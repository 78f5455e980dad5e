"""Shared lines, the filter audit and spelling variants against brute force, with edge cases in every column."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from stowage.llm import filter_audit, line_dedup, variants
from test_llm import SCHEMA, edge_rows, with_clashes

BLANK = " \t\n\x0b\x0c\r"
SHARED = "  This line stands in very many documents\tof all kinds.  "


def line_rows():
    rng = random.Random(5)
    rows = [(i, f"own {i}\n{SHARED}\nunique {rng.random()} line that is long enough to count {i}\n", "en", "a", 1) for i in range(40)]
    rows += [(100 + i, f"{SHARED.upper()}\r\n{SHARED}", "en", "b", 1) for i in range(3)]  # upper case only, twice
    rows += [(200 + i, "é" * 39 + "\n" + "é" * 40 + "\n" + "x" * 40, "fr", None, 1) for i in range(5)]
    rows += [(300 + i, "four documents hold this line, and no other one does", "fr", None, 1) for i in range(4)]
    rows += [(None, SHARED + "\n" + "only rows without an id have this line, all of them", None, None, None)] * 6
    rows += [(500, "this line is in repeated rows of one document, which are counted", "de", "c", 1)] * 5
    return rows + edge_rows()


def key(line):
    return line.strip(BLANK).translate(str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower()))


def order(doc_id):
    return -1 if doc_id is None else doc_id


def lines_by_hand(rows, least=40, docs=5):
    holders = collections.defaultdict(list)
    for r, row in enumerate(rows):
        for k in {key(line) for line in (row[1] or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(row[0])
    keeper = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= docs}
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), row[0]) in (row[0], None)]
        out.append((row[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("filter_bytes", [32 << 20, 0])
def test_lines(spark, filter_bytes):
    rows = line_rows()
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumnsRenamed({"slot": "digests", "size": "row_id", "n": "id"})
    rules = line_dedup.LineRules(filter_bytes=filter_bytes)
    expected = lines_by_hand(rows)
    assert sum(r[2] for r in expected) > 40
    assert plain(line_dedup.line_report(docs.repartition(7), rules).collect()) == plain(expected)
    cut = line_dedup.without_shared_lines(docs, rules)
    assert cut.columns == docs.columns
    texts = [(r[0], None if row[1] is None else r[3]) for r, row in zip(expected, rows)]
    assert plain(cut.select("doc_id", "text").collect()) == plain(texts)


def test_lines_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_report(empty).collect() == []
    assert line_dedup.without_shared_lines(empty).columns == empty.columns


def test_only_suspected_lines_are_shuffled(spark):
    docs = spark.createDataFrame(line_rows(), SCHEMA)
    rules = line_dedup.LineRules()
    found = line_dedup.suspected(docs, line_dedup.repeat_filters(docs, rules), rules)
    held = collections.Counter(k for row in line_rows() for k in {key(x) for x in (row[1] or "").split("\n")} if len(k) >= 40)
    expected = sum(n for n in held.values() if n > 1)
    assert expected <= found.count() <= expected + 2


def test_filters_hold_what_was_put_and_little_else():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 50_000, np.uint64)
    bits = np.zeros(1 << 16, np.uint8)
    mask = np.uint64(len(bits) * 8 - 1)
    line_dedup.put(bits, hashes[:20_000], mask)
    for each in (bits, line_dedup.folded(bits)):
        found = line_dedup.holds(each, hashes, np.uint64(len(each) * 8 - 1))
        assert found[:20_000].all() and found[20_000:].mean() < 0.02
    few = np.zeros(1 << 16, np.uint8)
    line_dedup.put(few, hashes[:10], mask)
    assert len(line_dedup.folded(few)) <= 64


def test_keys_of_pieces():
    texts = ["", "a\n\n b\tc \r\n", "\n", "éé x", " \n \n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends, row = line_dedup.lines(data, offsets, 1)
    got = [(r, bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, row)]
    assert got == [(r, key(line)) for r, t in enumerate(texts) for line in t.split("\n") if key(line)]


# ---------------------------------------------------------------- audit


def audit_by_hand(rows, labels):
    first, parts = {}, collections.defaultdict(list)
    for doc_id, text, _, _, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, _, source, _ in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > first[t],
        }
        parts[source or ""].append(({k for k, v in fails.items() if v}, labels.get(doc_id, (0, 0))))
    out = []
    for part, docs in parts.items():
        total, lines = collections.Counter(), []
        for p in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(p, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                fail = sum(f in d[0] for d in docs)
                lost = [sum(d[1][i] for d in gone) for i in range(2)]
                lines.append([part, "".join(p), step, len(left), len(gone), fail - len(gone), sum(d[0] == {f} for d in docs), *lost])
        out += [(*line, total[line[1][line[2] - 1]]) for line in lines]
    return out


def audit_rows():
    rng = random.Random(7)
    pool = ["A Title In Capitals", "price $5 " + "w " * 250, " ".join(f"w{i}" for i in range(260)), "", "Plain words"]
    pool += [" ".join(rng.choice("abcdefgh") for _ in range(300)) + rng.choice(["", "#", " THE END OF IT"]) for _ in range(20)]
    rows = [(i, rng.choice(pool), "en", rng.choice(["a", "b", None, ""]), 1) for i in range(300)]
    return rows + [(i, pool[2], "en", "hot", 1) for i in range(1000, 1100)] + edge_rows()


def test_audit(spark):
    rows = audit_rows()
    labels = {i: (i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)}
    known = [(i, *l) for i, l in labels.items()] + [(3, None, None), (None, 1, 1), (99_999, 1, 1)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    counts = filter_audit.filter_counts(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(counts, "ABCDE", ["good", "toxic"])
    assert plain(got.collect()) == plain(audit_by_hand(rows, labels))


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = filter_audit.filter_counts(spark.createDataFrame([], SCHEMA), labels)
    assert filter_audit.audit(counts, "ABCDE", ["good", "toxic"]).collect() == []
    assert filter_audit.filter_counts(spark.createDataFrame(edge_rows(), SCHEMA), labels).count() > 0


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5])
def test_events_are_the_removal_steps_of_all_orders(total):
    orders = list(itertools.permutations(range(total)))
    steps = collections.Counter()
    for mask, step, rank, sign in filter_audit.removal_events(total):
        for r in range(rank, len(orders)):
            steps[mask, step, r] += sign
    expected = {
        (mask, next(s for s, f in enumerate(p, 1) if mask >> f & 1), r): 1 for mask in range(1, 1 << total) for r, p in enumerate(orders)
    }
    assert {k: v for k, v in steps.items() if v} == expected


def test_audit_of_other_chains(spark):
    counts = spark.createDataFrame([("p", 3, 4), ("p", 0, 1)], "part string, mask int, n long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(counts, "xy").collect()}
    assert got == {("xy", 1): (1, 4, 0, 4), ("xy", 2): (1, 0, 4, 4), ("yx", 1): (1, 4, 0, 4), ("yx", 2): (1, 0, 4, 4)}
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "yx")


# ---------------------------------------------------------------- variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_index_finds_all_words_at_distance_one():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    index = variants.PositionIndex(words)
    for word in [*words, "", "abbabbabbabb"]:
        found = [set(index.members(bits)) for bits in index.within_one(word)]
        assert [{words[j] for j in bits} for bits in found] == [{w for w in words if len(w) - len(word) == d and near(w, word)} for d in (0, 1, -1)]


@pytest.mark.parametrize("block_words", [1, 5, 2048])
def test_near_words_whatever_the_groups(spark, block_words):
    rng = random.Random(2)
    words = sorted({"common" * rng.randrange(2) + "".join(rng.choice("abé") for _ in range(rng.randrange(7, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = variants.near_words(df, variants.VariantRules(block_words=block_words)).collect()
    assert sorted((r.word, r.near) for r in got) == [(a, b) for a in words for b in words if near(a, b)]


def variants_by_hand(rows):
    count = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.UPPER.lower()))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    around = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in around.items() if v}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None))
    return out


def variant_rows():
    rng = random.Random(4)
    base = ["spelling", "variants", "Übersicht", "naïveté", "colourful", "abcdefgh"]
    changed = ["speling", "spellingg", "variant", "variantss", "übersicht", "naivete", "colorful", "colorfull", "abcdefg", "abcdefghi"]
    rows = [(i, " ".join(rng.choice(base).upper() if i % 9 == 0 else rng.choice(base) for _ in range(40)), "en", "a", 1) for i in range(60)]
    rows += [(1000 + i, " ".join(rng.choice(changed) for _ in range(4)) + " x1y2 tie-ties", "en", None, 1) for i in range(30)]
    # A chain of forms, ties, and a run as long as a text.
    rows += [(2000, "chained " * 300 + "chainedd " * 30 + "chaineddd " * 3 + "chaineddde chaineddde", None, None, None)]
    rows += [(2001, "aaaaaab " * 20 + "aaaaaac " * 20 + "aaaaaad " * 2, "en", "a", 1), (None, "nullnull nullnulll " * 3, "en", "a", 1)]
    return rows + [(3000 + i, "z" * 40_000 + "yx"[i % 2], "en", "a", 1) for i in range(4)] + edge_rows()


def test_variants(spark):
    rows = variant_rows()
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumnsRenamed({"s": "run", "t": "word", "k": "id"})
    got = variants.variants(docs.repartition(3))
    expected = variants_by_hand(rows)
    assert len({r[2] for r in expected if r[1]}) >= 5
    assert plain(got.collect()) == plain(expected)


def test_variants_of_nothing(spark):
    assert variants.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "lonesome lonesome", "en", "a", 1)], SCHEMA)
    rules = variants.VariantRules(erase=0)
    assert variants.variants(one, rules).collect() == [("lonesome", None, "lonesome", 2, 0, None)]
    with pytest.raises(ValueError):
        variants.variants(one, variants.VariantRules(ratio=1))
