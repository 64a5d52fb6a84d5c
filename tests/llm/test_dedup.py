"""Substring dedup and near-dedup against brute force, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wavespark.llm import order_minhash, recompression
from wavespark.llm.words import WordHashes, find_words

VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    """Random texts, some with shared passages, copies, periodic parts and short ones."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice(VOCABULARY) for _ in range(k)]
    passages = [some(rng.randint(49, 120)) for _ in range(4)] + [["a"] * 130, ["a", "b"] * 70, (["x", "y", "z"] * 40)]
    docs: list[tuple[int, str | None]] = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two")]
    for i in range(n):
        words = some(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            at, cut = rng.randint(0, len(words)), rng.randint(0, 20)
            words[at:at] = p[cut:]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    docs += [(2000 + i, docs[10 + i][1]) for i in range(5)]
    rng.shuffle(docs)
    return docs


def by_force(docs, window=50):
    first: dict[tuple, int] = {}
    words = [(i, find_words(t or "")) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = recompression.remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == by_force(docs)


def test_symbols_of_equal_stretches_are_equal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        shared = rng.integers(0, 30, 80).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 30, rng.integers(1, 60)), shared, rng.integers(0, 30, 40)]).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 30, rng.integers(1, 60)), shared, rng.integers(0, 30, 9)]).astype(np.uint64)
        inside = []
        for x in (a, b):
            at = next(i for i in range(len(x)) if np.array_equal(x[i : i + 80], shared))
            name, lo, hi = recompression.recompressed(x, 4)
            assert (np.diff(lo) >= 0).all() and (np.diff(hi) >= 0).all()
            own = (lo >= at) & (hi <= at + 80)
            inside.append(list(zip(name[own].tolist(), (lo[own] - at).tolist(), (hi[own] - at).tolist(), strict=True)))
        assert inside[0] == inside[1] and inside[0]


def test_repeats_edges(spark):
    long = " ".join(VOCABULARY[:60])
    rows = [(None, long, 1), (None, long, 2), (1, long, 3), (1, long, 4), (2, long + " end", 5), (3, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    got = {r.gone: (r.n_words, r.n_removed, r.kept_text) for r in recompression.remove_repeats(spark, docs.withColumn("n_removed", docs.gone)).collect()}
    assert got == {1: (60, 0, long), 2: (60, 0, long), 3: (60, 0, long), 4: (60, 0, long), 5: (61, 60, "end"), 6: (0, 0, "")}
    assert recompression.remove_repeats(spark, docs.limit(0)).count() == 0
    back = {r.gone: r.text for r in recompression.without_repeats(spark, docs).collect()}
    assert back[5] == "end" and back[6] is None and back[1] == long


def edits(a, b):
    """Edit distance, the plain way."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(9)
    for _ in range(150):
        a = [rng.randint(0, 8) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randint(0, 8) for _ in range(rng.randint(0, 2))]
        d, x, y = edits(a, b), np.array(a, np.int32), np.array(b, np.int32)
        assert order_minhash.edits_within(x, y, 40) == d
        assert order_minhash.edits_within(x, y, d) == d
        assert d == 0 or order_minhash.edits_within(x, y, d - 1) is None
        if d:
            assert order_minhash._banded(a, b, max(d, abs(len(a) - len(b)))) == d
    for n in (500, 1500):  # beyond the first band
        x = np.array([rng.randint(0, 10**6) for _ in range(n)], np.int32)
        y = np.delete(x, range(7, n, 6)).astype(np.int32)
        assert order_minhash.edits_within(x, y, n // 5) == n - len(y) and order_minhash.edits_within(x, y, n - len(y) - 1) is None


def varied(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


def test_classes_equal_brute_force(spark):
    """Originals with copies of few edits, all of which share one passage that makes up half of each text."""
    rng = random.Random(4)
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    docs, i = [], 0
    for _ in range(25):
        base = [rng.choice(VOCABULARY) for _ in range(55)] + passage
        for words in [base, *[varied(base, rng, 4) for _ in range(rng.randint(0, 3))]]:
            docs.append((i, " ".join(words)))
            i += 1
    rng.shuffle(docs)
    words = {i: t.split() for i, t in docs}
    up = {i: i for i in words}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a in words:
        for b in words:
            if a < b and edits(words[a], words[b]) <= 0.2 * max(len(words[a]), len(words[b])):
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = order_minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in words}
    assert all(r.kept == (r.class_id == r.doc_id) for r in got)


def spread_edits(words, rng, n, tag):
    """n words replaced by new ones at different places."""
    words = list(words)
    for j, at in enumerate(rng.sample(range(len(words)), n)):
        words[at] = f"{tag}-{j}"
    return words


def test_pairs_near_the_threshold_are_found(spark):
    """Pairs of similarity 0.80 to 0.90, of 5 to 240 words."""
    rng = random.Random(12)
    docs, pairs = [], 0
    for n, share in [(n, s) for n in (5, 12, 30, 45, 120, 240) for s in (0.8, 0.82, 0.85, 0.9) for _ in range(10)]:
        base = [f"v{rng.randrange(5000)}" for _ in range(n)]
        changed = spread_edits(base, rng, int((1 - share) * n + 1e-9), f"p{pairs}")
        assert edits(base, changed) <= 0.2 * n + 1e-9
        docs += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(changed))]
        pairs += 1
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * p] == 2 * p for p in range(pairs))
    assert sum(got[2 * p + 1] == 2 * p for p in range(pairs)) >= 0.97 * pairs


@pytest.mark.parametrize("most", [2048, 10])
def test_pairs_in_crowds_are_found(spark, most):
    """Texts of which half or more are passages that many unlike ones share, in different selections; a few have a like one."""
    rng = random.Random(13)
    passages = [[f"p{i}-{j}" for j in range(45)] for i in range(4)]
    docs, like = [], []
    for g in range(150):
        own, shared = [f"g{g}-{j}" for j in range(90)], rng.sample(passages, 2)
        base = own[:30] + shared[0] + own[30:60] + shared[1] + own[60:]
        docs.append(base)
        if g % 3 == 0:
            like.append((len(docs) - 1, len(docs)))
            docs.append(spread_edits(own[:30], rng, 9, f"x{g}") + shared[0] + spread_edits(own[30:60], rng, 9, f"y{g}") + shared[1] + spread_edits(own[60:], rng, 9, f"z{g}"))
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    assert all(edits(docs[a], docs[b]) <= 0.2 * 180 for a, b in like)
    rows = [(i, " ".join(t)) for i, t in zip(ids, docs, strict=True)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), most_in_block=most).collect()}
    truth = {i: i for i in ids} | {max(ids[a], ids[b]): min(ids[a], ids[b]) for a, b in like}
    assert sum(got[i] != truth[i] for i in ids) <= 1


def test_signatures_bound_the_distance():
    """No signature may call a pair further apart than it is, whatever the lengths."""
    rng = np.random.default_rng(5)
    for n in (1, 30, 300, 1000, 1100, 9000):
        for _ in range(8):
            a = rng.integers(0, 2**63, 400, dtype=np.uint64)[np.minimum(rng.geometric(0.02, n), 400) - 1]
            b = np.delete(a, rng.integers(0, n, n // 9))
            b[rng.integers(0, len(b), max(1, n // 20))] = rng.integers(0, 2**63, dtype=np.uint64)
            x, y = order_minhash.signature(a), order_minhash.signature(b)
            bound = order_minhash.least_apart(x, y)
            assert bound <= order_minhash.least_edits(a, b) and order_minhash.least_apart(x, x) == 0
            assert order_minhash.all_apart(pa.array([x, y]), pa.array([y, y])).tolist() == [bound, 0]
    assert order_minhash.least_apart(order_minhash.signature(np.full(5000, 7, np.uint64)), order_minhash.signature(np.full(400, 7, np.uint64))) == 4600


@pytest.mark.parametrize("most", [2048, 10])
def test_a_crowd_of_near_misses(spark, most):
    """A group of many copies around a centre that is not the smallest: copies unlike the smallest are found through others."""
    rng = random.Random(21)
    centre = [f"c{i}" for i in range(60)]
    docs = [centre if g == 50 else spread_edits(centre, rng, 8, f"e{g}-") for g in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), most_in_block=most).collect()}
    assert all(edits(docs[50], d) <= 12 for d in docs) and sum(edits(docs[0], d) > 12 for d in docs) > 90
    assert sum(c != 0 for c in got.values()) <= 1


def test_near_duplicates_edges(spark):
    text = " ".join(VOCABULARY[:50])
    rows = [(None, text), (None, None), (1, ""), (2, None), (3, "a"), (4, "a"), (5, "b"), (6, text), (6, text + " z"), (7, text + " z"), (8, text * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS root", "3 AS class_id")
    got = sorted((str(r.doc_id), r.class_id, r.kept) for r in order_minhash.near_duplicates(spark, docs).collect())
    assert got == [("1", 1, True), ("2", 2, True), ("3", 3, True), ("4", 3, False), ("5", 5, True), ("6", 6, True), ("6", 6, True), ("7", 6, False), ("8", 8, True), ("None", None, True), ("None", None, True)]
    kept = order_minhash.deduplicate(spark, docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "8", "None", "None"]
    assert order_minhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_word_hashes_are_bounded():
    h = WordHashes()
    h.most = 10
    a = h.of([f"x{i}" for i in range(50)])
    assert len(h) <= 10 and len(set(a.tolist())) == 50
