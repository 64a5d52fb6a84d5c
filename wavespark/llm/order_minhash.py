"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. Texts with the same words are one class; all below works on one document per class, the one of the smallest id.
2. A sketch samples, for each of a number of hash functions, the ``ell`` least k-mers of k words - each labelled with
   its number of earlier occurrences - and keeps them in text order. Equal samples put documents into one bucket; order
   and repeats count, so it follows edit similarity where plain MinHash follows sets. The number of functions follows
   from the recall wanted at the threshold (``planned``); texts under SHORT words are sampled by single words.
3. In each bucket the smallest id meets all others. A pair whose bags of words alone differ too much - told from
   signatures of fixed size - is dropped; the words of the others are aligned within a band as wide as the threshold
   allows (1 - edits / words of the longer >= threshold). Components of these links are the first classes.
4. What shares a bucket but no class yet meets too, without listing a crowd's pairs: documents that met the same smallest
   one are a group. The signatures of a group up to MOST_IN_BLOCK are compared by one task; larger groups meet by their
   rare words (``_by_rare_words``, which loses no pair within the threshold). Alignment judges as before.
5. Components of all links are the classes.

Defined cases: null ids take no part (null class, kept); a text without words (null, empty, blank) is a class of its
own; rows that share an id are one document, of which the least text is read, and each row gets its class; an empty
table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components
from .words import WordHashes, digest, find_words, mix, mix2

#: Texts of fewer words are sampled by single words: an edit would cost them too many of their k-mers.
SHORT = 40
#: Places of one word in a text from which on they are kept as one number.
COMMON = 64
#: Documents of one group whose signatures one task compares; larger groups meet by their rare words.
MOST_IN_BLOCK = 2048


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (of the whole text, if it is shorter), each labelled with its occurrence number."""
    if len(words) < k:
        words = np.concatenate([words, np.zeros(k - len(words), np.uint64)])
    n = len(words) - k + 1
    h = words[:n]
    for i in range(1, k):
        h = mix2(h, words[i : i + n])
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]]
    place = np.arange(n)
    number = np.empty(n, np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix2(h, number)


def planned(threshold: float, recall: float, k: int, ell: int) -> int:
    """Sketches by which a pair at the threshold, its edits spread over the text, shares a sample as often as recall says."""
    kept = threshold**k
    return math.ceil(math.log(1 - recall) / math.log(1 - min((kept / (2 - kept)) ** ell, 1 - 1e-9)))


class OrderSketch:
    def __init__(self, k: int = 2, ell: int = 2, sketches: int = 19, seed: int = 11, threshold: float = 0.8):
        self.k, self.ell, self.sketches, self.threshold = k, ell, sketches, threshold
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(0, 2**63, sketches, dtype=np.uint64)
        self.odd = rng.integers(0, 2**62, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Names of all samples of the words."""
        return np.concatenate([self.sample(kmers(words, k)) ^ np.int64(k) for k in self.sizes(len(words))])

    def sizes(self, n: int) -> list[int]:
        """By which k a text of n words is sampled: two texts that may be alike have one in common."""
        return [1] * (n < SHORT) + [self.k] * (n >= int(SHORT * self.threshold))

    def sample(self, grams: np.ndarray) -> np.ndarray:
        """One signed 64-bit name per sketch of the ordered sample of labelled k-mers."""
        n, out = len(grams), np.empty(self.sketches, np.uint64)
        step = max(1, 2_000_000 // n)
        for s in range(0, self.sketches, step):
            e = min(self.sketches, s + step)
            if n > self.ell:
                values = (grams[None, :] ^ self.seeds[s:e, None]) * self.odd[s:e, None]
                at = np.sort(np.argpartition(values, self.ell - 1, axis=1)[:, : self.ell], axis=1)
            else:
                at = np.tile(np.arange(n), (e - s, 1))
            name = self.seeds[s:e].copy()
            for i in range(at.shape[1]):
                name = mix2(name, grams[at[:, i]])
            out[s:e] = name
        return out.view(np.int64)


def least_edits(a: np.ndarray, b: np.ndarray) -> int:
    """Words that only one side has bound the distance from below."""
    _, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    count = np.bincount(inverse[: len(a)], minlength=inverse.max(initial=0) + 1) - np.bincount(inverse[len(a) :], minlength=inverse.max(initial=0) + 1)
    return int(max(count[count > 0].sum(), -count[count < 0].sum()))


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two word sequences (insert, delete, replace: 1 each) if it is at most limit, else None."""
    if abs(len(a) - len(b)) > limit:
        return None
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    head = int(diff[0]) if len(diff) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(diff[0]) if len(diff) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= limit else None
    least = max(1, least_edits(a, b))
    if least > limit:
        return None
    band = max(least, 64)  # a narrow band first: few edits are common
    while True:
        band = min(band, limit)
        d = _banded(a.tolist(), b.tolist(), band)
        if d is not None or band >= limit:
            return d
        band *= 8


def _banded(a: list[int], b: list[int], band: int) -> int | None:
    """Edit distance along the band of diagonals -band to band, a column at a time; None if it is more than band.

    A column's steps down are bits (vp: +1, vn: -1) of one number, from the band's upper to its lower end, which moves a
    row down with each column. The distance is followed on the lower end and then along the last row.
    """
    more = [-1] * (band + 1 - len(a))  # the lower end starts in a row: a common end changes no distance
    a, b = a + more, b + more
    n, m = len(a), len(b)
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i + 1 + band)
    # Common words keep a number of all their places; one for each word would take memory by the square of the length.
    common = {x: sum(1 << p for p in rows) for x, rows in places.items() if len(rows) >= COMMON}
    full, low = (1 << 2 * band + 1) - 1, 1 << 2 * band
    vp, vn, d = full >> band << band, 0, band
    for j in range(1, m + 1):
        if b[j - 1] in common:
            x = common[b[j - 1]] >> j & full
        else:
            x = 0
            for p in places.get(b[j - 1], ()):
                if 0 <= p - j <= 2 * band:
                    x |= 1 << p - j
        d0 = ((x & vp) + vp ^ vp | x | vn) & full
        hp, hn = vn | full & ~(d0 | vp), d0 & vp
        if j <= n - band:
            d += not d0 & low
        else:
            row = 1 << n - j + band
            d += bool(hp & row) - bool(hn & row)
        vp, vn = hn | full & ~(d0 >> 1 | hp), d0 >> 1 & hp
    return d if d <= band else None


def allowed(a: int, b: int, share: float) -> int:
    """Edits that make up a share of the longer of two sequences of so many words."""
    return int(share * max(a, b) + 1e-9)


def signature(words: np.ndarray) -> bytes:
    """How often the words fall into each of some slots - four for a word, from 256 to 2048, and up to 8192 in very long
    texts - led by the slots' power of two and the width of a count. Words have hashes of 64 bits; the slots of a small
    signature are sums of those of a large one."""
    power = min(max(8, (4 * len(words)).bit_length()), 11 if len(words) <= 2048 else 13)
    count = np.bincount((mix(words) >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power)
    kind = np.uint8 if count.max(initial=0) < 256 else np.uint32
    return bytes([power, kind().itemsize]) + count.astype(kind).tobytes()


def counts_of(mark: bytes) -> np.ndarray:
    return np.frombuffer(mark, np.uint8 if mark[1] == 1 else np.uint32, offset=2).astype(np.int64)


def least_apart(a: bytes, b: bytes) -> int:
    """Edits that two texts are apart at least, by their signatures: the true bags differ as much or more."""
    x, y = counts_of(a), counts_of(b)
    n = min(len(x), len(y))
    d = x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


#: Bytes of the least signature: 256 slots with counts of one byte.
USUAL = 258


def all_apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``least_apart`` of two columns; signatures of the usual size at once."""
    usual = (np.asarray(pc.binary_length(a)) == USUAL) & (np.asarray(pc.binary_length(b)) == USUAL)
    out = np.empty(len(a), np.int64)
    at = np.flatnonzero(usual)
    if len(at):
        x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), USUAL)[:, 2:].astype(np.int16) for c in (a, b))
        d = x - y
        out[at] = np.maximum(np.maximum(d, 0).sum(axis=1, dtype=np.int64), np.maximum(-d, 0).sum(axis=1, dtype=np.int64))
    for i in np.flatnonzero(~usual).tolist():
        out[i] = least_apart(a[i].as_py(), b[i].as_py())
    return out


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in arrays])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)))


def _sketched(docs: DataFrame, sketch: OrderSketch) -> DataFrame:
    """docs: ``id``, ``text``. Number of words, digest, names of the samples and signature; the text stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sizes, marks, names, bags = [], [], [], []
                for text in batch.column(1).to_pylist():
                    words = hashes.of(find_words(text or ""))
                    sizes.append(len(words))
                    marks.append(digest(words))
                    names.append(np.unique(sketch.of(words)) if len(words) else np.empty(0, np.int64))
                    bags.append(signature(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), _lists(names, np.int64), pa.array(bags, pa.binary())],
                    names=["id", "n", "c1", "c2", "keys", "bag"],
                )

    return docs.mapInArrow(run, "id long, n int, c1 long, c2 long, keys array<long>, bag binary")


def _as_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                # 31 bits are enough inside one pair or group of texts.
                words = [hashes.of(find_words(t or "")) & np.uint64(0x7FFFFFFF) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(words, np.int32)], names=["id", "words"])

    return docs.mapInArrow(run, "id long, words array<int>")


def _possible(pairs: DataFrame, bags: DataFrame, share: float) -> DataFrame:
    """pairs: ``a``, ``b``; bags: ``id``, ``n``, ``bag``. Those pairs that their signatures allow to be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                longer = np.maximum(np.asarray(batch.column(2)), np.asarray(batch.column(3)))
                ok = all_apart(batch.column(4), batch.column(5)) <= (share * longer + 1e-9).astype(np.int64)
                yield batch.select([0, 1]).filter(pa.array(ok))

    side = lambda s: bags.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bag").alias(f"bag{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_as_long(F.col("na"), F.col("nb"), share))
    return near.select("a", "b", "na", "nb", "baga", "bagb").mapInArrow(run, "a long, b long")


def _within_groups(members: DataFrame, share: float) -> DataFrame:
    """members: ``a``, ``id``, ``root``, ``n``, ``bag``. Pairs ``a``, ``b`` of one group of MOST_IN_BLOCK at most, but of different
    roots, that their signatures allow to be links. Every member travels once, and only such pairs are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) < 4 * MOST_IN_BLOCK:
                    continue
            if not held:
                continue
            rows = pa.concat_batches(held)
            group = np.asarray(rows.column(0))
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            whole = len(group) if batch is None else int(starts[-1])  # the last group may go on
            for s, e in zip(starts, [*starts[1:], len(group)], strict=True):
                if e <= whole:
                    a, b = _block(rows.slice(s, e - s), share)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            held = [rows.slice(whole)] if whole < len(group) else []

    dealt = members.select("a", "id", "root", "n", "bag").repartition("a").sortWithinPartitions("a", "n")
    return dealt.mapInArrow(run, "a long, b long")


def _block(rows: pa.RecordBatch, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the possible pairs of a group; its rows are in the order of their length."""
    ids, root, n, marks = np.asarray(rows.column(1)), np.asarray(rows.column(2)), np.asarray(rows.column(3)).astype(np.int64), rows.column(4).to_pylist()
    bags = np.stack([counts_of(m).reshape(256, -1).sum(axis=1) for m in marks])
    bags = bags.astype(np.uint8 if bags.max() < 256 else np.int64)
    limit = (share * n + 1e-9).astype(np.int64)  # of pairs in which this is the longer one
    first = np.searchsorted(n, n - limit)  # shorter texts are too short for it
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for j in range(1, len(ids)):
        at = np.arange(first[j], j)
        at = at[root[at] != root[j]]
        if len(at):
            common = np.minimum(bags[at], bags[j]).sum(axis=1, dtype=np.int64)
            at = at[n[j] - common <= limit[j]]
            if len(marks[j]) > USUAL:
                at = np.array([i for i in at.tolist() if least_apart(marks[i], marks[j]) <= limit[j]], np.int64)
            found.append((ids[at], np.full(len(at), ids[j])))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _as_long(x: Column, y: Column, share: float) -> Column:
    """Texts of so many words may be alike."""
    return F.abs(x - y) <= F.floor(F.greatest(x, y) * F.lit(share) + F.lit(1e-9))


def _linked(pairs: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """pairs: ``a``, ``b``. Those within the edits allowed, by banded alignment of the words of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ok = batch.column(2), batch.column(3), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.asarray(a[i].values), np.asarray(b[i].values)
                ok[i] = edits_within(x, y, allowed(len(x), len(y), share)) is not None
            yield batch.select([0, 1]).filter(pa.array(ok))

    side = lambda s: words.select(F.col("id").alias(s), F.col("words").alias(f"w{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def _tokens(members: DataFrame) -> DataFrame:
    """members: ``a``, ``id``, ``root``, ``n``, ``words``. A row for each word, hashed with its number of earlier occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [(kmers(np.asarray(w.values).astype(np.uint64), 1) >> np.uint64(32)).astype(np.uint32).view(np.int32) for w in batch.column(4)]
                each = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(each) for i in range(4)], pa.array(np.concatenate(found) if found else np.empty(0, np.int32))], names=["a", "id", "root", "n", "token"])

    return members.select("a", "id", "root", "n", "words").mapInArrow(run, "a long, id long, root long, n int, token int")


def _by_rare_words(scratch: Scratch, members: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """members: ``a``, ``id``, ``root``, ``n``. All pairs ``a``, ``b`` of one group but of different roots that may be alike.

    Like texts differ in a share of their words at most, so if each lists one word more than that share, the rarest of the
    group first, two like ones have a listed word in common (the prefix filter of exact set joins). What a crowd shares
    is common in its group and so at the end of the order.
    """
    tokens = scratch.write(_tokens(members.join(words, "id")))
    often = tokens.groupBy("a", "token").agg(F.count("*").alias("df"))
    order = F.sort_array(F.collect_list(F.struct("df", "token")))
    most = F.floor(F.col("n") * F.lit(share) + F.lit(1e-9)).cast("int") + 1
    listed = tokens.join(often, ["a", "token"]).groupBy("a", "id", "root", "n").agg(F.transform(F.slice(order, 1, most), lambda x: x["token"]).alias("listed"))
    listed = scratch.write(listed)
    rows = listed.select("a", "id", "root", F.posexplode("listed").alias("pos", "token"))
    # Of each word's texts those of its commonest root needn't meet each other: the others meet all.
    roots = rows.groupBy("a", "token", "root").agg(F.count("*").alias("of"))
    open_ = roots.groupBy("a", "token").agg(F.max_by("root", F.struct("of", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    some = rows.join(open_, ["a", "token"])
    # A pair is taken at the first word that both list; the words listed before it travel along.
    some = scratch.write(some.join(listed.select("a", "id", "n", "listed"), ["a", "id"]).select("a", "token", "id", "root", "n", "main", F.expr("slice(listed, 1, pos)").alias("before")))
    scratch.drop(tokens)
    x, y = some.where("root <> main").alias("x"), some.alias("y")
    both = (F.col("x.a") == F.col("y.a")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    met = x.join(y, both & once & _as_long(F.col("x.n"), F.col("y.n"), share) & ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids. The ids grow with the corpus, so they are not broadcast at any size."""
    return texts.join(ids.distinct().hint("merge"), "id", "left_semi").select("id", "text")


def _checked(scratch: Scratch, close: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """The links among the pairs ``a``, ``b``; only their texts are gathered."""
    words = scratch.write(_as_words(_of_ids(texts, close.select(F.col("a").alias("id")).union(close.select("b")))))
    links = scratch.write(_linked(close, words, share))
    scratch.drop(words)
    return links


def near_duplicates(
    spark: SparkSession, docs: DataFrame, text: str = "text", id_: str = "doc_id", k: int = 2, ell: int = 2, sketches: int | None = None, threshold: float = 0.8, seed: int = 11, recall: float = 0.99, most_in_block: int = MOST_IN_BLOCK
) -> DataFrame:
    """One row per row of docs: ``doc_id``, ``class_id`` (the smallest id of its class), ``kept``. The number of sketches
    follows from the recall wanted at the threshold, unless it is given."""
    scratch, share = Scratch(spark, "order-minhash"), 1 - threshold
    whole = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = whole.where("id IS NOT NULL")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        texts = rows
    else:
        texts = scratch.write(rows.groupBy("id").agg(F.min("text").alias("text")))
    sketches = sketches or planned(threshold, recall, k, ell)
    known = scratch.write(_sketched(texts, OrderSketch(k, ell, sketches, seed, threshold)))
    classes = scratch.write(known.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep")))
    spread = known.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("keys").alias("key"))
    # Each bucket's smallest id stands against all its others; the signatures tell which of these pairs are worth an alignment.
    # Sums are written before they are joined: a join right on top of them couldn't be split where one key is common.
    buckets = scratch.write(spread.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").drop("last"))
    met = scratch.write(spread.join(buckets, "key").where("id > a").select("a", F.col("id").alias("b")).distinct())
    bags = known.select("id", "n", "bag")
    close = scratch.write(_possible(met, bags, share))
    links = _checked(scratch, close, texts, share)
    near = scratch.write(components(scratch, links))
    # Members of one bucket that aren't one component yet meet too.
    members = met.select("a", F.col("b").alias("id")).join(near, "id", "left").withColumn("root", F.coalesce("root", "id")).join(bags, "id")
    groups = scratch.write(members.groupBy("a").agg(F.count("*").alias("of"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("a", "of"))
    members = scratch.write(members.join(groups, "a").select("a", "id", "root", "n", "bag", "of"))
    rest = _within_groups(members.where(F.col("of") <= most_in_block), share)
    crowds = members.where(F.col("of") > most_in_block)
    if not crowds.isEmpty():
        words = scratch.write(_as_words(_of_ids(texts, crowds.select("id"))))
        rest = rest.unionByName(_possible(_by_rare_words(scratch, crowds, words, share).distinct(), bags, share))
    close = scratch.write(rest.distinct())
    if not close.isEmpty():
        near = scratch.write(components(scratch, links.unionByName(_checked(scratch, close, texts, share))))
    scratch.drop(buckets, groups, met, members, close)
    classed = known.join(classes, ["c1", "c2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    classed = classed.join(near.select(F.col("id").alias("rep"), "root"), "rep", "left").select(F.col("id").alias("of"), F.coalesce("root", "rep").alias("class_id"))
    out = whole.select(F.col("id").alias("doc_id")).join(classed, F.col("doc_id") == F.col("of"), "left")
    return out.select("doc_id", "class_id", (F.col("class_id").isNull() | (F.col("class_id") == F.col("doc_id"))).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, text: str = "text", id_: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each class, the one of the smallest id."""
    scratch = Scratch(spark, "near-dedup")
    decided = scratch.write(near_duplicates(spark, docs, text, id_, **how))
    kept = decided.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id"))
    out = docs.join(kept.distinct().hint("merge"), docs[id_] == F.col("_kept_id"), "left_semi").unionByName(docs.where(docs[id_].isNull()))
    if not kept.groupBy("_kept_id").count().where("count > 1").isEmpty():  # rows that share an id
        out = out.where(F.col(id_).isNotNull()).dropDuplicates([id_]).unionByName(docs.where(docs[id_].isNull()))
    return out
