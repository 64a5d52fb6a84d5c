"""Substring dedup by recompression: repeats of ``window`` words and more, across documents, of which the copy in the
document of the smallest id stays.

1. Rounds of recompression name runs of equal symbols and pairs of a left and a right symbol (a hash of the symbol says
   which it is). A name is a hash of what it stands for, so equal substrings get equal symbols in every task, but for
   those near their ends; with each symbol goes the stretch of words that its making depends on.
2. Of the last round's symbols whose stretch lies in a window, the least name is the window's anchor. Neighbouring
   windows with one anchor are a segment (some twenty windows), so a document is a short list of segments.
3. Spark groups the anchors: those that only one document has are done with. Where all segments of an anchor are equal,
   the smallest document keeps them; equal segments of unequal ones go the same way.
4. Only what is left - the smallest copies of unequal segments of shared anchors, at the ends of repeats - is compared
   window by window, by two independent hashes of 64 bits each.
5. Each document's removed windows are joined to its text, and the words that they cover go.

Windows of periodic text may hold no such symbol; each is then its own anchor. All groups are sums with partial
aggregation and joins on them that can be split, so a passage in a third of all documents is no single task's.

Defined cases: a null text has no words; documents with fewer than ``window`` words keep all; rows that share an id
don't remove each other's words; rows with a null id neither lose words nor remove any; an empty table gives an empty
table. Other columns pass through; ``n_words``, ``n_removed`` and ``kept_text`` replace columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .words import WordHashes, find_words, mix, mix2

#: Odd multipliers of the two substring hashes, their inverses modulo 2**64, and the salt of the second one.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
SALT, RUN, SEP = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Words that are parsed at once (or one document, if it is longer).
AT_ONCE = 150_000


class Substrings:
    """Hashes of substrings of a sequence of word hashes, by sums of powers."""

    def __init__(self, h: np.ndarray, which: int):
        n = len(h)
        powers = np.full(n + 1, BASES[which], np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.back = np.full(n + 1, INVERSES[which], np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((mix(h ^ SALT) if which else h) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def runs(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of an equal symbol become one; that a run ends depends on its neighbours."""
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    size = np.diff(np.r_[first, len(name)])
    out = name[first]
    many = size > 1
    out[many] = mix2(out[many] ^ RUN, size[many].astype(np.uint64))
    last = first + size - 1
    return out, lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(hi) - 1)]


def pairs(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A left symbol and the right symbol after it become one; a symbol that stays depends on the one it didn't meet."""
    n = len(name)
    right = mix(name + np.uint64(number + 1) * SALT) >> np.uint64(63) == 1
    joined = np.zeros(n, bool)
    joined[:-1] = ~right[:-1] & right[1:]
    second = np.r_[False, joined[:-1]]
    at = np.flatnonzero(~second)
    out, both, alone = name[at], joined[at], right[at]
    out[both] = mix2(name[at[both]], name[at[both] + 1])
    return out, lo[np.where(alone, np.maximum(at - 1, 0), at)], hi[np.where(alone, at, np.minimum(at + 1, n - 1))]


def recompressed(h: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: names, and the stretches [lo, hi) of words that they depend on."""
    name, lo = h, np.arange(len(h))
    hi = lo + 1
    for r in range(rounds):
        if r % 2 == 0:
            name, lo, hi = runs(name, lo, hi)
        name, lo, hi = pairs(name, lo, hi, r)
    return name, lo, hi


def anchors(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, window: int) -> np.ndarray:
    """For the window at each place the symbol of the least name (the first such) whose stretch lies in it, or -1."""
    least = np.cumsum(np.bincount(lo, minlength=n + 1))
    begin = np.r_[0, least][: n - window + 1]
    end = np.cumsum(np.bincount(hi, minlength=n + 1))[window : n + 1]
    order = np.argsort(name, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = end - begin
    best = np.full(len(width), -1, np.int64)
    table, span = rank, 1
    while True:
        at = np.flatnonzero((width >= span) & (width < 2 * span))
        best[at] = order[np.minimum(table[begin[at]], table[end[at] - span])]
        if 2 * span > width.max(initial=0) or len(table) <= span:
            return best
        table, span = np.minimum(table[:-span], table[span:]), 2 * span


class Segments:
    """Segments of several documents' words at once."""

    def __init__(self, window: int, rounds: int):
        self.window, self.rounds = window, rounds

    def of(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, segment, place of its first window, number of windows), in order."""
        w = self.window
        sizes = np.array([len(d) for d in docs])
        # Between documents stands a symbol that is nowhere else, so nothing in a document depends on its neighbour.
        gaps = mix(np.arange(len(docs) + 1, dtype=np.uint64) ^ SEP)
        h = np.concatenate([x for g, d in zip(gaps, docs, strict=False) for x in ([g], d)] + [gaps[-1:]]).astype(np.uint64)
        start = np.cumsum(np.r_[1, sizes[:-1] + 1])
        place = np.concatenate([np.arange(s, s + k - w + 1) for s, k in zip(start, sizes, strict=True) if k >= w] or [np.empty(0, np.int64)])
        of = np.repeat(np.arange(len(docs)), np.maximum(sizes - w + 1, 0))
        if not len(place):
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        name, lo, hi = recompressed(h, self.rounds)
        anchor = anchors(name, lo, hi, len(h), w)[place]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | (anchor[1:] < 0)])
        p, m, a = place[new], np.diff(np.r_[new, len(place)]), anchor[new]
        first, second = Substrings(h, 0), Substrings(h, 1)
        own = a < 0
        key = first.of(np.where(own, p, lo[a]), np.where(own, p + w, hi[a]))
        return of[new], key.view(np.int64), second.of(p, p + m + w - 1).view(np.int64), p - start[of[new]], m


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[str]]]]:
    """Slices of a batch with few words each (or of one row), and the words."""
    words, size, begin = [], 0, 0
    texts = batch.column(column)
    for i in range(batch.num_rows):
        found = find_words(texts[i].as_py() or "")
        words.append(found)
        size += len(found)
        if size >= AT_ONCE or i == batch.num_rows - 1:
            yield begin, i + 1, words
            words, size, begin = [], 0, i + 1


def _segmented(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """docs: ``id``, ``mark``, ``text``. One row per document that has windows, with its segments in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, segments = WordHashes(), Segments(window, rounds)
        for batch in batches:
            for begin, end, words in _batches(batch, 2):
                of, key, seg, p, m = segments.of([hashes.of(w) for w in words])
                ends = pa.array(np.searchsorted(of, np.arange(end - begin + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((key, pa.int64()), (seg, pa.int64()), (p, pa.int32()), (m, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), *lists], names=["id", "mark", "key", "seg", "p", "m"])

    return docs.mapInArrow(run, "id long, mark long, key array<long>, seg array<long>, p array<int>, m array<int>")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """rows: ``id``, ``mark``, ``text``, ``parts`` (key, p, m). One row per window: key, hash, id, mark, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                ids, marks, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
                for i in range(batch.num_rows):
                    h = hashes.of(find_words(batch.column(2)[i].as_py() or ""))
                    key, p, m = (np.asarray(parts[i].values.field(f)) for f in range(3))
                    start = np.repeat(p, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    start = start.astype(np.int64)
                    for o, x in zip(out, (np.repeat(key, m), Substrings(h, 1).of(start, start + window).view(np.int64), np.full(len(start), ids[i]), np.full(len(start), marks[i]), start), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "win", "id", "mark", "p"])

    return rows.mapInArrow(run, "key long, win long, id long, mark long, p int")


def repeats(spark: SparkSession, scratch: Scratch, docs: DataFrame, window: int = 50, rounds: int = 4) -> DataFrame:
    """docs: ``id``, ``mark``, ``text``. Windows ``(id, mark, p, m)`` that also start in a document with a smaller id."""
    known = scratch.write(_segmented(docs.where("id IS NOT NULL"), window, rounds).where("size(key) > 0"))
    rows = known.select("id", "mark", F.explode(F.arrays_zip("key", "seg", "p", "m")).alias("s")).select("id", "mark", "s.*")
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("seg").alias("s1"), F.max("seg").alias("s2")).where("low < high")
    shared = scratch.write(shared.select("key", "low", (F.col("s1") != F.col("s2")).alias("unlike")))
    met = scratch.write(rows.join(shared, "key").where("unlike OR id > low").select("id", "mark", "key", "seg", "p", "m", "unlike"))
    scratch.drop(known, shared)
    some = met.where("unlike")
    # Sums are written before they are joined: a join right on top of them couldn't be split where one key is common.
    lows = scratch.write(some.groupBy("key", "seg").agg(F.min("id").alias("first")))
    told = scratch.write(some.join(lows, ["key", "seg"]).select("id", "mark", "key", "p", "m", (F.col("id") > F.col("first")).alias("gone")))
    edges = told.where("NOT gone").groupBy("id", "mark").agg(F.collect_list(F.struct("key", "p", "m")).alias("parts"))
    texts = docs.select("id", "mark", "text").join(edges.hint("shuffle_hash"), ["id", "mark"])
    wins = scratch.write(_windows(texts.select("id", "mark", "text", "parts"), window))
    best = scratch.write(wins.groupBy("key", "win").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    late = wins.join(best, ["key", "win"]).where("id > first").select("id", "mark", "p", F.lit(1).alias("m"))
    return met.where("NOT unlike").select("id", "mark", "p", "m").unionByName(told.where("gone").select("id", "mark", "p", "m")).unionByName(late)


def remove_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", id_: str = "doc_id", window: int = 50, rounds: int = 4) -> DataFrame:
    """Every document with ``n_words``, ``n_removed`` and ``kept_text`` (the words that stay, with one space between)."""
    scratch = Scratch(spark, "recompression")
    docs = docs.drop("n_words", "n_removed", "kept_text")
    body = F.col(f"`{text}`")
    keyed = [F.col(f"`{id_}`").cast("long").alias("id"), F.xxhash64(body).alias("mark"), body.alias("text")]
    found = scratch.write(repeats(spark, scratch, docs.select(*keyed), window, rounds))
    gone = found.groupBy("id", "mark").agg(F.collect_list(F.struct("p", "m")).alias("gone"))
    joined = docs.select(F.struct("*").alias("doc"), *keyed).join(gone.hint("shuffle_hash"), ["id", "mark"], "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, removed, kept = [], [], []
                for i in range(batch.num_rows):
                    words, parts = find_words(batch.column(1)[i].as_py() or ""), batch.column(2)[i]
                    n.append(len(words))
                    if parts.is_valid:
                        p, m = (np.asarray(parts.values.field(f)).astype(np.int64) for f in range(2))
                        change = np.bincount(p, minlength=len(words) + 1) - np.bincount(p + m + window - 1, minlength=len(words) + 1)
                        stays = np.cumsum(change)[: len(words)] == 0
                        words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    removed.append(n[-1] - len(words))
                    kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])

    kind = T.StructType([joined.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(run, kind).select("doc.*", "n_words", "n_removed", "kept_text")


def without_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", id_: str = "doc_id", window: int = 50) -> DataFrame:
    """docs with the texts that are left; texts that lose nothing stay as they are, and ``n_chars`` follows the text."""
    out = remove_repeats(spark, docs, text, id_, window)
    lost = F.col("n_removed") > 0
    changed = {text: F.when(lost, F.col("kept_text")).otherwise(F.col(f"`{text}`"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])
