"""Exact top-k search by MaxScore over integer vectors.

A query's terms are its dimensions; a term's posting list holds every row's weight there. Contributions are counted from
the least a term can give in the shard, so that all are at least 0 and a term's bound is the most it can add. Terms are
taken by falling bound: as long as those left over can still lift a row into the top k alone, terms are essential and
their whole postings are traversed; then only rows that can still compete are probed in the other lists, term by term,
and dropped once their bound falls below the k-th score. Shards keep their k best per query, and these are merged.

Queries come in blocks of bounded size: each block is broadcast, and meets all rows in one pass without a shuffle.

Defined cases: null vectors and those that hold null or non-finite components take no part; vectors of fewer dimensions
count as padded with zeros; a query id that repeats is one query (its least vector); rows that repeat an id are
candidates each; a row never meets a query of its own id; null ids take no part; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries in one block (and so in one broadcast), and rows that are scored at once.
BLOCK, ROWS = 2048, 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and every component finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), finite)


def matrix(column: pa.Array, dims: int, kind=np.float64) -> np.ndarray:
    """A list column as a matrix, shorter rows padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(kind)
    out = np.zeros((len(column), dims), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


class Shard:
    """Rows of one batch with their lists by term, and each term's least and greatest weight."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.lists = ids, np.ascontiguousarray(rows.T)
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The rows that may be among the k best, and their scores. floor: the k-th best score known so far."""
        a, b = query * self.low, query * self.high
        least, bound = np.minimum(a, b), np.abs(b - a)
        order = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from here on can add at most
        base = least.sum()
        need = floor - base
        score = np.zeros(len(self.ids), self.lists.dtype)
        t = 0
        while t < len(order) and left[t] >= need:
            j = order[t]
            score += query[j] * self.lists[j]
            t += 1
        # least[...] of the terms already added is inside the score; that of the others still belongs to its bound.
        rest = least[order[t:]].sum()
        alive = np.flatnonzero((score + rest + left[t] >= floor) & (self.ids != own))
        score = score[alive]
        for t in range(t, len(order)):
            j = order[t]
            score = score + query[j] * self.lists[j][alive]
            rest -= least[j]
            fits = score + rest + left[t + 1] >= floor
            if not fits.all():
                alive, score = alive[fits], score[fits]
            if not len(alive):
                break
        if len(alive) > k:  # only the k best, ties to the smaller id
            cut = np.partition(score, len(score) - k)[len(score) - k]
            near = np.flatnonzero(score >= cut)
            near = near[np.lexsort((self.ids[alive[near]], -score[near]))[:k]]
            alive, score = alive[near], score[near]
        return self.ids[alive], score


def top_k(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k highest inner products of every query.

    rows and queries: an integer id and an array of integers each. Scores are exact: single or double precision is used
    where it holds every sum exactly, 64-bit integers beyond.
    """
    pick = lambda d: d.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base, asked = pick(rows), pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, dims = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    seen = base.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims = max(dims or 0, seen[0] or 0)
    most = asked.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    largest = int(most) * int(seen[1] or 0) * max(1, dims) * 2
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    found = None
    for part in range(max(1, -(-n // BLOCK))):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK)))) == part).toArrow()
        shared = spark.sparkContext.broadcast((np.asarray(block.column("id")), matrix(block.column("v"), dims, kind)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best = [(np.empty(0, np.int64), np.empty(0, kind))] * len(ids)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    shard = Shard(np.asarray(batch.column(0)), matrix(batch.column(1), dims, kind))
                    for i, q in enumerate(asked):
                        floor = best[i][1].min() if len(best[i][1]) >= k else -np.inf
                        got, score = shard.search(q, ids[i], k, floor)
                        if len(got):
                            got, score = np.concatenate([best[i][0], got]), np.concatenate([best[i][1], score])
                            keep = np.lexsort((got, -score))[:k]
                            best[i] = (got[keep], score[keep])
            sizes = [len(b[0]) for b in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]).astype(np.int64))], names=["query_id", "vec_id", "score"])

        part_found = base.mapInArrow(run, "query_id long, vec_id long, score long")
        found = part_found if found is None else found.unionByName(part_found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
