"""Embedding near-dedup with randomised-rotation binary codes.

1. Equal vectors are one class (grouped by their components); all below works on one vector per class.
2. A random rotation (from a seed) turns each unit vector; its signs are the binary code, and the inner product of code
   and vector is stored as the correction factor. Parts of further rotations' signs are bucket keys: the number of
   tables follows from the number of vectors and the wanted recall at the threshold.
3. In each bucket, code(x) . y / factor(x) estimates x . y without bias, with a confidence bound from the factor; only
   pairs whose upper bound reaches the threshold are computed exactly, in double precision.
4. A pair that meets in several tables counts in the first alone (all keys travel with a vector), so links are counted
   without listing pairs; each task passes on counts and a spanning forest of the links it found.

Buckets beyond ``most_in_block`` are dealt to blocks of pairs of parts, so no task gets a whole hot bucket; copies never
reach a bucket. Components come from rounds of joins.

Defined cases: null or zero vectors and those with null or non-finite components link with nothing; vectors of unlike
dimension don't link; rows that repeat an id are one vertex each with its own row in the result, all with one component;
null ids get null component ids and no links; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components
from .maxscore import matrix, usable


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def plan(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a key, and tables: a pair at the threshold shares a key with probability p ** bits in each."""
    p = 1 - math.acos(threshold) / math.pi
    bits = max(6, min(30, math.ceil(math.log2(max(2, vectors)))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**bits)))


class Codes:
    """Codes, factors and keys of unit vectors of one dimension."""

    def __init__(self, dims: int, bits: int, tables: int, seed: int = 7):
        self.dims, self.bits, self.tables = dims, bits, tables
        self.turn = rotation(dims, seed)
        self.signs = np.hstack([rotation(dims, seed + 1 + i) for i in range(-(-bits * tables // dims))])[:, : bits * tables]

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs / sqrt(dims) of the turned vectors, and the factor <code, vector>."""
        turned = unit @ self.turn
        code = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(self.dims)
        return code, (code * turned).sum(axis=1)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        on = (unit @ self.signs >= 0).reshape(len(unit), self.tables, self.bits)
        return on @ (1 << np.arange(self.bits, dtype=np.int64))


def bounds(estimate: np.ndarray, factor: np.ndarray, dims: int, sigmas: float) -> np.ndarray:
    """The upper end of the confidence interval of an estimated inner product."""
    return estimate + sigmas * np.sqrt((1 - factor**2) / factor**2 / max(1, dims - 1))


class Forest:
    """Union-find over a task's rows; what it joins is the spanning forest it passes on."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def compare(left, right, table: int, same: bool, threshold: float, sigmas: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the links that two parts of a bucket hold. Parts: (unit, code, factor, keys)."""
    (ux, cx, fx, kx), (uy, _, _, ky) = left, right
    estimate = cx @ (uy @ turn).T / fx[:, None]
    maybe = bounds(estimate, fx[:, None], ux.shape[1], sigmas) >= threshold
    if same:
        maybe &= np.tri(len(ux), k=-1, dtype=bool).T
    i, j = np.nonzero(maybe)
    if table:  # met in an earlier table already
        fresh = ~(kx[i, :table] == ky[j, :table]).any(axis=1)
        i, j = i[fresh], j[fresh]
    exact = np.einsum("nd,nd->n", ux[i], uy[j]) >= threshold
    return i[exact], j[exact]


def links(spark: SparkSession, scratch: Scratch, reps: DataFrame, dims: int, count: int, threshold: float, recall: float, sigmas: float, most_in_block: int, seed: int) -> DataFrame:
    """reps: ``id``, ``x`` (doubles), ``copies``. Rows ``(id, n, other)``: links counted (in copies), or a link itself."""
    bits, tables = plan(count, threshold, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(dims, bits, tables, seed)
        for batch in batches:
            x = matrix(batch.column(1), dims)
            keys = codes.keys(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["id", "x", "copies", "keys"])

    rows = scratch.write(reps.mapInArrow(keyed, "id long, x array<double>, copies long, keys array<int>"))
    spread = rows.select("id", "x", "copies", "keys", F.posexplode("keys").alias("t", "key"))
    sizes = spread.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(most_in_block))).cast("int")
    met = spread.join(sizes, ["t", "key"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A row of part p stands in the blocks (min, max) of p and every part.
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("id", "x", "copies", "keys", "t", "key", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part")
    met = met.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "part", "id")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(dims, bits, tables, seed)
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
                if held.num_rows < 20_000:
                    continue
            if held is None or not held.num_rows:
                return
            block = np.stack([np.asarray(held.column(c)).astype(np.int64) for c in (4, 5, 6, 7)], axis=1)
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]).any(axis=1)])
            done = held.num_rows if batch is None else int(starts[-1])
            if done:
                yield from _linked(held.slice(0, done), block[:done], starts[starts < done], codes, threshold, sigmas)
            held = held.slice(done)

    return met.mapInArrow(linked, "id long, n long, other long")


def _then_none(items: Iterator):
    yield from items
    yield None


def _linked(rows: pa.RecordBatch, block: np.ndarray, starts: np.ndarray, codes: Codes, threshold: float, sigmas: float) -> Iterator[pa.RecordBatch]:
    ids, copies, part = np.asarray(rows.column(0)), np.asarray(rows.column(2)), np.asarray(rows.column(8))
    x = matrix(rows.column(1), codes.dims)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    keys = matrix(rows.column(3), codes.tables, np.int32)
    code, factor = codes.code(unit)
    found = np.zeros(len(ids), np.int64)
    near: list[tuple[int, int]] = []
    ends = np.r_[starts[1:], len(ids)]
    for s, e in zip(starts, ends, strict=True):
        if e - s < 2:
            continue
        same = block[s, 2] == block[s, 3]
        mid = e if same else s + int(np.searchsorted(part[s:e], block[s, 3]))
        pick = lambda a, b: (unit[a:b], code[a:b], factor[a:b], keys[a:b])
        i, j = compare(pick(s, mid), pick(s, e) if same else pick(mid, e), int(block[s, 0]), same, threshold, sigmas, codes.turn)
        if not len(i):
            continue
        i, j = i + s, j + (s if same else mid)
        np.add.at(found, i, copies[j])
        np.add.at(found, j, copies[i])
        forest = Forest(e - s)
        near += [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a - s, b - s)]
    some = np.flatnonzero(found)
    a, b = np.array(near, np.int64).reshape(-1, 2).T
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[ids[some], ids[a]]), pa.array(np.r_[found[some], np.zeros(len(a), np.int64)]), pa.array(np.r_[ids[some], ids[b]])], names=["id", "n", "other"]
    )


def near_duplicates(
    spark: SparkSession, rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = 0.999, sigmas: float = 6.0, most_in_block: int = 2048, seed: int = 7
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    scratch = Scratch(spark, "vectors")
    x = F.col("x")
    all_ = rows.select(F.col(f"`{id_}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    fit = usable(x) & F.exists(x, lambda v: v != 0) & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are one value: adding 0.0 makes them so before the digest.
    mark = F.when(fit, F.sha2(F.concat_ws(",", F.transform(x, lambda v: (v + F.lit(0.0)).cast("string"))), 256))
    marked = scratch.write(all_.select("vec_id", F.when(fit, x).alias("x"), mark.alias("mark")))
    classes = scratch.write(marked.where("mark IS NOT NULL").groupBy("mark").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("x").alias("x"), F.max(F.size("x")).alias("dims")))
    found = None
    for dims, count in classes.groupBy("dims").count().collect():  # a handful of dimensions
        some = links(spark, scratch, classes.where(F.col("dims") == dims).select("id", "x", "copies"), dims, count, threshold, recall, sigmas, most_in_block, seed)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, other long")
    found = scratch.write(found)
    # Rows that share an id but not a vector join the classes of their vectors.
    ties = marked.where("mark IS NOT NULL").join(classes.select("mark", "id"), "mark").select(F.col("vec_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    near = components(scratch, found.where("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(ties))
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    linked = classes.select("mark", "id", "copies").join(counts, "id", "left").select("mark", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    roots = near.select(F.col("id").alias("vec_id"), "root")
    out = marked.select("vec_id", "mark").join(linked, "mark", "left").join(roots, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
