"""One long axis in pieces: order, carry and islands without a task that sees the whole of it.

A capture is one ordered axis, and a window without a partition key would put it into one task. Here the axis is cut
into buckets; windows run inside buckets, and what a bucket must know of those before it is carried by a summary of one
row per bucket, over which alone an unpartitioned window runs. A summary is a second pass over the input, so where keys
(captures, signals) already deal the work, ``size=None`` leaves a key in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a bucket. One row per bucket meets in a summary: a million buckets hold 10**12 positions.
BUCKET = 1_000_000


def bucket_of(position: Column, size: int = BUCKET) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def _before(summary: DataFrame, keys: Sequence[str], how: dict[str, Column], after: bool = False) -> DataFrame:
    """For every bucket an aggregate over those before (after) it, per key."""
    ends = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*ends)
    return summary.select(*keys, "_bucket", *[c.over(w).alias(n) for n, c in how.items()])


def _with(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    theirs = carried.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), *[c for c in carried.columns if c not in (*keys, "_bucket")])
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(theirs, same, "left").drop("_b", *[f"_k_{k}" for k in keys])


def number_rows(df: DataFrame, by: str, keys: Sequence[str] = (), name: str = "sample", size: int = BUCKET) -> DataFrame:
    """Adds the place (from 0) in the order of an integer column with distinct values."""
    own = df.withColumn("_bucket", bucket_of(F.col(by), size))
    before = _before(own.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")), keys, {"_before": F.sum("_n")})
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(by)) - 1
    return _with(own.withColumn("_place", place), before, keys).withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("long")).drop("_bucket", "_place", "_before")


def fill_forward(df: DataFrame, order: Sequence[Column], position: str, values: Sequence[str], keys: Sequence[str] = (), size: int | None = BUCKET) -> DataFrame:
    """Replaces each of the columns by its last value that isn't null, in order, per key. The first of ``order`` is the
    position."""
    if size is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    own = df.withColumn("_bucket", bucket_of(F.col(position), size))
    key = F.struct(*order)
    last = own.groupBy(*keys, "_bucket").agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), key)).alias(f"_last_{v}") for v in values])
    carried = _before(last, keys, {f"_carry_{v}": F.last(f"_last_{v}", ignorenulls=True) for v in values})
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = own.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    out = _with(filled, carried, keys).withColumns({v: F.coalesce(v, f"_carry_{v}") for v in values})
    return out.drop("_bucket", *[f"_carry_{v}" for v in values])


def neighbour(df: DataFrame, by: str, values: Sequence[str], keys: Sequence[str] = (), size: int | None = BUCKET, name: str = "_prior", after: bool = False) -> DataFrame:
    """Adds a struct of the values of the row before (after) in the order of a column, per key; null at the end."""
    held, step = F.struct(*[F.col(v) for v in values]), F.lead if after else F.lag
    if size is None:
        return df.withColumn(name, step(held).over(Window.partitionBy(*keys).orderBy(by)))
    own = df.withColumn("_bucket", bucket_of(F.col(by), size))
    near, pick = (F.min_by, F.first) if after else (F.max_by, F.last)
    ends = own.groupBy(*keys, "_bucket").agg(near(held, F.col(by)).alias("_end"))
    carried = _before(ends, keys, {"_carry": pick("_end", ignorenulls=True)}, after)
    inside = step(held).over(Window.partitionBy(*keys, "_bucket").orderBy(by))
    return _with(own.withColumn("_inside", inside), carried, keys).withColumn(name, F.coalesce("_inside", "_carry")).drop("_bucket", "_inside", "_carry")


def merge_touching(df: DataFrame, keys: Sequence[str] = (), size: int | None = BUCKET) -> DataFrame:
    """Intervals ``[start, end)`` that overlap or touch become one, per key."""
    if size is None:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        told = df.select(*keys, "start", "end").where("end > start").withColumn("_reach", reach)
        new = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)
        numbered = told.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
    own = df.select(*keys, "start", "end").where("end > start").withColumn("_bucket", bucket_of(F.col("start"), size))
    reach = _before(own.groupBy(*keys, "_bucket").agg(F.max("end").alias("_e")), keys, {"_reach": F.max("_e")})
    w = Window.partitionBy(*keys, "_bucket").orderBy("start", "end")
    inside = own.withColumn("_inside", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flags = _with(inside, reach, keys).withColumn("_far", F.greatest("_inside", "_reach"))
    flags = flags.withColumn("_new", (F.col("_far").isNull() | (F.col("start") > F.col("_far"))).cast("long"))
    counted = _before(flags.groupBy(*keys, "_bucket").agg(F.sum("_new").alias("_n")), keys, {"_before": F.sum("_n")})
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = _with(flags.withColumn("_own", island), counted, keys).withColumn("_island", F.coalesce("_before", F.lit(0)) + F.col("_own"))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
