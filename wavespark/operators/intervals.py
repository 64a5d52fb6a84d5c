"""Intervals where a condition holds: highlight, window, pixels, steps, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axis import BUCKET, bucket_of, merge_touching, number_rows


def highlight(points: DataFrame, condition: Column, lower: Column | int = 0, upper: Column | int | None = None, keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
    """Spans of the points where the condition holds, clipped to the range; touching ones are one. A ``size`` cuts the axis
    into buckets."""
    lo = F.lit(lower) if isinstance(lower, int) else lower
    hi = None if upper is None else F.lit(upper) if isinstance(upper, int) else upper
    end = F.col("end") if hi is None else F.least(F.col("end"), hi)
    spans = points.where(F.coalesce(condition, F.lit(False))).select(*keys, F.greatest(F.col("start"), lo).alias("start"), end.alias("end"))
    return merge_touching(spans, keys, size)


def visible(intervals: DataFrame, left: int, right: int) -> DataFrame:
    """What of the intervals lies in [left, right)."""
    return intervals.where((F.col("end") > left) & (F.col("start") < right)).withColumns({"start": F.greatest("start", F.lit(left)), "end": F.least("end", F.lit(right))})


def pixels(intervals: DataFrame, left: int, right: int, count: int, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Runs of adjacent pixels that any interval touches: at most ``count`` rows per key, whatever the input."""
    scale = (right - left) / count
    seen = visible(intervals, left, right)
    first, last = F.floor((F.col("start") - left) / F.lit(scale)), F.ceil((F.col("end") - left) / F.lit(scale)) - 1
    touched = seen.select(*keys, F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))).alias("pixel")).distinct()
    island = F.col("pixel") - F.row_number().over(Window.partitionBy(*keys).orderBy("pixel"))
    return touched.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("pixel").alias("first"), F.max("pixel").alias("last")).drop("_i")


def containing(intervals: DataFrame, sample: int) -> DataFrame:
    return intervals.where((F.col("start") <= sample) & (F.col("end") > sample))


def step(intervals: DataFrame, sample: int, forward: bool = True, wrap: bool = True, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """The start of the next (previous) interval per key."""
    s = F.col("start")
    near = F.min(F.when(s > sample, s)) if forward else F.max(F.when(s < sample, s))
    far = F.min(s) if forward else F.max(s)
    return intervals.groupBy(*keys).agg((F.coalesce(near, far) if wrap else near).alias("start"))


def sequence(points: DataFrame, stages: Sequence[Column], keys: Sequence[str] = ("capture_id",), size: int | None = None, lower: int = 0, upper: Column | int | None = None) -> DataFrame:
    """Intervals from a point where the first stage holds, the next point the second, and so on; overlapping matches are
    found, and their spans are merged. points: one row per grid point, in the order of ``start``."""
    w = Window.partitionBy(*keys).orderBy("start")
    told = points.withColumns({f"_s{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(stages)})
    all_ = F.col("_s0")
    for i in range(1, len(stages)):
        all_ = all_ & F.coalesce(F.lead(f"_s{i}", i).over(w), F.lit(False))
    last = F.lead("end", len(stages) - 1).over(w) if len(stages) > 1 else F.col("end")
    found = told.withColumn("_end", last).withColumn("_all", all_).where("_all").select(*keys, "start", F.col("_end").alias("end"))
    return highlight(found, F.lit(True), lower, upper, keys, size)


def bucketed_sequence(points: DataFrame, stages: Sequence[Column], keys: Sequence[str] = ("capture_id",), size: int = BUCKET) -> DataFrame:
    """The same for one long axis. Points are numbered first, and buckets are of their numbers, so each but the last holds as many
    however sparse the points are, and the first k - 1 of the next one complete every match; no window goes over the whole axis."""
    k = len(stages)
    size = max(size, k)
    told = points.withColumns({f"_s{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(stages)})
    told = number_rows(told.select(*keys, "start", "end", *[f"_s{i}" for i in range(k)]), "start", keys, "_n", size)
    own = told.withColumn("_b", bucket_of(F.col("_n"), size)).withColumn("_own", F.lit(True))
    more = own.where((F.col("_n") % size < k - 1) & (F.col("_b") > 0)).withColumn("_b", F.col("_b") - 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(*keys, "_b").orderBy("_n")
    all_ = F.col("_s0") & F.col("_own")
    for i in range(1, k):
        all_ = all_ & F.coalesce(F.lead(f"_s{i}", i).over(w), F.lit(False))
    found = own.unionByName(more).withColumn("_end", F.lead("end", k - 1).over(w) if k > 1 else F.col("end")).withColumn("_all", all_).where("_all")
    return merge_touching(found.select(*keys, "start", F.col("_end").alias("end")), keys, size)
