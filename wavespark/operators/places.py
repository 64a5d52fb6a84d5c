"""Small questions about places in a capture: its ends, its trigger, what a cursor sees, ranges, bookmarks, two captures' signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import as_of, nearest
from .runs import KEYS


def next_change_or_end(cursors: DataFrame, runs: DataFrame, at: str = "at", forward: bool = True, size: int | None = None) -> DataFrame:
    """cursors (``capture_id``, ``signal``, a place) with the next (last) change as ``found``; where there is none, the capture's end (its beginning)."""
    ends = runs.groupBy("capture_id").agg((F.max("end") - 1).alias("_last"))
    near = nearest(cursors, runs.where("start > 0").select(*KEYS, "start"), at, (), KEYS, forward=forward, size=size)
    told = near.join(ends, "capture_id", "left")
    return told.withColumn("found", F.coalesce("found", F.col("_last") if forward else F.lit(0).cast("long"))).drop("_last")


def triggers(runs: DataFrame) -> DataFrame:
    """Per capture the first sample at which the signal called trigger (in any case, whatever its path) is 1; captures without one have no row."""
    own = runs.where((F.upper("signal") == "TRIGGER") & (F.col("num") == 1))
    return own.groupBy("capture_id").agg(F.min("start").alias("sample"))


def at_cursor(cursors: DataFrame, meta: DataFrame, at: str = "at", by: str = "sample", keys: Sequence[str] = ()) -> DataFrame:
    """cursors with the columns about the buffer at their samples; null where a cursor lies outside."""
    named = meta.withColumnRenamed(by, "_by")
    same = F.col(at) == F.col("_by")
    for k in keys:
        same = same & (cursors[k] == named[k])
    return cursors.join(named, same, "left").drop("_by")


def chosen_range(points: DataFrame, first: int, second: int | None = None, by: str = "at") -> DataFrame:
    """Points between two cursors, without the later one itself; all points where there is no second cursor."""
    if second is None:
        return points
    return points.where((F.col(by) >= min(first, second)) & (F.col(by) < max(first, second)))


def clamped(bookmarks: DataFrame, counts: DataFrame, by: str = "sample") -> DataFrame:
    """Bookmarks moved into captures that have become shorter; those of captures without samples go. counts: ``capture_id``, ``count``."""
    return bookmarks.join(counts.where("count > 0"), "capture_id").withColumn(by, F.greatest(F.lit(0), F.least(F.col(by), F.col("count") - 1))).drop("count")


def next_bookmark(cursors: DataFrame, bookmarks: DataFrame, at: str = "at", forward: bool = True, size: int | None = None) -> DataFrame:
    """cursors with the next (last) bookmark's ``id`` and its place ``found``; of several at one sample the one of the smallest id."""
    one = bookmarks.groupBy("capture_id", "sample").agg(F.min("id").alias("id"))
    return nearest(cursors, one, at, ["id"], ["capture_id"], "sample", forward, size=size)


def samples_at_times(points: DataFrame, times: DataFrame, at: str = "tick", size: int | None = None) -> DataFrame:
    """points with ``place``, the position between samples at their times; times before the first sample are before it by their share of its length, times
    after the last one beyond it, a tick a sample. times: ``capture_id``, ``sample``, ``tick``."""
    c = F.col
    following = nearest(times.withColumn("_t", c("tick")), times.withColumnRenamed("tick", "_next"), "_t", (), ["capture_id"], "_next", size=size).select("capture_id", "sample", "tick", c("found").alias("_after"))
    first = times.groupBy("capture_id").agg(F.min(F.struct("tick", "sample")).alias("_first"))
    ahead = following.join(first, "capture_id").where(c("sample") == c("_first.sample")).select("capture_id", c("tick").alias("_low0"), c("_after").alias("_after0"))
    axis = following.select("capture_id", c("tick").alias("start"), c("tick").alias("_low"), "_after", "sample")
    found = as_of(points, axis, at, ["_low", "_after", "sample"], ["capture_id"], size=size).join(ahead, "capture_id", "left")
    low, after, sample = F.coalesce("_low", "_low0"), F.when(c("_low").isNull(), c("_after0")).otherwise(c("_after")), F.coalesce("sample", F.lit(0))
    width = F.greatest(F.lit(1), F.coalesce(after - low, F.lit(1)))
    return found.withColumn("place", sample + (c(at) - low).cast("double") / width.cast("double")).drop("_low", "_after", "sample", "run_start", "_low0", "_after0")


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signals of two captures by name: ``signal``, ``old`` and ``new`` (whether it is there), ``alike`` (of one width in both)."""
    left, right = (d.select("signal", F.col("width").alias(n)) for d, n in ((old, "_a"), (new, "_b")))
    both = left.join(right, "signal", "full")
    return both.select("signal", F.col("_a").isNotNull().alias("old"), F.col("_b").isNotNull().alias("new"), F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("alike"))
