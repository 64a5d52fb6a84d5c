"""Temporal joins: as-of, points in intervals, overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .axis import BUCKET, bucket_of, fill_forward, number_rows


def as_of(points: DataFrame, runs: DataFrame, at: str, values: Sequence[str], keys: Sequence[str] = ("capture_id",), start: str = "start", size: int | None = None) -> DataFrame:
    """points with the values of the last run that starts at or before ``at``, per key.

    Both sides become one stream, ordered by position (a run before a point at the same place), in which values are
    carried forward: one shuffle by key, no join on ranges. With a ``size`` (without keys always) the axis is cut into
    buckets, for captures too long for one task.
    """
    size = size or (None if keys else BUCKET)
    names = [c for c in points.columns if c not in keys]
    held = [f"_v{i}" for i in range(len(values))]
    left = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_is"), F.struct(*names).alias("_p"), *[F.lit(None).cast(runs.schema[v].dataType).alias(h) for v, h in zip(values, held, strict=True)], F.lit(None).cast("long").alias("_found"))
    right = runs.select(*keys, F.col(start).cast("long").alias("_at"), F.lit(0).alias("_is"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), *[F.col(v).alias(h) for v, h in zip(values, held, strict=True)], F.col(start).cast("long").alias("_found"))
    # All values of a run travel in one struct, so a null among them isn't taken from an earlier run.
    pack = lambda d: d.select(*keys, "_at", "_is", "_p", F.when(F.col("_is") == 0, F.struct(*held, "_found")).alias("_run"))
    filled = fill_forward(pack(left.unionByName(right)), [F.col("_at"), F.col("_is")], "_at", ["_run"], keys, size)
    return filled.where("_is = 1").select(*keys, "_p.*", *[F.col(f"_run.{h}").alias(v) for v, h in zip(values, held, strict=True)], F.col("_run._found").alias("run_start"))


def nearest(points: DataFrame, marks: DataFrame, at: str, values: Sequence[str] = (), keys: Sequence[str] = ("capture_id",), start: str = "start", forward: bool = True, strict: bool = True, size: int | None = None) -> DataFrame:
    """points with the nearest mark after (before) each, or at its own place if not ``strict``: its values and ``found``, its place; null
    where there is none. Forward is the same stream with its axis turned round."""
    turn = -1 if forward else 1
    named = marks.select(*keys, (F.col(start) * turn).alias("_m"), F.col(start).alias("_place"), *values)
    asked = points.withColumn("_q", F.col(at).cast("long") * turn - int(strict))
    out = as_of(asked, named, "_q", ["_place", *values], keys, "_m", size)
    return out.withColumnRenamed("_place", "found").drop("_q", "run_start")


def search_positions(points: DataFrame, axis: DataFrame, at: str, side: str = "left", keys: Sequence[str] = ("capture_id",), by: str = "start", size: int | None = None) -> DataFrame:
    """points with ``position``: how many places of an axis of distinct integers lie before (``left``), or at or before (``right``) any real number.

    An integer is at most a real number if it is at most its floor, and less if it is less than its ceiling, so numbers are never made
    doubles. Beyond 64 bits all or none lie before; NaN is behind all, null has no position.
    """
    key = F.col(at)
    counts = axis.groupBy(*keys).agg(F.count("*").alias("_all"))
    real = F.floor(key) if side == "right" else F.ceil(key)
    inside = (key >= F.lit(-(2.0**63))) & (key < F.lit(2.0**63)) & ~F.isnan(key.cast("double"))
    whole = F.when(inside, real.try_cast("long"))
    asked = points.withColumn("_q", whole - F.lit(int(side == "left")))
    if keys:
        numbered = number_rows(axis.select(*keys, by), by, keys, "_n", size or BUCKET)
    else:
        numbered = number_rows(axis.select(by), by, (), "_n", size or BUCKET)
    here = as_of(asked.where(F.col("_q").isNotNull()), numbered, "_q", ["_n"], keys, by, size).withColumn("position", F.coalesce(F.col("_n") + 1, F.lit(0)).cast("long")).drop("_n", "run_start")
    out = asked.where(F.col("_q").isNull())
    out = out.join(counts, list(keys), "left") if keys else out.crossJoin(counts)  # counts is one row
    behind = F.isnan(key.cast("double")) | (key > 0)
    beyond = out.withColumn("position", F.when(key.isNotNull(), F.when(behind, F.coalesce("_all", F.lit(0))).otherwise(F.lit(0))).cast("long")).drop("_all")
    return here.unionByName(beyond).drop("_q")


def points_in(points: DataFrame, intervals: DataFrame, at: str, keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
    """points that lie in one of the disjoint intervals, with its ``start`` and ``end``."""
    found = as_of(points, intervals.withColumn("_end", F.col("end")), at, ["_end"], keys, size=size)
    return found.where(F.col("_end") > F.col(at)).withColumnRenamed("run_start", "start").withColumnRenamed("_end", "end")


def overlapping(left: DataFrame, right: DataFrame, size: int, keys: Sequence[str] = (), condition: Column | None = None) -> DataFrame:
    """Pairs of intervals that overlap: ``start``/``end`` against ``r_start``/``r_end``.

    Both sides are dealt to the buckets they touch and joined there by equality; a pair counts in the bucket where its
    overlap begins, so in one only. Choose a size of the order of the intervals' length.
    """
    deal = lambda d, a, b, n: d.withColumn(n, F.explode(F.sequence(bucket_of(F.col(a), size), bucket_of(F.col(b) - 1, size))))
    a, b = deal(left, "start", "end", "_bucket"), deal(right, "r_start", "r_end", "_bucket")
    both = a.join(b, ["_bucket", *keys])
    meet = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    own = F.col("_bucket") == bucket_of(F.greatest("start", "r_start"), size)
    return both.where(meet & own if condition is None else meet & own & condition).drop("_bucket")
