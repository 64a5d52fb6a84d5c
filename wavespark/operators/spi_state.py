"""Modes that one frame leaves for those after it, composed over long buses.

What a frame means depends on the mode it finds, so a bus seems to be one sequential task. But what frames do is a map from
the mode before them to the mode after them, and maps compose: the maps of a bucket are composed in order, and the
buckets' own maps are scanned the same way, level by level. No task sees more than ``BUCKET`` of them, whatever the length of the bus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import settled

BUCKET = 128


def before_each(maps: DataFrame, keys: list[str], place: str, value: str, size: int = BUCKET, modes: int = 1) -> DataFrame:
    """maps: keys, a place (from 0, one row each) and an array that maps numbers below ``modes`` to numbers. Adds ``before``, the composition
    of all maps before each place. Each level is written once, as the next one and its own rows are made of it."""
    same = F.array(*[F.lit(i) for i in range(modes)])
    size = max(2, size)
    chained = lambda first, then: F.transform(first, lambda s: F.get(then, s))
    listed = maps.select(*keys, F.floor(F.col(place) / size).cast("long").alias("_bucket"), F.struct(F.col(place).alias("p"), F.col(value).alias("m")).alias("_one"))
    grouped = listed.groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list("_one")).alias("_all"))
    upto = F.aggregate("_all", F.array(same), lambda acc, x: F.concat(acc, F.array(chained(F.element_at(acc, -1), x["m"]))))
    grouped = settled(grouped.withColumn("_upto", upto), "maps")
    if grouped.where("_bucket > 0").isEmpty():
        carried = grouped.withColumn("_carry", same)
    else:
        totals = grouped.select(*keys, "_bucket", F.element_at("_upto", -1).alias("_total"))
        above = before_each(totals, keys, "_bucket", "_total", size, modes).select(*keys, "_bucket", F.col("before").alias("_carry"))
        carried = grouped.join(above, [*keys, "_bucket"])
    each = carried.select(*keys, "_carry", F.explode(F.arrays_zip(F.transform("_all", lambda x: x["p"]).alias("p"), F.slice("_upto", F.lit(1), F.size("_all")).alias("m"))).alias("_x"))
    return each.select(*keys, F.col("_x.p").alias(place), chained(F.col("_carry"), F.col("_x.m")).alias("before"))
