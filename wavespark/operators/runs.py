"""Run-length intervals: encode, decode, dictionary, and lookups of values and changes.

A run says that ``num`` (or, if that is null, ``txt``) holds on [start, end); runs have ``capture_id`` and ``signal``.
Captures and signals are worked on side by side; a ``size`` cuts each of them into buckets too, and rows and values that
a bucket must know of its neighbours are carried over (``axis``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import bit_of, digits_of, labels
from .axis import fill_forward, neighbour

KEYS = ("capture_id", "signal")


def unlike(a: Column, b: Column) -> Column:
    """Different, where nulls are equal: a first row differs from what isn't there only by its own flag."""
    return ~a.eqNullSafe(b)


def encode(samples: DataFrame, size: int | None = None) -> DataFrame:
    """samples: capture_id, signal, sample, num, txt, in dense order per signal. The rows where the value changes; sample
    0 always starts a run, and the last run ends where the samples do. size: samples in a bucket, for signals too long
    for one task."""
    told = neighbour(samples, "sample", ["num", "txt"], KEYS, size)
    change = F.col("_prior").isNull() | unlike(F.col("_prior.num"), F.col("num")) | unlike(F.col("_prior.txt"), F.col("txt"))
    kept = told.withColumn("_new", change)
    if size is None:
        kept = kept.withColumn("_count", F.max("sample").over(Window.partitionBy(*KEYS)) + 1).where("_new")
    else:
        kept = kept.where("_new").join(samples.groupBy(*KEYS).agg((F.max("sample") + 1).alias("_count")), list(KEYS))
    ended = neighbour(kept.withColumnRenamed("sample", "start").drop("_prior", "_new"), "start", ["start"], KEYS, size, "_next", after=True)
    return ended.select(*KEYS, "start", F.coalesce("_next.start", "_count").alias("end"), "num", "txt")


def long_form(wide: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """A table with a column per signal as rows capture_id, signal, sample, num, txt. Text signals go to ``txt``."""
    parts = []
    for name, col in signals.items():
        is_text = wide.select(col.alias("c")).schema["c"].dataType.simpleString() == "string"
        num = F.lit(None).cast("long") if is_text else col.cast("long")
        txt = col if is_text else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(name).alias("signal"), num.alias("num"), txt.alias("txt")))
    return wide.select("capture_id", "sample", F.explode(F.array(*parts)).alias("s")).select("capture_id", "s.signal", "sample", "s.num", "s.txt")


def decode(runs: DataFrame) -> DataFrame:
    return runs.select(*KEYS, F.explode(F.sequence("start", F.col("end") - 1)).alias("sample"), "num", "txt")


def merge_seams(parts: DataFrame, size: int | None = None) -> DataFrame:
    """Runs of consecutive pieces of one capture: equal neighbours at the seams become one."""
    told = neighbour(parts, "start", ["num", "txt"], KEYS, size)
    same = F.col("_prior").isNotNull() & F.col("_prior.num").eqNullSafe(F.col("num")) & F.col("_prior.txt").eqNullSafe(F.col("txt"))
    told = told.withColumn("_same", same)
    if size is None:
        kept = told.withColumn("_stop", F.max("end").over(Window.partitionBy(*KEYS))).where("NOT _same")
    else:
        kept = told.where("NOT _same").join(parts.groupBy(*KEYS).agg(F.max("end").alias("_stop")), list(KEYS))
    ended = neighbour(kept.drop("_prior", "_same"), "start", ["start"], KEYS, size, "_next", after=True)
    return ended.withColumn("end", F.coalesce("_next.start", "_stop")).drop("_next", "_stop")


def dictionary(runs: DataFrame) -> DataFrame:
    """Codes of the values of each signal in the order of their first appearance."""
    first = runs.groupBy(*KEYS, "num", "txt").agg(F.min("start").alias("first"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy(*KEYS).orderBy("first")) - 1)


def transitions(runs: DataFrame) -> DataFrame:
    """Starts of all runs but the first."""
    return runs.where("start > 0")


def next_change(runs: DataFrame, sample: int, forward: bool = True) -> DataFrame:
    """Per signal the next change after, or the last one before a sample; null if there is none."""
    hit = F.when(F.col("start") > 0, F.when(F.col("start") > sample if forward else F.col("start") < sample, F.col("start")))
    return runs.groupBy(*KEYS).agg((F.min if forward else F.max)(hit).alias("start"))


def search(runs: DataFrame, num: int, sample: int, forward: bool = True, wrap: bool = True) -> DataFrame:
    """Per signal the next (last) start of a run with the value, and whether the search went past the end."""
    hits = runs.where(F.col("num") == num)
    ahead, best, other = (F.col("start") > sample, F.min, F.min) if forward else (F.col("start") < sample, F.max, F.max)
    found = hits.groupBy(*KEYS).agg(best(F.when(ahead, F.col("start"))).alias("near"), other(F.when(~ahead, F.col("start"))).alias("past"))
    start = F.coalesce("near", "past") if wrap else F.col("near")
    return found.select(*KEYS, start.alias("start"), (F.col("near").isNull() & start.isNotNull()).alias("wrapped")).where("start IS NOT NULL")


def expand_bits(runs: DataFrame, width: int, radix: str = "BINARY", size: int | None = None) -> DataFrame:
    """The bits of a bus as signals of their own, run-length encoded again. A bit of a value that is unknown in part is 0 or
    1, or else X, Z or ?. A range at the end of the bus's name says how its bits are called."""
    digits = digits_of(F.col("num"), F.col("txt"), radix, width)
    each = runs.withColumn("_digits", digits).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    d = bit_of(F.col("_digits"), F.col("offset"))
    name = F.concat(F.regexp_replace("signal", r"\[\d+\s*:\s*\d+\]$", ""), F.lit("["), labels(F.col("signal"), width, F.col("offset")).cast("string"), F.lit("]"))
    child = each.select("capture_id", name.alias("signal"), "start", "end", F.when(d.isin("0", "1"), d.cast("long")).alias("num"), F.when(~d.isin("0", "1"), d).alias("txt"))
    return merge_seams(child, size)


def assemble_bus(runs: DataFrame, members: list[str], name: str, size: int | None = None) -> DataFrame:
    """One bus of several one-bit signals, the highest bit first: at each change of any, all members' values."""
    of = runs.where(F.col("signal").isin(members))
    at = of.groupBy("capture_id", "start").agg(*[F.max(F.when(F.col("signal") == m, F.coalesce(F.col("num").cast("string"), "txt"))).alias(f"_m{i}") for i, m in enumerate(members)])
    cols = [f"_m{i}" for i in range(len(members))]
    filled = fill_forward(at, [F.col("start")], "start", cols, ["capture_id"], size).withColumn("_d", F.concat(*cols))
    known = F.col("_d").rlike("^[01]+$")
    value = filled.select("capture_id", F.lit(name).alias("signal"), "start", F.when(known, F.conv("_d", 2, 10).cast("long")).alias("num"), F.when(~known, F.col("_d")).alias("txt"))
    ends = of.groupBy("capture_id").agg(F.max("end").alias("count"))
    whole = neighbour(value, "start", ["start"], KEYS, size, "_next", after=True).join(ends, "capture_id").withColumn("end", F.coalesce("_next.start", "count"))
    return merge_seams(whole.select(*KEYS, "start", "end", "num", "txt"), size)


def seam_mismatches(left: DataFrame, right: DataFrame, sample: int) -> DataFrame:
    """Signals whose value at a sample isn't the same in two captures."""
    at = lambda d, n: d.where((F.col("start") <= sample) & (F.col("end") > sample)).select(*KEYS, F.struct("num", "txt").alias(n))
    return at(left, "l").join(at(right, "r"), list(KEYS), "full").where(unlike(F.col("l"), F.col("r"))).select(*KEYS)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
