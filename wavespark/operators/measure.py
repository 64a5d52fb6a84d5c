"""Measurements, exports and downsampling over runs and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import level
from ..sources.files import settled, write_in_order
from .axis import neighbour
from .joins import as_of
from .runs import KEYS

#: The largest text that an export makes, in characters.
MOST_CHARACTERS = 32_000_000


def measure_edges(runs: DataFrame, start: int, end: Column | int, size: int | None = None) -> DataFrame:
    """Rising and falling edges with their first and last rise, in (start, end]: steps between neighbouring runs of 0 and 1. Beside an
    unknown run there is no edge, so 0, X, 1 has none. size: samples in a bucket."""
    own = neighbour(runs.withColumn("_level", level(F.col("num"))), "start", ["_level"], KEYS, size)
    now, before = F.col("_level"), F.col("_prior._level")
    inside = (F.col("start") > start) & (F.col("start") <= end)
    told = own.withColumn("_rise", inside & (before == 0) & (now == 1)).withColumn("_fall", inside & (before == 1) & (now == 0))
    at = F.when(F.col("_rise"), F.col("start"))
    out = told.groupBy(*KEYS).agg(F.count_if("_rise").alias("rising"), F.count_if("_fall").alias("falling"), F.min(at).alias("first_rise"), F.max(at).alias("last_rise"))
    return out.withColumn("period", F.when(F.col("rising") > 1, (F.col("last_rise") - F.col("first_rise")) / (F.col("rising") - 1)))


def measured_period(measured: DataFrame, seconds: float, times: DataFrame | None = None) -> DataFrame:
    """measured (``measure_edges``) with ``period_ticks``, ``period_seconds`` and ``hertz``: between the first and the last rise, in rows of so many ``seconds``, or, with
    ``times`` (``capture_id``, ``sample``, ``tick``), in ticks of so many; null with fewer than two rises."""
    c = F.col
    told = measured.withColumn("_steps", F.when(c("rising") > 1, c("rising") - 1))
    if times is None:
        ticks = c("last_rise") - c("first_rise")
    else:
        at = lambda n: times.select("capture_id", c("sample").alias(f"{n}_rise"), c("tick").alias(f"_{n}"))
        told = told.join(at("first"), ["capture_id", "first_rise"], "left").join(at("last"), ["capture_id", "last_rise"], "left")
        ticks = c("_last") - c("_first")
    told = told.withColumn("period_ticks", ticks / c("_steps")).withColumn("period_seconds", c("period_ticks") * F.lit(float(seconds)))
    return told.withColumn("hertz", F.when(c("period_seconds") > 0, 1 / c("period_seconds"))).drop("_steps", "_first", "_last")


def summary(runs: DataFrame) -> DataFrame:
    """Per capture its rows, signals and changes."""
    each = runs.groupBy(*KEYS).agg(F.max("end").alias("rows"), (F.count("*") - 1).alias("changes"))
    return each.groupBy("capture_id").agg(F.max("rows").alias("rows"), F.count("*").alias("signals"), F.sum("changes").alias("changes"))


def export_changes(points: DataFrame, value: Column, by: str = "at", keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
    """Points in order without those whose value is that of the point before. size: positions in a bucket."""
    told = neighbour(points.select(*keys, by, value.alias("value")), by, ["value"], keys, size)
    return told.where(F.col("_prior").isNull() | ~F.col("_prior.value").eqNullSafe(F.col("value"))).drop("_prior")


def export_unique(points: DataFrame, value: Column, by: str = "at", keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Each value once, with its first place."""
    return points.select(*keys, by, value.alias("value")).groupBy(*keys, "value").agg(F.min(by).alias("first"))


def sorted_unique(unique: DataFrame, radix: str, descending: bool = False, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Unique values (``value`` as shown, ``num`` if it is a number) with their ``place`` from 0: numbers before texts, all reversed when falling; equal ones in
    the order of ``first``. Decimals and reals are compared as they are shown, others by ``num``."""
    shown = F.col("value").try_cast("decimal(38,0)").cast("double") if radix in ("SIGNED", "SIGNED_MAGNITUDE", "UNSIGNED") else F.col("value").try_cast("double") if radix == "REAL" else F.lit(None).cast("double")
    exact = F.col("value").try_cast("decimal(38,0)") if radix in ("SIGNED", "SIGNED_MAGNITUDE", "UNSIGNED") else F.when(shown.isNull(), F.col("num").cast("decimal(38,0)"))
    text = F.when(shown.isNull() & exact.isNull(), F.col("value"))
    order = [text.isNotNull(), shown, exact, text]
    order = [F.desc(o) if descending else F.asc(o) for o in order]
    return unique.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "first")) - 1)


def export_channels(points: DataFrame, labels: dict[str, Column], path: str, separator: str = " ", by: Sequence[str] = ("capture_id", "at"), bounded: bool = True) -> DataFrame:
    """Writes points in order as lines, a label of each channel in a line, as a folder of parts written side by side; returns ``part``, ``lines``,
    ``characters`` and ``offset`` (of its first character in the whole text). bounded: the size is summed before anything is written, and more than
    ``MOST_CHARACTERS`` are an error, for texts that one program takes whole; the folder itself may be of any size."""
    line = F.concat_ws(separator, *labels.values())
    rows = points.select(*by, line.alias("value"))
    if bounded:
        total = rows.agg(F.coalesce(F.sum(F.length("value") + 1), F.lit(0))).first()[0]
        if total > MOST_CHARACTERS:
            raise ValueError(f"the export would have {total} characters; at most {MOST_CHARACTERS} are allowed")
    dealt = settled(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "export")
    write_in_order(dealt, list(by), path)
    sums = dealt.groupBy(F.col("_part").alias("part")).agg(F.min(F.struct(*by)).alias("_first"), F.count("*").alias("lines"), F.sum(F.length("value") + 1).alias("characters"))
    w = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return sums.select("part", "lines", "characters", F.coalesce(F.sum("characters").over(w), F.lit(0)).alias("offset"))


def export_text(points: DataFrame, label: Column, separator: str = " ", by: str = "at", keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """One text per key; the lengths are summed first, so a text that would be too large is an error and not a lost task."""
    shown = points.select(*keys, by, label.alias("label"))
    most = shown.groupBy(*keys).agg((F.sum(F.length("label")) + (F.count("*") - 1) * len(separator)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_CHARACTERS:
        raise ValueError(f"the export would have {most} characters; at most {MOST_CHARACTERS} are allowed")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(by), F.col("label")))), lambda x: x["label"])
    return shown.groupBy(*keys).agg(F.array_join(ordered, separator).alias("text"))


def viewport(runs: DataFrame, left: int, right: int, columns: int) -> DataFrame:
    """A signal in a window of some pixel columns: a column is busy if its two edges fall in different runs; equal
    neighbours are one. Rows per signal are bounded by the columns, not by the capture.

    Every run is dealt to the column edges that it holds - none, for most - and so no range join is needed.
    """
    scale = (right - left) / columns
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - left) / F.lit(scale))).cast("long")
    last = F.least(F.lit(columns), F.ceil((F.col("end") - left) / F.lit(scale)) - 1).cast("long")
    held = runs.where((F.col("end") > left) & (F.col("start") <= right)).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    marks = held.select(*KEYS, F.col("start").alias("run"), "num", "txt", F.explode(F.sequence("_first", "_last")).alias("edge"))
    w = Window.partitionBy(*KEYS).orderBy("edge")
    follow = marks.withColumn("_next", F.lead("run").over(w)).withColumn("_next_edge", F.lead("edge").over(w)).where(F.col("edge") < columns)
    busy = ~F.coalesce((F.col("_next") == F.col("run")) & (F.col("_next_edge") == F.col("edge") + 1), F.col("edge") == columns)
    shown = follow.withColumn("busy", busy).withColumn("num", F.when(~F.col("busy"), F.col("num"))).withColumn("txt", F.when(~F.col("busy"), F.col("txt")))
    new = F.lag("edge").over(w).isNull() | (F.lag("busy").over(w) != F.col("busy")) | (~F.col("busy") & (F.lag("run").over(w) != F.col("run")))
    return shown.withColumn("_new", new).withColumn("_i", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*KEYS, "_i").agg(
        F.min("edge").alias("first"), F.max("edge").alias("last"), F.any_value("busy").alias("busy"), F.any_value("num").alias("num"), F.any_value("txt").alias("txt")
    ).drop("_i")


def visible_runs(runs: DataFrame, left: int, right: int) -> DataFrame:
    """The runs that a window shows, cut at its ends."""
    held = runs.where((F.col("end") > left) & (F.col("start") < right))
    return held.withColumns({"start": F.greatest("start", F.lit(left)), "end": F.least("end", F.lit(right))})


def viewport_detail(runs: DataFrame, left: int, right: int, columns: int) -> DataFrame:
    """What a window of some pixel columns shows of each signal: its runs where there are two a column at most (``exact``, from ``first`` to ``last`` sample),
    or else its columns (``viewport``). Rows per signal are at most twice the columns."""
    shown = visible_runs(runs, left, right)
    counts = shown.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    few, many = counts.where(F.col("_n") <= 2 * columns), counts.where(F.col("_n") > 2 * columns)
    exact = shown.join(few, list(KEYS), "left_semi").select(*KEYS, F.lit(True).alias("exact"), F.col("start").alias("first"), (F.col("end") - 1).alias("last"), F.lit(False).alias("busy"), "num", "txt")
    pixels = viewport(runs.join(many, list(KEYS), "left_semi"), left, right, columns)
    return exact.unionByName(pixels.select(*KEYS, F.lit(False).alias("exact"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "busy", "num", "txt"))


def viewport_by_time(runs: DataFrame, times: DataFrame, left: int, right: int, columns: int, size: int | None = None) -> DataFrame:
    """``viewport`` of a window in ticks, whose columns are equally long in time: ``first``, ``last`` column, ``busy``, value. times: ``capture_id``, ``sample``, ``tick``.

    The edges of the columns are looked up on the axis of time, then the runs at them in each signal; both are one stream, and what is kept are columns.
    """
    c = F.col
    spark = runs.sparkSession
    edges = spark.range(columns + 1).select(c("id").cast("int").alias("edge"), F.floor(F.lit(left) + c("id") * F.lit((right - left) / columns)).cast("long").alias("tick"))
    asked = times.select("capture_id").distinct().join(F.broadcast(edges))  # a row for each column edge of a capture
    placed = as_of(asked, times.withColumnRenamed("tick", "start"), "tick", ["sample"], ["capture_id"], size=size).select("capture_id", "edge", F.coalesce("sample", F.lit(0)).alias("at"))
    signals = runs.select(*KEYS).distinct()
    held = as_of(signals.join(placed, "capture_id"), runs, "at", ["num", "txt"], KEYS, size=size)
    w = Window.partitionBy(*KEYS).orderBy("edge")
    told = held.withColumn("_busy", F.lead("run_start").over(w) != c("run_start")).where(c("edge") < columns)
    fresh = F.lag("edge").over(w).isNull() | (F.lag("_busy").over(w) != c("_busy")) | (~c("_busy") & ~F.lag(F.struct("num", "txt")).over(w).eqNullSafe(F.struct("num", "txt")))
    marked = told.withColumn("_new", fresh).withColumn("_i", F.sum(c("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*KEYS, "_i").agg(F.min("edge").alias("first"), F.max("edge").alias("last"), F.any_value("_busy").alias("busy"), F.min_by("num", "edge").alias("num"), F.min_by("txt", "edge").alias("txt"))
    return out.drop("_i").withColumns({"num": F.when(~c("busy"), c("num")), "txt": F.when(~c("busy"), c("txt"))})
