"""Logic-analyser CSV: a line of names, a line of radices, then a row per sample."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import parse_value, radix_of
from ..operators.axis import BUCKET, fill_forward, neighbour, number_rows
from ..operators.runs import KEYS, encode, merge_seams
from .files import first_lines, lines, numbered, settled, split_name, write_in_order

META = ("sample in buffer", "sample in window")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    radix: str
    width: int | None
    meta: bool


def specs(names: list[str], radices: list[str]) -> list[ColumnSpec]:
    """What the two header lines say."""
    if len(names) != len(radices) or len(set(names)) != len(names):
        raise ValueError("the header lines must have as many fields, and names must be distinct")
    if not radices[0].lower().startswith("radix"):
        raise ValueError("line 2 must give the radix of each column")
    out = []
    for name, text in zip(names, radices, strict=True):
        ends = re.search(r"\[(\d+):(\d+)\]$", name)
        out.append(ColumnSpec(name, radix_of(text.split("-")[-1].strip()), abs(int(ends[1]) - int(ends[2])) + 1 if ends else None, name.lower() in META))
    if all(s.meta for s in out):
        raise ValueError("there is no signal column")
    return out


def _head(spark: SparkSession, path: str) -> list[ColumnSpec]:
    head = [line.lstrip("\ufeff").rstrip("\r") for line in first_lines(spark, path, 2)]
    if len(head) < 2:
        raise ValueError("a capture has two header lines")
    return specs(*[[c.strip() for c in next(csv.reader([line]))] for line in head])


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """A row per split of the text: lines, and lines with an odd number of quotes (a cell begins or ends there that has several)."""
    raw = spark.read.text(path).select(split_name().alias("block"), (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))) ).alias("_q"))
    return settled(raw.groupBy("block").agg(F.count("*").alias("lines"), F.count_if(F.col("_q") % 2 == 1).alias("odd")), "csv-splits")


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[ColumnSpec]]:
    """Data rows ``sample``, ``row`` (the number from 0 of their last line), ``cells``, and the columns.

    Whether a line begins inside quotes follows from the quotes before it: they are summed within splits, and the sums of the
    splits over those before, so that lines of one record find each other across splits.
    """
    columns = _head(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    text = numbered(lines(spark, path), "row").withColumn("_q", quotes)
    w = Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    sums = text.groupBy("block").agg(F.sum("_q").alias("_sum"))
    before = sums.select(F.col("block").alias("_b"), F.coalesce(F.sum("_sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))  # a row for each split
    told = text.withColumn("_inside", F.coalesce(F.sum("_q").over(w), F.lit(0))).join(before, F.col("block") == F.col("_b")).withColumn("_inside", (F.col("_inside") + F.col("_carry")) % 2 == 1)
    first = F.when(~F.col("_inside"), F.col("row"))
    # A record is known by its first line; only lines within one have to look for it.
    begun = fill_forward(told.withColumn("_first", first).select("row", "value", "_first", "_inside", "_q"), [F.col("row")], "row", ["_first"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda x: F.regexp_replace(x["value"], "\r$", "")), "\n")
    records = begun.groupBy("_first").agg(joined.alias("value"), F.max("row").alias("row"), F.sum("_q").alias("_q")).where("_first > 1")
    body = records.where(F.trim(F.translate("value", ',"\n', "")) != "").withColumn("cells", _cells(F.col("value")))
    wrong = body.agg(F.min(F.when(F.col("_q") % 2 == 1, F.col("_first"))).alias("open"), F.min(F.when(F.size("cells") != len(columns), F.struct("row", F.size("cells").alias("n")))).alias("size")).first()
    if wrong.open is not None:
        raise ValueError(f"line {wrong.open + 1} has a quoted cell that doesn't end")
    if wrong.size is not None:
        raise ValueError(f"line {wrong.size.row + 1} doesn't have {len(columns)} cells but {wrong.size.n}")
    return number_rows(body.select("cells", "row"), "row", (), "sample"), columns


def _changes(spark: SparkSession, path: str, columns: list[ColumnSpec], splits: DataFrame) -> DataFrame:
    """Rows where a cell is not that of the row before in its split: ``signal``, ``sample``, ``txt``, with ``count`` of all samples; for files whose
    records are lines. Each split is read once where it lies, and what leaves it are changes and one row of its own."""
    width, keep = len(columns), [i for i, c in enumerate(columns) if not c.meta]
    names = [c.name for c in columns]
    head: dict[str, int] = {}
    left = 2
    for r in splits.orderBy("block").limit(64).collect():  # the header's lines may lie in several of the first splits
        head[r.block] = min(left, r.lines)
        left -= head[r.block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows: split, column (-1: the split itself, -2: a wrong line), place, text; of the split its samples and lines.
        out: list[tuple] = []
        block, was, n, line = None, [None] * width, 0, 0

        def put() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["block", "column", "place", "txt", "lines"])
            out.clear()
            return batch

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != block:
                    if block is not None:
                        out.append((block, -1, n, None, line))
                    block, was, n, line = name, [None] * width, 0, 0
                line += 1
                if line <= head.get(block, 0):
                    continue
                value = value.rstrip("\r")
                cells = next(csv.reader([value]), []) if '"' in value else value.split(",")
                if not any(map(str.strip, cells)):
                    continue
                if len(cells) != width:
                    out.append((block, -2, line, str(len(cells)), line))
                    continue
                if cells != was:
                    for i in keep:
                        if cells[i] != was[i]:
                            out.append((block, i, n, cells[i].strip(), line))
                    was = cells
                n += 1
                if len(out) >= 20_000:
                    yield put()
        if block is not None:
            out.append((block, -1, n, None, line))
        if out:
            yield put()

    told = settled(spark.read.text(path).select(split_name().alias("block"), "value").mapInArrow(run, "block string, column int, place long, txt string, lines long"), "csv-changes")
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    sums = told.where("column = -1").select(F.col("block").alias("_b"), F.coalesce(F.sum("place").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("lines").over(w), F.lit(0)).alias("_lines"), F.sum("place").over(Window.partitionBy()).alias("count"))
    placed = told.where("column <> -1").join(sums, F.col("block") == F.col("_b"))
    wrong = placed.where("column = -2").agg(F.min(F.struct((F.col("_lines") + F.col("place")).alias("at"), "txt"))).first()[0]
    if wrong is not None:
        raise ValueError(f"line {wrong['at']} doesn't have {width} cells but {wrong['txt']}")
    return placed.select(F.element_at(F.array(*map(F.lit, names)), F.col("column") + 1).alias("signal"), (F.col("_before") + F.col("place")).alias("sample"), "txt", "count")


def _cells(line: Column) -> Column:
    """The cells of a line; quotes around a cell are taken off, and two inside it are one."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r'(?s),\s*("(?:[^"]|"")*"|[^,]*)'), 1)
    bare = F.transform(quoted, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, ","))


def _checked(parsed: DataFrame, columns: list[ColumnSpec]) -> tuple[DataFrame, list[ColumnSpec]]:
    """parsed: ``signal``, ``start``, ``txt``, ``v``. Raises for the first cell that is no value or doesn't fit the width that
    its column names; patterns of negative numbers get their sign, and columns without a width the least that holds all."""
    named = [(c.name, c.radix, c.width) for c in columns if not c.meta]
    spec = lambda i, kind: F.create_map(*[F.lit(x).cast(t) for c in named for x, t in ((c[0], "string"), (c[i], kind))])[F.col("signal")]
    own = parsed.withColumn("_radix", spec(1, "string")).withColumn("_width", spec(2, "int"))
    num, width = F.col("v.num"), F.col("_width")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(62)))
    fits = F.when(num.isNotNull(), (width >= 63) | (num < power(width)) & (num >= -power(width - 1))).when(F.col("v.wide").isNotNull(), F.length("v.wide") <= width)
    none = F.col("v.num").isNull() & F.col("v.wide").isNull() & F.col("v.txt").isNull()
    # Texts with X or Z take whole digits: a number as wide as they are may hold more bits than the column.
    size = F.length(F.bin(F.when(num < 0, -(num + 1)).otherwise(num))) + ((num < 0) | (F.col("_radix") == "SIGNED")).cast("int")
    digits = F.when(F.col("_radix") == "HEX", 4).when(F.col("_radix") == "OCTAL", 3).otherwise(1)
    need = F.coalesce(size, F.length("v.wide"), F.length("v.txt") * digits)
    told = own.groupBy("signal").agg(
        F.min(F.when(none, F.struct("start", "txt"))).alias("bad"),
        F.min(F.when(width.isNotNull() & ~F.coalesce(fits, F.lit(True)), F.struct("start", "txt"))).alias("over"),
        F.max(need).alias("need"),
    )
    needs = {}
    for r in told.collect():  # a row per column of the file
        for what, why in ((r.bad, "is no value"), (r.over, "doesn't fit its width")):
            if what is not None:
                raise ValueError(f"sample {what['start']}, {r.signal}: {what['txt']!r} {why}")
        needs[r.signal] = r.need
    columns = [c if c.meta or c.width is not None else replace(c, width=max(1, needs.get(c.name) or 1)) for c in columns]
    wrap = (F.col("_radix") == "SIGNED") & (width <= 62) & (num >= power(width - 1))
    signed = F.when(wrap, num - power(width)).otherwise(num)
    return own.select("capture_id", "signal", "start", "end", signed.alias("num"), F.coalesce("v.wide", "v.txt").alias("txt")), columns


def read_csv_capture(spark: SparkSession, path: str, capture_id: int = 0, size: int | None = BUCKET) -> tuple[DataFrame, list[ColumnSpec]]:
    """Runs of a capture file (or folder of parts) and its columns, with their widths. Cells are run-length encoded as text
    first, so only changes are parsed.

    Blank lines and lines of empty cells are skipped; a row of another number of cells, a cell that is no value of its
    radix and one that doesn't fit the width its column names are errors that name the first such place. Quoted cells may hold commas and
    line ends. size: samples in a bucket.
    """
    columns, splits = _head(spark, path), _splits(spark, path)
    if splits.where("odd > 0").isEmpty():
        changes = _changes(spark, path, columns, splits)
        told = neighbour(changes.withColumn("capture_id", F.lit(capture_id).cast("long")), "sample", ["txt"], KEYS, size)
        fresh = told.where(F.col("_prior").isNull() | (F.col("_prior.txt") != F.col("txt"))).drop("_prior").withColumnRenamed("sample", "start")
        ended = neighbour(fresh, "start", ["start"], KEYS, size, "_next", after=True)
        coded = ended.select(*KEYS, "start", F.coalesce("_next.start", "count").alias("end"), "txt")
    else:
        dense, columns = _rows(spark, path)
        names = F.array(*[F.lit(c.name) for c in columns])
        cells = dense.select(F.lit(capture_id).cast("long").alias("capture_id"), "sample", F.posexplode("cells").alias("column", "cell"))
        keep = [i for i, c in enumerate(columns) if not c.meta]
        signals = cells.where(F.col("column").isin(keep)).select("capture_id", F.element_at(names, F.col("column") + 1).alias("signal"), "sample", F.lit(None).cast("long").alias("num"), F.trim(F.translate("cell", "\n\t", "  ")).alias("txt"))
        coded = encode(settled(signals, "csv-cells"), size)
    value = None
    for c in columns:
        one = parse_value(F.col("txt"), c.radix)
        value = F.when(F.col("signal") == c.name, one) if value is None else value.when(F.col("signal") == c.name, one)
    runs, columns = _checked(settled(coded.withColumn("v", value), "csv-runs"), columns)
    return merge_seams(runs, size), columns


def read_csv_meta(spark: SparkSession, path: str) -> DataFrame:
    """``sample`` and the columns about the buffer, as integers."""
    dense, columns = _rows(spark, path)
    picked = [F.trim(F.get("cells", F.lit(i))).cast("long").alias(c.name) for i, c in enumerate(columns) if c.meta]
    return dense.select("sample", *picked)


def write_csv_capture(wide: DataFrame, signals: dict[str, str], path: str) -> None:
    """The samples of one capture as a folder of parts in the order of samples, written side by side; signals: column name
    to radix."""
    text = {"HEX": lambda c: F.hex(c), "BINARY": lambda c: F.bin(c)}
    cells = [F.col("sample").cast("string")] + [text.get(r, lambda c: c.cast("string"))(F.col(n)) for n, r in signals.items()]
    rows = wide.select(F.col("sample").alias("k"), F.concat_ws(",", *cells).alias("value"))
    spark = wide.sparkSession
    head = spark.createDataFrame([(-2, ",".join(["Sample in Buffer", *signals])), (-1, ",".join(["Radix - UNSIGNED", *[r for r in signals.values()]]))], "k long, value string")
    write_in_order(head.unionByName(rows), ["k"], path)
