"""SPI and QSPI: frames, transfers, and the fields of each frame, decoded by joins and sums.

The plan of a frame (lines of command, address and data, address bytes, dummy clocks, direction) is a row: fixed for all
frames, or joined by the frame's own opcode. Which field a transfer belongs to follows from its ordinal alone, so frames
are decoded side by side in one aggregation.

On one line the master drives ``io0`` and the slave answers on ``io1``: data of a read are taken from ``io1`` (lane ``in``), all
else from ``io0`` (lane ``out``). Where nothing says which way data go (direction ``both``), both lanes are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import level
from ..sources.files import write_bytes
from .axis import fill_forward, neighbour, number_rows
from .flash import Command, common

FRAME = ["capture_id", "frame"]


def command_table(spark: SparkSession, commands: tuple[Command, ...] | None = None, lines: int = 1) -> DataFrame:
    """Commands without both-edge transfers as a table, as they look in the protocol of so many lines; its size is that of the set."""
    rows = []
    for c in commands or common():
        if not c.dtr:
            _, address, data = c.lines(lines)
            rows.append((c.code, c.name, c.address, max(address, 1), c.clocks(lines), data if c.data != "none" else 0, c.data if c.data != "none" else ""))
    return spark.createDataFrame(rows, "opcode int, name string, address_bytes int, address_lines int, dummy int, data_lines int, direction string")


def frames(runs: DataFrame, select: str = "cs", active: int = 0, size: int | None = None) -> DataFrame:
    """Intervals in which the select line is active, numbered per capture; X ends a frame. A frame that touches an end of
    the capture is ``truncated``."""
    own = runs.where(F.col("signal") == select)
    ends = own.groupBy("capture_id").agg(F.max("end").alias("count"))
    on = own.where(level(F.col("num")) == active).select("capture_id", "start", "end")
    if size is None:
        on = on.withColumn("frame", F.row_number().over(Window.partitionBy("capture_id").orderBy("start")) - 1)
    else:
        on = number_rows(on, "start", ["capture_id"], "frame", size)
    cut = (F.col("start") == 0) | (F.col("end") == F.col("count"))
    return on.join(ends, "capture_id").select("capture_id", F.col("frame").cast("long").alias("frame"), "start", "end", cut.alias("truncated"))


def whole_capture(runs: DataFrame) -> DataFrame:
    """The frames of a bus without a select line: each capture is one."""
    return runs.groupBy("capture_id").agg(F.lit(0).cast("long").alias("frame"), F.min("start").alias("start"), F.max("end").alias("end")).withColumn("truncated", F.lit(True))


def clock_edges(runs: DataFrame, framed: DataFrame, clock: str = "sck", lines: tuple[str, ...] = ("io0",), before_edge: bool = False, falling: bool = False, size: int | None = None) -> DataFrame:
    """All edges of the clock inside frames, with ``own`` (a sampling one) and the level of each line (-1: unknown).

    The changes of the clock and of all lines and the ends of the frames are one stream per capture, in which levels are
    carried forward: one shuffle. before_edge: lines are read a sample before the edge; falling: the clock samples as it falls.
    """
    moved = runs.where(F.col("signal").isin(clock, *lines)).select("capture_id", F.col("start").alias("pos"), "signal", level(F.col("num")).alias("level"), F.lit(None).cast("long").alias("frame"))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.col("frame").cast("long").alias("frame")), F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("frame")))
    marks = framed.select("capture_id", F.explode(ends).alias("m")).select("capture_id", "m.pos", F.lit(None).cast("string").alias("signal"), F.lit(None).cast("int").alias("level"), "m.frame")
    stream = moved.unionByName(marks)
    if size is None:
        stream = stream.repartition("capture_id")  # serves the grouping and the windows after it
    wires = {clock: "_clock"} | {n: f"_line{i}" for i, n in enumerate(lines)}
    at = stream.groupBy("capture_id", "pos").agg(*[F.max(F.when(F.col("signal") == n, F.col("level"))).alias(c) for n, c in wires.items()], F.max("frame").alias("_frame"))
    held = [*wires.values(), "_frame"]
    filled = neighbour(fill_forward(at, [F.col("pos")], "pos", held, ["capture_id"], size), "pos", held, ["capture_id"], size, "_was")
    rose, fell = (F.col("_was._clock") == 0) & (F.col("_clock") == 1), (F.col("_was._clock") == 1) & (F.col("_clock") == 0)
    levels = [F.coalesce(F.col(f"_was.{c}") if before_edge else F.col(c), F.lit(-1)).alias(n) for n, c in wires.items() if n != clock]
    inside = filled.where((F.col("_frame") >= 0) & (rose | fell))
    return inside.select("capture_id", F.col("_frame").alias("frame"), F.col("pos").alias("edge"), (fell if falling else rose).alias("own"), *levels)


def transfers(runs: DataFrame, framed: DataFrame, clock: str = "sck", lines: tuple[str, ...] = ("io0",), before_edge: bool = False, falling: bool = False, both_edges: bool = False, size: int | None = None) -> DataFrame:
    """Sampling edges inside frames (``clock_edges``) with their ordinal. both_edges: every edge samples, from the first
    sampling one of a frame on."""
    found = clock_edges(runs, framed, clock, lines, before_edge, falling, size)
    w = Window.partitionBy(*FRAME).orderBy("edge")
    if both_edges:
        found = found.withColumn("_begun", F.max("own").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_begun").drop("_begun")
    else:
        found = found.where("own")
    return found.withColumn("ordinal", F.row_number().over(w) - 1).drop("own")


def _level(names: tuple[str, ...], k: int) -> Column:
    """A line that isn't there is unknown."""
    return F.col(names[k]) if k < len(names) else F.lit(-1)


def _bits(lines: Column, lane: Column, names: tuple[str, ...]) -> tuple[Column, Column]:
    """What one transfer carries on 1, 2 or 4 lines, the highest line first (an unknown bit counts as 0), and whether any of
    them is unknown."""
    one = F.when(lane == "in", _level(names, 1)).otherwise(_level(names, 0))
    value, unknown = F.greatest(one, F.lit(0)), one < 0
    for n in (2, 4):
        value = F.when(lines == n, sum((F.greatest(_level(names, k), F.lit(0)) * F.lit(1 << k) for k in range(n)), F.lit(0))).otherwise(value)
        some = F.lit(False)
        for k in range(n):
            some = some | (_level(names, k) < 0)
        unknown = F.when(lines == n, some).otherwise(unknown)
    return value.cast("long"), unknown


def opcodes(moved: DataFrame, line: str = "io0") -> DataFrame:
    """The first eight transfers of each frame, as a number (null if they are fewer or unknown)."""
    first = moved.where("ordinal < 8")
    bits = F.sum(F.greatest(F.col(line), F.lit(0)) * F.call_function("shiftleft", F.lit(1), (7 - F.col("ordinal")).cast("int")))
    return first.groupBy(*FRAME).agg(F.when((F.count("*") == 8) & (F.min(line) >= 0), bits).cast("int").alias("opcode"))


def planned(moved: DataFrame, commands: DataFrame) -> DataFrame:
    """Each frame's plan, by its opcode; opcodes that the table lacks are data on one line, either way. A frame whose opcode has an
    unknown bit, or isn't whole, asks for nothing: what follows has no plan."""
    plan = opcodes(moved).join(F.broadcast(commands), "opcode", "left")
    none = {"address_bytes": 0, "address_lines": 1, "dummy": 0, "data_lines": F.when(F.col("opcode").isNull(), 0).otherwise(1), "direction": F.when(F.col("opcode").isNull(), "none").otherwise("both")}
    return plan.select(*FRAME, "opcode", "name", F.lit(1).alias("command_lines"), *[F.coalesce(c, v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in none.items()])


def fields(moved: DataFrame, plan: DataFrame, names: tuple[str, ...] = ("io0",), lowest_first: bool = False) -> DataFrame:
    """Fields of all frames: kind (CMD, ADDR, DUMMY, DATA), lane, unit in the kind, start, end, value, bytes in the value,
    partial, unknown; ``main`` marks all but the second lane of data that go either way.

    plan: per frame ``command_lines`` (0: none), ``address_bytes``, ``address_lines``, ``dummy``, ``data_lines``, ``direction``.
    lowest_first: data bytes begin with their lowest bit.
    """
    c = F.col
    size = lambda bits, lines: F.when(lines > 0, F.ceil(bits / F.greatest(lines, F.lit(1)))).otherwise(F.lit(0)).cast("long")
    own = moved.join(plan, FRAME).where((c("direction") != "none") | (c("ordinal") * c("command_lines") < 8)).withColumn("_c", size(F.lit(8), c("command_lines"))).withColumn("_a", size(c("address_bytes") * 8, c("address_lines")))
    own = own.withColumn("_from_a", c("_c")).withColumn("_from_d", c("_c") + c("_a")).withColumn("_from_x", c("_c") + c("_a") + c("dummy"))
    o = c("ordinal")
    kind = F.when(o < c("_from_a"), "CMD").when(o < c("_from_d"), "ADDR").when(o < c("_from_x"), "DUMMY").otherwise("DATA")
    own = own.withColumn("kind", kind)
    lines = F.when(kind == "CMD", c("command_lines")).when(kind == "ADDR", c("address_lines")).when(kind == "DUMMY", F.lit(1)).otherwise(F.greatest(c("data_lines"), F.lit(1)))
    first = F.when(kind == "CMD", F.lit(0)).when(kind == "ADDR", c("_from_a")).when(kind == "DUMMY", c("_from_d")).otherwise(c("_from_x"))
    need = F.when(kind == "CMD", c("_c")).when(kind == "ADDR", c("_a")).when(kind == "DUMMY", c("dummy")).otherwise(F.ceil(F.lit(8) / F.greatest(c("data_lines"), F.lit(1)))).cast("long")
    own = own.withColumn("_lines", lines).withColumn("_need", need).withColumn("unit", F.floor((o - first) / F.greatest(need, F.lit(1))).cast("long"))
    single = (kind == "DATA") & (c("_lines") == 1)
    lanes = F.when(single & (c("direction") == "read"), F.array(F.lit("in"))).when(single & (c("direction") == "both") & F.lit(len(names) > 1), F.array(F.lit("out"), F.lit("in"))).otherwise(F.array(F.lit("out")))
    own = own.withColumn("_place", o - first - c("unit") * c("_need")).withColumn("lane", F.explode(lanes))
    left = F.when((kind == "DATA") & F.lit(lowest_first), c("_place")).otherwise(c("_need") - 1 - c("_place")) * c("_lines")
    bits, unknown = _bits(c("_lines"), c("lane"), names)
    value = F.when(kind == "DUMMY", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", bits, left.cast("int")))
    grouped = own.withColumn("_value", value).withColumn("_unknown", unknown & (kind != "DUMMY")).groupBy(*FRAME, "kind", "lane", "unit")
    out = grouped.agg(F.min("edge").alias("start"), F.max("edge").alias("end"), F.sum("_value").alias("value"), F.count("*").alias("_n"), F.first("_need").alias("_need"), F.max("_unknown").alias("unknown"), F.first("address_bytes").alias("_b"), F.first("direction").alias("_way"))
    main = (c("lane") == "out") | (c("_way") == "read")
    return out.select(*FRAME, "kind", "lane", main.alias("main"), "unit", "start", "end", "value", F.when(c("kind") == "ADDR", c("_b")).otherwise(F.lit(1)).cast("int").alias("bytes"), (c("_n") < c("_need")).alias("partial"), "unknown")


def raw_plan(framed: DataFrame, lines: int = 1, direction: str = "write") -> DataFrame:
    """All transfers are data."""
    return fixed_plan(framed, 0, 0, 1, 0, lines, direction)


def fixed_plan(framed: DataFrame, command_lines: int, address_bytes: int, address_lines: int, dummy: int, data_lines: int, direction: str = "write") -> DataFrame:
    values = {"command_lines": command_lines, "address_bytes": address_bytes, "address_lines": address_lines, "dummy": dummy, "data_lines": data_lines, "direction": direction}
    return framed.select(*FRAME, *[F.lit(v).alias(n) for n, v in values.items()])


def resets(moved: DataFrame, names: tuple[str, ...] = ("io0",), most: int = 8) -> DataFrame:
    """Frames in which the command lines are 1 all the time, in ``most`` transfers and more: they reset a device's mode."""
    low = F.least(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    return moved.groupBy(*FRAME).agg(F.min(low).alias("_low"), F.count("*").alias("_n")).where(f"_low = 1 AND _n >= {most}").select(*FRAME)


def transactions(found: DataFrame, plan: DataFrame, framed: DataFrame) -> DataFrame:
    """One row per frame: opcode, name, address, number of data bytes, whether anything is partial or unknown."""
    whole = ~F.col("partial") & ~F.col("unknown")
    sums = found.groupBy(*FRAME).agg(
        F.max(F.when((F.col("kind") == "ADDR") & whole, F.col("value"))).alias("address"),
        F.count_if((F.col("kind") == "DATA") & ~F.col("partial") & F.col("main")).alias("data_bytes"),
        F.max((F.col("partial") | F.col("unknown")) & F.col("main")).alias("problem"),
    )
    return framed.join(sums, FRAME, "left").join(plan.select(*FRAME, "opcode", "name"), FRAME, "left").withColumn("data_bytes", F.coalesce("data_bytes", F.lit(0).cast("long")))


def summary(told: DataFrame) -> DataFrame:
    """Per capture its frames, data bytes, frames with a problem and frames of an unknown command. told: ``transactions``."""
    unknown = F.col("opcode").isNotNull() & F.col("name").isNull()
    return told.groupBy("capture_id").agg(F.count("*").alias("frames"), F.sum("data_bytes").alias("data_bytes"), F.count_if("problem").alias("problems"), F.count_if(unknown).alias("unknown"))


def find_values(found: DataFrame, kind: str, low: int, high: int | None = None) -> DataFrame:
    """Commands (``CMD``) or addresses (``ADDR``) in a range, of fields that are whole and known."""
    hit = (F.col("kind") == kind) & ~F.col("partial") & ~F.col("unknown") & F.col("value").between(low, low if high is None else high)
    return found.where(hit).select(*FRAME, "start")


def find_bytes(found: DataFrame, wanted: list[int], data_only: bool = False) -> DataFrame:
    """Where bytes follow each other in a frame (address bytes highest first, dummy clocks are none of them). Of data that go
    either way each lane follows the command."""
    size = F.col("bytes")
    known = found.where("kind <> 'DUMMY' AND NOT partial" + " AND kind = 'DATA'" * data_only).withColumn("k", F.explode(F.sequence(F.lit(0), size - 1)))
    byte = F.call_function("shiftright", F.col("value"), (8 * (size - 1 - F.col("k"))).cast("int")).bitwiseAND(F.lit(255))
    rank = F.when(F.col("kind") == "CMD", 0).when(F.col("kind") == "ADDR", 1).otherwise(2)
    streams = F.when(F.col("kind") != "DATA", F.array(F.lit(True), F.lit(False))).otherwise(F.array("main"))
    stream = known.select(*FRAME, F.explode(streams).alias("of"), F.struct(rank.alias("r"), "unit", "k").alias("place"), "start", F.when(~F.col("unknown"), byte).alias("byte"))
    w = Window.partitionBy(*FRAME, "of").orderBy("place")
    hit = F.lit(True)
    for i, b in enumerate(wanted):
        hit = hit & F.coalesce((F.lead("byte", i).over(w) if i else F.col("byte")) == b, F.lit(False))
    return stream.withColumn("_hit", hit).where("_hit").select(*FRAME, "start").distinct()


def frames_span(found: DataFrame, data_only: bool = False) -> DataFrame:
    """Per capture from where to where its fields reach."""
    own = found.where("kind = 'DATA'") if data_only else found
    return own.groupBy("capture_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def format_histogram(plan: DataFrame) -> DataFrame:
    """How often each format of frame occurs, and where first."""
    key = ["command_lines", "address_lines", "data_lines", "dummy"]
    return plan.groupBy(*key).agg(F.count("*").alias("frames"), F.min(F.struct(*FRAME)).alias("_f")).select(*key, "frames", F.col("_f.capture_id").alias("first_capture"), F.col("_f.frame").alias("first_frame"))


def export_frames(found: DataFrame, separator: str = " ", lane: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """Data bytes of each frame as hexadecimal text: of its main lane or of a named one, and of fields that start in
    [start, end)."""
    data = found.where("kind = 'DATA' AND NOT partial").where(F.col("main") if lane is None else F.col("lane") == lane).where(F.col("start") >= start)
    data = data if end is None else data.where(F.col("start") < end)
    one = F.struct("unit", F.when(F.col("unknown"), F.lit("XX")).otherwise(F.lpad(F.hex("value"), 2, "0")).alias("t"))
    return data.groupBy(*FRAME).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), separator).alias("text"))


def export_binary(found: DataFrame, path: str) -> DataFrame:
    """Writes the data bytes of all captures' main lanes, in order, as a folder of parts (``sources.files.write_bytes``), one byte a field.
    An unknown byte is an error that names its place, found before anything is written: what lay at the path stays. Returns the parts."""
    data = found.where("kind NOT IN ('CMD', 'ADDR', 'DUMMY', 'RESET') AND NOT partial").where(F.col("main") if "main" in found.columns else F.col("lane") == 0)
    bad = data.where("unknown").agg(F.min(F.struct(*FRAME, "start"))).first()[0]
    if bad is not None:
        raise ValueError(f"capture {bad.capture_id}, frame {bad.frame}: the byte at {bad.start} is unknown")
    return write_bytes(data.select("capture_id", "start", F.unhex(F.lpad(F.hex("value"), 2, "0")).alias("value")), ["capture_id", "start"], path)
