"""Questions about decoded frames and fields: what lies at a place, what comes next, which frames, and one row for each frame.

Cursors are a table, so any number of them is answered in one stream per capture (``joins.as_of`` and its mirror).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of, nearest
from .measure import MOST_CHARACTERS
from .spi import FRAME
from .spi_decode import beside, format_text

#: Data bytes that a row shows.
PREVIEW = 16
DATA = ("RD", "WR", "MOSI", "MISO", "DATA")


def at_places(cursors: DataFrame, spans: DataFrame, values: Sequence[str], at: str = "at", keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
    """cursors with the values, ``start`` and ``end`` of the span (field or frame) that each lies in; null between spans."""
    found = as_of(cursors, spans.withColumn("_end", F.col("end")), at, [*values, "_end"], keys, size=size)
    inside = F.col(at) < F.col("_end")
    held = {v: F.when(inside, F.col(v)) for v in values}
    return found.withColumns(held | {"start": F.when(inside, F.col("run_start")), "end": F.when(inside, F.col("_end"))}).drop("_end", "run_start")


def boundaries(fields: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Where steps from field to field stop: each field's start, and the end of a frame's last one. fields: of one lane."""
    return _stops(fields, keys).distinct()


def _stops(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``boundaries``, some of them twice. One pass over the fields: those that lie in their captures' tasks stay there."""
    last = F.max("end").over(Window.partitionBy(*keys, "frame"))
    ends = fields.select(*keys, "frame", "start", "end").withColumn("_last", F.when(F.col("end") == last, F.col("end")))
    return ends.select(*keys, F.explode(F.array("start", "_last")).alias("start")).where("start IS NOT NULL")


def step(cursors: DataFrame, fields: DataFrame, at: str = "at", forward: bool = True, keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
    """cursors with the next (last) boundary of a field as ``found``; null where there is none."""
    return nearest(cursors, _stops(fields, keys), at, (), keys, forward=forward, size=size)


def search(cursors: DataFrame, hits: DataFrame, at: str = "at", forward: bool = True, wrap: bool = True, keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
    """cursors with the next (last) hit as ``found``; behind the last one the first is, if ``wrap``, with ``wrapped``. hits: ``start`` of fields that a
    search has found (``spi.find_values``, ``spi.find_bytes``)."""
    near = nearest(cursors, hits.select(*keys, "start").distinct(), at, (), keys, forward=forward, size=size)
    if not wrap:
        return near.withColumn("wrapped", F.lit(False))
    ends = hits.groupBy(*keys).agg((F.min if forward else F.max)("start").alias("_far"))
    told = near.join(ends, list(keys), "left")
    return told.withColumn("wrapped", F.col("found").isNull() & F.col("_far").isNotNull()).withColumn("found", F.coalesce("found", "_far")).drop("_far")


def window(fields: DataFrame, left: int, right: int) -> DataFrame:
    """Fields that touch [left, right)."""
    return fields.where((F.col("end") > left) & (F.col("start") < right))


def busy(fields: DataFrame, left: int, right: int, columns: int, keys: Sequence[str] = ("capture_id", "lane")) -> DataFrame:
    """Runs of pixel columns in which fields lie: at most ``columns`` rows a lane."""
    scale = F.lit((right - left) / columns)
    first = F.floor((F.greatest("start", F.lit(left)) - left) / scale)
    last = F.ceil((F.least("end", F.lit(right)) - left) / scale) - 1
    touched = window(fields, left, right).select(*keys, F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))).alias("column")).where(F.col("column") < columns).distinct()
    island = F.col("column") - F.row_number().over(Window.partitionBy(*keys).orderBy("column"))
    return touched.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("column").alias("first"), F.max("column").alias("last")).drop("_i")


def previews(fields: DataFrame, most: int = PREVIEW) -> DataFrame:
    """The first data bytes of each frame as text, with a mark where there are more, the answering lane behind the asking one. Only ``most`` + 1
    fields a lane are gathered: a field knows its number in the frame."""
    c = F.col
    text = F.when(c("unknown"), F.lit("XX")).when(c("partial"), F.concat(F.hex("value"), F.lit("/"), c("bits").cast("string"), F.lit("b"))).otherwise(F.lpad(F.hex("value"), 2, "0"))
    few = fields.where(c("kind").isin(*DATA) & (c("unit") <= most)).select(*FRAME, "lane", F.struct("unit", F.when(c("unit") < most, text).otherwise(F.lit("…")).alias("t")).alias("one"))
    lanes = few.groupBy(*FRAME, "lane").agg(F.array_join(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["t"]), " ").alias("text"))
    named = F.when(c("lane") == 0, c("text")).otherwise(F.concat(F.lit("MISO: "), c("text")))
    return lanes.groupBy(*FRAME).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lane", named.alias("t")))), lambda x: x["t"]), " | ").alias("preview"))


def mode_text(frames: DataFrame) -> Column:
    """The mode that a frame leaves."""
    c = frames.__getitem__
    parts = [
        F.when(c("next_lines") == 1, "Extended").when(c("next_lines") == 2, "Dual 2-2-2").otherwise("Quad 4-4-4"),
        F.when(c("next_dtr"), F.lit("DTR")),
        F.when(c("next_dummy").isNotNull(), F.concat(F.lit("dummy "), c("next_dummy").cast("string"))),
        F.when(c("next_address") == 4, F.lit("4-byte address")),
        F.when(c("next_xip").isNotNull(), F.lit("XIP")).when(c("next_xip_enabled"), F.lit("XIP enabled")),
    ]
    return F.concat_ws(", ", *parts)


def transaction_table(frames: DataFrame, fields: DataFrame, most: int = PREVIEW) -> DataFrame:
    """One row per frame as a table shows it: ``start``, ``duration``, ``command``, ``format``, ``address``, ``dummy``, ``data_bytes``, ``preview``, ``flags``."""
    told = beside(frames, previews(fields, most), how="left")
    c = told.__getitem__
    command = F.when(c("reset"), F.lit("RESET")).when(c("opcode").isNull(), F.lit("-")).otherwise(F.concat_ws(" ", F.lpad(F.hex("opcode"), 2, "0"), c("name"), F.when(c("xip_frame"), F.lit("(XIP)"))))
    flags = F.concat_ws(", ", *[F.when(c(n), F.lit(t)) for n, t in (("unknown_command", "not in the table"), ("unknown", "X/Z"), ("partial", "partial"), ("truncated", "truncated"))], F.when(c("changed"), F.concat(F.lit("-> "), mode_text(told))))
    address = F.when(c("address").isNotNull(), F.lpad(F.hex("address"), F.greatest(c("address_bytes"), F.lit(1)) * 2, F.lit("0")))
    return told.select(*FRAME, "start", (c("end") - c("start")).alias("duration"), command.alias("command"), format_text(told).alias("format"), address.alias("address"), "dummy", "data_bytes", F.coalesce("preview", F.lit("")).alias("preview"), flags.alias("flags"))


def matching(frames: DataFrame, wanted: DataFrame | None = None, problems: bool = False, resets: bool | None = None) -> DataFrame:
    """Frames that a filter keeps: those of ``wanted`` (``capture_id``, ``frame``), with something wrong, that are resets or none."""
    out = frames if wanted is None else frames.join(wanted.select(*FRAME).distinct(), FRAME, "left_semi")
    c = F.col
    if problems:
        out = out.where(c("unknown") | c("partial") | c("unknown_command") | c("truncated"))
    return out if resets is None else out.where(c("reset") == resets)


#: What an export holds: lane and kinds.
CONTENTS = {
    "data": (0, ("RD", "WR", "MOSI", "DATA")),
    "read": (0, ("RD",)),
    "write": (0, ("WR",)),
    "miso": (1, ("MISO",)),
    "all": (0, ("CMD", "ADDR", "RD", "WR", "MOSI", "DATA")),
}


def export_text(frames: DataFrame, fields: DataFrame, content: str = "data", radix: str = "HEX", separator: str = " ", prefix: bool = False, header: bool = False, start: int = 0, end: int | None = None, bounded: bool = True) -> DataFrame:
    """``text`` of each frame that has such fields (``CONTENTS``) starting in [start, end): values in ``HEX``, ``BIN`` or ``DEC`` (with 0x or 0b before them if
    ``prefix``), unknown ones as X. With a ``header`` the frame's number from 1, opcode and address stand before them. A text of all
    frames is these in order (``files.write_in_order``). bounded: the size of the whole is summed before any text is made, and more than
    ``MOST_CHARACTERS`` are an error, for texts that one program takes whole."""
    c = F.col
    lane, kinds = CONTENTS[content]
    own = fields.where((c("lane") == lane) & c("kind").isin(*kinds) & (c("start") >= start))
    own = own if end is None else own.where(c("start") < end)
    if radix == "DEC":
        text = F.when(c("unknown"), F.lit("X")).otherwise(c("value").cast("string"))
    elif radix == "BIN":
        text = F.concat(F.lit("0b" * prefix), F.when(c("unknown"), F.lit("XXXXXXXX")).otherwise(F.lpad(F.bin("value"), c("bits"), F.lit("0"))))
    else:
        text = F.concat(F.lit("0x" * prefix), F.when(c("unknown"), F.lit("XX")).otherwise(F.lpad(F.hex("value"), F.greatest(F.lit(1), F.ceil(c("bits") / 4)).cast("int"), F.lit("0"))))
    told = own.select(*FRAME, "start", text.alias("t"))
    if bounded:
        total = told.agg(F.coalesce(F.sum(F.length("t") + len(separator)), F.lit(0))).first()[0]
        if total > MOST_CHARACTERS:
            raise ValueError(f"the export would have {total} characters; at most {MOST_CHARACTERS} are allowed")
    texts = told.groupBy(*FRAME).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), separator).alias("text"))
    if not header:
        return texts
    address = F.when(c("address").isNotNull(), F.concat(F.lit("@"), F.lpad(F.hex("address"), F.greatest(F.lit(1), c("address_bytes")) * 2, F.lit("0"))))
    head = F.concat_ws(" ", F.concat(F.lit("#"), (c("frame") + 1).cast("string")), F.when(c("opcode").isNotNull(), F.lpad(F.hex("opcode"), 2, "0")), address)
    return beside(texts, frames.select(*FRAME, head.alias("_head"))).select(*FRAME, F.concat("_head", F.lit(": "), "text").alias("text"))


def as_queried(fields: DataFrame) -> DataFrame:
    """Fields as ``spi.find_values``, ``spi.find_bytes`` and ``spi.frames_span`` take them."""
    c = F.col
    kind = F.when(c("kind").isin(*DATA), F.lit("DATA")).otherwise(c("kind"))
    lane = F.when((c("lane") == 1) | (c("kind") == "RD") & (c("lines") == 1), F.lit("in")).otherwise(F.lit("out"))
    return fields.where("kind <> 'RESET'").select(*FRAME, kind.alias("kind"), lane.alias("lane"), (c("lane") == 0).alias("main"), "unit", "start", "end", "value", F.greatest(F.lit(1), F.ceil(c("bits") / 8)).cast("int").alias("bytes"), "partial", "unknown")
