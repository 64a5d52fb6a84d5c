"""Queries over the decoder of flash memories' buses, and their SQL: each event is a frame whose layout depends on what the
frames of its user before it have set. And queries over axes of time, real numbers and exports in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import flash, grids, joins, measure, spi_decode, track
from . import captures as cap
from ..functions import values as v
from ..sources.files import FRAMES, lines, numbered, pieces, shared_folder
from .queries import EDGES, U, query, rle

#: A device whose registers set the dummy clocks and the protocol.
DEVICE = flash.parse(
    [
        {"code": "35", "name": "QUAD", "extended": "1-0-0", "effects": [{"set": "protocol", "value": "quad"}]},
        {"code": "F5", "name": "SINGLE", "extended": "1-0-0", "effects": [{"set": "protocol", "value": "extended"}]},
        {"code": "81", "name": "CONFIGURE", "extended": "1-0-1", "data": "write", "effects": [{"set": "dummy", "bits": "7:4", "values": {"1111": "default"}}]},
        {"code": "0B", "name": "FAST", "extended": "1-1-1", "quad": "4-4-4", "address": 3, "dummy": [8, 8, 10], "dummy_setting": True, "data": "read"},
        {"code": "0D", "name": "BOTH EDGES", "extended": "1-1-1", "quad": "4-4-4", "address": 3, "dummy": [6, 6, 8], "dummy_setting": True, "data": "read", "dtr": True},
    ]
)
#: Samples of each level of the clock, and between frames.
HALF, GAP = 2, 3


def _device(spark, sf) -> DataFrame:
    """One frame per event: its ``code``, the ``lines`` and ``dummy`` clocks that it finds, ``addr`` and ``byte``."""
    rows = cap.by_user(spark, sf, frames=True)
    w = Window.partitionBy("capture_id").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    code = F.element_at(F.array(*[F.lit(c) for c in (0x81, 0x0B, 0x35, 0xF5, 0x0D)]), (F.col("etype") + 1).cast("int"))
    setting = 4 + F.col("event_id") % 12
    held = F.last(F.when(F.col("etype") == 0, setting), ignorenulls=True).over(w)
    lines = F.coalesce(F.last(F.when(F.col("etype") == 2, 4).when(F.col("etype") == 3, 1), ignorenulls=True).over(w), F.lit(1))
    own = rows.select("capture_id", F.col("sample").alias("frame"), "etype", "event_id", "uid", code.alias("code"), lines.alias("lines"), held.alias("held"), setting.alias("setting"))
    table = F.when(F.col("etype") == 1, F.when(F.col("lines") == 1, 8).otherwise(10)).otherwise(F.when(F.col("lines") == 1, 6).otherwise(8))
    dummy = F.when(F.col("etype").isin(1, 4), F.coalesce(F.when(F.col("held") < 15, F.col("held")), table)).otherwise(0)
    return own.withColumn("dummy", dummy.cast("long")).withColumn("byte", F.when(F.col("etype") == 0, F.col("setting") * 16 + 11).otherwise(F.col("uid").bitwiseAND(F.lit(255))))


def _levels(value: Column, bits: int, lines: Column, both: bool, incoming: bool) -> Column:
    """Of a value's bits the levels of the clock and of io0 to io3 while the clock is low and high in each transfer; with ``both`` edges each
    is a transfer: the first, third ... of a phase stands while the clock is low."""
    mask, line = F.when(lines == 4, 15).otherwise(1), F.when(lines == 4, 1).otherwise(2 if incoming else 1)
    last = (F.lit(bits) / lines).cast("int") - 1
    nth = lambda j: last - (j if both else F.call_function("shiftright", j, F.lit(1)))
    one = lambda j: F.call_function("shiftright", value, (nth(j) * lines).cast("int")).cast("int").bitwiseAND(mask) * line + j % 2 * cap.CLOCK + cap.SELECTED
    return F.transform(F.sequence(F.lit(0), last if both else 2 * last + 1), one)


def _bus(frames: DataFrame) -> DataFrame:
    """Runs of cs, sck and io0 to io3."""
    c = F.col
    none = F.array().cast("array<int>")
    still = F.array(F.lit(cap.SELECTED))
    dummy = F.flatten(F.array_repeat(F.array(F.lit(cap.SELECTED), F.lit(cap.SELECTED + cap.CLOCK)), c("dummy").cast("int")))
    command = _levels(c("code"), 8, c("lines"), False, False)
    address = lambda both: _levels(c("event_id"), 24, c("lines"), both, False)
    data = lambda both, incoming: _levels(c("byte"), 8, c("lines"), both, incoming)
    rest = F.when(c("etype") == 0, data(False, False)).when(c("etype") == 1, F.concat(address(False), dummy, data(False, True))).when(c("etype") == 4, F.concat(address(True), dummy, data(True, True))).otherwise(none)
    return cap.bus_runs(frames, F.concat(still, command, rest, still), {"io0": 1, "io1": 2, "io2": 4, "io3": 8}, HALF, HALF - 1, GAP, GAP, GAP)


DEVICE_SQL = f"""WITH {U}, s AS (SELECT *, last_value(CASE WHEN etype = 0 THEN 4 + event_id % 12 END IGNORE NULLS) OVER w AS held, coalesce(last_value(CASE etype WHEN 2 THEN 4 WHEN 3 THEN 1 END IGNORE NULLS) OVER w, 1) AS lines
  FROM u WINDOW w AS (PARTITION BY capture_id ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, [129, 11, 53, 245, 13][etype + 1] AS code, CASE WHEN etype = 0 THEN (4 + event_id % 12) * 16 + 11 ELSE uid & 255 END AS byte,
  CASE WHEN etype IN (1, 4) THEN CASE WHEN held < 15 THEN held ELSE CASE etype WHEN 1 THEN CASE lines WHEN 1 THEN 8 ELSE 10 END ELSE CASE lines WHEN 1 THEN 6 ELSE 8 END END END ELSE 0 END AS dummy FROM s),
m AS (SELECT *, 8 // lines AS nc, CASE WHEN etype IN (1, 4) THEN 24 // lines ELSE 0 END AS na, CASE WHEN etype IN (2, 3) THEN 0 ELSE 8 // lines END AS nx, CASE WHEN etype = 4 THEN 2 ELSE 4 END AS step FROM f),
p AS (SELECT *, 1 + 4 * nc + step * na + 4 * dummy + step * nx + 2 AS size FROM m),
q AS (SELECT *, sum(size + 3) OVER (PARTITION BY capture_id ORDER BY sample) - size AS base FROM p),
o AS (SELECT *, base + 1 AS pc, base + 1 + 4 * nc AS pa, base + 1 + 4 * nc + step * na AS pd, base + 1 + 4 * nc + step * na + 4 * dummy AS px FROM q)"""


@query(f"""{DEVICE_SQL} SELECT capture_id, sample AS frame, CAST(code AS INT) AS opcode, CAST(lines AS INT) AS command_lines, CAST(dummy AS INT) AS dummy, CASE WHEN na > 0 THEN event_id & 16777215 END AS address, CAST(CASE WHEN nx > 0 THEN 1 ELSE 0 END AS BIGINT) AS data_bytes,
  CAST(CASE WHEN etype = 0 AND event_id % 12 < 11 THEN 4 + event_id % 12 WHEN etype = 0 THEN NULL WHEN held < 15 THEN held END AS INT) AS next_dummy, CAST(CASE etype WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE lines END AS INT) AS next_lines FROM o""")
def spi_registers(spark, sf):
    """Frames whose lines and dummy clocks earlier frames have set, single writes of a register among them."""
    data = _bus(_device(spark, sf))
    table, _ = spi_decode.decode(data, how=spi_decode.Decoding(commands=DEVICE))
    return table.select("capture_id", "frame", "opcode", "command_lines", "dummy", "address", "data_bytes", "next_dummy", "next_lines")


@query(f"""{DEVICE_SQL}, r AS (
  SELECT capture_id, sample AS frame, 'CMD' AS kind, pc + 2 AS start, pc + 2 + 4 * (nc - 1) + 2 AS "end", code AS value FROM o
  UNION ALL SELECT capture_id, sample, 'ADDR', pa + 2, pa + 2 + step * (na - 1) + step // 2, event_id & 16777215 FROM o WHERE na > 0
  UNION ALL SELECT capture_id, sample, 'DUMMY', pd + 2, pd + 2 + 4 * (dummy - 1) + 2, dummy FROM o WHERE dummy > 0
  UNION ALL SELECT capture_id, sample, CASE etype WHEN 0 THEN 'WR' ELSE 'RD' END, px + 2, px + 2 + step * (nx - 1) + step // 2, byte FROM o WHERE nx > 0)
SELECT capture_id, frame, kind, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(value AS BIGINT) AS value FROM r""")
def spi_field_extents(spark, sf):
    """Where every field begins and ends, on one edge and on both."""
    data = _bus(_device(spark, sf))
    return spi_decode.decode(data, how=spi_decode.Decoding(commands=DEVICE))[1].select("capture_id", "frame", "kind", "start", "end", "value")


NAMED = "['81 CONFIGURE', '0B FAST', '35 QUAD', 'F5 SINGLE', '0D BOTH EDGES'][etype + 1]"


@query(f"""{DEVICE_SQL}, t AS (SELECT *, CASE WHEN held < 15 THEN held END AS was, CASE WHEN etype = 0 THEN CASE WHEN event_id % 12 < 11 THEN 4 + event_id % 12 END ELSE CASE WHEN held < 15 THEN held END END AS now, CASE etype WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE lines END AS left_lines FROM o)
SELECT capture_id, sample AS frame, CAST(base AS BIGINT) AS start, CAST(size AS BIGINT) AS duration, {NAMED} AS command,
  lines || '-' || CASE WHEN na > 0 THEN lines ELSE 0 END || '-' || CASE WHEN nx > 0 THEN lines ELSE 0 END || CASE WHEN etype = 4 THEN ' DTR' ELSE '' END AS format, CASE WHEN na > 0 THEN lpad(upper(to_hex(event_id & 16777215)), 6, '0') END AS address, CAST(dummy AS INT) AS dummy,
  CAST(CASE WHEN nx > 0 THEN 1 ELSE 0 END AS BIGINT) AS data_bytes, CASE WHEN nx > 0 THEN lpad(upper(to_hex(byte)), 2, '0') ELSE '' END AS preview,
  CASE WHEN was IS DISTINCT FROM now OR lines <> left_lines THEN '-> ' || CASE left_lines WHEN 1 THEN 'Extended' ELSE 'Quad 4-4-4' END || coalesce(', dummy ' || now, '') ELSE '' END AS flags FROM t""")
def spi_transactions(spark, sf):
    """One row per frame, with its first data bytes and the mode it leaves."""
    data = _bus(_device(spark, sf))
    return track.transaction_table(*spi_decode.decode(data, how=spi_decode.Decoding(commands=DEVICE)))


@query(f"""{DEVICE_SQL}, r AS (
  SELECT capture_id, sample AS frame, pc + 2 AS start, pc + 2 + 4 * (nc - 1) + 2 AS stop FROM o
  UNION ALL SELECT capture_id, sample, pa + 2, pa + 2 + step * (na - 1) + step // 2 FROM o WHERE na > 0
  UNION ALL SELECT capture_id, sample, pd + 2, pd + 2 + 4 * (dummy - 1) + 2 FROM o WHERE dummy > 0
  UNION ALL SELECT capture_id, sample, px + 2, px + 2 + step * (nx - 1) + step // 2 FROM o WHERE nx > 0),
b AS (SELECT DISTINCT capture_id, place FROM (SELECT capture_id, start AS place FROM r UNION ALL SELECT capture_id, max(stop) FROM r GROUP BY capture_id, frame)),
a AS (SELECT capture_id, base + 7 * (sample % 9) AS spot FROM o),
x AS (SELECT a.capture_id, a.spot, b.place AS after_it FROM a ASOF LEFT JOIN b ON a.capture_id = b.capture_id AND a.spot < b.place),
y AS (SELECT x.*, b.place AS before_it FROM x ASOF LEFT JOIN b ON x.capture_id = b.capture_id AND x.spot > b.place),
z AS (SELECT y.*, o.sample AS inside, o.base + o.size AS stop FROM y ASOF LEFT JOIN o ON y.capture_id = o.capture_id AND y.spot >= o.base)
SELECT capture_id, CAST(spot AS BIGINT) AS at, CAST(after_it AS BIGINT) AS following, CAST(before_it AS BIGINT) AS prior, CASE WHEN spot < stop THEN inside END AS frame FROM z""")
def spi_navigation(spark, sf):
    """For a cursor per frame the field boundaries after and before it, and the frame it lies in."""
    data = _bus(_device(spark, sf))
    table, found = spi_decode.decode(data, how=spi_decode.Decoding(commands=DEVICE))
    # Steps and places are asked for along each capture: its frames and fields are dealt to one task once.
    parts = pieces(found, 4 * FRAMES)
    frames = table.select("capture_id", "frame", "start", "end").repartition(parts, "capture_id")
    own = found.select("capture_id", "frame", "start", "end").repartition(parts, "capture_id")
    cursors = frames.select("capture_id", (F.col("start") + 7 * (F.col("frame") % 9)).alias("at"))
    told = track.step(cursors, own).withColumnRenamed("found", "following")
    told = track.step(told, own, forward=False).withColumnRenamed("found", "prior")
    return track.at_places(told, frames, ["frame"]).select("capture_id", "at", "following", "prior", "frame")


TICKS = f"""{EDGES}, g AS (SELECT e.capture_id, e.edge, u.tick, lag(e.edge) OVER w AS prior, lead(e.edge) OVER w AS following, tick - lag(tick) OVER w AS gap, row_number() OVER w AS k FROM e JOIN u ON e.capture_id = u.capture_id AND e.edge = u.sample WHERE rising WINDOW w AS (PARTITION BY e.capture_id ORDER BY e.edge)),
c AS (SELECT capture_id, CAST(floor(median(gap)) AS BIGINT) AS cap FROM g WHERE k <= 65536 AND gap > 0 GROUP BY 1)"""


@query(f"""{TICKS}, t AS (SELECT g.*, cap, tick - coalesce(cap, 0) AS low FROM g LEFT JOIN c USING (capture_id)), z AS (SELECT t.*, u.sample AS near FROM t ASOF LEFT JOIN u ON t.capture_id = u.capture_id AND t.low <= u.tick)
SELECT capture_id, edge, edge - 1 AS at, prior - 1 AS previous_at, greatest(0, least(greatest(coalesce(prior, 0), CASE WHEN cap IS NOT NULL THEN near ELSE 0 END), edge - 1)) AS start, edge AS "end" FROM z""")
def grid_time_spans_before(spark, sf):
    """Spans that reach back a typical period of time at most."""
    rows = cap.by_user(spark, sf)
    return grids.edge_grid_by_time(grids.edges(cap.runs(rows, "clk")), rows.select("capture_id", "sample", "tick")).drop("signal")


@query(f"""{TICKS}, t AS (SELECT g.*, cap, tick + coalesce(cap, 0) AS high FROM g LEFT JOIN c USING (capture_id)), z AS (SELECT t.*, u.sample AS near FROM t ASOF LEFT JOIN u ON t.capture_id = u.capture_id AND t.high <= u.tick)
SELECT capture_id, edge, edge AS at, prior AS previous_at, edge AS start, greatest(edge + 1, least(coalesce(following, count), CASE WHEN cap IS NOT NULL THEN coalesce(near, count) ELSE count END)) AS "end" FROM z JOIN n USING (capture_id)""")
def grid_time_spans_at(spark, sf):
    rows = cap.by_user(spark, sf)
    return grids.edge_grid_by_time(grids.edges(cap.runs(rows, "clk")), rows.select("capture_id", "sample", "tick"), before=False).drop("signal")


@query(f"""WITH {U}, {rle('etype')}, q AS (SELECT capture_id, sample, CASE sample % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN -1e300 ELSE sample / 3.0::DOUBLE - 1 END AS key FROM u)
SELECT capture_id, sample, (SELECT count(*) FROM r WHERE r.capture_id = q.capture_id AND CAST(r.start AS DOUBLE) < q.key) AS before, (SELECT count(*) FROM r WHERE r.capture_id = q.capture_id AND CAST(r.start AS DOUBLE) <= q.key) AS upto FROM q""")
def search_real_keys(spark, sf):
    """How many runs begin before, and at or before, real numbers, NaN and infinities."""
    rows = cap.by_user(spark, sf)
    k = F.col("sample") % 7
    key = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(-1e300)).otherwise(F.col("sample") / 3.0 - 1)
    axis = cap.runs(rows, "etype").select("capture_id", "start")
    left = joins.search_positions(rows.select("capture_id", "sample", key.alias("key")), axis, "key").withColumnRenamed("position", "before")
    return joins.search_positions(left, axis, "key", "right").select("capture_id", "sample", "before", F.col("position").alias("upto"))


@query(f"""WITH {U}, f AS (SELECT capture_id, val, min(sample) AS first FROM u GROUP BY 1, 2) SELECT capture_id, CAST(val AS VARCHAR) AS value, row_number() OVER (PARTITION BY capture_id ORDER BY val DESC, first) - 1 AS place FROM f""")
def export_unique_sorted(spark, sf):
    rows = cap.by_user(spark, sf).withColumnRenamed("sample", "at")
    unique = measure.export_unique(rows, v.format_value(F.col("val"), "UNSIGNED", 16)).withColumn("num", F.col("value").cast("long"))
    return measure.sorted_unique(unique, "UNSIGNED", descending=True).select("capture_id", "value", F.col("place").cast("long").alias("place"))


@query(f"""WITH {U} SELECT row_number() OVER (ORDER BY capture_id, sample) - 1 AS row, lpad(to_binary(etype), 3, '0') || ' ' || lpad(upper(to_hex(val)), 4, '0') AS value FROM u""")
def export_two_channels(spark, sf):
    """Two channels of all captures as lines of one text in order, read back."""
    rows = cap.by_user(spark, sf).withColumnRenamed("sample", "at")
    path = shared_folder(spark, "export")
    measure.export_channels(rows, {"etype": v.format_value(F.col("etype"), "BINARY", 3), "val": v.format_value(F.col("val"), "HEX", 16)}, path, bounded=False)
    return numbered(lines(spark, path), "row").select("row", "value")


@query(f"""WITH {U}, {rle('etype')}, w AS (SELECT capture_id, greatest(start, 0) AS start, least("end", 64) AS "end", num FROM r WHERE start < 64), k AS (SELECT capture_id, count(*) AS n FROM w GROUP BY 1)
SELECT capture_id, n <= 32 AS exact, CASE WHEN n <= 32 THEN count(*) END AS rows, CASE WHEN n <= 32 THEN CAST(sum(num * ("end" - start)) AS BIGINT) END AS total FROM w JOIN k USING (capture_id) GROUP BY 1, n""")
def viewport_detail(spark, sf):
    """Signals with few runs in a window are shown run by run; of the others the rows are bounded by the columns."""
    got = measure.viewport_detail(cap.runs(cap.by_user(spark, sf), "etype"), 0, 64, 16)
    own = F.col("exact")
    return got.groupBy("capture_id", "exact").agg(F.when(own, F.count("*")).alias("rows"), F.when(own, F.sum(F.col("num") * (F.col("last") - F.col("first") + 1))).alias("total"))


@query(f"""{DEVICE_SQL} SELECT capture_id, sample AS frame, '#' || (sample + 1) || ' ' || lpad(upper(to_hex(code)), 2, '0') || CASE WHEN na > 0 THEN ' @' || lpad(upper(to_hex(event_id & 16777215)), 6, '0') ELSE '' END || ': 0x' || lpad(upper(to_hex(code)), 2, '0') ||
  CASE WHEN na > 0 THEN ',0x' || lpad(upper(to_hex(event_id & 16777215)), 6, '0') ELSE '' END || CASE WHEN nx > 0 THEN ',0x' || lpad(upper(to_hex(byte)), 2, '0') ELSE '' END AS text FROM o""")
def spi_export_lines(spark, sf):
    """All fields of each frame as a line with its number, opcode and address."""
    data = _bus(_device(spark, sf))
    table, found = spi_decode.decode(data, how=spi_decode.Decoding(commands=DEVICE))
    return track.export_text(table, found, "all", separator=",", prefix=True, header=True, bounded=False)
