"""One query per operator over the driver's tables, and the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times as tm
from ..functions import values as v
from ..operators import axis, grids, intervals, joins, measure, runs, spi, spi_decode
from ..sources import csvfile, vcdfile
from ..sources.files import settled, shared_folder, write_in_order
from . import captures as cap
from .conditions import S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Events as one capture per user, and its runs of a column.
U = """u AS (SELECT user_id AS capture_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample, event_id, epoch_us(ts) AS tick,
  CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS BIGINT) AS etype, CAST(floor(value) AS BIGINT) AS val,
  CAST(event_type = 'error' AS BIGINT) AS err, event_id & 1 AS clk, user_id AS uid FROM events),
n AS (SELECT capture_id, max(sample) + 1 AS count FROM u GROUP BY 1)"""


def rle(col: str, name: str = "r", frm: str = "u") -> str:
    return f"""{name} AS (SELECT capture_id, start, coalesce(lead(start) OVER (PARTITION BY capture_id ORDER BY start), count) AS "end", num FROM (
  SELECT capture_id, sample AS start, {col} AS num, lag({col}) OVER (PARTITION BY capture_id ORDER BY sample) AS was, max(sample) OVER (PARTITION BY capture_id) + 1 AS count FROM {frm})
  WHERE was IS DISTINCT FROM num OR start = 0)"""


def islands(frm: str, name: str = "i", by: str = "capture_id") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"""{name}_a AS (SELECT *, max("end") OVER ({part}ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {frm} WHERE "end" > start),
{name}_b AS (SELECT *, sum(CAST(reach IS NULL OR start > reach AS INT)) OVER ({part}ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT {keys}min(start) AS start, max("end") AS "end" FROM {name}_b GROUP BY {keys}g)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Runs and lookups


@query(f"WITH {U}, {rle('etype')} SELECT * FROM r")
def rle_event_type(spark, sf):
    return cap.runs(cap.by_user(spark, sf), "etype").select("capture_id", "start", "end", "num")


@query(f"WITH {U}, g AS (SELECT CAST(0 AS BIGINT) AS capture_id, row_number() OVER (ORDER BY event_id) - 1 AS sample, etype FROM u), {rle('etype', frm='g')} SELECT start, \"end\", num FROM r")
def rle_long_axis(spark, sf):
    """One axis, encoded in pieces whose seams are mended."""
    got = runs.encode(runs.long_form(cap.whole(spark, sf), {"etype": F.col("etype")}), size=4096)
    return got.select("start", "end", "num")


@query(f"WITH {U} SELECT capture_id, count(*) AS samples, CAST(sum(etype) AS BIGINT) AS total FROM u GROUP BY 1")
def rle_decode_count(spark, sf):
    dense = runs.decode(cap.runs(cap.by_user(spark, sf), "etype"))
    return dense.groupBy("capture_id").agg(F.count("*").alias("samples"), F.sum("num").alias("total"))


@query(f"WITH {U}, {rle('val // 10')} SELECT capture_id, start, \"end\", num FROM r")
def rle_seam_merge(spark, sf):
    """Pieces of each capture are encoded apart and merged."""
    rows = cap.by_user(spark, sf).withColumn("num", F.floor(F.col("val") / 10))
    piece = rows.withColumn("part", F.floor(F.col("sample") / 7))
    w = Window.partitionBy("capture_id", "part").orderBy("sample")
    heads = piece.withColumn("_was", F.lag("num").over(w)).where("_was IS NULL OR _was <> num")
    ends = piece.groupBy("capture_id", "part").agg((F.max("sample") + 1).alias("_stop"))
    parts = heads.join(ends, ["capture_id", "part"]).select("capture_id", F.lit("v").alias("signal"), F.col("sample").alias("start"), F.coalesce(F.lead("sample").over(w), "_stop").alias("end"), "num", F.lit(None).cast("string").alias("txt"))
    return runs.merge_seams(parts).select("capture_id", "start", "end", "num")


@query(f"WITH {U}, f AS (SELECT capture_id, etype AS num, min(sample) AS first FROM u GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY first) - 1 AS code FROM f")
def dictionary_codes(spark, sf):
    return runs.dictionary(cap.runs(cap.by_user(spark, sf), "etype")).select("capture_id", "num", "first", F.col("code").cast("long").alias("code"))


@query(f"WITH {U}, p AS (SELECT capture_id, sample, val FROM u WHERE etype = 2), c AS (SELECT capture_id, sample FROM u WHERE etype = 0) SELECT c.capture_id, c.sample, p.val, p.sample AS run_start FROM c ASOF LEFT JOIN p ON c.capture_id = p.capture_id AND c.sample >= p.sample")
def asof_value(spark, sf):
    rows = cap.by_user(spark, sf)
    bought = rows.where("etype = 2").select("capture_id", F.col("sample").alias("start"), "val")
    return joins.as_of(rows.where("etype = 0").select("capture_id", "sample"), bought, "sample", ["val"])


@query(f"WITH {U}, s AS (SELECT min(tick) AS a, max(tick) AS b FROM u), t AS (SELECT unnest(range(a, b + 1, 21600000000)) AS tick FROM s) SELECT t.tick, u.tick AS run_start, u.event_id FROM t ASOF LEFT JOIN u ON t.tick >= u.tick")
def asof_time(spark, sf):
    """What held every six hours, over one long axis of microseconds."""
    rows = cap.whole(spark, sf)
    marks = rows.agg(F.min("tick").alias("a"), F.max("tick").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(21_600_000_000))).alias("tick"))
    return joins.as_of(marks, rows.select(F.col("tick").alias("start"), "event_id"), "tick", ["event_id"], keys=(), size=86_400_000_000)


@query(f"WITH {U}, t AS (SELECT *, lead(tick) OVER (PARTITION BY capture_id ORDER BY sample) AS nxt FROM u), q AS (SELECT capture_id, min(tick) + 3600000000 AS at FROM u GROUP BY 1) SELECT q.capture_id, q.at, t.sample, coalesce(CAST(q.at - t.tick AS DOUBLE) / CAST(t.nxt - t.tick AS DOUBLE), 0) + t.sample AS place FROM q ASOF LEFT JOIN t ON q.capture_id = t.capture_id AND q.at >= t.tick")
def position_at_time(spark, sf):
    rows = cap.by_user(spark, sf)
    w = Window.partitionBy("capture_id").orderBy("sample")
    axis_ = rows.select("capture_id", F.col("tick").alias("start"), F.col("tick").alias("low"), F.lead("tick").over(w).alias("high"), "sample")
    ask = rows.groupBy("capture_id").agg((F.min("tick") + 3_600_000_000).alias("at"))
    got = joins.as_of(ask, axis_, "at", ["low", "high", "sample"])
    return got.select("capture_id", "at", "sample", tm.between(F.col("at"), F.col("low"), F.col("high"), F.col("sample")).alias("place"))


@query(f"WITH {U}, {rle('etype')} SELECT capture_id, min(start) FILTER (start > 5) AS start FROM r GROUP BY 1")
def next_transition(spark, sf):
    return runs.next_change(cap.runs(cap.by_user(spark, sf), "etype"), 5).select("capture_id", "start")


@query(f"WITH {U}, {rle('etype')} SELECT capture_id, max(start) FILTER (start < 20 AND start > 0) AS start FROM r GROUP BY 1")
def prev_transition(spark, sf):
    return runs.next_change(cap.runs(cap.by_user(spark, sf), "etype"), 20, forward=False).select("capture_id", "start")


@query(f"WITH {U}, {rle('etype')}, h AS (SELECT capture_id, min(start) FILTER (start > 30) AS near, min(start) FILTER (start <= 30) AS past FROM r WHERE num = 2 GROUP BY 1) SELECT capture_id, coalesce(near, past) AS start, near IS NULL AS wrapped FROM h")
def search_value_wrap(spark, sf):
    return runs.search(cap.runs(cap.by_user(spark, sf), "etype"), 2, 30).drop("signal")


# Bits and formats


@query(f"WITH {U}, b AS (SELECT capture_id * 10 + o AS capture_id, sample, (etype >> o) & 1 AS bit FROM u, (SELECT unnest([0, 1, 2]) AS o)), {rle('bit', frm='b')} SELECT capture_id // 10 AS capture_id, capture_id % 10 AS bit, start, \"end\", num FROM r")
def bits_of_bus(spark, sf):
    got = runs.expand_bits(cap.runs(cap.by_user(spark, sf), "etype"), 3)
    return got.select("capture_id", F.regexp_extract("signal", r"\[(\d)\]", 1).cast("long").alias("bit"), "start", "end", "num")


@query(f"""WITH {U}, b AS (SELECT capture_id * 10 + o AS capture_id, sample, CASE WHEN etype = 3 THEN substr('ZX1', 3 - o, 1) ELSE CAST((etype >> o) & 1 AS VARCHAR) END AS bit FROM u, (SELECT unnest([0, 1, 2]) AS o)), {rle('bit', frm='b')}
SELECT capture_id // 10 AS capture_id, capture_id % 10 AS bit, start, "end", num AS value FROM r""")
def bits_of_unknown_bus(spark, sf):
    """A bus some of whose values are unknown in part."""
    rows = cap.by_user(spark, sf)
    odd = F.col("etype") == 3
    samples = rows.select("capture_id", F.lit("bus[2:0]").alias("signal"), "sample", F.when(~odd, F.col("etype")).alias("num"), F.when(odd, F.lit("ZX1")).alias("txt"))
    got = runs.expand_bits(runs.encode(samples), 3)
    return got.select("capture_id", F.regexp_extract("signal", r"\[(\d)\]", 1).cast("long").alias("bit"), "start", "end", F.coalesce(F.col("num").cast("string"), "txt").alias("value"))


@query("SELECT event_id, ((user_id >> 2) & 1) * 8 + ((user_id >> 7) & 1) * 4 + ((user_id >> 6) & 1) * 2 + ((user_id >> 5) & 1) AS picked, CAST(user_id & 240 AS BIGINT) >> 4 AS high FROM events")
def bit_select_pack(spark, sf):
    pick = lambda t: v.select_bits(F.col("user_id"), v.offsets_of(t, 11))
    return cap.table(spark, sf, "events").select("event_id", pick("2,7-5").alias("picked"), pick("7:4").alias("high"))


@query("SELECT event_id, CAST(list_sum(list_transform(range(0, 11), lambda i: ((user_id >> i) & 1) << (10 - i))) AS BIGINT) AS reversed FROM events")
def bit_reverse(spark, sf):
    return cap.table(spark, sf, "events").select("event_id", v.reverse_bits(F.col("user_id"), 11).alias("reversed"))


@query("""SELECT event_id, lpad(upper(to_hex(x)), 3, '0') AS hex, lpad(to_binary(x), 12, '0') AS bin, lpad(format('{:o}', x), 4, '0') AS oct, CAST(CASE WHEN x >= 2048 THEN x - 4096 ELSE x END AS VARCHAR) AS signed,
  CAST(CASE WHEN x >= 2048 THEN -(x & 2047) ELSE x END AS VARCHAR) AS magnitude, (CASE WHEN x >= 2048 THEN x - 4096 ELSE x END) / 16.0::DOUBLE AS fixed FROM (SELECT event_id, CAST((event_id * 37) & 4095 AS BIGINT) AS x FROM events)""")
def format_radices(spark, sf):
    x = (F.col("event_id") * 37).bitwiseAND(F.lit(4095))
    shown = {n: v.format_value(x, r, 12).alias(n) for n, r in (("hex", "HEX"), ("bin", "BINARY"), ("oct", "OCTAL"), ("signed", "SIGNED"), ("magnitude", "SIGNED_MAGNITUDE"))}
    return cap.table(spark, sf, "events").select("event_id", *shown.values(), v.fixed_point(x, 12, 4).alias("fixed"))


@query("SELECT event_id, CAST(user_id AS BIGINT) AS num, CASE WHEN event_id % 3 = 0 THEN 'X' || (event_id % 10) END AS txt FROM events")
def parse_cells(spark, sf):
    """Texts in hexadecimal, decimal and with unknown digits, parsed back."""
    rows = cap.table(spark, sf, "events").withColumn("h", v.parse_value(F.concat(F.lit(" 0x"), F.lower(F.hex("user_id")), F.lit(" ")), "HEX"))
    rows = rows.withColumn("d", v.parse_value(F.col("user_id").cast("string"), "UNSIGNED")).withColumn("x", v.parse_value(F.concat(F.lit("x"), (F.col("event_id") % 10).cast("string")), "HEX"))
    return rows.select("event_id", F.when(F.col("h.num") == F.col("d.num"), F.col("h.num")).alias("num"), F.when(F.col("event_id") % 3 == 0, F.col("x.txt")).alias("txt"))


# Conditions


def _held(spark, sf, condition, *names):
    rows = cap.by_user(spark, sf)
    got = condition.on(cap.every_point(rows), cap.runs(rows, *names))
    return got.where("holds").select("capture_id", "at")


@query(f"WITH {U} SELECT capture_id, sample AS at FROM u WHERE err = 1 OR (etype = 2 AND NOT val < 50)")
def condition_basic(spark, sf):
    return _held(spark, sf, S("err").true | (S("etype", 3).eq(2) & ~S("val", 16, "UNSIGNED").lt("50")), "err", "etype", "val")


@query(f"WITH {U}, p AS (SELECT *, lag(err) OVER (PARTITION BY capture_id ORDER BY sample) AS was FROM u) SELECT capture_id, sample AS at FROM p WHERE was IS NOT NULL AND (err = 1 AND was = 0 OR etype = 4)")
def condition_prev(spark, sf):
    return _held(spark, sf, (S("err").true & ~S("err").previous.true) | S("etype", 3).eq(4), "err", "etype")


@query(f"WITH {U}, x AS (SELECT *, etype = 3 AS unknown FROM u) SELECT capture_id, sample AS at FROM x WHERE CASE WHEN unknown THEN true ELSE err <> 0 END")
def condition_unknown(spark, sf):
    """X != 0 is true, X is not true itself, and !X is true."""
    x = S("unk")
    return _held(spark, sf, x.ne(0) & (~x.true | x.eq(1)), "unk")


@query(f"WITH {U} SELECT capture_id, sample AS at FROM u WHERE etype = (uid & 7) OR ((val >> 2) & 3) > etype")
def condition_cross_signal(spark, sf):
    return _held(spark, sf, S("etype", 3).eq(S("uid", 11).bits("2:0")) | S("val", 16).bits("3:2").gt(S("etype", 3)), "etype", "uid", "val")


@query(f"WITH {U}, x AS (SELECT *, CASE WHEN (val * 7) & 255 >= 128 THEN ((val * 7) & 255) - 256 ELSE (val * 7) & 255 END AS s FROM u) SELECT capture_id, sample AS at FROM x WHERE s = -7 OR s < -100 OR s >= 90 OR (s >> 6) & 3 = 1")
def condition_signed(spark, sf):
    """Patterns and numbers against a signed byte, and a selection of its bits."""
    x = S("x", 8, "SIGNED")
    rows = cap.by_user(spark, sf).withColumn("x", (F.col("val") * 7).bitwiseAND(F.lit(255)))
    got = (x.eq("hF9") | x.lt("d-100") | x.ge(90) | x.bits("7:6").eq(1)).on(cap.every_point(rows), cap.runs(rows, "x"))
    return got.where("holds").select("capture_id", "at")


# Grids


@query(f"WITH {U} SELECT capture_id, sample AS at, CASE WHEN sample >= 3 THEN sample - 3 END AS previous_at, sample AS start, sample + 3 AS \"end\" FROM u WHERE sample % 3 = 2")
def grid_periodic(spark, sf):
    return grids.periodic_grid(cap.counts(cap.by_user(spark, sf)), 3, 5)


EDGES = f"WITH {U}, {rle('clk')}, e AS (SELECT capture_id, start AS edge, num = 1 AS rising FROM r WHERE start > 0)"


@query(f"{EDGES} SELECT capture_id, edge FROM e WHERE rising")
def grid_edges_rising(spark, sf):
    return grids.edges(cap.runs(cap.by_user(spark, sf), "clk"), "rising").select("capture_id", "edge")


@query(f"{EDGES} SELECT capture_id, edge FROM e WHERE NOT rising")
def grid_edges_falling(spark, sf):
    return grids.edges(cap.runs(cap.by_user(spark, sf), "clk"), "falling").select("capture_id", "edge")


@query(f"{EDGES} SELECT * FROM e")
def grid_edges_both(spark, sf):
    return grids.edges(cap.runs(cap.by_user(spark, sf), "clk"), "both").select("capture_id", "edge", "rising")


GAPS = f"""{EDGES}, g AS (SELECT *, lag(edge) OVER w AS prior, lead(edge) OVER w AS following, row_number() OVER w AS k FROM e WHERE rising WINDOW w AS (PARTITION BY capture_id ORDER BY edge)),
c AS (SELECT capture_id, CAST(round_even(median(edge - prior), 0) AS BIGINT) AS cap FROM g WHERE k <= 65536 GROUP BY 1)"""


@query(f"{GAPS} SELECT capture_id, edge, edge - 1 AS at, prior - 1 AS previous_at, greatest(coalesce(prior, 0), coalesce(edge - cap, 0)) AS start, edge AS \"end\" FROM g JOIN c USING (capture_id)")
def grid_edge_spans_before(spark, sf):
    rows = cap.by_user(spark, sf)
    return grids.edge_grid(grids.edges(cap.runs(rows, "clk")), cap.counts(rows)).drop("signal")


@query(f"{GAPS} SELECT capture_id, edge, edge AS at, prior AS previous_at, edge AS start, greatest(edge + 1, least(coalesce(following, count), coalesce(edge + cap, count))) AS \"end\" FROM g JOIN c USING (capture_id) JOIN n USING (capture_id) WHERE edge >= 4")
def grid_edge_spans_at(spark, sf):
    rows = cap.by_user(spark, sf)
    return grids.edge_grid(grids.edges(cap.runs(rows, "clk")), cap.counts(rows), before=False, lower=4).drop("signal")


@query(f"{EDGES}, d AS (SELECT *, edge - lag(edge) OVER (PARTITION BY capture_id ORDER BY edge) AS gap FROM e WHERE rising), s AS (SELECT capture_id, count(*) AS rising, median(gap) AS typical, CASE WHEN count(*) > 1 THEN CAST(max(edge) - min(edge) AS DOUBLE) / (count(*) - 1) END AS period FROM d GROUP BY 1) SELECT capture_id, count(*) AS edges, coalesce(any_value(s.rising), 0) AS rising, any_value(typical) AS typical, any_value(period) AS period FROM e LEFT JOIN s USING (capture_id) GROUP BY 1")
def clock_statistics(spark, sf):
    return grids.clock_statistics(cap.runs(cap.by_user(spark, sf), "clk")).drop("signal")


# Intervals and sequences

LIT = f"WITH {U}, h AS (SELECT capture_id, sample AS start, sample + 1 AS \"end\" FROM u WHERE (err = 1 OR val >= 50) AND sample >= 2), {islands('h')}"


def _lit(spark, sf):
    rows = cap.by_user(spark, sf)
    held = (S("err").true | S("val", 16, "UNSIGNED").ge(50)).on(cap.every_point(rows), cap.runs(rows, "err", "val"))
    return intervals.highlight(held, F.col("holds"), 2)


@query(f"{LIT} SELECT * FROM i")
def highlight_intervals(spark, sf):
    return _lit(spark, sf)


@query(f"WITH h AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS start, event_type, value FROM events), k AS (SELECT start, start + 1 AS \"end\" FROM h WHERE event_type IN ('error', 'view')), {islands('k', by='')} SELECT * FROM i")
def highlight_long_axis(spark, sf):
    """One axis for all events: buckets and carries, no window without a key over the rows."""
    rows = cap.whole(spark, sf)
    spans = rows.where("etype IN (1, 4)").select(F.col("sample").alias("start"), (F.col("sample") + 1).alias("end"))
    return axis.merge_touching(spans, size=1024)


@query(f"{LIT} SELECT capture_id, greatest(start, 5) AS start, least(\"end\", 40) AS \"end\" FROM i WHERE \"end\" > 5 AND start < 40")
def highlight_visible(spark, sf):
    return intervals.visible(_lit(spark, sf), 5, 40)


@query(f"{LIT} SELECT capture_id, coalesce(min(start) FILTER (start > 25), min(start)) AS start FROM i GROUP BY 1")
def highlight_step(spark, sf):
    return intervals.step(_lit(spark, sf), 25)


@query(f"{LIT}, s AS (SELECT capture_id, greatest(start, 0) AS a, least(\"end\", 60) AS b FROM i WHERE \"end\" > 0 AND start < 60), p AS (SELECT DISTINCT capture_id, unnest(range(a // 4, (b + 3) // 4)) AS pixel FROM s), q AS (SELECT *, pixel - row_number() OVER (PARTITION BY capture_id ORDER BY pixel) AS g FROM p) SELECT capture_id, min(pixel) AS first, max(pixel) AS last FROM q GROUP BY capture_id, g")
def highlight_pixels(spark, sf):
    return intervals.pixels(_lit(spark, sf), 0, 60, 15)


def stages(sql: str, span: int) -> str:
    return f"WITH {U}, l AS (SELECT *, {', '.join(f'lead(etype, {k}) OVER w AS e{k}' for k in range(1, span))} FROM u WINDOW w AS (PARTITION BY capture_id ORDER BY sample)), h AS (SELECT capture_id, sample AS start, sample + {span} AS \"end\" FROM l WHERE {sql}), {islands('h')} SELECT * FROM i"


@query(stages("etype IN (0, 4) AND e1 = 2", 2))
def sequence_two_stage(spark, sf):
    rows = cap.by_user(spark, sf)
    points = rows.select("capture_id", "etype", F.col("sample").alias("start"), (F.col("sample") + 1).alias("end"))
    return intervals.sequence(points, [F.col("etype").isin(0, 4), F.col("etype") == 2])


@query(stages("etype = 4 AND e1 <> 4 AND e2 IN (0, 1)", 3))
def sequence_three_stage(spark, sf):
    rows = cap.by_user(spark, sf)
    points = rows.select("capture_id", "etype", F.col("sample").alias("start"), (F.col("sample") + 1).alias("end"))
    return intervals.sequence(points, [F.col("etype") == 4, F.col("etype") != 4, F.col("etype").isin(0, 1)])


@query("WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS start, event_type AS a, lead(event_type) OVER (ORDER BY event_id) AS b FROM events), h AS (SELECT start, start + 2 AS \"end\" FROM l WHERE a = 'click' AND b = 'purchase'), " + islands("h", by="") + " SELECT * FROM i")
def sequence_long_axis(spark, sf):
    points = cap.whole(spark, sf).select("etype", F.col("sample").alias("start"), (F.col("sample") + 1).alias("end"))
    return intervals.bucketed_sequence(points, [F.col("etype") == 0, F.col("etype") == 2], keys=(), size=1024)


# Exports and measurements


@query(f"WITH {U}, f AS (SELECT *, lpad(upper(to_hex(val)), 4, '0') AS value FROM u WHERE err = 0), l AS (SELECT *, lag(value) OVER (PARTITION BY capture_id ORDER BY sample) AS was FROM f) SELECT capture_id, sample AS at, value FROM l WHERE was IS DISTINCT FROM value")
def export_changes(spark, sf):
    rows = cap.by_user(spark, sf).where("err = 0").withColumnRenamed("sample", "at")
    return measure.export_changes(rows, v.format_value(F.col("val"), "HEX", 16))


@query(f"WITH {U} SELECT capture_id, CAST(etype AS VARCHAR) AS value, min(sample) AS first FROM u GROUP BY 1, 2")
def export_unique(spark, sf):
    rows = cap.by_user(spark, sf).withColumnRenamed("sample", "at")
    return measure.export_unique(rows, v.format_value(F.col("etype"), "UNSIGNED", 3))


@query(f"WITH {U} SELECT capture_id, string_agg(lpad(to_binary(etype), 3, '0'), ' ' ORDER BY sample) AS text FROM u GROUP BY 1")
def export_text(spark, sf):
    rows = cap.by_user(spark, sf).withColumnRenamed("sample", "at")
    return measure.export_text(rows, v.format_value(F.col("etype"), "BINARY", 3))


@query(f"WITH {U}, {rle('clk')}, l AS (SELECT *, lag(num) OVER (PARTITION BY capture_id ORDER BY start) AS was FROM r), m AS (SELECT capture_id, start, start > 0 AND was = 0 AND num = 1 AS rise, start > 0 AND was = 1 AND num = 0 AS fall FROM l) SELECT capture_id, count(*) FILTER (rise) AS rising, count(*) FILTER (fall) AS falling, min(start) FILTER (rise) AS first_rise, max(start) FILTER (rise) AS last_rise, CASE WHEN count(*) FILTER (rise) > 1 THEN CAST(max(start) FILTER (rise) - min(start) FILTER (rise) AS DOUBLE) / (count(*) FILTER (rise) - 1) END AS period FROM m GROUP BY 1")
def edge_measure(spark, sf):
    return measure.measure_edges(cap.runs(cap.by_user(spark, sf), "clk"), 0, 1 << 62).drop("signal")


@query(f"WITH {U}, {rle('etype', 'r1')}, {rle('err', 'r2')}, a AS (SELECT capture_id, count(*) - 1 AS c FROM r1 GROUP BY 1 UNION ALL SELECT capture_id, count(*) - 1 FROM r2 GROUP BY 1) SELECT capture_id, any_value(count) AS rows, count(*) AS signals, CAST(sum(c) AS BIGINT) AS changes FROM a JOIN n USING (capture_id) GROUP BY 1")
def capture_summary(spark, sf):
    return measure.summary(cap.runs(cap.by_user(spark, sf), "etype", "err"))


@query(f"WITH {U}, {rle('etype')} SELECT * FROM r")
def bus_assemble(spark, sf):
    """Three one-bit signals put together again."""
    rows = cap.by_user(spark, sf)
    bits = cap.runs(rows.withColumns({f"b{k}": v.bit(F.col("etype"), k) for k in range(3)}), "b0", "b1", "b2")
    return runs.assemble_bus(bits, ["b2", "b1", "b0"], "bus[2:0]").select("capture_id", "start", "end", "num")


# Joins and sets


@query(f"WITH {U}, {rle('etype')}, {rle('val // 25', 'q')} SELECT r.capture_id, r.start, r.\"end\", q.start AS r_start, q.\"end\" AS r_end FROM r JOIN q ON r.capture_id = q.capture_id AND r.start < q.\"end\" AND q.start < r.\"end\" WHERE r.num = 0 AND q.num >= 2")
def interval_overlap_join(spark, sf):
    rows = cap.by_user(spark, sf).withColumn("q", F.floor(F.col("val") / 25))
    both = cap.runs(rows, "etype", "q")
    left = both.where("signal = 'etype' AND num = 0").select("capture_id", "start", "end")
    right = both.where("signal = 'q' AND num >= 2").select("capture_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return joins.overlapping(left, right, 8, ["capture_id"])


@query(f"WITH {U}, {rle('etype')} SELECT u.capture_id, u.sample, r.start, r.\"end\" FROM u JOIN r ON u.capture_id = r.capture_id AND u.sample >= r.start AND u.sample < r.\"end\" WHERE r.num = 4")
def point_in_interval(spark, sf):
    rows = cap.by_user(spark, sf)
    spans = cap.runs(rows, "etype").where("num = 4").select("capture_id", "start", "end")
    return joins.points_in(rows.select("capture_id", "sample"), spans, "sample").select("capture_id", "sample", "start", "end")


@query(f"WITH {U} SELECT capture_id FROM u WHERE sample = 10 AND etype <> CASE WHEN clk = 1 THEN etype ELSE 4 END")
def seam_mismatch(spark, sf):
    rows = cap.by_user(spark, sf)
    other = rows.withColumn("etype", F.when(F.col("clk") == 1, F.col("etype")).otherwise(F.lit(4).cast("long")))
    return runs.seam_mismatches(cap.runs(rows, "etype"), cap.runs(other, "etype"), 10).select("capture_id")


@query(f"WITH {U}, a AS (SELECT capture_id, etype, val FROM u WHERE clk = 0), b AS (SELECT capture_id, etype, val FROM u WHERE err = 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def set_difference(spark, sf):
    rows = cap.by_user(spark, sf)
    pick = lambda c: rows.where(c).select("capture_id", "etype", "val")
    return runs.difference(pick("clk = 0"), pick("err = 0"))


@query(f"""WITH {U}, {rle('etype')}, k AS (SELECT capture_id, unnest(range(0, 17)) AS edge FROM n), m AS (SELECT k.capture_id, k.edge, r.start AS run, r.num FROM k JOIN r ON k.capture_id = r.capture_id AND r.start <= k.edge * 4 AND r."end" > k.edge * 4),
f AS (SELECT *, lead(run) OVER w AS nxt, lead(edge) OVER w AS ne FROM m WINDOW w AS (PARTITION BY capture_id ORDER BY edge)), s AS (SELECT capture_id, edge, run, NOT coalesce(nxt = run AND ne = edge + 1, false) AS busy, num FROM f WHERE edge < 16),
l AS (SELECT *, lag(edge) OVER w IS NULL OR lag(busy) OVER w <> busy OR (NOT busy AND lag(run) OVER w <> run) AS fresh FROM s WINDOW w AS (PARTITION BY capture_id ORDER BY edge)),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY capture_id ORDER BY edge ROWS UNBOUNDED PRECEDING) AS i FROM l)
SELECT capture_id, min(edge) AS first, max(edge) AS last, any_value(busy) AS busy, any_value(CASE WHEN NOT busy THEN num END) AS num FROM g GROUP BY capture_id, i""")
def viewport_runs(spark, sf):
    return measure.viewport(cap.runs(cap.by_user(spark, sf), "etype"), 0, 64, 16).drop("signal", "txt")


# SPI


def _wave(frames: DataFrame, lines: dict[str, str] = {"io0": "bits"}) -> DataFrame:
    """Runs of cs, sck and lines that carry each frame's bits; frames: capture_id, frame, and a column of bits per line, of
    one length."""
    bit = lambda c, j: F.substring(F.col(c), F.call_function("shiftright", j, F.lit(1)) + 1, F.lit(1)).cast("int")
    each = lambda j: sum((bit(c, j) * (1 << i) for i, c in enumerate(lines.values())), j % 2 * cap.CLOCK + cap.SELECTED)
    return cap.bus_runs(frames, F.transform(F.sequence(F.lit(0), 2 * F.length("bits") - 1), each), {n: 1 << i for i, n in enumerate(lines)})


def _bits(n: F.Column, width: int) -> F.Column:
    return v.binary_text(n, width)


def _raw_frames(spark, sf):
    rows = cap.by_user(spark, sf, frames=True)
    return rows.select("capture_id", F.col("sample").alias("frame"), F.concat(_bits(F.col("event_id"), 8), _bits(F.col("val"), 8)).alias("bits"))


@query(f"WITH {U} SELECT capture_id, sample AS frame, b AS unit, CASE WHEN b = 0 THEN event_id & 255 ELSE val & 255 END AS value FROM u, (SELECT unnest([0, 1]) AS b)")
def spi_raw_roundtrip(spark, sf):
    wave = settled(_wave(_raw_frames(spark, sf)), "bus")
    framed = spi.frames(wave)
    found = spi.fields(spi.transfers(wave, framed), spi.raw_plan(framed))
    return found.select("capture_id", "frame", "unit", "value")


LINES = ("io0", "io1")
OPCODE = "[159, 170, 11, 6, 3][etype + 1]"
#: Flash-like frames: read id, an unknown code, fast read, write enable, read.
CODES = (0x9F, 0xAA, 0x0B, 0x06, 0x03)


def _commands(spark, sf):
    rows = cap.by_user(spark, sf, frames=True)
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("etype") + 1).cast("int"))
    data, address, none = _bits(F.col("uid"), 8), _bits(F.col("event_id"), 24), F.lit("0" * 8)
    rest = F.when(F.col("etype") == 0, none).when(F.col("etype") == 1, data).when(F.col("etype") == 2, F.concat(address, none, none)).when(F.col("etype") == 3, F.lit("")).otherwise(F.concat(address, none))
    sent = F.concat(_bits(code.cast("long"), 8), rest)
    # What is read comes back on the other line, under zeros.
    back = F.when(F.col("etype").isin(0, 2, 4), F.concat(F.repeat(F.lit("0"), F.length(sent) - 8), data)).otherwise(F.repeat(F.lit("0"), F.length(sent)))
    wave = settled(_wave(rows.select("capture_id", F.col("sample").alias("frame"), sent.alias("bits"), back.alias("back")), {"io0": "bits", "io1": "back"}), "bus")
    # Opcodes and fields are both made of the transfers.
    framed = settled(spi.frames(wave), "spi-frames")
    moved = settled(spi.transfers(wave, framed, lines=LINES), "spi-transfers")
    return framed, moved, spi.planned(moved, spi.command_table(spark))


@query(f"""WITH {U} SELECT capture_id, sample AS frame, CAST({OPCODE} AS INT) AS opcode, ['READ ID', NULL, 'FAST READ', 'WRITE ENABLE', 'READ'][etype + 1] AS name,
  CASE WHEN etype IN (2, 4) THEN event_id & 16777215 END AS address, CASE WHEN etype = 3 THEN 0 ELSE 1 END AS data_bytes, CASE WHEN etype <> 3 THEN lpad(upper(to_hex(uid & 255)), 2, '0') END AS text FROM u""")
def spi_command_roundtrip(spark, sf):
    framed, moved, plan = _commands(spark, sf)
    found = settled(spi.fields(moved, plan, LINES), "spi-fields")
    out = spi.transactions(found, plan, framed).join(spi.export_frames(found), spi.FRAME, "left")
    return out.select("capture_id", F.col("frame").cast("long").alias("frame"), "opcode", "name", "address", F.col("data_bytes").cast("int").alias("data_bytes"), "text")


@query(f"WITH {U} SELECT address_lines, data_lines, dummy, count(*) AS frames FROM (SELECT 1 AS address_lines, CASE WHEN etype = 3 THEN 0 ELSE 1 END AS data_lines, CASE WHEN etype = 2 THEN 8 ELSE 0 END AS dummy FROM u) GROUP BY 1, 2, 3")
def spi_format_histogram(spark, sf):
    return spi.format_histogram(_commands(spark, sf)[2]).select("address_lines", "data_lines", "dummy", "frames")


@query(f"WITH {U}, b AS (SELECT capture_id, sample AS frame, CASE WHEN etype IN (0, 1) THEN [{OPCODE}, uid & 255] WHEN etype = 3 THEN [6] ELSE [{OPCODE}, (event_id >> 16) & 255, (event_id >> 8) & 255, event_id & 255, uid & 255] END AS l FROM u), p AS (SELECT *, unnest(range(1, len(l))) AS i FROM b) SELECT capture_id, frame FROM p WHERE l[i] = 0 AND l[i + 1] = 1")
def spi_query_bytes(spark, sf):
    framed, moved, plan = _commands(spark, sf)
    return spi.find_bytes(spi.fields(moved, plan, LINES).where("main"), [0, 1]).select("capture_id", "frame")


@query(f"""WITH {U} SELECT capture_id, sample AS frame, [183, 3, 233, 3, 2, 19][sample % 6 + 1] AS opcode, CASE sample % 6 WHEN 0 THEN NULL WHEN 1 THEN event_id + 16777216 WHEN 2 THEN NULL WHEN 5 THEN event_id + 16777216 ELSE event_id & 16777215 END AS address,
  CASE WHEN sample % 6 IN (0, 2) THEN 0 ELSE 1 END AS data_bytes FROM u""")
def spi_modes(spark, sf):
    """Reads and writes whose addresses are as long as the last change of mode says."""
    rows = cap.by_user(spark, sf, frames=True).withColumn("k", (F.col("sample") % 6).cast("int"))
    code = F.element_at(F.array(*map(F.lit, (0xB7, 0x03, 0xE9, 0x03, 0x02, 0x13))), F.col("k") + 1).cast("long")
    address = F.when(F.col("k").isin(1, 5), _bits(F.col("event_id") + (1 << 24), 32)).when(F.col("k").isin(3, 4), _bits(F.col("event_id"), 24)).otherwise(F.lit(""))
    data = F.when(F.col("k").isin(0, 2), F.lit("")).otherwise(_bits(F.col("uid"), 8))
    sent = F.concat(_bits(code, 8), address, data)
    wave = _wave(rows.select("capture_id", F.col("sample").alias("frame"), sent.alias("bits"), F.repeat(F.lit("1"), F.length(sent)).alias("back")), {"io0": "bits", "io1": "back"})
    out, _ = spi_decode.decode(wave, lines=LINES, before_edge=False)
    return out.select("capture_id", "frame", "opcode", "address", F.col("data_bytes").cast("int").alias("data_bytes"))


@query(f"""WITH {U} SELECT capture_id, count(*) AS frames, CAST(sum(CASE WHEN etype = 3 THEN 0 ELSE 1 END) AS BIGINT) AS data_bytes, CAST(0 AS BIGINT) AS problems, count(*) FILTER (etype = 1) AS unknown FROM u GROUP BY 1""")
def spi_summary(spark, sf):
    framed, moved, plan = _commands(spark, sf)
    return spi.summary(spi.transactions(spi.fields(moved, plan, LINES), plan, framed))


@query(f"WITH {U} SELECT capture_id, sample AS frame FROM u WHERE etype IN (2, 4) AND event_id & 16777215 BETWEEN 100 AND 400")
def spi_query_addr(spark, sf):
    framed, moved, plan = _commands(spark, sf)
    return spi.find_values(spi.fields(moved, plan, LINES), "ADDR", 100, 400).select("capture_id", "frame")


# Sources


@query(f"WITH {U}, g AS (SELECT CAST(0 AS BIGINT) AS capture_id, row_number() OVER (ORDER BY event_id) - 1 AS sample, etype, val FROM u), {rle('etype', 'r1', 'g')}, {rle('val', 'r2', 'g')} SELECT 'etype[2:0]' AS signal, start, \"end\", num FROM r1 UNION ALL SELECT 'val[15:0]', start, \"end\", num FROM r2")
def csv_roundtrip(spark, sf):
    rows = cap.whole(spark, sf).select("sample", F.col("etype").alias("etype[2:0]"), F.col("val").alias("val[15:0]"))
    path = shared_folder(spark, "csv")
    csvfile.write_csv_capture(rows.withColumnsRenamed({"etype[2:0]": "e", "val[15:0]": "v"}), {"e": "BINARY", "v": "HEX"}, path)
    got, _ = csvfile.read_csv_capture(spark, path)
    names = F.when(F.col("signal") == "e", "etype[2:0]").otherwise("val[15:0]")
    return got.select(names.alias("signal"), "start", "end", "num")


@query(f"WITH {U}, g AS (SELECT CAST(0 AS BIGINT) AS capture_id, row_number() OVER (ORDER BY event_id) - 1 AS sample, etype, err FROM u), {rle('etype', 'r1', 'g')}, {rle('err', 'r2', 'g')} SELECT 'top/etype[2:0]' AS signal, start, \"end\", num FROM r1 UNION ALL SELECT 'top/err', start, \"end\", num FROM r2")
def vcd_roundtrip(spark, sf):
    """The dump's time is the number of the event, as in ``vcd_layouts``."""
    rows = cap.whole(spark, sf)
    path = shared_folder(spark, "vcd")
    changes = rows.select(F.col("sample").alias("tick"), F.explode(F.array(F.struct(F.lit("etype[2:0]").alias("signal"), F.col("etype").alias("num")), F.struct(F.lit("err").alias("signal"), F.col("err").alias("num")))).alias("s")).select("tick", "s.*")
    vcdfile.write_vcd_capture(changes, {"etype[2:0]": 3, "err": 1}, path, "1us")
    return vcdfile.read_vcd_capture(spark, path)[0].select("signal", "start", "end", "num")


@query(f"WITH {U}, g AS (SELECT CAST(0 AS BIGINT) AS capture_id, row_number() OVER (ORDER BY event_id) - 1 AS sample, CASE WHEN (val * 7) & 255 >= 128 THEN ((val * 7) & 255) - 256 ELSE (val * 7) & 255 END AS s FROM u), {rle('s', 'r', 'g')} SELECT start, \"end\", num FROM r")
def csv_signed(spark, sf):
    """Patterns of signed bytes in quoted cells."""
    rows = cap.whole(spark, sf).select(F.col("sample").alias("k"), F.concat_ws(",", F.col("sample").cast("string"), F.concat(F.lit('"'), (F.col("val") * 7).bitwiseAND(F.lit(255)).cast("string"), F.lit('"'))).alias("value"))
    head = spark.createDataFrame([(-2, "Sample in Buffer,s[7:0]"), (-1, "Radix - UNSIGNED,SIGNED")], "k long, value string")
    path = shared_folder(spark, "csv")
    write_in_order(head.unionByName(rows), ["k"], path)
    return csvfile.read_csv_capture(spark, path)[0].select("start", "end", "num")


@query(f"WITH {U}, g AS (SELECT CAST(0 AS BIGINT) AS capture_id, row_number() OVER (ORDER BY event_id) - 1 AS sample, etype, err FROM u), {rle('etype', 'r1', 'g')}, {rle('err', 'r2', 'g')} SELECT 'top/etype[2:0]' AS signal, start, \"end\", num FROM r1 UNION ALL SELECT 'top/err', start, \"end\", num FROM r2")
def vcd_layouts(spark, sf):
    """A dump in changing layouts: identifiers on the next line, comments that look like changes, several changes a line. Its time
    is the number of the event: events of one time are samples of their own, which a dump by ``tick`` would make one."""
    rows = cap.whole(spark, sf)
    vector, scalar, time = F.concat(F.lit("b"), F.bin("etype")), F.concat(F.col("err").cast("string"), F.lit('"')), F.format_string("#%d", "sample")
    layouts = [
        F.array(time, vector, F.lit("b!"), scalar),
        F.array(F.concat(time, F.lit(" $comment 1! b101 b! #5 $end "), vector, F.lit(" b! "), scalar)),
        F.array(time, F.lit("r1.5"), F.lit("r"), scalar, F.lit("$comment"), F.lit('0" r'), F.lit("$end"), F.concat(vector, F.lit("  b!"))),
    ]
    text = F.element_at(F.array(*layouts), (F.col("sample") % 3 + 1).cast("int"))
    body = rows.select("sample", F.posexplode(text).alias("k", "value"))
    head = ["$timescale 1us $end", "$scope module top $end", "$var wire 3 b! etype[2:0] $end", '$var wire 1 " err $end', "$var real 64 r x $end", "$upscope $end", "$enddefinitions $end"]
    heads = spark.createDataFrame([(-1, i, h) for i, h in enumerate(head)], "sample long, k int, value string")
    path = shared_folder(spark, "vcd")
    write_in_order(heads.unionByName(body), ["sample", "k"], path)
    return vcdfile.read_vcd_capture(spark, path)[0].select("signal", "start", "end", "num")


@query("SELECT event_id, format('{:.6g}', CASE WHEN h >= 1e9 THEN h / 1e9 WHEN h >= 1e6 THEN h / 1e6 WHEN h >= 1e3 THEN h / 1e3 ELSE h END) || CASE WHEN h >= 1e9 THEN ' GHz' WHEN h >= 1e6 THEN ' MHz' WHEN h >= 1e3 THEN ' kHz' ELSE ' Hz' END AS text FROM (SELECT event_id, (CAST(event_id AS DOUBLE) + 1) * (user_id + 1) * 37.0::DOUBLE / 3 AS h FROM events)")
def frequency_texts(spark, sf):
    hertz = (F.col("event_id").cast("double") + 1) * (F.col("user_id") + 1) * F.lit(37.0) / 3
    return cap.table(spark, sf, "events").select("event_id", tm.frequency_text(hertz).alias("text"))


from . import flash_queries as _flash  # noqa: E402, F401 - registers its queries
