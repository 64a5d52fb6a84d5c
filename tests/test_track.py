"""Navigation, tables, searches, viewports and captures of any kind, against plain Python."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from test_golden import capture, write
from test_spi_decode import QUAD, READ, told
from wavespark.functions import times as tm
from wavespark.operators import grids, intervals, joins, measure, runs, spi, track
from wavespark.sources.capture import open_capture


@pytest.mark.parametrize("size", [None, 3, 50])
def test_nearest_marks_and_positions(spark, size):
    rng = random.Random(1)
    axis = {k: sorted(rng.sample(range(-60, 200), 30)) for k in (0, 1)} | {2: []}
    ask = [(k, rng.randint(-80, 220)) for k in (0, 1, 2) for _ in range(40)]
    marks = spark.createDataFrame([(k, a) for k, xs in axis.items() for a in xs], "capture_id long, start long")
    points = spark.createDataFrame(ask, "capture_id long, at long")
    for forward in (True, False):
        for strict in (True, False):
            got = sorted((r.capture_id, r.at, r.found) for r in joins.nearest(points, marks, "at", forward=forward, strict=strict, size=size).collect() if r.found is not None)
            want = []
            for k, a in ask:
                xs = [x for x in axis[k] if (x > a if forward else x < a) or not strict and x == a]
                want += [(k, a, (min if forward else max)(xs))] if xs else []
            assert got == sorted(want)
    reals = [(k, float(a) / 3) for k, a in ask] + [(0, math.inf), (1, -math.inf), (0, math.nan), (1, 1e19), (2, 2.0**63), (0, -(2.0**64)), (1, float(axis[1][4]))]
    keyed = spark.createDataFrame(reals, "capture_id long, at double")
    for side in ("left", "right"):
        got = sorted((r.capture_id, repr(r.at), r.position) for r in joins.search_positions(keyed, marks, "at", side, size=size).collect())
        want = sorted((k, repr(a), len(axis[k]) if math.isnan(a) else (bisect.bisect_left if side == "left" else bisect.bisect_right)(axis[k], a)) for k, a in reals)
        assert got == want
    assert [r.position for r in joins.search_positions(spark.createDataFrame([(0, None)], "capture_id long, at double"), marks, "at").collect()] == [None]


def test_steps_and_searches_over_a_track(spark):
    _, _, table, found = told(spark, [[(1, [0x9F]), (READ, [1, 2])], [(1, [0x06])], [(1, [0x9F]), (READ, [3])]])
    fields = [(r.frame, r.start, r.end) for r in found.orderBy("start").collect()]
    stops = sorted({s for _, s, _ in fields} | {max(e for f, _, e in fields if f == k) for k in (0, 1, 2)})
    cursors = spark.createDataFrame([(0, a) for a in range(0, stops[-1] + 8, 3)], "capture_id long, at long")
    for forward in (True, False):
        got = {r.at: r.found for r in track.step(cursors, found, forward=forward).collect()}
        assert got == {a: (min if forward else max)([s for s in stops if (s > a if forward else s < a)], default=None) for a in got}
    inside = {r.at: r.frame for r in track.at_places(cursors, table, ["frame"]).collect()}
    frames = [(r.frame, r.start, r.end) for r in table.collect()]
    assert inside == {a: next((f for f, s, e in frames if s <= a < e), None) for a in inside}
    hits = found.where("kind = 'CMD' AND value = 159")
    got = {r.at: (r.found, r.wrapped) for r in track.search(cursors, hits).collect()}
    starts = sorted(r.start for r in hits.collect())
    assert got == {a: next(((s, False) for s in starts if s > a), (starts[0], True)) for a in got}
    assert {r.found for r in track.search(cursors, hits, forward=False, wrap=False).where("at < 5").collect()} == {None}
    assert track.window(found, fields[1][1], fields[2][1] + 1).count() == 2
    spans = [(r.first, r.last) for r in track.busy(found.where("frame = 0"), 0, 160, 16).collect()]
    covered = {c for a, b in spans for c in range(a, b + 1)}
    assert covered == {c for _, s, e in fields[:3] for c in range(s // 10, -(-e // 10))} and all(b < c for (_, b), (c, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))


def test_one_row_for_each_frame(spark):
    long_read = [(1, [0x03, 0, 0, 9]), (READ, list(range(20)))]
    _, _, table, found = told(spark, [long_read, [(1, [0xAA, 0x11])], [(1, [0x35])], [("io", [15] * 16)], [(1, [0xEB]), (QUAD, [0, 0, 1]), ("dummy", 10), (QUAD, [0xAB]), ("io", [12])]])
    rows = track.transaction_table(table, found).orderBy("frame").collect()
    assert rows[0].preview == " ".join(f"{i:02X}" for i in range(16)) + " …" and rows[0].command == "03 READ" and rows[0].address == "000009" and rows[0].data_bytes == 20
    assert rows[1].preview == "11 | MISO: 00" and rows[1].flags == "not in the table" and rows[1].command == "AA"
    assert rows[2].flags == "-> Quad 4-4-4" and rows[3].command == rows[3].format == "RESET" and rows[3].flags == "-> Extended"
    assert rows[4].preview == "AB C/4b" and rows[4].flags == "partial"
    assert [r.frame for r in track.matching(table, problems=True).orderBy("frame").collect()] == [1, 4] and track.matching(table, found.where("kind = 'ADDR'"), resets=False).count() == 2


def test_spans_by_time_leave_idle_time_alone(spark):
    ticks = [0, 5, 10, 15, 20, 25, 30, 35, 1000, 1005, 1010, 1015]
    data = capture(spark, clk=[i % 2 for i in range(12)])
    axis = spark.createDataFrame([(0, i, t) for i, t in enumerate(ticks)], "capture_id long, sample long, tick long")
    marks = grids.edges(data)
    for size in (None, 4):
        got = {r.edge: (r.start, r.end) for r in grids.edge_grid_by_time(marks, axis, size=size).collect()}
        assert got == {1: (0, 1), 3: (1, 3), 5: (3, 5), 7: (5, 7), 9: (8, 9), 11: (9, 11)}  # the edge at 1005 reaches to 995, not over the idle time
        got = {r.edge: (r.start, r.end) for r in grids.edge_grid_by_time(marks, axis, before=False, size=size).collect()}
        assert got == {1: (1, 3), 3: (3, 5), 5: (5, 7), 7: (7, 8), 9: (9, 11), 11: (11, 12)}


def test_viewports_by_time_and_by_detail(spark):
    rng = random.Random(3)
    ticks = sorted(rng.sample(range(1000), 200))
    values = [rng.randint(0, 2) if i % 9 else 5 for i in range(200)]
    data = capture(spark, a=values, b=[i // 100 for i in range(200)])
    axis = spark.createDataFrame([(0, i, t) for i, t in enumerate(ticks)], "capture_id long, sample long, tick long")
    left, right, columns = 100, 900, 40
    starts = [i for i in range(200) if i == 0 or values[i] != values[i - 1]]
    at = [max(0, bisect.bisect_right(ticks, math.floor(left + k * (right - left) / columns)) - 1) for k in range(columns + 1)]
    run = [starts[bisect.bisect_right(starts, s) - 1] for s in at]
    pixels = [(run[k] != run[k + 1], None if run[k] != run[k + 1] else values[run[k]]) for k in range(columns)]
    for size in (None, 16):
        got = {}
        for r in measure.viewport_by_time(data, axis, left, right, columns, size).where("signal = 'a'").collect():
            got |= {k: (r.busy, r.num) for k in range(r.first, r.last + 1)}
        assert [got[k] for k in range(columns)] == pixels
    shown = measure.viewport_detail(data, 20, 180, 20).collect()
    assert {r.signal: r.exact for r in shown} == {"a": False, "b": True} and sorted((r.first, r.last, r.num) for r in shown if r.signal == "b") == [(20, 99, 0), (100, 179, 1)]
    assert sum(r.signal == "a" for r in shown) <= 20


def test_unique_values_are_sorted_numbers_first(spark):
    rows = [(0, t, n, i) for i, (t, n) in enumerate([("1F", 31), ("0X", None), ("A", 10), ("XX", None), ("2", 2)])]
    df = spark.createDataFrame(rows, "capture_id long, value string, num long, first long")
    order = lambda **how: [r.value for r in measure.sorted_unique(df, **how).orderBy("place").collect()]
    assert order(radix="HEX") == ["2", "A", "1F", "0X", "XX"] and order(radix="HEX", descending=True) == ["XX", "0X", "1F", "A", "2"]
    signed = spark.createDataFrame([(0, t, 0, i) for i, t in enumerate(["5", "-7", "X", "10"])], "capture_id long, value string, num long, first long")
    assert [r.value for r in measure.sorted_unique(signed, "SIGNED").orderBy("place").collect()] == ["-7", "5", "10", "X"]


def test_exports_are_in_order_and_bounded(spark, tmp_path, monkeypatch):
    points = spark.range(500).select(F.lit(0).cast("long").alias("capture_id"), F.col("id").alias("at")).repartition(7)
    path = f"file://{tmp_path}/x"
    parts = measure.export_channels(points, {"a": F.col("at").cast("string"), "b": F.hex("at")}, path).orderBy("offset").collect()
    text = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*")))
    assert text == "".join(f"{i} {i:X}\n" for i in range(500)) and sum(p.characters for p in parts) == len(text) and [p.offset for p in parts] == [sum(q.characters for q in parts[:i]) for i in range(len(parts))]
    monkeypatch.setattr(measure, "MOST_CHARACTERS", 100)
    with pytest.raises(ValueError, match="characters"):
        measure.export_channels(points, {"a": F.col("at").cast("string")}, path)
    with pytest.raises(ValueError, match="characters"):
        measure.export_text(points, F.col("at").cast("string"))


def test_sizes_change_nothing(spark):
    rng = random.Random(9)
    data = capture(spark, a=[rng.choice([0, 1, "X"]) for _ in range(150)], b=[rng.randint(0, 1) for _ in range(150)])
    rows = lambda df: sorted(map(repr, df.collect()))
    points = runs.decode(data).withColumnRenamed("sample", "at").withColumn("value", F.coalesce(F.col("num").cast("string"), "txt"))
    for size in (1, 7, 64):
        assert rows(measure.measure_edges(data, 3, 140, size)) == rows(measure.measure_edges(data, 3, 140))
        assert rows(measure.export_changes(points, F.col("value"), keys=("signal",), size=size)) == rows(measure.export_changes(points, F.col("value"), keys=("signal",)))


def test_captures_of_any_kind_come_in_one_way(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Sample in Buffer,x[3:0],y\nRadix - UNSIGNED,HEX,HEX\n0,1,0\n1,1,1\n2,A,1\n")
    found = open_capture(spark, path)
    assert found.kind == "csv" and found.count == 3 and found.times is None and [(r.signal, r.width) for r in found.signals.orderBy("position").collect()] == [("x[3:0]", 4), ("y", 1)]
    assert {r.signal for r in open_capture(spark, path, ["y"]).runs.collect()} == {"y"}
    with pytest.raises(ValueError, match="zz"):
        open_capture(spark, path, ["zz"])
    dump = "$timescale 1ns $end $scope module t $end $var wire 1 ! clk $end $var wire 2 \" d $end $upscope $end $enddefinitions $end\n#0 0! b01 \"\n#5 1!\n#9 b10 \"\n"
    found = open_capture(spark, write(tmp_path / "b.VCD", dump))
    assert found.kind == "vcd" and found.count == 3 and [r.tick for r in found.times.orderBy("sample").collect()] == [0, 5, 9] and sorted((r.signal, r.start, r.num) for r in found.runs.collect()) == [("t/clk", 0, 0), ("t/clk", 1, 1), ("t/d", 0, 1), ("t/d", 2, 2)]
    with pytest.raises(ValueError, match="csv"):
        open_capture(spark, str(tmp_path / "c.wlf"))


def test_small_pieces_that_had_no_test(spark):
    spans = spark.createDataFrame([(0, 2, 5), (0, 7, 9)], "capture_id long, start long, end long")
    assert [(r.start, r.end) for r in intervals.containing(spans, 4).collect()] == [(2, 5)] and intervals.containing(spans, 5).count() == 0
    one = spark.range(1)
    assert one.select(tm.ruler(7, 22, 5)).first()[0] == [10, 15, 20] and one.select(tm.ruler(11, 14, 5)).first()[0] == [] and one.select(tm.sample_time(F.lit(6), 2.5)).first()[0] == 15.0
    _, _, _, found = told(spark, [[(1, [0x9F]), (READ, [1])]])
    r = spi.frames_span(found.withColumn("kind", F.when(F.col("kind") == "RD", "DATA").otherwise(F.col("kind")))).first()
    assert (r.start, r.end) == (7, 69)


def test_fields_are_exported_and_searched(spark, monkeypatch):
    _, _, table, found = told(spark, [[(1, [0x03, 0, 0x12, 9]), (READ, [0xDE, 5])], [(1, [0xAA, 0x11])], [(1, [0x06])], [(1, [0x02, 0, 0, 1, 0xBE, 0xEF]), ("io", [1, 0, 1])]])
    texts = lambda *a, **k: [r.text for r in track.export_text(table, found, *a, **k).orderBy("frame").collect()]
    assert texts() == ["DE 05", "11", "BE EF 5"] and texts("read", "DEC") == ["222 5"] and texts("write", "BIN", prefix=True)[0] == "0b10111110 0b11101111 0b101"
    assert texts("miso") == ["00"] and texts("all", separator="", header=True)[:3] == ["#1 03 @001209: 03001209DE05", "#2 AA: AA11", "#3 06: 06"]
    first = found.where("frame = 1 AND kind = 'MOSI'").first().start
    assert texts(start=first) == ["11", "BE EF 5"] and texts(end=first) == ["DE 05"]
    unknown = found.withColumn("unknown", F.col("value") == 0xDE)
    assert track.export_text(table, unknown).where("frame = 0").first().text == "XX 05"
    asked = track.as_queried(found)
    hits = lambda *b, **how: sorted(r.frame for r in spi.find_bytes(asked, list(b), **how).collect())
    assert hits(0x03, 0x00, 0x12) == [0] and hits(0x09, 0xDE, 0x05) == [0] and hits(0xBE, 0xEF) == [3] and hits(0xAA, 0x00) == [1] and hits(0x03, data_only=True) == []
    assert [r.frame for r in spi.find_values(asked, "ADDR", 0x1000, 0x1FFF).collect()] == [0] and [r.frame for r in spi.find_values(asked, "CMD", 6).collect()] == [2]
    monkeypatch.setattr(track, "MOST_CHARACTERS", 5)
    with pytest.raises(ValueError, match="characters"):
        track.export_text(table, found)


def test_periods_in_seconds(spark):
    data = capture(spark, clk=[0, 1, 0, 1, 0, 1], still=[0, 0, 0, 0, 1, 1])
    measured = measure.measure_edges(data, 0, 5)
    rows = {r.signal: r for r in measure.measured_period(measured, 5e-9).collect()}
    assert rows["clk"].period_ticks == 2 and rows["clk"].period_seconds == pytest.approx(1e-8) and rows["clk"].hertz == pytest.approx(1e8) and rows["still"].hertz is None
    axis = spark.createDataFrame([(0, i, t) for i, t in enumerate([0, 10, 25, 30, 45, 70])], "capture_id long, sample long, tick long")
    rows = {r.signal: r for r in measure.measured_period(measured, 1e-9, axis).collect()}
    assert rows["clk"].period_ticks == 30 and rows["clk"].hertz == pytest.approx(1 / 30e-9)
