"""Small captures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from wavespark.functions import times, values
from wavespark.operators import axis, grids, intervals, joins, measure, runs, spi, spi_decode
from wavespark.plans.conditions import S, literal
from wavespark.sources import csvfile, vcdfile


def capture(spark, **signals):
    """Runs of signals given as lists of samples; None or text is unknown."""
    rows = [(0, n, i, v if isinstance(v, int) else None, v if isinstance(v, str) else None) for n, vs in signals.items() for i, v in enumerate(vs)]
    return runs.encode(spark.createDataFrame(rows, "capture_id long, signal string, sample long, num long, txt string"))


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def points(spark, n, period=1, phase=0):
    return grids.periodic(spark, 0, n, period, phase).withColumn("capture_id", F.lit(0).cast("long"))


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_runs_and_search(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Sample in Buffer,bus[8:0]\nRadix - UNSIGNED,HEX\n0,001\n1,001\n\n2,0AC\n3,0ac\n4,001\n")
    got, columns = csvfile.read_csv_capture(spark, path)
    assert [(c.name, c.width, c.meta) for c in columns] == [("Sample in Buffer", None, True), ("bus[8:0]", 9, False)]
    assert sorted((r.start, r.end, r.num) for r in got.collect()) == [(0, 2, 1), (2, 4, 172), (4, 5, 1)]
    assert runs.search(got, 1, 0).first().asDict() == {"capture_id": 0, "signal": "bus[8:0]", "start": 4, "wrapped": False}
    assert runs.search(got, 1, 4).first()["start"] == 0 and runs.search(got, 1, 4).first()["wrapped"]
    with pytest.raises(ValueError, match="line 4"):
        csvfile.read_csv_capture(spark, write(tmp_path / "b.csv", "a,b\nRadix - HEX,HEX\n1,2\n1\n"))
    with pytest.raises(ValueError, match="'1G'"):
        csvfile.read_csv_capture(spark, write(tmp_path / "c.csv", "a,b\nRadix - HEX,HEX\n1,2\n1,1G\n"))


def test_values(spark):
    cells = [("0AC", "HEX", "i:172"), ("xz", "HEX", "t:XZ"), ("0b1_01", "BINARY", "i:5"), ("777", "OCTAL", "i:511"), ("-3", "SIGNED", "i:-3"), ("F" * 20, "HEX", "w:" + "1" * 80), ("G", "HEX", None), ("", "BINARY", None), ("7FFFFFFFFFFFFFFF", "HEX", f"i:{2**63 - 1}")]
    for text, radix, key in cells:
        got = spark.range(1).select(values.value_key(values.parse_value(F.lit(text), radix)).alias("k")).first().k
        assert got == key, text
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(values.expand_text(F.lit("X1"), "BINARY", 8)) == "000000X1" and one(values.expand_text(F.lit("X"), "HEX", 6)) == "XXXXXX"
    assert one(values.format_value(F.lit(0x5C41), "ASCII", 16)) == "\\\\A" and one(values.format_value(F.lit(7), "ASCII", 8)) == "\\x07"
    assert one(values.format_value(F.lit(-1), "HEX", 9)) == "1FF" and one(values.format_value(F.lit(255), "SIGNED", 8)) == "-1"
    assert one(values.real_text(F.lit(0x3FC00000).cast("long"), 32)) == "1.5" and one(values.reverse_bits(F.lit(1).cast("long"), 4)) == 8
    assert values.offsets_of("7-4 2-1", 8, as_set=True) == [7, 6, 5, 4, 2, 1] and values.offsets_of("2,0", 3) == [2, 0]
    with pytest.raises(ValueError):
        values.offsets_of("8", 8)


def test_times(spark):
    assert times.unit_seconds("10 ns") == pytest.approx(1e-8) and times.clock_ns("100 MHz") == pytest.approx(10) and times.clock_ns("2,5ns") == pytest.approx(2.5)
    got = spark.createDataFrame([(3.0, 2.5e6), (0.7, 999.0)], "a double, h double").select(times.nice_step(F.col("a")), times.frequency_text(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(5.0, "2.5 MHz"), (1.0, "999 Hz")]


def test_highlight_golden(spark):
    ready = capture(spark, ready=[0, 1, 0, 0, 1, 1, 0, 1])
    held = S("ready").true.on(points(spark, 8), ready)
    assert spans(intervals.highlight(held, F.col("holds"))) == [(1, 2), (4, 6), (7, 8)]
    assert [r.capture_id for r in held.where("at = 0").collect()] == [0]


def test_conditions_unknown_and_previous(spark):
    data = capture(spark, a=[0, "X", 1, 1], b=[1, 1, 1, 0])
    at = lambda c: sorted(r["at"] for r in c.on(points(spark, 4), data).where("holds").collect())
    assert at(S("a").true) == [2, 3] and at(~S("a").true) == [0, 1] and at(S("a").ne(0)) == [1, 2, 3] and at(S("a").eq("X")) == [1]
    assert at(S("a").lt(1)) == [0] and at(S("b").true | S("b").previous.true) == [1, 2, 3] and at(S("b").eq(S("a"))) == [2]
    assert literal("10") == 16 and literal("d10") == 10 and literal("hFF", width=8) == 255 and literal("0b11") == 3
    with pytest.raises(ValueError):
        literal("h100", width=8)


def test_gated_clock(spark):
    sck = capture(spark, sck=[0, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 1, 1])
    marks = grids.edges(sck)
    assert sorted(r.edge for r in marks.collect()) == [2, 4, 6, 11]
    count = spark.createDataFrame([(0, 13)], "capture_id long, count long")
    assert spans(grids.edge_grid(marks, count)) == [(0, 2), (2, 4), (4, 6), (9, 11)]
    assert spans(axis.merge_touching(grids.edge_grid(marks, count), ["capture_id"], None)) == [(0, 6), (9, 11)]


def test_edges_beside_unknown(spark):
    flag = capture(spark, flag=[0, 0, 1, 0, "X", 0, 1, 0])
    r = measure.measure_edges(flag, 0, 7).first()
    assert (r.rising, r.first_rise, r.last_rise) == (2, 2, 6)
    clk = measure.measure_edges(capture(spark, clk=[0, 1] * 6), 0, 11).first()
    assert (clk.rising, clk.falling, clk.first_rise, clk.last_rise, clk.period) == (6, 5, 1, 11, 2.0)


@pytest.mark.parametrize("size", [1, 2, 5, 7, 1000, None])
def test_cut_axis_equals_whole(spark, size):
    """Buckets of any size give what one window gives."""
    import random

    rng = random.Random(2)
    rows = [(0, s, s + rng.choice([1, 1, 2, 9])) for s in sorted(rng.sample(range(60), 25))]
    want, reach = [], None
    for _, s, e in rows:
        if reach is not None and s <= reach:
            want[-1] = (want[-1][0], max(reach, e))
        else:
            want.append((s, e))
        reach = want[-1][1]
    assert spans(axis.merge_touching(spark.createDataFrame(rows, "capture_id long, start long, end long"), ["capture_id"], size)) == want
    held = spark.createDataFrame([(0, s, i) for i, (_, s, _) in enumerate(rows)], "capture_id long, start long, v long")
    asked = spark.createDataFrame([(0, p) for p in range(60)], "capture_id long, p long")
    got = {r.p: r.v for r in joins.as_of(asked, held, "p", ["v"], size=size).collect()}
    assert got == {p: max((i for i, (_, s, _) in enumerate(rows) if s <= p), default=None) for p in range(60)}
    if size:
        spread = spark.createDataFrame([(x * 3,) for x in range(40)], "x long")
        assert sorted((r.x, r.sample) for r in axis.number_rows(spread, "x", size=size).collect()) == [(x * 3, x) for x in range(40)]


def test_vcd(spark, tmp_path):
    text = "$timescale 1ns $end\n$scope module t $end\n$var wire 8 ! data [7:0] $end\n$var wire 1 \" ready $end\n$var wire 1 # late $end\n$var real 1 r x $end\n$upscope $end\n$enddefinitions $end\n$dumpvars\nb1 !\n0\"\n$end\n#0\n#10\nbx0 ! 1\"\nr1.5 r\n1#\n#100\n0\"\n1\"\n#100\n0#\n#120\n"
    got, ticks, scale = vcdfile.read_vcd_capture(spark, write(tmp_path / "a.vcd", text))
    assert scale == "1ns" and sorted((r.sample, r.tick) for r in ticks.collect()) == [(0, 0), (1, 10), (2, 100), (3, 120)]
    rows = sorted((r.signal, r.start, r.end, r.num, r.txt) for r in got.collect())
    assert rows == [("t/data[7:0]", 0, 1, 1, None), ("t/data[7:0]", 1, 4, None, "XXXXXXX0"), ("t/late", 0, 1, None, "X"), ("t/late", 1, 2, 1, None), ("t/late", 2, 4, 0, None), ("t/ready", 0, 1, 0, None), ("t/ready", 1, 4, 1, None)]


def test_bus_with_unknown_bit(spark):
    bits = capture(spark, b1=[0, 1, 1], b0=[0, 1, "X"])
    got = sorted((r.start, r.end, r.num, r.txt) for r in runs.assemble_bus(bits, ["b1", "b0"], "b[1:0]").collect())
    assert got == [(0, 1, 0, None), (1, 2, 3, None), (2, 3, None, "1X")]


def test_quad_frame_and_partial(spark):
    """A quad read: command on one line, address and data on four, ten dummy clocks; then a frame cut short."""
    wave: dict[str, list[int]] = {n: [] for n in ("cs", "sck", "io0", "io1", "io2", "io3")}

    def put(cs, sck, nibble):
        for n, v in zip(wave, (cs, sck, *[(nibble >> k) & 1 for k in range(4)]), strict=True):
            wave[n].append(v)

    def clock(nibble):
        put(0, 0, nibble)
        put(0, 1, nibble)

    put(1, 0, 0)
    for k in range(7, -1, -1):
        clock((0xEB >> k) & 1)
    for h in "123456" + "0" * 10 + "DEADBEEF":
        clock(int(h, 16))
    put(1, 0, 0)
    for k in range(7, 1, -1):
        clock((0x9F >> k) & 1)
    put(1, 0, 0)
    data = capture(spark, **wave)
    lines = ("io0", "io1", "io2", "io3")
    framed = spi.frames(data)
    moved = spi.transfers(data, framed, lines=lines)
    plan = spi.planned(moved, spi.command_table(spark))
    found = spi.fields(moved, plan, lines)
    rows = {r.frame: r for r in spi.transactions(found, plan, framed).collect()}
    assert (rows[0].opcode, rows[0].address, rows[0].data_bytes, rows[0].problem) == (0xEB, 0x123456, 4, False)
    assert rows[1].opcode is None and rows[1].problem
    assert [r.text for r in spi.export_frames(found).collect()] == ["DE AD BE EF"]
    assert [r.frame for r in spi.find_bytes(found, [0x56, 0xDE, 0xAD]).collect()] == [0]


def test_address_widths_and_erases(spark):
    """A 4-byte read and two erases by their opcodes; then addresses of one byte by a fixed plan."""
    wave: dict[str, list[int]] = {n: [] for n in ("cs", "sck", "io0", "io1")}

    def put(*values):
        for n, x in zip(wave, (*values, values[-1]), strict=True):
            wave[n].append(x)

    put(1, 0, 0)
    for frame in ("1312345678AB", "20001000", "DC01020304"):
        for bit in f"{int(frame, 16):0{4 * len(frame)}b}":
            put(0, 0, int(bit))
            put(0, 1, int(bit))
        put(1, 0, 0)
    data = capture(spark, **wave)
    framed = spi.frames(data)
    moved = spi.transfers(data, framed, lines=("io0", "io1"))
    plan = spi.planned(moved, spi.command_table(spark))
    found = spi.fields(moved, plan, ("io0", "io1"))
    rows = sorted((r.frame, r.name, r.address, r.data_bytes) for r in spi.transactions(found, plan, framed).collect())
    assert rows == [(0, "4-BYTE READ", 0x12345678, 1), (1, "4KB SUBSECTOR ERASE", 0x1000, 0), (2, "4-BYTE SECTOR ERASE", 0x01020304, 0)]
    hits = lambda found, *wanted: sorted(r.frame for r in spi.find_bytes(found, list(wanted)).collect())
    assert hits(found, 0x13, 0x12, 0x34) == [0] and hits(found, 0x78, 0xAB) == [0]
    narrow = spi.fields(moved, spi.fixed_plan(framed, 1, 1, 1, 0, 1))
    assert hits(narrow, 0, 0x12) == [] and hits(narrow, 0x13, 0x12, 0x34) == [0]


def spi_wave(spark, frames, *names, falling=False):
    """Frames as lists of levels of the lines, one per clock."""
    wave: dict[str, list[int]] = {n: [] for n in ("cs", "sck", *names)}
    idle = int(falling)

    def put(*values):
        for n, x in zip(wave, values, strict=True):
            wave[n].append(x)

    rest = [0] * len(names)
    put(1, idle, *rest)
    for frame in frames:
        for levels in frame:
            put(0, idle, *levels)
            put(0, 1 - idle, *levels)
        put(1, idle, *rest)
    return capture(spark, **wave)


def bits(text):
    return [int(b) for b in f"{int(text, 16):0{4 * len(text)}b}"]


def test_spi_lanes_and_polarity(spark):
    """A read answers on io1; an unknown command has both lanes; the clock may sample as it falls, the lowest bit first."""
    lines = ("io0", "io1")
    read = list(zip(bits("9F0000"), bits("00EF40"), strict=True))
    odd = list(zip(bits("AA11"), bits("0022"), strict=True))
    for falling in (False, True):
        data = spi_wave(spark, [read, odd], *lines, falling=falling)
        framed = spi.frames(data)
        moved = spi.transfers(data, framed, lines=lines, falling=falling)
        plan = spi.planned(moved, spi.command_table(spark))
        found = spi.fields(moved, plan, lines)
        rows = {r.frame: r for r in spi.transactions(found, plan, framed).collect()}
        assert (rows[0].name, rows[0].data_bytes, rows[1].name, rows[1].data_bytes) == ("READ ID", 2, None, 1)
        text = lambda lane=None: {r.frame: r.text for r in spi.export_frames(found, lane=lane).collect()}
        assert text() == {0: "EF 40", 1: "11"} and text("in") == {0: "EF 40", 1: "22"}
        hits = lambda *b, **how: sorted(r.frame for r in spi.find_bytes(found, list(b), **how).collect())
        assert hits(0x9F, 0xEF) == [0] and hits(0xAA, 0x22) == [1] and hits(0xAA, 0x11) == [1] and hits(0x9F, data_only=True) == []
    raw = spi.fields(moved, spi.raw_plan(framed), lines, lowest_first=True)
    assert [r.value for r in raw.where("frame = 1").orderBy("unit").collect()] == [0x55, 0x88]
    alone = spi.fields(moved.drop("io1"), plan)
    assert spi.transactions(alone, plan, framed).where("frame = 0").first().problem  # nothing is wired to the reading line


def test_spi_modes(spark):
    """Four lines and four address bytes until they are taken back, by a command or by a reset; buckets of any size."""
    lines = ("io0", "io1", "io2", "io3")
    one = lambda text: [(b, 0, 0, 0) for b in bits(text)]
    four = lambda text: [tuple((int(h, 16) >> k) & 1 for k in range(4)) for h in text]
    frames = [one("02123456AA"), one("B7"), one("0212345678AA"), one("35"), four("0212345678AA"), four("E9"), four("02123456AA"), four("F5"), one("02123456AA"), one("B7"), one("66"), one("99"), one("02123456AA"), one("B7"), one("66"), one("05"), one("99"), one("0212345678AA")]
    data = spi_wave(spark, frames, *lines)
    framed = spi.frames(data)
    for size in (1 << 10, 3, 2):
        table, _ = spi_decode.decode(data, framed, lines=lines, before_edge=False, bucket=size)
        told = {r.frame: r.address for r in table.where("opcode = 2").collect()}
        assert told == {0: 0x123456, 2: 0x12345678, 4: 0x12345678, 6: 0x123456, 8: 0x123456, 12: 0x123456, 17: 0x12345678}, size


def test_bits_of_unknown_and_wide_values(spark):
    wide = "1" + "0" * 98 + "1"
    data = capture(spark, **{"v[99:0]": [5, wide, "X"]})
    got = {(r.signal, r.start): r.num if r.txt is None else r.txt for r in runs.expand_bits(data, 100).collect()}
    assert [got["v[0]", 0], got["v[1]", 0], got["v[2]", 0], got["v[99]", 0], got["v[99]", 1], got["v[50]", 0], got["v[0]", 2]] == [1, 0, 1, 0, 1, 0, "X"] and ("v[0]", 1) not in got
    up = {r.signal: r.txt or r.num for r in runs.expand_bits(capture(spark, **{"u[4:7]": ["1X0Z"]}), 4).collect()}
    assert up == {"u[4]": 1, "u[5]": "X", "u[6]": 0, "u[7]": "Z"}
    hexed = {r.signal: r.txt for r in runs.expand_bits(capture(spark, h=["XA"]), 8, "HEX").where("txt IS NOT NULL").collect()}
    assert hexed == {f"h[{k}]": "X" for k in range(4, 8)}
    picked = S("d", 4, source="BINARY").bits("1:0").eq("b01")
    held = picked.on(points(spark, 3), capture(spark, d=["XX01", "XX1X", 5])).where("holds")
    assert sorted(r["at"] for r in held.collect()) == [0, 2]


def test_signed_literals():
    assert literal("hFF", "SIGNED", 8) == -1 and literal("d-1", "SIGNED", 8) == -1 and literal("hFF", "SIGNED_MAGNITUDE", 8) == -127 and literal("200", "UNSIGNED", 8) == 200
    for text, radix in (("d200", "SIGNED"), ("h1FF", "SIGNED"), ("d-1", "UNSIGNED"), ("zz", "HEX")):
        with pytest.raises(ValueError):
            literal(text, radix, 8)


def test_csv_checks(spark, tmp_path):
    head = "Sample in Buffer,s[7:0],u\nRadix - UNSIGNED,SIGNED,HEX\n"
    got, columns = csvfile.read_csv_capture(spark, write(tmp_path / "a.csv", head + '0,255,"1F"\n1,-3,XX\n2,7,3\n'))
    assert sorted((r.signal, r.start, r.num, r.txt) for r in got.collect()) == [("s[7:0]", 0, -1, None), ("s[7:0]", 1, -3, None), ("s[7:0]", 2, 7, None), ("u", 0, 31, None), ("u", 1, None, "XX"), ("u", 2, 3, None)]
    assert [c.width for c in columns] == [None, 8, 8]
    assert [tuple(r) for r in csvfile.read_csv_meta(spark, str(tmp_path / "a.csv")).orderBy("sample").collect()] == [(0, 0), (1, 1), (2, 2)]
    for row, why in (("0,256,1", "width"), ('0,"1,1', "quoted"), ("0,1", "cells")):
        with pytest.raises(ValueError, match=why):
            csvfile.read_csv_capture(spark, write(tmp_path / f"{why}{len(row)}.csv", head + row + "\n"))


def test_vcd_errors(spark, tmp_path):
    head = "$var wire 8 ! data [7:0] $end\n$enddefinitions\n$end\n"
    good, _, _ = vcdfile.read_vcd_capture(spark, write(tmp_path / "a.vcd", head + "#0 b1\n! $comment 1! b101 $end\n#1\n$dumpvars b11 ! $end #2"))
    assert sorted((r.start, r.end, r.num) for r in good.collect()) == [(0, 1, 1), (1, 3, 3)]
    for n, (text, why) in enumerate([("#5\n1!\n#3\n", "below"), ("#0 hello", "hello"), ("#0 b1", "b1")]):
        with pytest.raises(ValueError, match=why):
            vcdfile.read_vcd_capture(spark, write(tmp_path / f"{n}.vcd", head + text), size=2)


@pytest.mark.parametrize("size", [1, 7])
def test_buckets_equal_one_window(spark, size):
    """Runs, edges, grids, buses and frames in pieces are what they are in one."""
    import random

    rng = random.Random(4)
    names = {n: [rng.choice([0, 0, 1, 1, "X"]) for _ in range(40)] for n in ("clk", "a", "b")}
    data = capture(spark, **names)
    rows = lambda d: sorted(map(str, d.collect()))
    samples = runs.decode(data)
    assert rows(runs.encode(samples, size)) == rows(runs.encode(samples))
    cut = data.withColumn("part", F.explode(F.sequence("start", F.col("end") - 1))).withColumn("start", F.col("part")).withColumn("end", F.col("part") + 1).drop("part")
    assert rows(runs.merge_seams(cut, size)) == rows(runs.merge_seams(cut)) == rows(data)
    assert rows(grids.edges(data, "both", size)) == rows(grids.edges(data, "both"))
    marks, counts = grids.edges(data), spark.createDataFrame([(0, 40)], "capture_id long, count long")
    assert rows(grids.edge_grid(marks, counts, False, size=size)) == rows(grids.edge_grid(marks, counts, False))
    assert rows(grids.clock_statistics(data, size)) == rows(grids.clock_statistics(data))
    assert rows(runs.assemble_bus(data, ["a", "b"], "ab", size)) == rows(runs.assemble_bus(data, ["a", "b"], "ab"))
    framed = spi.frames(data, "a", size=size)
    assert rows(framed) == rows(spi.frames(data, "a"))
    assert rows(spi.transfers(data, framed, "clk", ("b",), size=size)) == rows(spi.transfers(data, framed, "clk", ("b",)))


def test_time_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(times.frequency_text(F.lit(333333333.3))) == "333.333 MHz" and one(times.frequency_text(F.lit(1e9))) == "1 GHz" and one(times.frequency_text(F.lit(12.5))) == "12.5 Hz"
    assert one(times.nice_step(F.lit(0.0))) == 1.0 and one(times.nice_step(F.lit(1000.0))) == 1000.0 and times.clock_ns("10") == 10
    assert one(times.seconds_text(F.lit(1.0031005e-3))) == "1,003,100.5 ns" and one(times.ruler_text(F.lit(2.5e-6), 5e-7)) == "2,500 ns"
    assert str(one(times.time_at(F.lit(2.5), F.lit(10).cast("long"), F.lit(20).cast("long"))).normalize()) == "15" and one(times.between(F.lit(25).cast("long"), F.lit(20).cast("long"), F.lit(None).cast("long"), F.lit(3))) == 8.0
    signals = spark.createDataFrame([("top/data", 0, 1), ("top/clk_in", 1, 1), ("top/clk_en", 2, 1), ("top/aclk", 3, 1), ("top/myclock", 4, 1), ("top/clk", 5, 8)], "signal string, position int, width int")
    assert [(r.signal, r.score) for r in grids.clock_candidates(signals).collect()] == [("top/clk_in", 3), ("top/aclk", 3), ("top/clk_en", 2), ("top/myclock", 1), ("top/data", 0)]
    assert grids.marker_period(7, 3) == (4, 7)


def test_wide_values_have_one_form(spark):
    keys = [spark.range(1).select(values.value_key(values.parse_value(F.lit(t), r)).alias("k")).first().k for t, r in ((str(2**70 + 5), "UNSIGNED"), (f"{2**70 + 5:X}", "HEX"), (str(2**63 - 1), "SIGNED"), (f"{2**63 - 1:X}", "HEX"), (str(-(2**64)), "SIGNED"))]
    assert keys[0] == keys[1] == f"w:{2**70 + 5:b}" and keys[2] == keys[3] == f"i:{2**63 - 1}" and keys[4] == f"w:-{2**64:b}"


@pytest.mark.parametrize("split", ["128m", "40b"])
def test_cells_over_several_lines(spark, tmp_path, split):
    """Records with line ends in quotes, read in one split and in many; errors name the last line of their record."""
    head = "Sample in Buffer,note[7:0],u\nRadix - UNSIGNED,HEX,HEX\n"
    body = "".join(f'{i},"{i % 7:X}\n",{i // 5:X}\n' if i % 3 == 0 else f'{i},"{i % 7:X}","{i // 5:X}"\n' if i % 3 == 1 else f'{i},"\n{i % 7:X} ",{i // 5:X}\n' for i in range(40))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = write(tmp_path / "m.csv", head + body + "\n,,\n")
        got, _ = csvfile.read_csv_capture(spark, path)
        rows = {(r.signal, r.start): r.num for r in got.collect()}
        assert [rows["note[7:0]", i] for i in range(40)] == [i % 7 for i in range(40)] and {k[1]: v for k, v in rows.items() if k[0] == "u"} == {5 * k: k for k in range(8)}
        with pytest.raises(ValueError, match="line 6 "):
            csvfile.read_csv_capture(spark, write(tmp_path / "n.csv", head + '0,1,1\n1,"2\n\n",2,3\n'))
        with pytest.raises(ValueError, match="line 4 .*doesn't end"):
            csvfile.read_csv_capture(spark, write(tmp_path / "o.csv", head + '0,1,1\n1,"2,2\n2,3,3\n'))
        plain = write(tmp_path / "p.csv", head + "".join(f"{i},{i % 5 // 2:X},{i // 4:X}\n" for i in range(40)))
        rows = sorted((r.signal, r.start, r.end, r.num) for r in csvfile.read_csv_capture(spark, plain)[0].collect())
        assert [r[1:] for r in rows if r[0] == "u"] == [(4 * k, 4 * k + 4, k) for k in range(10)] and len(rows) == 10 + 24
        with pytest.raises(ValueError, match="line 31 "):
            csvfile.read_csv_capture(spark, write(tmp_path / "q.csv", head + "".join(f"{i},1{',' * (i == 28)},2\n" for i in range(40))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_frequency_texts_round_the_exact_value(spark):
    hertz = [1500905.0, 1e15, 0.00001234, 999999.7, 999.9999, 1000.0, 0.0, 1234567.5, 2.5e9, 0.5]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(hertz)], "i int, h double").select("i", times.frequency_text(F.col("h")).alias("t")).orderBy("i").collect()
    want = ["1.5009 MHz", "1e+06 GHz", "1.234e-05 Hz", "1000 kHz", "1000 Hz", "1 kHz", "0 Hz", "1.23457 MHz", "2.5 GHz", "0.5 Hz"]
    assert [r.t for r in got] == want


def test_cells_that_are_values_and_cells_that_are_none(spark):
    cases = [("1X", "UNSIGNED", None), ("X?", "SIGNED", "X?"), ("-5", "HEX", -5), ("+5", "BINARY", None), ("+101", "BINARY", 5), ("-0x1F", "HEX", None), ("0x1F", "HEX", 31), ("0xX1", "HEX", "X1"), ("-12", "SIGNED", -12), ("+12", "UNSIGNED", 12), ("7X", "OCTAL", "7X"), ("8X", "OCTAL", None), ("", "HEX", None), ("-", "HEX", None), ("1_000", "UNSIGNED", 1000)]
    for text, radix, want in cases:
        r = spark.range(1).select(values.parse_value(F.lit(text), radix).alias("v")).first().v
        assert (r.num if r.num is not None else r.txt) == want, (text, radix)


def test_sequences_over_sparse_buckets(spark):
    rng = random.Random(4)
    at = sorted(rng.sample(range(4000), 60))
    kinds = [rng.choice("ab") for _ in at]
    df = spark.createDataFrame([(0, a, a + 1, k) for a, k in zip(at, kinds, strict=True)], "capture_id long, start long, end long, k string")
    stages = [F.col("k") == "a", F.col("k") == "b", F.col("k") == "a"]
    want = spans(intervals.sequence(df, stages))
    assert want and all(spans(intervals.bucketed_sequence(df, stages, size=n)) == want for n in (1, 4, 7, 100, 10_000))


def test_bytes_are_written_in_order_or_not_at_all(spark, tmp_path):
    frames = [[(b, 0) for b in bits("DE")], [(b, 0) for b in bits("ADBE")], [(b, 0) for b in bits("EF")]]
    data = spi_wave(spark, frames, "io0", "io1")
    found = spi.fields(spi.transfers(data, spi.frames(data)), spi.raw_plan(spi.frames(data)))
    path = f"file://{tmp_path}/out"
    read = lambda: b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()))
    parts = spi.export_binary(found.repartition(3), path)
    assert read() == bytes.fromhex("DEADBEEF") and parts.agg(F.sum("bytes")).first()[0] == 4
    with pytest.raises(ValueError, match="unknown"):
        spi.export_binary(found.withColumn("unknown", F.col("value") == 0xEF), path)
    assert read() == bytes.fromhex("DEADBEEF")
    spi.export_binary(found.where("value <> 190"), path)
    assert read() == bytes.fromhex("DEADEF") and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_an_opcode_with_an_unknown_bit_asks_for_nothing(spark):
    wave = [[(b, 0) for b in bits("9FC2")]]
    data = spi_wave(spark, wave, "io0", "io1")
    framed = spi.frames(data)
    moved = spi.transfers(data, framed, lines=("io0", "io1")).withColumn("io0", F.when(F.col("ordinal") == 3, -1).otherwise(F.col("io0")))
    found = spi.fields(moved, spi.planned(moved, spi.command_table(spark)), ("io0", "io1"))
    assert [(r.kind, r.unknown) for r in found.collect()] == [("CMD", True)]


def test_empty_inputs(spark):
    none = capture(spark, a=[0]).limit(0)
    assert runs.dictionary(none).count() == 0 and grids.edges(none).count() == 0 and measure.summary(none).count() == 0
    assert axis.merge_touching(none, ["capture_id"], 10).count() == 0 and joins.as_of(none.select("capture_id", "start"), none, "start", ["num"]).count() == 0
