"""SPI frames by the device's mode: registers, frames without commands, both-edge transfers, resets, field ends; against a plain decoder."""

import random

import pytest
from pyspark.sql import functions as F

from test_golden import capture
from wavespark.operators import flash, spi, spi_decode
from wavespark.operators.spi_decode import Decoding

ONE, READ, QUAD = 1, "read", 4


def clocks(item):
    """Nibbles of an item: (lines, bytes), ("dtr", lines, bytes), ("dummy", clocks), ("io", nibbles)."""
    kind, *rest = item
    if kind == "dummy":
        return False, [0] * rest[0]
    if kind == "io":
        return False, rest[0]
    both = kind == "dtr"
    lines, data = (rest if both else item)
    bits = [b >> k & 1 for b in data for k in range(7, -1, -1)]
    if lines == READ:
        return both, [2 * b for b in bits]
    return both, [sum(x << lines - 1 - k for k, x in enumerate(bits[i : i + lines])) for i in range(0, len(bits), lines)]


def wave(spark, frames, half=2, gap=4):
    """Two samples (``half``) of each level of the clock; lines hold a bit for a clock, or for half a one."""
    rows = [(1, 0, 15)] * gap
    for frame in frames:
        rows += [(0, 0, 0)]
        for item in frame:
            both, nibbles = clocks(item)
            for i, n in enumerate(nibbles):
                rows += [(0, i % 2, n)] * half if both else [(0, 0, n)] * half + [(0, 1, n)] * half
        rows += [(0, 0, 0)] * half + [(1, 0, 15)] * gap
    return capture(spark, cs=[r[0] for r in rows], sck=[r[1] for r in rows], **{f"io{k}": [r[2] >> k & 1 for r in rows] for k in range(4)})


#: Registers of a device whose modes are set by writes.
REGISTERS = flash.parse(
    [
        {"code": "06", "name": "WE", "extended": "1-0-0"}, {"code": "66", "extended": "1-0-0"}, {"code": "99", "extended": "1-0-0", "effects": [{"set": "reset", "after": "66"}]},
        {"code": "05", "name": "STATUS", "extended": "1-0-1", "data": "read"}, {"code": "03", "name": "READ", "extended": "1-1-1", "address": 3, "data": "read"},
        {"code": "EB", "name": "QUAD", "extended": "1-4-4", "quad": "4-4-4", "address": 3, "dummy": [10, 0, 10], "data": "read", "dummy_setting": True, "xip": True},
        {"code": "ED", "name": "DTR QUAD", "extended": "1-4-4", "quad": "4-4-4", "address": 3, "dummy": 8, "data": "read", "dummy_setting": True, "dtr": True},
        {"code": "35", "extended": "1-0-0", "effects": [{"set": "protocol", "value": "quad"}]}, {"code": "F5", "extended": "1-0-0", "effects": [{"set": "protocol", "value": "extended"}]},
        {"code": "B7", "extended": "1-0-0", "effects": [{"set": "address_bytes", "value": 4}]},
        {"code": "81", "name": "VCR", "extended": "1-0-1", "data": "write", "effects": [{"set": "dummy", "bits": "7:4", "values": {"0000": "default", "1111": "default"}}, {"set": "xip", "bits": "3", "values": {"0": True, "1": False}}]},
        {"code": "61", "name": "EVCR", "extended": "1-0-1", "data": "write", "effects": [{"set": "protocol", "bits": "7", "values": {"0": "quad", "1": "extended"}}, {"set": "dtr", "bits": "5", "values": {"0": True, "1": False}}]},
    ]
)


def told(spark, frames, how=None, bucket=128, size=None, **more):
    data = wave(spark, frames)
    framed = spi.frames(data, size=size)
    how = how or Decoding()
    table, found = spi_decode.decode(data, framed, how, bucket=bucket, size=size, **more)
    rows = table.withColumn("format", spi_decode.format_text(table)).orderBy("frame").collect()
    labels = {}
    for r in found.withColumn("label", spi_decode.label(found, how)).orderBy("frame", "lane", "start").collect():
        labels.setdefault(r.frame, []).append(r.label)
    return rows, labels, table, found


def test_quad_protocol_has_dummy_clocks_of_its_own(spark):
    rows, labels, table, _ = told(spark, [[(1, [0x35])], [(4, [0x0B, 0, 0, 0x40]), ("dummy", 10), (4, [0x5A])], [(4, [0xF5])], [(1, [0x03, 0, 0x10, 0]), (READ, [0x11])]])
    assert [r.format for r in rows] == ["1-0-0", "4-4-4", "4-0-0", "1-1-1"]
    assert labels[1] == ["CMD 0B FAST READ", "ADDR 000040", "dummy 10", "RD 5A"] and labels[3] == ["CMD 03 READ", "ADDR 001000", "RD 11"]
    assert [r.changed for r in rows] == [True, False, True, False]
    s = spi_decode.summary(table).first()
    assert (s.frames, s.data_bytes, s.changes, s.problems) == (4, 2, 2, 0)
    rows = told(spark, [[(1, [0x35])], [(4, [0x0B, 0, 0, 0x40])]], Decoding(follow=False))[0]
    assert [r.command_lines for r in rows] == [1, 1] and not any(r.changed for r in rows)


@pytest.mark.parametrize("bucket", [1, 7])
def test_registers_set_dummy_clocks_and_frames_without_commands(spark, bucket):
    frames = [
        [(1, [0x06])], [(1, [0x81, 0x87])], [(1, [0xEB]), (4, [0x12, 0x34, 0x56]), (1, [0x00]), (4, [0xA1, 0xA2])], [(4, [0, 1, 0]), (1, [0]), (4, [0xB1])], [(4, [0, 2, 0]), (1, [0x80]), (4, [0xC1])],
        [(1, [0x06])], [(1, [0x61, 0x7F])], [(4, [0x05]), (4, [0x00])], [(4, [0x81, 0x5F])], [(4, [0xEB, 0, 0, 9]), ("dummy", 5), (4, [0xD1])],
    ]
    rows, labels, _, _ = told(spark, frames, Decoding(commands=REGISTERS), bucket)
    assert [r.format for r in rows] == ["1-0-0", "1-0-1", "1-4-4", "0-4-4", "0-4-4", "1-0-0", "1-0-1", "4-0-4", "4-0-4", "4-4-4"]
    assert labels[2][2:] == ["dummy 8 XIP", "RD A1", "RD A2"] and labels[3] == ["ADDR 000100", "dummy 8 XIP", "RD B1"] and labels[4] == ["ADDR 000200", "dummy 8 XIP exit", "RD C1"]
    assert [r.opcode for r in rows[3:5]] == [0xEB, 0xEB] and [r.xip_frame for r in rows] == [i in (3, 4) for i in range(10)]
    assert (rows[1].next_dummy, rows[1].next_xip_enabled, rows[4].next_xip_enabled, rows[6].next_lines) == (8, True, False, 4)
    assert labels[7] == ["CMD 05 STATUS", "RD 00"] and labels[9] == ["CMD EB QUAD", "ADDR 000009", "dummy 5", "RD D1"]


def test_a_reset_needs_its_enabling_and_ends_in_the_first_mode(spark):
    xip = Decoding(commands=REGISTERS, xip=0xEB, dummy=8)
    labels = told(spark, [[(4, [0, 0x30, 0]), (1, [0]), (4, [0x42])], [(1, [0x99])], [(4, [0, 0x40, 0]), (1, [0]), (4, [0x43])]], xip)[1]
    assert labels[0] == ["ADDR 003000", "dummy 8 XIP", "RD 42"]
    with pytest.raises(ValueError):
        Decoding(xip=0x03)
    rows = told(spark, [[(1, [0x35])], [(4, [0x99])], [(4, [0x66])], [], [(4, [0x99])], [(4, [0x66])], [(4, [0x99])], [(1, [0x05, 0])]], Decoding(commands=REGISTERS), 2)[0]
    assert [r.command_lines for r in rows] == [1, 4, 4, 4, 4, 4, 4, 1]  # an empty frame lies between the first 66 and 99


def test_frames_of_ones_are_resets(spark):
    ones = lambda n: [("io", [15] * n)]
    boot = [ones(7), ones(13), ones(16), [(1, [0x66])], [(1, [0x99])], [(1, [0xEB]), (4, [0, 1, 0]), ("dummy", 10), (4, [0x30, 0, 0x41, 0x2F])]]
    rows, labels, table, found = told(spark, boot)
    assert [r.reset for r in rows] == [True] * 3 + [False] * 3 and [r.opcode for r in rows[3:]] == [0x66, 0x99, 0xEB]
    assert [labels[i] for i in range(3)] == [["RESET 7"], ["RESET 13"], ["RESET 16"]] and labels[5][3:] == ["RD 30", "RD 00", "RD 41", "RD 2F"] and rows[5].address == 0x100
    s = spi_decode.summary(table).first()
    assert (s.frames, s.data_bytes, s.resets, s.problems) == (6, 4, 3, 0)
    rows = told(spark, boot, Decoding(resets=False))[0]
    assert rows[2].unknown_command and not rows[2].reset
    listed = Decoding(commands=(*flash.common(), *flash.parse([{"code": "FF", "name": "MINE", "extended": "1-0-0"}])))
    rows = told(spark, boot, listed)[0]
    assert rows[2].opcode == 255 and not rows[2].reset
    rows = told(spark, [[(1, [0x66]), ("io", [15] * 8)], [(1, [0x35])], ones(8), [(1, [0x03, 0, 0, 1]), (READ, [7])]])[0]
    assert not rows[0].reset and not rows[0].partial
    assert rows[2].reset and rows[2].changed and rows[3].address == 1  # back from quad


def test_both_edges_carry_address_and_data_of_the_dtr_reads(spark):
    reads = [(0x0D, 1, 6, 1), (0x3D, 1, 6, 2), (0xBD, 2, 6, 2), (0x6D, 1, 6, 4), (0xED, 4, 8, 4)]
    frames = [f for code, address, dummy, lines in reads for f in ([(1, [code]), ("dtr", address, [0x12, 0x34, 0x56]), ("dummy", dummy), ("dtr", READ if lines == 1 else lines, [0xDE, 0xAD, 0xBE])], [(1, [0x9F]), (READ, [0xC2])])]
    rows, labels, _, _ = told(spark, frames)
    for i, (code, address, _, lines) in enumerate(reads):
        assert [x.split()[1] for x in labels[2 * i] if not x.startswith("dummy")] == [f"{code:02X}", "123456", "DE", "AD", "BE"]
        assert rows[2 * i].format == f"1-{address}-{lines} DTR" and rows[2 * i + 1].format == "1-0-1" and labels[2 * i + 1] == ["CMD 9F READ ID", "RD C2"]


def test_fixed_and_raw_frames_on_both_edges(spark):
    how = lambda dtr: Decoding("fixed", fixed_lines=(1, 4, 4), fixed_address=2, fixed_dummy=3, fixed_dtr=dtr)
    labels = told(spark, [[(1, [0xAB]), ("dtr", 4, [1, 2]), ("dummy", 3), ("dtr", 4, [0x77])]], how("address_data"))[1]
    assert labels[0] == ["CMD AB", "ADDR 0102", "dummy 3", "RD 77"]
    labels = told(spark, [[("dtr", 1, [0xAB]), ("dtr", 4, [1, 2]), ("dummy", 3), ("dtr", 4, [0x77])]], how("all"))[1]
    assert labels[0] == ["CMD AB", "ADDR 0102", "dummy 3", "RD 77"]
    labels = told(spark, [[(1, [0xA5, 0x0F])]], Decoding("raw"))[1]
    assert labels[0] == ["MOSI A5", "MOSI 0F", "MISO 00", "MISO 00"]
    assert told(spark, [[(4, [0xA6, 0x0F])]], Decoding("raw", raw_lines=4, lowest_first=True))[1][0] == ["DATA 65", "DATA F0"]
    assert told(spark, [[(1, [0x80]), ("io", [1, 1, 0])]], Decoding("raw", raw_lines=1))[1][0] == ["MOSI 80", "MOSI 6/3b", "MISO 00", "MISO 0/3b"]


def test_unknown_and_partial_frames(spark):
    rows, labels, _, _ = told(spark, [[(1, [0xAA, 1])], [("io", [1, 0, 1])], [(1, [0x03, 0, 1])], [(1, [0xEB]), (4, [0, 0, 1]), ("dummy", 4)]])
    assert labels == {0: ["CMD AA", "MOSI 01", "MISO 00"], 1: ["CMD 5/3b"], 2: ["CMD 03 READ", "ADDR 1/16b"], 3: ["CMD EB QUAD INPUT/OUTPUT FAST READ", "ADDR 000001", "dummy 4/10"]}
    assert [(r.unknown_command, r.partial, r.opcode) for r in rows] == [(True, False, 0xAA), (False, True, None), (False, True, 3), (False, False, 0xEB)]
    data = wave(spark, [[(1, [0x9F]), (READ, [0xC2])]])
    unknown = data.withColumn("num", F.when((F.col("signal") == "io0") & (F.col("start") > 4), F.lit(None)).otherwise(F.col("num"))).withColumn("txt", F.when(F.col("num").isNull(), F.lit("X")))
    table, found = spi_decode.decode(unknown, spi.frames(unknown))
    r = table.first()
    assert r.unknown and r.opcode is None and r.data_bytes == 0 and [f.kind for f in found.collect()] == ["CMD"]  # an opcode of X asks for nothing


def test_fields_end_half_a_transfer_after_their_last_edge(spark):
    _, _, _, found = told(spark, [[(1, [0x9F]), (READ, [0xC2])]])
    rows = [(r.kind, r.start, r.end) for r in found.orderBy("start").collect()]
    # cs falls at 4; the clock rises at 7, 11, ...: eight transfers of four samples each.
    assert rows == [("CMD", 7, 37), ("RD", 39, 69)]
    gapped = wave(spark, [[(1, [0x06])], [(1, [0x06])]])
    _, found = spi_decode.decode(gapped, spi.frames(gapped))
    assert [(r.start, r.end) for r in found.orderBy("frame").collect()] == [(7, 37), (46, 76)]


def plain(frames, how):
    """A decoder of a list of nibbles, written out frame by frame, with its own reading of what modes do."""
    reader = spi_decode.Reader(how)
    mode, out = reader.first, []
    for frame in frames:
        edges, level = [], 0
        for item in frame:
            both, nibbles = clocks(item)
            for i, n in enumerate(nibbles):
                edges += [(i % 2 == 0, n)] if both else [(True, n), (False, n)]
        head = spi_decode.Head([(own << 8) | 0xF0 | n for own, n in edges], len(edges), {(k, b) for k in (1, 2, 4) for b in (False, True) if edges and all(n & (1 << k) - 1 == (1 << k) - 1 for own, n in edges if own or b)})
        row, mode = reader.read(head, mode)
        out.append((row["opcode"], row["command_lines"], row["dummy"], row["reset"], row["xip_frame"], mode.text()))
    return out


@pytest.mark.parametrize("bucket", [1, 16])
def test_random_modes_are_those_of_one_frame_after_the_other(spark, bucket):
    rng = random.Random(5)
    menu = [[(1, [0x35])], [(4, [0xF5])], [(1, [0x81, 0x87])], [(4, [0x81, 0x5F])], [(1, [0x61, 0x7F])], [(4, [0x61, 0xFF])], [(1, [0x66])], [(1, [0x99])], [(4, [0x66])], [(4, [0x99])], [("io", [15] * 16)], [(1, [0xEB]), (4, [0, 0, 7]), (1, [0]), (4, [1])], [(4, [0, 0, 9]), (1, [0x80]), (4, [2])], [(1, [0x03, 0, 0, 1]), (READ, [5])], [(1, [0xB7])], [(1, [0x61, 0xDF])], [("dtr", 1, [0x61, 0xFF])]]
    frames = [rng.choice(menu) for _ in range(60)]
    how = Decoding(commands=REGISTERS)
    table = told(spark, frames, how, bucket)[0]
    got = [(r.opcode, r.command_lines, r.dummy, r.reset, r.xip_frame) for r in table]
    assert got == [p[:5] for p in plain(frames, how)] and len({p[5] for p in plain(frames, how)}) > 5


def test_buckets_of_edges_change_nothing(spark):
    frames = [[(1, [0x0D]), ("dtr", 1, [1, 2, 3]), ("dummy", 6), ("dtr", READ, [9, 8])], [(1, [0xAA, 0x55])], [(1, [0x03, 0, 0, 1]), (READ, [5, 6, 7])]]
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    want = told(spark, frames)[3].collect()
    for size in (5, 64):
        assert key(told(spark, frames, size=size)[3].collect()) == key(want)
    data = wave(spark, frames)
    whole = spi_decode.decode(data, spi.whole_capture(data), Decoding("raw"))[1]  # no select line: one frame
    assert whole.where("lane = 0").count() == -(-sum(len([1 for i, _ in enumerate(clocks(x)[1]) if not clocks(x)[0] or i % 2 == 0]) for f in frames for x in f) // 8)


def test_command_sets_are_read_and_written_and_name_their_errors(tmp_path):
    for commands in (flash.common(), REGISTERS):
        path = tmp_path / "set.json"
        path.write_text(flash.dump("mine", commands, "here"))
        assert flash.load(path) == ("mine", commands)
    assert len(flash.common()) == 74 and next(c for c in flash.common() if c.code == 0x0B).clocks(4) == 10
    good = {"code": "9F", "extended": "1-0-1"}
    for bad in ([], [{**good, "nme": "x"}], [good, good], [{"code": "9F"}], [{**good, "code": "1FF"}], [{**good, "extended": "1-3-1"}], [{**good, "dummy": [1, 2]}], [{**good, "data": "up"}], [{**good, "dtr": 1}], [{**good, "effects": [{"set": "speed"}]}], [{**good, "effects": [{"set": "xip", "bits": "3", "values": {"00": True}}]}], [{**good, "effects": [{"set": "protocol", "value": "octal"}]}], [{**good, "effects": [{"set": "dtr", "bits": "9"}]}]):
        with pytest.raises(flash.CommandSetError):
            flash.parse(bad)
