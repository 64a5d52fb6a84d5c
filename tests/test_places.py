"""Values shown and read back, and small questions about places."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from test_golden import capture
from wavespark.functions.display import Shown, read_ascii, read_real
from wavespark.operators import places


def test_what_is_shown_is_read_back(spark):
    rng = random.Random(2)
    for width, radix, more in ((12, "HEX", {}), (9, "BINARY", {}), (10, "OCTAL", {}), (11, "UNSIGNED", {}), (8, "SIGNED", {}), (8, "SIGNED_MAGNITUDE", {}), (24, "ASCII", {}), (16, "REAL", {"fraction": 4}), (12, "REAL", {"fraction": 3, "signed_real": False}), (32, "REAL", {}), (7, "HEX", {"reverse": True}), (8, "SIGNED", {"reverse": True})):
        shown = Shown(width, radix, **more)
        nums = [rng.randrange(1 << width) for _ in range(12)] if radix != "REAL" or "fraction" in more else [int.from_bytes(struct.pack(">f", x), "big") for x in (0.5, -2.25, 1e10, 0.0)]
        if radix == "SIGNED_MAGNITUDE":
            nums = [n for n in nums if n != 1 << (width - 1)]
        rows = spark.createDataFrame([(n,) for n in nums], "n long").select("n", shown.text(F.col("n")).alias("t")).collect()
        assert all(shown.read(r.t) == r.n for r in rows), (radix, more, rows)
    assert Shown(8, "SIGNED", source="SIGNED").read("-3") == -3 and Shown(8, "HEX", source="SIGNED").read("FF") == -1 and Shown(8).read("0b101") == 5 and Shown(8, "REAL", fraction=2).read("0x1F") == 31
    assert Shown(8).read("X1") == "XXXX0001" and Shown(8, reverse=True).read("X1") == "1000XXXX" and Shown(4, "BINARY").read("Z") == "ZZZZ" and Shown(4, "BINARY").read("?1") == "00?1"
    assert Shown(8, reverse=True).name("top/d[7:0]") == "top/d[0:7]" and Shown(8).name("top/d[7:0]") == "top/d[7:0]"


def test_texts_that_are_no_values_are_errors():
    assert read_ascii('"A\\\\\\x01"', 24) == 0x415C01
    assert read_ascii("\\q", 16) == 0x5C71
    for text, width in (("é", 8), ("AB", 8), ("\\xG0", 32), ("z", 6)):
        with pytest.raises(ValueError):
            read_ascii(text, width)
    for text, width, fraction in (("0.3", 8, 2), ("40", 8, 2), ("inf", 8, 2), ("1", 16, None), ("1e39", 32, None)):
        with pytest.raises(ValueError):
            read_real(text, width, fraction)
    for shown, text in ((Shown(4), "1F"), (Shown(4, "UNSIGNED"), "1X"), (Shown(4, "SIGNED_MAGNITUDE"), "8"), (Shown(4), "g"), (Shown(8, "OCTAL"), "8X")):
        with pytest.raises(ValueError):
            shown.read(text)


def test_changes_ends_triggers_and_cursors(spark):
    data = capture(spark, **{"a": [0, 0, 1, 1, 0, 0], "Trigger": [0, 0, 0, 1, 1, 0]})
    cursors = spark.createDataFrame([(0, "a", k) for k in range(6)], "capture_id long, signal string, at long")
    for size in (None, 2):
        assert [r.found for r in places.next_change_or_end(cursors, data, size=size).orderBy("at").collect()] == [2, 2, 4, 4, 5, 5]
        assert [r.found for r in places.next_change_or_end(cursors, data, forward=False, size=size).orderBy("at").collect()] == [0, 0, 0, 2, 2, 4]
    assert [tuple(r) for r in places.triggers(data).collect()] == [(0, 3)] and places.triggers(data.where("signal = 'a'")).count() == 0
    meta = spark.createDataFrame([(k, 10 + k) for k in range(4)], "sample long, window long")
    assert [(r.at, r.window) for r in places.at_cursor(cursors.select("at"), meta).orderBy("at").collect()] == [(k, 10 + k if k < 4 else None) for k in range(6)]
    at = lambda *ends: [r.at for r in places.chosen_range(cursors, *ends).orderBy("at").collect()]
    assert at(4) == list(range(6)) and at(4, 1) == [1, 2, 3] and at(2, 2) == []


def test_bookmarks_and_matches(spark):
    marks = spark.createDataFrame([(0, 3, 7), (0, 9, 1), (0, 3, 2), (1, 50, 4), (2, 1, 5)], "capture_id long, sample long, id long")
    counts = spark.createDataFrame([(0, 6), (1, 10), (2, 0)], "capture_id long, count long")
    assert sorted((r.capture_id, r.sample, r.id) for r in places.clamped(marks, counts).collect()) == [(0, 3, 2), (0, 3, 7), (0, 5, 1), (1, 9, 4)]
    cursors = spark.createDataFrame([(0, k) for k in (0, 3, 9)], "capture_id long, at long")
    assert [(r.found, r.id) for r in places.next_bookmark(cursors, marks).orderBy("at").collect()] == [(3, 2), (9, 1), (None, None)]
    assert [(r.found, r.id) for r in places.next_bookmark(cursors, marks, forward=False).orderBy("at").collect()] == [(None, None), (None, None), (3, 2)]
    old, new = (spark.createDataFrame(r, "signal string, width int") for r in ([("a", 1), ("b", 8), ("c", 2)], [("b", 8), ("c", 3), ("d", 1)]))
    assert sorted(tuple(r) for r in places.matched(old, new).collect()) == [("a", True, False, False), ("b", True, True, True), ("c", True, True, False), ("d", False, True, False)]


@pytest.mark.parametrize("size", [None, 40])
def test_places_of_times(spark, size):
    times = spark.createDataFrame([(0, i, t) for i, t in enumerate([10, 20, 60])], "capture_id long, sample long, tick long")
    points = spark.createDataFrame([(0, t) for t in (5, 10, 15, 20, 30, 60, 63)], "capture_id long, tick long")
    got = [r.place for r in places.samples_at_times(points, times, size=size).orderBy("tick").collect()]
    assert got == [-0.5, 0.0, 0.5, 1.0, 1.25, 2.0, 5.0]
