"""Frames by the million: what goes to the driver, what passes a shuffle, and that edges in arrays are the same edges."""

import random

import pytest
from pyspark.sql import functions as F

from test_golden import capture
from test_spi_decode import READ, wave
from wavespark.operators import spi, spi_decode, track
from wavespark.plans import captures, flash_queries
from wavespark.plans.queries import QUERIES

plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def written(monkeypatch):
    """What the decoder writes, by name."""
    out = {}
    monkeypatch.setattr(spi_decode, "settled", lambda df, name, keep=spi_decode.settled: out.setdefault(name, (df, keep(df, name)))[1])
    return out


def test_frames_are_not_sent_to_the_driver(spark, docs_dir, written):
    table = QUERIES["spi_modes"](spark, docs_dir)
    assert "Broadcast" not in plan_of(table) and "Broadcast" not in plan_of(written["spi-fields"][0])


def test_edges_are_written_once_a_frame_and_their_bus_not_at_all(spark, docs_dir, written, monkeypatch):
    monkeypatch.setattr(captures, "settled", None)
    found = QUERIES["spi_field_extents"](spark, docs_dir)
    assert written["spi-edges"][1].count() == spark.read.parquet(f"{docs_dir}/events.parquet").count()
    assert plan_of(written["spi-edges"][0]).count("Exchange") == 1 and plan_of(written["spi-fields"][0]).count("Exchange") == 2
    assert found.count() > 2000


def test_exported_lines_meet_their_frames_without_the_driver_and_buses_are_dealt_by_frames(spark, docs_dir, monkeypatch):
    assert "Broadcast" not in plan_of(QUERIES["spi_export_lines"](spark, docs_dir))
    monkeypatch.setattr(captures, "pieces", lambda frames: 13)
    data = flash_queries._bus(flash_queries._device(spark, docs_dir))
    assert plan_of(data).count("Exchange") == 1 and data.rdd.getNumPartitions() == 13


def test_steps_over_dealt_captures_shuffle_nothing(spark):
    cursors = spark.createDataFrame([(k, a) for k in (0, 1) for a in range(-1, 14)], "capture_id long, at long").repartition(5, "capture_id")
    fields = spark.createDataFrame([(0, 0, 1, 4), (0, 0, 4, 9), (0, 1, 9, 12), (0, 1, 10, 11), (1, 0, 2, 3)], "capture_id long, frame long, start long, end long").repartition(5, "capture_id")
    stops = {0: [1, 4, 9, 10, 12], 1: [2, 3]}
    for forward in (True, False):
        told = track.step(cursors, fields, forward=forward)
        assert plan_of(told).count("Exchange") == 2
        near = lambda k, a: min([x for x in stops[k] if x > a], default=None) if forward else max([x for x in stops[k] if x < a], default=None)
        assert {(r.capture_id, r.at): r.found for r in told.collect()} == {(k, a): near(k, a) for k in (0, 1) for a in range(-1, 14)}
    assert rows(track.boundaries(fields)) == sorted(map(repr, fields.sparkSession.createDataFrame([(k, x) for k, xs in stops.items() for x in xs], "capture_id long, start long").collect()))


@pytest.mark.parametrize("falling", [False, True])
def test_frames_of_the_select_line_are_those_made_before(spark, falling):
    """Unknown levels, frames at both ends, without edges, edges where a frame begins or ends, captures never selected."""
    rng = random.Random(3 + falling)
    data = None
    for k in range(12):
        bus = {"cs": [rng.choice([0, 0, 0, 1, None] if k else [1]) if i % 3 == 0 else -1 for i in range(60)]}
        for i, x in enumerate(bus["cs"]):
            bus["cs"][i] = bus["cs"][i - 1] if x == -1 else x
        bus |= {n: [rng.choice([0, 1, 0, 1, None]) for _ in range(60)] for n in ("sck", "io0", "io1")}
        one = capture(spark, **{n: [-1 if x is None else x for x in xs] for n, xs in bus.items()}).withColumn("capture_id", F.lit(k).cast("long"))
        one = one.withColumn("txt", F.when(F.col("num") < 0, F.lit("X"))).withColumn("num", F.when(F.col("num") >= 0, F.col("num")))
        data = one if data is None else data.unionByName(one)
    for before in (True, False):
        got = spi_decode.packed(data, None, "sck", ("io0", "io1"), before, falling, None, 4)
        want = spi_decode.packed(data, spi.frames(data), "sck", ("io0", "io1"), before, falling, None, 4)
        assert rows(got) == rows(want) and got.where("block > 0").count() > 0 and got.where("edges = 0").count() > 0


def test_frames_of_several_blocks_are_those_of_one(spark, monkeypatch):
    frames = [[(1, [0x03, 0, 0, 1]), (READ, list(range(40)))], [(1, [0x0B, 0, 0, 2]), ("dummy", 8), (READ, [7] * 30)], [(1, [0x9F]), (READ, [1])], [], [(1, [0xAA]), (1, [5] * 33)], [("io", [15] * 200)]]
    data = wave(spark, frames)
    whole = [rows(df) for df in spi_decode.decode(data)]
    monkeypatch.setattr(spi_decode, "BLOCK", 1)
    for few in (0, 256):
        monkeypatch.setattr(spi_decode, "FEW", few)
        assert [rows(df) for df in spi_decode.decode(data)] == whole
    assert [rows(df) for df in spi_decode.decode(data, size=64)] == whole and len(whole[1]) > 100
