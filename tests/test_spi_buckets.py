"""Which buckets of frames are asked for their modes, and buses that are only changes."""

from pyspark.sql import functions as F

from wavespark.operators import spi, spi_decode
from wavespark.plans import flash_queries
from wavespark.operators.runs import merge_seams


def test_short_captures_ask_no_bucket_and_long_ones_agree(spark, docs_dir, monkeypatch):
    frames = flash_queries._device(spark, docs_dir).where("capture_id % 2 = 0")
    data = flash_queries._bus(frames)
    asked = []
    monkeypatch.setattr(spi_decode, "settled", lambda df, name, keep=spi_decode.settled: asked.append((name, kept := keep(df, name))) or kept)
    how = spi_decode.Decoding(commands=flash_queries.DEVICE)
    rows = lambda bucket: sorted(map(repr, spi_decode.decode(data, spi.frames(data), how, bucket=bucket)[0].collect()))
    whole = rows(1 << 20)
    assert [df.count() for name, df in asked if name == "spi-modes"] == [0]
    for bucket in (2, 7):
        assert rows(bucket) == whole


def test_a_bus_is_made_of_changes_alone(spark, docs_dir):
    data = flash_queries._bus(flash_queries._device(spark, docs_dir))
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(merge_seams(data)) == rows(data)
    short = data.groupBy("capture_id", "signal").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.sum(F.col("end") - F.col("start")).alias("n"))
    assert short.where("a <> 0 OR n <> b").isEmpty() and short.groupBy("capture_id").agg(F.count_distinct("b").alias("k")).where("k > 1").isEmpty()
