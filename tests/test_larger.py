"""What only larger tables show: events of one time, exports beyond what one program takes."""

import datetime as dt

import duckdb
import pytest

from wavespark.operators import measure, track
from wavespark.plans.queries import ORACLES, QUERIES


def differs(spark, folder, name: str, events: list[tuple]) -> bool:
    """Do the query and its SQL differ on these events (id, seconds, user, type, value)?"""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=t), u, e, float(x), "{}") for i, t, u, e, x in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    return sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) != sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["vcd_roundtrip", "vcd_layouts"])
def test_events_of_one_time_are_samples_of_their_own(spark, tmp_path, name):
    types = ["click", "error", "view", "signup", "purchase", "click", "error", "error", "view"]
    assert not differs(spark, tmp_path, name, [(i, t, i % 2, types[i], i) for i, t in enumerate([0, 1, 1, 1, 2, 3, 3, 2, 5])])


def test_exports_to_a_folder_have_no_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(measure, "MOST_CHARACTERS", 5)
    monkeypatch.setattr(track, "MOST_CHARACTERS", 5)
    events = [(i, i, i % 2, ["click", "view", "error"][i % 3], i) for i in range(9)]
    assert not differs(spark, tmp_path / "a", "export_two_channels", events) and not differs(spark, tmp_path / "b", "spi_export_lines", events)
