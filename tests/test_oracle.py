"""Every query of the wave operators against its DuckDB SQL; those of scalar functions over more rows."""

import duckdb
import pytest

from wavespark.plans.queries import ORACLES, QUERIES

TABLES = ("events",)
#: Queries that compare each row by itself: more rows hold more cases.
SCALAR = {"frequency_texts", "format_radices", "bit_select_pack", "bit_reverse", "parse_cells"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, docs_dir, name):
    docs_dir = docs_dir.replace("sf0.001", "sf0.01") if name in SCALAR else docs_dir
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{docs_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, docs_dir)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))
