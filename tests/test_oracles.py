"""Queries against their SQL twins in another engine, on the smallest tables."""

import os

import pytest

from tamperscope.oracle import ORACLES
from tamperscope.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["terminal_digit", "benford_first", "value_spike", "duplicate_rows", "sequential_duplication", "pair_autocorrelation",
         "regional_noise", "loess_cusum", "mahalanobis_rows", "rank_correlation", "missing_blocks", "vst_choice"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = [tuple("null" if v is None or v != v else repr(round(float(v), 4)) if not isinstance(v, str) else v for v in r)
           for r in frame.itertuples(index=False)]
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
