import numpy as np
import pytest
from pyspark.sql import functions as F

from tamperscope.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=257), 3)
    rows = [("u", i, float(v)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "u string, pos bigint, x double")


@pytest.mark.parametrize("parts", [1, 7])
def test_ordinal_is_dense_per_key(spark, parts):
    rows = [(k, v) for k in "ab" for v in (5, 3, 9, 1, 7)] + [("c", 2)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(parts)
    got = sorted((r.k, r.o, r.v) for r in ordered.ordinal(df, ["k"], ["v"], "o").collect())
    want = sorted((k, i, v) for k in "abc" for i, v in enumerate(sorted(w for q, w in rows if q == k)))
    assert got == want


@pytest.mark.parametrize("block", [4, 1000])
def test_blocked_positions_and_sums(spark, block):
    rows = [("u", i * 3, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "u string, o bigint, x double")
    placed = ordered.dense_position(df, ["u"], "o", block=block)
    assert {r.o: r.pos for r in placed.collect()} == {i * 3: i for i in range(50)}
    run = ordered.prefix_sum(placed, ["u"], "x", "s", block=block)
    assert {r.pos: r.s for r in run.collect()} == {i: float(sum(range(i + 1))) for i in range(50)}


def test_lags_and_windows_cross_block_edges(spark, series, monkeypatch):
    x, df = series
    for name in ("lagged", "sliding"):
        assert hasattr(ordered, name)
    halo = ordered.with_halo
    monkeypatch.setattr(ordered, "with_halo", lambda *a, **k: halo(*a, **{**k, "block": 32}))
    got = {r.pos: r.x_lag3 for r in ordered.lagged(df, ["u"], "x", [1, 3]).collect()}
    assert all(got[i] == (x[i - 3] if i >= 3 else None) for i in range(len(x)))
    windows = {r.w: r.x for r in ordered.sliding(df, ["u"], ["x"], 15, 5).collect()}
    assert sorted(windows) == list(range((len(x) - 15) // 5 + 1))
    assert all(np.allclose(windows[w], x[w * 5:w * 5 + 15]) for w in windows)


@pytest.mark.parametrize("block", [8, 4096])
def test_sign_runs(spark, block):
    rng = np.random.default_rng(1)
    s = rng.integers(-1, 2, 300)
    df = spark.createDataFrame([("u", i, int(v)) for i, v in enumerate(s)], "u string, o bigint, s int")
    row = ordered.sign_runs(df, ["u"], "s", "o", block=block).first()
    kept = s[s != 0]
    assert (row.n_pos, row.n_neg, row.runs) == ((kept > 0).sum(), (kept < 0).sum(), 1 + (np.diff(kept) != 0).sum())


@pytest.mark.parametrize("block", [5, 4096])
def test_islands(spark, block):
    pos = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 19, 20, 21, 24, 25]
    df = spark.createDataFrame([("u", p) for p in pos], "u string, p bigint")
    got = sorted((r.lo, r.hi, r.length) for r in ordered.islands(df, ["u"], "p", block=block).collect())
    assert got == [(0, 11, 12), (15, 15, 1), (19, 21, 3), (24, 25, 2)]


def test_median(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (4, 1, 3, 2)], "k int, x double")
    assert df.groupBy("k").agg(ordered.median("x").alias("m")).first().m == 2.5
    assert df.where(F.col("x") < 4).groupBy("k").agg(ordered.median("x").alias("m")).first().m == 2.0


def test_positions_where_a_task_writes_several_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        df = spark.range(100).selectExpr("id % 2 AS k", "id")
        got = [(r.k, r.id, r.pos) for r in ordered.ordinal(df, ["k"], ["id"], "pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(got) == sorted((i % 2, i, i // 2) for i in range(100))


def test_number_of_a_file_is_not_read_from_the_id_of_its_write(spark):
    name = "part-00002-1b2a77de-c417-4c1d-9f3e-c09d12aa7e55-c013.snappy.parquet"
    got = spark.range(1).select(F.regexp_extract(F.lit(name), ordered.FILE_NUMBER, 1).alias("n")).head().n
    assert got == "013"
