import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamperscope.functions import stats, tails
from tamperscope.functions.adjust import bh_large, bh_small, family_minimum
from tamperscope.functions.values import decimal_text, plain_decimal, significant_digit, to_number, value_key


def bh(ps):
    order = np.argsort(ps)[::-1]
    out, low = np.empty(len(ps)), 1.0
    for k, i in enumerate(order):
        low = min(low, ps[i] * len(ps) / (len(ps) - k))
        out[i] = low
    return out


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("z", [-3.0, -0.5, 0.0, 1.0, 2.5, 6.0, 12.0])
def test_normal_tail_keeps_relative_precision(spark, z):
    got = one(spark, stats.normal_sf(F.lit(z)))
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=3e-7)


@pytest.mark.parametrize("df", [1, 2, 8, 9, 14])
def test_chi2_tail_matches_incomplete_gamma(spark, df):
    for x in (0.3, 5.0, 40.0):
        assert one(spark, stats.chi2_sf(F.lit(x), df)) == pytest.approx(
            float(tails.chi2_sf_np(np.array([x]), np.array([df]))[0]), rel=1e-5, abs=1e-12)


def test_tails_against_direct_sums():
    n, p = 30, 0.2
    pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    for k in (0, 1, 7, 20):
        assert tails.binomial_sf_np([k], [n], [p])[0] == pytest.approx(sum(pmf[k:]), rel=1e-9)
    lam = 3.7
    pois = [math.exp(-lam) * lam**k / math.factorial(k) for k in range(60)]
    for k in (0, 2, 9, 25):
        assert tails.poisson_sf_np([k], [lam])[0] == pytest.approx(sum(pois[k:]), rel=1e-8)
    # Lady tasting tea: 3 of 4 right.
    assert tails.fisher_exact_np([3], [1], [1], [3])[0] == pytest.approx(34 / 70, rel=1e-9)
    assert tails.t_two_sided_np(np.array([2.228]), np.array([10]))[0] == pytest.approx(0.05, abs=2e-4)
    assert tails.f_sf_np(np.array([4.26]), np.array([2]), np.array([9]))[0] == pytest.approx(0.05, abs=1e-3)


def test_numbers_and_digits(spark):
    texts = ["12.5", " 1e3 ", "0x10", "12d", "", "NaN", "-.5", "1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(to_number(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [12.5, 1000.0, None, None, None, None, -0.5, None]
    values = [0.0001234, 12345678.9, 100.0, 0.0, 68423.46, -2.50]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        plain_decimal(F.col("x")).alias("t"), significant_digit(plain_decimal(F.col("x")), 2).alias("d2"),
        value_key(F.col("x")).alias("k"))
    rows = df.collect()
    assert [r.t for r in rows] == ["0.0001234", "12345678.9", "100", "0", "68423.46", "2.5"]
    assert [r.d2 for r in rows] == [2, 2, 0, None, 8, 5]
    assert rows[4].k == 684234600
    raw = spark.createDataFrame([(30.7, "30.70"), (5.0, "x")], "x double, r string").select(
        decimal_text(F.col("x"), F.col("r")).alias("t"))
    assert [r.t for r in raw.collect()] == ["30.7", "5"]


def test_bh_small_large_and_minimum_agree(spark):
    rng = np.random.default_rng(3)
    ps = np.concatenate([rng.random(300), rng.random(40) ** 6, np.full(50, 1.0), np.full(9, 0.002)])
    df = spark.createDataFrame([("f", i, float(p)) for i, p in enumerate(ps)], "f string, i int, raw_p double")
    want = bh(ps)
    for method in (bh_small, bh_large):
        got = {r.i: r.adj_p for r in method(df, ["f"]).collect()}
        assert max(abs(got[i] - want[i]) for i in range(len(ps))) < 1e-12
    assert family_minimum(df, ["f"]).first().min_adj_p == pytest.approx(want.min(), rel=1e-12)


def test_sidak_and_flags(spark):
    assert one(spark, stats.sidak(F.lit(1e-17), F.lit(5))) == pytest.approx(5e-17)
    flags = [one(spark, stats.flag_from_p(F.lit(p))) for p in (0.0005, 0.005, 0.5)]
    assert flags == ["HIGH", "MODERATE", "LOW"]
