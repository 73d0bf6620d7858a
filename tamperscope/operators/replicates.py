"""Noise between replicate columns read along the rows of a sheet."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_large, bh_small, family_minimum
from tamperscope.functions.rows import (
    cells, mean, pair_label, pair_values, sheet_sizes, with_row_stats,
)
from tamperscope.functions.stats import (
    ALPHA_HIGH, chi2_sf, fisher_z, flag_from_p, let, log_variance_bias, normal_cdf, normal_sf, runs_z, sidak,
    stronger_flag, z_to_p,
)
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import (
    dense_position, lagged, median, ordinal, rank_values, sign_runs, sliding, windows_in,
)
from tamperscope.operators.resample import generator
from tamperscope.operators.shapes import phi
from tamperscope.session import materialize

WIDTH, STRIDE = 15, 5
PAIR = [*KEY, "c1", "c2"]
CUTS = [0.05 + 1e-9, 0.95 - 1e-9]

# Expected log-log slope of variance on mean per assay.
EXPECTED_SLOPE = {
    "qpcr": 0.0, "densitometry": 2.0, "plate_reader": 1.0, "cell_count": 1.0, "elisa": 2.0,
    "genomics": 2.0, "physiological": 0.0,
}


def pair_differences(sheet: Sheet, *keep: str) -> DataFrame:
    """Difference series of every column pair with its dense position."""
    pairs = pair_values(sheet.rows, *keep).withColumn("d", F.col("a") - F.col("b")).drop("a", "b")
    return dense_position(pairs, PAIR, "row_idx")


def size_cause(min_cols: int, min_rows: int, rows: str = "n_rows") -> tuple[Column, Column, Column]:
    cause = F.when(F.coalesce("n_cols", F.lit(0)) < min_cols, "tooFewColumns").when(
        F.coalesce(rows, F.lit(0)) < min_rows, "tooFewRows"
    )
    few_cols = F.coalesce("n_cols", F.lit(0)) < min_cols
    return (
        cause, F.when(few_cols, F.col("n_cols")).otherwise(F.coalesce(rows, F.lit(0))),
        F.when(few_cols, min_cols).otherwise(min_rows),
    )


# --------------------------------------------------------------- F15 autocorrelation

LAGS = list(range(1, 11))
HIGHER_LAGS = [2, 3, 4, 5]


def pair_autocorrelation(sheet: Sheet) -> DataFrame:
    """Lag 1 to 10 autocorrelation of each pair's differences.

    Products at fixed lags need only the previous ten rows, so each block of
    rows is complete by itself; everything else is sums.
    """
    diffs = pair_differences(sheet)
    centre = diffs.groupBy(*PAIR).agg(F.count("d").alias("n"), F.avg("d").alias("m"))
    lag = lagged(diffs.select(*PAIR, "pos", "d"), PAIR, "d", LAGS).join(centre, PAIR)
    e = F.col("d") - F.col("m")
    sums = lag.groupBy(*PAIR).agg(
        F.first("n").alias("n"), F.sum(e * e).alias("den"),
        *[F.sum(e * (F.col(f"d_lag{k}") - F.col("m"))).alias(f"s{k}") for k in LAGS],
    )
    return sums.where(F.col("n") >= 10).select(
        *PAIR, "n",
        *[F.when(F.col("den") > 0, F.coalesce(f"s{k}", F.lit(0.0)) / F.col("den")).otherwise(0.0).alias(f"r{k}")
          for k in LAGS],
        z_to_p(F.when(F.col("den") > 0, F.col("s1") / F.col("den")).otherwise(0.0) * F.sqrt("n")).alias("raw_p"),
    )


def _one_sample_t(mean_: Column, sd: Column, n: Column) -> Column:
    """p of a zero mean: Student t up to 30 degrees of freedom, normal beyond."""
    t = F.when(sd > 0, mean_ / (sd / F.sqrt(n)))
    return F.when((n < 2) | t.isNull(), F.lit(1.0)).when(n - 1 > 30, z_to_p(t)).otherwise(
        special.t_two_sided(t, (n - 1).cast("double"))
    )


def autocorrelation(sheet: Sheet) -> Outcome:
    test = "Autocorrelation"
    pairs = materialize(bh_small(pair_autocorrelation(sheet), KEY), "acf")
    lag_family = pairs.select(
        *KEY, "c1", "c2", "n",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("r")) for k in HIGHER_LAGS])).alias("l"),
    ).select(*KEY, "c1", "c2", "n", "l.*").withColumn("raw_p", z_to_p(F.col("r") * F.sqrt("n")))
    lag_family = bh_small(lag_family, KEY)
    by_lag = lag_family.groupBy(*KEY, "k").agg(F.count_if(F.col("adj_p") < 0.05).alias("n_sig"))
    pooled = pairs.select(
        *KEY, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("r"))
                                  for k in [1, *HIGHER_LAGS]])).alias("l"),
    ).select(*KEY, "l.*").groupBy(*KEY, "k").agg(
        F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"), F.count("r").alias("n_pairs")
    ).withColumn("raw_p", _one_sample_t(F.col("mean_r"), F.col("sd_r"), F.col("n_pairs")))
    pooled = bh_small(pooled, KEY).join(by_lag, [*KEY, "k"], "left")
    sizes = sheet_sizes(sheet.rows)
    big = F.col("n_rows") >= 500
    pooled = pooled.join(sizes, KEY).withColumn(
        "fires",
        (F.col("k") > 1) & (F.col("adj_p") < ALPHA_HIGH) & ~(big & (F.abs("mean_r") < 0.25)) & (F.col("n_sig") >= 2),
    )
    lags = pooled.groupBy(*KEY).agg(
        F.max("fires").alias("higher"), F.max(F.when(F.col("k") == 1, F.col("mean_r"))).alias("mean_r1")
    )
    best = pairs.groupBy(*KEY).agg(F.min("adj_p").alias("p"), F.count("raw_p").alias("n_pairs"))
    every = sizes.join(best, KEY, "left").join(lags, KEY, "left")
    gate = big & (F.abs("mean_r1") < 0.25)
    flag = F.when(gate, "LOW").otherwise(flag_from_p(F.col("p")))
    flag = stronger_flag(F.when(F.col("p") < ALPHA_HIGH, "MODERATE").otherwise("LOW"), flag)
    flag = stronger_flag(F.when(F.col("higher"), "MODERATE").otherwise("LOW"), flag)
    cause, seen, need = size_cause(2, 10)
    result = result_rows(
        every, test, flag, F.col("p"),
        {"pairs": F.col("n_pairs"), "mean_r1": F.col("mean_r1"),
         "higher_lag": F.col("higher").cast("int")},
        na_cause=cause.when(F.col("p").isNull(), "emptyInput"), na_observed=seen, na_minimum=need,
    )
    return Outcome(
        lambda: unit_rows(
            pairs, test, pair_label(), F.col("r1"), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
            cols=F.array("c1", "c2"),
        ),
        result,
    )


# ---------------------------------------------------------- F16 windowed autocorrelation

def _lag1(xs: Column) -> Column:
    """Lag-1 autocorrelation of one window held as an array."""
    def body(s: Column) -> Column:
        x, m = s["x"], s["m"]
        den = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        num = F.aggregate(
            F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0),
            lambda a, i: a + (F.get(x, i) - m) * (F.get(x, i - 1) - m),
        )
        return let(den, lambda d: F.when(d > 0, num / d).otherwise(0.0))

    return let(F.struct(xs.alias("x"), mean(xs).alias("m")), body)


def windowed_lag1(sheet: Sheet) -> DataFrame:
    """Lag-1 r of every 15-row window of every pair."""
    return _lag1_windows(pair_differences(sheet))


def _lag1_windows(diffs: DataFrame) -> DataFrame:
    windows = sliding(diffs.select(*PAIR, "pos", "d", "row_idx"), PAIR, ["d", "row_idx"], WIDTH, STRIDE)
    return windows.select(
        *PAIR, "w", _lag1(F.col("d")).alias("r"),
        F.get("row_idx", F.lit(0)).alias("row_lo"), F.get("row_idx", F.lit(WIDTH - 1)).alias("row_hi"),
    )


def resample_count(n: Column) -> Column:
    return F.when(n <= 500, 999).when(n <= 5000, 499).otherwise(199)


NULL_SAMPLE = 4096


def bounded_sample(df: DataFrame, unit: list[str], column: str, seed: int) -> DataFrame:
    """Up to about NULL_SAMPLE values per unit, all of them where the unit is
    that small, picked by a hash of unit and position. Feeds the null only."""
    sizes = df.groupBy(*unit).agg(F.count(column).alias("n"))
    pick = F.pmod(F.xxhash64(F.lit(seed), *unit, "pos"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = df.join(sizes, unit).where(pick < F.lit(float(NULL_SAMPLE)) / F.col("n"))
    return kept.groupBy(*unit).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda s: s[column]).alias("sample"),
    )


def windowed_autocorrelation(sheet: Sheet) -> Outcome:
    """Under a shuffle of the rows every window of a pair holds the same random
    ordered subset, so one null per pair serves all its windows."""
    test = "Windowed Autocorrelation"
    seed = sheet.settings.seed
    diffs = materialize(pair_differences(sheet), "differences")
    sample = bounded_sample(diffs, PAIR, "d", seed).where(F.col("n") >= 30)
    sample = sample.withColumn("draws", resample_count(F.col("n")))

    @F.pandas_udf("array<double>")
    def null_r(dataset: pd.Series, grp: pd.Series, c1: pd.Series, c2: pd.Series,
               values: pd.Series, draws: pd.Series) -> pd.Series:
        out = []
        for ds, g, i, j, v, b in zip(dataset, grp, c1, c2, values, draws, strict=True):
            v = np.asarray(v, float)
            if len(v) < WIDTH:
                out.append([])
                continue
            rng = generator(seed, test, ds, g, i, j)
            x = v[np.argsort(rng.random((int(b), len(v))), axis=1)[:, :WIDTH]]
            x = x - x.mean(axis=1, keepdims=True)
            den = (x * x).sum(axis=1)
            r = np.where(den > 0, (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.where(den > 0, den, 1), 0.0)
            out.append(np.sort(np.abs(r)))
        return pd.Series(out)

    nulls = sample.select(
        *PAIR, "n", null_r("dataset_id", "grp", "c1", "c2", "sample", "draws").alias("null_r")
    )
    windows = _lag1_windows(diffs).join(nulls, PAIR)
    size = F.abs("r") - 1e-12
    exceed = F.size(F.filter("null_r", lambda v: v >= size))
    windows = windows.withColumn("raw_p", (exceed + 1) / (F.size("null_r") + 1)).drop("null_r")
    windows = materialize(windows, "acf-windows")
    adjusted = bh_large(windows, PAIR)
    sums = family_minimum(windows, PAIR).groupBy(*KEY).agg(
        F.min("min_adj_p").alias("p"), F.sum("n_units").alias("n_windows")
    )
    every = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    cause, seen, need = size_cause(2, 30)
    result = result_rows(
        every, test, flag_from_p(F.col("p")), F.col("p"), {"windows": F.col("n_windows")},
        na_cause=cause.when(F.col("p").isNull(), "emptyInput"), na_observed=seen, na_minimum=need,
        null_method="random window",
    )
    return Outcome(
        lambda: unit_rows(
            adjusted, test, F.concat_ws(" ", pair_label(), F.concat(F.lit("window "), F.col("w"))), F.col("r"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"), row_lo=F.col("row_lo"), row_hi=F.col("row_hi"),
            cols=F.array("c1", "c2"),
        ),
        result,
    )


# -------------------------------------------------------------------- F17 runs

def pair_runs(sheet: Sheet) -> DataFrame:
    """Wald-Wolfowitz runs of the sign of each pair's differences."""
    diffs = pair_values(sheet.rows).withColumn("s", F.signum(F.col("a") - F.col("b")))
    runs = sign_runs(diffs, PAIR, "s", "row_idx")
    runs = runs.where(
        (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= 10)
    )
    n = F.col("n_pos") + F.col("n_neg")
    return runs.withColumn("expected", F.lit(2.0) * F.col("n_pos") * F.col("n_neg") / n + 1).withColumn(
        "z", runs_z(F.col("runs"), F.col("n_pos"), F.col("n_neg"))
    ).where(F.col("z").isNotNull()).withColumn("raw_p", z_to_p(F.col("z")))


def window_runs(windows: DataFrame, signs: str, unit: list[str], keep: list[str]) -> DataFrame:
    """Runs z of each window's signs; windows with fewer than 8 signs drop out."""
    used = windows.withColumn("_s", F.filter(signs, lambda v: v != 0))
    runs = F.aggregate(
        F.sequence(F.lit(0), F.size("_s") - 1), F.lit(0),
        lambda a, i: a + F.when((i == 0) | (F.get("_s", i) != F.get("_s", i - 1)), 1).otherwise(0),
    )
    pos = F.size(F.filter("_s", lambda v: v > 0))
    return (
        used.where(F.size("_s") >= 8).withColumn("_p", pos)
        .withColumn("z", runs_z(runs, F.col("_p"), F.size("_s") - F.col("_p")))
        .where(F.col("z").isNotNull()).select(*unit, "w", *keep, "z")
    )


def runs_windows(sheet: Sheet) -> DataFrame:
    """Window z of each pair, over all rows and inside each condition."""
    unit = ["dataset_id", "grp", "seq", "c1", "c2"]
    pairs = pair_values(sheet.rows, "cond").withColumn(
        "s", F.signum(F.col("a") - F.col("b"))
    )
    both = F.array(F.lit("all"), F.when(F.col("cond").isNotNull(), F.concat(F.lit("cond:"), "cond")))
    series = pairs.withColumn("seq", F.explode(F.array_compact(both))).select(*unit, "row_idx", "s")
    placed = materialize(dense_position(series, unit, "row_idx"), "sign-series")
    lengths = placed.groupBy(*unit).agg(F.count("s").alias("n"))
    windows = sliding(placed, unit, ["s", "row_idx"], WIDTH, STRIDE).join(lengths, unit)
    windows = windows.withColumn("row_lo", F.get("row_idx", F.lit(0))).withColumn(
        "row_hi", F.get("row_idx", F.lit(WIDTH - 1))
    )
    return window_runs(windows, "s", unit, ["row_lo", "row_hi", "n"])


def runs_test(sheet: Sheet) -> Outcome:
    test = "Runs Test"
    pairs = materialize(bh_small(pair_runs(sheet), KEY), "runs")
    sizes = sheet_sizes(sheet.rows)
    sums = pairs.groupBy(*KEY).agg(
        F.min("adj_p").alias("pair_p"), F.sum("runs").alias("runs"), F.sum("expected").alias("expected"),
        F.count("z").alias("n_pairs"), F.avg("z").alias("mean_z"),
    )
    windows = materialize(runs_windows(sheet).withColumn("raw_p", z_to_p(F.col("z"))), "runs-windows")
    best = family_minimum(windows, KEY).withColumnRenamed("min_adj_p", "window_p")
    lowest = windows.groupBy(*KEY).agg(F.min("z").alias("min_z"))
    every = sizes.join(sums, KEY, "left").join(best, KEY, "left").join(lowest, KEY, "left")
    gate = (F.col("n_rows") >= 500) & (F.col("runs") / F.col("expected") > 0.70)
    # Smallest window z over all windows, each read against the normal.
    scan = sidak(normal_sf(-F.col("min_z")), F.col("n_units"))
    every = every.withColumn("gate", F.coalesce(gate, F.lit(False))).withColumn(
        "scan_p", F.when(F.col("gate") | F.col("min_z").isNull(), 1.0).otherwise(scan)
    ).withColumn("window_p", F.when(F.col("gate"), 1.0).otherwise(F.coalesce("window_p", F.lit(1.0))))
    promoted = (F.col("window_p") < ALPHA_HIGH) | (F.col("pair_p") < ALPHA_HIGH)
    flag = F.when(F.col("gate"), "LOW").otherwise(flag_from_p(F.col("pair_p")))
    flag = stronger_flag(F.when(promoted, "MODERATE").otherwise("LOW"), flag)
    window_part = F.when(F.col("window_p") < ALPHA_HIGH, F.col("window_p")).otherwise(1.0)
    cause, seen, need = size_cause(2, 0)
    result = result_rows(
        every, test, flag, F.least("pair_p", "scan_p", window_part),
        {"pairs": F.col("n_pairs"), "runs": F.col("runs"), "expected": F.col("expected"),
         "mean_z": F.col("mean_z"), "scan_p": F.col("scan_p"), "windows": F.col("n_units")},
        na_cause=cause.when(F.col("pair_p").isNull(), "emptyInput"), na_observed=seen, na_minimum=need,
        null_method="normal with Sidak",
    )
    return Outcome(
        lambda: unit_rows(
            pairs, test, pair_label(), F.col("z"), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
            cols=F.array("c1", "c2"),
        ).unionByName(unit_rows(
            bh_large(windows, KEY).where(F.col("adj_p") < 0.05), test,
            F.concat_ws(" ", "seq", pair_label(), F.concat(F.lit("window "), F.col("w"))), F.col("z"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"), row_lo=F.col("row_lo"), row_hi=F.col("row_hi"),
            cols=F.array("c1", "c2"),
        )),
        result,
    )


# ---------------------------------------------------------- F18 noise scaling

def log_points(sheet: Sheet) -> DataFrame:
    """ln mean and ln variance of each row with three or more values."""
    rows = with_row_stats(sheet.rows).where(
        (F.col("n_vals") >= 3) & (F.col("row_mean") > 0) & (F.col("row_var") > 0)
    )
    return rows.select(
        *KEY, "row_idx", F.log("row_mean").alias("lm"), F.log("row_var").alias("lv"), "row_mean"
    )


def _slope(prefix: str = "") -> list[Column]:
    sxx, syy = F.regr_sxx("lv", "lm"), F.regr_syy("lv", "lm")
    return [
        F.count("lm").alias(f"{prefix}n"), F.regr_slope("lv", "lm").alias(f"{prefix}slope"),
        sxx.alias(f"{prefix}sxx"), syy.alias(f"{prefix}syy"),
        F.regr_sxy("lv", "lm").alias(f"{prefix}sxy"),
    ]


def _slope_variance(prefix: str = "") -> Column:
    n, sxx = F.col(f"{prefix}n"), F.col(f"{prefix}sxx")
    rss = F.greatest(F.col(f"{prefix}syy") - F.col(f"{prefix}sxy") * F.col(f"{prefix}sxy") / sxx, F.lit(0.0))
    return F.when((sxx > 0) & (n > 2), rss / ((n - 2) * sxx))


def noise_slope(sheet: Sheet) -> DataFrame:
    """Slope of ln variance on ln mean, its standard error, and the slopes of
    up to ten equal blocks of increasing mean."""
    points = log_points(sheet)
    whole = points.groupBy(*KEY).agg(
        *_slope(), (F.max(F.log10("row_mean")) - F.min(F.log10("row_mean"))).alias("decades")
    ).withColumn("se", F.sqrt(_slope_variance()))
    # Written, its size is known: points aren't dealt by group to meet it.
    whole = materialize(whole, "noise-slope")
    blocks = F.least(F.lit(10), F.floor(F.col("n") / 5))
    placed = ordinal(points, KEY, ["lm", "row_idx"], "_o", "log-points").join(
        whole.select(*KEY, blocks.alias("n_blocks"), F.floor(F.col("n") / blocks).alias("per")), KEY
    ).where(F.col("n_blocks") >= 3)
    block = F.least(F.floor(F.col("_o") / F.col("per")), F.col("n_blocks") - 1)
    by_block = placed.withColumn("block", block).groupBy(*KEY, "block").agg(*_slope("b_")).where("b_n >= 4")
    by_block = by_block.withColumn("bv", _slope_variance("b_")).where(F.col("bv") > 0)
    weighted = by_block.groupBy(*KEY).agg(
        F.count("bv").alias("n_used"),
        (F.sum(F.col("b_slope") / F.col("bv")) / F.sum(1 / F.col("bv"))).alias("centre"),
        F.sum(F.col("b_slope") * F.col("b_slope") / F.col("bv")).alias("_q2"),
        F.sum(F.col("b_slope") / F.col("bv")).alias("_q1"), F.sum(1 / F.col("bv")).alias("_q0"),
        F.stddev_samp("b_slope").alias("sd_slope"),
    ).withColumn("q", F.greatest(F.lit(0.0), F.col("_q2") - F.col("_q1") * F.col("_q1") / F.col("_q0")))
    q_p: Column = F.lit(1.0)
    for used in range(3, 11):
        q_p = F.when(F.col("n_used") == used, chi2_sf(F.col("q"), used - 1)).otherwise(q_p)
    weighted = weighted.select(
        *KEY, F.col("n_used").alias("blocks_used"), "q",
        F.when((F.col("n_used") >= 3) & (q_p < 0.05), F.col("sd_slope") / F.sqrt("n_used")).alias("block_se"),
    )
    return whole.join(weighted, KEY, "left").withColumn(
        "slope_se", F.greatest("se", F.coalesce("block_se", F.lit(0.0)))
    )


def noise_scaling(sheet: Sheet) -> Outcome:
    test = "Noise Scaling With Measurement Size"
    df = sheet_sizes(sheet.rows).join(noise_slope(sheet), KEY, "left")
    expected = EXPECTED_SLOPE.get(sheet.settings.assay)
    se, slope = F.col("slope_se"), F.coalesce("slope", F.lit(0.0))

    def p_against(target: float) -> Column:
        return F.when(se > 0, z_to_p((slope - target) / se)).otherwise(1.0)

    if expected is None:
        p = F.when(slope < 0, p_against(0.0)).when(slope > 2, p_against(2.0)).otherwise(1.0)
    else:
        p = p_against(expected)
    cause, seen, need = size_cause(3, 0)
    narrow = F.lit(expected != 0) & (F.coalesce("decades", F.lit(0.0)) < 1.0)
    df = df.withColumn("p", p)
    result = result_rows(
        df, test, flag_from_p(F.col("p")), F.col("p"),
        {"slope": F.col("slope"), "slope_se": se, "points": F.col("n"), "decades": F.col("decades")},
        na_cause=cause.when(narrow, "rangeOutOfBand"), na_observed=seen, na_minimum=need,
    )
    return Outcome(lambda: unit_rows(df.where(F.col("n").isNotNull()), test, F.lit("sheet"), F.col("slope"), raw_p=F.col("p")), result)


# ------------------------------------------------------- F19 within-row variance

Z_LIMIT = 4.0


def _upper_tail(k: Column, n: Column, p: float) -> Column:
    """Continuity-corrected normal tail of a binomial count."""
    z = (k - 0.5 - n * p) / F.sqrt(n * p * (1 - p))
    return F.when(k == 0, 1.0).otherwise(normal_sf(z))


def within_row_bins(sheet: Sheet) -> DataFrame:
    """Median mean, median sd and its MAD per bin of rows of similar mean."""
    rows = with_row_stats(sheet.rows).where(F.col("n_vals") >= 3).select(
        *KEY, "row_idx", "row_mean", F.sqrt("row_var").alias("sd")
    )
    sizes = rows.groupBy(*KEY).agg(F.count("sd").alias("n_valid"))
    bins = F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.col("n_valid") / 10)))
    placed = ordinal(rows, KEY, ["row_mean", "row_idx"], "_o", "row-means").join(
        materialize(sizes.where(F.col("n_valid") >= 40), "row-counts"), KEY
    )
    bin_ = F.least(F.floor(F.col("_o") / F.floor(F.col("n_valid") / bins)), bins - 1)
    placed = placed.withColumn("bin", bin_).drop("_o")
    centres = placed.groupBy(*KEY, "bin").agg(
        F.count("sd").alias("n_bin"), median("row_mean").alias("mid_mean"), median("sd").alias("mid_sd")
    )
    # Written, its size is known: rows aren't dealt by bin to meet it.
    centres = materialize(centres, "bin-centres")
    spread = placed.join(centres, [*KEY, "bin"]).groupBy(*KEY, "bin").agg(
        median(F.abs(F.col("sd") - F.col("mid_sd"))).alias("mad_sd")
    )
    return centres.join(spread, [*KEY, "bin"])


def within_row_z(sheet: Sheet) -> DataFrame:
    """Each row's sd against the level interpolated between bins."""
    rows = with_row_stats(sheet.rows).where(F.col("n_vals") >= 3).select(
        *KEY, "row_idx", "row_mean", F.sqrt("row_var").alias("sd")
    )
    sd_mid = rows.groupBy(*KEY).agg(median("sd").alias("_m"), F.count("sd").alias("n_valid"))
    floor = rows.join(materialize(sd_mid, "sd-medians"), KEY).groupBy(*KEY).agg(
        (median(F.abs(F.col("sd") - F.col("_m"))) * 0.20).alias("floor"), F.max("n_valid").alias("n_valid")
    )
    # At most 20 bins per group travel with each row.
    curve = within_row_bins(sheet).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("mid_mean", "mid_sd", "mad_sd"))).alias("bins")
    )
    joined = rows.join(materialize(curve, "sd-curve"), KEY).join(materialize(floor, "sd-floor"), KEY)
    below = F.filter("bins", lambda b: b["mid_mean"] <= F.col("row_mean"))
    above = F.filter("bins", lambda b: b["mid_mean"] > F.col("row_mean"))
    joined = joined.withColumn(
        "_lo", F.coalesce(F.try_element_at(below, F.lit(-1)), F.col("bins")[0])
    ).withColumn("_hi", F.coalesce(F.try_element_at(above, F.lit(1)), F.element_at("bins", -1)))
    gap = F.col("_hi.mid_mean") - F.col("_lo.mid_mean")
    t = F.when((gap > 0) & (F.col("row_mean") >= F.col("_lo.mid_mean")),
               (F.col("row_mean") - F.col("_lo.mid_mean")) / gap).otherwise(0.0)
    joined = joined.withColumn("_t", t)
    sd = F.col("_lo.mid_sd") + F.col("_t") * (F.col("_hi.mid_sd") - F.col("_lo.mid_sd"))
    mad = F.greatest(F.col("_lo.mad_sd") + F.col("_t") * (F.col("_hi.mad_sd") - F.col("_lo.mad_sd")), F.col("floor"))
    joined = joined.withColumn("expected_sd", sd).withColumn("_mad", mad)
    z = F.when((F.col("_mad") > 0) & (F.col("expected_sd") > 0),
               (F.col("sd") - F.col("expected_sd")) / (F.col("_mad") * 1.4826)).otherwise(0.0)
    return joined.select(*KEY, "row_idx", "row_mean", "sd", "expected_sd", "n_valid", z.alias("z"))


def within_row_variance(sheet: Sheet) -> Outcome:
    test = "Within-Row Variance"
    z = materialize(within_row_z(sheet), "within-row")
    rate = 0.5 * math.erfc(Z_LIMIT / math.sqrt(2))
    sums = z.groupBy(*KEY).agg(
        F.max("n_valid").alias("n_valid"), F.count_if(F.col("z") < -Z_LIMIT).alias("n_smooth"),
        F.count_if(F.col("z") > Z_LIMIT).alias("n_noisy"),
    ).withColumn("global_p", _upper_tail(F.col("n_smooth"), F.col("n_valid"), rate))
    if sheet.settings.row_semantics == "ordered":
        # A window's p depends only on how many smooth rows it holds; windows
        # holding none have p = 1, so only the rest need to be formed.
        smooth = dense_position(z, KEY, "row_idx").where(F.col("z") < -Z_LIMIT)
        first = F.greatest(F.lit(0), F.ceil((F.col("pos") - WIDTH + 1) / STRIDE))
        counts = smooth.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("pos") / STRIDE)))).groupBy(
            *KEY, "w").agg(F.count("z").alias("k"))
        hits = counts.join(sums.select(*KEY, windows_in(F.col("n_valid"), WIDTH, STRIDE).alias("n_windows")), KEY)
        hits = hits.where(F.col("w") < F.col("n_windows")).withColumn("raw_p", _upper_tail(F.col("k"), F.lit(WIDTH), rate))
        by_count = hits.groupBy(*KEY, "k").agg(F.max("n_windows").alias("m"), F.min("raw_p").alias("p"))
        # BH over all windows: those with k smooth rows or more rank ahead. A
        # window holds at most 15, so the lists below have at most 15 entries.
        ranked = by_count.join(
            hits.groupBy(*KEY, "k").agg(F.count("w").alias("n_k")), [*KEY, "k"]
        )
        up = ranked.select(*KEY, F.struct("k", "n_k").alias("s")).groupBy(*KEY).agg(F.collect_list("s").alias("all_k"))
        ranked = ranked.join(up, KEY).withColumn(
            "rank", F.aggregate(F.filter("all_k", lambda s: s["k"] >= F.col("k")), F.lit(0).cast("bigint"),
                                lambda a, s: a + s["n_k"]),
        )
        window = ranked.groupBy(*KEY).agg(F.min(F.col("p") * F.col("m") / F.col("rank")).alias("window_p"))
        sums = sums.join(window, KEY, "left")
    else:
        sums = sums.withColumn("window_p", F.lit(1.0))
    df = sheet_sizes(sheet.rows).join(sums, KEY, "left").withColumn(
        "window_p", F.least(F.lit(1.0), F.coalesce("window_p", F.lit(1.0)))
    )
    flag = stronger_flag(flag_from_p(F.col("window_p")), flag_from_p(F.col("global_p")))
    quiet = (F.col("n_smooth") < 3) | (F.col("n_smooth") / F.col("n_valid") < 0.01)
    cause, seen, need = size_cause(3, 40)
    cause = F.when(F.lit(sheet.settings.assay == "genomics"), "assayNotApplicable").otherwise(cause)
    result = result_rows(
        df, test, F.when(quiet, "LOW").otherwise(flag), F.least("global_p", "window_p"),
        {"rows": F.col("n_valid"), "smooth": F.col("n_smooth"), "noisy": F.col("n_noisy"),
         "global_p": F.col("global_p"), "window_p": F.col("window_p")},
        na_cause=F.coalesce(cause, F.when(F.col("n_valid").isNull(), "tooFewRows")),
        na_observed=seen, na_minimum=need,
    )
    out = z.where(F.abs("z") > Z_LIMIT)
    return Outcome(
        lambda: unit_rows(
            out, test, F.when(F.col("z") < 0, "too smooth").otherwise("too noisy"), F.col("z"),
            row_lo=F.col("row_idx"), row_hi=F.col("row_idx"),
        ),
        result,
    )


# ----------------------------------------------- F13 inter-replicate correlation

def winsor_bounds(rows: DataFrame) -> DataFrame:
    """5% and 95% bounds per pair member, over the rows both members share."""
    pairs = pair_values(rows)
    return pairs.groupBy(*PAIR).agg(
        F.count("a").alias("n"), rank_values("a", CUTS).alias("_a"), rank_values("b", CUTS).alias("_b")
    ).select(
        *PAIR, "n", F.col("_a")[0].alias("a_lo"), F.col("_a")[1].alias("a_hi"),
        F.col("_b")[0].alias("b_lo"), F.col("_b")[1].alias("b_hi"),
    )


def pair_correlations(sheet: Sheet) -> DataFrame:
    """Winsorised r of each pair with the mean r of the condition's other pairs."""
    grouped = sheet.by_condition().rows
    bounds = winsor_bounds(grouped)
    pairs = pair_values(grouped).join(bounds, PAIR)
    clipped = pairs.withColumn("a", F.least(F.greatest("a", "a_lo"), F.col("a_hi"))).withColumn(
        "b", F.least(F.greatest("b", "b_lo"), F.col("b_hi"))
    )
    r = clipped.groupBy(*PAIR).agg(
        F.count("a").alias("n"), F.coalesce(F.nanvl(F.corr("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("r")
    ).where("n >= 6")
    sums = r.groupBy(*KEY).agg(F.sum("r").alias("_sum"), F.count("r").alias("k"))
    others = F.when(F.col("k") > 1, (F.col("_sum") - F.col("r")) / (F.col("k") - 1))
    joined = r.join(sums, KEY).withColumn("others", others)
    z_obs = F.when(F.abs("r") < 0.9999, fisher_z(F.col("r"))).otherwise(6.0)
    z_null = F.when(F.abs("others") < 0.9999, fisher_z(F.col("others")))
    se = F.sqrt(F.col("k") / (F.col("k") - 1)) / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)))
    return joined.withColumn("z", F.when(F.col("k") > 1, (z_obs - z_null) / se)).withColumn(
        "raw_p", F.coalesce(z_to_p(F.col("z")), F.lit(1.0))
    ).withColumn("excess", F.col("r") - F.col("others")).drop("_sum")


def intraclass(sheet: Sheet) -> DataFrame:
    """ICC per condition from row means and variances of winsorised columns."""
    grouped = sheet.by_condition().rows
    c = cells(grouped).drop("raw")
    bounds = c.groupBy(*KEY, "col").agg(
        rank_values("x", CUTS).alias("_q"), F.count("x").alias("n"),
    ).where("n >= 3").select(*KEY, "col", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
    per_group = bounds.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.struct("lo", "hi")))).alias("bounds")
    )
    clipped = grouped.join(per_group, KEY).withColumn(
        "vals",
        F.transform("vals", lambda v, i: F.when(
            v.isNotNull(), F.least(F.greatest(v, F.try_element_at(F.col("bounds"), i)["lo"]),
                                   F.try_element_at(F.col("bounds"), i)["hi"]))),
    )
    stats = with_row_stats(clipped).where(F.col("n_vals") >= 2)
    sums = stats.groupBy(*KEY).agg(
        F.count("row_mean").alias("n"), F.coalesce(F.var_samp("row_mean"), F.lit(0.0)).alias("vb"),
        F.avg("row_var").alias("vw"), F.max(F.size("vals")).alias("p"),
    ).where("n >= 3")
    between = F.greatest(F.lit(0.0), F.col("vb") - F.col("vw") / F.col("p"))
    return sums.select(*KEY, F.when(between + F.col("vw") > 0, between / (between + F.col("vw"))).alias("icc"))


def _window_r(a: Column, b: Column) -> Column:
    def body(s: Column) -> Column:
        sums = F.aggregate(
            F.arrays_zip(s["a"].alias("a"), s["b"].alias("b")),
            F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb")),
            lambda acc, v: F.struct(
                (acc["ab"] + (v["a"] - s["ma"]) * (v["b"] - s["mb"])).alias("ab"),
                (acc["aa"] + (v["a"] - s["ma"]) * (v["a"] - s["ma"])).alias("aa"),
                (acc["bb"] + (v["b"] - s["mb"]) * (v["b"] - s["mb"])).alias("bb"),
            ),
        )
        return let(sums, lambda t: F.when((t["aa"] > 0) & (t["bb"] > 0),
                                          t["ab"] / F.sqrt(t["aa"] * t["bb"])).otherwise(0.0))

    return let(F.struct(a.alias("a"), b.alias("b"), mean(a).alias("ma"), mean(b).alias("mb")), body)


def correlation_windows(sheet: Sheet, baseline: DataFrame) -> DataFrame:
    """Excess of each window's r over the baseline of its pair."""
    grouped = sheet.by_condition().rows
    pairs = pair_values(grouped).join(baseline, PAIR)
    placed = dense_position(pairs, PAIR, "row_idx")
    windows = sliding(placed.select(*PAIR, "pos", "a", "b", "row_idx"), PAIR, ["a", "b", "row_idx"], WIDTH, STRIDE)
    windows = windows.join(baseline, PAIR)
    return windows.select(
        *PAIR, "w", "n", "others", _window_r(F.col("a"), F.col("b")).alias("r"),
        F.get("row_idx", F.lit(0)).alias("row_lo"), F.get("row_idx", F.lit(WIDTH - 1)).alias("row_hi"),
    ).withColumn("excess", F.col("r") - F.col("others"))


def inter_replicate_correlation(sheet: Sheet) -> Outcome:
    test = "Inter-Replicate Correlation"
    pairs = pair_correlations(sheet).join(intraclass(sheet), KEY, "left").withColumn(
        "steady", F.coalesce(F.col("icc") > 0.99, F.lit(False))
    )
    pairs = materialize(bh_small(pairs, ["dataset_id"]), "correlations")
    min_excess = F.when(F.col("n") >= 500, 0.05).otherwise(0.01)
    pairs = pairs.withColumn(
        "suspicious", ~F.col("steady") & (F.col("adj_p") < ALPHA_HIGH) & (F.col("excess") > min_excess)
    )
    ordered = sheet.settings.row_semantics == "ordered"
    baseline = pairs.where(~F.col("steady") & F.col("others").isNotNull() & (F.col("n") >= WIDTH + 2)).select(
        *PAIR, "n", "others"
    )
    sums = pairs.groupBy("dataset_id").agg(
        F.min(F.when(F.col("suspicious"), F.col("adj_p"))).alias("susp_p"), F.min("adj_p").alias("pair_p"),
        F.count_if("suspicious").alias("n_suspicious"), F.count("r").alias("n_pairs"),
        F.avg("r").alias("mean_r"), F.avg("icc").alias("icc"), F.min("steady").alias("all_steady"),
    )
    if ordered:
        windows = correlation_windows(sheet, baseline)
        # Tail of one window's excess: Fisher z with its pair's baseline, then
        # the number of windows; exact enough once a sheet has many windows.
        bound = F.greatest(F.least(F.col("others"), F.lit(0.9999)), F.lit(-0.9999))
        held = F.greatest(F.least(F.col("r"), F.lit(0.999999)), F.lit(-0.999999))
        z = (fisher_z(held) - fisher_z(bound)) * math.sqrt(WIDTH - 3)
        scan = windows.withColumn("z", z).groupBy("dataset_id").agg(
            F.max("z").alias("max_z"), F.max("excess").alias("max_excess"), F.count("z").alias("n_windows")
        ).withColumn("scan_p", sidak(normal_sf(F.col("max_z")), F.col("n_windows")))
        sums = sums.join(scan, "dataset_id", "left")
    else:
        sums = sums.withColumn("scan_p", F.lit(1.0)).withColumn("n_windows", F.lit(0)).withColumn(
            "max_excess", F.lit(None).cast("double"))
    sums = sums.withColumn("grp", F.lit("all")).withColumn("scan_p", F.coalesce("scan_p", F.lit(1.0)))
    every = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    own = F.when(F.col("n_suspicious") > 0, flag_from_p(F.col("susp_p"))).when(
        F.col("pair_p") < ALPHA_HIGH, "MODERATE"
    ).otherwise("LOW")
    flag = F.when(F.col("all_steady"), "LOW").otherwise(stronger_flag(flag_from_p(F.col("scan_p")), own))
    p = F.least(F.when(F.col("all_steady"), 1.0).otherwise(F.col("pair_p")), F.col("scan_p"))
    result = result_rows(
        every, test, flag, p,
        {"pairs": F.col("n_pairs"), "mean_r": F.col("mean_r"), "icc": F.col("icc"),
         "suspicious": F.col("n_suspicious"), "scan_p": F.col("scan_p"), "windows": F.col("n_windows")},
        na_cause=F.when(F.col("n_pairs").isNull(), "emptyInput"), null_method="Fisher z with Sidak",
    )
    return Outcome(
        lambda: unit_rows(
            pairs, test, pair_label(), F.col("r"), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"), cols=F.array("c1", "c2")
        ),
        result,
    )


# -------------------------------------------------------------- F14 kurtosis

SIMULATIONS = 1999
#: Simulated rows handed out together; a longer sheet is a draw at a time.
DRAW_ROWS = 1_000_000
DRAW_TASKS = 1024
#: Sheets of up to so many rows judge their conditions by their own null, longer
#: ones by that of the condition's rows.
SHARED_ROWS = 500
#: Differences held at a time; a simulated sheet of more than _PILOT times as many is never whole.
PIECE = 1 << 16
_PILOT = 8
_GRID = 1 << 16            # cells of the differences of a sheet made in pieces
_REACH = 16.0              # ... from -_REACH to _REACH; normal differences lie inside
#: Sheets of so many columns or fewer are judged by the Anderson-Darling distance.
AD_COLUMNS = 3
_CLIP = 1e-10


def predicted_sigma(rows: DataFrame) -> DataFrame:
    """Row sigma from the log-log fit of variance on mean where it covers half
    the rows, else the row's own sd. Adds row_mean, n_vals, sigma and
    log_bias, how far the mean of the fitted log variances lies below theirs."""
    stats = with_row_stats(rows)
    usable = (F.col("n_vals") >= 2) & (F.col("row_mean") > 0) & (F.col("row_var") > 0)
    lm, lv = F.when(usable, F.log("row_mean")), F.when(usable, F.log("row_var"))
    fit = stats.groupBy(*KEY).agg(
        F.count(lm).alias("_n"), F.regr_slope(lv, lm).alias("_slope"),
        F.avg(lm).alias("_mx"), F.avg(lv).alias("_my"), F.count(F.lit(1)).alias("_rows"),
        F.avg(F.when(usable, log_variance_bias(F.col("n_vals") - 1))).alias("log_bias"),
        F.count_if((F.col("n_vals") >= 2) & (F.col("row_mean") > 0)).alias("_covered"),
    ).withColumn("_slope", F.coalesce("_slope", F.lit(0.0)))
    # Written, the fits' size is known: rows aren't dealt by group to meet them.
    joined = stats.join(materialize(fit, "sigma-fit"), KEY)
    used = (F.col("_n") >= 5) & (F.col("_covered") >= F.col("_rows") * 0.5)
    level = F.exp((F.col("_my") + F.col("_slope") * (F.log("row_mean") - F.col("_mx"))) / 2)
    from_fit = F.when((F.col("n_vals") >= 2) & (F.col("row_mean") > 0), level)
    own = F.when(F.col("n_vals") >= 2, F.sqrt("row_var"))
    return joined.withColumn("from_fit", used).withColumn(
        "sigma", F.when(used, from_fit).otherwise(own)
    ).drop("_n", "_slope", "_mx", "_my", "_rows", "_covered")


def _kurtosis(x: Column, n: Column) -> Column:
    """Excess kurtosis with the sample sd in the denominator."""
    return (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2)) - 3


def standardised_differences(sheet: Sheet) -> DataFrame:
    """Pair differences in units of the row's sigma, freed of the fit's bias."""
    rows = predicted_sigma(sheet.rows).where(F.col("sigma") > 0)
    free = F.when(F.col("from_fit"), F.exp(-F.col("log_bias") / 2)).otherwise(1.0)
    rows = rows.withColumn("sigma", F.col("sigma") * free).withColumn("width", F.size("vals"))
    return pair_values(rows, "cond", "sigma", "width").withColumn("nd", (F.col("a") - F.col("b")) / F.col("sigma"))


def _trimmed_kurtosis(diffs: DataFrame, keys: list[str], n_rows: DataFrame) -> DataFrame:
    """Pooled kurtosis; from 200 rows on, of the middle 96%.

    The cut values come from the quantile sketch and the moments from the rows
    between them.
    """
    cuts = diffs.groupBy(*keys).agg(
        rank_values("nd", [0.02 + 1e-9, 0.98 - 1e-9]).alias("_q"), F.count("nd").alias("pooled_n")
    ).select(*keys, "pooled_n", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
    # Written, the cuts' size is known: differences aren't dealt by group to meet them.
    joined = diffs.join(materialize(cuts.join(n_rows, KEY), "kurtosis-cuts"), keys)
    inside = (F.col("n_rows") < 200) | ((F.col("nd") >= F.col("lo")) & (F.col("nd") <= F.col("hi")))
    x = F.when(inside, F.col("nd"))
    return joined.groupBy(*keys).agg(
        F.max("pooled_n").alias("pooled_n"),
        _kurtosis(x, F.count(x)).alias("kurtosis"),
    )


def pair_kurtosis(sheet: Sheet) -> DataFrame:
    """Excess kurtosis of each pair's raw differences."""
    pairs = pair_values(sheet.rows).withColumn("d", F.col("a") - F.col("b"))
    k = pairs.groupBy(*PAIR).agg(F.count("d").alias("n"), _kurtosis(F.col("d"), F.count("d")).alias("kurtosis"),
                                 F.var_samp("d").alias("_v"))
    return k.where((F.col("n") >= 20) & (F.col("_v") > 0)).drop("_v").withColumn(
        "z", F.col("kurtosis") / F.sqrt(F.lit(24.0) / F.col("n"))
    ).withColumn("raw_p", z_to_p(F.col("z")))


def excess_kurtosis(sheet: Sheet) -> Outcome:
    """Replicate noise flatter than Gaussian noise of the same row sigmas."""
    test = "Excess Kurtosis"
    seed = sheet.settings.seed
    sizes = sheet_sizes(sheet.rows)
    diffs = materialize(standardised_differences(sheet), "standardised-differences")
    pooled = _trimmed_kurtosis(diffs, KEY, sizes.select(*KEY, "n_rows"))
    by_cond = _trimmed_kurtosis(
        diffs.where(F.col("cond").isNotNull()), [*KEY, "cond"], sizes.select(*KEY, "n_rows")
    ).where("pooled_n >= 20")
    ad = pooled_ad(diffs)
    by_size = predicted_sigma(sheet.rows).where(F.col("sigma") > 0).groupBy(*KEY, "cond").agg(
        F.count("sigma").alias("_n"), F.max("from_fit").alias("from_fit"))
    # An entry per condition; rows without one are a part of their own.
    rows = by_size.groupBy(*KEY).agg(
        F.sum("_n").alias("n_sigma"), F.max("from_fit").alias("from_fit"),
        F.array_sort(F.collect_list(F.struct("cond", F.col("_n").alias("n")))).alias("parts"))
    base = sizes.join(rows, KEY).join(pooled, KEY).join(ad, KEY, "left").where("pooled_n >= 20")
    base = materialize(base, "kurtosis")
    # No two draws of a sheet of over half of DRAW_ROWS share a task's row.
    several = F.greatest(F.lit(1), F.least(F.lit(SIMULATIONS), F.floor(F.lit(DRAW_ROWS) / F.col("n_sigma")))).cast("int")
    units = base.select(*KEY, "n_rows", "n_cols", "from_fit", F.col("parts.cond").alias("conds"), F.col("parts.n").alias("sizes"),
                        several.alias("_several"))
    units = units.withColumn("_unit", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(SIMULATIONS) / F.col("_several")).cast("int") - 1)))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u in pdf.to_dict("records"):
                rng = generator(seed, test, *[u[k] for k in KEY], *([u["_unit"]] if u["_unit"] else []))
                draws = min(u["_several"], SIMULATIONS - u["_unit"] * u["_several"])
                kurts, ads = _simulate_kurtosis(
                    rng, [int(n) for n in u["sizes"]], int(u["n_cols"]), bool(u["from_fit"]), u["n_rows"] >= 200, draws)
                named = [(None, kurts[:, 0], ads)] + [
                    (c, k, []) for c, k in zip(u["conds"], kurts[:, 1:].T, strict=False) if c is not None]
                yield pd.DataFrame([[*[u[k] for k in KEY], *x] for x in named], columns=[*KEY, "cond", "kurt", "ad"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    dealt = units.repartition(max(1, min(units.count(), DRAW_TASKS)), F.xxhash64(*KEY, "_unit"))
    drawn = dealt.mapInPandas(simulate, ", ".join(f"`{k}` {kinds[k]}" for k in KEY) + ", cond string, kurt array<double>, ad array<double>")
    # SIMULATIONS numbers a sheet or condition.
    drawn = materialize(drawn.groupBy(*KEY, "cond").agg(F.struct(*[
        F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("kurt", "ad")]).alias("null")), "simulated")
    nulls = base.select(*KEY, "n_rows", "n_cols", "pooled_n", "kurtosis", "ad", "n_sigma").join(
        drawn.where("cond IS NULL").drop("cond"), KEY)
    middle = F.get("null.kurt", F.floor(F.size("null.kurt") / 2).cast("int"))
    avg = F.aggregate("null.kurt", F.lit(0.0), lambda a, v: a + v) / F.size("null.kurt")
    nulls = nulls.withColumn("middle", middle).withColumn("null_mean", avg).withColumn(
        "kurt_p", _two_sided(F.col("kurtosis"))
    ).withColumn(
        "ad_p", F.when(F.col("ad").isNotNull(), (F.size(F.filter("null.ad", lambda v: v >= F.col("ad"))) + 1) / (F.size("null.ad") + 1))
    ).withColumn("deviation", F.col("kurtosis") - F.col("null_mean"))
    nulls = materialize(nulls, "kurtosis-null")
    own_null = drawn.where("cond IS NOT NULL").select(*KEY, "cond", F.col("null").alias("_own"))
    conds = by_cond.withColumnRenamed("kurtosis", "k_cond").drop("pooled_n").join(
        nulls.select(*KEY, "null"), KEY
    ).join(own_null, [*KEY, "cond"], "left").withColumn("null", F.coalesce("_own", "null")).withColumn(
        "middle", middle).withColumn("null_mean", avg).withColumn("raw_p", _two_sided(F.col("k_cond"))).drop("null", "_own")
    below = bh_small(conds.where(F.col("k_cond") < F.col("null_mean")), KEY)
    promoted = below.groupBy(*KEY).agg(F.min("adj_p").alias("cond_adj_p"), F.min("raw_p").alias("cond_p"))
    threshold = F.greatest(F.lit(0.20), 1.96 * F.sqrt(F.lit(24.0) / F.greatest("pooled_n", F.lit(1))))
    p = F.when(F.col("n_cols") <= AD_COLUMNS, F.col("ad_p")).otherwise(F.col("kurt_p"))
    df = sizes.join(nulls.drop("n_rows", "n_cols", "null"), KEY, "left").join(
        promoted, KEY, "left"
    ).withColumn("p", p)
    gated = (F.col("deviation") >= 0) | (F.abs("deviation") < threshold)
    own = F.when(gated, "LOW").otherwise(flag_from_p(F.col("p")))
    lift = (own == "LOW") & (F.col("cond_adj_p") < ALPHA_HIGH)
    cause, seen, need = size_cause(2, 20)
    result = result_rows(
        df, test, F.when(lift, "MODERATE").otherwise(own),
        F.when(lift, F.least("p", "cond_p")).otherwise(F.col("p")),
        {"kurtosis": F.col("kurtosis"), "null_median": F.col("middle"), "deviation": F.col("deviation"),
         "pooled_n": F.col("pooled_n"), "ad_p": F.col("ad_p"), "kurtosis_p": F.col("kurt_p")},
        na_cause=cause.when(F.col("p").isNull(), "emptyInput"), na_observed=seen, na_minimum=need,
        null_method="Gaussian simulation",
    )
    return Outcome(
        lambda: unit_rows(
            bh_small(pair_kurtosis(sheet), KEY), test, pair_label(), F.col("kurtosis"), raw_p=F.col("raw_p"),
            adj_p=F.col("adj_p"), cols=F.array("c1", "c2"),
        ),
        result,
    )


def _two_sided(observed: Column) -> Column:
    gap = F.abs(observed - F.col("middle")) - 1e-12
    far = F.size(F.filter("null.kurt", lambda v: F.abs(v - F.col("middle")) >= gap))
    return (far + 1) / (F.size("null.kurt") + 1)


def pooled_ad(diffs: DataFrame) -> DataFrame:
    """Anderson-Darling distance of a sheet's pooled differences from
    N(0, sqrt 2), for the narrow sheets where it decides. Ranks come from one
    range sort, and the number of values is known with the sums."""
    x = diffs.where(F.col("width") <= AD_COLUMNS).select(*KEY, (F.col("nd") / math.sqrt(2)).alias("x"))
    ranked = ordinal(x, KEY, ["x"], "pos", "pooled")
    low = F.log(F.greatest(F.lit(_CLIP), normal_cdf(F.col("x"))))
    high = F.log(F.greatest(F.lit(_CLIP), normal_cdf(-F.col("x"))))
    odd = 2 * F.col("pos") + 1
    n = F.col("_n")
    return ranked.groupBy(*KEY).agg(
        F.count("x").alias("_n"), F.sum(odd * (low - high)).alias("_s"), F.sum(high).alias("_h")
    ).select(*KEY, (-n - F.col("_s") / n - 2 * F.col("_h")).alias("ad"))


def _ad(x: np.ndarray) -> float:
    """The same distance of one sorted array from N(0, 1)."""
    n = len(x)
    odd = 2 * np.arange(1, n + 1) - 1
    logs = np.log(np.maximum(phi(x), _CLIP)) + np.log(np.maximum(phi(-x[::-1]), _CLIP))
    return float(-n - (odd * logs).sum() / n)


def _simulate_kurtosis(rng, sizes: list[int], p: int, from_fit: bool, trim: bool, draws: int = SIMULATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Kurtosis (draws, 1 + parts) and Anderson-Darling distance of ``draws``
    whole sheets whose parts have ``sizes`` rows. Parts of sheets of up to
    SHARED_ROWS rows have no kurtosis of their own."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    left, right = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    n = sum(sizes)
    ends = np.cumsum(sizes) if n > SHARED_ROWS else np.zeros(0, np.int64)
    kurts, ads = np.empty((draws, 1 + len(ends))), np.zeros(draws)
    bias = log_variance_bias(p - 1.0, math.log)
    for b in range(draws):
        if trim and n > _PILOT * _piece_rows(left):
            kurts[b], ads[b] = _simulate_in_pieces(rng, sizes, p, from_fit, left, right, bias)
            continue
        x = rng.standard_normal((n, p))
        if not from_fit:
            x = x / x.std(axis=1, ddof=1, keepdims=True)
        rows = x[:, left] - x[:, right]
        d = np.sort(rows.ravel())
        if p <= AD_COLUMNS:
            # The fit is made anew in each simulated sheet, as in the real one.
            scale = math.exp((np.log(x.var(axis=1, ddof=1)).mean() - bias) / 2) if from_fit else 1.0
            ads[b] = _ad(d / (scale * math.sqrt(2)))
        kurts[b, 0] = _sorted_kurtosis(d, trim)
        for i, end in enumerate(ends):
            kurts[b, i + 1] = _sorted_kurtosis(np.sort(rows[end - sizes[i]:end].ravel()), trim)
    return kurts, ads


def _sorted_kurtosis(d: np.ndarray, trim: bool) -> float:
    if trim:
        cut = max(1, int(len(d) * 0.02))
        d = d[cut:len(d) - cut]
    if not len(d):
        return 0.0
    e = d - d.mean()
    s2 = (e * e).sum() / max(len(e) - 1, 1)
    return float((e ** 4).mean() / (s2 * s2) - 3) if s2 > 0 else 0.0


def _piece_rows(pairs: np.ndarray) -> int:
    return max(1, PIECE // len(pairs))


def _simulate_in_pieces(
    rng, sizes: list[int], p: int, from_fit: bool, left: np.ndarray, right: np.ndarray, bias: float
) -> tuple[list[float], float]:
    """The same of one sheet that is never held whole.

    Power sums are added up as rows are drawn. The values at which the tails
    are cut off lie, by the first _PILOT pieces, in two narrow bands; the
    bands' values are kept, and sorted they give the exact cuts. Parts of up to
    as many rows are held whole. Should a cut lie outside its band, the same
    sheet is drawn again with wider ones.
    """
    # Half the time of a draw is its normal values, so the faster generator makes them.
    rng = np.random.Generator(np.random.SFC64(rng.integers(1 << 63)))
    start, n, few = rng.bit_generator.state, sum(sizes), _PILOT * _piece_rows(left)
    wide = 8.0
    while True:
        known = np.sort(np.concatenate([d for d, _ in _differences(rng, few, p, from_fit, left, right)]))
        slack = wide * math.sqrt(0.02 * 0.98 / (few * p / 2))
        ends = [known[int(q * (len(known) - 1))] for q in (max(0.0, 0.02 - slack), 0.02 + slack, 0.98 - slack, min(1.0, 0.98 + slack))]
        if slack >= 0.02:
            ends[0], ends[3] = -np.inf, np.inf
        grid, logs = np.zeros(_GRID, np.int64), 0.0
        parts: list[_Part] = []
        kurts: list[float] = []
        for size in sizes:
            whole, part = [], _Part(ends)
            for d, log_sum in _differences(rng, size, p, from_fit, left, right):
                part.add(d)
                if size <= few:
                    whole.append(d)
                if p <= AD_COLUMNS:
                    logs += log_sum
                    at = ((d + _REACH) * (_GRID / (2 * _REACH))).astype(np.int64)
                    grid += np.bincount(np.clip(at, 0, _GRID - 1), minlength=_GRID)
            parts.append(part)
            kurts.append(_sorted_kurtosis(np.sort(np.concatenate(whole)), True) if whole else part.kurtosis())
        kurts = [_Part.joined(parts).kurtosis(), *kurts]
        if not any(k is None for k in kurts):
            break
        rng.bit_generator.state, wide = start, wide * 4
    scale = math.exp((logs / n - bias) / 2) if from_fit else 1.0
    return kurts, _grid_ad(grid, scale * math.sqrt(2)) if p <= AD_COLUMNS else 0.0


class _Part:
    """Values of a sheet's rows: their number below two bands and above them,
    the bands' values, and the power sums of those between."""

    def __init__(self, ends: list[float]) -> None:
        self.ends, self.below, self.above = ends, 0, 0
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.sums = np.zeros(5)

    def add(self, d: np.ndarray) -> None:
        a, b, c, e = self.ends
        self.below += int((d < a).sum())
        self.above += int((d > e).sum())
        self.low.append(d[(d >= a) & (d <= b)])
        self.high.append(d[(d >= c) & (d <= e)])
        self.sums += _power_sums(d[(d > b) & (d < c)])

    @classmethod
    def joined(cls, parts: list[_Part]) -> _Part:
        out = cls(parts[0].ends)
        for part in parts:
            out.below, out.above, out.sums = out.below + part.below, out.above + part.above, out.sums + part.sums
            out.low += part.low
            out.high += part.high
        return out

    def kurtosis(self) -> float | None:
        """Kurtosis of the middle 96%; none where a cut lies in no band."""
        low, high = np.sort(np.concatenate(self.low)), np.sort(np.concatenate(self.high))
        cut = max(1, int((self.below + self.above + len(low) + len(high) + int(self.sums[0])) * 0.02))
        if not (0 <= cut - self.below <= len(low) and 0 <= cut - self.above <= len(high)):
            return None
        m, s1, s2, s3, s4 = self.sums + _power_sums(low[cut - self.below:]) + _power_sums(high[:len(high) - (cut - self.above)])
        mean_ = s1 / m
        var = (s2 - m * mean_**2) / max(m - 1, 1)
        fourth = s4 - 4 * mean_ * s3 + 6 * mean_**2 * s2 - 3 * m * mean_**4
        return float(fourth / m / (var * var) - 3)


def _differences(rng, n: int, p: int, from_fit: bool, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Pair differences of ``n`` simulated rows in pieces, with the sum of the rows' log variances.

    Differences of p normal values are those of p - 1 normal values turned
    into the space of rows of mean 0, so only these are drawn.
    """
    turn = np.linalg.qr(np.eye(p)[:, 1:] - 1.0 / p)[0]
    apart = turn[left] - turn[right]
    size = _piece_rows(left)
    for first in range(0, n, size):
        z = rng.standard_normal((p - 1, min(size, n - first)))
        if not from_fit or p <= AD_COLUMNS:
            variances = (z * z).sum(axis=0) / (p - 1)
        if not from_fit:
            z = z / np.sqrt(variances)
        yield (apart @ z).ravel(), float(np.log(variances).sum()) if from_fit and p <= AD_COLUMNS else 0.0


def _power_sums(d: np.ndarray) -> np.ndarray:
    sq = d * d
    return np.array([len(d), d.sum(), sq.sum(), d @ sq, sq @ sq])


def _grid_ad(counts: np.ndarray, scale: float) -> float:
    """Anderson-Darling distance of values known by their cells, whose order
    inside a cell of 1/2048 is taken as even."""
    n = counts.sum()
    edges = np.linspace(-_REACH, _REACH, len(counts) + 1) / scale
    # Differences of the nearer tail keep their digits.
    u, upper = phi(edges), phi(-edges)
    gap = np.where(edges < 0, np.append(0, np.cumsum(counts)) / n - u, upper - np.append(np.cumsum(counts[::-1])[::-1], 0) / n)
    du = np.where(edges[:-1] < 0, np.diff(u), -np.diff(upper))
    spread = np.maximum((u[:-1] + u[1:]) * (upper[:-1] + upper[1:]) / 4, 1e-300)
    square = (gap[:-1]**2 + gap[:-1] * gap[1:] + gap[1:]**2) / 3 + counts / (6.0 * n * n)
    return float(n * (du * square / spread)[np.maximum(u[1:], upper[1:]) < 1].sum())
