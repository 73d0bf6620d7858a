"""Where the noise of a sheet sits: between columns, along rows, in regions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_large, bh_small, family_minimum
from tamperscope.functions.rows import (
    mean, pair_values, present, sheet_sizes, variance, with_row_stats,
)
from tamperscope.functions.stats import (
    ALPHA_HIGH, flag_from_p, kolmogorov_sf, runs_z, sidak, stronger_flag, z_to_p,
)
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import (
    dense_position, median, prefix_sum, sign_runs, sliding, with_halo,
)
from tamperscope.operators.replicates import (
    PAIR, STRIDE, WIDTH, predicted_sigma, size_cause, window_runs,
)
from tamperscope.operators.resample import exceed_p, gather, permutation_exceedances
from tamperscope.session import materialize

# ------------------------------------------------------------ F20 selective noise


def residual_cells(rows: DataFrame, complete: bool) -> DataFrame:
    """Cells minus their row mean: KEY, col, e."""
    stats = with_row_stats(rows).where(F.col("n_vals") > 0)
    if complete:
        stats = stats.where(F.col("n_vals") == F.size("vals"))
    centred = F.transform("vals", lambda v: v - F.col("row_mean"))
    return stats.select(*KEY, F.posexplode(centred).alias("col", "e")).where(F.col("e").isNotNull())


def bartlett(sheet: Sheet) -> DataFrame:
    """Homogeneity of residual variance across columns, per group."""
    per_col = residual_cells(sheet.rows, False).groupBy(*KEY, "col").agg(
        F.count("e").alias("n"), F.coalesce(F.var_samp("e"), F.lit(0.0)).alias("v")
    ).where("n >= 5")
    sums = per_col.groupBy(*KEY).agg(
        F.sum("n").alias("n_cells"), F.count("v").alias("k"), F.max("v").alias("v_max"), F.min("v").alias("v_min"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("_ss"),
        F.sum((F.col("n") - 1) * F.log(F.when(F.col("v") > 0, F.col("v")))).alias("_ln"),
        F.sum(1.0 / (F.col("n") - 1)).alias("_inv"),
    ).join(sheet_sizes(sheet.rows), KEY).where(
        (F.col("k") >= 2) & (F.col("n_cols") >= 3) & (F.col("n_rows") >= 10) & (F.col("_ss") > 0)
    )
    dof = F.col("n_cells") - F.col("k")
    b = dof * F.log(F.col("_ss") / dof) - F.col("_ln")
    c = 1 + (F.col("_inv") - 1 / dof) / (3 * (F.col("k") - 1))
    return sums.select(
        *KEY, "n_cells", "k", "n_rows",
        F.when(F.col("v_min") > 0, F.col("v_max") / F.col("v_min")).alias("ratio"),
        F.when(F.col("v_min") > 0, b / c).alias("bartlett"),
    )


def column_levene(sheet: Sheet) -> DataFrame:
    """Brown-Forsythe test of each column's residuals against all the others."""
    e = residual_cells(sheet.rows, True)
    width = sheet_sizes(sheet.rows).select(*KEY, "n_cols", "n_rows").where(
        (F.col("n_cols") >= 3) & (F.col("n_rows") >= 10)
    )
    # Written, the small tables' sizes are known: cells aren't dealt by group to meet them.
    both = e.join(materialize(width, "widths"), KEY).withColumn("target", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    both = both.withColumn("own", F.col("col") == F.col("target"))
    mids = both.groupBy(*KEY, "target", "own").agg(median("e").alias("mid"), F.var_samp("e").alias("v"))
    z = both.join(materialize(mids, "levene-medians"), [*KEY, "target", "own"]).withColumn("z", F.abs(F.col("e") - F.col("mid")))
    side = z.groupBy(*KEY, "target", "own").agg(
        F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("vp"), F.max("v").alias("v")
    )
    own = F.col("own")
    wide = side.groupBy(*KEY, "target").agg(*[
        F.max(F.when(cond, F.col(c))).alias(f"{c}{i}")
        for i, cond in ((1, own), (2, ~own)) for c in ("n", "m", "vp", "v")
    ]).where("n1 >= 10 and n2 >= 3")
    n = F.col("n1") + F.col("n2")
    grand = (F.col("m1") * F.col("n1") + F.col("m2") * F.col("n2")) / n
    between = F.col("n1") * (F.col("m1") - grand) ** 2 + F.col("n2") * (F.col("m2") - grand) ** 2
    within = F.col("vp1") * F.col("n1") + F.col("vp2") * F.col("n2")
    return wide.select(
        *KEY, F.col("target").alias("col"), n.alias("n"),
        F.when(within > 0, between / (within / (n - 2))).otherwise(0.0).alias("f"),
        F.when(F.col("v1") > F.col("v2"), "noisier").when(F.col("v1") < F.col("v2"), "quieter")
        .otherwise("equal").alias("direction"),
    )


def selective_noise(sheet: Sheet) -> Outcome:
    test = "Selective Noise Partitioning"

    def with_p(df: DataFrame) -> DataFrame:
        return df.withColumn("p", special.chi2_tail("bartlett", (F.col("k") - 1).cast("double"))).withColumn(
            "gated", (F.col("n_cells") >= 500) & (F.col("ratio") < 3.0)
        )

    whole = with_p(bartlett(sheet))
    per_cond = with_p(bartlett(sheet.by_condition())).withColumn(
        "raw_p", F.when(F.col("gated"), 1.0).otherwise(F.col("p"))
    )
    per_cond = bh_small(per_cond.withColumnRenamed("grp", "cond"), ["dataset_id"])
    conds = per_cond.groupBy("dataset_id").agg(F.min("adj_p").alias("cond_p"), F.count("raw_p").alias("n_cond"))
    n_conds = sheet.rows.groupBy(*KEY).agg(F.count_distinct("cond").alias("conditions"))
    df = sheet_sizes(sheet.rows).join(n_conds, KEY).join(whole.drop("n_rows"), KEY, "left").join(conds, "dataset_id", "left")
    by_cond = F.col("conditions") >= 2
    p = F.when(by_cond, F.col("cond_p")).otherwise(F.col("p"))
    flag = F.when(by_cond, flag_from_p(F.col("cond_p"))).when(F.col("gated"), "LOW").otherwise(flag_from_p(F.col("p")))
    if sheet.settings.pivoted:
        flag, p = F.when(p.isNotNull(), "LOW"), F.when(p.isNotNull(), 1.0)
    cause, seen, need = size_cause(3, 10)
    result = result_rows(
        df, test, flag, p,
        {"ratio": F.col("ratio"), "bartlett": F.col("bartlett"), "cells": F.col("n_cells"), "conditions": F.col("n_cond")},
        na_cause=cause.when(p.isNull(), "tooFewRows"), na_observed=seen, na_minimum=need,
    )
    lev = column_levene(sheet).withColumn("raw_p", special.f_tail("f", F.lit(1.0), (F.col("n") - 2).cast("double")))
    lev = bh_small(lev, KEY)
    return Outcome(
        lambda: unit_rows(
            lev, test, F.concat_ws(" ", F.lit("column"), F.col("col") + 1, "direction"), F.col("f"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"), cols=F.array("col"),
        ),
        result,
    )


# ------------------------------------------------------------ F21 regional noise

def standardised_rows(sheet: Sheet) -> DataFrame:
    """Complete rows as residuals over sigma, with their dense position."""
    rows = predicted_sigma(sheet.rows)
    own = F.when(F.col("n_vals") >= 2, F.sqrt("row_var"))
    rows = rows.withColumn("sigma", F.coalesce(F.when(F.col("sigma") > 0, F.col("sigma")), own)).where(
        (F.col("sigma") > 0) & (F.col("n_vals") == F.size("vals")) & (F.col("n_vals") >= 2)
    )
    z = F.transform("vals", lambda v: (v - F.col("row_mean")) / F.col("sigma"))
    return dense_position(rows.select(*KEY, "row_idx", z.alias("z")), KEY, "row_idx")


def column_moments(rows: DataFrame) -> DataFrame:
    """Per group: arrays of column variances and excess kurtoses."""
    cols = rows.select(*KEY, F.posexplode("z").alias("col", "e")).groupBy(*KEY, "col").agg(
        F.count("e").alias("n"), F.greatest(F.var_samp("e"), F.lit(1e-20)).alias("v"), F.kurtosis("e").alias("k")
    )
    return cols.groupBy(*KEY).agg(
        F.max("n").alias("n_valid"),
        F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda s: s["v"]).alias("col_var"),
        F.transform(F.array_sort(F.collect_list(F.struct("col", "k"))), lambda s: s["k"]).alias("col_kurt"),
    )


def regional_windows(sheet: Sheet) -> DataFrame:
    """Per window and column: window variance over the column's own variance."""
    return _regional(standardised_rows(sheet))


def _regional(rows: DataFrame) -> DataFrame:
    moments = materialize(column_moments(rows).where("n_valid >= 20"), "column-moments")
    windows = sliding(rows.select(*KEY, "pos", "z", "row_idx"), KEY, ["z", "row_idx"], WIDTH, STRIDE)
    windows = windows.join(moments, KEY).select(
        *KEY, "w", "n_valid", F.get("row_idx", F.lit(0)).alias("row_lo"),
        F.get("row_idx", F.lit(WIDTH - 1)).alias("row_hi"), "z", F.posexplode("col_var").alias("col", "global_var"),
        "col_kurt",
    )
    column = F.transform("z", lambda r: F.get(r, F.col("col")))
    out = windows.withColumn("win_var", F.greatest(variance(column), F.lit(1e-20))).withColumn(
        "kurt", F.get("col_kurt", F.col("col"))
    ).drop("z", "col_kurt")
    return out.withColumn("ratio", F.greatest(
        F.col("win_var") / F.col("global_var"), F.col("global_var") / F.col("win_var")
    ))


def _regional_null(rec: dict, order: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return _regional_statistic(rec["z"], order)


def _regional_statistic(z: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Largest ratio over all windows and columns, then per column."""
    g = np.maximum(z.var(axis=0, ddof=1), 1e-20)
    starts = np.arange(0, z.shape[0] - WIDTH + 1, STRIDE)
    out = np.empty((order.shape[0], 1 + z.shape[1]))
    for c in range(z.shape[1]):
        x = z[:, c][order]
        s = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
        q = np.cumsum(np.pad(x * x, ((0, 0), (1, 0))), axis=1)
        sm, sq = s[:, starts + WIDTH] - s[:, starts], q[:, starts + WIDTH] - q[:, starts]
        v = np.maximum((sq - sm * sm / WIDTH) / (WIDTH - 1), 1e-20)
        out[:, 1 + c] = np.maximum(v / g[c], g[c] / v).max(axis=1)
    out[:, 0] = out[:, 1:].max(axis=1)
    return out


def regional_noise(sheet: Sheet) -> Outcome:
    test = "Regional Noise Homogeneity"
    rows = materialize(standardised_rows(sheet), "standardised")
    windows = materialize(_regional(rows), "regional")
    best = windows.groupBy(*KEY, "col").agg(
        F.max("ratio").alias("col_ratio"), F.count("ratio").alias("n_windows"), F.max("n_valid").alias("n_valid"),
        F.max("kurt").alias("kurt"),
    )
    best = best.withColumn(
        "tail_p", sidak(special.ratio_tail("col_ratio", F.lit(float(WIDTH)), "kurt"), F.col("n_windows"))
    )
    small = gather(rows, KEY, "pos", ["z"]).where("n >= 20")

    @F.pandas_udf("array<double>")
    def observed(z: pd.Series) -> pd.Series:
        out = []
        for rows_ in z:
            m = np.array([np.asarray(r, float) for r in rows_])
            out.append(_regional_statistic(m, np.arange(len(m))[None, :])[0])
        return pd.Series(out)

    null = permutation_exceedances(
        small.withColumn("obs", observed("z")), KEY, test=test, seed=sheet.settings.seed,
        draws=lambda n: 4999 if n <= 100 else 499, statistic=_regional_null, array_columns=["z"], observed="obs",
    )
    best = best.join(null, KEY, "left").withColumn(
        "raw_p", F.coalesce((F.get("exceed", F.col("col") + 1) + 1) / (F.col("n_draws") + 1), F.col("tail_p"))
    )
    best = materialize(bh_small(best, KEY), "regional-best")
    sums = best.groupBy(*KEY).agg(
        F.max("col_ratio").alias("scan"), F.min("adj_p").alias("col_p"), F.sum("n_windows").alias("n_windows"),
        F.max("n_valid").alias("n_valid"), F.min("tail_p").alias("_tail"), F.count("tail_p").alias("_cols"),
        F.max(exceed_p(0)).alias("perm_p"),
    ).withColumn("scan_p", F.coalesce("perm_p", sidak(F.col("_tail"), F.col("_cols"))))
    df = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    gated = (F.col("n_rows") >= 500) & (F.col("scan") < 2.0)
    flag = F.when(gated, "LOW").otherwise(
        stronger_flag(F.when(F.col("col_p") < ALPHA_HIGH, "MODERATE").otherwise("LOW"), flag_from_p(F.col("scan_p")))
    )
    cause, seen, need = size_cause(3, 20)
    result = result_rows(
        df, test, flag, F.col("scan_p"),
        {"scan": F.col("scan"), "windows": F.col("n_windows"), "rows": F.col("n_valid"), "column_p": F.col("col_p")},
        na_cause=cause.when(F.col("scan").isNull(), "tooFewRows"), na_observed=seen, na_minimum=need,
        null_method=F.when(F.col("perm_p").isNotNull(), "row shuffle").otherwise("scaled chi-squared with Sidak"),
    )
    top = windows.join(best.select(*KEY, "col", "col_ratio", "raw_p", "adj_p"), [*KEY, "col"]).where(
        F.col("ratio") >= F.col("col_ratio") * 0.5
    )
    return Outcome(
        lambda: unit_rows(
            top, test, F.concat_ws(" ", F.lit("window"), "w"), F.col("ratio"), raw_p=F.col("raw_p"),
            adj_p=F.col("adj_p"), row_lo=F.col("row_lo"), row_hi=F.col("row_hi"), cols=F.array("col"),
        ),
        result,
    )


# ------------------------------------------------- F22 LOESS residuals and CUSUM

SPAN_ROWS = 50
_HALF = SPAN_ROWS // 2 - 1          # 24 neighbours a side carry weight
_INTERIOR_FROM = 167                # below this the span is a share of the rows


def _tricube(u: np.ndarray) -> np.ndarray:
    return np.where(u < 1, (1 - u ** 3) ** 3, 0.0)


def _local_line(y: np.ndarray, k: int, targets: np.ndarray) -> np.ndarray:
    """Local linear fit at ``targets`` over the k nearest positions."""
    n = len(y)
    x = np.arange(n, dtype=float)
    out = np.empty(len(targets))
    for i, t in enumerate(targets):
        d = np.abs(x - t)
        near = np.argsort(d, kind="stable")[:k]
        reach = d[near[-1]] or 1.0
        w = _tricube(d[near] / reach)
        xs, ys = x[near], y[near]
        sw, swx, swy = w.sum(), (w * xs).sum(), (w * ys).sum()
        den = sw * (w * xs * xs).sum() - swx * swx
        if sw == 0:
            out[i] = y[int(t)]
        elif abs(den) < 1e-30:
            out[i] = swy / sw
        else:
            b = (sw * (w * xs * ys).sum() - swx * swy) / den
            out[i] = (swy - b * swx) / sw + b * t
    return out


def loess_residuals(series: DataFrame, unit: list[str]) -> DataFrame:
    """Residuals of a tricube local line along ``pos``.

    Rows are evenly spaced and the span is 50 rows, so away from the ends the
    fit is a fixed weighted mean of the 24 rows on each side: a bounded window
    frame. Only the rows at the two ends, and series shorter than 167 rows,
    are fitted directly; those groups hold at most 166 rows.
    """
    # Written, the sizes are known to be small: rows aren't dealt by unit to meet them.
    sizes = materialize(series.groupBy(*unit).agg(F.count("y").alias("n")), "loess-sizes")
    rows = series.join(sizes, unit)
    long_ = rows.where(F.col("n") >= _INTERIOR_FROM)
    weights = _tricube(np.abs(np.arange(-_HALF, _HALF + 1)) / (_HALF + 1.0))
    spread, window, own = with_halo(long_, unit, "pos", before=_HALF, after=_HALF)
    kernel = F.array(*[F.lit(float(w / weights.sum())) for w in weights])
    near = F.collect_list("y").over(window.rowsBetween(-_HALF, _HALF))
    fit = F.aggregate(F.zip_with("_near", kernel, lambda y, w: y * w), F.lit(0.0), lambda a, v: a + v)
    inside = (F.col("pos") >= _HALF + 1) & (F.col("pos") < F.col("n") - _HALF - 1)
    interior = spread.withColumn("_near", near).where(own & inside).withColumn("resid", F.col("y") - fit).select(
        *unit, "n", "pos", "row_idx", "y", "resid"
    )
    side = F.when(F.col("n") < _INTERIOR_FROM, 0).when(F.col("pos") < 2 * SPAN_ROWS, 1).otherwise(2)
    ends = rows.where(
        (F.col("n") < _INTERIOR_FROM) | (F.col("pos") < SPAN_ROWS + _HALF) | (F.col("pos") >= F.col("n") - SPAN_ROWS - _HALF)
    ).withColumn("_side", side)
    kinds = {f.name: f.dataType.simpleString() for f in ends.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*unit, "n", "pos", "row_idx", "y"]) + ", resid double"
    columns = [*unit, "n", "pos", "row_idx", "y", "resid"]

    def fit_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, where = int(pdf["n"].iloc[0]), int(pdf["_side"].iloc[0])
        y = pdf["y"].to_numpy(float)
        k = max(3, math.ceil(min(0.3, SPAN_ROWS / n) * n - 1e-9))
        if where == 0:
            keep = np.arange(len(y))
        elif where == 1:
            keep = np.arange(min(_HALF + 1, len(y)))
        else:
            keep = np.arange(len(y) - _HALF - 1, len(y))
        out = pdf.iloc[keep].copy()
        out["resid"] = y[keep] - _local_line(y, k, keep)
        return out[columns]

    edge = ends.groupBy(*unit, "_side").applyInPandas(fit_ends, schema)
    return interior.select(*columns).unionByName(edge)


def noise_profile(sheet: Sheet) -> DataFrame:
    """Mean absolute pair difference of each row, with its dense position."""
    xs = present("vals")
    rows = sheet.rows.withColumn("_x", F.array_sort(xs)).where(F.size("_x") >= 2)
    # With sorted values the sum of absolute pair differences is a weighted sum.
    n = F.size("_x")
    gaps = F.aggregate(
        F.transform("_x", lambda v, i: v * (2 * i - n + 1).cast("double")), F.lit(0.0), lambda a, v: a + v
    )
    rows = rows.select(*KEY, "row_idx", (gaps / (n * (n - 1) / 2)).alias("y"))
    return dense_position(rows, KEY, "row_idx")


def loess_windows(resid: DataFrame, unit: list[str]) -> DataFrame:
    """Variance of each 20-row window of residuals over that of all residuals
    (series of 60 rows or more)."""
    spread = resid.groupBy(*unit).agg(
        F.count("resid").alias("n"), F.var_samp("resid").alias("global_var"), F.kurtosis("resid").alias("kurt")
    ).where("n >= 60 and global_var >= 1e-30")
    windows = sliding(resid.select(*unit, "pos", "resid", "row_idx"), unit, ["resid", "row_idx"], 20, 6)
    out = windows.join(materialize(spread, "loess-spread"), unit).withColumn("win_var", variance("resid"))
    return out.select(
        *unit, "w", "n", "kurt", "win_var", "global_var",
        F.greatest(F.col("win_var") / F.col("global_var"), F.col("global_var") / F.col("win_var")).alias("ratio"),
        F.get("row_idx", F.lit(0)).alias("row_lo"), F.get("row_idx", F.lit(19)).alias("row_hi"),
    )


def changepoint(series: DataFrame, unit: list[str]) -> DataFrame:
    """Largest cumulative deviation from the mean, and where it happens."""
    centre = series.groupBy(*unit).agg(
        F.avg("y").alias("_m"), F.stddev_samp("y").alias("sd"), F.count("y").alias("n")
    )
    dev = series.join(materialize(centre, "centre"), unit).withColumn("_d", F.col("y") - F.col("_m"))
    run = prefix_sum(dev, unit, "_d", "cusum")
    return run.groupBy(*unit).agg(
        F.max(F.abs("cusum")).alias("max_cusum"),
        F.max_by("row_idx", F.struct(F.round(F.abs("cusum"), 9), -F.col("pos"))).alias("row_at"),
        F.max_by("cusum", F.struct(F.round(F.abs("cusum"), 9), -F.col("pos"))).alias("cusum_at"),
        F.max("sd").alias("sd"), F.max("n").alias("n"),
    )


def _scan_shape(n: int) -> tuple[int, int]:
    width = min(20, n // 3)
    return width, max(1, width // 3)


def _loess_statistic(y: np.ndarray, resid: np.ndarray, order: np.ndarray) -> np.ndarray:
    width, stride = _scan_shape(len(y))
    g = resid.var(ddof=1)
    starts = np.arange(0, len(y) - width + 1, stride)
    x = resid[order]
    s = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    q = np.cumsum(np.pad(x * x, ((0, 0), (1, 0))), axis=1)
    sm, sq = s[:, starts + width] - s[:, starts], q[:, starts + width] - q[:, starts]
    v = np.maximum((sq - sm * sm / width) / (width - 1), 1e-300)
    ratio = np.maximum(v / max(g, 1e-300), max(g, 1e-300) / v).max(axis=1)
    cusum = np.abs(np.cumsum(y[order] - y.mean(), axis=1)).max(axis=1)
    return np.stack([ratio, cusum], axis=1)


def _loess_null(rec: dict, order: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return _loess_statistic(rec["y"], rec["resid"], order)


def loess_scan(series: DataFrame, unit: list[str], test: str, seed: int, draws) -> DataFrame:
    """Scan and changepoint statistics with p-values per unit."""
    resid = materialize(loess_residuals(series, unit), "loess")
    scan = loess_windows(resid, unit).groupBy(*unit).agg(
        F.max("ratio").alias("tail_ratio"), F.count("ratio").alias("n_windows"), F.max("kurt").alias("kurt")
    )
    shift = changepoint(series, unit)
    small = gather(resid, unit, "pos", ["y", "resid"]).where("n >= 30")

    @F.pandas_udf("array<double>")
    def observed(y: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([
            _loess_statistic(np.asarray(a, float), np.asarray(b, float), np.arange(len(a))[None, :])[0]
            for a, b in zip(y, r, strict=True)
        ])

    small = small.withColumn("obs", observed("y", "resid"))
    null = permutation_exceedances(
        small, unit, test=test, seed=seed, draws=draws, statistic=_loess_null,
        array_columns=["y", "resid"], observed="obs",
    )
    exact = small.select(*unit, F.get("obs", F.lit(0)).alias("small_ratio")).join(null, unit, "left")
    spread = resid.groupBy(*unit).agg(F.var_samp("resid").alias("resid_var"))
    out = shift.where("n >= 30").join(spread, unit).join(scan, unit, "left").join(exact, unit, "left")
    ratio = F.coalesce("small_ratio", "tail_ratio")
    tail = sidak(special.ratio_tail("tail_ratio", F.lit(20.0), "kurt"), F.col("n_windows"))
    bridge = kolmogorov_sf(F.col("max_cusum") / (F.col("sd") * F.sqrt("n")))
    return out.withColumn("ratio", ratio).withColumn("scan_p", F.coalesce(exceed_p(0), tail, F.lit(1.0))).withColumn(
        "cusum_p", F.coalesce(exceed_p(1), F.when(F.col("sd") > 0, bridge), F.lit(1.0))
    ).withColumn("shuffled", F.col("n_draws").isNotNull())


def loess_cusum(sheet: Sheet) -> Outcome:
    test = "LOESS Residual Analysis"
    seed = sheet.settings.seed
    series = materialize(noise_profile(sheet), "noise-profile")
    whole = materialize(loess_scan(series, KEY, test, seed, lambda n: 4999 if n <= 100 else 499), "loess-scan")
    sizes = sheet_sizes(sheet.rows)
    pairs = pair_values(sheet.rows).withColumn("y", F.abs(F.col("a") - F.col("b"))).drop("a", "b")
    per_pair = loess_scan(materialize(dense_position(pairs, PAIR, "row_idx"), "pair-noise"), PAIR, test + " pair", seed, lambda n: 499)
    per_pair = bh_small(materialize(per_pair.withColumn("raw_p", F.least("scan_p", "cusum_p")), "pair-scan"), KEY)
    lift = per_pair.groupBy(*KEY).agg(F.min("adj_p").alias("pair_p"))
    second = _second_changepoint(series, whole.select(*KEY, "row_at"))
    df = sizes.join(whole, KEY, "left").join(lift, KEY, "left").join(second, KEY, "left")
    p = sidak(F.least("scan_p", "cusum_p"), F.lit(2))
    df = df.withColumn("p", F.when(F.col("resid_var") < 1e-30, 1.0).otherwise(p))
    gated = (F.col("n_rows") >= 500) & (F.col("ratio") < 2.0)
    own = F.when(gated | (F.col("resid_var") < 1e-30), "LOW").otherwise(flag_from_p(F.col("p")))
    flag = stronger_flag(F.when(F.col("pair_p") < ALPHA_HIGH, "MODERATE").otherwise("LOW"), own)
    cause, seen, need = size_cause(2, 30)
    result = result_rows(
        df, test, flag, F.col("p"),
        {"ratio": F.col("ratio"), "max_cusum": F.col("max_cusum"), "changepoint_row": F.col("row_at"),
         "second_row": F.col("second_row"), "second_p": F.col("second_p"), "scan_p": F.col("scan_p"),
         "cusum_p": F.col("cusum_p"), "pair_p": F.col("pair_p")},
        na_cause=cause.when(F.col("p").isNull(), "tooFewRows"), na_observed=seen, na_minimum=need,
        null_method=F.when(F.col("shuffled"), "row shuffle").otherwise("scaled chi-squared and Brownian bridge"),
    )

    def units() -> DataFrame:
        windows = loess_windows(loess_residuals(series, KEY), KEY).join(
            whole.select(*KEY, F.col("ratio").alias("best"), "scan_p"), KEY)
        return unit_rows(
            windows.where(F.col("ratio") >= F.col("best") * 0.5), test, F.concat_ws(" ", F.lit("window"), "w"),
            F.col("ratio"), raw_p=F.col("scan_p"), row_lo=F.col("row_lo"), row_hi=F.col("row_hi"),
        ).unionByName(unit_rows(
            whole, test, F.lit("changepoint"), F.col("max_cusum"), raw_p=F.col("cusum_p"),
            row_lo=F.col("row_at"), row_hi=F.col("row_at"),
        ))

    return Outcome(units, result)


def _second_changepoint(series: DataFrame, first: DataFrame) -> DataFrame:
    """Strongest changepoint inside the segments before and after the first."""
    cut = series.join(first, KEY).withColumn("seg", F.when(F.col("row_idx") < F.col("row_at"), 0).otherwise(1))
    seg = changepoint(cut, [*KEY, "seg"]).where("n >= 15 and sd > 0").withColumn(
        "p", kolmogorov_sf(F.col("max_cusum") / (F.col("sd") * F.sqrt("n")))
    )
    best = seg.groupBy(*KEY).agg(F.min("p").alias("second_p"), F.min_by("row_at", "p").alias("second_row"))
    return best.where("second_p < 0.01")


# ------------------------------------------------------------ F23 row-mean runs

def row_mean_residuals(sheet: Sheet) -> DataFrame:
    """Sign of each row mean around its condition's straight line."""
    rows = sheet.by_condition().rows.withColumn("y", mean(present("vals"))).where(F.col("y").isNotNull())
    placed = dense_position(rows.select(*KEY, "row_idx", "y"), KEY, "row_idx")
    fit = placed.groupBy(*KEY).agg(
        F.count("y").alias("n"), F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0)).alias("_b"),
        F.avg("y").alias("_my"), F.avg("pos").alias("_mx"),
    ).where("n >= 10")
    resid = F.col("y") - (F.col("_my") + F.col("_b") * (F.col("pos") - F.col("_mx")))
    return placed.join(fit, KEY).withColumn("s", F.signum(resid)).drop("_b", "_my", "_mx")


def row_mean_runs_table(sheet: Sheet) -> DataFrame:
    return _mean_runs(row_mean_residuals(sheet))


def _mean_runs(signs: DataFrame) -> DataFrame:
    runs = sign_runs(signs, KEY, "s", "pos")
    n = F.col("n_pos") + F.col("n_neg")
    return runs.where(n >= 8).withColumn("expected", F.lit(2.0) * F.col("n_pos") * F.col("n_neg") / n + 1).withColumn(
        "z", runs_z(F.col("runs"), F.col("n_pos"), F.col("n_neg"))
    ).where(F.col("z").isNotNull()).withColumn("raw_p", z_to_p(F.col("z")))


def row_mean_runs(sheet: Sheet) -> Outcome:
    test = "Row-Mean Runs"
    signs = materialize(row_mean_residuals(sheet), "row-mean-signs")
    table = materialize(_mean_runs(signs), "row-mean-runs")
    windows = sliding(signs, KEY, ["s", "row_idx"], WIDTH, STRIDE)
    windows = windows.withColumn("row_lo", F.get("row_idx", F.lit(0))).withColumn(
        "row_hi", F.get("row_idx", F.lit(WIDTH - 1)))
    windows = window_runs(windows, "s", KEY, ["row_lo", "row_hi"]).withColumn("raw_p", z_to_p(F.col("z")))
    windows = materialize(windows.join(table.select(*KEY), KEY, "left_semi"), "row-mean-windows")
    best = family_minimum(windows, ["dataset_id"])
    sums = table.groupBy("dataset_id").agg(F.min("raw_p").alias("cond_p"), F.count("z").alias("n_sequences"))
    conds = sheet.rows.groupBy(*KEY).agg(F.count("cond").alias("labelled"))
    df = sheet_sizes(sheet.rows).join(conds, KEY).join(sums, "dataset_id", "left").join(best, "dataset_id", "left")
    window_p = F.coalesce("min_adj_p", F.lit(1.0))
    lift = F.when(window_p < ALPHA_HIGH, "MODERATE").otherwise("LOW")
    cause, seen, need = size_cause(2, 10)
    result = result_rows(
        df, test, stronger_flag(lift, flag_from_p(F.col("cond_p"))), F.least("cond_p", window_p),
        {"sequences": F.col("n_sequences"), "windows": F.col("n_units"), "window_p": window_p},
        na_cause=F.when(F.col("labelled") == 0, "premiseVoid").otherwise(
            cause.when(F.col("cond_p").isNull(), "tooFewRows")),
        na_observed=seen, na_minimum=need,
    )
    all_grp = F.lit("all")
    return Outcome(
        lambda: unit_rows(
            table.withColumn("_c", F.col("grp")).withColumn("grp", all_grp), test, F.concat(F.lit("condition "), "_c"),
            F.col("z"), raw_p=F.col("raw_p"),
        ).unionByName(unit_rows(
            bh_large(windows, ["dataset_id"]).where("adj_p < 0.01").withColumn("_c", F.col("grp")).withColumn("grp", all_grp),
            test, F.concat_ws(" ", F.lit("condition"), "_c", F.lit("window"), "w"), F.col("z"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"), row_lo=F.col("row_lo"), row_hi=F.col("row_hi"),
        )),
        result,
    )

