"""Shape of each column's distribution, per condition where there are any."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.functions.adjust import bh_small
from tamperscope.functions.rows import cells, sheet_sizes
from tamperscope.functions.stats import flag_from_p, normal_cdf
from tamperscope.functions.values import decimal_places, plain_decimal, round_half_up
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import ordinal, prefix_sum
from tamperscope.operators.resample import MAX_UNIT_ROWS, generator

COL = [*KEY, "col"]
MAX_BINS = 20_000


def modal_precision(sheet: Sheet) -> DataFrame:
    """Most common number of decimal places per column (fewest on a tie)."""
    dp = cells(sheet.rows).groupBy(*COL, decimal_places(plain_decimal(F.col("x"))).alias("dp")).agg(
        F.count(F.lit(1)).alias("c")
    )
    return dp.groupBy(*COL).agg(F.max_by("dp", F.struct("c", -F.col("dp"))).alias("prec"))


def column_moments(sheet: Sheet) -> DataFrame:
    return cells(sheet.rows).groupBy(*COL).agg(
        F.count("x").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"),
        F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"),
        F.count_distinct("x").alias("n_distinct"),
    )


def _worst(df: DataFrame, test: str, sheet: Sheet, need: float, stats: dict, method: str) -> DataFrame:
    """Result per group from per-column flags."""
    flagged = F.col("flag").isin("HIGH", "MODERATE")
    sums = df.groupBy(*KEY).agg(
        F.min("adj_p").alias("p"), F.min(F.when(flagged, F.col("adj_p"))).alias("flag_p"),
        F.count("adj_p").alias("n_tested"), F.count_if(flagged).alias("n_flagged"), F.max("n").alias("n_max"),
        F.max_by("skip", "n").alias("skip"),
    )
    every = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    unsuitable = {"ordinal", "count"}
    cause = F.when(F.lit(sheet.settings.data_type in unsuitable), "dataTypeMismatch").when(
        F.coalesce("n_tested", F.lit(0)) == 0, F.coalesce("skip", F.lit("tooFewObservations"))
    )
    flag = F.when(F.col("flag_p").isNotNull(), flag_from_p(F.col("flag_p"))).otherwise("LOW")
    return result_rows(
        every, test, flag, F.col("p"), {"tested": F.col("n_tested"), "flagged": F.col("n_flagged"), **stats},
        na_cause=cause, na_observed=F.col("n_max"), na_minimum=need, null_method=method,
    )


# ------------------------------------------------------------------ F10 entropy

ENTROPY_DRAWS = 999


def column_entropy(sheet: Sheet) -> DataFrame:
    """Shannon entropy in bits of each column at its modal precision."""
    prec = modal_precision(sheet)
    c = cells(sheet.rows).join(prec, COL)
    key = round_half_up(F.col("x") * F.pow(F.lit(10.0), F.col("prec")))
    freq = c.groupBy(*COL, "prec", key.alias("key")).agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("_s"))
    total = freq.groupBy(*COL, "prec").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("_cl"), F.count(F.lit(1)).alias("n_distinct")
    )
    return total.select(
        *COL, "prec", "n", "n_distinct", (F.log2("n") - F.col("_cl") / F.col("n")).alias("entropy")
    )


def _poisson_moments(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and variance of c*log2(c) and its covariance with c, c ~ Poisson."""
    mean_g, var_g, cov = np.zeros_like(lam), np.zeros_like(lam), np.zeros_like(lam)
    for i, m in enumerate(lam):
        if m <= 0:
            continue
        top = int(m + 12 * math.sqrt(m) + 20)
        low = max(0, int(m - 12 * math.sqrt(m) - 20))
        k = np.arange(low, top + 1)
        logp = k * math.log(m) - m - np.array([math.lgamma(v + 1) for v in k])
        p = np.exp(logp)
        g = np.where(k > 1, k * np.log2(np.maximum(k, 1)), 0.0)
        mean_g[i] = (p * g).sum()
        var_g[i] = (p * g * g).sum() - mean_g[i] ** 2
        cov[i] = (p * g * k).sum() - mean_g[i] * m
    return mean_g, var_g, cov


def entropy_null(rng, n: int, mu: float, sd: float, prec: int) -> tuple[np.ndarray | None, float, float]:
    """Entropy of n Gaussian draws rounded to ``prec`` places: draws, or the
    mean and sd of its normal limit where the grid has too many cells."""
    width = 10.0 ** -prec
    cells_ = 14 * sd / width
    if n <= 1000:
        out = np.empty(ENTROPY_DRAWS)
        for b in range(ENTROPY_DRAWS):
            k = np.floor((mu + sd * rng.standard_normal(n)) / width + 0.5)
            c = np.unique(k, return_counts=True)[1] / n
            out[b] = -(c * np.log2(c)).sum()
        return out, float(np.median(out)), float(out.std())
    if cells_ <= MAX_BINS:
        edge = np.arange(math.floor((mu - 7 * sd) / width), math.ceil((mu + 7 * sd) / width) + 1)
        cdf = np.array([0.5 * math.erfc(-((e - 0.5) * width - mu) / sd / math.sqrt(2)) for e in [*edge, edge[-1] + 1]])
        p = np.maximum(np.diff(cdf), 0)
        c = rng.multinomial(n, p / p.sum(), size=ENTROPY_DRAWS)
        h = math.log2(n) - np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0).sum(axis=1) / n
        return h, float(np.median(h)), float(h.std())
    grid = np.linspace(-7, 7, 701)
    lam = n * width / sd * np.exp(-grid * grid / 2) / math.sqrt(2 * math.pi)
    per_cell = sd * (grid[1] - grid[0]) / width
    g, v, c = _poisson_moments(lam)
    mean = math.log2(n) - g.sum() * per_cell / n
    var = (v.sum() * per_cell - (c.sum() * per_cell) ** 2 / n) / (n * n)
    return None, mean, math.sqrt(max(var, 1e-30))


def entropy(sheet: Sheet) -> Outcome:
    test = "Entropy / Zipf Analysis"
    seed = sheet.settings.seed
    h = column_entropy(sheet).join(column_moments(sheet).select(*COL, "mu", "sd"), COL)

    @F.pandas_udf("struct<raw_p:double,expected:double,low:boolean>")
    def null(ds: pd.Series, grp: pd.Series, col: pd.Series, n: pd.Series, mu: pd.Series, sd: pd.Series,
             prec: pd.Series, seen: pd.Series) -> pd.DataFrame:
        rows = []
        for d, g, c, size, m, s, q, h_obs in zip(ds, grp, col, n, mu, sd, prec, seen, strict=True):
            if size < 20 or s is None or not s > 0:
                rows.append((None, None, None))
                continue
            draws, mid, spread = entropy_null(generator(seed, test, d, g, c), int(size), m, s, int(q))
            if draws is None:
                z = (h_obs - mid) / spread
                low, high = 0.5 * math.erfc(-z / math.sqrt(2)), 0.5 * math.erfc(z / math.sqrt(2))
                floor = 1 / (1 + ENTROPY_DRAWS)
                low, high = max(low, floor), max(high, floor)
            else:
                low = (1 + (draws <= h_obs + 1e-12).sum()) / (1 + len(draws))
                high = (1 + (draws >= h_obs - 1e-12).sum()) / (1 + len(draws))
            rows.append((min(1.0, 2 * min(low, high)), mid, bool(low < high)))
        return pd.DataFrame(rows, columns=["raw_p", "expected", "low"])

    out = h.withColumn(
        "_n", null("dataset_id", "grp", "col", "n", "mu", "sd", "prec", "entropy")
    ).select(*h.columns, "_n.*")
    out = bh_small(out, KEY).withColumn("ratio", F.when(F.col("expected") > 0, F.col("entropy") / F.col("expected")))
    out = out.withColumn("flag", F.when(F.col("raw_p").isNull(), "N/A").when(
        F.abs(F.col("ratio") - 1) >= 0.15, flag_from_p(F.col("adj_p"))).otherwise("LOW"))
    out = out.withColumn("skip", F.when(F.col("raw_p").isNull(), "tooFewObservations"))
    return Outcome(
        lambda: unit_rows(
            out, test, F.concat(F.lit("column "), F.col("col") + 1), F.col("ratio"), raw_p=F.col("raw_p"),
            adj_p=F.col("adj_p"), cols=F.array("col"),
        ),
        _worst(out, test, sheet, 20.0, {}, "parametric bootstrap"),
    )


# ------------------------------------------------------- F11 goodness of fit

GOF_DRAWS = 2000
_CLIP = 1e-6
SIM_VALUES = 2000


def column_ad(sheet: Sheet) -> DataFrame:
    """Anderson-Darling distance of each column from its fitted normal.

    Taken over distinct values: a value holding ranks a..b weighs b^2-(a-1)^2
    on ln F and the rest of 2N per copy on ln(1-F). Ranks are running totals of
    the value counts, carried across blocks of the sorted value table.
    """
    moments = column_moments(sheet).where("n >= 30 and n_distinct >= 10 and sd > 0")
    freq = cells(sheet.rows).join(moments.select(*COL), COL, "left_semi").groupBy(*COL, "x").agg(
        F.count(F.lit(1)).alias("c")
    )
    placed = ordinal(freq, COL, ["x"], "pos", "values")
    ranked = prefix_sum(placed.withColumn("_c", F.col("c").cast("double")), COL, "_c", "b")
    low = F.col("b") - F.col("c")
    w = F.col("b") * F.col("b") - low * low
    ranked = ranked.withColumn("_w", w).join(moments, COL).withColumn(
        "_f", F.greatest(F.lit(_CLIP), F.least(F.lit(1 - _CLIP), normal_cdf((F.col("x") - F.col("mu")) / F.col("sd"))))
    )
    term = F.col("_w") * F.log("_f") + (2 * F.col("n") * F.col("c") - F.col("_w")) * F.log1p(-F.col("_f"))
    sums = ranked.groupBy(*COL).agg(F.sum(term).alias("_s"), F.first("n").alias("_n"))
    return moments.join(sums, COL).withColumn("a2", -F.col("n") - F.col("_s") / F.col("n")).drop("_s", "_n")


def _ad_rows(x: np.ndarray) -> np.ndarray:
    """A^2 of each sorted row against its own fitted normal."""
    n = x.shape[1]
    sd = np.maximum(x.std(axis=1, ddof=1, keepdims=True), 1e-9)
    z = (x - x.mean(axis=1, keepdims=True)) / sd
    f = np.clip(phi(z), _CLIP, 1 - _CLIP)
    i = 2 * np.arange(1, n + 1) - 1
    return -n - ((np.log(f) + np.log1p(-f[:, ::-1])) * i).sum(axis=1) / n


def phi(z: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.5 * np.abs(z) / math.sqrt(2))
    e = np.abs(z) / math.sqrt(2)
    poly = 0.17087277
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196,
              1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * np.exp(-e * e + poly)
    return np.where(z >= 0, 1 - tail, tail)


def gof_null(rng, n: int, mu: float, sd: float, prec: int) -> np.ndarray:
    """A^2 of refitted Gaussian samples rounded as the column is.

    A coarse grid is drawn as counts at the full n. On a fine grid the refitted
    statistic no longer depends on n beyond a few thousand values.
    """
    width = 10.0 ** -prec
    if n > SIM_VALUES and 14 * sd / width <= 4096:
        edge = np.arange(math.floor((mu - 7 * sd) / width), math.ceil((mu + 7 * sd) / width) + 1)
        value = edge * width
        cdf = np.array([0.5 * math.erfc(-((e - 0.5) * width - mu) / sd / math.sqrt(2)) for e in [*edge, edge[-1] + 1]])
        p = np.maximum(np.diff(cdf), 0)
        c = rng.multinomial(n, p / p.sum(), size=GOF_DRAWS).astype(float)
        m = (c * value).sum(axis=1, keepdims=True) / n
        s = np.sqrt((c * (value - m) ** 2).sum(axis=1, keepdims=True) / (n - 1))
        b = np.cumsum(c, axis=1)
        w = b * b - (b - c) ** 2
        f = np.clip(phi((value - m) / np.maximum(s, 1e-9)), _CLIP, 1 - _CLIP)
        return -n - (w * np.log(f) + (2.0 * n * c - w) * np.log1p(-f)).sum(axis=1) / n
    size = min(n, SIM_VALUES)
    out = np.empty(GOF_DRAWS)
    for first in range(0, GOF_DRAWS, 250):
        x = mu + sd * rng.standard_normal((250, size))
        out[first:first + 250] = _ad_rows(np.sort(np.floor(x / width + 0.5) * width, axis=1))
    return out


def column_gof(sheet: Sheet) -> Outcome:
    test = "Column Goodness-of-Fit"
    seed = sheet.settings.seed
    every = column_moments(sheet).join(modal_precision(sheet), COL)
    flat = (F.col("kurt") < -1.2) | ((F.col("kurt") < -0.8) & (F.col("n") >= 100))
    skip = F.when(F.col("n") < 30, "tooFewObservations").when(F.col("n_distinct") < 10, "tooFewDistinct").when(
        (F.abs("skew") > 1.5) | flat, "shapeNotCovered"
    )
    every = every.withColumn("skip", skip).join(column_ad(sheet).select(*COL, "a2"), COL, "left")

    @F.pandas_udf("struct<raw_p:double,middle:double,high:boolean>")
    def null(ds: pd.Series, grp: pd.Series, col: pd.Series, n: pd.Series, mu: pd.Series, sd: pd.Series,
             prec: pd.Series, a2: pd.Series, skipped: pd.Series) -> pd.DataFrame:
        rows = []
        for d, g, c, size, m, s, q, seen, why in zip(ds, grp, col, n, mu, sd, prec, a2, skipped, strict=True):
            if why is not None or seen is None or not np.isfinite(seen):
                rows.append((None, None, None))
                continue
            draws = gof_null(generator(seed, test, d, g, c), int(size), m, s, int(q))
            low = (1 + (draws <= seen).sum()) / (1 + len(draws))
            high = (1 + (draws >= seen).sum()) / (1 + len(draws))
            rows.append((min(1.0, 2 * min(low, high)), float(np.sort(draws)[len(draws) // 2]), bool(high <= low)))
        return pd.DataFrame(rows, columns=["raw_p", "middle", "high"])

    out = every.withColumn(
        "_n", null("dataset_id", "grp", "col", "n", "mu", "sd", "prec", "a2", "skip")
    ).select(*every.columns, "_n.*")
    out = bh_small(out, KEY).withColumn("ratio", F.col("a2") / F.col("middle"))
    strong = (F.col("high") & (F.col("ratio") >= 2.0)) | (~F.col("high") & (F.col("ratio") <= 0.5))
    out = out.withColumn("flag", F.when(F.col("raw_p").isNull(), "N/A").when(
        strong, flag_from_p(F.col("adj_p"))).otherwise("LOW"))
    return Outcome(
        lambda: unit_rows(
            out, test, F.concat(F.lit("column "), F.col("col") + 1), F.col("a2"), raw_p=F.col("raw_p"),
            adj_p=F.col("adj_p"), cols=F.array("col"),
        ),
        _worst(out, test, sheet, 30.0, {}, "parametric bootstrap"),
    )


# ---------------------------------------------------------------- F12 modality

DIP_GATE = 0.04
DIP_FLOOR = 0.001
DIP_DRAWS = 999
_NULL_VALUES = 200


def _hull_gap(x: np.ndarray, n: int, first: int) -> float:
    """Largest ECDF excess over the convex minorant of consecutive order
    statistics ``x`` whose ranks start at ``first``."""
    m = len(x)
    if m < 3:
        return 0.0
    rank = np.arange(first + 1, first + m + 1) / n
    # Under ties a minorant passes through the lowest rank of each value.
    keep = np.insert(np.diff(x) > 0, 0, True)
    xs, ys = x[keep].tolist(), rank[keep].tolist()
    hull = [0]
    for i in range(1, len(xs)):
        while len(hull) >= 2:
            a, b = hull[-2], hull[-1]
            if (ys[b] - ys[a]) * (xs[i] - xs[b]) > (ys[i] - ys[b]) * (xs[b] - xs[a]):
                hull.pop()
            else:
                break
        hull.append(i)
    hx, hy = np.array(xs)[hull], np.array(ys)[hull]
    return float(np.max(rank - np.interp(x, hx, hy), initial=0.0))


def dip(x: np.ndarray) -> float:
    """Smallest, over the split point, of the larger of the two hull gaps:
    convex minorant to its left, concave majorant to its right.

    The left gap grows and the right gap shrinks as the split moves right, so
    the crossing is found by bisection.
    """
    n = len(x)
    if n < 4:
        return 0.0

    def left(k: int) -> float:
        return _hull_gap(x[:k + 1], n, 0)

    def right(k: int) -> float:
        # Turned by 180 degrees the majorant becomes a minorant.
        return _hull_gap(-x[k:][::-1], n, 0)

    lo, hi = 1, n - 2
    while lo < hi:
        mid = (lo + hi) // 2
        if left(mid) >= right(mid):
            hi = mid
        else:
            lo = mid + 1
    around = [k for k in (lo - 1, lo) if 1 <= k <= n - 2]
    return min(max(left(k), right(k)) for k in around) / 2


def _dip_null(n: int, seed: int) -> np.ndarray:
    rng = generator(seed, "dip", n)
    return np.sort([math.sqrt(n) * dip(np.sort(rng.random(n))) for _ in range(DIP_DRAWS)])


def ecdf_points(sheet: Sheet) -> DataFrame:
    """Each column's values, or 4096 evenly spaced quantiles where it has more."""
    moments = column_moments(sheet)
    c = cells(sheet.rows).join(moments.select(*COL, "n"), COL)
    grid = [(i + 0.5) / MAX_UNIT_ROWS for i in range(MAX_UNIT_ROWS)]
    few = c.where(F.col("n") <= MAX_UNIT_ROWS).groupBy(*COL).agg(F.array_sort(F.collect_list("x")).alias("points"))
    many = c.where(F.col("n") > MAX_UNIT_ROWS).groupBy(*COL).agg(
        F.percentile_approx("x", grid, 200_000).alias("points")
    )
    return moments.join(few.unionByName(many), COL)


def modality(sheet: Sheet) -> Outcome:
    test = "Modality Test"
    seed = sheet.settings.seed
    flat = (F.col("kurt") < -1.2) | ((F.col("kurt") < -0.8) & (F.col("n") >= 100))
    skip = F.when(F.col("n") < 50, "tooFewObservations").when(F.col("n_distinct") < 15, "tooFewDistinct").when(
        flat, "shapeNotCovered"
    )
    every = ecdf_points(sheet).withColumn("skip", skip)

    @F.pandas_udf("struct<dip:double,raw_p:double>")
    def dip_test(points: pd.Series, n: pd.Series, skipped: pd.Series) -> pd.DataFrame:
        rows, nulls = [], {}
        for x, size, why in zip(points, n, skipped, strict=True):
            if why is not None:
                rows.append((None, None))
                continue
            d, m = dip(np.asarray(x, float)), int(min(size, _NULL_VALUES))
            if m not in nulls:
                nulls[m] = _dip_null(m, seed)
            null = nulls[m]
            p = (1 + (null >= math.sqrt(size) * d).sum()) / (1 + len(null))
            rows.append((d, max(DIP_FLOOR, float(p))))
        return pd.DataFrame(rows, columns=["dip", "raw_p"])

    out = every.withColumn("_d", dip_test("points", "n", "skip")).drop("points").select(
        *COL, "n", "n_distinct", "kurt", "skip", "_d.*"
    )
    out = bh_small(out, KEY).withColumn("flag", F.when(F.col("raw_p").isNull(), "N/A").when(
        F.col("dip") >= DIP_GATE, flag_from_p(F.col("adj_p"))).otherwise("LOW"))
    return Outcome(
        lambda: unit_rows(
            out, test, F.concat(F.lit("column "), F.col("col") + 1), F.col("dip"), raw_p=F.col("raw_p"),
            adj_p=F.col("adj_p"), cols=F.array("col"),
        ),
        _worst(out, test, sheet, 50.0, {}, "uniform simulation"),
    )
