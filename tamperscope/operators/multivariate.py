"""Rows and row blocks that do not fit the joint spread of the columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_large, bh_small
from tamperscope.functions.rows import present, sheet_sizes
from tamperscope.functions.stats import ALPHA_MODERATE, flag_from_p, normal_sf
from tamperscope.functions.tails import chi2_sf_np
from tamperscope.model import ALL, KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import dense_position
from tamperscope.operators.replicates import size_cause
from tamperscope.operators.resample import MAX_UNIT_ROWS, gather, generator, permutation_exceedances
from tamperscope.session import materialize

ROW_ALPHA = 0.001


def complete_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.size(present("vals")) == F.size("vals")) & (F.size("vals") > 0))


# --------------------------------------------------------- F24 row outliers

def _moments(rows: DataFrame) -> DataFrame:
    """Column means and covariance matrix (row-major) per group.

    Covariances are mergeable aggregates over the column pairs of a row, so
    the shuffle carries p(p+1)/2 partial sums per task and group.
    """
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("vals") - 1),
        lambda i: F.transform(F.sequence(i, F.size("vals") - 1), lambda j: F.struct(
            i.alias("i"), j.alias("j"), F.get("vals", i).alias("a"), F.get("vals", j).alias("b"))),
    ))
    cov = rows.select(*KEY, F.explode(pairs).alias("p")).select(*KEY, "p.*").groupBy(*KEY, "i", "j").agg(
        F.count("a").alias("n"), F.covar_samp("a", "b").alias("c"), F.avg("a").alias("m")
    )
    return cov.groupBy(*KEY).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "j", "c", "m"))).alias("e")
    )


@F.pandas_udf(T.StructType([
    T.StructField("mu", T.ArrayType(T.DoubleType())), T.StructField("inv", T.ArrayType(T.DoubleType())),
    T.StructField("cut", T.DoubleType()),
]))
def _inverse(i: pd.Series, j: pd.Series, c: pd.Series, m: pd.Series) -> pd.DataFrame:
    """Means, inverse covariance and the 1% point of chi-squared with p df."""
    mus, invs, cuts = [], [], []
    for ii, jj, cc, mm in zip(i, j, c, m, strict=True):
        ii, jj, cc = np.asarray(ii, int), np.asarray(jj, int), np.asarray(cc, float)
        p = int(jj.max()) + 1
        s = np.zeros((p, p))
        s[ii, jj] = cc
        s[jj, ii] = cc
        mu = np.asarray(mm, float)[ii == jj]
        scale = np.sqrt(np.maximum(np.diag(s), 1e-300))
        singular = not np.all(np.isfinite(s)) or np.linalg.matrix_rank(s / np.outer(scale, scale)) < p
        lo, hi = 0.0, 1000.0 + 10 * p
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if chi2_sf_np(np.array([mid]), np.array([p]))[0] > ALPHA_MODERATE else (lo, mid)
        mus.append(mu.tolist())
        invs.append(None if singular else np.linalg.inv(s).ravel().tolist())
        cuts.append(lo)
    return pd.DataFrame({"mu": mus, "inv": invs, "cut": cuts})


def _log_scaled(rows: DataFrame) -> DataFrame:
    """Natural logs for all-positive groups with strongly skewed values."""
    pooled = rows.select(*KEY, F.explode("vals").alias("v")).groupBy(*KEY).agg(
        (F.min("v") > 0).alias("_pos"), F.skewness("v").alias("_skew")
    )
    logged = F.coalesce(F.col("_pos") & (F.col("_skew") > 1.5), F.lit(False))
    # Written, its size is known: rows aren't dealt by group to meet it.
    return rows.join(materialize(pooled, "skewness"), KEY).withColumn("logged", logged).withColumn(
        "vals", F.transform("vals", lambda v: F.when(F.col("logged"), F.log(v)).otherwise(v))
    ).drop("_pos", "_skew")


def row_distances(sheet: Sheet) -> DataFrame:
    """Squared Mahalanobis distance of every complete row."""
    rows = _log_scaled(complete_rows(sheet.rows))
    moments = _moments(rows).where(F.col("n") >= 3 * F.element_at("e.j", -1) + 3)
    shape = moments.select(*KEY, "n", _inverse("e.i", "e.j", "e.c", "e.m").alias("s")).select(*KEY, "n", "s.*")
    joined = rows.join(materialize(shape.where(F.col("inv").isNotNull()), "row-shapes"), KEY).withColumn(
        "_d", F.zip_with("vals", "mu", lambda v, m: v - m)
    )
    p = F.size("_d")

    def row_term(i: Column) -> Column:
        inner = F.aggregate(
            F.sequence(F.lit(0), p - 1), F.lit(0.0),
            lambda a, j: a + F.get("inv", i * p + j) * F.get("_d", j),
        )
        return F.get("_d", i) * inner

    d2 = F.aggregate(F.sequence(F.lit(0), p - 1), F.lit(0.0), lambda a, i: a + row_term(i))
    return joined.select(
        *KEY, "row_idx", "n", p.alias("p"), "cut", "logged", F.greatest(F.lit(0.0), d2).alias("d2")
    )


def mahalanobis_rows(sheet: Sheet) -> Outcome:
    test = "Mahalanobis Row Outlier"
    dist = materialize(row_distances(sheet), "distances")
    counts = dist.groupBy(*KEY).agg(
        F.max("n").alias("n_complete"), F.count_if(F.col("d2") > F.col("cut")).alias("n_exceed"),
        F.max(F.col("logged").cast("int")).alias("logged"),
    )
    # Adjusted p is never below raw p, so only rows beyond the 1% point can
    # pass; their ranks among all rows are their ranks among themselves.
    far = dist.where(F.col("d2") > F.col("cut")).withColumn(
        "raw_p", special.chi2_tail("d2", F.col("p").cast("double"))
    ).where(F.col("raw_p") < ROW_ALPHA)
    ranked = bh_large(far, KEY, "raw_p", "_among").join(
        materialize(far.groupBy(*KEY).agg(F.count("raw_p").alias("_m")), "far-rows"), KEY
    ).withColumn("adj_p", F.least(F.lit(1.0), F.col("_among") * F.col("n") / F.col("_m")))
    out = ranked.where(F.col("adj_p") < ROW_ALPHA)
    outliers = out.groupBy(*KEY).agg(F.count("d2").alias("n_outliers"), F.min("d2").alias("threshold"))
    df = sheet_sizes(sheet.rows).join(counts, KEY, "left").join(outliers, KEY, "left").fillna(0, ["n_outliers"])
    n = F.col("n_complete")
    z = (F.col("n_exceed") - n * 0.01) / F.sqrt(n * 0.01 * 0.99)
    df = df.withColumn("p", F.when(z > 0, normal_sf(z)).otherwise(F.when(n.isNotNull(), 1.0)))
    quiet = (F.col("n_outliers") == 0) | (F.col("n_exceed") / n < 0.02)
    cause, seen, _ = size_cause(3, 0)
    few = F.col("n_rows") < 3 * F.col("n_cols")
    cause = F.when(F.lit(sheet.settings.assay == "genomics"), "assayNotApplicable").otherwise(
        F.coalesce(cause, F.when(few, "tooFewRows"), F.when(F.col("p").isNull(), "tooFewRows"))
    )
    result = result_rows(
        df, test, F.when(quiet, "LOW").otherwise(flag_from_p(F.col("p"))), F.col("p"),
        {"rows": n, "exceed": F.col("n_exceed"), "outliers": F.col("n_outliers"), "logged": F.col("logged")},
        na_cause=cause, na_observed=F.when(F.col("n_cols") < 3, seen).otherwise(F.col("n_rows")),
        na_minimum=F.when(F.col("n_cols") < 3, F.lit(3)).otherwise(3 * F.col("n_cols")),
    )
    return Outcome(
        lambda: unit_rows(
            out, test, F.lit("row"), F.col("d2"), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
            row_lo=F.col("row_idx"), row_hi=F.col("row_idx"),
        ),
        result,
    )


# ------------------------------------------------------- F25 blocks of rows

MIN_BLOCK_ROWS = 60


def _features(x: np.ndarray) -> np.ndarray:
    """Per row: x, x x^T, |x|^2, |x|^2 x, |x|^4; all additive over rows."""
    n, p = x.shape
    q = (x * x).sum(axis=1, keepdims=True)
    return np.hstack([x, (x[:, :, None] * x[:, None, :]).reshape(n, p * p), q, q * x, q * q])


def _shrunk(f: np.ndarray, n: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Ledoit-Wolf covariance from feature sums of shape (w, F)."""
    n = np.broadcast_to(np.asarray(n, float), f.shape[:1])[:, None]
    m = f[:, :p] / n
    xx = f[:, p:p + p * p].reshape(-1, p, p)
    sq, qx, qq = f[:, p + p * p], f[:, p + p * p + 1:p + p * p + 1 + p], f[:, -1]
    s = (xx - n[:, :, None] * m[:, :, None] * m[:, None, :]) / (n[:, :, None] - 1)
    c = (m * m).sum(axis=1)
    n1 = n[:, 0]
    fourth = (qq + 4 * np.einsum("wi,wij,wj->w", m, xx, m) + n1 * c * c
              - 4 * (m * qx).sum(axis=1) + 2 * c * sq - 4 * c * n1 * c)
    tr2 = (s * s).sum(axis=(1, 2))
    mu = np.trace(s, axis1=1, axis2=2) / p
    delta = tr2 - p * mu * mu
    beta = np.minimum((fourth - (n1 - 2) * tr2) / (n1 * n1), delta)
    alpha = np.clip(np.where(delta > 0, beta / np.where(delta > 0, delta, 1), 0), 0, 1)[:, None, None]
    return m, (1 - alpha) * s + alpha * mu[:, None, None] * np.eye(p)


def block_statistics(block: np.ndarray, total: np.ndarray, width: int, n: int, p: int) -> np.ndarray:
    """Hotelling-type T^2 and leading eigenvalue of each block against the rest."""
    rest = total[None, :] - block
    mb, sb = _shrunk(block, width, p)
    mc, sc = _shrunk(rest, n - width, p)
    pooled = ((width - 1) * sb + (n - width - 1) * sc) / (n - 2)
    d = mb - mc
    eye = 1e-12 * np.trace(pooled, axis1=1, axis2=2)[:, None, None] / p * np.eye(p)
    tsq = np.einsum("wi,wi->w", d, np.linalg.solve(pooled + eye, d[:, :, None])[:, :, 0]) * width * (n - width) / n
    low = np.linalg.cholesky(sc + eye)
    half = np.linalg.solve(low, sb)
    lam = np.linalg.eigvalsh(np.linalg.solve(low, np.swapaxes(half, 1, 2)))[:, -1]
    return np.stack([np.maximum(tsq, 0), np.maximum(lam, 0)], axis=1)


def block_shape(p: int) -> tuple[int, int]:
    width = max(30, 3 * p)
    return width, max(10, width // 3)


def _scan(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Largest T^2 and eigenvalue over all windows, for each row order."""
    n, p = x.shape
    width, stride = block_shape(p)
    f = _features(x - x.mean(axis=0))
    total = f.sum(axis=0)
    starts = np.arange(0, n - width + 1, stride)
    out = np.empty((order.shape[0], 2))
    for b in range(order.shape[0]):
        c = np.vstack([np.zeros((1, f.shape[1])), np.cumsum(f[order[b]], axis=0)])
        out[b] = block_statistics(c[starts + width] - c[starts], total, width, n, p).max(axis=0)
    return out


def _block_null(rec: dict, order: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return _scan(rec["vals"], order)


def _conditions(sheet: Sheet) -> DataFrame:
    """Complete rows per condition (per sheet where rows carry none)."""
    rows = complete_rows(sheet.rows).withColumn("grp", F.coalesce("cond", F.lit(ALL)))
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vals")).alias("p"))
    enough = sizes.where((F.col("n") >= MIN_BLOCK_ROWS) & (F.col("p") >= 3))
    return dense_position(rows.select(*KEY, "row_idx", "vals"), KEY, "row_idx").join(enough, KEY)


def block_windows(sheet: Sheet) -> DataFrame:
    """T^2 and leading eigenvalue of every window of each condition.

    Windows hold max(30, 3p) rows. The complement of a window is the total
    minus the window, so one pass of feature sums serves every window.
    """
    rows = _conditions(sheet)
    means = rows.select(*KEY, F.posexplode("vals").alias("i", "v")).groupBy(*KEY, "i").agg(F.avg("v").alias("m"))
    centre = means.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(
        *KEY, F.col("c.m").alias("mu")
    )
    centred = rows.join(centre, KEY).withColumn("vals", F.zip_with("vals", "mu", lambda v, m: v - m)).drop("mu")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for key, g in pdf.groupby([*KEY, "n", "p"], sort=False):
                sums = _features(np.stack(g["vals"].to_numpy())).sum(axis=0)
                parts += [(*key, k, float(v)) for k, v in enumerate(sums)]
            yield pd.DataFrame(parts, columns=[*KEY, "n", "p", "k", "v"])

    sums = centred.select(*KEY, "n", "p", "vals").mapInPandas(
        partial, "dataset_id string, grp string, n bigint, p int, k int, v double"
    ).groupBy(*KEY, "n", "p", "k").agg(F.sum("v").alias("v"))
    totals = sums.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("t")).select(
        *KEY, F.col("t.v").alias("total")
    )
    width = F.greatest(F.lit(30), 3 * F.col("p"))
    stride = F.greatest(F.lit(10), F.floor(width / 3))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / stride))
    last = F.least(F.floor(F.col("pos") / stride), F.floor((F.col("n") - width) / stride))
    spread = centred.where(first <= last).withColumn("w", F.explode(F.sequence(first, last)))
    windows = spread.groupBy(*KEY, "w").agg(
        F.max("n").alias("n"), F.max("p").alias("p"), F.min("row_idx").alias("row_lo"),
        F.max("row_idx").alias("row_hi"), F.collect_list("vals").alias("rows"), F.max(width).alias("width"),
    ).join(totals, KEY)

    @F.pandas_udf("struct<tsq:double,lambda:double>")
    def evaluate(rows_: pd.Series, total: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = []
        for r, t, size, cols in zip(rows_, total, n, p, strict=True):
            x = np.array([np.asarray(v, float) for v in r])
            stat = block_statistics(_features(x).sum(axis=0)[None, :], np.asarray(t, float), len(x), int(size), int(cols))
            out.append(stat[0])
        return pd.DataFrame(out, columns=["tsq", "lambda"])

    return windows.select(
        *KEY, "w", "n", "p", "row_lo", "row_hi", evaluate("rows", "total", "n", "p").alias("s")
    ).select(*KEY, "w", "n", "p", "row_lo", "row_hi", "s.*")


def blocked_mahalanobis(sheet: Sheet) -> Outcome:
    test = "Blocked Mahalanobis"
    seed = sheet.settings.seed
    windows = materialize(block_windows(sheet), "block-windows")
    best = windows.groupBy(*KEY).agg(
        F.max("n").alias("n"), F.max("tsq").alias("tsq"), F.max("lambda").alias("lambda"), F.count("w").alias("n_windows")
    )
    rows = materialize(_conditions(sheet), "block-rows")
    small = gather(rows, KEY, "pos", ["vals"]).drop("n").join(best.select(*KEY, "n_windows", "tsq", "lambda"), KEY)
    null = permutation_exceedances(
        small.withColumn("obs", F.array("tsq", "lambda")), KEY, test=test, seed=seed,
        draws=lambda n: 4999 if n <= 500 else 999, statistic=_block_null, array_columns=["vals"], observed="obs",
    )
    tail = _extreme_value_tails(rows, best, test, seed)
    joined = best.join(null, KEY, "left").join(tail, KEY, "left")
    long_ = joined.select(*KEY, "n_windows", "n_draws", F.explode(F.array(
        F.struct(F.lit("mean shift").alias("what"), F.col("tsq").alias("stat"),
                 F.coalesce((F.col("exceed")[0] + 1) / (F.col("n_draws") + 1), F.col("p_tsq")).alias("raw_p")),
        F.struct(F.lit("covariance").alias("what"), F.col("lambda").alias("stat"),
                 F.coalesce((F.col("exceed")[1] + 1) / (F.col("n_draws") + 1), F.col("p_lambda")).alias("raw_p")),
    )).alias("u")).select(*KEY, "n_windows", "n_draws", "u.*")
    family = materialize(bh_small(long_, ["dataset_id"]), "block-family")
    sums = family.groupBy("dataset_id").agg(
        F.min("adj_p").alias("p"), F.count("raw_p").alias("n_units"), F.sum("n_windows").alias("n_windows"),
        F.min("n_draws").alias("n_draws"),
    )
    df = sheet_sizes(sheet.rows).join(sums, "dataset_id", "left")
    cause, seen, need = size_cause(3, 60)
    cause = F.when(F.lit(sheet.settings.data_type != "continuous"), "dataTypeMismatch").otherwise(
        cause.when(F.col("p").isNull(), "tooFewRows"))
    result = result_rows(
        df, test, flag_from_p(F.col("p")), F.col("p"),
        {"units": F.col("n_units"), "windows": F.col("n_windows") / 2},
        na_cause=cause, na_observed=seen, na_minimum=need,
        null_method=F.when(F.col("n_draws").isNotNull(), "row shuffle").otherwise("extreme value"),
    )
    top = windows.join(best.select(*KEY, F.col("tsq").alias("best_t"), F.col("lambda").alias("best_l")), KEY)
    both = top.select(*KEY, "w", "row_lo", "row_hi", F.explode(F.array(
        F.struct(F.lit("mean shift").alias("what"), F.col("tsq").alias("stat"), F.col("best_t").alias("top")),
        F.struct(F.lit("covariance").alias("what"), F.col("lambda").alias("stat"), F.col("best_l").alias("top")),
    )).alias("u")).select(*KEY, "w", "row_lo", "row_hi", "u.*").where("stat >= 0.95 * top and stat > 0")
    both = both.join(family.select(*KEY, "what", "raw_p", "adj_p"), [*KEY, "what"]).withColumn(
        "_c", F.col("grp")).withColumn("grp", F.lit(ALL))
    return Outcome(
        lambda: unit_rows(
            both, test, F.concat_ws(" ", "what", F.lit("condition"), "_c", F.lit("window"), "w"), F.col("stat"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"), row_lo=F.col("row_lo"), row_hi=F.col("row_hi"),
        ),
        result,
    )


def _extreme_value_tails(rows: DataFrame, best: DataFrame, test: str, seed: int) -> DataFrame:
    """Null of the largest window statistic of a long condition.

    A hash-picked set of at most about 4096 of its rows is shuffled; the maxima
    follow a Gumbel law whose location moves with the log of the number of
    windows. The observed statistics come from every row.
    """
    keep = F.pmod(F.xxhash64(F.lit(seed), *KEY, "pos"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where((F.col("n") > MAX_UNIT_ROWS) & (keep < F.lit(0.9 * MAX_UNIT_ROWS) / F.col("n")))
    lists = picked.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "vals"))).alias("s")).select(
        *KEY, F.col("s.vals").alias("sample")
    ).join(best, KEY)

    @F.pandas_udf("struct<p_tsq:double,p_lambda:double>")
    def tails(ds: pd.Series, grp: pd.Series, sample: pd.Series, n_windows: pd.Series, tsq: pd.Series,
              lam: pd.Series) -> pd.DataFrame:
        out = []
        for d, g, s, w, t, v in zip(ds, grp, sample, n_windows, tsq, lam, strict=True):
            x = np.array([np.asarray(r, float) for r in s])
            rng = generator(seed, test, d, g, "tail")
            order = rng.permuted(np.tile(np.arange(len(x)), (100, 1)), axis=1)
            maxima = _scan(x, order)
            width, stride = block_shape(x.shape[1])
            own = (len(x) - width) // stride + 1
            scale = np.maximum(maxima.std(axis=0, ddof=1) * np.sqrt(6) / np.pi, 1e-12)
            place = maxima.mean(axis=0) - 0.5772156649 * scale + scale * np.log(w / own)
            out.append(-np.expm1(-np.exp(-(np.array([t, v]) - place) / scale)))
        return pd.DataFrame(out, columns=["p_tsq", "p_lambda"])

    return lists.select(
        *KEY, tails("dataset_id", "grp", "sample", "n_windows", "tsq", "lambda").alias("p")
    ).select(*KEY, "p.*")
