"""Tail probabilities as Arrow UDFs, for result rows (one per unit)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperscope.functions.tails import (
    beta_cdf, binomial_sf_np, chi2_sf_np, f_sf_np, fisher_exact_np, gamma_sf, poisson_sf_np,
    t_two_sided_np,
)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf_np(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf_np(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_np(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_sf_np(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def poisson_tail(k: pd.Series, lam: pd.Series) -> pd.Series:
    return pd.Series(poisson_sf_np(k.to_numpy(float), lam.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cols = [s.to_numpy(float) for s in (a, b, c, d)]
    return pd.Series(fisher_exact_np(*cols))


@F.pandas_udf(T.DoubleType())
def binomial_lower(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k)."""
    k, n, p = (s.to_numpy(float) for s in (k, n, p))
    inner = beta_cdf((n - k).clip(1e-9), k + 1, 1 - p)
    inner[k >= n] = 1.0
    return pd.Series(inner)


@F.pandas_udf(T.DoubleType())
def ratio_tail(ratio: pd.Series, width: pd.Series, kurt: pd.Series) -> pd.Series:
    """Chance that one window's variance ratio is this far from one either way:
    a scaled chi-squared whose spread follows the kurtosis of the values."""
    r, w = ratio.to_numpy(float), width.to_numpy(float)
    spread = 2.0 / (w - 1) + kurt.fillna(0.0).to_numpy(float).clip(-1.5) / w
    shape = 1.0 / spread.clip(1e-3)
    both = gamma_sf(shape, shape * r) + 1.0 - gamma_sf(shape, shape / r)
    return pd.Series(both.clip(0.0, 1.0))
