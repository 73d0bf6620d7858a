"""Distribution functions and verdict rules as plain Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significance levels.
ALPHA_HIGH = 0.001
ALPHA_MODERATE = 0.01

# Chebyshev coefficients of the complementary error function
# (published rational fit, relative error below 1.2e-7 everywhere).
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``.

    Without it an argument used ten times is planned ten times over, and
    nested formulas outgrow the generated code.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_many(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """As ``let`` for several values, passed to ``body`` as one struct."""
    return let(F.struct(*[c.alias(k) for k, c in values.items()]), body)


def erfc(x: Column) -> Column:
    def tail(z: Column, t: Column) -> Column:
        poly: Column = F.lit(ERFC_COEFFICIENTS[-1])
        for c in reversed(ERFC_COEFFICIENTS[:-1]):
            poly = poly * t + F.lit(c)
        return t * F.exp(-z * z + poly)

    def body(v: Column) -> Column:
        size = F.abs(v)
        upper = let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * size), lambda t: tail(size, t))
        return let(upper, lambda u: F.when(v >= 0, u).otherwise(F.lit(2.0) - u))

    return let(x.cast("double"), body)


def normal_sf(z: Column) -> Column:
    return F.lit(0.5) * erfc(z / F.lit(math.sqrt(2.0)))


def normal_cdf(z: Column) -> Column:
    return normal_sf(-z)


def z_to_p(z: Column) -> Column:
    """Two-sided p of a standard normal deviate."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-squared for a whole ``df`` known at plan time."""

    def body(h: Column) -> Column:
        if df % 2 == 0:
            total: Column = F.lit(1.0)
            for k in range(1, df // 2):
                total = total + F.pow(h, F.lit(float(k))) / F.lit(float(math.factorial(k)))
            p = F.exp(-h) * total
        else:
            p = erfc(F.sqrt(h))
            for k in range((df - 1) // 2):
                p = p + F.exp(-h) * F.pow(h, F.lit(k + 0.5)) / F.lit(math.gamma(k + 1.5))
        return F.when(h <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))

    return let(x.cast("double") / F.lit(2.0), body)


def flag_from_p(p: Column) -> Column:
    return let(
        p,
        lambda v: F.when(v.isNull() | F.isnan(v), "N/A")
        .when(v < ALPHA_HIGH, "HIGH")
        .when(v < ALPHA_MODERATE, "MODERATE")
        .otherwise("LOW"),
    )


def flag_rank(flag: Column) -> Column:
    return (
        F.when(flag == "HIGH", 3).when(flag == "MODERATE", 2).when(flag == "LOW", 1)
        .when(flag == "ERROR", -1).otherwise(0)
    )


def stronger_flag(a: Column, b: Column) -> Column:
    return let_many(
        {"a": a, "b": b},
        lambda s: F.when(flag_rank(s["a"]) >= flag_rank(s["b"]), s["a"]).otherwise(s["b"]),
    )


def sidak(p: Column, k: Column) -> Column:
    """Size of the smallest of ``k`` independent p-values."""
    return let(
        p,
        lambda v: F.when(k <= 1, v).when(v <= 0, F.lit(0.0)).when(v >= 1, F.lit(1.0))
        .otherwise(-F.expm1(k * F.log1p(-v))),
    )


def kolmogorov_sf(s: Column) -> Column:
    """P(sup |Brownian bridge| > s); the eighth term is below 1e-15 from s = 0.4."""

    def body(v: Column) -> Column:
        total: Column = F.lit(0.0)
        for k in range(1, 9):
            sign = 1.0 if k % 2 else -1.0
            total = total + F.lit(sign) * F.exp(F.lit(-2.0 * k * k) * v * v)
        return F.when(v <= 0.4, F.lit(1.0)).otherwise(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * total))
        )

    return let(s, body)


def digamma(x, log=F.log):
    """Digamma of a positive column, or of a number with ``log=math.log``."""
    y = x + 6
    square = 1 / (y * y)
    series = square / 12 - square * square / 120 + square * square * square / 252
    return log(y) - 1 / (2 * y) - series - sum(1 / (x + i) for i in range(6))


def log_variance_bias(freedom, log=F.log):
    """Mean of ln(s^2 / sigma^2) of Gaussian samples with ``freedom`` degrees."""
    return digamma(freedom / 2, log) - log(freedom / 2)


def fisher_z(r: Column) -> Column:
    return let(r, lambda v: F.lit(0.5) * F.log((F.lit(1.0) + v) / (F.lit(1.0) - v)))


def runs_z(runs: Column, n_pos: Column, n_neg: Column) -> Column:
    """Wald-Wolfowitz z; null where one sign is absent."""

    def body(s: Column) -> Column:
        n, twice = s["n"], F.lit(2.0) * s["np"] * s["nm"]
        variance = twice * (twice - n) / (n * n * (n - F.lit(1.0)))
        usable = (s["np"] > 0) & (s["nm"] > 0) & (n > 1)
        z = let(variance, lambda v: F.when(v > 0, (s["runs"] - twice / n - F.lit(1.0)) / F.sqrt(v)))
        return F.when(usable, z)

    return let_many(
        {"np": n_pos.cast("double"), "nm": n_neg.cast("double"),
         "n": (n_pos + n_neg).cast("double"), "runs": runs.cast("double")},
        body,
    )
