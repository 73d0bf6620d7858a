"""Digit tests: leading, second and last digits, precision, frequency spikes.

Every table here is a mergeable count, so one shuffle of partial counts is all
a test needs however many cells a sheet has.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_large, bh_small
from tamperscope.functions.rows import cells, sheet_sizes
from tamperscope.functions.stats import (
    ALPHA_MODERATE, chi2_sf, flag_from_p, let, normal_sf, stronger_flag,
)
from tamperscope.functions.values import (
    decimal_places, decimal_text, is_integer, last_digit, plain_decimal, significant_digit,
)
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import rank_values, with_halo
from tamperscope.operators.resample import multinomial_mad_p
from tamperscope.session import materialize

FIRST_DIGIT = np.log10(1 + 1 / np.arange(1, 10))
SECOND_DIGIT = np.array(
    [sum(math.log10(1 + 1 / (10 * d + k)) for d in range(1, 10)) for k in range(10)]
)
SIMULATIONS = 5000


def log_span(x: Column) -> Column:
    """5-95% span of log10|x|; the full span below ten values."""
    size = F.when(x != 0, F.log10(F.abs(x)))
    return F.when(
        F.count(size) < 10, F.max(size) - F.min(size)
    ).otherwise(let(rank_values(size, [0.05 + 1e-9, 0.95 + 1e-9]), lambda q: F.get(q, F.lit(1)) - F.get(q, F.lit(0))))


def digit_counts(sheet: Sheet, position: int) -> DataFrame:
    """Per group: cell counts, sign and integer shares, log span and the counts
    of the ``position``-th significant digit (0 for the last digit)."""
    c = cells(sheet.rows)
    if position == 0:
        digit = last_digit(plain_decimal(F.col("x")))
        span, low = [], 0
    else:
        digit = significant_digit(plain_decimal(F.col("x")), position)
        span, low = [log_span(F.col("x")).alias("span")], 1 if position == 1 else 0
    c = c.withColumn("_d", digit)
    return c.groupBy(*KEY).agg(
        F.count("x").alias("n"),
        F.count_if(F.col("x") != 0).alias("n_nonzero"),
        F.count_if(F.col("x") > 0).alias("n_positive"),
        F.count_if(is_integer(F.col("x"))).alias("n_integer"),
        *span,
        *[
            F.count_if((F.col("_d") == d) & ((F.col("x") != 0) if position else F.lit(True))).alias(f"d{d}")
            for d in range(low, 10)
        ],
    )


def goodness(counts: list[Column], probs: list[float]) -> tuple[Column, Column, Column]:
    """Total, chi-squared and mean absolute deviation of counts against probs."""
    total = sum(counts[1:], counts[0])
    chi: Column = F.lit(0.0)
    mad: Column = F.lit(0.0)
    for c, p in zip(counts, probs, strict=True):
        expected = total * F.lit(float(p))
        chi = chi + (c - expected) * (c - expected) / expected
        mad = mad + F.abs(c / total - F.lit(float(p)))
    return total, chi, mad / F.lit(float(len(counts)))


def _digit_units(df: DataFrame, test: str, digits: list[int], probs: list[float]) -> DataFrame:
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(d).alias("d"), F.col(f"d{d}").alias("c"), F.lit(float(p)).alias("p"))
            for d, p in zip(digits, probs, strict=True)
        ])
    )
    long = df.select(*KEY, rows.alias("u")).select(*KEY, "u.*")
    return unit_rows(long, test, F.concat(F.lit("digit "), F.col("d")), F.col("c").cast("double"))


def _benford(sheet: Sheet, test: str, position: int, probs: np.ndarray, min_span: float,
             gate: float, positive: bool) -> Outcome:
    low = 1 if position == 1 else 0
    digits = list(range(low, 10))
    df = digit_counts(sheet, position)
    total, chi, mad = goodness([F.col(f"d{d}") for d in digits], probs.tolist())
    df = df.withColumn("total", total).withColumn("chi", chi).withColumn("mad", mad)
    p_sim = multinomial_mad_p(test, probs / probs.sum(), SIMULATIONS, sheet.settings.seed)
    df = df.withColumn("p_mad", p_sim("dataset_id", "grp", "total", "mad"))
    cell_count = sheet.settings.assay == "cell_count"
    cause = F.when(F.lit(cell_count), "assayNotApplicable")
    if position == 2:
        cause = cause.when(F.col("n_integer") / F.col("n") > 0.9, "dataTypeMismatch")
    cause = cause.when(F.col("n_nonzero") < 100, "tooFewRows")
    if positive:
        cause = cause.when(F.col("n_positive") / F.col("n_nonzero") < 0.80, "shapeNotCovered")
    cause = cause.when(F.col("span") < min_span, "rangeOutOfBand").when(
        F.col("total") < 50, "emptyInput"
    )
    result = result_rows(
        df, test,
        F.when(F.col("mad") < gate, "LOW").otherwise(flag_from_p(F.col("p_mad"))),
        F.col("p_mad"),
        {"n": F.col("total"), "chi2": F.col("chi"), "p_chi2": chi2_sf(F.col("chi"), len(digits) - 1),
         "mad": F.col("mad"), "span": F.col("span")},
        na_cause=cause, na_observed=F.col("n_nonzero"), na_minimum=100.0,
        null_method="multinomial",
    )
    return Outcome(lambda: _digit_units(df, test, digits, probs.tolist()), result)


def benford_first(sheet: Sheet) -> Outcome:
    return _benford(sheet, "Benford's Law (First Digit)", 1, FIRST_DIGIT, 1.5, 0.015, True)


def benford_second(sheet: Sheet) -> Outcome:
    return _benford(sheet, "Benford's Law (Second Digit)", 2, SECOND_DIGIT, 1.0, 0.008, False)


def terminal_digit(sheet: Sheet) -> Outcome:
    """Uniformity of the last digit; zero is left out where trailing zeros have
    visibly been stripped by the file."""
    test = "Terminal Digit Uniformity"
    df = digit_counts(sheet, 0)
    total, chi10, _ = goodness([F.col(f"d{d}") for d in range(10)], [0.1] * 10)
    _, chi9, _ = goodness([F.col(f"d{d}") for d in range(1, 10)], [1 / 9] * 9)
    stripped = F.col("d0") < F.lit(0.4) * total / 10
    df = (
        df.withColumn("stripped", stripped)
        .withColumn("chi", F.when(stripped, chi9).otherwise(chi10))
        .withColumn("p", F.when(stripped, chi2_sf(chi9, 8)).otherwise(chi2_sf(chi10, 9)))
    )
    cause = F.when(F.col("n") < 50, "tooFewRows").when(
        F.col("n_integer") / F.col("n") > 0.95, "dataTypeMismatch"
    )
    result = result_rows(
        df, test, flag_from_p(F.col("p")), F.col("p"),
        {"n": F.col("n"), "chi2": F.col("chi"), "df": F.when(F.col("stripped"), 8).otherwise(9)},
        na_cause=cause, na_observed=F.col("n"), na_minimum=50.0,
    )
    return Outcome(lambda: _digit_units(df, test, list(range(10)), [0.1] * 10), result)


def precision_levels(sheet: Sheet) -> DataFrame:
    """Per group and number of decimal places: observed count and the count a
    single fixed precision with stripped trailing zeros would leave."""
    c = cells(sheet.rows)
    tidy = F.format_string("%.14e", F.col("x")).cast("double")
    source = F.coalesce(F.trim("raw"), plain_decimal(F.col("x")))
    noisy = F.length(F.regexp_replace(source, r"\D", "")) > 15
    text = F.when(noisy, plain_decimal(tidy)).otherwise(source)
    dp = (
        c.withColumn("_t", text).where(F.col("_t").contains("."))
        .groupBy(*KEY, decimal_places(F.col("_t")).alias("dp")).agg(F.count(F.lit(1)).alias("observed"))
    )
    tops = dp.groupBy(*KEY).agg(
        F.sum("observed").alias("total"), F.max("dp").alias("max_dp"), F.min("dp").alias("min_dp"),
        F.count(F.lit(1)).alias("n_levels"),
    )
    grid = tops.withColumn("dp", F.explode(F.sequence(F.lit(1), F.greatest("max_dp", F.lit(1)))))
    return (
        grid.join(dp, [*KEY, "dp"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .withColumn("expected_share", F.pow(F.lit(0.1), F.col("max_dp") - F.col("dp")) * 0.9)
        .withColumn("expected", F.col("expected_share") * F.col("total"))
    )


def decimal_precision(sheet: Sheet) -> Outcome:
    test = "Decimal Precision Consistency"
    levels = precision_levels(sheet)
    tested = (F.col("dp") < F.col("max_dp")) & (F.col("n_levels") > 1)
    levels = levels.withColumn(
        "raw_p", F.when(tested, special.binomial_lower("observed", "total", "expected_share"))
    )
    levels = bh_small(levels, KEY)
    sums = levels.groupBy(*KEY).agg(
        F.max("total").alias("total"), F.max("max_dp").alias("max_dp"),
        F.max("n_levels").alias("n_levels"), F.coalesce(F.min("adj_p"), F.lit(1.0)).alias("p"),
        F.count_if((F.col("observed") == 0) & (F.col("dp") > F.col("min_dp"))).alias("gaps"),
        F.max_by("dp", F.struct("observed", -F.col("dp"))).alias("modal_dp"),
    )
    every = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    n = F.coalesce(F.col("total"), F.lit(0))
    result = result_rows(
        every, test, flag_from_p(F.col("p")), F.col("p"),
        {"n": n, "max_dp": F.col("max_dp"), "modal_dp": F.col("modal_dp"),
         "levels": F.col("n_levels"), "gaps": F.col("gaps")},
        na_cause=F.when(n < 30, "tooFewRows"), na_observed=n, na_minimum=30.0,
    )
    return Outcome(
        lambda: unit_rows(
            levels, test, F.concat(F.col("dp"), F.lit(" places")), F.col("observed"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
        ),
        result,
    )


# ---------------------------------------------------------------- spikes

# Numpad-diagonal integers.
KEYPAD = [12, 23, 34, 45, 56, 67, 78, 89]
MAX_SPAN = 10_000


def spike_frequencies(sheet: Sheet) -> DataFrame:
    """Counts per (pass, length, key): whole integers, and the fractional digits
    of each cell bucketed by how many there are. Carries how dominated a key is
    by one full value."""
    c = cells(sheet.rows)
    whole = c.where(is_integer(F.col("x"))).select(
        *KEY, F.lit("full").alias("pass"), F.lit(0).alias("len"),
        F.col("x").cast("bigint").alias("key"), "x",
    )
    source = F.coalesce(F.trim("raw"), plain_decimal(F.col("x")))
    frac = c.withColumn("_f", F.regexp_extract(source, r"\.(\d{1,18})$", 1)).where(F.col("_f") != "")
    part = frac.select(
        *KEY, F.lit("digit").alias("pass"), F.length("_f").alias("len"),
        F.col("_f").cast("bigint").alias("key"), "x",
    )
    by_value = whole.unionByName(part).groupBy(*KEY, "pass", "len", "key", "x").agg(
        F.count(F.lit(1)).alias("_c")
    )
    return by_value.groupBy(*KEY, "pass", "len", "key").agg(
        F.sum("_c").alias("obs"), F.max("_c").alias("top"), F.count(F.lit(1)).alias("n_values")
    )


def _poisson_p(obs: Column, smoothed: Column) -> Column:
    lam = F.greatest(smoothed, F.lit(0.1))
    bulk = let((obs - lam) / F.sqrt(lam), lambda z: F.when(z > 0, normal_sf(z)).otherwise(F.lit(1.0)))
    return F.when(lam > 30, bulk).when(obs <= 0, F.lit(1.0)).otherwise(
        special.poisson_tail(obs.cast("double"), F.least(lam, F.lit(30.0)))
    )


def spike_neighbourhoods(sheet: Sheet) -> DataFrame:
    """Each tested key with its count and the mean count of its neighbours.

    Buckets of span up to 10,000 are scanned on the full grid of keys; a wider
    fractional bucket is scanned at its distinct keys, in blocks of the key
    range, so no task holds a whole bucket.
    """
    freq = materialize(spike_frequencies(sheet), "frequencies")
    sizes = sheet_sizes(sheet.rows).withColumn("n_cells", F.col("n_rows") * F.col("n_cols"))
    counts = cells(sheet.rows).groupBy(*KEY).agg(F.count("x").alias("n_values_all"))
    buckets = freq.groupBy(*KEY, "pass", "len").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n_keys"),
        F.sum("obs").alias("bucket_n"),
    )
    share = buckets.groupBy(*KEY, "pass").agg(F.sum("bucket_n").alias("pass_n"))
    buckets = buckets.join(share, [*KEY, "pass"]).join(sizes, KEY).join(counts, KEY)
    span = F.col("hi") - F.col("lo")
    keyspace = F.pow(F.lit(10.0), F.col("len"))
    lam = F.col("bucket_n") / keyspace
    at_least_three = F.lit(1.0) - F.exp(-lam) * (1 + lam + lam * lam / 2)
    # The difference cancels for tiny rates; the leading series term does not.
    at_least_three = F.when(lam < 1e-3, lam * lam * lam / 6 * (1 - 0.75 * lam)).otherwise(at_least_three)
    buckets = (
        buckets.withColumn("span", span)
        .withColumn("half", F.when(span > 200, 5).otherwise(3))
        .withColumn("deep_enough", (F.col("pass") == "digit") & (keyspace * at_least_three < ALPHA_MODERATE))
    )
    usable = F.when(
        F.col("pass") == "full",
        (F.col("n_values_all") >= 100) & (F.col("pass_n") / F.col("n_values_all") >= 0.8)
        & (span <= MAX_SPAN),
    ).otherwise((F.col("pass_n") / F.col("n_cells") >= 0.5) & ((span <= MAX_SPAN) | F.col("deep_enough")))
    buckets = buckets.where(usable & (F.col("n_keys") >= 20)).select(
        *KEY, "pass", "len", "lo", "hi", "span", "half", "deep_enough"
    )
    # Written, the buckets are known to be few: keys aren't dealt by bucket to meet them.
    buckets = materialize(buckets, "spike-buckets")
    unit = [*KEY, "pass", "len"]
    grid = buckets.where(F.col("span") <= MAX_SPAN).select(
        *unit, F.explode(F.sequence("lo", "hi")).alias("key")
    )
    wide = freq.join(buckets.where(F.col("span") > MAX_SPAN).select(*unit), unit).select(*unit, "key")
    keys = grid.unionByName(wide).join(freq, [*unit, "key"], "left").join(buckets, unit)
    keys = keys.withColumn("obs", F.coalesce("obs", F.lit(0)))
    spread, window, own = with_halo(keys, unit, "key", before=5, after=5)
    near5 = F.sum("obs").over(window.rangeBetween(-5, 5))
    near3 = F.sum("obs").over(window.rangeBetween(-3, 3))
    around = F.when(F.col("half") == 5, near5).otherwise(near3) - F.col("obs")
    n_near = F.least(F.col("key") + F.col("half"), F.col("hi")) - F.greatest(
        F.col("key") - F.col("half"), F.col("lo")
    )
    return (
        spread.withColumn("_near", around).where(own).drop("_blk")
        .withColumn("n_near", n_near).where(F.col("n_near") >= 2)
        .withColumn("smoothed", F.col("_near") / F.col("n_near"))
        .where(~((F.col("smoothed") < 0.5) & (F.col("obs") < 3)))
        .where((F.col("pass") == "digit") | (F.col("key") != 0))
        .withColumn("ratio", F.when(F.col("smoothed") > 0, F.col("obs") / F.col("smoothed")).otherwise(0.0))
        .withColumn("deep", F.col("span") > MAX_SPAN)
        .drop("_near")
    )


def value_frequency_spike(sheet: Sheet) -> Outcome:
    test = "Value-Frequency Spike"
    tested = spike_neighbourhoods(sheet).withColumn("raw_p", _poisson_p(F.col("obs"), F.col("smoothed")))
    tested = materialize(tested, "spikes")
    adjusted = bh_large(tested, [*KEY, "deep"])
    effect = F.when(F.col("pass") == "full", F.col("ratio") >= 2.0).otherwise(
        (F.col("ratio") >= 2.0) | (F.col("smoothed") == 0)
    )
    near_dup = (F.col("pass") == "full") | F.col("deep_enough") | (
        (F.col("top") / F.col("obs") >= 0.5) & (F.col("n_values") <= 5)
    )
    spike = F.coalesce((F.col("adj_p") < ALPHA_MODERATE) & effect & near_dup, F.lit(False))
    marked = materialize(adjusted.withColumn("spike", spike), "spikes-adjusted")
    best = {
        kind: F.coalesce(F.min(F.when(F.col("spike") & (F.col("pass") == kind), F.col("adj_p"))), F.lit(1.0))
        for kind in ("full", "digit")
    }
    sums = marked.groupBy(*KEY).agg(
        best["full"].alias("p_full"), best["digit"].alias("p_digit"),
        F.count_if(F.col("spike")).alias("n_spikes"), F.count(F.lit(1)).alias("n_tested"),
        F.count_if(F.col("spike") & (F.col("pass") == "full") & F.col("key").isin(KEYPAD)).alias("keypad"),
        F.count_if(F.col("spike") & (F.col("pass") == "full")).alias("n_full"),
    )
    every = sheet_sizes(sheet.rows).join(sums, KEY, "left")
    flag = stronger_flag(flag_from_p(F.col("p_full")), flag_from_p(F.col("p_digit")))
    result = result_rows(
        every, test, flag, F.least("p_full", "p_digit"),
        {"n_tested": F.col("n_tested"), "n_spikes": F.col("n_spikes"),
         "keypad_pattern": F.when((F.col("keypad") >= 3) & (F.col("n_full") >= 3), 1).otherwise(0)},
        na_cause=F.when(F.col("n_tested").isNull(), "dataTypeMismatch"),
    )
    return Outcome(
        lambda: unit_rows(
            marked.where("spike"), test,
            F.concat_ws(" ", "pass", F.when(F.col("pass") == "full", F.col("key").cast("string")).otherwise(
            F.lpad(F.col("key").cast("string"), F.col("len"), "0"))),
            F.col("ratio"), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
        ),
        result,
    )


__all__ = [
    "benford_first", "benford_second", "decimal_precision", "decimal_text", "digit_counts",
    "precision_levels", "spike_neighbourhoods", "terminal_digit", "value_frequency_spike",
]
