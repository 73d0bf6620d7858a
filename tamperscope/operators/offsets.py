"""Columns that are shifted or scaled copies of one another over some rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_small
from tamperscope.functions.rows import cells, pair_label, pair_values, sheet_sizes
from tamperscope.functions.stats import ALPHA_HIGH, flag_from_p
from tamperscope.functions.values import round_half_up
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import with_halo
from tamperscope.operators.replicates import size_cause
from tamperscope.operators.resample import gather, permutation_exceedances
from tamperscope.session import materialize

UNIT = [*KEY, "kind", "c1", "c2"]


def _with_kinds(rows: DataFrame, sheet: Sheet) -> DataFrame:
    """``rows`` with the columns whose values are all above zero."""
    lows = cells(sheet.rows).groupBy(*KEY, "col").agg(F.min("x").alias("low")).where("low > 0").select(*KEY, "col")
    positive = materialize(lows.groupBy(*KEY).agg(F.collect_set("col").alias("positive")), "positive-columns")
    return rows.join(positive, KEY, "left")


def _kinds() -> Column:
    """Kinds of differences that a pair has."""
    scaled = F.array_contains("positive", F.col("c1")) & F.array_contains("positive", F.col("c2"))
    return F.when(F.coalesce(scaled, F.lit(False)), F.array(F.lit("additive"), F.lit("multiplicative"))).otherwise(
        F.array(F.lit("additive")))


def _difference(a: Column, b: Column) -> Column:
    return round_half_up(F.when(F.col("kind") == "additive", a - b).otherwise(F.log(a) - F.log(b)) * 10000.0)


def difference_keys(sheet: Sheet) -> DataFrame:
    """Differences at four decimals, additive and, for column pairs without a
    value at or below zero, of the logarithms."""
    pairs = pair_values(_with_kinds(sheet.rows, sheet), "positive").withColumn("kind", F.explode(_kinds()))
    return pairs.select(*UNIT, "row_idx", _difference(F.col("a"), F.col("b")).alias("d"))


def equal_steps(sheet: Sheet) -> DataFrame:
    """Differences as above, and whether the row before (``prev_row``) has the
    pair, too (``adjacent``), and the same difference, not zero (``hit``).

    Rows meet the row before them while they still hold all columns, so the
    pairs, of which there are many times as many, are never shuffled."""
    rows = _with_kinds(sheet.rows.select(*KEY, "row_idx", "vals"), sheet)
    spread, window, own = with_halo(rows, KEY, "row_idx", before=1)
    before = F.when(F.lag("row_idx").over(window) == F.col("row_idx") - 1, F.lag("vals").over(window))
    met = spread.withColumn("_before", before).where(own).drop("_blk")
    each = pair_values(met, "positive", "_before").withColumn("kind", F.explode(_kinds())).select(
        *UNIT, "row_idx", _difference(F.col("a"), F.col("b")).alias("d"),
        _difference(F.get("_before", F.col("c1")), F.get("_before", F.col("c2"))).alias("prev"))
    return each.select(
        "*", (F.col("row_idx") - 1).alias("prev_row"), F.col("prev").isNotNull().alias("adjacent"),
        F.coalesce((F.col("d") == F.col("prev")) & (F.col("d") != 0), F.lit(False)).alias("hit"))


def offset_counts(sheet: Sheet) -> DataFrame:
    """Observed and expected equal steps per pair and kind.

    Under a shuffle two given rows hold the same non-zero difference with
    chance sum c(c-1) / n(n-1) over the difference counts c.
    """
    each = equal_steps(sheet).groupBy(*UNIT, "d").agg(
        F.count("d").alias("c"), F.count_if("adjacent").alias("steps"), F.count_if("hit").alias("blocks"))
    c = F.col("c").cast("double")
    sums = each.groupBy(*UNIT).agg(
        F.sum("c").alias("n"), F.sum("steps").alias("steps"), F.sum("blocks").alias("blocks"),
        F.sum(F.when(F.col("d") != 0, c * (c - 1))).alias("cc"))
    n = F.col("n").cast("double")
    share = F.when(n > 1, F.coalesce("cc", F.lit(0.0)) / (n * (n - 1))).otherwise(0.0)
    return sums.withColumn("expected", F.col("steps") * share).drop("cc")


def _shuffled_blocks(rec: dict, order: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    d, rows = rec["d"], rec["row_idx"]
    v = d[order]
    near = np.diff(rows) == 1
    return ((v[:, 1:] == v[:, :-1]) & (v[:, 1:] != 0) & near).sum(axis=1, keepdims=True)


def _draws(n: int) -> int:
    return 999 if n <= 1000 else 499


def constant_offset(sheet: Sheet) -> Outcome:
    test = "Constant-Offset Blocks"
    counts = materialize(offset_counts(sheet), "offset-counts")
    keys = difference_keys(sheet).withColumn("d", F.col("d").cast("double"))

    @F.pandas_udf("array<double>")
    def as_array(b: pd.Series) -> pd.Series:
        return pd.Series([[float(v)] for v in b])

    small = gather(keys, UNIT, "row_idx", ["d"]).join(counts.select(*UNIT, "blocks"), UNIT)
    null = permutation_exceedances(
        small.withColumn("obs", as_array("blocks")), UNIT, test=test, seed=sheet.settings.seed, draws=_draws,
        statistic=_shuffled_blocks, array_columns=["d", "row_idx"], observed="obs",
    )
    tail = special.poisson_tail(F.col("blocks").cast("double"), "expected")
    pairs = counts.join(null, UNIT, "left").withColumn(
        "raw_p", F.when(F.col("blocks") == 0, 1.0).otherwise(
            F.coalesce((F.col("exceed")[0] + 1) / (F.col("n_draws") + 1), tail))
    )
    pairs = materialize(bh_small(pairs, [*KEY, "kind"]), "offset-pairs")
    kinds = pairs.groupBy(*KEY, "kind").agg(
        F.sum("blocks").alias("blocks"), F.sum("steps").alias("steps"), F.sum("expected").alias("expected"),
        F.min("adj_p").alias("pair_p"), F.max("n_draws").alias("n_draws"), F.count(F.lit(1)).alias("n_pairs"),
        F.max("raw_p").alias("only_p"),
    )
    # Pairs are shuffled independently, so their counts add up to a Poisson.
    total_p = special.poisson_tail(F.col("blocks").cast("double"), "expected")
    kinds = kinds.withColumn("p", F.when(F.col("n_pairs") == 1, F.col("only_p")).otherwise(total_p))
    best = kinds.groupBy(*KEY).agg(
        F.min_by(F.struct("kind", "blocks", "steps", "expected", "p", "pair_p", "n_draws"),
                 F.struct("p", "kind")).alias("b")
    ).select(*KEY, "b.*")
    df = sheet_sizes(sheet.rows).join(best, KEY, "left")
    rate = F.col("blocks") / F.greatest("steps", F.lit(1))
    gated = (F.col("n_rows") >= 500) & (rate < 0.01)
    own = flag_from_p(F.col("p"))
    flag = F.when(gated, "LOW").when((own == "LOW") & (F.col("pair_p") < ALPHA_HIGH), "MODERATE").otherwise(own)
    cause, seen, need = size_cause(2, 4)
    result = result_rows(
        df, test, flag, F.col("p"),
        {"blocks": F.col("blocks"), "steps": F.col("steps"), "expected": F.col("expected"),
         "multiplicative": (F.col("kind") == "multiplicative").cast("int"), "pair_p": F.col("pair_p")},
        na_cause=cause.when(F.col("p").isNull(), "emptyInput"), na_observed=seen, na_minimum=need,
        null_method=F.when(F.col("n_draws").isNotNull(), "row shuffle and Poisson").otherwise("Poisson"),
    )
    hits = equal_steps(sheet).where("hit")
    return Outcome(
        lambda: unit_rows(
            pairs, test, F.concat_ws(" ", "kind", pair_label()), F.col("blocks"), raw_p=F.col("raw_p"),
            adj_p=F.col("adj_p"), cols=F.array("c1", "c2"),
        ).unionByName(unit_rows(
            hits, test, F.concat_ws(" ", "kind", F.lit("step"), pair_label()), F.col("d") / 10000.0,
            row_lo=F.col("prev_row"), row_hi=F.col("row_idx"), cols=F.array("c1", "c2"),
        )),
        result,
    )
