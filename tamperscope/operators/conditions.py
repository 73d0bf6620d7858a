"""Conditions that are too alike, too balanced, or noisy in the same places."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_small
from tamperscope.functions.rows import cells, mean, present, sheet_sizes, with_row_stats
from tamperscope.functions.stats import (
    ALPHA_HIGH, fisher_z, flag_from_p, kolmogorov_sf, normal_sf,
)
from tamperscope.model import ALL, KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import dense_position, lagged, ordinal, prefix_sum
from tamperscope.operators.resample import generator
from tamperscope.session import materialize

PAIR = ["dataset_id", "a", "b"]


def average_ranks(df: DataFrame, unit: list[str], column: str, out: str) -> DataFrame:
    """Rank of each distinct value in its unit, ties sharing their mean rank.
    Ranks are running totals over the sorted table of distinct values."""
    freq = df.groupBy(*unit, column).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    placed = prefix_sum(ordinal(freq, unit, [column], "_p", "ranks"), unit, "_c", "_b", pos="_p")
    return placed.select(*unit, column, (F.col("_b") - (F.col("_c") - 1) / 2).alias(out))


def condition_profiles(sheet: Sheet) -> DataFrame:
    """Row means per condition with the key that matches rows across
    conditions: the subject where subjects recur, else the position."""
    rows = sheet.rows.where(F.col("cond").isNotNull()).withColumn("y", mean(present("vals"))).where(
        F.col("y").isNotNull()
    )
    placed = dense_position(rows.select("dataset_id", "cond", "subject", "row_idx", "vals", "y"),
                            ["dataset_id", "cond"], "row_idx")
    shared = placed.groupBy("dataset_id", "subject").agg(F.count_distinct("cond").alias("k")).groupBy(
        "dataset_id"
    ).agg(F.max(F.when(F.col("subject").isNotNull(), F.col("k"))).alias("most"))
    # Written, its size is known: rows aren't dealt by dataset to meet it.
    shared = materialize(shared, "shared-subjects")
    key = F.when(F.col("most") > 1, F.concat(F.lit("s:"), "subject")).otherwise(F.concat(F.lit("p:"), "pos"))
    return placed.join(shared, "dataset_id").withColumn("match", key).drop("most")


def matched_pairs(profiles: DataFrame, column: str) -> DataFrame:
    """Values of the same row in two conditions, for every condition pair.

    Rows meet by grouping on their match key, which holds one entry per
    condition, so the list is bounded by the number of conditions.
    """
    together = profiles.where(F.col("match").isNotNull()).groupBy("dataset_id", "match").agg(
        F.array_sort(F.collect_list(F.struct("cond", F.col(column).alias("v"), "row_idx"))).alias("e")
    ).where(F.size("e") >= 2)
    pairs = F.flatten(F.transform("e", lambda p: F.transform(
        F.filter("e", lambda q: q["cond"] > p["cond"]),
        lambda q: F.struct(p["cond"].alias("a"), q["cond"].alias("b"), p["v"].alias("x"), q["v"].alias("y"),
                           p["row_idx"].alias("row_a"), q["row_idx"].alias("row_b")),
    )))
    return together.select("dataset_id", F.explode(pairs).alias("p")).select("dataset_id", "p.*")


# ------------------------------------------------- F26 rank correlation

def pair_spearman(profiles: DataFrame, column: str, minimum: int) -> DataFrame:
    """Spearman correlation of a profile column for every condition pair."""
    pairs = materialize(matched_pairs(profiles, column), "matched")
    big = pairs.groupBy(*PAIR).agg(F.count("x").alias("n")).where(F.col("n") >= minimum)
    pairs = pairs.join(materialize(big, "condition-pairs"), PAIR)
    # Both sides are ranked in one sort, then meet their rows by value.
    sides = pairs.select(*PAIR, F.explode(F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v"))
    )).alias("s")).select(*PAIR, "s.*")
    ranks = materialize(average_ranks(sides, [*PAIR, "side"], "v", "rank"), "ranks")
    ranked = pairs.join(
        ranks.where("side = 'x'").select(*PAIR, F.col("v").alias("x"), F.col("rank").alias("rx")), [*PAIR, "x"]
    ).join(ranks.where("side = 'y'").select(*PAIR, F.col("v").alias("y"), F.col("rank").alias("ry")), [*PAIR, "y"])
    return ranked.groupBy(*PAIR).agg(
        F.max("n").alias("n"), F.coalesce(F.nanvl(F.corr("rx", "ry"), F.lit(0.0)), F.lit(0.0)).alias("rho")
    )


def rank_correlation(sheet: Sheet) -> Outcome:
    test = "Cross-Condition Rank Correlation"
    pairs = materialize(pair_spearman(condition_profiles(sheet), "y", 5), "spearman")
    held = F.greatest(F.least(F.col("rho"), F.lit(0.9999)), F.lit(-0.9999))
    pairs = pairs.withColumn("fz", fisher_z(held))
    sums = pairs.groupBy("dataset_id").agg(
        F.sum("fz").alias("_sum"), F.count("fz").alias("k"), F.min_by("n", F.struct("a", "b")).alias("n0")
    )
    pairs = pairs.join(sums, "dataset_id").where("k >= 4")
    se = F.sqrt(F.col("k") / (F.col("k") - 1)) / F.sqrt(F.greatest(F.col("n0") - 3, F.lit(1)))
    pairs = pairs.withColumn("others", (F.col("_sum") - F.col("fz")) / (F.col("k") - 1)).withColumn(
        "z", (F.col("fz") - F.col("others")) / se
    ).withColumn("raw_p", F.when(F.col("z") > 0, normal_sf(F.col("z"))).otherwise(1.0))
    pairs = bh_small(pairs, ["dataset_id"])
    best = pairs.groupBy("dataset_id").agg(
        F.min("adj_p").alias("p"), F.tanh(F.avg("fz")).alias("mean_rho"),
        F.count_if(F.col("adj_p") < ALPHA_HIGH).alias("n_suspicious"),
    )
    df = sheet_sizes(sheet.rows).join(sums.drop("_sum"), "dataset_id", "left").join(best, "dataset_id", "left")
    flag = flag_from_p(F.col("p"))
    cause = F.when(F.col("k").isNull(), "tooFewConditions").when(F.col("k") < 4, "premiseVoid")
    result = result_rows(
        df, test, F.when(flag == "HIGH", "MODERATE").otherwise(flag), F.col("p"),
        {"pairs": F.col("k"), "mean_rho": F.col("mean_rho"), "suspicious": F.col("n_suspicious")},
        na_cause=cause, na_observed=F.coalesce("k", F.lit(0)), na_minimum=F.when(F.col("k").isNull(), 2).otherwise(4),
    )
    return Outcome(
        lambda: unit_rows(
            pairs.withColumn("grp", F.lit(ALL)), test, F.concat_ws(" vs ", "a", "b"), F.col("rho"),
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
        ),
        result,
    )


# -------------------------------------------- F04 residual spikes

SPIKE_DRAWS = 999


def spike_profiles(sheet: Sheet) -> DataFrame:
    """Mean absolute residual of each row, z-scored in its condition, over as
    many rows as the smallest condition has, with its rank from the top."""
    profiles = condition_profiles(sheet)
    sizes = profiles.groupBy("dataset_id", "cond").agg(F.count("y").alias("_n"))
    least = sizes.groupBy("dataset_id").agg(F.min("_n").alias("n_rows"), F.count("cond").alias("n_cond"))
    xs = present("vals")
    spread = F.when(F.size(xs) >= 2, F.aggregate(
        xs, F.lit(0.0), lambda a, v: a + F.abs(v - F.col("y"))) / F.size(xs))
    rows = profiles.join(materialize(least, "least-conditions"), "dataset_id").where(
        (F.col("pos") < F.col("n_rows")) & (F.col("n_rows") >= 10) & (F.col("n_cond") >= 2)
    ).withColumn("mar", spread)
    level = rows.groupBy("dataset_id", "cond").agg(
        F.coalesce(F.avg("mar"), F.lit(1.0)).alias("_m"), F.stddev_samp("mar").alias("_s")
    )
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    z = rows.join(materialize(level, "residual-levels"), ["dataset_id", "cond"]).withColumn("z", (F.col("mar") - F.col("_m")) / sd).drop("_m", "_s", "vals")
    ranked = ordinal(z, ["dataset_id", "cond"], [F.col("z").desc_nulls_last(), "pos"], "rank", "spikes")
    return ranked.withColumn("top_k", F.greatest(F.lit(5), F.floor(F.col("n_rows") * 0.10)))


def spike_overlaps(sheet: Sheet) -> DataFrame:
    """How many of the noisiest rows two conditions share."""
    return _overlaps(spike_profiles(sheet))


def _overlaps(profiles: DataFrame) -> DataFrame:
    top = profiles.where(F.col("rank") < F.col("top_k"))
    shared = matched_pairs(top, "z").groupBy(*PAIR).agg(F.count("x").alias("overlap"))
    sizes = profiles.groupBy("dataset_id").agg(
        F.max("n_rows").alias("n_rows"), F.max("top_k").alias("top_k"), F.collect_set("cond").alias("conds")
    )
    every = F.flatten(F.transform("conds", lambda p: F.transform(
        F.filter("conds", lambda q: q > p), lambda q: F.struct(p.alias("a"), q.alias("b")))))
    grid = sizes.select("dataset_id", "n_rows", "top_k", F.size("conds").alias("n_cond"), F.explode(every).alias("p")).select(
        "dataset_id", "n_rows", "top_k", "n_cond", "p.*"
    )
    return grid.join(shared, PAIR, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn(
        "expected", F.col("top_k") * F.col("top_k") / F.col("n_rows")
    )


def residual_spike(sheet: Sheet) -> Outcome:
    """The null depends only on sizes: random top sets of the same size."""
    test = "Residual Spike Correlation"
    seed = sheet.settings.seed
    profiles = materialize(spike_profiles(sheet), "spike-profiles")
    overlaps = materialize(_overlaps(profiles), "overlaps")
    best = overlaps.groupBy("dataset_id", "n_rows", "top_k", "n_cond").agg(F.max("overlap").alias("overlap"))

    @F.pandas_udf("double")
    def p_value(ds: pd.Series, n: pd.Series, k: pd.Series, conds: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for d, rows, top, c, o in zip(ds, n, k, conds, seen, strict=True):
            rng = generator(seed, test, d)
            rows, top, c = int(rows), int(top), int(c)
            if rows <= 5000 and c <= 64:
                hits = 0
                for _ in range(SPIKE_DRAWS):
                    mask = np.zeros((c, rows), dtype=np.float32)
                    for i in range(c):
                        mask[i, rng.choice(rows, top, replace=False)] = 1
                    both = np.triu(mask @ mask.T, 1)
                    hits += both.max() >= o
            else:
                draws = rng.hypergeometric(top, rows - top, top, size=(SPIKE_DRAWS, c * (c - 1) // 2))
                hits = int((draws.max(axis=1) >= o).sum())
            out.append((hits + 1) / (SPIKE_DRAWS + 1))
        return pd.Series(out, dtype=float)

    best = best.withColumn("p", p_value("dataset_id", "n_rows", "top_k", "n_cond", "overlap")).withColumnRenamed(
        "n_rows", "n_used")
    n_cond = sheet.rows.groupBy("dataset_id").agg(F.count_distinct("cond").alias("conditions"))
    df = sheet_sizes(sheet.rows).join(n_cond, "dataset_id").join(best, "dataset_id", "left")
    cause = F.when(F.lit(sheet.settings.paired), "subjectsSharedAcrossConditions").when(
        F.col("conditions") < 2, "premiseVoid"
    ).when(F.col("p").isNull(), "tooFewRows")
    result = result_rows(
        df, test, flag_from_p(F.col("p")), F.col("p"),
        {"overlap": F.col("overlap"), "top_k": F.col("top_k"), "rows": F.col("n_used"), "conditions": F.col("n_cond")},
        na_cause=cause, na_observed=F.col("n_rows"), na_minimum=10.0, null_method="random subsets",
    )
    rho = pair_spearman(profiles.where(F.col("z").isNotNull()), "z", 10)
    return Outcome(
        lambda: unit_rows(
            overlaps.join(rho.select(*PAIR, "rho"), PAIR, "left").withColumn("grp", F.lit(ALL)), test,
            F.concat_ws(" vs ", "a", "b"), F.col("overlap"),
        ).unionByName(unit_rows(
            rho.withColumn("grp", F.lit(ALL)), test, F.concat(F.lit("rho "), F.concat_ws(" vs ", "a", "b")), F.col("rho"),
        )),
        result,
    )


# ------------------------------------------------------- F27 baseline balance

def feature_anova(values: DataFrame, feature: list[str], minimum: int) -> DataFrame:
    """One-way ANOVA of ``x`` across conditions for each feature."""
    groups = values.groupBy("dataset_id", *feature, "cond").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    ).where(F.col("n") >= minimum)
    sums = groups.groupBy("dataset_id", *feature).agg(
        F.count("n").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_g"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.collect_list(F.struct("n", "m")).alias("_e"),
    ).where((F.col("k") >= 2) & (F.col("n") > F.col("k")))
    between = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["n"] * (e["m"] - F.col("_g")) * (e["m"] - F.col("_g")))
    f = F.when(F.col("within") > 0, (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))))
    return sums.withColumn("f", f).where(F.col("f").isNotNull()).drop("_g", "_e", "within")


def balance_features(sheet: Sheet) -> DataFrame:
    """Columns as features where conditions are rows; subjects as features
    where conditions are column groups of the same row."""
    c = cells(sheet.rows, "cond", "subject").where(F.col("cond").isNotNull())
    if sheet.settings.column_relationship == "conditions":
        return feature_anova(c, ["subject"], 2).withColumnRenamed("subject", "feature")
    return feature_anova(c, ["col"], 3).withColumnRenamed("col", "feature")


def baseline_balance(sheet: Sheet) -> Outcome:
    test = "Baseline Balance"
    features = balance_features(sheet).withColumn(
        "p", special.f_tail("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    ).withColumn("grp", F.lit(ALL)).withColumn("feature", F.col("feature").cast("string"))
    features = materialize(features, "features")
    sizes = features.groupBy("dataset_id").agg(
        F.count("p").alias("n_features"), F.count_if(F.col("p") < 0.05).alias("n_sig"),
        F.count_if(F.col("p") > 0.95).alias("n_excess"),
    )
    placed = ordinal(features.select("dataset_id", "p"), ["dataset_id"], ["p"], "i", "balance").join(sizes, "dataset_id")
    n = F.col("n_features")
    ks = placed.groupBy("dataset_id").agg(
        F.max(F.greatest(F.abs((F.col("i") + 1) / n - F.col("p")), F.abs(F.col("p") - F.col("i") / n))).alias("ks")
    )
    n_cond = sheet.rows.groupBy("dataset_id").agg(F.count_distinct("cond").alias("conditions"))
    df = sheet_sizes(sheet.rows).join(n_cond, "dataset_id").join(sizes, "dataset_id", "left").join(ks, "dataset_id", "left")
    z = (F.col("n_excess") - 0.5 - n * 0.05) / F.sqrt(n * 0.05 * 0.95)
    df = df.withColumn("binom_p", F.when(F.col("n_excess") == 0, 1.0).otherwise(normal_sf(z))).withColumn(
        "ks_p", kolmogorov_sf(F.col("ks") * F.sqrt(n))
    ).withColumn("p", F.least("binom_p", "ks_p"))
    columns = F.lit(sheet.settings.column_relationship != "conditions")
    few = F.coalesce(n, F.lit(0))
    cause = F.when(F.col("conditions") < 2, "tooFewConditions").when(
        columns & (F.col("n_cols") < 5), "tooFewColumns").when(
        ~columns & (F.col("n_rows") < 10), "tooFewRows").when(few < 5, "tooFewColumns").when(
        F.col("n_sig") / n > 0.50, "premiseVoid")
    flag = F.when(F.col("n_excess") / n < 0.50, "LOW").otherwise(flag_from_p(F.col("p")))
    result = result_rows(
        df, test, flag, F.col("p"),
        {"features": n, "excess": F.col("n_excess"), "significant": F.col("n_sig"), "ks": F.col("ks"),
         "binom_p": F.col("binom_p"), "ks_p": F.col("ks_p")},
        na_cause=cause, na_observed=F.when(F.col("conditions") < 2, F.col("conditions")).otherwise(few),
        na_minimum=F.when(F.col("conditions") < 2, 2).otherwise(5),
    )
    return Outcome(lambda: unit_rows(features, test, F.concat(F.lit("feature "), "feature"), F.col("f"), raw_p=F.col("p")), result)


# -------------------------------------------- F28 cross-condition consistency

BINS = 512
GROUPS = 2048
DRAWS = 999
LN10 = math.log(10.0)
COND = ["dataset_id", "cond"]

# Property -> (stage, smallest condition, directions that count,
# effect threshold for "different").
PROPERTIES = {
    "P1": (1, 30, ("similar",), 0.1), "P2": (1, 30, ("similar",), 0.2), "P3": (1, 30, ("similar",), 0.1),
    "P4": (2, 30, ("similar", "different"), 0.5), "P5": (2, 50, ("similar", "different"), None),
    "P6": (2, 100, ("similar", "different"), 1.0), "P9": (3, 0, ("similar", "different"), 0.5),
}


def order_statistics(df: DataFrame, unit: list[str], column: str, fractions: dict[str, float], name: str) -> DataFrame:
    """Linearly interpolated quantiles at any size: one range sort gives every
    value its position and only the wanted positions are kept."""
    # Written, the sizes are known to be small: values aren't dealt by unit to meet them.
    sizes = materialize(df.groupBy(*unit).agg(F.count(column).alias("_n")), f"{name}-sizes")
    placed = ordinal(df.select(*unit, column), unit, [column], "_p", name).join(sizes, unit)
    wanted = F.lit(False)
    for f in fractions.values():
        at = (F.col("_n") - 1) * F.lit(f)
        wanted = wanted | (F.col("_p") == F.floor(at)) | (F.col("_p") == F.ceil(at))
    aggs = []
    for label, f in fractions.items():
        at = (F.col("_n") - 1) * F.lit(f)
        low = F.max(F.when(F.col("_p") == F.floor(at), F.col(column)))
        high = F.max(F.when(F.col("_p") == F.ceil(at), F.col(column)))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(label))
    return placed.where(wanted).groupBy(*unit).agg(F.max("_n").alias("n"), *aggs)


def _residuals(sheet: Sheet) -> DataFrame:
    rows = with_row_stats(sheet.rows.where(F.col("cond").isNotNull())).where(F.col("n_vals") >= 2)
    e = F.transform("vals", lambda v: v - F.col("row_mean"))
    return rows.select(*COND, "row_idx", F.posexplode(e).alias("rep", "e")).where(F.col("e").isNotNull())


def _lag_correlation(sheet: Sheet) -> DataFrame:
    """Residual lag-1 correlation per replicate, averaged as Fisher z."""
    unit = [*COND, "rep"]
    series = dense_position(_residuals(sheet), unit, "row_idx")
    r = lagged(series, unit, "e", [1]).where(F.col("e_lag1").isNotNull()).groupBy(*unit).agg(
        F.count("e").alias("_n"), F.corr("e_lag1", "e").alias("r")
    ).where((F.col("_n") >= 2) & F.col("r").isNotNull() & ~F.isnan("r"))
    held = F.greatest(F.least(F.col("r"), F.lit(0.999999)), F.lit(-0.999999))
    return r.groupBy(*COND).agg(
        F.avg(fisher_z(held)).alias("lag_z"), F.count("r").alias("n_reps"), (F.min("_n") + 1).alias("n_series")
    )


def _mean_variance(rows: DataFrame) -> DataFrame:
    stats = with_row_stats(rows.where(F.col("cond").isNotNull())).where(
        (F.col("n_vals") >= 3) & (F.col("row_mean") > 0) & (F.col("row_var") > 0)
    )
    return stats.select(*COND, "row_idx", F.log("row_mean").alias("lm"), F.log("row_var").alias("lv"))


def condition_properties(sheet: Sheet, original: Sheet | None = None) -> DataFrame:
    """Observed statistics of each condition."""
    c = cells(sheet.rows, "cond").where(F.col("cond").isNotNull()).select(*COND, "x")
    q = order_statistics(c, COND, "x", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, "cond-quantiles")
    q = materialize(q, "cond-quantile-table")
    dev = c.join(q.select(*COND, "q50"), COND).withColumn("dev", F.abs(F.col("x") - F.col("q50")))
    mad = order_statistics(dev, COND, "dev", {"mad": 0.5}, "cond-deviations").drop("n")
    rows = with_row_stats(sheet.rows.where(F.col("cond").isNotNull())).where(F.col("n_vals") >= 2)
    dof = rows.groupBy(*COND).agg(F.sum(F.col("n_vals") - 1).alias("dof"))
    res = _residuals(sheet).groupBy(*COND).agg(
        F.sum(F.col("e") * F.col("e")).alias("_s2"), F.sum(F.pow("e", F.lit(4))).alias("_s4"), F.count("e").alias("n_res")
    ).join(dof, COND).select(
        *COND, F.sqrt(F.col("_s2") / F.col("dof")).alias("resid_sd"),
        F.when(F.col("_s2") > 0, F.col("_s4") * F.col("n_res") / (F.col("_s2") * F.col("_s2")) - 3).alias("resid_kurt"),
    )
    slope = _mean_variance((original or sheet).rows).groupBy(*COND).agg(
        F.count("lm").alias("n_points"), (F.max("lm") - F.min("lm")).alias("log_span"),
        F.when(F.regr_sxx("lv", "lm") > 1e-20, F.regr_slope("lv", "lm")).alias("slope"),
    )
    return (
        q.withColumn("span", F.col("q95") - F.col("q05")).join(mad, COND, "left").join(res, COND, "left")
        .join(_lag_correlation(sheet), COND, "left").join(slope, COND, "left")
    )


def _binned(sheet: Sheet) -> DataFrame:
    """Rank bins of the pooled values: dataset, x, bin. Equal values share a
    bin; a sheet with fewer distinct values than bins is binned exactly."""
    freq = cells(sheet.rows, "cond").where(F.col("cond").isNotNull()).groupBy("dataset_id", "x").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    sizes = materialize(freq.groupBy("dataset_id").agg(F.sum("c").alias("_n"), F.count(F.lit(1)).alias("_d")), "pooled-sizes")
    placed = prefix_sum(ordinal(freq, ["dataset_id"], ["x"], "pos", "pooled"), ["dataset_id"], "c", "b").join(
        sizes, "dataset_id")
    by_rank = F.floor((F.col("b") - F.col("c")) * BINS / F.col("_n"))
    return placed.select(
        "dataset_id", "x", F.when(F.col("_d") <= BINS, F.col("pos")).otherwise(by_rank).cast("int").alias("bin"))


def _row_groups(sheet: Sheet) -> DataFrame:
    """Deals each condition's rows into random groups, 2048 per sheet in all.
    Up to 2048 rows every row is a group and the shuffle below is a row shuffle."""
    rows = sheet.rows.where(F.col("cond").isNotNull() & F.exists("vals", lambda v: v.isNotNull()))
    placed = dense_position(rows.select(*COND, "row_idx"), COND, "row_idx")
    sizes = rows.groupBy(*COND).agg(F.count(F.lit(1)).alias("_r"))
    total = sizes.groupBy("dataset_id").agg(F.sum("_r").alias("_t"))
    share = sizes.join(total, "dataset_id").withColumn(
        "_g", F.when(F.col("_t") <= GROUPS, F.col("_r")).otherwise(
            F.greatest(F.lit(1), F.floor(F.col("_r") * GROUPS / F.col("_t")))))
    before = Window.partitionBy("dataset_id").orderBy("cond").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumn("_from", F.coalesce(F.sum("_g").over(before), F.lit(0)))
    # Mixed deal: consecutive rows go to different groups, and each run of one
    # row per group starts at a hashed offset.
    lap = F.floor(F.col("pos") / F.col("_g"))
    turn = F.pmod(F.xxhash64(F.lit(sheet.settings.seed), "dataset_id", "cond", lap), F.col("_g"))
    number = F.col("_from") + F.pmod(F.col("pos") + turn, F.col("_g"))
    return placed.join(materialize(share, "row-group-shares"), COND).select(*COND, "row_idx", number.cast("int").alias("g"))


def permuted_distances(sheet: Sheet, original: Sheet | None = None) -> DataFrame:
    """Distances between conditions after groups of rows have been shuffled
    across them: dataset, property, a, b, ds ARRAY<DOUBLE>.

    Every row is summarised into the additive statistics of its group (counts
    per value bin, residual sums, regression sums); a shuffle then only adds up
    groups. What one task holds is bounded by 2048 groups of 512 bins.
    """
    groups = materialize(_row_groups(sheet), "row-groups")
    bins = materialize(_binned(sheet), "bins")
    c = cells(sheet.rows, "cond").where(F.col("cond").isNotNull()).select(*COND, "row_idx", "x")
    value = c.join(bins, ["dataset_id", "x"])
    centre = value.groupBy("dataset_id", "bin").agg(F.avg("x").alias("v")).groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("centres"))
    by_group = ["dataset_id", "g"]
    hist = value.join(groups, [*COND, "row_idx"]).groupBy(*by_group, "bin").agg(F.count("x").alias("c"))
    hist = hist.groupBy("dataset_id").agg(F.collect_list(F.struct("g", "bin", "c")).alias("h"))
    rows = with_row_stats(sheet.rows.where(F.col("cond").isNotNull())).where(F.col("n_vals") >= 1)
    e = F.transform(present("vals"), lambda v: v - F.col("row_mean"))
    many = F.col("n_vals") >= 2
    sums = rows.withColumn("_e", e).join(groups, [*COND, "row_idx"]).groupBy(*by_group, "cond").agg(
        F.sum(F.when(many, F.col("n_vals") - 1).otherwise(0)).cast("double").alias("dof"),
        F.sum(F.when(many, F.col("n_vals")).otherwise(0)).cast("double").alias("nres"),
        F.sum(F.when(many, F.aggregate("_e", F.lit(0.0), lambda a, v: a + v * v)).otherwise(0.0)).alias("s2"),
        F.sum(F.when(many, F.aggregate("_e", F.lit(0.0), lambda a, v: a + v * v * v * v)).otherwise(0.0)).alias("s4"),
    )
    mv = _mean_variance((original or sheet).rows).join(groups, [*COND, "row_idx"]).groupBy(*by_group).agg(
        F.count("lm").cast("double").alias("mn"), F.sum("lm").alias("mx"), F.sum("lv").alias("my"),
        F.sum(F.col("lm") * F.col("lm")).alias("mxx"), F.sum(F.col("lm") * F.col("lv")).alias("mxy"))
    names = ["dof", "nres", "s2", "s4", "mn", "mx", "my", "mxx", "mxy"]
    packed = sums.join(mv, by_group, "left").fillna(0.0, names).groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct("g", "cond", *names))).alias("s"))
    per_sheet = packed.join(hist, "dataset_id").join(centre, "dataset_id").select(
        "dataset_id", F.col("s.cond").alias("conds"), *[F.col(f"s.{n}").alias(n) for n in names],
        F.col("h.g").alias("hg"), F.col("h.bin").alias("hb"), F.col("h.c").alias("hc"),
        F.col("centres.v").alias("centres"), F.col("centres.bin").alias("bin_ids"),
    )
    chunk = 50
    tasks = per_sheet.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(DRAWS / chunk) - 1))))
    tasks = tasks.repartition(F.xxhash64("dataset_id", "chunk"))
    seed = sheet.settings.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                out += _permute(rec, min(chunk, DRAWS - rec["chunk"] * chunk), seed)
            yield pd.DataFrame(out, columns=["dataset_id", "property", "a", "b", "d"])

    parts = tasks.mapInPandas(run, "dataset_id string, property string, a string, b string, d array<double>")
    return parts.groupBy("dataset_id", "property", "a", "b").agg(
        F.array_sort(F.flatten(F.collect_list("d"))).alias("ds"))


def _permute(rec: dict, draws: int, seed: int) -> list[tuple]:
    conds = np.asarray(rec["conds"])
    names, first = np.unique(conds, return_index=True)
    sizes = np.bincount(np.searchsorted(names, conds))
    centres = np.asarray(rec["centres"], float)
    hist = np.zeros((len(conds), len(centres)))
    np.add.at(hist, (np.asarray(rec["hg"], int), np.searchsorted(rec["bin_ids"], rec["hb"])), np.asarray(rec["hc"], float))
    sums = np.stack([np.asarray(rec[n], float) for n in ("dof", "nres", "s2", "s4", "mn", "mx", "my", "mxx", "mxy")], 1)
    rng = generator(seed, "Cross-Condition Consistency", rec["dataset_id"], rec["chunk"])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    kept: dict[tuple, list] = {}
    for _ in range(draws):
        order = rng.permutation(len(conds))
        stats = []
        for k in range(len(names)):
            pick = order[edges[k]:edges[k + 1]]
            stats.append(_condition_stats(hist[pick].sum(axis=0), sums[pick].sum(axis=0), centres))
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                for prop in ("P1", "P2", "P4"):
                    x, y = abs(stats[i][prop]), abs(stats[j][prop])
                    if max(x, y) >= 1e-10:
                        d = abs(math.log(x) - math.log(y)) if min(x, y) >= 1e-10 else abs(x - y)
                        kept.setdefault((prop, i, j), []).append(d)
                kept.setdefault(("P3", i, j), []).append(
                    float(np.abs(stats[i]["cdf"] - stats[j]["cdf"]).max()))
                for prop in ("P6", "P9"):
                    d = abs(stats[i][prop] - stats[j][prop])
                    if math.isfinite(d):
                        kept.setdefault((prop, i, j), []).append(d)
    return [(rec["dataset_id"], p, str(names[i]), str(names[j]), d) for (p, i, j), d in kept.items()]


def _condition_stats(h: np.ndarray, s: np.ndarray, centres: np.ndarray) -> dict:
    c = np.cumsum(h)
    n = c[-1]

    def at(order: np.ndarray, cum: np.ndarray, f: float) -> float:
        place = f * (n - 1)
        lo = order[min(np.searchsorted(cum, math.floor(place), side="right"), len(order) - 1)]
        hi = order[min(np.searchsorted(cum, math.ceil(place), side="right"), len(order) - 1)]
        return lo + (hi - lo) * (place - math.floor(place))

    dev = np.abs(centres - at(centres, c, 0.5))
    by = np.argsort(dev)
    dof, nres, s2, s4, mn, mx, my, mxx, mxy = s
    sxx = mxx - mx * mx / mn if mn > 1 else 0.0
    return {
        "P1": at(centres, c, 0.95) - at(centres, c, 0.05), "P2": at(dev[by], np.cumsum(h[by]), 0.5),
        "cdf": c / max(n, 1), "P4": math.sqrt(s2 / dof) if dof > 0 else 0.0,
        "P6": s4 * nres / (s2 * s2) - 3 if s2 > 0 else math.nan,
        "P9": (mxy - mx * my / mn) / sxx if sxx > 1e-12 else math.nan,
    }


def observed_distances(sheet: Sheet, original: Sheet | None = None) -> DataFrame:
    """Distance of every property for every condition pair, with the facts its
    gates need."""
    props = condition_properties(sheet, original)
    c = cells(sheet.rows, "cond").where(F.col("cond").isNotNull()).select(*COND, "x")
    hist = c.join(_binned(sheet), ["dataset_id", "x"]).groupBy(*COND, "bin").agg(F.count("x").alias("c"))
    # One entry per bin and condition: at most 512 per condition.
    curves = hist.groupBy(*COND).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("c").cast("double")))).alias("hist"))
    packed = props.join(curves, COND).withColumn("_all", F.struct(
        "cond", "n", "span", "mad", "resid_sd", "resid_kurt", "lag_z", "n_reps", "n_series", "slope", "n_points",
        "log_span", "hist"))
    # One entry per condition and sheet.
    per_sheet = packed.groupBy("dataset_id").agg(F.collect_list(F.struct("cond", "_all")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda p: F.transform(
        F.filter("e", lambda q: q["cond"] > p["cond"]),
        lambda q: F.struct(p["_all"].alias("l"), q["_all"].alias("r")))))
    both = per_sheet.select("dataset_id", F.explode(pairs).alias("p")).select("dataset_id", "p.*")

    def log_ratio(name: str) -> Column:
        x, y = F.abs(F.col(f"l.{name}")), F.abs(F.col(f"r.{name}"))
        return F.when(F.greatest(x, y) < 1e-10, None).when(F.least(x, y) < 1e-10, F.abs(x - y)).otherwise(
            F.abs(F.log(x) - F.log(y)))

    def gap(name: str) -> Column:
        return F.abs(F.col(f"l.{name}") - F.col(f"r.{name}"))

    step = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS)),
        F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("d")),
        lambda acc, b: F.struct(
            (acc["f"] + F.coalesce(F.try_element_at(F.col("l.hist"), b), F.lit(0.0)) / F.col("l.n")
             - F.coalesce(F.try_element_at(F.col("r.hist"), b), F.lit(0.0)) / F.col("r.n")).alias("f"),
            F.greatest(acc["d"], F.abs(
                acc["f"] + F.coalesce(F.try_element_at(F.col("l.hist"), b), F.lit(0.0)) / F.col("l.n")
                - F.coalesce(F.try_element_at(F.col("r.hist"), b), F.lit(0.0)) / F.col("r.n"))).alias("d")),
        lambda acc: acc["d"])
    enough_points = F.least("l.n_points", "r.n_points") >= 50
    wide = F.least("l.log_span", "r.log_span") >= LN10
    spread5 = F.sqrt(1 / (F.col("l.n_reps") * (F.col("l.n_series") - 3)) + 1 / (F.col("r.n_reps") * (F.col("r.n_series") - 3)))
    floor5 = math.sqrt(2) / F.sqrt(F.least("l.n_reps", "r.n_reps") * (F.least("l.n_series", "r.n_series") - 3))
    distance = {
        "P1": log_ratio("span"), "P2": log_ratio("mad"), "P3": step, "P4": log_ratio("resid_sd"),
        "P5": gap("lag_z"), "P6": gap("resid_kurt"), "P9": F.when(enough_points & wide, gap("slope")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), d.alias("distance")) for p, d in distance.items()]))
    out = both.select(
        "dataset_id", F.col("l.cond").alias("a"), F.col("r.cond").alias("b"), F.least("l.n", "r.n").alias("n_min"),
        spread5.alias("spread5"), floor5.alias("floor5"), rows.alias("u"),
    ).select("dataset_id", "a", "b", "n_min", "spread5", "floor5", "u.*")
    least = F.lit(0)
    for p, (_, n, _, _) in PROPERTIES.items():
        least = F.when(F.col("property") == p, n).otherwise(least)
    return out.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("n_min") >= least))


def condition_consistency(sheet: Sheet, original: Sheet | None = None) -> Outcome:
    test = "Cross-Condition Consistency"
    seen = observed_distances(sheet, original)
    joined = seen.join(permuted_distances(sheet, original), ["dataset_id", "property", "a", "b"], "left")
    d = F.col("distance")
    n = F.size("ds")
    upper = (1 + F.size(F.filter("ds", lambda v: v >= d - 1e-12))) / (1 + n)
    lower = (1 + F.size(F.filter("ds", lambda v: v <= d + 1e-12))) / (1 + n)
    # A shuffle of rows leaves the lag-1 correlation at noise level, so the null
    # of P5 is the difference of two mean Fisher z of known spread.
    z5 = d / F.col("spread5")
    up5 = 2 * normal_sf(z5)
    p = F.when(F.col("property") == "P5", F.least(F.lit(1.0), 2 * F.least(up5, 1 - up5))).otherwise(
        F.least(F.lit(1.0), 2 * F.least(upper, lower)))
    half = F.floor(n / 2).cast("int")
    middle = F.when(F.col("property") == "P5", F.col("spread5") * 0.6744897501960817).otherwise(
        F.when(n % 2 == 1, F.get("ds", half)).otherwise((F.get("ds", half) + F.get("ds", half - 1)) / 2))
    stage, threshold = F.lit(0), F.lit(None).cast("double")
    both_ways = F.lit(False)
    for name, (s, _, ways, t) in PROPERTIES.items():
        own = F.col("property") == name
        stage = F.when(own, s).otherwise(stage)
        both_ways = F.when(own, F.lit("different" in ways)).otherwise(both_ways)
        threshold = F.when(own, F.lit(t).cast("double")).otherwise(threshold)
    units = joined.withColumn("raw_p", p).withColumn("middle", middle).withColumn("stage", stage).drop("ds")
    units = materialize(bh_small(units, ["dataset_id", "stage"]), "properties")
    similar = d <= F.col("middle")
    limit = F.when(F.col("property") == "P5", F.col("floor5")).otherwise(threshold)
    gate = F.when(similar, F.when(F.col("middle") > 0, d / F.col("middle") <= 0.5).otherwise(d == 0)).otherwise(d >= limit)
    units = units.withColumn("direction", F.when(similar, "similar").otherwise("different")).withColumn(
        "gate", F.when((F.col("property") == "P5") | (F.col("n_min") >= 500), F.coalesce(gate, F.lit(True))).otherwise(True)
    ).withColumn("counts", (F.col("direction") == "similar") | both_ways).withColumn("grp", F.lit(ALL))
    effective = F.when(F.col("gate") & F.col("counts"), F.col("adj_p")).otherwise(1.0)
    best = units.groupBy("dataset_id").agg(F.min(effective).alias("p"), F.count("raw_p").alias("n_units"))
    n_cond = sheet.rows.groupBy("dataset_id").agg(F.count_distinct("cond").alias("conditions"))
    df = sheet_sizes(sheet.rows).join(n_cond, "dataset_id").join(best, "dataset_id", "left")
    cause = F.when(F.lit(sheet.settings.paired), "subjectsSharedAcrossConditions").when(
        (F.col("conditions") < 2) | F.col("p").isNull(), "tooFewConditions")
    result = result_rows(
        df, test, flag_from_p(F.col("p")), F.col("p"), {"units": F.col("n_units"), "conditions": F.col("conditions")},
        na_cause=cause, na_observed=F.col("conditions"), na_minimum=2.0, null_method="group shuffle",
    )
    return Outcome(
        lambda: unit_rows(
            units, test, F.concat_ws(" ", "property", F.concat_ws(" vs ", "a", "b"), "direction"), d,
            raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
        ),
        result,
    )


