"""From test results to one verdict per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.stats import flag_from_p, flag_rank, sidak, stronger_flag
from tamperscope.model import ALL, MECHANISM

# Tests whose groups are not combined by Fisher's method.
FISHER_EXEMPT = (
    "Excess Kurtosis", "Windowed Autocorrelation", "Blocked Mahalanobis", "Mahalanobis Row Outlier",
    "Column Goodness-of-Fit", "Entropy / Zipf Analysis", "Modality Test",
)

_NAMES = {3: "HIGH", 2: "MODERATE", 1: "LOW"}


def mechanism_of(test: Column) -> Column:
    out: Column = F.lit(None).cast("string")
    for name, mech in MECHANISM.items():
        out = F.when(test == name, mech).otherwise(out)
    return out


def _flag_of_rank(rank: Column) -> Column:
    out: Column = F.lit("N/A")
    for r, name in _NAMES.items():
        out = F.when(rank == r, name).otherwise(out)
    return out


def aggregate_groups(results: DataFrame) -> DataFrame:
    """One row per dataset and test from its per-group rows.

    The worst group counts, Sidak-corrected where its flag follows from p
    alone; Fisher's combination over groups can only raise the flag.
    """
    p = F.col("primary_p")
    ran = results.where(F.col("flag") != "N/A")
    sums = ran.groupBy("dataset_id", "test").agg(
        F.count(F.lit(1)).alias("n_groups"), F.max(flag_rank(F.col("flag"))).alias("worst"),
        F.max(flag_rank(flag_from_p(p))).alias("worst_by_p"), F.count(p).alias("n_p"), F.min(p).alias("min_p"),
        F.count_if(p > 0).alias("n_positive"), (-2 * F.sum(F.when(p > 0, F.log(F.greatest(p, F.lit(1e-300)))))).alias("fisher"),
        F.min_by("grp", F.struct(-flag_rank(F.col("flag")), p, F.col("grp"))).alias("worst_group"),
        F.first("null_method").alias("null_method"),
    )
    by_p = (F.col("n_groups") >= 2) & (F.col("n_p") == F.col("n_groups")) & (F.col("worst") == F.col("worst_by_p"))
    sums = sums.withColumn("sidak_p", sidak(F.col("min_p"), F.col("n_groups")))
    arm = F.when(by_p, flag_from_p(F.col("sidak_p"))).otherwise(_flag_of_rank(F.col("worst")))
    combine = (F.col("n_groups") >= 2) & ~F.col("test").isin(list(FISHER_EXEMPT)) & (F.col("n_positive") >= 2)
    sums = sums.withColumn(
        "fisher_p", F.when(combine, special.chi2_tail("fisher", (2 * F.col("n_positive")).cast("double"))))
    flag = stronger_flag(F.coalesce(flag_from_p(F.coalesce("fisher_p", F.lit(1.0))), F.lit("LOW")), arm)
    best = F.when(by_p, F.col("sidak_p")).otherwise(F.col("min_p"))
    done = sums.select(
        "dataset_id", F.lit(ALL).alias("grp"), "test", flag.alias("flag"),
        F.least(best, F.coalesce("fisher_p", F.lit(1.0))).alias("primary_p"),
        F.lit(None).cast("string").alias("na_cause"), F.lit(None).cast("double").alias("na_observed"),
        F.lit(None).cast("double").alias("na_minimum"), "null_method",
        F.create_map(
            F.lit("groups"), F.col("n_groups").cast("double"), F.lit("min_p"), F.col("min_p"),
            F.lit("sidak_p"), F.col("sidak_p"), F.lit("fisher_p"), F.col("fisher_p"),
        ).alias("stats"),
    )
    # Where no group could be tested the shared cause, if there is one, stays.
    none = results.groupBy("dataset_id", "test").agg(
        F.max(F.when(F.col("flag") != "N/A", 1).otherwise(0)).alias("_any"),
        F.when(F.count_distinct("na_cause") == 1, F.max("na_cause")).alias("na_cause"),
        F.max("na_observed").alias("na_observed"), F.max("na_minimum").alias("na_minimum"),
        F.first("null_method").alias("null_method"),
    ).where("_any = 0").select(
        "dataset_id", F.lit(ALL).alias("grp"), "test", F.lit("N/A").alias("flag"),
        F.lit(None).cast("double").alias("primary_p"), "na_cause", "na_observed", "na_minimum", "null_method",
        F.create_map(F.lit("groups"), F.lit(0.0)).alias("stats"),
    )
    return done.unionByName(none)


def severity(results: DataFrame) -> DataFrame:
    """0 to 3 per dataset from its flags and the mechanisms they fall in."""
    mech = mechanism_of(F.col("test"))
    flagged = F.col("flag").isin("HIGH", "MODERATE")
    sums = results.groupBy("dataset_id").agg(
        F.count_if(F.col("flag") == "HIGH").alias("n_high"), F.count_if(F.col("flag") == "MODERATE").alias("n_moderate"),
        F.count_distinct(F.when(flagged, mech)).alias("n_mechanisms"),
    )
    high, mod, dims = F.col("n_high"), F.col("n_moderate"), F.col("n_mechanisms")
    level = F.when(high >= 2, 3).when((high >= 1) & (dims >= 2), 3).when(high >= 1, 2).when(
        (mod >= 2) & (dims >= 2), 3).when(mod >= 1, 1).otherwise(0)
    return sums.withColumn("severity", level)


def coverage_state(flag: Column, cause: Column) -> Column:
    return (
        F.when(flag.isin("HIGH", "MODERATE", "LOW"), "ran")
        .when(cause == "groupingPending", "pending").when(cause == "groupingUnassessed", "unassessed")
        .when(flag == "ERROR", "errored").when(cause == "subjectsSharedAcrossConditions", "withheld")
        .otherwise("notApplicable")
    )


COVERAGE_STATES = ("ran", "notApplicable", "withheld", "unassessed", "errored", "pending")


def coverage(results: DataFrame) -> DataFrame:
    state = coverage_state(F.col("flag"), F.col("na_cause"))
    return results.withColumn("_s", state).groupBy("dataset_id").agg(
        *[F.count_if(F.col("_s") == s).alias(s) for s in COVERAGE_STATES], F.count(F.lit(1)).alias("total"))


def mechanism_rollup(results: DataFrame) -> DataFrame:
    """Per dataset and mechanism: tests run, flags and the smallest p."""
    return results.withColumn("mechanism", mechanism_of(F.col("test"))).groupBy("dataset_id", "mechanism").agg(
        F.count_if(F.col("flag") != "N/A").alias("n_ran"), F.count_if(F.col("flag") == "HIGH").alias("n_high"),
        F.count_if(F.col("flag") == "MODERATE").alias("n_moderate"), F.min("primary_p").alias("min_p"))


def no_verdict_reasons(results: DataFrame) -> DataFrame:
    """Tests without a verdict, grouped by why."""
    return results.where(F.col("flag") == "N/A").groupBy("dataset_id", F.coalesce("na_cause", F.lit("unknown")).alias("na_cause")).agg(
        F.count(F.lit(1)).alias("n_tests"), F.array_sort(F.collect_set("test")).alias("tests"))


def findings(results: DataFrame, regions: DataFrame) -> DataFrame:
    """Flagged tests, strongest first, with where they point."""
    flagged = results.where(F.col("flag").isin("HIGH", "MODERATE")).select("dataset_id", "test", "flag", "primary_p")
    place = regions.groupBy("dataset_id", "test").agg(
        F.count(F.lit(1)).alias("n_regions"), F.min("row_lo").alias("row_lo"), F.max("row_hi").alias("row_hi"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cols")))).alias("cols"),
        F.max((F.col("row_lo").isNotNull() & F.col("cols").isNotNull()).cast("int")).alias("_cell"),
        F.max((F.col("row_lo").isNotNull() & F.col("cols").isNull()).cast("int")).alias("_row"),
        F.max((F.col("row_lo").isNull() & F.col("cols").isNotNull()).cast("int")).alias("_col"),
    )
    locality = F.when(F.col("n_regions").isNull(), "dataset-wide").when(F.col("_cell") == 1, "cell-local").when(
        F.col("_row") == 1, "row-local").when(F.col("_col") == 1, "column-local").otherwise("unscoped")
    joined = flagged.join(place, ["dataset_id", "test"], "left").withColumn("locality", locality).withColumn(
        "mechanism", mechanism_of(F.col("test")))
    # At most 29 findings per dataset.
    order = Window.partitionBy("dataset_id").orderBy(
        flag_rank(F.col("flag")).desc(), F.coalesce("primary_p", F.lit(1.0)), "test")
    by_place = Window.partitionBy("dataset_id").orderBy(
        F.col("row_lo").isNull(), "row_lo", F.get("cols", F.lit(0)), "test")
    return joined.withColumn("finding_rank", F.row_number().over(order)).withColumn(
        "region_number", F.row_number().over(by_place)).drop("_cell", "_row", "_col")


def handoff(results: DataFrame, sheet_summary: DataFrame) -> DataFrame:
    """One JSON document per dataset with everything a report needs."""
    tests = results.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(
        "test", "flag", "primary_p", "na_cause", "null_method"))).alias("tests"))
    doc = severity(results).join(coverage(results), "dataset_id").join(tests, "dataset_id").join(
        sheet_summary, "dataset_id", "left")
    return doc.select("dataset_id", "severity", F.to_json(F.struct(*[c for c in doc.columns])).alias("document"))


def batch_summary(results: DataFrame, sheet_summary: DataFrame) -> DataFrame:
    """One row per dataset: size, severity, counts and the flagged tests."""
    flagged = results.where(F.col("flag").isin("HIGH", "MODERATE")).groupBy("dataset_id").agg(
        F.array_sort(F.collect_set("test")).alias("flagged_tests"))
    return sheet_summary.select("dataset_id", "n_rows", "n_cols", "n_conditions", "n_values").join(
        severity(results), "dataset_id").join(coverage(results), "dataset_id").join(flagged, "dataset_id", "left")


