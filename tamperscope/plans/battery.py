"""The whole battery over a corpus of sheets."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.model import ALL, MECHANISM, RESULT_SCHEMA, UNIT_SCHEMA, Outcome, Sheet
from tamperscope.operators import (
    conditions, digits, duplicates, missing, multivariate, noise, offsets, replicates, shapes,
)
from tamperscope.plans import settings as settings_table
from tamperscope.plans.battery_status import subject_pairing  # noqa: F401  part of this module's interface
from tamperscope.plans.gates import dataset_summary, gates
from tamperscope.plans.verdict import aggregate_groups
from tamperscope.session import materialize, new_path


@dataclass(frozen=True)
class ForensicTest:
    """How one test is run: on transformed values or not, per condition or not."""

    name: str
    run: Callable[[Sheet], Outcome]
    transformed: bool = False
    per_condition: bool = False


TESTS = [
    ForensicTest("Exact Duplicate Detection", duplicates.exact_duplicates),
    ForensicTest("Sequential Duplication", duplicates.sequential_duplication),
    ForensicTest("Constant-Offset Blocks", offsets.constant_offset, transformed=True),
    ForensicTest("Residual Spike Correlation", conditions.residual_spike, transformed=True),
    ForensicTest("Benford's Law (First Digit)", digits.benford_first),
    ForensicTest("Benford's Law (Second Digit)", digits.benford_second),
    ForensicTest("Terminal Digit Uniformity", digits.terminal_digit),
    ForensicTest("Decimal Precision Consistency", digits.decimal_precision),
    ForensicTest("Value-Frequency Spike", digits.value_frequency_spike),
    ForensicTest("Entropy / Zipf Analysis", shapes.entropy, per_condition=True),
    ForensicTest("Column Goodness-of-Fit", shapes.column_gof, per_condition=True),
    ForensicTest("Modality Test", shapes.modality, per_condition=True),
    ForensicTest("Inter-Replicate Correlation", replicates.inter_replicate_correlation),
    ForensicTest("Excess Kurtosis", replicates.excess_kurtosis, transformed=True),
    ForensicTest("Autocorrelation", replicates.autocorrelation, transformed=True),
    ForensicTest("Windowed Autocorrelation", replicates.windowed_autocorrelation, transformed=True),
    ForensicTest("Runs Test", replicates.runs_test, transformed=True),
    ForensicTest("Noise Scaling With Measurement Size", replicates.noise_scaling),
    ForensicTest("Within-Row Variance", replicates.within_row_variance),
    ForensicTest("Selective Noise Partitioning", noise.selective_noise, transformed=True),
    ForensicTest("Regional Noise Homogeneity", noise.regional_noise, transformed=True),
    ForensicTest("LOESS Residual Analysis", noise.loess_cusum, transformed=True),
    ForensicTest("Row-Mean Runs", noise.row_mean_runs, transformed=True),
    ForensicTest("Mahalanobis Row Outlier", multivariate.mahalanobis_rows, transformed=True, per_condition=True),
    ForensicTest("Blocked Mahalanobis", multivariate.blocked_mahalanobis, transformed=True),
    ForensicTest("Cross-Condition Rank Correlation", conditions.rank_correlation),
    ForensicTest("Baseline Balance", conditions.baseline_balance),
    ForensicTest("Cross-Condition Consistency", conditions.condition_consistency, transformed=True),
    ForensicTest("Missing Data Pattern", missing.missing_data_pattern),
]

THIN_MEDIAN = 4
MIN_GROUP = 3


MANY_CONDITION_COLUMNS = 3


def grouping_status(sheet: Sheet, condition_columns: DataFrame | None = None) -> DataFrame:
    """Whether the row conditions of a dataset give usable groups, and whether
    its user should confirm them first: none usable, a median of 4 or less, or
    three or more condition columns (``condition_columns``: dataset_id, n)."""
    sizes = sheet.rows.where(F.col("cond").isNotNull()).groupBy("dataset_id", "cond").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        F.percentile("n", F.lit(0.5)).alias("median_size"))
    usable = (F.col("n_groups") >= 2) & (F.col("smallest") >= MIN_GROUP)
    thin = ~usable | (F.col("median_size") <= THIN_MEDIAN)
    if condition_columns is not None:
        many = condition_columns.select("dataset_id", (F.col("n") >= MANY_CONDITION_COLUMNS).alias("_many"))
        per = per.join(many, "dataset_id", "left")
        thin = thin | F.coalesce("_many", F.lit(False))
    return per.withColumn("usable", usable).withColumn("pending", thin).drop("_many")


def _regrouped(sheet: Sheet, status: DataFrame, refuse_pending: bool) -> Sheet:
    """One group per condition where the grouping is usable, whole sheets
    without conditions, and nothing for a grouping still to be confirmed."""
    known = sheet.rows.join(status.select("dataset_id", "usable", "pending"), "dataset_id", "left")
    if refuse_pending:
        known = known.where(~F.coalesce("pending", F.lit(False)))
    grouped = F.coalesce("usable", F.lit(False)) & F.col("cond").isNotNull()
    keep = ~F.coalesce("usable", F.lit(False)) | F.col("cond").isNotNull()
    return sheet.with_rows(known.where(keep).withColumn("grp", F.when(grouped, F.col("cond")).otherwise(ALL)).drop(
        "usable", "pending"))


def run_test(test: ForensicTest, sheet: Sheet, status: DataFrame) -> Outcome:
    """One test by its route; per-condition results come back aggregated."""
    base = sheet.transformed() if test.transformed else sheet
    if test.name == "Cross-Condition Consistency":
        return conditions.condition_consistency(base, sheet)
    if not test.per_condition:
        return test.run(base)
    outcome = test.run(_regrouped(base, status, refuse_pending=True))
    pending = status.where("pending").select(
        "dataset_id", F.lit(ALL).alias("grp"), F.lit(test.name).alias("test"), F.lit("N/A").alias("flag"),
        F.lit(None).cast("double").alias("primary_p"), F.lit("groupingPending").alias("na_cause"),
        F.col("median_size").alias("na_observed"), F.lit(float(THIN_MEDIAN + 1)).alias("na_minimum"),
        F.lit(None).cast("string").alias("null_method"),
        F.create_map(F.lit("groups"), F.col("n_groups").cast("double")).alias("stats"))
    return Outcome(outcome.evidence, aggregate_groups(outcome.result).unionByName(pending))


def run_battery(
    sheet: Sheet, tests: list[str] | None = None, parallel: int = 4, settings: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Results (datasets x tests) and units of the battery, as written tables.

    ``settings`` has a row per dataset (see ``settings.settings_rows``); what
    it leaves open is the sheet's own. Zeros go where they stand for missing
    cells, the transform and pairing are read off the data where asked. Gates
    come next: a dataset a test cannot judge never reaches its plan. Datasets
    of equal settings run together. Each test writes its own part of the two
    tables; several run side by side.
    """
    spark = sheet.rows.sparkSession
    wanted = [t for t in TESTS if tests is None or t.name in tests]
    chosen = materialize(settings_table.settings_rows(sheet, settings), "settings")
    sheet = settings_table.zeros_as_missing(sheet, chosen)
    if settings is not None:
        chosen = materialize(settings_table.read_off(sheet, chosen), "settings")
    gate = materialize(gates(sheet, dataset_summary(sheet), chosen), "gates")
    status = materialize(grouping_status(sheet), "grouping")
    kinds = settings_table.classes(chosen)
    results_path, units_path = new_path(spark, "results"), new_path(spark, "units")

    def one(test: ForensicTest) -> None:
        own = gate.where(F.col("test") == test.name)
        slot = f"t{[t.name for t in TESTS].index(test.name):02d}"
        closed = own.where("not runs").select(
            "dataset_id", F.lit(ALL).alias("grp"), "test", F.lit("N/A").alias("flag"),
            F.lit(None).cast("double").alias("primary_p"), "na_cause", "na_observed", "na_minimum",
            F.lit(None).cast("string").alias("null_method"),
            F.create_map(F.lit("gated"), F.lit(1.0)).alias("stats"))
        closed.select(*RESULT_SCHEMA.names).write.parquet(f"{results_path}/slot={slot}-closed")
        for k, kind in enumerate(kinds):
            open_ = own.where("runs").select("dataset_id")
            if len(kinds) > 1:
                open_ = open_.join(settings_table.of_class(chosen, kind), "dataset_id", "left_semi")
                if open_.isEmpty():
                    continue
            rows = sheet.rows.join(open_, "dataset_id", "left_semi")
            outcome = run_test(test, replace(sheet, rows=rows, settings=replace(kind, seed=sheet.settings.seed)), status)
            outcome.result.select(*RESULT_SCHEMA.names).write.parquet(f"{results_path}/slot={slot}-{k}")
            outcome.units.select(*UNIT_SCHEMA.names).write.parquet(f"{units_path}/slot={slot}-{k}")

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        list(pool.map(one, wanted))
    spark.createDataFrame([], UNIT_SCHEMA).write.parquet(f"{units_path}/slot=none")
    return (
        spark.read.schema(RESULT_SCHEMA).parquet(results_path).select(*RESULT_SCHEMA.names),
        spark.read.schema(UNIT_SCHEMA).parquet(units_path).select(*UNIT_SCHEMA.names),
    )


def run_confirmed_grouping(sheet: Sheet) -> DataFrame:
    """The four per-condition tests on a grouping the user has confirmed (the
    ``cond`` column of ``sheet``). A grouping without usable groups is refused
    with its shortfall instead of being pooled."""
    status = materialize(grouping_status(sheet), "grouping")
    bad = status.where("not usable")
    rows = sheet.rows.join(bad.select("dataset_id"), "dataset_id", "left_anti")
    parts: DataFrame | None = None
    for test in (t for t in TESTS if t.per_condition):
        base = sheet.with_rows(rows)
        base = base.transformed() if test.transformed else base
        done = aggregate_groups(test.run(_regrouped(base, status, refuse_pending=False)).result)
        refused = bad.select(
            "dataset_id", F.lit(ALL).alias("grp"), F.lit(test.name).alias("test"), F.lit("N/A").alias("flag"),
            F.lit(None).cast("double").alias("primary_p"), F.lit("tooFewRows").alias("na_cause"),
            F.col("largest").cast("double").alias("na_observed"), F.lit(float(MIN_GROUP)).alias("na_minimum"),
            F.lit(None).cast("string").alias("null_method"),
            F.create_map(F.lit("groups"), F.col("n_groups").cast("double")).alias("stats"))
        both = done.unionByName(refused)
        parts = both if parts is None else parts.unionByName(both)
    return parts


def surviving_groups(sheet: Sheet, minimum_rows: int = 3) -> DataFrame:
    """Conditions a dataset would keep, and whether dropping down to them must
    be refused because fewer than two are left."""
    sizes = sheet.rows.where(F.col("cond").isNotNull()).groupBy("dataset_id", "cond").agg(F.count(F.lit(1)).alias("n"))
    kept = sizes.where(F.col("n") >= minimum_rows).groupBy("dataset_id").agg(
        F.array_sort(F.collect_set("cond")).alias("remaining"))
    every = sheet.rows.select("dataset_id").distinct().join(kept, "dataset_id", "left")
    n = F.when(F.col("remaining").isNull(), 0).otherwise(F.size("remaining"))
    return every.withColumn("observed", n).withColumn("minimum", F.lit(2)).withColumn("refused", n < 2)


assert {t.name for t in TESTS} == set(MECHANISM)
