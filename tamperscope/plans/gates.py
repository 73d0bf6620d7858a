"""Which tests apply to which dataset, decided before any heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperscope.functions.rows import cells
from tamperscope.functions.values import is_integer
from tamperscope.model import MECHANISM, Sheet
from tamperscope.operators.digits import log_span
from tamperscope.plans.settings import facts, settings_rows

# Tests a data type rules out.
DATA_TYPE_SKIP = {
    "ordinal": (
        "Selective Noise Partitioning", "Autocorrelation", "Excess Kurtosis", "Runs Test", "Row-Mean Runs",
        "Inter-Replicate Correlation", "Regional Noise Homogeneity", "Noise Scaling With Measurement Size",
        "LOESS Residual Analysis", "Residual Spike Correlation", "Within-Row Variance", "Constant-Offset Blocks",
        "Mahalanobis Row Outlier", "Entropy / Zipf Analysis", "Column Goodness-of-Fit", "Modality Test",
        "Blocked Mahalanobis",
    ),
    "count": ("Entropy / Zipf Analysis", "Column Goodness-of-Fit", "Modality Test", "Blocked Mahalanobis"),
    "continuous": (),
}

# Tests that read the row order as a sequence.
ORDERED_ONLY = (
    "Runs Test", "Row-Mean Runs", "Blocked Mahalanobis", "LOESS Residual Analysis", "Regional Noise Homogeneity",
)

# Tests that compare repeats of one measurement.
REPLICATES_ONLY = (
    "Inter-Replicate Correlation", "Constant-Offset Blocks", "Residual Spike Correlation", "Mahalanobis Row Outlier",
    "Blocked Mahalanobis", "Noise Scaling With Measurement Size", "Excess Kurtosis", "Autocorrelation",
    "Windowed Autocorrelation", "Runs Test", "Within-Row Variance", "LOESS Residual Analysis", "Row-Mean Runs",
    "Selective Noise Partitioning", "Regional Noise Homogeneity",
)

# Tests withheld where the same subjects are in every condition.
UNPAIRED_ONLY = ("Cross-Condition Consistency", "Residual Spike Correlation")

# Smallest sheet per test.
MINIMA = {
    "Sequential Duplication": {"n_rows": 4},
    "Constant-Offset Blocks": {"n_cols": 2, "n_rows": 4},
    "Residual Spike Correlation": {"n_conditions": 2, "n_rows": 10},
    "Benford's Law (First Digit)": {"n_values": 100, "span": 1.5},
    "Benford's Law (Second Digit)": {"n_values": 100, "span": 1.0},
    "Terminal Digit Uniformity": {"n_values": 50},
    "Decimal Precision Consistency": {"n_decimal": 30},
    "Value-Frequency Spike": {"n_values": 100},
    "Entropy / Zipf Analysis": {"n_cols": 1, "n_rows": 20},
    "Column Goodness-of-Fit": {"n_cols": 1, "n_rows": 30},
    "Modality Test": {"n_cols": 1, "n_rows": 50},
    "Inter-Replicate Correlation": {"n_cols": 2, "n_rows": 10},
    "Excess Kurtosis": {"n_cols": 2, "n_rows": 20},
    "Autocorrelation": {"n_cols": 2, "n_rows": 10},
    "Windowed Autocorrelation": {"n_cols": 2, "n_rows": 30},
    "Runs Test": {"n_cols": 2, "n_rows": 10},
    "Noise Scaling With Measurement Size": {"n_cols": 3, "n_rows": 5},
    "Within-Row Variance": {"n_cols": 3, "n_rows": 40},
    "Selective Noise Partitioning": {"n_cols": 3, "n_rows": 10},
    "Regional Noise Homogeneity": {"n_cols": 3, "n_rows": 20},
    "LOESS Residual Analysis": {"n_cols": 2, "n_rows": 30},
    "Row-Mean Runs": {"n_cols": 2, "n_rows": 10, "n_conditions": 1},
    "Mahalanobis Row Outlier": {"n_cols": 3, "rows_per_col": 3},
    "Blocked Mahalanobis": {"n_cols": 3, "n_rows": 60},
    "Missing Data Pattern": {"n_cols": 2, "n_rows": 10, "n_missing": 10},
    "Cross-Condition Rank Correlation": {"n_conditions": 2, "n_rows": 10},
    "Baseline Balance": {"n_conditions": 2, "n_rows": 10},
    "Cross-Condition Consistency": {"n_conditions": 2, "n_values": 60},
}

_CAUSE = {
    "n_rows": "tooFewRows", "n_cols": "tooFewColumns", "n_conditions": "tooFewConditions", "n_values": "tooFewRows",
    "span": "rangeOutOfBand", "n_decimal": "tooFewRows", "n_missing": "missingnessOutOfBand",
    "rows_per_col": "tooFewRows",
}


def dataset_summary(sheet: Sheet) -> DataFrame:
    """One row per dataset with the counts the gates read."""
    rows = sheet.rows.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vals")).alias("n_cols"),
        F.count_distinct("cond").alias("n_conditions"),
        F.sum(F.size(F.filter("vals", lambda v: v.isNull()))).alias("n_missing"),
    )
    values = cells(sheet.rows).groupBy("dataset_id").agg(
        F.count("x").alias("n_values"), F.avg(is_integer(F.col("x")).cast("double")).alias("integer_share"),
        F.count_if(~is_integer(F.col("x"))).alias("n_decimal"), log_span(F.col("x")).alias("span"),
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.count_if(F.col("x") < 0).alias("n_negative"),
    )
    return rows.join(values, "dataset_id", "left").withColumn(
        "rows_per_col", F.col("n_rows") / F.greatest("n_cols", F.lit(1))
    )


def rules(spark: SparkSession) -> DataFrame:
    """(test, fact, cause, rank): tests that a fact about a dataset closes;
    the smallest rank names the cause."""
    rows = [(t, f"data type {kind}", "dataTypeMismatch", 0) for kind, tests in DATA_TYPE_SKIP.items() for t in tests]
    rows += [(t, "columns are conditions", "columnsNotReplicates", 1) for t in REPLICATES_ONLY]
    rows += [(t, "row order arbitrary", "rowOrderArbitrary", 2) for t in ORDERED_ONLY]
    rows += [(t, "subjects shared", "subjectsSharedAcrossConditions", 3) for t in UNPAIRED_ONLY]
    return spark.createDataFrame(rows, "test string, fact string, na_cause string, rank int")


def minima(spark: SparkSession) -> DataFrame:
    """(test, measure, least, cause, rank): what a dataset must hold for a test."""
    rows = [(t, name, float(least), _CAUSE[name], 10 + i) for t, need in MINIMA.items() for i, (name, least) in enumerate(need.items())]
    return spark.createDataFrame(rows, "test string, measure string, na_minimum double, na_cause string, rank int")


def gates(sheet: Sheet, summary: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """datasets x 29 tests: runs, na_cause, na_observed, na_minimum.

    ``settings`` is a settings table; each dataset is judged by its own row.
    The two rule tables are fixed and small, so they are broadcast, and one
    grouping picks the first cause of each dataset and test.
    """
    spark = sheet.rows.sparkSession
    base = summary if summary is not None else dataset_summary(sheet)
    chosen = settings if settings is not None else settings_rows(sheet)
    none = F.lit(None)
    shared = ["dataset_id", "test", "rank", "na_cause", "na_observed", "na_minimum"]
    every = base.select("dataset_id", F.explode(F.array(*[F.lit(t) for t in MECHANISM])).alias("test")).select(
        "dataset_id", "test", F.lit(99).alias("rank"), none.cast("string").alias("na_cause"),
        none.cast("double").alias("na_observed"), none.cast("double").alias("na_minimum"))
    ruled = facts(chosen).join(F.broadcast(rules(spark)), "fact").select(
        "dataset_id", "test", "rank", "na_cause", none.cast("double").alias("na_observed"), none.cast("double").alias("na_minimum"))
    measures = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("na_observed")) for m in _CAUSE]
    long = base.select("dataset_id", F.explode(F.array(*measures)).alias("m")).select("dataset_id", "m.*")
    short = long.join(F.broadcast(minima(spark)), "measure").where(
        F.coalesce("na_observed", F.lit(0.0)) < F.col("na_minimum")).select(*shared)
    first = F.min(F.struct(*shared[2:])).alias("g")
    mechanism = F.element_at(F.create_map(*[F.lit(x) for pair in MECHANISM.items() for x in pair]), F.col("test"))
    return every.unionByName(ruled).unionByName(short).groupBy("dataset_id", "test").agg(first).select(
        "dataset_id", "test", mechanism.alias("mechanism"), "g.na_cause", "g.na_observed", "g.na_minimum",
        F.col("g.na_cause").isNull().alias("runs"))
