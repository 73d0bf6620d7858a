"""Vocabulary shared by every test: names, mechanisms, keys and row shapes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A test works on one (dataset, group of rows). ``grp`` is ALL for a test of the
# whole sheet and a condition name for a test that runs once per condition.
KEY = ["dataset_id", "grp"]
ALL = "all"

# Test name -> mechanism.
MECHANISM = {
    "Exact Duplicate Detection": "copied",
    "Sequential Duplication": "copied",
    "Constant-Offset Blocks": "copied",
    "Residual Spike Correlation": "copied",
    "Benford's Law (First Digit)": "digits",
    "Benford's Law (Second Digit)": "digits",
    "Terminal Digit Uniformity": "digits",
    "Decimal Precision Consistency": "digits",
    "Value-Frequency Spike": "digits",
    "Entropy / Zipf Analysis": "shapes",
    "Column Goodness-of-Fit": "shapes",
    "Modality Test": "shapes",
    "Inter-Replicate Correlation": "replicate",
    "Excess Kurtosis": "replicate",
    "Autocorrelation": "replicate",
    "Windowed Autocorrelation": "replicate",
    "Runs Test": "replicate",
    "Noise Scaling With Measurement Size": "replicate",
    "Within-Row Variance": "replicate",
    "Selective Noise Partitioning": "replicate",
    "Regional Noise Homogeneity": "replicate",
    "LOESS Residual Analysis": "replicate",
    "Row-Mean Runs": "replicate",
    "Mahalanobis Row Outlier": "replicate",
    "Blocked Mahalanobis": "replicate",
    "Cross-Condition Rank Correlation": "group",
    "Baseline Balance": "group",
    "Cross-Condition Consistency": "group",
    "Missing Data Pattern": "replicate",
}

RESULT_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("grp", T.StringType()),
    T.StructField("test", T.StringType()),
    T.StructField("flag", T.StringType()),
    T.StructField("primary_p", T.DoubleType()),
    T.StructField("na_cause", T.StringType()),
    T.StructField("na_observed", T.DoubleType()),
    T.StructField("na_minimum", T.DoubleType()),
    T.StructField("null_method", T.StringType()),
    T.StructField("stats", T.MapType(T.StringType(), T.DoubleType())),
])

UNIT_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("grp", T.StringType()),
    T.StructField("test", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("stat", T.DoubleType()),
    T.StructField("raw_p", T.DoubleType()),
    T.StructField("adj_p", T.DoubleType()),
    T.StructField("row_lo", T.LongType()),
    T.StructField("row_hi", T.LongType()),
    T.StructField("cols", T.ArrayType(T.IntegerType())),
])


@dataclass(frozen=True)
class Settings:
    """What the user says about a corpus of sheets."""

    assay: str = "general"
    data_type: str = "continuous"        # continuous | count | ordinal
    column_relationship: str = "replicates"  # replicates | conditions
    row_semantics: str = "ordered"       # ordered | arbitrary
    paired: bool = False
    pivoted: bool = False
    transform: str = "raw"               # raw | log | anscombe
    seed: int = 20240501


@dataclass(frozen=True)
class Sheet:
    """Rows of one or many sheets plus the settings that apply to them.

    ``rows``: dataset_id, grp, row_idx (dense from 0 within the dataset), cond,
    subject, vals ARRAY<DOUBLE>, raws ARRAY<STRING>.
    """

    rows: DataFrame
    settings: Settings = field(default_factory=Settings)

    def with_rows(self, rows: DataFrame) -> Sheet:
        return replace(self, rows=rows)

    def by_condition(self) -> Sheet:
        """The same rows, one group per condition."""
        return self.with_rows(
            self.rows.where(F.col("cond").isNotNull()).withColumn("grp", F.col("cond"))
        )

    def transformed(self) -> Sheet:
        """Rows after the variance-stabilising transform in the settings."""
        kind = self.settings.transform
        if kind == "log":
            vals = F.transform("vals", lambda v: F.when(v > 0, F.log(v)))
        elif kind == "anscombe":
            vals = F.transform("vals", lambda v: F.when(v >= 0, F.sqrt(v + F.lit(0.375))))
        else:
            return self
        return self.with_rows(self.rows.withColumn("vals", vals))


@dataclass(frozen=True)
class Outcome:
    """A test's verdict (``result``) and its evidence (``units``), which is
    only planned when asked for."""

    evidence: Callable[[], DataFrame]
    result: DataFrame

    @property
    def units(self) -> DataFrame:
        return self.evidence()


def result_rows(
    df: DataFrame,
    test: str,
    flag: Column,
    primary_p: Column,
    stats: dict[str, Column],
    *,
    na_cause: Column | None = None,
    na_observed: Column | None = None,
    na_minimum: Column | float | None = None,
    null_method: Column | str = "closed form",
) -> DataFrame:
    """Shape one row per group into RESULT_SCHEMA; a cause makes it N/A."""
    null = F.lit(None)
    cause = (na_cause if na_cause is not None else null).cast("string")
    observed = (na_observed if na_observed is not None else null).cast("double")
    minimum = na_minimum if isinstance(na_minimum, Column) else F.lit(na_minimum)
    method = null_method if isinstance(null_method, Column) else F.lit(null_method)
    pairs: list[Column] = []
    for name, col in stats.items():
        pairs += [F.lit(name), col.cast("double")]
    return df.select(
        F.col("dataset_id").cast("string").alias("dataset_id"),
        F.col("grp").cast("string").alias("grp"),
        F.lit(test).alias("test"),
        F.when(cause.isNotNull(), "N/A").otherwise(flag).alias("flag"),
        F.when(cause.isNull(), primary_p).cast("double").alias("primary_p"),
        cause.alias("na_cause"),
        F.when(cause.isNotNull(), observed).alias("na_observed"),
        F.when(cause.isNotNull(), minimum.cast("double")).alias("na_minimum"),
        method.cast("string").alias("null_method"),
        F.create_map(*pairs).alias("stats"),
    )


def unit_rows(
    df: DataFrame,
    test: str,
    unit: Column,
    stat: Column,
    *,
    raw_p: Column | None = None,
    adj_p: Column | None = None,
    row_lo: Column | None = None,
    row_hi: Column | None = None,
    cols: Column | None = None,
) -> DataFrame:
    null = F.lit(None)

    def pick(col: Column | None, kind: str, name: str) -> Column:
        return (col if col is not None else null).cast(kind).alias(name)

    return df.select(
        F.col("dataset_id").cast("string").alias("dataset_id"),
        F.col("grp").cast("string").alias("grp"),
        F.lit(test).alias("test"),
        unit.cast("string").alias("unit"),
        stat.cast("double").alias("stat"),
        pick(raw_p, "double", "raw_p"),
        pick(adj_p, "double", "adj_p"),
        pick(row_lo, "bigint", "row_lo"),
        pick(row_hi, "bigint", "row_hi"),
        pick(cols, "array<int>", "cols"),
    )

