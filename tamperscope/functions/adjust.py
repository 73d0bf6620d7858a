"""Multiple-testing corrections over unit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bh_small(df: DataFrame, family: Sequence[str], p: str = "raw_p", out: str = "adj_p") -> DataFrame:
    """Benjamini-Hochberg inside a family whose size is bounded by the number
    of columns, column pairs or conditions of one sheet."""
    fam = Window.partitionBy(*family)
    tie_last = fam.orderBy(F.col(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    downward = fam.orderBy(F.col(p).desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.withColumn("_m", F.count(p).over(fam))
        .withColumn("_r", F.count(p).over(tie_last))
        .withColumn("_raw", F.col(p) * F.col("_m") / F.col("_r"))
        .withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(downward))))
        .drop("_m", "_r", "_raw")
    )


def _bucket(p):
    """Order-preserving bucket of a p-value: fine in the bulk, log-spaced in the tail."""
    return F.when(p <= 0, F.lit(-20000)).when(
        p < 1 / 1024, F.floor(F.log2(p) * 8).cast("int") - 10000
    ).otherwise(F.floor(p * 4096).cast("int"))


def _ranked(df: DataFrame, fam: list[str], p: str) -> DataFrame:
    """Distinct p-values per family with the step-up value p * m / rank."""
    counts = (
        df.where(F.col(p).isNotNull()).groupBy(*fam, p).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _bucket(F.col(p)))
    )
    by_family = Window.partitionBy(*fam)
    earlier = by_family.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*fam, "_b").agg(F.sum("_n").alias("_bn")).select(
        *fam, "_b",
        F.sum("_bn").over(by_family).alias("_m"),
        F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_before"),
    )
    so_far = Window.partitionBy(*fam, "_b").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(totals, [*fam, "_b"])
        .withColumn("_r", F.col("_before") + F.sum("_n").over(so_far))
        .withColumn("_raw", F.col(p) * F.col("_m") / F.col("_r"))
    )


def bh_large(df: DataFrame, family: Sequence[str], p: str = "raw_p", out: str = "adj_p") -> DataFrame:
    """Benjamini-Hochberg for a family that grows with the rows of a sheet.

    Equal p-values collapse first (a map-side combine), then ranks and running
    minima are taken inside p-buckets and joined across buckets, so no task
    sees a whole family.
    """
    fam = list(family)
    ranked = _ranked(df, fam, p)
    in_bucket = Window.partitionBy(*fam, "_b")
    floors = ranked.groupBy(*fam, "_b").agg(F.min("_raw").alias("_low"))
    floors = floors.select(
        *fam, "_b",
        F.min("_low").over(
            Window.partitionBy(*fam).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
        ).alias("_later"),
    )
    here = in_bucket.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = (
        ranked.join(floors, [*fam, "_b"])
        .withColumn("_here", F.min("_raw").over(here))
        .select(
            *fam, p,
            F.least(F.lit(1.0), F.col("_here"), F.coalesce("_later", F.lit(1.0))).alias(out),
        )
    )
    return df.join(adjusted, [*fam, p], "left")


def family_minimum(df: DataFrame, family: Sequence[str], p: str = "raw_p") -> DataFrame:
    """Smallest BH-adjusted p per family; needs ranks but no running minimum."""
    ranked = _ranked(df, list(family), p)
    return ranked.groupBy(*family).agg(
        F.least(F.lit(1.0), F.min("_raw")).alias("min_adj_p"), F.sum("_n").alias("n_units")
    )
