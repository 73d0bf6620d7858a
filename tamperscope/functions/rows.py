"""Row-wise statistics of ``vals`` and the shapes tests explode it into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.model import KEY


def present(vals: Column | str) -> Column:
    return F.filter(vals, lambda v: v.isNotNull())


def total(xs: Column | str) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)


def mean(xs: Column | str) -> Column:
    xs = F.col(xs) if isinstance(xs, str) else xs
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def variance(xs: Column | str, centre: Column | None = None) -> Column:
    """Sample variance; 0 for a single value."""
    xs = F.col(xs) if isinstance(xs, str) else xs
    m = centre if centre is not None else mean(xs)
    squares = F.aggregate(xs, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(xs) > 0, squares / F.greatest(F.size(xs) - 1, F.lit(1)))


def with_row_stats(rows: DataFrame) -> DataFrame:
    """Adds n_vals, row_mean, row_var over the non-null values."""
    return (
        rows.withColumn("_x", present("vals"))
        .withColumn("n_vals", F.size("_x"))
        .withColumn("row_mean", mean("_x"))
        .withColumn("row_var", variance("_x", F.col("row_mean")))
        .drop("_x")
    )


def cells(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per non-null cell: KEY, row_idx, col, x, raw."""
    zipped = F.arrays_zip(F.col("vals").alias("x"), F.col("raws").alias("raw"))
    return (
        rows.select(*KEY, "row_idx", *keep, F.posexplode(zipped).alias("col", "_c"))
        .select(*KEY, "row_idx", *keep, "col", F.col("_c.x").alias("x"), F.col("_c.raw").alias("raw"))
        .where(F.col("x").isNotNull())
    )


def pair_values(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per complete column pair: KEY, row_idx, c1, c2, a, b.

    Generators inside the row, so it costs no shuffle; they yield column
    numbers, which compiled code turns into values.
    """
    firsts = rows.where(F.size("vals") >= 2).select(
        *KEY, "row_idx", *keep, F.col("vals").alias("_v"), F.explode(F.sequence(F.lit(0), F.size("vals") - 2)).alias("c1"))
    pairs = firsts.select("*", F.explode(F.sequence(F.col("c1") + 1, F.size("_v") - 1)).alias("c2"))
    return (
        pairs.select(*KEY, "row_idx", *keep, "c1", "c2", F.get("_v", F.col("c1")).alias("a"), F.get("_v", F.col("c2")).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def pair_label() -> Column:
    return F.concat_ws("-", F.col("c1") + 1, F.col("c2") + 1)


def sheet_sizes(rows: DataFrame) -> DataFrame:
    """Row and column counts per group."""
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vals")).alias("n_cols")
    )
