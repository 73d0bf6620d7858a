"""Choice of a variance-stabilising transform per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.functions.rows import cells, mean, variance
from tamperscope.functions.values import is_integer
from tamperscope.model import Sheet

# Transform an assay asks for where the data do not decide.
FALLBACK = {"densitometry": "log", "elisa": "log", "genomics": "log", "proteomics": "log"}


def choose_transform(sheet: Sheet, settings: DataFrame | None = None) -> DataFrame:
    """raw, log or anscombe per dataset, with the slope evidence behind it; the
    assay is that of ``settings`` (dataset_id, assay), else of the sheet."""
    values = cells(sheet.rows).groupBy("dataset_id").agg(
        F.avg(is_integer(F.col("x")).cast("double")).alias("integer_share"),
        F.avg((F.col("x") > 0).cast("double")).alias("positive_share"),
        F.avg((F.col("x") < 0).cast("double")).alias("negative_share"),
    )
    pos = sheet.rows.withColumn("_p", F.filter("vals", lambda v: v > 0)).withColumn("_m", mean("_p"))
    points = pos.where(F.size("_p") >= 3).withColumn("_v", variance("_p", F.col("_m"))).where("_m > 0 and _v > 0").select(
        "dataset_id", F.log("_m").alias("lm"), F.log("_v").alias("lv"))
    sizes = sheet.rows.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vals")).alias("n_cols"))
    fit = points.groupBy("dataset_id").agg(
        F.count("lm").alias("n_points"), F.regr_slope("lv", "lm").alias("slope"), F.regr_sxx("lv", "lm").alias("_sxx"),
        F.regr_syy("lv", "lm").alias("_syy"), F.regr_sxy("lv", "lm").alias("_sxy"),
    )
    df = sizes.join(values, "dataset_id", "left").join(fit, "dataset_id", "left")
    usable = (F.col("n_cols") >= 3) & (F.col("n_rows") >= 10) & (F.col("n_points") >= 10) & (F.col("_sxx") > 1e-10)
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
    se = F.when(usable, F.sqrt(rss / (F.col("n_points") - 2) / F.col("_sxx")))
    df = df.withColumn("slope", F.when(usable, F.col("slope"))).withColumn("slope_se", se)
    above = F.coalesce((F.col("slope_se") > 0) & (F.col("slope") - 1.96 * F.col("slope_se") > 1), F.lit(False))
    if settings is None:
        df = df.withColumn("_assay", F.lit(sheet.settings.assay))
    else:
        df = df.join(settings.select("dataset_id", F.col("assay").alias("_assay")), "dataset_id", "left")
    assay = F.col("_assay")
    positive = F.col("negative_share") < 0.1
    mostly = F.col("positive_share") > 0.5
    fallback: Column = F.lit("raw")
    for name, kind in FALLBACK.items():
        fallback = F.when(assay == name, kind).otherwise(fallback)
    kind = (
        F.when(F.col("integer_share").isNull(), "raw")
        .when((F.col("integer_share") > 0.95) & above & mostly & positive, "log")
        .when((F.col("integer_share") > 0.95) & ~positive, "raw")
        .when(F.col("integer_share") > 0.95, "anscombe")
        .when(above & mostly & positive & (assay == "general"), "log")
        .when((fallback == "log") & (~positive | ~mostly), "raw")
        .otherwise(fallback)
    )
    return df.select(
        "dataset_id", "integer_share", "positive_share", "negative_share", "n_points", "slope", "slope_se",
        kind.alias("transform"),
    )
