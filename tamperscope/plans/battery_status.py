"""What the rows of a dataset say about its design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.model import Sheet


def subject_pairing(sheet: Sheet) -> DataFrame:
    """Datasets whose conditions all hold the same subjects, each once."""
    rows = sheet.rows.where(F.col("cond").isNotNull())
    per_subject = rows.groupBy("dataset_id", "subject").agg(
        F.count_distinct("cond").alias("k"), F.count(F.lit(1)).alias("n"))
    conds = rows.groupBy("dataset_id").agg(F.count_distinct("cond").alias("n_conditions"))
    checks = per_subject.join(conds, "dataset_id").groupBy("dataset_id").agg(
        F.max("n_conditions").alias("n_conditions"),
        F.bool_and(F.col("subject").isNotNull() & (F.col("k") == F.col("n_conditions")) & (F.col("n") == F.col("k"))).alias("same"))
    paired = F.col("same") & (F.col("n_conditions") >= 2)
    return checks.select(
        "dataset_id", "n_conditions", paired.alias("paired"),
        F.when(paired, "identifier").alias("basis"))
