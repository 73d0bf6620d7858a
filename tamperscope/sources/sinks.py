"""Where results go: tables for machines, CSV for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.model import Sheet


def write_report(path: str, tables: dict[str, DataFrame]) -> None:
    """Each table as Parquet under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV; arrays and maps become JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def annotated_rows(sheet: Sheet, regions: DataFrame) -> DataFrame:
    """Sheet rows with the flagged tests that point at each of them."""
    spans = regions.where(F.col("row_lo").isNotNull()).withColumn(
        "_c", F.explode(F.sequence(F.floor(F.col("row_lo") / 4096), F.floor(F.col("row_hi") / 4096))))
    hits = sheet.rows.select("dataset_id", "row_idx", F.floor(F.col("row_idx") / 4096).alias("_c")).join(
        spans.select("dataset_id", "_c", "test", "row_lo", "row_hi"), ["dataset_id", "_c"]
    ).where(F.col("row_idx").between(F.col("row_lo"), F.col("row_hi")))
    marks = hits.groupBy("dataset_id", "row_idx").agg(F.array_sort(F.collect_set("test")).alias("flagged_by"))
    return sheet.rows.join(marks, ["dataset_id", "row_idx"], "left")


def legend(results: DataFrame) -> DataFrame:
    """Flags used in a report and how many tests carry each."""
    return results.groupBy("flag").agg(F.count(F.lit(1)).alias("n_tests"), F.array_sort(F.collect_set("test")).alias("tests"))
