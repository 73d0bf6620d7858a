"""What a user should know about a dataset before its verdicts, and where
findings stand in the file it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.model import Sheet
from tamperscope.plans.gates import dataset_summary
from tamperscope.plans.settings import settings_rows

#: Fixed value: share of missing cells beyond which a dataset is warned of.
MOSTLY_MISSING = 0.5

#: Fixed values: (assay, level, name, condition on a dataset's summary); the
#: first that holds says why the values don't look like the assay.
HINTS = [
    ("cell_count", "warn", "negative counts", "min_value < 0"),
    ("cell_count", "warn", "counts are not whole", "1 - integer_share > 0.1"),
    ("qpcr", "warn", "whole numbers", "integer_share > 0.9"),
    ("qpcr", "warn", "outside the cycle range", "min_value < 5 OR max_value > 45"),
    ("qpcr", "info", "wide span", "span > 2"),
    ("densitometry", "info", "high values", "max_value > 50"),
    ("densitometry", "info", "whole numbers", "integer_share > 0.9"),
    ("elisa", "warn", "negative concentrations", "min_value < 0"),
    ("elisa", "info", "narrow span", "coalesce(span, 0) < 1"),
    ("plate_reader", "info", "beyond the linear range", "max_value > 4.5"),
    ("genomics", "info", "not whole, narrow span", "1 - integer_share > 0.05 AND coalesce(span, 0) < 2"),
]


def dataset_report(sheet: Sheet, settings: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """(dataset_id, n_rows, n_cols, missing_share, mostly_missing, hint_level,
    hint): the share of missing cells, and whether the values fit the assay of
    the dataset's settings. Rows without a value never reach a sheet, so a
    dataset without any is no row here: see ``rejected``."""
    base = summary if summary is not None else dataset_summary(sheet)
    chosen = settings if settings is not None else settings_rows(sheet)
    df = base.join(chosen.select("dataset_id", "assay"), "dataset_id", "left")
    level, hint = F.lit(None).cast("string"), F.lit(None).cast("string")
    for assay, kind, name, condition in reversed(HINTS):
        holds = (F.col("assay") == assay) & F.coalesce(F.expr(condition), F.lit(False))
        level, hint = F.when(holds, kind).otherwise(level), F.when(holds, name).otherwise(hint)
    share = F.col("n_missing") / (F.col("n_rows").cast("double") * F.col("n_cols"))
    return df.select("dataset_id", "n_rows", "n_cols", share.alias("missing_share"),
                     (share > MOSTLY_MISSING).alias("mostly_missing"), level.alias("hint_level"), hint.alias("hint"))


def rejected(offered: DataFrame, sheet: Sheet) -> DataFrame:
    """(dataset_id, reason) of the datasets of ``offered`` (dataset_id) of
    which no row with a value is left."""
    return offered.select("dataset_id").distinct().join(sheet.rows.select("dataset_id").distinct(), "dataset_id", "left_anti").select(
        "dataset_id", F.lit("no values").alias("reason"))


def column_letter(index: Column) -> Column:
    """Letters of a column counted from 0, as spreadsheets name it: A, Z, AA."""
    left, letters = index.cast("long"), []
    for _ in range(7):  # seven letters reach beyond every int
        letters.append(F.when(left >= 0, F.char(F.lit(65) + left % 26)).otherwise(""))
        left = F.floor(left / 26) - 1
    return F.concat(*reversed(letters))


def file_row(row: Column, skipped: Column | int = 0, headers: Column | int = 1) -> Column:
    """Line of the file, from 1, of a data row from 0 behind so many skipped
    and header lines."""
    return row + F.coalesce(F.lit(skipped), F.lit(0)) + F.coalesce(F.lit(headers), F.lit(0)) + 1


def cell_range(col_lo: Column, col_hi: Column, row_lo: Column, row_hi: Column) -> Column:
    """A range of cells such as B12:D20, a single cell as B12; whole columns
    (no rows) as B:D, whole rows (no columns) as 12:20, nothing as null."""
    left = F.concat(F.when(col_lo.isNull(), "").otherwise(column_letter(col_lo)), F.coalesce(row_lo.cast("string"), F.lit("")))
    right = F.concat(F.when(col_hi.isNull(), "").otherwise(column_letter(col_hi)), F.coalesce(row_hi.cast("string"), F.lit("")))
    single = (left == right) & col_lo.isNotNull() & row_lo.isNotNull()
    return F.when(col_lo.isNull() & row_lo.isNull(), None).when(single, left).otherwise(F.concat_ws(":", left, right))


def placed(findings: DataFrame, layout: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``findings`` (row_lo, row_hi, cols) with ``place``, their range in the
    file. ``layout`` has skipped, headers and columns ARRAY<INT> (file column
    of each data column) per dataset; ``rows`` (dataset_id, row_idx, file_row)
    maps the rows of a sheet that lost some. Without them the sheet is the
    file, behind one header line."""
    df = findings.withColumn("_lo", F.col("row_lo")).withColumn("_hi", F.col("row_hi"))
    if rows is not None:
        for end in ("lo", "hi"):
            at = rows.select("dataset_id", F.col("row_idx").alias(f"_{end}"), F.col("file_row").alias(f"_f{end}"))
            df = df.join(at, ["dataset_id", f"_{end}"], "left").withColumn(f"_{end}", F.coalesce(f"_f{end}", f"_{end}")).drop(f"_f{end}")
    if layout is not None:
        df = df.join(layout.select("dataset_id", F.col("skipped").alias("_s"), F.col("headers").alias("_h"), F.col("columns").alias("_c")),
                     "dataset_id", "left")
    else:
        df = df.select("*", F.lit(0).alias("_s"), F.lit(1).alias("_h"), F.lit(None).cast("array<int>").alias("_c"))
    line = lambda c: file_row(F.col(c), F.col("_s"), F.col("_h"))
    first, last = F.array_min("cols"), F.array_max("cols")
    column = lambda c: F.coalesce(F.get("_c", c), c)
    return df.withColumn("place", cell_range(column(first), column(last), line("_lo"), line("_hi"))).drop("_lo", "_hi", "_s", "_h", "_c")
