"""Long tables (one measurement per row) to sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.functions.values import to_number
from tamperscope.operators.ordered import dense_position


def detect_long_format(data: DataFrame) -> DataFrame:
    """Datasets that look long: at least 100 rows, one measured column, and a
    text column of 2 to 30 levels that divides the rows evenly.

    ``data``: dataset_id, row, cells ARRAY<STRING>.
    """
    sizes = data.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("n_cols"))
    cells = data.select("dataset_id", F.posexplode("cells").alias("col", "c")).where(F.trim("c") != "")
    v = to_number(F.col("c"))
    cols = cells.groupBy("dataset_id", "col").agg(
        F.count("c").alias("n"), F.count(v).alias("n_num"), F.count_distinct("c").alias("k"),
        F.count_if(v == F.floor(v)).alias("n_int")).join(sizes, "dataset_id").where(F.col("n") >= F.col("n_rows") * 0.5)
    share = F.col("n_num") / F.col("n")
    metadata = (F.col("n_int") / F.col("n") > 0.9) & (F.col("k") < F.col("n_rows") * 0.15)
    is_cond = (share < 0.3) & (F.col("k") >= 2) & (F.col("k") <= 30) & (F.col("k") < F.col("n_rows") * 0.3)
    crossed = is_cond & (F.col("n_rows") / F.col("k") >= 2) & (F.col("n_rows") % F.col("k") <= 1)
    measured = (share > 0.85) & ~metadata
    value = measured & (F.col("k") > F.greatest(F.lit(10), F.col("n_rows") * 0.05))
    identity = (F.col("k") > F.col("n_rows") * 0.3) & (share < 0.15)
    found = cols.groupBy("dataset_id", "n_rows", "n_cols").agg(
        F.min(F.when(crossed, F.col("col"))).alias("cond_col"), F.min(F.when(value, F.col("col"))).alias("measure_col"),
        F.count_if(measured).alias("n_measured"), F.min(F.when(identity, F.col("col"))).alias("id_col"))
    ok = (F.col("n_rows") >= 100) & (F.col("n_cols") >= 3) & F.col("cond_col").isNotNull() & F.col(
        "measure_col").isNotNull() & (F.col("n_measured") < 2)
    return found.where(ok).select("dataset_id", "cond_col", "measure_col", "id_col")


def pivot_long(data: DataFrame, shape: DataFrame, order: str = "row") -> DataFrame:
    """One row per subject with an array of values, one per condition in name
    order. The last measurement of a subject and condition wins. Without an
    identity column the n-th row of each condition is one subject."""
    rows = data.join(shape, "dataset_id")
    pick = lambda c: F.trim(F.get("cells", F.col(c)))
    long_ = rows.select(
        "dataset_id", order, pick("cond_col").alias("cond"), pick("measure_col").alias("raw"),
        F.when(F.col("id_col").isNotNull(), pick("id_col")).alias("id"),
    ).where(F.col("cond") != "")
    placed = dense_position(long_, ["dataset_id", "cond"], order)
    keyed = placed.withColumn("subject", F.coalesce(F.when(F.col("id") != "", F.col("id")), F.col("pos").cast("string")))
    last = keyed.groupBy("dataset_id", "subject", "cond").agg(F.max_by("raw", order).alias("raw"), F.min(order).alias("first"))
    conds = last.groupBy("dataset_id").agg(F.array_sort(F.collect_set("cond")).alias("conds"))
    wide = last.groupBy("dataset_id", "subject").agg(
        F.map_from_entries(F.collect_list(F.struct("cond", "raw"))).alias("m"), F.min("first").alias("file_row"))
    raws = F.transform("conds", lambda c: F.try_element_at(F.col("m"), c))
    out = wide.join(conds, "dataset_id").select("dataset_id", "subject", "file_row", "conds", raws.alias("raws"))
    return out.withColumn("vals", F.transform("raws", lambda c: to_number(c)))
