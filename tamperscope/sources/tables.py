"""Sheets built from tables that already live in a warehouse."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamperscope.functions.values import finite
from tamperscope.model import ALL, Settings, Sheet
from tamperscope.operators.ordered import ordinal
from tamperscope.session import materialize

_BUILT: dict[tuple, DataFrame] = {}


def sheet_rows(
    df: DataFrame,
    values: Column,
    order: list[str],
    *,
    dataset: Column | None = None,
    cond: Column | None = None,
    subject: Column | None = None,
    raws: Column | None = None,
    name: str = "sheet",
) -> DataFrame:
    """Any DataFrame as sheet rows: non-finite cells become null, rows without
    a single value are dropped, and row_idx is the dense row order."""
    vals = F.transform(values, lambda v: finite(v.cast("double")))
    # A typed column has no source text; digits are then read off the number.
    text = raws if raws is not None else F.transform("vals", lambda v: F.lit(None).cast("string"))
    null = F.lit(None).cast("string")
    shaped = (
        df.withColumn("vals", vals)
        .where(F.exists("vals", lambda v: v.isNotNull()))
        .select(
            (dataset if dataset is not None else F.lit("sheet")).cast("string").alias("dataset_id"),
            F.lit(ALL).alias("grp"),
            (cond if cond is not None else null).cast("string").alias("cond"),
            (subject if subject is not None else null).cast("string").alias("subject"),
            "vals",
            text.alias("raws"),
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        )
    )
    keys = [f"_o{i}" for i in range(len(order))]
    return ordinal(shaped, ["dataset_id"], keys, "row_idx", name).drop(*keys)


def _fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under ``path``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    statuses = fs.globStatus(where)
    found = []
    for s in statuses or []:
        for f in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
            found.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return str(sorted(found))


def built_once(spark: SparkSession, name: str, paths: list[str], build) -> DataFrame:
    """A sheet is extracted once per session and source state, then every test
    reads that table."""
    key = (spark.sparkContext.applicationId, name, *[(p, _fingerprint(spark, p)) for p in paths])
    if key not in _BUILT:
        _BUILT[key] = materialize(build(), name)
    return _BUILT[key]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events_sheet(spark: SparkSession, sf_dir: str, per_user: bool = False) -> Sheet:
    """events.value in time order; conditions are event types. With
    ``per_user`` every user is a dataset of its own."""

    def build() -> DataFrame:
        ev = _read(spark, sf_dir, "events")
        return sheet_rows(
            ev, F.array("value"), ["ts", "event_id"], cond=F.col("event_type"),
            dataset=F.col("user_id") if per_user else F.lit("events"), name="events",
        )

    name = "events_by_user" if per_user else "events"
    return Sheet(built_once(spark, name, [f"{sf_dir}/events.parquet"], build))


def column_sheet(spark: SparkSession, sf_dir: str, table: str, column: str, order: list[str]) -> Sheet:
    """One numeric column of one table as a one-column sheet."""

    def build() -> DataFrame:
        df = _read(spark, sf_dir, table)
        return sheet_rows(df, F.array(column), order, dataset=F.lit(column), name=column)

    return Sheet(built_once(spark, column, [f"{sf_dir}/{table}.parquet"], build))


#: Columns of the order sheet; an order with more lines goes on in a further row.
ORDER_LINES = 4


def order_lines_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """All line prices of each order, four to a row as four replicates;
    conditions are order priorities and rows follow the order date."""

    def build() -> DataFrame:
        line = _read(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        )
        first = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        )
        # The window, the rows and the join share one partitioning by order.
        place = F.row_number().over(first) - 1
        placed = line.withColumn("_part", F.floor(place / ORDER_LINES)).withColumn("_slot", place % ORDER_LINES)
        wide = placed.groupBy("l_orderkey", "_part").agg(
            *[F.max(F.when(F.col("_slot") == i, F.col("l_extendedprice"))).alias(f"v{i}") for i in range(ORDER_LINES)]
        )
        orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        joined = wide.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return sheet_rows(
            joined,
            F.array(*[f"v{i}" for i in range(ORDER_LINES)]),
            ["o_orderdate", "o_orderkey", "_part"],
            dataset=F.lit("orders"), cond=F.col("o_orderpriority"), subject=F.col("o_orderkey"),
            name="order-lines",
        )

    paths = [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet"]
    return Sheet(built_once(spark, "order_lines", paths, build))


def embedding_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """All embedding dimensions as columns; conditions are labels."""

    def build() -> DataFrame:
        return sheet_rows(
            _read(spark, sf_dir, "embeddings"), F.col("embedding"), ["vec_id"], dataset=F.lit("embeddings"),
            cond=F.col("label"), subject=F.col("vec_id"), name="embeddings",
        )

    return Sheet(built_once(spark, "embeddings", [f"{sf_dir}/embeddings.parquet"], build))


def with_settings(sheet: Sheet, **changes) -> Sheet:
    return replace(sheet, settings=replace(sheet.settings, **changes))


__all__ = [
    "Settings", "built_once", "column_sheet", "embedding_sheet", "events_sheet",
    "order_lines_sheet", "sheet_rows", "with_settings",
]
