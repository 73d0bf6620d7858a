"""Settings as a table: one row per dataset, looked up wherever a plan needs them."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.model import Settings, Sheet
from tamperscope.operators.ordered import ordinal
from tamperscope.plans.battery_status import subject_pairing
from tamperscope.plans.transform import choose_transform

#: Columns of a settings table; any may be missing or null.
NAMES = [f.name for f in fields(Settings) if f.name != "seed"]
TYPES = {"paired": "boolean", "pivoted": "boolean"}


def settings_rows(sheet: Sheet, given: DataFrame | None = None) -> DataFrame:
    """(dataset_id, NAMES, zero_as_missing) of every dataset of the sheet:
    what ``given`` says of it, else the sheet's own settings."""
    every = sheet.rows.select("dataset_id").distinct()
    has = set(given.columns) if given is not None else set()
    joined = every.join(given, "dataset_id", "left") if given is not None else every

    def value(name: str, default) -> Column:
        kind = TYPES.get(name, "string")
        own = F.lit(default).cast(kind)
        return F.coalesce(F.col(name).cast(kind), own) if name in has else own

    zero = F.coalesce(F.col("zero_as_missing"), F.lit(False)) if "zero_as_missing" in has else F.lit(False)
    return joined.select("dataset_id", *[value(n, getattr(sheet.settings, n)).alias(n) for n in NAMES], zero.alias("zero_as_missing"))


def read_off(sheet: Sheet, settings: DataFrame) -> DataFrame:
    """Settings with what the data themselves decide: the transform where it
    is ``auto``, and pairing where every condition holds the same subjects."""
    chosen = choose_transform(sheet, settings).select("dataset_id", F.col("transform").alias("_t"))
    pairs = subject_pairing(sheet).select("dataset_id", F.col("paired").alias("_p"))
    joined = settings.join(chosen, "dataset_id", "left").join(pairs, "dataset_id", "left")
    return joined.withColumn("transform", F.when(F.col("transform") == "auto", F.coalesce("_t", F.lit("raw"))).otherwise(F.col("transform"))
                             ).withColumn("paired", F.col("paired") | F.coalesce("_p", F.lit(False))).drop("_t", "_p")


def zeros_as_missing(sheet: Sheet, settings: DataFrame) -> Sheet:
    """The sheet with zeros taken out of the datasets that ask for it; rows
    left without a value go, and positions are dense again."""
    asked = settings.where("zero_as_missing").select("dataset_id")
    if asked.isEmpty():
        return sheet
    others = sheet.rows.join(asked, "dataset_id", "left_anti")
    held = sheet.rows.join(asked, "dataset_id", "left_semi")
    cleared = held.withColumn("vals", F.transform("vals", lambda v: F.when(v != 0, v)))
    cleared = cleared.withColumn("raws", F.zip_with("raws", "vals", lambda r, v: F.when(v.isNotNull(), r)))
    cleared = cleared.where(F.exists("vals", lambda v: v.isNotNull())).withColumnRenamed("row_idx", "_was")
    placed = ordinal(cleared, ["dataset_id"], ["_was"], "row_idx", "zeros").drop("_was")
    return sheet.with_rows(others.unionByName(placed.select(*others.columns)))


def facts(settings: DataFrame) -> DataFrame:
    """(dataset_id, fact): what the settings of a dataset say, as gate rules name it."""
    said = F.array_compact(F.array(
        F.concat(F.lit("data type "), F.col("data_type")),
        F.when((F.col("column_relationship") == "conditions") & ~F.col("paired"), F.lit("columns are conditions")),
        F.when(F.col("row_semantics") == "arbitrary", F.lit("row order arbitrary")),
        F.when(F.col("paired"), F.lit("subjects shared"))))
    return settings.select("dataset_id", F.explode(said).alias("fact"))


def classes(settings: DataFrame) -> list[Settings]:
    """The different settings of a corpus: a few choices each, so few rows
    whatever the number of datasets. An assay matters where a test asks for it."""
    known = F.when(F.col("assay").isin(*ASSAYS), F.col("assay")).otherwise("general")
    rows = settings.withColumn("assay", known).select(*NAMES).distinct().orderBy(*NAMES).collect()
    return [Settings(**r.asDict()) for r in rows]


def of_class(settings: DataFrame, kind: Settings) -> DataFrame:
    """Datasets with these settings."""
    known = F.when(F.col("assay").isin(*ASSAYS), F.col("assay")).otherwise("general")
    same = [(known if n == "assay" else F.col(n)) == F.lit(getattr(kind, n)) for n in NAMES]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return settings.where(on).select("dataset_id")


#: Assays that a test or the transform treats in its own way.
ASSAYS = ("densitometry", "elisa", "genomics", "proteomics", "qpcr", "cell_count", "plate_reader", "physiological", "survey")
