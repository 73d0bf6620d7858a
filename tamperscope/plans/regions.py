"""Where flagged tests point, and where several of them point together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.functions.stats import flag_rank
from tamperscope.operators.ordered import ordinal
from tamperscope.plans.verdict import mechanism_of
from tamperscope.session import materialize


def regions(results: DataFrame, units: DataFrame) -> DataFrame:
    """Row ranges and columns of the units behind each flagged test. A unit
    counts where its adjusted p (raw p if it has none) is below 0.01, or where
    the test lists only its hits."""
    flagged = results.where(F.col("flag").isin("HIGH", "MODERATE")).select("dataset_id", "test", "flag")
    p = F.coalesce("adj_p", "raw_p")
    hit = p.isNull() | (p < 0.01)
    return units.where(hit & (F.col("row_lo").isNotNull() | F.col("cols").isNotNull())).join(
        flagged, ["dataset_id", "test"]).select(
        "dataset_id", "test", mechanism_of(F.col("test")).alias("mechanism"), "flag", "row_lo", "row_hi", "cols")


def cell_runs(regions_: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per column, maximal row stretches covered by the same set of tests.

    A sweep over range ends: between two neighbouring cuts the covering set
    cannot change, so ranges are never expanded into single cells.
    """
    full = regions_.join(sizes.select("dataset_id", "n_rows", "n_cols"), "dataset_id").withColumn(
        "lo", F.coalesce("row_lo", F.lit(0))).withColumn("hi", F.coalesce("row_hi", F.col("n_rows") - 1)).withColumn(
        "col", F.explode(F.coalesce("cols", F.sequence(F.lit(0), F.col("n_cols") - 1))))
    spans = full.select("dataset_id", "col", "test", "mechanism", flag_rank(F.col("flag")).alias("sev"), "lo", "hi")
    # Overlapping ranges of one test count once: merge them first.
    by_test = Window.partitionBy("dataset_id", "col", "test").orderBy("lo", "hi")
    reach = F.max("hi").over(by_test.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)).withColumn(
        "_g", F.sum("_new").over(by_test.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy("dataset_id", "col", "test", "mechanism", "_g").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("sev").alias("sev")).drop("_g")
    cuts = spans.select("dataset_id", "col", F.col("lo").alias("at")).unionByName(
        spans.select("dataset_id", "col", (F.col("hi") + 1).alias("at"))).distinct()
    along = Window.partitionBy("dataset_id", "col").orderBy("at")
    pieces = cuts.withColumn("until", F.lead("at").over(along) - 1).where(F.col("until").isNotNull())
    # A span is dealt to the 4096-row cells it crosses, and so is a piece, so
    # that covering sets are found by an equality join.
    deal = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / 4096), F.floor(F.col(hi) / 4096)))
    met = pieces.withColumn("_c", F.floor(F.col("at") / 4096)).join(
        spans.withColumn("_c", deal("lo", "hi")), ["dataset_id", "col", "_c"]
    ).where((F.col("lo") <= F.col("at")) & (F.col("hi") >= F.col("until")))
    return met.groupBy("dataset_id", "col", "at", "until").agg(
        F.count_distinct("test").alias("n_tests"), F.array_sort(F.collect_set("test")).alias("tests"),
        F.array_sort(F.collect_set("mechanism")).alias("mechanisms"), F.max("sev").alias("max_severity"),
    ).select("dataset_id", "col", F.col("at").alias("row_lo"), F.col("until").alias("row_hi"), "n_tests", "tests",
             "mechanisms", "max_severity")


def hotspots(runs: DataFrame, min_depth: int = 2) -> DataFrame:
    """8-connected areas in which at least ``min_depth`` tests meet.

    Runs of qualifying cells, not cells, are linked: two runs touch where their
    columns differ by at most one and their rows are at most one apart.
    """
    deep = materialize(runs, "cell-runs").where(F.col("n_tests") >= min_depth)
    # Neighbouring runs of one column first become one stretch.
    rows = deep.select("dataset_id", "col", "row_lo", "row_hi", "n_tests", "tests", "mechanisms", "max_severity")
    along = Window.partitionBy("dataset_id", "col").orderBy("row_lo")
    rows = rows.withColumn("_new", F.when(F.col("row_lo") == F.lag("row_hi").over(along) + 1, 0).otherwise(1)).withColumn(
        "_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = rows.groupBy("dataset_id", "col", "_g").agg(
        F.min("row_lo").alias("lo"), F.max("row_hi").alias("hi"), F.max("n_tests").alias("max_count"),
        F.array_distinct(F.flatten(F.collect_set("tests"))).alias("tests"),
        F.array_distinct(F.flatten(F.collect_set("mechanisms"))).alias("mechanisms"),
        F.max("max_severity").alias("max_severity"),
    ).drop("_g")
    stretch = materialize(
        ordinal(stretch, ["dataset_id"], ["lo", "col"], "id", "stretches").withColumn("cells", F.col("hi") - F.col("lo") + 1),
        "stretches")
    label = _component_labels(stretch)
    parts = stretch.join(label, ["dataset_id", "id"]).groupBy("dataset_id", "label").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("col").alias("c_lo"), F.max("col").alias("c_hi"),
        F.sum("cells").alias("cells"), F.max("max_count").alias("max_count"),
        F.array_distinct(F.flatten(F.collect_set("tests"))).alias("tests"),
        F.array_distinct(F.flatten(F.collect_set("mechanisms"))).alias("mechanisms"),
        F.max("max_severity").alias("max_severity"))
    area = (F.col("hi") - F.col("lo") + 1) * (F.col("c_hi") - F.col("c_lo") + 1)
    dense = parts.withColumn("density", F.col("cells") / area).where(F.col("density") >= 0.3)
    near = Window.partitionBy("dataset_id").orderBy("lo", "hi", "c_lo")
    reach2 = F.max("hi").over(near.rowsBetween(Window.unboundedPreceding, -1))
    merged = dense.withColumn("_n", F.when(reach2.isNull() | (F.col("lo") > reach2 + 2), 1).otherwise(0)).withColumn(
        "_m", F.sum("_n").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy("dataset_id", "_m").agg(
        F.min("lo").alias("row_lo"), F.max("hi").alias("row_hi"), F.min("c_lo").alias("col_lo"),
        F.max("c_hi").alias("col_hi"), F.sum("cells").alias("n_cells"), F.max("max_count").alias("max_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tests")))).alias("tests"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("mechanisms")))).alias("mechanisms"),
        F.max("max_severity").alias("max_severity"),
    ).drop("_m")
    return out.withColumn("score", F.col("max_count") * F.size("tests"))


def _component_labels(stretch: DataFrame) -> DataFrame:
    """Smallest stretch id of each connected area: dataset_id, id, label.

    Stretches of neighbouring columns meet in the 4096-row cells they cross.
    Labels take the smallest neighbour's label and then jump to their label's
    label, so the rounds grow with the logarithm of an area's extent.
    """
    own = stretch.select("dataset_id", "id", "col", "lo", "hi", F.explode(F.sequence(
        F.floor((F.col("lo") - 1) / 4096), F.floor((F.col("hi") + 1) / 4096))).alias("_c"))
    right = own.select("dataset_id", "_c", F.col("id").alias("other"), (F.col("col") - 1).alias("col"),
                       F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    touch = own.join(right, ["dataset_id", "_c", "col"]).where(
        (F.col("o_lo") <= F.col("hi") + 1) & (F.col("o_hi") >= F.col("lo") - 1)).select("dataset_id", "id", "other").distinct()
    links = materialize(touch.unionByName(touch.select("dataset_id", F.col("other").alias("id"), F.col("id").alias("other"))), "links")
    nodes = stretch.select("dataset_id", "id", F.col("id").alias("label"))
    while True:
        near = links.join(nodes.select("dataset_id", F.col("id").alias("other"), F.col("label").alias("_l")),
                          ["dataset_id", "other"]).groupBy("dataset_id", "id").agg(F.min("_l").alias("_near"))
        hooked = nodes.join(near, ["dataset_id", "id"], "left").withColumn("_old", F.col("label")).withColumn(
            "label", F.least("label", F.coalesce("_near", "label"))).drop("_near")
        jump = nodes.select("dataset_id", F.col("id").alias("label"), F.col("label").alias("_next"))
        moved = materialize(hooked.join(jump, ["dataset_id", "label"], "left").select(
            "dataset_id", "id", F.least("label", F.coalesce("_next", "label")).alias("label"), "_old"), "labels")
        nodes = moved.drop("_old")
        if moved.where(F.col("label") != F.col("_old")).isEmpty():
            return nodes


def pattern_class(runs: DataFrame, spots: DataFrame, sizes: DataFrame) -> DataFrame:
    """saturated, sparse, scattered or clean."""
    flagged = runs.groupBy("dataset_id").agg(F.sum(F.col("row_hi") - F.col("row_lo") + 1).alias("n_flagged"))
    n_spots = spots.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_hotspots"))
    df = sizes.select("dataset_id", "n_rows", "n_cols").join(flagged, "dataset_id", "left").join(
        n_spots, "dataset_id", "left").fillna(0, ["n_flagged", "n_hotspots"])
    share = F.col("n_flagged") / (F.col("n_rows") * F.col("n_cols"))
    return df.withColumn("pattern", F.when(share > 0.5, "saturated").when(F.col("n_hotspots") > 0, "sparse").when(
        F.col("n_flagged") > 0, "scattered").otherwise("clean"))

