"""Structured gaps: columns, conditions and rectangles that go missing together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.functions import special
from tamperscope.functions.adjust import bh_large, family_minimum
from tamperscope.functions.rows import sheet_sizes
from tamperscope.functions.stats import flag_from_p
from tamperscope.model import KEY, Outcome, Sheet, result_rows, unit_rows
from tamperscope.operators.ordered import islands
from tamperscope.session import materialize


def missing_rates(sheet: Sheet) -> DataFrame:
    gaps = sheet.rows.select(*KEY, F.posexplode("vals").alias("col", "v"))
    return gaps.groupBy(*KEY, "col").agg(
        F.count_if(F.col("v").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_rows")
    )


def pair_gaps(sheet: Sheet) -> DataFrame:
    """Rows in which both, one or neither column of a pair is missing, for all
    pairs of columns with gaps.

    Only the pairs of a row's own gaps are expanded; what one column alone
    lacks, and the rows that lack neither, follow from the columns' totals.
    """
    gaps = F.filter(F.transform("vals", lambda v, i: F.when(v.isNull(), i)), lambda i: i.isNotNull())
    holes = sheet.rows.select(*KEY, gaps.alias("h")).where(F.size("h") >= 2)
    per_row = F.flatten(F.transform("h", lambda a: F.transform(
        F.filter("h", lambda b: b > a), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))
    shared = holes.select(*KEY, F.explode(per_row).alias("p")).select(*KEY, "p.*").groupBy(*KEY, "c1", "c2").agg(
        F.count(F.lit(1)).alias("both"))
    rates = missing_rates(sheet).where("n_missing > 0")
    left = rates.select(*KEY, F.col("col").alias("c1"), F.col("n_missing").alias("_m1"), "n_rows")
    right = rates.select(*KEY, F.col("col").alias("c2"), F.col("n_missing").alias("_m2"))
    pairs = left.join(right, KEY).where("c1 < c2").join(shared, [*KEY, "c1", "c2"], "left").fillna(0, ["both"])
    only1, only2 = F.col("_m1") - F.col("both"), F.col("_m2") - F.col("both")
    return pairs.select(
        *KEY, "c1", "c2", "both", only1.alias("only1"), only2.alias("only2"),
        (F.col("n_rows") - F.col("both") - only1 - only2).alias("neither"))


def condition_gaps(sheet: Sheet) -> DataFrame:
    """Missing and present cells per column and condition."""
    cells = sheet.rows.where(F.col("cond").isNotNull()).select(*KEY, "cond", F.posexplode("vals").alias("col", "v"))
    return cells.groupBy(*KEY, "col", "cond").agg(
        F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v").isNotNull()).alias("present")
    )


def _condition_tests(sheet: Sheet) -> DataFrame:
    gaps = condition_gaps(sheet)
    total = gaps.groupBy(*KEY, "col").agg(
        F.sum("missing").alias("m"), F.sum("present").alias("q"), F.count(F.lit(1)).alias("k"),
        F.min_by(F.struct("missing", "present"), "cond").alias("first"),
        F.max_by(F.struct("missing", "present"), "cond").alias("last"),
    ).where("k >= 2 and m > 0")
    n = F.col("m") + F.col("q")
    size = F.col("missing") + F.col("present")

    def part(seen: Column, margin: Column) -> Column:
        expected = size * margin / n
        return F.when(expected > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)

    chi = gaps.join(total.select(*KEY, "col", "m", "q"), [*KEY, "col"]).groupBy(*KEY, "col").agg(
        F.sum(part(F.col("missing"), F.col("m")) + part(F.col("present"), F.col("q"))).alias("chi")
    )
    exact = special.fisher_exact(
        F.col("first.missing").cast("double"), F.col("first.present").cast("double"),
        F.col("last.missing").cast("double"), F.col("last.present").cast("double"),
    )
    return total.join(chi, [*KEY, "col"]).withColumn("exact_p", exact).withColumn(
        "chi_p", special.chi2_tail("chi", (F.col("k") - 1).cast("double"))
    ).withColumn("raw_p", F.when(F.col("k") == 2, F.col("exact_p")).otherwise(F.col("chi_p")))


def missing_blocks(sheet: Sheet) -> DataFrame:
    """Stretches of two or more rows in which a contiguous range of columns is
    missing throughout."""
    holes = sheet.rows.where(F.size("vals") >= 2)
    spans = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("vals") - 2),
        lambda i: F.transform(F.sequence(i + 1, F.size("vals") - 1),
                              lambda j: F.struct(i.cast("int").alias("c1"), j.cast("int").alias("c2"))),
    ))
    gone = holes.where(F.size(F.filter("vals", lambda v: v.isNull())) >= 2).select(
        *KEY, "row_idx", "vals", F.explode(spans).alias("s")
    ).select(*KEY, "row_idx", "vals", "s.*").where(
        F.forall(F.slice("vals", F.col("c1") + 1, F.col("c2") - F.col("c1") + 1), lambda v: v.isNull())
    ).drop("vals")
    runs = islands(gone, [*KEY, "c1", "c2"], "row_idx").where("length >= 2")
    rates = missing_rates(sheet).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "col", F.greatest(F.col("n_missing") / F.col("n_rows"), F.lit(1e-10)).alias("rate")))).alias("rates"),
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"),
    )
    width = F.col("c2") - F.col("c1") + 1
    log_p = F.aggregate(
        F.sequence("c1", "c2"), F.lit(0.0), lambda a, c: a + F.log(F.element_at(F.col("rates"), c))
    ) * F.col("length")
    places = (F.col("n_rows") - F.col("length") + 1) * F.greatest(F.lit(1), F.col("n_cols") - width + 1)
    # Written, the rates are known to be small: blocks aren't dealt by group to meet them.
    return runs.join(materialize(rates, "gap-rates"), KEY).withColumn(
        "raw_p", F.least(F.lit(1.0), F.exp(log_p) * places)
    ).drop("rates")


def _largest_blocks(blocks: DataFrame) -> DataFrame:
    """Drops a block lying inside a wider or taller one. The wider block covers
    the same start row, where a row meets at most one block per column range."""
    big = blocks.select(
        *KEY, F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"),
        F.explode(F.sequence(F.floor(F.col("lo") / 256), F.floor(F.col("hi") / 256))).alias("_cell"),
    )
    small = blocks.withColumn("_cell", F.floor(F.col("lo") / 256))
    on = (small["_cell"] == big["_cell"])
    for k in KEY:
        on = on & (small[k] == big[k])
    inside = (
        (F.col("b1") <= F.col("c1")) & (F.col("b2") >= F.col("c2")) & (F.col("b_lo") <= F.col("lo"))
        & (F.col("b_hi") >= F.col("hi")) & (F.col("b2") - F.col("b1") > F.col("c2") - F.col("c1"))
    )
    return small.join(big, on & inside, "left_anti").drop("_cell")


def missing_data_pattern(sheet: Sheet) -> Outcome:
    test = "Missing Data Pattern"
    pairs = pair_gaps(sheet).withColumn("raw_p", special.fisher_exact(
        *[F.col(c).cast("double") for c in ("both", "only1", "only2", "neither")]))
    conds = _condition_tests(sheet)
    blocks = _largest_blocks(materialize(missing_blocks(sheet), "gap-blocks"))
    label = F.concat_ws("-", F.col("c1") + 1, F.col("c2") + 1)
    null = F.lit(None).cast("bigint")
    family = pairs.select(
        *KEY, F.concat_ws(" ", F.lit("columns"), label).alias("unit"), F.col("both").cast("double").alias("stat"),
        "raw_p", null.alias("lo"), null.alias("hi"), F.array("c1", "c2").alias("cols"),
    ).unionByName(conds.select(
        *KEY, F.concat(F.lit("condition column "), F.col("col") + 1).alias("unit"), F.col("chi").alias("stat"),
        "raw_p", null.alias("lo"), null.alias("hi"), F.array("col").alias("cols"),
    )).unionByName(blocks.select(
        *KEY, F.concat_ws(" ", F.lit("block"), label).alias("unit"), F.col("length").cast("double").alias("stat"),
        "raw_p", "lo", "hi", F.sequence("c1", "c2").alias("cols"),
    ))
    family = materialize(family, "gaps")
    best = family_minimum(family, KEY)
    sums = missing_rates(sheet).groupBy(*KEY).agg(
        F.sum("n_missing").alias("n_missing"), F.sum("n_rows").alias("n_cells")
    )
    df = sheet_sizes(sheet.rows).join(sums, KEY).join(best, KEY, "left")
    rate = F.col("n_missing") / F.col("n_cells")
    cause = F.when(F.col("n_cols") < 2, "tooFewColumns").when(F.col("n_rows") < 10, "tooFewRows").when(
        (F.col("n_missing") < 10) | (rate < 0.01) | (rate > 0.50), "missingnessOutOfBand"
    ).when(F.lit(sheet.settings.assay == "genomics"), "assayNotApplicable").when(
        F.col("min_adj_p").isNull(), "missingnessOutOfBand"
    )
    result = result_rows(
        df, test, flag_from_p(F.col("min_adj_p")), F.col("min_adj_p"),
        {"missing": F.col("n_missing"), "rate": rate, "patterns": F.col("n_units")},
        na_cause=cause, na_observed=F.col("n_missing"), na_minimum=10.0,
    )
    return Outcome(
        lambda: unit_rows(
            bh_large(family, KEY), test, F.col("unit"), F.col("stat"), raw_p=F.col("raw_p"), adj_p=F.col("adj_p"),
            row_lo=F.col("lo"), row_hi=F.col("hi"), cols=F.col("cols"),
        ),
        result,
    )


