"""One query per operator over the warehouse tables, as (session, folder) -> table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperscope.functions.rows import pair_values
from tamperscope.functions.stats import chi2_sf
from tamperscope.model import Sheet
from tamperscope.operators import (
    conditions, digits, duplicates, missing, multivariate, noise, offsets, replicates, shapes,
)
from tamperscope.plans import battery, datasets, gates, regions, settings, transform, verdict
from tamperscope.sources import tables
from tamperscope.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

PRICE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER = [*PRICE_ORDER, "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def prices(spark: SparkSession, sf: str) -> Sheet:
    return tables.column_sheet(spark, sf, "lineitem", "l_extendedprice", PRICE_ORDER)


def quantities(spark: SparkSession, sf: str) -> Sheet:
    return tables.column_sheet(spark, sf, "lineitem", "l_quantity", LINE_ORDER)


def line_measures(spark: SparkSession, sf: str) -> Sheet:
    """Quantity, line number, discount and tax of every line as four columns."""

    def build() -> DataFrame:
        line = spark.read.parquet(f"{sf}/lineitem.parquet")
        vals = F.array("l_quantity", F.col("l_linenumber").cast("double"), "l_discount", "l_tax")
        return tables.sheet_rows(line, vals, LINE_ORDER, dataset=F.lit("lines"), name="lines")

    return Sheet(tables.built_once(spark, "lines", [f"{sf}/lineitem.parquet"], build))


def r(column: str, digits_: int = 6):
    return F.round(F.col(column), digits_).alias(column)


def _digit_table(df: DataFrame, low: int, probs, dof: int) -> DataFrame:
    cols = [F.col(f"d{d}") for d in range(low, 10)]
    total, chi, mad = digits.goodness(cols, list(probs))
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("digit"), F.col(f"d{d}").alias("observed")) for d in range(low, 10)]))
    return df.select(
        total.alias("n"), F.round(chi, 6).alias("chi2"), F.round(mad, 9).alias("mad"),
        F.round(chi2_sf(chi, dof), 9).alias("p_chi2"), F.round("span", 6).alias("span"), rows.alias("u"),
    ).select("u.digit", "u.observed", "n", "chi2", "mad", "p_chi2", "span")


def benford_first(spark, sf):
    return _digit_table(digits.digit_counts(tables.events_sheet(spark, sf), 1), 1, digits.FIRST_DIGIT, 8)


def benford_second(spark, sf):
    return _digit_table(digits.digit_counts(prices(spark, sf), 2), 0, digits.SECOND_DIGIT, 9)


def terminal_digit(spark, sf):
    """Last-digit verdict of every user's events, one small sheet per user."""
    out = digits.terminal_digit(tables.events_sheet(spark, sf, per_user=True)).result
    return out.select(
        "dataset_id", "flag", F.round("primary_p", 9).alias("p"), F.col("stats")["n"].alias("n"),
        F.round(F.col("stats")["chi2"], 6).alias("chi2"), F.col("stats")["df"].alias("df"), "na_cause")


def decimal_precision(spark, sf):
    return digits.precision_levels(tables.events_sheet(spark, sf)).select(
        "dp", "observed", "total", F.round("expected", 6).alias("expected"))


def value_spike(spark, sf):
    """Tested keys of a whole-number column and of a two-decimal column."""
    def part(name: str, sheet: Sheet) -> DataFrame:
        return digits.spike_neighbourhoods(sheet).select(
            F.lit(name).alias("sheet"), F.col("pass").alias("kind"), F.col("key"), "obs", "n_near",
            F.round("smoothed", 6).alias("smoothed"), F.round("ratio", 6).alias("ratio"))

    return part("quantity", quantities(spark, sf)).unionByName(part("events", tables.events_sheet(spark, sf)))


def value_collisions(spark, sf):
    return duplicates.value_collisions(tables.events_sheet(spark, sf)).select(
        "n", "n_distinct", "colliding_pairs", "over_represented", F.round("hhi", 12).alias("hhi"), "modal_dp")


def duplicate_rows(spark, sf):
    return duplicates.duplicate_rows(line_measures(spark, sf)).select("first_row", "last_row", "n_copies")


def within_row_matches(spark, sf):
    return duplicates.within_row_bins(line_measures(spark, sf)).select(
        "bin", "n_rows", "n_pairs", "matches", F.round("expected", 6).alias("expected"))


def column_concentration(spark, sf):
    return duplicates.column_concentration(line_measures(spark, sf)).select(
        "col", "n_col", F.round("hhi", 9).alias("hhi"), F.round("row_hhi", 9).alias("row_hhi"))


def sequential_duplication(spark, sf):
    return duplicates.sequential_runs(quantities(spark, sf)).select("d", "lo", "hi", "height", "changes")


def block_copies(spark, sf):
    return duplicates.partial_blocks(line_measures(spark, sf)).select(
        "d", F.array_join("cols", ",").alias("cols"), "lo", "hi", "height")


def column_streaks(spark, sf):
    return duplicates.column_streaks(line_measures(spark, sf)).select(
        F.array_join("cols", ",").alias("cols"), "lo", "hi", "height")


def partial_rows(spark, sf):
    return duplicates.partial_rows(tables.order_lines_sheet(spark, sf)).select("n_pairs", "n_groups")


def exact_duplicates(spark, sf):
    return verdict_rows(duplicates.exact_duplicates(line_measures(spark, sf)).result)


def constant_offset(spark, sf):
    return offsets.offset_counts(line_measures(spark, sf)).select(
        "kind", "c1", "c2", "n", "steps", "blocks", F.round("expected", 3).alias("expected"))


def pair_autocorrelation(spark, sf):
    df = replicates.pair_autocorrelation(tables.order_lines_sheet(spark, sf))
    return df.select("c1", "c2", "n", *[r(f"r{k}", 8) for k in replicates.LAGS], F.round("raw_p", 7).alias("p"))


def windowed_autocorrelation(spark, sf):
    return replicates.windowed_lag1(tables.order_lines_sheet(spark, sf)).select(
        "c1", "c2", "w", r("r", 7), "row_lo", "row_hi")


def runs_test(spark, sf):
    return replicates.pair_runs(tables.order_lines_sheet(spark, sf)).select(
        "c1", "c2", "n_pos", "n_neg", "runs", r("expected"), r("z"), F.round("raw_p", 7).alias("p"))


def row_mean_runs(spark, sf):
    return noise.row_mean_runs_table(tables.order_lines_sheet(spark, sf)).select(
        F.col("grp").alias("cond"), "n_pos", "n_neg", "runs", r("z"), F.round("raw_p", 7).alias("p"))


def noise_scaling(spark, sf):
    return replicates.noise_slope(tables.order_lines_sheet(spark, sf)).select(
        "n", r("slope"), r("se"), F.round("decades", 6).alias("mean_range"), "blocks_used", r("q", 3), r("block_se", 5))


def selective_noise(spark, sf):
    sheet = tables.order_lines_sheet(spark, sf)
    both = noise.bartlett(sheet).unionByName(noise.bartlett(sheet.by_condition()))
    return both.select("grp", "n_cells", "k", r("ratio"), r("bartlett", 5))


def column_levene(spark, sf):
    return noise.column_levene(tables.order_lines_sheet(spark, sf)).select("col", "n", r("f", 5), "direction")


def within_row_variance(spark, sf):
    return replicates.within_row_bins(tables.order_lines_sheet(spark, sf)).select(
        "bin", "n_bin", r("mid_mean", 4), r("mid_sd", 4), r("mad_sd", 4))


def regional_noise(spark, sf):
    return noise.regional_windows(tables.order_lines_sheet(spark, sf)).select(
        "w", "col", "row_lo", "row_hi", r("ratio", 5))


def loess_cusum(spark, sf):
    series = noise.noise_profile(tables.order_lines_sheet(spark, sf))
    return noise.loess_windows(noise.loess_residuals(series, ["dataset_id", "grp"]), ["dataset_id", "grp"]).select(
        "w", "row_lo", "row_hi", r("ratio", 5))


def changepoint(spark, sf):
    return noise.changepoint(noise.noise_profile(tables.order_lines_sheet(spark, sf)), ["dataset_id", "grp"]).select(
        "n", r("max_cusum", 2), "row_at", r("sd", 4))


def replicate_correlation(spark, sf):
    return replicates.pair_correlations(tables.order_lines_sheet(spark, sf)).select(
        F.col("grp").alias("cond"), "c1", "c2", "n", r("r", 7), r("others", 7), r("z", 5))


def excess_kurtosis(spark, sf):
    return replicates.pair_kurtosis(tables.order_lines_sheet(spark, sf)).select("c1", "c2", "n", r("kurtosis"), r("z", 5))


def entropy(spark, sf):
    return shapes.column_entropy(tables.events_sheet(spark, sf).by_condition()).select(
        F.col("grp").alias("cond"), "prec", "n", "n_distinct", r("entropy", 7))


def column_gof(spark, sf):
    return shapes.column_ad(tables.embedding_sheet(spark, sf).by_condition()).select(
        F.col("grp").alias("cond"), "col", "n", r("skew"), r("kurt"), r("a2", 5))


def modality(spark, sf):
    return verdict_rows(shapes.modality(tables.embedding_sheet(spark, sf).by_condition()).result)


def mahalanobis_rows(spark, sf):
    return multivariate.row_distances(tables.order_lines_sheet(spark, sf)).select("row_idx", "n", r("d2"))


def blocked_mahalanobis(spark, sf):
    return multivariate.block_windows(tables.order_lines_sheet(spark, sf)).select(
        F.col("grp").alias("cond"), "w", "row_lo", "row_hi", r("tsq"), r("lambda"))


def residual_spike(spark, sf):
    return conditions.spike_overlaps(tables.order_lines_sheet(spark, sf)).select(
        "a", "b", "n_rows", "top_k", "overlap", r("expected"))


def rank_correlation(spark, sf):
    return conditions.pair_spearman(
        conditions.condition_profiles(tables.order_lines_sheet(spark, sf)), "y", 5).select("a", "b", "n", r("rho", 8))


def baseline_balance(spark, sf):
    return conditions.balance_features(tables.embedding_sheet(spark, sf)).select("feature", "k", "n", r("f"))


def condition_consistency(spark, sf):
    return conditions.condition_properties(tables.order_lines_sheet(spark, sf)).select(
        "cond", "n", r("span", 4), r("mad", 4), r("resid_sd", 4), r("resid_kurt"), r("lag_z", 7), "n_points", r("slope"))


def missing_pattern(spark, sf):
    return missing.pair_gaps(tables.order_lines_sheet(spark, sf)).select("c1", "c2", "both", "only1", "only2", "neither")


def missing_by_condition(spark, sf):
    return missing.condition_gaps(tables.order_lines_sheet(spark, sf)).select("col", "cond", "missing", "present")


def missing_blocks(spark, sf):
    return missing.missing_blocks(tables.order_lines_sheet(spark, sf)).select(
        "c1", "c2", "lo", "hi", "length", F.round("raw_p", 9).alias("p"))


def vst_choice(spark, sf):
    sheets = [tables.order_lines_sheet(spark, sf), tables.embedding_sheet(spark, sf), line_measures(spark, sf)]
    out = None
    for s in sheets:
        part = transform.choose_transform(s).select(
            "dataset_id", r("integer_share"), r("positive_share"), r("negative_share"), "n_points", r("slope"),
            r("slope_se"), "transform")
        out = part if out is None else out.unionByName(part)
    return out


def group_aggregation(spark, sf):
    """Last-digit verdicts of the event types as groups of one dataset."""
    per_group = digits.terminal_digit(tables.events_sheet(spark, sf).by_condition()).result
    return verdict.aggregate_groups(per_group).select(
        "dataset_id", "flag", F.round("primary_p", 8).alias("p"), F.round(F.col("stats")["sidak_p"], 8).alias("sidak_p"),
        F.round(F.col("stats")["fisher_p"], 8).alias("fisher_p"))


def dataset_gates(spark, sf):
    """What the gates read for every user's sheet, and how many tests run."""
    sheet = tables.events_sheet(spark, sf, per_user=True)
    summary = gates.dataset_summary(sheet)
    runs = gates.gates(sheet, summary).groupBy("dataset_id").agg(F.count_if("runs").alias("n_tests"))
    return summary.join(runs, "dataset_id").select(
        "dataset_id", "n_rows", "n_values", "n_conditions", "n_decimal", F.round("span", 6).alias("span"), "n_tests")


def _mixed_corpus(spark, sf) -> tuple[Sheet, DataFrame]:
    """Every user's events and the order lines as one corpus, with a settings
    row for each dataset: what a user says depends on the user's number."""
    users, orders = tables.events_sheet(spark, sf, per_user=True), tables.order_lines_sheet(spark, sf)
    sheet = users.with_rows(users.rows.unionByName(orders.rows))
    kind = F.when(F.col("dataset_id") == "orders", 0).otherwise(F.expr("try_cast(dataset_id AS bigint)") % 5)
    given = sheet.rows.select("dataset_id").distinct().withColumn("_k", kind).select(
        "dataset_id", F.when(F.col("_k") == 0, "survey").when(F.col("_k") == 1, "cell_count").alias("assay"),
        F.when(F.col("_k") == 0, "ordinal").when(F.col("_k") == 1, "count").alias("data_type"),
        F.when(F.col("_k") == 2, "conditions").alias("column_relationship"),
        F.when(F.col("_k").isin(1, 2), "arbitrary").alias("row_semantics"), (F.col("_k") == 3).alias("paired"))
    return sheet, given


def mixed_gates(spark, sf):
    """Every dataset's 29 tests under its own settings."""
    sheet, given = _mixed_corpus(spark, sf)
    rows = settings.settings_rows(sheet, given)
    return gates.gates(sheet, settings=rows).select(
        "dataset_id", "test", "mechanism", "runs", "na_cause", F.round("na_observed", 6).alias("na_observed"), "na_minimum")


def dataset_report(spark, sf):
    """Missing cells and plausibility of every dataset under its own assay."""
    sheet, given = _mixed_corpus(spark, sf)
    assays = F.array(*[F.lit(a) for a in ("qpcr", "cell_count", "elisa", "plate_reader", "genomics")])
    kind = F.when(F.col("dataset_id") == "orders", 2).otherwise(F.expr("try_cast(dataset_id AS bigint)") % 5)
    rows = settings.settings_rows(sheet, given.withColumn("assay", F.get(assays, kind.cast("int"))))
    return datasets.dataset_report(sheet, rows).select(
        "dataset_id", "n_rows", "n_cols", F.round("missing_share", 9).alias("missing_share"), "mostly_missing", "hint_level", "hint")


def streak_places(spark, sf):
    """Cells of the file in which two columns are equal for three rows or more."""
    runs = duplicates.column_streaks(line_measures(spark, sf)).select(
        "dataset_id", F.col("lo").alias("row_lo"), F.col("hi").alias("row_hi"), "cols", "height")
    return datasets.placed(runs).select("place", "height")


def _user_results(spark, sf) -> DataFrame:
    sheet = tables.events_sheet(spark, sf, per_user=True)
    return digits.terminal_digit(sheet).result.unionByName(digits.decimal_precision(sheet).result)


def severity(spark, sf):
    return verdict.severity(digits.terminal_digit(tables.events_sheet(spark, sf, per_user=True)).result).select(
        "dataset_id", "n_high", "n_moderate", "n_mechanisms", "severity")


def coverage(spark, sf):
    return verdict.coverage(_user_results(spark, sf)).select("dataset_id", "ran", "notApplicable", "total")


def _flagged(spark, sf) -> tuple[Sheet, DataFrame, DataFrame]:
    sheet = tables.order_lines_sheet(spark, sf)
    gaps, rows = missing.missing_data_pattern(sheet), multivariate.mahalanobis_rows(sheet)
    results = materialize(gaps.result.unionByName(rows.result), "results")
    return sheet, results, materialize(gaps.units.unionByName(rows.units), "units")


def region_table(spark, sf):
    _, results, units = _flagged(spark, sf)
    return regions.regions(results, units).select("test", "mechanism", "flag", "row_lo", "row_hi", "cols")


def hotspots(spark, sf):
    """Areas the flagged gap patterns of the order lines cover."""
    sheet, results, units = _flagged(spark, sf)
    sizes = gates.dataset_summary(sheet)
    return regions.hotspots(regions.cell_runs(regions.regions(results, units), sizes), min_depth=1)


def findings(spark, sf):
    _, results, units = _flagged(spark, sf)
    return verdict.findings(results, regions.regions(results, units))


def grouping_status(spark, sf):
    return battery.grouping_status(tables.order_lines_sheet(spark, sf)).select(
        "dataset_id", "n_groups", "smallest", "largest", "median_size", "usable", "pending")


def verdict_rows(result: DataFrame) -> DataFrame:
    return result.select("dataset_id", "grp", "test", "flag", F.round("primary_p", 9).alias("primary_p"), "na_cause", "null_method")


def _verdict(run, sheet_of) -> Query:
    return lambda spark, sf: verdict_rows(run(sheet_of(spark, sf)).result)


def differences(spark, sf):
    """Mean and spread of every replicate pair's differences."""
    pairs = pair_values(tables.order_lines_sheet(spark, sf).rows).withColumn("d", F.col("a") - F.col("b"))
    return pairs.groupBy("c1", "c2").agg(
        F.count("d").alias("n"), F.round(F.avg("d"), 5).alias("mean_d"), F.round(F.stddev_samp("d"), 5).alias("sd_d"))


STATISTICS: dict[str, Query] = {f.__name__: f for f in (
    benford_first, benford_second, terminal_digit, decimal_precision, value_spike, value_collisions, duplicate_rows,
    within_row_matches, column_concentration, sequential_duplication, block_copies, column_streaks, partial_rows,
    exact_duplicates, constant_offset, pair_autocorrelation, windowed_autocorrelation, runs_test, row_mean_runs,
    noise_scaling, selective_noise, column_levene, within_row_variance, regional_noise, loess_cusum, changepoint,
    replicate_correlation, excess_kurtosis, entropy, column_gof, modality, mahalanobis_rows, blocked_mahalanobis,
    residual_spike, rank_correlation, baseline_balance, condition_consistency, missing_pattern, missing_by_condition,
    missing_blocks, vst_choice, group_aggregation, dataset_gates, mixed_gates, dataset_report, streak_places, severity, coverage, region_table, hotspots, findings,
    grouping_status, differences,
)}

_ORD, _EMB, _EV = tables.order_lines_sheet, tables.embedding_sheet, tables.events_sheet


def _by_condition(spark: SparkSession, sf: str) -> Sheet:
    return _EMB(spark, sf).by_condition()


VERDICTS: dict[str, Query] = {
    "benford_first_verdict": _verdict(digits.benford_first, _EV),
    "benford_second_verdict": _verdict(digits.benford_second, prices),
    "decimal_precision_verdict": _verdict(digits.decimal_precision, _EV),
    "value_spike_verdict": _verdict(digits.value_frequency_spike, quantities),
    "sequential_duplication_verdict": _verdict(duplicates.sequential_duplication, quantities),
    "constant_offset_verdict": _verdict(offsets.constant_offset, _ORD),
    "residual_spike_verdict": _verdict(conditions.residual_spike, _ORD),
    "entropy_verdict": _verdict(shapes.entropy, lambda s, sf: _EV(s, sf).by_condition()),
    "column_gof_verdict": _verdict(shapes.column_gof, _by_condition),
    "replicate_correlation_verdict": _verdict(replicates.inter_replicate_correlation, _ORD),
    "excess_kurtosis_verdict": _verdict(replicates.excess_kurtosis, _ORD),
    "autocorrelation_verdict": _verdict(replicates.autocorrelation, _ORD),
    "windowed_autocorrelation_verdict": _verdict(replicates.windowed_autocorrelation, _ORD),
    "runs_verdict": _verdict(replicates.runs_test, _ORD),
    "noise_scaling_verdict": _verdict(replicates.noise_scaling, _ORD),
    "within_row_variance_verdict": _verdict(replicates.within_row_variance, _ORD),
    "selective_noise_verdict": _verdict(noise.selective_noise, _ORD),
    "regional_noise_verdict": _verdict(noise.regional_noise, _ORD),
    "loess_verdict": _verdict(noise.loess_cusum, _ORD),
    "row_mean_runs_verdict": _verdict(noise.row_mean_runs, _ORD),
    "mahalanobis_verdict": _verdict(multivariate.mahalanobis_rows, _ORD),
    "blocked_mahalanobis_verdict": _verdict(multivariate.blocked_mahalanobis, _ORD),
    "rank_correlation_verdict": _verdict(conditions.rank_correlation, _ORD),
    "baseline_balance_verdict": _verdict(conditions.baseline_balance, _EMB),
    "condition_consistency_verdict": _verdict(conditions.condition_consistency, _ORD),
    "missing_pattern_verdict": _verdict(missing.missing_data_pattern, _ORD),
}

QUERIES: dict[str, Query] = {**STATISTICS, **VERDICTS}

__all__ = ["QUERIES", "STATISTICS", "VERDICTS"]
