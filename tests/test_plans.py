import numpy as np
import pytest
from pyspark.sql import functions as F

from tamperscope.model import MECHANISM, RESULT_SCHEMA
from tamperscope.operators import replicates
from tamperscope.plans import battery, datasets, gates, regions, settings, transform, verdict




@pytest.mark.parametrize("flags,level", [
    ({}, 0), ({"Runs Test": "MODERATE"}, 1), ({"Runs Test": "HIGH"}, 2),
    ({"Runs Test": "MODERATE", "Terminal Digit Uniformity": "MODERATE"}, 3),
    ({"Runs Test": "MODERATE", "Autocorrelation": "MODERATE"}, 1),
    ({"Runs Test": "HIGH", "Autocorrelation": "HIGH"}, 3), ({"Runs Test": "HIGH", "Modality Test": "MODERATE"}, 3),
])
def test_severity(spark, flags, level):
    rows = [("d", "all", t, flags.get(t, "LOW"), 0.5, None, None, None, None, None) for t in MECHANISM]
    df = spark.createDataFrame(rows, RESULT_SCHEMA)
    assert verdict.severity(df).first().severity == level
    cover = verdict.coverage(df).first()
    assert cover.ran == cover.total == 29


def test_group_aggregation(spark):
    rows = [("d", g, "Terminal Digit Uniformity", "LOW", p, None, None, None, None, None) for g, p in
            (("a", 0.02), ("b", 0.03), ("c", 0.02))]
    rows += [("d", g, "Modality Test", f, p, None, None, None, None, None) for g, p, f in
             (("a", 0.005, "MODERATE"), ("b", 0.9, "LOW"))]
    rows += [("d", "a", "Column Goodness-of-Fit", "N/A", None, "tooFewRows", 5.0, 30.0, None, None)]
    got = {r.test: r for r in verdict.aggregate_groups(spark.createDataFrame(rows, RESULT_SCHEMA)).collect()}
    # Three weak groups add up by Fisher; an exempt test does not.
    assert got["Terminal Digit Uniformity"].flag == "HIGH" or got["Terminal Digit Uniformity"].flag == "MODERATE"
    assert got["Modality Test"].flag == "MODERATE" and got["Modality Test"].stats["fisher_p"] is None
    assert got["Column Goodness-of-Fit"].na_cause == "tooFewRows"


def test_gates(make_sheet):
    rng = np.random.default_rng(1)
    sheet = make_sheet(rng.normal(10, 1, (30, 2)), data_type="count", row_semantics="arbitrary")
    rows = {r.test: r for r in gates.gates(sheet).collect()}
    assert len(rows) == 29
    assert rows["Modality Test"].na_cause == "dataTypeMismatch"
    assert rows["Runs Test"].na_cause == "rowOrderArbitrary"
    assert rows["Within-Row Variance"].na_cause == "tooFewColumns" and rows["Within-Row Variance"].na_minimum == 3.0
    assert rows["Autocorrelation"].runs


def test_transform_choice(make_sheet):
    rng = np.random.default_rng(2)
    level = 10 ** rng.uniform(1, 4, (80, 1))
    cases = [(level * rng.lognormal(0, 0.2, (80, 4)), "general", "log"), (rng.poisson(level, (80, 4)), "general", "anscombe"),
             (rng.normal(size=(80, 4)), "elisa", "raw"), (rng.normal(50, 1, (80, 4)), "elisa", "log")]
    for m, assay, want in cases:
        assert transform.choose_transform(make_sheet(m, assay=assay)).first().transform == want


def test_hotspots_join_touching_areas(spark):
    rows = [("d", "A", "copied", "HIGH", 10, 20, [0, 1]), ("d", "B", "digits", "MODERATE", 12, 18, [1, 2]),
            ("d", "C", "copied", "HIGH", 15, 30, [1]), ("d", "A", "copied", "HIGH", 80, 81, [4]),
            ("d", "B", "digits", "HIGH", 80, 81, [4])]
    reg = spark.createDataFrame(rows, "dataset_id string, test string, mechanism string, flag string, row_lo bigint, "
                                      "row_hi bigint, cols array<int>")
    sizes = spark.createDataFrame([("d", 100, 5)], "dataset_id string, n_rows bigint, n_cols int")
    runs = regions.cell_runs(reg, sizes)
    grid = np.zeros((100, 5), int)
    for _, _, _, _, lo, hi, cols in rows:
        grid[lo:hi + 1, cols] += 1
    seen = np.zeros((100, 5), int)
    for r in runs.collect():
        seen[r.row_lo:r.row_hi + 1, r.col] = r.n_tests
    assert (seen == grid).all()
    spots = {(s.row_lo, s.row_hi, s.col_lo, s.col_hi): s for s in regions.hotspots(runs).collect()}
    assert set(spots) == {(12, 20, 1, 1), (80, 81, 4, 4)}
    assert spots[(12, 20, 1, 1)].max_count == 3 and spots[(12, 20, 1, 1)].score == 9
    assert regions.pattern_class(runs, regions.hotspots(runs), sizes).first().pattern == "sparse"


def test_grouping_and_pairing(make_sheet):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 4))
    thin = make_sheet(m, [f"c{i // 2}" for i in range(40)])
    assert battery.grouping_status(thin).first().pending
    refused = battery.run_confirmed_grouping(thin)
    assert {r.na_cause for r in refused.collect()} == {"tooFewRows"}
    paired = make_sheet(m, ["x"] * 20 + ["y"] * 20, [str(i % 20) for i in range(40)])
    assert battery.subject_pairing(paired).first().paired
    assert not battery.subject_pairing(make_sheet(m, ["x"] * 20 + ["y"] * 20, [str(i) for i in range(40)])).first().paired
    assert battery.surviving_groups(make_sheet(m, ["x"] * 38 + ["y"] * 2)).first().refused


def test_battery_on_planted_and_clean_sheets(make_sheet):
    rng = np.random.default_rng(4)
    clean = rng.normal(50, 5, (120, 1)) + rng.normal(size=(120, 4))
    planted = clean.copy().round(3)
    planted[80:95] = planted[10:25]
    wanted = ["Exact Duplicate Detection", "Sequential Duplication", "Autocorrelation", "Terminal Digit Uniformity",
              "Missing Data Pattern"]
    sheet = make_sheet(clean.round(3), dataset="clean")
    sheet = sheet.with_rows(sheet.rows.unionByName(make_sheet(planted, dataset="planted").rows))
    results, units = battery.run_battery(sheet, wanted)
    level = {r.dataset_id: r.severity for r in verdict.severity(results).collect()}
    assert level == {"clean": 0, "planted": 3}
    found = verdict.findings(results, regions.regions(results, units)).collect()
    assert {f.dataset_id for f in found} == {"planted"} and {f.test for f in found} >= set(wanted[:2])
    why = {(r.dataset_id, r.na_cause): r.tests for r in verdict.no_verdict_reasons(results).collect()}
    assert why[("clean", "missingnessOutOfBand")] == ["Missing Data Pattern"]


def test_gates_by_each_datasets_own_settings(spark, make_sheet):
    rng = np.random.default_rng(7)
    base = make_sheet(rng.normal(10, 1, (80, 4)), ["a"] * 40 + ["b"] * 40, dataset="plain")
    rows = base.rows
    for name in ("survey", "conds", "list", "pairs", "both"):
        rows = rows.unionByName(make_sheet(rng.normal(10, 1, (80, 4)), ["a"] * 40 + ["b"] * 40, dataset=name).rows)
    given = spark.createDataFrame(
        [("survey", "ordinal", None, None, None), ("conds", None, "conditions", None, False), ("list", None, None, "arbitrary", None),
         ("pairs", None, None, None, True), ("both", None, "conditions", None, True), ("elsewhere", "count", None, None, None)],
        "dataset_id string, data_type string, column_relationship string, row_semantics string, paired boolean")
    sheet = base.with_rows(rows)
    table = settings.settings_rows(sheet, given)
    assert table.count() == 6 and {r.assay for r in table.collect()} == {"general"}
    closed = {}
    for r in gates.gates(sheet, settings=table).collect():
        closed.setdefault((r.dataset_id, r.na_cause), set()).add(r.test)
    assert closed["survey", "dataTypeMismatch"] == set(gates.DATA_TYPE_SKIP["ordinal"]) and len(gates.DATA_TYPE_SKIP["ordinal"]) == 17
    assert closed["conds", "columnsNotReplicates"] == set(gates.REPLICATES_ONLY)
    assert closed["list", "rowOrderArbitrary"] == set(gates.ORDERED_ONLY)
    assert closed["pairs", "subjectsSharedAcrossConditions"] == closed["both", "subjectsSharedAcrossConditions"] == set(gates.UNPAIRED_ONLY)
    assert ("plain", "dataTypeMismatch") not in closed and ("both", "columnsNotReplicates") not in closed


def test_battery_over_mixed_settings(spark, make_sheet):
    rng = np.random.default_rng(8)
    level = 10 ** rng.uniform(1, 4, (60, 1))
    skewed = level * rng.lognormal(0, 0.2, (60, 4))
    zeros = rng.normal(20, 1, (60, 3)).round(2)
    zeros[rng.random(zeros.shape) < 0.3] = 0.0
    zeros[5] = 0.0
    same = rng.normal(10, 1, (60, 3))
    sheet = make_sheet(skewed, dataset="skewed")
    rows = sheet.rows.unionByName(make_sheet(zeros, dataset="zeros").rows).unionByName(
        make_sheet(same, ["x"] * 30 + ["y"] * 30, [str(i % 30) for i in range(60)], dataset="same").rows).unionByName(
        make_sheet(zeros + 1, dataset="scores").rows)
    sheet = sheet.with_rows(rows)
    given = spark.createDataFrame([("skewed", "auto", False, None), ("zeros", None, True, None), ("scores", None, None, "ordinal")],
                                  "dataset_id string, transform string, zero_as_missing boolean, data_type string")
    table = settings.settings_rows(sheet, given)
    cleared = settings.zeros_as_missing(sheet, table)
    assert sorted(r.row_idx for r in cleared.rows.where("dataset_id = 'zeros'").collect()) == list(range(int((zeros != 0).any(axis=1).sum())))
    read = {r.dataset_id: r for r in settings.read_off(cleared, table).collect()}
    assert read["skewed"].transform == "log" and read["zeros"].transform == "raw" and read["same"].paired and not read["zeros"].paired
    kinds = settings.classes(settings.read_off(cleared, table))
    assert len(kinds) == 4
    results, units = battery.run_battery(sheet, ["Autocorrelation", "Missing Data Pattern", "Cross-Condition Consistency"], settings=given)
    got = {(r.dataset_id, r.test): r for r in results.collect()}
    assert len(got) == 12 and units.columns
    assert got["scores", "Autocorrelation"].na_cause == "dataTypeMismatch"
    assert got["same", "Cross-Condition Consistency"].na_cause == "subjectsSharedAcrossConditions"
    assert got["zeros", "Missing Data Pattern"].na_cause is None and got["scores", "Missing Data Pattern"].na_cause is not None
    # The logged sheet is judged as if its rows had been logged before.
    logged = replicates.autocorrelation(make_sheet(np.log(skewed), dataset="skewed")).result.first()
    assert got["skewed", "Autocorrelation"].primary_p == pytest.approx(logged.primary_p, rel=1e-9)


def test_places_in_the_file(spark):
    def letters(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    numbers = [0, 1, 25, 26, 27, 51, 52, 701, 702, 703, 16383, 18277, 18278, 2**31 - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", datasets.column_letter(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in got} == {n: letters(n) for n in numbers}
    found = spark.createDataFrame(
        [("d", 3, 5, [1, 2]), ("d", 4, 4, [0]), ("d", None, None, [2]), ("d", 1, 2, None), ("d", None, None, None), ("e", 0, 2, [1])],
        "dataset_id string, row_lo bigint, row_hi bigint, cols array<int>")
    assert [r.place for r in datasets.placed(found.where("dataset_id = 'd'")).collect()] == ["B5:C7", "A6", "C:C", "3:4", None]
    layout = spark.createDataFrame([("e", 4, 2, [3, 30])], "dataset_id string, skipped int, headers int, columns array<int>")
    rows = spark.createDataFrame([("e", 0, 1), ("e", 1, 2), ("e", 2, 9)], "dataset_id string, row_idx bigint, file_row bigint")
    assert datasets.placed(found.where("dataset_id = 'e'"), layout, rows).first().place == "AE8:AE16"


def test_dataset_report_and_pending_groups(spark, make_sheet):
    rng = np.random.default_rng(9)
    sparse = rng.normal(20, 1, (40, 4))
    sparse[:, 1:] = np.nan
    sheet = make_sheet(sparse, dataset="sparse", assay="cell_count")
    sheet = sheet.with_rows(sheet.rows.unionByName(make_sheet(-np.arange(40.0).reshape(20, 2), dataset="minus").rows).unionByName(
        make_sheet(np.arange(40.0).reshape(20, 2), ["a|x"] * 10 + ["b|y"] * 10, dataset="plain").rows))
    got = {r.dataset_id: r for r in datasets.dataset_report(sheet).collect()}
    assert got["sparse"].mostly_missing and got["sparse"].missing_share == 0.75 and got["sparse"].hint == "counts are not whole"
    assert got["minus"].hint_level == "warn" and got["minus"].hint == "negative counts" and got["plain"].hint is None
    offered = spark.createDataFrame([("sparse",), ("void",)], "dataset_id string")
    assert [tuple(r) for r in datasets.rejected(offered, sheet).collect()] == [("void", "no values")]
    assert not battery.grouping_status(sheet).first().pending
    three = spark.createDataFrame([("plain", 3)], "dataset_id string, n bigint")
    assert battery.grouping_status(sheet, three).first().pending
