import random
import zipfile

import pytest

from tamperscope.sources import excel, longformat, sinks, text


def write(path, rows):
    path.write_text("\n".join(",".join(map(str, r)) for r in rows) + "\n")


def test_corpus_of_sheets(spark, tmp_path):
    rnd = random.Random(1)
    cell = lambda: f"{rnd.gauss(50, 5):.2f}"
    write(tmp_path / "elisa.csv", [["Analyte", "Plate1", "Plate2", "Plate3"]] + [
        [f"A{i}", cell(), cell(), "" if i % 9 == 0 else cell()] for i in range(60)])
    head = ["", "Control", "", "", "", "Low", "", "", "", "High", "", "", ""]
    write(tmp_path / "bands.csv", [head, ["Residue"] + ["Rep1", "Rep2", "Rep3", "Rep4"] * 3] + [
        [i] + [cell() for _ in range(12)] for i in range(35)])
    levels = [f"site{i}" for i in range(10)]
    write(tmp_path / "field.csv", [["Site", "Latitude", "Condition", "M1", "M2"]] + [
        [levels[i % 10], 40 + 1.5 * (i % 10), "dry" if i % 3 else "wet", cell(), cell()] for i in range(80)])
    corpus = text.read_corpus(spark, str(tmp_path))
    roles = {(r.dataset_id, r.col): r.role for r in corpus.columns.collect()}
    assert [roles[("elisa.csv", c)] for c in range(4)] == ["label", "data", "data", "data"]
    assert roles[("bands.csv", 0)] == "label" and all(roles[("bands.csv", c)] == "data" for c in range(1, 13))
    assert [roles[("field.csv", c)] for c in range(5)] == ["condition", "attribute", "condition", "data", "data"]
    rows = corpus.sheet.rows.collect()
    bands = [r for r in rows if r.dataset_id == "bands.csv"]
    assert len(bands) == 105 and {r.cond for r in bands} == {"Control", "Low", "High"} and len(bands[0].vals) == 4
    assert sorted(r.row_idx for r in bands) == list(range(105))
    missing = [r for r in rows if r.dataset_id == "elisa.csv" and r.vals[2] is None]
    assert len(missing) == 7
    assays = {r.dataset_id: (r.assay, r.row_semantics) for r in corpus.datasets.collect()}
    assert assays["elisa.csv"][0] == "elisa"


def test_quoted_lines_and_files_of_one_name(spark, tmp_path):
    for k, folder in enumerate(("one", "two")):
        (tmp_path / folder).mkdir()
        lines = [f'"r{i}","{i}.5, or ""so""","a\nb{k}",plain' for i in range(1000)]
        (tmp_path / folder / "same.csv").write_text("\r\n".join(lines) + "\r\n\r\nlast,1\r\n")
    got = {(r.dataset_id, r.line_no): r.cells for r in text.read_lines(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 1002 and {d for d, _ in got} == {"one/same.csv", "two/same.csv"}
    assert got[("two/same.csv", 7)] == ["r7", '7.5, or "so"', "a\nb1", "plain"]
    assert got[("one/same.csv", 1000)] == [""] and got[("one/same.csv", 1001)] == ["last", "1"]


def test_first_sheet_is_the_workbooks_first(spark):
    cells = spark.createDataFrame([("b", "Appendix", 1, 0, "no", 1), ("b", "Zdata", 1, 0, "yes", 0)],
                                  "book string, sheet string, line_no bigint, col int, value string, sheet_no int")
    assert excel.sheet_lines(cells).first().cells == ["yes"]


def test_blocks_are_split_on_blank_lines(spark):
    lines = [("d", i, c) for i, c in enumerate([["a", "b"], ["1", "2"], ["", ""], ["x", "y"], ["3", "4"], ["5", "6"], ["", ""], ["z", ""]])]
    df = spark.createDataFrame(lines, "dataset_id string, line_no bigint, cells array<string>")
    blocks = text.split_blocks(df)
    assert {(r.block_id, r.line_no) for r in blocks.collect()} == {(0, 0), (0, 1), (1, 3), (1, 4), (1, 5)}
    summary = {r.block_id: (r.n_lines, r.n_data_lines, r.preview) for r in text.block_summary(blocks).collect()}
    assert summary == {0: (2, 1, "a, b"), 1: (3, 2, "x, y")}


def test_long_table_is_pivoted(spark):
    rnd = random.Random(2)
    rows = [("d", i, [f"s{i % 60}", "ctl" if i < 60 else "trt", f"{rnd.gauss(5, 1):.3f}"]) for i in range(120)]
    rows.append(("d", 120, ["s3", "trt", "9.999"]))
    df = spark.createDataFrame(rows[:120], "dataset_id string, row bigint, cells array<string>")
    shape = longformat.detect_long_format(df)
    got = shape.first()
    assert (got.cond_col, got.measure_col, got.id_col) == (1, 2, 0)
    more = spark.createDataFrame(rows, df.schema)
    wide = {r.subject: r.vals for r in longformat.pivot_long(more, shape).collect()}
    assert len(wide) == 60 and wide["s3"][1] == 9.999 and wide["s7"] == [float(rows[7][2][2]), float(rows[67][2][2])]


@pytest.fixture()
def workbook(tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join(
        f'<row r="{i}"><c r="A{i}" s="{1 if i in (4, 7) else 0}"><v>{i}.5</v></c><c r="B{i}"><f>A{i}*2</f><v>{i * 2 + 1}</v></c></row>'
        for i in range(1, 11))
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/>'
                   '<sheet name="Old" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts><font><sz val="11"/><name val="A"/></font></fonts>'
                   '<cellXfs><xf numFmtId="0" fontId="0"/><xf numFmtId="2" fontId="0"/></cellXfs></styleSheet>')
        z.writestr("docProps/core.xml", '<p xmlns:dc="d" xmlns:cp="c" xmlns:t="t"><dc:creator>Ann</dc:creator>'
                   '<cp:lastModifiedBy>Bob</cp:lastModifiedBy><t:created>2015-01-01T00:00:00Z</t:created>'
                   '<t:modified>2024-01-01T00:00:00Z</t:modified></p>')
    return str(tmp_path)


def test_workbook_audit(spark, workbook):
    cells, parts = excel.read_cells(spark, workbook), excel.read_parts(spark, workbook)
    found = excel.audit(cells, parts)
    assert {r.finding for r in found.collect()} == {"creator-mismatch", "temporal", "format", "hidden", "formula"}
    assert excel.audit_verdict(found).first().flag == "HIGH"
    lines = excel.sheet_lines(cells).orderBy("line_no").collect()
    assert lines[0].cells == ["1.5", "3"] and len(lines) == 10


def test_report_tables(spark, tmp_path, make_sheet):
    sheet = make_sheet([[1.0, 2.0]] * 5)
    reg = spark.createDataFrame([("d", "T", 1, 2)], "dataset_id string, test string, row_lo bigint, row_hi bigint")
    marked = {r.row_idx: r.flagged_by for r in sinks.annotated_rows(sheet, reg).collect()}
    assert marked == {0: None, 1: ["T"], 2: ["T"], 3: None, 4: None}
    sinks.write_report(str(tmp_path / "out"), {"rows": sheet.rows})
    sinks.write_csv(sheet.rows, str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 5
