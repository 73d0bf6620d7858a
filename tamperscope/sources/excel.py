"""Workbook corpora: cell values and the traces editing leaves in a file.

Each workbook is opened once, inside a task, into flat tables of cells, parts
and properties; every rule then runs as a grouped query over the corpus.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperscope.sources.text import file_id

CELL_SCHEMA = ("book string, sheet string, line_no bigint, col int, value string, is_text boolean, "
               "number_format string, font string, color_source string, formula string, sheet_no int")
PART_SCHEMA = "book string, kind string, name string, value string"
YEAR = 365.25 * 86400

# Built-in number formats.
FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00",
    14: "m/d/yyyy", 49: "@",
}


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _children(node, name: str) -> list:
    return [c for c in node.iter() if _tag(c) == name] if node is not None else []


def _column(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1, int(digits) - 1


def _styles(root) -> list[tuple[str, str, str]]:
    """(number format, font signature, colour source) per cell style."""
    formats = dict(FORMATS)
    for f in _children(root, "numFmt"):
        formats[int(f.get("numFmtId"))] = f.get("formatCode")
    fonts = []
    for block in _children(root, "fonts")[:1]:
        for font in block:
            parts = {_tag(c): c for c in font}
            color = parts.get("color")
            source = next((k for k in ("rgb", "theme", "indexed") if color is not None and color.get(k)), "none")
            name = "|".join(str(parts[k].get("val")) if k in parts else "" for k in ("name", "sz"))
            flags = "".join(k for k in ("b", "i", "u") if k in parts)
            fonts.append((f"{name}|{flags}|{source}:{color.get(source) if color is not None else ''}", source))
    out = []
    for block in _children(root, "cellXfs")[:1]:
        for xf in block:
            number, font = int(xf.get("numFmtId", 0)), int(xf.get("fontId", 0))
            sig, source = fonts[font] if font < len(fonts) else ("", "none")
            out.append((formats.get(number, f"#{number}"), sig, source))
    return out


def _open(book: str, content: bytes) -> tuple[list[tuple], list[tuple]]:
    cells, parts = [], []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()

        def xml(path: str):
            return ElementTree.fromstring(z.read(path)) if path in names else None

        core = xml("docProps/core.xml")
        for node in core if core is not None else []:
            parts.append((book, "property", _tag(node), node.text))
        workbook, rels = xml("xl/workbook.xml"), xml("xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target") for r in (rels if rels is not None else [])}
        sheets = {}
        for s in _children(workbook, "sheet"):
            ref = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
            if targets.get(ref):
                sheets["xl/" + targets[ref].lstrip("/").removeprefix("xl/")] = s.get("name")
            if s.get("state") in ("hidden", "veryHidden"):
                parts.append((book, s.get("state"), s.get("name"), None))
        for d in _children(workbook, "definedName"):
            parts.append((book, "named range", d.get("name"), d.text))
        parts += [(book, "external link", n, None) for n in names
                  if n.startswith("xl/externalLinks/") and n.endswith(".xml") and "_rels" not in n]
        shared = ["".join(t.text or "" for t in _children(si, "t")) for si in _children(xml("xl/sharedStrings.xml"), "si")]
        root = xml("xl/styles.xml")
        styles = _styles(root) if root is not None else []
        for number, (path, sheet) in enumerate(sheets.items()):
            for c in _children(xml(path), "c"):
                col, line = _column(c.get("r"))
                inner = {_tag(n): n for n in c}
                text = inner["v"].text if "v" in inner else None
                kind = c.get("t")
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in _children(c, "t"))
                style = int(c.get("s", 0))
                fmt, font, source = styles[style] if style < len(styles) else ("General", "", "none")
                cells.append((book, sheet, line, col, text, kind in ("s", "inlineStr", "str"), fmt, font, source,
                              inner["f"].text if "f" in inner else None, number))
    return cells, parts


def _workbooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select(
        file_id(path).alias("book"), "content")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of every workbook under ``path``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
        for pdf in batches:
            for book, content in zip(pdf["book"], pdf["content"], strict=True):
                yield pd.DataFrame(_open(book, content)[0], columns=names)

    return _workbooks(spark, path).mapInPandas(run, CELL_SCHEMA)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Document properties, hidden sheets, named ranges and links."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for book, content in zip(pdf["book"], pdf["content"], strict=True):
                yield pd.DataFrame(_open(book, content)[1], columns=["book", "kind", "name", "value"])

    return _workbooks(spark, path).mapInPandas(run, PART_SCHEMA)


def sheet_lines(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """Lines of one sheet per workbook (the first, or the named one), in the
    shape the delimited reader produces."""
    first = cells.groupBy("book").agg(F.min_by("sheet", "sheet_no").alias("sheet")) if sheet is None else cells.where(
        F.col("sheet") == sheet).select("book", "sheet").distinct()
    own = cells.join(first, ["book", "sheet"])
    width = own.groupBy("book").agg(F.max("col").alias("_w"))
    # One entry per column of a line.
    line = own.groupBy("book", "line_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("m"))
    return line.join(width, "book").select(
        F.col("book").alias("dataset_id"), "line_no",
        F.transform(F.sequence(F.lit(0), "_w"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))


def _minority(cells: DataFrame, column: str, kind: str) -> DataFrame:
    """Columns in which two cells or more, up to half, differ from the rest."""
    counts = cells.groupBy("book", "sheet", "col", column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("book", "sheet", "col").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    odd = F.col("total") - F.col("top")
    return top.where((F.col("total") >= 3) & (odd >= 2) & (odd <= F.col("total") * 0.5)).select(
        "book", F.lit(kind).alias("finding"), F.concat_ws("!", "sheet", F.col("col") + 1).alias("place"), odd.alias("n"))


def audit(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Findings per workbook: book, finding, place, n."""
    prop = lambda n: F.max(F.when((F.col("kind") == "property") & (F.col("name") == n), F.col("value")))
    props = parts.groupBy("book").agg(
        prop("creator").alias("creator"), prop("lastModifiedBy").alias("editor"),
        F.to_timestamp(prop("created")).alias("created"), F.to_timestamp(prop("modified")).alias("modified"))
    gap = (F.unix_timestamp("modified") - F.unix_timestamp("created")) / YEAR
    age = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created")) / YEAR
    one = F.lit(1).cast("bigint")

    def when(cond, kind: str) -> DataFrame:
        return props.where(F.coalesce(cond, F.lit(False))).select(
            "book", F.lit(kind).alias("finding"), F.lit("properties").alias("place"), one.alias("n"))

    mixed = cells.where(~F.col("is_text")).groupBy("book", "sheet", "col").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("color_source").isin("rgb", "indexed")).alias("x"),
        F.count_if(F.col("color_source") == "theme").alias("t")).where("total >= 3 and x > 0 and t > 0")
    formulas = cells.where(F.col("formula").isNotNull()).groupBy("book", "sheet", "col").agg(F.count(F.lit(1)).alias("n"))
    outside = (F.col("kind") == "named range") & F.col("value").rlike(r"\[.*\]|\\\\|//|[A-Z]:\\")
    pieces = [
        when(F.lower(F.trim("creator")) != F.lower(F.trim("editor")), "creator-mismatch"),
        when((gap > 5) | (gap < 0) | (age > 20), "temporal"),
        _minority(cells.where(~F.col("is_text")), "number_format", "format"), _minority(cells, "font", "font"),
        mixed.select("book", F.lit("font").alias("finding"), F.concat_ws("!", "sheet", F.col("col") + 1).alias("place"),
                     F.least("x", "t").alias("n")),
        parts.where(F.col("kind").isin("hidden", "veryHidden")).select(
            "book", F.lit("hidden").alias("finding"), F.col("name").alias("place"), one.alias("n")),
        parts.where((F.col("kind") == "external link") | outside).select(
            "book", F.lit("external").alias("finding"), F.col("name").alias("place"), one.alias("n")),
        formulas.select("book", F.lit("formula").alias("finding"), F.concat_ws("!", "sheet", F.col("col") + 1).alias("place"), "n"),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def audit_verdict(findings: DataFrame) -> DataFrame:
    """HIGH from three kinds of finding, MODERATE from one."""
    kinds = findings.groupBy("book").agg(
        F.count_distinct("finding").alias("n_kinds"), F.array_sort(F.collect_set("finding")).alias("findings"))
    return kinds.withColumn("flag", F.when(F.col("n_kinds") >= 3, "HIGH").otherwise("MODERATE"))
