"""A folder of delimited sheets as one corpus.

Lines keep their file and position; trimming, block splitting, header
detection, roles and assay are aggregates and windows over (dataset, line) and
(dataset, column), so a million small sheets are one job.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamperscope.functions.values import to_number
from tamperscope.model import ALL, Sheet
from tamperscope.operators.ordered import islands, ordinal
from tamperscope.session import materialize

ROLE_SAMPLE = 40
MIN_ROWS_FOR_GROUPING = 50

# Header patterns that decide a role.
LABEL_HEADER = (
    r"^(id|name|sample|subject|patient|well|row|res|residue|index|idx|num|no|n|number|#|pos|position|frame|step|time"
    r"|timepoint|obs|gene|geneid|protein|accession)\b"
)
CONDITION_HEADER = r"^(group|condition|treatment|dose|conc|ctrl|control|type|category|class|arm|genotype|strain)\b"

# Fixed values: (assay, points, pattern) on file names and on headers.
FILE_HINTS = [
    ("qpcr", 3, r"qpcr|rtpcr|rtqpcr"), ("qpcr", 2, r"\bpcr\b|cqvalue|ctvalue"),
    ("densitometry", 3, r"densitom|western|wblot|bandint"),
    ("plate_reader", 3, r"platereader|absorbance|fluoresc|luminesc"), ("elisa", 3, r"elisa|immunoassay|eia\b"),
    ("cell_count", 3, r"cellcount|viabilit|mtt\b|celltiter|cytox"),
    ("genomics", 3, r"rnaseq|rnacount|tpm|fpkm|rpkm|deseq|edger"), ("genomics", 3, r"rawcount|gse\d{4,}"),
    ("genomics", 2, r"grch3[78]|hg3[89]|hg19|mm10|mm39|ncbi"),
    ("proteomics", 3, r"proteomi|massspec|lcmsms|itraq|tmt\b|silac|swath\b|dia\b|maxquant|spectronaut|progenesis"),
    ("physiological", 3, r"heartrate|bloodpress|bodymass|temperature"),
    ("survey", 3, r"survey|likert|questionnaire|rating|selfreport"),
]
HEADER_HINTS = [
    ("qpcr", 3, r"^ct\d*$|^cq\d*$|deltact|ddct|dct|cycling"),
    ("qpcr", 2, r"^tm\d*$|^eff$|^cpd\d*$|melttemp|melting|pcr.*eff|amplif"), ("qpcr", 2, r"ct_|_ct|cq_|_cq"),
    ("densitometry", 2, r"density|banddens|normband|bandint"),
    ("plate_reader", 2, r"^od\d|^abs\d|absorbance|fluoresc|rfu\d|rlu\d|lum\d"),
    ("elisa", 2, r"pgml|ngml|concen|pg/ml|ng/ml"), ("elisa", 2, r"od450|od490|od620"),
    ("cell_count", 2, r"cellcount|viabilit|viable|livecell|deadcell|cells?$"),
    ("genomics", 3, r"^tpm$|^fpkm$|^rpkm$|readcount|normcount"), ("genomics", 2, r"^geneid$|^ensembl|^ensg\d|^enst\d"),
    ("genomics", 2, r"^gsm\d{4,}"), ("physiological", 2, r"heartrate|bpm|systol|diastol|weight|height|bmi"),
    ("proteomics", 2, r"protein|peptide|abundance|intensity|lfq\b|ibaq\b|razor|ms1area|ms2area|precursor"),
    ("survey", 2, r"likert|scale|agree|disagree|satisf|rating|item[_\s]?[0-9]|q[0-9]"),
]
INSTRUMENT_ASSAYS = ("qpcr", "elisa", "plate_reader", "densitometry", "physiological", "cell_count")


@dataclass(frozen=True)
class Corpus:
    """Sheets read from files: settings per dataset, roles per column, rows."""

    datasets: DataFrame
    columns: DataFrame
    sheet: Sheet


#: Lines handed on at a time.
LINE_BATCH = 10_000


def file_id(path: str) -> Column:
    """A file's path below the folder ``path``, or its whole path where that
    is a pattern: files of one name in two folders stay apart."""
    full, folder = F.col("_metadata.file_path"), path.rstrip("/") + "/"
    at = F.instr(full, folder)
    return F.when(at > 0, F.substring(full, at + len(folder), F.length(full))).otherwise(full)


def _records(value: str, separator: str) -> Iterator[list[str]]:
    """Cells of each line of a file, in one pass; quoted cells may hold
    separators, line breaks and doubled quotes. A blank line has one empty cell."""
    csv.field_size_limit(1 << 31)
    for cells in csv.reader(io.StringIO(value, newline=""), delimiter=separator, skipinitialspace=separator != " "):
        yield [c.strip() for c in cells] or [""]


def read_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """dataset_id, line_no, cells of every file under ``path``. A file is one
    record, so quoted line breaks and line order survive."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(file_id(path).alias("dataset_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, value in zip(pdf["dataset_id"], pdf["value"], strict=True):
                held: list[tuple] = []
                for number, cells in enumerate(_records(value or "", separator)):
                    held.append((name, number, cells))
                    if len(held) == LINE_BATCH:
                        yield pd.DataFrame(held, columns=["dataset_id", "line_no", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["dataset_id", "line_no", "cells"])

    return files.mapInPandas(run, "dataset_id string, line_no bigint, cells array<string>")


def _filled(cells: str | Column) -> Column:
    return F.size(F.filter(cells, lambda c: c != ""))


def trim_lines(lines: DataFrame) -> DataFrame:
    """Drops sparse lines at both ends and columns with almost nothing in them."""
    width = lines.withColumn("_w", F.coalesce(F.array_max(F.transform(
        "cells", lambda c, i: F.when(c != "", i + 1))), F.lit(0))).groupBy("dataset_id").agg(F.max("_w").alias("_w"))
    need = F.greatest(F.lit(3), F.ceil(F.col("_w") * 0.1))
    full = lines.join(width, "dataset_id").withColumn("_ok", _filled("cells") >= need)
    ends = full.where("_ok").groupBy("dataset_id").agg(F.min("line_no").alias("_lo"), F.max("line_no").alias("_hi"))
    kept = full.join(ends, "dataset_id").where(F.col("line_no").between(F.col("_lo"), F.col("_hi")))
    kept = kept.select("dataset_id", "line_no", "cells")
    counts = kept.select("dataset_id", F.posexplode("cells").alias("col", "c")).groupBy("dataset_id", "col").agg(
        F.count_if(F.col("c") != "").alias("filled"))
    total = kept.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    used = counts.join(total, "dataset_id").where(
        F.col("filled") > F.greatest(F.lit(2), F.floor(F.col("_n") * 0.05)))
    # One entry per column of a sheet.
    used = used.groupBy("dataset_id").agg(F.array_sort(F.collect_list("col")).alias("_cols"))
    return kept.join(used, "dataset_id").select(
        "dataset_id", "line_no", F.transform("_cols", lambda i: F.coalesce(F.get("cells", i), F.lit(""))).alias("cells"))


def split_blocks(lines: DataFrame) -> DataFrame:
    """Numbers the blocks between blank lines; blocks of one line are dropped."""
    solid = lines.where(_filled("cells") > 0)
    blocks = islands(solid.select("dataset_id", "line_no"), ["dataset_id"], "line_no").where("length >= 2").withColumn(
        "block_id", F.row_number().over(Window.partitionBy("dataset_id").orderBy("lo")) - 1)
    spans = blocks.withColumn("_c", F.explode(F.sequence(F.floor(F.col("lo") / 4096), F.floor(F.col("hi") / 4096))))
    met = solid.withColumn("_c", F.floor(F.col("line_no") / 4096)).join(
        spans.select("dataset_id", "_c", "lo", "hi", "block_id"), ["dataset_id", "_c"])
    return met.where(F.col("line_no").between(F.col("lo"), F.col("hi"))).select(
        "dataset_id", "block_id", "line_no", (F.col("line_no") - F.col("lo")).alias("at"), "cells")


def block_summary(blocks: DataFrame) -> DataFrame:
    numeric = F.size(F.filter("cells", lambda c: to_number(c).isNotNull()))
    return blocks.groupBy("dataset_id", "block_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.size("cells")).alias("n_cols"),
        F.count_if(numeric > F.size("cells") * 0.3).alias("n_data_lines"),
        F.array_join(F.slice(F.filter(F.min_by("cells", "at"), lambda c: c != ""), 1, 6), ", ").alias("preview"))


def header_rows(blocks: DataFrame) -> DataFrame:
    """1 or 2 header lines per block: two where a sparse group line sits over a
    repeating line and the third line is mostly numbers."""
    top = blocks.where("at < 3").groupBy("dataset_id", "block_id").agg(*[
        F.max(F.when(F.col("at") == i, F.col("cells"))).alias(f"r{i}") for i in range(3)])
    blank = F.size("r0") - _filled("r0")
    sparse = (F.size("r0") >= 3) & (blank / F.size("r0") > 0.4) & (_filled("r0") >= 2)
    names = F.filter("r1", lambda c: c != "")
    kinds = F.size(F.array_distinct(names))
    repeating = (F.size(names) >= 4) & (kinds <= F.ceil(F.size(names) / 2)) & (kinds >= 2)
    numeric = F.size(F.filter("r2", lambda c: to_number(c).isNotNull())) / F.greatest(F.size("r2"), F.lit(1))
    two = F.coalesce(sparse & repeating & (numeric > 0.5), F.lit(False))
    return top.select("dataset_id", "block_id", F.when(two, 2).otherwise(1).alias("n_header"), "r0", "r1")


def named_columns(headers: DataFrame) -> DataFrame:
    """dataset_id, block_id, col, header, group_name; group names run to the
    right until the next one."""
    two = F.col("n_header") == 2
    names = F.when(two, F.col("r1")).otherwise(F.col("r0"))
    cols = headers.select("dataset_id", "block_id", two.alias("two"), "r0", F.posexplode(names).alias("col", "header"))
    own = F.get("r0", F.col("col"))
    along = Window.partitionBy("dataset_id", "block_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(own != "", own), ignorenulls=True).over(along)
    return cols.withColumn("group_name", F.when(F.col("two"), group)).drop("two", "r0")


def infer_roles(data: DataFrame, columns: DataFrame) -> DataFrame:
    """data, label, condition, attribute or ignore per column, from the first
    40 rows and the header."""
    cells = data.where(F.col("row") < ROLE_SAMPLE).select(
        "dataset_id", "block_id", "row", F.posexplode("cells").alias("col", "c")).where(F.col("c") != "")
    value = to_number(F.col("c"))
    key = ["dataset_id", "block_id", "col"]
    # At most 40 values per column.
    stats = cells.groupBy(*key).agg(
        F.count("c").alias("n"), F.count(value).alias("n_num"), F.count_distinct("c").alias("n_distinct"),
        F.array_sort(F.collect_list(F.struct("row", value.alias("v")))).alias("_s"))
    seq = F.transform(F.filter("_s", lambda s: s["v"].isNotNull()), lambda s: s["v"])
    steps = F.size(F.filter(F.zip_with(F.slice("_v", 2, 1000), F.slice("_v", F.lit(1), F.greatest(F.size("_v") - 1, F.lit(0))),
                                       lambda b, a: b - a == 1), lambda x: x))
    stats = stats.withColumn("_v", seq).withColumn(
        "running", (F.size("_v") >= 4) & F.forall("_v", lambda v: v == F.floor(v))
        & (steps / F.greatest(F.size("_v") - 1, F.lit(1)) > 0.85))
    every = columns.join(stats.drop("_s", "_v"), key, "left")
    low = F.lower(F.trim("header"))
    few = (F.col("n_distinct") <= 20) & (F.col("n_distinct") / F.col("n") < 0.3)
    role = (
        F.when(F.col("n").isNull(), "ignore")
        .when(F.col("n_num") / F.col("n") < 0.5, F.when(few, "condition").otherwise("label"))
        .when(F.col("group_name").isNotNull(), "data")
        .when(low.rlike(LABEL_HEADER), "label").when(low.rlike(CONDITION_HEADER), "condition")
        .when(F.col("running"), "label").otherwise("data"))
    return every.select("dataset_id", "block_id", "col", "header", "group_name", role.alias("role"))


def group_attributes(data: DataFrame, roles: DataFrame) -> DataFrame:
    """Data columns that are constant inside every level of some other column
    become attributes. Each grouping column is one pass over its levels."""
    key = ["dataset_id", "block_id"]
    cells = data.select(*key, "row", F.posexplode("cells").alias("col", "c")).where(F.col("c") != "").join(
        roles.select(*key, "col", "role"), [*key, "col"])
    sizes = data.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= MIN_ROWS_FOR_GROUPING)
    levels = cells.where("role <> 'ignore'").groupBy(*key, "col", "c").agg(F.count(F.lit(1)).alias("n"))
    usable = levels.groupBy(*key, "col").agg(
        F.count(F.lit(1)).alias("k"), F.percentile_approx("n", 0.5).alias("mid")).join(sizes, key).where(
        (F.col("k") >= 2) & (F.col("k") <= F.floor(F.col("n_rows") * 0.5)) & (F.col("mid") >= 2))
    grouping = cells.join(usable.select(*key, "col"), [*key, "col"], "left_semi").select(
        *key, "row", F.col("col").alias("g"), F.col("c").alias("level"))
    number = to_number(F.col("c"))
    values = cells.where("role = 'data'").withColumn("v", number).where(F.col("v").isNotNull()).select(*key, "row", "col", "v")
    varied = values.groupBy(*key, "col").agg((F.min("v") < F.max("v")).alias("_varied")).where("_varied").drop("_varied")
    constant = values.join(grouping, [*key, "row"]).where(F.col("g") != F.col("col")).groupBy(*key, "g", "col", "level").agg(
        (F.min("v") == F.max("v")).alias("same")).groupBy(*key, "g", "col").agg(F.bool_and("same").alias("same"))
    held = constant.where("same").join(varied, [*key, "col"], "left_semi").select(*key, "col").distinct().withColumn(
        "_attr", F.lit(True))
    return roles.join(held, [*key, "col"], "left").withColumn(
        "role", F.when(F.col("_attr"), "attribute").otherwise(F.col("role"))).drop("_attr")


def detect_assay(columns: DataFrame) -> DataFrame:
    """Best-scoring assay per dataset from its file name and headers."""
    def tidy(c: str) -> Column:
        last = F.regexp_extract(c, r"([^/]*)$", 1) if c == "dataset_id" else F.col(c)  # folders say nothing
        return F.regexp_replace(F.lower(last), r"[-_.\s]", "")

    kinds = list(dict.fromkeys(a for a, _, _ in FILE_HINTS + HEADER_HINTS))

    def score(hints, column: Column, assay: str) -> Column:
        total: Column = F.lit(0)
        for a, points, pattern in hints:
            if a == assay:
                total = total + F.when(column.rlike(pattern), points).otherwise(0)
        return total

    # Numbered plates speak for either plate assay, once a dataset.
    plates = F.max(F.when(tidy("header").rlike(r"^plate\d"), 1).otherwise(0))
    per = columns.groupBy("dataset_id").agg(
        *[(F.sum(score(HEADER_HINTS, tidy("header"), a)) + (plates if a in ("elisa", "plate_reader") else F.lit(0))).alias(f"h_{a}")
          for a in kinds])
    best = F.array_max(F.array(*[F.struct(
        (F.col(f"h_{a}") + score(FILE_HINTS, tidy("dataset_id"), a)).alias("total"), F.lit(-i).alias("order"),
        F.lit(a).alias("assay"), F.col(f"h_{a}").alias("from_headers")) for i, a in enumerate(kinds)]))
    out = per.select("dataset_id", best.alias("b"))
    sure = F.when(F.col("b.from_headers") >= 2, "high").when(F.col("b.total") >= 3, "low").otherwise("none")
    return out.select(
        "dataset_id", F.when(sure == "none", "general").otherwise(F.col("b.assay")).alias("assay"), sure.alias("confidence"))


def dataset_settings(assays: DataFrame) -> DataFrame:
    """Data type and row-order meaning that follow from the assay."""
    a = F.col("assay")
    return assays.withColumn(
        "data_type", F.when(a.isin("cell_count", "genomics"), "count").when(a == "survey", "ordinal").otherwise("continuous")
    ).withColumn("row_semantics", F.when(a == "genomics", "arbitrary").otherwise("ordered"))


def condition_columns(roles: DataFrame) -> DataFrame:
    """(dataset_id, n): how many columns of a dataset hold conditions."""
    return roles.groupBy("dataset_id").agg(F.count_if(F.col("role") == "condition").alias("n"))


def read_corpus(spark: SparkSession, path: str, separator: str = ",") -> Corpus:
    """First block of every file as sheet rows with inferred roles. Column
    groups become conditions whose subject is the row."""
    lines = materialize(trim_lines(read_lines(spark, path, separator)), "lines")
    blocks = materialize(split_blocks(lines).where("block_id = 0"), "blocks")
    headers = header_rows(blocks)
    data = blocks.join(headers.select("dataset_id", "block_id", "n_header"), ["dataset_id", "block_id"]).where(
        F.col("at") >= F.col("n_header")).select(
        "dataset_id", "block_id", (F.col("at") - F.col("n_header")).alias("row"), "cells")
    data = materialize(data, "data")
    roles = materialize(group_attributes(data, infer_roles(data, named_columns(headers))), "roles")
    settings = dataset_settings(detect_assay(roles))
    # One entry per column of a sheet.
    plan = roles.groupBy("dataset_id", "block_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "data", F.struct("col", "group_name")))).alias("_d"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "condition", F.col("col")))).alias("_c"),
        F.min(F.when(F.col("role") == "label", F.col("col"))).alias("_l"),
        F.count_distinct(F.when(F.col("role") == "data", F.col("group_name"))).alias("n_groups"))
    full = data.join(plan, ["dataset_id", "block_id"])
    cond = F.array_join(F.filter(F.transform("_c", lambda i: F.get("cells", i)), lambda c: c != ""), " | ")
    groups = F.when(F.col("n_groups") >= 2, F.array_distinct(F.transform("_d", lambda s: s["group_name"]))).otherwise(
        F.array(F.lit(None).cast("string")))
    rows = full.withColumn("grp_name", F.explode(groups)).withColumn(
        "_use", F.filter("_d", lambda s: F.col("grp_name").isNull() | (s["group_name"] == F.col("grp_name"))))
    raws = F.transform("_use", lambda s: F.trim(F.get("cells", s["col"])))
    rows = rows.withColumn("raws", raws).withColumn("vals", F.transform("raws", lambda c: to_number(c))).where(
        F.exists("vals", lambda v: v.isNotNull()))
    raw = F.zip_with("raws", "vals", lambda c, v: F.when(v.isNotNull(), c))
    sheet = rows.select(
        "dataset_id", F.lit(ALL).alias("grp"),
        F.coalesce("grp_name", F.when(cond != "", cond)).alias("cond"),
        F.when(F.col("grp_name").isNotNull(), F.col("row").cast("string")).otherwise(
            F.when(F.col("_l").isNotNull(), F.get("cells", F.col("_l")))).alias("subject"),
        "vals", raw.alias("raws"), F.col("row").alias("file_row"),
    )
    placed = ordinal(sheet, ["dataset_id"], ["file_row", "cond"], "row_idx", "corpus")
    return Corpus(settings, roles, Sheet(materialize(placed, "corpus")))
