import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("tables")))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_sheet(spark):
    """Sheet from a list of rows of numbers, with optional conditions."""
    from tamperscope.model import ALL, Settings, Sheet

    def build(matrix, conds=None, subjects=None, dataset="d", parts=3, **settings):
        rows = []
        for i, row in enumerate(matrix):
            vals = [None if v is None or v != v else float(v) for v in row]
            raws = [None if v is None else f"{v:.10f}".rstrip("0").rstrip(".") for v in vals]
            rows.append((dataset, ALL, conds[i] if conds else None, subjects[i] if subjects else None, vals, raws, i))
        df = spark.createDataFrame(
            rows, "dataset_id string, grp string, cond string, subject string, vals array<double>, "
            "raws array<string>, row_idx bigint").repartition(parts)
        return Sheet(df, Settings(**settings))

    return build
