"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, and its regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body, or a lambda inside it, refers to it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; a null text hashes like no other."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's partition count, for explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_size(batches, column: int, limit: int = 8 << 20):
    """Record batches cut so that each holds about ``limit`` bytes of one
    binary or string column, or a single longer row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text as SQL, byte by byte and bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, k: xor(y >> 1, (y & 1) * 3988292384))"
    byte = step.replace("xor(x, b)", "xor(x, b) & 255")
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda x, b: xor(x >> 8, {byte})), 4294967295)"
