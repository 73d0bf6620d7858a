"""Text to number, number to digits, equality keys, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Beyond this size a four-decimal key no longer fits a BIGINT.
_KEY_LIMIT = 9.0e14


def to_number(text: Column) -> Column:
    """Plain decimal or exponent notation to DOUBLE; anything else is null."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(NUMBER_PATTERN), trimmed).try_cast("double")
    return finite(value)


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def plain_decimal(value: Column) -> Column:
    """Shortest plain decimal text of |value|, without trailing zeros."""
    text = F.abs(value).try_cast("decimal(38,18)").cast("string")
    text = F.when(text.contains("E"), F.lit("0")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def decimal_text(value: Column, raw: Column | None = None) -> Column:
    """Digits of a cell: its source text where it is plain, else the double."""
    if raw is None:
        return plain_decimal(value)
    clean = F.regexp_replace(F.trim(raw), r"^[+-]", "")
    clean = F.when(
        clean.rlike(r"^\d+(\.\d+)?$"),
        F.regexp_replace(
            F.when(clean.contains("."), F.regexp_replace(clean, r"0+$", "")).otherwise(clean),
            r"\.$", "",
        ),
    )
    return F.coalesce(clean, plain_decimal(value))


def significant_digit(text: Column, position: int) -> Column:
    """The ``position``-th significant digit (1-based), 0 past the last one."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\.", ""), r"^0+", "")
    digit = F.substring(digits, position, 1)
    return F.when(F.length(digits) == 0, F.lit(None).cast("int")).otherwise(
        F.when(digit == "", 0).otherwise(digit.cast("int"))
    )


def last_digit(text: Column) -> Column:
    return F.substring(text, -1, 1).cast("int")


def decimal_places(text: Column) -> Column:
    return F.when(text.contains("."), F.length(F.element_at(F.split(text, r"\."), 2))).otherwise(0)


def value_key(value: Column) -> Column:
    """Equality key at four decimals, as BIGINT; minus zero equals zero."""
    return F.when(
        F.abs(value) < _KEY_LIMIT, round_half_up(value * F.lit(10000.0)).cast("bigint")
    ).otherwise(F.xxhash64(value))


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(value + F.lit(0.5))


def is_integer(value: Column) -> Column:
    return value == F.floor(value)
