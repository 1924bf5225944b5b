"""Numeric columns: lenient parsing, rounding and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
#: The cast alone would also read Java's suffixes and hexadecimal numbers.
NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)$"


def lenient_double(text: Column) -> Column:
    """Trimmed text as a double; anything that is not a decimal number becomes null."""
    trimmed = F.trim(text.cast("string"), F.lit(BLANKS))
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def round_level(level: Column, flow_unit: Column) -> Column:
    """Two decimals for feet (ties to even), the next whole number for anything else."""
    # ceil goes through BIGINT, which has no NaN.
    up = F.when(F.isnan(level), level).otherwise(F.ceil(level).cast("float"))
    return F.when(flow_unit == "feet", F.bround(level, 2)).otherwise(up)


def display_level(level: Column) -> Column:
    """Thousands separators; no decimals for whole numbers, two otherwise, empty text for no value."""
    value = level.cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(""))
        .when(value == F.floor(value), F.format_number(value, 0))
        .otherwise(F.format_number(value, 2))
    )


def clamp(value: Column, low: Column, high: Column) -> Column:
    # greatest and least skip nulls, so a null value would come back as a bound.
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))
