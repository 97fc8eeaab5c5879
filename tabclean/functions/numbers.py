"""Number text: one pattern decides what counts as a number in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabclean.functions.text import strip_text

# Decimal or scientific notation after stripping; "inf", "12d", "1_000" are not numbers.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_PATTERN = r"^[+-]?\d+$"


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become NULL, so isNull() is the only missing test."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def is_number_text(c: Column) -> Column:
    return strip_text(c).rlike(NUMBER_PATTERN)


def to_number(c: Column) -> Column:
    """Parse text to double; anything else (or an overflow) gives NULL."""
    stripped = strip_text(c)
    parsed = F.when(stripped.rlike(NUMBER_PATTERN), stripped.try_cast("double"))
    return finite_or_null(parsed)


UNSIGNED_64 = "decimal(20,0)"


def to_integer(c: Column, data_type: str) -> Column:
    """Parse integer text straight to ``data_type`` (every digit kept); anything else gives NULL."""
    stripped = strip_text(c)
    return F.when(stripped.rlike(INTEGER_PATTERN), stripped.try_cast(data_type))
