"""Column expressions shared by the operators (all JVM-side built-ins)."""

from tabclean.functions.text import strip_text, normalized_text, MISSING_MARKERS, CSV_NULL_MARKERS
from tabclean.functions.numbers import to_number, is_number_text, NUMBER_PATTERN, finite_or_null
from tabclean.functions.dates import to_datetime, DATE_FORMATS

__all__ = [
    "strip_text", "normalized_text", "MISSING_MARKERS", "CSV_NULL_MARKERS",
    "to_number", "is_number_text", "NUMBER_PATTERN", "finite_or_null",
    "to_datetime", "DATE_FORMATS",
]
