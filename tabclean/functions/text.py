"""Whitespace, blank and missing-marker handling for text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour).
# Text that means "missing" once stripped and lower-cased.
MISSING_MARKERS = ("", " ", "na", "n/a", "null", "none", "nan", "nat", "<na>", "missing")
# Cells the CSV reader treats as missing, compared exactly (case kept), on top
# of the list above: the default missing markers of the pandas CSV reader.
CSV_NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Python's str.strip() whitespace, derived by its own rule (str.isspace):
# Unicode White_Space plus the information separators U+001C..U+001F.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def strip_text(c: Column) -> Column:
    """Remove leading and trailing whitespace as str.strip() does.

    ``btrim`` with the character set is native and fast; ``trim()`` alone
    only drops the space character.
    """
    return F.btrim(c, F.lit(WHITESPACE))


def normalized_text(c: Column) -> Column:
    """Stripped text, or NULL when it is blank or a missing marker."""
    stripped = strip_text(c)
    return F.when(F.lower(stripped).isin(*MISSING_MARKERS), F.lit(None).cast("string")).otherwise(stripped)
