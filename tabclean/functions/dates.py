"""Date text: an ordered list of layouts, month first when ambiguous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabclean.functions.text import strip_text

# Fixed layouts, tried in this order (Spark datetime patterns), each with a
# cheap shape test that accepts everything the layout can parse. A failed
# parse costs an exception inside the parser, so the shape test keeps text
# that cannot be a date (most text) away from it. With both readings possible
# the month comes first; a first number above 12 can only be a day.
_CLOCK = "[ HH:mm[:ss[.SSSSSSSSS]]]"
_CLOCK_SHAPE = r"( \d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
_HALF_DAY = " h:mm[:ss] a"
_HALF_DAY_SHAPE = r" \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$"
DATE_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm[:ss[.SSSSSSSSS]][XXX]", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"),
    ("yyyy-MM-dd HH:mm[:ss[.SSSSSSSSS]][XXX]", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?!.*[AaPp][Mm]$)"),
    ("yyyy-MM-dd" + _HALF_DAY, r"^\d{4}-\d{2}-\d{2}" + _HALF_DAY_SHAPE),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("M/d/yyyy" + _HALF_DAY, r"^\d{1,2}/\d{1,2}/\d{4}" + _HALF_DAY_SHAPE),
    ("d/M/yyyy" + _HALF_DAY, r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}" + _HALF_DAY_SHAPE),
    (f"M/d/yyyy{_CLOCK}", r"^\d{1,2}/\d{1,2}/\d{4}" + _CLOCK_SHAPE),
    (f"d/M/yyyy{_CLOCK}", r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}" + _CLOCK_SHAPE),
    (f"M-d-yyyy{_CLOCK}", r"^\d{1,2}-\d{1,2}-\d{4}" + _CLOCK_SHAPE),
    (f"d-M-yyyy{_CLOCK}", r"^(1[3-9]|2\d|3[01])-\d{1,2}-\d{4}" + _CLOCK_SHAPE),
    (f"yyyy/M/d{_CLOCK}", r"^\d{4}/\d{1,2}/\d{1,2}" + _CLOCK_SHAPE),
    (f"yyyy.M.d{_CLOCK}", r"^\d{4}\.\d{1,2}\.\d{1,2}" + _CLOCK_SHAPE),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    (f"MMM d, yyyy{_CLOCK}", r"^[A-Za-z]{3} \d{1,2}, \d{4}" + _CLOCK_SHAPE),
    (f"MMMM d, yyyy{_CLOCK}", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}" + _CLOCK_SHAPE),
    (f"MMM d yyyy{_CLOCK}", r"^[A-Za-z]{3} \d{1,2} \d{4}" + _CLOCK_SHAPE),
    (f"MMMM d yyyy{_CLOCK}", r"^[A-Za-z]{3,9} \d{1,2} \d{4}" + _CLOCK_SHAPE),
    (f"d MMM yyyy{_CLOCK}", r"^\d{1,2} [A-Za-z]{3} \d{4}" + _CLOCK_SHAPE),
    (f"d MMMM yyyy{_CLOCK}", r"^\d{1,2} [A-Za-z]{3,9} \d{4}" + _CLOCK_SHAPE),
    (f"d-MMM-yyyy{_CLOCK}", r"^\d{1,2}-[A-Za-z]{3}-\d{4}" + _CLOCK_SHAPE),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyyMMddHHmmss", r"^\d{14}$"),
)


# What every shape above and every text that ``_whole_year`` completes has: digits alone, or three words in which the day and
# the year are digits. One cheap test keeps most text away from the two dozen others.
_LIKE_A_DATE = r"^(?:\d{8}|\d{14})$|^\d{1,4}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/. ]\d|^[A-Za-z]{3,9} \d{1,2},? \d"


def _whole_year(text: Column) -> Column:
    """``1/5/24`` with four digits of the year: from 69 on the last century's."""
    head = r"^\d{1,2}[/-](?:\d{1,2}|[A-Za-z]{3})[/-]"
    short = text.rlike(head + r"\d{2}( |$)")
    before = F.regexp_extract(text, f"({head})", 1)
    after = F.substr(text, F.length(before) + 1)
    century = F.when(after.substr(1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    return F.when(short, F.concat(before, century, after)).otherwise(text)


def to_datetime(c: Column) -> Column:
    """First layout that parses the stripped text, else NULL (a zone-less timestamp)."""
    text = strip_text(c)
    stripped = _whole_year(text)
    parsed = F.coalesce(*[F.when(stripped.rlike(shape), F.try_to_timestamp(stripped, F.lit(fmt)))
                          for fmt, shape in DATE_FORMATS])
    first, shape = DATE_FORMATS[0]  # of its shape nothing else parses
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(first))).when(text.rlike(_LIKE_A_DATE), parsed).cast("timestamp_ntz")
