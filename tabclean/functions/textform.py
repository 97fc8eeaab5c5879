"""Text form of a value as the reference prints it (``astype(str)``).

Used by the ``equals`` / ``not_equals`` / ``contains`` filters on columns that
are compared as text. Missing prints ``nan`` (text, numbers) or ``NaT``
(datetimes), so a pattern such as ``na`` matches missing rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabclean.operators.kinds import BOOLEAN, DATETIME, NUMERIC, kind_of, is_fractional


def double_text(x: Column) -> Column:
    """Python's repr of a double: plain decimals in [1e-4, 1e16), else 1.5e-05 / 1e+16.

    Java prints digits that read back as the same number (the shortest ones
    from Java 19 on), as 1.5E-4 or 1.5E7 outside [1e-3, 1e7);
    the plain form moves the point in that text, so no digit is lost.
    """
    sci = x.cast("string")                      # Java form, e.g. 1.5E-5
    power = F.regexp_extract(sci, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(sci.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(sci, r"^-?([0-9.]+)E", 1), r"\.", ""), r"(?<=.)0+$", "")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
    large = F.concat(sign, F.substr(whole, F.lit(1), power + 1), F.lit("."),
                     F.when(F.length(whole) > power + 1, F.substr(whole, power + 2)).otherwise(F.lit("0")))
    plain = F.when(power.isNull(), sci).when(power < 0, small).otherwise(large)
    mant = F.regexp_replace(F.regexp_extract(sci, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    sci_py = F.concat(mant, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                      F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    a = F.abs(x)
    use_plain = (x == 0) | ((a >= F.lit(1e-4)) & (a < F.lit(1e16)))
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .when(use_plain, plain).otherwise(sci_py))


def datetime_text(ts: Column, dates_only: bool, with_fraction: bool) -> Column:
    if dates_only:
        return F.date_format(ts, "yyyy-MM-dd")
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS" if with_fraction else "yyyy-MM-dd HH:mm:ss")


def text_form(c: Column, data_type: T.DataType, dates_only: bool = False, with_fraction: bool = False) -> Column:
    kind = kind_of(data_type)
    if kind == NUMERIC:
        body = double_text(c.cast("double")) if is_fractional(data_type) else c.cast("string")
        return F.coalesce(body, F.lit("nan"))
    if kind == BOOLEAN:
        return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit("nan"))
    if kind == DATETIME:
        return F.coalesce(datetime_text(c, dates_only, with_fraction), F.lit("NaT"))
    return F.coalesce(c.cast("string"), F.lit("nan"))
