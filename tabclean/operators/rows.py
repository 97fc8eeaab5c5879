"""O-50..O-60: column drops, sparse/empty rows, empty columns, row filters."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabclean.functions import to_number
from tabclean.functions.numbers import NUMBER_PATTERN
from tabclean.functions.textform import text_form
from tabclean.operators.fit import fit
from tabclean.operators.kinds import BOOLEAN, DATETIME, NUMERIC, TEXT, is_fractional, kind_of, q

FILTER_OPERATORS = ("equals", "not_equals", "greater_than", "less_than", "contains")
AUTO_DROP_MISSING = 0.85


@dataclass(frozen=True)
class FilterRule:
    column: str
    operator: str = "equals"
    value: str = ""

    def validate(self) -> None:
        if self.operator not in FILTER_OPERATORS:
            raise ValueError(f"unknown filter operator: {self.operator}")
        if self.operator in ("greater_than", "less_than") and not self.is_empty() and _timestamp_value(self.value) is None:
            float(self.value)  # raises ValueError like the reference does

    def is_empty(self) -> bool:
        """A rule without column or value asks for nothing."""
        return not str(self.column).strip() or not str(self.value).strip()


def _timestamp_value(value: str) -> dt.datetime | None:
    """The value as an ISO date or timestamp in UTC, if it is one."""
    try:
        found = dt.datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None
    if str(value).strip().isdigit():
        return None  # 20240105 is a number
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """O-50: unknown names are ignored."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present) if present else df


def auto_drop_candidates(profile, keep: tuple[str, ...] = ()) -> list[str]:
    """O-51: possible ids and columns with rounded missing ratio >= 0.85, but those in ``keep``."""
    return [c.name for c in profile.columns
            if (c.possible_id or c.missing_ratio >= AUTO_DROP_MISSING) and c.name not in keep]


def min_non_missing(n_columns: int, threshold: float) -> int:
    """Same float arithmetic as the reference: n=10, t=0.7 gives 4."""
    return int(math.ceil(n_columns * (1 - threshold)))


def drop_sparse_rows(df: DataFrame, threshold: float) -> DataFrame:
    """O-52: keep rows holding at least ceil(ncols * (1 - t)) values."""
    k = min_non_missing(len(df.columns), threshold)
    if k <= 0:
        return df
    return df.na.drop(thresh=k, subset=[q(c) for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """O-53."""
    if not df.columns:
        return df
    return df.na.drop(how="all", subset=[q(c) for c in df.columns])


def _number_value(value: str) -> Decimal | None:
    """The rule value as a number with all its digits; None when it is not a finite one."""
    text = str(value).strip()
    return Decimal(text) if re.match(NUMBER_PATTERN, text) and not math.isinf(float(text)) else None


_LEAST_LONG, _MOST_LONG = -(2**63), 2**63 - 1


def _fits_decimal(v: Decimal) -> bool:
    """Can the value be a decimal literal of 38 digits?"""
    _, digits, exponent = v.as_tuple()
    return -38 <= exponent and len(digits) + max(exponent, 0) <= 38


def _equals_number(c, dtype, v: Decimal):
    """``col == v``, exactly: no integer goes through a double, and none outside the column's range is equal."""
    if _is_integral(dtype):
        if not _LEAST_LONG <= v <= _MOST_LONG or v != v.to_integral_value():
            return F.lit(False)
        return (c.cast("int") if kind_of(dtype) == BOOLEAN else c) == F.lit(int(v))
    if isinstance(dtype, T.DecimalType):
        return c == F.lit(v) if _fits_decimal(v) else F.lit(False)
    return c == F.lit(float(v))


def _compares_number(c, dtype, v: Decimal, gt: bool):
    """``col > v`` or ``col < v`` on a number column, exactly."""
    if _is_integral(dtype):
        if not _LEAST_LONG <= v <= _MOST_LONG:
            return c.isNotNull() if (v < 0) == gt else F.lit(False)
        target = c.cast("int") if kind_of(dtype) == BOOLEAN else c
        bound = int(v.to_integral_value(ROUND_FLOOR if gt else ROUND_CEILING))
        if bound > _MOST_LONG:  # the next whole number above the column's range
            return c.isNotNull()
        return (target > F.lit(bound)) if gt else (target < F.lit(bound))
    if isinstance(dtype, T.DecimalType):
        if not _fits_decimal(v):
            if abs(v) >= Decimal(10) ** 38:
                return c.isNotNull() if (v < 0) == gt else F.lit(False)
            v = v.quantize(Decimal(1).scaleb(-dtype.scale), ROUND_FLOOR if gt else ROUND_CEILING)
        return (c > F.lit(v)) if gt else (c < F.lit(v))
    return (c > F.lit(float(v))) if gt else (c < F.lit(float(v)))


def _datetime_layout(df: DataFrame, name: str) -> tuple[bool, bool]:
    """Does the column print as dates only / with microseconds (one aggregate)."""
    c = F.col(q(name))
    stats = fit(df, _layout_counts(c))
    return stats["not_midnight"] == 0, stats["fraction"] > 0


def _layout_counts(c) -> dict:
    return {"not_midnight": F.count_if(F.date_format(c, "HH:mm:ss.SSSSSS") != "00:00:00.000000"),
            "fraction": F.count_if(F.date_format(c, "SSSSSS") != "000000")}


def datetime_layouts_by(df: DataFrame, name: str, by: str) -> dict:
    """``{key: (dates only, with microseconds)}`` of a datetime column by the values of ``by``."""
    rows = df.groupBy(F.col(q(by)).alias("by")).agg(*[e.alias(k) for k, e in _layout_counts(F.col(q(name))).items()]).collect()
    return {r["by"]: (r["not_midnight"] == 0, r["fraction"] > 0) for r in rows}


def _is_integral(data_type) -> bool:
    return kind_of(data_type) == BOOLEAN or (kind_of(data_type) == NUMERIC and not is_fractional(data_type)
                                              and not isinstance(data_type, T.DecimalType))


def _exact(value: str) -> Decimal:
    """A number that ``float`` has read, with all its digits."""
    try:
        return Decimal(str(value).strip())
    except InvalidOperation:  # a form that only float reads
        return Decimal(float(value))


def compares_layout(df: DataFrame, rule: FilterRule) -> bool:
    """Does the rule compare a datetime as text, in the layout of the column's values?"""
    return (rule.column in df.columns and rule.operator in ("equals", "not_equals", "contains")
            and kind_of(df.schema[rule.column].dataType) == DATETIME)


def filter_condition(df: DataFrame, rule: FilterRule, layout: tuple[bool, bool] | None = None):
    """Condition of one rule, or None when the column is unknown (rule skipped).

    The rule value is a literal, so the driver picks an equivalent form on the
    bare column wherever one exists (``col = v``, ``col > floor(v)``,
    ``col IS NULL OR col <> v``): such forms reach the parquet scan as pushed
    filters. A NULL condition drops the row, as False does.
    """
    if rule.column not in df.columns:
        return None
    dtype = df.schema[rule.column].dataType
    kind = kind_of(dtype)
    c = F.col(q(rule.column))
    op = rule.operator
    if op in ("equals", "not_equals") and kind in (NUMERIC, BOOLEAN):
        v = _number_value(rule.value)
        hit = None if v is None else _equals_number(c, dtype, v)
        if op == "equals":
            return F.lit(False) if v is None else hit
        return F.lit(True) if v is None else (c.isNull() | ~hit)
    if op in ("greater_than", "less_than"):
        moment = _timestamp_value(rule.value)
        if moment is not None and kind == DATETIME:
            bound = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz")
            x = c.cast("timestamp_ntz") if isinstance(dtype, T.DateType) else c
            return (x > bound) if op == "greater_than" else (x < bound)
        v = float(rule.value)  # an ISO value on another kind of column raises
        if math.isnan(v):
            return F.lit(False)
        gt = op == "greater_than"
        if kind == DATETIME:
            return _ns_compare(c, dtype, v, gt)
        if kind == TEXT:
            x = to_number(c)
            return (x > F.lit(v)) if gt else (x < F.lit(v))
        if kind not in (NUMERIC, BOOLEAN) or math.isinf(v):
            return (c > F.lit(v)) if gt else (c < F.lit(v))
        return _compares_number(c, dtype, _exact(rule.value), gt)
    if kind == TEXT and op in ("equals", "not_equals"):
        v = str(rule.value)
        hit = (c.isNull() | (c == F.lit(v))) if v == "nan" else (c == F.lit(v))
        if op == "equals":
            return hit
        return (c.isNotNull() & (c != F.lit(v))) if v == "nan" else (c.isNull() | (c != F.lit(v)))
    dates_only, with_fraction = (layout or _datetime_layout(df, rule.column)) if kind == DATETIME else (False, False)
    text = text_form(c, dtype, dates_only, with_fraction)
    if op == "equals":
        return text == F.lit(str(rule.value))
    if op == "not_equals":
        return text != F.lit(str(rule.value))
    if op == "contains":
        return text.rlike(str(rule.value))
    raise ValueError(f"unknown filter operator: {op}")


def _ns_compare(c, dtype, v: float, gt: bool):
    """Datetime against a number of nanoseconds since the epoch (the reference
    compares the int64 view). The bound becomes a timestamp literal of the
    column's own type, so the comparison stays pushable."""
    if math.isinf(v):
        return c.isNotNull() if (v < 0) == gt else F.lit(False)
    if isinstance(dtype, T.DateType):
        c, dtype = c.cast("timestamp_ntz"), T.TimestampNTZType()
    micros = math.floor(v / 1000) if gt else math.ceil(v / 1000)  # x_ns > v <=> x_us > floor(v/1000)
    bound = F.timestamp_micros(F.lit(micros)).cast(dtype)
    return (c > bound) if gt else (c < bound)


def apply_filters(df: DataFrame, rules: list[FilterRule]) -> DataFrame:
    """O-60: rules are conjunctive; one filter that Catalyst pushes toward the scan.

    Rules without column or value are dropped. A rule that compares a datetime
    as text takes the layout of the rows that the rules before it have left.
    """
    cond = None
    for rule in rules:
        if rule.is_empty():
            continue
        rule.validate()
        c = filter_condition(df if cond is None else df.filter(cond), rule)
        if c is None:
            continue
        cond = c if cond is None else (cond & c)
    return df if cond is None else df.filter(cond)
