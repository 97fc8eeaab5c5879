"""O-20..O-23: infer logical types, coerce number text, convert date text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.functions import to_datetime, to_number
from tabclean.functions.numbers import UNSIGNED_64, to_integer
from tabclean.operators.fit import count_by_column
from tabclean.operators.kinds import BOOLEAN, DATETIME, NUMERIC, TEXT, columns_of, kind_of, q

NUMERIC_COERCE_RATIO = 0.9      # cleaner: share of non-missing values that parse, >=
DATETIME_CONVERT_RATIO = 0.8    # cleaner and profiler: share that parses, >
NUMERIC_INFER_RATIO = 0.9       # profiler: share that parses, >


COERCE_COUNTS = {
    "num": lambda s: to_number(s).isNotNull(), "int": lambda s: to_integer(s, "bigint").isNotNull(),
    "u64": lambda s: to_integer(s, UNSIGNED_64).between(0, F.lit(str(2**64 - 1)).cast(UNSIGNED_64))}
DATE_COUNTS = {"dt": lambda s: to_datetime(s).isNotNull()}


@dataclass
class Conversion:
    df: DataFrame
    converted: list[str]
    lost: dict[str, int] = field(default_factory=dict)  # values of converted columns that did not parse


def coerce_numeric(df: DataFrame, columns: list[str] | None = None) -> Conversion:
    """Text columns where >= 90% of non-missing values are numbers become numbers.

    Values that do not parse become NULL. When every row holds an integer, the
    digits are kept: bigint if all fit, else decimal(20,0) if all are unsigned
    64-bit numbers; otherwise the new column is double (an integer column with
    gaps is double). A boolean column with gaps becomes 0/1 as double, so that
    its gaps are filled like those of any number.
    """
    given = columns if columns is not None else df.columns
    text_cols = [c for c in columns_of(df, TEXT) if c in given]
    bool_cols = [c for c in columns_of(df, BOOLEAN) if c in given]
    if not text_cols + bool_cols:
        return Conversion(df, [])
    stats = count_by_column(df, text_cols + bool_cols, COERCE_COUNTS)
    plan = coercion_plan(stats, df.columns, text_cols, bool_cols)
    return Conversion(coerced(df, plan), list(plan), {n: stats[(n, "nn")] - stats[(n, "num")] for n in plan if n in text_cols})


def coercion_plan(stats: dict, columns: list[str], text_cols: list[str], bool_cols: list[str]) -> dict[str, str]:
    """Which columns become numbers, and of which type."""
    rows, plan = stats[("", "rows")], {}
    for name in columns:
        if name in bool_cols and 0 < stats[(name, "nn")] < rows:
            plan[name] = "flag"
        if name not in text_cols:
            continue
        nn, num = stats[(name, "nn")], stats[(name, "num")]
        if nn == 0 or num / nn < NUMERIC_COERCE_RATIO:
            continue
        plan[name] = "bigint" if stats[(name, "int")] == rows else UNSIGNED_64 if stats[(name, "u64")] == rows else "double"
    return plan


def coerced(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    if not plan:
        return df
    made = {"flag": lambda c: c.cast("int").cast("double"), "double": to_number}
    return df.withColumns({n: made[t](F.col(q(n))) if t in made else to_integer(F.col(q(n)), t) for n, t in plan.items()})


def convert_datetimes(df: DataFrame, columns: list[str] | None = None) -> Conversion:
    """Text columns where > 80% of non-missing values parse as dates become timestamps."""
    text_cols = columns if columns is not None else columns_of(df, TEXT)
    if not text_cols:
        return Conversion(df, [])
    stats = count_by_column(df, text_cols, DATE_COUNTS)
    converted = dates_plan(stats, text_cols)
    return Conversion(dates_converted(df, converted), converted, {n: stats[(n, "nn")] - stats[(n, "dt")] for n in converted})


def dates_plan(stats: dict, text_cols: list[str]) -> list[str]:
    """Which text columns become timestamps."""
    return [n for n in text_cols if stats[(n, "nn")] > 0 and stats[(n, "dt")] / stats[(n, "nn")] > DATETIME_CONVERT_RATIO]


def dates_converted(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: to_datetime(F.col(q(n))) for n in names}) if names else df


def bool_to_int(df: DataFrame) -> Conversion:
    """O-23: boolean columns become 0/1 integers on output."""
    names = columns_of(df, BOOLEAN)
    if not names:
        return Conversion(df, [])
    return Conversion(df.withColumns({n: F.col(q(n)).cast("int") for n in names}), names)


def infer_type(kind: str, non_missing: int, parsed_dates: int, parsed_numbers: int) -> str:
    """O-20, decided on the driver from counts of one aggregate."""
    if non_missing == 0:
        return "unknown"
    if kind in (BOOLEAN, NUMERIC, DATETIME):
        return kind
    if kind == TEXT:
        if parsed_dates / non_missing > DATETIME_CONVERT_RATIO:
            return "datetime"
        if parsed_numbers / non_missing > NUMERIC_INFER_RATIO:
            return "numeric"
        return "text"
    return "unknown" if non_missing == 0 else "text"


def infer_types(df: DataFrame) -> DataFrame:
    """O-20 as a table: column, non-missing count, parse counts, inferred type."""
    stats = count_by_column(df, df.columns, {"dt": lambda s: to_datetime(s).isNotNull(),
                                             "num": lambda s: to_number(s).isNotNull()})
    rows = []
    for i, f in enumerate(df.schema.fields):
        kind = kind_of(f.dataType)
        nn = stats[(f.name, "nn")]
        dt = stats.get((f.name, "dt"), 0)
        num = stats.get((f.name, "num"), 0)
        rows.append((i, f.name, nn, dt, num, infer_type(kind, nn, dt, num)))
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, non_missing bigint, parsed_dates bigint, parsed_numbers bigint, inferred_type string")
