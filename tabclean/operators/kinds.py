"""Logical column kinds derived from the Spark schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC, TEXT, DATETIME, BOOLEAN, OTHER = "numeric", "text", "datetime", "boolean", "other"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, _NUMERIC_TYPES):
        return NUMERIC
    if isinstance(data_type, _DATETIME_TYPES):
        return DATETIME
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(data_type, T.NullType):
        return TEXT
    return OTHER


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def fresh(taken, *names: str) -> list[str]:
    """Names for helper columns that no column of ``taken`` has."""
    out = []
    for name in names:
        while name in taken or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def q(name: str) -> str:
    """Backtick-quote a column name (names may hold dots or spaces)."""
    return "`" + name.replace("`", "``") + "`"
