"""O-71: drop rows whose population z-score exceeds the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.functions import to_number
from tabclean.operators.fit import moments
from tabclean.operators.kinds import TEXT, kind_of, q


def _as_number(df: DataFrame, name: str):
    c = F.col(q(name))
    return to_number(c) if kind_of(df.schema[name].dataType) == TEXT else c.cast("double")


def zscore_condition(df: DataFrame, numeric_columns: list[str], threshold: float):
    """Keep a row when every column has |z| <= t, is missing, or has no spread.

    Mean and population std of every column come from one aggregate and go
    into the filter as literals.
    """
    cols = [c for c in numeric_columns if c in df.columns]
    if not cols:
        return None
    near = []
    for c, (_, mean, std) in moments(df, {c: _as_number(df, c) for c in cols}).items():
        if mean is None or std is None or std == 0:
            continue
        z = F.abs((_as_number(df, c) - F.lit(mean)) / F.lit(std))
        near.append(z.isNull() | (z <= F.lit(float(threshold))))
    if not near:
        return None
    return near[0] if len(near) == 1 else F.least(*near)  # flat: false is least


def remove_outliers(df: DataFrame, numeric_columns: list[str], threshold: float = 3.0) -> DataFrame:
    cond = zscore_condition(df, numeric_columns, threshold)
    return df if cond is None else df.filter(cond)
