"""O-76: standard scaling with the population std (zero spread divides by 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.operators.fit import moments
from tabclean.operators.kinds import NUMERIC, columns_of, q


def scale_columns(df: DataFrame, target: str | None = None, exclude: list[str] = ()) -> list[str]:
    return [c for c in columns_of(df, NUMERIC) if c != target and c not in set(exclude)]


def scale_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std_pop; missing stays missing. One aggregate, one projection."""
    if not columns:
        return df
    updates = {}
    for c, (_, mean, std) in moments(df, {c: F.col(q(c)) for c in columns}).items():
        if mean is None:
            updates[c] = F.col(q(c)).cast("double")
            continue
        scale = 1.0 if (std is None or std == 0) else float(std)
        updates[c] = (F.col(q(c)).cast("double") - F.lit(float(mean))) / F.lit(scale)
    return df.withColumns(updates)
