"""O-46: before / after comparison of two profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("rows", "columns", "missing_cells", "duplicate_rows")


def compare_summaries(spark: SparkSession, before, after, steps: list | None = None) -> DataFrame:
    """The summary numbers before and after; with the step log, also how many steps were taken."""
    values = {
        "rows": (before.rows, after.rows),
        "columns": (before.column_count, after.column_count),
        "missing_cells": (before.missing_cells, after.missing_cells),
        "duplicate_rows": (before.duplicate_rows, after.duplicate_rows),
    }
    rows = [(m, *values[m]) for m in METRICS]
    if steps is not None:
        rows.append(("steps", 0, len(steps)))
    return spark.createDataFrame(rows, "metric string, before bigint, after bigint")


def compare_columns(spark: SparkSession, before, after) -> DataFrame:
    """Full outer join of the two column profiles on the column name."""
    b = before.columns_df(spark).select("name", F.col("inferred_type").alias("type_before"),
                                       F.col("missing_ratio").alias("missing_before"))
    a = after.columns_df(spark).select("name", F.col("inferred_type").alias("type_after"),
                                      F.col("missing_ratio").alias("missing_after"))
    return b.join(a, "name", "full_outer")
