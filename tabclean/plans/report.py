"""O-84: the cleaning report as rows ``section, line_no, text`` (no page cut)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed texts of the report, here and in report_lines.
REPORT_TITLE = "Data Cleaning Report"
REPORT_SCHEMA = "section string, line_no int, text string"


def report_lines(dataset: str, before, after, steps: list) -> list[tuple[str, str]]:
    lines = [("header", REPORT_TITLE), ("header", f"Dataset: {dataset}"), ("header", "")]
    lines += [
        ("counts", f"Rows before: {before.rows}"),
        ("counts", f"Rows after: {after.rows}"),
        ("counts", f"Columns before: {before.column_count}"),
        ("counts", f"Columns after: {after.column_count}"),
        ("counts", f"Missing cells before: {before.missing_cells}"),
        ("counts", f"Missing cells after: {after.missing_cells}"),
        ("counts", ""),
        ("steps", "Applied steps:"),
    ]
    lines += [("steps", f"- {name}: {details}") for name, details in steps]
    lines += [("steps", ""), ("suggestions", "Smart suggestions after cleaning:")]
    lines += [("suggestions", f"- {s}") for s in after.suggestions()]
    return lines


def report_df(spark: SparkSession, dataset: str, before, after, steps: list) -> DataFrame:
    rows = [(section, i + 1, text) for i, (section, text) in enumerate(report_lines(dataset, before, after, steps))]
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """The report is a few dozen lines (steps + 8 suggestions), so one file is fine."""
    ordered = df.orderBy("line_no").coalesce(1).write.mode("overwrite")
    if fmt == "text":
        df.orderBy("line_no").select("text").coalesce(1).write.mode("overwrite").text(path)
    else:
        ordered.json(path)
