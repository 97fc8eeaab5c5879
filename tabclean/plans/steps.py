"""Step names and detail texts of the execution log.

Fixed values: they must equal the reference's log for the same run, so they
are listed here together, in the order the steps can occur.
"""

from __future__ import annotations

# Fixed values (must equal the reference's step log).
STEP_TEXT = {
    "coerce_numeric_like_columns": "Converted numeric-like text columns: {cols}",
    "drop_columns": "Dropped columns: {cols}",
    "remove_duplicates": "Removed {n} duplicate rows.",
    "drop_sparse_rows": "Removed {n} sparse rows.",
    "fill_numeric": "Applied {strategy} strategy to numeric columns: {cols}",
    "fill_datetime": "Filled datetime missing values in: {cols}",
    "fill_text": "Applied {strategy} strategy to text columns: {cols}",
    "convert_datetimes": "Converted to datetime: {cols}",
    "filter_rows": "Filtered {n} rows using manual rules.",
    "remove_outliers": "Removed {n} rows outside z-score threshold.",
    "encode_none": "No text columns available for encoding.",
    "encode_one_hot": "One-hot encoded: {cols}",
    "encode_label": "Label encoded for speed: {cols}",
    "encode_renamed": "Renamed, as the name was taken: {cols}",  # own wording
    "scale_numeric": "Scaled columns: {cols}",
    "drop_empty_rows": "Removed {n} fully empty rows.",
    "drop_empty_columns": "Dropped empty columns: {cols}",
    "normalize_boolean_columns": "Converted boolean columns to 0/1: {cols}",
}
# A fill step is named by the place in the recipe that asks for it
# (auto, post_datetime_auto, manual_numeric, manual_text, post_datetime_manual,
# residual_manual) followed by what it fills (_numeric, _datetime, _text).


def detail(key: str, cols=None, **kw) -> str:
    if cols is not None:
        kw["cols"] = ", ".join(cols)
    return STEP_TEXT[key].format(**kw)
