"""O-85, O-86: flags from a free-text instruction and the plan they suggest.

Both are column expressions over a table of instructions, so a table of
many prompts is processed by the executors; the only driver input is the
profile's short lists of id-like and mostly-missing columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.plans.request import CleanRequest, ManualOptions

# Fixed values (must equal the reference's behaviour): flag -> lower-case substrings.
FLAG_WORDS = {
    "flag_id": ("id", "identifier"),
    "flag_missing": ("missing", "null", "empty"),
    "flag_duplicate": ("duplicate",),
    "flag_outlier": ("outlier",),
    "flag_encode": ("encode", "categorical"),
    "flag_scale": ("scale", "normalize", "standardize"),
    "flag_date": ("date", "datetime"),
}

# Fixed texts (must equal the reference's wording).
REASON_IDS = "Flagged likely identifier columns: {cols}."
REASON_MISSING = "Suggested filling missing values using median for numeric data and mode for text data."
REASON_DUPLICATE = "Duplicate row removal is enabled."
REASON_OUTLIER = "Outlier removal was enabled using the default z-score threshold."
REASON_ENCODE = "Categorical encoding is enabled for model-ready data."
REASON_SCALE = "Numeric feature scaling is enabled."
REASON_DATE = "Datetime conversion remains enabled for date-like columns."
REASON_HIGH_MISSING = "Columns with very high missing values were detected: {cols}."
REASON_DEFAULT = ("Applied a safe default plan: remove duplicates, keep datetime detection, "
                  "and prepare missing-value handling.")
HIGH_MISSING = 0.8


def prompt_flags(df: DataFrame, text_col: str) -> DataFrame:
    """Seven boolean flags by lower-case substring (``hidden`` sets the id flag)."""
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    flags = {}
    for name, words in FLAG_WORDS.items():
        cond = F.lit(False)
        for w in words:
            cond = cond | lowered.contains(w)
        flags[name] = cond
    return df.withColumns(flags)


def suggest_plans(df: DataFrame, text_col: str, profile) -> DataFrame:
    """One suggested manual request per instruction row, with its reasons."""
    ids = [c.name for c in profile.columns if c.possible_id]
    high_missing = [c.name for c in profile.columns if c.missing_ratio >= HIGH_MISSING]
    flagged = prompt_flags(df, text_col)
    f = F.col
    reasons = [
        F.when(f("flag_id") & F.lit(bool(ids)), F.lit(REASON_IDS.format(cols=", ".join(ids)))),
        F.when(f("flag_missing"), F.lit(REASON_MISSING)),
        F.when(f("flag_duplicate"), F.lit(REASON_DUPLICATE)),
        F.when(f("flag_outlier"), F.lit(REASON_OUTLIER)),
        F.when(f("flag_encode"), F.lit(REASON_ENCODE)),
        F.when(f("flag_scale"), F.lit(REASON_SCALE)),
        F.when(f("flag_date"), F.lit(REASON_DATE)),
    ]
    given = F.concat_ws(" | ", *reasons)
    default = [REASON_HIGH_MISSING.format(cols=", ".join(high_missing))] if high_missing else []
    default.append(REASON_DEFAULT)
    no_reason = given == ""
    ids_list = F.array(*[F.lit(c) for c in ids]).cast("array<string>")
    none = F.array().cast("array<string>")
    out = flagged.withColumns({
        "drop_columns": F.when(f("flag_id") | no_reason, ids_list).otherwise(none),
        "fill_numeric_strategy": F.lit("median"),
        "fill_text_strategy": F.lit("mode"),
        "remove_duplicates": F.lit(True),
        "remove_outliers": f("flag_outlier"),
        "encode_categoricals": f("flag_encode"),
        "scale_numeric": f("flag_scale"),
        "convert_datetimes": F.lit(True),
        "reasons": F.when(no_reason, F.lit(" | ".join(default))).otherwise(given),
    })
    return out.drop(*FLAG_WORDS)


def request_of(row, text_col: str = "text") -> CleanRequest:
    """The manual request that a row of ``suggest_plans`` asks for, with its prompt (where the row has it)."""
    prompt = row[text_col] if text_col in row.__fields__ else None
    return CleanRequest(mode="manual", ai_instructions=prompt, manual=ManualOptions(
        drop_columns=list(row["drop_columns"]), remove_duplicates=row["remove_duplicates"],
        fill_numeric_strategy=row["fill_numeric_strategy"], fill_text_strategy=row["fill_text_strategy"],
        remove_outliers=row["remove_outliers"], encode_categoricals=row["encode_categoricals"],
        scale_numeric=row["scale_numeric"], convert_datetimes=row["convert_datetimes"])).validate()
