"""The cleaning request: mode plus manual options, as plain dataclasses.

Serialised as JSON for presets; the Spark schema of that JSON is
``REQUEST_SCHEMA`` so a presets table can be parsed with ``from_json``.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T

from tabclean.operators.impute import NUMERIC_STRATEGIES, TEXT_STRATEGIES
from tabclean.operators.rows import FilterRule

MODES = ("auto", "manual")


# The field names, defaults and choices are the request contract.
@dataclass
class ManualOptions:
    drop_columns: list = field(default_factory=list)
    target_column: str | None = None
    remove_duplicates: bool = True
    drop_missing_rows_threshold: float | None = None
    fill_numeric_strategy: str = "median"
    fill_text_strategy: str = "mode"
    text_constant: str = "unknown"
    convert_datetimes: bool = True
    encode_categoricals: bool = False
    remove_outliers: bool = False
    outlier_zscore_threshold: float = 3.0
    scale_numeric: bool = False
    filter_rules: list = field(default_factory=list)


@dataclass
class CleanRequest:
    mode: str = "auto"
    manual: ManualOptions = field(default_factory=ManualOptions)
    ai_instructions: str | None = None
    keep_columns: list = field(default_factory=list)  # auto mode: never dropped as an id or as sparse

    def validate(self) -> "CleanRequest":
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        m = self.manual
        if m.fill_numeric_strategy not in NUMERIC_STRATEGIES:
            raise ValueError(f"fill_numeric_strategy must be one of {NUMERIC_STRATEGIES}")
        if m.fill_text_strategy not in TEXT_STRATEGIES:
            raise ValueError(f"fill_text_strategy must be one of {TEXT_STRATEGIES}")
        for rule in m.filter_rules:
            rule.validate()
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_dict(data: dict) -> "CleanRequest":
        manual = dict(data.get("manual") or {})
        rules = [r if isinstance(r, FilterRule) else FilterRule(
            column=r["column"], operator=r.get("operator", "equals"), value=str(r.get("value", "")))
            for r in manual.get("filter_rules") or []]
        manual["filter_rules"] = rules
        known = {k: v for k, v in manual.items() if k in ManualOptions.__dataclass_fields__}
        return CleanRequest(mode=data.get("mode", "auto"), manual=ManualOptions(**known),
                            ai_instructions=data.get("ai_instructions"),
                            keep_columns=list(data.get("keep_columns") or [])).validate()

    @staticmethod
    def from_json(text: str) -> "CleanRequest":
        return CleanRequest.from_dict(json.loads(text))


_ELEMENTS = {  # what the lists hold
    "drop_columns": T.StringType(), "keep_columns": T.StringType(),
    "filter_rules": T.StructType([T.StructField(f.name, T.StringType()) for f in fields(FilterRule)]),
}
_TYPES = {"str": T.StringType(), "bool": T.BooleanType(), "float": T.DoubleType()}


def _schema(kind: type) -> T.StructType:
    """The Spark schema of a dataclass of the request."""
    out = []
    for f in fields(kind):
        name = f.type.split(" ")[0]
        if name == "list":
            data_type = T.ArrayType(_ELEMENTS[f.name])
        elif name == "ManualOptions":
            data_type = _schema(ManualOptions)
        else:
            data_type = _TYPES[name]
        out.append(T.StructField(f.name, data_type))
    return T.StructType(out)


REQUEST_SCHEMA = _schema(CleanRequest)
