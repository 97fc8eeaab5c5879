"""O-64..O-70: fill missing numbers, datetimes and text.

One aggregate finds the gaps (and means); the exact medians of the columns
with gaps come from the distributed rank; the modes of datetime and text
columns come from one long value-count shuffle, reduced per column by
``min_by(value, (-count, value))`` (largest count, smallest value on ties).
Fitted values go back into the plan as literals (no join).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.operators.fit import count_by_column, moments
from tabclean.operators.kinds import DATETIME, NUMERIC, TEXT, columns_of, q
from tabclean.operators.rank import exact_medians
from tabclean.plans.steps import detail

NUMERIC_STRATEGIES = ("mean", "median", "zero", "none")
TEXT_STRATEGIES = ("mode", "constant", "none")


@dataclass
class FillResult:
    df: DataFrame
    steps: list = field(default_factory=list)
    values: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)  # rows and present values of each column of ``df``, as ``count_by_column`` gives them


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median of each column (the midpoint of the two middle values), from one distributed rank."""
    if not columns:
        return {}
    structs = [F.struct(F.lit(i).alias("idx"), F.col(q(c)).cast("double").alias("v")) for i, c in enumerate(columns)]
    medians = exact_medians(df.select(F.inline(F.array(*structs))), "idx", "v")
    return {c: medians.get(i) for i, c in enumerate(columns)}


def medians_by(df: DataFrame, columns: list[str], by: str) -> dict:
    """``{key: {column: exact median}}`` by the values of ``by``, a column of whole numbers from 0."""
    structs = [F.struct(F.lit(i).alias("idx"), F.col(q(c)).cast("double").alias("v")) for i, c in enumerate(columns)]
    long = df.select(F.col(q(by)).cast("bigint").alias("by"), F.inline(F.array(*structs)))
    medians = exact_medians(long.select((F.col("by") * len(columns) + F.col("idx")).alias("g"), "v"), "g", "v")
    out: dict = {}
    for g, v in medians.items():
        out.setdefault(g // len(columns), {})[columns[g % len(columns)]] = v
    return out


def column_modes(df: DataFrame, text_cols: list[str], datetime_cols: list[str]) -> dict:
    """Most frequent value of each column, the smallest one on ties."""
    return modes_by(df, text_cols, datetime_cols, None).get(0, {})


def modes_by(df: DataFrame, text_cols: list[str], datetime_cols: list[str], by: str | None) -> dict:
    """``{key: {column: most frequent value}}`` by the values of ``by`` (None: one key, 0), the smallest one on ties."""
    structs = []
    names = list(text_cols) + list(datetime_cols)
    for i, c in enumerate(names):
        is_text = c in text_cols
        s = F.col(q(c)).cast("string") if is_text else F.lit(None).cast("string")
        t = F.lit(None).cast("timestamp_ntz") if is_text else F.col(q(c)).cast("timestamp_ntz")
        structs.append(F.struct(F.lit(i).alias("idx"), s.alias("s"), t.alias("t")))
    if not structs:
        return {}
    key = F.lit(0) if by is None else F.col(q(by))
    long = df.select(key.alias("by"), F.inline(F.array(*structs))).filter(F.col("s").isNotNull() | F.col("t").isNotNull())
    counts = long.groupBy("by", "idx", "s", "t").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("by", "idx").agg(
        F.min_by(F.struct("s", "t"), F.struct((-F.col("n")).alias("m"), F.col("s"), F.col("t"))).alias("mode"))
    out: dict = {}
    for r in modes.collect():
        name = names[r["idx"]]
        out.setdefault(r["by"], {})[name] = r["mode"]["s"] if name in text_cols else r["mode"]["t"]
    return out


def fill_gaps(df: DataFrame, names: dict[str, str], numbers: set[str]) -> DataFrame:
    """Gaps of each column in ``names`` take the value of the column named beside it; ``numbers`` become doubles."""
    def filled(c, v):
        dtype = df.schema[c].dataType
        own = F.col(q(c)).cast("double") if c in numbers else F.col(q(c))
        return F.coalesce(own, F.col(q(v)) if c in numbers else F.col(q(v)).cast(dtype))

    return df.withColumns({c: filled(c, v) for c, v in names.items()})


def missing_cleanup(df: DataFrame, numeric_strategy: str = "median", text_strategy: str = "mode",
                    text_constant: str = "unknown", step_prefix: str = "missing_cleanup", stats: dict | None = None) -> FillResult:
    """O-70: numeric fill, then datetime fill (always), then text fill; logged per kind.

    ``stats`` are the counts of ``df`` where they are known already; else they are counted.
    """
    numeric_cols = columns_of(df, NUMERIC)
    datetime_cols = columns_of(df, DATETIME)
    text_cols = columns_of(df, TEXT)
    counted = numeric_cols + datetime_cols + text_cols
    if stats is None or any((c, "nn") not in stats for c in counted):
        stats = count_by_column(df, counted, {})
    rows = stats[("", "rows")]

    def gaps(c):
        return stats[(c, "nn")] < rows

    steps, values, updates = [], {}, {}
    filled = [c for c in numeric_cols if gaps(c)] if numeric_strategy != "none" else []
    dt_gaps = [c for c in datetime_cols if gaps(c) and stats[(c, "nn")] > 0]
    text_gaps = [c for c in text_cols if gaps(c)] if text_strategy != "none" else []
    mode_text = text_gaps if text_strategy == "mode" else []
    # The median and mode jobs do not depend on each other: submitted together.
    with ThreadPoolExecutor(max_workers=2) as pool:
        medians = pool.submit(column_medians, df, filled) if numeric_strategy == "median" else None
        modes = pool.submit(column_modes, df, mode_text, dt_gaps) if (mode_text or dt_gaps) else None
        medians = medians.result() if medians else {}
        modes = modes.result() if modes else {}

    if numeric_strategy != "none":
        if numeric_strategy == "median":
            fills = medians
        elif numeric_strategy == "mean":
            fills = {c: mean for c, (_, mean, _) in moments(df, {c: F.col(q(c)) for c in filled}).items()}
        else:
            fills = {c: 0.0 for c in filled}
        for c in filled:
            v = fills.get(c)
            v = None if v is None else float(v)
            values[c] = v
            x = F.col(q(c)).cast("double")
            updates[c] = x if v is None else F.coalesce(x, F.lit(v))
        if filled:
            steps.append((step_prefix + "_numeric",
                          detail("fill_numeric", filled, strategy=numeric_strategy)))

    filled_dt = []
    for c in dt_gaps:
        v = modes.get(c)
        if v is None:
            continue
        values[c] = v
        dtype = df.schema[c].dataType
        updates[c] = F.coalesce(F.col(q(c)), F.lit(v).cast("timestamp_ntz").cast(dtype))
        filled_dt.append(c)
    if filled_dt:
        steps.append((step_prefix + "_datetime", detail("fill_datetime", filled_dt)))

    if text_gaps:
        for c in text_gaps:
            v = text_constant if text_strategy == "constant" else modes.get(c, text_constant)
            if v is None:
                v = text_constant
            values[c] = v
            updates[c] = F.coalesce(F.col(q(c)), F.lit(v))
        steps.append((step_prefix + "_text", detail("fill_text", text_gaps, strategy=text_strategy)))

    out = df.withColumns(updates) if updates else df
    return FillResult(out, steps, values, stats | {(c, "nn"): rows for c, v in values.items() if v is not None})
