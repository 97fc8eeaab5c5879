"""O-30..O-45: column and dataset profile.

Three data passes, each one job (submitted together):

* F1 - one aggregate by column index over unpivoted values: row count,
  non-missing counts, parse counts of text columns, mean / sample std / min /
  max / skewness of number values (code size independent of the width).
* F2 - long value counts: every column exploded to ``(idx, typed key)`` and
  counted in ONE shuffle for all columns; distinct counts and the top 5 values
  per column come from that table. A text of over 32 bytes goes by its first
  16 characters and its digest, so a row of the shuffle has tens of bytes however
  long the texts are; the few winners' texts are fetched afterwards (late
  materialisation). The top-5 window is a ``rank() <= 5``, which Spark plans with a
  partial group limit before the shuffle.
* F3 - whole-row duplicates: digests of 16 bytes counted in one ``groupBy``.

Only per-column summaries come back to the driver (bounded by the schema).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabclean.functions import to_datetime, to_number
from tabclean.operators.fit import fit
from tabclean.operators.kinds import BOOLEAN, DATETIME, NUMERIC, OTHER, TEXT, is_fractional, kind_of, q
from tabclean.operators.types import infer_type

TOP_K = 5
# How many of them are given by default; None gives all.
MOST_CANDIDATES, MOST_SUGGESTIONS = 5, 8
ID_UNIQUE_RATIO = 0.95
ID_MISSING_RATIO = 0.05
LOW_CARDINALITY_TEXT = 10

# Fixed texts (must equal the reference's wording).
HINT_NO_NUMERIC = "No numeric distribution available."
HINT_RIGHT = "Right-skewed distribution."
HINT_LEFT = "Left-skewed distribution."
HINT_BALANCED = "Fairly balanced numeric distribution."
HINT_LOW_CARD = "Low-cardinality categorical distribution."
HINT_HIGH_CARD = "High-cardinality text distribution."
HINT_TEMPORAL = "Temporal column detected."
HINT_LIMITED = "Distribution insight is limited for this column."
ALERT_MISSING = "High missing ratio: more than 80% of values are empty."
ALERT_ID = "This column looks like an identifier and may not help model training."
ALERT_LOW_CARD = "Low-cardinality text column: useful candidate for encoding."
SUGGEST_ID = "Consider dropping '{name}' because it behaves like an ID column."
SUGGEST_MISSING = "'{name}' has a high missing ratio; dropping or imputing is recommended."
SUGGEST_MIXED = "'{name}' has mixed types and should be normalized before modeling."

COLUMN_PROFILE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("inferred_type", T.StringType()),
    T.StructField("missing_ratio", T.DoubleType()),
    T.StructField("unique_ratio", T.DoubleType()),
    T.StructField("duplicate_count", T.LongType()),
    T.StructField("possible_id", T.BooleanType()),
    T.StructField("distribution_hint", T.StringType()),
    T.StructField("top_values", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("count", T.LongType())]))),
    T.StructField("numeric_summary", T.StructType([
        T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])),
    T.StructField("smart_alerts", T.ArrayType(T.StringType())),
])

SUMMARY_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("columns", T.LongType()),
    T.StructField("missing_cells", T.LongType()),
    T.StructField("duplicate_rows", T.LongType()),
    T.StructField("numeric_columns", T.LongType()),
    T.StructField("categorical_columns", T.LongType()),
    T.StructField("datetime_columns", T.LongType()),
    T.StructField("target_candidates", T.ArrayType(T.StringType())),
    T.StructField("smart_suggestions", T.ArrayType(T.StringType())),
])


@dataclass
class ColumnProfile:
    ordinal: int
    name: str
    inferred_type: str
    missing_ratio_exact: float
    unique_ratio_exact: float
    duplicate_count: int
    possible_id: bool
    distribution_hint: str
    top_values: list
    numeric_summary: tuple | None
    smart_alerts: list = field(default_factory=list)
    distinct: int = 0

    @property
    def missing_ratio(self) -> float:
        return round(self.missing_ratio_exact, 4)

    @property
    def unique_ratio(self) -> float:
        return round(self.unique_ratio_exact, 4)


@dataclass
class DatasetProfile:
    file_name: str
    rows: int
    columns: list[ColumnProfile]
    missing_cells: int
    duplicate_rows: int

    @property
    def column_count(self) -> int:
        return len(self.columns)

    def count_type(self, t: str) -> int:
        return sum(1 for c in self.columns if c.inferred_type == t)

    def target_candidates(self, most: int | None = MOST_CANDIDATES) -> list[str]:
        """O-43: the first non-id numeric/text/boolean columns with rounded missing < 0.4 (None: all)."""
        fits = (c.name for c in self.columns
                if not c.possible_id and c.inferred_type in ("numeric", "text", "boolean") and c.missing_ratio < 0.4)
        return list(fits)[:most]

    def suggestions(self, most: int | None = MOST_SUGGESTIONS) -> list[str]:
        """O-44: the first texts, by column, of the rules that hold (None: all)."""
        rules = ((SUGGEST_ID, lambda c: c.possible_id), (SUGGEST_MISSING, lambda c: c.missing_ratio > 0.6),
                 (SUGGEST_MIXED, lambda c: c.inferred_type == "mixed"))
        return [text.format(name=c.name) for c in self.columns for text, holds in rules if holds(c)][:most]

    def by_name(self) -> dict[str, ColumnProfile]:
        return {c.name: c for c in self.columns}

    # -- tables -----------------------------------------------------------
    def columns_df(self, spark: SparkSession) -> DataFrame:
        rows = [(
            c.ordinal, c.name, c.inferred_type, c.missing_ratio, c.unique_ratio, c.duplicate_count,
            c.possible_id, c.distribution_hint, [(v, n) for v, n in c.top_values],
            c.numeric_summary, list(c.smart_alerts)) for c in self.columns]
        return spark.createDataFrame(rows, COLUMN_PROFILE_SCHEMA)

    def summary_row(self) -> tuple:
        return (self.file_name, self.rows, self.column_count, self.missing_cells, self.duplicate_rows,
                self.count_type("numeric"), self.count_type("text"), self.count_type("datetime"),
                self.target_candidates(), self.suggestions())

    def summary_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.summary_row()], SUMMARY_SCHEMA)


def _profile_view(df: DataFrame) -> DataFrame:
    """NaN counts as missing in a profile, as it does for the reference."""
    cols = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if is_fractional(f.dataType):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.MapType):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.VariantType):
            c = F.try_variant_get(c, "$", "string")  # a JSON null is missing
        cols.append(c.alias(f.name))
    return df.select(*cols)


# What the auto plan counts of a column beside its values.
AUTO_PROFILE_COUNTS = {"dt": lambda s: to_datetime(s).isNotNull(), "num": lambda s: to_number(s).isNotNull()}


# Value slots of the long value-count table: text, integral, fractional, time, digest of a long text.
_SLOTS = ("s", "i", "d", "t", "h")
INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# A text of more bytes is stood for by its first characters (which order it) and its digest.
LONG_TEXT, LEADING = 32, 16


def _slot_of(data_type) -> str:
    kind = kind_of(data_type)
    if kind == BOOLEAN or isinstance(data_type, INT_TYPES):
        return "i"
    if kind == NUMERIC and is_fractional(data_type):
        return "d"
    if kind == DATETIME:
        return "t"
    return "s"


def _slot_values(c, data_type) -> dict:
    """Typed value of a column in its slot: numbers and times are grouped as
    numbers and times (no text conversion per row); -0.0 counts as 0.0. A decimal keeps
    its digits as text, and its double beside it for the order."""
    slot = _slot_of(data_type)
    vals = {"s": F.lit(None).cast("string"), "i": F.lit(None).cast("bigint"),
            "d": F.lit(None).cast("double"), "t": F.lit(None).cast("timestamp_ntz"), "h": F.lit(None).cast("binary")}
    if slot == "i":
        vals["i"] = c.cast("bigint")
    elif slot == "d":
        vals["d"] = F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
    elif slot == "t":
        vals["t"] = c.cast("timestamp_ntz")
    elif isinstance(data_type, T.DecimalType):
        vals["s"], vals["d"] = c.cast("string"), c.cast("double")
    else:
        text = c.cast("string")
        long = F.octet_length(text) > LONG_TEXT
        vals["s"] = F.when(long, F.substring(text, 1, LEADING)).otherwise(text)
        vals["h"] = F.when(long, _digest(text))
    return vals


def _digest(text):
    return F.unhex(F.md5(text.cast("binary")))


def distinct_by(view: DataFrame, by: str) -> dict:
    """``{key: {column: distinct non-missing values}}`` by the values of ``by``, from digests of 16 bytes."""
    fields = [f for f in view.schema.fields if f.name != by]
    structs = []
    for i, f in enumerate(fields):
        values = _slot_values(F.col(q(f.name)), f.dataType)
        value = values[_slot_of(f.dataType)].cast("string")
        structs.append(F.struct(F.lit(i).alias("idx"), F.coalesce(values["h"], _digest(value)).alias("d")))
    long = view.select(F.col(q(by)).alias("by"), F.inline(F.array(*structs))).filter("d is not null").distinct()
    out: dict = {}
    for r in long.groupBy("by", "idx").agg(F.count(F.lit(1)).alias("k")).collect():
        out.setdefault(r["by"], {})[fields[r["idx"]].name] = int(r["k"])
    return out


def is_possible_id(distinct: int, rows: int, missing: int, inferred: str) -> bool:
    """O-37, from unrounded ratios."""
    missing_ratio = float(missing / rows) if rows else 0.0
    return distinct / max(rows, 1) > ID_UNIQUE_RATIO and missing_ratio < ID_MISSING_RATIO and inferred in ("numeric", "text")


def value_counts(df: DataFrame) -> DataFrame:
    """Long value counts ``(idx, s, i, d, t, h, n)`` of every column, ONE shuffle.

    Map-side partial aggregation collapses repeated values before the
    exchange, so a value holding a third of the rows is one row per task.
    """
    structs = []
    for i, f in enumerate(df.schema.fields):
        vals = _slot_values(F.col(q(f.name)), f.dataType)
        structs.append(F.struct(F.lit(i).alias("idx"), *[vals[k].alias(k) for k in _SLOTS]))
    long = df.select(F.inline(F.array(*structs)))
    return long.groupBy("idx", *_SLOTS).agg(F.count(F.lit(1)).alias("n"))


def variant_kinds(df: DataFrame) -> dict[str, list[str]]:
    """The kinds of value in each VARIANT column (number widths and object fields aside), in one aggregate."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)]
    kind = {c: F.regexp_extract(F.schema_of_variant(F.col(q(c))), "^[A-Z_]+", 0) for c in names}
    found = fit(df, {c: F.array_sort(F.collect_set(F.when(~F.is_variant_null(F.col(q(c))), kind[c]))) for c in names})
    return {c: list(found[c]) for c in names}


def _present():
    return F.col("s").isNotNull() | F.col("i").isNotNull() | F.col("d").isNotNull() | F.col("t").isNotNull()


def distinct_stats(counts: DataFrame) -> DataFrame:
    """Per column: distinct non-missing values and whether a missing value occurs."""
    return counts.groupBy("idx").agg(
        F.count_if(_present()).alias("distinct"),
        F.max((~_present()).cast("int")).alias("has_missing"),
        F.sum("n").alias("rows"))


def display_value(schema: T.StructType):
    """Text of a top value as the reference prints it (after the top-k, few rows)."""
    from tabclean.functions.textform import double_text
    code = F.element_at(F.array(*[F.lit(
        "b" if kind_of(f.dataType) == BOOLEAN else _slot_of(f.dataType)) for f in schema.fields]), F.col("idx") + 1)
    t = F.col("t").cast("timestamp")
    time_text = F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd HH:mm:ss")) \
                 .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return (F.when(code == "b", F.when(F.col("i") == 1, F.lit("True")).when(F.col("i") == 0, F.lit("False")))
            .when(code == "i", F.col("i").cast("string"))
            .when(code == "d", F.when(F.col("d").isNotNull(), double_text(F.col("d"))))
            .when(code == "t", time_text)
            .otherwise(F.col("s")))


MOST_TIED = 200  # candidates a column may send to the driver


def _candidates(counts: DataFrame, schema: T.StructType, k: int) -> DataFrame:
    """Values that may be among the top ``k`` of their column: those whose count and leading characters
    (or number) are, ties included; at most one more than ``MOST_TIED`` a column."""
    decimals = [i for i, f in enumerate(schema.fields) if isinstance(f.dataType, T.DecimalType)]
    lead = F.substring("s", 1, LEADING)
    if decimals:
        lead = F.when(F.col("idx").isin(decimals), F.when(F.col("s").isNotNull(), F.lit(""))).otherwise(lead)
    order = [F.desc("n"), *[F.asc_nulls_last(x) for x in ("i", "d", "t")], F.asc_nulls_last("lead")]
    near = counts.withColumn("lead", lead).withColumn("place", F.rank().over(Window.partitionBy("idx").orderBy(*order)))
    near = near.filter(F.col("place") <= k)
    nth = F.row_number().over(Window.partitionBy("idx").orderBy("place", "s", "h"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= MOST_TIED + 1)


def _whole_texts(view: DataFrame, columns: list[int], wanted: list[tuple]) -> dict:
    """``{(idx, digest): text}`` of long texts: one scan of their columns, one text a task and digest out."""
    fields = view.schema.fields
    table = view.sparkSession.createDataFrame(wanted, "idx int, h binary")  # at most MOST_TIED a column
    structs = [F.struct(F.lit(i).alias("idx"), F.col(q(fields[i].name)).cast("string").alias("v")) for i in columns]
    long = view.select(F.inline(F.array(*structs))).filter(F.octet_length("v") > LONG_TEXT).withColumn("h", _digest(F.col("v")))
    found = long.join(F.broadcast(table), ["idx", "h"]).groupBy("idx", "h").agg(F.first("v").alias("v"))
    return {(r["idx"], bytes(r["h"])): r["v"] for r in found.collect()}


def _top_by_whole_text(view: DataFrame, name: str, k: int) -> list[tuple]:
    """The top ``k`` of one text column counted by whole texts: for more ties than digests and leading characters resolve."""
    text = F.col(q(name)).cast("string")
    counts = view.groupBy(text.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return [(r["v"], int(r["n"])) for r in counts.orderBy(F.desc("n"), F.asc_nulls_last("v")).limit(k).collect()]


def column_value_summary(view: DataFrame, with_top: bool = True, k: int = TOP_K) -> tuple[dict, dict]:
    """``{idx: (distinct, has missing)}`` and ``{idx: [(value, count)]}`` of all columns.

    Both come from the same value-count exchange, which Spark reuses. Top
    values go by count descending, then value ascending, missing last.
    """
    fields = view.schema.fields
    counts = value_counts(view)
    dist = distinct_stats(counts).select("idx", F.lit(0).alias("place"), "distinct", "has_missing", F.col("rows").alias("n"),
                                         *[F.lit(None).cast(t).alias(c) for c, t in _CANDIDATE.items()])
    rows = dist
    if with_top:
        near = _candidates(counts, view.schema, k).withColumn("value", display_value(view.schema))
        rows = dist.unionByName(near.select("idx", "place", F.lit(None).cast("bigint").alias("distinct"),
                                            F.lit(None).cast("int").alias("has_missing"), "n", *_CANDIDATE))
    distinct, near = {}, {}
    for r in rows.collect():
        if r["place"] == 0:
            distinct[r["idx"]] = (int(r["distinct"]), bool(r["has_missing"]))
        else:
            near.setdefault(r["idx"], []).append(r)
    many = {i for i, found in near.items() if len(found) > MOST_TIED}
    wanted = [(i, bytes(r["h"])) for i, found in near.items() if i not in many for r in found if r["h"] is not None]
    texts = _whole_texts(view, sorted({i for i, _ in wanted}), wanted) if wanted else {}
    tops = {}
    for i, found in near.items():
        if i in many:
            tops[i] = _top_by_whole_text(view, fields[i].name, k)
            continue
        each = []
        for r in found:
            value = texts[(i, bytes(r["h"]))] if r["h"] is not None else r["value"]
            typed = [r["i"], r["d"], r["t"]]
            if isinstance(fields[i].dataType, T.DecimalType) and r["s"] is not None:
                typed = [Decimal(r["s"])]
            order = [(v is None, v) for v in typed if v is not None] or [(r["value"] is None, (value or "").encode())]
            each.append((-int(r["n"]), value is None, order, value))
        each.sort(key=lambda x: x[:3])
        tops[i] = [(value, -n) for n, _, _, value in each[:k]]
    return distinct, tops


_CANDIDATE = {"i": "bigint", "d": "double", "t": "timestamp_ntz", "s": "string", "h": "binary", "value": "string"}


def duplicate_rows(df: DataFrame) -> int:
    """O-32: rows beyond the first of each identical row; NULL equals NULL. Digests alone are shuffled."""
    from tabclean.operators.dedupe import repeated
    return repeated(df).extra


def _adjusted_skew(g1, n):
    if g1 is None or n is None or n < 3 or (isinstance(g1, float) and math.isnan(g1)):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def profile(df: DataFrame, file_name: str = "dataset", light: bool = False) -> DatasetProfile:
    """O-45: whole profile of a DataFrame (three jobs, see module doc).

    ``light`` skips number summaries, top values and whole-row duplicates
    (two jobs): enough for id and sparse-column detection.
    """
    view = _profile_view(df)
    fields = view.schema.fields
    mixed = {c for c, kinds in variant_kinds(df).items() if len(kinds) > 1}

    # F1, F2 and F3 do not depend on each other: they are submitted together
    # from driver threads, so the scheduler can run their stages side by side
    # (each job's partitioning, and so its result, is the same as alone).
    with ThreadPoolExecutor(max_workers=3) as pool:
        f1 = pool.submit(column_stats, view, light)
        f2 = pool.submit(column_value_summary, view, not light)
        f3 = pool.submit(lambda: 0 if light else duplicate_rows(view))
        stats, (dist, tops), dups = f1.result(), f2.result(), f3.result()
    if not fields:
        stats[("", "rows")] = view.count()
    rows = int(stats[("", "rows")] or 0)

    columns = []
    missing_cells = 0
    for i, f in enumerate(fields):
        kind = kind_of(f.dataType)
        nn = int(stats[(f.name, "nn")])
        missing_cells += rows - nn
        inferred = infer_type(kind if kind != OTHER else TEXT, nn, stats.get((f.name, "dt"), 0) or 0,
                              stats.get((f.name, "num"), 0) or 0)
        if kind == OTHER and inferred != "unknown":
            inferred = "text"
        if f.name in mixed and inferred == "text":
            inferred = "mixed"
        distinct, has_missing = dist.get(i, (0, rows > 0))
        missing_ratio = float((rows - nn) / rows) if rows else 0.0
        unique_ratio = distinct / max(rows, 1)
        duplicate_count = rows - distinct - (1 if has_missing else 0)
        possible_id = is_possible_id(distinct, rows, rows - nn, inferred)
        top = tops.get(i, [])
        summary = None
        hint = HINT_LIMITED
        if inferred == "numeric":
            xn = stats.get((f.name, "xn"), 0) or 0
            summary = tuple(_nan_null(stats.get((f.name, s))) for s in ("mean", "std", "min", "max"))
            if xn == 0:
                hint = HINT_NO_NUMERIC
            else:
                skew = _adjusted_skew(stats.get((f.name, "skew")), xn)
                skew = 0.0 if skew is None else skew
                hint = HINT_RIGHT if skew > 1 else HINT_LEFT if skew < -1 else HINT_BALANCED
        elif inferred == "text":
            hint = HINT_LOW_CARD if distinct <= LOW_CARDINALITY_TEXT else HINT_HIGH_CARD
        elif inferred == "datetime":
            hint = HINT_TEMPORAL
        alerts = []
        if missing_ratio >= 0.8:
            alerts.append(ALERT_MISSING)
        if possible_id:
            alerts.append(ALERT_ID)
        if unique_ratio <= 0.02 and inferred == "text":
            alerts.append(ALERT_LOW_CARD)
        columns.append(ColumnProfile(i, f.name, inferred, missing_ratio, unique_ratio, duplicate_count,
                                     possible_id, hint, top, summary, alerts, distinct))
    return DatasetProfile(file_name, rows, columns, missing_cells, dups)


def column_stats(view: DataFrame, light: bool = False) -> dict:
    """per-column counts, parse counts and number moments in ONE job.

    Values are unpivoted to ``(idx, present, x, s)`` and aggregated by column
    index, so the generated code is the same size for 5 or 5,000 columns (a
    one-row aggregate with several functions per column grows with the
    schema and outgrows the JVM's method limits on wide tables). ``x`` is the
    number of a numeric column or the parsed number of a text column; ``s``
    the text of a text column, tested as a date. Partial aggregation leaves
    one row per column and task before the shuffle.
    """
    fields = view.schema.fields
    if not fields:
        return {}
    structs = []
    for i, f in enumerate(fields):
        c = F.col(q(f.name))
        kind = kind_of(f.dataType)
        x = c.cast("double") if kind == NUMERIC else F.lit(None).cast("double")
        s = c.cast("string") if kind == TEXT else F.lit(None).cast("string")
        structs.append(F.struct(F.lit(i).alias("idx"), c.isNotNull().alias("p"), x.alias("x"), s.alias("s")))
    long = (view.select(F.inline(F.array(*structs)))
            .withColumn("x", F.coalesce(F.col("x"), to_number(F.col("s")))))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if("p").alias("nn"),
            F.count(to_datetime(F.col("s"))).alias("dt"), F.count("x").alias("xn")]
    if not light:
        aggs += [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                 F.max("x").alias("max"), F.skewness("x").alias("skew")]
    stats = {("", "rows"): 0}
    for r in long.groupBy("idx").agg(*aggs).collect():
        f = fields[r["idx"]]
        stats[("", "rows")] = int(r["rows"])
        stats[(f.name, "nn")] = int(r["nn"])
        if kind_of(f.dataType) == TEXT:
            stats[(f.name, "dt")] = int(r["dt"])
            stats[(f.name, "num")] = int(r["xn"])
        if kind_of(f.dataType) in (NUMERIC, TEXT):
            stats[(f.name, "xn")] = int(r["xn"])
            if not light:
                for k in ("mean", "std", "min", "max", "skew"):
                    stats[(f.name, k)] = r[k]
    for f in fields:
        stats.setdefault((f.name, "nn"), 0)
    return stats


def _nan_null(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v)
