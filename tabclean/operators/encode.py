"""O-72..O-75: one-hot or label encoding of text columns.

Cardinalities come from one long value-count shuffle. One-hot columns hold at
most 20 values, so their sorted values are a bounded collect. Label codes are
dense ranks from the distributed rank (no single-task window), joined back
per column by digest (see ``label_encode``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabclean.operators.kinds import fresh, q
from tabclean.operators.rank import dense_ranks
from tabclean.plans.steps import detail

ONE_HOT_MAX_VALUES = 20
ONE_HOT_MAX_RATIO = 0.2
BROADCAST_LABELS_MAX = 200_000   # distinct values of a broadcast label table


@dataclass
class EncodingPlan:
    one_hot: dict = field(default_factory=dict)     # column -> sorted values
    label: list = field(default_factory=list)
    distinct: dict = field(default_factory=dict)
    rows: int = 0


def _long_counts(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    structs = [F.struct(F.lit(i).alias("idx"), F.col(q(c)).cast("string").alias("v")) for i, c in enumerate(columns)]
    key = [] if by is None else [F.col(q(by)).alias("by")]
    return (df.select(*key, F.inline(F.array(*structs)))
            .groupBy(*[k for k in ("by",) if by is not None], "idx", "v").agg(F.count(F.lit(1)).alias("n")))


def choose_encoding(df: DataFrame, columns: list[str]) -> EncodingPlan:
    """O-72: one-hot when distinct <= 20 and distinct / rows <= 0.2, else label."""
    if not columns:
        return EncodingPlan()
    return _encoding_plans(_long_counts(df, columns).withColumn("by", F.lit(0)), columns).get(0) or _decided(EncodingPlan(), columns, {})


def choose_encoding_by(df: DataFrame, columns: list[str], by: str) -> dict:
    """O-72 for each value of ``by`` alone (at most 22 rows a key and column come back)."""
    return _encoding_plans(_long_counts(df, columns, by), columns) if columns else {}


def _encoding_plans(counts: DataFrame, columns: list[str]) -> dict:
    per_col = counts.groupBy("by", "idx").agg(
        F.count("v").alias("distinct"), F.sum("n").alias("rows"))
    w = Window.partitionBy("by", "idx").orderBy("v")
    first = (counts.filter(F.col("v").isNotNull())
             .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= ONE_HOT_MAX_VALUES + 1))
    stats = per_col.select("by", "idx", "distinct", "rows", F.lit(None).cast("string").alias("v"),
                           F.lit(0).alias("r"))
    both = stats.unionByName(first.select("by", "idx", F.lit(None).cast("bigint").alias("distinct"),
                                          F.lit(None).cast("bigint").alias("rows"), "v", "r"))
    plans: dict = {}
    values: dict = {}
    for r in both.collect():
        plan = plans.setdefault(r["by"], EncodingPlan())
        if r["r"] == 0:
            plan.distinct[columns[r["idx"]]] = int(r["distinct"])
            plan.rows = max(plan.rows, int(r["rows"]))
        else:
            values.setdefault(r["by"], {}).setdefault(r["idx"], []).append((r["r"], r["v"]))
    return {key: _decided(plan, columns, values.get(key, {})) for key, plan in plans.items()}


def _decided(plan: EncodingPlan, columns: list[str], values: dict) -> EncodingPlan:
    for i, c in enumerate(columns):
        d = plan.distinct.get(c, 0)
        if d <= ONE_HOT_MAX_VALUES and d / max(plan.rows, 1) <= ONE_HOT_MAX_RATIO:
            plan.one_hot[c] = [v for _, v in sorted(values.get(i, []))]
        else:
            plan.label.append(c)
    return plan


def one_hot(df: DataFrame, encoded: dict) -> tuple[DataFrame, list[str], dict]:
    """O-73: ``{col}_{value}`` 0/1 columns appended at the end, source dropped.

    A name that is taken already gets the next free number (``a_x_2``). Returns
    the frame, the new names and what was renamed.
    """
    keep = [c for c in df.columns if c not in encoded]
    taken, dummies, names, renamed = set(keep), [], [], {}
    for c, vals in encoded.items():
        for v in vals:
            name, k = f"{c}_{v}", 2
            while name in taken:
                name, k = f"{c}_{v}_{k}", k + 1
            if k > 2:
                renamed[f"{c}={v}"] = name
            taken.add(name)
            dummies.append(F.when(F.col(q(c)) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(name))
            names.append(name)
    return df.select(*[F.col(q(c)) for c in keep], *dummies), names, renamed


def _digest(v):
    """16 bytes that stand for a value in joins and shuffles."""
    return F.unhex(F.md5(v.cast("binary")))


def label_encode(df: DataFrame, columns: list[str], distinct: dict | None = None,
                 rows: int | None = None, counts: DataFrame | None = None,
                 broadcast_max: int = BROADCAST_LABELS_MAX, by: str | None = None) -> DataFrame:
    """O-74: code = position among the sorted distinct values, missing = -1.

    The values are ranked once and then stood for by 16-byte digests. Each
    column adds joins to one and the same branch, so the input is scanned once
    whatever the number of columns. A label table of at most
    ``broadcast_max`` values (24 bytes each) is broadcast. Of a larger one, the
    values that alone exceed an average partition (at most one a partition) are
    broadcast; the rows they and the missing values leave without a key get
    keys of their own that match nothing, so no key is hot in the join of the rest.

    With ``by`` (a whole-number column) the codes count from 0 within each of its values.
    """
    if not columns:
        return df
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = (_long_counts(df, columns, by) if counts is None else counts).filter(F.col("v").isNotNull())
    group = F.col("idx") if by is None else F.col("by").cast("bigint") * len(columns) + F.col("idx")
    said = (lambda v: v) if by is None else (lambda v: F.concat(F.col("by").cast("string"), F.lit(":"), v))
    ranks = dense_ranks(counts.withColumn("_group", group), "_group", "v")  # keeps n: the count of every value
    ranks = ranks.select("idx", _digest(said(F.col("v"))).alias("_d"), F.col("rank").cast("int").alias("_code"), "n")
    if distinct is None or rows is None:
        sizes = {r["idx"]: r for r in ranks.groupBy("idx").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
        distinct = {c: sizes[i]["k"] if i in sizes else 0 for i, c in enumerate(columns)}
        rows = max([r["n"] for r in sizes.values()], default=0)
    out = df
    key, code, first = fresh(df.columns, "_k", "_label", "_hot")
    for i, c in enumerate(columns):
        labels = ranks.filter(F.col("idx") == i).select(F.col("_d").alias(key), F.col("_code").alias(code), "n")
        value = F.col(q(c)).cast("string")
        out = out.withColumn(key, _digest(value if by is None else F.concat(F.col(q(by)).cast("string"), F.lit(":"), value)))
        if distinct.get(c, 0) <= broadcast_max:
            out = out.join(F.broadcast(labels.drop("n")), key, "left")
        else:
            hot = labels.filter(F.col("n") > max(1, rows // partitions))
            out = out.join(F.broadcast(hot.select(key, F.col(code).alias(first))), key, "left")
            alone = F.concat(F.lit(b"-"), F.unhex(F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))))  # 17 bytes
            out = out.withColumn(key, F.when(F.col(key).isNull() | F.col(first).isNotNull(), alone).otherwise(F.col(key)))
            out = out.join(labels.drop("n"), key, "left")
            out = out.withColumn(code, F.coalesce(first, code))
        out = out.withColumn(c, F.coalesce(F.col(code), F.lit(-1))).select(*[F.col(q(x)) for x in df.columns])
    return out


def encode_categoricals(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], str]:
    """O-75: returns the frame, the encoder-output columns and the log details."""
    if not columns:
        return df, [], detail("encode_none")
    plan = choose_encoding(df, columns)
    outputs: list[str] = []
    out, renamed = df, {}
    if plan.one_hot:
        out, names, renamed = one_hot(out, plan.one_hot)
        outputs.extend(names)
    if plan.label:
        out = label_encode(out, plan.label, plan.distinct, plan.rows)
        outputs.extend(plan.label)
    parts = []
    if plan.one_hot:
        parts.append(detail("encode_one_hot", list(plan.one_hot)))
    if plan.label:
        parts.append(detail("encode_label", plan.label))
    if renamed:
        parts.append(detail("encode_renamed", [f"{v} as {name}" for v, name in renamed.items()]))
    return out, outputs, ". ".join(parts)
