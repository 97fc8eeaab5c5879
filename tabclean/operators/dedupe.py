"""O-63: whole-row de-duplication (NULL equals NULL) by a candidate set.

Equal rows have equal digests. Digests of 16 bytes are counted first, so a
table without copies shuffles digests and no row. Where some repeat, only
the rows that have a repeated digest move whole and are compared in full; the
others pass straight through. More repeated digests than may be broadcast
(``MOST_REPEATED``) let all rows take the whole-row shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabclean.operators.kinds import fresh, q

MOST_REPEATED = 500_000  # digests of 16 bytes


@dataclass
class Repeated:
    rows: int
    extra: int                      # rows beyond the first of each identical row
    digests: DataFrame | None       # the repeated ones; None if there is none or too many


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    return isinstance(data_type, T.MapType)


def _comparable(df: DataFrame) -> list:
    """Every column in a form that Spark can compare and hash; maps as JSON with sorted keys."""
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, T.MapType):
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if not _holds_map(f.dataType.valueType) else F.to_json(c)
        elif _holds_map(f.dataType) or isinstance(f.dataType, T.VariantType):
            c = F.to_json(c)
        out.append(c)
    return out


def _digest(columns: list) -> list:
    """Two 64-bit hashes of a row; missing values count by their place."""
    gaps = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns]) if len(columns) < 500 else \
        F.array_join(F.transform(F.array(*[c.isNull() for c in columns]), lambda x: x.cast("string")), "")
    return [F.xxhash64(gaps, *columns), F.xxhash64(F.lit(7), gaps, *columns)]


def repeated(df: DataFrame) -> Repeated:
    """Count rows and copies, and find the digests that repeat: one shuffle of 16 bytes a distinct row."""
    if not df.columns:
        return Repeated(df.count(), 0, None)
    a, b = _digest(_comparable(df))
    counts = df.select(a.alias("_a"), b.alias("_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    many = F.col("_n") > 1
    got = counts.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("extra"), F.count_if(many).alias("repeated")).first()
    extra = int(got["extra"] or 0)
    return Repeated(int(got["rows"] or 0), extra, counts.filter(many).select("_a", "_b") if 0 < got["repeated"] <= MOST_REPEATED else None)


def without_copies(df: DataFrame, found: Repeated) -> DataFrame:
    if not found.extra:
        return df
    columns = df.columns
    whole = [c for c, f in zip(_comparable(df), df.schema.fields, strict=True) if _holds_map(f.dataType) or isinstance(f.dataType, T.VariantType)]
    keys = fresh(columns, *[f"_m{i}" for i in range(len(whole))])
    plain = [c for c, f in zip(columns, df.schema.fields, strict=True) if not (_holds_map(f.dataType) or isinstance(f.dataType, T.VariantType))]

    def distinct(rows: DataFrame) -> DataFrame:
        if not whole:
            return rows.dropDuplicates()
        return rows.withColumns(dict(zip(keys, whole, strict=True))).dropDuplicates([*plain, *keys]).select(*[F.col(q(c)) for c in columns])

    if found.digests is None:
        return distinct(df)
    a, b, flag = fresh(columns, "_a", "_b", "_again")
    one, two = _digest(_comparable(df))
    marks = found.digests.toDF(a, b).withColumn(flag, F.lit(True))
    marked = df.withColumns({a: one, b: two}).join(F.broadcast(marks), [a, b], "left")
    alone = marked.filter(F.col(flag).isNull()).select(*[F.col(q(c)) for c in columns])
    return alone.unionByName(distinct(marked.filter(F.col(flag)).select(*[F.col(q(c)) for c in columns])))


def deduplicate(df: DataFrame) -> DataFrame:
    """The rows without their copies (the digests are counted at once, in one job)."""
    return without_copies(df, repeated(df)) if df.columns else df
