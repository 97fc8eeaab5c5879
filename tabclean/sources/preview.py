"""O-08, O-09: one page of rows in a stable order, and the page count.

A page near the start is a top-k sort. A deep page is located first: sampled keys cut
the order into ranges, one aggregate counts the rows of each, and only the range
that holds the page is read on, again and again until few rows are left. So neither
is the table sorted nor do page x size rows meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabclean.operators.kinds import DATETIME, OTHER, kind_of, q

PAGE_SIZE = 100
MOST_SORTED = 20_000  # rows that a task keeps for a page
_SAMPLE, _RANGES = 2000, 64
_ROUNDS = 8


def preview(df: DataFrame, order_by: list[str], page: int = 1, size: int = PAGE_SIZE, most: int = MOST_SORTED) -> DataFrame:
    """Rows ``(page-1)*size .. page*size`` by ``order_by`` (missing first)."""
    page = max(1, int(page))
    offset = (page - 1) * size
    if offset + size > most and all(kind_of(df.schema[c].dataType) != OTHER for c in order_by):
        df, before = _located(df, order_by, offset, size, most)
        offset -= before
    return df.orderBy(*[q(c) for c in order_by]).offset(offset).limit(size)


def _located(df: DataFrame, order_by: list[str], offset: int, size: int, most: int) -> tuple[DataFrame, int]:
    """The rows of a key range that holds the page, and how many rows come before it."""
    key = F.struct(*[F.col(q(c)) for c in order_by])
    kind = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(order_by)])
    here, before, rows = df, 0, df.count()
    for _ in range(_ROUNDS):
        if offset - before + size <= most or not rows:
            break
        sample = here.select(*[F.col(q(c)) for c in order_by])
        if rows > _SAMPLE:
            sample = sample.sample(fraction=min(1.0, 2 * _SAMPLE / rows), seed=7)
        cuts = _cuts(sample.limit(4 * _SAMPLE).distinct().orderBy(*[q(c) for c in order_by]).collect())
        if not cuts:
            break
        limits = [F.struct(*[F.lit(v).cast(f.dataType) for v, f in zip(cut, kind, strict=True)]) for cut in cuts]
        place = sum(((key > limit).cast("int") for limit in limits), F.lit(0))
        counts = {r["p"]: r["n"] for r in here.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        first = last = None
        start = end = before
        for p in range(len(limits) + 1):
            n = counts.get(p, 0)
            if first is None and end + n > offset:
                first, start = p, end
            end += n
            if first is not None and end >= offset + size:
                last = p
                break
        if first is None:  # the page lies beyond the last row
            return here.filter(F.lit(False)), offset
        last = len(limits) if last is None else last
        if first > 0:
            here = here.filter(key > limits[first - 1])
        if last < len(limits):
            here = here.filter(key <= limits[last])
        if end - start == rows:  # equal keys: no cut divides them
            break
        before, rows = start, end - start
    return here, before


def _cuts(rows: list) -> list[tuple]:
    """About ``_RANGES`` keys that divide the sampled ones evenly."""
    keys = [tuple(r) for r in rows]
    step = max(1, len(keys) // _RANGES)
    return keys[step - 1:-1:step] if len(keys) > 1 else []


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(df.count() / size))


def serialize(df: DataFrame) -> DataFrame:
    """O-09: timestamps become text (whole seconds, or with microseconds)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if kind_of(f.dataType) == DATETIME:
            ts = c.cast("timestamp")
            c = F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) \
                 .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        cols.append(c.alias(f.name))
    return df.select(*cols)
