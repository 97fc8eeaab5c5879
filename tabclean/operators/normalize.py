"""O-10..O-13: blank, infinite and marker values become NULL; text is stripped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.functions import finite_or_null, normalized_text
from tabclean.operators.kinds import TEXT, is_fractional, kind_of, q


def normalize_raw(df: DataFrame) -> DataFrame:
    """One projection: no shuffle, stays inside whole-stage codegen."""
    cols = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if kind_of(f.dataType) == TEXT:
            c = normalized_text(c.cast("string"))
        elif is_fractional(f.dataType):
            c = finite_or_null(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)
