"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabclean.session import scratch_dir

ARROW_ROWS = 4000

_SHIPPED: dict[str, str] = {}

# Fixed: the six ASCII white-space characters of the contracts, as a Java / RE2 class.
SPACE = r"[\x20\x09-\x0D]+"

# Fixed: what any of the tokenizers may take for white space beside the ASCII ones.
WIDE_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{2581}\x{FEFF}"


def set_arrow_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and bytes, so long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(48 << 20))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tabclean-code-")) / "tabclean_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(str(target))
    _SHIPPED["app"] = sc.applicationId


def prepare(spark: SparkSession) -> None:
    """What every operator with Python tasks needs of the session."""
    set_arrow_batches(spark)
    ship_package(spark)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh folder beside the checkpoints and read it back.

    This cuts the lineage: the folder is shared, so a lost executor costs
    only its running tasks.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """As ``stored``, bucketed by ``key``: grouping by it later moves no row.

    The table's name is dropped from the catalog again; the plan that comes back keeps
    the files and their bucketing.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", scratch_dir(spark, label)).saveAsTable(name)
    table = spark.table(name)
    table.schema  # analysed while the name exists
    spark.sql(f"DROP TABLE {name}")
    return table


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def look_up(rows: DataFrame, table: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Left-join ``table`` (one row a key) to ``rows``, safe against hot keys.

    ``size`` counts the rows of ``rows`` with that key, so at most
    ``count(rows) / most`` keys exceed ``most``; those are broadcast. The
    others meet in a shuffled join in which no key has over ``most`` rows.
    """
    hot = table.filter(F.col(size) > most)
    cold = table.filter(F.col(size) <= most).withColumnRenamed(key, "_cold")
    values = [c for c in table.columns if c != key]
    out = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"_hot_{c}") for c in values])), key, "left")
    # A hot row needs no partner: a random negative slot keeps it off any shared null key.
    out = out.withColumn("_cold", F.when(F.col(f"_hot_{size}").isNull(), F.col(key)))
    met = out.filter(F.col("_cold").isNotNull()).join(cold, "_cold", "left")
    rest = out.filter(F.col("_cold").isNull())
    shape = rows.columns
    return (met.select(*shape, *values)
            .unionByName(rest.select(*shape, *[F.col(f"_hot_{c}").alias(c) for c in values])))


def hot_limit(rows: int, keys: int = 1000, least: int = 1000) -> int:
    """Rows a key may have before it is broadcast; at most ``keys`` keys have more."""
    return max(least, -(-rows // keys))


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray):
    """Concatenate ``values[starts[i]:starts[i]+lengths[i]]`` for i in ``index``; also the bounds."""
    n = lengths[index]
    bounds = np.zeros(len(index) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    at = np.repeat(starts[index] - bounds[:-1], n)
    at += np.arange(bounds[-1])
    return values[at], bounds


def split_on(texts: pa.Array, sep: str = " "):
    """Split every text on ``sep``: codes of all chunks, the distinct chunks, bounds by text."""
    parts = pc.split_pattern(texts, sep)
    return _coded(parts)


def ascii_words(texts: pa.Array):
    """Words between ASCII white space, in A-Z lower case: codes, distinct words, bounds by text."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SPACE)
    codes, words, bounds = _coded(parts)
    if "" not in words:
        return codes, words, bounds
    real = codes != words.index("")  # leading and trailing separators make empty chunks
    kept = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(real, out=kept[1:])
    return codes[real], words, kept[bounds]


def _coded(parts: pa.Array):
    bounds = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist(), bounds - bounds[0]


SLICE_ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows: arrays over tokens are many times their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def no_nulls(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def file_system(uri: str):
    """The Arrow file system of a folder that Spark names, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def running_totals(rows: DataFrame, order: str, weight: str, fan: int = 1024) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over all rows of smaller ``order`` (whole numbers from 0).

    Two levels, so that no task gets more than ``fan`` rows or one row a group.
    """
    g = (F.col(order) / F.lit(fan)).cast("bigint")
    inner = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    grouped = rows.withColumn("_g", g)
    groups = grouped.groupBy("_g").agg(F.sum(weight).alias("_w")).select("_g", F.coalesce(F.sum("_w").over(outer), F.lit(0)).alias("_before"))
    return (grouped.withColumn("_in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
            .join(groups, "_g").withColumn("before", F.col("_in") + F.col("_before")).drop("_g", "_in", "_before"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
