"""O-01..O-07: CSV files in and out.

* ``source_manifest`` lists files (path, name, size, time) from file-system
  metadata, without reading content, with the reason a file is not accepted.
* ``detect_encodings`` reads every file as lines, in parallel, and decides per
  file: valid UTF-8 -> utf-8; else bytes undefined in cp1252 -> latin1;
  else cp1252 (the order utf-8, utf-8-sig, cp1252, latin1 of the reference).
* ``read_csv`` reads one source (a file or a folder of parts, matched by
  header names): all values as text, the CSV missing markers as NULL, trimmed header names,
  then the column types a pandas CSV reader would give (one aggregate).
* Large files are parsed in many tasks, quoted newlines included. The line scan that finds
  the encoding also tells whether every line closes its quotes. Such a file is **split**
  like any text file. Of the others, one that is a single split anyway is read **whole**; a longer one is read
  by **records**: the parity of quotes before each split (a prefix sum over the splits' parities) says whether
  it begins inside a value, lines are put together to records where they lie, and only the two ends of a split travel.
* ``write_csv`` writes a folder of part files with a header, no index, and
  numbers / timestamps printed as Python prints them.
"""

from __future__ import annotations

from collections.abc import Iterator
from csv import reader as csv_lines

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabclean.functions.numbers import INTEGER_PATTERN, NUMBER_PATTERN, UNSIGNED_64, finite_or_null, to_integer
from tabclean.functions.text import CSV_NULL_MARKERS, strip_text
from tabclean.functions.textform import double_text
from tabclean.operators.fit import count_by_column
from tabclean.operators.kinds import BOOLEAN, NUMERIC, is_fractional, kind_of, q
from tabclean.sources.preview import serialize
from tabclean.sources.tables import widen

SUPPORTED_SUFFIXES = (".csv", ".xlsx", ".xls")
READABLE_SUFFIXES = (".csv",)
# Fixed texts (reasons a file is not read).
REASON_SUFFIX = "Only CSV and Excel files are supported"
REASON_EXCEL = "Excel workbooks are not read by this engine"
REASON_EMPTY = "Uploaded file is empty"

# Bytes with no character in cp1252; a file holding one is read as latin1.
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
TRUE_TEXT = ("True", "TRUE", "true")
FALSE_TEXT = ("False", "FALSE", "false")


def _cp1252_translation() -> tuple[str, str]:
    """C1 characters (as latin1 decodes them) and their cp1252 characters."""
    src, dst = [], []
    for b in range(0x80, 0xA0):
        if b in CP1252_UNDEFINED:
            continue
        src.append(chr(b))
        dst.append(bytes([b]).decode("cp1252"))
    return "".join(src), "".join(dst)


CP1252_FROM, CP1252_TO = _cp1252_translation()


def _name_of(path_col):
    return F.element_at(F.split(path_col, "/"), -1)


def list_files(spark: SparkSession, paths) -> DataFrame:
    """``path, length, modificationTime`` of every file under ``paths``.

    Metadata only: Spark's own file index lists the folders (on the executors,
    where there are many), and its listing comes over as one text that is cut into rows
    by Spark, so no file costs a call or a step of Python. A file scan would skip empty
    files; the index has them. Hidden files (``.x``, ``_x``) are left out, as Spark's readers do.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    listing = found._jdf.queryExecution().analyzed().relation().location().allFiles().mkString("\0")
    each = spark.createDataFrame([(listing,)], "listing string").select(F.explode(F.split("listing", "\0")).alias("file")).filter("file <> ''")
    # Fixed: the text form of a file's status.
    form = r"(?s)path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+)"
    part = lambda i: F.regexp_extract("file", form, i)
    return each.select(part(1).alias("path"), part(2).cast("bigint").alias("length"), F.timestamp_millis(part(3).cast("bigint")).alias("modificationTime"))


def source_manifest(spark: SparkSession, paths) -> DataFrame:
    """O-03: ``path, name, length, modificationTime, suffix, accepted, reason``."""
    files = list_files(spark, paths)
    name = _name_of(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    reason = (F.when(~suffix.isin(*SUPPORTED_SUFFIXES), F.lit(REASON_SUFFIX))
              .when(~suffix.isin(*READABLE_SUFFIXES), F.lit(REASON_EXCEL))
              .when(F.col("length") == 0, F.lit(REASON_EMPTY)))
    return files.select("path", name.alias("name"), "length", "modificationTime", suffix.alias("suffix"),
                        reason.isNull().alias("accepted"), reason.alias("reason"))


def dedupe_sources(manifest: DataFrame) -> DataFrame:
    """O-05: one file per (name, size, modification time); the first path wins."""
    keys = ["name", "length", "modificationTime"]
    first = manifest.groupBy(*keys).agg(F.min("path").alias("path"))
    return manifest.join(first, keys + ["path"], "left_semi")


# How a file is read: split at its lines, in one piece, or by records put together from lines.
SPLIT, WHOLE, RECORDS = "split", "whole", "records"
_QUOTED_FIELD = r'(?<=^|,)"(?:[^"]++|"")*+"(?=,|$)'


def _file_path() -> Column:
    """The file of a row as it is named (the metadata column has it with escapes)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _leaves_quote(line) -> Column:
    """Has the line a quote beside whole quoted fields (an open one, or one inside a bare field)?"""
    return line.contains('"') & F.regexp_replace(line, _QUOTED_FIELD, "").contains('"')


def _lines(spark: SparkSession, paths) -> DataFrame:
    """``value, path, block, row``: the lines of files; block and row give their order in a file."""
    return spark.read.text(paths).select(
        "value", _file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def scan_files(spark: SparkSession, paths) -> DataFrame:
    """``path, encoding, header, mode`` of every file, from one distributed line scan.

    ``header`` is the first line with content, as latin1 decodes it; NULL where
    that line leaves a quote open (a header over several lines).
    """
    raw = _lines(spark, paths).withColumn("at", F.struct("block", "row"))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    undefined = "[" + "".join(f"\\x{{{b:02X}}}" for b in CP1252_UNDEFINED) + "]"
    per_file = raw.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(latin.rlike(undefined)).alias("undefined"),
        F.min_by(latin, F.when(F.length("value") > 0, F.col("at"))).alias("header"),
        F.bool_or(_leaves_quote(F.col("value"))).alias("open"), F.max("block").alias("last"))
    enc = F.when(F.col("utf8"), F.lit("utf-8")).when(F.col("undefined"), F.lit("latin1")).otherwise(F.lit("cp1252"))
    quotes = F.length("header") - F.length(F.replace("header", F.lit('"'), F.lit("")))
    mode = F.when(~F.col("open"), F.lit(SPLIT)).when(F.col("last") == 0, F.lit(WHOLE)).otherwise(F.lit(RECORDS))
    return per_file.select("path", enc.alias("encoding"), F.when(quotes % 2 == 0, F.col("header")).alias("header"), mode.alias("mode"))


def detect_encodings(spark: SparkSession, paths) -> DataFrame:
    """O-02: ``path, encoding`` for every file."""
    return scan_files(spark, paths).select("path", "encoding")


# Columns of the reader itself: a field beyond the header, and the file of a row.
SURPLUS, FILE = "__surplus_field", "__source_file"
_PARSE = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def split_states(lines: DataFrame) -> DataFrame:
    """``path, block, inside``: whether each split of a file begins inside a quoted value (1) or not (0)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("path", "block").agg((F.sum(quotes) % 2).alias("odd"))  # a row a split
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parity.select("path", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order to records: (path, block, part, text). Part 0 is a whole record, 1 what a
    split holds before its first record, 2 the record it leaves open, 3 the header."""
    names = ["path", "block", "part", "text"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    at, held, inside, part, out = ("", -1), [], False, 0, []

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for value, path, block, state in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (path, block) != at:
                if held:
                    out.append((*at, 1 if part == 1 else 2, "\n".join(held)))
                at, held, inside = (path, block), [], bool(state)
                part = 1 if inside else 3 if block == 0 else 0
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                text = "\n".join(held)
                held = []
                if text:
                    out.append((path, block, part, text))
                    part = 0
        if out:
            yield made()
    if held:
        out.append((*at, 1 if part == 1 else 2, "\n".join(held)))
        yield made()


def _records(spark: SparkSession, paths, encoding: str) -> DataFrame:
    """``path, record``: the records of files whose values hold newlines, without the headers."""
    lines = _lines(spark, paths)
    text = F.col("value") if encoding.startswith("utf") else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    # A broadcast join keeps the order in which a scan gives its rows; the table has a row a split.
    read = lines.join(F.broadcast(split_states(lines)), ["path", "block"], "left").select(text.alias("value"), "path", "block", "inside")
    parts = read.mapInArrow(assemble, "path string, block bigint, part int, text string")
    so_far = Window.partitionBy("path").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (parts.filter("part in (1, 2)").withColumn("record", F.sum((F.col("part") == 2).cast("int")).over(so_far))
            .groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("of"))
            .select("path", F.expr("array_join(transform(of, x -> x.text), '\n')").alias("text")))
    return parts.filter("part = 0").select("path", "text").unionByName(ends)


def _parsed_records(spark: SparkSession, paths, encoding: str, names: list[str]) -> DataFrame | None:
    """All values as text and the file; None where a quote stands inside a bare field, which parity cannot follow."""
    records = _records(spark, paths, encoding)
    if not records.filter(_leaves_quote(F.col("text"))).isEmpty():
        return None
    parsed = records.select(F.from_csv("text", ", ".join(f"{q(n)} string" for n in names), _PARSE).alias("r"), F.col("path").alias(FILE))
    return parsed.select(*[F.col(f"r.{q(n)}").alias(n) for n in names], FILE)


def read_text_columns(spark: SparkSession, paths, encoding: str, mode: str = WHOLE) -> DataFrame:
    """Files of one encoding and one header, all values as text, plus surplus field and file.

    A row with fewer fields than the header gets NULLs, as in the reference's
    reader; a row with more has a value in the surplus field (an empty one
    there loses nothing and is ignored).
    """
    java_enc = "UTF-8" if encoding.startswith("utf") else "ISO-8859-1"
    reader = (spark.read.option("header", True).option("multiLine", mode != SPLIT).option("inferSchema", False)
              .option("encoding", java_enc).options(**_PARSE))
    names = reader.csv(paths[0] if isinstance(paths, list) else paths).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    df = _parsed_records(spark, paths, encoding, schema.names) if mode == RECORDS else None
    if df is None:
        df = reader.schema(schema).option("enforceSchema", True).csv(paths).withColumn(FILE, _file_path())
    if encoding == "cp1252":
        table = str.maketrans(CP1252_FROM, CP1252_TO)
        return df.select(*[F.translate(F.col(q(c)), CP1252_FROM, CP1252_TO).alias(c.translate(table)) for c in df.columns if c != FILE], FILE)
    return df


def surplus_text(path: str, row: str) -> str:
    return f"{path}: a row has more fields than the header: {row[:200]}"


def _refuse_surplus(df: DataFrame) -> None:
    """Raise for the first file in which a row has more fields than the header, with the row."""
    row = F.concat_ws(",", *[F.col(q(c)) for c in df.columns if c != FILE])
    first = df.filter(F.col(SURPLUS).isNotNull()).groupBy(FILE).agg(F.min(row).alias("row")).orderBy(FILE).first()
    if first:
        raise ValueError(surplus_text(first[FILE], first["row"]))


def trim_header(df: DataFrame) -> DataFrame:
    """O-04: strip column names; names equal after stripping are an error."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column names after trimming: {names}")
    return df.toDF(*names)


def refuse_repeated_names(header: str) -> None:
    """Raise where the raw header line names a column twice (Spark would number both and say nothing)."""
    names = [n.strip() for n in next(csv_lines([header.removeprefix("\xef\xbb\xbf")]), [])]
    repeated = sorted({n for n in names if n and names.count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate column names in the header: {repeated}")


def csv_markers_to_null(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Cells equal to a CSV missing marker (exact case) or empty become NULL (in ``names``, or everywhere)."""
    return df.select(*[F.when(F.col(q(c)).isin(*CSV_NULL_MARKERS), F.lit(None).cast("string"))
                       .otherwise(F.col(q(c))).alias(c) if names is None or c in names else F.col(q(c)) for c in df.columns])


def infer_csv_types(df: DataFrame) -> DataFrame:
    """Types a pandas CSV reader gives: every value an integer -> bigint or, for
    unsigned 64-bit numbers, decimal(20,0) (double with gaps; text beyond 64
    bits), every value a number -> double, every value True/False -> boolean,
    else text. One aggregate for all columns."""
    if not df.columns:
        return df
    return csv_typed(df, csv_type_plan(count_by_column(df, df.columns, CSV_COUNTS), df.columns))


CSV_COUNTS = {
    "int": lambda v: to_integer(v, "bigint").isNotNull(),
    "u64": lambda v: to_integer(v, UNSIGNED_64).between(0, F.lit(str(2**64 - 1)).cast(UNSIGNED_64)),
    "digits": lambda v: strip_text(v).rlike(INTEGER_PATTERN),
    "num": lambda v: strip_text(v).rlike(NUMBER_PATTERN),
    "bool": lambda v: v.isin(*TRUE_TEXT, *FALSE_TEXT)}


def csv_type_plan(stats: dict, columns: list[str]) -> dict[str, str]:
    """The columns that do not stay text, and their types."""
    rows, plan = stats[("", "rows")], {}
    for c in columns:
        nn = stats[(c, "nn")]
        if not nn:
            continue
        full = nn == rows
        if full and stats[(c, "int")] == nn:
            plan[c] = "bigint"
        elif full and stats[(c, "u64")] == nn:
            plan[c] = UNSIGNED_64
        elif full and stats[(c, "digits")] == nn:
            pass  # integers beyond 64 bits stay text, with all their digits
        elif stats[(c, "num")] == nn:
            plan[c] = "double"
        elif stats[(c, "bool")] == nn:
            plan[c] = "boolean"
    return plan


def csv_typed(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    def typed(c):
        v, kind = F.col(q(c)), plan.get(c)
        if kind == "boolean":
            return F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(v.isin(*TRUE_TEXT))
        if kind == "double":
            return finite_or_null(strip_text(v).try_cast("double"))
        return v if kind is None else strip_text(v).try_cast(kind)

    return df.select(*[typed(c).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, paths, encoding: str | None = None, infer_types: bool = True,
             multi_line: bool = True) -> DataFrame:
    """O-01 (+ O-02, O-04): one CSV source as a DataFrame.

    The files of a folder are read by header (and encoding) and matched by
    column name, so the order of the columns may differ between files. A row
    with more fields than its header is refused with its file.

    Quoted newlines stay inside a value; with ``multi_line`` off every line is a
    row whatever its quotes say.
    """
    groups: dict[tuple, list[str]] = {}
    for r in scan_files(spark, paths).collect():  # a row a file
        own = r["header"] if r["header"] is not None else r["path"]
        groups.setdefault((encoding or r["encoding"], own, r["mode"] if multi_line else SPLIT), []).append(r["path"])
    if not groups:
        raise ValueError("Uploaded file is empty")
    df = None
    for (enc, header, mode), files in sorted(groups.items()):
        refuse_repeated_names(header)
        part = read_text_columns(spark, sorted(files), enc, mode)
        part = trim_header(part.drop(SURPLUS, FILE)).columns, part
        part = part[1].toDF(*part[0], SURPLUS, FILE)
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    names = [c for c in df.columns if c not in (SURPLUS, FILE)]
    marked = csv_markers_to_null(widen(df.select(*[F.col(q(c)) for c in names], SURPLUS, FILE)), names)
    if not infer_types:
        _refuse_surplus(df)
        return marked.select(*[F.col(q(c)) for c in names])
    # The surplus field is counted with the values, so that no parse is spent on it alone.
    stats = count_by_column(marked, [*names, SURPLUS], CSV_COUNTS)
    if stats[(SURPLUS, "nn")]:
        _refuse_surplus(df)
    return csv_typed(marked.select(*[F.col(q(c)) for c in names]), csv_type_plan(stats, names))


def printable(df: DataFrame) -> DataFrame:
    """Numbers and timestamps as the reference prints them (for CSV output)."""
    df = serialize(df)
    cols = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if kind_of(f.dataType) == NUMERIC and is_fractional(f.dataType):
            c = F.when(c.isNotNull(), double_text(c))
        elif kind_of(f.dataType) == BOOLEAN:
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    """O-07: a folder of part files with a header row; no coalesce to one task.

    A frame with no column left (every column dropped) gives an empty folder.
    With ``by``, rows go to a folder for each value of that column (``by=value``), and only
    the folders of values that occur are replaced.
    """
    if not df.columns:
        df.sparkSession.createDataFrame([], "value string").write.mode(mode).text(path)
        return
    writer = printable(df).write.mode(mode)
    if by is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    (writer.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("nullValue", "").option("emptyValue", '""').csv(path))
