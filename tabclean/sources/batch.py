"""O-06: clean several files, each on its own (statistics never cross files).

The files of a batch are read and cleaned together (``plans/keyed``): one scan
finds encodings and headers, files of one encoding and header make one frame,
every fit is keyed by file, and one write deals the rows into a folder a file. A
thousand files so cost the jobs of one.

A file that cannot be cleaned is reported with the reason and the others go on: a
row with surplus fields names its file; if a frame fails as a whole, it is halved until
the file is found.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabclean.operators.fit import count_by_column, no_counts
from tabclean.operators.kinds import fresh, q
from tabclean.plans.keyed import MOST_FITTED, KeyedRun, clean_keyed
from tabclean.plans.request import CleanRequest
from tabclean.sources.csv import (CSV_COUNTS, FILE, REASON_EMPTY, SURPLUS, csv_markers_to_null, csv_type_plan, csv_typed, dedupe_sources, read_text_columns,
                                  refuse_repeated_names, scan_files, source_manifest, surplus_text, trim_header, write_csv)
from tabclean.sources.tables import widen

RESULT_SCHEMA = "path string, name string, accepted boolean, reason string, output string, steps int"
PARTITION = "source"  # the folder of a file's rows is source=<its output name>


def output_name(path: str) -> str:
    """A file's output: its name in plain characters, and a digest of its whole path (two folders may hold one name)."""
    name = re.sub(r"[^A-Za-z0-9._-]", "_", path.rstrip("/").rsplit("/", 1)[-1])
    return f"{name}-{hashlib.sha256(path.encode()).hexdigest()[:12]}"


def output_folder(out_dir: str, path: str) -> str:
    return f"{out_dir.rstrip('/')}/{PARTITION}={output_name(path)}"


def _as_given(found: list[str], given: list[str]) -> dict[str, str]:
    """The paths of a scan (with scheme) as they were given."""
    whole = {re.sub(r"^file:/+", "file:/", p): p for p in given}
    out = {}
    for path in found:
        plain = re.sub(r"^file:/+", "file:/", path)
        bare = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?/*", "/", plain)
        out[path] = whole.get(plain) or whole.get(bare) or path
    return out


def _frame(spark: SparkSession, paths: list[str], encoding: str, mode: str) -> tuple[DataFrame, str, str, list[str]]:
    """The files' rows as text with the number of their file; the names of that column, of the surplus field and of the data columns."""
    raw = read_text_columns(spark, paths, encoding, mode)
    names = trim_header(raw.drop(SURPLUS, FILE)).columns
    key, surplus, path = fresh(names, "_file_no", "_surplus", "_path")
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], f"{path} string, {key} int")  # a row a file
    df = raw.toDF(*names, surplus, path).join(F.broadcast(numbers), path)
    return df.select(key, *[F.col(q(c)) for c in names], surplus), key, surplus, names


def _clean_group(spark: SparkSession, files: dict[str, str], kind: tuple[str, str], request: CleanRequest, out_dir: str) -> dict[str, tuple]:
    """Clean files (path in a scan, path as given) of one header and kind (encoding and reading mode); ``{path: (reason, steps)}``."""
    df, key, surplus, names = _frame(spark, list(files), *kind)
    paths = list(files.values())
    row = F.concat_ws(",", *[F.col(q(c)) for c in [*names, surplus]])
    bad = {r[key]: r["row"] for r in df.filter(F.col(q(surplus)).isNotNull()).groupBy(q(key)).agg(F.min(row).alias("row")).collect()}
    done = {paths[i]: (surplus_text(paths[i], text), []) for i, text in bad.items()}
    good = [i for i in range(len(paths)) if i not in bad]
    if not good:
        return done
    df = df.drop(surplus)
    if bad:
        df = df.filter(F.col(q(key)).isin(good))
    df = widen(csv_markers_to_null(df, names))
    run = KeyedRun(df, key, good)
    found = count_by_column(df, names, CSV_COUNTS, by=key)
    runs = []
    for part, plan in run.split({f: tuple(csv_type_plan(found.get(f) or no_counts(names, CSV_COUNTS), names).items()) for f in good}):
        part.df = csv_typed(part.df, dict(plan))
        runs.append(part)
    try:
        for part in clean_keyed(runs, request):
            _write(part, paths, out_dir)
            done |= {paths[f]: (None, part.steps[f]) for f in part.files}
    finally:
        run.release()
    return done


def _write(run: KeyedRun, paths: list[str], out_dir: str) -> None:
    """One write of all files of a run; files left without rows get their header alone."""
    spark, rows = run.df.sparkSession, run.counts()
    full = [f for f in run.files if rows[f]] if run.columns else []
    if full:
        part = fresh(run.df.columns, PARTITION)[0]
        if part != PARTITION:  # the folder's name is fixed, so a column of that name makes one write a file
            for f in full:
                write_csv(run.df.filter(F.col(q(run.key)) == f).drop(run.key), output_folder(out_dir, paths[f]), mode="overwrite")
        else:
            names = spark.createDataFrame([(f, output_name(paths[f])) for f in run.files], f"{q(run.key)} int, {part} string")
            # A file's rows come together (a large file's are split again), so that not every task writes to every folder.
            rows_of = run.df.join(F.broadcast(names), run.key).drop(run.key).hint("rebalance", F.col(part))
            write_csv(rows_of, out_dir, mode="overwrite", by=part)
    for f in run.files:
        if f not in full:
            write_csv(spark.createDataFrame([], run.df.drop(run.key).schema).coalesce(1), output_folder(out_dir, paths[f]), mode="overwrite")


def _isolated(spark: SparkSession, files: dict[str, str], kind: tuple[str, str], request: CleanRequest, out_dir: str) -> dict[str, tuple]:
    try:
        return _clean_group(spark, files, kind, request, out_dir)
    except (ValueError, PySparkException) as e:
        each = list(files.items())
        if len(each) == 1:
            return {each[0][1]: (str(e)[:1000] or type(e).__name__, [])}
        halves = (dict(each[:len(each) // 2]), dict(each[len(each) // 2:]))
        return {p: v for half in halves for p, v in _isolated(spark, half, kind, request, out_dir).items()}


def clean_batch(spark: SparkSession, paths: list[str], request: CleanRequest, out_dir: str) -> dict[str, tuple]:
    """Clean CSV files together, each alone; ``{path: (reason or None, step log)}``.

    Rows go to ``<out_dir>/source=<output name>`` as CSV part files; a second
    run of a file replaces its folder only.
    """
    request = request.validate()
    if not paths:
        return {}
    scanned = scan_files(spark, list(paths)).collect()  # a row a file
    given = _as_given([r["path"] for r in scanned], paths)
    groups: dict[tuple, list[str]] = {}
    for r in scanned:
        own = r["header"] if r["header"] is not None else r["path"]
        groups.setdefault((r["encoding"], r["mode"], own), []).append(r["path"])
    done: dict[str, tuple] = {}
    for (*kind, header), files in sorted(groups.items()):
        try:
            refuse_repeated_names(header)
        except ValueError as e:
            done |= {given[p]: (str(e), []) for p in files}
            continue
        files, most = sorted(files), max(1, MOST_FITTED // (header.count(",") + 1))
        for at in range(0, len(files), most):
            done |= _isolated(spark, {p: given[p] for p in files[at:at + most]}, tuple(kind), request, out_dir)
    return {p: done.get(p, (REASON_EMPTY, [])) for p in paths}


def clean_files(spark: SparkSession, paths, request: CleanRequest, out_dir: str) -> DataFrame:
    """Clean each accepted, de-duplicated CSV file under ``paths``; one result row a file."""
    manifest = dedupe_sources(source_manifest(spark, paths)).orderBy("path").collect()
    done = clean_batch(spark, [f["path"] for f in manifest if f["accepted"]], request, out_dir)
    rows = []
    for f in manifest:
        reason, steps = done.get(f["path"], (f["reason"], []))
        output = None if reason else output_folder(out_dir, f["path"])
        rows.append((f["path"], f["name"], not reason, reason, output, len(steps)))
    return spark.createDataFrame(rows, RESULT_SCHEMA)
