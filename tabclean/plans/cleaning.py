"""O-77..O-79, O-83: the auto and manual cleaning plans and their step log.

Each data-dependent decision is one fit (an aggregate job whose small result
comes back to the driver); everything else is a lazy select / filter / drop.
The frame is persisted after each de-duplication (the shuffle later fits
would otherwise recompute); persisted data is recomputed from a deterministic
lineage if an executor is lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabclean.operators.dedupe import repeated, without_copies
from tabclean.operators.encode import encode_categoricals
from tabclean.operators.fit import count_by_column, fit
from tabclean.operators.impute import missing_cleanup
from tabclean.operators.kinds import NUMERIC, TEXT, columns_of, q
from tabclean.operators.normalize import normalize_raw
from tabclean.operators.outliers import remove_outliers
from tabclean.operators.profile import profile
from tabclean.operators.rows import (apply_filters, auto_drop_candidates, drop_columns,
                                     drop_empty_rows, drop_sparse_rows, min_non_missing)
from tabclean.operators.scale import scale_columns, scale_numeric
from tabclean.operators.types import bool_to_int, coerce_numeric, convert_datetimes
from tabclean.plans.request import CleanRequest
from tabclean.plans.steps import detail

LOG_SCHEMA = "step_no int, name string, details string"


@dataclass
class CleanResult:
    df: DataFrame
    steps: list = field(default_factory=list)
    persisted: list = field(default_factory=list)
    lost: dict = field(default_factory=dict)  # step -> {column: values that did not convert and became missing}

    def log_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, n, d) for i, (n, d) in enumerate(self.steps)], LOG_SCHEMA)

    def lost_df(self, spark: SparkSession) -> DataFrame:
        """How many values each conversion could not read (they became missing)."""
        rows = [(step, c, n) for step, found in self.lost.items() for c, n in found.items()]
        return spark.createDataFrame(rows, "step string, column string, values bigint")

    def release(self) -> None:
        for d in self.persisted:
            d.unpersist()
        self.persisted.clear()


class _Run:
    """State of one cleaning run: the frame, its known row count and the log."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.rows: int | None = None
        self.steps: list = []
        self.persisted: list = []
        self.lost: dict = {}
        self.stats: tuple[DataFrame, dict] | None = None  # a frame and its counts; they hold while it is the run's frame

    def known(self) -> dict | None:
        return self.stats[1] if self.stats and self.stats[0] is self.df else None

    def log(self, name: str, details: str) -> None:
        self.steps.append((name, details))

    def count(self) -> int:
        if self.rows is None:
            self.rows = self.df.count()
        return self.rows

    def persist(self) -> None:
        """Keep the frame; the caller's next count fills it, then the copy before it goes."""
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        self.persisted.append(self.df)

    def release_earlier(self) -> None:
        while len(self.persisted) > 1:
            self.persisted.pop(0).unpersist()

    def set(self, df: DataFrame, rows: int | None = None) -> None:
        self.df, self.rows = df, rows

    # -- steps shared by both plans ---------------------------------------
    def coerce(self) -> None:
        conv = coerce_numeric(self.df)
        self.df = conv.df
        if conv.converted:
            self.lost["coerce_numeric_like_columns"] = conv.lost
            self.log("coerce_numeric_like_columns",
                     detail("coerce_numeric_like_columns", conv.converted))

    def dedupe(self, step_name: str) -> None:
        found = repeated(self.df)
        self.set(without_copies(self.df, found), found.rows - found.extra)
        self.persist()
        self.df.count()
        self.release_earlier()
        if found.extra:
            self.log(step_name, detail("remove_duplicates", n=found.extra))

    def fill(self, numeric: str, text: str, constant: str, prefix: str) -> None:
        res = missing_cleanup(self.df, numeric, text, constant, prefix, self.known())
        self.df, self.stats = res.df, (res.df, res.stats)
        self.steps.extend(res.steps)

    def convert_dates(self) -> None:
        conv, stats = convert_datetimes(self.df), self.known()
        self.df = conv.df
        if stats is not None:
            self.stats = conv.df, stats | {(c, "nn"): stats[(c, "nn")] - n for c, n in conv.lost.items()}
        if conv.converted:
            self.lost["convert_datetimes"] = conv.lost
            self.log("convert_datetimes", detail("convert_datetimes", conv.converted))


def auto_clean(run: _Run, keep: tuple[str, ...] = ()) -> None:
    """O-77: coerce -> drop ids / sparse columns (but ``keep``) -> dedupe -> fill -> dates -> fill -> dedupe."""
    run.coerce()
    prof = profile(run.df, "auto", light=True)
    run.rows = prof.rows
    candidates = auto_drop_candidates(prof, keep)
    if candidates:
        run.df = drop_columns(run.df, candidates)
        run.log("drop_columns", detail("drop_columns", candidates))
    run.dedupe("remove_duplicates")
    run.fill("median", "mode", "unknown", "auto")
    run.convert_dates()
    run.fill("median", "mode", "unknown", "post_datetime_auto")
    run.dedupe("remove_duplicates_final")


def manual_clean(run: _Run, request: CleanRequest) -> None:
    """O-78: the manual recipe, in the reference's order."""
    m = request.manual
    encoded_outputs: list[str] = []
    run.coerce()
    if m.drop_columns:
        run.df = drop_columns(run.df, list(m.drop_columns))
        run.log("drop_columns", detail("drop_columns", m.drop_columns))
    if m.remove_duplicates:
        run.dedupe("remove_duplicates")
    if m.drop_missing_rows_threshold is not None:
        before = run.count()
        run.set(drop_sparse_rows(run.df, float(m.drop_missing_rows_threshold)))
        run.log("drop_sparse_rows", detail("drop_sparse_rows", n=before - run.count()))
    numeric_columns = columns_of(run.df, NUMERIC)
    if m.fill_numeric_strategy != "none":
        run.fill(m.fill_numeric_strategy, "none", m.text_constant, "manual_numeric")
    if m.fill_text_strategy != "none":
        run.fill("none", m.fill_text_strategy, m.text_constant, "manual_text")
    if m.convert_datetimes:
        run.convert_dates()
        run.fill(m.fill_numeric_strategy, m.fill_text_strategy, m.text_constant, "post_datetime_manual")
    if m.filter_rules:
        before = run.count()
        run.set(apply_filters(run.df, list(m.filter_rules)))
        run.log("filter_rows", detail("filter_rows", n=before - run.count()))
    if m.remove_outliers and numeric_columns:
        before = run.count()
        run.set(remove_outliers(run.df, numeric_columns, float(m.outlier_zscore_threshold)))
        run.log("remove_outliers", detail("remove_outliers", n=before - run.count()))
    if m.encode_categoricals:
        cols = [c for c in columns_of(run.df, TEXT) if c != m.target_column]
        df, encoded_outputs, details = encode_categoricals(run.df, cols)
        run.df = df
        if details:
            run.log("encode_categoricals", details)
    if m.scale_numeric:
        cols = scale_columns(run.df, m.target_column, encoded_outputs)
        if cols:
            run.df = scale_numeric(run.df, cols)
            run.log("scale_numeric", detail("scale_numeric", cols))
    if m.remove_duplicates:
        run.dedupe("remove_duplicates_final")
    run.fill(m.fill_numeric_strategy, m.fill_text_strategy, m.text_constant, "residual_manual")


def finalize(run: _Run) -> None:
    """O-79: drop fully empty rows, then empty columns, then booleans to 0/1.

    One aggregate by column index gives each column's value count (none where the last fill left
    the counts of this frame); the rows that hold any value are counted only where every column has gaps. With no
    row left the schema is kept (D-10).
    """
    cols = run.df.columns
    if cols:
        stats = run.known()
        if stats is None or any((c, "nn") not in stats for c in cols):
            stats = count_by_column(run.df, cols, {})
        rows = nonempty = stats[("", "rows")]
        if all(stats[(c, "nn")] < rows for c in cols):  # a full column leaves no empty row
            marks = ", ".join(f"if({q(c)} is not null, 1, null)" for c in cols)
            nonempty = fit(run.df, {"n": F.expr(f"count(coalesce({marks}))")})["n"] if len(cols) > 1 else stats[(cols[0], "nn")]
        if nonempty != rows:
            run.set(drop_empty_rows(run.df), nonempty)
            run.log("drop_empty_rows", detail("drop_empty_rows", n=rows - nonempty))
        empty = [c for c in cols if stats[(c, "nn")] == 0] if nonempty > 0 else []
        if empty:
            run.df = run.df.drop(*empty)
            run.log("drop_empty_columns", detail("drop_empty_columns", empty))
    conv = bool_to_int(run.df)
    if conv.converted:
        run.df = conv.df
        run.log("normalize_boolean_columns", detail("normalize_boolean_columns", conv.converted))


def clean(df: DataFrame, request: CleanRequest | None = None) -> CleanResult:
    """Run a recipe on a DataFrame; returns the lazy cleaned frame and the log."""
    request = (request or CleanRequest()).validate()
    run = _Run(normalize_raw(df))
    if request.mode == "auto":
        auto_clean(run, tuple(request.keep_columns))
    else:
        manual_clean(run, request)
    finalize(run)
    return CleanResult(run.df, run.steps, run.persisted, run.lost)
