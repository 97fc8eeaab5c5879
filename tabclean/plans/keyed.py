"""O-06 / O-82: one recipe over many files at once, each file cleaned as if alone.

All files of a batch stand in one frame with the number of their file in a key
column. A fit is one aggregate by (file, column) for the whole batch, so
a thousand files cost the jobs of one. What a fit finds goes two ways:

* **Values** (fills, means, spreads) become a table with a row a file, joined back by
  broadcast. Its size is checked: a batch has at most ``MOST_FITTED`` values
  (files x columns), beyond which the caller makes more batches.
* **Decisions** (types, dropped columns, dummy columns) change the schema. Files
  that decide alike go on together; the others go on as a frame of their
  own. Files of one origin decide alike, so that is one frame as a rule.

Steps, order and log texts are those of ``plans/cleaning``; ``tests/test_keyed.py`` holds
every file's rows and log against a run of that file alone.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.functions import to_number
from tabclean.operators.dedupe import deduplicate
from tabclean.operators.encode import choose_encoding_by, label_encode, one_hot
from tabclean.operators.fit import count_by_column, moments_by, no_counts
from tabclean.operators.impute import fill_gaps, medians_by, modes_by
from tabclean.operators.kinds import BOOLEAN, DATETIME, NUMERIC, OTHER, TEXT, columns_of, fresh, kind_of, q
from tabclean.operators.normalize import normalize_raw
from tabclean.operators.profile import AUTO_PROFILE_COUNTS, _profile_view, distinct_by, is_possible_id
from tabclean.operators.rows import (AUTO_DROP_MISSING, FilterRule, compares_layout, datetime_layouts_by, filter_condition,
                                     min_non_missing)
from tabclean.operators.types import (COERCE_COUNTS, DATE_COUNTS, bool_to_int, coerced, coercion_plan, dates_converted,
                                      dates_plan, infer_type)
from tabclean.plans.request import CleanRequest
from tabclean.plans.steps import detail

MOST_FITTED = 200_000  # values (files x columns) of a batch, which bounds every table that is broadcast


class KeyedRun:
    """Files that have decided alike so far: their frame, logs and row counts."""

    def __init__(self, df: DataFrame, key: str, files: list[int], kept: list[DataFrame] | None = None):
        self.df, self.key, self.files = df, key, list(files)
        self.steps: dict[int, list] = {f: [] for f in files}
        self.rows: dict[int, int] | None = None
        self.kept = [] if kept is None else kept  # persisted frames, shared by all runs of a batch

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.key]

    def of_kind(self, kind: str) -> list[str]:
        return [c for c in columns_of(self.df, kind) if c != self.key]

    def log(self, file: int, name: str, details: str) -> None:
        self.steps[file].append((name, details))

    def counts(self) -> dict[int, int]:
        if self.rows is None:
            found = {r[self.key]: int(r["count"]) for r in self.df.groupBy(q(self.key)).count().collect()}
            self.rows = {f: found.get(f, 0) for f in self.files}
        return self.rows

    def set(self, df: DataFrame) -> None:
        self.df, self.rows = df, None

    def persist(self) -> None:
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(self.df)

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def stats(self, columns: list[str], conditions: dict) -> dict[int, dict]:
        found = count_by_column(self.df, columns, conditions, by=self.key)
        return {f: found.get(f) or no_counts(columns, conditions) for f in self.files}

    def split(self, decisions: dict[int, Hashable]) -> list[tuple[KeyedRun, Hashable]]:
        """One run for each decision that any of the files has made."""
        groups: dict[Hashable, list[int]] = {}
        for f in self.files:
            groups.setdefault(decisions[f], []).append(f)
        if len(groups) == 1:
            return [(self, next(iter(groups)))]
        out = []
        for decision, files in groups.items():
            run = KeyedRun(self.df.filter(F.col(q(self.key)).isin(files)), self.key, files, self.kept)
            run.steps = {f: self.steps[f] for f in files}
            run.rows = None if self.rows is None else {f: self.rows[f] for f in files}
            out.append((run, decision))
        return out

    def with_values(self, values: dict[int, dict[str, object]], types: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
        """The frame with one more column for each name in ``types``: its file's value."""
        names = dict(zip(types, fresh(self.df.columns, *[f"_v{i}" for i in range(len(types))]), strict=True))
        rows = [(f, *[values.get(f, {}).get(n) for n in types]) for f in self.files]
        schema = ", ".join([f"{q(self.key)} int", *[f"{q(names[n])} {t}" for n, t in types.items()]])
        return self.df.join(F.broadcast(self.df.sparkSession.createDataFrame(rows, schema)), self.key, "left"), names

    def only(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select(*[F.col(q(c)) for c in [self.key, *columns]])


Step = Callable[[KeyedRun], list[KeyedRun]]


def coerce(run: KeyedRun) -> list[KeyedRun]:
    text, flags = run.of_kind(TEXT), run.of_kind(BOOLEAN)
    if not text + flags:
        return [run]
    stats = run.stats(text + flags, COERCE_COUNTS)
    out = []
    for part, plan in run.split({f: tuple(coercion_plan(stats[f], run.columns, text, flags).items()) for f in run.files}):
        if plan:
            part.df = coerced(part.df, dict(plan))
            for f in part.files:
                part.log(f, "coerce_numeric_like_columns", detail("coerce_numeric_like_columns", [n for n, _ in plan]))
        out.append(part)
    return out


def auto_drop(keep: tuple[str, ...]) -> Step:
    """O-51: ids and sparse columns of each file."""
    def step(run: KeyedRun) -> list[KeyedRun]:
        view = _profile_view(run.df)
        stats = count_by_column(view, run.columns, AUTO_PROFILE_COUNTS, by=run.key)
        distinct = distinct_by(view, run.key)
        types = {f.name: f.dataType for f in view.schema.fields}
        decisions = {}
        run.rows = {}
        for f in run.files:
            s = stats.get(f) or no_counts(run.columns, AUTO_PROFILE_COUNTS)
            rows = run.rows[f] = s[("", "rows")]
            drop = []
            for c in run.columns:
                kind, nn = kind_of(types[c]), s[(c, "nn")]
                inferred = infer_type(TEXT if kind == OTHER else kind, nn, s[(c, "dt")], s[(c, "num")])
                missing = round((rows - nn) / rows, 4) if rows else 0.0
                if c not in keep and (is_possible_id(distinct.get(f, {}).get(c, 0), rows, rows - nn, inferred) or missing >= AUTO_DROP_MISSING):
                    drop.append(c)
            decisions[f] = tuple(drop)
        out = []
        for part, drop in run.split(decisions):
            if drop:
                part.df = part.df.drop(*drop)
                for f in part.files:
                    part.log(f, "drop_columns", detail("drop_columns", drop))
            out.append(part)
        return out
    return step


def drop_named(names: list[str]) -> Step:
    def step(run: KeyedRun) -> list[KeyedRun]:
        run.df = run.df.drop(*[n for n in names if n in run.columns])
        for f in run.files:
            run.log(f, "drop_columns", detail("drop_columns", names))
        return [run]
    return step


def _counted(run: KeyedRun, df: DataFrame, name: str, text: str, always: bool = False) -> None:
    """Go on with ``df``; log the rows each file has lost (a loss of none only where ``always``)."""
    before = run.counts()
    run.set(df)
    after = run.counts()
    for f in run.files:
        if always or before[f] > after[f]:
            run.log(f, name, detail(text, n=before[f] - after[f]))


def dedupe(name: str) -> Step:
    def step(run: KeyedRun) -> list[KeyedRun]:
        if not run.columns:  # rows without a column are kept, as alone
            return [run]
        run.counts()
        before, run.rows = run.rows, None
        run.df = deduplicate(run.df)
        run.persist()
        after = run.counts()
        for f in run.files:
            if before[f] > after[f]:
                run.log(f, name, detail("remove_duplicates", n=before[f] - after[f]))
        return [run]
    return step


def sparse_rows(threshold: float) -> Step:
    def step(run: KeyedRun) -> list[KeyedRun]:
        k = min_non_missing(len(run.columns), threshold)
        df = run.df.na.drop(thresh=k, subset=[q(c) for c in run.columns]) if k > 0 else run.df
        _counted(run, df, "drop_sparse_rows", "drop_sparse_rows", always=True)
        return [run]
    return step


def fill(numeric: str, text: str, constant: str, prefix: str) -> Step:
    """O-70 for each file. Whole-number columns with gaps become doubles, which may split the run."""
    def step(run: KeyedRun) -> list[KeyedRun]:
        numbers, times, texts = run.of_kind(NUMERIC), run.of_kind(DATETIME), run.of_kind(TEXT)
        stats = run.stats(numbers + times + texts, {})
        whole = [c for c in numbers if run.df.schema[c].dataType.simpleString() != "double"] if numeric != "none" else []
        out = []
        for part, turned in run.split({f: tuple(c for c in whole if stats[f][(c, "nn")] < stats[f][("", "rows")]) for f in run.files}):
            part.rows = {f: stats[f][("", "rows")] for f in part.files}
            out.append(_filled(part, stats, numbers, times, texts, turned, numeric, text, constant, prefix))
        return out
    return step


def _filled(run, stats, numbers, times, texts, turned, numeric, text, constant, prefix) -> KeyedRun:
    gap = {f: {c for c in numbers + times + texts if stats[f][(c, "nn")] < stats[f][("", "rows")]} for f in run.files}
    some = [c for c in numbers + times + texts if any(c in gap[f] for f in run.files)]
    filled = [c for c in numbers if c in some] if numeric != "none" else []
    timed = [c for c in times if c in some]
    texted = [c for c in texts if c in some] if text != "none" else []
    medians = medians_by(run.df, filled, run.key) if numeric == "median" and filled else {}
    means = moments_by(run.df, run.key, {c: F.col(q(c)) for c in filled}) if numeric == "mean" else {}
    by_mode = texted if text == "mode" else []
    modes = modes_by(run.df, by_mode, timed, run.key) if by_mode or timed else {}
    values: dict[int, dict] = {}
    for f in run.files:
        mine: dict = {}
        own = [c for c in filled if c in gap[f]]
        for c in own:
            v = medians.get(f, {}).get(c) if numeric == "median" else means.get(f, {}).get(c, (0, None, None))[1] if numeric == "mean" else 0.0
            mine[c] = None if v is None else float(v)
        if own:
            run.log(f, prefix + "_numeric", detail("fill_numeric", own, strategy=numeric))
        own = [c for c in timed if c in gap[f] and modes.get(f, {}).get(c) is not None]
        mine |= {c: modes[f][c] for c in own}
        if own:
            run.log(f, prefix + "_datetime", detail("fill_datetime", own))
        own = [c for c in texted if c in gap[f]]
        for c in own:
            v = constant if text == "constant" else modes.get(f, {}).get(c)
            mine[c] = constant if v is None else v
        if own:
            run.log(f, prefix + "_text", detail("fill_text", own, strategy=text))
        values[f] = mine
    cast = [c for c in filled if c in turned or run.df.schema[c].dataType.simpleString() == "double"]
    types = {c: "double" for c in cast} | {c: "timestamp_ntz" for c in timed} | {c: "string" for c in texted}
    if types:
        columns = run.columns
        df, names = run.with_values(values, types)
        run.df = run.only(fill_gaps(df, names, set(cast)), columns)
    return run


def convert_dates(run: KeyedRun) -> list[KeyedRun]:
    text = run.of_kind(TEXT)
    if not text:
        return [run]
    stats = run.stats(text, DATE_COUNTS)
    out = []
    for part, names in run.split({f: tuple(dates_plan(stats[f], text)) for f in run.files}):
        if names:
            part.df = dates_converted(part.df, list(names))
            for f in part.files:
                part.log(f, "convert_datetimes", detail("convert_datetimes", names))
        out.append(part)
    return out


def filter_rows(rules: list[FilterRule]) -> Step:
    """O-60. A rule that compares a datetime as text takes the layout of each file's rows left so far."""
    def apply(run: KeyedRun, left: list[FilterRule]) -> list[KeyedRun]:
        for i, rule in enumerate(left):
            if rule.is_empty() or rule.column not in run.columns:
                continue
            rule.validate()
            if compares_layout(run.df, rule):
                layouts = datetime_layouts_by(run.df, rule.column, run.key)
                parts = run.split({f: layouts.get(f, (True, False)) for f in run.files})
                out = []
                for part, layout in parts:
                    part.df = part.df.filter(filter_condition(part.df, rule, layout))
                    out += apply(part, left[i + 1:])
                return out
            run.df = run.df.filter(filter_condition(run.df, rule))
        return [run]

    def step(run: KeyedRun) -> list[KeyedRun]:
        before = dict(run.counts())
        parts = apply(run, rules)
        for part in parts:
            part.rows = None
            after = part.counts()
            for f in part.files:
                part.log(f, "filter_rows", detail("filter_rows", n=before[f] - after[f]))
        return parts
    return step


def _number(run: KeyedRun, name: str):
    c = F.col(q(name))
    return to_number(c) if kind_of(run.df.schema[name].dataType) == TEXT else c.cast("double")


def _with_moments(run: KeyedRun, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    found = moments_by(run.df, run.key, {c: _number(run, c) for c in names})
    values = {f: {(c, k): found.get(f, {}).get(c, (0, None, None))[1 + k] for c in names for k in (0, 1)} for f in run.files}
    return run.with_values(values, {(c, k): "double" for c in names for k in (0, 1)})


def remove_outliers(names: list[str], threshold: float) -> Step:
    def step(run: KeyedRun) -> list[KeyedRun]:
        columns, given = run.columns, [c for c in names if c in run.columns]
        if not names:
            return [run]
        run.counts()
        if not given:
            _counted(run, run.df, "remove_outliers", "remove_outliers", always=True)
            return [run]
        df, at = _with_moments(run, given)
        near = []
        for c in given:
            mean, std = F.col(at[(c, 0)]), F.nullif(F.col(at[(c, 1)]), F.lit(0.0))
            z = F.abs((_number(run, c) - mean) / std)
            near.append(z.isNull() | (z <= F.lit(float(threshold))))
        keep = near[0] if len(near) == 1 else F.least(*near)
        _counted(run, run.only(df.filter(keep), columns), "remove_outliers", "remove_outliers", always=True)
        return [run]
    return step


def encode(target: str | None, outputs: dict[int, list[str]]) -> Step:
    """O-75; ``outputs`` gets each file's encoder-output columns."""
    def step(run: KeyedRun) -> list[KeyedRun]:
        columns = [c for c in run.of_kind(TEXT) if c != target]
        if not columns:
            for f in run.files:
                run.log(f, "encode_categoricals", detail("encode_none"))
            return [run]
        plans = choose_encoding_by(run.df, columns, run.key)
        # A file without rows has no values: every column has none, hence one-hot with no dummy column.
        chosen = {f: (tuple((c, tuple(v)) for c, v in plans[f].one_hot.items()), tuple(plans[f].label)) if f in plans
                  else (tuple((c, ()) for c in columns), ()) for f in run.files}
        out = []
        for part, (hot, label) in run.split(chosen):
            parts, names, renamed = [], [], {}
            if hot:
                part.df, names, renamed = one_hot(part.df, {c: list(v) for c, v in hot})
                parts.append(detail("encode_one_hot", [c for c, _ in hot]))
            if label:
                part.df = label_encode(part.df, list(label), {c: sum(plans[f].distinct[c] for f in part.files if f in plans) for c in label},
                                       sum(plans[f].rows for f in part.files if f in plans), by=part.key)
                parts.append(detail("encode_label", label))
            if renamed:
                parts.append(detail("encode_renamed", [f"{v} as {name}" for v, name in renamed.items()]))
            for f in part.files:
                part.log(f, "encode_categoricals", ". ".join(parts))
                outputs[f] = [*names, *label]
            out.append(part)
        return out
    return step


def scale(target: str | None, outputs: dict[int, list[str]]) -> Step:
    def step(run: KeyedRun) -> list[KeyedRun]:
        out = []
        for part, made in run.split({f: tuple(outputs.get(f, ())) for f in run.files}):
            names = [c for c in part.of_kind(NUMERIC) if c != target and c not in made]
            if names:
                columns = part.columns
                df, at = _with_moments(part, names)
                scaled = {c: F.coalesce((F.col(q(c)).cast("double") - F.col(at[(c, 0)])) / F.coalesce(F.nullif(F.col(at[(c, 1)]), F.lit(0.0)), F.lit(1.0)),
                                        F.col(q(c)).cast("double")) for c in names}
                part.df = part.only(df.withColumns(scaled), columns)
                for f in part.files:
                    part.log(f, "scale_numeric", detail("scale_numeric", names))
            out.append(part)
        return out
    return step


def finalize(run: KeyedRun) -> list[KeyedRun]:
    """O-79 for each file; a file without rows keeps its columns (D-10)."""
    columns = run.columns
    out = [run]
    if columns:
        stats = run.stats(columns, {})
        rows = {f: stats[f][("", "rows")] for f in run.files}
        filled = dict(rows)
        if doubtful := [f for f in run.files if rows[f] and all(stats[f][(c, "nn")] < rows[f] for c in columns)]:
            marks = ", ".join(f"if({q(c)} is not null, 1, null)" for c in columns)
            found = {r[0]: r[1] for r in run.df.filter(F.col(q(run.key)).isin(doubtful)).groupBy(q(run.key)).agg(F.expr(f"count(coalesce({marks}))")).collect()}
            filled |= {f: int(found.get(f, 0)) for f in doubtful}
        for f in run.files:
            if filled[f] != rows[f]:
                run.log(f, "drop_empty_rows", detail("drop_empty_rows", n=rows[f] - filled[f]))
        if filled != rows:
            run.df = run.df.na.drop(how="all", subset=[q(c) for c in columns])
        run.rows = filled
        out = []
        for part, empty in run.split({f: tuple(c for c in columns if stats[f][(c, "nn")] == 0) if filled[f] else () for f in run.files}):
            if empty:
                part.df = part.df.drop(*empty)
                for f in part.files:
                    part.log(f, "drop_empty_columns", detail("drop_empty_columns", empty))
            out.append(part)
    for part in out:
        conv = bool_to_int(part.df)
        if conv.converted:
            part.df = conv.df
            for f in part.files:
                part.log(f, "normalize_boolean_columns", detail("normalize_boolean_columns", conv.converted))
    return out


def _auto(keep: tuple[str, ...]) -> list[Step]:
    return [coerce, auto_drop(keep), dedupe("remove_duplicates"), fill("median", "mode", "unknown", "auto"), convert_dates,
            fill("median", "mode", "unknown", "post_datetime_auto"), dedupe("remove_duplicates_final")]


def _manual(request: CleanRequest) -> list[Step]:
    m = request.manual
    outputs: dict[int, list[str]] = {}
    numbers: dict[tuple, list[str]] = {}
    strategies = (m.fill_numeric_strategy, m.fill_text_strategy, m.text_constant)

    def note_numbers(run: KeyedRun) -> list[KeyedRun]:
        for f in run.files:  # the columns judged for outliers are those that are numbers before any fill
            numbers[f] = run.of_kind(NUMERIC)
        return [run]

    def outliers(run: KeyedRun) -> list[KeyedRun]:
        out = []
        for part, names in run.split({f: tuple(numbers[f]) for f in run.files}):
            out += remove_outliers(list(names), float(m.outlier_zscore_threshold))(part)
        return out

    steps: list[Step] = [coerce]
    if m.drop_columns:
        steps.append(drop_named(list(m.drop_columns)))
    if m.remove_duplicates:
        steps.append(dedupe("remove_duplicates"))
    if m.drop_missing_rows_threshold is not None:
        steps.append(sparse_rows(float(m.drop_missing_rows_threshold)))
    steps.append(note_numbers)
    if m.fill_numeric_strategy != "none":
        steps.append(fill(m.fill_numeric_strategy, "none", m.text_constant, "manual_numeric"))
    if m.fill_text_strategy != "none":
        steps.append(fill("none", m.fill_text_strategy, m.text_constant, "manual_text"))
    if m.convert_datetimes:
        steps += [convert_dates, fill(*strategies, "post_datetime_manual")]
    if m.filter_rules:
        steps.append(filter_rows(list(m.filter_rules)))
    if m.remove_outliers:
        steps.append(outliers)
    if m.encode_categoricals:
        steps.append(encode(m.target_column, outputs))
    if m.scale_numeric:
        steps.append(scale(m.target_column, outputs))
    if m.remove_duplicates:
        steps.append(dedupe("remove_duplicates_final"))
    return [*steps, fill(*strategies, "residual_manual")]


def clean_keyed(runs: list[KeyedRun], request: CleanRequest) -> list[KeyedRun]:
    """Run a recipe on all files; returns the runs in which they end, each with one schema."""
    request = request.validate()
    steps = _auto(tuple(request.keep_columns)) if request.mode == "auto" else _manual(request)
    for run in runs:
        run.df = normalize_raw(run.df)
    for step in [*steps, finalize]:
        runs = [part for run in runs for part in step(run)]
    return runs
