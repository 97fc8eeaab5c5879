"""Run one aggregate job and hand back a small record to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def fit(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Evaluate named aggregate expressions in ONE job (map-side partial agg).

    The result is one row whose width is the number of expressions, which is
    bounded by the schema, never by the data.
    """
    if not exprs:
        return {}
    keys = list(exprs)
    aliases = [f"_f{i}" for i in range(len(keys))]
    row = df.agg(*[exprs[k].alias(a) for k, a in zip(keys, aliases)]).collect()[0]
    return {k: row[a] for k, a in zip(keys, aliases)}


WIDE = 64  # columns up to which one aggregate per column is planned; more go by index


def moments_by(df: DataFrame, by: str, numbers: dict[str, Column]) -> dict:
    """``{key: {name: (non-missing, mean, std)}}`` by the values of ``by``, in ONE job (one row a key and column out)."""
    from pyspark.sql import functions as F

    names = list(numbers)
    if not names:
        return {}
    structs = [F.struct(F.lit(i).alias("idx"), numbers[n].cast("double").alias("x")) for i, n in enumerate(names)]
    long = df.select(F.col(f"`{by}`").alias("by"), F.inline(F.array(*structs))).filter("x is not null")
    out: dict = {}
    for r in long.groupBy("by", "idx").agg(F.count("x").alias("nn"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).collect():
        out.setdefault(r["by"], {})[names[r["idx"]]] = (r["nn"], r["mean"], r["std"])
    return out


def moments(df: DataFrame, numbers: dict[str, Column], wide: int = WIDE) -> dict:
    """Count, mean and population std of named number expressions, in ONE job.

    Up to ``wide`` columns these are plain aggregates. Beyond, the values are
    unpivoted to ``(idx, x)`` and aggregated by index, so that the generated
    code does not grow with the schema; partial aggregation leaves one row per
    column and task. Both give the same results.

    Returns ``{name: (non-missing, mean, std)}``.
    """
    from pyspark.sql import functions as F

    names = list(numbers)
    if not names:
        return {}
    if len(names) <= wide:
        got = fit(df, {(n, k): f(numbers[n]) for n in names
                       for k, f in (("nn", F.count), ("mean", F.avg), ("std", F.stddev_pop))})
        return {n: (got[(n, "nn")], got[(n, "mean")], got[(n, "std")]) for n in names}
    structs = [F.struct(F.lit(i).alias("idx"), numbers[n].cast("double").alias("x")) for i, n in enumerate(names)]
    long = df.select(F.inline(F.array(*structs))).filter("x is not null")
    found = {r["idx"]: (r["nn"], r["mean"], r["std"]) for r in long.groupBy("idx").agg(
        F.count("x").alias("nn"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).collect()}
    return {n: found.get(i, (0, None, None)) for i, n in enumerate(names)}


def count_by_column(df: DataFrame, columns: list[str], conditions: dict, by: str | None = None) -> dict:
    """Per-column counts of rows meeting each condition, in ONE job.

    The columns are unpivoted to ``(idx, p, s)`` - ``p`` whether the value
    is present, ``s`` the value of a text column (NULL for other kinds) - and
    each condition (a function of ``s``) is counted by column index. The
    generated code is the same size for 3 or 3,000 columns, where a one-row
    aggregate with a parse per column and condition would grow with the
    schema. Partial aggregation leaves one row per column and task.

    Returns ``{(column, "nn"): non-missing, (column, name): count, ("", "rows"): rows}``; with
    ``by``, one such record for each value of that column (one row a key and column comes back).
    """
    from pyspark.sql import functions as F

    from tabclean.operators.kinds import TEXT, kind_of, q

    if not columns:
        return {("", "rows"): 0} if by is None else {}
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for i, c in enumerate(columns):  # as SQL text: one call to the JVM for all columns
        text = f"cast({q(c)} as string)" if kind_of(types[c]) == TEXT else "cast(null as string)"
        structs.append(f"struct({i} as idx, {q(c)} is not null as p, {text} as s)")
    key = [] if by is None else [f"{q(by)} as by"]
    long = df.selectExpr(*key, f"inline(array({', '.join(structs)}))")
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_if("p").alias("_nn")]
    aggs += [F.count_if(cond(F.col("s"))).alias(f"_c{k}") for k, cond in enumerate(conditions.values())]
    found: dict = {} if by is not None else {None: no_counts(columns, conditions)}
    for r in long.groupBy("idx", *(["by"] if by is not None else [])).agg(*aggs).collect():
        c = columns[r["idx"]]
        key = None if by is None else r["by"]
        if key not in found:
            found[key] = no_counts(columns, conditions)
        out = found[key]
        out[("", "rows")] = int(r["_rows"])
        out[(c, "nn")] = int(r["_nn"])
        for k, name in enumerate(conditions):
            out[(c, name)] = int(r[f"_c{k}"])
    return found[None] if by is None else found


def no_counts(columns: list[str], conditions: dict) -> dict:
    """The record of a table without rows."""
    return {("", "rows"): 0} | {(c, name): 0 for c in columns for name in ("nn", *conditions)}
