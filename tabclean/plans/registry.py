"""Named queries over the generated tables, one per operator group.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. Timestamps are
rendered as text and floats rounded, the same way as in the DuckDB oracle
(``tabclean.plans.oracle_sql``), so results compare by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabclean.operators.dedupe import deduplicate
from tabclean.operators.encode import encode_categoricals, label_encode
from tabclean.operators.impute import missing_cleanup
from tabclean.operators.kinds import DATETIME, is_fractional, kind_of, q
from tabclean.operators.normalize import normalize_raw
from tabclean.operators.outliers import remove_outliers
from tabclean.operators.profile import _profile_view, column_value_summary, profile
from tabclean.operators.rows import FilterRule, apply_filters, drop_empty_rows, drop_sparse_rows
from tabclean.operators.scale import scale_columns, scale_numeric
from tabclean.operators.types import bool_to_int, coerce_numeric, convert_datetimes, infer_types
from tabclean.plans.cleaning import _Run, clean, finalize
from tabclean.plans.request import CleanRequest, ManualOptions
from tabclean.plans.suggest import prompt_flags, request_of, suggest_plans
from tabclean.session import scratch_dir
from tabclean.sources.batch import clean_files
from tabclean.sources.csv import dedupe_sources, detect_encodings, read_csv, source_manifest, write_csv
from tabclean.sources.presets import list_presets, load_request, save_preset
from tabclean.sources.preview import page_count, preview
from tabclean.sources.tables import (BIG_ORDERS_SQL, BOOLEAN_ORDERS_SQL, DOTTED_PART_SQL, EXACT_ORDERS_SQL, ODD_NAMES_SQL, INF_EVENTS_SQL, NAMED_ORDERS_SQL,
                                     ODD_ORDERS_SQL, SKEWED_ORDERS_SQL, VARIANT_ORDERS_SQL, WIDE_DATES_SQL, WIDE_PART_SQL, dirty, register,
                                     spark_text, table, widen)

SIG_FORMAT = "%.9e"   # compared doubles keep 10 significant digits

# Options of the manual recipe checked against the oracle.
MANUAL_OPTIONS = ManualOptions(
    target_column="cust_txt", remove_duplicates=True, drop_missing_rows_threshold=0.5,
    fill_numeric_strategy="mean", fill_text_strategy="constant", text_constant="unknown",
    convert_datetimes=True, encode_categoricals=True, remove_outliers=True, outlier_zscore_threshold=3.0,
    scale_numeric=True, filter_rules=[FilterRule("price", "greater_than", "1000")])

FILTER_RULES = {
    "filter_eq": [FilterRule("prio", "equals", "1-URGENT")],
    "filter_eq_num": [FilterRule("cust_txt", "equals", "605")],
    "filter_ne": [FilterRule("cust_txt", "not_equals", "605")],
    "filter_ne_text": [FilterRule("prio", "not_equals", "2-HIGH")],
    "filter_gt": [FilterRule("price", "greater_than", "250000")],
    "filter_lt": [FilterRule("cust_txt", "less_than", "100")],
    "filter_contains": [FilterRule("prio", "contains", "URG|na")],
    "filter_contains_num": [FilterRule("price", "contains", r"\.5")],
    "filter_date": [FilterRule("odate", "equals", "1996-01-02")],
    "filter_date_gt": [FilterRule("odate", "greater_than", "1996-01-02T00:00:00"), FilterRule("odate", "less_than", "1997-06-30")],
    "filter_empty_rules": [FilterRule("prio", "equals", ""), FilterRule("", "equals", "x"),
                           FilterRule("price", "greater_than", " "), FilterRule("price", "less_than", "300000")],
    "filter_all": [FilterRule("prio", "contains", "HIGH|URG"), FilterRule("price", "greater_than", "1000"),
                   FilterRule("cust_txt", "not_equals", "605"), FilterRule("nope", "equals", "x")],
}

def sig(c):
    """A double to 9 decimals, then 10 significant digits (summation order does not show).

    One of at most two decimals and ten digits, as whole numbers and prices are, is that already: no text is made of it.
    """
    hundreds = F.rint(c * F.lit(100.0))
    short = (F.abs(hundreds) < F.lit(1e10)) & (hundreds / F.lit(100.0) == c)
    return F.when(short, c + F.lit(0.0)).when(c.isNotNull(), F.format_string(SIG_FORMAT, F.round(c, 9) + F.lit(0.0)).cast("double"))


def py_sig(v):
    return None if v is None else float(SIG_FORMAT % (round(v, 9) + 0.0))


RENDER = True  # bench.py turns it off, to time the operators and not the comparison's form


def render(df: DataFrame) -> DataFrame:
    """Timestamps as text, doubles to 10 significant digits: the form compared with the oracle."""
    if not RENDER:
        return df
    cols = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if kind_of(f.dataType) == DATETIME:
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif is_fractional(f.dataType):
            c = sig(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _orders_clean_input(spark, sf):
    """dirty_orders after normalisation and number coercion (the state filters and fills see)."""
    return coerce_numeric(normalize_raw(dirty(spark, sf, "dirty_orders"))).df


# -- normalise and types -------------------------------------------------------

def normalize_text(spark, sf):
    return render(normalize_raw(dirty(spark, sf, "dirty_orders")))


def infer_ratio(spark, sf):
    return infer_types(dirty(spark, sf, "dirty_orders"))


def coerce_numbers(spark, sf):
    return render(_orders_clean_input(spark, sf))


def coerce_bigint(spark, sf):
    """Integers beyond 2^53 and unsigned 64-bit ones keep their digits."""
    register(spark, sf, ("orders",))
    df = coerce_numeric(spark.sql(spark_text(BIG_ORDERS_SQL))).df
    return df.select("o_orderkey", F.col("big").cast("bigint").alias("big"), F.col("u64").cast("string").alias("u64"),
                     F.concat_ws(",", *[F.lit(t) for _, t in df.dtypes]).alias("types"))


def inf_to_null(spark, sf):
    register(spark, sf, ("events",))
    return render(normalize_raw(spark.sql(INF_EVENTS_SQL)))


def bool_to_int_orders(spark, sf):
    register(spark, sf, ("orders",))
    return bool_to_int(spark.sql("select o_orderkey, o_orderstatus = 'F' as done, o_totalprice > 100000 as large from orders")).df


def convert_dates_wide(spark, sf):
    """The spreadsheet layouts, month first unless the first number can only be a day."""
    register(spark, sf, ("orders",))
    return render(convert_datetimes(spark.sql(WIDE_DATES_SQL)).df)


def convert_dates(spark, sf):
    return render(convert_datetimes(normalize_raw(dirty(spark, sf, "dirty_dates"))).df)


# -- profile -------------------------------------------------------------------

def _profile_columns(spark, df, name):
    p = profile(df, name)
    rows = []
    for c in p.columns:
        s = c.numeric_summary or (None, None, None, None)
        rows.append((c.ordinal, c.name, c.inferred_type, c.missing_ratio, c.unique_ratio, c.duplicate_count,
                     c.possible_id, *[py_sig(v) for v in s], c.distribution_hint))
    return spark.createDataFrame(rows, "ordinal int, name string, inferred_type string, missing_ratio double, "
                                       "unique_ratio double, duplicate_count bigint, possible_id boolean, mean double, "
                                       "std double, min double, max double, distribution_hint string")


def profile_orders(spark, sf):
    return _profile_columns(spark, dirty(spark, sf, "dirty_orders"), "dirty_orders")


def profile_lineitem(spark, sf):
    return _profile_columns(spark, table(spark, sf, "lineitem"), "lineitem")


def profile_variant(spark, sf):
    """VARIANT columns: one that mixes kinds of value, and what is suggested for it."""
    register(spark, sf, ("orders",))
    p = profile(spark.sql(VARIANT_ORDERS_SQL).drop("o_orderkey"), "variant", light=True)
    advice = p.suggestions(None)
    rows = [(c.name, c.inferred_type, c.missing_ratio, c.unique_ratio, next((a for a in advice if f"'{c.name}'" in a or f" {c.name} " in f" {a} "), None)) for c in p.columns]
    return spark.createDataFrame(rows, "name string, inferred_type string, missing_ratio double, unique_ratio double, suggestion string")


def _top_values(df):
    view = _profile_view(df)
    _, tops = column_value_summary(view)
    rows = [(view.columns[i], k + 1, v, n) for i, found in tops.items() for k, (v, n) in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "name string, rank int, value string, count bigint")


def profile_documents(spark, sf):
    return _profile_columns(spark, table(spark, sf, "documents"), "documents")


def top_values_documents(spark, sf):
    return _top_values(table(spark, sf, "documents"))


def top_values_orders(spark, sf):
    return _top_values(dirty(spark, sf, "dirty_orders"))


def top_values_events(spark, sf):
    return _top_values(table(spark, sf, "events"))


def _summary(spark, df, name):
    p = profile(df, name)
    return spark.createDataFrame([p.summary_row()[1:8]],
                                 "rows bigint, columns bigint, missing_cells bigint, duplicate_rows bigint, "
                                 "numeric_columns bigint, categorical_columns bigint, datetime_columns bigint")


def summary_orders(spark, sf):
    return _summary(spark, dirty(spark, sf, "dirty_orders"), "dirty_orders")


def summary_customer(spark, sf):
    return _summary(spark, table(spark, sf, "customer"), "customer")


def target_candidates(spark, sf):
    p = profile(dirty(spark, sf, "dirty_orders"), "dirty_orders", light=True)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(p.target_candidates())], "position int, name string")


def suggestions(spark, sf):
    p = profile(table(spark, sf, "customer"), "customer", light=True)
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(p.suggestions())], "position int, suggestion string")


def alerts(spark, sf):
    p = profile(dirty(spark, sf, "dirty_orders"), "dirty_orders", light=True)
    return spark.createDataFrame([(c.name, a) for c in p.columns for a in c.smart_alerts], "name string, alert string")


# -- rows ----------------------------------------------------------------------

def drop_sparse(spark, sf):
    return render(drop_sparse_rows(dirty(spark, sf, "dirty_sparse"), 0.5))


def drop_empty(spark, sf):
    run = _Run(dirty(spark, sf, "dirty_sparse"))
    finalize(run)
    return render(run.df)


def _filter_query(name):
    def run(spark, sf):
        return render(apply_filters(_orders_clean_input(spark, sf), FILTER_RULES[name]))
    run.__name__ = name
    return run


def dedupe(spark, sf):
    return render(deduplicate(_orders_clean_input(spark, sf)))


# Two neighbours above 2^53, and bounds beyond any 64-bit number.
BIG_RULES = [FilterRule("big", "not_equals", "9007199254740993"), FilterRule("big", "less_than", "1e300"),
             FilterRule("u64", "greater_than", "18446744073709000001.5"), FilterRule("o_orderkey", "not_equals", "1e300")]


def filter_eq_big(spark, sf):
    """Integers beyond 2^53 and 64 bits are compared digit by digit."""
    register(spark, sf, ("orders",))
    df = coerce_numeric(spark.sql(spark_text(BIG_ORDERS_SQL))).df
    some = apply_filters(df, [FilterRule("big", "equals", "9007199254740994")]).unionByName(apply_filters(df, BIG_RULES))
    return some.select("o_orderkey", F.col("big").cast("bigint").alias("big"), F.col("u64").cast("string").alias("u64"))


def label_encode_names(spark, sf):
    """Columns called ``_k`` and ``_code``, one encoded and one carried."""
    register(spark, sf, ("orders",))
    df = spark.sql(spark_text(ODD_NAMES_SQL))
    return label_encode(label_encode(df, ["_k"], broadcast_max=0), ["cust"])


def dotted_names(spark, sf):
    """Sparse rows, empty rows and empty columns of a table whose names have dots."""
    register(spark, sf, ("part",))
    req = CleanRequest(mode="manual", manual=ManualOptions(
        remove_duplicates=True, drop_missing_rows_threshold=0.6, fill_numeric_strategy="zero", fill_text_strategy="constant", text_constant="none"))
    return render(clean(drop_empty_rows(spark.sql(spark_text(DOTTED_PART_SQL))), req).df)


# -- fills, outliers -----------------------------------------------------------

def _fill(numeric, text, constant="unknown"):
    def run(spark, sf):
        return render(missing_cleanup(_orders_clean_input(spark, sf), numeric, text, constant, "q").df)
    return run


def fill_median_odd(spark, sf):
    """An odd number of present values, whose median is one of them."""
    register(spark, sf, ("orders",))
    return render(missing_cleanup(spark.sql(ODD_ORDERS_SQL), "median", "none").df)


def fill_boolean(spark, sf):
    register(spark, sf, ("orders",))
    flags = coerce_numeric(spark.sql(BOOLEAN_ORDERS_SQL)).df
    return render(missing_cleanup(flags, "median", "mode").df)


def outliers(spark, sf):
    ev = table(spark, sf, "events")
    return render(remove_outliers(ev, ["event_id", "user_id", "value"], 3.0))


# -- encoding, scaling ---------------------------------------------------------

def one_hot(spark, sf):
    return render(encode_categoricals(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])[0])


def one_hot_source(spark, sf):
    return encode_categoricals(table(spark, sf, "documents"), ["lang", "source"])[0]


def one_hot_collision(spark, sf):
    """A dummy column whose name is taken."""
    df = table(spark, sf, "orders").withColumnRenamed("o_totalprice", "o_orderstatus_F")
    return render(encode_categoricals(df, ["o_orderstatus"])[0])


def label_encode_part(spark, sf):
    return render(encode_categoricals(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])[0])


def label_encode_text(spark, sf):
    return label_encode(table(spark, sf, "documents"), ["text"])


def label_encode_skewed(spark, sf):
    """Three text columns with missing values, one value in half of the rows; no label table is broadcast."""
    register(spark, sf, ("orders",))
    return label_encode(spark.sql(spark_text(SKEWED_ORDERS_SQL)), ["a", "b", "c"], broadcast_max=0)


def scale_part(spark, sf):
    df = table(spark, sf, "part")
    return render(scale_numeric(df, scale_columns(df, target="p_partkey")))


def scale_lineitem(spark, sf):
    df = table(spark, sf, "lineitem")
    return render(scale_numeric(df, scale_columns(df, target="l_orderkey")))


def wide_clean(spark, sf):
    """A table of 300 columns through the manual recipe."""
    widen(table(spark, sf, "part")).createOrReplaceTempView("part")  # a small file makes much work here
    req = CleanRequest(mode="manual", manual=ManualOptions(
        remove_duplicates=False, fill_numeric_strategy="mean", fill_text_strategy="none", convert_datetimes=False))
    return render(clean(spark.sql(WIDE_PART_SQL), req).df)


# -- plans ---------------------------------------------------------------------

def auto_clean(spark, sf):
    return render(clean(dirty(spark, sf, "dirty_orders")).df)


def manual_clean(spark, sf):
    req = CleanRequest(mode="manual", manual=MANUAL_OPTIONS)
    return render(clean(dirty(spark, sf, "dirty_orders"), req).df)


def auto_keep(spark, sf):
    """Auto mode with the id column opted out of dropping."""
    return render(clean(dirty(spark, sf, "dirty_orders"), CleanRequest(keep_columns=["o_orderkey"])).df)


def manual_label(spark, sf):
    """The request a prompt suggests, with encoding: drops the id, fills by median and mode, label-encodes."""
    register(spark, sf, ("orders",))
    raw = spark.sql(spark_text(NAMED_ORDERS_SQL))
    prompt = spark.sql("select 'Remove the id, fill missing values, drop duplicate rows and encode' as text")
    row = suggest_plans(prompt, "text", profile(raw, "orders", light=True)).first()
    return render(clean(raw, request_of(row)).df)


def compare(spark, sf):
    from tabclean.plans.compare import compare_summaries
    raw = dirty(spark, sf, "dirty_orders")
    before = profile(raw, "dirty_orders")
    done = clean(raw)
    out = compare_summaries(spark, before, profile(done.df, "cleaned_dirty_orders"), done.steps)
    done.release()
    return out


def compare_columns_query(spark, sf):
    from tabclean.plans.compare import compare_columns
    raw = dirty(spark, sf, "dirty_orders")
    before = profile(raw, "dirty_orders", light=True)
    after = profile(clean(raw).df, "cleaned_dirty_orders", light=True)
    return compare_columns(spark, before, after)


def execution_log(spark, sf):
    return clean(dirty(spark, sf, "dirty_orders")).log_df(spark)


def preview_events(spark, sf):
    page = preview(table(spark, sf, "events"), ["event_id"], page=2, size=100)
    return page.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def preview_deep(spark, sf):
    """A page in the middle of events by time and id, located by counts of key ranges."""
    events = table(spark, sf, "events")
    page = preview(events, ["ts", "event_id"], page=page_count(events) // 2, size=100, most=1000)
    return page.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def pages(spark, sf):
    """The number of preview pages of each table."""
    rows = [(name, page_count(table(spark, sf, name))) for name in ("events", "documents", "orders")]
    return spark.createDataFrame(rows, "name string, pages bigint")


def prompt_flags_conversations(spark, sf):
    """Flags of every conversation turn (whole texts)."""
    return prompt_flags(table(spark, sf, "conversations"), "text").drop("text")


def suggest_plan(spark, sf):
    """A suggested plan for dirty_orders from every conversation turn."""
    conv = table(spark, sf, "conversations")
    prof = profile(dirty(spark, sf, "dirty_orders"), "dirty_orders", light=True)
    plans = suggest_plans(conv, "text", prof).drop("text")
    return plans.withColumn("drop_columns", F.array_join("drop_columns", ", "))


# -- files ---------------------------------------------------------------------

def csv_roundtrip(spark, sf):
    """dirty_orders written as CSV part files, then read back with pandas-like types."""
    out = scratch_dir(spark, "csv")
    write_csv(dirty(spark, sf, "dirty_orders"), out)
    return render(read_csv(spark, out))


def _documents_roundtrip(spark, sf, encoding):
    out = scratch_dir(spark, "enc")
    docs = table(spark, sf, "documents")
    (docs.write.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out))
    found = {r["encoding"] for r in detect_encodings(spark, out).collect()}
    back = read_csv(spark, out)
    return back.withColumn("encoding", F.lit(",".join(sorted(found))))


def encoding_latin1(spark, sf):
    return _documents_roundtrip(spark, sf, "ISO-8859-1")


def encoding_utf8(spark, sf):
    return _documents_roundtrip(spark, sf, "UTF-8")


def csv_exact(spark, sf):
    """Doubles of many digits survive writing and reading."""
    out = scratch_dir(spark, "exact")
    register(spark, sf, ("orders",))
    write_csv(spark.sql(EXACT_ORDERS_SQL), out)
    return read_csv(spark, out)


def csv_headers(spark, sf):
    """Two folders whose files have the same columns in another order."""
    out = scratch_dir(spark, "headers")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    write_csv(orders.filter("o_orderkey % 2 = 0"), f"{out}/even")
    write_csv(orders.filter("o_orderkey % 2 = 1").select("o_custkey", "o_orderpriority", "o_orderkey"), f"{out}/odd")
    return read_csv(spark, [f"{out}/even", f"{out}/odd"]).select("o_orderkey", "o_orderpriority", "o_custkey")


def trim_header_orders(spark, sf):
    """Header names with spaces around them."""
    out = scratch_dir(spark, "trim")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").toDF(" o_orderkey ", "o_orderpriority  ")
    write_csv(orders, out)
    return read_csv(spark, out)


def manifest(spark, sf):
    """Files by suffix and reason: CSV files by priority and text files by status, more of them the larger the table."""
    out = scratch_dir(spark, "manifest")
    orders = table(spark, sf, "orders")
    orders = orders.withColumn("part", F.col("o_orderkey") % _files_of(orders))
    orders.repartition("o_orderpriority", "part").write.partitionBy("o_orderpriority", "part").option("header", True).csv(f"{out}/csv")
    (orders.select("o_orderstatus", "part", F.col("o_orderkey").cast("string").alias("value")).repartition("o_orderstatus", "part")
     .write.partitionBy("o_orderstatus", "part").text(f"{out}/txt"))
    return source_manifest(spark, out).groupBy("suffix", "accepted", "reason").agg(F.count(F.lit(1)).alias("files"))


def dedupe_sources_events(spark, sf):
    """A manifest made of events: files of equal name, size and time count once."""
    files = table(spark, sf, "events").select(
        F.concat(F.lit("in/"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"), F.col("event_type").alias("name"),
        (F.col("user_id") % 50).alias("length"), F.date_trunc("day", "ts").alias("modificationTime"))
    return render(dedupe_sources(files))


# The table as CSV files of about so many rows, as users upload them: their number grows with the table.
FILE_OPTIONS = ManualOptions(fill_numeric_strategy="mean", fill_text_strategy="constant", text_constant="unknown")
FILE_ROWS = 5000


def _files_of(df):
    return max(2, -(-df.count() // FILE_ROWS))


def _write_files(spark, sf, folder):
    df = dirty(spark, sf, "dirty_orders")
    files = _files_of(df)
    part = df.withColumn("part", F.col("o_orderkey") % files).repartition("part")
    write_csv(part.select("part", *df.columns), folder, by="part")


def clean_each(spark, sf):
    src, out = scratch_dir(spark, "each-in"), scratch_dir(spark, "each-out")
    _write_files(spark, sf, src)
    done = clean_files(spark, src, CleanRequest(mode="manual", manual=FILE_OPTIONS), out)
    rows = spark.read.option("header", True).csv(out).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    name = F.regexp_extract("output", "source=(.*)$", 1)
    return done.withColumn("source", name).join(rows, "source", "left").select("accepted", "reason", "steps", "rows")


def replay(spark, sf):
    """A saved preset, listed, loaded and replayed on new files."""
    from tabclean.streaming.replay import replay_stream
    src, out, store = (scratch_dir(spark, f"replay-{x}") for x in ("in", "out", "presets"))
    save_preset(spark, store, "files", CleanRequest(mode="manual", manual=FILE_OPTIONS))
    preset = list_presets(spark, store).filter("name = 'files'").first()
    _write_files(spark, sf, src)
    replay_stream(spark, src, load_request(preset), out)
    rows = spark.read.option("header", True).csv(f"{out}/rows/*")
    # A file whose dates or prices are all missing keeps that column as text, filled with the constant: missing here.
    return render(rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("price").try_cast("double").alias("price"), "prio",
                              F.col("odate").try_cast("timestamp_ntz").alias("odate"), F.col("cust_txt").try_cast("double").alias("cust_txt")))


def report(spark, sf):
    from tabclean.plans.report import report_df
    raw = dirty(spark, sf, "dirty_orders")
    res = clean(raw)
    return report_df(spark, "dirty_orders", profile(raw, "dirty_orders"), profile(res.df, "cleaned"), res.steps)


QUERIES = {
    "normalize_text": normalize_text,
    "infer_ratio": infer_ratio,
    "coerce_numeric": coerce_numbers,
    "coerce_bigint": coerce_bigint,
    "inf_to_null": inf_to_null,
    "bool_to_int": bool_to_int_orders,
    "convert_dates": convert_dates,
    "convert_dates_wide": convert_dates_wide,
    "profile_orders": profile_orders,
    "profile_lineitem": profile_lineitem,
    "profile_documents": profile_documents,
    "profile_variant": profile_variant,
    "top_values_orders": top_values_orders,
    "top_values_documents": top_values_documents,
    "top_values_events": top_values_events,
    "summary_orders": summary_orders,
    "summary_customer": summary_customer,
    "target_candidates": target_candidates,
    "suggestions": suggestions,
    "alerts": alerts,
    "drop_sparse": drop_sparse,
    "drop_empty": drop_empty,
    **{name: _filter_query(name) for name in FILTER_RULES},
    "filter_eq_big": filter_eq_big,
    "dedupe": dedupe,
    "fill_mean": _fill("mean", "none"),
    "fill_median": _fill("median", "none"),
    "fill_zero": _fill("zero", "none"),
    "fill_mode": _fill("none", "mode"),
    "fill_constant": _fill("none", "constant", "unknown"),
    "fill_datetime": _fill("none", "none"),
    "fill_median_odd": fill_median_odd,
    "fill_boolean": fill_boolean,
    "outliers": outliers,
    "one_hot": one_hot,
    "one_hot_source": one_hot_source,
    "one_hot_collision": one_hot_collision,
    "label_encode": label_encode_part,
    "label_encode_skewed": label_encode_skewed,
    "label_encode_names": label_encode_names,
    "dotted_names": dotted_names,
    "label_encode_text": label_encode_text,
    "scale_part": scale_part,
    "scale_lineitem": scale_lineitem,
    "wide_clean": wide_clean,
    "auto_clean": auto_clean,
    "auto_keep": auto_keep,
    "manual_label": manual_label,
    "manual_clean": manual_clean,
    "compare": compare,
    "compare_columns": compare_columns_query,
    "execution_log": execution_log,
    "preview": preview_events,
    "preview_deep": preview_deep,
    "pages": pages,
    "prompt_flags": prompt_flags_conversations,
    "suggest_plan": suggest_plan,
    "csv_roundtrip": csv_roundtrip,
    "csv_exact": csv_exact,
    "csv_headers": csv_headers,
    "trim_header": trim_header_orders,
    "dedupe_sources": dedupe_sources_events,
    "encoding_latin1": encoding_latin1,
    "encoding_utf8": encoding_utf8,
    "manifest": manifest,
    "clean_each": clean_each,
    "replay": replay,
    "report": report,
}
