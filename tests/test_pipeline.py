"""Auto and manual plans: step log, properties, presets and replay."""

from pyspark.sql import functions as F

from tabclean.plans.cleaning import clean
from tabclean.plans.request import CleanRequest, ManualOptions
from tabclean.plans.suggest import prompt_flags
from tabclean.operators.rows import FilterRule
from tabclean.sources.presets import list_presets, load_request, save_preset
from tabclean.sources.tables import dirty

from conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_auto_clean_log_and_properties(spark):
    raw = dirty(spark, SF_SMALL, "dirty_orders")
    res = clean(raw)
    names = [n for n, _ in res.steps]
    assert names[:3] == ["coerce_numeric_like_columns", "drop_columns", "remove_duplicates"]
    assert ("drop_columns", "Dropped columns: o_orderkey") in res.steps
    out = res.df
    assert out.columns == ["price", "prio", "odate", "cust_txt"]
    assert out.count() <= raw.count()
    assert out.count() == out.dropDuplicates().count()
    assert out.filter(F.col("price").isNull() | F.col("prio").isNull() | F.col("odate").isNull()
                      | F.col("cust_txt").isNull()).count() == 0


def test_clean_independent_of_partitioning(spark):
    raw = dirty(spark, SF_SMALL, "dirty_orders")
    a = clean(raw.repartition(1)).df
    b = clean(raw.repartition(5)).df
    assert _rows(a) == _rows(b)


def test_manual_clean_order(spark):
    req = CleanRequest(mode="manual", manual=ManualOptions(
        drop_columns=["o_orderkey", "missing_col"], fill_numeric_strategy="zero", fill_text_strategy="constant",
        text_constant="?", filter_rules=[FilterRule("prio", "not_equals", "?")], encode_categoricals=True,
        scale_numeric=True, remove_outliers=True, drop_missing_rows_threshold=0.9))
    res = clean(dirty(spark, SF_SMALL, "dirty_orders"), req)
    names = [n for n, _ in res.steps]
    assert names == ["coerce_numeric_like_columns", "drop_columns", "remove_duplicates", "drop_sparse_rows",
                     "manual_numeric_numeric", "manual_numeric_datetime", "manual_text_text", "filter_rows",
                     "remove_outliers", "encode_categoricals", "scale_numeric"]
    assert ("drop_columns", "Dropped columns: o_orderkey, missing_col") in res.steps
    assert res.df.filter(F.col("prio_?").isNotNull()).count() == 0 if "prio_?" in res.df.columns else True
    assert "prio" not in res.df.columns


def test_booleans_become_ints(spark):
    none = CleanRequest(mode="manual", manual=ManualOptions(fill_numeric_strategy="none", fill_text_strategy="none"))
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (True, None)], "b boolean, x double")
    res = clean(df, none)
    assert dict(res.df.dtypes)["b"] == "int"
    assert res.steps[-1][0] == "normalize_boolean_columns"
    # with a gap the column counts as numbers from the start, as an object column does in pandas
    res = clean(spark.createDataFrame([(True, 1.0), (False, 2.0), (None, None)], "b boolean, x double"), none)
    assert dict(res.df.dtypes)["b"] == "double"
    assert ("drop_empty_rows", "Removed 1 fully empty rows.") in res.steps


def _wide(spark, n):
    rows = [tuple(None if (i + k) % 5 == 0 else float((i * k) % 7 + i) for k in range(n)) for i in range(6)]
    return spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(n)))


def test_finalize_of_a_wide_table(spark):
    """2,000 columns: the plan is flat."""
    from tabclean.plans.cleaning import _Run, finalize
    run = _Run(_wide(spark, 2000))
    finalize(run)
    assert len(run.df.columns) == 2000 and run.df.count() == 6


def test_manual_clean_of_a_wide_table(spark):
    res = clean(_wide(spark, 150), CleanRequest(mode="manual", manual=ManualOptions(
        fill_numeric_strategy="mean", remove_duplicates=False, remove_outliers=True, scale_numeric=True)))
    assert len(res.df.columns) == 150 and res.df.na.drop().count() == 6


def test_only_the_last_copy_stays_persisted(spark):
    res = clean(dirty(spark, SF_SMALL, "dirty_orders"))
    assert len(res.persisted) == 1
    res.release()
    assert not res.persisted


def test_request_of_a_suggestion(spark):
    from tabclean.operators.profile import profile
    from tabclean.plans.suggest import request_of, suggest_plans
    raw = dirty(spark, SF_SMALL, "dirty_orders")
    prompt = spark.createDataFrame([("remove identifier, encode and scale, handle outliers",)], "text string")
    req = request_of(suggest_plans(prompt, "text", profile(raw, light=True)).first())
    m = req.manual
    assert (req.mode, m.drop_columns, m.encode_categoricals, m.scale_numeric, m.remove_outliers) == ("manual", ["o_orderkey"], True, True, True)


def test_presets_round_trip(spark, tmp_dir):
    store = tmp_dir + "/presets"
    assert list_presets(spark, store).count() == 0
    req = CleanRequest(mode="manual", manual=ManualOptions(fill_numeric_strategy="mean",
                                                           filter_rules=[FilterRule("prio", "contains", "URG")]))
    save_preset(spark, store, "  first ", CleanRequest())
    save_preset(spark, store, "second", req)
    rows = list_presets(spark, store).collect()
    assert [r["name"] for r in rows] == ["second", "first"]
    assert load_request(rows[0]) == req
    raw = dirty(spark, SF_SMALL, "dirty_orders")
    assert _rows(clean(raw, load_request(rows[0])).df) == _rows(clean(raw, req).df)


def test_prompt_flags_substrings(spark):
    df = spark.createDataFrame([("Hidden values",), ("validate the DATES",), ("scale it",)], "text string")
    got = [r.asDict() for r in prompt_flags(df, "text").drop("text").collect()]
    assert got[0]["flag_id"] and not got[0]["flag_date"]
    assert got[1]["flag_id"] and got[1]["flag_date"]
    assert got[2]["flag_scale"] and not got[2]["flag_id"]


def test_report_lines(spark):
    from tabclean.operators.profile import profile
    from tabclean.plans.report import report_df
    raw = dirty(spark, SF_SMALL, "dirty_orders")
    res = clean(raw)
    rows = report_df(spark, "dirty_orders", profile(raw), profile(res.df), res.steps).orderBy("line_no").collect()
    text = [r["text"] for r in rows]
    assert text[0] == "Data Cleaning Report" and text[1] == "Dataset: dirty_orders"
    assert text[3] == f"Rows before: {raw.count()}" and text[4] == f"Rows after: {res.df.count()}"
    assert "Applied steps:" in text
    assert "- drop_columns: Dropped columns: o_orderkey" in text


def test_suggest_plan_default_branch(spark):
    from tabclean.operators.profile import profile
    from tabclean.plans.suggest import suggest_plans
    prompts = spark.createDataFrame([(1, "make it nice"), (2, "drop the identifier please")], "k int, text string")
    prof = profile(dirty(spark, SF_SMALL, "dirty_orders"), light=True)
    got = {r["k"]: r for r in suggest_plans(prompts, "text", prof).collect()}
    assert got[1]["drop_columns"] == ["o_orderkey"] and got[1]["reasons"].startswith("Applied a safe default plan")
    assert got[2]["drop_columns"] == ["o_orderkey"]
    assert got[2]["reasons"] == "Flagged likely identifier columns: o_orderkey."


def test_report_is_written(spark, tmp_dir):
    from tabclean.operators.profile import profile
    from tabclean.plans.report import report_df, write_report
    prof = profile(dirty(spark, SF_SMALL, "dirty_orders"), light=True)
    rows = report_df(spark, "orders", prof, prof, [("a", "b")])
    write_report(rows, f"{tmp_dir}/json")
    write_report(rows, f"{tmp_dir}/text", "text")
    assert spark.read.json(f"{tmp_dir}/json").count() == rows.count()
    assert any(r["value"] == "- a: b" for r in spark.read.text(f"{tmp_dir}/text").collect())
    assert len(prof.suggestions(None)) >= len(prof.suggestions(0)) == 0


def test_known_counts_are_not_counted_again(spark, monkeypatch):
    """After a fill the counts of its frame are known: a second fill and the end of the recipe read nothing for them."""
    from tabclean.operators import impute
    from tabclean.plans import cleaning
    calls = []
    for module in (impute, cleaning):
        counted = module.count_by_column
        monkeypatch.setattr(module, "count_by_column", lambda df, columns, *a, _f=counted, **k: calls.append(list(columns)) or _f(df, columns, *a, **k))
    df = spark.createDataFrame([(1, 1.0, "x", None), (2, None, None, None), (3, 4.0, "y", None), (None, None, None, None)], "k int, p double, t string, e double")
    request = CleanRequest(mode="manual", manual=ManualOptions(
        remove_duplicates=False, fill_numeric_strategy="mean", fill_text_strategy="none", convert_datetimes=False))
    done = clean(df, request)
    assert len(calls) == 1
    assert _rows(done.df) == sorted([(1.0, 1.0, "x"), (2.0, 2.5, None), (3.0, 4.0, "y"), (2.0, 2.5, None)], key=repr)
    assert ("drop_empty_columns", "Dropped empty columns: e") in done.steps
    # dates that do not parse become missing, and are filled: their counts follow from the conversion
    dates = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in range(1, 20)] + [("soon",), (None,)], "d string")
    assert [r["d"].day for r in clean(dates, CleanRequest(mode="manual", manual=ManualOptions(
        remove_duplicates=False, fill_numeric_strategy="none", fill_text_strategy="mode", convert_datetimes=True))).df.collect()].count(1) == 3


def test_short_numbers_are_shown_without_text(spark):
    import random
    from tabclean.plans.registry import SIG_FORMAT, sig
    rnd = random.Random(1)
    values = [0.0, -0.0, float("nan"), float("inf"), None, 0.005, 1.005, 2.675, 99999999.99, 99999999.994, 1e8, 1e10, 0.1 + 0.2, 1e-12]
    values += [round(rnd.uniform(-1e9, 1e9), rnd.randint(0, 5)) for _ in range(2000)] + [rnd.gauss(0, 1) * 10 ** rnd.randint(-8, 12) for _ in range(2000)]
    c = F.col("c")
    by_text = F.when(c.isNotNull(), F.format_string(SIG_FORMAT, F.round(c, 9) + F.lit(0.0)).cast("double"))
    both = spark.createDataFrame([(v,) for v in values], "c double").select(sig(c).cast("string").alias("a"), by_text.cast("string").alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_wide_clean_uses_every_core(spark):
    from tabclean.plans.registry import wide_clean
    assert wide_clean(spark, SF_SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
