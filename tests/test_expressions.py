"""Number text, date text, whitespace and markers (D-2, D-3, O-10..O-13)."""

from pyspark.sql import functions as F

from tabclean.functions import normalized_text, to_datetime, to_number
from tabclean.functions.textform import double_text
from tabclean.operators.normalize import normalize_raw


def _one(spark, expr, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col(df.columns[0]))).collect()]


def test_number_text(spark):
    got = _one(spark, to_number, ["12", " 12 ", "12d", "1_000", "1e400", "inf", "-.5", "+3.", "1e5", "abc", None])
    assert got == [12.0, 12.0, None, None, None, None, -0.5, 3.0, 1e5, None, None]


def test_date_text(spark):
    got = _one(spark, to_datetime, ["2024-01-05", "01/05/2024", "20240105", "2024-01-05 10:11:12", "Jan 5, 2024",
                                    "2024", "soon", "1/5/2024", None])
    assert [None if g is None else g.isoformat() for g in got] == [
        "2024-01-05T00:00:00", "2024-01-05T00:00:00", "2024-01-05T00:00:00", "2024-01-05T10:11:12",
        "2024-01-05T00:00:00", None, None, "2024-01-05T00:00:00", None]


def test_strip_tabs_and_no_break_spaces(spark):
    got = _one(spark, normalized_text, ["\t a  ", "  ", " N/A ", "None", "<NA>", "x y", "\x1cz\x1f"])
    assert got == ["a", None, None, None, None, "x y", "z"]


def test_inf_and_nan_become_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,)], "x double")
    assert [r[0] for r in normalize_raw(df).collect()] == [None, None, None, 1.5]


def test_double_text_like_python(spark):
    values = [10000000.0, 12.5, 0.1, 1e-05, 1.5e-05, 1e16, 123456.789, -2.0, 0.0]
    got = _one(spark, double_text, values, "x double")
    assert got == [repr(v) for v in values]


def test_text_unlike_a_date_meets_one_test(spark):
    """The test before the layouts lets every text through that a layout parses."""
    from pyspark.sql import functions as F
    from tabclean.functions.dates import DATE_FORMATS, _whole_year
    from tabclean.functions.text import strip_text
    heads = ["2024", "24", "5", "05", "13", "Jan", "May", "September", "x", ""]
    texts = [f"{a}{s}{b}{t}{c}{z}" for s in "-/. " for a in heads for b in heads for t in (s, ", ") for c in ("2024", "24", "5", "31", "69")
             for z in ("", " 10:30", " 1:30 PM")] + ["20240105", "20240105101112", "2024-01-05T10:11", "2024-13-45", " 2024-1-5 ", "1-URGENT", "12345", "2024", "10:30", ""]
    stripped = _whole_year(strip_text(F.col("t")))
    every = F.coalesce(*[F.when(stripped.rlike(shape), F.try_to_timestamp(stripped, F.lit(fmt))) for fmt, shape in DATE_FORMATS]).cast("timestamp_ntz")
    both = spark.createDataFrame([(t,) for t in texts], "t string").select("t", every.alias("a"), to_datetime(F.col("t")).alias("b")).collect()
    assert [r for r in both if r["a"] != r["b"]] == []
    assert sum(r["a"] is not None for r in both) > 100
    plan = spark.createDataFrame([("x",)], "t string").select(to_datetime(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("RLIKE") < plan.index("coalesce")
