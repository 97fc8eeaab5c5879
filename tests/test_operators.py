"""Row, fill, outlier, encoding and scaling operators on hand-made frames."""

import pytest

from tabclean.operators.encode import choose_encoding, encode_categoricals, label_encode
from tabclean.operators.impute import column_medians, missing_cleanup
from tabclean.operators.outliers import remove_outliers
from tabclean.operators.rank import dense_ranks
from tabclean.operators.rows import FilterRule, apply_filters, drop_sparse_rows, min_non_missing
from tabclean.operators.scale import scale_numeric
from tabclean.operators.types import coerce_numeric, convert_datetimes


def test_sparse_threshold_float_rule():
    assert min_non_missing(10, 0.7) == 4


def test_drop_sparse_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2, None), (None, None, None)], "a int, b int, c int")
    assert drop_sparse_rows(df, 0.5).count() == 1  # ceil(3 * 0.5) = 2


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "b", "a", "c", None]], "t string")
    res = missing_cleanup(df, "none", "mode", "unknown", "p")
    assert res.values["t"] == "a"
    assert res.steps == [("p_text", "Applied mode strategy to text columns: t")]


def test_median_even_count(spark):
    df = spark.createDataFrame([(x,) for x in [4.0, 1.0, 3.0, 2.0, None, 100.0, 5.0]], "x double")
    assert column_medians(df, ["x"]) == {"x": 3.5}


def test_median_many_partitions(spark):
    import statistics
    vals = [float((i * 7919) % 1013) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    assert column_medians(df, ["x"])["x"] == statistics.median(vals)


def test_dense_rank_across_partitions(spark):
    words = [f"w{i:04d}" for i in range(1000)]
    df = spark.createDataFrame([(0, w) for w in reversed(words)], "idx int, v string").repartition(4)
    ranks = {r["v"]: r["rank"] for r in dense_ranks(df, "idx", "v", partitions=4).collect()}
    assert [ranks[w] for w in words] == list(range(1000))


def test_fill_all_missing_numeric_is_logged_but_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "x double, y double")
    res = missing_cleanup(df, "median", "none", "unknown", "auto")
    assert res.steps[0] == ("auto_numeric", "Applied median strategy to numeric columns: x, y")
    assert [tuple(r) for r in res.df.collect()] == [(None, 1.0), (None, 1.0)]


def test_datetime_fill_runs_with_strategy_none(spark):
    import datetime as dt
    d1, d2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(d2,), (d1,), (None,)], "t timestamp_ntz")
    res = missing_cleanup(df, "none", "none", "unknown", "p")
    assert res.steps == [("p_datetime", "Filled datetime missing values in: t")]
    assert sorted(r[0] for r in res.df.collect()) == [d1, d1, d2]


def test_coerce_numeric_threshold(spark):
    nine = [(str(i),) for i in range(9)] + [("x",)]
    df = spark.createDataFrame(nine, "t string")
    conv = coerce_numeric(df)
    assert conv.converted == ["t"] and dict(conv.df.dtypes)["t"] == "double"
    eight = [(str(i),) for i in range(8)] + [("x",), ("y",)]
    assert coerce_numeric(spark.createDataFrame(eight, "t string")).converted == []
    ints = spark.createDataFrame([("1",), ("2",)], "t string")
    assert dict(coerce_numeric(ints).df.dtypes)["t"] == "bigint"


def test_convert_datetimes_threshold(spark):
    vals = [("2024-01-0%d" % i,) for i in range(1, 10)] + [("soon",)]
    conv = convert_datetimes(spark.createDataFrame(vals, "t string"))
    assert conv.converted == ["t"]
    vals = [("2024-01-0%d" % i,) for i in range(1, 9)] + [("soon",), ("later",)]
    assert convert_datetimes(spark.createDataFrame(vals, "t string")).converted == []


def test_outliers_keep_missing_and_constant(spark):
    rows = [(float(i % 10), 1.0) for i in range(200)] + [(1000.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, c double")
    out = remove_outliers(df, ["x", "c"], 3.0)
    assert out.count() == 201
    assert out.filter("x is null").count() == 1


def test_scale_population_std_and_zero_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    got = [tuple(r) for r in scale_numeric(df, ["x", "c"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_label_encoding_missing_is_minus_one(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "k int, t string")
    got = sorted(tuple(r) for r in label_encode(df, ["t"]).collect())
    assert got == [(1, 1), (2, 0), (3, -1), (4, 2), (5, 0)]


@pytest.mark.parametrize("n_values,rows,expect_one_hot", [(20, 100, True), (21, 105, False), (20, 101, True),
                                                          (10, 50, True), (10, 49, False)])
def test_one_hot_limits(spark, n_values, rows, expect_one_hot):
    data = [(f"v{i % n_values:02d}",) for i in range(rows)]
    plan = choose_encoding(spark.createDataFrame(data, "t string"), ["t"])
    assert (list(plan.one_hot) == ["t"]) == expect_one_hot


def test_one_hot_columns_sorted_and_missing_all_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)] * 10, "k int, t string")
    out, names, details = encode_categoricals(df, ["t"])
    assert names == ["t_a", "t_b"] and out.columns == ["k", "t_a", "t_b"]
    assert details == "One-hot encoded: t"
    assert sorted({tuple(r) for r in out.collect()}) == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]


def test_filters_on_missing_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (2.0, "nan")], "x double, t string")
    ne = apply_filters(df, [FilterRule("x", "not_equals", "1")])
    assert ne.count() == 2  # the missing row is kept
    assert apply_filters(df, [FilterRule("x", "equals", "abc")]).count() == 0
    assert apply_filters(df, [FilterRule("x", "not_equals", "abc")]).count() == 3
    assert apply_filters(df, [FilterRule("t", "contains", "na")]).count() == 2  # missing prints "nan"
    assert apply_filters(df, [FilterRule("t", "equals", "nan")]).count() == 2
    assert apply_filters(df, [FilterRule("x", "greater_than", "1.5")]).count() == 1
    assert apply_filters(df, [FilterRule("nope", "equals", "1")]).count() == 3
    with pytest.raises(ValueError):
        apply_filters(df, [FilterRule("x", "less_than", "abc")])


def test_label_encoding_hot_value_split(spark):
    """A value holding a third of the rows goes through the broadcast side of the split join."""
    rows = [(i, "hot") for i in range(40)] + [(100 + i, f"v{i:03d}") for i in range(80)] + [(999, None)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(5)
    got = dict((r["k"], r["t"]) for r in label_encode(df, ["t"]).collect())
    assert len(got) == len(rows)
    assert {got[i] for i in range(40)} == {0}  # "hot" sorts before "v000"
    assert [got[100 + i] for i in range(80)] == list(range(1, 81))
    assert got[999] == -1


def test_median_of_every_count(spark):
    """All counts from 1 to 300, and 10,001: one column each, against the standard library."""
    import random
    import statistics
    rnd = random.Random(9)
    sizes = [*range(1, 301)]
    values = {f"c{n}": [rnd.choice([rnd.random(), float(rnd.randint(0, 5))]) for _ in range(n)] for n in sizes}
    rows = [tuple(v[i] if i < len(v) else None for v in values.values()) for i in range(max(sizes))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in values))
    assert column_medians(df, list(values)) == {c: statistics.median(v) for c, v in values.items()}
    big = [float((i * 7919) % 10007) / 8 for i in range(10_001)]
    df = spark.createDataFrame([(v,) for v in big] + [(None,)], "x double").repartition(5)
    assert column_medians(df, ["x"]) == {"x": statistics.median(big)}
    assert column_medians(spark.createDataFrame([(None,)], "x double"), ["x"]) == {"x": None}


def test_moments_by_index_equal_plain_ones(spark):
    import math

    from pyspark.sql import functions as F

    from tabclean.operators.fit import moments
    df = spark.createDataFrame([(1.0, None, 5), (2.5, None, 7), (None, None, 9)], "a double, b double, c int")
    exprs = {c: F.col(c) for c in df.columns}
    plain, by_index = moments(df, exprs), moments(df, exprs, wide=0)
    assert plain["b"][0] == by_index["b"][0] == 0
    for c in "ac":
        assert all(math.isclose(x, y) for x, y in zip(plain[c], by_index[c]))


def test_big_integers_keep_their_digits(spark):
    from tabclean.operators.types import coerce_numeric
    rows = [("9007199254740993", "18446744073709551615", "99999999999999999999"), ("9007199254740992", " 1 ", "2")]
    got = coerce_numeric(spark.createDataFrame(rows, "a string, b string, c string")).df
    assert [t for _, t in got.dtypes] == ["bigint", "decimal(20,0)", "double"]
    assert sorted((r["a"], int(r["b"])) for r in got.collect()) == [(9007199254740992, 1), (9007199254740993, 18446744073709551615)]


def test_boolean_with_gaps_is_filled(spark):
    from tabclean.plans.cleaning import clean
    from tabclean.plans.request import CleanRequest
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3 > 0) for i in range(40)], "k int, b boolean")
    out = clean(df, CleanRequest(keep_columns=["k"]))
    assert out.df.filter("b is null").count() == 0 and dict(out.df.dtypes)["b"] == "double"
    assert out.df.columns == ["k", "b"]


def test_one_hot_name_that_is_taken(spark):
    from tabclean.operators.encode import encode_categoricals
    df = spark.createDataFrame([("x", 7, 1) if i % 2 else ("y", 8, 2) for i in range(40)], "a string, a_x int, a_y_2 int")
    out, names, details = encode_categoricals(df, ["a"])
    assert out.columns == ["a_x", "a_y_2", "a_x_2", "a_y"] and names == ["a_x_2", "a_y"] and "a_x_2" in details
    assert {tuple(r) for r in out.collect()} == {(7, 1, 1, 0), (8, 2, 0, 1)}


def test_label_encode_scans_do_not_grow(spark, tmp_dir):
    """One scan of the input for 1 and for 8 columns, hot and missing values included."""
    from tabclean.operators.encode import label_encode
    names = [f"t{i}" for i in range(8)]
    rows = [tuple(None if (i + k) % 3 == 0 else "hot" if (i + k) % 3 == 1 else f"v{i:03d}" for k in range(8)) for i in range(90)]
    path = f"{tmp_dir}/t"
    spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).write.parquet(path)
    df = spark.read.parquet(path)
    scans = []
    for cols in (names[:1], names):
        out = label_encode(df, cols, broadcast_max=0)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation ["))
        for k, c in enumerate(cols):
            order = sorted({r[k] for r in rows if r[k] is not None})
            want = sorted(-1 if r[k] is None else order.index(r[k]) for r in rows)
            assert sorted(r[c] for r in out.select(c).collect()) == want
    assert scans[0] == scans[1] == 1


def test_filter_rules_empty_iso_and_layout(spark):
    import datetime as dt

    from tabclean.operators.rows import FilterRule, apply_filters
    rows = [(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 1, 6)), (3, dt.datetime(2024, 1, 7, 10, 30))]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz")
    keys = lambda *rules: sorted(r["k"] for r in apply_filters(df, list(rules)).collect())
    assert keys(FilterRule("k", "equals", ""), FilterRule("k", "greater_than", " "), FilterRule("", "equals", "1")) == [1, 2, 3]
    assert keys(FilterRule("t", "greater_than", "2024-01-05T12:00:00")) == [2, 3]
    assert keys(FilterRule("t", "less_than", "2024-01-06")) == [1]
    # with the third row gone the column prints as dates only
    assert keys(FilterRule("k", "less_than", "3"), FilterRule("t", "equals", "2024-01-05")) == [1]
    assert keys(FilterRule("t", "equals", "2024-01-05")) == []
    with pytest.raises(ValueError):
        keys(FilterRule("k", "greater_than", "2024-01-05"))


@pytest.mark.parametrize("text, want", [
    ("1/5/2024", "2024-01-05 00:00:00"), ("2024/01/05", "2024-01-05 00:00:00"), ("2024-01-05 10:30", "2024-01-05 10:30:00"),
    ("01/05/2024 10:30", "2024-01-05 10:30:00"), ("5 Jan 2024", "2024-01-05 00:00:00"), ("January 5, 2024", "2024-01-05 00:00:00"),
    ("13/01/2024", "2024-01-13 00:00:00"), ("2024-01-05 10:30:00+00:00", "2024-01-05 10:30:00"), ("2024.01.05", "2024-01-05 00:00:00"),
    ("2024-1-5", "2024-01-05 00:00:00"), ("13/13/2024", None), ("2024", None), ("10:30", None)])
def test_date_layouts(spark, text, want):
    from pyspark.sql import functions as F

    from tabclean.functions import to_datetime
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(to_datetime(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("d"))
    assert got.first()["d"] == want


def test_text_of_doubles_is_pythons(spark):
    import random

    from pyspark.sql import functions as F

    from tabclean.functions.textform import double_text
    rnd = random.Random(2)
    values = [0.0, -0.0, 1.0, 0.012345678901234567, 1e-4, 9.9e-5, 1e7, 1e15, 123456789012345.6, 1e16, 1.5e300, -2.5e-7, 100.0, 12345678.9]
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 18) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", double_text(F.col("x")).alias("t")).collect()
    assert all(float(r["t"]) == r["x"] for r in rows)
    assert [r["t"] for r in rows[:14]] == [repr(v) for v in values[:14]]


def test_count_by_column_wide_text_table(spark):
    """Type fits over 500 text columns: one grouped job, counts equal brute force."""
    import random

    from tabclean.functions import to_number
    from tabclean.functions.numbers import to_integer
    from tabclean.operators.fit import count_by_column
    from tabclean.operators.types import coerce_numeric

    rnd = random.Random(3)
    width = 500
    cols = [f"t{i}" for i in range(width)]
    pool = ["1", " 2 ", "3.5", "x", None, "1e3"]
    data = [tuple(rnd.choice(pool) for _ in cols) for _ in range(30)]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    stats = count_by_column(df, cols, {"num": lambda s: to_number(s).isNotNull(), "int": lambda s: to_integer(s, "bigint").isNotNull()})
    assert stats[("", "rows")] == 30
    for i, c in enumerate(cols):
        vals = [r[i] for r in data if r[i] is not None]
        assert stats[(c, "nn")] == len(vals)
        assert stats[(c, "num")] == sum(1 for v in vals if v != "x")
        assert stats[(c, "int")] == sum(1 for v in vals if v.strip() in ("1", "2"))
    conv = coerce_numeric(df)
    expect = [c for i, c in enumerate(cols)
              if (vals := [r[i] for r in data if r[i] is not None]) and sum(v != "x" for v in vals) / len(vals) >= 0.9]
    assert conv.converted == expect


def test_filters_compare_whole_numbers_exactly(spark):
    from tabclean.operators.rows import FilterRule, apply_filters
    top = 2**63 - 1
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (top,), (-top - 1,), (None,)], "x bigint")

    def kept(op, value):
        return sorted(r[0] for r in apply_filters(df, [FilterRule("x", op, value)]).collect() if r[0] is not None)

    assert kept("equals", str(2**53 + 1)) == [2**53 + 1]
    assert kept("not_equals", str(2**53 + 1)) == [-top - 1, 2**53, top]
    for value in ("1e300", "9223372036854775808", "99999999999999999999"):
        assert kept("equals", value) == [] and kept("greater_than", value) == []
        assert len(kept("less_than", value)) == 4 and len(kept("not_equals", value)) == 4
    assert kept("greater_than", "-1e300") == [-top - 1, 2**53, 2**53 + 1, top]
    assert kept("greater_than", "9007199254740992.5") == [2**53 + 1, top]
    assert kept("greater_than", "9223372036854775806.5") == [top]
    assert len(kept("less_than", "9223372036854775807.5")) == 0 or kept("less_than", "9223372036854775807.5") == [-top - 1, 2**53, 2**53 + 1, top]
    dec = spark.createDataFrame([("12345678901234567890",), ("12345678901234567891",)], "s string").selectExpr("cast(s as decimal(20,0)) as x")
    assert [str(r[0]) for r in apply_filters(dec, [FilterRule("x", "equals", "12345678901234567891")]).collect()] == ["12345678901234567891"]
    assert apply_filters(dec, [FilterRule("x", "less_than", "1e300")]).count() == 2


def test_label_encode_keeps_columns_of_any_name(spark):
    from tabclean.operators.encode import label_encode
    df = spark.createDataFrame([("a", "b", 1, "x"), ("c", None, 2, "y")], "`_k` string, `_label` string, `_hot` int, v string")
    for most in (0, 10):
        got = label_encode(df, ["v", "_label"], broadcast_max=most)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [("a", 0, 1, 0), ("c", -1, 2, 1)]


def test_dotted_names_through_row_drops(spark):
    from tabclean.operators.rows import drop_empty_rows, drop_sparse_rows
    df = spark.createDataFrame([("x", None, 1), (None, None, None)], "`a.b` string, `c``d` string, e int")
    assert drop_empty_rows(df).count() == 1 and drop_sparse_rows(df, 0.5).count() == 1


def test_deep_pages(spark):
    import random
    from pyspark.sql import functions as F
    from tabclean.sources.preview import _located, preview
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "c" * rnd.randint(1, 9)]), rnd.choice([None, rnd.gauss(0, 5)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "`k.1` string, x double, id int").repartition(5)
    by = ["k.1", "x", "id"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0.0, r[2]))
    for page in (1, 2, 37, 50, 51, 400):
        assert [tuple(r) for r in preview(df, by, page, 100, most=300).collect()] == want[(page - 1) * 100:page * 100]
    left, before = _located(df, by, 2500, 100, 300)
    assert before <= 2500 and left.count() + before >= 2600 and left.count() < 2500
    same = spark.range(3000).select(F.lit(1).alias("k"))
    assert preview(same, ["k"], 20, 100, most=300).count() == 100


def test_mixed_kinds_of_a_variant(spark):
    from tabclean.operators.dedupe import deduplicate
    from tabclean.operators.profile import profile, variant_kinds
    df = spark.sql("""select parse_json(v) as v, parse_json(w) as w, map('a', 1) as m from values
        ('1', '1'), ('"x"', '2.5'), ('null', '3'), ('{"a": 1}', '4'), ('"x"', '2.5') as t(v, w)""")
    assert variant_kinds(df)["v"] == ["BIGINT", "OBJECT", "STRING"]
    p = profile(df, "t")
    assert [c.inferred_type for c in p.columns[:2]] == ["mixed", "numeric"] and p.duplicate_rows == 1
    assert any("v" in s for s in p.suggestions())
    assert deduplicate(df).count() == 4


def test_top_values_of_long_texts_and_decimals(spark):
    from tabclean.operators.profile import profile
    long = "the same beginning of a text, "
    rows = [(long + str(i % 7), float(i)) for i in range(20)] + [(None, None)]
    df = spark.createDataFrame(rows, "t string, d double").selectExpr("t", "cast(d as decimal(12,2)) as d")
    top = {c.name: c.top_values for c in profile(df, "x").columns}
    assert top["t"] == [(long + str(i), 3) for i in range(5)]
    assert [v for v, _ in top["d"]] == ["0.00", "1.00", "2.00", "3.00", "4.00"]
    many = spark.range(1000).selectExpr(f"concat('{long}{long}', lpad(id, 6, '0')) as t")
    assert [v[-6:] for v, _ in profile(many, "y").columns[0].top_values] == [f"{i:06d}" for i in range(5)]
    c = profile(many, "y").columns[0]
    assert c.distinct == 1000 and c.possible_id


def test_duplicates_by_candidates(spark):
    from tabclean.operators import dedupe
    rows = [(i % 50, None if i % 3 else "x", -0.0 if i % 2 else 0.0, [1, None]) for i in range(300)]
    df = spark.createDataFrame(rows, "_a int, _b string, z double, l array<int>")
    want = df.distinct().count()
    for most in (0, 1000):
        dedupe.MOST_REPEATED, kept = most, dedupe.MOST_REPEATED
        try:
            found = dedupe.repeated(df)
            assert (found.rows, found.extra) == (300, 300 - want)
            assert dedupe.without_copies(df, found).count() == want and dedupe.deduplicate(df).columns == df.columns
        finally:
            dedupe.MOST_REPEATED = kept
    alone = spark.range(100)
    assert dedupe.deduplicate(alone) is alone


def test_medians_by_selection(spark):
    import random
    import statistics
    from tabclean.operators.rank import exact_medians
    rnd = random.Random(1)
    groups = {0: [rnd.gauss(0, 1) for _ in range(5001)], 1: [10 ** rnd.uniform(-300, 300) * rnd.choice([1, -1]) for _ in range(4000)], 2: [1.0] * 3000,
              3: [0.0] * 1500 + [1.0] * 1500, 4: [7.5], 5: [1.0, 2.0], 6: [float(rnd.randint(0, 3)) for _ in range(4001)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(0, None), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    for most in (7, 700, 100_000):
        assert exact_medians(df, "g", "v", most=most) == {g: statistics.median(vs) for g, vs in groups.items()}
    assert exact_medians(df.limit(0), "g", "v") == {}


def test_lost_values_steps_and_prompt(spark):
    from tabclean.plans.cleaning import clean
    from tabclean.plans.suggest import request_of, suggest_plans
    from tabclean.operators.profile import profile
    df = spark.createDataFrame([(f"2024-01-{i + 1:02d}" if i else "soon", str(i) if i != 3 else "x", i % 3) for i in range(12)], "d string, n string, k int")
    res = clean(df)
    assert {r["column"]: r["values"] for r in res.lost_df(spark).collect()}.items() >= {"n": 1}.items()
    row = suggest_plans(spark.createDataFrame([("drop duplicates",)], "text string"), "text", profile(df, "x", light=True)).first()
    assert request_of(row).ai_instructions == "drop duplicates"


def test_more_date_layouts(spark):
    from pyspark.sql import functions as F
    from tabclean.functions import to_datetime
    texts = {"Jan 5 2024 10:00": "2024-01-05 10:00:00", "5-Jan-2024": "2024-01-05 00:00:00", "20240105101112": "2024-01-05 10:11:12",
             "2024-01-05 10:11:12.123456789": "2024-01-05 10:11:12.123456", "2024-01-05 10:11:12 PM": "2024-01-05 22:11:12",
             "1/5/24": "2024-01-05 00:00:00", "1/5/99": "1999-01-05 00:00:00", "13/5/24": "2024-05-13 00:00:00", "1/5/2024 9:05 am": "2024-01-05 09:05:00",
             "5-Jan-69": "1969-01-05 00:00:00", "99/99/99": None, "1/5": None, "12345678901234": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", to_datetime(F.col("t")).cast("string")).collect()} == {
        t: None if v is None else v.removesuffix(".000000") for t, v in texts.items()}
