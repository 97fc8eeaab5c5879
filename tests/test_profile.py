"""Profile quirks (O-30..O-44)."""

import math

from tabclean.operators.profile import profile


def test_mode_and_counts_on_small_frame(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "b", "a", "c", None]], "t string")
    c = profile(df).columns[0]
    assert c.inferred_type == "text"
    assert c.duplicate_count == 6 - 3 - 1
    assert c.top_values == [("a", 2), ("b", 2), ("c", 1), (None, 1)]
    assert round(c.missing_ratio_exact, 6) == round(1 / 6, 6)


def test_constant_column_is_balanced(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    c = profile(df).columns[0]
    assert c.distribution_hint == "Fairly balanced numeric distribution."
    assert c.numeric_summary[1] == 0.0


def test_one_row_and_zero_row(spark):
    one = profile(spark.createDataFrame([(1.0, "a")], "x double, t string"))
    assert one.rows == 1 and one.columns[0].numeric_summary[1] is None
    zero = profile(spark.createDataFrame([], "x double, t string"))
    assert zero.rows == 0
    assert [c.inferred_type for c in zero.columns] == ["unknown", "unknown"]
    assert [c.missing_ratio for c in zero.columns] == [0.0, 0.0]


def test_all_missing_column(spark):
    p = profile(spark.createDataFrame([(None, 1), (None, 2)], "x string, y int"))
    x = p.columns[0]
    assert x.inferred_type == "unknown" and x.missing_ratio == 1.0
    assert "High missing ratio: more than 80% of values are empty." in x.smart_alerts
    assert p.missing_cells == 2


def test_adjusted_skewness_matches_pandas_rule(spark):
    vals = [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 50.0]
    n = len(vals)
    mean = sum(vals) / n
    m2 = sum((v - mean) ** 2 for v in vals) / n
    m3 = sum((v - mean) ** 3 for v in vals) / n
    g1 = m3 / m2 ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    assert g1 > 1
    c = profile(spark.createDataFrame([(v,) for v in vals], "x double")).columns[0]
    assert c.distribution_hint == "Right-skewed distribution."


def test_boolean_and_id_columns(spark):
    rows = [(i, i % 2 == 0, f"k{i}") for i in range(40)]
    p = profile(spark.createDataFrame(rows, "id bigint, flag boolean, key string"))
    by = p.by_name()
    assert by["flag"].inferred_type == "boolean" and not by["flag"].possible_id
    assert by["id"].possible_id and by["key"].possible_id
    assert p.target_candidates() == ["flag"]
    assert p.suggestions() == ["Consider dropping 'id' because it behaves like an ID column.",
                               "Consider dropping 'key' because it behaves like an ID column."]


def test_whole_row_duplicates_count_null_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "x int, y string")
    assert profile(df).duplicate_rows == 3


def test_column_stats_on_a_wide_table_match_brute_force(spark):
    """F1 is one grouped aggregate whatever the width: 300 columns of mixed kinds."""
    import random

    from tabclean.operators.profile import _profile_view, column_stats

    rnd = random.Random(7)
    width, n = 300, 40
    schema = ", ".join(f"c{i} {'double' if i % 3 else 'string'}" for i in range(width))
    data = []
    for _ in range(n):
        row = []
        for i in range(width):
            if rnd.random() < 0.2:
                row.append(None)
            elif i % 3:
                row.append(float(rnd.randint(-50, 50)))
            else:
                row.append(rnd.choice(["7", " 8.5 ", "x", "2024-01-02", "abc"]))
        data.append(tuple(row))
    df = spark.createDataFrame(data, schema)
    stats = column_stats(_profile_view(df))
    assert stats[("", "rows")] == n
    for i in range(width):
        vals = [r[i] for r in data]
        present = [v for v in vals if v is not None]
        assert stats[(f"c{i}", "nn")] == len(present)
        if i % 3:
            assert stats[(f"c{i}", "min")] == min(present) and stats[(f"c{i}", "max")] == max(present)
            assert math.isclose(stats[(f"c{i}", "mean")], sum(present) / len(present))
        else:
            assert stats[(f"c{i}", "num")] == sum(1 for v in present if v.strip() in ("7", "8.5"))
            assert stats[(f"c{i}", "dt")] == sum(1 for v in present if v == "2024-01-02")


def test_widen_only_spreads_narrow_inputs(spark):
    from tabclean.sources.tables import widen

    cores = spark.sparkContext.defaultParallelism
    narrow = spark.range(100).coalesce(1)
    assert widen(narrow).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores * 2)
    assert widen(wide) is wide
