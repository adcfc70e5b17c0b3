"""Statistics on hand-computed tables and p-values against published ones."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.operators import combine, insights, profile, ranks, stats


def test_cramers_v(spark):
    rows = [(a, b) for a, b, n in [("x", "p", 10), ("x", "q", 20), ("y", "p", 30), ("y", "q", 40)] for _ in range(n)]
    found = stats.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert found["n"] == 100 and found["v"] == pytest.approx(0.0891, abs=1e-4)


def test_perfect_association(spark):
    found = stats.chi_square(spark.createDataFrame([("a", "b")] * 10 + [("c", "d")] * 10, "a string, b string"), "a", "b").first()
    assert found["chi2"] == pytest.approx(20) and found["v"] == pytest.approx(1)


def test_infinite_values_count_as_none(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    r = profile.numeric_summary(df, ["x"]).first()
    assert (r["n"], r["mean"], r["median"], r["max"]) == (2, 1.5, 1.5, 2.0)


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None)
def test_quantiles_equal_numpy(spark, rows):
    found = ranks.quantiles(spark.createDataFrame(rows, "k string, v int"), "k", "v", [0.0, 0.1, 0.5, 0.95, 1.0])
    for r in found.collect():
        values = [v for k, v in rows if k == r["k"]]
        assert r["n"] == len(values) and r["q"] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.95, 1.0]).tolist())


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-4, 4)), min_size=8, max_size=60))
@settings(max_examples=6, deadline=None)
def test_kendall_equals_brute_force(spark, rows):
    sign = lambda a: (a > 0) - (a < 0)
    s = sum(sign(b[0] - a[0]) * sign(b[1] - a[1]) for a, b in combinations(rows, 2))
    assert stats.kendall_trend(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()["s"] == s


def test_tests_by_name(spark):
    rows = [("ab"[i % 2], float(i + 40 * (i % 2)), f"2024-01-{i + 1:02d}", "xy"[i % 3 > 0]) for i in range(28)]
    df = spark.createDataFrame(rows, "g string, v double, day string, h string")
    assert stats.run_test(df, "mann_whitney", "v", "g").effect == pytest.approx(-1.0) and stats.run_test(df, "mann_whitney", "v", "g").p_value < 1e-4
    assert stats.run_test(df, "trend", "day", "v").n == 28 and stats.run_test(df.withColumn("day", F.to_date("day")), "trend", "day", "v").p_value < 0.1
    assert stats.run_test(df.limit(3), "spearman", "v", "v").error and stats.run_test(df, "mann_whitney", "v", "day").error and stats.run_test(df, "nothing", "v", "g").error
    assert stats.run_test(df, "chi_square", "g", "h").error is None and stats.run_test(df, "kruskal_wallis", "v", "h").p_value <= 1


def test_planted_relations(spark):
    """400 rows by formula: a copy, a label, a missing value that depends on the group, a shift of units, mixed units."""
    rows = []
    for i in range(1, 401):
        grp = "A" if i % 2 == 0 else "B"
        income = None if grp == "A" and i % 4 == 0 else 1000 + 7 * i
        rows.append((i, grp, income, income, i % 3, "xyz"[i % 3], (50.0 + i % 5) * (2.2046 if i > 200 else 1), "67 in" if i % 5 == 0 else "170 cm"))
    df = spark.createDataFrame(rows, "id long, grp string, income long, copy long, outcome int, label string, weight double, height string")
    assert profile.equal_shares(df, [("income", "copy")]).first()["share"] == 1.0
    assert stats.chi_square(df, "outcome", "label", 20).first()["v"] == pytest.approx(1.0)
    found = {r["by"]: r for r in insights.missing_dependencies(df, ["income"], ["grp", "label"], ["weight"]).collect()}
    assert found["grp"]["strength"] == pytest.approx(20000 / math.sqrt(200 * 200 * 100 * 300)) and (found["grp"]["highest"], found["grp"]["lowest"]) == ("A", "B") and set(found) == {"grp"}
    assert stats.co_missing(df, "income", "copy").first()["phi"] == pytest.approx(1.0)
    shift = profile.unit_shift(df, "weight", "id").first()
    assert shift["from_position"] == 201 and shift["ratio"] == pytest.approx(2.2046, rel=0.01)
    assert [tuple(r) for r in profile.unit_histogram(df, "height").collect()] == [("cm", 320), ("in", 80)]


@pytest.mark.parametrize("step, count, want", [("week", 11, ("weekly", "week")), ("day", 60, ("daily", "day")), ("month", 30, ("monthly", "month")), ("year", 30, ("yearly", "year")), ("day", 1, ("single date", "day"))])
def test_periods_follow_span_and_granularity(spark, step, count, want):
    days = spark.sql(f"SELECT explode(sequence(date'2000-01-03', date'2000-01-03' + interval '{count - 1}' {step}, interval 1 {step})) AS d")
    found = profile.date_profile(days, "d").first()
    assert (found["granularity"], found["period"]) == want


def test_power():
    from pyspark.sql import SparkSession

    row = SparkSession.getActiveSession().range(1).select(
        stats.detectable_difference(F.lit(64), F.lit(64)).alias("d"), stats.detectable_correlation(F.lit(85)).alias("r"), stats.margin_of_error(F.lit(100)).alias("m")
    ).first()
    assert (row["d"], row["r"], row["m"]) == (pytest.approx(0.495, abs=1e-3), pytest.approx(0.30, abs=5e-3), pytest.approx(0.098, abs=1e-3))


def test_samples_are_fixed(spark):
    df = spark.range(1000)
    a, b = (insights.sampled(df.repartition(k), 50, 42, "id").collect() for k in (3, 7))
    assert sorted(a) == sorted(b) and len(a) == 50 and insights.sampled(df.limit(5), 50, 42).count() == 5


def test_correlation_ratio(spark):
    rows = [("a", v) for v in (1, 2, 3)] * 4 + [("b", v) for v in (4, 5, 6)] * 4
    assert stats.correlation_ratio(spark.createDataFrame(rows, "g string, v int"), "g", "v").first()["eta"] == pytest.approx(math.sqrt(54 / 70))


def test_kruskal_effect(spark):
    rows = [("a", v) for v in range(1, 5)] + [("b", v) for v in range(3, 7)] + [("c", v) for v in range(7, 11)]
    found = stats.kruskal_wallis(spark.createDataFrame(rows, "g string, v int"), "v", "g").first()
    assert found["effect"] == pytest.approx(found["h"] / 11) and found["k"] == 3


def test_trend_of_an_increasing_series(spark):
    assert stats.kendall_trend(spark.range(10).selectExpr("id as x", "id as y"), "x", "y").first()["tau"] == pytest.approx(1)


@pytest.mark.parametrize(
    "found, wanted",
    [
        (lambda: stats.chi_square_p(244.890542, 2), 6.648053e-54),
        (lambda: stats.spearman_p(0.5, 20), 0.0248),
        (lambda: stats.chi_square_p(3.841459, 1), 0.05),
    ],
)
def test_p_values(found, wanted):
    assert found() == pytest.approx(wanted, rel=2e-3)


def test_text_keys_and_name_clash(spark):
    left = spark.createDataFrame([(10, "1", "x"), (12, "9", "y")], "order_id int, customer_id string, city string")
    right = spark.createDataFrame([(1, "Ann", "z")], "id int, name string, city string")
    joined = combine.join_on_text(left, right, "customer_id", "id", right_name="customers")
    assert joined.columns == ["order_id", "customer_id", "city", "name", "customers_city"]
    assert joined.where("name is not null").count() == 1


def test_names_match():
    assert combine.names_match("orders", "customer_id", "customers", "id")
    assert not combine.names_match("a", "id", "b", "id")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x double, d date")
    assert profile.histogram(empty, "x").count() == 0
    assert profile.period_counts(empty, "d", "day").count() == 0
    assert profile.numeric_summary(empty, ["x"]).first()["n"] == 0
