"""Running sums by ranges: right with repeated values and keys, and with work for a row that does not grow with the ranges."""

from __future__ import annotations

import random
import statistics
from collections import Counter

from pyspark.sql import functions as F

from veritab.operators import profile, ranks, stats


def test_running_sums_of_repeated_values_within_keys(spark):
    random.seed(4)
    rows = [(random.choice("ab"), float(random.randint(-9, 9)), random.randint(0, 5)) for _ in range(300)]
    counts = spark.createDataFrame(rows, "k string, v double, n long").repartition(5)
    found = ranks.with_running(counts, ["k"], "v", ["n"]).select("k", "v", "n", "before_n", "same_n").collect()
    assert Counter((r["k"], r["v"], r["n"]) for r in found) == Counter(rows)
    for r in found:
        assert r["before_n"] == sum(n for k, v, n in rows if k == r["k"] and v < r["v"])
        assert r["same_n"] == sum(n for k, v, n in rows if k == r["k"] and v == r["v"])


def test_expressions_do_not_grow_with_the_values(spark):
    def size(n):
        rows = spark.range(n).select(F.col("id").alias("r"), (F.col("id") * 7 % 1000003).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
        made = [profile.chunk_medians(rows, "x", "r"), profile.unit_shift(rows, "x", "r"), stats.mann_whitney(rows, "x", "g"), stats.value_ranks(rows, "x")]
        return [df._jdf.queryExecution().optimizedPlan().toString().count(" > ") for df in made]

    assert size(300_000) == size(300)


def test_mann_whitney_with_many_values_in_many_ranges(spark):
    rows = spark.range(200_000).select(F.pmod(F.col("id") * 7919, F.lit(150_001)).alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    x = [(i * 7919) % 150_001 for i in range(200_000)]
    ties = Counter(x)
    place, at = {}, 0
    for v in sorted(ties):
        place[v] = at + (ties[v] + 1) / 2
        at += ties[v]
    n = len(range(0, 200_000, 3))
    u = sum(place[v] for v in x[::3]) - n * (n + 1) / 2
    found = stats.mann_whitney(rows, "x", "g").first()
    assert (found["first_group"], found["n1"], found["u"], found["tie_term"]) == ("a", n, u, sum(t**3 - t for t in ties.values()))


def test_chunks_put_only_the_ranges_in_order_where_they_begin(spark, monkeypatch):
    random.seed(5)
    rows = [(p, float(p % 97) if p % 3 else None, float(p % 89), float("nan")) for p in random.sample(range(10**9), 4003)]
    df = spark.createDataFrame(rows, "p long, x double, y double, z double")
    seen = []
    for module in (profile, ranks):
        monkeypatch.setattr(module, "written", lambda d, label, real=ranks.written: (seen.append((label, d)), real(d, label))[1])
    found = {(r["col"], r["chunk"]): (r["rows"], r["first_position"], r["median"]) for r in profile.chunk_medians_of(df, ["x", "y", "z"], "p").collect()}
    want = {}
    for col, values in enumerate([[(p, x) for p, x, _, _ in sorted(rows) if x is not None], [(p, y) for p, _, y, _ in sorted(rows)]]):
        at = 0
        for k in range(10):
            size = len(values) // 10 + (k < len(values) % 10)
            chunk = values[at : at + size]
            want[col, k + 1] = (size, chunk[0][0], statistics.median(v for _, v in chunk))
            at += size
    assert found == want
    assert {d.count() for label, d in seen if label == "positions"} == {4003}  # rows are cut into ranges once for all columns
    assert all(d.count() <= 30 for label, d in seen if "row_number" in d._jdf.queryExecution().optimizedPlan().toString())
    few = profile.chunk_medians(df.orderBy("p").limit(3), "y", "p").collect()
    assert sorted((r["chunk"], r["rows"]) for r in few) == [(1, 1), (2, 1), (3, 1)]
    assert profile.chunk_medians(df, "z", "p").collect() == []


def test_quantiles_of_several_counts_of_a_value(spark):
    counts = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.0, 2), ("a", 5.0, 1), ("b", 7.0, 1)], "k string, v double, n long")
    found = {r["k"]: (r["n"], r["q"]) for r in ranks.quantiles_of_counts(counts, "k", "v", [0.0, 0.5, 0.75, 1.0]).collect()}
    assert found == {"a": (7, [1.0, 2.0, 2.0, 5.0]), "b": (1, [7.0] * 4)}


def test_unit_shift_puts_no_row_in_order_but_where_chunks_begin(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("r"), (F.lit(50) + F.col("id") % 7 + F.when(F.col("id") >= 3000, 100).otherwise(0)).alias("x"))
    seen = []
    monkeypatch.setattr(ranks, "written", lambda d, label, real=ranks.written: (seen.append(label), real(d, label))[1])
    assert tuple(profile.unit_shift(rows, "x", "r").first()) == (3000, 153 / 53, 53.0, 153.0)
    assert "running" not in seen
