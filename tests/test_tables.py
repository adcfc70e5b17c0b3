"""The profile of whole tables: facts, warnings, and how often the table is read."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veritab import registry
from veritab.operators import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def visits(spark):
    rows = [
        (i, f"P{i:03}", "yes" if i % 3 else "no", None if i % 4 == 0 else float(i % 10), -999 if i in (5, 6) else 40 + i % 14, "DE" if i else "FR", f"{150 + i} cm", " " if i == 1 else "some words that go on", None, i % 2 == 0, dt.date(2024, 1, 1) + dt.timedelta(7 * i if i < 20 else 7 * (i + 3)))
        for i in range(40)
    ]
    return spark.createDataFrame(rows, "row int, person_id string, agreed string, score double, age int, country string, height string, note string, nothing string, flag boolean, day date")


@pytest.fixture(scope="module")
def facts(visits):
    return {r["column"]: r for r in tables.profile_table(visits, "row").collect()}


def test_meanings(facts):
    want = {"row": "numeric", "person_id": "identifier", "agreed": "boolean", "score": "numeric", "age": "numeric", "country": "categorical", "nothing": "constant", "flag": "boolean", "day": "datetime", "note": "categorical"}
    assert {c: facts[c]["semantic_type"] for c in want} == want


def test_numbers(facts):
    age = facts["age"]
    assert (age["n_finite"], age["min"], age["max"], age["negatives"]) == (40, -999.0, 53.0, 2)
    assert [tuple(s) for s in age["sentinels"]] == [(-999.0, 2)] and age["n_outside"] == 2 and sum(age["histogram"]) == 40 and age["histogram"][0] == 2
    assert (facts["score"]["missing"], facts["score"]["n_finite"], facts["score"]["median"]) == (10, 30, 5.0)
    assert facts["nothing"]["n_finite"] is None and facts["note"]["mean"] is None


def test_dates_texts_and_categories(facts):
    day = facts["day"]
    assert (day["granularity"], day["period"], day["periods"], day["empty_periods"]) == ("weekly", "week", 43, 3)
    assert facts["height"]["unit_share"] == 1.0 and [tuple(u) for u in facts["height"]["units"]] == [("cm", 40)]
    assert facts["note"]["blank"] == 1 and facts["note"]["max_length"] == 21
    assert [tuple(v) for v in facts["country"]["top"]] == [("DE", 39), ("FR", 1)] and facts["country"]["imbalance_ratio"] == 39 and facts["row"]["top"][0]["n"] == 1


def test_warnings_and_keys(visits):
    profile = tables.profile_table(visits)
    found = {(r["column"], r["code"], r["severity"]) for r in tables.profile_warnings(profile).collect()}
    assert found == {
        ("person_id", "identifier", "info"), ("score", "high_missing", "warning"), ("age", "placeholder_value", "warning"), ("country", "imbalance", "warning"),
        ("height", "numeric_with_unit", "info"), ("note", "blank_strings", "info"), ("note", "imbalance", "warning"), ("nothing", "empty_column", "severe"), ("day", "date_gaps", "warning"),
    }
    row = tables.table_facts(profile).first()
    assert (row["columns"], row["cells"], row["missing_cells"], row["keys"]) == (11, 440, 50, ["person_id"])


def test_every_rule_fires_on_a_messy_export(spark):
    found = registry.QUERIES["profile_warnings_events"](spark, SF).collect()
    codes = "high_missing constant identifier imbalance placeholder_value date_gaps unit_shift mixed_units numeric_with_unit blank_strings empty_column"
    assert {r["code"] for r in found} == set(codes.split()) and ("weight", "unit_shift") in {(r["column"], r["code"]) for r in found}


def test_a_table_is_scanned_once_and_once_more_in_order(spark, monkeypatch):
    """What is written on the way is read again; the table itself is not."""
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    scans = []
    for name in ("written",):
        real = tables.written
        monkeypatch.setattr(tables, name, lambda d, label: (scans.append(d._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate#")), real(d, label))[1])
    left = tables.profile_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate#" not in left and sum(n > 0 for n in scans) == 1


def test_odd_tables(spark):
    empty = tables.profile_table(spark.createDataFrame([], "a int, b string, c date, d array<int>")).collect()
    assert [(r["rows"], r["semantic_type"], r["n_distinct"]) for r in empty] == [(0, "constant", 0)] * 4
    rows = spark.createDataFrame([(float("nan"), "x" * 500, [1]), (float("inf"), "x" * 500, [2]), (None, "y", None), (1.0, None, [1])], "v double, t string, a array<int>")
    found = {r["column"]: r for r in tables.profile_table(rows).collect()}
    assert (found["v"]["n_finite"], found["v"]["min"], found["v"]["histogram"], found["v"]["stddev"]) == (1, 1.0, [1], None)
    assert (found["t"]["n_distinct"], found["t"]["max_length"]) == (2, 500) and found["t"]["top"][0]["value"].startswith("sha256:")
    assert found["a"]["kind"] == "other" and (found["a"]["missing"], found["a"]["n_distinct"]) == (1, 2)


def test_values_are_counted_before_their_facts_are_made(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    counted = tables.cells(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(counted) if "Aggregate" in line)
    facts_of_short_texts = [i for i, line in enumerate(counted) if "regexp_extract" in line and "octet_length" not in line]
    assert facts_of_short_texts and max(facts_of_short_texts) <= at
    assert "SortAggregate" not in tables._counts(tables.cells(df))._jdf.queryExecution().executedPlan().toString()


def test_values_of_every_type_stay_apart(spark):
    types = "a double, b float, c decimal(20,2), d timestamp, e timestamp_ntz, f long, g date"
    row = lambda a, b, c, d, f: (a, b, Decimal(c), d, d, f, d.date())
    noon, midnight = dt.datetime(2024, 1, 2, 12, 0, 0, 5), dt.datetime(2024, 1, 2)
    rows = [row(0.0, 0.1, "900719925474099.01", noon, 2**53), row(-0.0, 0.1, "900719925474099.02", midnight, 2**53 + 1), row(float("nan"), 1.5, "1.00", midnight, 3), row(float("nan"), float("inf"), "1.00", noon, 3)]
    found = {r["column"]: {v["value"]: v["n"] for v in r["top"] or []} | {"n": r["n_distinct"]} for r in tables.profile_table(spark.createDataFrame(rows, types)).collect()}
    assert found["a"] == {"0.0": 1, "-0.0": 1, "NaN": 2, "n": 3} and found["b"] == {"0.1": 2, "1.5": 1, "Infinity": 1, "n": 3}
    assert found["c"] == {"900719925474099.01": 1, "900719925474099.02": 1, "1.00": 2, "n": 3} and found["f"] == {str(2**53): 1, str(2**53 + 1): 1, "3": 2, "n": 3}
    assert [found[c]["n"] for c in "deg"] == [2, 2, 1]
    times = {r["col"]: (r["value"], r["timed"]) for r in tables.cells(spark.createDataFrame(rows, types).where("hour(d) = 12").limit(1)).where("col in (3, 4)").collect()}
    assert times == {c: ("2024-01-02 12:00:00.000005", True) for c in (3, 4)}


def test_a_row_is_cut_into_ranges_once_for_all_columns(spark, monkeypatch):
    from veritab.operators import profile, ranks

    df = spark.range(700).select("id", *((F.when(F.col("id") % k > 0, 1 + F.col("id") % 5) * F.when(F.col("id") >= 420, 3).otherwise(1)).alias(f"x{k}") for k in (2, 3, 7)))
    seen = []
    for module in (tables, profile, ranks):
        monkeypatch.setattr(module, "written", lambda d, label, real=ranks.written: (seen.append(real(d, label)), seen[-1])[1])
    found = {r["column"]: r["shift"] for r in tables.profile_table(df, "id").select("column", "shift").collect()}
    assert found["id"] is None and all(found[f"x{k}"]["ratio"] == 3 for k in (2, 3, 7))
    assert [d.count() for d in seen if "position" in d.columns] == [700]
