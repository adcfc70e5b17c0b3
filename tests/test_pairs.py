"""All pairs of columns at once against one pair at a time."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from veritab.operators import insights, pairs, stats


@pytest.fixture(scope="module")
def survey(spark):
    random.seed(2)
    rows = []
    for i in range(400):
        base = random.gauss(0, 1)
        grp = random.choice("abc")
        rows.append((base, round(base + random.gauss(0, 1), 1), 1 if i % 3 else 7, None if i % 5 == 0 else base * -2, float("nan") if i % 7 == 0 else float(i), 3.0, grp, None if i % 4 == 0 else grp + "x", "same", str(i)))
    return spark.createDataFrame(rows, "u double, v double, hot int, gap double, odd double, flat double, grp string, label string, one string, id string")


NUMBERS, CATEGORIES = ["u", "v", "hot", "gap", "odd", "flat"], ["grp", "label", "one", "id"]


def test_all_pairs_equal_one_by_one(survey):
    found = {(r["a"], r["b"]): r for r in pairs.rank_correlations(survey, NUMBERS).collect() if r["value"] is not None}
    for a, b in combinations(NUMBERS, 2):
        one = stats.spearman(survey, a, b).first()
        if one["rho"] is None:
            assert (a, b) not in found
        else:
            assert (found[a, b]["n"], found[a, b]["value"]) == (one["n"], pytest.approx(one["rho"], abs=1e-9))
    found = {(r["a"], r["b"]): r for r in pairs.category_associations(survey, CATEGORIES).collect() if r["value"] is not None}
    wanted = {(a, b): stats.chi_square(survey, a, b, stats.PAIR_ROWS).first() for a, b in combinations(CATEGORIES, 2)}
    assert {k: (r["n"], pytest.approx(r["value"], abs=1e-9)) for k, r in found.items()} == {k: (r["n"], r["v"]) for k, r in wanted.items() if r["v"] is not None}
    found = {(r["a"], r["b"]): r["value"] for r in pairs.correlation_ratios(survey, CATEGORIES, NUMBERS).collect() if r["value"] is not None}
    wanted = {(c, x): stats.correlation_ratio(survey, c, x).first()["eta"] for c in CATEGORIES for x in NUMBERS}
    assert {k: pytest.approx(v, abs=1e-9) for k, v in found.items()} == {k: v for k, v in wanted.items() if v is not None}


def test_more_columns_take_no_more_scans(spark, survey, monkeypatch):
    def scans(numbers, categories):
        seen = []
        for module in (pairs, pairs.battery):
            real = module.written
            monkeypatch.setattr(module, "written", lambda d, label, real=real: (seen.append(d._jdf.queryExecution().optimizedPlan().toString()), real(d, label))[1])
        left = insights.pairwise_associations(survey, numbers, categories)._jdf.queryExecution().optimizedPlan().toString()
        monkeypatch.undo()
        return sum("LogicalRDD" in p for p in [*seen, left])

    assert scans(["u", "v", "gap"], ["grp", "label"]) == scans(NUMBERS, CATEGORIES)


def test_few_rows_and_columns(spark, survey):
    assert pairs.rank_correlations(survey.limit(10), ["u", "v"]).count() == 0 and pairs.rank_correlations(survey, ["u"]).count() == 0
    assert insights.pairwise_associations(survey.limit(0), NUMBERS, CATEGORIES).count() == 0
    assert pairs.category_associations(survey, ["grp"]).count() == 0 and pairs.correlation_ratios(survey, [], NUMBERS).count() == 0
