"""Which columns a result is made from, and what masking makes of it."""

from __future__ import annotations

import pytest

from veritab.operators import texts
from veritab.plans import guard, lineage


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a@b.de", "Kiel", 3), (2, None, "call 040 123 456 78", 4), (3, "c@d.de", None, 5)]
    return {"people": spark.createDataFrame(rows, "id int, mail string, city string, tax long"), "visits": spark.createDataFrame([(1, "x"), (1, "y")], "id int, what string")}


M, C, I, W = ("people", "mail"), ("people", "city"), ("people", "id"), ("visits", "what")


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT mail AS m, city || mail, 1 FROM people", [{M}, {M, C}, set()]),
        ("SELECT p.*, what FROM people p JOIN visits USING (id)", [{I}, {M}, {C}, {("people", "tax")}, {W}]),
        ("WITH a AS (SELECT upper(mail) AS u FROM people), b AS (SELECT u FROM a) SELECT u FROM b", [{M}]),
        ("SELECT a.mail, b.city FROM people a JOIN people b ON a.id = b.id + 1", [{M}, {C}]),
        ("SELECT mail FROM people UNION ALL SELECT what FROM visits", [{M, W}]),
        ("SELECT city, max(mail) FROM people GROUP BY city", [{C}, {M}]),
        ("SELECT (SELECT max(mail) FROM people), EXISTS (SELECT mail FROM people) FROM visits", [{M}, {M}]),
        ("SELECT x.m FROM visits v, LATERAL (SELECT max(mail) AS m FROM people p WHERE p.id = v.id) x", [{M}]),
        ("SELECT part FROM people LATERAL VIEW explode(split(mail, '@')) e AS part", [{M}]),
        ("SELECT first_value(mail) OVER (ORDER BY id) FROM people", [{M, I}]),
        ("SELECT city, min(mail) FROM people GROUP BY ROLLUP (city)", [{C}, {M}]),
        ("SELECT v FROM people UNPIVOT (v FOR n IN (mail, city))", [{M, C}]),
        ("SELECT transform(array(mail), x -> x || city) FROM people", [{M, C}]),
        ("SELECT city FROM people WHERE mail LIKE 'a%' ORDER BY mail", [{C}]),
        ("SELECT DISTINCT city FROM people INTERSECT SELECT what FROM visits", [{C}]),
    ],
)
def test_sources(spark, people, sql, want):
    assert [set(s) for s in lineage.sources(guard.guarded(spark, sql, people))] == want


def test_plain_frames_are_known_by_their_columns(people):
    df = people["people"]
    assert [set(s) for s in lineage.sources(df.selectExpr("mail AS m", "length(city) AS n"))] == [{(None, "mail")}, {(None, "city")}]


def test_counts_are_not_the_counted(spark, people):
    found = guard.guarded(spark, "SELECT count(mail), count(DISTINCT mail), max(length(mail)) FROM people", people)
    assert [set(s) for s in lineage.sources(found, counts=False)] == [set(), set(), {M}]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT mail AS city FROM people ORDER BY id", [("<masked>",), (None,), ("<masked>",)]),
        ("SELECT city AS mail FROM people ORDER BY id", [("Kiel",), ("call <phone>",), (None,)]),
        ("SELECT id, id FROM people WHERE id = 1", [(1, 1)]),
        ("SELECT count(*), count(mail), max(tax) FROM people", [(3, 2, "<masked>")]),
        ("SELECT collect_list(mail) AS l, map(1, max(mail)) AS m, 'a@b.de' AS t FROM people", [("<masked>", "<masked>", "<email>")]),
        ("SELECT CASE WHEN mail LIKE 'a%' THEN 'a' ELSE 'b' END FROM people WHERE id = 1", [("<masked>",)]),
    ],
)
def test_masked(spark, people, sql, want):
    assert [tuple(r) for r in texts.masked(guard.guarded(spark, sql, people), {"mail", "PEOPLE.Tax"}).collect()] == want
