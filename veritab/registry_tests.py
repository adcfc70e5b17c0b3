"""Registered queries over many tests at once, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import battery
from .registry import Read, query, rounded

_TESTS = [
    ("spearman", "dose", "response"), ("mann_whitney", "response", "half"), ("kruskal_wallis", "response", "o_orderstatus"), ("chi_square", "band", "half"), ("trend", "o_orderdate", "response"),
]
#: A dose and a response that fall together within a priority and rise together over all of them.
_PLANTED = {
    "dose": "o_custkey % 100 + 100 * CAST(left(o_orderpriority, 1) AS INT)",
    "response": "500 * CAST(left(o_orderpriority, 1) AS INT) - (o_custkey % 100) + floor(o_totalprice / 10000)",
    "half": "CASE WHEN o_custkey % 100 < 50 THEN 'even' ELSE 'odd' END",
    "band": "CAST(CAST(floor((o_custkey % 100 + floor(o_totalprice / 10000)) / 40) AS INT) AS STRING)",
}
#: Every order twice: once for the whole, once within its priority; average ranks of price, customer and time.
_RANKED = f"""
WITH o AS (SELECT {_PLANTED["dose"]} AS c, {_PLANTED["response"]} AS p, o_orderdate AS d, o_orderstatus AS s, {_PLANTED["half"]} AS half, {_PLANTED["band"]} AS band, o_orderpriority AS level FROM orders),
w AS (SELECT * FROM o UNION ALL SELECT * REPLACE (NULL AS level) FROM o),
r AS (SELECT *, rank() OVER (PARTITION BY level ORDER BY p) + (count(*) OVER (PARTITION BY level, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY level ORDER BY c) + (count(*) OVER (PARTITION BY level, c) - 1) / 2.0 AS rc FROM w),
ties AS (SELECT level, sum(t * t * t - t) AS tie FROM (SELECT level, p, CAST(count(*) AS DOUBLE) AS t FROM w GROUP BY ALL) GROUP BY level),
u AS (SELECT level, count(*) AS n, CAST(count(*) FILTER (half = 'even') AS DOUBLE) AS n1, sum(rp) FILTER (half = 'even') AS r1 FROM r GROUP BY level),
g AS (SELECT level, s, CAST(count(*) AS DOUBLE) AS n, sum(rp) AS rs FROM r GROUP BY ALL),
h AS (SELECT level, sum(n) AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)) / (1 - any_value(tie) / (sum(n) ** 3 - sum(n))) AS h FROM g JOIN ties USING (level) WHERE level IS NOT NULL GROUP BY level
  UNION ALL SELECT NULL, sum(n), (12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)) / (1 - (SELECT tie FROM ties WHERE level IS NULL) / (sum(n) ** 3 - sum(n))) FROM g WHERE level IS NULL),
k AS (SELECT *, sum(o) OVER (PARTITION BY level, band) AS a, sum(o) OVER (PARTITION BY level, half) AS b FROM (SELECT level, band, half, CAST(count(*) AS DOUBLE) AS o FROM w GROUP BY ALL)),
q AS (SELECT level, sum(o) AS n, sum(o) * (sum(o * o / (a * b)) - 1) AS chi2, least(count(DISTINCT band), count(DISTINCT half)) AS side FROM k GROUP BY level),
pairs AS (SELECT x.level, sum(sign(epoch_us(x.d) - epoch_us(y.d)) * sign(x.p - y.p)) / 2 AS s FROM w x JOIN w y ON x.level IS NOT DISTINCT FROM y.level GROUP BY 1),
tp AS (SELECT level, sum(t * (t - 1) / 2) AS t FROM (SELECT level, p, count(*) AS t FROM w GROUP BY ALL) GROUP BY level),
td AS (SELECT level, sum(t * (t - 1) / 2) AS t FROM (SELECT level, d, count(*) AS t FROM w GROUP BY ALL) GROUP BY level),
tau AS (SELECT u.level, u.n, pairs.s / sqrt((CAST(u.n AS DOUBLE) * (u.n - 1) / 2 - tp.t) * (CAST(u.n AS DOUBLE) * (u.n - 1) / 2 - td.t)) AS tau
  FROM u JOIN pairs ON pairs.level IS NOT DISTINCT FROM u.level JOIN tp ON tp.level IS NOT DISTINCT FROM u.level JOIN td ON td.level IS NOT DISTINCT FROM u.level),
found AS (
  SELECT 'spearman' AS test, level, count(*) AS n, corr(rc, rp) AS statistic, corr(rc, rp) AS effect FROM r GROUP BY level
  UNION ALL SELECT 'mann_whitney', level, n, r1 - n1 * (n1 + 1) / 2, 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) - 1 FROM u
  UNION ALL SELECT 'kruskal_wallis', level, n, h, h / (n - 1) FROM h
  UNION ALL SELECT 'chi_square', level, n, chi2, sqrt(chi2 / (n * (side - 1))) FROM q
  UNION ALL SELECT 'trend', level, n, tau, tau FROM tau
)
"""


def _results(t: Read) -> DataFrame:
    orders = t("orders").withColumns({c: F.expr(e) for c, e in _PLANTED.items()})
    return battery.run_tests(orders, [battery.Spec(*s) for s in _TESTS] + [battery.Spec(*s, "o_orderpriority") for s in _TESTS])


@query(f"{_RANKED} SELECT test, level, CAST(n AS BIGINT) AS n, round(statistic, 5) AS statistic, round(effect, 6) AS effect FROM found")
def tests_by_stratum_orders(t: Read) -> DataFrame:
    """Five tests over all orders and within every priority, from one scan."""
    found = _results(t)
    return found.select("test", "level", "n", F.round("statistic", 5).alias("statistic"), F.round("effect", 6).alias("effect"))


@query(f"""{_RANKED}, crude AS (SELECT test, effect AS crude FROM found WHERE level IS NULL),
judged AS (
  SELECT test, any_value(crude) AS effect, count(*) FILTER (n >= 30) AS strata, sum(abs(f.effect) * n) FILTER (n >= 30) / sum(n) FILTER (n >= 30) AS mean_effect,
         bool_or(n >= 30 AND f.effect * crude < 0 AND abs(f.effect) >= 0.1) AND test IN ('spearman', 'mann_whitney', 'trend') AS turned
  FROM found f JOIN crude USING (test) WHERE level IS NOT NULL GROUP BY test
)
SELECT test, round(effect, 6) AS effect, strata, round(mean_effect, 6) AS mean_effect,
       CASE WHEN strata < 2 THEN 'unclear' WHEN turned THEN 'reverses' WHEN abs(effect) > 0 AND mean_effect < 0.5 * abs(effect) THEN 'weakens' ELSE 'holds' END AS verdict
FROM judged""")
def effects_within_strata_orders(t: Read) -> DataFrame:
    """Whether the five effects hold within priorities."""
    return rounded(battery.within_strata(_results(t)).select("test", "effect", "strata", "mean_effect", "verdict"))
