"""The registered queries and their SQL oracles.

Each query applies operators to whole test tables; its oracle is independent DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as text_functions
from .operators import combine, insights, profile, ranks, records, stats, texts
from .plans import guard
from .plans import verdict as verdicts
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Read = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Register a function of a table reader under its own name."""

    def add(function: Callable[[Read], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


def _summary_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(x) AS n, round(min(x), 6) AS "min", round(max(x), 6) AS "max", round(avg(x), 6) AS mean, round(median(x), 6) AS median,
 round(stddev_samp(x), 6) AS stddev, round(skewness(x), 6) AS skewness, count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x < 0) AS negatives,
 round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95
 FROM (SELECT CAST({column} AS DOUBLE) AS x FROM lineitem)"""


@query(" UNION ALL ".join(map(_summary_sql, _NUMERIC)))
def profile_numeric_lineitem(t: Read) -> DataFrame:
    return rounded(profile.numeric_summary(t("lineitem"), _NUMERIC))


_FENCES = "(SELECT q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v))"


@query(f"WITH v AS (SELECT o_totalprice AS x FROM orders) SELECT round(low_fence, 6) AS low_fence, round(high_fence, 6) AS high_fence, count(x) AS n, count(*) FILTER (WHERE x < low_fence OR x > high_fence) AS n_outside FROM v, {_FENCES} GROUP BY ALL")
def profile_outliers(t: Read) -> DataFrame:
    return rounded(profile.outliers(t("orders"), "o_totalprice"))


@query(f"WITH v AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -999999.0 ELSE o_totalprice END AS x FROM orders) SELECT x AS code, count(*) AS n FROM v, {_FENCES} WHERE x IN (-999999.0, -1.0) AND (x < low_fence OR x > high_fence) GROUP BY x HAVING count(*) >= 2")
def profile_sentinels(t: Read) -> DataFrame:
    rows = t("orders").select(F.when(F.col("o_orderkey") % 50 == 0, F.lit(-999999.0)).otherwise(F.col("o_totalprice")).alias("x"))
    return profile.sentinels(rows, "x", [-999999.0, -1.0])


@query("WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, count(*) AS n FROM orders, b GROUP BY 1) SELECT CAST(r.range AS BIGINT) AS bin, coalesce(n, 0) AS n FROM range(20) r LEFT JOIN c ON c.bin = r.range")
def histogram_totalprice(t: Read) -> DataFrame:
    return profile.histogram(t("orders"), "o_totalprice")


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(o_orderpriority) FROM orders), 6) AS share FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values_priority(t: Read) -> DataFrame:
    return rounded(profile.top_values(t("orders"), "o_orderpriority"))


@query("SELECT count(*) AS n_distinct, count(*) FILTER (WHERE n < 0.01 * total) AS n_rare, round(max(n) / any_value(total), 6) AS top_share, round(max(n) / min(n), 6) AS imbalance_ratio FROM (SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1), (SELECT count(p_brand) AS total FROM part)")
def category_stats_brand(t: Read) -> DataFrame:
    return rounded(profile.category_stats(t("part"), "p_brand"))


def _text_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(min(length({column})) AS BIGINT) AS min_length, round(avg(length({column})), 6) AS avg_length, CAST(max(length({column})) AS BIGINT) AS max_length,
 count(*) FILTER (WHERE w = '') AS blank, round(avg(CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END), 6) AS avg_words
 FROM (SELECT {column}, trim(regexp_replace({column}, '[ \\t\\r\\n]+', ' ', 'g')) AS w FROM documents)"""


@query(" UNION ALL ".join(map(_text_sql, ["text", "lang", "source"])))
def text_stats_documents(t: Read) -> DataFrame:
    return rounded(profile.text_stats(t("documents"), ["text", "lang", "source"]))


_UNIT = "CASE p_partkey % 5 WHEN 0 THEN ' in' WHEN 1 THEN '°C' WHEN 2 THEN ' m/s²' WHEN 3 THEN '' ELSE ' cm' END"


@query(f"SELECT regexp_extract(trim(h), '^[-+]?[0-9]*[.,]?[0-9]+\\s*([A-Za-z%°µ][A-Za-z%°µ/²³0-9]*)$', 1) AS unit, count(*) AS n FROM (SELECT p_size || {_UNIT} AS h FROM part) GROUP BY 1 HAVING unit <> '' ORDER BY n DESC, unit LIMIT 50")
def unit_histogram_part(t: Read) -> DataFrame:
    return profile.unit_histogram(t("part").select(F.expr(f"cast(p_size as string) || {_UNIT}").alias("h")), "h")


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM d) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 1")
def date_gaps_orders(t: Read) -> DataFrame:
    return profile.modal_gap(t("orders"), "o_orderdate")


@query("WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM c) SELECT s.period, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (period)")
def period_counts_orders(t: Read) -> DataFrame:
    return profile.period_counts(t("orders"), "o_orderdate", "month")


@query("SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS duplicates FROM documents")
def duplicate_rows_documents(t: Read) -> DataFrame:
    return profile.duplicate_rows(t("documents"))


@query("WITH d AS (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT * REPLACE (NULL AS lang) FROM documents WHERE doc_id % 9 = 0) SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates FROM d")
def duplicate_rows_copied(t: Read) -> DataFrame:
    """Documents with copies, and with others that differ in a null alone."""
    docs = t("documents")
    changed = docs.where("doc_id % 9 = 0").withColumn("lang", F.lit(None).cast("string"))
    return profile.duplicate_rows(docs.union(docs.where("doc_id % 7 = 0")).union(changed))


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness FROM customer" for c in _CUSTOMER))
def column_counts_customer(t: Read) -> DataFrame:
    return rounded(profile.column_counts(t("customer"), _CUSTOMER))


@query("SELECT 'c_name' AS \"column\" FROM customer HAVING count(*) = count(DISTINCT c_name) AND count(*) = count(c_name) AND avg(len(string_split(trim(c_name), ' '))) <= 1.5 UNION ALL SELECT 'c_mktsegment' FROM customer HAVING count(*) = count(DISTINCT c_mktsegment)")
def candidate_keys_customer(t: Read) -> DataFrame:
    return profile.candidate_keys(t("customer"), _CUSTOMER)


@query("SELECT 'email' AS kind, round(avg(CAST(regexp_full_match(m, '[A-Za-z0-9._%+#-]+@[A-Za-z0-9.-]+') AS DOUBLE)), 6) AS rate FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '@x.org' END AS m FROM customer) UNION ALL SELECT 'digits', round(avg(CAST(regexp_full_match(m, '[0-9]+') AS DOUBLE)), 6) FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '@x.org' END AS m FROM customer)")
def pii_rates_customer(t: Read) -> DataFrame:
    mail = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@x.org")))
    return rounded(profile.match_rates(t("customer").select(mail.alias("m")), "m", {"email": "[A-Za-z0-9._%+#-]+@[A-Za-z0-9.-]+", "digits": "[0-9]+"}))


@query("SELECT 'l_discount' AS a, 'copy' AS b, round(avg(CAST(l_discount IS NOT DISTINCT FROM CASE WHEN l_orderkey % 100 = 0 THEN NULL ELSE l_discount END AS DOUBLE)), 6) AS share FROM lineitem")
def near_duplicate_columns(t: Read) -> DataFrame:
    rows = t("lineitem").withColumn("copy", F.when(F.col("l_orderkey") % 100 != 0, F.col("l_discount")))
    return rounded(profile.equal_shares(rows, [("l_discount", "copy")]))


@query("WITH c AS (SELECT o_orderdate AS x, o_totalprice AS y, count(*) AS c FROM orders GROUP BY 1, 2), s AS (SELECT sum(CAST(sign(q.y - p.y) * p.c * q.c AS DOUBLE)) AS s FROM c p JOIN c q ON p.x < q.x), n AS (SELECT CAST(sum(c) AS BIGINT) AS n FROM c), tx AS (SELECT sum(k * (k - 1) / 2) AS a FROM (SELECT CAST(sum(c) AS DOUBLE) AS k FROM c GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS b FROM (SELECT CAST(sum(c) AS DOUBLE) AS k FROM c GROUP BY y)) SELECT n, s, round(s / sqrt((CAST(n AS DOUBLE) * (n - 1) / 2 - a) * (CAST(n AS DOUBLE) * (n - 1) / 2 - b)), 6) AS tau FROM n, s, tx, ty")
def trend_orders(t: Read) -> DataFrame:
    rows = t("orders")
    return rounded(stats.kendall_trend(rows.withColumn("x", stats.ordinal(rows, "o_orderdate")), "x", "o_totalprice").select("n", "s", "tau"))


_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT {_RANKS.format('p_size')} AS a, {_RANKS.format('p_retailprice')} AS b FROM part)")
def spearman_part(t: Read) -> DataFrame:
    return rounded(stats.spearman(t("part"), "p_size", "p_retailprice"))


@query(f"WITH r AS (SELECT o_orderstatus AS g, o_totalprice AS x, {_RANKS.format('o_totalprice')} AS rk FROM orders WHERE o_orderstatus IN ('F', 'O')), s AS (SELECT g, count(*) AS n, sum(rk) AS rs FROM r GROUP BY 1), tt AS (SELECT CAST(sum(k * k * k - k) AS DOUBLE) AS tie_term FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM r GROUP BY x)) SELECT a.g AS first_group, a.n AS n1, b.n AS n2, a.rs - a.n * (a.n + 1) / 2.0 AS u, round(2 * (a.rs - a.n * (a.n + 1) / 2.0) / (CAST(a.n AS DOUBLE) * b.n) - 1, 6) AS effect, tie_term FROM s a, s b, tt WHERE a.g < b.g")
def mann_whitney_orders(t: Read) -> DataFrame:
    return rounded(stats.mann_whitney(t("orders").where("o_orderstatus in ('F', 'O')"), "o_totalprice", "o_orderstatus"))


@query(f"WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, {_RANKS.format('l_quantity')} AS rk FROM lineitem), s AS (SELECT g, count(*) AS n, sum(rk) AS rs FROM r GROUP BY 1), tt AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM r GROUP BY x)), h AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(rs * rs / n) AS q FROM s) SELECT k, n, round((12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)), 5) AS h, round((12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) / (n - 1), 6) AS effect FROM h, tt")
def kruskal_lineitem(t: Read) -> DataFrame:
    return stats.kruskal_wallis(t("lineitem"), "l_quantity", "l_returnflag").select("k", "n", F.round("h", 5).alias("h"), F.round("effect", 6).alias("effect"))


@query("WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), g AS (SELECT ra.a, cb.b, coalesce(o.o, 0) AS o, CAST(ra.n AS DOUBLE) * cb.n / t.n AS e, t.n AS n FROM (SELECT a, sum(o) AS n FROM o GROUP BY 1) ra, (SELECT b, sum(o) AS n FROM o GROUP BY 1) cb, (SELECT sum(o) AS n FROM o) t LEFT JOIN o ON o.a = ra.a AND o.b = cb.b) SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum((o - e) * (o - e) / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, round(sqrt(sum((o - e) * (o - e) / e) / (any_value(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS v, round(avg(CAST(e < 5 AS DOUBLE)), 6) AS small_share FROM g")
def chi_square_orders(t: Read) -> DataFrame:
    return rounded(stats.chi_square(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sqrt((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / ((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) + sum(n * v))), 5) AS eta FROM g")
def eta_lineitem(t: Read) -> DataFrame:
    return stats.correlation_ratio(t("lineitem"), "l_returnflag", "l_extendedprice").select("n", F.round("eta", 5).alias("eta"))


@query("WITH v AS (SELECT nullif(l_discount, 0) IS NULL AS a, nullif(l_tax, 0) IS NULL AS b FROM lineitem) SELECT count(*) AS n, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS phi FROM v")
def co_missing_lineitem(t: Read) -> DataFrame:
    rows = t("lineitem").select(F.expr("nullif(l_discount, 0)").alias("a"), F.expr("nullif(l_tax, 0)").alias("b"))
    return rounded(stats.co_missing(rows, "a", "b"))


@query("SELECT count(*) FILTER (WHERE l_discount = 0) AS n_missing, count(*) FILTER (WHERE l_discount <> 0) AS n_present, round((avg(l_quantity) FILTER (WHERE l_discount = 0) - avg(l_quantity) FILTER (WHERE l_discount <> 0)) / sqrt((var_samp(l_quantity) FILTER (WHERE l_discount = 0) + var_samp(l_quantity) FILTER (WHERE l_discount <> 0)) / 2), 6) AS smd FROM lineitem")
def missing_dependency_lineitem(t: Read) -> DataFrame:
    return rounded(stats.missing_shift(t("lineitem").withColumn("d", F.expr("nullif(l_discount, 0)")), "d", "l_quantity").select("n_missing", "n_present", "smd"))


@query("WITH p AS (SELECT event_type, 1.0 / count(*) * 20 AS p_value FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM p) SELECT event_type, round(CAST(p_value AS DOUBLE), 6) AS p_value, round(least(CAST(min(p_value * m / k) OVER (ORDER BY k DESC) AS DOUBLE), 1.0), 6) AS p_adjusted FROM r")
def bh_adjust_events(t: Read) -> DataFrame:
    tests = t("events").groupBy("event_type").agg((F.lit(20.0) / F.count("*")).alias("p_value"))
    return rounded(stats.benjamini_hochberg(tests))


@query("SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source_file FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier' FROM supplier")
def stack_customers_suppliers(t: Read) -> DataFrame:
    customers = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return combine.stack({"customer": customers, "supplier": suppliers})


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def join_orders_customers(t: Read) -> DataFrame:
    joined = combine.join_on_text(t("orders"), t("customer"), "o_custkey", "c_custkey", right_name="customer")
    return joined.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT count(*) AS left_rows, (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS matched_rows, (SELECT count(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey) AS joined_rows FROM customer")
def join_report_customers(t: Read) -> DataFrame:
    return combine.join_report(t("customer"), t("orders"), "c_custkey", "o_custkey")


@query("WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT c_custkey AS v FROM customer), s AS (SELECT count(*) AS k FROM a JOIN b USING (v)) SELECT (SELECT count(*) FROM a) AS left_distinct, (SELECT count(*) FROM b) AS right_distinct, k AS shared, round(k / (SELECT count(*) FROM a), 6) AS left_coverage, round(k / (SELECT count(*) FROM b), 6) AS right_coverage, CASE WHEN (SELECT count(*) FROM a) >= 0.999 * (SELECT count(o_custkey) FROM orders) THEN CASE WHEN (SELECT count(*) FROM b) >= 0.999 * (SELECT count(c_custkey) FROM customer) THEN 'one-to-one' ELSE 'one-to-many' END WHEN (SELECT count(*) FROM b) >= 0.999 * (SELECT count(c_custkey) FROM customer) THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality FROM s")
def join_discovery_overlap(t: Read) -> DataFrame:
    return rounded(combine.value_overlap(t("orders"), t("customer"), "o_custkey", "c_custkey"))


@query("WITH a AS (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS v FROM supplier) SELECT (SELECT count(*) FROM a JOIN b USING (v)) AS shared, (SELECT count(*) FROM (FROM a UNION FROM b)) AS all_values, round((SELECT count(*) FROM a JOIN b USING (v)) / (SELECT count(*) FROM (FROM a UNION FROM b)), 6) AS jaccard")
def compare_categories(t: Read) -> DataFrame:
    return rounded(combine.category_jaccard(t("customer").where("c_acctbal > 5000"), t("supplier"), "c_nationkey", "s_nationkey"))


#: Questions about test tables that are answerable, partly answerable, and not; with the facts that a plain reading of the tables gives.
_ASKED = {
    "flag_quantity": ("lineitem", verdicts.Question("comparative", [verdicts.Construct("dependent", "direct", "l_quantity", "lineitem"), verdicts.Construct("independent", "direct", "l_returnflag", "lineitem")], "l_discount > 0.02", groups=True)),
    "status_price_1994": (
        "orders",
        verdicts.Question(
            "causal", [verdicts.Construct("dependent", "proxy", "o_totalprice", "orders"), verdicts.Construct("independent", "direct", "o_orderpriority", "orders"), verdicts.Construct("covariate", None)],
            None, "o_orderdate", "1990-01-01", "1994-12-31", confounders=1, groups=True,
        ),
    ),
    "constant_outcome": ("lineitem", verdicts.Question("correlational", [verdicts.Construct("dependent", "direct", "case when l_quantity > 25 then 'many' end", "lineitem"), verdicts.Construct("independent", "direct", "l_tax", "lineitem")], "l_discount > 0.05")),
    "after_the_data": ("orders", verdicts.Question("descriptive", [verdicts.Construct("dependent", "direct", "o_totalprice", "orders")], None, "o_orderdate", "2150-01-01", "2151-01-01")),
}


def _asked_sql(name: str, table: str, scope: str, outcome: str, other: str | None, group: bool, coverage: str) -> str:
    whole = f"({outcome}) IS NOT NULL" + (f" AND ({other}) IS NOT NULL" if other else "")
    g = f"CAST({other} AS VARCHAR)" if group else "CAST(NULL AS VARCHAR)"
    missing = ", ".join(f"avg(CAST(({c}) IS NULL AS DOUBLE))" for c in (outcome, other) if c)
    missing = f"greatest({missing})" if other else missing
    return f"""SELECT '{name}' AS question, b.*, o.*, g.*, {coverage} AS time_coverage FROM
 (SELECT count(*) AS rows_in_scope, count(*) FILTER (WHERE {whole}) AS complete_cases, {missing} AS most_missing FROM {table} WHERE {scope}) b,
 (SELECT count(*) AS outcome_distinct, max(n) / sum(n) AS outcome_top_share FROM (SELECT CAST({outcome} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE ({scope}) AND ({outcome}) IS NOT NULL GROUP BY 1)) o,
 (SELECT count(*) AS n_groups, min(n) AS smallest_group, max(n) AS largest_group FROM (SELECT {g} AS v, count(*) AS n FROM {table} WHERE ({scope}) AND {whole} GROUP BY 1) WHERE n >= 5 AND v IS NOT NULL) g"""


_COVERED = "(SELECT least(1.0, greatest(0, date_diff('day', greatest(min(CAST(o_orderdate AS DATE)), DATE '{0}'), least(max(CAST(o_orderdate AS DATE)), DATE '{1}')) + 1) / (date_diff('day', DATE '{0}', DATE '{1}') + 1.0)) FROM orders)"
_BETWEEN = "CAST(o_orderdate AS DATE) BETWEEN DATE '{0}' AND DATE '{1}'"
_MEASURES = " UNION ALL ".join(
    [
        _asked_sql("flag_quantity", "lineitem", "l_discount > 0.02", "l_quantity", "l_returnflag", True, "CAST(NULL AS DOUBLE)"),
        _asked_sql("status_price_1994", "orders", _BETWEEN.format("1990-01-01", "1994-12-31"), "o_totalprice", "o_orderpriority", True, _COVERED.format("1990-01-01", "1994-12-31")),
        _asked_sql("constant_outcome", "lineitem", "l_discount > 0.05", "CASE WHEN l_quantity > 25 THEN 'many' END", "l_tax", False, "CAST(NULL AS DOUBLE)"),
        _asked_sql("after_the_data", "orders", _BETWEEN.format("2150-01-01", "2151-01-01"), "o_totalprice", None, False, _COVERED.format("2150-01-01", "2151-01-01")),
    ]
)
_MEASURED = f"""SELECT question, rows_in_scope, complete_cases, round(most_missing, 6) AS most_missing, outcome_distinct, round(CAST(outcome_top_share AS DOUBLE), 6) AS outcome_top_share,
 n_groups, smallest_group, largest_group, round(time_coverage, 6) AS time_coverage FROM ({_MEASURES})"""
_FIRED = f"""SELECT m.question, r.code, r.severity FROM ({_MEASURED}) m, (VALUES ('core_gap', 'fail'), ('covariate_gap', 'warn'), ('proxy_only', 'warn'), ('no_rows_in_scope', 'fail'), ('too_few_complete', 'fail'), ('small_sample', 'warn'),
 ('high_missing', 'warn'), ('outcome_constant', 'fail'), ('outcome_near_constant', 'warn'), ('too_few_groups', 'fail'), ('small_group', 'warn'), ('unbalanced_groups', 'warn'), ('no_time_overlap', 'fail'),
 ('partial_time_coverage', 'warn'), ('causal_claim', 'warn'), ('confounders', 'info')) r(code, severity)
 WHERE CASE r.code WHEN 'covariate_gap' THEN question = 'status_price_1994' WHEN 'proxy_only' THEN question = 'status_price_1994' WHEN 'causal_claim' THEN question = 'status_price_1994'
 WHEN 'confounders' THEN question = 'status_price_1994' WHEN 'no_rows_in_scope' THEN rows_in_scope = 0 WHEN 'too_few_complete' THEN rows_in_scope > 0 AND complete_cases < 10
 WHEN 'small_sample' THEN rows_in_scope > 0 AND complete_cases BETWEEN 10 AND 29 WHEN 'high_missing' THEN most_missing > 0.3 WHEN 'outcome_constant' THEN rows_in_scope > 0 AND outcome_distinct <= 1
 WHEN 'outcome_near_constant' THEN rows_in_scope > 0 AND outcome_distinct > 1 AND outcome_top_share >= 0.95 WHEN 'too_few_groups' THEN n_groups < 2 AND complete_cases > 0 AND question IN ('flag_quantity', 'status_price_1994')
 WHEN 'small_group' THEN n_groups >= 2 AND smallest_group < 20 WHEN 'unbalanced_groups' THEN n_groups >= 2 AND largest_group > 10 * smallest_group WHEN 'no_time_overlap' THEN time_coverage <= 0
 WHEN 'partial_time_coverage' THEN time_coverage > 0 AND time_coverage < 0.8 ELSE false END"""


def _measured(t: Read) -> DataFrame:
    parts = [verdicts.measure(t(table), question).withColumn("question", F.lit(name)) for name, (table, question) in _ASKED.items()]
    return reduce(DataFrame.unionByName, parts)


@query(_MEASURED)
def rq_measurements(t: Read) -> DataFrame:
    return rounded(_measured(t)).select("question", "rows_in_scope", "complete_cases", "most_missing", "outcome_distinct", "outcome_top_share", "n_groups", "smallest_group", "largest_group", "time_coverage")


@query(_FIRED)
def rq_rules(t: Read) -> DataFrame:
    return verdicts.apply_rules(_measured(t)).select("question", "code", "severity")


@query(f"SELECT q.question, CASE max(CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'not_answerable' WHEN 1 THEN 'partial' ELSE 'answerable' END AS verdict FROM (VALUES {', '.join(f'({name!r})' for name in _ASKED)}) q(question) LEFT JOIN ({_FIRED}) f ON f.question = q.question GROUP BY 1")
def rq_verdict(t: Read) -> DataFrame:
    return verdicts.verdict(_measured(t)).select("question", "verdict")


@query(f"SELECT question, code, severity FROM ({_FIRED}) WHERE code IN ('high_missing', 'small_group', 'unbalanced_groups', 'outcome_near_constant', 'partial_time_coverage', 'too_few_complete', 'small_sample', 'outcome_constant', 'too_few_groups')")
def rq_data_findings(t: Read) -> DataFrame:
    fired = verdicts.apply_rules(_measured(t))
    return fired.join(verdicts.data_findings(fired), ["code", "severity"], "left_semi").select("question", "code", "severity")


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def share_within_group(t: Read) -> DataFrame:
    return rounded(insights.group_shares(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("WITH r AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS s, o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY s, a) AS ra, sum(o) OVER (PARTITION BY s, b) AS rb, sum(o) OVER (PARTITION BY s) AS n FROM r) SELECT s AS stratum, CAST(any_value(n) AS BIGINT) AS n, round(sqrt(greatest(0, sum(o * o / (CAST(ra AS DOUBLE) * rb)) - 1) / nullif(least(count(DISTINCT a), count(DISTINCT b)) - 1, 0)), 6) AS v FROM m GROUP BY s")
def confounder_strata(t: Read) -> DataFrame:
    rows = t("orders").withColumn("y", F.year("o_orderdate"))
    return rounded(insights.cramers_v_by_stratum(rows, "o_orderstatus", "o_orderpriority", "y"))


@query("SELECT o_orderpriority AS stratum, count(*) AS n, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS effect FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def group_gap_orders(t: Read) -> DataFrame:
    return rounded(insights.mean_gap_by_stratum(t("orders"), "o_totalprice", "o_orderstatus", "F", "O", "o_orderpriority"), 4)


@query("SELECT l_returnflag AS \"group\", count(*) AS n, round(avg(CAST(l_discount = 0 AS DOUBLE)), 6) AS missing_rate FROM lineitem GROUP BY 1 HAVING count(*) >= 20")
def missing_rates_lineitem(t: Read) -> DataFrame:
    return rounded(insights.missing_rates(t("lineitem").withColumn("d", F.expr("nullif(l_discount, 0)")), "d", "l_returnflag"))


_STOPS = ", ".join(f"'{w}'" for w in [*text_functions.STOP_WORDS, *text_functions.QUESTION_WORDS])
_STEM = "CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END"


def _terms_sql(table: str, key: str) -> str:
    found = f"SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-]*[a-z0-9'']|[a-z0-9]')) AS w FROM {table}"
    return f"SELECT DISTINCT {key}, {_STEM} AS term FROM (SELECT {key}, trim(w, '''') AS w FROM ({found}) WHERE length(w) >= 3 AND w NOT IN ({_STOPS}) AND NOT regexp_matches(w, '^[0-9]+$'))"


@query(f"WITH a AS ({_terms_sql('benchmark', 'item_id')}), d AS ({_terms_sql('documents', 'doc_id')}), s AS (SELECT item_id, count(*) AS terms FROM a GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS matched FROM a JOIN d USING (term) GROUP BY 1, 2) SELECT item_id, doc_id, matched, round(matched / terms, 6) AS score FROM m JOIN s USING (item_id) WHERE matched >= greatest(2, ceil(0.3 * terms))")
def related_documents(t: Read) -> DataFrame:
    return rounded(texts.related(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def guarded_orders(t: Read) -> DataFrame:
    orders = t("orders")
    return guard.guarded(orders.sparkSession, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus;", {"orders": orders})


_CONTACTS = """
WITH lower_names AS (SELECT c_custkey, lower(c_name) AS who, c_nationkey FROM customer),
joined AS (SELECT l.*, n_name, concat(n_name, ' / ', l.who) AS label, count(l.who) OVER (PARTITION BY n_name) AS named FROM lower_names l JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, who, label, n_name AS country, named, CASE WHEN who LIKE '%7' THEN 'seven' ELSE 'other' END AS ends,
       (SELECT max(c_name) FROM customer) AS last_name, CAST(c_custkey + 100000000 AS STRING) AS phone FROM joined
UNION ALL
SELECT s_suppkey, s_name, 'supplier', NULL, NULL, NULL, NULL, s_name FROM supplier
"""


@query(
    "SELECT c_custkey, '<masked>' AS who, '<masked>' AS label, n_name AS country, count(*) OVER (PARTITION BY n_name) AS named, '<masked>' AS ends, '<masked>' AS last_name, '<phone>' AS phone FROM customer JOIN nation ON n_nationkey = c_nationkey "
    "UNION ALL SELECT s_suppkey, '<masked>', '<masked>', NULL, NULL, NULL, NULL, 'Supplier#<phone>' FROM supplier"
)
def masked_contacts(t: Read) -> DataFrame:
    """Names of customers reach the result under other names, joined, in a union, in a condition and as a maximum; only their number is shown."""
    customer = t("customer")
    found = guard.guarded(customer.sparkSession, _CONTACTS, {"customer": customer, "nation": t("nation"), "supplier": t("supplier")})
    return texts.masked(found, {"customer.c_name"})


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def usage_by_user(t: Read) -> DataFrame:
    return tables.usage(t("events"), ["user_id", "event_type"], "value").select("user_id", "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def usage_p95(t: Read) -> DataFrame:
    return rounded(ranks.quantiles(t("events"), "event_type", "value", [0.95]).select("event_type", F.col("q")[0].alias("p95")))


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS calls, round(sum(value), 4) AS cost, sum(value) > 100000 AS over_budget FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def monthly_usage(t: Read) -> DataFrame:
    found = tables.monthly_usage(t("events"), "ts", "value", F.lit("2024-01-01").cast("timestamp_ntz"), 100000.0)
    return found.withColumn("cost", F.round("cost", 4))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_event_per_user(t: Read) -> DataFrame:
    return records.latest(t("events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def pivot_event_types(t: Read) -> DataFrame:
    counts = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return records.wide(counts, "user_id", "event_type", "n", ["click", "view", "purchase"]).fillna(0)


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}', '<email>', 'g'), '\\+?[0-9][0-9 ().-]{7,}[0-9]', '<phone>', 'g'), '[0-9]{9,}', '<number>', 'g') AS text FROM documents")
def scrub_documents(t: Read) -> DataFrame:
    return t("documents").select("doc_id", text_functions.scrub(F.col("text")).alias("text"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_top(t: Read) -> DataFrame:
    one = t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = t("embeddings").crossJoin(F.broadcast(one)).select("vec_id", F.round(text_functions.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))
    return near.orderBy(F.desc("cosine"), "vec_id").limit(10)


@query("SELECT line, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5")
def running_lines(t: Read) -> DataFrame:
    lines = t("documents").select(F.lit(1).alias("corpus"), "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return texts.running_lines(lines, "corpus", "doc_id", "line", least=0.0, pages=5).select("line", F.col("n_pages").alias("n_docs"))


@query("SELECT o_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 5".replace("sum(l_extendedprice * (1 - l_discount)) AS", "round(sum(l_extendedprice * (1 - l_discount)), 4) AS"))
def top_orders(t: Read) -> DataFrame:
    orders = t("orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")
    joined = orders.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(5)


# Associations, warnings, joins and comparisons of whole tables.

_SPEARMAN = "SELECT '{1}' AS a, '{2}' AS b, 'spearman' AS measure, corr(p, q) AS value, count(*) AS n FROM (SELECT {3} AS p, {4} AS q FROM {0})"
_CRAMER = "SELECT '{1}' AS a, '{2}' AS b, 'cramers_v' AS measure, sqrt((sum(o * o / (ra * rb)) - 1) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)) AS value, CAST(sum(o) AS BIGINT) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY x) AS ra, sum(o) OVER (PARTITION BY y) AS rb FROM (SELECT CAST({1} AS VARCHAR) AS x, CAST({2} AS VARCHAR) AS y, CAST(count(*) AS DOUBLE) AS o FROM {0} GROUP BY 1, 2))"
_ETA = "SELECT '{1}' AS a, '{2}' AS b, 'eta' AS measure, sqrt(sum(n * (m - t) * (m - t)) / (sum(n * (m - t) * (m - t)) + sum(n * v))) AS value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg({2}) AS m, var_pop({2}) AS v, any_value((SELECT avg({2}) FROM {0})) AS t FROM {0} GROUP BY {1})"


def _associations_sql(table: str, numeric: list[str], categories: list[str]) -> str:
    parts = [_SPEARMAN.format(table, a, b, _RANKS.format(a), _RANKS.format(b)) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    parts += [_CRAMER.format(table, a, b) for i, a in enumerate(categories) for b in categories[i + 1 :]]
    parts += [_ETA.format(table, c, x) for c in categories for x in numeric]
    return f"SELECT a, b, measure, round(value, 5) AS value, n FROM ({' UNION ALL '.join(parts)}) WHERE abs(value) >= 0.1"


_COPIED = "(SELECT *, l_discount AS copy, CASE WHEN l_quantity > 30 AND l_returnflag = 'A' THEN NULL ELSE l_tax END AS tax, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code FROM lineitem)"


def _copied(t: Read) -> DataFrame:
    columns = ["*", "l_discount as copy", "case when l_quantity > 30 and l_returnflag = 'A' then null else l_tax end as tax", "cast(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as string) as code"]
    return t("lineitem").selectExpr(*columns)


_RELATED = "(SELECT l_quantity, l_quantity * 2 + l_linenumber AS weight, l_extendedprice, l_returnflag, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS size, l_linestatus FROM lineitem)"


@query(_associations_sql(_RELATED, ["l_quantity", "weight", "l_extendedprice"], ["l_returnflag", "size", "l_linestatus"]))
def associations_lineitem(t: Read) -> DataFrame:
    rows = t("lineitem").selectExpr("l_quantity", "l_quantity * 2 + l_linenumber as weight", "l_extendedprice", "l_returnflag", "case when l_quantity > 40 then 'big' when l_quantity > 20 then 'mid' else 'small' end as size", "l_linestatus")
    return rounded(insights.pairwise_associations(rows, ["l_quantity", "weight", "l_extendedprice"], ["l_returnflag", "size", "l_linestatus"]), 5)


@query(f"""SELECT * FROM (
 SELECT 'near_duplicate_columns' AS code, 'warning' AS severity, 'copy' AS "column", 'l_discount' AS other FROM {_COPIED} HAVING avg(CAST(l_discount IS NOT DISTINCT FROM copy AS DOUBLE)) >= 0.98
 UNION ALL SELECT 'near_perfect_association', 'warning', 'code', 'l_returnflag'
 UNION ALL SELECT 'missing_depends', 'warning', 'tax', arg_max(by_, strength) FROM (
  SELECT 'l_returnflag' AS by_, sqrt(sum(o * o / (ra * rb)) - 1) AS strength FROM (SELECT *, sum(o) OVER (PARTITION BY x) AS ra, sum(o) OVER (PARTITION BY y) AS rb FROM (SELECT tax IS NULL AS x, l_returnflag AS y, CAST(count(*) AS DOUBLE) AS o FROM {_COPIED} GROUP BY 1, 2))
  UNION ALL SELECT 'l_quantity', abs(avg(l_quantity) FILTER (WHERE tax IS NULL) - avg(l_quantity) FILTER (WHERE tax IS NOT NULL)) / sqrt((var_samp(l_quantity) FILTER (WHERE tax IS NULL) + var_samp(l_quantity) FILTER (WHERE tax IS NOT NULL)) / 2) FROM {_COPIED}))""")
def table_warnings_lineitem(t: Read) -> DataFrame:
    rows = _copied(t)
    found = insights.pairwise_associations(rows, [], ["l_returnflag", "code", "l_linestatus"])
    missing = insights.missing_dependencies(rows, ["tax"], ["l_returnflag"], ["l_quantity"])
    counted = rows.agg(F.count("*").alias("rows"))
    keyed = profile.duplicate_rows(rows)
    return insights.table_warnings(counted, keyed, profile.equal_shares(rows, [("l_discount", "copy")]), found, missing)


@query(f"""SELECT 'tax' AS "column", 'l_returnflag' AS "by", max_by(g, rate) AS highest, round(max(rate), 6) AS highest_rate, round(min(rate), 6) AS lowest_rate FROM (SELECT l_returnflag AS g, avg(CAST(tax IS NULL AS DOUBLE)) AS rate FROM {_COPIED} GROUP BY 1)""")
def missing_by_group_lineitem(t: Read) -> DataFrame:
    rates = insights.missing_rates(_copied(t), "tax", "l_returnflag")
    ends = rates.agg(F.max_by("group", "missing_rate").alias("highest"), F.max("missing_rate").alias("highest_rate"), F.min("missing_rate").alias("lowest_rate"))
    return rounded(ends.select(F.lit("tax").alias("column"), F.lit("l_returnflag").alias("by"), "*"))


@query("""WITH p AS (SELECT 'events' AS left_table, 'customer_id' AS left_column, 'customers' AS right_table, 'id' AS right_column, true AS name_match,
 (SELECT count(DISTINCT user_id) FROM events) AS left_distinct, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_distinct,
 (SELECT count(*) FROM (SELECT DISTINCT user_id AS v FROM events) JOIN (SELECT DISTINCT c_custkey AS v FROM customer) USING (v)) AS shared)
 SELECT *, round(shared / left_distinct, 6) AS left_coverage, round(shared / right_distinct, 6) AS right_coverage,
 CASE WHEN left_distinct >= 0.999 * (SELECT count(user_id) FROM events) THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality FROM p WHERE shared >= 2 AND greatest(shared / left_distinct, shared / right_distinct) >= 0.5""")
def find_joins_events_customers(t: Read) -> DataFrame:
    # Names as a user's files have them, so that a key is told by its name.
    asked = {"events": t("events").select(F.col("user_id").alias("customer_id"), "event_type"), "customers": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))}
    return rounded(combine.find_joins(asked))


@query("""WITH medians AS (SELECT (SELECT median(o_totalprice) FROM orders) AS a, (SELECT median(o_totalprice * 3) FROM orders) AS b),
 gap AS (SELECT avg(CAST(o_custkey % 2 = 0 AS DOUBLE)) AS g FROM orders),
 tops AS (SELECT DISTINCT lower(o_orderpriority) AS v, 1 AS side FROM orders UNION ALL SELECT DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN lower(o_orderpriority) ELSE 'p' || lower(o_orderpriority) END, 2 FROM orders),
 overlap AS (SELECT count(*) AS n, count(*) FILTER (WHERE k = 2) AS c FROM (SELECT v, count(DISTINCT side) AS k FROM tops GROUP BY 1))
 SELECT * FROM (SELECT 'Total price' AS "column", 'scale_mismatch' AS code FROM medians WHERE greatest(a, b) / least(a, b) >= 2 UNION ALL SELECT 'comment', 'missing_gap' FROM gap WHERE g >= 0.3
 UNION ALL SELECT 'priority', 'category_mismatch' FROM overlap WHERE c < 0.5 * n UNION ALL SELECT 'status', 'type_mismatch')""")
def compare_orders(t: Read) -> DataFrame:
    orders = t("orders")
    first = orders.select(F.col("o_totalprice").alias("Total price"), F.col("o_orderstatus").alias("comment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    other = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).otherwise(F.concat(F.lit("p"), "o_orderpriority"))
    second = orders.select((F.col("o_totalprice") * 3).alias("total_price"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_orderstatus")).alias("Comment"), other.alias("Priority"), F.length("o_orderstatus").alias("Status"))
    kinds = {("first", "priority"): "categorical", ("second", "Priority"): "categorical"}
    return combine.compare_tables({"first": first, "second": second}, kinds)


@query("SELECT code, severity FROM (SELECT count(*) AS l, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS m, (SELECT count(*) FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey) AS j FROM customer), (VALUES ('combined_join', 'info'), ('join_low_match', 'warning'), ('join_multiplied_rows', 'warning')) v(code, severity) WHERE CASE code WHEN 'join_low_match' THEN m < 0.5 * l WHEN 'join_multiplied_rows' THEN j > l ELSE true END")
def join_notes_customers(t: Read) -> DataFrame:
    return combine.join_notes(combine.join_report(t("customer"), t("orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey"))


# Times, chunks and series.

_SHIFTED = "CASE WHEN event_id > (SELECT max(event_id) * 0.6 FROM events) THEN (50 + value % 7) * 2.2 ELSE 50 + value % 7 END"


@query(f"WITH v AS (SELECT event_id AS r, {_SHIFTED} AS x FROM events), c AS (SELECT k, median(x) AS median, count(*) AS rows, min(r) AS first_position FROM (SELECT r, x, ntile(10) OVER (ORDER BY r) AS k FROM v) GROUP BY k) SELECT CAST(k AS INTEGER) AS chunk, rows, first_position, round(median, 6) AS median FROM c")
def chunk_medians_events(t: Read) -> DataFrame:
    return rounded(profile.chunk_medians(_shifted(t), "x", "event_id").select("chunk", "rows", "first_position", "median"))


def _shifted(t: Read) -> DataFrame:
    last = t("events").agg((F.max("event_id") * 0.6).alias("cut"))
    x = 50 + F.col("value") % 7
    return t("events").crossJoin(F.broadcast(last)).select("event_id", F.when(F.col("event_id") > F.col("cut"), x * 2.2).otherwise(x).alias("x"))  # one row


@query(f"WITH v AS (SELECT event_id AS r, {_SHIFTED} AS x FROM events), c AS (SELECT k, median(x) AS m, min(r) AS f FROM (SELECT r, x, ntile(10) OVER (ORDER BY r) AS k FROM v) GROUP BY k), j AS (SELECT s.k, (SELECT f FROM c WHERE c.k = s.k + 1) AS f, (SELECT median(m) FROM c WHERE c.k <= s.k) AS a, (SELECT median(m) FROM c WHERE c.k > s.k) AS b, greatest((SELECT max(m) / min(m) FROM c WHERE c.k <= s.k), (SELECT max(m) / min(m) FROM c WHERE c.k > s.k)) AS w FROM (SELECT unnest(range(2, 9)) AS k) s) SELECT f AS from_position, round(b / a, 6) AS ratio, round(a, 6) AS median_before, round(b, 6) AS median_after FROM j WHERE greatest(b / a, a / b) >= 2 AND w <= 1.3 AND (SELECT count(*) FROM v) >= 300 ORDER BY greatest(b / a, a / b) DESC, k LIMIT 1")
def unit_shift_events(t: Read) -> DataFrame:
    return rounded(profile.unit_shift(_shifted(t), "x", "event_id"))


@query("WITH g AS (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)), m AS (SELECT gap FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, gap LIMIT 1), s AS (SELECT min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, bool_or(o_orderdate <> date_trunc('day', o_orderdate)) AS timed FROM orders), p AS (SELECT *, CASE WHEN timed THEN 'sub-daily' WHEN gap = 1 THEN 'daily' WHEN gap = 7 THEN 'weekly' ELSE 'irregular (~' || gap || ' days)' END AS granularity, date_diff('day', first, last) AS days FROM s, m) SELECT first, last, granularity, CASE WHEN days > 7320 THEN 'year' WHEN days <= 92 THEN CASE WHEN granularity = 'weekly' THEN 'week' ELSE 'day' END WHEN days <= 731 THEN 'week' WHEN date_diff('month', first, last) + 1 <= 400 THEN 'month' ELSE 'quarter' END AS period FROM p")
def date_profile_orders(t: Read) -> DataFrame:
    return profile.date_profile(t("orders"), "o_orderdate")


@query("SELECT l_returnflag AS \"group\", count(*) AS n, round(median(l_extendedprice), 6) AS median, round(avg(l_extendedprice), 5) AS mean FROM lineitem GROUP BY 1")
def group_summary_lineitem(t: Read) -> DataFrame:
    found = stats.group_summary(t("lineitem"), "l_extendedprice", "l_returnflag")
    return found.select("group", "n", F.round("median", 6).alias("median"), F.round("mean", 5).alias("mean"))


@query("SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS time, round(avg(o_totalprice), 5) AS mean, count(*) AS n FROM orders GROUP BY 1")
def trend_series_orders(t: Read) -> DataFrame:
    return rounded(insights.trend_series(t("orders"), "o_orderdate", "o_totalprice", "quarter"), 5)


@query("WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT a, b, 100.0 * n / sum(n) OVER (PARTITION BY a) AS share FROM c) SELECT a, " + ", ".join(f"round(max(share) FILTER (WHERE b = '{p}'), 1) AS \"% {p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM s GROUP BY 1")
def share_series_orders(t: Read) -> DataFrame:
    return insights.share_series(t("orders"), "o_orderstatus", "o_orderpriority", k=5)


# Tests, power and findings.


@query(f"SELECT l_returnflag AS g, n, round(2.801585 * sqrt(2.0 / n), 6) AS d, round(tanh(2.801585 / sqrt(n - 3)), 6) AS r, round(1.959964 * sqrt(0.25 / n), 6) AS margin FROM (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)")
def detectable_effects_lineitem(t: Read) -> DataFrame:
    n = F.col("n")
    groups = t("lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").cast("double").alias("n"))
    return rounded(groups.select("g", "n", stats.detectable_difference(n, n).alias("d"), stats.detectable_correlation(n).alias("r"), stats.margin_of_error(n).alias("margin")))


@query("""WITH r AS (SELECT event_type AS test_id, CASE WHEN event_type < 'm' THEN 'spearman' ELSE 'kruskal_wallis' END AS test, count(*) AS n, 1.0 / count(*) * 20 AS p_value, (count(*) % 100) / 100.0 AS effect FROM events GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM r), a AS (SELECT *, least(min(p_value * m / k) OVER (ORDER BY k DESC), 1.0) AS p_adjusted FROM k),
 z AS (SELECT *, CASE WHEN test = 'kruskal_wallis' THEN least(1.0, sqrt(effect)) ELSE least(1.0, effect) END AS scale, CASE WHEN test = 'kruskal_wallis' THEN CASE WHEN effect < 0.01 THEN 'negligible' WHEN effect < 0.06 THEN 'small' WHEN effect < 0.14 THEN 'medium' ELSE 'large' END
 ELSE CASE WHEN effect < 0.1 THEN 'negligible' WHEN effect < 0.3 THEN 'small' WHEN effect < 0.5 THEN 'medium' ELSE 'large' END END AS magnitude FROM a)
 SELECT test_id, magnitude, round(CAST((0.4 * 0.6 + 0.4 * scale + 0.2 * least(1.0, log10(n) / 3)) * CASE WHEN p_adjusted < 0.05 THEN 1 ELSE 0.5 END AS DOUBLE), 4) AS score,
 CASE WHEN p_adjusted >= 0.05 THEN 'no_evidence' WHEN magnitude = 'negligible' THEN 'weak' ELSE 'finding' END AS status FROM z""")
def rank_findings_events(t: Read) -> DataFrame:
    counts = t("events").groupBy(F.col("event_type").alias("test_id")).agg(F.count("*").alias("n"))
    test = F.when(F.col("test_id") < "m", "spearman").otherwise("kruskal_wallis")
    results = counts.select("test_id", test.alias("test"), "n", (F.lit(20.0) / F.col("n")).alias("p_value"), ((F.col("n") % 100) / 100).alias("effect"), F.lit(0.6).alias("relevance"))
    return insights.rank_findings(stats.benjamini_hochberg(results)).select("test_id", "magnitude", "score", "status")


@query("""WITH s AS (SELECT o_orderpriority AS stratum, count(*) AS n, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS e FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), u AS (SELECT * FROM s WHERE n >= 30)
 SELECT count(*) AS strata, round(sum(abs(e) * n) / sum(n), 4) AS mean_effect, CASE WHEN count(*) < 2 THEN 'unclear' WHEN bool_or(e < 0 AND abs(e) >= 0.1) THEN 'reverses' WHEN sum(abs(e) * n) / sum(n) < 50 THEN 'weakens' ELSE 'holds' END AS verdict FROM u""")
def confounder_verdict_orders(t: Read) -> DataFrame:
    strata = insights.mean_gap_by_stratum(t("orders"), "o_totalprice", "o_orderstatus", "F", "O", "o_orderpriority")
    return rounded(insights.confounder_verdict(strata, 100.0), 4)


@query("""WITH c AS (SELECT 'p_name' AS "column", count(*) AS rows, count(*) - count(v) AS missing, count(DISTINCT v) AS d FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name END AS v FROM part) UNION ALL SELECT 'p_size', count(*), count(*) - count(v), count(DISTINCT v) FROM (SELECT CASE WHEN p_partkey % 4 <> 0 THEN 7 END AS v FROM part) UNION ALL SELECT 'p_brand', count(*), count(*), 0 FROM part)
 SELECT "column", code, severity FROM c, (VALUES ('empty_column', 'severe'), ('high_missing', 'severe'), ('high_missing', 'warning'), ('constant', 'warning')) r(code, severity)
 WHERE CASE WHEN code = 'empty_column' THEN missing = rows WHEN missing = rows THEN false WHEN code = 'constant' THEN d = 1 WHEN severity = 'severe' THEN missing >= 0.5 * rows ELSE missing >= 0.2 * rows AND missing < 0.5 * rows END""")
def column_warnings_part(t: Read) -> DataFrame:
    rows = t("part").selectExpr("case when p_partkey % 3 = 0 then p_name end as p_name", "case when p_partkey % 4 <> 0 then 7 end as p_size", "cast(null as string) as p_brand")
    counts = profile.column_counts(rows, ["p_name", "p_size", "p_brand"])
    return insights.column_warnings(counts.withColumn("semantic_type", F.when(F.col("n_distinct") == 1, "constant")))


@query("SELECT count(*) AS columns, CAST(sum(r) AS BIGINT) AS cells, CAST(sum(m) AS BIGINT) AS missing_cells, round(sum(m) / sum(r), 6) AS missing_share FROM (SELECT count(*) AS r, count(*) FILTER (WHERE l_discount = 0) AS m FROM lineitem UNION ALL SELECT count(*), count(*) FILTER (WHERE l_tax = 0) FROM lineitem)")
def table_summary_lineitem(t: Read) -> DataFrame:
    rows = t("lineitem").select(F.expr("nullif(l_discount, 0)").alias("a"), F.expr("nullif(l_tax, 0)").alias("b"))
    return rounded(profile.table_summary(profile.column_counts(rows, ["a", "b"])))


# Records, JSON and text checks.


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_keys_events(t: Read) -> DataFrame:
    return t("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


_VERSIONS = """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, 1 + o_custkey % 2 AS version, CASE WHEN o_custkey % 5 = 0 THEN 'user' ELSE 'result' END AS source FROM orders GROUP BY o_custkey),
asked AS (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION SELECT -1 - c_custkey FROM customer WHERE c_custkey % 10 = 0),
after AS (SELECT coalesce(c.o_custkey, a.o_custkey) AS o_custkey, a.o_custkey IS NOT NULL AND coalesce(source, '') <> 'user' AS reset, f, version, source FROM c FULL JOIN asked a ON a.o_custkey = c.o_custkey)
"""


def _versions(t: Read, reset_user: bool = False) -> DataFrame:
    source = F.when(F.col("o_custkey") % 5 == 0, "user").otherwise("result")
    cells = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f")).select("o_custkey", "f", (1 + F.col("o_custkey") % 2).cast("int").alias("version"), source.alias("source"))
    asked = t("orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_custkey")
    new = t("customer").where("c_custkey % 10 = 0").select((-1 - F.col("c_custkey")).alias("o_custkey"))
    return records.upsert_versions(cells, asked.union(new), ["o_custkey"], "f", reset_user)


@query(f"{_VERSIONS} SELECT o_custkey, CASE WHEN NOT reset THEN f END AS f, CASE WHEN reset THEN coalesce(version, 0) + 1 ELSE version END AS version, CASE WHEN reset THEN 'pending' ELSE source END AS source FROM after")
def upsert_versions_orders(t: Read) -> DataFrame:
    """Cells of customers asked for anew lose their value and go up a version, but for those that a user set; some are new."""
    return _versions(t)


@query(f"""{_VERSIONS}, now AS (SELECT o_custkey, CASE WHEN NOT reset THEN f END AS f, CASE WHEN reset THEN coalesce(version, 0) + 1 ELSE version END AS version, CASE WHEN reset THEN 'pending' ELSE source END AS source FROM after),
results AS (SELECT o_custkey, 2 AS version, count(*) AS f FROM orders GROUP BY 1)
SELECT n.o_custkey, n.version, CASE WHEN n.source = 'user' OR r.f IS NULL THEN n.f ELSE r.f END AS f, CASE WHEN n.source = 'user' OR r.f IS NULL THEN n.source ELSE 'result' END AS source, CASE WHEN n.source = 'user' THEN r.f END AS proposed
FROM now n LEFT JOIN results r ON r.o_custkey = n.o_custkey AND r.version = n.version""")
def apply_results_orders(t: Read) -> DataFrame:
    """Results of version 2 reach the cells of that version alone, and stand beside what a user set."""
    results = t("orders").groupBy("o_custkey").agg(F.count("*").alias("f")).withColumn("version", F.lit(2))
    return records.apply_results(_versions(t), results, ["o_custkey"], "f")


@query("SELECT l_returnflag, list_sort(list(DISTINCT l_linenumber) FILTER (WHERE l_discount <> 0)) AS pages, list_sort(list(DISTINCT l_linestatus) FILTER (WHERE l_discount = 0)) AS not_found FROM lineitem GROUP BY 1")
def appendix_lineitem(t: Read) -> DataFrame:
    return records.appendix(t("lineitem").withColumn("d", F.expr("nullif(l_discount, 0)")), "l_returnflag", "l_linestatus", "l_linenumber", "d")


@query("SELECT n_name, r_name, 'left' AS left_label, 'right' AS right_label FROM nation JOIN region ON n_regionkey = r_regionkey")
def labelled_joins_nations(t: Read) -> DataFrame:
    edges = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("n").alias("left_table"), F.col("n_name").alias("left_column"), F.lit("r").alias("right_table"), F.col("r_name").alias("right_column"))
    labels = t("nation").select(F.lit("n").alias("table"), F.col("n_name").alias("column"), F.lit("left").alias("label")).union(t("region").select(F.lit("r"), "r_name", F.lit("right")))
    return tables.labelled_joins(edges, labels).select(F.col("left_column").alias("n_name"), F.col("right_column").alias("r_name"), "left_label", "right_label")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS seconds FROM events GROUP BY 1")
def query_stats_events(t: Read) -> DataFrame:
    return rounded(tables.query_stats(t("events").withColumnRenamed("value", "seconds"), "event_type"))


@query("SELECT o_orderkey, CAST(1 + (said > 10)::INT AS INTEGER) AS checked, CAST((said <> o_orderkey AND said > 10)::INT AS INTEGER) AS n_unsupported FROM (SELECT o_orderkey, o_orderkey + (o_orderkey % 4 = 0)::INT AS said FROM orders)")
def grounded_orders(t: Read) -> DataFrame:
    """Every fourth answer states a number of rows that its source does not hold."""
    orders = t("orders")
    said = F.col("o_orderkey") + (F.col("o_orderkey") % 4 == 0).cast("int")
    answers = orders.select("o_orderkey", F.format_string("Share %.1f%% of %d rows", F.col("o_custkey") / 7, said).alias("answer"))
    sources = orders.select("o_orderkey", F.to_json(F.struct((F.col("o_custkey") / 700).alias("share"), F.col("o_orderkey").alias("rows"))).alias("source"))
    found = texts.grounded(answers, sources, "o_orderkey", "answer", "source")
    return found.select("o_orderkey", "checked", F.size("unsupported").alias("n_unsupported"))


@query("""WITH c AS (SELECT concat_ws('_', replace(p_name, ' ', '_'), p_partkey) AS name, p_type AS label, concat('made by ', p_brand, ' in size ', p_size) AS description FROM part),
w AS (SELECT *, list_distinct(string_split_regex(lower(replace(name, '_', ' ') || ' ' || label), '[^a-z0-9]+')) AS named, list_distinct(string_split_regex(lower(description), '[^a-z0-9]+')) AS described, ['red', 'widget', 'economy', 'size'] AS asked FROM c),
p AS (SELECT name, label, 3 * len(list_intersect(asked, named)) + len(list_intersect(asked, described)) + len(list_filter(asked, lambda a: len(list_filter(named, lambda n: starts_with(n, a))) > 0)) AS points FROM w)
SELECT name, label, points, CAST(points AS DOUBLE) AS score FROM p WHERE points > 0 ORDER BY score DESC, name LIMIT 20""")
def retrieve_columns_part(t: Read) -> DataFrame:
    """Every part as a column with its name, label and description: the twenty best for a question."""
    description = F.concat(F.lit("made by "), "p_brand", F.lit(" in size "), F.col("p_size").cast("string"))
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    columns = t("part").select(name.alias("name"), F.col("p_type").alias("label"), description.alias("description"))
    return texts.retrieve_columns(columns, "red widget economy size 4").select("name", "label", "points", "score")


_PLAIN = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"
_QUOTED = {
    "exact": "upper(left(p, 60))", "ligature": "replace(replace(left(p, 80), 'fi', 'ﬁ'), 'ff', 'ﬀ')", "short": "'#' || left(p, 10)", "long": "p || ' ' || p || ' and so on and on'",
    "edited": "left(p, 49) || '#'",
}


# Of a quote with one character that no passage has, all others match at most; a stretch has 5 more, unless the passage ends.
@query(
    f"""WITH d AS (SELECT doc_id, trim(left(p, 400)) AS p FROM (SELECT doc_id, {_PLAIN} AS p FROM documents)),
q AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, p, trim(lower(replace(replace({e}, 'ﬁ', 'fi'), 'ﬀ', 'ff'))) AS q FROM d" for k, e in _QUOTED.items())}),
ends AS (SELECT doc_id, kind, min(length(p) - r.range) AS rest FROM q, range(400) r WHERE kind = 'edited' AND length(p) >= 60 AND r.range < length(p) AND (r.range = 0 OR substr(p, r.range, 1) = ' ')
  AND starts_with(substr(p, r.range + 1), left(q, 49)) GROUP BY 1, 2)
SELECT doc_id, kind, CASE WHEN q = '' THEN 0 WHEN contains(trim(p), q) THEN 1 WHEN kind <> 'edited' THEN 0 ELSE round(2.0 * (length(q) - 1) / (length(q) + least(length(q) + 5, rest)), 3) END AS score
FROM q LEFT JOIN ends USING (doc_id, kind) WHERE kind <> 'edited' OR length(p) >= 60"""
)
def quotes_documents(t: Read) -> DataFrame:
    """Quotes planted in every document: in capitals, with ligatures, with a wrong letter, too short and too long."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))
    docs = t("documents").select("doc_id", F.trim(F.substring(plain, 1, 400)).alias("p"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(e).alias("quote")) for k, e in _QUOTED.items()))
    asked = docs.select("doc_id", F.explode(kinds).alias("q"), F.length("p").alias("size")).where("q.kind <> 'edited' OR size >= 60").select("doc_id", "q.*")
    return texts.quoted(asked, docs, "doc_id", "quote", "p").select("doc_id", "kind", "score")


def sampled_orders(t: Read) -> DataFrame:
    """A fixed sample of 300 rows; hashes differ between engines, so it has no SQL."""
    return insights.sampled(t("orders"), 300, 42, "o_orderkey")


query()(sampled_orders)

from . import registry_joins, registry_profiles, registry_tests  # noqa: E402, F401 - they register their queries here
