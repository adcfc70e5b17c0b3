"""Registered queries over several tables at once, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import combine
from .registry import Read, query, rounded

#: Whole-number and text columns of the tables, without the prefix of their table's name.
_COLUMNS = {
    "region": ("r_", "regionkey name"), "nation": ("n_", "nationkey name regionkey"), "customer": ("c_", "custkey name nationkey mktsegment"), "supplier": ("s_", "suppkey name nationkey"),
    "part": ("p_", "partkey name brand type size"), "orders": ("o_", "orderkey custkey orderstatus orderpriority"), "lineitem": ("l_", "orderkey partkey suppkey linenumber returnflag linestatus"),
}
_NUMBERS = "regionkey nationkey custkey suppkey partkey orderkey size linenumber".split()


def _index_sql() -> str:
    rows = []
    for place, (table, (prefix, names)) in enumerate(_COLUMNS.items()):
        for i, name in enumerate(names.split()):
            family = "integer" if name in _NUMBERS else "text"
            rows.append(f"SELECT {100 * place + i} AS c, {place} AS t, '{table}' AS tab, '{name}' AS name, '{family}' AS family, CAST({prefix}{name} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {prefix}{name} IS NOT NULL GROUP BY v")
    return " UNION ALL ".join(rows)


@query(f"""
WITH i AS ({_index_sql()}),
f AS (SELECT c, t, tab, name, family, count(*) AS d, sum(n) AS rows, count(*) / sum(n) AS u FROM i GROUP BY ALL),
shared AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM i a JOIN i b ON a.v = b.v AND a.t < b.t GROUP BY ALL),
p AS (
  SELECT x.tab AS left_table, x.name AS left_column, y.tab AS right_table, y.name AS right_column, x.name = y.name AND x.name NOT IN ('name', 'type') AS name_match,
         x.d AS left_distinct, y.d AS right_distinct, shared, shared / x.d AS lc, shared / y.d AS rc, x.d / x.rows >= 0.999 AS ol, y.d / y.rows >= 0.999 AS onr,
         x.family = 'text' AS texts, x.u >= 0.95 AS kx, y.u >= 0.95 AS ky
  FROM shared JOIN f x ON x.c = a JOIN f y ON y.c = b WHERE x.family = y.family
)
SELECT left_table, left_column, right_table, right_column, name_match, left_distinct, right_distinct, shared, round(lc, 6) AS left_coverage, round(rc, 6) AS right_coverage,
       CASE WHEN ol AND onr THEN 'one-to-one' WHEN ol THEN 'one-to-many' WHEN onr THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality
FROM p WHERE shared >= 2 AND greatest(lc, rc) >= 0.5 AND (name_match OR (texts AND (kx OR ky)) OR (NOT texts AND kx <> ky AND CASE WHEN kx THEN right_distinct ELSE left_distinct END >= 20))
""")
def find_joins_all_tables(t: Read) -> DataFrame:
    """Joins among seven tables, from one index of all their values."""
    named = {table: t(table).selectExpr(*(f"{prefix}{c} AS {c}" for c in names.split())) for table, (prefix, names) in _COLUMNS.items()}
    return rounded(combine.find_joins(named))


# A title that goes on with a word that no other has is nearest to itself, or to the first of its copies.
@query(r"""
WITH d AS (SELECT doc_id, trim(left(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')), 80)) AS p FROM documents),
first AS (SELECT p, min(doc_id) AS right_id FROM d GROUP BY p)
SELECT doc_id AS left_id, doc_id AS right_id, 1.0 AS similarity FROM d WHERE doc_id % 3 = 1
UNION ALL
SELECT doc_id, right_id, round(2.0 * length(p) / (2 * length(p) + 4), 6) FROM d JOIN first USING (p) WHERE doc_id % 3 <> 1 AND 2.0 * length(p) / (2 * length(p) + 4) >= 0.92
""")
def match_titles_documents(t: Read) -> DataFrame:
    """The beginnings of all documents as titles, against themselves with a word more; a third have a DOI."""
    plain = F.trim(F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")), 1, 80))
    doi = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("10.1000/X"), F.col("doc_id").cast("string")))
    titles = t("documents").select(F.col("doc_id").alias("id"), doi.alias("doi"), plain.alias("title"))
    asked = titles.select("id", F.concat(F.lit("https://doi.org/"), F.lower("doi")).alias("doi"), F.concat("title", F.lit(": Zzz")).alias("title"))
    return rounded(combine.match_titles(asked, titles))
