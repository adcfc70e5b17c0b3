"""Registered queries over whole-table profiles, and their SQL, made for each column by its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import tables as profiles
from .registry import Read, query, rounded

_FACTS = {
    "rows": "BIGINT", "missing": "BIGINT", "n_distinct": "BIGINT", "n_finite": "BIGINT", "min": "DOUBLE", "max": "DOUBLE", "mean": "DOUBLE", "median": "DOUBLE", "stddev": "DOUBLE", "skewness": "DOUBLE",
    "p05": "DOUBLE", "p25": "DOUBLE", "p75": "DOUBLE", "p95": "DOUBLE", "zeros": "BIGINT", "negatives": "BIGINT", "low_fence": "DOUBLE", "high_fence": "DOUBLE", "n_outside": "BIGINT", "bins": "VARCHAR",
    "sentinels": "VARCHAR", "first": "VARCHAR", "last": "VARCHAR", "granularity": "VARCHAR", "period": "VARCHAR", "empty_periods": "BIGINT", "min_length": "BIGINT", "avg_length": "DOUBLE", "max_length": "BIGINT",
    "blank": "BIGINT", "avg_words": "DOUBLE", "unit_share": "DOUBLE", "n_units": "BIGINT", "top": "VARCHAR", "top_share": "DOUBLE", "n_rare": "BIGINT", "imbalance_ratio": "DOUBLE",
}
_FINITE = "CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
_UNIT = r"^[-+]?[0-9]*[.,]?[0-9]+\s*([A-Za-z%°µ][A-Za-z%°µ/²³0-9]*)$"
_PERIODS = ("day", "week", "month", "quarter", "year")


def _number_sql(c: str, table: str) -> dict[str, str]:
    v = f"(SELECT {_FINITE.format(c=c)} AS x FROM {table})"
    q = {n: f"(SELECT quantile_cont(x, {p}) FROM {v} WHERE x IS NOT NULL)" for n, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))}
    low, high = f"({q['p25']} - 1.5 * ({q['p75']} - {q['p25']}))", f"({q['p75']} + 1.5 * ({q['p75']} - {q['p25']}))"
    bound = f"(SELECT min(x) AS lo, max(x) AS hi FROM {v})"
    bins = f"""(SELECT string_agg(coalesce(n, 0), ' ' ORDER BY r.range) FROM {bound} b, range(20) r
      LEFT JOIN (SELECT CASE WHEN lo = hi THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 20)) AS BIGINT), 19) END AS bin, count(*) AS n FROM {v}, {bound} WHERE x IS NOT NULL GROUP BY 1) k ON k.bin = r.range
      WHERE r.range = 0 OR b.lo < b.hi)"""
    codes = f"(SELECT string_agg(x || ':' || n, ' ' ORDER BY x) FROM (SELECT x, count(*) AS n FROM {v} WHERE x IN (-99999, -9999, -999, -99, 999, 9999, 99999) GROUP BY 1) WHERE n >= 2 AND (x < {low} OR x > {high}))"
    return {
        "n_finite": "count(x)", "min": "min(x)", "max": "max(x)", "mean": "avg(x)", "stddev": "stddev_samp(x)", "skewness": "skewness(x)", "zeros": "count(*) FILTER (x = 0)", "negatives": "count(*) FILTER (x < 0)",
        **q, "low_fence": low, "high_fence": high, "n_outside": f"count(*) FILTER (x < {low} OR x > {high})", "bins": bins, "sentinels": f"coalesce({codes}, '')",
    }


def _category_sql(c: str, table: str) -> dict[str, str]:
    v = f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)"
    label = f"(SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT * FROM {v} ORDER BY n DESC, v LIMIT 10))"
    return {"top": label, "top_share": f"(SELECT max(n) / sum(n) FROM {v})", "n_rare": f"(SELECT count(*) FILTER (n < 0.01 * (SELECT count({c}) FROM {table})) FROM {v})", "imbalance_ratio": f"(SELECT max(n) / min(n) FROM {v})"}


def _text_sql(c: str, table: str) -> dict[str, str]:
    flat = rf"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'))"
    units = f"(SELECT regexp_extract(trim({c}), '{_UNIT}', 1) AS u, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)"
    return {
        "min_length": f"min(length({c}))", "avg_length": f"avg(length({c}))", "max_length": f"max(length({c}))", "blank": f"count(*) FILTER ({flat} = '')",
        "avg_words": f"avg(CASE WHEN {flat} = '' THEN 0 ELSE len(string_split({flat}, ' ')) END) FILTER ({c} IS NOT NULL)",
        "unit_share": f"(SELECT coalesce(sum(n) FILTER (u <> ''), 0) / sum(n) FROM {units})", "n_units": f"(SELECT count(*) FILTER (u <> '' AND n >= greatest(2, 0.01 * (SELECT count({c}) FROM {table}))) FROM {units})",
    }


def _date_sql(c: str, table: str) -> dict[str, str]:
    days = f"(SELECT DISTINCT CAST({c} AS DATE) AS d FROM {table} WHERE {c} IS NOT NULL)"
    gap = f"(SELECT gap FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM {days}) WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)"
    grain = f"""(SELECT CASE WHEN (SELECT bool_or(CAST({c} AS TIMESTAMP) <> CAST(CAST({c} AS DATE) AS TIMESTAMP)) FROM {table}) THEN 'sub-daily' WHEN g IS NULL THEN 'single date' WHEN g = 1 THEN 'daily' WHEN g = 7 THEN 'weekly'
      WHEN g BETWEEN 28 AND 31 THEN 'monthly' WHEN g BETWEEN 89 AND 92 THEN 'quarterly' WHEN g IN (365, 366) THEN 'yearly' ELSE 'irregular (~' || g || ' days)' END FROM (SELECT {gap} AS g))"""
    span = f"(SELECT date_diff('day', min(d), max(d)) FROM {days})"
    start = f"greatest(CASE WHEN {span} > 7320 THEN 4 WHEN {span} <= 92 THEN 0 WHEN {span} <= 731 THEN 1 ELSE 2 END, CASE {grain} WHEN 'weekly' THEN 1 WHEN 'monthly' THEN 2 WHEN 'quarterly' THEN 3 WHEN 'yearly' THEN 4 ELSE 0 END)"
    counts = [f"(SELECT len(generate_series(date_trunc('{p}', min(d)), date_trunc('{p}', max(d)), INTERVAL 1 {p})) FROM {days})" for p in _PERIODS]
    place = f"(SELECT min(i) FROM (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(counts))}) w(i, n) WHERE i >= {start} AND (n <= 400 OR i = 4))"
    empty = " ".join(f"WHEN {i} THEN {n} - (SELECT count(DISTINCT date_trunc('{p}', d)) FROM {days})" for i, (p, n) in enumerate(zip(_PERIODS, counts)))
    return {"first": f"CAST(min(CAST({c} AS DATE)) AS VARCHAR)", "last": f"CAST(max(CAST({c} AS DATE)) AS VARCHAR)", "granularity": grain, "period": f"(ARRAY{list(_PERIODS)})[{place} + 1]", "empty_periods": f"CASE {place} {empty} END"}


def facts_sql(columns: dict[str, str], table: str) -> str:
    """A row of facts for each column; ``columns`` have their kinds."""
    rows = []
    for c, kind in columns.items():
        have = {"rows": "count(*)", "missing": f"count(*) - count({c})", "n_distinct": f"count(DISTINCT {c})"}
        have |= {"number": _number_sql, "text": _text_sql, "date": _date_sql, "boolean": lambda c, t: {}}[kind](c, table)
        if kind in ("number", "text", "boolean"):
            few = f"(SELECT count(DISTINCT {c}) FROM {table}) <= 50" if kind == "number" else "true"
            have |= {f: f"CASE WHEN {few} THEN {sql} END" for f, sql in _category_sql(c, table).items()}
        x = _FINITE.format(c=c) if kind == "number" else "NULL"
        listed = ", ".join(f'round({have.get(f, "NULL")}, 5) + 0 AS "{f}"' if t == "DOUBLE" and f in have else f'CAST({have.get(f, "NULL")} AS {t}) AS "{f}"' for f, t in _FACTS.items())
        rows.append(f"SELECT '{c}' AS \"column\", {listed} FROM (SELECT *, {x} AS x FROM {table})")
    return " UNION ALL ".join(rows)


def flat(profile: DataFrame) -> DataFrame:
    """The facts as SQL gives them: lists as text, doubles rounded."""
    pairs = lambda c: F.transform(c, lambda r: F.concat_ws(":", *(r[k].cast("string") for k in ("value", "n"))))
    codes = F.transform("sentinels", lambda r: F.concat_ws(":", r["code"].cast("string"), r["n"].cast("string")))
    listed = {"bins": F.concat_ws(" ", F.transform("histogram", lambda n: n.cast("string"))), "sentinels": F.concat_ws(" ", codes), "top": F.concat_ws("|", pairs("top"))}
    listed = {k: F.when(F.col("histogram" if k != "top" else "top").isNotNull(), v) for k, v in listed.items()}
    return rounded(profile.select("column", *(listed.get(f, F.col(f"`{f}`").cast("string") if f in ("first", "last") else F.col(f"`{f}`")).alias(f) for f in _FACTS)), 5)


_LINEITEM = dict.fromkeys("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split(), "number")
_LINEITEM |= {"l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date"}


@query(facts_sql(_LINEITEM, "lineitem"))
def profile_table_lineitem(t: Read) -> DataFrame:
    """Every column of lineitem, from one scan of it."""
    return flat(profiles.profile_table(t("lineitem")))


@query(facts_sql({"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"}, "part"))
def profile_table_part(t: Read) -> DataFrame:
    return flat(profiles.profile_table(t("part")))


#: Events as a careless export would have them: every rule on columns has one to fire on.
_EXPORT = """
SELECT event_id, 'v1' AS release, CASE WHEN event_id % 10 < 6 THEN NULL ELSE user_id END AS mostly_missing, CASE WHEN event_id % 10 < 3 THEN NULL ELSE user_id END AS often_missing,
       CASE WHEN event_id % 40 = 0 THEN 'no' ELSE 'yes' END AS agreed, CASE WHEN event_id % 50 = 0 THEN 99999.0 ELSE value END AS amount,
       CASE WHEN event_id < (SELECT count(*) FROM events) / 2 THEN 70 + value / 1000 ELSE 155 + value / 1000 END AS weight,
       CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) || ' kg' ELSE CAST(user_id AS STRING) || 'lb' END AS mixed, CAST(user_id AS STRING) || ' cm' AS height,
       CASE WHEN event_id % 25 = 0 THEN '  ' ELSE event_type END AS note, CAST(NULL AS STRING) AS nothing, CASE WHEN day(ts) BETWEEN 10 AND 14 THEN NULL ELSE CAST(ts AS DATE) END AS seen
FROM events
"""
_EXPORT_KINDS = {
    "event_id": "number", "release": "text", "mostly_missing": "number", "often_missing": "number", "agreed": "text", "amount": "number", "weight": "number", "mixed": "text", "height": "text", "note": "text",
    "nothing": "text", "seen": "date",
}
_SHIFT_SQL = """
SELECT c, count(*) AS chunks, sum(n) AS n, list(m ORDER BY k) AS ms FROM (
  SELECT c, k, median(x) AS m, count(*) AS n FROM (
    SELECT c, x, ntile(10) OVER (PARTITION BY c ORDER BY event_id) AS k FROM (UNPIVOT (SELECT event_id, {columns} FROM export) ON COLUMNS(* EXCLUDE (event_id)) INTO NAME c VALUE x)
  ) GROUP BY c, k) GROUP BY c
"""


def _warnings_sql() -> str:
    numeric = [c for c, k in _EXPORT_KINDS.items() if k == "number" and c != "event_id"]
    shift = _SHIFT_SQL.format(columns=", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in numeric))
    jump = """SELECT c FROM shift, range(2, 9) r WHERE n >= 300 AND chunks >= 4 AND (list_min(ms) > 0 OR list_max(ms) < 0)
      AND greatest(median_of(ms[r.range + 1:]) / median_of(ms[1:r.range]), median_of(ms[1:r.range]) / median_of(ms[r.range + 1:])) >= 2
      AND list_max(ms[1:r.range]) / list_min(ms[1:r.range]) <= 1.3 AND list_max(ms[r.range + 1:]) / list_min(ms[r.range + 1:]) <= 1.3""".replace("median_of(", "list_median(")
    return f"""
WITH export AS ({_EXPORT}), facts AS ({facts_sql(_EXPORT_KINDS, "export")}), shift AS ({shift}), shifted AS (SELECT DISTINCT c FROM ({jump})),
meant AS (
  SELECT *, rows - missing AS known, CASE WHEN rows > 0 THEN missing / rows ELSE 0 END AS share,
    CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct = 2 AND top LIKE '%yes:%' AND top LIKE '%no:%' THEN 'boolean' WHEN "column" = 'event_id' AND n_distinct >= 0.95 * (rows - missing) THEN 'identifier'
      WHEN avg_words IS NULL THEN 'other' WHEN avg_length >= 50 OR (avg_words >= 4 AND n_distinct >= 0.5 * (rows - missing)) THEN 'free_text' WHEN n_distinct >= 0.95 * (rows - missing) AND rows - missing >= 20 AND avg_words <= 1.5 THEN 'identifier'
      ELSE 'categorical' END AS meaning FROM facts
)
SELECT "column", 'empty_column' AS code, 'severe' AS severity FROM meant WHERE rows > 0 AND known = 0
UNION ALL SELECT "column", 'high_missing', CASE WHEN share >= 0.5 THEN 'severe' ELSE 'warning' END FROM meant WHERE known > 0 AND share >= 0.2
UNION ALL SELECT "column", 'constant', 'warning' FROM meant WHERE known > 0 AND meaning = 'constant'
UNION ALL SELECT "column", 'identifier', 'info' FROM meant WHERE known > 0 AND meaning = 'identifier'
UNION ALL SELECT "column", 'imbalance', 'warning' FROM meant WHERE known > 0 AND meaning IN ('categorical', 'boolean') AND top_share >= 0.9
UNION ALL SELECT "column", 'placeholder_value', 'warning' FROM meant WHERE known > 0 AND sentinels <> ''
UNION ALL SELECT "column", 'date_gaps', 'warning' FROM meant WHERE known > 0 AND empty_periods > 0
UNION ALL SELECT c, 'unit_shift', 'warning' FROM shifted
UNION ALL SELECT "column", CASE WHEN n_units >= 2 THEN 'mixed_units' ELSE 'numeric_with_unit' END, CASE WHEN n_units >= 2 THEN 'warning' ELSE 'info' END FROM meant WHERE known > 0 AND unit_share >= 0.8 AND n_units >= 1
UNION ALL SELECT "column", 'blank_strings', 'info' FROM meant WHERE known > 0 AND blank > 0
"""


@query(_warnings_sql())
def profile_warnings_events(t: Read) -> DataFrame:
    """All eleven warnings on columns, from the profile of a messy export: one pass for its cells, one in the order of its rows."""
    events = t("events")
    export = events.sparkSession.sql(_EXPORT.replace("FROM events", "FROM {events}"), events=events)
    return profiles.profile_warnings(profiles.profile_table(export, "event_id"))
