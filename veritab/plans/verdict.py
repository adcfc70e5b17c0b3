"""Whether a research question can be answered: rules over one row of measurements."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import detectable_correlation, detectable_difference, margin_of_error
from .guard import Refused, check_expression

# Thresholds of the rules, and the roles that a question cannot do without.
MIN_COMPLETE, SMALL_SAMPLE, HIGH_MISSING, MIN_GROUP_ROWS, SMALL_GROUP, UNBALANCED, NEAR_CONSTANT, TIME_COVERAGE = 10, 30, 0.30, 5, 20, 10.0, 0.95, 0.80
LARGE_D, LARGE_R, LARGE_MARGIN = 0.8, 0.5, 0.1
CORE_ROLES = ("dependent", "independent")
GROUP_LIMIT = 50

#: code, severity and the condition over the measurements, in the order they are reported. A
#: condition over a null measurement does not fire.
RULES = [
    ("core_gap", "fail", "core_gaps > 0"),
    ("covariate_gap", "warn", "covariate_gaps > 0"),
    ("proxy_only", "warn", "core_proxies > 0"),
    ("multi_table", "warn", "tables > 1"),
    ("no_rows_in_scope", "fail", "rows_in_scope = 0"),
    ("too_few_complete", "fail", f"rows_in_scope > 0 and complete_cases < {MIN_COMPLETE}"),
    ("small_sample", "warn", f"rows_in_scope > 0 and complete_cases >= {MIN_COMPLETE} and complete_cases < {SMALL_SAMPLE}"),
    ("high_missing", "warn", f"most_missing > {HIGH_MISSING}"),
    ("outcome_constant", "fail", "rows_in_scope > 0 and outcome_distinct <= 1"),
    ("outcome_near_constant", "warn", f"rows_in_scope > 0 and outcome_distinct > 1 and outcome_top_share >= {NEAR_CONSTANT}"),
    ("too_few_groups", "fail", "needs_groups and complete_cases > 0 and n_groups < 2"),
    ("small_group", "warn", f"needs_groups and complete_cases > 0 and n_groups >= 2 and smallest_group < {SMALL_GROUP}"),
    ("unbalanced_groups", "warn", f"needs_groups and complete_cases > 0 and n_groups >= 2 and largest_group / smallest_group > {UNBALANCED}"),
    ("group_constant_outcome", "warn", "needs_groups and constant_groups > 0"),
    ("no_time_overlap", "fail", "time_coverage <= 0"),
    ("partial_time_coverage", "warn", f"time_coverage > 0 and time_coverage < {TIME_COVERAGE}"),
    ("low_power", "warn", "underpowered"),
    ("causal_claim", "warn", "kind = 'causal'"),
    ("confounders", "info", "confounders > 0"),
]


@dataclass(frozen=True)
class Construct:
    """A concept of a question: its role, how it is matched (direct, proxy, derivable; None for a gap), by which column expression of which table."""

    role: str
    match: str | None = "direct"
    expression: str | None = None
    table: str | None = None


@dataclass(frozen=True)
class Question:
    """What is asked of one table: kind (descriptive, correlational, comparative, causal), constructs, scope, time."""

    kind: str
    constructs: list[Construct] = field(default_factory=list)
    scope: str | None = None
    time_column: str | None = None
    time_start: str | None = None
    time_end: str | None = None
    confounders: int = 0
    groups: bool = False


def time_scope(df: DataFrame, column: str, start: str | None, end: str | None) -> Column:
    """Rows within two ISO dates: by year where the column is a number of years, else by date."""
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        low, high = (int(start[:4]) if start else None), (int(end[:4]) if end else None)
        at = F.col(column)
    else:
        low, high = (F.lit(start).cast("date") if start else None), (F.lit(end).cast("date") if end else None)
        at = F.col(column).cast("date")
    parts = ([at >= low] if low is not None else []) + ([at <= high] if high is not None else [])
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _extent(df: DataFrame, question: Question) -> DataFrame:
    """Share of the period asked for that the table's dates cover; one row, null where nothing is asked."""
    if not (question.time_column and question.time_start and question.time_end):
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("time_coverage"))
    c = F.col(question.time_column)
    years = dict(df.dtypes)[question.time_column] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    day = F.when(c.between(1000, 9999), F.make_date(c.cast("int"), F.lit(1), F.lit(1))) if years else c.cast("date")
    span = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return span.select(time_coverage(F.col("first"), F.col("last"), F.lit(question.time_start).cast("date"), F.lit(question.time_end).cast("date")).alias("time_coverage"))


def time_coverage(first: Column, last: Column, wanted_first: Column, wanted_last: Column) -> Column:
    """Days of overlap over days asked for, 1 at most; null if a date is missing or the period ends before it starts."""
    overlap = F.greatest(F.lit(0), F.datediff(F.least(last, wanted_last), F.greatest(first, wanted_first)) + 1)
    known = first.isNotNull() & last.isNotNull() & (wanted_last >= wanted_first)
    return F.when(known, F.least(F.lit(1.0), overlap / (F.datediff(wanted_last, wanted_first) + 1)))


def _resolved(df: DataFrame, construct: Construct) -> Construct:
    """The construct, as a gap if it is a derived value that cannot be computed; raises ``Refused`` for others."""
    if construct.match and construct.expression:
        try:
            check_expression(df, construct.expression)
        except Refused:
            if construct.match != "derivable":
                raise
            return replace(construct, match=None, expression=None)
    return construct


def measure(df: DataFrame, question: Question) -> DataFrame:
    """All that the rules need, in one row, from one pass over counts of (group, outcome) and one over the table.

    The scope and all expressions pass the guard (``guard.check_expression``) first; ``Refused``
    is raised for those that may not run, but a derived value that cannot be computed is a gap.
    Constructs of other tables than the outcome's are not measured. Groups with fewer than
    ``MIN_GROUP_ROWS`` complete rows do not count; the largest 51 are looked at. Time coverage
    is measured before the scope is applied.
    """
    rows = df.where(check_expression(df, question.scope)) if question.scope else df
    if question.time_column:
        rows = rows.where(time_scope(df, question.time_column, question.time_start, question.time_end))
    home = next((c.table for c in question.constructs if c.role == "dependent"), None)
    question = replace(question, constructs=[_resolved(df, c) if c.table in (None, home) else c for c in question.constructs])
    mapped = [c for c in question.constructs if c.match and c.expression and c.table in (None, home)]
    first = lambda role: next((c for c in mapped if c.role == role), None)
    outcome, group = first("dependent"), first("independent") if question.groups else None
    values = [F.expr(c.expression) for c in mapped]
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    text = lambda c: F.expr(c.expression).cast("string") if c else F.lit(None).cast("string")
    gone = [F.avg(v.isNull().cast("double")) for v in values]
    base = rows.agg(
        F.count("*").alias("rows_in_scope"), F.count_if(complete).alias("complete_cases"),
        (F.greatest(*gone) if len(gone) > 1 else gone[0] if gone else F.lit(None).cast("double")).alias("most_missing"),
    )
    cells = rows.select(text(group).alias("g"), text(outcome).alias("o"), complete.alias("whole")).groupBy("g", "o", "whole").agg(F.count("*").alias("n"))
    outcomes = cells.where("o is not null").groupBy("o").agg(F.sum("n").alias("n")).agg(F.count("*").alias("outcome_distinct"), (F.max("n") / F.sum("n")).alias("outcome_top_share"))
    sizes = cells.where("whole and g is not null").groupBy("g").agg(F.sum("n").alias("n"), F.count("o").alias("k")).orderBy(F.desc("n"), "g").limit(GROUP_LIMIT + 1)
    counted = sizes.where(F.col("n") >= MIN_GROUP_ROWS)
    groups = counted.agg(
        F.count("*").alias("n_groups"), F.min("n").alias("smallest_group"), F.max("n").alias("largest_group"), F.count_if(F.col("k") <= 1).alias("constant_groups"),
        F.sort_array(F.collect_list("n")).alias("sizes"),
    )
    second = F.when(F.size("sizes") >= 2, F.get("sizes", F.lit(1)))
    groups = groups.withColumn("second_smallest", second).drop("sizes")
    whole = base.crossJoin(F.broadcast(outcomes)).crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(_extent(df, question)))  # single rows
    gaps = [c for c in question.constructs if c.match is None]
    facts = {
        "needs_groups": F.lit(group is not None),
        "core_gaps": F.lit(sum(c.role in CORE_ROLES for c in gaps)),
        "covariate_gaps": F.lit(sum(c.role not in CORE_ROLES for c in gaps)),
        "core_proxies": F.lit(sum(c.match == "proxy" and c.role in CORE_ROLES for c in question.constructs)),
        "tables": F.lit(len({c.table for c in question.constructs if c.table})),
        "kind": F.lit(question.kind),
        "confounders": F.lit(question.confounders),
        "outcome_distinct": F.col("outcome_distinct") if outcome else F.lit(None).cast("long"),
    }
    whole = whole.withColumns(facts)
    correlational = F.lit(group is None and first("independent") is not None)
    n = F.col("complete_cases")
    weak = (
        F.when(F.col("needs_groups"), F.when(F.col("n_groups") >= 2, detectable_difference(F.col("smallest_group"), F.col("second_smallest")) > LARGE_D))
        .when(correlational, detectable_correlation(n) > LARGE_R)
        .when(F.lit(question.kind == "descriptive"), margin_of_error(n) > LARGE_MARGIN)
    )
    return whole.withColumn("underpowered", (n > 0) & ~_failing() & F.coalesce(weak, F.lit(False)))


def _failing() -> Column:
    """Whether any rule fails."""
    out = F.lit(False)
    for _, severity, when in RULES:
        if severity == "fail":
            out = out | F.coalesce(F.expr(when), F.lit(False))
    return out


def apply_rules(measurements: DataFrame) -> DataFrame:
    """A row per rule that fires: the measurements' columns, code and severity."""
    fired = [F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in RULES]
    return measurements.withColumn("rule", F.explode(F.filter(F.array(*fired), lambda r: r.isNotNull()))).select(*measurements.columns, "rule.code", "rule.severity")


def verdict(measurements: DataFrame) -> DataFrame:
    """not_answerable if a rule fails, partial if one warns, else answerable."""
    warning = F.lit(False)
    for _, severity, when in RULES:
        if severity == "warn":
            warning = warning | F.coalesce(F.expr(when), F.lit(False))
    return measurements.withColumn("verdict", F.when(_failing(), "not_answerable").when(warning, "partial").otherwise("answerable"))


# Rules that are findings about the data, whatever the question.
DATA_RULES = (
    "high_missing", "small_group", "unbalanced_groups", "outcome_near_constant",
    "group_constant_outcome", "partial_time_coverage", "too_few_complete", "small_sample",
    "outcome_constant", "too_few_groups",
)


def data_findings(fired: DataFrame) -> DataFrame:
    """Of fired rules those about the data: code and severity."""
    return fired.where(F.col("code").isin(*DATA_RULES)).select("code", "severity")
