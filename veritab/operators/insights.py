"""From profiles and test results to ranked findings, each by fixed rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pairs, stats
from .stats import contingency, effect_magnitude, rank_score

# Thresholds of the column and table rules.
HIGH_MISSING, SEVERE_MISSING, IMBALANCE = 0.2, 0.5, 0.9
UNIT_SHARE, UNIT_MIN_SHARE = 0.8, 0.01
NEAR_PERFECT = {"spearman": 0.98, "cramers_v": 0.95, "eta": 0.95}
DUPLICATE_SHARE, DEPENDENCY_V, DEPENDENCY_SMD = 0.98, 0.2, 0.5
#: Associations that are kept: the strongest, of at least this size.
KEEP_PAIRS, LEAST_ASSOCIATION = 50, 0.1
#: Strata of a confounder check: rows each, and how many.
STRATUM_ROWS, STRATA = 30, 2
#: A mean effect within strata under this share of the crude one is weaker; an effect that reverses has this size.
WEAKER, REVERSING = 0.5, 0.1
#: Effects with a sign.
SIGNED = ("rho", "tau", "rank_biserial")
#: Values of an ordered category at least, of a group at most, and of a confounder at most.
ORDINAL_MIN, MAX_GROUPS, MAX_LEVELS = 6, 20, 6

WARNING_FACTS = "column string, rows long, missing long, n_distinct long, semantic_type string, top_share double, n_sentinels long, empty_periods long, shifted boolean, unit_share double, n_units long, blank long"


def column_warnings(facts: DataFrame) -> DataFrame:
    """Rules over one row of facts per column (``WARNING_FACTS``): column, code, severity.

    A fact that is null or a column that is absent fires no rule; an empty column gets no other.
    """
    have = set(facts.columns)
    fact = lambda c: F.col(c) if c in have else F.lit(None)
    known = F.col("rows") - F.col("missing")
    share = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(F.lit(0.0))
    kind = fact("semantic_type")
    unit, several = fact("unit_share") >= UNIT_SHARE, fact("n_units") >= 2
    rules = [
        ("high_missing", "severe", share >= SEVERE_MISSING),
        ("high_missing", "warning", (share >= HIGH_MISSING) & (share < SEVERE_MISSING)),
        ("constant", "warning", kind == "constant"),
        ("identifier", "info", kind == "identifier"),
        ("imbalance", "warning", kind.isin("categorical", "boolean") & (fact("top_share") >= IMBALANCE)),
        ("placeholder_value", "warning", fact("n_sentinels") > 0),
        ("date_gaps", "warning", fact("empty_periods") > 0),
        ("unit_shift", "warning", fact("shifted").cast("boolean")),
        ("mixed_units", "warning", unit & several),
        ("numeric_with_unit", "info", unit & (fact("n_units") == 1)),
        ("blank_strings", "info", fact("blank") > 0),
    ]
    fired = [F.when((known > 0) & when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in rules]
    empty = F.when((F.col("rows") > 0) & (known == 0), F.struct(F.lit("empty_column").alias("code"), F.lit("severe").alias("severity")))
    return facts.select("column", F.explode(F.filter(F.array(empty, *fired), lambda r: r.isNotNull())).alias("rule")).select("column", "rule.code", "rule.severity")


def table_warnings(rows: DataFrame, duplicates: DataFrame, same: DataFrame, associations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rules over a table: code, severity, column, other.

    ``rows`` and ``duplicates`` are rows, duplicates of a table; ``same`` a, b, share of equal
    columns; ``associations`` a, b, measure, value; ``dependencies`` column, by, strength. Of a
    column's missing-data dependencies the strongest counts.
    """
    def plain(df: DataFrame, code: str, severity: str, column: Column, other: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), column.alias("column"), other.alias("other"))

    none = F.lit(None).cast("string")
    limit = F.create_map(*(F.lit(x) for kv in NEAR_PERFECT.items() for x in kv))
    strongest_of = dependencies.groupBy("column").agg(F.max_by("by", F.struct("strength", "by")).alias("by"))
    parts = [
        plain(duplicates.where("duplicates > 0"), "duplicate_rows", "warning", none, none),
        plain(rows.where("rows = 0"), "no_rows", "severe", none, none),
        plain(same.where(F.col("share") >= DUPLICATE_SHARE), "near_duplicate_columns", "warning", F.col("b"), F.col("a")),
        plain(associations.where(F.abs("value") >= limit[F.col("measure")]), "near_perfect_association", "warning", F.col("b"), F.col("a")),
        plain(strongest_of, "missing_depends", "warning", F.col("column"), F.col("by")),
    ]
    return reduce(DataFrame.union, parts)


def pairwise_associations(df: DataFrame, numeric: list[str], categories: list[str], least: float = LEAST_ASSOCIATION, keep: int = KEEP_PAIRS) -> DataFrame:
    """Associations of all pairs of columns over all rows: a, b, measure, value, n.

    Spearman for two numbers, Cramer's V for two categories (50 values at most), eta for a
    category and a number; the ``keep`` strongest of at least ``least``. The table is read as
    often for many columns as for few (see ``pairs``).
    """
    parts = [pairs.rank_correlations(df, numeric), pairs.category_associations(df, categories), pairs.correlation_ratios(df, categories, numeric)]
    return strongest(reduce(DataFrame.union, parts).where("value is not null"), keep, least)


def missing_dependencies(df: DataFrame, columns: list[str], categories: list[str], numeric: list[str]) -> DataFrame:
    """Columns whose missing values depend on another one: column, by, kind, measure, strength, highest, lowest.

    For a category Cramer's V of being missing, of ``DEPENDENCY_V`` or more, with the groups of
    20 rows or more that miss most and least; for a number the standardised difference of
    ``DEPENDENCY_SMD`` or more, with its means where missing and present.
    """
    parts = []
    for c in columns:
        for by in (b for b in categories if b != c):
            gone = df.withColumn("__gone", F.col(c).isNull())
            v = stats.chi_square(gone, "__gone", by, stats.PAIR_ROWS).select("v")
            rates = missing_rates(df, c, by)
            ends = rates.agg(F.max_by("group", F.struct("missing_rate", "group")).alias("highest"), F.min_by("group", F.struct("missing_rate", "group")).alias("lowest"), F.count("*").alias("k"))
            both = v.crossJoin(F.broadcast(ends)).where((F.col("v") >= DEPENDENCY_V) & (F.col("k") >= 2))  # single rows
            parts.append(both.select(F.lit(c).alias("column"), F.lit(by).alias("by"), F.lit("categorical").alias("kind"), F.lit("cramers_v").alias("measure"), F.col("v").alias("strength"), "highest", "lowest"))
        for by in (b for b in numeric if b != c):
            found = stats.missing_shift(df, c, by).where(F.abs("smd") >= DEPENDENCY_SMD)
            means = [F.col(m).cast("string") for m in ("mean_when_missing", "mean_when_present")]
            parts.append(found.select(F.lit(c).alias("column"), F.lit(by).alias("by"), F.lit("numeric").alias("kind"), F.lit("smd").alias("measure"), F.abs("smd").alias("strength"), means[0].alias("highest"), means[1].alias("lowest")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, by string, kind string, measure string, strength double, highest string, lowest string")
    return reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class ColumnFacts:
    """What choosing a test needs to know of a column."""

    name: str
    semantic_type: str
    n_distinct: int = 0
    number: bool = False
    integer: bool = False
    uniqueness: float = 0.0
    missing: int = 0
    personal: bool = False

    @property
    def is_row_number(self) -> bool:
        """A complete integer column with another value in each row."""
        return self.integer and self.uniqueness == 1.0 and self.missing == 0

    @property
    def usable(self) -> bool:
        """Whether a column may be analysed: no identifier, constant, free text or personal data."""
        return not (self.personal or self.is_row_number or self.semantic_type in ("identifier", "constant", "free_text"))

    @property
    def is_ordinal(self) -> bool:
        """A number with few values, but enough to rank."""
        return self.semantic_type == "categorical" and self.number and self.n_distinct >= ORDINAL_MIN

    @property
    def is_numeric(self) -> bool:
        return self.semantic_type == "numeric" or self.is_ordinal

    @property
    def is_grouping(self) -> bool:
        return not self.is_ordinal and self.semantic_type in ("categorical", "boolean") and 2 <= self.n_distinct <= MAX_GROUPS


def choose_test(outcome: ColumnFacts, explanatory: ColumnFacts) -> tuple[str, str, str] | None:
    """The test for two columns and its x and y, None if none fits: ordered categories count as numbers."""
    if outcome.is_numeric and explanatory.semantic_type == "datetime":
        return "trend", explanatory.name, outcome.name
    if outcome.is_numeric and explanatory.is_numeric:
        return "spearman", explanatory.name, outcome.name
    for value, group in ((outcome, explanatory), (explanatory, outcome)):
        if value.is_numeric and group.is_grouping:
            return ("mann_whitney" if group.n_distinct == 2 else "kruskal_wallis"), value.name, group.name
    if outcome.is_grouping and explanatory.is_grouping:
        return "chi_square", explanatory.name, outcome.name
    return None


def rank_findings(results: DataFrame) -> DataFrame:
    """Scores of test results (test, effect, n, relevance, p_adjusted), with magnitude and status.

    Without evidence (p of .05 or more) no_evidence; a negligible effect is weak, any other a
    finding.
    """
    score = rank_score(F.col("test"), F.col("effect"), F.col("n"), F.col("relevance"), F.col("p_adjusted"))
    size = effect_magnitude(F.col("test"), F.col("effect"))
    status = F.when(F.col("p_adjusted") >= 0.05, "no_evidence").when(size == "negligible", "weak").otherwise("finding")
    return results.withColumns({"magnitude": size, "score": score, "status": status})


def cramers_v_by_stratum(df: DataFrame, a: str, b: str, stratum: str) -> DataFrame:
    """Cramer's V of two columns within every value of a third: stratum, n, v."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(stratum).isNotNull())
    cells = rows.groupBy(F.col(stratum).cast("string").alias("s"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("o"))
    by_a, by_b = cells.groupBy("s", "a").agg(F.sum("o").alias("ra")), cells.groupBy("s", "b").agg(F.sum("o").alias("rb"))
    total = cells.groupBy("s").agg(F.sum("o").alias("n"))
    # Chi-square from observed cells alone: sum of o squared over the margins' product, less one.
    met = cells.join(by_a, ["s", "a"]).join(by_b, ["s", "b"])
    share = met.groupBy("s").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("rb"))).alias("q"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    v = F.when(F.least("r", "c") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("q") - 1) / (F.least("r", "c") - 1)))
    return share.join(total, "s").select(F.col("s").alias("stratum"), "n", v.alias("v"))


def mean_gap_by_stratum(df: DataFrame, value: str, group: str, first: str, second: str, stratum: str) -> DataFrame:
    """Mean of the second group less the first's within every stratum of a third column."""
    x, g = F.col(value).cast("double"), F.col(group).cast("string")
    out = df.where(F.col(stratum).isNotNull() & g.isin(first, second) & x.isNotNull()).groupBy(F.col(stratum).cast("string").alias("stratum"))
    found = out.agg(F.count("*").alias("n"), (F.avg(F.when(g == second, x)) - F.avg(F.when(g == first, x))).alias("effect"))
    return found.where("effect is not null")


def confounder_verdict(strata: DataFrame, crude: float, signed: bool = True) -> DataFrame:
    """Does an effect hold within strata (stratum, n, effect)? One row: strata, mean_effect, verdict.

    Strata under ``STRATUM_ROWS`` rows do not count; with fewer than ``STRATA`` the verdict is
    ``unclear``. An effect with a sign reverses if any stratum has the other sign and an effect
    of ``REVERSING`` or more. Else it weakens if the mean size within strata, weighted by rows,
    is under half the crude one's, and holds otherwise.
    """
    used = strata.where((F.col("n") >= STRATUM_ROWS) & F.col("effect").isNotNull())
    mean = F.sum(F.abs("effect") * F.col("n")) / F.sum("n")
    other = F.coalesce(F.bool_or((F.col("effect") * F.lit(crude) < 0) & (F.abs("effect") >= REVERSING)), F.lit(False))
    out = used.agg(F.count("*").alias("strata"), mean.alias("mean_effect"), other.alias("other_sign"))
    verdict = (
        F.when(F.col("strata") < STRATA, "unclear").when(F.lit(signed) & F.col("other_sign"), "reverses").when((F.lit(abs(crude)) > 0) & (F.col("mean_effect") < WEAKER * abs(crude)), "weakens").otherwise("holds")
    )
    return out.select("strata", "mean_effect", verdict.alias("verdict"))


def missing_rates(df: DataFrame, column: str, group: str, least_rows: int = 20) -> DataFrame:
    """Groups with the share of rows that lack a value, groups of ``least_rows`` or more."""
    out = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"), F.avg(F.col(column).isNull().cast("double")).alias("missing_rate"))
    return out.where((F.col("n") >= least_rows) & F.col("group").isNotNull())


def strongest(edges: DataFrame, k: int = 50, least: float = 0.1) -> DataFrame:
    """The ``k`` strongest associations (a, b, value) of at least ``least``."""
    return edges.where(F.abs("value") >= least).orderBy(F.desc(F.abs("value")), "a", "b").limit(k)


def confounders(edges: DataFrame, outcome: str, explanatory: str, levels: DataFrame | None = None, least: float = 0.1, k: int = 2) -> DataFrame:
    """Grouping columns linked to both of two columns, the largest sum of links first: column, to_outcome, to_explanatory, strength.

    ``levels`` (column, n_distinct) limits them to columns of 2 to ``MAX_LEVELS`` values.
    """
    both = edges.select("a", "b", "value").union(edges.select("b", "a", "value")).where(F.abs("value") >= least)
    x = both.where(F.col("a") == outcome).groupBy(F.col("b").alias("column")).agg(F.max(F.abs("value")).alias("to_outcome"))
    y = both.where(F.col("a") == explanatory).groupBy(F.col("b").alias("column")).agg(F.max(F.abs("value")).alias("to_explanatory"))
    met = x.join(y, "column").where(~F.col("column").isin(outcome, explanatory)).withColumn("strength", F.col("to_outcome") + F.col("to_explanatory"))
    if levels is not None:
        met = met.join(levels.where(F.col("n_distinct").between(2, MAX_LEVELS)).select("column"), "column", "left_semi")
    return met.orderBy(F.desc("strength"), F.desc("column")).limit(k)


def possible_confounders(edges: DataFrame, outcome: str, explanatory: str, mapped: list[str], least: float = 0.1, k: int = 5) -> DataFrame:
    """Columns outside a question linked to both of its variables, the first ``k`` by name: column."""
    both = edges.select("a", "b", "value").union(edges.select("b", "a", "value")).where(F.abs("value") >= least)
    found = both.where(F.col("a").isin(outcome, explanatory)).groupBy(F.col("b").alias("column")).agg(F.count_distinct("a").alias("k"))
    return found.where((F.col("k") == 2) & ~F.col("column").isin(*mapped, outcome, explanatory)).select("column").orderBy("column").limit(k)


def group_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) and the percentage of each within its value of a: a, b, n, share."""
    return contingency(df, a, b).select("a", "b", F.col("observed").alias("n"), (100.0 * F.col("observed") / F.col("row")).alias("share"))


def share_series(df: DataFrame, a: str, b: str, k: int = 4) -> DataFrame:
    """Shares within each value of a, a column ``% <value>`` for each of the ``k`` commonest values of b."""
    shares = group_shares(df, a, b)
    top = [r["b"] for r in shares.groupBy("b").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "b").limit(k).collect()]
    return shares.groupBy("a").agg(*(F.round(F.max(F.when(F.col("b") == v, F.col("share"))), 1).alias(f"% {v}") for v in top))


def trend_series(df: DataFrame, time: str, value: str, period: str | None = None) -> DataFrame:
    """Mean and count of a value by time, or by calendar period: time, mean, n."""
    at = F.col(time) if period is None else F.date_trunc(period, F.col(time)).cast("date")
    x = F.col(value).cast("double")
    return df.where(F.col(time).isNotNull() & x.isNotNull()).groupBy(at.alias("time")).agg(F.avg(x).alias("mean"), F.count("*").alias("n"))


def sampled(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``keys`` (all columns if none) and seed; the same rows every time."""
    order = F.xxhash64(*(keys or df.columns), F.lit(seed))
    return df.orderBy(order, *(keys or df.columns)).limit(n)


#: Association from which two columns are one under two names; analyses of a plan at most.
ALIAS, MAX_ANALYSES = 0.95, 20
#: Sources of analyses in order of precedence.
SOURCES = ("rq", "llm", "profile")


def aliases(edges: DataFrame) -> dict[str, str]:
    """Columns that are one under several names, each with the first of its names.

    Of associations (at most ``KEEP_PAIRS`` rows) those of ``ALIAS`` or more link.
    """
    group: dict[str, str] = {}
    for row in edges.where(F.abs("value") >= ALIAS).select("a", "b").orderBy("a", "b").limit(KEEP_PAIRS).collect():
        one, other = group.get(row["a"], row["a"]), group.get(row["b"], row["b"])
        first, last = min(one, other), max(one, other)
        group |= {c: first for c, g in group.items() if g == last} | {row["a"]: first, row["b"]: first}
    return group


def combined_plan(analyses: DataFrame, edges: DataFrame, k: int = MAX_ANALYSES) -> DataFrame:
    """Analyses (position, x, y, source) without repeats, the ``k`` first by source and position.

    Two analyses repeat if their columns are the same in any order, aliases counted as one; a
    pair of two names of one column is none.
    """
    group = aliases(edges)
    name = lambda c: F.coalesce(F.create_map(*(F.lit(v) for kv in group.items() for v in kv))[F.col(c)], F.col(c)) if group else F.col(c)
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    keyed = analyses.withColumns({"__a": F.least(name("x"), name("y")), "__b": F.greatest(name("x"), name("y")), "__rank": rank}).where("__a <> __b")
    best = keyed.groupBy("__a", "__b").agg(F.min(F.struct("__rank", "position", "x", "y", "source")).alias("m"))
    return best.select("m.*").orderBy("__rank", "position").limit(k).select("position", "x", "y", "source")


def grouping_column(column: ColumnFacts, kind: str) -> bool:
    """Whether an explanatory column splits rows into groups: categories do, numbers of few values in comparisons only."""
    if column.semantic_type in ("categorical", "boolean"):
        return True
    return column.semantic_type == "numeric" and kind == "comparative" and 0 < column.n_distinct <= MAX_GROUPS


def placeholder_caveats(findings: DataFrame, codes: DataFrame) -> DataFrame:
    """Findings (id, x, y) over columns that hold codes for missing values (column, code, n): id, column, codes."""
    used = findings.select("id", F.explode(F.array_distinct(F.array("x", "y"))).alias("column"))
    listed = codes.groupBy("column").agg(F.array_sort(F.collect_set("code")).alias("codes"))  # seven codes at most
    return used.join(F.broadcast(listed), "column").select("id", "column", "codes")
