"""Rank and contingency statistics from counts of distinct values.

Ranks depend only on how often each value occurs, so columns are reduced to counts of values, of
pairs of values, or of values by group, before anything is ranked (see ``ranks``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .ranks import finite, quantiles, ranked_counts, with_running

# Normal quantiles for 5 % two-sided and for 80 % power.
Z_ALPHA, Z_POWER = 1.959964, 0.841621
#: Complete rows that an association needs, and that a test needs; categories that it may have.
PAIR_ROWS, TEST_ROWS, MAX_CATEGORIES = 20, 5, 50


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a numeric column with its count and average rank: value, ties, rank."""
    counts = df.select(finite(F.col(column)).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("ties"))
    return ranked_counts(counts, "value", "ties").select("value", "ties", "rank")


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts c of the distinct pairs (x, y) of finite values."""
    both = df.select(finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    return both.groupBy("x", "y").agg(F.count("*").alias("c"))


def spearman(df: DataFrame, x: str, y: str, least: int = PAIR_ROWS) -> DataFrame:
    """Rank correlation of two numeric columns over complete rows: n, rho.

    Rho is null if a column is constant or with fewer than ``least`` rows. Pairs of values are
    counted first, so that a common value is one row where ranks are joined.
    """
    cells = _cells(df, x, y)

    def ranks(column: str) -> DataFrame:
        counts = cells.groupBy(column).agg(F.sum("c").alias("t"))
        return ranked_counts(counts, column, "t").select(column, F.col("rank").alias(f"r{column}"))

    met = cells.join(ranks("x"), "x").join(ranks("y"), "y")
    n = F.sum("c")
    mean = (n + 1) / 2.0  # of average ranks
    square = lambda a, b: F.sum(F.col("c") * F.col(a) * F.col(b)) - n * mean * mean
    out = met.agg(F.coalesce(n, F.lit(0)).alias("n"), square("rx", "ry").alias("xy"), square("rx", "rx").alias("xx"), square("ry", "ry").alias("yy"))
    spread = (F.col("xx") > 1e-9) & (F.col("yy") > 1e-9) & (F.col("n") >= least)
    return out.select("n", F.when(spread, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """For each group its size and sum of ranks, with the whole's n and tie term."""
    cells = df.select(finite(F.col(value)).alias("x"), F.col(group).cast("string").alias("g")).where("x is not null and g is not null")
    placed = with_running(cells.groupBy("g", "x").agg(F.count("*").alias("c")), [], "x", ["c"])
    ties = F.col("same_c").cast("double")
    # Over the groups of a value, c (t^2 - 1) adds up to t^3 - t.
    sums = placed.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("before_c") + (ties + 1) / 2)).alias("rank_sum"), F.sum(F.col("c") * (ties * ties - 1)).alias("tied"))
    sums = written(sums, "rank-sums")
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("total"), F.sum("tied").alias("tie_term")))).drop("tied")


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the alphabetically first of two groups and the rank-biserial effect; one row.

    No row unless there are exactly two groups of two values or more.
    """
    sums = rank_sums(df, value, group).limit(3)  # a third group tells that the test does not fit
    smallest = sums.groupBy().agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("g", "n", "rank_sum", "tie_term")))).alias("s"))
    both = smallest.where((F.col("k") == 2) & (F.array_min(F.transform("s", lambda g: g["n"])) >= 2))
    n1, n2 = F.col("s")[0]["n"], F.col("s")[1]["n"]
    u = F.col("s")[0]["rank_sum"] - n1 * (n1 + 1) / 2.0
    return both.select(
        F.col("s")[0]["g"].alias("first_group"), n1.alias("n1"), n2.alias("n2"), u.alias("u"), (2 * u / (n1.cast("double") * n2) - 1).alias("effect"), F.col("s")[0]["tie_term"].alias("tie_term")
    )


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with tie correction and epsilon squared; one row, none unless there are 2 to 50 groups."""
    sums = rank_sums(df, value, group)
    n = F.first("total").cast("double")
    h = (12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)) / F.nullif(1 - F.first("tie_term") / (n * n * n - n), F.lit(0.0))
    out = sums.agg(F.count("*").alias("k"), F.first("total").alias("n"), h.alias("h")).where(F.col("k").between(2, MAX_CATEGORIES))
    return out.withColumn("effect", F.col("h") / (F.col("n") - 1))


def group_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Size, median and mean of the finite values of each group: group, n, median, mean."""
    rows = df.select(F.col(group).cast("string").alias("group"), finite(F.col(value)).alias("x")).where("group is not null and x is not null")
    means = rows.groupBy("group").agg(F.avg("x").alias("mean"))
    medians = quantiles(rows, "group", "x", [0.5]).select("group", "n", F.col("q")[0].alias("median"))
    return medians.join(means, "group").select("group", "n", "median", "mean")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed counts of pairs of values with the sums of their row and column: a, b, observed, row, column."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("observed"))
    rows, columns = cells.groupBy("a").agg(F.sum("observed").alias("row")), cells.groupBy("b").agg(F.sum("observed").alias("column"))
    return cells.join(rows, "a").join(columns, "b").select("a", "b", "observed", "row", "column")


def chi_square(df: DataFrame, a: str, b: str, least: int = TEST_ROWS) -> DataFrame:
    """Chi-square without correction, Cramer's V, and the share of small expected counts; one row.

    Chi-square comes from observed cells alone: n (sum of o squared over its margins - 1).
    V is null with fewer than ``least`` rows or one category on a side. Only with at most ``MAX_CATEGORIES``
    categories a side are expected counts of all pairs looked at; else their share is null, as
    are statistic and V, for the test is refused.
    """
    table = contingency(df, a, b)
    q = F.sum(F.col("observed") * F.col("observed") / (F.col("row").cast("double") * F.col("column")))
    base = table.agg(F.coalesce(F.sum("observed"), F.lit(0)).alias("n"), q.alias("q"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    fits = (F.col("r") <= MAX_CATEGORIES) & (F.col("c") <= MAX_CATEGORIES)
    # Margins as one row of two short lists; the limit is of no effect where the test is not refused.
    margin = lambda side, total: table.groupBy(side).agg(F.first(total).alias("t")).limit(MAX_CATEGORIES + 1).agg(F.collect_list("t").alias(f"of_{side}"))
    whole = base.crossJoin(F.broadcast(margin("a", "row"))).crossJoin(F.broadcast(margin("b", "column")))
    low = F.expr("aggregate(of_a, 0, (s, x) -> s + size(filter(of_b, y -> cast(x as double) * y < 5 * n)))")
    chi2 = F.when(fits, F.greatest(F.lit(0.0), F.col("n") * (F.col("q") - 1)))
    side = F.least("r", "c")
    v = F.when(fits & (side > 1) & (F.col("n") >= least), F.sqrt(chi2 / (F.col("n") * (side - 1))))
    return whole.select("n", chi2.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), v.alias("v"), F.when(fits & (F.col("n") > 0), low / (F.col("r") * F.col("c"))).alias("small_share"))


def correlation_ratio(df: DataFrame, category: str, value: str, least: int = PAIR_ROWS) -> DataFrame:
    """Eta: the root of between-group over total variation; one row: n, eta.

    Null with fewer than ``least`` rows, one group, or a constant value.
    """
    x = finite(F.col(value))
    rows = df.select(F.col(category).alias("g"), x.alias("x")).where("g is not null and x is not null")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    square = F.sum(F.col("n") * F.col("m") * F.col("m"))
    out = groups.agg(
        F.coalesce(n, F.lit(0)).alias("n"), F.greatest(F.lit(0.0), square - n * mean * mean).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("k")
    )
    all_of_it = F.col("between") + F.col("within")
    return out.select("n", F.when((F.col("n") >= least) & (F.col("k") >= 2) & (all_of_it > 0), F.sqrt(F.col("between") / all_of_it)).alias("eta"))


def kendall_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of two numeric columns: n, s, tau and the variance of s; one row.

    Null tau with fewer than ``TEST_ROWS`` rows or three values of ``x``, or a constant ``y``.
    Values of y are numbered in order. Two rows with different y part at one bit of these
    numbers: within the rows that agree in all higher bits, the one with bit 1 has the larger
    y. So for every bit, running counts of zeros and ones over x give the pairs that agree and
    disagree, without any join of pairs: the work is that of the distinct (x, y), times the
    bits, and a range of x is a task.
    """
    cells = _cells(df, x, y)

    def ties(column: str) -> DataFrame:
        g = cells.groupBy(column).agg(F.sum("c").cast("double").alias("t"))
        t = F.col("t")
        terms = {"pairs": t * (t - 1) / 2, "triples": t * (t - 1) * (t - 2), "weighted": t * (t - 1) * (2 * t + 5)}
        return g.agg(F.count("*").alias(f"k_{column}"), *(F.coalesce(F.sum(e), F.lit(0.0)).alias(f"{name}_{column}") for name, e in terms.items()))

    values = cells.select("y").distinct().withColumn("one", F.lit(1).cast("long"))
    bits = max(1, (max(1, values.count()) - 1).bit_length())
    numbers = with_running(values, [], "y", ["one"]).select("y", F.col("before_one").alias("number"))
    parts = cells.join(numbers, "y").select("x", "c", "number", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    upper = F.expr("shiftright(number, bit + 1)").alias("upper")
    one = F.expr("shiftright(number, bit) & 1")
    sides = parts.select("bit", upper, "x", F.when(one == 1, F.col("c")).otherwise(0).alias("ones"), F.when(one == 0, F.col("c")).otherwise(0).alias("zeros"))
    sides = sides.groupBy("bit", "upper", "x").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    running = with_running(sides, ["bit", "upper"], "x", ["ones", "zeros"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    s = running.agg(F.coalesce(F.sum(wide("ones") * wide("before_zeros") - wide("zeros") * wide("before_ones")), F.lit(0)).cast("double").alias("s"))
    n = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    whole = n.crossJoin(s).crossJoin(ties("x")).crossJoin(ties("y"))  # single rows
    m = F.col("n").cast("double") * (F.col("n") - 1)
    tau = F.col("s") / F.sqrt((m / 2 - F.col("pairs_x")) * (m / 2 - F.col("pairs_y")))
    variance = (m * (2 * F.col("n") + 5) - F.col("weighted_x") - F.col("weighted_y")) / 18 + 2 * F.col("pairs_x") * F.col("pairs_y") / m
    variance = variance + F.col("triples_x") * F.col("triples_y") / (9 * m * (F.col("n") - 2))
    fits = (F.col("n") >= TEST_ROWS) & (F.col("k_x") >= 3) & (F.col("k_y") >= 2)
    return whole.select("n", "s", F.when(fits, tau).alias("tau"), F.when(fits, variance).alias("variance"))


def co_missing(df: DataFrame, a: str, b: str) -> DataFrame:
    """Phi of two columns being null together; null where one never or always is."""
    x, y = F.col(a).isNull().cast("double"), F.col(b).isNull().cast("double")
    spread = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return df.agg(F.count("*").alias("n"), F.when(spread, F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y))).alias("phi"))


def missing_shift(df: DataFrame, missing: str, value: str, least: int = PAIR_ROWS) -> DataFrame:
    """Standardised difference of a value between rows with and without another one.

    n_missing, n_present, smd, mean_when_missing, mean_when_present; only rows with a finite
    value count, and smd is null with fewer than ``least`` on a side or no variation.
    """
    gone, x = F.col(missing).isNull(), finite(F.col(value))
    with_, without = F.when(gone, x), F.when(~gone, x)
    out = df.agg(
        F.count(with_).alias("n_missing"), F.count(without).alias("n_present"), F.avg(with_).alias("mean_when_missing"), F.avg(without).alias("mean_when_present"),
        F.sqrt((F.var_samp(with_) + F.var_samp(without)) / 2).alias("pooled"),
    )
    enough = (F.col("n_missing") >= least) & (F.col("n_present") >= least) & (F.col("pooled") > 0)
    smd = F.when(enough, (F.col("mean_when_missing") - F.col("mean_when_present")) / F.col("pooled"))
    return out.select("n_missing", "n_present", smd.alias("smd"), "mean_when_missing", "mean_when_present")


def benjamini_hochberg(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Adjusted p-values of a table of test results (tests, not rows of data)."""
    rank = F.row_number().over(Window.orderBy(p))
    total = F.count("*").over(Window.partitionBy())
    scaled = df.withColumn("__rank", rank).withColumn("__scaled", F.col(p) * total / F.col("__rank"))
    lowest = F.min("__scaled").over(Window.orderBy(F.desc("__rank")))
    return scaled.withColumn("p_adjusted", F.least(lowest, F.lit(1.0))).drop("__rank", "__scaled")


# p-values: statistics are single numbers, so these run on the driver.


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square_p(statistic: float, dof: int) -> float:
    return gamma_q(dof / 2, statistic / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def spearman_p(rho: float, n: int) -> float:
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return beta_i((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def mann_whitney_p(u: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided, by the normal form with tie and continuity corrections."""
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma if sigma else 0.0
    return min(1.0, math.erfc(z / math.sqrt(2)))


def trend_p(s: float, variance: float) -> float:
    """Two-sided, by the normal form."""
    return min(1.0, math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2))) if variance > 0 else 1.0


@dataclass
class TestResult:
    """A test's statistic, p-value and effect, or why it was refused."""

    test: str
    statistic: float | None = None
    p_value: float | None = None
    effect_name: str = ""
    effect: float | None = None
    n: int = 0
    error: str | None = None


def run_test(df: DataFrame, name: str, x: str, y: str) -> TestResult:
    """One of the five tests on two columns; the statistic is Spark's, its p-value the driver's.

    spearman: two numbers; mann_whitney and kruskal_wallis: a number and a group; chi_square: two
    categories; trend: time (number, date or timestamp) and a number. An unknown name or data
    that a test refuses give an error, not an exception.
    """
    if name == "spearman":
        r = spearman(df, x, y, TEST_ROWS).first()
        if r["rho"] is None:
            return TestResult(name, n=r["n"], error="too few complete rows, or a constant column")
        return TestResult(name, r["rho"], spearman_p(r["rho"], r["n"]), "rho", r["rho"], r["n"])
    if name == "mann_whitney":
        r = mann_whitney(df, x, y).first()
        if r is None:
            return TestResult(name, error="needs exactly two groups of two values or more")
        return TestResult(name, r["u"], mann_whitney_p(r["u"], r["n1"], r["n2"], r["tie_term"]), "rank_biserial", r["effect"], r["n1"] + r["n2"])
    if name == "kruskal_wallis":
        r = kruskal_wallis(df, x, y).first()
        if r is None or r["h"] is None:
            return TestResult(name, error=f"needs 2 to {MAX_CATEGORIES} groups and more than one value")
        return TestResult(name, r["h"], chi_square_p(r["h"], r["k"] - 1), "epsilon_squared", r["effect"], r["n"])
    if name == "chi_square":
        r = chi_square(df, x, y).first()
        if r["v"] is None:
            return TestResult(name, n=r["n"], error=f"needs {TEST_ROWS} rows and 2 to {MAX_CATEGORIES} categories in each column")
        return TestResult(name, r["chi2"], chi_square_p(r["chi2"], r["dof"]), "cramers_v", r["v"], r["n"])
    if name == "trend":
        r = kendall_trend(df.withColumn(x, ordinal(df, x)), x, y).first()
        if r["tau"] is None:
            return TestResult(name, n=r["n"], error="needs five complete rows, three times and two values")
        return TestResult(name, r["tau"], trend_p(r["s"], r["variance"]), "tau", r["tau"], r["n"])
    return TestResult(name, error=f"unknown test {name!r}; there are spearman, mann_whitney, kruskal_wallis, chi_square and trend")


def ordinal(df: DataFrame, time: str) -> Column:
    """A time column as a number in its order: microseconds, days, or the number itself."""
    kind = dict(df.dtypes)[time]
    if kind == "date":
        return F.unix_date(time)
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(time).cast("timestamp"))
    if kind == "string":  # ISO dates and times
        return F.unix_micros(F.col(time).try_cast("timestamp"))
    return F.col(time).cast("double")


def detectable_difference(n1: Column, n2: Column) -> Column:
    """The smallest Cohen's d that two groups show with 80 % power at 5 %."""
    return F.lit(Z_ALPHA + Z_POWER) * F.sqrt(1 / n1 + 1 / n2)


def detectable_correlation(n: Column) -> Column:
    """The smallest correlation that n rows show with 80 % power at 5 %; 1 for three rows or fewer."""
    return F.when(n > 3, F.tanh(F.lit(Z_ALPHA + Z_POWER) / F.sqrt(F.greatest(n - 3, F.lit(1))))).otherwise(1.0)


def margin_of_error(n: Column) -> Column:
    """Half the 95 % interval of a proportion from n rows; 1 without rows."""
    return F.when(n > 0, F.lit(Z_ALPHA) * F.sqrt(0.25 / F.greatest(n, F.lit(1)))).otherwise(1.0)


def effect_magnitude(test: Column, effect: Column) -> Column:
    """negligible, small, medium or large: cuts .1/.3/.5, for epsilon squared .01/.06/.14."""
    size = F.abs(effect)
    kw = test == "kruskal_wallis"
    at = lambda low, high: F.when(kw, F.lit(low)).otherwise(F.lit(high))
    return F.when(size < at(0.01, 0.1), "negligible").when(size < at(0.06, 0.3), "small").when(size < at(0.14, 0.5), "medium").otherwise("large")


def rank_score(test: Column, effect: Column, n: Column, relevance: Column, p_adjusted: Column) -> Column:
    """0.4 relevance + 0.4 effect + 0.2 support, halved without evidence."""
    scale = F.least(F.lit(1.0), F.when(test == "kruskal_wallis", F.sqrt(F.abs(effect))).otherwise(F.abs(effect)))
    support = F.when(n > 1, F.least(F.lit(1.0), F.log10(F.greatest(n, F.lit(1)).cast("double")) / 3)).otherwise(0.0)
    score = 0.4 * relevance + 0.4 * scale + 0.2 * support
    return F.round(F.when(p_adjusted < 0.05, score).otherwise(score / 2), 4)
