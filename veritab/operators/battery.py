"""Many tests at once, each over a whole table or within every value of a further column.

The table is read once, into counts of the pairs of values of each test and stratum. Ranks run
over these counts in ranges of (test, stratum, value): no join brings them back, and a stratum
that holds most rows is many ranges. Concordant and discordant pairs are counted by ranges too:
between ranges from their counts, within a range in a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import stats
from .ranks import finite

#: Distinct pairs that a value must have to be a range of its own.
HOT_CELLS = 1 << 16
EFFECTS = {"spearman": "rho", "mann_whitney": "rank_biserial", "kruskal_wallis": "epsilon_squared", "chi_square": "cramers_v", "trend": "tau"}


@dataclass(frozen=True)
class Spec:
    """A test of two columns; with ``stratum``, one within each of that column's values.

    spearman: two numbers; trend: a time and a number; mann_whitney, kruskal_wallis: a number
    and a group; chi_square: two categories.
    """

    test: str
    x: str
    y: str
    stratum: str | None = None


def _cells(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """Counts c of the complete pairs of every test and stratum: key, a, b (numbers), ga, gb (categories)."""
    parts = []
    for place, s in enumerate(specs):
        a = b = F.lit(None).cast("double")
        ga = gb = F.lit(None).cast("string")
        if s.test in ("spearman", "trend"):
            a, b = finite(F.col(f"`{s.x}`") if s.test == "spearman" else stats.ordinal(df, s.x)), finite(F.col(f"`{s.y}`"))
        elif s.test in ("mann_whitney", "kruskal_wallis"):
            a, ga = finite(F.col(f"`{s.x}`")), F.col(f"`{s.y}`").cast("string")
        elif s.test == "chi_square":
            ga, gb = F.col(f"`{s.x}`").cast("string"), F.col(f"`{s.y}`").cast("string")
        else:
            raise ValueError(f"unknown test {s.test!r}; there are {', '.join(EFFECTS)}")
        used = {"spearman": [a, b], "trend": [a, b], "chi_square": [ga, gb]}.get(s.test, [a, ga])
        level = F.lit("") if s.stratum is None else F.col(f"`{s.stratum}`").cast("string")
        complete = reduce(lambda p, q: p & q, [v.isNotNull() for v in (*used, level)])
        cell = F.struct(F.struct(F.lit(place).alias("spec"), level.alias("level")).alias("key"), a.alias("a"), b.alias("b"), ga.alias("ga"), gb.alias("gb"))
        parts.append(F.when(complete, cell))
    exploded = df.select(F.explode(F.filter(F.array(*parts), lambda r: r.isNotNull())).alias("r")).select("r.*")
    return written(exploded.groupBy("key", "a", "b", "ga", "gb").agg(F.count("*").alias("c")), "cells")


def _ranked(cells: DataFrame, value: str) -> DataFrame:
    """Add the average rank of ``value`` within its key (r_), how many rows share it (t_), and its range (p_).

    Ranges are in the order of values; one value with very many pairs is a range of its own.
    """
    placed = written(cells.repartitionByRange("key", value).withColumn("__range", F.spark_partition_id()), "ranked")
    sums = placed.groupBy("key", "__range").agg(F.sum("c").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("key").orderBy("__range")) - F.col("__sum")  # a row for each range
    met = placed.join(sums.select("key", "__range", before.alias("__before")), ["key", "__range"])
    of_value = Window.partitionBy("key", "__range", value)
    upto = Window.partitionBy("key", "__range").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumns({"__t": F.sum("c").over(of_value), "__m": F.count("*").over(of_value), "__upto": F.sum("c").over(upto)})
    met = met.withColumn("__hot", (F.col("__m") > HOT_CELLS).cast("long"))
    # Pairs of hot values up to here over pairs of each: how many hot values there have been.
    hot = F.sum(F.col("__hot") / F.col("__m")).over(upto)
    part = F.col("__range").cast("long") * F.lit(1 << 32) + 2 * F.round(hot).cast("long") - F.col("__hot")
    rank = F.col("__before") + F.col("__upto") - (F.col("__t") - 1) / 2.0
    return met.withColumns({f"r_{value}": rank, f"t_{value}": F.col("__t"), f"p_{value}": part}).drop(*(c for c in ("__range", "__before", "__t", "__m", "__upto", "__hot")))


def concordance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Of weighted points the pairs that rise together less those that do not, ties in x or y as none.

    Two points with different y part at one bit of their place among the values of y: among the
    points that agree in all higher bits, those with bit 1 have the larger y.
    """
    place = np.unique(y, return_inverse=True)[1].reshape(-1)
    x = np.unique(x, return_inverse=True)[1].reshape(-1)
    total = 0.0
    for bit in range(int(place.max(initial=0)).bit_length()):
        upper = place >> (bit + 1)
        order = np.lexsort((x, upper))
        u, v, w, one = upper[order], x[order], c[order].astype(float), (place[order] >> bit) & 1
        ones, zeros = w * one, w * (1 - one)
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])  # points of equal x together
        start = np.repeat(first, np.diff(np.r_[first, len(u)]))
        group = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        base = np.repeat(group, np.diff(np.r_[group, len(u)]))
        run_ones, run_zeros = (np.r_[0.0, np.cumsum(a)] for a in (ones, zeros))
        total += float((ones * (run_zeros[start] - run_zeros[base]) - zeros * (run_ones[start] - run_ones[base])).sum())
    return total


def _concordance(cells: DataFrame) -> DataFrame:
    """S of every key, from cells with ranges of both sides: key, s.

    A pair of points is in two ranges of x and two of y (counts of ranges tell), or in one range
    of y, or in one of x but not of y. A range of a single value has no pairs to tell apart.
    """
    def summed(rows: pa.Table) -> pa.Table:
        s = concordance(*(rows.column(n).to_numpy() for n in ("x", "y", "c")))
        return pa.table({"spec": rows.column("spec")[:1], "level": rows.column("level")[:1], "s": pa.array([s])})

    shape = "spec int, level string, s double"
    flat = cells.select("key.spec", "key.level", "a", "b", "p_a", "p_b", "c")
    between = flat.groupBy("spec", "level", F.col("p_a").alias("x"), F.col("p_b").alias("y")).agg(F.sum("c").alias("c"))
    several = lambda side, of: F.min(of).over(Window.partitionBy("spec", "level", side)) != F.max(of).over(Window.partitionBy("spec", "level", side))
    in_y = flat.withColumn("__several", several("p_b", "b")).where("__several").select("spec", "level", F.col("p_b").alias("part"), F.col("a").alias("x"), F.col("b").alias("y"), "c")
    coarse = flat.groupBy("spec", "level", "p_a", F.col("a").alias("x"), F.col("p_b").alias("y")).agg(F.sum("c").alias("c"))
    in_x = coarse.withColumn("__several", several("p_a", "x")).where("__several").select("spec", "level", F.col("p_a").alias("part"), "x", "y", "c")
    found = between.groupBy("spec", "level").applyInArrow(summed, shape)
    for rows in (in_y, in_x):
        found = found.union(rows.groupBy("spec", "level", "part").applyInArrow(summed, shape))
    return found.groupBy("spec", "level").agg(F.sum("s").alias("s")).select(F.struct("spec", "level").alias("key"), "s")


_OUT = ["key", "n", "k", "statistic", "effect", "n1", "n2", "tie_term", "variance"]


def _result(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"n": "long", "k": "long", "n1": "long", "n2": "long"}
    return df.select("key", *(columns.get(c, F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in _OUT[1:]))


def _of_two_numbers(ranked: DataFrame) -> DataFrame:
    """Spearman's rho of every key."""
    n, c = F.sum("c"), F.col("c")
    mean = (n + 1) / 2.0
    square = lambda p, q: F.sum(c * F.col(p) * F.col(q)) - n * mean * mean
    sums = ranked.groupBy("key").agg(n.alias("n"), square("r_a", "r_b").alias("xy"), square("r_a", "r_a").alias("xx"), square("r_b", "r_b").alias("yy"))
    rho = F.when((F.col("xx") > 1e-9) & (F.col("yy") > 1e-9) & (F.col("n") >= stats.TEST_ROWS), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return _result(sums, n=F.col("n"), statistic=rho, effect=rho)


def _of_trends(ranked: DataFrame) -> DataFrame:
    """Kendall's tau-b of every key, with the variance of S."""
    c = F.col("c").cast("double")
    terms = []
    for side in "ab":
        t = F.col(f"t_{side}").cast("double")
        # A value with t rows has them in several cells: each cell adds its share.
        terms += [F.round(F.sum(c / t)).alias(f"k_{side}"), F.sum(c * (t - 1) / 2).alias(f"pairs_{side}"), F.sum(c * (t - 1) * (t - 2)).alias(f"triples_{side}"), F.sum(c * (t - 1) * (2 * t + 5)).alias(f"weighted_{side}")]
    whole = ranked.groupBy("key").agg(F.sum("c").alias("n"), *terms).join(_concordance(ranked), "key")
    n = F.col("n").cast("double")
    m = n * (n - 1)
    tau = F.col("s") / F.sqrt((m / 2 - F.col("pairs_a")) * (m / 2 - F.col("pairs_b")))
    variance = (m * (2 * n + 5) - F.col("weighted_a") - F.col("weighted_b")) / 18 + 2 * F.col("pairs_a") * F.col("pairs_b") / m + F.col("triples_a") * F.col("triples_b") / (9 * m * (n - 2))
    fits = (n >= stats.TEST_ROWS) & (F.col("k_a") >= 3) & (F.col("k_b") >= 2)
    return _result(whole, n=F.col("n"), statistic=F.when(fits, tau), effect=F.when(fits, tau), variance=F.when(fits, variance), tie_term=F.col("s"))


def _of_groups(ranked: DataFrame, two: list[int]) -> DataFrame:
    """U of the first of two groups for the specs in ``two``, H for all others."""
    sums = ranked.groupBy("key", "ga").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r_a")).alias("rank_sum"), F.sum(F.col("c") * (F.col("t_a").cast("double") * F.col("t_a") - 1)).alias("tie"))
    total = F.sum("n").cast("double")
    first = F.min(F.struct("ga", "n", "rank_sum"))  # the alphabetically first group
    whole = sums.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("tie").alias("tie_term"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("squares"), first.alias("first"), F.min("n").alias("least"), total.alias("total")
    )
    n, tie = F.col("total"), F.col("tie_term")
    h = (12 / (n * (n + 1)) * F.col("squares") - 3 * (n + 1)) / F.nullif(1 - tie / (n * n * n - n), F.lit(0.0))
    h = F.when(F.col("k").between(2, stats.MAX_CATEGORIES), h)
    n1 = F.col("first.n")
    n2 = F.col("n") - n1
    u = F.when((F.col("k") == 2) & (F.col("least") >= 2), F.col("first.rank_sum") - n1 * (n1 + 1) / 2.0)
    of_two = F.col("key.spec").isin(two)
    return _result(
        whole, n=F.col("n"), k=F.col("k"), statistic=F.when(of_two, u).otherwise(h), effect=F.when(of_two, 2 * u / (n1.cast("double") * n2) - 1).otherwise(h / (n - 1)), n1=n1, n2=n2, tie_term=tie
    )


def _of_categories(cells: DataFrame) -> DataFrame:
    """Chi-square and Cramer's V of every key with at most ``stats.MAX_CATEGORIES`` categories on a side."""
    margins = {s: cells.groupBy("key", f"g{s}").agg(F.sum("c").alias(f"m{s}")) for s in "ab"}
    sizes = [m.groupBy("key").agg(F.count("*").alias(f"k{s}")) for s, m in margins.items()]
    small = sizes[0].join(sizes[1], "key").where((F.col("ka") <= stats.MAX_CATEGORIES) & (F.col("kb") <= stats.MAX_CATEGORIES))
    met = cells.groupBy("key", "ga", "gb").agg(F.sum("c").alias("o")).join(small, "key").join(margins["a"], ["key", "ga"]).join(margins["b"], ["key", "gb"])
    q = F.sum(F.col("o") * F.col("o") / (F.col("ma").cast("double") * F.col("mb")))
    whole = met.groupBy("key").agg(F.sum("o").alias("n"), q.alias("q"), F.first("ka").alias("ka"), F.first("kb").alias("kb"))
    side, fits = F.least("ka", "kb"), (F.least("ka", "kb") > 1) & (F.col("n") >= stats.TEST_ROWS)
    chi2 = F.when(fits, F.greatest(F.lit(0.0), F.col("n") * (F.col("q") - 1)))
    return _result(whole, n=F.col("n"), k=(F.col("ka") - 1) * (F.col("kb") - 1) + 1, statistic=chi2, effect=F.sqrt(chi2 / (F.col("n") * (side - 1))))


def _p_values(test: pd.Series, statistic: pd.Series, n: pd.Series, k: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series, variance: pd.Series) -> pd.Series:
    """The p-value of a test's numbers, a row at a time: there is one for each test and stratum."""
    def one(t, s, rows, groups, a, b, tie, var):
        if s is None or s != s:
            return None
        if t == "spearman":
            return stats.spearman_p(s, int(rows))
        if t == "mann_whitney":
            return stats.mann_whitney_p(s, a, b, tie)
        return stats.trend_p(tie, var) if t == "trend" else stats.chi_square_p(s, int(groups) - 1)

    return pd.Series([one(*r) for r in zip(test, statistic, n, k, n1, n2, tie_term, variance)], dtype="float64")


def run_tests(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """All tests in one plan: spec (its place), test, x, y, stratum, level, n, statistic, p_value, effect_name, effect.

    A row for each test and, where it has a stratum, for each value of that with complete rows;
    ``level`` is null for tests over all rows. Statistic, p-value and effect are null where the
    test is refused: too few rows, a constant column, or not the groups that it needs.
    """
    if not specs:
        return df.sparkSession.createDataFrame([], "spec int, test string, x string, y string, stratum string, level string, n long, statistic double, p_value double, effect_name string, effect double")
    cells = _cells(df, specs)
    names = df.sparkSession.createDataFrame([(i, s.test, s.x, s.y, s.stratum, EFFECTS[s.test]) for i, s in enumerate(specs)], "spec int, test string, x string, y string, stratum string, effect_name string")
    of = lambda *tests: [i for i, s in enumerate(specs) if s.test in tests]
    kept = lambda rows, places: rows.where(F.col("key.spec").isin(places))
    parts = []
    if of("chi_square"):
        parts.append(_of_categories(kept(cells, of("chi_square"))))
    if rank_tests := of("spearman", "trend", "mann_whitney", "kruskal_wallis"):
        by_a = _ranked(kept(cells, rank_tests), "a")
        if of("mann_whitney", "kruskal_wallis"):
            parts.append(_of_groups(kept(by_a, of("mann_whitney", "kruskal_wallis")), of("mann_whitney")))
        if of("spearman", "trend"):
            by_b = _ranked(kept(by_a, of("spearman", "trend")).drop("ga", "gb"), "b")
            if of("spearman"):
                parts.append(_of_two_numbers(kept(by_b, of("spearman"))))
            if of("trend"):
                parts.append(_of_trends(kept(by_b, of("trend"))))
    met = reduce(DataFrame.union, parts).withColumns({"spec": F.col("key.spec"), "level": F.col("key.level")}).join(F.broadcast(names), "spec")  # as many names as tests
    level = F.when(F.col("stratum").isNotNull(), F.col("level")).alias("level")
    p_value = F.pandas_udf(_p_values, "double")("test", "statistic", "n", "k", "n1", "n2", "tie_term", "variance")
    return met.select("spec", "test", "x", "y", "stratum", level, "n", "statistic", p_value.alias("p_value"), "effect_name", "effect")


def within_strata(results: DataFrame) -> DataFrame:
    """Whether effects hold within strata: test, x, y, stratum, effect, strata, mean_effect, verdict.

    ``results`` of ``run_tests`` with a test over all rows and the same one by strata. The rules
    are those of ``insights.confounder_verdict``; measures with a sign may reverse. A test
    without an effect over all rows gives no row.
    """
    crude = results.where("stratum IS NULL AND effect IS NOT NULL").select("test", "x", "y", F.col("effect").alias("crude"))
    strata = results.where("stratum IS NOT NULL").join(crude, ["test", "x", "y"])
    from . import insights  # which uses this module

    used = (F.col("n") >= insights.STRATUM_ROWS) & F.col("effect").isNotNull()
    size = F.when(used, F.abs("effect"))
    other = F.coalesce(F.bool_or(used & (F.col("effect") * F.col("crude") < 0) & (F.abs("effect") >= insights.REVERSING)), F.lit(False))
    out = strata.groupBy("test", "x", "y", "stratum", "effect_name", "crude").agg(F.count_if(used).alias("strata"), (F.sum(size * F.col("n")) / F.sum(F.when(used, F.col("n")))).alias("mean_effect"), other.alias("other"))
    weaker = (F.abs("crude") > 0) & (F.col("mean_effect") < insights.WEAKER * F.abs("crude"))
    verdict = F.when(F.col("strata") < insights.STRATA, "unclear").when(F.col("effect_name").isin(*insights.SIGNED) & F.col("other"), "reverses").when(weaker, "weakens").otherwise("holds")
    return out.select("test", "x", "y", "stratum", F.col("crude").alias("effect"), "strata", "mean_effect", verdict.alias("verdict"))
