"""Associations of all pairs of columns in a fixed number of passes: a, b, measure, value, n.

Numeric columns without missing values are ranked once each; rows then carry ranks instead of
values, and every task sums the products of its rows to one matrix. Ranks of other columns
depend on the rows that a pair has in common, so their pairs are counted one by one, all in
one pass (``battery``). Categories, and numbers by category, are counts and sums of all pairs
at once, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import battery, stats
from .ranks import finite, in_order

_PAIRS = "a string, b string, measure string, value double, n long"


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the finite values of each column (col, value, n); missing ones have a null value. One pass."""
    cells = F.array(*(F.struct(F.lit(i).alias("col"), finite(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(columns)))
    return df.select(F.explode(cells).alias("c")).groupBy("c.col", "c.value").agg(F.count("*").alias("n"))


def rank_products(df: DataFrame, ranks: DataFrame, columns: dict[int, str], total: int) -> np.ndarray:
    """Of columns without missing values the sums of products of their ranks, less the mean rank.

    ``ranks`` (col, value, rank) replaces the values of one column after the other; each task
    returns one matrix, of as many numbers as there are pairs of columns.
    """
    rows = df.select(*(finite(F.col(f"`{c}`")).alias(f"v{i}") for i, c in columns.items()))
    for i in columns:
        of_column = ranks.where(F.col("col") == i).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
        rows = rows.join(of_column, f"v{i}").drop(f"v{i}")  # Spark broadcasts what it sees to be small
    names, k, mean = [f"r{i}" for i in columns], len(columns), (total + 1) / 2

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k))
        for batch in batches:
            r = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) - mean
            sums += r @ r.T
        yield pa.RecordBatch.from_arrays([pa.array([sums.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["m"])

    tasks = rows.select(*names).mapInArrow(multiply, "m array<double>").select(F.posexplode("m").alias("place", "x"))
    found = tasks.groupBy("place").agg(F.sum("x").alias("x")).collect()  # a number for each pair of columns
    out = np.zeros(k * k)
    for r in found:
        out[r["place"]] = r["x"]
    return out.reshape(k, k)


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman's rho of every two numeric columns over the rows where both have a finite value."""
    spark, empty = df.sparkSession, df.sparkSession.createDataFrame([], _PAIRS)
    if len(columns) < 2:
        return empty
    counts = written(_counts(df, columns), "column-counts")
    sizes = counts.groupBy("col").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing")).collect()
    whole = {r["col"]: columns[r["col"]] for r in sorted(sizes) if r["missing"] == 0}
    rows = sizes[0]["rows"] if sizes else 0
    found = []
    if len(whole) >= 2 and rows >= stats.PAIR_ROWS:
        placed = in_order(counts.where(F.col("col").isin(list(whole))), "col", "value")
        upto = F.sum("n").over(Window.partitionBy("col", "range").orderBy("value"))
        ranks = placed.select("col", "value", (F.col("before") + upto - (F.col("n") - 1) / 2.0).alias("rank"))
        m = rank_products(df, written(ranks, "ranks"), whole, rows)
        names = list(whole.values())
        for i, j in combinations(range(len(names)), 2):
            if m[i, i] > 1e-9 and m[j, j] > 1e-9:
                found.append((names[i], names[j], "spearman", float(m[i, j] / np.sqrt(m[i, i] * m[j, j])), rows))
    out = spark.createDataFrame(found, _PAIRS)
    gaps = [battery.Spec("spearman", a, b) for a, b in combinations(columns, 2) if not {a, b} <= set(whole.values())]
    if gaps:
        tested = battery.run_tests(df, gaps).where(F.col("n") >= stats.PAIR_ROWS)
        out = out.union(tested.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit("spearman").alias("measure"), F.col("effect").alias("value"), "n"))
    return out


def category_associations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cramer's V of every two categories, of columns with 50 values at most."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    tested = battery.run_tests(df, [battery.Spec("chi_square", a, b) for a, b in combinations(columns, 2)]).where(F.col("n") >= stats.PAIR_ROWS)
    return tested.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit("cramers_v").alias("measure"), F.col("effect").alias("value"), "n")


def correlation_ratios(df: DataFrame, categories: list[str], numeric: list[str]) -> DataFrame:
    """Eta of every category and number: the root of between-group over total variation."""
    wanted = [(c, x) for c in categories for x in numeric if c != x]
    if not wanted:
        return df.sparkSession.createDataFrame([], _PAIRS)
    cells = F.array(*(F.struct(F.lit(c).alias("a"), F.lit(x).alias("b"), F.col(f"`{c}`").cast("string").alias("g"), finite(F.col(f"`{x}`")).alias("x")) for c, x in wanted))
    rows = df.select(F.explode(cells).alias("c")).select("c.*").where("g is not null and x is not null")
    groups = rows.groupBy("a", "b", "g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean)
    out = groups.groupBy("a", "b").agg(n.alias("n"), between.alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("k"))
    total = F.col("between") + F.col("within")
    eta = F.when((F.col("n") >= stats.PAIR_ROWS) & (F.col("k") >= 2) & (total > 0), F.sqrt(F.col("between") / total))
    return out.select("a", "b", F.lit("eta").alias("measure"), eta.alias("value"), "n")
