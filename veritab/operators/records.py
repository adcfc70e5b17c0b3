"""Operators on record tables: latest rows, long to wide, versions, precedence, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by ``order``; an aggregate, so a hot key combines early."""
    top = F.max(F.struct(*order, *(c for c in df.columns if c not in order and c not in keys))).alias("__top")
    return df.groupBy(*keys).agg(top).select(*(F.col(c) if c in keys else F.col(f"__top.{c}").alias(c) for c in df.columns))


def wide(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A row per key with a column for each of ``names``; the smallest value where several are."""
    return df.groupBy(key).agg(*(F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def upsert_versions(old: DataFrame, new: DataFrame, keys: list[str], value: str, reset_user: bool = False) -> DataFrame:
    """Cells (keys, value, version, source) after a new run is asked for.

    Cells of ``new`` keys are created with version 1 or reset with the next version; a value
    that a user set stays unless ``reset_user``. Cells that ``new`` lacks stay as they are.
    """
    a, b = old.alias("a"), new.select(*keys).distinct().withColumn("__asked", F.lit(True)).alias("b")
    met = a.join(b, keys, "full")
    kept = F.col("__asked").isNull() | ((F.col("source") == "user") & F.lit(not reset_user))
    reset = ~F.coalesce(kept, F.lit(False))
    return met.select(
        *keys,
        F.when(~reset, F.col(value)).alias(value),
        F.when(reset, F.coalesce(F.col("version"), F.lit(0)) + 1).otherwise(F.col("version")).alias("version"),
        F.when(~reset, F.col("source")).otherwise("pending").alias("source"),
    )


def apply_results(cells: DataFrame, results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Put results (keys, version, value) into cells of the same version.

    Stale versions are dropped; where a user set the value it stays, the result beside it in
    ``proposed``.
    """
    found = results.select(*keys, "version", F.col(value).alias("__result"))
    met = cells.join(found, [*keys, "version"], "left")
    user = F.coalesce(F.col("source") == "user", F.lit(False))
    return met.select(
        *keys,
        "version",
        F.when(user | F.col("__result").isNull(), F.col(value)).otherwise(F.col("__result")).alias(value),
        F.when(user | F.col("__result").isNull(), F.col("source")).otherwise("result").alias("source"),
        F.when(user, F.col("__result")).alias("proposed"),
    )


def first_known(*columns: Column) -> Column:
    """The first value that is neither null nor blank: sources in order of precedence."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in columns))


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the groups that ``new`` brings, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def appendix(df: DataFrame, key: str, name: str, page: str, value: str) -> DataFrame:
    """For each key the sorted distinct pages cited and the sorted names without a value."""
    return df.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col(value).isNotNull(), F.col(page)))).alias("pages"),
        F.array_sort(F.collect_set(F.when(F.col(value).isNull(), F.col(name)))).alias("not_found"),
    )


def searched(df: DataFrame, text: str, order: str, columns: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Rows with a text in any of the columns, without case, sorted by one column: numbers by value first, then text, nulls last."""
    named = columns or df.columns
    hit = F.lit(False)
    for c in named:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    number, plain = F.col(order).cast("string").try_cast("double"), F.col(order)
    keys = [number.desc_nulls_last(), plain.desc_nulls_last()] if descending else [number.asc_nulls_last(), plain.asc_nulls_last()]
    return df.where(hit).orderBy(*keys)


def reading_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys such as ``score desc`` or ``folder first``: descending and ascending with nulls last, or ascending with nulls first."""
    how = {"desc": "desc_nulls_last", "asc": "asc_nulls_last", "first": "asc_nulls_first"}
    parts = [(k.split() + ["asc"])[:2] for k in keys]
    return df.orderBy(*(getattr(F.col(c), how[o])() for c, o in parts))
