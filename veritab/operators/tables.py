"""The profile of a whole table from shared passes: a row of facts for every column.

A table is read once, into counts of cells: (column, value, rows). Counts, extremes, top
values, categories, placeholders, lengths, units, days and quantiles come from these; moments,
outliers and histograms too, once means, fences and bounds are known. Only what depends on the
order of rows reads the table again.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import insights
from .profile import (
    ID_NAME, PERIODS, QUANTILES, SENTINEL_MIN_COUNT, SENTINEL_VALUES, UNIT_PATTERN, chunk_medians_of, granularity, period_choice, period_number, semantic_type, shifts,
)
from .ranks import finite, quantiles_of_counts

BINS, TOP_VALUES, UNITS, CHUNKS = 20, 10, 50, 10
#: Numbers with at most so many distinct values also have categories; a category under this share is rare.
LOW_CARDINALITY, RARE = 50, 0.01
#: Texts of more bytes are counted by their sha256, which stands for them among the top values.
LONG_VALUE = 128
# Two-valued columns that mean yes and no.
BOOLEAN_PAIRS = [("0", "1"), ("false", "true"), ("no", "yes"), ("n", "y"), ("f", "t")]
_INTEGERS, _REALS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def kind_of(dtype: str) -> str:
    """integer, real, datetime, boolean, text or other, by a Spark type."""
    if dtype in _INTEGERS:
        return "integer"
    if dtype in _REALS or dtype.startswith("decimal"):
        return "real"
    if dtype.startswith(("date", "timestamp")):
        return "datetime"
    return {"boolean": "boolean", "string": "text"}.get(dtype, "other")


def _values(df: DataFrame) -> DataFrame:
    """Counts of the values of every column by what tells them apart: col, whole, real, text, long (where a column is a text), n. One pass; rows combine before the shuffle.

    Integers are whole; numbers are real, as text only where that does not tell them apart (decimals,
    zeros by their sign); dates are whole days, with a text where there is a time of day. Texts of
    more than ``LONG_VALUE`` bytes have their facts in ``long``.
    """
    parts = []
    for place, (name, dtype) in enumerate(df.dtypes):
        value, kind = F.col(f"`{name}`"), kind_of(dtype)
        whole, real = F.lit(None).cast("long"), F.lit(None).cast("double")
        text = F.to_json(value) if kind == "other" and dtype.startswith(("array", "struct", "map")) else value.cast("string")
        if kind == "integer":
            whole, text = value.cast("long"), F.lit(None).cast("string")
        elif kind == "real":
            real, text = value.cast("double"), text if dtype.startswith("decimal") else F.when(value == 0, text)
        elif kind == "datetime":
            whole, text = F.unix_date(value.cast("date")).cast("long"), F.when(value != value.cast("date").cast(dtype), text)
        parts.append(F.struct(F.lit(place).alias("col"), whole.alias("whole"), real.alias("real"), text.alias("text")))
    exploded = df.select(F.explode(F.array(*parts)).alias("c")).select("c.*")
    text, texts = F.col("text"), [i for i, (_, t) in enumerate(df.dtypes) if kind_of(t) == "text"]
    if texts:
        is_long = F.col("col").isin(texts) & (F.octet_length(text) > LONG_VALUE)
        long = F.when(is_long, F.struct(*(c.alias(k) for k, c in _text_facts(text).items())))
        text = F.when(is_long, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
        exploded = exploded.select("col", "whole", "real", text.alias("text"), long.alias("long"))
    return exploded.groupBy(*exploded.columns).agg(F.count("*").alias("n"))


def _text_facts(text: Column) -> dict[str, Column]:
    trimmed = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    words = F.when(trimmed == "", 0).when(text.isNotNull(), F.size(F.split(trimmed, " ")))
    return {"length": F.length(text), "words": words, "blank": trimmed == "", "unit": F.regexp_extract(F.trim(text), UNIT_PATTERN, 1)}


def cells(df: DataFrame) -> DataFrame:
    """Counts of the values of every column: col (its place), value, n, and facts of each value.

    ``num`` is a finite number, or a date's day since 1970; ``timed`` says that a time of day is
    not midnight; a text has its length, words, blank and the unit after a number. Values are
    counted first, and each has its facts made once.
    """
    whole, real, text, long = map(F.col, ("whole", "real", "text", "long"))
    found = {"value": [], "num": [], "timed": [], "length": [], "words": [], "blank": [], "unit": []}
    for dtype in sorted({t for _, t in df.dtypes}):
        kind, of_type = kind_of(dtype), F.col("col").isin([i for i, (_, t) in enumerate(df.dtypes) if t == dtype])
        facts = {"value": text}
        if kind == "integer":
            facts = {"value": whole.cast("string"), "num": whole.cast("double")}
        elif kind == "real":
            facts = {"value": text if dtype.startswith("decimal") else F.coalesce(text, real.cast(dtype).cast("string")), "num": finite(real)}
        elif kind == "datetime":
            day = F.date_from_unix_date(whole.cast("int"))
            facts = {"value": F.coalesce(text, day.cast(dtype).cast("string")), "num": whole.cast("double"), "timed": F.when(whole.isNotNull(), text.isNotNull())}
        elif kind == "text":
            facts |= {k: F.when(long.isNotNull(), long[k]).otherwise(c) for k, c in _text_facts(text).items()}
        for k, c in facts.items():
            found[k].append((of_type, c))
    none = {"value": "string", "num": "double", "timed": "boolean", "length": "int", "words": "int", "blank": "boolean", "unit": "string"}
    choose = lambda cases, t: reduce(lambda rest, c: F.when(*c).otherwise(rest), cases, F.lit(None).cast(t))
    return _values(df).select("col", *(choose(found[k], t).alias(k) for k, t in none.items()), "n")


def _counts(cells: DataFrame) -> DataFrame:
    """Facts of a column that sums and extremes of numbers over its cells give; no text is compared."""
    n, x, known = F.col("n"), F.col("num"), F.col("value").isNotNull()
    weighed = lambda c: F.sum(F.col(c) * n) / F.sum(F.when(known, n))
    total = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    return cells.groupBy("col").agg(
        F.sum("n").alias("rows"), total(~known).alias("missing"), F.count("value").alias("n_distinct"), total(x.isNotNull()).alias("n_finite"), F.min("num").alias("min"), F.max("num").alias("max"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"), total(x == 0).alias("zeros"), total(x < 0).alias("negatives"),
        F.min("length").cast("long").alias("min_length"), weighed("length").alias("avg_length"), F.max("length").cast("long").alias("max_length"), total(F.col("blank")).alias("blank"),
        weighed("words").alias("avg_words"), F.coalesce(F.bool_or("timed"), F.lit(False)).alias("timed"), F.max(F.when(known, n)).alias("largest"), F.min(F.when(known, n)).alias("smallest"),
    )


def _codes(numbers: DataFrame) -> DataFrame:
    """How often each column has numbers that stand for missing ones: col, codes (code, n)."""
    met = numbers.where(F.col("num").isin(list(SENTINEL_VALUES))).groupBy("col", F.col("num").alias("code")).agg(F.sum("n").alias("n"))
    return met.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("codes"))  # as many as codes


def _spread(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that need a column's mean, fences, bounds and rows first: moments, outliers, histogram, rare values."""
    n, x = F.col("n"), F.col("num")
    met = cells.where("value is not null").join(F.broadcast(facts.select("col", "mean", "min", "max", "low_fence", "high_fence", "known")), "col")  # as many rows as columns
    width = (F.col("max") - F.col("min")) / BINS
    at = F.when(F.col("max") > F.col("min"), F.least(F.floor((x - F.col("min")) / width), F.lit(BINS - 1))).when(x.isNotNull(), F.lit(0))
    away = x - F.col("mean")
    parts = met.withColumn("bin", at.cast("int")).groupBy("col", "bin").agg(
        F.sum(n * away * away).alias("m2"), F.sum(n * away * away * away).alias("m3"), F.sum(F.when((x < F.col("low_fence")) | (x > F.col("high_fence")), n)).alias("n_outside"),
        F.sum("n").alias("n"), F.count_if(n < RARE * F.col("known")).alias("n_rare"),
    )
    bins = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))  # as many as bins
    found = parts.groupBy("col").agg(F.sum("m2").alias("m2"), F.sum("m3").alias("m3"), F.coalesce(F.sum("n_outside"), F.lit(0)).alias("n_outside"), bins.alias("bins"), F.sum("n_rare").alias("n_rare"))
    return found.withColumn("bins", F.array(*(F.coalesce(F.col("bins")[i], F.lit(0)) for i in range(BINS))))


def _top(counts: DataFrame, label: str, k: int) -> DataFrame:
    """The ``k`` commonest labels of each column, in order: col, listed (label, n). Tasks keep k each before they meet."""
    first = counts.withColumn("place", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), label))).where(F.col("place") <= k)
    listed = F.sort_array(F.collect_list(F.struct("place", F.col(label).alias("label"), "n")))
    return first.groupBy("col").agg(F.transform(listed, lambda r: F.struct(r["label"].alias("value"), r["n"].alias("n"))).alias("listed"))


def _dates(days: DataFrame) -> DataFrame:
    """Of distinct days (col, num): the modal gap, and how many periods of each kind have rows."""
    in_order_of_days = Window.partitionBy("col").orderBy("num")  # distinct days: as many as a calendar has
    gaps = days.withColumn("gap", (F.col("num") - F.lag("num").over(in_order_of_days)).cast("long")).where("gap is not null")
    modal = gaps.groupBy("col", "gap").agg(F.count("*").alias("n")).groupBy("col").agg(F.min_by("gap", F.struct(-F.col("n"), "gap")).alias("gap"))
    day = F.date_from_unix_date(F.col("num").cast("int"))
    held = days.groupBy("col").agg(F.array(*(F.count_distinct(period_number(day, p)) for p in PERIODS)).alias("held"), F.min(day).alias("first"), F.max(day).alias("last"))
    return held.join(modal, "col", "left")


def _shifts(df: DataFrame, numeric: list[tuple[int, str]], position: str) -> DataFrame:
    """Lasting jumps of scale in the order of ``position``, for all numeric columns in one pass: col, shift."""
    found = shifts(chunk_medians_of(df, [c for _, c in numeric], position, CHUNKS), "col")
    place = F.element_at(F.array(*(F.lit(i) for i, _ in numeric)), F.col("col") + 1)
    return found.select(place.alias("col"), F.struct("from_position", "ratio", "median_before", "median_after").alias("shift"))


def profile_table(df: DataFrame, position: str | None = None) -> DataFrame:
    """A row of facts for every column of a table; ``position``, a column of distinct numbers, is the order of its rows.

    Numbers have n_finite, extremes, moments, exact quantiles, fences, n_outside, sentinels and a
    histogram; dates first, last, granularity, period, periods and empty_periods; text lengths,
    words, blank and units; categories top values, their share, rare ones and imbalance. What does
    not fit a column is null. Scale shifts are looked for where ``position`` is given. A table
    without rows gives a row for each column, of no rows.
    """
    kinds = [kind_of(t) for _, t in df.dtypes]
    spark = df.sparkSession
    counted = written(cells(df), "cells")
    names = [F.struct(*(F.lit(v).alias(k) for k, v in {"col": i, "column": c, "kind": kinds[i], "physical_type": t, "id_name": bool(re.search(ID_NAME, c))}.items())) for i, (c, t) in enumerate(df.dtypes)]
    names = spark.range(1).select(F.inline(F.array(*names)))
    numeric = [i for i, k in enumerate(kinds) if k in ("integer", "real")]
    is_number, is_date, is_text = (F.col("kind").isin(*k) for k in (("integer", "real"), ("datetime",), ("text",)))
    numbers = counted.where(F.col("col").isin(numeric) & F.col("num").isNotNull())
    q = quantiles_of_counts(numbers, "col", "num", list(QUANTILES)).select("col", "q")
    facts = names.join(_counts(counted), "col", "left").join(_codes(numbers), "col", "left").join(q, "col", "left")
    reach = 1.5 * (F.col("q")[3] - F.col("q")[1])
    facts = facts.withColumns({"low_fence": F.col("q")[1] - reach, "high_fence": F.col("q")[3] + reach, "known": F.col("rows") - F.col("missing")})
    facts = written(facts, "facts")
    met = facts.join(_spread(counted, facts), "col", "left")
    with_top = facts.where(is_text | (F.col("kind") == "boolean") | (F.col("n_distinct") <= LOW_CARDINALITY)).select("col")  # as many as columns
    met = met.join(_top(counted.where("value is not null").join(F.broadcast(with_top), "col"), "value", TOP_VALUES).withColumnRenamed("listed", "top"), "col", "left")
    met = met.join(_top(counted.where("unit is not null").groupBy("col", "unit").agg(F.sum("n").alias("n")), "unit", UNITS).withColumnRenamed("listed", "units"), "col", "left")
    met = met.join(_dates(counted.where(F.col("col").isin([i for i, k in enumerate(kinds) if k == "datetime"]) & F.col("num").isNotNull()).select("col", "num").distinct()), "col", "left")
    shift = F.lit(None).cast("struct<from_position bigint, ratio double, median_before double, median_after double>").alias("shift")
    if position is not None and numeric:
        met = met.join(_shifts(df, [(i, df.columns[i]) for i in numeric], position), "col", "left")
        shift = F.col("shift")
    return _described(met, is_number, is_date, is_text, shift)


def _described(met: DataFrame, is_number: Column, is_date: Column, is_text: Column, shift: Column) -> DataFrame:
    """The facts of ``profile_table`` by name, each only where it fits the column."""
    rows, missing = F.coalesce("rows", F.lit(0)), F.coalesce("missing", F.lit(0))
    known, n_distinct = rows - missing, F.coalesce("n_distinct", F.lit(0))
    uniqueness = F.when(known > 0, n_distinct / known).otherwise(F.lit(0.0))
    lowered = F.transform("top", lambda t: F.lower(F.trim(t["value"])))
    pair = F.struct(F.array_min(lowered).alias("a"), F.array_max(lowered).alias("b"))
    two_valued = F.coalesce((n_distinct == 2) & pair.isin(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BOOLEAN_PAIRS)), F.lit(False))
    meaning = F.lit("other")
    for kind in ("integer", "real", "datetime", "boolean", "text"):
        meant = semantic_type(kind, n_distinct, uniqueness, known, F.col("id_name"), F.col("avg_length"), F.col("avg_words"), two_valued)
        meaning = F.when(F.col("kind") == kind, meant).otherwise(meaning)
    meaning = F.when(n_distinct <= 1, "constant").otherwise(meaning)
    n, some, finite_some = F.col("n_finite"), known > 0, is_number & (F.col("n_finite") > 0)
    number = lambda c: F.when(finite_some, c)
    text, date = (lambda c: F.when(is_text & some, c)), (lambda c: F.when(is_date & some, c))
    sd = F.when(n > 1, F.sqrt(F.col("m2") / (n - 1)))
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1.0)) / (n - 2) * (F.col("m3") / n) / F.pow(F.col("m2") / n, 1.5))
    outside = lambda c: (c["n"] >= SENTINEL_MIN_COUNT) & ((c["code"] < F.col("low_fence")) | (c["code"] > F.col("high_fence")))
    categories = lambda c: F.when(some & (is_text | (F.col("kind") == "boolean") | (is_number & (n_distinct <= LOW_CARDINALITY))), c)
    unit_rows = F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + u["n"])
    with_unit = F.filter("units", lambda u: u["value"] != "")
    unit_share = F.aggregate(with_unit, F.lit(0).cast("long"), lambda a, u: a + u["n"]) / unit_rows
    real_units = F.filter(with_unit, lambda u: u["n"] >= F.greatest(F.lit(2), insights.UNIT_MIN_SHARE * known))
    grain = granularity(F.col("gap"), F.col("timed"))
    counts = F.array(*(period_number(F.col("last"), p) - period_number(F.col("first"), p) + 1 for p in PERIODS))
    period = period_choice(F.datediff("last", "first"), grain, counts)
    of_period = lambda c: F.element_at(c, period + 1).cast("long")
    out = {
        "rows": rows, "missing": missing, "n_distinct": n_distinct, "uniqueness": uniqueness, "semantic_type": meaning,
        "n_finite": F.when(is_number & some, n), "min": number(F.col("min")), "max": number(F.col("max")), "mean": number(F.col("mean")), "median": number(F.col("q")[2]), "stddev": number(sd), "skewness": number(skew),
        "p05": number(F.col("q")[0]), "p25": number(F.col("q")[1]), "p75": number(F.col("q")[3]), "p95": number(F.col("q")[4]), "zeros": number(F.col("zeros")), "negatives": number(F.col("negatives")),
        "low_fence": number(F.col("low_fence")), "high_fence": number(F.col("high_fence")), "n_outside": number(F.col("n_outside")), "sentinels": number(F.coalesce(F.filter("codes", outside), F.array().cast("array<struct<code: double, n: bigint>>"))),
        "histogram": number(F.when(F.col("max") > F.col("min"), F.col("bins")).otherwise(F.slice("bins", 1, 1))),
        "first": date(F.col("first")), "last": date(F.col("last")), "granularity": date(grain), "period": date(F.element_at(F.array(*map(F.lit, PERIODS)), period + 1)),
        "periods": date(of_period(counts)), "empty_periods": date(of_period(counts) - of_period(F.col("held"))),
        "min_length": text(F.col("min_length")), "avg_length": text(F.col("avg_length")), "max_length": text(F.col("max_length")), "blank": text(F.col("blank")), "avg_words": text(F.col("avg_words")),
        "unit_share": text(unit_share), "units": text(F.slice(with_unit, 1, 10)), "n_units": text(F.size(real_units).cast("long")),
        "top": categories(F.col("top")), "top_share": categories(F.col("largest") / known), "n_rare": categories(F.col("n_rare")), "imbalance_ratio": categories(F.col("largest") / F.col("smallest")),
        "shift": shift,
    }
    return met.select("column", "kind", "physical_type", *(c.alias(name) for name, c in out.items()))


def table_facts(profile: DataFrame) -> DataFrame:
    """Of a table's profile, one row: columns, cells, missing cells, their share, and the candidate keys.

    Keys are identifiers without missing values whose values are all different.
    """
    key = (F.col("missing") == 0) & (F.col("n_distinct") == F.col("rows")) & (F.col("rows") > 0) & (F.col("semantic_type") == "identifier")
    out = profile.agg(
        F.count("*").alias("columns"), F.sum("rows").alias("cells"), F.sum("missing").alias("missing_cells"), F.sort_array(F.collect_list(F.when(key, F.col("column")))).alias("keys")
    )  # as many as columns
    return out.withColumn("missing_share", F.when(F.col("cells") > 0, F.col("missing_cells") / F.col("cells")).otherwise(F.lit(0.0)))


def profile_warnings(profile: DataFrame) -> DataFrame:
    """The warnings that a table's profile gives rise to: column, code, severity."""
    facts = profile.select("*", F.size(F.coalesce("sentinels", F.array())).cast("long").alias("n_sentinels"), F.col("shift").isNotNull().alias("shifted"))
    return insights.column_warnings(facts)
