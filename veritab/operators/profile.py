"""Column and table profiles, each one or two aggregations over all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .ranks import chunk_starts, column_quantiles, finite, quantiles, quantiles_of_counts

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
# Numeric codes that often stand for a missing value, and how often one must occur.
SENTINEL_VALUES = (-99999.0, -9999.0, -999.0, -99.0, 999.0, 9999.0, 99999.0)
SENTINEL_MIN_COUNT = 2


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: counts, extremes, moments and exact quantiles of its finite values.

    NaN and infinity count as no value. Moments of all columns take one pass; quantiles come
    from counts of values.
    """
    parts = []
    for c in columns:
        x = finite(F.col(c))
        n = F.count(x)
        # Spark's skewness is the population's; this is the sample-corrected one.
        fix = F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2))
        parts.append(
            F.struct(
                F.lit(c).alias("column"), n.alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("stddev"), (F.skewness(x) * fix).alias("skewness"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"),
            )
        )
    moments = df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
    met = moments.join(F.broadcast(column_quantiles(df, columns, list(QUANTILES)).select("column", "q")), "column", "left")
    q = F.col("q")
    return met.select(
        "column", "n", "min", "max", "mean", q[2].alias("median"), "stddev", "skewness", "zeros", "negatives", q[0].alias("p05"), q[1].alias("p25"), q[3].alias("p75"), q[4].alias("p95")
    )


def fences(df: DataFrame, column: str) -> DataFrame:
    """Tukey fences of a column's finite values, low_fence and high_fence; one row, none without values."""
    q = column_quantiles(df, [column], [0.25, 0.75]).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    return q.select((F.col("a") - 1.5 * (F.col("b") - F.col("a"))).alias("low_fence"), (F.col("b") + 1.5 * (F.col("b") - F.col("a"))).alias("high_fence"))


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Tukey fences and how many finite values lie outside; one row."""
    found = df.select(finite(F.col(column)).alias("x")).crossJoin(F.broadcast(fences(df, column)))  # one row of fences
    return found.groupBy("low_fence", "high_fence").agg(
        F.count("x").alias("n"), F.count_if((F.col("x") < F.col("low_fence")) | (F.col("x") > F.col("high_fence"))).alias("n_outside")
    )


def sentinels(df: DataFrame, column: str, codes: tuple[float, ...] | list[float] = SENTINEL_VALUES) -> DataFrame:
    """Codes such as -999 that occur twice or more outside the fences: code, n."""
    x = F.col(column).cast("double")
    counts = df.where(x.isin(list(codes))).groupBy(x.alias("code")).agg(F.count("*").alias("n")).where(F.col("n") >= SENTINEL_MIN_COUNT)
    return counts.crossJoin(F.broadcast(fences(df, column))).where("code < low_fence or code > high_fence").select("code", "n")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts over equal bins from minimum to maximum, empty bins too."""
    x = finite(F.col(column))
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(bounds)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    last = F.when(F.col("hi") > F.col("lo"), F.lit(bins - 1)).otherwise(F.lit(0))
    spine = bounds.where("lo is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` commonest values with their share of non-null rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column).alias("total"))
    return counts.orderBy(F.desc("n"), "value").limit(k).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def category_stats(df: DataFrame, column: str, rare: float = 0.01) -> DataFrame:
    """Distinct values, rare ones, largest share, and largest count over smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column).alias("total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .groupBy("total")
        .agg(
            F.count("*").alias("n_distinct"), F.count_if(F.col("n") < rare * F.col("total")).alias("n_rare"),
            (F.max("n") / F.first("total")).alias("top_share"), (F.max("n") / F.min("n")).alias("imbalance_ratio"),
        )
        .drop("total")
    )


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per text column: lengths, blanks, words; one pass."""
    parts = []
    for c in columns:
        text = F.col(c)
        trimmed = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
        words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.min(F.length(text)).cast("long").alias("min_length"), F.avg(F.length(text)).alias("avg_length"), F.max(F.length(text)).cast("long").alias("max_length"),
                F.count_if(trimmed == "").alias("blank"), F.avg(F.when(text.isNotNull(), words)).alias("avg_words"),
            )
        )
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


# Fixed value: a number followed by a unit, such as "72 kg", "5.5ft" or "30%".
UNIT_PATTERN = r"^[-+]?[0-9]*[.,]?[0-9]+\s*([A-Za-z%°µ][A-Za-z%°µ/²³0-9]*)$"


def unit_histogram(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """Units written after numbers, such as ``170 cm``: the ``k`` commonest with their counts."""
    unit = F.regexp_extract(F.trim(F.col(column)), UNIT_PATTERN, 1)
    counts = df.select(unit.alias("unit")).where("unit <> ''").groupBy("unit").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "unit").limit(k)


def modal_gap(df: DataFrame, column: str) -> DataFrame:
    """The commonest gap in days between neighbouring distinct dates, the smaller on ties.

    Distinct dates are at most a few hundred thousand in any calendar, so one window is fine.
    """
    days = df.select(F.to_date(column).alias("d")).where("d is not null").distinct()
    gaps = days.select(F.datediff("d", F.lag("d").over(Window.orderBy("d"))).cast("long").alias("gap")).where("gap is not null")
    return gaps.groupBy("gap").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap").limit(1)


PERIODS = ["day", "week", "month", "quarter", "year"]
MAX_PERIODS = 400


def granularity(gap: Column, has_time: Column) -> Column:
    """What a column of dates records, from its modal gap in days."""
    named = F.when(gap.isNull(), "single date").when(gap == 1, "daily").when(gap == 7, "weekly").when(gap.between(28, 31), "monthly").when(gap.between(89, 92), "quarterly")
    named = named.when(gap.isin(365, 366), "yearly").otherwise(F.concat(F.lit("irregular (~"), gap.cast("string"), F.lit(" days)")))
    return F.when(has_time, "sub-daily").otherwise(named)


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """First and last date, granularity and the period to count by; one row.

    The period follows the span, is never finer than the data's, and grows until no more than
    ``MAX_PERIODS`` are counted. A column without dates gives nulls.
    """
    c = F.col(column)
    timed = dict(df.dtypes)[column].startswith("timestamp")
    has_time = F.coalesce(F.bool_or(c != c.cast("date").cast(dict(df.dtypes)[column])), F.lit(False)) if timed else F.lit(False)
    span = df.agg(F.min(c.cast("date")).alias("first"), F.max(c.cast("date")).alias("last"), has_time.alias("has_time"))
    gap = modal_gap(df, column).agg(F.min("gap").alias("gap"))  # one row, also without gaps
    both = span.crossJoin(F.broadcast(gap)).withColumn("granularity", granularity(F.col("gap"), F.col("has_time")))
    counts = F.array(*(period_number(F.col("last"), p) - period_number(F.col("first"), p) + 1 for p in PERIODS))
    name = F.element_at(F.array(*map(F.lit, PERIODS)), period_choice(F.datediff("last", "first"), F.col("granularity"), counts) + 1)
    return both.select("first", "last", F.when(F.col("first").isNotNull(), F.col("granularity")).alias("granularity"), F.when(F.col("first").isNotNull(), name).alias("period"))


def period_choice(days: Column, grain: Column, counts: Column) -> Column:
    """The place in ``PERIODS`` of the period to count by; ``counts`` has the number of each in the span."""
    by_span = F.when(days > 20 * 366, 4).when(days <= 92, 0).when(days <= 731, 1).otherwise(2)
    by_data = F.when(grain == "weekly", 1).when(grain == "monthly", 2).when(grain == "quarterly", 3).when(grain == "yearly", 4).otherwise(0)
    # Of the periods from there on the first with few enough counts, the year in any case.
    fits = F.filter(F.sequence(F.greatest(by_span, by_data), F.lit(4)), lambda i: (F.element_at(counts, i + 1) <= MAX_PERIODS) | (i == 4))
    return F.element_at(fits, 1)


def period_number(day: Column, period: str) -> Column:
    """Whole periods since a fixed day, so that differences count periods."""
    if period in ("day", "week"):
        days = F.datediff(F.date_trunc(period, day).cast("date"), F.lit("1970-01-05").cast("date"))
        return days if period == "day" else F.floor(days / 7).cast("int")
    months = F.year(day) * 12 + F.month(day) - 1
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[period]).cast("int")


_STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def period_counts(df: DataFrame, column: str, period: str) -> DataFrame:
    """Rows by calendar period, periods without rows as 0."""
    at = F.date_trunc(period, F.col(column)).cast("date")
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("period")).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo is not null")
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(_STEPS[period]))).alias("period"))
    return spine.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row; one row."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"))


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: rows, missing, distinct values and uniqueness.

    Values are counted as (column, value) groups, which combine before the shuffle; one
    aggregate of many distinct counts would copy every row once for each column.
    """
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*")
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("n_distinct")
    )
    known = F.col("rows") - F.col("missing")
    return out.withColumn("uniqueness", F.when(known > 0, F.col("n_distinct") / known).otherwise(F.lit(0.0)))


# Fixed value: names of identifiers.
ID_NAME = r"(^|_)(id|uuid|guid|key)$|^id_"


def candidate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identifiers without missing values whose values are all different.

    Identifiers are integers with a telling name, and text of one word a value or with such a
    name, in 20 rows or more.
    """
    kinds = dict(df.dtypes)
    named = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "string") and re.search(ID_NAME, c)]
    texts = [c for c in columns if kinds[c] == "string" and c not in named]
    keys = column_counts(df, named + texts).where("missing = 0 and n_distinct = rows and rows > 0").select("column", "rows") if named or texts else None
    if keys is None:
        return df.sparkSession.createDataFrame([], "column string")
    if not texts:
        return keys.select("column")
    words = text_stats(df, texts).select("column", "avg_words", "avg_length")
    short = (F.col("rows") >= 20) & (F.col("avg_words") <= 1.5) & (F.col("avg_length") < 50)
    return keys.join(F.broadcast(words), "column", "left").where(F.col("avg_words").isNull() | short).select("column")


def table_summary(columns: DataFrame) -> DataFrame:
    """Cells, missing cells and their share over a table's column counts; one row."""
    out = columns.agg(F.count("*").alias("columns"), F.coalesce(F.sum("rows"), F.lit(0)).alias("cells"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"))
    return out.withColumn("missing_share", F.when(F.col("cells") > 0, F.col("missing_cells") / F.col("cells")).otherwise(F.lit(0.0)))


def chunk_medians_of(df: DataFrame, columns: list[str], position: str, chunks: int = 10) -> DataFrame:
    """Medians of equal chunks of each column's finite values in the order of ``position``: col (its place in ``columns``), chunk (from 1), rows, first_position, median.

    Positions are distinct numbers, as rows of a file have; chunks differ by one row at most,
    the longer ones first. Rows are cut into ranges of positions once for all columns; where
    chunks begin tells the chunk of a row, so rows are counted without being put in order.
    """
    values = [f"x{i}" for i in range(len(columns))]
    rows = df.select(F.col(position).cast("long").alias("position"), *(finite(F.col(f"`{c}`")).alias(v) for c, v in zip(columns, values)))
    rows = rows.where(F.col("position").isNotNull() & F.coalesce(*values).isNotNull()).repartitionByRange("position")
    placed = written(rows.withColumn("range", F.spark_partition_id()), "positions")
    starts, parts = chunk_starts(placed, values, "position", chunks)
    cells = placed.join(F.broadcast(parts), "range").select("position", F.array(*values).alias("x"), F.explode("parts").alias("p"))
    chunk = F.col("p.chunk") + F.size(F.filter("p.begins", lambda first: first <= F.col("position")))
    cut = cells.select((F.col("p.col") * chunks + chunk).alias("key"), F.col("x")[F.col("p.col")].alias("x")).where("x is not null")
    medians = quantiles_of_counts(cut.groupBy("key", "x").agg(F.count("*").alias("n")), "key", "x", [0.5])
    medians = medians.select(F.floor(F.col("key") / chunks).cast("int").alias("col"), F.pmod("key", F.lit(chunks)).alias("chunk"), F.col("n").alias("rows"), F.col("q")[0].alias("median"))
    return starts.join(medians, ["col", "chunk"]).select("col", (F.col("chunk") + 1).cast("int").alias("chunk"), "rows", "first_position", "median")


def chunk_medians(df: DataFrame, column: str, position: str, chunks: int = 10) -> DataFrame:
    """Those of one column: chunk (from 1), rows, first_position, median."""
    return chunk_medians_of(df, [column], position, chunks).drop("col")


UNIT_SHIFT_ROWS, UNIT_SHIFT_RATIO, UNIT_SHIFT_WITHIN = 300, 2.0, 1.3


def unit_shift(df: DataFrame, column: str, position: str, chunks: int = 10) -> DataFrame:
    """A lasting jump of scale partway through a file, such as from kg to lb: from_position, ratio, median_before, median_after.

    See ``shifts``; no row if there is none.
    """
    return shifts(chunk_medians(df, column, position, chunks).withColumn("by", F.lit(0)), "by").drop("by")


def shifts(medians: DataFrame, by: str) -> DataFrame:
    """Lasting jumps among chunk medians (by, chunk, rows, first_position, median): by, from_position, ratio, median_before, median_after.

    Medians must have one sign, differ by ``UNIT_SHIFT_RATIO`` across the jump, and by
    ``UNIT_SHIFT_WITHIN`` at most on each side, of two chunks or more. The strongest jump is
    given, the first of equal ones; no row if there is none or under ``UNIT_SHIFT_ROWS`` values.
    """
    listed = medians.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("chunk", "median", "first_position"))).alias("c"), F.sum("rows").alias("n"))  # as many as chunks
    m = F.transform("c", lambda x: x["median"])
    one_sign = F.forall(m, lambda x: x > 0) | F.forall(m, lambda x: x < 0)
    usable = listed.where((F.col("n") >= UNIT_SHIFT_ROWS) & (F.size("c") >= 4) & one_sign).select(by, "c", m.alias("m"), F.explode(F.sequence(F.lit(2), F.size("c") - 2)).alias("k"))
    half = lambda a: F.expr(f"(element_at(array_sort({a}), cast((size({a}) + 1) div 2 as int)) + element_at(array_sort({a}), cast(size({a}) div 2 + 1 as int))) / 2")
    sides = usable.withColumns({"a": F.slice("m", F.lit(1), F.col("k")), "b": F.slice("m", F.col("k") + 1, F.size("m") - F.col("k"))})
    spread = lambda s: F.greatest(F.abs(F.array_max(s)), F.abs(F.array_min(s))) / F.least(F.abs(F.array_max(s)), F.abs(F.array_min(s)))
    judged = sides.withColumns({"median_before": half("a"), "median_after": half("b"), "within": F.greatest(spread("a"), spread("b"))})
    judged = judged.withColumn("ratio", F.col("median_after") / F.col("median_before")).withColumn("jump", F.greatest("ratio", 1 / F.col("ratio")))
    fits = judged.where((F.col("jump") >= UNIT_SHIFT_RATIO) & (F.col("within") <= UNIT_SHIFT_WITHIN))
    best = fits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("jump"), "k"))).where("place = 1")
    return best.select(by, F.element_at("c", F.col("k") + 1)["first_position"].alias("from_position"), "ratio", "median_before", "median_after")


def match_rates(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """For each named pattern the share of values that match it as a whole."""
    parts = [F.struct(F.lit(k).alias("kind"), F.avg(F.col(column).rlike(f"^(?:{p})$").cast("double")).alias("rate")) for k, p in patterns.items()]
    return df.where(F.col(column).isNotNull()).agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def equal_shares(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each pair of columns the share of rows that agree, nulls agreeing with nulls."""
    same = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg(F.col(a).cast("string").eqNullSafe(F.col(b).cast("string")).cast("double")).alias("share")) for a, b in pairs]
    return df.agg(F.array(*same).alias("rows")).select(F.inline("rows"))


def semantic_type(kind: str, n_distinct: Column, uniqueness: Column, known: Column, id_name: bool, avg_length: Column, avg_words: Column, two_valued: Column) -> Column:
    """What a column means: constant, boolean, datetime, identifier, categorical, numeric, text."""
    first = F.when(n_distinct <= 1, "constant").when(F.lit(kind == "boolean") | ((n_distinct == 2) & two_valued), "boolean")
    if kind == "datetime":
        return first.otherwise("datetime")
    if kind == "integer":
        return first.when(F.lit(id_name) & (uniqueness >= 0.95), "identifier").when((n_distinct <= 10) & (uniqueness <= 0.5), "categorical").otherwise("numeric")
    if kind == "real":
        return first.otherwise("numeric")
    unique = uniqueness >= 0.95
    free = (avg_length >= 50) | ((avg_words >= 4) & (uniqueness >= 0.5))
    return first.when(F.lit(id_name) & unique, "identifier").when(free, "free_text").when(unique & (known >= 20) & (avg_words <= 1.5), "identifier").otherwise("categorical")
