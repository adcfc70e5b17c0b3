"""Order statistics from counts of distinct values: running sums, ranks and exact quantiles.

Values are counted first, which combines before the shuffle. Counts are cut into ranges of
values, summed by range, added up over the ranges (a few rows for each key), and summed within
each range by a window of its own. So no task sorts or holds all values of a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def finite(column: Column) -> Column:
    """The value as a double, null unless it is a finite number."""
    x = column.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def with_running(counts: DataFrame, by: list[str], value: str, weights: list[str]) -> DataFrame:
    """Add for every weight its sums within ``by``: ``before_<w>`` over smaller values, ``same_<w>`` over rows of this value.

    Values are not null. Rows are cut into ranges of (by, value) as Spark sorts them, so that the
    work for a row does not depend on how many ranges there are. They are written, so that ranges
    stay as they are.
    """
    placed = written(counts.repartitionByRange(*by, value).withColumn("__range", F.spark_partition_id()), "running")
    totals = placed.groupBy(*by, "__range").agg(*(F.sum(w).alias(f"__{w}") for w in weights))
    order = Window.partitionBy(*by).orderBy("__range") if by else Window.orderBy("__range")  # as many rows as ranges
    before = totals.select(*by, "__range", *((F.sum(f"__{w}").over(order) - F.col(f"__{w}")).alias(f"__{w}") for w in weights))
    met = placed.join(before if by else F.broadcast(before), [*by, "__range"])
    running, same = Window.partitionBy(*by, "__range").orderBy(value), Window.partitionBy(*by, "__range", value)
    met = met.withColumns({f"same_{w}": F.sum(w).over(same) for w in weights} | {f"before_{w}": F.col(f"__{w}") + F.sum(w).over(running) for w in weights})
    return met.withColumns({f"before_{w}": F.col(f"before_{w}") - F.col(f"same_{w}") for w in weights}).drop("__range", *(f"__{w}" for w in weights))


def ranked_counts(counts: DataFrame, value: str, ties: str) -> DataFrame:
    """Counts of distinct values with ``rank``, the average rank of each value's rows."""
    found = with_running(counts, [], value, [ties])
    return found.withColumn("rank", F.col(f"before_{ties}") + (F.col(ties) + 1) / 2.0).drop(f"before_{ties}", f"same_{ties}")


def by_ranges(counts: DataFrame, by: str, value: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Counts of values (by, value, n, more) with their range, and for each key and range: before, sum, total.

    Rows are cut into ranges of (by, value), whatever the number of keys and however large one
    is; ``before`` is the sum of n over the ranges of a key before this one, ``total`` that of
    the key. They are written, so that ranges stay as they are.
    """
    placed = counts.select(by, value, "n", *more).repartitionByRange(by, value)
    placed = written(placed.withColumn("range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(by, "range").agg(F.sum("n").alias("sum"))
    of_key = Window.partitionBy(by)  # a row for each range
    before = F.sum("sum").over(of_key.orderBy("range")) - F.col("sum")
    return placed, sums.select(by, "range", before.alias("before"), "sum", F.sum("sum").over(of_key).alias("total"))


def in_order(counts: DataFrame, by: str, value: str, *more: str) -> DataFrame:
    """Counts of values (by, value, n) in order, with the facts of their range (see ``by_ranges``)."""
    placed, sums = by_ranges(counts, by, value, *more)
    return placed.join(sums, [by, "range"])


def quantiles_of_counts(counts: DataFrame, by: str, value: str, fractions: list[float]) -> DataFrame:
    """Exact interpolated quantiles from counts of values (by, value, n): by, n, q (an array in the order of ``fractions``).

    Only the ranges that hold a wanted place are summed value by value; they are listed first, so
    that Spark knows how few they are when it joins them. A value may have several counts.
    """
    placed, sums = by_ranges(counts, by, value)
    places = F.array_distinct(F.array(*(f((F.col("total") - 1) * F.lit(q)).cast("long") for q in fractions for f in (F.floor, F.ceil))))
    inside = F.filter(places, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("sum")))
    ranges = written(sums.withColumn("places", inside).where("size(places) > 0").drop("sum"), "wanted")
    running = Window.partitionBy(by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = placed.join(ranges, [by, "range"]).withColumn("end", F.col("before") + F.sum("n").over(running))
    hit = wanted.select(by, "total", value, "n", "end", F.explode("places").alias("place")).where("place >= end - n and place < end")
    found = hit.groupBy(by, "total").agg(F.map_from_entries(F.collect_list(F.struct("place", value))).alias("at"))  # two places for each fraction

    def pick(q: float) -> Column:
        place = (F.col("total") - 1) * F.lit(q)
        low, high = (F.element_at("at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (place - F.floor(place)) * (high - low)

    return found.select(by, F.col("total").alias("n"), F.array(*map(pick, fractions)).alias("q"))


def chunk_starts(placed: DataFrame, columns: list[str], position: str, chunks: int) -> tuple[DataFrame, DataFrame]:
    """Equal chunks of the values of several columns in the order of distinct positions, which ``placed`` has cut into ranges by its column range.

    Two tables: where chunks begin (col, its place in ``columns``; chunk, from 0; first_position),
    and by range for each column (parts: col, chunk before the range, begins, the positions in
    it where a chunk begins). Chunks differ by one row at most, the longer ones first. Ranges are
    counted; only those where a chunk begins are put in order.
    """
    counts = F.array(*(F.struct(F.lit(i).alias("col"), F.count(F.col(c)).alias("sum")) for i, c in enumerate(columns)))
    sums = placed.groupBy("range").agg(counts.alias("c")).select("range", F.inline("c")).where("sum > 0")
    of_column = Window.partitionBy("col")  # a row for each range
    sums = sums.withColumns({"total": F.sum("sum").over(of_column), "before": F.sum("sum").over(of_column.orderBy("range")) - F.col("sum")})
    size, longer = F.floor(F.col("total") / chunks), F.col("total") % chunks
    numbers = F.sequence(F.lit(0), F.lit(chunks - 1))
    listed = F.transform(numbers, lambda k: F.struct(k.alias("chunk"), (k * size + F.least(k.cast("long"), longer)).alias("start")))
    inside = F.filter(listed, lambda s: (s["start"] >= F.col("before")) & (s["start"] < F.col("before") + F.col("sum")))
    earlier = F.size(F.filter(listed, lambda s: s["start"] < F.col("before")))
    ranges = written(sums.select("range", "col", "before", (earlier - 1).alias("chunk"), inside.alias("begun")), "chunks")
    begun = ranges.where("size(begun) > 0").select("range", "col", "before", F.map_from_entries(F.transform("begun", lambda s: F.struct(s["start"], s["chunk"]))).alias("begun"))
    met = placed.join(F.broadcast(begun), "range")  # as many as chunks at most
    met = met.select("col", "range", "before", "begun", position, F.array(*columns)[F.col("col")].alias("x")).where("x is not null")
    place = F.col("before") + F.row_number().over(Window.partitionBy("col", "range").orderBy(position)) - 1
    starts = met.withColumn("chunk", F.col("begun")[place]).where("chunk is not null").select("range", "col", "chunk", F.col(position).alias("first_position"))
    starts = written(starts, "chunk-starts")
    begins = starts.groupBy("range", "col").agg(F.collect_list("first_position").alias("begins"))  # as many as chunks
    begins = ranges.select("range", "col", "chunk").join(F.broadcast(begins), ["range", "col"], "left").withColumn("begins", F.coalesce("begins", F.array().cast("array<bigint>")))
    return starts.drop("range"), begins.groupBy("range").agg(F.collect_list(F.struct("col", "chunk", "begins")).alias("parts"))  # as many as columns


def quantiles(rows: DataFrame, by: str, value: str, fractions: list[float]) -> DataFrame:
    """Exact interpolated quantiles of finite values: by, n, q (an array in the order of ``fractions``).

    Rows with a null key or value are not counted.
    """
    read = rows.select(F.col(by).alias("by"), finite(F.col(value)).alias("value")).where("by is not null and value is not null")
    counts = read.groupBy("by", "value").agg(F.count("*").alias("n"))
    return quantiles_of_counts(counts, "by", "value", fractions).withColumnRenamed("by", by)


def column_quantiles(df: DataFrame, columns: list[str], fractions: list[float]) -> DataFrame:
    """Exact quantiles of several columns in one go: column, n, q; columns without values give no row."""
    values = F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(f"`{c}`")).alias("value")) for c in columns))
    return quantiles(df.select(F.explode(values).alias("p")).select("p.*"), "column", "value", fractions)
