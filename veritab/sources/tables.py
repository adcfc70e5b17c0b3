"""Tables that stay: saved results, profiles by dataset, the log of queries, and a catalog of columns."""

from __future__ import annotations

import decimal
import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "id string, sql string, row_count long, seconds double, error string, preview string, at timestamp"
PREVIEW_ROWS = 20


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table in place of one of its name, and read it back as a view of that name.

    A new version is written beside the old one, which readers keep until they read anew; the
    newest version counts.
    """
    path = f"{folder.rstrip('/')}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved.createOrReplaceTempView(name)
    return saved


def drop(spark: SparkSession, name: str) -> bool:
    """Forget a table's view; whether there was one."""
    return spark.catalog.dropTempView(name)


def replace_dataset(old: DataFrame | None, new: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows of a profile table after a new run: those of its datasets give way to the new ones."""
    if old is None:
        return new
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_partitions(new: DataFrame, path: str, key: str = "dataset_id") -> DataFrame:
    """Write the rows of a new run in place of those that its datasets had before, and read the whole table.

    The table is kept by ``key``: only the folders of the datasets in ``new`` are written anew,
    and nothing of the others is read. A dataset without rows in ``new`` keeps what it has.
    """
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    # A key is read as it was written: by its values Spark would take text of digits for numbers.
    return new.sparkSession.read.schema(new.select(*(c for c in new.columns if c != key), key).schema).parquet(path)


def plain_value(value):
    """A value as JSON has it: dates as ISO text, numbers that are none as null, lists and structs likewise."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (list, tuple)):
        return [plain_value(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain_value(v) for k, v in value.items()}
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return plain_value(float(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def log_query(spark: SparkSession, path: str, sql: str, row_count: int | None, seconds: float, error: str | None, columns: list[str], rows: list) -> None:
    """Append one query to a log: its text, rows, duration, error, and ``PREVIEW_ROWS`` rows as JSON.

    A query that failed has neither a number of rows nor a preview. Each query is a file of its
    own, so that several may be logged at once.
    """
    preview = None if error else json.dumps({"columns": columns, "rows": plain_value(rows[:PREVIEW_ROWS])}, ensure_ascii=False)
    row = [(uuid.uuid4().hex, sql, None if error else row_count, seconds, error, preview)]
    spark.createDataFrame(row, LOG.rsplit(", ", 1)[0]).coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def query_stats(log: DataFrame, key: str) -> DataFrame:
    """Queries and their mean duration by a column of the log: key, n, seconds."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.avg("seconds").alias("seconds"))


def usage(calls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Calls by their keys: n, total and mean of a value."""
    return calls.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def monthly_usage(calls: DataFrame, at: str, value: str, since: Column, budget: float | None = None) -> DataFrame:
    """Calls and their cost by calendar month from a time on, with whether a month is over budget: month, calls, cost, over_budget."""
    rows = calls.where(F.col(at) >= since).groupBy(F.date_trunc("month", at).cast("date").alias("month"))
    out = rows.agg(F.count("*").alias("calls"), F.sum(value).alias("cost"))
    return out.withColumn("over_budget", F.col("cost") > F.lit(budget) if budget is not None else F.lit(False))


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per column of the given tables: table, column, type, position."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, kind, i) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def labelled_joins(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Join edges (left_table, left_column, right_table, right_column) with both columns' labels (table, column, label)."""
    side = lambda s: labels.select(F.col("table").alias(f"{s}_table"), F.col("column").alias(f"{s}_column"), F.col("label").alias(f"{s}_label"))
    return edges.join(side("left"), ["left_table", "left_column"], "left").join(side("right"), ["right_table", "right_column"], "left")


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON text, nulls included and numbers that are none as null: json."""
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    how = {"double": number, "float": number, "array<double>": lambda c: F.transform(c, number), "array<float>": lambda c: F.transform(c, number)}
    columns = [how[kind](F.col(f"`{c}`")).alias(c) if kind in how else F.col(f"`{c}`") for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def bibtex(papers: DataFrame) -> DataFrame:
    """BibTeX entries of papers (id, title, authors array, year, venue, doi): id, key, entry.

    A key is the first author's last name, the year and the title's first word; entries that
    share one get a, b and so on by id. Papers with a venue that names a conference are
    inproceedings.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    last = plain(F.element_at(F.split(F.coalesce(F.get("authors", F.lit(0)), F.lit("anon")), "[ ,]+"), -1))
    word = plain(F.element_at(F.split(F.coalesce("title", F.lit("untitled")), " +"), 1))
    keyed = papers.withColumn("__key", F.concat(last, F.coalesce(F.col("year").cast("string"), F.lit("nd")), word))
    from pyspark.sql.window import Window

    same = Window.partitionBy("__key")
    place = F.row_number().over(same.orderBy("id"))
    key = F.when(F.count("*").over(same) == 1, F.col("__key")).otherwise(F.concat("__key", F.when(place <= 26, F.char(place + 96)).otherwise(F.concat(F.lit("_"), place.cast("string")))))
    conference = F.coalesce(F.lower("venue").rlike("proc|conference|workshop|symposium"), F.lit(False))
    line = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("}")))
    venue = F.when(conference, line("booktitle", F.col("venue"))).otherwise(line("journal", F.col("venue")))
    fields = F.concat_ws(",\n", line("title", F.col("title")), line("author", F.concat_ws(" and ", "authors")), line("year", F.col("year")), venue, line("doi", F.col("doi")))
    out = keyed.withColumn("key", key)
    return out.select("id", "key", F.concat(F.when(conference, "@inproceedings{").otherwise("@article{"), F.col("key"), F.lit(",\n"), fields, F.lit("\n}")).alias("entry"))
