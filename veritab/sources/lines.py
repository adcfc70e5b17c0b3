"""Quoted records of delimited files, from many tasks a file.

A line break within quotes belongs to a value, so whether a line begins a record depends on
all lines before it. Each split of a file tells, for both cases, whether quotes are open at its
end; put together in order these tell every split how it begins and which line it is at. Then
splits are read on their own, and only records that go over the end of a split are put together.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a record, and lines; a longer one has quotes that nobody closed.
MAX_CHARS, MAX_LINES = 16 << 20, 1 << 20
_SPLIT = "file string, block long, lines long, shut_open boolean, open_open boolean, shut_last long, open_last long, valid boolean"


def ends_open(line: str, opened: bool, delimiter: str) -> bool:
    """Whether quotes are open at the end of a line, given whether they are at its beginning.

    Quotes open a value only at its beginning; two within quotes stand for one.
    """
    at = 0
    while True:
        if not opened:
            if not line.startswith('"', at):
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        opened = True
        while True:  # to the quote that closes
            at = line.find('"', at) + 1
            if not at:
                return True
            if not line.startswith('"', at):
                break
            at += 1
        opened = False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """The lines of each split, as they come: a split may come in several parts."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        kind = pa.large_binary() if pa.types.is_large_string(batch.column("value").type) else pa.binary()
        lines = batch.column("value").cast(kind).to_pylist()
        for key, rows in groupby(range(len(lines)), lambda i: (files[i], blocks[i])):
            yield key, [lines[i] for i in rows]


@dataclass
class Layout:
    """How the splits of some files begin: by (file, block) the lines before, whether quotes are open, and the line where their record began."""

    encoding: str = "UTF-8"
    begins: dict[tuple[str, int], tuple[int, bool, int]] = field(default_factory=dict)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files with the split they come from; a task has those of a split in order."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def layout(spark: SparkSession, path: str, delimiter: str, encoding: str | None = None) -> Layout:
    """How the splits begin; one pass, of which the driver gets a row for each split.

    Files that are not UTF-8 throughout are ISO-8859-1, unless an encoding is given.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of both beginnings: open now, and the line of the split where the last record began.
        state: dict[tuple[str, int], list] = {}
        for key, lines in _runs(batches):
            s = state.setdefault(key, [0, False, True, -1, -1, True])
            for raw in lines:
                if not s[1]:
                    s[3] = s[0]
                if not s[2]:
                    s[4] = s[0]
                s[0] += 1
                if raw.isascii():
                    line = raw.decode("ascii")
                else:
                    line = raw.decode("latin-1")
                    s[5] = s[5] and _is_utf8(raw)
                if '"' in line:
                    s[1], s[2] = (ends_open(line, was, delimiter) for was in (s[1], s[2]))
        rows = [(*key, *s) for key, s in state.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(list(zip(names, kinds))))

    names = [part.split()[0] for part in _SPLIT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
    found = Layout(encoding or "UTF-8")
    at: dict[str, tuple[int, bool, int]] = {}
    for r in raw_lines(spark, path).mapInArrow(summed, _SPLIT).orderBy("file", "block").collect():
        before, opened, began = at.get(r["file"], (0, False, 0))
        found.begins[r["file"], r["block"]] = (before, opened, began)
        last = r["open_last"] if opened else r["shut_last"]
        at[r["file"]] = (before + r["lines"], r["open_open"] if opened else r["shut_open"], before + last if last >= 0 else began)
        if encoding is None and not r["valid"]:
            found.encoding = "ISO-8859-1"
    return found


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def records(spark: SparkSession, path: str, delimiter: str, known: Layout) -> DataFrame:
    """The records of files: file, line (of its first, from 1), record (line breaks as ``\\n``), whole.

    A record over ``MAX_CHARS`` or ``MAX_LINES`` is not whole, and has its first line alone; lines
    without a character are none. The mark before the first line is taken off.
    """
    shared = spark.sparkContext.broadcast(known)  # a few numbers for each split

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, encoding = shared.value.begins, shared.value.encoding
        key, out = None, []
        part: list[str] = []
        line = began = size = 0
        opened = inside = False

        def close(done: bool) -> None:
            """Put out what there is of a record; ``inside``: it began in an earlier split."""
            if part:
                out.append((key[0], began + 1, key[1], "\n".join(part), inside or not done))

        for found, lines in _runs(batches):
            if found != key:
                if opened:
                    close(False)
                key, part, size = found, [], 0
                line, opened, began = begins[key]
                inside = opened
            for raw in lines:
                text = raw.decode(encoding, errors="replace")
                if line == 0:
                    text = text.removeprefix("﻿")
                if not opened:
                    began, part, size, inside = line, [], 0, False
                size += len(text) + 1
                # Of what cannot be a record no more than its beginning is kept.
                if size <= MAX_CHARS or not part:
                    part.append(text[:MAX_CHARS])
                if '"' in text:
                    opened = ends_open(text, opened, delimiter)
                line += 1
                if not opened:
                    if size > MAX_CHARS or line - began > MAX_LINES:
                        out.append((key[0], began + 1, -1, part[0], False))
                    else:
                        close(True)
                    part = []
            if out:
                yield _batch(out)
                out = []
        if opened and key is not None:
            close(False)
        if out:
            yield _batch(out)

    shape = "file string, line long, block long, record string, part boolean"
    found = raw_lines(spark, path).mapInArrow(cut, shape)
    complete = found.where("NOT part").select("file", "line", "record", (F.col("block") >= 0).alias("whole"))
    # Parts of a record that goes over a split's end: each is bounded, and so is what is put together.
    parts = found.where("part").groupBy("file", "line").agg(F.sum(F.length("record")).alias("size"), F.min_by("record", "block").alias("first"), F.count("*").alias("k"))
    small = parts.where(F.col("size") <= MAX_CHARS).select("file", "line")
    joined = found.where("part").join(small, ["file", "line"]).groupBy("file", "line")
    joined = joined.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"))
    joined = joined.select("file", "line", "record", F.lit(True).alias("whole"))
    large = parts.where(F.col("size") > MAX_CHARS).select("file", "line", F.substring_index("first", "\n", 1).alias("record"), F.lit(False).alias("whole"))
    return complete.union(joined).union(large).where("record <> ''")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "line", "block", "record", "part"])


def fault(record: Column, whole: Column, width: int, delimiter: str) -> Column:
    """What is wrong with a rejected record: UNCLOSED QUOTE, TOO MANY COLUMNS, MISSING COLUMNS or INVALID RECORD."""
    def name(text: str, is_whole: bool) -> str:
        if not is_whole or ends_open(text.replace("\n", " "), False, delimiter):
            return "UNCLOSED QUOTE"
        fields = len(next(csv.reader([text.replace("\n", " ")], delimiter=delimiter)))
        return "TOO MANY COLUMNS" if fields > width else "MISSING COLUMNS" if fields < width else "INVALID RECORD"

    def names(texts: pd.Series, wholes: pd.Series) -> pd.Series:
        return pd.Series([name(t, w) for t, w in zip(texts, wholes)], dtype="string")

    return F.pandas_udf(names, "string")(record, whole)
