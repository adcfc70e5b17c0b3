"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Bytes of text that an operator holds as Python objects at once.
PIECE_BYTES = 2 << 20
#: Rows that Spark sends to a Python worker at once, where the session says nothing else.
BATCH_ROWS, _SPARK_ROWS = 300, "10000"


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send fewer rows at once than its default, as texts may be long.

    The setting stays in the session, as results are computed later; a number that a user has set is left.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, _SPARK_ROWS) == _SPARK_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], T]) -> T:
    """What this Python worker made for ``key``; it serves many tasks of a stage.

    A worker holds one thing only: the next operator's takes the place of the last one's, and
    the memory goes back to the system.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as tests do, a temporary folder
    is made and set; on a cluster executors would not see it, and ValueError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veritab-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here.

    A lost executor then costs a reread, never a recomputation, and later plans read only
    the columns that they need. The files go when the session's process ends; until then a
    result may still be read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    written = jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


def pieces(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in a piece stay near ``max_bytes``.

    A single longer text is a piece of its own: texts are never cut.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8 bytes, null as empty."""
    array = pc.fill_null(batch.column(column), "")
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


class Numbers(dict):
    """Numbers strings in the order they are first looked up; ``fresh`` has the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        number = self[text] = len(self)
        self.fresh.append(text)
        return number
