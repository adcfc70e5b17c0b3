"""Exact duplicates by deterministic block naming: equal texts, and only those, get one name.

A text's bytes are cut into blocks of fixed size. All distinct blocks are sorted, and a block's
name is its place there, by its first bytes, a hash and all bytes; then neighbouring names are paired, the distinct pairs are sorted and
named likewise, and so on until a text has a single name. Names are places in a sort, never
hashes, so they cannot collide.

Texts stay in chunks, parts of a task's input of bounded size. A chunk numbers its distinct
blocks (or pairs) for itself, only those go through the sort, and the names come back to the
chunk. A block that very many texts share thus moves once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, utf8

BLOCK_BYTES = 1024
#: A chunk ends when it has this many blocks, or distinct ones of this many bytes.
CHUNK_BLOCKS, CHUNK_BYTES = 1 << 17, 24 << 20
_RANK_BITS = 40  # of a name below the number of its range
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(raw: bytes) -> bytes:
    """A-Z as a-z; bytes of other characters are never in that range."""
    return raw.translate(_LOWER)


#: Rows of a chunk: a text (``row`` numbers it; ``names`` are its blocks, as numbers within the
#: chunk) or a distinct block or pair (``local`` is its number).
_TEXT_ROWS = "chunk long, row long, names array<int>"
_BLOCK_ROWS = "chunk long, local int, block binary"
_PAIR_ROWS = "chunk long, local int, first long, second long"


def _named(rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Sort distinct blocks or pairs; chunk, local, name. ``rows`` are to be read from files.

    They are sorted by ``order``, if there is one, then by their keys; ranges are cut by the
    former alone. Equal keys are in one range, where names count up; a range has its own names,
    above those of the ranges before it.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rank, last = TaskContext.get().partitionId() << _RANK_BITS, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.ones(batch.num_rows, bool)
            columns = [batch.column(k) for k in keys]
            same = [pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns]
            fresh[1:] = ~np.logical_and.reduce(same)
            fresh[0] = [c[0].as_py() for c in columns] != last
            last = [c[-1].as_py() for c in columns]
            ranks = rank + np.cumsum(fresh)
            rank = int(ranks[-1])
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("local"), pa.array(base + ranks)], names=["chunk", "local", "name"])

    cut = order or [F.col(k) for k in keys]
    placed = rows.repartitionByRange(*cut).sortWithinPartitions(*cut, *(keys if order else []))
    return placed.mapInArrow(name, "chunk long, local int, name long")


def _cut(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[bytes], bytes], block_bytes: int) -> DataFrame:
    """Chunks of texts and their distinct blocks, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, row = TaskContext.get().partitionId() << 32, 0
        numbers: dict[bytes, int] = {}
        blocks_seen = bytes_seen = 0
        for batch in pieces(batches, "text"):
            if blocks_seen >= CHUNK_BLOCKS or bytes_seen >= CHUNK_BYTES:
                chunk, numbers, blocks_seen, bytes_seen = chunk + 1, {}, 0, 0
            texts = [normalise(t) for t in utf8(batch, "text")]
            known, names = len(numbers), []
            for text in texts:
                # An empty text is one empty block.
                cut = [text[i : i + block_bytes] for i in range(0, len(text) or 1, block_bytes)]
                names.append([numbers.setdefault(b, len(numbers)) for b in cut])
                blocks_seen += len(cut)
            fresh = list(numbers)[known:] if known else list(numbers)
            bytes_seen += sum(map(len, fresh))
            n, m = len(texts), len(fresh)
            columns = [
                pa.array(np.full(n + m, chunk)),
                pa.array([*range(row, row + n), *[None] * m], pa.int64()),
                pa.concat_arrays([batch.column("id"), pa.nulls(m, batch.column("id").type)]),
                pa.array([*(hashlib.sha256(t).hexdigest() for t in texts), *[None] * m], pa.string()),
                pa.array([*names, *[None] * m], pa.list_(pa.int32())),
                pa.array([*[None] * n, *range(known, known + m)], pa.int32()),
                pa.array([*[None] * n, *fresh], pa.binary()),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=shape)

    shape = ["chunk", "row", "id", "text_sha256", "names", "local", "block"]
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return read.mapInArrow(run, f"chunk long, row long, id {kind}, text_sha256 string, names array<int>, local int, block binary")


def _paired(texts: DataFrame, names: DataFrame, final: bool = False) -> DataFrame:
    """Give the texts of every chunk their names, and pair neighbours.

    Rows: a text that has one name (``name`` is set), a text in numbers of pairs (``names``),
    or a distinct pair (local, first, second); the last name of an odd number pairs with -1.
    """

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        of = np.zeros(found.num_rows, np.int64)
        of[found.column("local").to_numpy()] = found.column("name").to_numpy()
        lists = rows.column("names").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = of[lists.flatten().to_numpy()]
        starts = np.cumsum(sizes) - sizes
        done = sizes == 1
        # Pairs of all texts: the first of each pair, and the next name if the same text has one.
        halves = np.where(done, 0, (sizes + 1) // 2)
        owner = np.repeat(np.arange(len(sizes)), halves)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves)
        at = starts[owner] + 2 * step
        first = flat[at]
        second = np.where(2 * step + 1 < sizes[owner], flat[np.minimum(at + 1, max(len(flat) - 1, 0))], -1) if len(flat) else first
        pairs, numbers = np.unique(np.stack([first, second], axis=1), axis=0, return_inverse=True)
        open_ = ~done
        m, n = len(pairs), len(sizes)
        offsets = np.concatenate([[0], np.cumsum(halves[open_])]).astype(np.int32)
        lists_out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers.reshape(-1).astype(np.int32)))
        row = rows.column("row").combine_chunks()
        finished, unfinished = row.filter(pa.array(done)), row.filter(pa.array(open_))
        chunk = rows.column("chunk")[0].as_py()

        def none(count: int, kind: pa.DataType) -> pa.Array:
            return pa.nulls(count, kind)

        f, u = len(finished), len(unfinished)
        return pa.table(
            {
                "chunk": pa.array(np.full(f + u + m, chunk)),
                "row": pa.concat_arrays([finished, unfinished, none(m, pa.int64())]),
                "name": pa.concat_arrays([pa.array(flat[starts[done]]), none(u + m, pa.int64())]),
                "names": pa.concat_arrays([none(f, lists_out.type), lists_out, none(m, lists_out.type)]),
                "local": pa.concat_arrays([none(f + u, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
                "first": pa.concat_arrays([none(f + u, pa.int64()), pa.array(pairs[:, 0])]),
                "second": pa.concat_arrays([none(f + u, pa.int64()), pa.array(pairs[:, 1])]),
            }
        )

    shape = "chunk long, row long, name long, names array<int>, local int, first long, second long"
    return texts.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(run, shape)


def same_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    normalise: Callable[[bytes], bytes] = lower_ascii, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The group of equal texts of every row, and which row of it stays.

    Texts are equal when ``normalise`` gives the same bytes. Returns id, keep_id (the largest
    id of the group), group_size, kept, text_sha256 (of the normalised text), blocks (levels of
    names that the text needed). Null counts as empty. Every row is a document of its own: of
    rows with equal text that share the largest id, one is kept. Null ids are smaller than any
    other. An empty table gives no rows; other columns are not read.
    """
    cut = materialize(_cut(docs, id_col, text_col, normalise, block_bytes), "blocks")
    texts = cut.where("row IS NOT NULL")
    pending = texts.select("chunk", "row", "names")
    # Spark looks at a sample of what it cuts ranges by on the driver: a few bytes of each block, not all.
    by_start = [F.substring("block", 1, 8), F.xxhash64("block")]
    names = _named(cut.where("local IS NOT NULL").select("chunk", "local", "block"), ["block"], by_start)
    finished, level = None, 0
    while True:
        step = materialize(_paired(pending, names), "pairs")
        one = step.where("name IS NOT NULL").select("chunk", "row", "name", F.lit(level).alias("level"))
        finished = one if finished is None else finished.union(one)
        pending = step.where("names IS NOT NULL").select("chunk", "row", "names")
        if pending.isEmpty():
            break
        names = _named(step.where("local IS NOT NULL").select("chunk", "local", "first", "second"), ["first", "second"])
        level += 1
    # A text is known by its name and the level where it was the only one.
    named = texts.select("chunk", "row", F.col("id"), "text_sha256").join(finished, ["chunk", "row"])
    named = materialize(named, "named")
    best = F.max(F.struct("id", "chunk", "row"))
    groups = materialize(named.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    kept = (F.col("best.chunk") == F.col("chunk")) & (F.col("best.row") == F.col("row"))
    found = named.join(groups, ["level", "name"])
    return found.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", F.col("level").alias("blocks"))
