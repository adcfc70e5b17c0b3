"""Vector best-fit packing of tokenized documents into training sequences.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces go, longest first, into the open sequence that fits under every
capacity and leaves the least weighted residual norm (or has the largest weighted dot product
of demand and residual); if none fits, a new sequence opens.

With the default capacities only tokens can close a sequence, as sequences are to be few: each
piece has at least one token, and a sum of squares is at most the square of the sum. The other two
weigh in the choice: of sequences with like room for tokens, a piece goes where less attention
cost and fewer documents are left to spend. Smaller capacities bind, each for itself.

Tokenized pieces (ids and lengths, not texts) are dealt evenly over tasks of about
``TASK_PIECES``, whatever order and file they came from. A task places all of its pieces
together, longest first, and every sequence stays open as long as it has room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import AT_ONCE, encoder
from .common import materialize, pieces, strings

#: Pieces that a task packs together, about; bounds its memory and the cost of a search.
TASK_PIECES = 32768


@dataclass
class Capacities:
    """What a sequence may hold, and how the residual of each weighs in the score."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.1, 0.3)
    score: str = "norm"

    @property
    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return max(1, min(self.tokens, int(self.attention**0.5)))


@dataclass
class Packer:
    """Places blocks of pieces; keeps every sequence with room between blocks."""

    caps: Capacities
    opened: int = 0
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    used: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence number of each piece and its offset there."""
        caps = np.array([self.caps.tokens, self.caps.documents, self.caps.attention], dtype=float)
        weights = np.array(self.caps.weights) / caps**2
        n, m = len(lengths), len(self.number)
        left = np.zeros((3, m + n))
        left[:, :m] = caps[:, None] - self.used.T
        number = np.zeros(m + n, np.int64)
        number[:m] = self.number
        to, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(-lengths, kind="stable")
        for i in order.tolist():
            length = int(lengths[i])
            demand = (length, 1.0, float(length) * length)
            slot = -1
            fits = np.flatnonzero(left[0, :m] >= length)
            if len(fits):
                fits = fits[(left[1, fits] >= 1) & (left[2, fits] >= demand[2])]
                if len(fits):
                    a, b, c = left[:, fits]
                    if self.caps.score == "dot":
                        best = int(np.argmax(a * demand[0] * weights[0] + b * weights[1] + c * demand[2] * weights[2]))
                    else:
                        best = int(np.argmin((a - demand[0]) ** 2 * weights[0] + (b - 1) ** 2 * weights[1] + (c - demand[2]) ** 2 * weights[2]))
                    slot = int(fits[best])
            if slot < 0:
                slot, m = m, m + 1
                left[:, slot] = caps
                number[slot] = self.opened
                self.opened += 1
            to[i], offset[i] = number[slot], int(caps[0] - left[0, slot])
            left[:, slot] -= demand
        room = np.flatnonzero((left[0, :m] > 0) & (left[1, :m] >= 1) & (left[2, :m] >= 1))
        self.number, self.used = number[room], (caps[:, None] - left[:, room]).T
        return to, offset


def pack(
    docs: DataFrame, tokenizer: str, caps: Capacities | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenize every text, append ``end_id``, cut what is too long, and pack.

    Returns a row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. A null
    text counts as empty: one piece with the end id alone. Every input row is a document of
    its own, with a null or repeated id too; an empty table gives no rows; other columns are
    not read. A piece is shorter than a sequence only at its document's end. Sequence ids are
    unique over all tasks and the same when a lost task runs again.
    """
    caps = caps or Capacities()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, by_library=True)
        for batch in pieces(batches, "text", AT_ONCE):
            ids, ends = coder.encode(strings(batch, "text"))
            full = np.insert(ids, ends, end_id).astype("<u4", copy=False)
            sizes = np.diff(ends, prepend=0) + 1
            stops = np.cumsum(sizes)
            count = -(-sizes // caps.longest)
            owner = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * caps.longest
            length = np.minimum(caps.longest, sizes[owner] - start)
            at = stops[owner] - sizes[owner] + start
            crc = np.array([zlib.crc32(full[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())], dtype=np.int64)
            kept = batch.column("id").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([kept, *map(pa.array, (piece.astype(np.int32), start, length, crc))], names=names[:5])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            to, offset = Packer(caps).place(table.column("length").to_numpy())
            whole = table.append_column("sequence_id", pa.array(base + to)).append_column("offset", pa.array(offset))
            yield from whole.to_batches()

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(cut, shape)
    found = materialize(found, "pieces")
    # Dealt round, not by a key: copies and repeated ids spread, and each task gets all lengths.
    dealt = found.repartition(max(1, -(-found.count() // TASK_PIECES)))
    order = [F.desc("length"), *(F.col(f"`{c}`") for c in names[:5])]
    return dealt.sortWithinPartitions(*order).mapInArrow(fill, f"{shape}, sequence_id long, offset long")
