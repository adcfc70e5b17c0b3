"""Maximum inner product search by score-aware quantisation.

Vectors are cut into subspaces of two dimensions, each coded in four bits. Codebooks and codes
minimise an anisotropic loss: the part of the residual that is parallel to the vector, which
shifts inner products most, costs ``eta`` times as much as the rest. A query's products with
all code words form small tables; scanning a block of codes through them ranks its vectors,
and the best of each block are reranked by exact inner products in double precision.

Codebooks are fitted on a bounded sample, in one task; every vector is coded. Queries meet all
vectors in blocks: blocks of vectors form strips and blocks of queries form groups, both of
bounded bytes. Each strip meets each group once, and only the group's best of the whole strip
are sent on. So the work is that of all queries against all codes, a byte for four components, and
exact products are made for ``RERANK`` vectors of a block alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors that codebooks are fitted on at most.
MAX_SAMPLE = 20_000
WORDS, WIDTH = 16, 2
#: Vectors and queries in a block; candidates of a block that are reranked for each query.
BLOCK, QUERIES, RERANK = 2048, 1024, 120
#: Partitions of blocks in a strip or a group at most, and the bytes of their vectors; strips that
#: there are at least, if there are as many partitions, to spread few vectors.
STRIP, STRIP_BYTES, SPREAD = 32, 64 << 20, 12
#: Different lengths of vectors that are searched, each on its own; more raise an error.
MAX_LENGTHS = 16
#: Inner products above this share of the norm are those whose error counts.
THRESHOLD = 0.2
_STEP, _CODED = 128, 4096  # queries scanned and vectors coded at once


@dataclass
class Codebook:
    """Code words by subspace (subspaces x 16 x 2) and the weight of parallel error."""

    words: np.ndarray
    dimension: int

    @property
    def eta(self) -> float:
        return max(1.0, (self.dimension - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Vectors as n x subspaces x 2, padded with zeros."""
        out = np.zeros((len(x), len(self.words) * WIDTH))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), -1, WIDTH)


def assign(book: Codebook, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n x subspaces) by coordinate descent on the anisotropic loss."""
    parts = book.cut(x)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    words, more = book.words, book.eta - 1
    square = (parts**2).sum(2)[:, :, None] - 2 * np.einsum("nmd,mkd->nmk", parts, words) + (words**2).sum(2)[None]
    along = np.einsum("nmd,nmd->nm", parts, unit)[:, :, None] - np.einsum("nmd,mkd->nmk", unit, words)
    codes = square.argmin(2)
    parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = parallel.sum(1)
    for _ in range(sweeps):
        for m in range(len(words)):
            rest = total - parallel[:, m]
            codes[:, m] = (square[:, m] + more * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            parallel[:, m] = along[np.arange(len(x)), m, codes[:, m]]
            total = rest + parallel[:, m]
    return codes


def fit(x: np.ndarray, rounds: int = 6, seed: int = 5) -> Codebook:
    """Alternate codes and code words; each word solves its two normal equations."""
    n, d = x.shape
    m = -(-d // (2 * WIDTH)) * 2  # an even number of subspaces: two codes fill a byte
    book = Codebook(np.zeros((m, WORDS, WIDTH)), d)
    parts = book.cut(x)
    random = np.random.default_rng(seed)
    book.words = np.stack([parts[random.choice(n, WORDS, replace=n < WORDS), i] for i in range(m)])
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    more = book.eta - 1
    for _ in range(rounds):
        codes = np.concatenate([assign(book, x[i : i + _CODED], 1) for i in range(0, n, _CODED)])
        chosen = book.words[np.arange(m)[None], codes]
        parallel = ((parts - chosen) * unit).sum(2)
        total = parallel.sum(1)
        for i in range(m):
            u, v = unit[:, i], parts[:, i]
            weight = np.eye(WIDTH)[None] + more * u[:, :, None] * u[:, None, :]
            right = np.einsum("nab,nb->na", weight, v) + more * (total - parallel[:, i])[:, None] * u
            for k in range(WORDS):
                mine = codes[:, i] == k
                if mine.any():
                    book.words[i, k] = np.linalg.solve(weight[mine].sum(0) + 1e-9 * np.eye(WIDTH), right[mine].sum(0))
    return book


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in each byte."""
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def scan(book: Codebook, queries: np.ndarray, codes: np.ndarray, keep: int) -> np.ndarray:
    """For each query the ``keep`` best rows of a block by table sums, earlier rows on ties."""
    tables = np.einsum("qmd,mkd->qmk", book.cut(queries), book.words)
    pairs = tables[:, 0::2, None, :] + tables[:, 1::2, :, None]  # high code, low code
    pairs = pairs.reshape(len(queries), -1, WORDS * WORDS)
    scale = (1 << 30) / max(1e-300, np.abs(pairs).max() * pairs.shape[1])
    pairs = np.rint(pairs * scale).astype(np.int64)
    sums = np.zeros((len(queries), len(codes)), np.int64)
    for byte in range(codes.shape[1]):
        sums += np.take(pairs[:, byte], codes[:, byte], axis=1)
    n = len(codes)
    keep = min(keep, n)
    keys = sums * n + np.arange(n - 1, -1, -1)  # all different
    return np.argpartition(keys, n - keep, axis=1)[:, n - keep :]


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and one that is not 0."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _fitted(rows: DataFrame) -> Codebook:
    """A codebook for the vectors of ``rows``, from at most ``MAX_SAMPLE`` of them by hash."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack(b.column("vector").to_numpy(zero_copy_only=False)).astype(float) for b in batches if b.num_rows]
        book = fit(np.concatenate(found))
        yield pa.RecordBatch.from_arrays([pa.array([book.words.astype("<f8").tobytes()]), pa.array([book.dimension], pa.int32())], names=["words", "dimension"])

    sample = rows.select("vector", F.xxhash64("id", "vector").alias("draw")).orderBy("draw").limit(MAX_SAMPLE).select("vector")
    row = sample.coalesce(1).mapInArrow(learn, "words binary, dimension int").first()
    return Codebook(np.frombuffer(row["words"], "<f8").reshape(-1, WORDS, WIDTH), row["dimension"])


def _blocks(rows: DataFrame, count: int, size: int, name: str, book: Codebook | None, kind: str) -> DataFrame:
    """Rows (id, vector) as numbered blocks (block, ids, vectors[, codes]) of ``size`` at most.

    ``kind`` is the numpy type of the components.

    Rows are dealt by a hash of their id over one partition a block; a partition that gets
    more, for one very common id, makes several blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("id").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy().astype(kind).reshape(len(ids), -1)
            for a in range(0, len(ids), size):
                part = vectors[a : a + size]
                row = [pa.array([number]), pa.array([ids[a : a + size].astype("<i8").tobytes()]), pa.array([part.tobytes()])]
                if book is not None:
                    row.append(pa.array([packed(assign(book, part.astype(float))).tobytes()]))
                yield pa.RecordBatch.from_arrays(row, names=names)
                number += 1

    names = ["block", "ids", "vectors"] + ["codes"] * (book is not None)
    schema = "block long, ids binary, vectors binary" + ", codes binary" * (book is not None)
    dealt = rows.repartition(max(1, -(-count // size)), "id").sortWithinPartitions("id", "vector")
    return materialize(dealt.mapInArrow(run, schema), name)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK
) -> DataFrame:
    """The ``k`` rows with the largest inner products for every query row.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the original vectors
    in double precision, nearest first, ties to the smaller id; a query's own id is not
    among them; all other rows if they are fewer than ``k``. Vectors that are null, empty, zero,
    or that hold null or non-finite components take no part, nor do null ids. Vectors of
    different lengths have no inner product: each length is searched on its own, and more than
    ``MAX_LENGTHS`` raise ValueError. A repeated query id counts once, with its smallest vector;
    repeated candidates stay. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(vectors[id_col].isNotNull() & usable(vectors[vector_col]))
    counts = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy("d").limit(MAX_LENGTHS + 1).collect()
    if len(counts) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out: DataFrame | None = None
    for row in counts:
        if row["q"]:
            found = _of_one_length(rows.where(F.size(vector_col) == row["d"]), is_query, row, k, id_col, vector_col, rerank)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _of_one_length(found: DataFrame, is_query: Column, counted: Row, k: int, id_col: str, vector_col: str, rerank: int) -> DataFrame:
    """The search over usable vectors of one length; ``counted`` has their length d, number n, and queries q."""
    single = found.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, width = ("<f4", 4) if single else ("<f8", 8)  # products are made in double precision
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = found.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asked"))
    book = _fitted(rows)
    index = _blocks(rows.select("id", "vector"), counted["n"], BLOCK, "index", book, kind)
    asked = rows.where("asked").groupBy("id").agg(F.min("vector").alias("vector"))
    asks = _blocks(asked, counted["q"], QUERIES, "queries", None, kind)

    def meet(asking: pa.Table, having: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        blocks = [
            (ids := np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], kind).reshape(len(ids), -1), np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1))
            for row in having.select(["ids", "vectors", "codes"]).to_pylist()
        ]
        for row in asking.select(["ids", "vectors"]).to_pylist() if blocks else []:
            own = np.frombuffer(row["ids"], "<i8")
            asked = np.frombuffer(row["vectors"], kind).reshape(len(own), -1).astype(float)
            for a in range(0, len(own), _STEP):
                q, mine = asked[a : a + _STEP], own[a : a + _STEP]
                best, names = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
                for ids, x, codes in blocks:
                    near = np.sort(scan(book, q, codes, rerank + k), axis=1)
                    exact = np.einsum("qrd,qd->qr", x[near].astype(float), q)
                    exact[ids[near] == mine[:, None]] = -np.inf  # the query itself
                    best, names = np.hstack([best, exact]), np.hstack([names, ids[near]])
                    first = np.lexsort((names, -best), axis=1)[:, :k]
                    best, names = np.take_along_axis(best, first, 1), np.take_along_axis(names, first, 1)
                real = np.isfinite(best)
                found.append((np.repeat(mine, real.sum(1)), names[real], best[real]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    held = lambda size: max(1, min(STRIP, STRIP_BYTES // (size * counted["d"] * width)))
    parts, ask_parts = -(-counted["n"] // BLOCK), -(-counted["q"] // QUERIES)
    strips, groups = max(-(-parts // held(BLOCK)), min(parts, SPREAD)), -(-ask_parts // held(QUERIES))

    def dealt(blocks: DataFrame, key: str, count: int, other: str, others: int) -> DataFrame:
        """Blocks by their own strip or group, once for each of the other side."""
        own = F.pmod(F.shiftright("block", 32), F.lit(count)).cast("long").alias(key)
        return blocks.select("*", own, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    left = dealt(asks, "group", groups, "strip", strips).groupBy("group", "strip")
    right = dealt(index, "strip", strips, "group", groups).groupBy("group", "strip")
    met = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
