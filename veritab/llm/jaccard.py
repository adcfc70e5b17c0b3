"""Exact n-gram Jaccard self-join by a token-group matrix.

Documents are sets of hashed word shingles; two link if their Jaccard similarity reaches the
threshold. Sets are ordered by how often each shingle occurs in the corpus, rarest first, as
told by a counting sketch of fixed size over all documents (any order gives the same links; this
one gives few candidates). Documents that link share a shingle in their *prefixes*, the first
``n - ceil(t * n) + 1`` of each set.

1. Equal sets become one node. Shingles in the prefix of one node only are dropped.
2. Nodes are partitioned into groups of similar sets: each shingle's smallest node is its leader,
   and a node's home is the leader that leads most of its shingles and may link with it. A home's
   nodes are cut into groups of about ``GROUP``, each with the leader as one more member.
3. The first rows of the token-group matrix are those of each group with its own members: the
   union of the group's sets bounds each member's overlap with the others, members whose bound
   does not qualify stay closed, and the rest are compared exactly by a product of their
   incidence matrix. Linked nodes form components.
4. What may still link lies in different components. Nodes are partitioned anew (by component or
   leader, and by size). The token-group matrix has a row for each shingle and group: the group's
   token union. Joined with itself it counts, for every two groups, the shingles their unions
   share, which bounds the overlap of any of their members; only groups whose bound qualifies
   are opened. A shingle of very many groups is joined in blocks, so that no task gets all of it.
5. In two opened groups a product of their incidence matrices counts the shared prefix
   shingles of all members at once, which bounds each pair; the pairs that qualify are compared
   exactly.

Only pairs within a component are never compared, as they change no component. Shingles are
compared as 64-bit hashes: two different shingles of one pair of documents with 10,000 shingles
each are taken for one with a chance of about 10 to the power of -11.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize, pieces, utf8
from .components import components

#: The sketch has 2 ** SKETCH_BITS counters, sent in PARTS; a byte each when it is broadcast.
SKETCH_BITS, PARTS = 22, 64
#: Members of a group, about, and groups of one shingle that are joined in one block.
GROUP, BLOCK = 64, 512
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 1 << 16
#: Ids (8 bytes each) that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Distinct words whose hashes a worker remembers, and bytes of text that it holds as words.
MAX_REMEMBERED, AT_ONCE = 100_000, 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Turns texts into sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known = _Hashes()

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.known) > MAX_REMEMBERED:
            self.known.clear()
        for text in texts:
            # Both work on ASCII alone for bytes: A-Z, and white space 09-0D and 20.
            words = text.lower().split()
            if not words:
                yield np.zeros(0, np.uint64)
                continue
            w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            n = min(self.size, len(w))
            h = np.full(len(w) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ w[k : len(w) - n + 1 + k]) * _PRIME
                h ^= h >> np.uint64(29)
            yield np.unique(_mix(h))


def shingler_of(size: int) -> Shingler:
    """This worker's shingler."""
    return held(f"shingles {size}", lambda: Shingler(size))


def least_overlap(n, percent: int):
    """The least overlap of a set of n shingles with a set that it links to."""
    return -(-n * percent // 100)


def least_overlap_sql(n: str, percent: int):
    return F.ceil(F.col(n) * percent / 100)


def prefix_length(n, percent: int):
    return n - least_overlap(n, percent) + 1


def sketch(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """How common shingles are, by bucket of their hash: a level of 0 to 255, by logarithm.

    Every document is counted. Tasks add up counters of fixed size, which are compressed,
    shuffled in parts and added again; the driver gets one byte for each counter, 4 MB.
    """
    count, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // PARTS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, seen = shingler_of(size), np.zeros(count, np.uint32), False
        for batch in pieces(batches, "text", AT_ONCE):
            found = np.concatenate([*shingler.sets(utf8(batch, "text")), np.zeros(0, np.uint64)])
            if len(found):
                seen = True
                bucket, times = np.unique((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[bucket] += times.astype(np.uint32)
        if seen:
            press = zstandard.ZstdCompressor(level=1)
            for p in range(PARTS):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([press.compress(total[p * part : (p + 1) * part].tobytes())])], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)
                sums[p] = sums[p] + found if p in sums else found.astype(np.uint64)
        for p, total in sums.items():
            level = np.minimum(255, np.floor(8 * np.log2(1.0 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([level.tobytes()])], names=["part", "counts"])

    kind = "part int, counts binary"
    rows = docs.select(docs[text_col].alias("text")).mapInArrow(gather, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect()
    out = np.zeros(count, np.uint8)
    for row in rows:
        out[row["part"] * part : (row["part"] + 1) * part] = np.frombuffer(row["counts"], np.uint8)
    return out


def signatures(docs: DataFrame, levels: np.ndarray, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: id, n_shingles, set_hash (null if empty), prefix, last.

    Prefix shingles are numbers that sort rarest first: the level, then 56 bits of the hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level = shingler_of(size), shared.value
        for batch in pieces(batches, "text", AT_ONCE):
            counts, hashes, prefixes, lasts = [], [], [], []
            for s in shingler.sets(utf8(batch, "text")):
                counts.append(len(s))
                if not len(s):
                    hashes.append(None)
                    prefixes.append(np.zeros(0, np.int64))
                    lasts.append(None)
                    continue
                key = (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                key.sort()
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefixes.append((key[: prefix_length(len(s), percent)] ^ np.uint64(1 << 63)).view(np.int64))  # keeps the order
                lasts.append(int(prefixes[-1][-1]))
            ends = np.cumsum([0, *map(len, prefixes)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), prefix, pa.array(lasts, pa.int64())],
                names=["id", "n", "set_hash", "prefix", "last"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return materialize(rows.mapInArrow(run, "id long, n long, set_hash binary, prefix array<long>, last long"), "signatures")


def sets_of(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """The whole sets (node, shingles) of the documents in ``ids`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(size)
        for batch in pieces(batches, "text", AT_ONCE):
            found = [s.view(np.int64) for s in shingler.sets(utf8(batch, "text"))]
            ends = np.cumsum([0, *map(len, found)])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "shingles"])

    ids = materialize(ids.select("node").distinct(), "ids")
    small = ids.count() <= BROADCAST_IDS
    rows = docs.select(docs[id_col].cast("long").alias("node"), docs[text_col].alias("text"))
    picked = rows.join(F.broadcast(ids) if small else ids, "node")
    return materialize(picked.mapInArrow(run, "node long, shingles array<long>"), "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return met.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def _sizes_fit(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def group_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sorted sets of one group that connect all that its links connect.

    A set that shares too few shingles with the union of the others is closed: it links with none.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[number] > 1
    bound = np.bincount(owner[shared], minlength=len(sets))
    opened = np.flatnonzero(bound >= least_overlap(sizes, percent))
    if len(opened) < 2:
        return []
    row = np.full(len(sets), -1)
    row[opened] = np.arange(len(opened))
    keep = shared & (row[owner] >= 0)
    owner, column = row[owner[keep]], np.cumsum(counts > 1)[number[keep]] - 1
    common = np.zeros((len(opened), len(opened)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        matrix = np.zeros((len(opened), COLUMNS if column[-1] >= COLUMNS else int(column[-1]) + 1), np.float32)
        matrix[owner[a:b], column[a:b] - start] = 1
        common += np.rint(matrix @ matrix.T).astype(np.int64)
    n = sizes[opened]
    linked = 100 * common >= percent * (n[:, None] + n[None] - common)
    root = list(range(len(opened)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(linked, 1)))):
        if (x := top(i)) != (y := top(j)):
            root[y] = x
            out.append((int(opened[i]), int(opened[j])))
    return out


def _open_own(percent: int):
    """The links within groups, from rows (grp, node, shingles) sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                lists = batch.column("shingles")
                values = lists.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                for i, (grp, node) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("node").to_pylist())):
                    yield grp, node, values[ends[i] : ends[i + 1]].copy()

        for _, members in groupby(rows(), itemgetter(0)):
            _, nodes, sets = zip(*members)
            if pairs := group_links(list(sets), percent):
                a, b = zip(*((nodes[i], nodes[j]) for i, j in pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _own_links(docs: DataFrame, near: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links of nodes with others of their home; ``near`` has leader a, node b, led."""
    homes = near.groupBy("b").agg(F.max_by("a", F.struct("led", -F.col("a"))).alias("home")).select(F.col("b").alias("node"), "home")
    homes = materialize(homes, "homes")
    cuts = homes.groupBy("home").agg(F.ceil(F.count("*") / GROUP).alias("cuts"))
    cut = homes.join(cuts, "home").select("node", "home", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("grp"))
    members = materialize(cut.select("grp", "node").union(cut.select("grp", F.col("home").alias("node")).distinct()), "homed")
    whole = sets_of(docs, members, size, id_col, text_col)
    # A set goes once to each of its groups; few pairs of group and node are broadcast.
    members = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(whole, "node").select("grp", "node", "shingles").repartition(parts, "grp").sortWithinPartitions("grp", "node")
    return rows.mapInArrow(_open_own(percent), "a long, b long")


def _open_groups(percent: int):
    """Pairs of members of two groups that may still link, by their shared prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):  # one pair of groups at a time
            a_out, b_out = [], []
            for left, right, same in zip(*(row.column(c).to_pylist() for c in ("x", "y", "same"))):
                sides = []
                number: dict[int, int] = {}
                for members in (left, right):
                    for m in members:
                        for t in m["tokens"]:
                            number.setdefault(t, len(number))
                for members in (left, right):
                    matrix = np.zeros((len(members), len(number)), np.float32)
                    for i, m in enumerate(members):
                        matrix[i, [number[t] for t in m["tokens"]]] = 1
                    columns = [np.array([m[k] for m in members], dtype=np.int64) for k in ("node", "n", "last", "component")]
                    sides.append((matrix, *columns))
                (p, node, n, last, comp), (q, node2, n2, last2, comp2) = sides
                shared = np.rint(p @ q.T).astype(np.int64)
                # All common shingles up to the earlier prefix end are in both prefixes.
                rest = np.where(last[:, None] <= last2[None], (n - prefix_length(n, percent))[:, None], (n2 - prefix_length(n2, percent))[None])
                need = -(-percent * (n[:, None] + n2[None]) // (100 + percent))
                may = (comp[:, None] != comp2[None]) & (shared > 0) & (shared + rest >= need)
                may &= (n[:, None] * 100 >= n2[None] * percent) & (n2[None] * 100 >= n[:, None] * percent)
                i, j = np.nonzero(np.triu(may, 1) if same else may)
                a_out.append(np.minimum(node[i], node2[j]))
                b_out.append(np.maximum(node[i], node2[j]))
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return run


def _residual(shared: DataFrame, found: DataFrame, facts: DataFrame, percent: int) -> DataFrame | None:
    """Pairs of nodes in different components that the token-group matrix lets through.

    ``shared`` has token, node, leader; ``found`` node, component; ``facts`` node, n, last.
    """
    rows = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows, "by-component")
    torn = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = materialize(rows.join(materialize(torn, "torn"), "token"), "torn-rows")
    if rows.isEmpty():
        return None
    # Groups: large components of their own, the other nodes by leader; each by size class.
    members = rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("component", "leader"))).join(facts, "node")
    members = materialize(members, "members")
    large = members.groupBy("component").count().where(F.col("count") >= GROUP).select("component", F.lit(True).alias("large"))
    step = float(np.log(100 / percent)) if percent < 100 else 1e-9
    keyed = members.join(materialize(large, "large"), "component", "left").withColumns(
        {"kind": F.coalesce("large", F.lit(False)), "size_class": F.floor(F.log(F.col("n").cast("double")) / step)}
    )
    keyed = keyed.withColumn("home", F.when(F.col("kind"), F.col("component")).otherwise(F.col("leader")))
    keyed = materialize(keyed, "keyed")
    home = ["kind", "home", "size_class"]
    counts = materialize(keyed.groupBy(*home).agg(F.ceil(F.count("*") / GROUP).alias("cuts")), "cuts")
    grouped = keyed.join(counts, home).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    grouped = materialize(grouped.select("node", "n", "last", "component", F.xxhash64(*home, "cut").alias("grp")), "grouped")
    facts = grouped.groupBy("grp").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("component").alias("c_lo"), F.max("component").alias("c_hi")
    )
    # The matrix: a row for each shingle and group that holds it.
    union = rows.select("token", "node").join(grouped.select("node", "grp"), "node").select("token", "grp").distinct()
    union = materialize(union.join(materialize(facts, "facts"), "grp"), "matrix")
    apart = (F.col("p.c_lo") != F.col("q.c_lo")) | (F.col("p.c_lo") != F.col("p.c_hi")) | (F.col("q.c_lo") != F.col("q.c_hi"))
    fit = (F.col("p.n_hi") * 100 >= F.col("q.n_lo") * percent) & (F.col("q.n_hi") * 100 >= F.col("p.n_lo") * percent)
    facts_of = ("n_lo", "n_hi")

    def meet(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
        one, two = one.alias("p"), two.alias("q")
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(f"p.{k}") == F.col(f"q.{k}"))
        found = one.join(two, same & (F.col("p.grp") <= F.col("q.grp")) & apart & fit)
        return found.select(F.col("p.grp").alias("g"), F.col("q.grp").alias("h"), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pq" for c in facts_of))

    hot = materialize(union.groupBy("token").count().where(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / BLOCK).alias("blocks")), "hot")
    if hot.isEmpty():
        met = meet(union, union, ["token"])
    else:
        # A token of very many groups is joined block by block.
        split = union.join(hot, "token")
        own, every = F.pmod(F.xxhash64("grp"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        rest = union.join(hot, "token", "left_anti")
        met = meet(rest, rest, ["token"]).union(meet(split.select("*", own.alias("i"), every.alias("j")), split.select("*", own.alias("j"), every.alias("i")), ["token", "i", "j"]))
    bound = met.groupBy("g", "h").agg(F.count("*").alias("common"), *(F.first(f"{s}_{c}").alias(f"{s}_{c}") for s in "pq" for c in facts_of))
    top = F.greatest("p_n_hi", "q_n_hi")
    need = F.ceil((F.col("p_n_lo") + F.col("q_n_lo")) * percent / (100 + percent))
    opened = bound.where(F.col("common") + F.ceil(top * percent / 100) - 1 >= need).select("g", "h", (F.col("g") == F.col("h")).alias("same"))
    content = rows.groupBy("node").agg(F.collect_set("token").alias("tokens")).join(grouped, "node")
    content = content.groupBy("grp").agg(F.collect_list(F.struct("node", "n", "last", "component", "tokens")).alias("members"))
    content = materialize(content, "groups")
    opened = materialize(opened, "opened").join(content.select(F.col("grp").alias("g"), F.col("members").alias("x")), "g")
    opened = opened.join(content.select(F.col("grp").alias("h"), F.col("members").alias("y")), "h")
    pairs = opened.select("x", "y", "same").mapInArrow(_open_groups(percent), "a long, b long")
    return materialize(pairs.distinct(), "pairs")


def _link_apart(docs: DataFrame, several: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``link`` where some ids (``several``: id) have different texts: each text gets a number of its own, and an id's texts are one."""
    key, own_id = docs[id_col].cast("long"), "__own_id"
    hashes = [F.xxhash64(docs[text_col]), F.xxhash64(docs[text_col], F.lit(1))]
    rows = docs.select(key.alias("id"), docs[text_col].alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(hashes)))
    texts = materialize(rows.join(several, "id", "left_semi").select("id", "h0", "h1").distinct(), "texts-of-ids")
    top = rows.agg(F.max("id")).first()[0]
    numbers = materialize(texts.withColumn(own_id, F.monotonically_increasing_id() + F.lit(top + 1)), "numbers")
    same = (F.col("r.id") == F.col("t.id")) & (F.col("r.h0") == F.col("t.h0")) & F.col("r.h1").eqNullSafe(F.col("t.h1"))
    numbered = rows.alias("r").join(numbers.alias("t"), same, "left").select(F.coalesce(f"t.{own_id}", "r.id").alias(own_id), "r.text")
    found = materialize(link(numbered, size, percent, own_id, "text"), "by-text")
    back = numbers.select(own_id, "id")
    met = materialize(found.join(back, own_id, "left").withColumn("id", F.coalesce("id", own_id)), "by-id")
    held = met.join(several, "id").select("id", F.col("component_id").alias("b"))
    ties = held.join(held.groupBy("id").agg(F.min("b").alias("a")), "id").select("a", "b").distinct()
    merged = components(ties).select(F.col("node").alias("component_id"), "component")
    met = materialize(met.join(merged, "component_id", "left").withColumn("component", F.coalesce("component", "component_id")), "merged")
    least = met.where("id is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    return met.drop("component_id").join(least, "component", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def link(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents under links of Jaccard similarity ``percent`` / 100 or more.

    Returns a row per input row: id (long), n_shingles, component_id (the smallest id that
    links reach, its own included). Words are what ASCII white space separates, A-Z
    lower-cased; a text with fewer than ``size`` words is one shingle; a null or empty text
    has none and links with nothing. Rows with a null id link with nothing and get a null
    component. Rows that share an id are one document, whatever their texts. An empty table
    gives no rows; other columns are not read.
    """
    levels = sketch(docs, size, text_col)
    found = signatures(docs, levels, size, percent, id_col, text_col)
    full = found.where("set_hash is not null and id is not null")
    several = materialize(full.groupBy("id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).where("a < b").select("id"), "ids-of-several-sets")
    if not several.isEmpty():
        return _link_apart(docs, several, size, percent, id_col, text_col)
    nodes = materialize(full.groupBy("set_hash").agg(F.min("id").alias("node")), "nodes")
    own = materialize(full.select("id", "n", "last", "set_hash").join(nodes, "set_hash").select("id", "node", "n", "last"), "own")
    facts = materialize(own.where("id = node").groupBy("node").agg(F.min("n").alias("n"), F.min("last").alias("last")), "facts")

    # Copies take no part: of equal sets the smallest id stands for all.
    copies = materialize(own.where("id != node").select("id").distinct().join(own.where("id = node").select("id"), "id", "left_anti"), "copies")
    small = copies.count() <= BROADCAST_IDS
    first = full.join(F.broadcast(copies) if small else copies, "id", "left_anti")
    tokens = first.select(F.explode("prefix").alias("token"), F.col("id").alias("node"))
    leaders = tokens.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("hi")).where("leader < hi").select("token", "leader")
    rows = materialize(tokens.join(materialize(leaders, "leaders"), "token"), "led")

    # What a leader leads of a node bounds their overlap.
    led = rows.where("node != leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("led"))
    of = lambda s: facts.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("last").alias(f"last_{s}"))
    rest = F.when(F.col("last_a") <= F.col("last_b"), least_overlap_sql("n_a", percent)).otherwise(least_overlap_sql("n_b", percent)) - 1
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    near = led.join(of("a"), "a").join(of("b"), "b").where(_sizes_fit("n_a", "n_b", percent) & (F.col("led") + rest >= need)).select("a", "b", "led")
    edges = materialize(_own_links(docs, near, size, percent, id_col, text_col), "links")
    parts = materialize(components(edges), "components")

    pairs = _residual(rows, parts, facts, percent)
    if pairs is not None and not pairs.isEmpty():
        whole = sets_of(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), size, id_col, text_col)
        more = materialize(linked(pairs, whole, percent), "more-links")
        if not more.isEmpty():
            parts = materialize(components(edges.union(more)), "components")

    named = found.select("id", "n", "set_hash").join(nodes, "set_hash", "left").select("id", "n", "node")
    return named.join(parts, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document for each component: its smallest id.

    Rows with a null id stay, as they link with nothing; of rows that share a kept id one
    stays, the one with the smallest hash.
    """
    found = link(docs, size, percent, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    gone = materialize(gone, "gone")
    repeated = materialize(docs.groupBy(docs[id_col].cast("long").alias("gone")).count().where("count > 1 and gone is not null").select("gone"), "repeated")
    if not repeated.isEmpty():
        number = "__row_number_of_id"
        from pyspark.sql.window import Window

        order = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
        several = docs.join(repeated, docs[id_col].cast("long") == repeated["gone"], "left_semi")
        several = several.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
        docs = docs.join(repeated, docs[id_col].cast("long") == repeated["gone"], "left_anti").unionByName(several)
    return docs.join(gone, docs[id_col].cast("long") == gone["gone"], "left_anti")
