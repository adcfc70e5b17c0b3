"""Merkle manifest of a dataset: a root, and for every row the siblings that prove it.

Rows are leaves in the order of a key within a group; runs of ``fanout`` consecutive nodes
become their parent, the digest of their hex texts joined, until one is left: the group's
root. The group roots, by group, make a tree of the same kind. A superblock of fanout ** k
consecutive nodes collapses k levels at once, so a tree of n rows takes log(n) / (k log(fanout))
rounds, each a shuffle of what the last left. On the way down every superblock gets the proof
of its root and puts it behind the proofs within it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Nodes in a run, and levels that a superblock collapses: 729 leaves.
FANOUT, LEVELS = 3, 6
_ROW_BITS = 33  # as monotonically_increasing_id numbers rows


def field(value: Column) -> Column:
    """A value as the leaves hold it: `-` for null, else its UTF-8 byte count, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row: lowercase hex sha256 of its fields, joined."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(digest: Column, lefts: Column, rights: Column) -> Column:
    """The root that ``digest`` leads to by a proof: at each level its siblings stand to the left and right."""
    steps = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(steps, digest, lambda at, step: F.sha2(F.concat(step["l"], at, step["r"]), 256))


def proof_text(lefts: Column, rights: Column) -> Column:
    """All siblings of a proof, from the leaf to the root, left to right, as one text."""
    return F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda step: F.concat(step["l"], step["r"])), "")


def _levels(n: int, fanout: int, most: int) -> int:
    """Levels between n nodes and one, at most ``most``."""
    found = 0
    while n > 1 and found < most:
        n, found = -(-n // fanout), found + 1
    return found


def _grow(nodes: list[str], levels: int, fanout: int) -> Iterator[list[str]]:
    """The nodes of each level of a superblock, the lowest first."""
    yield nodes
    for _ in range(levels):
        nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
        yield nodes


def _paths(nodes: list[str], levels: int, fanout: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each node of a superblock its siblings to the left and right, a text for each level."""
    grown = list(_grow(nodes, levels, fanout))[:levels]
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    for i in range(len(nodes)):
        at = i
        for level in grown:
            run = at - at % fanout
            lefts[i].append("".join(level[run:at]))
            rights[i].append("".join(level[at + 1 : run + fanout]))
            at //= fanout
    return lefts, rights


def in_order(rows: DataFrame, group: Column, order: list[Column], block: int, name: str) -> DataFrame:
    """Number rows within their group, from 0, in the order given: adds grp, idx, n and slot.

    ``grp`` is the group as text, before which null sorts. Rows are cut into ranges of group
    and order, ranges are counted, and the counts are added up, so a group may have rows of any
    number and no task sorts it whole; rows that tie in all of ``order`` should be alike. Small
    groups that begin in the same stretch of ``block`` rows share a slot. ``rows`` are to be
    read from files, so that they come again in the same order.
    """
    keyed = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")))
    keys = [F.col("grp"), *order, F.col("_row")]
    placed = keyed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.drop("_row").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counted = placed.groupBy("grp", "_part").agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        "grp", "_part", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(whole).alias("n"),
        F.floor(F.min("_first").over(whole) / block).alias("slot"),
    )
    found = placed.join(starts, ["grp", "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
    return found.drop("_part", "_at", "_before", "_first")


_NODE = "slot long, grp string, idx long, n long, digest string"


def _collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Collapse every superblock of ``nodes`` to its root: a node of the next round."""
    block = fanout**levels

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for grp, part in rows.sort_values(["grp", "idx"]).groupby("grp", sort=False):
            n = int(part["n"].iloc[0])
            for top in _grow(part["digest"].tolist(), _levels(n, fanout, levels), fanout):
                pass
            found.append((int(part["slot"].iloc[0]), grp, int(part["idx"].iloc[0]) // block, -(-n // block), top[0]))
        return pd.DataFrame(found, columns=["slot", "grp", "idx", "n", "digest"])

    bucketed = nodes.select("slot", "grp", "idx", "n", "digest", F.expr(f"idx div {block}").alias("bucket"))
    return bucketed.groupBy("slot", "bucket").applyInPandas(reduce, _NODE)


_PROOF = "slot long, grp string, idx long, subroot string, root string, lefts array<string>, rights array<string>"
_TEXTS = pa.list_(pa.string())


def _descend(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, keep: list[str]) -> DataFrame:
    """Give the nodes of a round their proofs: within the superblock, then that of its root in ``above``."""
    names = ["slot", "grp", "idx", "subroot", "root", "lefts", "rights", *keep]

    def down(rows: pa.Table, tops: pa.Table) -> pa.Table:
        rows = rows.sort_by([("grp", "ascending"), ("idx", "ascending")])
        upper = {t["grp"]: t for t in tops.to_pylist()}
        digests, counts = rows.column("digest").to_pylist(), rows.column("n").to_pylist()
        subroots, roots, lefts, rights = [], [], [], []
        for grp, part in groupby(range(rows.num_rows), rows.column("grp").to_pylist().__getitem__):
            members, top = list(part), upper[grp]
            own = [digests[i] for i in members]
            before, after = _paths(own, _levels(counts[members[0]], fanout, levels), fanout)
            subroots += [top["subroot"]] * len(own)
            roots += [top["root"]] * len(own)
            lefts += [x + top["lefts"] for x in before]
            rights += [x + top["rights"] for x in after]
        made = [pa.array(subroots, pa.string()), pa.array(roots, pa.string()), pa.array(lefts, _TEXTS), pa.array(rights, _TEXTS)]
        return pa.table([*(rows.column(c) for c in names[:3]), *made, *(rows.column(c) for c in keep)], names=names)

    kinds = "".join(f", `{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep)
    below = nodes.select(*dict.fromkeys(["slot", "grp", "idx", "n", "digest", *keep]), F.expr(f"idx div {fanout**levels}").alias("bucket"))
    tops = above.withColumn("bucket", F.col("idx"))
    return below.groupBy("slot", "bucket").cogroup(tops.groupBy("slot", "bucket")).applyInArrow(down, _PROOF + kinds)


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes of each round: what is given, and superblock roots until each group has one."""
    found = [nodes]
    while not found[-1].where("n > 1").isEmpty():
        found.append(materialize(_collapse(found[-1], fanout, levels), "superblocks"))
    return found


def _proofs(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int, keep: list[str]) -> DataFrame:
    """Proofs of the nodes of the first round, from those of the groups' roots (``tops``, idx 0)."""
    for nodes in rounds[-2:0:-1]:
        tops = materialize(_descend(nodes, tops, fanout, levels, []), "proofs")
    return _descend(rounds[0], tops, fanout, levels, keep)


def prove(
    leaves: DataFrame, group: str, order: list[str], digest: str, keep: list[str], fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """A row for each leaf with its proof: ``keep``, digest, subroot, root, lefts, rights.

    ``leaves`` are rows read from files, with a hex ``digest`` each. Within a ``group`` they
    ascend by ``order``, then by digest (nulls first); groups ascend, null first, bytewise.
    Proofs have an entry for each level: the joined digests of the siblings to the left, and
    those to the right. A group of one leaf has it as its subroot. Rows that repeat are leaves of their
    own, side by side. An empty table gives no rows. A task holds a superblock, or small groups
    that fill one or two; neither a large group nor very many small ones meet anywhere.
    """
    block = fanout**levels
    flat = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    read = leaves.select(F.col(digest).alias("digest"), F.col(group).alias("_group"), F.struct(*order).alias("_order"), *flat)
    kept = in_order(read, F.col("_group"), [F.col("_order"), F.col("digest")], block, "leaves-in-order").drop("_group", "_order")
    below = _rounds(materialize(kept, "leaves"), fanout, levels)
    subroots = materialize(below[-1].select("digest", F.col("grp").alias("_subgroup"), F.col("slot").alias("_subslot")), "subroots")
    numbered = in_order(subroots, F.lit(None), [F.col("_subgroup")], block, "subroots-in-order")
    above = _rounds(materialize(numbered, "subroots-numbered"), fanout, levels)
    none = F.array().cast("array<string>")
    top = above[-1].select("slot", "grp", "idx", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("lefts"), none.alias("rights"))
    over = _proofs(above, materialize(top, "root"), fanout, levels, ["digest", "_subgroup", "_subslot"])
    tops = over.select(F.col("_subslot").alias("slot"), F.col("_subgroup").alias("grp"), F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "root", "lefts", "rights")
    found = _proofs(below, materialize(tops, "group-proofs"), fanout, levels, ["digest", *(f"_keep{i}" for i in range(len(keep)))])
    return found.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), F.col("digest").alias(digest), "subroot", "root", "lefts", "rights")
