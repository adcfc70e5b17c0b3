"""Chat formatting with repair of illegal role sequences at the least cost.

Legal conversations begin with at most one system turn, then alternate user and assistant and
end with the assistant. A turn may be kept, given another role, or merged into the turn before
it; empty turns may be inserted. Dynamic programming over the automaton of legal turns finds
the cheapest repair, and the repaired sequence is rendered.

The automaton has four states, so what a run of turns can do is a 4 x 4 matrix of costs, and
runs combine by min-plus products. Conversations are sorted over all partitions and cut into
segments of bounded length; segments are reduced to matrices in parallel, and up to ``CHUNK``
matrices of a conversation to their product. The products choose the states between chunks, a
chunk's matrices those between its segments, and the segments are then repaired and rendered in
parallel. So a conversation with a third of all turns is no task's burden: one task holds a
matrix for each 262,144 turns of it.

A role mark inside a turn's text gets a backslash (``<\\|user|>``), a mark with backslashes one
more, so that no text renders as a turn of its own and the text can be restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Turns in a segment at most, segments in a chunk, and turn numbers that are dealt to one partition.
SEGMENT, CHUNK, SPAN = 256, 1024, 4096
_MARK = re.compile(r"<(\\*)\|(?=(?:system|user|assistant)\|>)")
#: Rows of a plan that are sent on at once.
PLANNED = 1000
INF = float("inf")


@dataclass(frozen=True)
class Costs:
    """What each repair costs; an unknown or null role is relabelled for ``unknown``."""

    relabel: float = 2.0
    unknown: float = 1.0
    merge: float = 1.0
    insert: float = 3.0


def _given(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


@lru_cache
def _moves(costs: Costs) -> list[list[tuple[float, list[int]]]]:
    """The cheapest insertions that lead from each state to each other one."""
    table = [[(INF, []) for _ in range(4)] for _ in range(4)]
    for a in range(4):
        table[a][a] = (0.0, [])
        edge = [(a, [])]
        for depth in range(1, 4):
            edge = [(t, path + [t]) for s, path in edge for t in STEPS[s]]
            for t, path in edge:
                if costs.insert * depth < table[a][t][0]:
                    table[a][t] = (costs.insert * depth, path)
    return table


def turn_options(role: str | None, costs: Costs) -> list[list[tuple[float, str, list[int]]]]:
    """For one turn, from each state to each: cost, how (add or merge), roles inserted first."""
    return _options(_given(role), costs)


@lru_cache
def _options(given: int | None, costs: Costs) -> list[list[tuple[float, str, list[int]]]]:
    moves = _moves(costs)
    table = [[(INF, "", []) for _ in range(4)] for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            label = costs.unknown if given is None else costs.relabel * (given != b)
            if a == b:  # into the turn before
                table[a][b] = (label + costs.merge, "merge", [])
            for s in range(4):
                if b in STEPS[s] and (cost := moves[a][s][0] + label) < table[a][b][0]:
                    table[a][b] = (cost, "add", moves[a][s][1])
    return table


def matrix(roles: list[str | None], costs: Costs) -> np.ndarray:
    """The least cost of a run of turns from each state to each."""
    out = np.full((4, 4), INF)
    np.fill_diagonal(out, 0.0)
    known: dict[str | None, np.ndarray] = {}
    for role in roles:
        if role not in known:
            known[role] = np.array([[c for c, _, _ in row] for row in turn_options(role, costs)])
        out = (out[:, :, None] + known[role][None]).min(1)
    return out


def repair(turns: list[tuple[str | None, str | None]], start: int, end: int, costs: Costs) -> list[tuple[int, str]]:
    """The turns (role, text) of the cheapest repair between two states; text '' if inserted.

    A first item with role 0 continues the turn before the run. Of equal repairs the one whose
    last states are smallest wins.
    """
    options = [turn_options(role, costs) for role, _ in turns]
    best = [[INF] * 4 for _ in range(len(turns) + 1)]
    came: list[list[int]] = [[0] * 4 for _ in range(len(turns) + 1)]
    best[0][start] = 0.0
    for i, table in enumerate(options):
        for b in range(4):
            for a in range(4):
                if (cost := best[i][a] + table[a][b][0]) < best[i + 1][b]:
                    best[i + 1][b], came[i + 1][b] = cost, a
    states = [end]
    for i in range(len(turns), 0, -1):
        states.append(came[i][states[-1]])
    states.reverse()
    out: list[tuple[int, str]] = []
    for i, (_, text) in enumerate(turns):
        _, how, inserted = options[i][states[i]][states[i + 1]]
        out += [(r, "") for r in inserted]
        if how == "merge" and out:
            role, before = out[-1]
            out[-1] = (role, "\n".join(x for x in (before, text or "") if x))
        else:
            out.append((0 if how == "merge" else states[i + 1], text or ""))
    return out


def finish(cost: np.ndarray, costs: Costs) -> tuple[int, float, list[int]]:
    """The end state of a conversation, the total cost, and what is inserted to end legally."""
    moves = _moves(costs)
    total = [cost[s] + moves[s][ASSISTANT][0] for s in range(4)]
    state = int(np.argmin(total))
    return state, float(total[state]), moves[state][ASSISTANT][1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The least costs of runs one after another."""
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).min(1)
    return out


def states_between(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """The states before, between and after runs on the cheapest way from one state to another."""
    reach = [np.where(np.arange(4) == start, 0.0, INF)]
    for m in matrices:
        reach.append((reach[-1][:, None] + m).min(0))
    states = [end]
    for i in range(len(matrices) - 1, -1, -1):
        states.append(int(np.argmin(reach[i] + matrices[i][:, states[-1]])))
    return states[::-1]


def choose_states(matrices: list[np.ndarray], costs: Costs) -> tuple[list[int], float, list[int]]:
    """The states before, between and after a conversation's runs; cost; final insertions."""
    state, cost, inserted = finish(product(matrices)[START] if matrices else np.where(np.arange(4) == START, 0.0, INF), costs)
    return states_between(matrices, START, state), cost, inserted


def escaped(text: str) -> str:
    """Text in which no role mark stands as it is."""
    return _MARK.sub(r"<\1\\|", text)


def render(turns: list[tuple[int, str]], first: bool) -> str:
    """Turns as ``<|role|>`` blocks; role 0 continues the block before."""
    out = []
    for i, (role, text) in enumerate(turns):
        text = escaped(text)
        out.append((f"\n{text}" if text else "") if role == 0 else f"{'' if first and i == 0 else chr(10)}<|{ROLES[role - 1]}|>\n{text}")
    return "".join(out)


def format_chats(
    turns: DataFrame, costs: Costs = Costs(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Repair and render every conversation.

    Returns a row per segment: id, segment (from 0), n_turns (read), n_rendered (turns
    rendered), repair_cost (of the whole conversation) and text; a conversation's texts joined
    by nothing in order of segment are its rendering, and all but the longest conversations
    have one segment. Turns are ordered by number, null last, then role and text; repeated
    turns count each; a null text is empty; a null id is one conversation of its own. An empty
    table gives no rows; other columns are not read.
    """
    rows = turns.select(turns[id_col].alias("id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    parts = turns.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.col("id").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    # Only spans of turn numbers are dealt apart, so that a common conversation stays whole; turns
    # without a number are dealt by what orders them.
    span = F.floor(F.col("turn") / SPAN).asc_nulls_last()
    loose = [F.when(F.col("turn").isNull(), c) for c in (F.col("role"), F.substring("text", 1, 64))]
    dealt = rows.repartitionByRange(int(parts), F.col("id").asc(), span, *(c.asc() for c in loose)).sortWithinPartitions(*order)
    item = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kind = turns.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held, owner = TaskContext.get().partitionId() << 32, [], None

        def segment(kind_of: pa.DataType) -> pa.RecordBatch:
            nonlocal place
            place += 1
            cost = matrix([r for r, _ in held], costs)
            columns = [pa.array([owner], kind_of), pa.array([place]), pa.array([[{"role": r, "text": t} for r, t in held]], item), pa.array([cost.ravel().tolist()])]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "place", "turns", "costs"])

        kind_of = None
        for batch in batches:
            kind_of = batch.column("id").type
            for key, role, text in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if held and (key != owner or len(held) >= SEGMENT):
                    yield segment(kind_of)
                owner = key
                held.append((role, text))
        if held:
            yield segment(kind_of)

    segments = materialize(dealt.mapInArrow(cut, f"id {kind}, place long, turns array<struct<role string, text string>>, costs array<double>"), "segments")

    def grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[tuple]:
        """Rows of sorted batches by their first ``keys`` columns, which groups share; the rest as lists."""
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        for key, own in groupby(rows, itemgetter(*range(keys))):
            yield (key, *(list(c) for c in list(zip(*own))[keys:]))

    def sent(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        held_rows: list[tuple] = []
        for row in rows:
            held_rows.append(row)
            if len(held_rows) == PLANNED:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held_rows), kinds)], names=names)
                held_rows.clear()
        if held_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held_rows), kinds)], names=names)

    id_kind = to_arrow_type(turns.schema[id_col].dataType)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (key[0], key[1], len(matrices), product([np.array(m).reshape(4, 4) for m in matrices]).ravel().tolist())
            for key, matrices in grouped(batches, ("id", "chunk", "costs"), 2)
        )
        yield from sent(found, ["id", "chunk", "n", "costs"], [id_kind, pa.int64(), pa.int32(), pa.list_(pa.float64())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, chunks, counts, matrices in grouped(batches, ("id", "chunk", "n", "costs"), 1):
                states, total, inserted = choose_states([np.array(m).reshape(4, 4) for m in matrices], costs)
                first = 0
                for i, (chunk, n) in enumerate(zip(chunks, counts)):
                    yield key, chunk, first, states[i], states[i + 1], total, inserted if i == len(chunks) - 1 else []
                    first += n

        kinds = [id_kind, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
        yield from sent(rows(), ["id", "chunk", "first", "start", "end", "repair_cost", "inserted"], kinds)

    def detail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("id", "chunk", "place", "costs", "first", "start", "end", "repair_cost", "inserted")

        def rows() -> Iterator[tuple]:
            for _, places, matrices, firsts, starts, ends, totals, inserted in grouped(batches, columns, 2):
                states = states_between([np.array(m).reshape(4, 4) for m in matrices], starts[0], ends[0])
                for i, place in enumerate(places):
                    yield place, firsts[0] + i, states[i], states[i + 1], totals[0], inserted[0] if i == len(places) - 1 else []

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
        yield from sent(rows(), ["place", "segment", "a", "b", "repair_cost", "inserted"], kinds)

    # A number of partitions that is given is not lowered when the matrices are small.
    costed = segments.select("id", F.expr(f"place div {CHUNK}").alias("chunk"), "place", "costs")
    chunked = costed.repartition(int(parts), "id", "chunk").sortWithinPartitions("id", "chunk", "place")
    chunks = chunked.mapInArrow(shrink, f"id {kind}, chunk long, n int, costs array<double>")
    by_id = chunks.repartition(int(parts), "id").sortWithinPartitions("id", "chunk")
    planned = materialize(by_id.mapInArrow(plan, f"id {kind}, chunk long, first int, start int, end int, repair_cost double, inserted array<int>"), "plans")
    ends = planned.select(F.col("id").alias("__id"), F.col("chunk").alias("__chunk"), "first", "start", "end", "repair_cost", "inserted")
    met = costed.join(ends, F.col("id").eqNullSafe(F.col("__id")) & (F.col("chunk") == F.col("__chunk"))).drop("__id", "__chunk")
    inner = met.repartition(int(parts), "id", "chunk").sortWithinPartitions("id", "chunk", "place")
    plans = inner.mapInArrow(detail, "place long, segment int, a int, b int, repair_cost double, inserted array<int>")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for row in batch.select(["turns", "a", "b", "segment", "inserted"]).to_pylist():
                fixed = repair([(t["role"], t["text"]) for t in row["turns"]], row["a"], row["b"], costs)
                fixed += [(r, "") for r in row["inserted"]]
                counts.append(sum(r > 0 for r, _ in fixed))
                texts.append(render(fixed, row["segment"] == 0))
            read = pa.array([len(t) for t in batch.column("turns").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("segment"), read, pa.array(counts, pa.int32()), batch.column("repair_cost"), pa.array(texts, pa.string())],
                names=[id_col, "segment", "n_turns", "n_rendered", "repair_cost", "text"],
            )

    return segments.drop("costs").join(plans, "place").mapInArrow(
        write, f"`{id_col}` {kind}, segment int, n_turns int, n_rendered int, repair_cost double, text string"
    )
