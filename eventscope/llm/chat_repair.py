"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is: at most one system turn, then user and assistant turns in
alternation, starting with user and ending with assistant.  Every turn is kept, merged
into the turn before, or relabelled, with empty turns inserted where needed; the repair of
least total cost is found by dynamic programming over the automaton of legal turns.

The cost of a stretch of turns between two states is a small matrix, and matrices of
consecutive stretches combine (min-plus), so a conversation of any length is split: rows
are range-partitioned in turn order, each task summarises its stretches of at most
``STRETCH`` turns, one pass over the summaries of a conversation fixes the state at every
border, and each stretch is traced back on its own.  No conversation is ever gathered.

The result has one row per input turn with the piece of the rendering that it adds:
closing of the turn before, inserted empty turns, header and text, and the end of the
conversation on its last turn.  The pieces of a conversation, concatenated in turn order,
are the rendered conversation.

Defined cases: roles are compared trimmed and lower-cased, any other or NULL role must be
relabelled or merged; a NULL text is empty; NULL conv_id rows form one conversation; NULL
turns come first, equal turns are ordered by role and text; of repairs of equal cost the
one whose actions come first in the order keep, merge, relabel, insert is taken at each
step from the end; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import bound_batches, saved

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: States a role's turn may follow: role -> states; the turn's own state is its index + 1.
LEGAL = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
MERGE_SAME, MERGE_OTHER, RELABEL, INSERT = 1, 4, 3, 5
FAR = 1 << 40
STRETCH = 4096
OTHER = 0      # class of a role that is none of ROLES


def _inserts(a: int, b: int) -> list[int] | None:
    """Fewest empty turns after state a so that a turn b is legal."""
    paths = [(a, [])]
    for _ in range(4):
        for state, path in paths:
            if state in LEGAL[b]:
                return path
        paths = [(x, [*p, x]) for s, p in paths for x in LEGAL if s in LEGAL[x]]
    return None


def _options() -> dict[tuple[int, int, int], tuple[int, str, list[int]]]:
    """(state, class of turn, next state) -> (cost, action, inserted turns), the cheapest."""
    out: dict[tuple[int, int, int], tuple[int, str, list[int]]] = {}
    for state in range(4):
        for kind in range(4):
            choices = []
            if state != START:
                choices.append((state, MERGE_SAME if kind == state else MERGE_OTHER, "merge", []))
            for role in (SYSTEM, USER, ASSISTANT):
                empty = _inserts(state, role)
                if empty is not None:
                    cost = INSERT * len(empty) + (0 if role == kind else RELABEL)
                    choices.append((role, cost, "keep" if role == kind else "relabel", empty))
            for to, cost, action, empty in choices:
                rank = (cost, ("keep", "merge", "relabel").index(action), len(empty))
                old = out.get((state, kind, to))
                if old is None or rank < (old[0], ("keep", "merge", "relabel").index(old[1]), len(old[2])):
                    out[state, kind, to] = (cost, action, empty)
    return out


OPTIONS = _options()
#: STEP[kind]: 4 x 4 costs of one turn between states.
STEP = np.full((4, 4, 4), FAR, np.int64)
for (_s, _k, _t), _o in OPTIONS.items():
    STEP[_k, _s, _t] = _o[0]
#: Cost of ending in each state: empty turns up to a final one.
_END_TURNS = {s: [] if s in FINAL else [*(_inserts(s, ASSISTANT) or []), ASSISTANT] for s in range(4)}
END = np.array([INSERT * len(_END_TURNS[s]) for s in range(4)], np.int64)


def kind_of(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else OTHER


def _summaries(batches: Iterator[pa.RecordBatch], part_bits: int = 33) -> Iterator[pa.RecordBatch]:
    """Number the stretches; the last row of each carries its 16 costs."""
    from pyspark import TaskContext
    stretch, n, key, cost = TaskContext.get().partitionId() << part_bits, 0, None, None
    held = None         # rows of a batch whose last row may close a stretch only later

    def table(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], id_type), pa.array(cols[1], turn_type), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()),
             pa.array(cols[6], pa.list_(pa.int64()))],
            names=["conv_id", "turn", "role", "text", "stretch", "place", "costs"])

    started = False
    id_type = turn_type = None
    for batch in batches:
        id_type, turn_type = batch.schema.field(0).type, batch.schema.field(1).type
        rows = []
        for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if started and (conv != key or n >= STRETCH):
                last = rows[-1] if rows else held
                last[6] = cost.reshape(-1).tolist()
                stretch, n, cost = stretch + 1, 0, None
            started, key = True, conv
            step = STEP[kind_of(role)]
            cost = step if cost is None else np.minimum((cost[:, :, None] + step[None]).min(axis=1), FAR)
            if held is not None:
                yield table([held])
                held = None
            rows.append([conv, turn, role, text, stretch, n, None])
            n += 1
        if rows:
            held = rows.pop()
            if rows:
                yield table(rows)
    if held is not None:
        held[6] = cost.reshape(-1).tolist()
        yield table([held])


def solve(costs: list[np.ndarray]) -> tuple[int, list[int]]:
    """Least total cost of consecutive stretches from START, and the state after each."""
    best, back = np.full(4, FAR, np.int64), []
    best[START] = 0
    for c in costs:
        total = best[:, None] + c
        back.append(total.argmin(axis=0))
        best = np.minimum(total.min(axis=0), FAR)
    state = int((best + END).argmin())
    total, states = int((best + END)[state]), []
    for b in reversed(back):
        states.append(state)
        state = int(b[state])
    return total, states[::-1]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry and exit state of every stretch; input sorted by conversation and stretch."""
    started, key, numbers, costs = False, None, [], []

    def close() -> pa.RecordBatch:
        total, exits = solve([np.array(c, np.int64).reshape(4, 4) for c in costs])
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([START, *exits[:-1]], pa.int32()), pa.array(exits, pa.int32()),
             pa.array([k == n - 1 for k in range(n)]), pa.array([total] * n, pa.int64())],
            names=["stretch", "enter", "leave", "ends", "cost"])

    for batch in batches:
        for conv, number, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if started and conv != key:
                yield close()
                numbers, costs = [], []
            started, key = True, conv
            numbers.append(number)
            costs.append(c)
    if numbers:
        yield close()


def trace(kinds: list[int], enter: int, leave: int) -> list[int]:
    """States after each turn of a stretch on a least-cost way from enter to leave."""
    best, back = np.full(4, FAR, np.int64), []
    best[enter] = 0
    for k in kinds:
        total = best[:, None] + STEP[k]
        back.append(total.argmin(axis=0))
        best = np.minimum(total.min(axis=0), FAR)
    states, state = [], leave
    for b in reversed(back):
        states.append(state)
        state = int(b[state])
    return states[::-1]


def header(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "\n<|end|>\n"


def pieces(roles: list, texts: list, enter: int, leave: int, ends: bool
           ) -> list[tuple[str, str, int, str]]:
    """(action, role, inserted turns, rendered piece) of the turns of a stretch."""
    kinds = [kind_of(r) for r in roles]
    states = trace(kinds, enter, leave)
    out, before = [], enter
    for k, (kind, state, text) in enumerate(zip(kinds, states, texts)):
        _, action, empty = OPTIONS[before, kind, state]
        if action == "merge":
            piece = "\n" + (text or "")
        else:
            piece = (CLOSE if before != START else "") + "".join(header(e) + CLOSE for e in empty)
            piece += header(state) + (text or "")
        added = len(empty)
        if ends and k == len(kinds) - 1:
            piece += CLOSE + "".join(header(e) + CLOSE for e in _END_TURNS[state])
            added += len(_END_TURNS[state])
        out.append((action, ROLES[state - 1], added, piece))
        before = state
    return out


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by stretch and place; a stretch is at most STRETCH turns."""
    rows: list[tuple] = []

    def close() -> pa.RecordBatch:
        _, _, roles, texts, _, enter, leave, ends, cost = zip(*rows)
        action, role, added, piece = zip(*pieces(list(roles), list(texts), enter[0], leave[0], ends[0]))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], turn_type),
             pa.array(action), pa.array(role), pa.array(added, pa.int32()), pa.array(piece, pa.string()),
             pa.array(cost, pa.int64())],
            names=["conv_id", "turn", "action", "role", "inserted", "rendered", "conversation_cost"])

    id_type = turn_type = None
    for batch in batches:
        id_type, turn_type = batch.schema.field(0).type, batch.schema.field(1).type
        for row in zip(*(batch.column(k).to_pylist() for k in range(9))):
            if rows and row[4] != rows[0][4]:
                yield close()
                rows = []
            rows.append(row)
    if rows:
        yield close()


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn, action, role, inserted, rendered and conversation_cost of every row
    of ``turns`` (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    bound_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type, turn_type = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    text = F.col("text").cast("string")
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    numbered = saved(
        turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("text"))
        .repartitionByRange(parts, *order[:4]).sortWithinPartitions(*order)
        .mapInArrow(_summaries, f"conv_id {id_type}, turn {turn_type}, role string, text string, "
                                "stretch long, place long, costs array<long>"), "turns")
    borders = (numbered.where("costs IS NOT NULL").select("conv_id", "stretch", "costs")
               .repartition(parts, "conv_id").sortWithinPartitions("conv_id", "stretch")
               .mapInArrow(_borders, "stretch long, enter int, leave int, ends boolean, cost long"))
    return (numbered.join(borders, "stretch")
            .select("conv_id", "turn", "role", "text", "stretch", "enter", "leave", "ends", "cost", "place")
            .repartition(parts, "stretch").sortWithinPartitions("stretch", "place").drop("place")
            .mapInArrow(_render, f"conv_id {id_type}, turn {turn_type}, action string, role string, "
                                 "inserted int, rendered string, conversation_cost long"))
