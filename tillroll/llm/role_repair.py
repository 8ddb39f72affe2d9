"""Chat formatting by minimum-cost role repair: dynamic programming over an automaton of legal turns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage, ship_package

ROLES = ("system", "user", "assistant")
#: What a repair costs: joining a message to the turn before it, another role, a role for an unknown one, an empty turn.
MERGE, RELABEL, NAME, INSERT = 1, 2, 1, 3
#: States are "nothing yet" and the role of the open turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40


def _links() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """[state][state after]: least cost to open or join a turn of that role, and the empty turns put before it.

    Legal: perhaps one system turn, then user and assistant in turns.
    """
    cost = [[_FAR] * 4 for _ in range(4)]
    before: list[list[tuple[int, ...]]] = [[()] * 4 for _ in range(4)]
    for s, t in ((START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
        cost[s][t] = 0
    for t in (SYSTEM, USER, ASSISTANT):
        cost[t][t] = MERGE
    for s in (START, SYSTEM):
        cost[s][ASSISTANT], before[s][ASSISTANT] = INSERT, (USER,)
    return cost, before


LINK, BEFORE = _links()
#: Least cost to end in a state (the last turn is the assistant's), and the empty turns put there.
END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
AFTER = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role) -> int:
    """State of a role's name, 0 when it is unknown."""
    name = str(role).strip().lower() if role is not None else ""
    return 1 + ROLES.index(name) if name in ROLES else 0


def name_cost(role: int, state: int) -> int:
    return 0 if role == state else NAME if role == 0 else RELABEL


def step(best: list[int], role: int) -> tuple[list[int], list[int]]:
    """Least costs after one more message, and the states they come from (ties: the first state)."""
    out, back = [_FAR] * 4, [0] * 4
    for t in (SYSTEM, USER, ASSISTANT):
        costs = [best[s] + LINK[s][t] for s in range(4)]
        s = min(range(4), key=costs.__getitem__)
        out[t], back[t] = min(_FAR, costs[s] + name_cost(role, t)), s
    return out, back


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost of a run of messages from each state to each state."""
    rows = []
    for s in range(4):
        best = [_FAR] * 4
        best[s] = 0
        for r in roles:
            best, _ = step(best, r)
        rows.append(best)
    return rows


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[list[int], int]:
    """(state after each message, cost) of the cheapest repair from ``entry``; ``leave`` fixes the last state."""
    best = [_FAR] * 4
    best[entry] = 0
    backs = []
    for r in roles:
        best, back = step(best, r)
        backs.append(back)
    if leave is None:
        total = [best[s] + END[s] for s in range(4)]
        leave = min(range(4), key=total.__getitem__)
        cost = total[leave]
    else:
        cost = best[leave]
    path = [leave]
    for back in reversed(backs[1:]):
        path.append(back[path[-1]])
    return path[::-1] if roles else [], cost


def plan(fragments: list[tuple[int, list[list[int]]]]) -> dict[int, tuple[int, int]]:
    """Entry and exit state of each fragment (part, matrix) of one conversation, in order."""
    best = [0, _FAR, _FAR, _FAR]
    backs = []
    for _, m in fragments:
        costs = [[best[s] + m[s][t] for s in range(4)] for t in range(4)]
        back = [min(range(4), key=c.__getitem__) for c in costs]
        best = [min(_FAR, c[b]) for c, b in zip(costs, back, strict=True)]
        backs.append(back)
    leave = min(range(4), key=lambda s: best[s] + END[s])
    out = {}
    for (part, _), back in zip(reversed(fragments), reversed(backs), strict=True):
        out[part] = (back[leave], leave)
        leave = back[leave]
    return out


def _ordered(chats: DataFrame) -> DataFrame:
    """Messages range-partitioned and sorted by conversation and turn, each with its part and place; written once.

    A conversation of any size is spread over as many parts as its rows fill.
    """
    ship_package(chats.sparkSession)
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text"))

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns],
                names=["part", "at", *batch.schema.names])
            at += n

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    return cut_lineage(ordered.mapInArrow(
        number, "part int, at long, conv_id long, turn long, role string, text string"))


def _runs(frame: pd.DataFrame):
    """(conversation, first row, end row) of the conversations of a part in order; null ids are one conversation each."""
    ids = frame["conv_id"]
    null = ids.isna().to_numpy()
    values = ids.fillna(0).to_numpy().astype(np.int64)
    head = np.ones(len(frame), dtype=bool)
    head[1:] = (values[1:] != values[:-1]) | null[1:] | null[:-1]
    first = np.flatnonzero(head)
    return [(None if null[a] else int(values[a]), a, b)
            for a, b in zip(first.tolist(), np.append(first[1:], len(frame)).tolist(), strict=True)]


def repair_conversations(chats: DataFrame) -> DataFrame:
    """One row per message: conv_id, seq, turn, role, new_role, action, inserted_before, inserted_after, rendered.

    The cheapest sequence of merges, relabels and empty turns that makes a
    conversation legal is found by dynamic programming. ``rendered`` is the
    message's piece of the repaired conversation, which is the pieces in order
    of ``seq``: empty turns put before it, a header where it opens a turn, its
    text, and the empty turns that end the conversation. A text's own ``<|`` is
    written ``<\\|``, so no text can forge a header.

    Costs compose: a run of messages is a 4 x 4 matrix of least costs. The
    messages are range-partitioned by conversation and turn, so one with a
    third of all rows is spread over many tasks; only the first and the last
    run of each part can go on elsewhere, and their matrices (two rows a part)
    are combined on the driver into the states at the parts' borders.

    Defined cases: null or unknown roles are named at a cost; null texts are
    empty; a null conv_id makes each message its own conversation; a null turn
    comes first; equal turns are ordered by role and text, repeated rows are
    messages each; an empty table gives an empty result; extra columns are
    ignored.
    """
    spark = chats.sparkSession
    table = _ordered(chats)

    def borders(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable").reset_index(drop=True)
        runs = _runs(frame)
        out = []
        for i in sorted({0, len(runs) - 1}):
            conv, a, b = runs[i]
            if conv is not None:
                m = matrix([role_number(r) for r in frame["role"].iloc[a:b]])
                out.append((frame["part"].iloc[0], conv, b - a, i == 0, i == len(runs) - 1, sum(m, [])))
        return pd.DataFrame(out, columns=["part", "conv_id", "n", "first", "last", "m"])

    edge = (table.select("part", "at", "conv_id", "role").groupBy("part")
            .applyInPandas(borders, "part int, conv_id long, n long, first boolean, last boolean, m array<long>")
            .collect())  # at most two rows a part
    by_conv: dict[int, list] = {}
    for r in sorted(edge, key=lambda r: (r.conv_id, r.part)):
        by_conv.setdefault(r.conv_id, []).append(r)
    known: dict[tuple[int, int], tuple[int, int, int, bool]] = {}  # (part, conversation): entry, exit, rows before, ends
    for conv, rows in by_conv.items():
        if len(rows) > 1:
            states = plan([(r.part, [list(r.m[4 * s:4 * s + 4]) for s in range(4)]) for r in rows])
            before = 0
            for i, r in enumerate(rows):
                known[(r.part, conv)] = (*states[r.part], before, i == len(rows) - 1)
                before += r.n
    held = spark.sparkContext.broadcast(known)
    names = ("", *ROLES)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable").reset_index(drop=True)
        part = int(frame["part"].iloc[0]) if len(frame) else 0
        roles, texts = frame["role"].tolist(), frame["text"].tolist()
        seq, new_role, action, before_, after_, rendered = [], [], [], [], [], []
        for conv, a, b in _runs(frame):
            numbers = [role_number(r) for r in roles[a:b]]
            entry, leave, done, ends = held.value.get((part, conv), (START, None, 0, True))
            path, _ = repair(numbers, entry, leave)
            state = entry
            for i, (r, t) in enumerate(zip(numbers, path, strict=True)):
                joined = state == t
                empties = BEFORE[state][t]
                tail = AFTER[t] if ends and i == len(path) - 1 else ()
                kind = [k for k, on in (("relabel", r != t), ("merge", joined)) if on] or ["keep"]
                piece = "".join(f"<|{names[e]}|>\n\n" for e in empties)
                piece += ("" if joined else f"<|{names[t]}|>\n") + texts[a + i].replace("<|", "<\\|") + "\n"
                piece += "".join(f"<|{names[e]}|>\n\n" for e in tail)
                seq.append(done + i)
                new_role.append(names[t])
                action.append("+".join(kind))
                before_.append(",".join(names[e] for e in empties))
                after_.append(",".join(names[e] for e in tail))
                rendered.append(piece)
                state = t
        return pd.DataFrame({"conv_id": frame["conv_id"], "seq": seq, "turn": frame["turn"], "role": frame["role"],
                             "new_role": new_role, "action": action, "inserted_before": before_,
                             "inserted_after": after_, "rendered": rendered})

    return table.groupBy("part").applyInPandas(
        write, "conv_id long, seq long, turn long, role string, new_role string, action string, "
               "inserted_before string, inserted_after string, rendered string")
