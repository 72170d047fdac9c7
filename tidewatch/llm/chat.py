"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last by the assistant.
A turn may be merged into the one before it, take another role, or have empty turns put before it, each at a cost; dynamic
programming over the automaton's states (the role written last) finds the cheapest repair, which is then rendered.

Conversations may be of any length, so the rows are sorted over the cluster and a conversation may span partitions. A
partition sums up what it holds of its first and last conversation as a small matrix of costs from state to state; the
driver chains these (two per partition), and each partition then decides its own rows from the right states. The result
doesn't depend on where partitions end. Each source turn gives one row with its piece of the rendered text; the pieces of
a conversation, in the order of turn and place, are the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Costs: merging a turn into the one before, putting in an empty turn, giving another role, giving a role to an unknown one.
MERGE, INSERT, RELABEL, NAME = 2, 3, 5, 1
FAR = 1 << 60
#: Turns that are put in so that a role may follow a state; None where no turns help.
BETWEEN: dict[tuple[int, int], list[int] | None] = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER],
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, SYSTEM): None, (USER, USER): [ASSISTANT], (USER, ASSISTANT): [],
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
#: Turns that are put in at the end.
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def _options(role: int) -> list[list[tuple[int, bool]]]:
    """[state before][role written]: (cost, merged) of a turn of this role (0: unknown); merging wins a tie."""
    table = [[(FAR, False)] * 4 for _ in range(4)]
    for state in range(4):
        for new in (SYSTEM, USER, ASSISTANT):
            named = 0 if role == new else NAME if role == 0 else RELABEL
            ways = [(named + MERGE, True)] if state == new else []
            between = BETWEEN[state, new]
            if between is not None:
                ways.append((named + INSERT * len(between), False))
            if ways:
                table[state][new] = min(ways, key=lambda w: w[0])
    return table


OPTIONS = [_options(role) for role in range(4)]
STEPS = [np.array([[cost for cost, _ in row] for row in table], np.int64) for table in OPTIONS]


def _forward(costs: np.ndarray, roles: list[int]) -> list[np.ndarray]:
    """Costs of each state before every turn and after the last."""
    out = [costs]
    for role in roles:
        out.append(np.minimum((out[-1][:, None] + STEPS[role]).min(axis=0), FAR))
    return out


def _back(ahead: list[np.ndarray], roles: list[int], end: int) -> list[int]:
    """States before every turn and after the last, on the cheapest way to end; the lowest state wins a tie."""
    states = [end]
    for i in range(len(roles) - 1, -1, -1):
        states.append(int((ahead[i] + STEPS[roles[i]][:, states[-1]]).argmin()))
    return states[::-1]


def best_end(costs: np.ndarray) -> int:
    return int((costs + np.array([INSERT * len(CLOSING[s]) for s in range(4)])).argmin())


def _runs(conversations: list, roles: list[int]) -> list[tuple[object, list[int]]]:
    """(conversation, its roles) one after the other."""
    out: list[tuple[object, list[int]]] = []
    for conversation, role in zip(conversations, roles, strict=True):
        if not out or out[-1][0] != conversation:
            out.append((conversation, []))
        out[-1][1].append(role)
    return out


def _held(batches: Iterator[pa.RecordBatch]) -> list[tuple[object, list[int]]]:
    conversations, roles = [], []
    for batch in batches:
        conversations += batch.column("conv").to_pylist()
        roles += batch.column("code").to_pylist()
    return _runs(conversations, roles)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, last, conv, matrix) of the first and the last conversation of a partition."""
    runs = _held(batches)
    rows = []
    for last, (conversation, roles) in [(False, runs[0]), (True, runs[-1])][: len(runs)] if runs else []:
        matrix = np.where(np.eye(4, dtype=bool), 0, FAR)
        rows.append((last, conversation, np.stack([_forward(m, roles)[-1] for m in matrix]).tobytes()))
    part = TaskContext.get().partitionId()
    columns = list(zip(*rows, strict=True)) or [()] * 3
    yield pa.record_batch([pa.array([part] * len(rows), pa.int32()), pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["part", "last", "conv", "matrix"])


def _ways(batches: Iterator[pa.RecordBatch], entering: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(part, last, starts): the state before the first turn for each state after the last one, of the outer conversations."""
    part, runs = TaskContext.get().partitionId(), _held(batches)
    rows = []
    for last, (_, roles) in [(False, runs[0]), (True, runs[-1])][: len(runs)] if runs else []:
        ahead = _forward(_entry(entering, part, last), roles)
        rows.append((part, last, [_back(ahead, roles, end)[0] for end in range(4)]))
    columns = list(zip(*rows, strict=True)) or [()] * 3
    yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.list_(pa.int32()))], ["part", "last", "starts"])


BEGIN = np.array([0, FAR, FAR, FAR], np.int64)


def _entry(entering: dict[int, np.ndarray], part: int, last: bool) -> np.ndarray:
    """Costs ahead of the first (or, of several, last) conversation of a partition."""
    return BEGIN if last else entering.get(part, BEGIN)


def render_turns(roles: list[int], template: str, end: str) -> str:
    return "".join(template.format(role=NAMES[r]) + end for r in roles)


def _decided(batches: Iterator[pa.RecordBatch], plan: object, template: str, end: str) -> Iterator[pa.RecordBatch]:
    entering, leaving, begun, open_end = plan.value
    part = TaskContext.get().partitionId()
    held = list(batches)
    runs = _held(held)
    before: list[int] = []
    after: list[int] = []
    final: list[bool] = []
    for i, (_, roles) in enumerate(runs):
        ahead = _forward(entering.get(part, BEGIN) if i == 0 else BEGIN, roles)
        goes_on = i == len(runs) - 1 and part in open_end
        states = _back(ahead, roles, leaving[part] if goes_on else best_end(ahead[-1]))
        before += states[:-1]
        after += states[1:]
        final += [False] * (len(roles) - 1) + [not goes_on]
    row, first = 0, part in begun
    opened = None
    for batch in held:
        out: dict[str, list] = {"place": [], "new_role": [], "action": [], "inserted": [], "piece": []}
        for conversation, role, text in zip(batch.column("conv").to_pylist(), batch.column("code").to_pylist(), batch.column("text").to_pylist(), strict=True):
            new_conversation = opened is None or opened[0] != conversation
            starts = new_conversation and not (opened is None and first)
            opened = (conversation,)
            state, new, text = before[row], after[row], text or ""
            merged = OPTIONS[role][state][new][1]
            between = [] if merged else BETWEEN[state, new] or []
            closing = CLOSING[new] if final[row] else []
            piece = f"\n{text}" if merged else ("" if starts else end) + render_turns(between, template, end) + template.format(role=NAMES[new]) + text
            piece += (end + render_turns(closing, template, end)) if final[row] else ""
            out["place"].append((part << 40) + row)
            out["new_role"].append(NAMES[new])
            out["action"].append(("merge" if merged else "open") if role == new else ("relabel and merge" if merged else "relabel"))
            out["inserted"].append([NAMES[r] for r in between] + [f"{NAMES[r]} (closing)" for r in closing])
            out["piece"].append(piece)
            row += 1
        names = ["conv", "turn", "role"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        yield pa.record_batch([*(batch.column(n) for n in names), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], [*names, *out])


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: str = "<|{role}|>\n", end: str = "<|end|>\n",
) -> DataFrame:
    """(conv, turn, role, place, new_role, action, inserted, piece) per row of turns.

    Rows are taken in the order of conversation, turn, role and text; place numbers them. A null, empty or unknown role is
    given one at a small cost; roles count without regard to case and outer blanks. Null and empty texts stay as empty
    turns. A null conversation is a conversation of its own; null turns come first. Repeated rows are turns of their own.
    inserted: roles of the empty turns put before the turn, and of those after it where it is the last.
    """
    spark = turns.sparkSession
    name = F.lower(F.trim(F.col(role_col).cast("string")))
    code = F.coalesce(*(F.when(name == n, F.lit(c)) for n, c in ROLES.items()), F.lit(0))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), code.alias("code"))
    # Equal turns of a conversation are told apart by a hash as well, so that one turn number repeated often is spread.
    spread = F.xxhash64("role", "text")
    rows = rows.withColumn("spread", spread)
    ordered = settle(rows.repartitionByRange("conv", "turn", "role", "spread").sortWithinPartitions("conv", "turn", "role", "spread", "text").drop("spread"))
    light = ordered.select("conv", "code")
    summaries = sorted(light.mapInArrow(_summaries, "part int, last boolean, conv long, matrix binary").collect(), key=lambda r: (r.part, r.last))
    parts = sorted({r.part for r in summaries})
    by_part = {p: [r for r in summaries if r.part == p] for p in parts}
    entering: dict[int, np.ndarray] = {}
    begun: set[int] = set()
    open_end: set[int] = set()
    costs, previous = BEGIN, None
    for p in parts:
        own = by_part[p]
        if previous is not None and by_part[previous][-1].conv == own[0].conv:
            entering[p] = costs
            begun.add(p)
            open_end.add(previous)
        start = _entry(entering, p, len(own) > 1)
        matrix = np.frombuffer(bytes(own[-1].matrix), np.int64).reshape(4, 4)
        costs = np.minimum((start[:, None] + matrix).min(axis=0), FAR)
        previous = p
    ways = {(r.part, r.last): r.starts for r in light.mapInArrow(lambda it: _ways(it, entering), "part int, last boolean, starts array<int>").collect()}
    leaving: dict[int, int] = {}
    for i in range(len(parts) - 1, 0, -1):
        p, q = parts[i - 1], parts[i]
        if p not in open_end:
            continue
        matrix = np.frombuffer(bytes(by_part[q][0].matrix), np.int64).reshape(4, 4)
        only = len(by_part[q]) == 1
        state = leaving[q] if only and q in open_end else best_end(np.minimum((entering[q][:, None] + matrix).min(axis=0), FAR))
        leaving[p] = ways[q, False][state]
    plan = spark.sparkContext.broadcast((entering, leaving, begun, open_end))
    schema = "conv long, turn long, role string, place long, new_role string, action string, inserted array<string>, piece string"
    return ordered.mapInArrow(lambda it: _decided(it, plan, template, end), schema)
