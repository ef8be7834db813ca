"""Chat formatting: minimum-cost repair of turn roles, and rendering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import stage

# States of the legal-turn automaton: nothing yet, then the role of the open turn. A dialogue is an optional system
# turn, then user and assistant in turn, and ends with the assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
NEXT = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Spellings of roles in public chat data.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Costs:
    """Prices of the repairs. A turn of unknown role pays `name` for the role it gets instead of `relabel`."""

    merge: int = 2
    relabel: int = 5
    name: int = 1
    insert: int = 4


@dataclass(frozen=True)
class Step:
    cost: int
    action: str = "keep"
    inserted: tuple[int, ...] = field(default=())


def role_of(role: str | None) -> int:
    """0 for an unknown role."""
    name = (role or "").strip().lower()
    return ROLES.get(ALIASES.get(name, name), NOTHING)


def insertions(state: int, costs: Costs) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Cheapest runs of empty turns from a state, by the state they end in."""
    best, todo = {state: (0, ())}, [state]
    while todo:
        s = todo.pop(0)
        for r in NEXT[s]:
            if r not in best:
                best[r] = (best[s][0] + costs.insert, (*best[s][1], r))
                todo.append(r)
    return best


def steps(costs: Costs) -> list[list[list[Step | None]]]:
    """steps[given role][state before][state after]: the cheapest way to take one turn. Of equal prices: keep, merge, relabel, then insertions."""
    out: list[list[list[Step | None]]] = [[[None] * 4 for _ in range(4)] for _ in range(4)]
    for given in range(4):
        for before in range(4):
            for middle, (price, empty) in insertions(before, costs).items():
                for after in NEXT[middle]:
                    change = 0 if given == after else costs.relabel if given else costs.name
                    action = "keep" if given == after else "relabel"
                    _offer(out[given][before], after, Step(price + change, action, empty))
            if before != NOTHING:
                change = 0 if given == before else costs.relabel if given else costs.name
                _offer(out[given][before], before, Step(costs.merge + change, "merge"))
    return out


ORDER = ("keep", "merge", "relabel")


def _offer(row: list[Step | None], after: int, step: Step) -> None:
    key = lambda s: (s.cost, len(s.inserted), ORDER.index(s.action))
    if row[after] is None or key(step) < key(row[after]):
        row[after] = step


class Repair:
    def __init__(self, costs: Costs):
        self.steps = steps(costs)
        self.price = np.array([[[s.cost if s else 1 << 40 for s in row] for row in table] for table in self.steps], np.int64)
        self.closing = [insertions(s, costs).get(ASSISTANT, (0, ())) for s in range(4)]
        self.end = np.array([c for c, _ in self.closing], np.int64)

    def product(self, given: list[int]) -> np.ndarray:
        """Cheapest price from each state before a run of turns to each state after it."""
        total = np.where(np.eye(4, dtype=bool), 0, 1 << 40)
        for g in given:
            total = np.minimum((total[:, :, None] + self.price[g][None]).min(1), 1 << 40)
        return total

    def path(self, given: list[int], first: int, last: int) -> list[tuple[int, Step]]:
        """State after each turn, and the step, on a cheapest way from `first` to `last` (the smallest state of equal ones)."""
        total, back = np.full(4, 1 << 40, np.int64), []
        total[first] = 0
        for g in given:
            ways = total[:, None] + self.price[g]
            back.append(ways.argmin(0))
            total = np.minimum(ways.min(0), 1 << 40)
        states = [last]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        return [(after, self.steps[g][before][after]) for g, before, after in zip(given, states, states[1:], strict=False)]

    def borders(self, products: list[np.ndarray]) -> list[int]:
        """States at the borders of consecutive runs of one conversation, first and last included."""
        total, back = np.full(4, 1 << 40, np.int64), []
        total[NOTHING] = 0
        for m in products:
            ways = total[:, None] + m
            back.append(ways.argmin(0))
            total = np.minimum(ways.min(0), 1 << 40)
        states = [int((total + self.end).argmin())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def _safe(text: str | None) -> str:
    return (text or "").replace("<|im_", "< |im_")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of one conversation and part, in order."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def repair_roles(turns: DataFrame, costs: Costs = Costs(), rows_per_part: int = 20_000, most_parts: int = 100_000, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: (conv_id, turn, role, new_role, action, inserted, rendered), repaired at the least total cost.

    A turn is kept, merged into the turn before it, or relabelled, and empty turns may be inserted before it; the roles then
    run through the legal-turn automaton. `rendered` is the turn's stretch of the conversation, so the stretches of a
    conversation in order of turn are its text. Empty turns missing at the end are rendered with the last row.

    Turns are sorted over the cluster by conversation and turn and dealt in parts of about `rows_per_part`, or of more where that
    would make more than `most_parts`, which bounds the tables of prices the driver holds: one or two a part. A conversation
    within one part is solved there; one that spans parts is summed up by one 4 x 4 table of prices a part, which
    give the states at the borders, and each part then solves its own stretch: so no conversation is collected.

    Roles are read without case and blanks; unknown and null roles are free to take any. Null text is empty. Rows
    with a null conversation form one; null turns come first; rows of one turn follow in the order of a hash of them, then by role and text. Extra columns are ignored.
    """
    types = {n: turns.schema[c].dataType.simpleString() for n, c in (("conv_id", conv_col), ("turn", turn_col))}
    turns = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    parts = max(1, min(most_parts, -(-turns.count() // rows_per_part)))
    salt = F.pmod(F.xxhash64(*order), F.lit(1024))  # rows repeating a turn very often still spread over parts
    ordered = turns.withColumn("salt", salt).repartitionByRange(parts, "conv_id", "turn", "salt").sortWithinPartitions("conv_id", "turn", "salt", "role", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in order), pa.array(np.full(b.num_rows, part, np.int64)), pa.array(np.arange(at, at + b.num_rows))], names=[*order, "part", "pos"])
            at += b.num_rows

    placed = stage(ordered.mapInArrow(number, f"conv_id {types['conv_id']}, turn {types['turn']}, role string, text string, part long, pos long"), "chat-turns")
    spans = placed.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(F.col("conv_id").alias("wide"))
    solver = Repair(costs)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, part), rows in _runs(batches, ["conv_id", "part", "role"]):
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch_type(types["conv_id"])), pa.array([part], pa.int64()), pa.array([solver.product([role_of(r[2]) for r in rows]).ravel().tolist()])], names=["conv_id", "part", "prices"])

    # At most two conversations begin or end amid any part, so this frame has one or two rows a part.
    wide = placed.join(F.broadcast(spans), F.col("conv_id").eqNullSafe(F.col("wide")), "left_semi").select("conv_id", "part", "role", "pos").repartition("part").sortWithinPartitions("part", "pos")
    tables = wide.mapInArrow(summed, f"conv_id {types['conv_id']}, part long, prices array<long>").collect()
    borders: dict[tuple, tuple[int, int, bool, bool]] = {}
    by_conv: dict = {}
    for r in sorted(tables, key=lambda r: r["part"]):
        by_conv.setdefault(r["conv_id"], []).append((r["part"], np.array(r["prices"]).reshape(4, 4)))
    for conv, runs in by_conv.items():
        states = solver.borders([m for _, m in runs])
        for i, (part, _) in enumerate(runs):
            borders[conv, part] = (states[i], states[i + 1], i == 0, i == len(runs) - 1)
    shared = turns.sparkSession.sparkContext.broadcast(borders)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, part), rows in _runs(batches, ["conv_id", "part", "turn", "role", "text"]):
            given = [role_of(r[3]) for r in rows]
            whole = (conv, part) not in shared.value
            first, last, opens, ends = shared.value.get((conv, part), (NOTHING, None, True, True))
            if whole:
                last = solver.borders([solver.product(given)])[-1]
            for i, ((_, _, turn, role, text), (state, step)) in enumerate(zip(rows, solver.path(given, first, last), strict=True)):
                empty = "".join(f"<|im_start|>{NAMES[k]}\n<|im_end|>\n" for k in step.inserted)
                shut = "" if opens and i == 0 else "<|im_end|>\n"
                piece = f"\n{_safe(text)}" if step.action == "merge" else f"{shut}{empty}<|im_start|>{NAMES[state]}\n{_safe(text)}"
                missing = ()
                if ends and i == len(rows) - 1:
                    missing = solver.closing[state][1]
                    piece += "<|im_end|>\n" + "".join(f"<|im_start|>{NAMES[k]}\n<|im_end|>\n" for k in missing)
                out.append((conv, turn, role, NAMES[state], step.action, [NAMES[k] for k in (*step.inserted, *missing)], piece))
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    kinds = [batch_type(types["conv_id"]), batch_type(types["turn"]), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    together = placed.repartition("part").sortWithinPartitions("part", "pos")
    return together.mapInArrow(solve, f"conv_id {types['conv_id']}, turn {types['turn']}, role string, new_role string, action string, inserted array<string>, rendered string")


def batch_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[name]
