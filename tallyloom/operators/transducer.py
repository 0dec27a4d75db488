"""Ordered folds for keys of any size: machines whose effect on a block of rows can be composed.

A machine's whole state is a tuple of registers. It looks at a register only through questions (equal to a value, at most a
bound), so that a block of rows can be worked through before the state at its beginning is known: registers then start as
variables, and an open question splits the run in two cases. Cases that come to the same registers are one again; most
machines forget their beginning within a few rows. What is left is the block's map from states to states. A scan over the maps of a
key (one small row for each block) fixes the state at every block's beginning, and a second pass over the blocks emits the output.

A key with a hundred times the rows is a hundred times the tasks; a task holds one block's cases, never its rows. Rows of one time
are in one block, whatever their number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import BATCH, arrow_schema, grouped_fold, record_batch, record_rows


class Var(NamedTuple):
    """A register's unknown value at a block's beginning."""

    place: int


class Open(Exception):
    """A question whose answer the case doesn't tell."""

    def __init__(self, place: int, kind: str, value: Any) -> None:
        super().__init__()
        self.place, self.kind, self.value = place, kind, value


class Never(Exception):
    """No state comes to this case."""


class Bound(NamedTuple):
    """What a case knows of a variable: its value, or what it is not and that it lies above `low` and at most at `high`."""

    fixed: bool = False
    value: Any = None
    other: frozenset = frozenset()
    low: Any = None
    high: Any = None

    def answer(self, kind: str, value: Any) -> bool | None:
        if self.fixed:
            return self.value == value if kind == "equal" else self.value <= value
        if kind == "equal":
            beyond = value is not None and ((self.low is not None and value <= self.low) or (self.high is not None and value > self.high))
            return False if value in self.other or beyond or (value is None and (self.low is not None or self.high is not None)) else None
        if self.high is not None and self.high <= value:
            return True
        return False if self.low is not None and self.low >= value else None

    def split(self, kind: str, value: Any) -> tuple[Bound, Bound]:
        if kind == "equal":
            return Bound(True, value), self._replace(other=self.other | {value})
        return self._replace(high=value), self._replace(low=value)

    def joined(self, other: Bound) -> Bound | None:
        """One bound for both, if there is one."""
        if self.fixed != other.fixed:
            one, rest = (self, other) if self.fixed else (other, self)
            both = rest._replace(other=rest.other - {one.value})
            return both if one.value in rest.other and holds(both, one.value) else None
        if self.fixed or self.other != other.other:
            return None
        if self.high is not None and self.high == other.low:
            return self._replace(high=other.high)
        return self._replace(low=other.low) if self.low is not None and self.low == other.high else None


Case = tuple[Bound, ...]


@dataclass
class Ask:
    """A machine's way to look at registers."""

    case: Case = ()

    def equal(self, register: Any, value: Any) -> bool:
        return self._ask(register, "equal", value)

    def at_most(self, register: Any, value: Any) -> bool:
        return self._ask(register, "at_most", value)

    def among(self, register: Any, values: Iterable[Any]) -> Any:
        """The register's value, if it is one of a few."""
        if not isinstance(register, Var):
            return register
        for value in values:
            if self.equal(register, value):
                return value
        raise Never

    def _ask(self, register: Any, kind: str, value: Any) -> bool:
        if not isinstance(register, Var):
            return register == value if kind == "equal" else register <= value
        known = self.case[register.place].answer(kind, value)
        if known is None:
            raise Open(register.place, kind, value)
        return known


Registers = tuple
Step = Callable[[Registers, tuple, Ask], tuple[Registers, list[tuple]]]


@dataclass(frozen=True)
class Machine:
    """start: registers before the first row. step: (registers, row, ask) to (registers, output rows). finish: output rows of what is
    open after a key's last row. Registers hold None, booleans, numbers and text. heeds: a column's place and the values of it that the step
    looks at; rows with others neither move registers nor give output, and a key of such rows alone gives none."""

    start: Registers
    step: Step
    finish: Callable[[Registers], list[tuple]] = lambda registers: []
    heeds: tuple[int, tuple] | None = None


class Cases:
    """The map of the rows read so far: every case, with the registers that it comes to."""

    def __init__(self, machine: Machine) -> None:
        width = len(machine.start)
        self.machine = machine
        self.runs: list[tuple[Case, Registers]] = [((Bound(),) * width, tuple(Var(i) for i in range(width)))]

    def read(self, row: tuple) -> None:
        out: list[tuple[Case, Registers]] = []
        done: dict[Registers, Registers] = {}
        forked = False
        for case, registers in self.runs:
            if registers in done:
                out.append((case, done[registers]))
                continue
            todo = [case]
            while todo:
                own = todo.pop()
                try:
                    after = self.machine.step(registers, row, Ask(own))[0]
                except Open as question:
                    yes, no = own[question.place].split(question.kind, question.value)
                    todo += [(*own[: question.place], b, *own[question.place + 1 :]) for b in (no, yes)]
                    forked = True
                    continue
                except Never:
                    continue
                if not any(isinstance(r, Var) for r in registers):
                    done[registers] = after
                out.append((own, after))
        self.runs = merged(out) if forked or len(out) > 1 else out

    def text(self) -> str:
        return json.dumps([[[[b.fixed, b.value, sorted(b.other, key=repr), b.low, b.high] for b in case], [{"of": r.place} if isinstance(r, Var) else r for r in registers]] for case, registers in self.runs])


def merged(runs: list[tuple[Case, Registers]]) -> list[tuple[Case, Registers]]:
    """Cases with the same outcome whose bounds differ in one place only, and touch there, are one."""
    by_outcome: dict[Registers, list[Case]] = {}
    for case, registers in runs:
        by_outcome.setdefault(tuple((type(r), r) for r in registers), []).append(case)
    out = []
    for typed, cases in by_outcome.items():
        again = len(cases) > 1
        while again:
            again = False
            for i in range(len(cases)):
                for j in range(i + 1, len(cases)):
                    differ = [k for k, (a, b) in enumerate(zip(cases[i], cases[j], strict=True)) if a != b]
                    both = cases[i][differ[0]].joined(cases[j][differ[0]]) if len(differ) == 1 else None
                    if both is not None:
                        cases[i] = (*cases[i][: differ[0]], both, *cases[i][differ[0] + 1 :])
                        del cases[j]
                        again = True
                        break
                if again:
                    break
        out += [(case, tuple(r for _, r in typed)) for case in cases]
    return out


def applied(text: str, registers: Registers) -> Registers:
    """A block's map, at one state."""
    for bounds, outcome in json.loads(text):
        case = [Bound(f, v, frozenset(o), lo, hi) for f, v, o, lo, hi in bounds]
        if all(holds(b, r) for b, r in zip(case, registers, strict=True)):
            return tuple(registers[x["of"]] if isinstance(x, dict) else x for x in outcome)
    raise ValueError("a block's cases don't cover the state before it")


def holds(bound: Bound, value: Any) -> bool:
    if bound.fixed:
        return value == bound.value
    if value in bound.other:
        return False
    if value is None:
        return bound.low is None and bound.high is None
    return (bound.low is None or value > bound.low) and (bound.high is None or value <= bound.high)


# --- on tables


def dealt(rows: DataFrame, keys: Sequence[str], time: str, tie: str, columns: Sequence[str], every: int) -> DataFrame:
    """keys, block (of `every` units of time), at, tie and the machine's columns c0, c1 ..."""
    return rows.select(*keys, F.floor(F.col(time) / every).cast("long").alias("block"), F.col(time).alias("at"), F.col(tie).alias("tie"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])


def heeded(rows: DataFrame, columns: Sequence[str], machine: Machine) -> DataFrame:
    """rows without those that the machine passes over."""
    return rows.filter(F.col(columns[machine.heeds[0]]).isin(*machine.heeds[1])) if machine.heeds else rows


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, tuple | None]]:
    """(first `width` values, the others) of every row, and (them, None) after a group's last row."""
    key = None
    for row in record_rows(batches):
        own = row[:width]
        if key is not None and own != key:
            yield key, None
        key = own
        yield own, row[width:]
    if key is not None:
        yield key, None


def block_maps(blocks: DataFrame, keys: Sequence[str], columns: int, machine: Machine) -> DataFrame:
    """keys, block and cases: the map of each block."""
    fields = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    out = arrow_schema(f"{fields}, block long, cases string")
    width = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cases = None
        for key, row in grouped(batches, width):
            if row is None:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, cases.text()], out, strict=True)], schema=out)
                cases = None
                continue
            cases = cases or Cases(machine)
            cases.read(row[2:])

    placed = blocks.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "at", "tie")
    return placed.select(*keys, "block", "at", "tie", *[f"c{i}" for i in range(columns)]).mapInArrow(run, f"{fields}, block long, cases string")


def block_starts(maps: DataFrame, keys: Sequence[str], machine: Machine) -> DataFrame:
    """keys, block, registers (before its first row) and last (whether it is the key's last block): a scan over the maps."""
    fields = ", ".join(f"{k} {maps.schema[k].dataType.simpleString()}" for k in keys)

    def start() -> Callable[[tuple | None], list[tuple]]:
        registers, held = machine.start, None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal registers, held
            out = [(*held, row is None)] if held is not None else []
            if row is not None:
                held = (row[0], json.dumps(registers))
                registers = applied(row[1], registers)
            return out

        return step

    return grouped_fold(maps, keys, ["block"], ["block", "cases"], start, f"{fields}, block long, registers string, last boolean")


def emitted(blocks: DataFrame, starts: DataFrame, keys: Sequence[str], columns: int, machine: Machine, schema: str) -> DataFrame:
    """keys, block and the machine's output rows (schema without the keys), each block from its own start."""
    fields = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"c{i}" for i in range(columns)]
    empty = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("at", "tie", *names)]
    first = starts.select(*keys, "block", F.lit(0).alias("what"), "registers", "last", *empty)
    rest = blocks.select(*keys, "block", F.lit(1).alias("what"), F.lit(None).cast("string").alias("registers"), F.lit(None).cast("boolean").alias("last"), "at", "tie", *names)
    both = first.unionByName(rest).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "what", "at", "tie")
    out = arrow_schema(f"{fields}, block long, {schema}")
    width = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, found = Ask(), []
        registers, last = machine.start, False
        for key, row in grouped(batches, width):
            if row is None:
                found += [(*key, *x) for x in machine.finish(registers)] if last else []
            elif row[0] == 0:
                registers, last = tuple(json.loads(row[1])), row[2]
            else:
                registers, rows = machine.step(registers, row[5:], ask)
                found += [(*key, *x) for x in rows]
            if len(found) > BATCH:
                yield record_batch(found, out)
                found = []
        yield record_batch(found, out)

    return both.mapInArrow(run, f"{fields}, block long, {schema}")


def blocked_fold(rows: DataFrame, keys: Sequence[str], time: str, tie: str, columns: Sequence[str], machine: Machine, every: int, schema: str) -> DataFrame:
    """The output of a machine over every key's rows in order: keys, then what the machine gives (schema). Equal to a fold of the key
    in one task; here each `every` units of time of a key are a task's work."""
    blocks = dealt(heeded(rows, columns, machine), keys, time, tie, columns, every)
    starts = block_starts(block_maps(blocks, keys, len(columns), machine), keys, machine)
    return emitted(blocks, starts, keys, len(columns), machine, schema).drop("block")


# --- machines


def latch(starts: str, ends: str, confirm: int) -> Machine:
    """(time, kind) rows: a start holds once `confirm` starts came without an end between; the next end closes it. Gives (first start,
    end), with no end for what is open at last."""

    def step(registers: Registers, row: tuple, ask: Ask) -> tuple[Registers, list[tuple]]:
        (seen, first), (time, kind) = registers, row
        if kind == starts:
            seen = ask.among(seen, range(confirm + 1))
            if seen < confirm:
                return (seen + 1, time if not seen else first), []
        elif kind == ends:
            return (0, None), [(first, time)] if ask.equal(seen, confirm) else []
        return (seen, first), []

    return Machine((0, None), step, lambda r: [(r[1], None)] if r[0] == confirm else [], (1, (starts, ends)) if confirm else None)


def debounce(hold: int) -> Machine:
    """(id, time, label) rows: a label replaces the current one once it was read for `hold`. Gives (id, current label)."""

    def step(registers: Registers, row: tuple, ask: Ask) -> tuple[Registers, list[tuple]]:
        (now, later, since), (ident, time, label) = registers, row
        if label is not None:
            if ask.equal(now, label):
                later = since = None
            else:
                if not ask.equal(later, label):
                    later, since = label, time
                if ask.at_most(since, time - hold):
                    now, later, since = label, None, None
        return (now, later, since), [(ident, now)]

    return Machine((None, None, None), step)


def lifecycle(signs: tuple[str, str, str, str], least: float, missing: int) -> Machine:
    """(time, kind, value) rows: the first sign arms, the second with `least` or more makes pending, the third ends and gives (armed,
    pending, ended). The fourth sign is a missing reading; once those last longer than `missing` all is idle again."""
    arm, score, end, unknown = signs

    def step(registers: Registers, row: tuple, ask: Ask) -> tuple[Registers, list[tuple]]:
        (armed, pending, since), (time, kind, value) = registers, row
        if kind == unknown:
            since = time if ask.equal(since, None) else since
            return (None, None, since) if ask.at_most(since, time - missing - 1) else (armed, pending, since), []
        out = []
        if kind == arm:
            armed, pending = time, None
        elif kind == score and value is not None and value >= least:
            if not ask.equal(armed, None) and ask.equal(pending, None):
                pending = time
        elif kind == end and not ask.equal(pending, None):
            out, armed, pending = [(armed, pending, time)], None, None
        return (armed, pending, None), out

    return Machine((None, None, None), step)
