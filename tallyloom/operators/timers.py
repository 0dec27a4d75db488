"""Folds with timers: what is due between two rows happens between them.

A machine reads rows and fires timers that it set itself, by name and time. Timers fire in the order of their times (of equal
ones by name), before the next later row; rows of a timer's own time come first, so that they can still put it off. The same machine
runs over a sorted table here and over a stream in `tallyloom.streaming.timed`. Its state is a dict that JSON can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .fold import grouped_fold

State = dict[str, Any]
Timers = dict[str, int]


@dataclass(frozen=True)
class TimedMachine:
    """row(state, timers, values) and timer(state, timers, name, at) change state and timers and return output rows; the first of
    the values is the row's time."""

    row: Callable[[State, Timers, tuple], list[tuple]]
    timer: Callable[[State, Timers, str, int], list[tuple]]
    start: State = field(default_factory=dict)


def fire(machine: TimedMachine, state: State, timers: Timers, before: int | None) -> list[tuple]:
    """Everything due before a time (None: everything, those set on the way too)."""
    out: list[tuple] = []
    while timers:
        at, name = min((at, name) for name, at in timers.items())
        if before is not None and at >= before:
            break
        del timers[name]
        out += machine.timer(state, timers, name, at)
    return out


def timed_fold(rows: DataFrame, keys: Sequence[str], time: str, tie: str, columns: Sequence[str], machine: TimedMachine, schema: str) -> DataFrame:
    """keys and the machine's output over each key's rows in order of (time, tie); columns: what a row gives besides its time.
    What is still due after a key's last row fires at its time."""

    def start() -> Callable[[tuple | None], list[tuple]]:
        state, timers = deepcopy(machine.start), {}

        def step(row: tuple | None) -> list[tuple]:
            out = fire(machine, state, timers, None if row is None else row[0])
            return out if row is None else out + machine.row(state, timers, row)

        return step

    return grouped_fold(rows, keys, [time, tie], [time, *columns], start, schema)


def encounters(seen: str, fired: str, still: str, moved: str, cut: str, *, lost: int, quiet: int, burst: int, again: int, hold: int) -> TimedMachine:
    """(time, kind) rows become (what, since, at, n) events:

    * `spotted` at the first sighting of a presence, `lost` once nothing was seen for `lost`;
    * `burst` of n shots, each at most `burst` after the one before, told once it is over;
    * `engaged` at the first shot of a presence; `over` once there was neither sighting nor shot for `quiet`; `again` if
      an engagement begins within `again` of the end of the one before (since: that end);
    * `held` once a stillness has lasted for `hold`; `left` when it ends after that.

    A cut forgets everything and tells nothing."""

    def row(state: State, timers: Timers, values: tuple) -> list[tuple]:
        time, kind = values
        out: list[tuple] = []
        if kind == cut:
            state.clear()
            timers.clear()
        elif kind == seen:
            if "seen" not in state:
                out.append(("spotted", time, time, None))
            state["seen"] = time
            timers["lost"] = time + lost
        elif kind == fired:
            if "burst" not in timers:
                state["burst"], state["shots"] = time, 0
            state["shots"] += 1
            state["fired"] = time
            timers["burst"] = time + burst
            if "seen" in state and "engaged" not in state:
                state["engaged"] = time
                out.append(("engaged", time, time, None))
                if "over" in state and time - state["over"] <= again:
                    out.append(("again", state["over"], time, None))
        elif kind == still and "still" not in state:
            state["still"] = time
            timers["hold"] = time + hold
        elif kind == moved and "still" in state:
            if "hold" not in timers:
                out.append(("left", state["still"], time, None))
            timers.pop("hold", None)
            del state["still"]
        if "engaged" in state:
            timers["quiet"] = max(state.get("seen", time), state["fired"]) + quiet if kind in (seen, fired) else timers["quiet"]
        return out

    def timer(state: State, timers: Timers, name: str, at: int) -> list[tuple]:
        if name == "lost":
            return [("lost", state.pop("seen"), at, None)]
        if name == "burst":
            return [("burst", state["burst"], state["fired"], state["shots"])]
        if name == "hold":
            return [("held", state["still"], at, None)]
        state["over"] = at
        return [("over", state.pop("engaged"), at, None)]

    return TimedMachine(row, timer)
