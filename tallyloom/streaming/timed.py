"""Machines with timers over a stream: the events of the batch fold, each once the watermark has passed its time."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tallyloom.operators.timers import TimedMachine, fire


class _Timed(StatefulProcessor):
    """Rows wait until the watermark has passed them, since earlier ones may still come; then they and the machine's timers take
    their turns in order. State: the machine's own, and the rows of the watermark's delay."""

    def __init__(self, machine: TimedMachine, names: list[str]) -> None:
        self.machine, self.names = machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "text string")
        self.waiting = handle.getListState("waiting", "row string")

    def _wake(self, time: int) -> None:
        self.handle.registerTimer(-(-time // 1000))  # the first millisecond not before it

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in filter(len, rows):
            for text, time in zip(frame["row_json"].tolist(), frame["row_time"].tolist(), strict=True):
                self.waiting.appendValue((text,))
                self._wake(time)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        state, timers = json.loads(self.state.get()[0]) if self.state.exists() else (dict(self.machine.start), {})
        rows = [list(json.loads(r[0]).values()) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= until), key=lambda r: (r[0], r[1]))
        out: list[tuple] = []
        for r in due:
            out += fire(self.machine, state, timers, r[0])
            out += self.machine.row(state, timers, (r[0], *r[2:]))
        out += fire(self.machine, state, timers, until)
        if due:
            self.waiting.clear()
            for r in rows:
                if r[0] > until:
                    self.waiting.appendValue((json.dumps(dict(enumerate(r))),))
        self.state.update((json.dumps([state, timers]),))
        for at in timers.values():
            self._wake(max(at, until) + 1)
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def timed_fold(rows: DataFrame, keys: Sequence[str], event_time: str, late: str, tie: str, columns: Sequence[str], machine: TimedMachine, schema: str) -> DataFrame:
    """The stream's form of operators.timers.timed_fold: times are microseconds of the column event_time, rows come up to `late` out of
    order, and the last events come once the watermark has passed them. schema: the keys first, then what the machine gives."""
    out = StructType.fromDDL(schema)
    micros = F.unix_micros(event_time)
    parts = F.struct(*[c.alias(f"v{i}") for i, c in enumerate([micros, F.col(tie), *map(F.col, columns)])])
    slim = rows.withWatermark(event_time, late).select(*keys, event_time, micros.alias("row_time"), F.to_json(parts, {"ignoreNullFields": "false"}).alias("row_json"))
    return slim.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Timed(machine, out.names), outputStructType=out, outputMode="Append", timeMode="EventTime")
