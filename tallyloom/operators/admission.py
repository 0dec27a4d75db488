"""Admission in order: several running caps at once, and a journal whose entries keep invariants."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import Step, grouped_fold


@dataclass(frozen=True)
class Cap:
    """At most `most` of an amount's sum (None: of rows) within each group of columns below the key (none: the key itself)."""

    name: str
    by: Sequence[str]
    most: float
    amount: str | None = None


def reservations(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, request: str, caps: Sequence[Cap], key_schema: str) -> DataFrame:
    """keys, ident, admitted and reason of every row. Rows ask in order; a row whose request was admitted before for its key is `repeated`, one that
    would lift a group above a cap is refused by the cap's name (the first broken one), and a refused row changes nothing. A null amount is 0, a negative
    one is refused as `negative`. State of a key: counters of groups and requests with admitted rows, so no more than the caps admit."""
    columns, places = [ident, request], []
    for cap in caps:
        places.append((len(columns), len(cap.by), cap.amount is not None))
        columns += [*cap.by, *([cap.amount] if cap.amount else [])]

    def start() -> Step:
        used: dict[tuple, float] = {}
        taken: set = set()

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            if row[1] in taken:
                return [(row[0], False, "repeated")]
            asks = []
            for i, (cap, (at, width, has_amount)) in enumerate(zip(caps, places, strict=True)):
                amount = (row[at + width] or 0) if has_amount else 1
                group = (i, *row[at : at + width])
                if amount < 0:
                    return [(row[0], False, "negative")]
                if used.get(group, 0) + amount > cap.most:
                    return [(row[0], False, cap.name)]
                asks.append((group, amount))
            for group, amount in asks:
                used[group] = used.get(group, 0) + amount
            taken.add(row[1])
            return [(row[0], True, None)]

        return step

    return grouped_fold(rows, keys, order, columns, start, f"{key_schema}, {ident} long, admitted boolean, reason string")


State = dict[str, Any]
#: Takes the state and an entry's data; changes the state, or leaves it and returns why.
Handler = Callable[[State, dict], str | None]


def journal(entries: DataFrame, keys: Sequence[str], seq: str, kind: str, data: str, handlers: dict[str, Handler], key_schema: str, snapshot: DataFrame | None = None) -> DataFrame:
    """keys, seq, what (`refused` or `state`), text of each key's journal: entries (kind, data as JSON) apply in order of seq. An entry
    that a handler refuses, or of a kind without handler, or whose data is no JSON object, leaves the state as it was and comes back
    with its reason; after the last entry the state comes back as JSON with the seq of the last entry applied. A snapshot (keys, seq, text: such
    a state) is where the replay begins; entries up to its seq are passed over, and an entry whose seq does not rise is refused. A key's state is what its
    handlers keep of its entities."""
    columns = [F.col(seq).alias("seq"), F.lit(1).alias("what"), F.col(kind).alias("kind"), F.col(data).alias("data")]
    rows = entries.select(*keys, *columns)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select(*keys, "seq", F.lit(0).alias("what"), F.lit(None).cast("string").alias("kind"), F.col("text").alias("data")))

    def start() -> Step:
        state: State = {}
        last: int | None = None
        until: int | None = None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal state, last, until
            if row is None:
                return [(last, "state", json.dumps(state, sort_keys=True))]
            at, what, name, text = row
            if not what:
                state, last, until = json.loads(text), at, at
                return []
            if until is not None and at is not None and at <= until:
                return []
            reason = refused(at, name, text)
            if reason is None:
                last = at
                return []
            return [(at, "refused", reason)]

        def refused(at: int | None, name: str, text: str | None) -> str | None:
            if at is None or (last is not None and at <= last):
                return "seq does not rise"
            if name not in handlers:
                return f"unknown kind {name}"
            try:
                value = json.loads(text or "")
            except ValueError:
                return "data is no JSON"
            if not isinstance(value, dict):
                return "data is no object"
            return handlers[name](state, value)

        return step

    # A snapshot comes before the entries after it, and they are in order of seq.
    return grouped_fold(rows, keys, ["what", "seq", "kind", "data"], ["seq", "what", "kind", "data"], start, f"{key_schema}, seq long, what string, text string")


def catalog(splits: Sequence[str], learning: Sequence[str], single: Sequence[str]) -> dict[str, Handler]:
    """Handlers of a catalog of sources and of artifacts made from them. Invariants: one `init`, before all else; ids, content hashes and artifacts are
    registered once; a physical unit stands in one split and one learning split, neither of which changes; artifacts have known parents, the physical
    units of their parents, and one such unit if their kind is single."""

    def begun(handler: Handler) -> Handler:
        return lambda state, data: handler(state, data) if "config" in state else "before init"

    def known(handler: Callable[[State, dict, dict], str | None]) -> Handler:
        def look(state: State, data: dict) -> str | None:
            own = state["sources"].get(data.get("id"))
            return "unknown source" if own is None else handler(state, own, data)

        return begun(look)

    def init(state: State, data: dict) -> str | None:
        if "config" in state:
            return "second init"
        state.update(config=data, sources={}, artifacts={}, hashes={}, units={}, learning={})
        return None

    def register(state: State, data: dict) -> str | None:
        if data.get("split") not in splits:
            return "unknown split"
        if data.get("id") is None or data["id"] in state["sources"]:
            return "id is taken"
        if data.get("sha") in state["hashes"]:
            return "same content"
        if state["units"].get(str(data.get("unit")), data["split"]) != data["split"]:
            return "unit in two splits"
        state["sources"][data["id"]] = {"unit": data.get("unit"), "split": data["split"], "anchors": [], "exposures": 0}
        state["hashes"][data.get("sha")] = data["id"]
        state["units"][str(data.get("unit"))] = data["split"]
        return None

    def learn(state: State, own: dict, data: dict) -> str | None:
        if data.get("split") not in learning:
            return "unknown learning split"
        if state["learning"].get(str(own["unit"]), data["split"]) != data["split"]:
            return "unit in two learning splits"
        state["learning"][str(own["unit"])] = own["learning"] = data["split"]
        return None

    def field(name: str) -> Handler:
        def put(state: State, own: dict, data: dict) -> str | None:
            own[name] = data.get(name)
            return None

        return known(put)

    def anchor(state: State, own: dict, data: dict) -> str | None:
        if data.get("sha") not in own["anchors"]:
            own["anchors"].append(data.get("sha"))
        return None

    def expose(state: State, own: dict, data: dict) -> str | None:
        own["exposures"] += 1
        return None

    def artifact(state: State, data: dict) -> str | None:
        ident, parents = data.get("id"), data.get("parents") or []
        if ident is None or ident in state["artifacts"] or ident in state["sources"]:
            return "id is taken"
        units: set = set()
        for p in parents:
            if p not in state["sources"] and p not in state["artifacts"]:
                return "unknown parent"
            units |= {state["sources"][p]["unit"]} if p in state["sources"] else set(state["artifacts"][p]["units"])
        if sorted(map(str, units)) != sorted(map(str, data.get("units") or [])):
            return "units differ from the parents'"
        if data.get("kind") in single and len(units) != 1:
            return "more than one unit"
        state["artifacts"][ident] = {"kind": data.get("kind"), "parents": parents, "units": sorted(units, key=str)}
        return None

    return {"init": init, "register": begun(register), "learning_split": known(learn), "location": field("location"), "metadata": field("metadata"), "status": field("status"), "anchor": known(anchor), "exposure": known(expose), "artifact": begun(artifact)}
