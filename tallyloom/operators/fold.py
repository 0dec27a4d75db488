"""Operators whose next step depends on what was kept before: ordered folds within a key.

`grouped_fold` sorts each key's rows in Spark and hands them over one after the other; state lives in the step function's
own object; rows are streamed from Arrow columns, and what is held of a key is what each step function's docstring names. One
key is one task: keys should be bounded units such as a match and round, or a user's session (`transducer` has no such bound).
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[tuple], list[tuple]]
#: Output rows that a task holds before it hands them on.
BATCH = 4096


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples; NaN comes as None."""
    for batch in batches:
        columns = [pc.if_else(pc.is_nan(c), None, c) if pa.types.is_floating(c.type) else c for c in batch.columns]
        yield from zip(*[c.to_pylist() for c in columns], strict=True)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def grouped_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable[[], Step], schema: str, partitions: int | None = None) -> DataFrame:
    """For every key a new step from start() gets its rows (values of columns, in order) and returns output rows; after
    the last one it gets None. schema: the keys first, then what the step returns."""
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = rows.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    dealt = chosen.repartition(partitions, *keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))])
    width = len(keys) + len(order)
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        step: Step | None = None
        out: list[tuple] = []
        for row in record_rows(batches):
            own = row[: len(keys)]
            if own != key:
                if step is not None:
                    out += [(*key, *x) for x in step(None)]  # type: ignore[misc]
                key, step = own, start()
            out += [(*own, *x) for x in step(row[width:])]  # type: ignore[misc]
            if len(out) >= BATCH:
                yield record_batch(out, fields)
                out = []
        if step is not None:
            out += [(*key, *x) for x in step(None)]  # type: ignore[misc]
        yield record_batch(out, fields)

    return dealt.mapInArrow(run, schema)


def thin(heartbeat: int) -> Callable[[], Step]:
    """Keep (id, time, state) rows whose state changed, or that come `heartbeat` or more after the last kept one."""

    def start() -> Step:
        kept: dict[str, Any] = {}

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            ident, time, state = row
            if not kept or kept["state"] != state or time - kept["time"] >= heartbeat:
                kept.update(state=state, time=time)
                return [(ident,)]
            return []

        return step

    return start


def heartbeat_thin(rows: DataFrame, keys: Sequence[str], time: str, tie: str, state: str, heartbeat: int, key_schema: str) -> DataFrame:
    return grouped_fold(rows, keys, [time, tie], [tie, time, state], thin(heartbeat), f"{key_schema}, {tie} long")


def spaced(window: int) -> Callable[[], Step]:
    """Greedy dedup in time: (id, time, confidence) rows within `window` of the kept item join it. The member with the
    highest confidence survives and gives the time that later rows are measured from; the merged confidence is the lowest."""

    def start() -> Step:
        kept: dict[str, Any] = {}

        def flush() -> list[tuple]:
            return [(kept["id"], kept["n"], kept["low"])] if kept else []

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return flush()
            ident, time, confidence = row
            if kept and time - kept["time"] <= window:
                kept["n"] += 1
                kept["low"] = min(kept["low"], confidence)
                if confidence > kept["best"]:
                    kept.update(id=ident, time=time, best=confidence)
                return []
            out = flush()
            kept.update(id=ident, time=time, best=confidence, low=confidence, n=1)
            return out

        return step

    return start


def dedup_in_time(rows: DataFrame, keys: Sequence[str], time: str, tie: str, confidence: str, window: int, key_schema: str) -> DataFrame:
    """survivor (tie column), members and confidence of each kept item."""
    rows = rows.withColumn("__neg", -F.col(confidence))
    return grouped_fold(rows, keys, [time, "__neg", tie], [tie, time, confidence], spaced(window), f"{key_schema}, survivor long, members long, confidence double")


def exclusive(within: int) -> Callable[[], Step]:
    """Greedy one-to-one matching in time order: each (side, id, time) row of side `b` takes the earliest unused row of side `a`
    at most `within` before it."""

    def start() -> Step:
        waiting: deque[tuple[int, int]] = deque()

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            side, ident, time = row
            while waiting and time - waiting[0][1] > within:
                waiting.popleft()
            if side == "a":
                waiting.append((ident, time))
            elif waiting:
                return [(waiting.popleft()[0], ident)]
            return []

        return step

    return start


def exclusive_match(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, ident: str, within: int, key_schema: str) -> DataFrame:
    """Pairs (a, b) of left and right ids; a left row is used once."""
    both = left.select(*keys, F.lit("a").alias("side"), ident, time).unionByName(right.select(*keys, F.lit("b").alias("side"), ident, time))
    return grouped_fold(both, keys, [time, "side", ident], ["side", ident, time], exclusive(within), f"{key_schema}, a long, b long")


def nearest_exclusive(within: int) -> Callable[[], Step]:
    """Greedy one-to-one matching: rows of side `b`, in time order, take the nearest unused row of side `a` at most `within`
    before or after; of equally near ones the earlier. A `b` waits until no later row can be near enough, so what is held
    are the rows within twice the distance, found by bisection."""

    def start() -> Step:
        times: list[int] = []  # unused rows of side a, in time order, and their ids
        idents: list[Any] = []
        waiting: deque[tuple[Any, int]] = deque()

        def forget(before: int) -> None:
            k = bisect_left(times, before)
            del times[:k], idents[:k]

        def decide() -> list[tuple]:
            ident, time = waiting.popleft()
            forget(time - within)  # too early for every later b as well
            after = bisect_left(times, time)
            near = [k for k in (bisect_left(times, times[after - 1]) if after else -1, after) if 0 <= k < len(times) and abs(times[k] - time) <= within]
            if not near:
                return []
            k = min(near, key=lambda k: (abs(times[k] - time), k))
            del times[k]
            return [(idents.pop(k), ident)]

        def step(row: tuple | None) -> list[tuple]:
            out: list[tuple] = []
            while waiting and (row is None or row[2] > waiting[0][1] + within):
                out += decide()
            if row is not None:
                if row[0] == "b":
                    waiting.append((row[1], row[2]))
                else:
                    times.append(row[2])
                    idents.append(row[1])
                if not waiting:
                    forget(row[2] - within)
            return out

        return step

    return start


def nearest_exclusive_match(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, ident: str, within: int, key_schema: str) -> DataFrame:
    """Pairs (a, b) of left and right ids; each row is used once, each right row in time order takes the nearest."""
    side = lambda rows, name: rows.select(*keys, F.lit(name).alias("side"), F.col(ident).alias("ident"), F.col(time).alias("time"))
    rows = side(left, "a").unionByName(side(right, "b"))
    return grouped_fold(rows, keys, ["time", "side", "ident"], ["side", "ident", "time"], nearest_exclusive(within), f"{key_schema}, a long, b long")


def latch(starts: str, ends: str, confirm: int) -> Callable[[], Step]:
    """A latched machine over (time, kind) rows: a start holds once `confirm` start signals came without an end between;
    then the first end signal closes it. Leftovers are emitted open."""

    def start() -> Step:
        state: dict[str, Any] = {"first": None, "seen": 0, "on": False}

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return [(state["first"], None)] if state["on"] else []
            time, kind = row
            if kind == starts:
                if not state["on"]:
                    state["first"] = time if not state["seen"] else state["first"]
                    state["seen"] += 1
                    state["on"] = state["seen"] >= confirm
            elif kind == ends:
                closed = [(state["first"], time)] if state["on"] else []
                state.update(first=None, seen=0, on=False)
                return closed
            return []

        return step

    return start


def latched_intervals(rows: DataFrame, keys: Sequence[str], time: str, tie: str, kind: str, starts: str, ends: str, confirm: int, key_schema: str) -> DataFrame:
    return grouped_fold(rows, keys, [time, tie], [time, kind], latch(starts, ends, confirm), f"{key_schema}, start long, end long")


def debounce(hold: int) -> Callable[[], Step]:
    """Labels that persist: a new label replaces the current one once it was read for `hold`; (id, time, label) rows come
    back as (id, current label)."""

    def start() -> Step:
        state: dict[str, Any] = {"now": None, "next": None, "since": None}

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            ident, time, label = row
            if label is not None and label != state["now"]:
                if label != state["next"]:
                    state.update(next=label, since=time)
                if time - state["since"] >= hold:
                    state.update(now=label, next=None, since=None)
            elif label is not None:
                state.update(next=None, since=None)
            return [(ident, state["now"])]

        return step

    return start


def debounced(rows: DataFrame, keys: Sequence[str], time: str, tie: str, label: str, hold: int, key_schema: str) -> DataFrame:
    return grouped_fold(rows, keys, [time, tie], [tie, time, label], debounce(hold), f"{key_schema}, {tie} long, label string")


def longest_rise() -> Step:
    """The longest non-decreasing subsequence of (id, value) rows; of equally long ones the one with the smaller values."""
    values: list[Any] = []  # the last values of the rises of each length, and their rows
    tails: list[int] = []
    parent: list[int] = []
    ids: list[Any] = []

    def step(row: tuple | None) -> list[tuple]:
        if row is None:
            out, at = [], tails[-1] if tails else -1
            while at >= 0:
                out.append((ids[at],))
                at = parent[at]
            return out[::-1]
        ident, value = row
        k = bisect_right(values, value)
        ids.append(ident)
        parent.append(tails[k - 1] if k else -1)
        values[k : k + 1], tails[k : k + 1] = [value], [len(ids) - 1]
        return []

    return step


def monotone_track(rows: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, key_schema: str) -> DataFrame:
    return grouped_fold(rows, keys, [time, tie], [tie, value], longest_rise, f"{key_schema}, {tie} long")


def narrower(within: int) -> Callable[[], Step]:
    """Of (id, start, end) rows that start before the kept one's end, or within `within` after it, the narrower is kept, the
    kept one if equal; gives (loser, kept) pairs. State: one row."""

    def start() -> Step:
        kept: tuple | None = None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal kept
            if row is None:
                return []
            if kept is None or row[1] - within > kept[2]:
                kept = row
                return []
            loser, kept = (kept, row) if row[2] - row[1] < kept[2] - kept[1] else (row, kept)
            return [(loser[0], kept[0])]

        return step

    return start


def around_first(radius: float) -> Callable[[], Step]:
    """(id, x, y) rows in rank order join the first group whose first member lies within the radius, else start one; gives (id,
    rank, group, whether it started the group), ranks and groups from 1 and 0. State: the first members of a key's groups, in
    cells of the radius; no two of them lie within it, so their number follows from the key's area, not its rows."""

    def start() -> Step:
        cells: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        rank = groups = 0

        def step(row: tuple | None) -> list[tuple]:
            nonlocal rank, groups
            if row is None:
                return []
            ident, x, y = row
            rank += 1
            cx, cy = int(x // radius), int(y // radius)
            around = [a for i in (-1, 0, 1) for j in (-1, 0, 1) for a in cells.get((cx + i, cy + j), ())]
            near = [g for g, ax, ay in around if math.hypot(x - ax, y - ay) <= radius]
            if near:
                return [(ident, rank, min(near), False)]
            cells.setdefault((cx, cy), []).append((groups, x, y))
            groups += 1
            return [(ident, rank, groups - 1, True)]

        return step

    return start


def reconcile(sources: tuple[str, ...], restart: str, live: str, same: int, alive: int) -> Callable[[], Step]:
    """(id, time, kind) candidates of the sources, in time order: `same` as the last accepted one within that distance; `new`
    after a restart; `second` if two live rows at least `alive` apart lie between; else `repeated`. Gives (id, verdict, of).
    State: the last accepted row and the live rows' first and last time since."""

    def start() -> Step:
        last: tuple | None = None
        restarted = False
        seen: list[int] = []

        def step(row: tuple | None) -> list[tuple]:
            nonlocal last, restarted
            if row is None:
                return []
            ident, time, kind = row
            if kind == restart:
                restarted = True
            elif kind == live:
                seen[1:] = [time]
            if kind not in sources:
                return []
            if last is not None and time - last[1] <= same:
                return [(ident, "same", last[0])]
            if last is None:
                verdict = "first"
            elif restarted:
                verdict = "new"
            elif len(seen) == 2 and seen[1] - seen[0] >= alive:
                verdict = "second"
            else:
                return [(ident, "repeated", last[0])]
            last, restarted = (ident, time), False
            seen.clear()
            return [(ident, verdict, ident)]

        return step

    return start


def reconciled(rows: DataFrame, keys: Sequence[str], time: str, tie: str, sources: tuple[str, ...], restart: str, live: str, same: int, alive: int, key_schema: str) -> DataFrame:
    """verdict and the accepted row (`of`) of every candidate row; the kinds are in `event_type`."""
    return grouped_fold(rows, keys, [time, tie], [tie, time, "event_type"], reconcile(sources, restart, live, same, alive), f"{key_schema}, {tie} long, verdict string, of long")


def fuse(within: int) -> Callable[[], Step]:
    """(id, time, confidence) rows at most `within` after the first of their group are one event: (first id, its time, surest
    id, members); of equal confidence the earlier. State: one group."""

    def start() -> Step:
        group: tuple | None = None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal group
            out = []
            if group is not None and (row is None or row[1] - group[1] > within):
                out, group = [(group[0], group[1], group[2], group[4])], None
            if row is not None:
                ident, time, confidence = row
                if group is None:
                    group = (ident, time, ident, confidence, 1)
                else:
                    best = (ident, confidence) if confidence is not None and (group[3] is None or confidence > group[3]) else group[2:4]
                    group = (*group[:2], *best, group[4] + 1)
            return out

        return step

    return start


def fused(rows: DataFrame, keys: Sequence[str], time: str, tie: str, confidence: str, within: int, key_schema: str) -> DataFrame:
    """One row for each group of rows: first, time, surest and members."""
    return grouped_fold(rows, keys, [time, tie], [tie, time, confidence], fuse(within), f"{key_schema}, first long, {time} long, surest long, members long")


def free_of(slack: int) -> Callable[[], Step]:
    """(id, start, end) rows in order of their starts are kept unless they start at most `slack` after the end of a kept one: (id). State: one end."""

    def start() -> Step:
        last: int | None = None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal last
            if row is None or (last is not None and row[1] <= last + slack):
                return []
            last = row[2]
            return [(row[0],)]

        return step

    return start


def windows(opens: str, closes: str, gap: int) -> Callable[[], Step]:
    """Windows (start, end, state) from (time, kind) rows. A gap closes an active window as partial at the last row before it,
    or leaves the rows since the last end as a fragment; a start closes an unfinished window as partial, or leaves a fragment
    before the first one; an end is complete only with a start. What is open after the last row is partial. State: one window
    and the first and last row outside of windows."""

    def start() -> Step:
        active = cursor = last = None
        ended = False

        def close(until: int) -> list[tuple]:
            nonlocal active, cursor
            out = []
            if active is not None:
                out = [(active, until, "partial")]
            elif cursor is not None and not ended:
                out = [(cursor, until, "fragment")]
            active = cursor = None
            return out

        def step(row: tuple | None) -> list[tuple]:
            nonlocal active, cursor, last, ended
            if row is None:
                return close(last) if last is not None else []
            time, kind = row
            out = close(last) if last is not None and time - last > gap else []
            if kind == opens:
                out += close(last if last is not None else time)
                active, ended = time, False
            elif kind == closes:
                out += [(active, time, "complete")] if active is not None else [] if cursor is None or ended else [(cursor, time, "fragment")]
                active, cursor, ended = None, None, True
            elif active is None and cursor is None:
                cursor = time
            last = time
            return out

        return step

    return start


def boundary_windows(rows: DataFrame, keys: Sequence[str], time: str, tie: str, kind: str, opens: str, closes: str, gap: int, key_schema: str) -> DataFrame:
    """start, end and state of each key's windows."""
    return grouped_fold(rows, keys, [time, tie], [time, kind], windows(opens, closes, gap), f"{key_schema}, start long, end long, state string")


def by_precedence(slack: int, most: int) -> Callable[[], Step]:
    """(id, start, end, rank) scenes in time order collect under a seed while they start within its end and the slack; the
    member of smallest rank survives (the earlier of equals), `most` others are named in order: (survivor, members, related).
    State: the seed, the survivor and `most` + 1 ids."""

    def start() -> Step:
        end = best = None
        named: list[int] = []
        members = 0

        def step(row: tuple | None) -> list[tuple]:
            nonlocal end, best, members
            out = []
            if members and (row is None or row[1] > end + slack):
                out = [(best[1], members, [i for i in named if i != best[1]][:most])]
                members, best = 0, None
                named.clear()
            if row is not None:
                ident, _, until, rank = row
                if not members:
                    end = until
                if best is None or rank < best[0]:
                    best = (rank, ident)
                if len(named) <= most:
                    named.append(ident)
                members += 1
            return out

        return step

    return start


def precedence_groups(rows: DataFrame, keys: Sequence[str], time: str, tie: str, until: str, rank: str, slack: int, most: int, key_schema: str) -> DataFrame:
    """survivor, members and related ids of each group of scenes."""
    return grouped_fold(rows, keys, [time, tie], [tie, time, until, rank], by_precedence(slack, most), f"{key_schema}, survivor long, members long, related array<long>")


def diverse(quota: int, total: int, apart: int) -> Callable[[], Step]:
    """(id, kind, time) rows in rank order are picked while their kind and the key have places left and no picked row lies
    within `apart`: (id, place). State: `total` picked rows at most."""

    def start() -> Step:
        picked: list[tuple[str, int]] = []

        def step(row: tuple | None) -> list[tuple]:
            if row is None or len(picked) == total:
                return []
            ident, kind, time = row
            if sum(k == kind for k, _ in picked) >= quota or any(abs(time - t) < apart for _, t in picked):
                return []
            picked.append((kind, time))
            return [(ident, len(picked))]

        return step

    return start


def diverse_picks(rows: DataFrame, keys: Sequence[str], rank: str, tie: str, kind: str, time: str, quota: int, total: int, apart: int, key_schema: str) -> DataFrame:
    """place of each picked row."""
    return grouped_fold(rows, keys, [rank, tie], [tie, kind, time], diverse(quota, total, apart), f"{key_schema}, {tie} long, place long")


def lifecycle(signs: tuple[str, str, str, str], least: float, missing: int) -> Callable[[], Step]:
    """(time, kind, value) rows drive a latch: the first sign arms it (again, from a pending state too), the second with a value
    of `least` or more makes it pending, the third ends it and gives (armed, pending, ended). The fourth sign is a missing
    reading; once such readings last longer than `missing` the latch is idle again. State: one latch."""
    arm, score, end, unknown = signs

    def start() -> Step:
        armed = pending = since = None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal armed, pending, since
            if row is None:
                return []
            time, kind, value = row
            if kind == unknown:
                since = time if since is None else since
                if time - since > missing:
                    armed = pending = None
                return []
            since = None
            if kind == arm:
                armed, pending = time, None
            elif kind == score and armed is not None and pending is None and value is not None and value >= least:
                pending = time
            elif kind == end and pending is not None:
                out = [(armed, pending, time)]
                armed = pending = None
                return out
            return []

        return step

    return start


def lifecycles(rows: DataFrame, keys: Sequence[str], time: str, tie: str, kind: str, value: str, signs: tuple[str, str, str, str], least: float, missing: int, key_schema: str) -> DataFrame:
    """armed, pending and ended times of each key's rounds."""
    return grouped_fold(rows, keys, [time, tie], [time, kind, value], lifecycle(signs, least, missing), f"{key_schema}, armed long, pending long, ended long")
