"""The folds of tallyloom/plans/promotion.py against plain Python that looks at all rows of a key at once."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import SparkSession

from tallyloom import plans
from tallyloom.operators import fold
from tallyloom.plans.catalog import DAY, HOUR, events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def users(spark: SparkSession) -> dict[int, list]:
    out = defaultdict(list)
    for r in sorted(events(spark, SF).collect(), key=lambda r: (r.t, r.event_id)):
        out[r.user_id].append(r)
    return out


def got(spark: SparkSession, name: str) -> list[tuple]:
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in plans.QUERIES[name](spark, SF).collect())


def test_reconciled_candidates(spark: SparkSession, users) -> None:
    want = []
    for user, rows in users.items():
        accepted: list[int] = []
        for i, r in enumerate(rows):
            if r.event_type not in ("error", "purchase"):
                continue
            if not accepted:
                verdict = "first"
            else:
                j = accepted[-1]
                between = rows[j + 1 : i]
                alive = [x.t for x in between if x.event_type == "view"]
                if r.t - rows[j].t <= 6 * HOUR:
                    verdict = "same"
                elif any(x.event_type == "signup" for x in between):
                    verdict = "new"
                else:
                    verdict = "second" if len(alive) > 1 and alive[-1] - alive[0] >= 12 * HOUR else "repeated"
            if verdict in ("first", "new", "second"):
                accepted.append(i)
            want.append((user, r.event_id, verdict, rows[accepted[-1]].event_id))
    assert got(spark, "reconciled_candidates") == sorted(want)
    assert {v for _, _, v, _ in want} == {"first", "same", "new", "second", "repeated"}


def test_fused_events(spark: SparkSession, users) -> None:
    want = []
    for user, all_rows in users.items():
        rows = [r for r in all_rows if r.event_type in ("click", "error")]
        while rows:
            group = [r for r in rows if r.t - rows[0].t <= 2 * HOUR]
            want.append((user, group[0].event_id, group[0].t, max(group, key=lambda r: r.value).event_id, len(group)))
            rows = rows[len(group) :]
    assert got(spark, "fused_events") == sorted(want)


def test_precedence_groups(spark: SparkSession, users) -> None:
    order = ["purchase", "error", "click", "view", "signup"]
    want = []
    for user, rows in users.items():
        while rows:
            end = rows[0].t + HOUR + int(rows[0].value * 60_000_000)
            group = [r for r in rows if r.t <= end + HOUR // 2]
            best = min(group, key=lambda r: order.index(r.event_type))
            want.append((user, best.event_id, len(group), tuple([r.event_id for r in group if r is not best][:2])))
            rows = rows[len(group) :]
    assert got(spark, "precedence_groups") == sorted(want)


def test_diverse_picks(spark: SparkSession, users) -> None:
    want = []
    for user, rows in users.items():
        picked: list = []
        for r in sorted(rows, key=lambda r: (-r.value, r.event_id)):
            if len(picked) < 6 and sum(p.event_type == r.event_type for p in picked) < 2 and all(abs(p.t - r.t) >= DAY for p in picked):
                picked.append(r)
                want.append((user, r.event_id, len(picked)))
    assert got(spark, "diverse_picks") == sorted(want)


def test_boundary_windows_cases() -> None:
    """Letters in time order: s starts, e ends, x others, each a unit after the one before; a dot is a long gap."""

    def run(signs: str) -> list[tuple]:
        step, time, out = fold.windows("s", "e", 10)(), 0, []
        for c in signs:
            time += 100 if c == "." else 1
            if c != ".":
                out += step((time, c))
        return out + step(None)

    assert run("") == []
    assert run("sxe") == [(1, 3, "complete")]
    assert run("xxsxe") == [(1, 2, "fragment"), (3, 5, "complete")]
    assert run("sxsxe") == [(1, 2, "partial"), (3, 5, "complete")]
    assert run("sx.xe") == [(1, 2, "partial"), (103, 104, "fragment")]
    assert run("sxexx") == [(1, 3, "complete")]
    assert run("xx") == [(1, 2, "fragment")]
    assert run("sx") == [(1, 2, "partial")]


def test_boundary_windows_never_overlap(spark: SparkSession, users) -> None:
    windows = got(spark, "boundary_windows")
    for (u, s, e, _), (u2, s2, _, _) in zip(windows, windows[1:]):
        assert s <= e and (u != u2 or e <= s2)
    ends = {(u, r.t) for u, rows in users.items() for r in rows if r.event_type == "purchase"}
    starts = {(u, r.t) for u, rows in users.items() for r in rows if r.event_type == "signup"}
    complete = [w for w in windows if w[3] == "complete"]
    assert complete and all((u, s) in starts and (u, e) in ends for u, s, e, _ in complete)


def test_lifecycles(spark: SparkSession, users) -> None:
    want = []
    for user, rows in users.items():
        for i, r in enumerate(rows):
            if r.event_type != "purchase":
                continue
            armed = [j for j in range(i) if rows[j].event_type == "signup"]
            if not armed:
                continue
            between = rows[armed[-1] + 1 : i]
            pending = [k for k, x in enumerate(between) if x.event_type == "view" and x.value >= 5]
            runs, run = [], []
            for x in between:
                run = [*run, x.t] if x.event_type == "error" else []
                runs.append(run)
            lost = [k for k, run in enumerate(runs) if run and run[-1] - run[0] > DAY]
            ended = [k for k, x in enumerate(between) if x.event_type == "purchase" and pending and pending[0] < k]
            if pending and not lost and not ended:
                want.append((user, rows[armed[-1]].t, between[pending[0]].t, r.t))
    assert want and got(spark, "lifecycles") == sorted(want)


def test_lifecycle_is_idle_after_missing_readings() -> None:
    def run(*rows: tuple) -> list[tuple]:
        step = fold.lifecycle(("arm", "score", "end", "none"), 5.0, 10)()
        return [x for row in [*rows, None] for x in step(row)]

    assert run((0, "arm", 1.0), (1, "none", None), (11, "none", None), (12, "score", 5.0), (13, "end", 0.0)) == [(0, 12, 13)]
    assert run((0, "arm", 1.0), (1, "none", None), (12, "none", None), (13, "score", 5.0), (14, "end", 0.0)) == []
    assert run((0, "arm", 1.0), (1, "score", 4.9), (2, "score", None), (3, "end", 0.0)) == []
    assert run((0, "arm", 1.0), (1, "score", 9.0), (2, "arm", 0.0), (3, "end", 0.0)) == []
