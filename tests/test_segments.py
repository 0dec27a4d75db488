"""Round windows, lives, numbered spans, feeds, checks and policies against plain Python over whole lists."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import segments

GAP, NUDGE = 10, 1


def plain_windows(rows: list[tuple], until: int) -> Counter:
    """rows of one stretch: (time, kind, usable, preparing, segment, prepared_at). Worked out over lists: windows first, the readings after ends last."""
    order = {"end": 0, "reading": 1, "start": 2}
    rows = sorted((r for r in rows if 0 <= r[0] <= until), key=lambda r: (r[0], order[r[1]], r[4] or ""))
    readings = [r for r in rows if r[1] == "reading"]
    windows: list[dict] = []
    usable = [r[0] for r in readings if r[2]]
    ends = [r[0] for r in rows if r[1] == "end"]
    line = [(r[0], order[r[1]], r) for r in rows if r[1] != "reading"] + [(b[0], 1, (b[0], "gap", a[0])) for a, b in zip(readings, readings[1:], strict=False) if b[0] - a[0] > GAP]
    line.sort(key=lambda x: (x[0], x[1], (x[2][4] or "") if x[2][1] != "gap" else ""))
    active = segment = prepared = None
    cursor = -1

    def window(a: int, b: int, state: str, start: int | None = None, end: int | None = None, reach: int | None = None) -> None:
        windows.append({"a": a if reach is None else min(a, reach), "b": b, "state": state, "start": start, "end": end})

    def founded(t: int) -> int | None:
        return next((u for u in usable if cursor < u < t), None)

    def settle(t: int, stay: bool, before: int | None = None) -> None:
        """Readings from the last end on, up to t, without gap or preparation."""
        last = windows[-1] if windows else None
        if not stay or last is None or last["end"] is None or last.get("settled"):
            if last is not None:
                last["settled"] = True
            return
        last["settled"] = True
        at = last["end"]
        for r in readings:
            if at <= r[0] <= t and r[0] >= last["end"]:
                if r[3] or r[0] - at > GAP and r[0] != at:
                    break
                at = r[0]
        last["b"] = max(last["b"], at)

    for t, _, row in line:
        kind = row[1]
        if kind == "gap":
            before = row[2]
            settle(before, True)
            if active is not None:
                window(active, before if before > active else min(t, active + NUDGE), "partial", active, None, prepared)
                active = segment = prepared = None
            else:
                bare = [u for u in usable if cursor < u <= before and not any(w["a0"] <= u <= w["b0"] if "a0" in w else w["a"] <= u <= w["b"] for w in windows)]
                if bare and not any(w["end"] is not None and w["end"] <= before for w in windows):
                    window(bare[0], min(t, max(before, bare[0] + NUDGE)), "fragment")
            cursor = max(cursor, before)
            continue
        other = active is not None and segment is not None and row[4] is not None and segment != row[4]
        if other:
            window(active, t, "partial", active, None, prepared)
            active = segment = prepared = None
            cursor = max(cursor, t)
        if kind == "start":
            settle(t, True)
            if active is not None and t > active:
                window(active, t, "partial", active, None, prepared)
            elif active is None and row[5] is None and not any(e < t for e in ends) and founded(t) is not None:
                window(founded(t), t, "fragment")
            active, segment, prepared = t, row[4], row[5]
        else:
            begin = founded(t)
            settle(t - 1, not (active is None and begin is not None and not other))
            if other:
                window(t - NUDGE, t, "partial", None, t)
            elif active is not None and t > active:
                window(active, t, "complete", active, t, prepared)
            elif active is None and begin is not None:
                window(begin, t, "fragment", None, t)
            active = segment = prepared = None
        cursor = t
    rest = [u for u in usable if u > cursor]
    settle(until, not (active is None and rest))
    if active is not None and until > active:
        window(active, until, "partial", active, None, prepared)
    elif active is None and rest:
        window(rest[0], min(until, max(rest[-1], rest[0] + NUDGE)), "fragment")
    return Counter((w["a"], w["b"], w["state"], w["start"], w["end"]) for w in windows if w["b"] > w["a"])


def stretch(rng: random.Random, n: int) -> list[tuple]:
    """Readings every few ticks, now and then a boundary; a preparation comes before some starts."""
    t, out = rng.randrange(4), []
    for _ in range(n):
        t += rng.choice([2, 3, 5, 7, 10, 11, 25])
        x = rng.random()
        if x < 0.15:
            prepared = rng.random() < 0.5
            if prepared:
                out.append((t, "reading", False, True, None, None))
            out.append((t + 4, "start", None, None, rng.choice([None, "p", "q"]), t if prepared else None))
            t += 4
        elif x < 0.3:
            out.append((t, "end", None, None, rng.choice([None, "p", "q"]), None))
        else:
            out.append((t, "reading", rng.random() < 0.6, False, None, None))
    return out


WINDOWS = "k long, t long, kind string, usable boolean, preparing boolean, segment string, prepared_at long, until long"


def test_windows_equal_plain_python(spark: SparkSession) -> None:
    rng = random.Random(2)
    by_key = {k: stretch(rng, rng.choice([1, 3, 8, 20, 60])) for k in range(120)}
    until = {k: max(r[0] for r in own) + rng.choice([-5, 0, 3, 30]) for k, own in by_key.items()}
    rows = [(k, *r, max(0, until[k])) for k, own in by_key.items() for r in own]
    rng.shuffle(rows)
    got = Counter(map(tuple, segments.round_windows(spark.createDataFrame(rows, WINDOWS), ["k"], "t", "kind", GAP, NUDGE, "until", "k long").drop("part").collect()))
    want: Counter = Counter()
    for k, own in by_key.items():
        want.update({(k, *w): n for w, n in plain_windows(own, max(0, until[k])).items()})
    wrong = {k[0] for k in ((got - want) + (want - got))}
    assert not wrong, [(sorted(by_key[k]), until[k], [g for g in got if g[0] == k], [w for w in want if w[0] == k]) for k in sorted(wrong, key=lambda k: len(by_key[k]))[:1]]
    assert {k[3] for k in want} == {"partial", "fragment", "complete"}


def test_breaks_part_a_recording(spark: SparkSession) -> None:
    r = lambda t, usable=True: (1, t, "reading", usable, False, None, None, 60)
    rows = [r(0), (1, 5, "start", None, None, None, None, 60), r(8), r(16), (1, 20, "break", None, None, None, None, 60), r(20), r(24), (1, 28, "end", None, None, None, None, 60), (1, 30, "start", None, None, None, None, 60), r(33), r(42), r(51), r(60)]
    got = {tuple(x)[1:] for x in segments.round_windows(spark.createDataFrame(rows, WINDOWS), ["k"], "t", "kind", GAP, NUDGE, "until", "k long").collect()}
    assert got == {(0, 0, 5, "fragment", None, None), (0, 5, 20, "partial", 5, None), (1, 20, 28, "fragment", None, 28), (1, 30, 60, "partial", 30, None)}


# --- lives


def plain_lives(rows: list[tuple], merge: int, samples: int, span: int, need: bool) -> Counter:
    """rows of one part: (t, kind, source)."""
    out: Counter = Counter()
    times = lambda kind: sorted(t for t, k, _ in rows if k == kind)
    live, restarts, revives = times("live"), times("restart"), times("revive")
    losses: list[list] = []
    for t, _, source in sorted(r for r in rows if r[1] == "candidate"):
        if losses and t - losses[-1][0] <= merge:
            losses[-1][1].add(source)
            out[("merged", t, source, None)] += 1
            continue
        how = "first"
        if losses:
            last = losses[-1]
            between = [x for x in live if last[0] + merge < x < t]
            if any(last[0] < x < t for x in restarts):
                how = "restart"
            elif len(between) < samples or between[-1] - between[0] < span:
                last[1].add(source)
                out[("duplicate", t, source, None)] += 1
                continue
            elif need and not any(last[0] < x < t for x in revives):
                out[("superseded", last[0], ",".join(sorted(last[1])), None)] += 1
                last[0], last[1] = t, {source}
                continue
            else:
                how = "revive"
        losses.append([t, {source}, how])
    out.update(("kept", t, ",".join(sorted(sources)), how) for t, sources, how in losses)
    return out


@pytest.mark.parametrize("need", [True, False])
def test_lives_equal_plain_python(spark: SparkSession, need: bool) -> None:
    rng = random.Random(need)
    rows = [("m", part, rng.randrange(300), rng.choices(["candidate", "live", "restart", "revive"], [4, 10, 1, 1])[0], rng.choice("xyz"), False) for part in range(40) for _ in range(rng.randrange(1, 40))]
    lost = [("m", None, 5, "candidate", "x", False), ("m", 1, 400, "candidate", "hud", True), ("m", None, 6, "live", None, False)]
    df = spark.createDataFrame(rows + lost, "k string, part long, t long, kind string, source string, unfit boolean").repartition(4)
    got = Counter(tuple(r)[1:] for r in segments.reconciled_lives(df, ["k"], "part", "t", 8, 2, 5, need, "k string").collect())
    want = Counter({(None, "outside_round", 5, "x", None): 1, (1, "while_spectating", 400, "hud", None): 1})
    for part in range(40):
        want.update({(part, *e): n for e, n in plain_lives([r[2:5] for r in rows if r[1] == part], 8, 2, 5, need).items()})
    assert got == want
    assert {e[1] for e in want} >= {"kept", "merged", "duplicate"} | ({"superseded"} if need else set())


@pytest.mark.parametrize(("second", "what"), [(8, "merged"), (9, "duplicate")])
def test_merge_window_is_inclusive(spark: SparkSession, second: int, what: str) -> None:
    df = spark.createDataFrame([("m", 1, 0, "candidate", "x", False), ("m", 1, second, "candidate", "y", False)], "k string, part long, t long, kind string, source string, unfit boolean")
    got = segments.reconciled_lives(df, ["k"], "part", "t", 8, 2, 5, True, "k string").collect()
    assert sorted(r.what for r in got) == sorted([what, "kept"]) and [r.sources for r in got if r.what == "kept"] == ["x,y"]


# --- numbers


def test_numbered_rounds_equal_plain_python(spark: SparkSession) -> None:
    rng = random.Random(21)
    states, events = [], []
    for k in range(30):
        n = 1
        for t in range(0, 200, 2):
            n += rng.random() < 0.06
            states.append((k, t, rng.choice([n, n, n, None, rng.randrange(1, 9)])))
        events += [(k, rng.randrange(200), rng.choice(["start", "end"])) for _ in range(rng.randrange(12))]
    got = {(r.k, r.number): (r.start, r.end) for r in segments.numbered_rounds(spark.createDataFrame(states, "k long, t long, n long"), spark.createDataFrame(events, "k long, t long, kind string"), ["k"], "t", "n", 3).collect()}
    want = {}
    for k in range(30):
        own = [(t, n) for kk, t, n in states if kk == k and n is not None]
        counts = Counter(n for _, n in own)
        first, last, current = {}, {}, 0
        for t, n in own:
            if counts[n] >= 3 and n >= current:
                current = n
                first.setdefault(n, t)
                last[n] = t
        numbers = sorted(first)
        start = {}
        for i, n in enumerate(numbers):
            floor = last[numbers[i - 1]] if i else -1e9
            start[n] = max((t for kk, t, e in events if kk == k and e == "start" and floor < t <= first[n]), default=first[n])
        for i, n in enumerate(numbers):
            following = start[numbers[i + 1]] if i + 1 < len(numbers) else None
            limit = 1e9 if following is None else following
            want[k, n] = (start[n], min((t for kk, t, e in events if kk == k and e == "end" and start[n] < t <= limit), default=following))
    assert got == want


# --- feeds


def test_feed_equals_plain_python(spark: SparkSession) -> None:
    rng = random.Random(31)
    entries = [(k, 1000 * k + i, rng.randrange(60), rng.choice(["elimination", "highlight", "other"]), rng.choice("ab"), 50) for k in range(25) for i in range(rng.randrange(14))]
    units = [(k, 1000 * k + i, low, low + rng.randrange(4), rng.choice("ab")) for k in range(25) for i in range(rng.randrange(9)) for low in [rng.randrange(55)]]
    a = spark.createDataFrame(entries, "k long, id long, time long, kind string, team string, last long")
    b = spark.createDataFrame(units, "k long, id long, low long, high long, team string")
    got = Counter(map(tuple, segments.assigned_feed(a, b, ["k"], 3, ["elimination", "highlight"], "k long").collect()))
    want: Counter = Counter()
    for k in range(25):
        mine = sorted((e for e in entries if e[0] == k), key=lambda e: (e[2], e[1]))
        used = set()
        for name in ("elimination", "highlight"):
            for u in sorted((u for u in units if u[0] == k), key=lambda u: (u[3], u[2], u[1])):
                for e in mine:
                    if e[1] not in used and e[3] == name and e[4] == u[4] and u[2] - 3 <= e[2] <= u[3] + 3:
                        used.add(e[1])
                        want[(k, u[1], e[1], name)] += 1
                        break
        want.update((k, None, e[1], "phantom") for e in mine if e[1] not in used and e[2] <= 50)
    assert got == want and {x[3] for x in want} == {"elimination", "highlight", "phantom"}


# --- checks


@pytest.mark.parametrize(("values", "verdict"), [([], "undetermined"), ([95.0], "correct"), ([94.9], "undetermined"), ([90.0], "undetermined"), ([89.9], "false"), ([10.0, 96.0], "correct")])
def test_verdict_by_bounds(spark: SparkSession, values: list[float], verdict: str) -> None:
    items = spark.createDataFrame([("m", 1, 100, "start")], "k string, id long, t long, kind string")
    signals = spark.createDataFrame([("m", 100 + 5 * (i % 2), "timer", v) for i, v in enumerate(values)] + [("m", 106, "timer", 99.0), ("m", 99, "timer", 99.0), ("n", 101, "timer", 99.0), ("m", 101, "other", 99.0)], "k string, t long, signal string, value double")
    checks = [segments.Check("start", "timer", 0, 5, 95.0, 90.0)]
    assert [r.verdict for r in segments.verified_items(items, signals, ["k"], "id", "t", checks, 10).collect()] == [verdict]


def test_verdict_by_absence_and_abstention(spark: SparkSession) -> None:
    items = spark.createDataFrame([("m", 1, 100, "end"), ("m", 2, 200, "end"), ("m", 3, None, "end"), ("m", 4, 100, "what")], "k string, id long, t long, kind string")
    signals = spark.createDataFrame([("m", 130, "active", None), ("m", 100, "active", None)], "k string, t long, signal string, value double")
    got = {r.id: r.verdict for r in segments.verified_items(items, signals, ["k"], "id", "t", [segments.Check("end", "active", 1, 50)], 16).collect()}
    assert got == {1: "false", 2: "correct", 3: "abstained", 4: "abstained"}


# --- policies


def test_context_assessment(spark: SparkSession) -> None:
    policies = spark.createDataFrame([("r1", True, True, True), ("r2", False, False, False)], "rule_id string, needs_previous boolean, needs_timeline boolean, windowed boolean")
    packages = spark.createDataFrame([("p1", 1, False, "complete"), ("p2", 2, False, None), ("p3", 2, True, "partial")], "package_id string, number int, has_previous boolean, timeline string")
    scopes = spark.createDataFrame([(r, p, w) for r in ("r1", "r2") for p, w in (("p1", True), ("p2", False), ("p3", None))], "rule_id string, package_id string, whole_round boolean")
    got = {(r.rule_id, r.package_id): (r.missing_context, r.round_timeline, r.shortfall, r.time_scope) for r in segments.context_assessment(policies, packages, scopes).collect()}
    assert got == {
        ("r1", "p1"): ([], "complete", False, "whole_round_fallback"), ("r1", "p2"): (["previous_round"], "absent", True, "event_windows"), ("r1", "p3"): ([], "partial", True, "unknown"),
        ("r2", "p1"): ([], "complete", False, "whole_round_by_policy"), ("r2", "p2"): ([], "absent", False, "event_windows"), ("r2", "p3"): ([], "partial", False, "unknown"),
    }


def test_provisional_admission_lists_every_reason(spark: SparkSession) -> None:
    policies = spark.createDataFrame([("ok", "moment", True, False, False, False), ("bad", "match", False, True, True, True), ("facts", "moment", True, False, False, False)], "rule_id string, level string, windowed boolean, needs_timeline boolean, needs_previous boolean, aggregated boolean")
    registry = spark.createDataFrame([("ok", ["x"], None), ("facts", ["score", "alive", "x"], ["round_end"])], "rule_id string, fact_keys array<string>, trigger_types array<string>")
    got = {r.rule_id: (r.admissible, r.reasons, r.match_aggregated) for r in segments.provisional_admission(policies, registry, ["moment"], ["alive", "score"], ["round_end"]).collect()}
    assert got == {"ok": (True, [], False), "bad": (False, ["not_in_registry", "level", "no_window", "round_timeline", "previous_round", "match_context"], True), "facts": (False, ["round_fact:alive", "round_fact:score", "round_trigger:round_end"], False)}
    gate = segments.timeline_gate(spark.createDataFrame([(1, True, "complete"), (2, True, None), (3, False, None), (4, None, "x")], "i int, n boolean, s string"), F.col("n"), F.col("s"))
    assert {r.i for r in gate.filter("gated").collect()} == {2}
