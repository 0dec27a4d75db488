"""Retraction, timers, fixpoints, graphs, neighbours, picks, caps, journals and swaps against plain Python."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import admission, components, fixpoint, nearest, picks, retract, timers, transducer
from tallyloom.operators.transducer import Ask
from tallyloom.sources import swap

# --- retraction


def machine_rows(rng: random.Random, n: int) -> list[tuple]:
    out, t = [], defaultdict(int)
    for i in range(n):
        k = rng.choice(["hot", "hot", "small", None])
        t[k] += rng.choice([0, 1, 4])
        out.append((k, t[k], i, rng.choice("aabx")))
    return out


def plain_latch(rows: list[tuple]) -> Counter:
    out: Counter = Counter()
    machine = transducer.latch("a", "b", 2)
    for key in {r[0] for r in rows}:
        registers = machine.start
        for _, t, _, kind in sorted(r for r in rows if r[0] == key) if key is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]):
            registers, found = machine.step(registers, (t, kind), Ask())
            out.update((key, *x) for x in found)
        out.update((key, *x) for x in machine.finish(registers))
    return out


def retracting(root: Path) -> retract.RetractingFold:
    return retract.RetractingFold(str(root), ["k"], "t", "i", ["t", "kind"], transducer.latch("a", "b", 2), 10, "start long, end long")


def test_shuffled_and_late_rows_converge(spark: SparkSession, tmp_path: Path) -> None:
    rng = random.Random(1)
    rows = machine_rows(rng, 240)
    late = rng.sample(rows, len(rows))
    fold, seen = retracting(tmp_path / "store"), []
    for k in range(4):
        part = late[k * 60 : (k + 1) * 60]
        seen += part
        fold.arrive(spark.createDataFrame(part, "k string, t long, i long, kind string"), k)
        assert Counter(map(tuple, fold.result(spark).collect())) == plain_latch(seen), k
    log = fold.changes(spark)
    assert log.filter("n < 0").count() > 0
    before = Counter(map(tuple, log.select("k", "start", "end", "n", "batch").collect()))
    fold.arrive(spark.createDataFrame(late[180:], "k string, t long, i long, kind string"), 3)  # a repeated batch changes nothing
    assert Counter(map(tuple, fold.changes(spark).select("k", "start", "end", "n", "batch").collect())) == before


def test_late_row_touches_only_blocks_whose_beginning_changes(spark: SparkSession, tmp_path: Path) -> None:
    rows = [("k", t, t, "b" if t % 5 == 4 else "a") for t in range(200)]
    fold = retracting(tmp_path / "store")
    fold.arrive(spark.createDataFrame(rows, "k string, t long, i long, kind string"), 0)
    fold.arrive(spark.createDataFrame([("k", 52, 1000, "b")], "k string, t long, i long, kind string"), 1)
    assert spark.read.parquet(str(tmp_path / "store/dirty/batch=1")).count() == 1
    assert Counter(map(tuple, fold.result(spark).collect())) == plain_latch([*rows, ("k", 52, 1000, "b")])


def test_rows_that_a_machine_passes_over_are_not_folded(spark: SparkSession, tmp_path: Path) -> None:
    rows = [("k", t, t, kind) for t, kind in enumerate("xaxxaxbxxaax")] + [("other", 3, 50, "x"), (None, 4, 51, "b")]
    fold = retracting(tmp_path / "store")
    fold.arrive(spark.createDataFrame(rows, "k string, t long, i long, kind string"), 0)
    assert Counter(map(tuple, fold.result(spark).collect())) == plain_latch(rows)
    assert {r.c1 for r in spark.read.parquet(str(tmp_path / "store/rows")).collect()} == {"a", "b"}
    never = retract.RetractingFold(str(tmp_path / "never"), ["k"], "t", "i", ["t", "kind"], transducer.latch("a", "b", 0), 10, "start long, end long")
    never.arrive(spark.createDataFrame(rows[-2:-1], "k string, t long, i long, kind string"), 0)
    assert [tuple(r) for r in never.result(spark).collect()] == [("other", None, None)]


# --- timers


def plain_encounters(rows: list[tuple[int, str]], lost: int, quiet: int, burst: int, again: int, hold: int) -> Counter:
    """The same events, worked out kind by kind over whole lists between cuts."""
    out: Counter = Counter()
    parts: list[list[tuple[int, str]]] = [[]]
    closed = []
    for t, kind in rows:
        if kind == "cut":
            closed.append(t)
            parts.append([])
        else:
            parts[-1].append((t, kind))
    for p, part in enumerate(parts):
        end = closed[p] if p < len(closed) else math.inf  # a cut silences what was due at its time or later

        def runs(times: list[int], gap: int) -> list[list[int]]:
            groups: list[list[int]] = []
            for t in times:
                if groups and t - groups[-1][-1] <= gap:
                    groups[-1].append(t)
                else:
                    groups.append([t])
            return groups

        presences = [(g[0], g[-1]) for g in runs([t for t, k in part if k == "seen"], lost)]
        for a, b in presences:
            out[("spotted", a, a, None)] += 1
            if b + lost < end:
                out[("lost", b, b + lost, None)] += 1
        for g in runs([t for t, k in part if k == "fire"], burst):
            if g[-1] + burst < end:
                out[("burst", g[0], g[-1], len(g))] += 1
        engaged = over = active = None
        present = None
        for t, k in [*part, (end, "end")]:
            if engaged is not None and active + quiet < t:
                over = active + quiet
                out[("over", engaged, over, None)] += 1
                engaged = None
            if present is not None and present + lost < t:
                present = None
            if k == "seen":
                present = t
            if k == "fire" and present is not None and engaged is None:
                engaged = t
                out[("engaged", t, t, None)] += 1
                if over is not None and t - over <= again:
                    out[("again", over, t, None)] += 1
            if k in ("seen", "fire"):
                active = t
        still = None
        for t, k in [*part, (end, "end")]:
            if k == "still" and still is None:
                still = t
            elif k in ("move", "end") and still is not None:
                if still + hold < t:
                    out[("held", still, still + hold, None)] += 1
                    if k == "move":
                        out[("left", still, t, None)] += 1
                still = None
    return out


SPANS = {"lost": 5, "quiet": 10, "burst": 3, "again": 30, "hold": 8}


def encounter_rows(rng: random.Random, n: int) -> list[tuple[int, str]]:
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([1, 1, 2, 3, 5, 6, 9, 15])
        out.append((t, rng.choice(["seen", "seen", "fire", "fire", "still", "move", "cut"] if rng.random() < 0.2 else ["seen", "fire", "still", "move"])))
    return out


def test_timers_fire_between_rows(spark: SparkSession) -> None:
    rng = random.Random(4)
    by_key = {k: encounter_rows(rng, rng.randrange(1, 120)) for k in range(30)}
    rows = [(k, t, i, kind) for k, own in by_key.items() for i, (t, kind) in enumerate(own)]
    rng.shuffle(rows)
    machine = timers.encounters("seen", "fire", "still", "move", "cut", **SPANS)
    got = timers.timed_fold(spark.createDataFrame(rows, "k long, t long, i long, kind string"), ["k"], "t", "i", ["kind"], machine, "k long, what string, since long, at long, n long")
    want = Counter({(k, *e): n for k, own in by_key.items() for e, n in plain_encounters(own, **SPANS).items()})
    assert Counter(map(tuple, got.collect())) == want
    assert {e[1] for e in want} == {"spotted", "lost", "burst", "engaged", "over", "again", "held", "left"}


@pytest.mark.parametrize(("second", "events"), [(4, 1), (5, 1), (6, 2)])
def test_row_at_a_timers_time_comes_first(second: int, events: int) -> None:
    machine, state, due = timers.encounters("seen", "fire", "still", "move", "cut", **SPANS), {}, {}
    out = []
    for t in (0, second):
        out += timers.fire(machine, state, due, t) + machine.row(state, due, (t, "seen"))
    assert [e[0] for e in out].count("spotted") == events


# --- fixpoint


def test_fixpoint_equals_a_plain_loop_and_shrinks(spark: SparkSession) -> None:
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["a", "b", None, None, None, None])) for k in range(40) for i in range(rng.randrange(1, 25))]
    rule = lambda w: {"x": F.coalesce("x", F.lag("x").over(w))}
    got = fixpoint.to_fixpoint(spark.createDataFrame(rows, "k long, i long, x string"), ["k"], ["i"], ["x"], [rule], 100)
    want = {}
    for k in range(40):
        own = [x for kk, _, x in rows if kk == k]
        while True:
            old = list(own)
            own = [x if x is not None else own[i - 1] if i else None for i, x in enumerate(own)]
            own = [x if x is not None else own[i + 1] if i + 1 < len(own) else None for i, x in enumerate(own)]
            if own == old:
                break
        want |= {(k, i): x for i, x in enumerate(own)}
    assert {(r.k, r.i): r.x for r in got.rows.collect()} == want
    assert got.done and got.sizes[0] == len(rows) and all(a >= b for a, b in zip(got.sizes, got.sizes[1:], strict=False)) and got.sizes[-1] < got.sizes[0]
    short = fixpoint.to_fixpoint(spark.createDataFrame([(1, 0, "a"), *[(1, i, None) for i in range(1, 9)]], "k long, i long, x string"), ["k"], ["i"], ["x"], [rule], 3)
    assert not short.done and short.rows.count() == 9 and short.rows.filter("x = 'a'").count() == 4


def test_fixpoint_works_many_rounds_in_one_job(spark: SparkSession) -> None:
    rule = lambda w: {"x": F.coalesce("x", F.lag("x").over(w))}
    long = fixpoint.to_fixpoint(spark.createDataFrame([(1, 0, "a"), *[(1, i, None) for i in range(1, 30)]], "k long, i long, x string"), ["k"], ["i"], ["x"], [rule], 100, both=False)
    assert long.done and long.rows.filter("x = 'a'").count() == 30 and len(long.sizes) == 6  # 1, 2, 4, 8, 8 and 8 rounds for 29 and one to see it


# --- graphs


def union_find(edges: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("name", ["random", "star", "path", "loops", "empty"])
def test_components_equal_union_find(spark: SparkSession, name: str) -> None:
    rng = random.Random(name)
    edges = {
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)],
        "star": [(7000, i) if i % 2 else (i, 7000) for i in range(3000)] + [(i, i + 1) for i in range(9000, 9100)],
        "path": rng.sample([(i, i + 1) for i in range(130)], 130),
        "loops": [(5, 5), (1, 2), (2, 1), (2, 1), (-3, 9)],
        "empty": [],
    }[name]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == union_find(edges)


def test_longest_chain_of_each_component(spark: SparkSession) -> None:
    rng = random.Random(8)
    tick = {i: rng.randrange(1000) for i in range(120)}
    edges = [(a, b) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(110)) if tick[a] < tick[b]] + [(200 + i, 201 + i) for i in range(60)]
    tick |= {200 + i: 10 * i for i in range(61)}
    best: dict[int, int] = {}
    for a, b in sorted(edges, key=lambda e: tick[e[1]]):
        best[b] = max(best.get(b, 0), best.get(a, 0) + tick[b] - tick[a])
    groups = union_find(edges)
    want = Counter()
    for x, c in groups.items():
        want[c] = max(want[c], best.get(x, 0))
    got = components.longest_chains(spark.createDataFrame(edges, "a long, b long"), "a", "b", spark.createDataFrame(list(tick.items()), "n long, t long"), "n", "t")
    assert {r.component: (r.nodes, r.longest) for r in got.collect()} == {c: (sum(g == c for g in groups.values()), want[c]) for c in set(groups.values())}
    with pytest.raises(ValueError, match="backwards"):
        components.longest_chains(spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b", spark.createDataFrame([(1, 5), (2, 3)], "n long, t long"), "n", "t")


def test_components_of_neighbouring_edges_need_no_rounds(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Edges that come together are settled in their task; only what lies across blocks goes through stars."""
    rng = random.Random(31)
    edges = [(50 * k + i, 50 * k + i + 1) for k in rng.sample(range(60), 60) for i in range(40)]
    handed, inner = [], components._starred

    def counted(rows, small):
        handed.append(rows.count())
        return inner(rows, small)

    monkeypatch.setattr(components, "_starred", counted)
    rows = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    assert {r.node: r.component for r in components.components(rows, "a", "b").collect()} == union_find(edges)
    assert not handed
    monkeypatch.setattr(components, "BLOCK", 100)
    assert {r.node: r.component for r in components.components(rows, "a", "b").collect()} == union_find(edges)
    assert handed and max(handed) <= 2 * len(edges) // 100


def plain_chains(edges: list[tuple], tick: dict) -> dict:
    """component: nodes with a time, and the longest span, by passes over all edges until nothing changes."""
    best = dict(tick)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a in tick and b in tick and best[a] < best[b]:
                best[b], moved = best[a], True
    want: dict = {}
    for x, c in union_find(edges).items():
        if x in tick:
            n, span = want.get(c, (0, 0))
            want[c] = (n + 1, max(span, tick[x] - best[x]))
    return want


@pytest.mark.parametrize("block", [7, 1 << 18])
@pytest.mark.parametrize("name", ["random", "giant", "ties", "texts"])
def test_longest_chains_across_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, name: str, block: int) -> None:
    """Any size of block gives the result of passes over all edges: one component over many blocks, edges within a time, nodes without a time."""
    monkeypatch.setattr(components, "BLOCK", block)
    rng = random.Random(name)
    n = 240
    tick = {i: rng.randrange(1000 if name != "ties" else 4) for i in range(n)}
    if name == "giant":
        way = rng.sample(range(n), n)
        tick = {x: 5 * i for i, x in enumerate(way)}
        edges = [*zip(way, way[1:], strict=False), *[(way[i], way[j]) for i, j in (sorted(rng.sample(range(n), 2)) for _ in range(40))]]
    else:
        edges = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(420 if name == "ties" else 260)) if tick[a] <= tick[b]]
    edges += rng.sample(edges, 20) + [(900, 3), (3, 901), (902, 903)]
    rng.shuffle(edges)
    kind = "long"
    if name == "texts":
        kind, edges, tick = "string", [(f"n{a}", f"n{b}") for a, b in edges], {f"n{x}": t for x, t in tick.items()}
    got = components.longest_chains(spark.createDataFrame([*edges, (None, edges[0][0])], f"a {kind}, b {kind}"), "a", "b", spark.createDataFrame([*tick.items(), ("n902" if kind == "string" else 902, None)], f"n {kind}, t long"), "n", "t")
    assert {r.component: (r.nodes, r.longest) for r in got.collect()} == plain_chains(edges, tick)


def test_one_path_over_many_blocks_needs_few_rounds(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A block's ancestor is looked up again when it or the block's nodes changed, so that rounds grow with the logarithm of the blocks."""
    monkeypatch.setattr(components, "BLOCK", 20)
    way = random.Random(17).sample(range(600), 600)
    edges = spark.createDataFrame(list(zip(way, way[1:], strict=False)), "a long, b long")
    got = components.longest_chains(edges, "a", "b", spark.createDataFrame([(x, 5 * i) for i, x in enumerate(way)], "n long, t long"), "n", "t", most=8)
    assert [tuple(r) for r in got.collect()] == [(0, 600, 5 * 599)]


def test_longest_chain_along_a_comb_needs_no_rounds(spark: SparkSession) -> None:
    """Each node of a path has a source of its own, earlier ones on its earlier nodes: a round for each node before, one pass in the order of time now."""
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, i) for i in range(n)]
    tick = {i: 10_000 + i for i in range(n + 1)} | {1000 + i: i for i in range(n)}
    got = components.longest_chains(spark.createDataFrame(edges, "a long, b long"), "a", "b", spark.createDataFrame(list(tick.items()), "n long, t long"), "n", "t", most=5)
    assert [(r.component, r.nodes, r.longest) for r in got.collect()] == [(0, 2 * n + 1, 10_000 + n)]


# --- neighbours


@pytest.mark.parametrize("k", [1, 3, 2000])
def test_nearest_equals_brute_force(spark: SparkSession, k: int) -> None:
    rng = random.Random(k)
    anchors = [(i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(1200)] + [(5000, 900.0, -900.0), (5001, None, 1.0), (5002, float("nan"), 1.0)]
    points = [(i, rng.uniform(-5, 45), rng.uniform(-5, 45)) for i in range(40)] + [(100, 20.0, 20.0), (101, -3000.0, 4000.0), (102, None, 0.0), (103, 1e6, 1e6)]
    got = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(anchors, "anchor long, ax double, ay double"), "p", k, 1.5).collect():
        got[r.p].append((r.rank, r.anchor, r.distance))
    known = [a for a in anchors if a[1] is not None and a[1] == a[1]]
    for p, x, y in points:
        if x is None:
            assert p not in got
            continue
        best = sorted(((x - ax) * (x - ax) + (y - ay) * (y - ay), a) for a, ax, ay in known)[:k]
        assert [(a, pytest.approx(math.sqrt(d))) for d, a in best] == [(a, d) for _, a, d in sorted(got[p])]


def test_nearest_without_anchors(spark: SparkSession) -> None:
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    assert nearest.nearest(points, spark.createDataFrame([], "anchor long, ax double, ay double"), "p", 2, 1.0).count() == 0


@pytest.mark.parametrize(("second", "label"), [(2.9, None), (3.0, None), (3.1, "a")])
def test_unique_nearest_at_its_margin(spark: SparkSession, second: float, label: str | None) -> None:
    anchors = spark.createDataFrame([("a", 1.0, 0.0), ("a", 1.1, 0.0), ("b", second, 0.0)], "label string, ax double, ay double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "p long, x double, y double")
    assert {r.p: r.label for r in nearest.unique_nearest(points, anchors, "p", 5.0, 1.0).collect()} == {1: label, 2: None}


@pytest.mark.parametrize(("radius", "label"), [(1.9, None), (2.0, "a"), (2.1, "a")])
def test_unique_nearest_at_its_radius(spark: SparkSession, radius: float, label: str | None) -> None:
    anchors = spark.createDataFrame([("a", 1.0, 0.0)], "label string, ax double, ay double")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    assert nearest.unique_nearest(points, anchors, "p", radius, 1.0).first().label == label


def test_neighbours_of_copies_and_of_dense_anchors(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Copies of points and anchors meet once, and cells shrink with the anchors' density: what meets doesn't grow with their product."""
    rng = random.Random(21)
    places = [(round(rng.uniform(0, 8), 2), round(rng.uniform(0, 8), 2)) for _ in range(600)]
    anchors = [(c * 600 + i, "abc"[i % 3], *p) for c in range(5) for i, p in enumerate(places)]
    spots = [(rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(30)] + [(60.0, 3.0), (-0.0, 0.0)]
    points = [(c * 32 + i, *p) for c in range(4) for i, p in enumerate(spots)]
    p, a = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(anchors, "anchor long, label string, ax double, ay double")
    met, inner = [], nearest._met

    def counted(*args):
        found, safe = inner(*args)
        met.append(found.count())
        return found, safe

    monkeypatch.setattr(nearest, "_met", counted)
    got = {(r.p, r.rank): (r.anchor, r.distance) for r in nearest.nearest(p, a.drop("label"), "p", 3, 8.0).collect()}
    labels = {r.p: r.label for r in nearest.unique_nearest(p, a, "p", 6.0, 0.05).collect()}
    for i, x, y in points:
        best = sorted(((x - ax) * (x - ax) + (y - ay) * (y - ay), n) for n, _, ax, ay in anchors)[:3]
        assert [got[i, n + 1] for n in range(3)] == [(b, pytest.approx(math.sqrt(d))) for d, b in best]
        by_label = sorted((min(math.sqrt((x - ax) ** 2 + (y - ay) ** 2) for _, m, ax, ay in anchors if m == name), name) for name in "abc")
        assert labels[i] == (by_label[0][1] if by_label[0][0] + 0.05 <= 6 and by_label[1][0] - by_label[0][0] > 0.1 else None)
    assert None in labels.values() and len(set(labels.values())) > 1
    assert sum(met) < 32 * 600


# --- picks


def test_farthest_first_equals_plain_python(spark: SparkSession) -> None:
    rng = random.Random(6)
    rows = [(k, i, rng.uniform(0, 9), float(rng.randrange(5))) for i, k in enumerate(rng.choices([1, None, 2], [6, 2, 1], k=90))]
    got = picks.farthest_first(spark.createDataFrame(rows, "k long, i long, x double, y double"), ["k"], "i", ["x", "y"], 6)
    want = set()
    for k in (1, None, 2):
        own = [r for r in rows if r[0] == k]
        chosen: list[tuple] = []
        near = lambda r: min((math.dist(r[2:], c[2:]) for c in chosen), default=math.inf)  # noqa: B023, E731
        while len(chosen) < min(6, len(own)):
            chosen.append(min((r for r in own if r not in chosen), key=lambda r: (-near(r), r[1])))
        want |= {(k, r[1], p + 1) for p, r in enumerate(chosen)}
        radius = max((near(r) for r in own), default=0)
        centres = {r: min(math.dist(r[2:], c[2:]) for c in chosen) for r in own}
        assert max(centres.values()) == radius
    assert {(r.k, r.i, r.place) for r in got.collect()} == want


def test_largest_gap_is_within_twice_the_best(spark: SparkSession) -> None:
    import itertools

    rng = random.Random(9)
    rows = [(1, i, rng.uniform(0, 100)) for i in range(14)]
    chosen = [r.x for r in picks.farthest_first(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], "i", ["x"], 3).collect()]
    gap = lambda centres: max(min(abs(x - c) for c in centres) for _, _, x in rows)
    assert gap(chosen) <= 2 * min(gap(c) for c in itertools.combinations([r[2] for r in rows], 3)) + 1e-9


def plain_balanced(rows: list[tuple], slots: int, start: int, end: int) -> set:
    """rows: (ident, time, priority)."""
    slots = min(slots, len(rows))
    span = max(end - start, 1)
    strata = defaultdict(list)
    for r in rows:
        strata[max(0, min(slots - 1, (r[1] - start) * slots // span))].append(r)
    chosen = []
    for b in sorted(strata):
        middle = start + span * (2 * b + 1) / (2 * slots)
        chosen.append(min(strata[b], key=lambda r: (-r[2], abs(r[1] - middle), r[1], r[0])))
    while len(chosen) < slots:
        chosen.append(min((r for r in rows if r not in chosen), key=lambda r: (-r[2], -min(abs(r[1] - c[1]) for c in chosen), r[1], r[0])))
    return {(r[0], p + 1) for p, r in enumerate(chosen)}


def test_balanced_picks_equal_plain_python(spark: SparkSession) -> None:
    rng = random.Random(12)
    rows = [(k, k * 100 + i, 1000 + rng.randrange(200) if rng.random() < 0.6 else 1000 + rng.randrange(2000), rng.randrange(2)) for k in range(12) for i in range(rng.choice([1, 2, 5, 40]))]
    bounds = {k: (min(r[2] for r in rows if r[0] == k), max(r[2] for r in rows if r[0] == k)) for k in range(12)}
    df = spark.createDataFrame([(*r, *bounds[r[0]]) for r in rows], "k long, i long, t long, p int, a long, b long")
    got = {(r.i, r.place) for r in picks.balanced(df, ["k"], "i", "t", "a", "b", "p", 6).collect()}
    assert got == {x for k in range(12) for x in plain_balanced([r[1:] for r in rows if r[0] == k], 6, *bounds[k])}


def test_balanced_picks_of_times_days_apart(spark: SparkSession) -> None:
    rng = random.Random(16)
    rows = [(i, 1_700_000_000_000_000 + i % 2 * 30 * 86_400_000_000 + rng.randrange(86_400_000_000), rng.randrange(2)) for i in range(40)]
    a, b = min(r[1] for r in rows), max(r[1] for r in rows)
    df = spark.createDataFrame([(1, *r, a, b) for r in rows], "k long, i long, t long, p int, a long, b long")
    assert {(r.i, r.place) for r in picks.balanced(df, ["k"], "i", "t", "a", "b", "p", 6).collect()} == plain_balanced(rows, 6, a, b)


def test_representatives_equal_plain_python(spark: SparkSession) -> None:
    rng = random.Random(13)
    rows = [(i, float(rng.randrange(60)), rng.choice("uvwx"), rng.choice("ABCDE"), rng.choice(["m", "n"]), sorted(rng.sample(["c1", "c2", "c3", "c4"], rng.randrange(3))), float(rng.randrange(40)), float(rng.randrange(4, 9))) for i in range(60)]
    rows = [(*r[:7], r[6] + r[7]) for r in rows]
    chosen: list[tuple] = []
    want = []
    while len(chosen) < 9:
        best = None
        for r in rows:
            if r in chosen or sum(c[2] == r[2] for c in chosen) >= 3 or sum(c[3] == r[3] for c in chosen) >= 3 or sum(c[4] == r[4] for c in chosen) >= 5:
                continue
            if any(c[2] == r[2] and min(c[7], r[7]) - max(c[6], r[6]) > 3 for c in chosen):
                continue
            gain = r[1] + 15 * len(set(r[5]) - {x for c in chosen for x in c[5]}) + (30 if all(c[2] != r[2] for c in chosen) else 0) + (20 if all(c[4] != r[4] for c in chosen) else 0)
            best = max(best or (-1, -1, None), (gain, r[0], r), key=lambda x: x[:2])
        if best is None:
            break
        chosen.append(best[2])
        want.append((best[1], len(chosen), best[0]))
    df = spark.createDataFrame(rows, "i long, s double, g string, c string, b string, codes array<string>, a double, z double")
    assert [tuple(r) for r in picks.representatives(df, "i", "s", "g", "c", "b", "codes", "a", "z", 9).orderBy("place").collect()] == want


# --- caps and journals


def test_reservations_equal_plain_python(spark: SparkSession) -> None:
    rng = random.Random(14)
    rows = [(k, i, rng.choice("xyz"), rng.randrange(25), rng.choice([None, 1.0, 2.0, 3.5, -1.0])) for i, k in enumerate(rng.choices([1, 2, None], k=150))]
    caps = [admission.Cap("group", ["g"], 6.0, "v"), admission.Cap("total", [], 15)]
    got = {(r.k, r.i): (r.admitted, r.reason) for r in admission.reservations(spark.createDataFrame(rows, "k long, i long, g string, q long, v double"), ["k"], ["i"], "i", "q", caps, "k long").collect()}
    used, taken, want = Counter(), set(), {}
    for k, i, g, q, v in rows:
        v = v or 0
        reason = "repeated" if (k, q) in taken else "negative" if v < 0 else "group" if used[k, g] + v > 6.0 else "total" if used[k] + 1 > 15 else None
        want[k, i] = (reason is None, reason)
        if reason is None:
            used[k, g] += v
            used[k] += 1
            taken.add((k, q))
    assert got == want and {r for _, r in want.values()} == {None, "repeated", "negative", "group", "total"}


def journal_rows(spark: SparkSession, entries: list[tuple]):
    return spark.createDataFrame([("j", s, kind, data if data is None or isinstance(data, str) else json.dumps(data)) for s, kind, data in entries], "k string, seq long, kind string, data string")


ENTRIES = [
    (1, "register", {"id": "r0", "split": "train"}), (2, "init", {"v": 1}), (3, "init", {}), (4, "register", {"id": "r1", "sha": "s1", "unit": "u1", "split": "train"}),
    (5, "register", {"id": "r1", "sha": "s9", "unit": "u1", "split": "train"}), (6, "register", {"id": "r2", "sha": "s1", "unit": "u2", "split": "test"}),
    (7, "register", {"id": "r2", "sha": "s2", "unit": "u1", "split": "test"}), (8, "register", {"id": "r2", "sha": "s2", "unit": "u2", "split": "none"}),
    (9, "register", {"id": "r2", "sha": "s2", "unit": "u2", "split": "test"}), (10, "learning_split", {"id": "r1", "split": "train"}), (11, "learning_split", {"id": "r1", "split": "test"}),
    (12, "artifact", {"id": "a1", "parents": ["r1"], "units": ["u1"], "kind": "clip"}), (13, "artifact", {"id": "a2", "parents": ["a1", "r2"], "units": ["u1", "u2"], "kind": "clip"}),
    (14, "artifact", {"id": "a2", "parents": ["a1", "r2"], "units": ["u1", "u2"], "kind": "set"}), (15, "artifact", {"id": "a3", "parents": ["zz"], "units": [], "kind": "set"}),
    (16, "artifact", {"id": "a3", "parents": ["r1"], "units": ["u2"], "kind": "set"}), (17, "artifact", {"id": "a1", "parents": ["r1"], "units": ["u1"], "kind": "set"}),
    (18, "status", {"id": "r1", "status": "ok"}), (19, "status", {"id": "zz", "status": "ok"}), (20, "other", {}), (21, "status", "no json"), (25, "status", "[1]"), (22, "exposure", {"id": "r1"}), (22, "exposure", {"id": "r1"}),
    (23, "anchor", {"id": "r2", "sha": "x"}), (24, "anchor", {"id": "r2", "sha": "x"}),
]
REFUSED = {1: "before init", 3: "second init", 5: "id is taken", 6: "same content", 7: "unit in two splits", 8: "unknown split", 11: "unit in two learning splits", 13: "more than one unit", 15: "unknown parent", 16: "units differ from the parents'", 17: "id is taken", 19: "unknown source", 20: "unknown kind other", 21: "data is no JSON", 22: "seq does not rise", 25: "data is no object"}


def test_journal_keeps_invariants_and_replays_from_a_snapshot(spark: SparkSession) -> None:
    handlers = admission.catalog(["train", "test"], ["train", "test"], ["clip"])
    run = lambda rows, snapshot=None: admission.journal(rows, ["k"], "seq", "kind", "data", handlers, "k string", snapshot).collect()
    got = run(journal_rows(spark, ENTRIES).repartition(3))
    assert {r.seq: r.text for r in got if r.what == "refused"} == REFUSED
    (state,) = [r for r in got if r.what == "state"]
    final = json.loads(state.text)
    assert state.seq == 24 and final["sources"]["r1"] == {"unit": "u1", "split": "train", "anchors": [], "exposures": 1, "learning": "train", "status": "ok"}
    assert final["sources"]["r2"]["anchors"] == ["x"] and set(final["artifacts"]) == {"a1", "a2"}
    (middle,) = [r for r in run(journal_rows(spark, ENTRIES[:13])) if r.what == "state"]
    snapshot = spark.createDataFrame([("j", middle.seq, middle.text)], "k string, seq long, text string")
    again = run(journal_rows(spark, ENTRIES), snapshot)
    assert [r.text for r in again if r.what == "state"] == [state.text]
    assert {r.seq for r in again if r.what == "refused"} == {s for s in REFUSED if s > 12}


# --- swaps


def store(spark: SparkSession, path: Path) -> swap.SwapTable:
    return swap.SwapTable(spark, str(path), "match long, round long, id string, score double", ["match", "round"], "id")


def frame(spark: SparkSession, rows: list[tuple]):
    return spark.createDataFrame(rows, "match long, round long, id string, score double")


def test_swap_replaces_whole_partitions_or_nothing(spark: SparkSession, tmp_path: Path) -> None:
    t = store(spark, tmp_path / "t")
    assert t.read().count() == 0
    t.replace(frame(spark, [(1, 1, "a", 0.5), (1, 1, "b", 0.5), (1, None, "c", 0.5), (2, 1, "d", 0.5)]))
    assert t.replace(frame(spark, [(1, 1, "b", 0.9), (1, 1, "e", 0.1)])) == 2  # b stays with its partition, a is gone
    rows = lambda: {tuple(r) for r in t.read().collect()}
    held = {(1, 1, "b", 0.9), (1, 1, "e", 0.1), (1, None, "c", 0.5), (2, 1, "d", 0.5)}
    assert rows() == held
    parents = spark.createDataFrame([(1, 1), (1, None), (2, 1)], "match long, round long")
    rules = {"score out of range": F.col("score").between(0, 1)}
    for bad, reason, n in [
        ([(1, 1, "d", 0.5)], "owned by another partition", 1), ([(1, 1, "x", 0.5), (1, 1, "x", 0.6)], "repeated ident", 1), ([(1, 1, None, 0.5)], "null ident", 1),
        ([(1, 1, "x", 1.5), (1, 1, "y", None)], "score out of range", 2), ([(9, 1, "x", 0.5)], "without a parent", 1),
    ]:
        with pytest.raises(swap.Refused) as refused:
            t.replace(frame(spark, bad), parents=parents, rules=rules)
        assert refused.value.reasons == {reason: n}
        assert rows() == held
    with pytest.raises(swap.Refused) as refused:
        t.replace(frame(spark, [(1, 1, "x", 0.5)]), expected=spark.createDataFrame([("y",)], "id string"))
    assert refused.value.reasons == {"missing": 1, "not expected": 1}
    with pytest.raises(swap.Refused) as refused:
        t.replace(frame(spark, [(1, 1, "x", 0.5)]), partitions=spark.createDataFrame([(2, 1)], "match long, round long"))
    assert refused.value.reasons == {"outside of the partitions": 1}
    t.replace(frame(spark, []), partitions=spark.createDataFrame([(1, None)], "match long, round long"))  # to be left without rows
    assert rows() == held - {(1, None, "c", 0.5)}
    t.compact()
    assert rows() == held - {(1, None, "c", 0.5)}


def test_second_writer_of_a_version_is_told(spark: SparkSession, tmp_path: Path) -> None:
    t = store(spark, tmp_path / "t")
    t.replace(frame(spark, [(1, 1, "a", 0.5)]))
    entry = t.entries()[0]
    with pytest.raises(swap.Conflict):
        t._publish(1, entry)
    assert len(t.entries()) == 1 and {r.id for r in t.read().collect()} == {"a"}
