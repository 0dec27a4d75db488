"""The engine of direct facts: every part at, below and above its thresholds, across breaks, and over shuffled keys."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import SparkSession

from tallyloom.operators import engine
from tallyloom.operators.engine import FIELDS, Limits, sides


def run(*rows: dict) -> list[tuple]:
    """(kind, t, confidence, attributes) of readings that lack nothing but what is given."""
    step = engine.engine(Limits())()
    base = {"view": "live", "confidence": 0.9, "own": True, "trusted": True}
    out = []
    for r in rows:
        out += step(tuple((base | r).get(f) for f in FIELDS))
    return out + step(None)


def kinds(events: list[tuple], *which: str) -> list[tuple]:
    return [(e[0], e[1]) for e in events if e[0] in which]


MENU = {"view": "menu", "timer": 5.0, "score_a": 1, "score_b": 2, "phase": True}
LIVE = {"timer": 99.0, "score_a": 1, "score_b": 2}


def test_start_is_told_with_its_own_time_once_confirmed() -> None:
    events = run({"t": 0.0, **MENU}, {"t": 0.5, **LIVE}, {"t": 1.0, **LIVE, "timer": 98.6})
    (start,) = [e for e in events if e[0] == "round_start"]
    assert start[1] == 0.5 and start[5] == {"segment": "0", "confirmed": "1.000"}


@pytest.mark.parametrize(("change", "found"), [({}, True), ({"timer": 97.4}, False), ({"timer": 97.5}, True), ({"timer": 99.1}, False), ({"score_a": 2}, False), ({"confidence": 0.64}, False), ({"confidence": 0.65}, True), ({"view": "menu"}, False), ({"phase": True}, False), ({"timer": None}, False), ({"timer": float("nan")}, False)])
def test_what_confirms_a_start(change: dict, found: bool) -> None:
    events = run({"t": 0.0, **MENU}, {"t": 0.5, **LIVE}, {"t": 1.0, **LIVE, "timer": 98.6, **change})
    assert bool(kinds(events, "round_start")) == found


@pytest.mark.parametrize(("after", "found"), [(0.04, False), (0.05, True), (1.0, True), (1.01, False)])
def test_confirmation_has_its_time(after: float, found: bool) -> None:
    events = run({"t": 0.0, **MENU}, {"t": 0.5, **LIVE}, {"t": 0.5 + after, **LIVE, "timer": 98.9})
    assert bool(kinds(events, "round_start")) == found


@pytest.mark.parametrize(("rise", "found"), [(3.0, False), (3.1, True)])
def test_a_start_needs_the_timers_jump(rise: float, found: bool) -> None:
    events = run({"t": 0.0, **MENU}, {"t": 0.5, **LIVE, "timer": 5.0 + rise}, {"t": 1.0, **LIVE, "timer": 5.0 + rise})
    assert bool(kinds(events, "round_start")) == found


def test_phase_text_stands_in_for_a_weak_row() -> None:
    weak = {"t": 0.0, **MENU, "confidence": 0.3, "buying": True}
    rest = [{"t": 0.5, **LIVE}, {"t": 1.0, **LIVE, "timer": 98.6}]
    assert not kinds(run(weak, *rest), "round_start")
    assert kinds(run(weak | {"phase_confidence": 0.9}, *rest), "round_start")
    assert not kinds(run(weak | {"phase_confidence": 0.89}, *rest), "round_start")


def test_a_menu_in_play_prepares_no_second_start() -> None:
    played = [{"t": 0.0, **MENU}, {"t": 0.5, **LIVE}, {"t": 1.0, **LIVE, "timer": 98.6}]
    again = [{"t": 1.5, **MENU, "phase": None}, {"t": 2.0, **LIVE}, {"t": 2.5, **LIVE, "timer": 98.6}]
    assert len(kinds(run(*played, *again), "round_start")) == 1
    phases = [{"t": 1.5, **MENU}, {"t": 2.0, **MENU}, {"t": 2.5, **LIVE}, {"t": 3.0, **LIVE, "timer": 98.6}]
    assert len(kinds(run(*played, *phases), "round_start")) == 2


END = {"end_banner": True, "timer_gone": True}


def test_an_end_needs_two_rows_or_joined_evidence() -> None:
    assert kinds(run({"t": 0.0}, {"t": 0.5, **END}), "round_end") == []
    assert kinds(run({"t": 0.0}, {"t": 0.5, **END}, {"t": 1.0, **END}), "round_end") == [("round_end", 0.5)]
    assert kinds(run({"t": 0.0}, {"t": 0.5, **END}, {"t": 1.0}, {"t": 1.5}), "round_end") == []
    joined = {"joined": True, "join_times": [0.1, 0.4], "join_confidence": 0.65}
    assert kinds(run({"t": 0.5, **joined}, {"t": 1.0, **joined}), "round_end") == [("round_end", 0.5)]
    assert not kinds(run({"t": 0.5, **joined, "join_times": [0.1, 0.1]}), "round_end")
    assert not kinds(run({"t": 0.5, **joined, "join_confidence": 0.64}), "round_end")


def test_a_changed_score_counts_only_without_a_join_that_said_no() -> None:
    rows = [{"t": 0.0, "score_a": 1}, {"t": 0.5, "score_a": 2, "end_banner": True}, {"t": 1.0, "score_a": 3, "end_banner": True}]
    assert kinds(run(*rows), "round_end") == [("round_end", 0.5)]
    assert not kinds(run(*[r | {"joined": False} for r in rows]), "round_end")


def test_edges_of_preparation_and_plant() -> None:
    buys = {"buying": True, "stable": True, "before_play": True}
    assert kinds(run({"t": 0.0, **buys}, {"t": 0.5}, {"t": 1.0, **buys}, {"t": 1.5, **buys}), "buy_phase") == [("buy_phase", 1.0)]
    plant = {"planted": "planted", "plant_timer": True, "site": " A "}
    events = run({"t": 0.0, "planted": "none"}, {"t": 0.5, **plant, "plant_confidence": 0.7}, {"t": 1.0, **plant})
    assert [(e[1], e[3], e[5]) for e in events if e[0] == "planted"] == [(0.5, 0.7, {"site": "A"})]
    assert not kinds(run({"t": 0.0}, {"t": 0.5, **plant, "plant_timer": False}), "planted")


def slot(k: int, **rest) -> dict:
    return {"slot": k, "available": None, "charges": None, "confidence": 0.9, "name": None} | rest


def test_slot_changes_take_the_least_confidence() -> None:
    rows = [{"t": 0.0, "slots": [slot(0, charges=2), slot(1, available=True)]}, {"t": 0.5, "slots": [slot(0, charges=1, confidence=0.7), slot(1, available=True), slot(7, charges=1), slot(2)]}, {"t": 1.0, "slots": [slot(0, charges=0, confidence=0.64)]}]
    found = [(e[1], e[5]["slot"], e[3], e[4]) for e in run(*rows) if e[0] == "slot"]
    assert found == [(0.0, "0", 0.9, False), (0.0, "1", 0.9, False), (0.5, "0", 0.7, True)]
    assert not kinds(run(*[r | {"own": False} for r in rows]), "slot")


def test_death_is_latched_until_a_return_a_start_or_a_break() -> None:
    dead = {"report": True, "away": True}
    assert kinds(run({"t": 0.0, **dead}, {"t": 0.5, **dead}, {"t": 1.0}, {"t": 1.5, **dead}), "death") == [("death", 0.0)]
    assert kinds(run({"t": 0.0, **dead}, {"t": 0.5, **dead, "back": True}), "death") == [("death", 0.0), ("death", 0.5)]
    assert kinds(run({"t": 0.0, **dead}, {"t": 1.1, **dead}), "death") == [("death", 0.0), ("death", 1.1)]
    assert kinds(run({"t": 0.0, **dead}, {"t": 1.0, **dead}), "death") == [("death", 0.0)]
    assert kinds(run({"t": 0.0, **dead}, {"t": 0.5, **dead, "cut": True}), "death") == [("death", 0.0), ("death", 0.5)]
    for missing in ({"report": False}, {"away": None}, {"buying": True}, {"death_confidence": 0.64}):
        assert not kinds(run({"t": 0.0, **dead, **missing}), "death")


def effect(name: str, **rest) -> dict:
    return {"effect": name, "effect_from": "enemy", "effect_checked": True} | rest


def test_episodes_have_a_duration_only_if_read_without_a_gap() -> None:
    seconds = lambda *rows: [(e[1], e[5]["effect"], e[5].get("seconds")) for e in run(*rows) if e[0] == "effect"]
    assert seconds({"t": 0.0, **effect("x")}, {"t": 0.5, **effect("x")}, {"t": 1.0}) == [(0.0, "x", "1.0")]
    assert seconds({"t": 0.0, **effect("x")}, {"t": 0.5, "trusted": False}, {"t": 1.0}) == [(0.0, "x", None)]
    assert seconds({"t": 0.0, **effect("x")}, {"t": 0.5, **effect("y")}, {"t": 1.0}) == [(0.0, "x", "0.5"), (0.5, "y", "0.5")]
    assert seconds({"t": 0.0, **effect("x", effect_seconds=4.0)}, {"t": 5.0}) == [(0.0, "x", "4.0")]  # broken off: what was read stays
    assert seconds({"t": 0.0, **effect("x", effect_checked=False, confidence=0.84)}) == []
    assert seconds({"t": 0.0, **effect("x")}) == [(0.0, "x", None)]


@pytest.mark.parametrize(("a", "b", "color", "normal", "want"), [((5, 4), (5, 5), True, None, ("ally", "enemy")), ((5, 5), (5, 4), True, None, ("enemy", "ally")), ((5, 4), (5, 4), True, None, ("unknown", "unknown")), ((5, 3), (5, 5), True, None, ("unknown", "unknown")), ((5, 4), (5, 5), False, True, ("ally", "unknown")), ((5, 4), (5, 5), True, False, ("ally", "unknown")), ((5, 4), (None, None), True, None, ("unknown", "unknown"))])
def test_sides_of_a_new_row(a: tuple, b: tuple, color: bool, normal: bool | None, want: tuple) -> None:
    assert sides(*a, *b, color, normal) == want


def test_keys_are_apart_and_shuffled_rows_give_the_same(spark: SparkSession) -> None:
    rng = random.Random(3)
    names = ["t", "view", "confidence", "phase", "timer", "score_a", "score_b", "end_banner", "timer_gone", "report", "away", "own", "trusted", "effect", "effect_checked"]
    schema = "k string, i long, t double, view string, confidence double, phase boolean, timer double, score_a long, score_b long, end_banner boolean, timer_gone boolean, report boolean, away boolean, own boolean, trusted boolean, effect string, effect_checked boolean"
    rows, want = [], Counter()
    for key in (None, "a", "b", "c"):
        t, step = 0.0, engine.engine(Limits())()
        for i in range(120):
            t += rng.choice([0.25, 0.5, 0.5, 2.0])
            menu = rng.random() < 0.4
            row = (t, "menu" if menu else "live", rng.choice([0.6, 0.7, 0.9, None, float("nan")]), menu or None, 5.0 if menu else 90.0 - t % 2, 1, 1, rng.random() < 0.3, True, rng.random() < 0.4, True, True, True, rng.choice([None, "x", "y"]), rng.random() < 0.5)
            rows.append((key, i, *row))
            clean = dict(zip(names, [None if x != x else x for x in row], strict=True))
            for e in step(tuple(clean.get(f) for f in FIELDS)):
                want[(key, *e[:5], tuple(sorted(e[5].items())))] += 1
        for e in step(None):
            want[(key, *e[:5], tuple(sorted(e[5].items())))] += 1
    rng.shuffle(rows)
    got = engine.direct_facts(spark.createDataFrame(rows, schema).repartition(5), ["k"], "i", "k string").collect()
    assert Counter((*tuple(r)[:6], tuple(sorted(r.attributes.items()))) for r in got) == want
    assert {e[1] for e in want} >= {"round_start", "round_end", "death", "effect"}
    sure = engine.accepted(spark.createDataFrame([(0.65, True), (0.64, True), (0.85, False), (0.84, False), (None, True)], "confidence double, checked boolean"))
    assert sorted(r.confidence for r in sure.collect()) == [0.65, 0.85]
