"""Promotion of boundaries against plain Python with the gates one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

from tallyloom.operators import boundaries
from tallyloom.operators.boundaries import Gates

START = Gates("round_start", "BUY", "ACTIVE", 3.0, 2, 2.0, 3)
END = Gates("round_end", "ACTIVE", "ENDED", 3.0, 2, 2.0, None)
SECONDS = "k long, second long, value string, status string, number long"
TRANSITIONS = "k long, id long, kind string, lower double, upper double, before string, after string, membership array<long>"
ROUNDS = "k long, number long, low long, high long, first long, last long"


def plain_reason(seconds: dict, c: tuple, r: tuple, g: Gates) -> str | None:
    _, _, _, lower, upper, before, after, _ = c
    _, n, _, _, first, last = r
    up, down = int(upper), int(lower)
    other = lambda x: x is not None and x != n
    near = lambda s, d, ok: next((seconds[s + d * i] for i in range(g.lookup + 1) if s + d * i in seconds and ok(seconds[s + d * i])), None)
    observed = lambda x: x[1] == "OBSERVED"
    if upper - lower > g.bracket:
        return "bracket_too_wide"
    if g.quiet is not None:
        if after not in (None, g.after) or before not in (None, g.before):
            return "not_from_before_to_after"
        a, b = near(up, 1, observed), near(down, -1, observed)
        if a is None or b is None or a[0] != g.after or b[0] != g.before:
            return "phase_not_corroborated"
        if any(seconds[s][:2] == (g.before, "OBSERVED") and not other(seconds[s][2]) for s in range(up + 1, up + 1 + g.quiet) if s in seconds):
            return "before_observed_after"
        return "round_number_mismatch" if other(a[2]) or other(b[2]) else None
    if after not in (None, g.after):
        return "not_to_after"
    e = near(up, 1, lambda x: x[0] == g.after and x[1] != "UNKNOWN")
    if e is None:
        return "phase_not_corroborated"
    if other(e[2]):
        return "round_number_mismatch"
    if any(other(seconds[s][2]) or seconds[s][:2] == ("BUY", "OBSERVED") for s in range(max(0, last), max(0, down)) if s in seconds):
        return "other_round_in_gap"
    return None if any(seconds[s][0] == "ACTIVE" and seconds[s][1] != "UNKNOWN" for s in range(first, up) if s in seconds) else "no_play_before"


def plain(seconds: dict, transitions: list, r: tuple, g: Gates) -> tuple:
    _, n, low, high, _, _ = r
    mine = [c for c in transitions if c[2] == g.kind and low <= int(c[4]) <= high and (not c[7] or n in c[7])]
    admitted = sorted((c[4], c[4] - c[3], c[3], c[1]) for c in mine if plain_reason(seconds, c, r, g) is None)
    if admitted:
        if admitted[-1][0] - admitted[0][0] > g.merge:
            return None, None, None, None, None, "competing_candidates"
        upper, _, lower, ident = admitted[0]
        return int(upper), lower, upper, ident, "transition", None
    if mine:
        return None, None, None, None, None, "no_admitted_candidate"
    pairs, last = [], None
    for s in range(max(0, low), high + 1):
        if s not in seconds:
            continue
        value, status, number = seconds[s]
        if status == "OBSERVED" and value == g.before:
            last = s
        elif status == "OBSERVED" and value == g.after:
            if last is not None and s - last <= g.bracket and {seconds[last][2], number} <= {None, n} and n in (seconds[last][2], number):
                pairs.append((last, s))
            last = None
        elif value not in ("UNKNOWN", g.before):
            last = None
    if len(pairs) == 1:
        return pairs[0][1], float(pairs[0][0]), float(pairs[0][1]), None, "state_pair", None
    return None, None, None, None, None, "competing_state_pairs" if pairs else "no_admitted_candidate"


@pytest.mark.parametrize("gates", [START, END])
def test_promotion_equals_plain_python(spark: SparkSession, gates: Gates) -> None:
    rng = random.Random(gates.kind)
    seconds, transitions, rounds = [], [], []
    for k in range(90):
        value, number = "BUY", 1
        for s in range(40):
            if rng.random() < 0.25:
                value = {"BUY": "ACTIVE", "ACTIVE": "ENDED", "ENDED": "BUY"}[value]
            number += rng.random() < 0.02
            status = rng.choices(["OBSERVED", "INFERRED", "UNKNOWN"], [7, 2, 1])[0]
            seconds.append((k, s, "UNKNOWN" if status == "UNKNOWN" else value, status, rng.choice([number, None])))
        for i in range(rng.choice([0, 0, 1, 2, 5])):
            upper = rng.randrange(2, 36) + rng.choice([0.0, 0.25])
            turn = (gates.before, gates.after)
            transitions.append((k, 100 * k + i, gates.kind if rng.random() < 0.9 else "other", upper - rng.choice([1.0, 1.0, 2.0, 3.0, 3.25]), upper, rng.choice([turn[0], None, "X"] if rng.random() < 0.2 else [turn[0], None]), rng.choice([turn[1], None]), rng.choice([None, [], [1], [1, 2], [3]])))
        rounds += [(k, 1, 0, 24, 0, 16), (k, 2, 17, 39, 20, 30)]
    df = spark.createDataFrame
    args = df(seconds, SECONDS).repartition(3), df(transitions, TRANSITIONS), df(rounds, ROUNDS), ["k"], gates
    want, reasons = {}, {}
    for r in rounds:
        own = {s: (v, st, n) for k, s, v, st, n in seconds if k == r[0]}
        mine = [c for c in transitions if c[0] == r[0]]
        want[r[:2]] = plain(own, mine, r, gates)
        reasons |= {(*r[:2], c[1]): plain_reason(own, c, r, gates) for c in mine if c[2] == gates.kind and r[2] <= int(c[4]) <= r[3] and (not c[7] or r[1] in c[7])}
    assert {(r.k, r.number, r.id): r.reason for r in boundaries.judged_candidates(*args).collect()} == reasons
    assert {(r.k, r.number): tuple(r)[2:] for r in boundaries.promoted(*args).collect()} == want
    assert {w[4] for w in want.values()} == {"transition", "state_pair", None}
    assert len({w for w in reasons.values()}) >= 5
