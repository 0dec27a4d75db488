"""Phases of rounds and facts of samples against plain Python over lists."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

from tallyloom.operators import samples

SERIES = "k long, t double, round long, ordinal long, role string, side string, own boolean, hud boolean, timer double, ally int, enemy int, planted boolean, carried boolean, charges array<double>, feed boolean, kills array<struct<own_victim:boolean,own_killer:boolean>>, death boolean"
NAMES = [f.split()[0] for f in SERIES.split(", ")]
RULES = samples.PhaseRules(half=3)


def series(rng: random.Random, k: int) -> list[dict]:
    t, ordinal, out, calm = 0.0, 0, [], k % 3 == 0  # calm: nobody is eliminated, nothing is planted
    for _ in range(rng.choice([1, 4, 60, 160])):
        t += rng.choice([1.0, 5.0, 5.0, 12.0])
        ordinal += rng.random() < (0.03 if calm else 0.08)
        maybe = lambda x, p=0.8: x if rng.random() < p else None
        out.append({
            "k": k, "t": t, "round": maybe(ordinal), "ordinal": maybe(ordinal), "role": maybe("duelist", 0.95), "side": maybe(rng.choice(["attack", "defense"])), "own": maybe(rng.random() < 0.7), "hud": maybe(rng.random() < 0.8),
            "timer": maybe(rng.choice([12.0, 29.0, 31.0, 44.0, 46.0, 70.0, 99.0]), 0.6), "ally": maybe(rng.randrange(calm, 6)), "enemy": maybe(rng.randrange(calm, 6)), "planted": maybe(not calm and rng.random() < 0.3, 0.6), "carried": maybe(rng.random() < 0.3),
            "charges": [rng.choice([0.0, 0.2, 0.25, 0.8, 1.0]) for _ in range(3)] + [rng.choice([0.59, 0.6])], "feed": maybe(rng.random() < 0.5), "kills": maybe([{"own_victim": rng.random() < 0.3, "own_killer": rng.random() < 0.3} for _ in range(rng.randrange(3))], 0.5), "death": maybe(rng.random() < 0.1),
        })
    return out


def plain_phases(rows: list[dict]) -> dict:
    by: dict[int, list[dict]] = {}
    for r in rows:
        if r["ordinal"] is not None:
            by.setdefault(r["ordinal"], []).append(r)
    out = {}
    for o in sorted(by):
        own = by[o]
        length = RULES.buy_half if o in (0, RULES.half) or o >= 2 * RULES.half else RULES.buy
        combat = next((r for r in own if r["timer"] is not None and r["timer"] >= RULES.combat_timer), None)
        start = combat["t"] - (RULES.limit - combat["timer"]) if combat else None
        buy = next((r for r in own if r["timer"] is not None and r["timer"] <= length and (start is None or r["t"] < start)), None)
        begin, basis = (buy["t"] - (length - buy["timer"]), "buy_countdown") if buy else (start - length, "combat_start_minus_buy_length") if combat else (None, None)
        out[o] = [own[0]["t"] if o else None, start, begin, basis, None, None]
    ordered = sorted(out)
    for o, after in zip(ordered, [*ordered[1:], None], strict=False):
        upper = out[after][0] if after is not None else None
        start = out[o][1]
        found = []
        if start is not None:
            window = [r for r in rows if start <= r["t"] and (upper is None or r["t"] <= upper)]
            found += [(r["t"], "team_eliminated") for r in window if r["ally"] == 0 or r["enemy"] == 0][:1]
            if not any(r["planted"] for r in window) and (upper is None or start + RULES.limit <= upper):
                found.append((start + RULES.limit, "timer_expired"))
        if not found and upper is not None:
            found = [(upper, "score_update_upper_bound")]
        out[o][4:] = min(found) if found else (None, None)
    return out


def plain_facts(rows: list[dict], phases: dict) -> dict:
    out, bought, killed = {}, set(), set()
    before = last_self = spike = None
    for r in rows:
        f, e = {}, set()
        t, at = r["t"], r["round"]
        mine = bool(r["own"] and r["hud"])
        if r["role"]:
            f["player_role"] = r["role"]
        if at is not None and (before is None or before["round"] != at):
            e.add("round_start")
        phase = item = None
        for o in sorted(phases, reverse=True):
            _, combat, buy, _, end, _ = phases[o]
            if combat is not None and t >= combat:
                phase, item = ("combat" if end is None or t <= end else None), o
                break
            if buy is not None and t >= buy:
                phase, item = "buy", o
                break
        if phase == "buy":
            f["buy_phase_observed"] = True
            if item not in bought:
                bought.add(item)
                e.add("buy_phase")
        elif phase == "combat" and not r["planted"]:
            f["round_time_remaining_sec"] = r["timer"] if r["timer"] is not None else max(0.0, 100.0 - (t - phases[item][1]))
        if r["side"]:
            f["side"] = r["side"]
            if r["side"] == "defense":
                f["spike_carried_by_player"] = False
        if r["own"] and r["carried"]:
            f["spike_carried_by_player"] = True
        a, b = r["ally"], r["enemy"]
        if a and b:
            f["numbers_state"] = "advantage" if a > b else "disadvantage" if a < b else "even"
            e.add("state_snapshot")
            if r["own"]:
                f["clutch_state"] = a == 1
        charged = lambda x: sum(c >= 0.25 for c in x["charges"][:3])
        if mine:
            e.add("ability_state")
            f |= {"utility_available_count": charged(r), "ultimate_available": r["charges"][3] >= 0.6, "player_died": False}
            if last_self and t - last_self["t"] <= 10 and last_self["round"] == at and max(x - y for x, y in zip(last_self["charges"][:3], r["charges"][:3], strict=True)) >= 0.5:
                e.add("utility_used")
            last_self = r
        if r["death"]:
            e.add("player_death")
            f["player_died"] = True
            if last_self and t - last_self["t"] <= 10:
                f["utility_available_count"] = charged(last_self)
        if r["kills"]:
            e.add("kill")
            if at is not None and at not in killed:
                killed.add(at)
                f |= {"first_death_by_player": r["kills"][0]["own_victim"], "first_kill_by_player": r["kills"][0]["own_killer"]}
        elif not r["feed"] and before and None not in (a, b, before["ally"], before["enemy"]) and t - before["t"] <= 10 and before["round"] == at and (0 < a < before["ally"] or 0 < b < before["enemy"]):
            e.add("kill")
        if r["planted"] is not None:
            f |= {"spike_planted": r["planted"], "objective_state_observed": True}
            if r["planted"] and spike == (at, False):
                e |= {"spike_planted", "objective_state"}
            spike = (at, r["planted"])
        out[t] = (f, sorted(e))
        before = r
    return out


def test_phases_and_facts_equal_plain_python(spark: SparkSession) -> None:
    rng = random.Random(17)
    by_key = {k: series(rng, k) for k in range(25)}
    rows = [tuple(r[n] for n in NAMES) for own in by_key.values() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SERIES).repartition(4)
    phases = samples.round_phases(df, ["k"], RULES)
    got: dict = {}
    for r in phases.collect():
        got.setdefault(r.k, {})[r.ordinal] = [r.score_update, r.combat_start, r.buy_start, r.buy_basis, r.round_end, r.end_basis]
    want = {k: p for k, own in by_key.items() if (p := plain_phases(own))}
    assert got == want
    assert {p[5] for own in want.values() for p in own.values()} == {"team_eliminated", "timer_expired", "score_update_upper_bound", None}
    seen: set[str] = set()
    facts = samples.sample_facts(df, phases, ["k"], samples.SampleRules())
    plain = {k: plain_facts(own, want.get(k, {})) for k, own in by_key.items()}
    for r in facts.collect():
        f, e = plain[r.k][r.t]
        assert {c[5:]: r[c] for c in facts.columns if c.startswith("fact_") and r[c] is not None} == f, (r.k, r.t)
        assert r.events == e, (r.k, r.t)
        seen |= {*f, *e}
    assert facts.count() == len(rows)
    assert len([c for c in facts.columns if c.startswith("fact_")]) == 14 and len(seen) == 14 + 9 - 1  # spike_planted is both


def test_no_rows(spark: SparkSession) -> None:
    df = spark.createDataFrame([], SERIES)
    phases = samples.round_phases(df, ["k"], RULES)
    assert phases.count() == 0 and samples.sample_facts(df, phases, ["k"], samples.SampleRules()).count() == 0
