"""Direct facts from readings of a display: one ordered fold per key in which several latches listen to the same rows.

A row holds what was read (view, phases, scores, timer, slots, added rows) and what other detectors say beside it. Each part of the engine keeps its own
small state and sees the row, the row before it and what the parts before it decided in this row:

* `Boundaries`, a lifecycle of seven states: a start is proposed at the change from preparation to play, and told, with its own time, once a
  later row confirms it; an end is told at once if score and banner were joined before, else once a second row repeats it;
* `Edges`: the first row of a preparation, and of a planted object with its own timer;
* `Slots`: slots whose availability or charges changed, with the least of the confidences involved;
* `Death`: two sources together, once until a return or a start;
* `Episode`: a condition with its sides, told when it changes or is seen to be gone; its duration counts only if it was read without a gap;
* `Added`: new rows of a feed, with the sides that one-man drops beside them prove.

A break (a marked cut, time that doesn't rise, or a gap longer than `longest_gap`) resets every part. Output rows are tagged by `kind`; `accepted`
keeps what is sure enough. Everything is decided in one shuffle by key; a key's state is the row before, four slots and a few values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import Step, grouped_fold

#: What a row holds, in this order; `t` in seconds. Missing columns count as null.
READING = """
t double, view string, confidence double, phase boolean, phase_confidence double, buying boolean, end_banner boolean, timer double, score_a long,
score_b long, planted string, slots array<struct<slot:int,available:boolean,charges:int,confidence:double,name:string>>, own boolean, report boolean,
trusted boolean, cut boolean, back boolean, plant_timer boolean, plant_confidence double, site string, joined boolean, join_times array<double>,
join_confidence double, timer_gone boolean, stable boolean, before_play boolean, slots_checked boolean, away boolean, cause boolean,
death_confidence double, effect string, effect_from string, effect_on string, effect_seconds double, effect_confidence double, effect_checked boolean,
added array<struct<a_before:int,a_after:int,b_before:int,b_after:int,color:boolean,normal:boolean,label:string,confidence:double,pair_confidence:double>>
"""
def split_fields() -> list[str]:
    """The fields of READING, each `name type`."""
    out, depth, at = [], 0, 0
    text = READING.replace("\n", " ").strip()
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return out


FIELDS = [f.split(" ", 1)[0] for f in split_fields()]
OUTPUT = "kind string, t double, actor string, confidence double, checked boolean, attributes map<string,string>"
PLAY, MENU = "live", "menu"
SIDES = ("player", "ally", "enemy")


@dataclass(frozen=True)
class Limits:
    """Thresholds: `low` for anything, `high` for what nothing else confirms; seconds."""

    low: float = 0.65
    high: float = 0.85
    phase: float = 0.9
    longest_gap: float = 1.0
    confirm_after: float = 0.05
    timer_slack: float = 1.0
    timer_rise: float = 3.0


Row = dict[str, Any]
Event = tuple[str, float, str, float, bool, dict[str, str]]


def bounded(x: Any, missing: float = 0.0) -> float:
    """A confidence in 0 to 1: NaN and null count as missing."""
    return missing if x is None or math.isnan(x) else min(1.0, max(0.0, x))


def sure(x: Any) -> float:
    """A confidence that counts only if it is one."""
    return x if x is not None and 0 <= x <= 1 else 0.0


def prepared(row: Row, limits: Limits) -> float:
    """Confidence of a preparation: the phase's own if it was read as text, else the row's."""
    text = row["phase_confidence"]
    own = row["phase"] and row["buying"] and text is not None and limits.phase <= text <= 1
    return max(sure(row["confidence"]), text) if own else sure(row["confidence"])


def scores(row: Row) -> tuple[int, int] | None:
    a, b = row["score_a"], row["score_b"]
    return (a, b) if a is not None and b is not None and a >= 0 and b >= 0 else None


def same_scores(a: Row, b: Row) -> bool:
    return scores(a) is not None and scores(a) == scores(b)


def number(x: Any) -> bool:
    return x is not None and math.isfinite(x)


def told(kind: str, t: float, actor: str, confidence: float, checked: bool, **attributes: Any) -> Event:
    return kind, max(0.0, t), actor, bounded(confidence), checked, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in attributes.items() if v is not None}


def enough(event: Event, limits: Limits) -> bool:
    return event[3] >= limits.high or (event[3] >= limits.low and event[4])


class Boundaries:
    """States: unobserved, pre_round, next_round_preparation, round_active, round_end_candidate, round_ended; a start that waits for its confirmation is
    the seventh."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.segment = limits, 0
        self.reset()
        self.segment = 0

    def reset(self) -> None:
        self.segment += 1
        self.state, self.ended, self.preparing = "unobserved", False, 0
        self.waiting: tuple[str, float, float, float, tuple[int, int] | None] | None = None  # kind, time, confidence, timer, scores

    def _told(self, kind: str, t: float, confidence: float, confirmed: float) -> Event:
        self.waiting = None
        self.ended = kind == "round_end"
        self.state = "round_ended" if self.ended else "round_active"
        return told(kind, t, "system", confidence, True, segment=self.segment, confirmed=f"{confirmed:.3f}")

    def read(self, before: Row | None, row: Row) -> list[Event]:
        limits, t, own = self.limits, row["t"], sure(row["confidence"])
        if self.waiting and self.waiting[0] == "round_start":
            _, since, confidence, timer, pair = self.waiting
            elapsed = t - since
            fits = row["view"] == PLAY and not row["phase"] and own >= limits.low and number(row["timer"]) and scores(row) == pair and 0 <= timer - row["timer"] <= elapsed + limits.timer_slack
            if fits and elapsed >= limits.confirm_after:
                return [self._told("round_start", since, min(confidence, own), t)]
            self.waiting = self.waiting if fits else None
        self._prepare(row)
        if before is not None and starts(before, row, limits) and self.state in ("unobserved", "pre_round", "next_round_preparation", "round_ended") and row["timer"] >= 0:
            confidence = min(own, prepared(before, limits))
            if confidence >= limits.low:
                self.waiting = ("round_start", t, confidence, row["timer"], scores(row))
        return self._end(before, row)

    def _prepare(self, row: Row) -> None:
        if prepared(row, self.limits) < self.limits.low or not (row["phase"] or row["view"] == MENU):
            self.preparing = 0
            return
        self.preparing += 1
        # A menu in the middle of a round prepares nothing; a phase that was read twice does, even if no end was seen.
        if self.state != "round_active" or (row["phase"] and self.preparing >= 2):
            self.state = "next_round_preparation" if self.ended else "pre_round"

    def _end(self, before: Row | None, row: Row) -> list[Event]:
        own, t = sure(row["confidence"]), row["t"]
        if not ends(before, row) or self.state in ("round_ended", "next_round_preparation"):
            if self.waiting and self.waiting[0] == "round_end":
                self.waiting, self.state = None, "round_active"
            return []
        beside = row["join_confidence"] if number(row["join_confidence"]) else 0.0
        if row["joined"] and len(set(row["join_times"] or ())) >= 2 and min(own, beside) >= self.limits.low:
            return [self._told("round_end", t, min(own, beside), t)]
        confidence = min(own, sure(before["confidence"])) if before is not None else 0.0
        if confidence < self.limits.low:
            return []
        if self.waiting and self.waiting[0] == "round_end":
            return [self._told("round_end", self.waiting[1], min(self.waiting[2], own), t)]
        self.state, self.waiting = "round_end_candidate", ("round_end", t, confidence, 0.0, None)
        return []


def starts(before: Row, row: Row, limits: Limits) -> bool:
    """From preparation to play, with a timer that jumped up and the same scores."""
    led = (before["view"] == MENU or bool(before["phase"])) and row["view"] == PLAY and not row["phase"]
    rose = number(before["timer"]) and number(row["timer"]) and row["timer"] > before["timer"] + limits.timer_rise
    return bool(led and rose and same_scores(before, row))


def ends(before: Row | None, row: Row) -> bool:
    """Joined evidence, or a banner beside a changed score or a stopped timer."""
    if row["joined"] or before is None:
        return bool(row["joined"])
    pairs = [(before[c], row[c]) for c in ("score_a", "score_b")]
    changed = any(a is not None and b is not None and a != b for a, b in pairs) and row["joined"] is None
    return bool((row["end_banner"] or before["end_banner"]) and (changed or row["timer_gone"]))


def edges(before: Row | None, row: Row) -> list[Event]:
    if before is None:
        return []
    out, own = [], bounded(row["confidence"])
    buys = lambda r: bool(r["buying"] and r["stable"] and r["before_play"])
    if buys(row) and not buys(before):
        out.append(told("buy_phase", row["t"], "team", own, True))
    if row["planted"] == "planted" and before["planted"] != "planted" and row["plant_timer"]:
        site = (row["site"] or "").strip() or None
        out.append(told("planted", row["t"], "team", min(own, bounded(before["confidence"]), bounded(row["plant_confidence"], 0.85)), True, site=site))
    return out


def mine(row: Row | None) -> bool:
    return row is not None and row["view"] == PLAY and bool(row["own"])


def slot_changes(before: Row | None, row: Row, limits: Limits) -> list[Event]:
    if not mine(row):
        return []
    by_slot = lambda r: {s["slot"]: s for s in r["slots"] or () if s and s["slot"] is not None and 0 <= s["slot"] < 4}
    old, least = (by_slot(before), min(bounded(row["confidence"]), bounded(before["confidence"]))) if mine(before) else ({}, bounded(row["confidence"]))
    out = []
    for slot, new in sorted(by_slot(row).items()):
        was = old.get(slot)
        readable = new["available"] is not None or (new["charges"] is not None and new["charges"] >= 0)
        if not readable or (was and (was["available"], was["charges"]) == (new["available"], new["charges"])):
            continue
        confidence = min([least, bounded(new["confidence"]), *([bounded(was["confidence"])] if was else [])])
        if confidence >= limits.low:
            out.append(told("slot", row["t"], "player", confidence, was is not None or bool(row["slots_checked"]), slot=slot, name=new["name"], available=new["available"], charges=new["charges"]))
    return out


class Death:
    def __init__(self, limits: Limits) -> None:
        self.limits, self.latched = limits, False

    def reset(self) -> None:
        self.latched = False

    def read(self, row: Row, starting: bool) -> list[Event]:
        if row["view"] == MENU or row["phase"] or row["buying"] or starting or not mine(row) or self.latched or not (row["report"] and row["away"]):
            return []
        event = told("death", row["t"], "player", min(bounded(row["confidence"]), bounded(row["death_confidence"], 0.85)), True, cause_known=bool(row["cause"]))
        self.latched = enough(event, self.limits)
        return [event] if self.latched else []


class Episode:
    """A condition waits for its end: it is told when it is over, or when the rows are."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.now: Event | None = None
        self.whole = True

    def close(self, until: float | None = None) -> list[Event]:
        out, self.now, whole, self.whole = self.now, None, self.whole, True
        if out is None:
            return []
        return [out if until is None or not whole else (*out[:5], out[5] | {"seconds": str(max(0.0, until - out[1]))})]

    def read(self, before: Row | None, row: Row) -> list[Event]:
        own, t = bounded(row["confidence"]), row["t"]
        side = lambda x: x if x in SIDES else "unknown"
        new: Event | None = None
        if mine(row) and (row["effect"] or "").strip():
            seconds = row["effect_seconds"] if number(row["effect_seconds"]) and row["effect_seconds"] >= 0 else None
            new = told("effect", t, "player", min(own, bounded(row["effect_confidence"], 0.85)), bool(row["effect_checked"]), effect=row["effect"].strip(), source=side(row["effect_from"]), on=side(row["effect_on"]), seconds=seconds)
            new = new if enough(new, self.limits) else None
        gone = new is None and mine(row) and own >= self.limits.low and bool(row["trusted"])
        if self.now is not None and ((new is None and not gone) or (before is not None and t - before["t"] > self.limits.longest_gap)):
            self.whole = False
        name = lambda e: None if e is None else tuple(e[5][k] for k in ("effect", "on", "source"))
        if name(new) == name(self.now) or not (new or gone):
            return []
        out = self.close(t)
        self.now = new
        return out


def sides(a_before: int | None, a_after: int | None, b_before: int | None, b_after: int | None, color: bool | None, normal: bool | None) -> tuple[str, str]:
    """(side that fell, side that did it): the one side that lost one while the other stayed; the other did it only if color and kind agree."""

    def lost(before: int | None, after: int | None) -> bool:
        return before is not None and after is not None and before - after == 1

    fell = "ally" if lost(a_before, a_after) and b_before is not None and b_before == b_after else "enemy" if lost(b_before, b_after) and a_before is not None and a_before == a_after else "unknown"
    agreed = bool(color) and (bool(normal) if normal is not None else True)
    return fell, "unknown" if fell == "unknown" or not agreed else "enemy" if fell == "ally" else "ally"


def feed_rows(row: Row) -> list[Event]:
    out = []
    for x in row["added"] or ():
        fell, by = sides(*[x[c] for c in ("a_before", "a_after", "b_before", "b_after", "color", "normal")])
        confidence = min(bounded(row["confidence"]), bounded(x["confidence"]), bounded(x["pair_confidence"], 1.0))
        out.append(told("kill", row["t"], "unknown", confidence, fell != "unknown", fell=fell, by=by, label=(x["label"] or "").strip() or None))
    return out


def engine(limits: Limits) -> Callable[[], Step]:
    """The fold's start: all parts, in the order in which they see a row."""

    def start() -> Step:
        boundaries, death, episode = Boundaries(limits), Death(limits), Episode(limits)
        before: Row | None = None

        def step(values: tuple | None) -> list[tuple]:
            nonlocal before
            if values is None:
                return list(episode.close())
            row = dict(zip(FIELDS, values, strict=True))
            out: list[Event] = []
            if row["cut"] or (before is not None and not 0 < row["t"] - before["t"] <= limits.longest_gap):
                out += episode.close()
                before = None
                boundaries.reset()
                death.reset()
            if row["back"]:
                death.reset()
            starting = before is not None and starts(before, row, limits) and min(sure(row["confidence"]), prepared(before, limits)) >= limits.low
            bounds = [] if row["cut"] else boundaries.read(before, row)
            if any(e[0] == "round_start" for e in bounds):
                death.reset()
                out += episode.close()
            out += bounds + edges(before, row) + slot_changes(before, row, limits) + death.read(row, starting) + episode.read(before, row) + feed_rows(row)
            before = row
            return list(out)

        return step

    return start


def direct_facts(readings: DataFrame, keys: Sequence[str], tie: str, key_schema: str, limits: Limits | None = None) -> DataFrame:
    """keys, kind, t, actor, confidence, checked, attributes: every candidate fact of each key's readings in order of (t, tie). Columns of
    READING that the readings lack count as null."""
    schema = {name: rest for name, rest in (f.split(" ", 1) for f in split_fields())}
    full = readings.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in readings.columns})
    return grouped_fold(full, keys, ["t", tie], FIELDS, engine(limits or Limits()), f"{key_schema}, {OUTPUT}")


def accepted(facts: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Facts that are sure by themselves, or sure enough and confirmed."""
    own = limits or Limits()
    return facts.filter((F.col("confidence") >= own.high) | ((F.col("confidence") >= own.low) & F.col("checked")))
