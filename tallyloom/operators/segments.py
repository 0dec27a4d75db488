"""Rounds from evidence: windows between boundaries, lives within rounds, spans from numbers, feeds matched to drops, and checks of all
of them against signals that were not used. Times are whole numbers (microseconds, seconds, ticks); thresholds are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import Step, grouped_fold
from .temporal import interval_join


@dataclass
class _Open:
    start: int
    end: int
    state: str
    start_event: int | None = None
    end_event: int | None = None


def _windows(gap: int, nudge: int):
    """One stretch without a break, as rows (time, kind, usable, preparing, segment, prepared_at, until) in order: at one time ends come before
    readings and readings before starts."""

    def start() -> Step:
        made: list[_Open] = []  # windows that may still change: the last ended one and those after it
        active: int | None = None  # an open window's start boundary,
        reach: int | None = None  # where its preparation began,
        own: str | None = None  # and the segment of its evidence
        cursor: int | None = None  # the last boundary or gap
        seen: int | None = None  # the reading before
        usable: int | None = None  # the first usable reading after the cursor,
        last_usable: int | None = None  # the last one,
        bare: int | None = None  # and the first that no window holds
        covered: int | None = None
        first_end: int | None = None  # the first end boundary,
        closed_at: int | None = None  # and the first one that closed a window
        tail: int | None = None  # the last reading that follows the last ended window without a gap or a preparation
        until: int | None = None

        def add(window: _Open) -> None:
            nonlocal covered
            made.append(window)
            covered = window.end if covered is None else max(covered, window.end)

        def close(end: int, state: str, end_event: int | None = None) -> None:
            """The open window ends."""
            nonlocal active, reach, own
            add(_Open(active if reach is None else min(active, reach), end, state, active, end_event))
            active = reach = own = None

        def move(to: int) -> None:
            nonlocal cursor, usable, last_usable, bare
            cursor = to if cursor is None else max(cursor, to)
            usable = last_usable = bare = None

        def settle(stay: bool) -> None:
            """The readings since the last end stay with the window that ended, or don't."""
            nonlocal tail
            if tail is not None and stay:
                made[0].end = max(made[0].end, tail)
            tail = None

        def flush(keep: int) -> list[tuple]:
            done = made[: len(made) - keep]
            del made[: len(done)]
            return [(w.start, w.end, w.state, w.start_event, w.end_event) for w in done if w.end > w.start]

        def reading(time: int, is_usable: bool, preparing: bool) -> None:
            nonlocal seen, usable, last_usable, bare, tail
            if seen is not None and time - seen > gap:
                settle(True)
                if active is not None:
                    close(seen if seen > active else min(time, active + nudge), "partial")
                elif bare is not None and (closed_at is None or closed_at > seen):
                    add(_Open(bare, min(time, max(seen, bare + nudge)), "fragment"))
                move(seen)
            if preparing:
                settle(True)
            tail = time if tail is not None else None
            seen = time
            if is_usable and (cursor is None or time > cursor):
                usable = time if usable is None else usable
                last_usable = time
                bare = time if bare is None and (covered is None or time > covered) else bare

        def starts(time: int, segment: str | None, prepared_at: int | None) -> list[tuple]:
            nonlocal active, reach, own
            settle(True)
            if active is not None and time > active:
                close(time, "partial")
            elif active is None and usable is not None and usable < time and prepared_at is None and not (first_end is not None and first_end < time):
                add(_Open(usable, time, "fragment"))
            active, reach, own = time, prepared_at, segment
            move(time)
            return flush(0)

        def ends(time: int, cut: bool) -> list[tuple]:
            nonlocal active, reach, own, first_end, closed_at, tail
            fragment = active is None and usable is not None and usable < time
            settle(not fragment)
            n = len(made)
            if cut:
                add(_Open(time - nudge, time, "partial", None, time))
            elif active is not None and time > active:
                close(time, "complete", time)
            elif fragment:
                add(_Open(usable, time, "fragment", None, time))
            active = reach = own = None
            first_end = time if first_end is None else first_end
            move(time)
            if len(made) == n:
                return flush(0)
            closed_at = time if closed_at is None else closed_at
            tail = time
            return flush(1)

        def step(row: tuple | None) -> list[tuple]:
            nonlocal until
            if row is None:
                fragment = active is None and usable is not None
                settle(not fragment)
                if active is not None and until > active:
                    close(until, "partial")
                elif fragment:
                    add(_Open(usable, min(until, max(last_usable, usable + nudge)), "fragment"))
                return flush(0)
            time, kind, is_usable, preparing, segment, prepared_at, until = row
            if kind == "reading":
                reading(time, bool(is_usable), bool(preparing))
                return []
            cut = active is not None and own is not None and segment is not None and own != segment
            if cut:
                close(time, "partial")
                move(time)
            return starts(time, segment, prepared_at) if kind == "start" else ends(time, cut)

        return step

    return start


def round_windows(rows: DataFrame, keys: Sequence[str], time: str, kind: str, gap: int, nudge: int, until: str, key_schema: str) -> DataFrame:
    """keys, part, start, end, state, start_event, end_event of each key's windows.

    rows: `reading` (with usable: play that may found a window; preparing: a reading of the next round's preparation), `start` (with segment: where its
    evidence is continuous; prepared_at: the first reading of its preparation, or null), `end` (with segment) and `break` (the recording is cut there).
    until: the recording's end.

    A start opens a window; an end closes it (complete), or, without a start, closes one that begins at the first usable reading since the last boundary (fragment). A gap
    of more than `gap` between readings closes an open window at the reading before (partial), or leaves the usable readings before the first end as a fragment; so does a start on
    top of an open window, and evidence from another segment. A window with a start reaches back to its preparation; the readings after an end stay with the round that ended
    until a gap, a preparation or the next start, unless they found a window of their own. Breaks part a key: no window crosses one, and what ends there ends at the break. Windows of no
    length are left out. State of a key's part: the windows since the last end, and a few times."""
    order = Window.partitionBy(*keys).orderBy(F.col(time), F.when(F.col(kind) == "break", 0).when(F.col(kind) == "end", 1).when(F.col(kind) == "reading", 2).otherwise(3)).rowsBetween(Window.unboundedPreceding, 0)
    parted = rows.withColumn("part", F.count(F.when(F.col(kind) == "break", 1)).over(order))
    cuts = rows.filter(F.col(kind) == "break").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(time).alias("__t"))
    numbered = cuts.withColumn("__part", F.row_number().over(Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__t")) - 1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) & (F.col("part") == F.col("__part"))
    bounded = parted.filter(F.col(kind) != "break").join(numbered, same, "left").withColumn("__until", F.least(F.col("__t"), F.col(until)))
    rank = F.when(F.col(kind) == "end", 0).when(F.col(kind) == "reading", 1).otherwise(2)
    placed = bounded.withColumn("__rank", rank).filter((F.col(time) >= 0) & (F.col(time) <= F.col(until)))
    columns = [time, kind, "usable", "preparing", "segment", "prepared_at", "__until"]
    return grouped_fold(placed, [*keys, "part"], [time, "__rank", "segment"], columns, _windows(gap, nudge), f"{key_schema}, part long, start long, end long, state string, start_event long, end_event long")


# --- lives


def _lives(merge: int, samples: int, span: int, need_revive: bool):
    def start() -> Step:
        last: dict = {}

        def fresh(time: int, source: str, how: str) -> None:
            last.clear()
            last.update(t=time, sources=[source], how=how, restart=False, n=0, low=None, high=None, revived=False)

        def kept() -> list[tuple]:
            return [("kept", last["t"], ",".join(sorted(set(last["sources"]))), last["how"])] if last else []

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return kept()
            time, kind, source = row
            if kind != "candidate":
                if last and time > last["t"]:
                    if kind == "restart":
                        last["restart"] = True
                    elif kind == "revive":
                        last["revived"] = True
                    elif kind == "live" and time > last["t"] + merge:
                        last.update(n=last["n"] + 1, low=time if last["low"] is None else last["low"], high=time)
                return []
            if not last:
                fresh(time, source, "first")
                return []
            if time - last["t"] <= merge:
                last["sources"].append(source)
                return [("merged", time, source, None)]
            if last["restart"]:
                out = kept()
                fresh(time, source, "restart")
                return out
            if last["n"] < samples or last["high"] - last["low"] < span:
                last["sources"].append(source)
                return [("duplicate", time, source, None)]
            if need_revive and not last["revived"]:
                out = [("superseded", last["t"], ",".join(sorted(set(last["sources"]))), None)]
                fresh(time, source, last["how"])
                return out
            out = kept()
            fresh(time, source, "revive")
            return out

        return step

    return start


def reconciled_lives(rows: DataFrame, keys: Sequence[str], part: str, time: str, merge: int, samples: int, span: int, need_revive: bool, key_schema: str) -> DataFrame:
    """keys, part, what, at, sources, how: at most one loss for each life of a part (a round), from candidates of several sources.

    rows: kind (`candidate`, `live`, `restart`, `revive`), source, part (null: in none) and unfit (a candidate that its source could not see). A candidate
    within `merge` of the last loss is the same (merged). After a restart it is a new loss. Otherwise `samples` live rows, `span` apart, must lie between, later than `merge` after
    the last loss, else it is a duplicate; and, with need_revive, a revive too: without one the subject was never lost before, and the later candidate takes the earlier
    one's place (superseded). Candidates in no part are outside_round, unfit ones while_spectating. State: one loss, and counts since."""
    lost = F.when(F.col("kind") == "candidate", F.when(F.col(part).isNull(), "outside_round").when(F.col("unfit"), "while_spectating"))
    marked = rows.withColumn("__lost", lost)
    out = marked.filter(F.col("__lost").isNotNull()).select(*keys, F.col(part), F.col("__lost").alias("what"), F.col(time).alias("at"), F.col("source").alias("sources"), F.lit(None).cast("string").alias("how"))
    rest = marked.filter(F.col("__lost").isNull() & F.col(part).isNotNull()).withColumn("__rank", F.when(F.col("kind") == "candidate", 0).otherwise(1))
    held = grouped_fold(rest, [*keys, part], [time, "__rank", "source"], [time, "kind", "source"], _lives(merge, samples, span, need_revive), f"{key_schema}, {part} long, what string, at long, sources string, how string")
    return held.unionByName(out.withColumn(part, F.col(part).cast("long")).withColumn("at", F.col("at").cast("long")))


# --- numbers


def numbered_rounds(states: DataFrame, events: DataFrame, keys: Sequence[str], time: str, number: str, support: int) -> DataFrame:
    """keys, number, start, end of rounds whose number was read `support` times or more, in rising order (lower ones after a higher one don't count). A round starts
    at the last `start` event after the number before it was last read and not after its own first reading, else at that reading; it ends at the first `end` event after its
    start, not after the next one's start, else there (null: open). states: time, number; events: time, kind. All windows and joins by key; nothing is folded."""
    whole = Window.partitionBy(*keys, number)
    read = states.filter(F.col(number).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(whole)).filter(F.col("__n") >= support)
    so_far = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rising = read.withColumn("__top", F.max(number).over(so_far)).filter(F.col(number) == F.col("__top"))
    spans = rising.groupBy(*keys, F.col(number).alias("number")).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    order = Window.partitionBy(*keys).orderBy("number")
    spans = spans.withColumn("floor", F.lag("last").over(order))
    opening = _last_before(spans, events.filter(F.col("kind") == "start"), keys, time, "first", "opening")
    begun = opening.withColumn("start", F.when(F.col("floor").isNull() | (F.col("opening") > F.col("floor")), F.coalesce("opening", "first")).otherwise(F.col("first")))
    begun = begun.withColumn("following", F.lead("start").over(order))
    closing = _first_after(begun, events.filter(F.col("kind") == "end"), keys, time, "start", "closing")
    end = F.when(F.col("closing").isNotNull() & (F.col("following").isNull() | (F.col("closing") <= F.col("following"))), F.col("closing")).otherwise(F.col("following"))
    return closing.select(*keys, "number", "start", end.alias("end"))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, at: str) -> DataFrame:
    """Rows of both, right's with their time alone; in order of `__at`."""
    mine = left.withColumn("__at", F.col(at)).withColumn("__t", F.lit(None).cast(right.schema[time].dataType))
    theirs = right.select(*keys, F.col(time).alias("__at"), F.col(time).alias("__t"))
    return mine.unionByName(theirs, allowMissingColumns=True)


def _last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, at: str, out: str) -> DataFrame:
    """The last time of right not after `at`."""
    order = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return _beside(left, right, keys, time, at).withColumn(out, F.max("__t").over(order)).filter(F.col(at).isNotNull()).drop("__at", "__t")


def _first_after(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, at: str, out: str) -> DataFrame:
    """The first time of right after `at`."""
    order = Window.partitionBy(*keys).orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, -1)
    return _beside(left, right, keys, time, at).withColumn(out, F.min("__t").over(order)).filter(F.col(at).isNotNull()).drop("__at", "__t")


# --- feeds


def _feed(passes: Sequence[str]):
    def start() -> Step:
        free: list[tuple] = []  # unused entries (id, time, kind, team), in order of time
        until: int | None = None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal until
            if row is None:
                return [(None, e[0], "phantom") for e in free if until is None or e[1] <= until]
            what, ident, time, kind, team, low, reach, last = row
            until = last if last is not None else until
            if what == "entry":
                free.append((ident, time, kind, team))
                return []
            out = []
            for name in passes:
                k = next((i for i, e in enumerate(free) if e[2] == name and e[3] == team and low <= e[1] <= reach), None)
                if k is not None:
                    out.append((ident, free.pop(k)[0], name))
            return out

        return step

    return start


def assigned_feed(entries: DataFrame, units: DataFrame, keys: Sequence[str], window: int, passes: Sequence[str], key_schema: str) -> DataFrame:
    """keys, unit, entry, pass: every unit (id, low, high, team), in order of high, takes of each pass's entries (id, time, kind, team) the earliest unused one of its team
    between low - window and high + window; a unit and an entry are used once a pass. Entries nobody took that are not after the key's `last` (a column of entries; null: no
    limit) are `phantom`. State: a key's unused entries, so a key is a round."""
    none = lambda t: F.lit(None).cast(t)
    a = entries.select(*keys, F.lit("entry").alias("what"), F.col("id").alias("id"), F.col("time").alias("at"), "time", "kind", "team", none("long").alias("low"), none("long").alias("reach"), F.col("last").cast("long").alias("last"), F.lit(0).alias("rank"), F.col("id").alias("tie"))
    b = units.select(*keys, F.lit("unit").alias("what"), F.col("id").alias("id"), (F.col("high") + window).alias("at"), F.col("high").alias("time"), none("string").alias("kind"), "team", (F.col("low") - window).alias("low"), (F.col("high") + window).alias("reach"), none("long").alias("last"), F.lit(1).alias("rank"), F.col("low").alias("tie"))
    both = a.unionByName(b)
    return grouped_fold(both, keys, ["at", "rank", "tie", "id"], ["what", "id", "time", "kind", "team", "low", "reach", "last"], _feed(passes), f"{key_schema}, unit long, entry long, pass string")


# --- checks


@dataclass(frozen=True)
class Check:
    """How items of a kind are held against a signal between `after` and `until` from their time (inclusive). With `correct` and `false`: correct if
    the largest value is at least `correct`, false if it is below `false`, else undetermined. Without: false if there is any signal, else correct."""

    kind: str
    signal: str
    after: int
    until: int
    correct: float | None = None
    false: float | None = None


def verified_items(items: DataFrame, signals: DataFrame, keys: Sequence[str], ident: str, time: str, checks: Sequence[Check], bucket: int) -> DataFrame:
    """items (keys, ident, time, kind) with `verdict`: correct, false, undetermined, or abstained for kinds without a check and null times. signals: keys, time, signal,
    value. They meet in buckets of time, so that a key's items and signals never meet all with all."""
    rule = lambda f, t: reduce(lambda rest, c: F.when(F.col("kind") == c.kind, F.lit(f(c)).cast(t)).otherwise(rest), checks, F.lit(None).cast(t))
    ruled = items.withColumns({"__signal": rule(lambda c: c.signal, "string"), "__lo": F.col(time) + rule(lambda c: c.after, "long"), "__hi": F.col(time) + rule(lambda c: c.until, "long"), "__correct": rule(lambda c: c.correct, "double"), "__false": rule(lambda c: c.false, "double")})
    used = [c for c in ruled.columns if c not in keys]
    windows = ruled.filter(F.col("__lo").isNotNull()).select(*keys, F.col(ident).alias("__id"), "__signal", "__lo", "__hi")
    points = signals.select(*keys, F.col(time).alias("__t"), F.col("signal").alias("__s"), "value")
    met = interval_join(points, windows, list(keys), "__t", "__lo", "__hi", bucket).filter(F.col("__s") == F.col("__signal"))
    found = met.groupBy(F.col("__id")).agg(F.count(F.lit(1)).alias("__n"), F.max("value").alias("__max"))
    judged = ruled.select(*keys, *used).join(found, F.col(ident) == F.col("__id"), "left")
    none = F.coalesce(F.col("__n"), F.lit(0)) == 0
    bounds = F.when(none, "undetermined").when(F.col("__max") >= F.col("__correct"), "correct").when(F.col("__max") < F.col("__false"), "false").otherwise("undetermined")
    verdict = F.when(F.col("__signal").isNull() | F.col(time).isNull(), "abstained").when(F.col("__correct").isNotNull(), bounds).when(none, "correct").otherwise("false")
    return judged.select(*items.columns, verdict.alias("verdict"))


# --- policies


def context_assessment(policies: DataFrame, packages: DataFrame, scopes: DataFrame) -> DataFrame:
    """What a rule's policy needs of a package, and what the package lacks: rule_id, package_id, missing_context, round_timeline, shortfall, time_scope.

    policies: rule_id, needs_previous, needs_timeline, windowed. packages: package_id, number (of its round), has_previous, timeline (status, or null: absent). scopes: rule_id, package_id,
    whole_round (null: no scope was determined), one row for each pair to assess."""
    pairs = scopes.select("rule_id", "package_id", "whole_round").join(policies, "rule_id").join(packages, "package_id")
    whole = F.col("whole_round")
    lacks = F.col("needs_previous") & (F.col("number") > 1) & ~F.coalesce("has_previous", F.lit(False))
    status = F.coalesce("timeline", F.lit("absent"))
    scope = F.when(whole.isNull(), "unknown").when(~whole, "event_windows").when(~F.col("windowed"), "whole_round_by_policy").otherwise("whole_round_fallback")
    missing = F.when(lacks, F.array(F.lit("previous_round"))).otherwise(F.array().cast("array<string>"))
    return pairs.select("rule_id", "package_id", missing.alias("missing_context"), status.alias("round_timeline"), (F.col("needs_timeline") & (status != "complete")).alias("shortfall"), scope.alias("time_scope"))


def provisional_admission(policies: DataFrame, registry: DataFrame, self_contained: Sequence[str], round_facts: Sequence[str], round_events: Sequence[str]) -> DataFrame:
    """rule_id, admissible, reasons, match_aggregated: whether a rule may be evaluated on a part of a round alone, with every reason against it, in a fixed order.

    policies: rule_id, level, windowed, needs_timeline, needs_previous, aggregated. registry: rule_id, fact_keys, trigger_types (arrays; a null one is empty)."""
    known = registry.select("rule_id", "fact_keys", "trigger_types", F.lit(True).alias("__known"))
    rows = policies.join(known, "rule_id", "left")
    named = lambda reason, column, of: F.transform(F.array_sort(F.array_intersect(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, of)))), lambda x: F.concat(F.lit(f"{reason}:"), x))
    reason = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(
        reason(F.col("__known").isNull(), "not_in_registry"), reason(~F.col("level").isin(*self_contained), "level"), reason(~F.col("windowed"), "no_window"), reason(F.col("needs_timeline"), "round_timeline"),
        reason(F.col("needs_previous"), "previous_round"), reason(F.col("level") == "match", "match_context"), named("round_fact", F.col("fact_keys"), round_facts), named("round_trigger", F.col("trigger_types"), round_events),
    )
    return rows.select("rule_id", (F.size(reasons) == 0).alias("admissible"), reasons.alias("reasons"), F.col("aggregated").alias("match_aggregated"))


def timeline_gate(rows: DataFrame, needs: Column, status: Column) -> DataFrame:
    """rows with `gated`: those that need a round timeline and don't have a complete one."""
    return rows.withColumn("gated", F.coalesce(needs, F.lit(False)) & (F.coalesce(status, F.lit("absent")) != "complete"))
