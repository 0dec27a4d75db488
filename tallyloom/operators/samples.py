"""Facts and events of each sample of a display's series, and the phases of its rounds: windows and joins by key, nothing is folded.

A fact is null where it was not observed. Times are seconds (double)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import interval_join


@dataclass(frozen=True)
class PhaseRules:
    """Lengths in seconds; combat_timer: a timer that only a combat phase shows; half: rounds of half a match, whose first has a longer preparation, as have all after two halves."""

    limit: float = 100.0
    buy: float = 30.0
    buy_half: float = 45.0
    half: int = 12
    combat_timer: float = 46.0


@dataclass(frozen=True)
class SampleRules:
    """longest: seconds between samples that are still compared; charged, ultimate: charges that count as available; used: a drop that is a use."""

    longest: float = 10.0
    charged: float = 0.25
    ultimate: float = 0.6
    used: float = 0.5


def round_phases(samples: DataFrame, keys: Sequence[str], rules: PhaseRules, bucket: int = 60) -> DataFrame:
    """keys, ordinal, score_update, combat_start, buy_start, round_end and their bases, of each round (ordinal from 0) that has samples.

    samples: t, ordinal, timer, ally, enemy (alive), planted. Combat starts where the first timer of a combat phase counts back to the limit; the preparation where the first timer of its length or less, before
    combat, counts back to that length, else that length before combat; the score's update is the first sample of a round but the first. A round ends at the earliest of a team eliminated and, if nothing was planted and the next
    score leaves time for it, the timer's end; else at the next round's score update."""
    whole = Window.partitionBy(*keys, "ordinal")
    length = F.when(F.col("ordinal").isin(0, rules.half) | (F.col("ordinal") >= 2 * rules.half), rules.buy_half).otherwise(rules.buy)
    first = lambda condition: F.min(F.when(condition, F.struct("t", "timer")))
    rows = samples.filter(F.col("ordinal").isNotNull()).withColumn("__length", length).withColumn("__combat", first(F.col("timer") >= rules.combat_timer).over(whole))
    start = F.col("__combat.t") - (rules.limit - F.col("__combat.timer"))
    rows = rows.withColumn("combat_start", start)
    before = (F.col("timer") <= F.col("__length")) & (F.col("combat_start").isNull() | (F.col("t") < F.col("combat_start")))
    found = rows.groupBy(*keys, "ordinal", "combat_start", "__length").agg(F.min("t").alias("__first"), first(before).alias("__buy"))
    buy = F.when(F.col("__buy").isNotNull(), F.col("__buy.t") - (F.col("__length") - F.col("__buy.timer"))).otherwise(F.col("combat_start") - F.col("__length"))
    basis = F.when(F.col("__buy").isNotNull(), "buy_countdown").when(F.col("combat_start").isNotNull(), "combat_start_minus_buy_length")
    phases = found.select(*keys, "ordinal", F.when(F.col("ordinal") > 0, F.col("__first")).alias("score_update"), "combat_start", buy.alias("buy_start"), basis.alias("buy_basis"))
    phases = phases.withColumn("__upper", F.lead("score_update").over(Window.partitionBy(*keys).orderBy("ordinal")))
    last = samples.groupBy(*keys).agg(F.max("t").alias("__last"))
    spans = phases.filter(F.col("combat_start").isNotNull()).join(last, list(keys)).select(*keys, F.col("ordinal").alias("__o"), F.col("combat_start").alias("__lo"), F.coalesce("__upper", F.greatest("__last", "combat_start")).alias("__hi"))
    points = samples.select(*keys, "t", ((F.col("ally") == 0) | (F.col("enemy") == 0)).alias("__gone"), "planted")
    inside = interval_join(points, spans.filter("__hi >= __lo"), list(keys), "t", "__lo", "__hi", bucket)
    ends = inside.groupBy(*keys, F.col("__o").alias("ordinal")).agg(F.min(F.when(F.col("__gone"), F.col("t"))).alias("__gone"), F.coalesce(F.bool_or("planted"), F.lit(False)).alias("__planted"))
    ended = phases.join(ends, [*keys, "ordinal"], "left")
    expiry = F.col("combat_start") + rules.limit
    expired = F.when(~F.coalesce("__planted", F.lit(False)) & (F.col("__upper").isNull() | (expiry <= F.col("__upper"))), F.struct(expiry.alias("t"), F.lit("timer_expired").alias("basis")))
    gone = F.when(F.col("__gone").isNotNull(), F.struct(F.col("__gone").alias("t"), F.lit("team_eliminated").alias("basis")))
    upper = F.when(F.col("__upper").isNotNull(), F.struct(F.col("__upper").alias("t"), F.lit("score_update_upper_bound").alias("basis")))
    end = F.when(F.col("combat_start").isNull(), upper).otherwise(F.coalesce(F.array_min(F.array_compact(F.array(gone, expired))), upper))
    return ended.withColumn("__end", end).select(*keys, "ordinal", "score_update", "combat_start", "buy_start", "buy_basis", F.col("__end.t").alias("round_end"), F.col("__end.basis").alias("end_basis"))


def sample_facts(series: DataFrame, phases: DataFrame, keys: Sequence[str], rules: SampleRules, limit: float = 100.0) -> DataFrame:
    """keys, t, round, fourteen facts and `events` (a sorted array) of each sample.

    series: t (once a key), round and ordinal (null: in none), role, side, own (the subject's own view), hud, timer, ally, enemy, planted, carried, charges (three utilities and an ultimate), feed (whether
    a feed was read), kills (new ones: own_victim, own_killer), death (a reconciled one falls on this sample). phases: see round_phases."""
    order = Window.partitionBy(*keys).orderBy("t")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # The latest round, by number, that had begun: its anchors come before samples of the same time.
    anchor = F.least(F.coalesce("combat_start", "buy_start"), F.coalesce("buy_start", "combat_start"))
    began = phases.select(*keys, anchor.alias("t"), F.struct("ordinal", "combat_start", "buy_start", "round_end").alias("__phase")).filter(F.col("t").isNotNull())
    both = series.withColumn("__sample", F.lit(1)).unionByName(began.withColumn("__sample", F.lit(0)), allowMissingColumns=True)
    begun = Window.partitionBy(*keys).orderBy("t", "__sample").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__in", F.max("__phase").over(begun)).filter("__sample = 1").drop("__phase", "__sample")
    t = F.col("t")
    combat = F.col("__in.combat_start").isNotNull() & (t >= F.col("__in.combat_start"))
    phase = F.when(combat & (F.col("__in.round_end").isNull() | (t <= F.col("__in.round_end"))), "combat").when(~combat & (t >= F.col("__in.buy_start")), "buy")
    mine = F.coalesce(F.col("own") & F.col("hud"), F.lit(False))
    now = F.struct("t", "round", "charges")
    rows = rows.withColumns({
        "__phase": phase, "__mine": mine, "__first_row": F.row_number().over(order) == 1, "__before": F.lag(F.struct("t", "round", "ally", "enemy")).over(order),
        "__self": F.last(F.when(mine, now), ignorenulls=True).over(earlier), "__self_now": F.last(F.when(mine, now), ignorenulls=True).over(so_far),
        "__spike": F.last(F.when(F.col("planted").isNotNull(), F.struct("round", "planted")), ignorenulls=True).over(earlier), "__killed": F.coalesce(F.size("kills") > 0, F.lit(False)),
    })
    in_round = Window.partitionBy(*keys, "round").orderBy("t")
    bought = Window.partitionBy(*keys, "__phase", F.col("__in.ordinal")).orderBy("t")
    rows = rows.withColumn("__kill_no", F.count(F.when(F.col("__killed"), 1)).over(in_round.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__buy_no", F.row_number().over(bought))
    near = lambda other: F.coalesce((t - F.col(f"{other}.t") <= rules.longest) & F.col(f"{other}.round").eqNullSafe(F.col("round")), F.lit(False))
    charged = lambda charges: F.size(F.filter(F.slice(charges, 1, 3), lambda c: c >= rules.charged))
    counted = F.col("ally").isNotNull() & F.col("enemy").isNotNull() & (F.col("ally") > 0) & (F.col("enemy") > 0)
    first_kill = F.col("__killed") & F.col("round").isNotNull() & (F.col("__kill_no") == 1)
    dead = F.coalesce("death", F.lit(False))
    left = F.when(dead & F.col("__self_now").isNotNull() & (t - F.col("__self_now.t") <= rules.longest), charged(F.col("__self_now.charges")))
    drop = F.array_max(F.zip_with(F.slice("__self.charges", 1, 3), F.slice("charges", 1, 3), lambda a, b: a - b))
    fell = lambda c: (F.col(c) > 0) & (F.col(c) < F.col(f"__before.{c}"))
    planted_now = F.coalesce(F.col("planted"), F.lit(False))
    facts = {
        "player_role": F.col("role"), "buy_phase_observed": F.when(F.col("__phase") == "buy", True),
        "round_time_remaining_sec": F.when((F.col("__phase") == "combat") & ~planted_now, F.coalesce("timer", F.greatest(F.lit(0.0), limit - (t - F.col("__in.combat_start"))))),
        "side": F.col("side"), "spike_carried_by_player": F.when(F.coalesce(F.col("own") & F.col("carried"), F.lit(False)), True).when(F.col("side") == "defense", False),
        "numbers_state": F.when(counted, F.when(F.col("ally") > F.col("enemy"), "advantage").when(F.col("ally") < F.col("enemy"), "disadvantage").otherwise("even")),
        "clutch_state": F.when(counted & F.coalesce("own", F.lit(False)), F.col("ally") == 1), "utility_available_count": F.coalesce(left, F.when(F.col("__mine"), charged(F.col("charges")))),
        "ultimate_available": F.when(F.col("__mine"), F.get("charges", F.lit(3)) >= rules.ultimate), "player_died": F.when(dead, True).when(F.col("__mine"), False),
        "first_death_by_player": F.when(first_kill, F.get("kills", F.lit(0))["own_victim"]), "first_kill_by_player": F.when(first_kill, F.get("kills", F.lit(0))["own_killer"]),
        "spike_planted": F.col("planted"), "objective_state_observed": F.when(F.col("planted").isNotNull(), True),
    }
    planted_event = planted_now & F.coalesce(F.col("__spike.round").eqNullSafe(F.col("round")) & ~F.col("__spike.planted"), F.lit(False))
    unread = ~F.coalesce("feed", F.lit(False)) & ~F.col("__killed") & near("__before") & F.col("ally").isNotNull() & F.col("enemy").isNotNull() & F.col("__before.ally").isNotNull() & F.col("__before.enemy").isNotNull() & (fell("ally") | fell("enemy"))
    events: dict[str, Column] = {
        "round_start": F.col("round").isNotNull() & (F.col("__first_row") | ~F.col("__before.round").eqNullSafe(F.col("round"))), "buy_phase": (F.col("__phase") == "buy") & (F.col("__buy_no") == 1), "state_snapshot": counted,
        "ability_state": F.col("__mine"), "utility_used": F.col("__mine") & near("__self") & (drop >= rules.used), "player_death": dead, "kill": F.col("__killed") | unread, "spike_planted": planted_event, "objective_state": planted_event,
    }
    named = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in events.items()])))
    return rows.select(*keys, "t", "round", *[c.alias(f"fact_{name}") for name, c in facts.items()], named.alias("events"))
