"""Machines in blocks against folds of whole keys, and a block's map against running from its start."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import fold, transducer
from tallyloom.operators.transducer import Ask, Cases, applied

MACHINES = {
    "latch": (transducer.latch("a", "b", 2), [(k, f) for k in range(3) for f in (None, -5)]),
    "debounce": (transducer.debounce(6), [(n, x, s) for n in (None, "a", "b", "q") for x, s in ((None, None), ("a", -4), ("b", -9), ("q", -1))]),
    "lifecycle": (transducer.lifecycle(("a", "b", "c", "d"), 5.0, 7), [(a, p, s) for a, p in ((None, None), (-9, None), (-9, -8)) for s in (None, -2, -7, -20)]),
}


def random_rows(name: str, rng: random.Random, n: int, step: int = 3) -> list[tuple]:
    t, out = 0, []
    for i in range(n):
        t += rng.randrange(step)
        kind = rng.choice(["a", "b", "c", "d"] if name == "lifecycle" else ["a", "b", None] if name == "debounce" else ["a", "b", "x"])
        out.append({"latch": (t, kind), "debounce": (i, t, kind), "lifecycle": (t, kind, rng.choice([None, 4.9, 5.0, 8.0]))}[name])
    return out


@pytest.mark.parametrize("name", MACHINES)
def test_map_of_a_block_equals_running_from_every_state(name: str) -> None:
    machine, states = MACHINES[name]
    rng = random.Random(name)
    for trial in range(150):
        rows = random_rows(name, rng, rng.randrange(1, 25))
        cases = Cases(machine)
        for r in rows:
            cases.read(r)
        text = cases.text()
        for state in states:
            want = state
            for r in rows:
                want = machine.step(want, r, Ask())[0]
            assert applied(text, state) == want, (trial, rows, state)


def test_cases_stay_few() -> None:
    machine = transducer.debounce(1000)
    cases = Cases(machine)
    for t in range(600):  # a long run that never breaks: one threshold, however many rows ask
        cases.read((t, t, "a"))
    assert len(cases.runs) <= 5


def test_two_maps_compose() -> None:
    machine, states = MACHINES["debounce"]
    rows = random_rows("debounce", random.Random(3), 40)
    for cut_at, state in itertools.product((1, 7, 20, 39), states):
        halves = [Cases(machine), Cases(machine)]
        for half, part in zip(halves, (rows[:cut_at], rows[cut_at:]), strict=True):
            for r in part:
                half.read(r)
        whole = state
        for r in rows:
            whole = machine.step(whole, r, Ask())[0]
        assert applied(halves[1].text(), applied(halves[0].text(), state)) == whole


@pytest.mark.parametrize("every", [1, 7, 10_000])
def test_blocks_equal_folds_of_whole_keys(spark: SparkSession, every: int) -> None:
    rng = random.Random(every)
    rows = []
    for k in (None, "hot", "small", "one"):
        t = -50
        for i in range({"hot": 900, "one": 1}.get(k, 40)):
            t += rng.choice([0, 0, 1, 2, 9])
            rows.append((k, t, i, rng.choice(["a", "b", "c", "d"]), rng.choice(["a", "b", None]), rng.choice([None, 4.0, 5.0, 9.0, float("nan")])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, i long, kind string, label string, v double").repartition(4)
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    blocked = lambda columns, machine, schema: transducer.blocked_fold(df, ["k"], "t", "i", columns, machine, every, schema)
    assert same(blocked(["t", "kind"], transducer.latch("a", "b", 2), "start long, end long"), fold.latched_intervals(df, ["k"], "t", "i", "kind", "a", "b", 2, "k string"))
    assert same(blocked(["i", "t", "label"], transducer.debounce(4), "i long, label string"), fold.debounced(df, ["k"], "t", "i", "label", 4, "k string"))
    signs = ("a", "b", "c", "d")
    assert same(blocked(["t", "kind", "v"], transducer.lifecycle(signs, 5.0, 3), "armed long, pending long, ended long"), fold.lifecycles(df, ["k"], "t", "i", "kind", "v", signs, 5.0, 3, "k string"))


def test_hot_key_is_many_tasks(spark: SparkSession) -> None:
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    blocks = transducer.dealt(rows, ["k"], "t", "i", ["t", "kind"], 500)
    maps = transducer.block_maps(blocks, ["k"], 2, transducer.latch("a", "b", 1))
    assert maps.count() == 40
    assert maps.select(F.max(F.length("cases"))).first()[0] < 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert maps.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "k string, t long, i long, kind string")
    assert transducer.blocked_fold(none, ["k"], "t", "i", ["t", "kind"], transducer.latch("a", "b", 2), 5, "start long, end long").count() == 0
