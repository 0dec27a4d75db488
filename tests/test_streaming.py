"""Streams give what the batch operators give over the same rows."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.streaming import events as S

SF = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def source(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    """The events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    spark.read.parquet(SF).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def out(spark: SparkSession, rows, tmp_path: Path):
    S.run_available(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_tumbling_windows_close_behind_the_watermark(spark: SparkSession, source: str, tmp_path: Path) -> None:
    got = {(r.start, r.event_type): r.n for r in out(spark, S.tumbling(S.read_events(spark, source), "1 hour", "1 day", "event_type"), tmp_path).collect()}
    batch = spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    want = {(r.w.start, r.event_type): r["count"] for r in batch.collect()}
    last = max(s for s, _ in want)
    assert got and {k: v for k, v in want.items() if k[0] < last} == {k: v for k, v in got.items() if k[0] < last}


def test_sessions(spark: SparkSession, source: str, tmp_path: Path) -> None:
    got = out(spark, S.sessions(S.read_events(spark, source), "1 hour", "12 hours", "user_id"), tmp_path)
    batch = spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").count()
    want = {(r.user_id, r.w.start): r["count"] for r in batch.collect()}
    rows = got.collect()
    assert rows and all(want[r.user_id, r.start] == r.n for r in rows)


def test_duplicates_go_once(spark: SparkSession, source: str, tmp_path: Path) -> None:
    assert out(spark, S.first_of(S.read_events(spark, source), "60 days", "user_id"), tmp_path).count() == spark.read.parquet(SF).select("user_id").distinct().count()


def test_debounce_resumes_after_its_checkpoint(spark: SparkSession, tmp_path: Path) -> None:
    h = 3_600_000_000

    def add(i: int, rows: list[tuple]) -> None:
        frame = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string")
        frame.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run() -> set[tuple]:
        rows = S.debounced(S.read_events(spark, str(tmp_path / "in")), "user_id", 2 * h, 24 * h)
        return {(r.user_id, r.label, r.since, r.confirmed) for r in out(spark, rows, tmp_path).collect()}

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    add(0, [(1, 0, 7, "a"), (2, h, 7, "a"), (3, 0, 8, "b")])
    assert run() == set()
    add(1, [(4, 3 * h, 7, "a"), (5, h, 8, "c"), (6, 40 * h, 8, "c")])
    assert run() == {(7, "a", 0, 3 * h)}
    add(2, [(7, 41 * h, 8, "c"), (8, 42 * h, 8, "c")])
    assert run() == {(7, "a", 0, 3 * h), (8, "c", 40 * h, 42 * h)}


def test_timers_in_a_stream_give_the_events_of_the_batch(spark: SparkSession, tmp_path: Path) -> None:
    """Rows come in eight files, each out of order within the watermark's delay; a far row at last lets all timers fall due."""
    import datetime
    import random

    from tallyloom.operators import timers
    from tallyloom.streaming import timed

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    begin = datetime.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(240):
        t += rng.choice([0.1, 0.4, 0.7, 3.0, 3.1, 6.0])
        rows.append((rng.choice(["a", "b"]), begin + datetime.timedelta(seconds=round(t, 1)), i, rng.choice(["seen", "fire", "still", "move"])))
    schema = "k string, ts timestamp, i long, kind string"
    path = str(tmp_path / "in")
    for n in range(8):
        part = rows[n * 30 : (n + 1) * 30]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    for extra in (3600, 7200, 10800):
        spark.createDataFrame([("far", begin + datetime.timedelta(seconds=t + extra), 999, "move")], schema).coalesce(1).write.mode("append").parquet(path)
    machine = timers.encounters("seen", "fire", "still", "move", "cut", lost=1_500_000, quiet=4_000_000, burst=900_000, again=9_000_000, hold=3_000_000)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    stream = timed.timed_fold(source, ["k"], "ts", "2 minutes", "i", ["kind"], machine, "k string, what string, since long, at long, n long")
    got = sorted(map(repr, map(tuple, out(spark, stream, tmp_path).collect())))
    batch = timers.timed_fold(spark.createDataFrame(rows, schema).withColumn("t", F.unix_micros("ts")), ["k"], "t", "i", ["kind"], machine, "k string, what string, since long, at long, n long")
    want = sorted(map(repr, map(tuple, batch.collect())))
    assert got == want and len({e.split("'")[3] for e in want}) == 8
