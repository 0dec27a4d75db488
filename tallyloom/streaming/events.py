"""Structured Streaming forms of the timeline operators. Each takes a streaming DataFrame of events and returns one; late
rows are dropped by the watermark, and state is bounded by it or by the number of live keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of events as they arrive; ts becomes a timestamp with zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, late: str, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts and sums in windows that close once the watermark has passed them."""
    g = rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(rows: DataFrame, late: str, gap: str, *keys: str) -> DataFrame:
    """Sessions that a gap ends."""
    g = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys)
    return g.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of(rows: DataFrame, late: str, *keys: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


class _Debounce(StatefulProcessor):
    """Reports a key's label once it has stood for `hold` microseconds; going back in time or a long gap starts anew."""

    def __init__(self, key: str, hold: int, gap: int) -> None:
        self.key, self.hold, self.gap = key, hold, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "label string, since long, last long, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["t", "event_id"])  # one micro-batch of one key
        label, since, last, told = self.state.get() if self.state.exists() else (None, 0, None, False)
        out = []
        for t, now in zip(frame["t"].tolist(), frame["event_type"].tolist(), strict=True):
            if last is None or now != label or t < last or t - last > self.gap:
                label, since, told = now, t, False
            elif not told and t - since >= self.hold:
                told = True
                out.append((key[0], label, since, t))
            last = t
        self.state.update((label, since, last, told))
        yield pd.DataFrame(out, columns=[self.key, "label", "since", "confirmed"])

    def close(self) -> None:
        pass


def debounced(rows: DataFrame, key: str, hold: int, gap: int) -> DataFrame:
    """key, label, since, confirmed (microseconds): labels that stood for `hold`. One small state per key."""
    out = StructType().add(rows.schema[key]).add("label", "string").add("since", "long").add("confirmed", "long")
    timed = rows.withColumn("t", F.unix_micros("ts")).select(key, "t", "event_id", "event_type")
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=_Debounce(key, hold, gap), outputStructType=out, outputMode="Append", timeMode="None")


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write Parquet and stop; run again to resume after the checkpoint."""
    rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Hand each micro-batch to write(batch, number); numbers repeat after a failure, so writes that go by them stay exact."""
    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
