"""A fold that revises itself: late and shuffled rows retract what was said before and say it anew.

The output is a changelog: every batch of arrivals adds rows with a signed count `n`, and the sum over all batches is the fold of all
rows so far in order. Only blocks of time whose rows came late, or whose state at the beginning changed because of that, are
worked out again; the wave stops at the first block whose beginning is as it was. Everything is written by batch number under one
folder, and a batch that is repeated writes the same again, so it can be the body of foreachBatch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources.tables import path_exists

from .transducer import Machine, block_maps, block_starts, dealt, emitted, heeded


def within(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """rows whose keys, nulls included, stand in others (or don't: left_anti)."""
    marked = others.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(marked, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)


@dataclass(frozen=True)
class RetractingFold:
    """A machine (see `transducer`) over rows that arrive in batches; schema: what the machine gives."""

    root: str
    keys: Sequence[str]
    time: str
    tie: str
    columns: Sequence[str]
    machine: Machine
    every: int
    schema: str

    def _stored(self, spark: SparkSession, what: str, until: int, like: StructType | None) -> DataFrame | None:
        """Rows of earlier batches, with their batch; None if there are none."""
        path = f"{self.root}/{what}"
        if not path_exists(spark, path):
            return None
        rows = spark.read.option("basePath", path).parquet(path) if like is None else spark.read.schema(like.add("batch", "long") if "batch" not in like.names else like).option("basePath", path).parquet(path)
        return rows.filter(F.col("batch") < until)

    def _write(self, rows: DataFrame, what: str, batch: int) -> DataFrame:
        path = f"{self.root}/{what}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _latest(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        """For each block what the last batch says of it."""
        if old is None:
            return new
        block = [*self.keys, "block"]
        rest = [c for c in new.columns if c not in block]
        both = old.select(*block, *rest, "batch").unionByName(new.withColumn("batch", F.lit(1 << 62)))
        best = both.groupBy(*block).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
        return best.select(*block, "x.*")

    def arrive(self, arrivals: DataFrame, batch: int) -> DataFrame:
        """Take a batch of rows in; returns its part of the changelog: keys, block, output, n."""
        spark = arrivals.sparkSession
        block = [*self.keys, "block"]
        width = len(self.columns)
        fresh = self._write(dealt(heeded(arrivals, self.columns, self.machine), self.keys, self.time, self.tie, self.columns, self.every), "rows", batch)
        earlier = self._stored(spark, "rows", batch, StructType(list(fresh.schema.fields)))
        rows = fresh if earlier is None else earlier.drop("batch").unionByName(fresh)
        touched = fresh.select(*block).distinct()
        maps = self._write(block_maps(within(rows, touched, block), self.keys, width, self.machine), "maps", batch)
        all_maps = self._latest(self._stored(spark, "maps", batch, StructType(list(maps.schema.fields))), maps)
        starts = block_starts(within(all_maps, touched, self.keys), self.keys, self.machine)
        starts = self._write(starts, "starts", batch)
        before = self._stored(spark, "starts", batch, StructType(list(starts.schema.fields)))
        if before is None:
            dirty = starts.select(*block)
        else:
            last = before.groupBy(*block).agg(F.max_by(F.struct("registers", "last"), "batch").alias("x")).select(*block, "x.*")
            dirty = within(starts, last, [*block, "registers", "last"], "left_anti").select(*block).unionByName(touched).distinct()
        dirty = self._write(dirty, "dirty", batch)
        now = emitted(within(rows, dirty, block), within(starts, dirty, block), self.keys, width, self.machine, self.schema)
        names = now.columns
        delta = now.withColumn("n", F.lit(1).cast("long"))
        log = self._stored(spark, "log", batch, None)
        if log is not None:
            delta = delta.unionByName(within(log, dirty, block).select(*names, (-F.col("n")).alias("n")))
        delta = delta.groupBy(*names).agg(F.sum("n").alias("n")).filter("n <> 0")
        return self._write(delta, "log", batch)

    def changes(self, spark: SparkSession) -> DataFrame:
        """The whole changelog, with the batch that each row came from."""
        path = f"{self.root}/log"
        return spark.read.option("basePath", path).parquet(path)

    def result(self, spark: SparkSession) -> DataFrame:
        """What stands after all batches: keys and output."""
        log = self.changes(spark)
        names = [c for c in log.columns if c not in ("block", "n", "batch")]
        counted = log.groupBy(*names, "block").agg(F.sum("n").alias("n")).filter("n > 0")
        return counted.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("__i")).drop("__i")
