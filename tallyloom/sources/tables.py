"""Readers and writers: Parquet tables, JSON lines with a side file, hashed files, and rewrites of Parquet tables.

Plain Parquet has no MERGE or DELETE: the writers return the new state of a table as a DataFrame, and `replace_partitions`
writes only the partitions that changed.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder in spark.checkpoint.dir (in local mode without the setting, in a temporary one), removed at exit."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared}/tallyloom/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to a scratch path and read it again, so that later rounds of an iteration neither repeat its work nor lose it with an
    executor."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop(spark, path)
    return files.exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    files, target = _hadoop(spark, path)
    files.delete(target, True)


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone: exact, and usable in RANGE frames."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, side: DataFrame | None = None, keys: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """JSON lines; values that are null in the lines come from the side table with the same keys."""
    rows = spark.read.schema(schema).json(path)
    if side is None:
        return rows
    side = side.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    joined = rows.join(side, list(keys), "left")
    return joined.withColumns({v: F.coalesce(v, f"__{v}") for v in values}).select(rows.columns)


def read_hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file under path, hashed on the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def bound_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256) with state ok, changed or missing."""
    seen = files.select("path", F.col("sha256").alias("__seen"))
    state = F.when(F.col("__seen").isNull(), "missing").when(F.col("__seen") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(seen, "path", "left").withColumn("state", state).drop("__seen")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new inserted or, where the keys match, updated; `keep` columns stay as they were."""
    marked = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys], F.lit(True).alias("__new"))
    joined = old.withColumn("__old", F.lit(True)).join(marked, list(keys), "full")

    def pick(c: str) -> Column:
        if c in keep:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}"))
        return F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))

    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def update_one(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """rows with values set where the condition holds; fails when the result is used unless exactly one row matches."""
    hits = rows.filter(where).count()
    if hits != 1:
        raise ValueError(f"{hits} rows match, not one")
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_cascade(parent: DataFrame, gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """parent and children without the rows whose key stands in gone."""
    return [t.join(gone.select(key).distinct(), key, "left_anti").select(t.columns) for t in (parent, *children)]


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write rows over the partitions that they fall in; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_usage(rows: DataFrame, texts: dict[str, int], counters: Sequence[str]) -> DataFrame:
    """Rows with texts cut to their lengths and counters not below 0."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in texts.items()} | {c: F.greatest(F.lit(0), F.col(c)) for c in counters})


def write_report(rows: DataFrame, path: str, form: str) -> None:
    """Export rows as JSON lines or CSV; text cells are guarded against spreadsheet formulas in CSV."""
    if form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "csv":
        from tallyloom.functions.text import csv_guard

        guarded = rows.select(*[csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
        guarded.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"no report form {form!r}")
