"""Tables whose partitions are replaced as a whole, behind checks, and never seen half replaced.

A replacement is first written aside, with the list of partitions that it stands for. Then its rows are checked. Only if all
checks hold is one small file put into the manifest by a rename that fails if the name is taken: readers see all of it or nothing,
and of two writers at the same version one is told to try again. A partition's rows are those of the newest entry that stands for
it, rows or none; whatever the checks refuse is removed and what stood before stays readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import _hadoop, drop_path, path_exists


class Refused(ValueError):
    """A replacement that broke checks: reasons, with the number of rows for each."""

    def __init__(self, reasons: Mapping[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {n}" for k, n in reasons.items()))
        self.reasons = dict(reasons)


class Conflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class SwapTable:
    """A table under a path, in partitions by columns; `ident` names a row within the whole table."""

    spark: SparkSession
    path: str
    schema: str
    by: Sequence[str]
    ident: str

    def entries(self) -> list[dict]:
        """The manifest, oldest first: version, data (path) and keys (path)."""
        files, folder = _hadoop(self.spark, f"{self.path}/manifest")
        if not files.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(folder)]
        published = sorted(n for n in names if n.endswith(".json"))
        if not published:
            return []
        lines = self.spark.read.schema("version long, data string, keys string").json([f"{self.path}/manifest/{n}" for n in published])
        return [r.asDict() for r in lines.orderBy("version").collect()]  # a row for each replacement since the last compaction

    def _marked(self, kind: str, schema: StructType) -> DataFrame | None:
        out: DataFrame | None = None
        for e in self.entries():
            one = self.spark.read.schema(schema).parquet(e[kind]).withColumn("__version", F.lit(e["version"]))
            out = one if out is None else out.unionByName(one)
        return out

    def read(self) -> DataFrame:
        """The rows as of the newest version."""
        schema = StructType.fromDDL(self.schema)
        rows, keys = self._marked("data", schema), self._marked("keys", StructType([schema[c] for c in self.by]))
        if rows is None or keys is None:
            return self.spark.createDataFrame([], schema)
        newest = keys.groupBy(*[F.col(c).alias(f"__{c}") for c in self.by]).agg(F.max("__version").alias("__newest"))
        same = F.col("__version") == F.col("__newest")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return rows.join(newest, same, "left_semi").select(*schema.names)

    def replace(self, rows: DataFrame, partitions: DataFrame | None = None, parents: DataFrame | None = None, rules: Mapping[str, Column] | None = None, expected: DataFrame | None = None) -> int:
        """Put rows in the place of their partitions, and of the given ones (which may be left without rows); returns the version.

        Refused are rows with a null or repeated ident, idents that another partition owns, partitions outside the given ones or
        without a parent (a table of the columns by), rows that break a rule (not true, null included), and, where `expected` (a
        table of idents) is given, idents that are missing or not expected."""
        schema = StructType.fromDDL(self.schema)
        version = max((e["version"] for e in self.entries()), default=0) + 1
        place = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{place}/data")
        staged = self.spark.read.schema(schema).parquet(f"{place}/data")
        own = staged.select(*self.by)
        (own if partitions is None else partitions.select(*self.by)).distinct().write.parquet(f"{place}/keys")
        keys = self.spark.read.schema(StructType([schema[c] for c in self.by])).parquet(f"{place}/keys")
        reasons = self._broken(staged, keys, parents, rules or {}, expected)
        if reasons:
            drop_path(self.spark, place)
            raise Refused(reasons)
        self._publish(version, {"version": version, "data": f"{place}/data", "keys": f"{place}/keys"})
        return version

    def _outside(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of partitions that don't stand in keys."""
        marked = keys.select(*[F.col(c).alias(f"__{c}") for c in self.by]).distinct()
        same = F.lit(True)
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return rows.join(marked, same, "left_anti")

    def _broken(self, staged: DataFrame, keys: DataFrame, parents: DataFrame | None, rules: Mapping[str, Column], expected: DataFrame | None) -> dict[str, int]:
        ident = F.col(self.ident)
        counted = staged.agg(F.count(F.when(ident.isNull(), 1)).alias("null ident"), *[F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(name) for name, rule in rules.items()]).first().asDict()
        repeated = staged.filter(ident.isNotNull()).groupBy(ident).count().filter("count > 1")
        others = self._outside(self.read(), keys).select(self.ident)
        checks = {"repeated ident": repeated, "owned by another partition": staged.join(others, self.ident, "left_semi"), "outside of the partitions": self._outside(staged, keys)}
        if parents is not None:
            checks["without a parent"] = self._outside(keys, parents)
        if expected is not None:
            checks["missing"] = expected.select(self.ident).distinct().join(staged, self.ident, "left_anti")
            checks["not expected"] = staged.join(expected, self.ident, "left_anti")
        return {k: n for k, n in (counted | {k: rows.count() for k, rows in checks.items()}).items() if n}

    def _publish(self, version: int, entry: dict) -> None:
        """One file, by a rename that doesn't overwrite."""
        jvm = self.spark.sparkContext._jvm
        files, folder = _hadoop(self.spark, f"{self.path}/manifest")
        files.mkdirs(folder)
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = files.create(aside, False)
        stream.write(bytearray((json.dumps(entry) + "\n").encode()))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{version:012d}.json")
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(aside, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            files.delete(aside, False)
            if path_exists(self.spark, f"{self.path}/manifest/{version:012d}.json"):
                raise Conflict(f"version {version} was published meanwhile") from e
            raise

    def compact(self) -> int:
        """Write what stands now as one replacement of all partitions."""
        return self.replace(self.read(), self.read().select(*self.by).distinct())
