"""Shared helpers of the corpus operators: tables, scratch folders and flat views of Arrow text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that numpy works on at once: arrays of eight bytes a character stay under what malloc keeps for good.
PIECE = 512 << 10

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/tallyloom/{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps don't recompute it if executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                drop_path(spark, path.rsplit("/", 1)[0])
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def fold() -> F.Column:
    """crc32(doc_id as text) mod 4: documents with 2 are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow column (null: empty), and where each begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """One scrambled uint64 for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def gram_hash(data: np.ndarray, levels: int, seed: int = 7) -> np.ndarray:
    """Hash of the 2**levels bytes from each position on, by doubling; shorter than data by 2**levels - 1."""
    h = byte_table(seed)[data]
    for level in range(levels):
        step = 1 << level
        if len(h) <= step:
            return h[:0]
        a = h[:-step] * np.uint64(0x9FB21C651E98DF25 + 2 * level)
        h = (a ^ (a >> np.uint64(29))) + h[step:]
    return h * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(32))


_R = 0x9E3779B97F4A7C15  # odd: powers have inverses modulo 2**64
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse, up to n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE)
        base = np.full((2, size), _R, np.uint64)
        base[1] = pow(_R, -1, 1 << 64)
        base[:, 0] = 1
        up, down = np.cumprod(base, axis=1, dtype=np.uint64)
        _powers = up, down
    return _powers[0][:n], _powers[1][:n]


#: Byte classes: ASCII capitals folded; what separates words: white space, or all ASCII but letters and digits.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SIGN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (with ASCII capitals folded), and where each text's words begin and end among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = ~separates[low]
    edge = np.zeros(len(data) + 1, bool)  # a new word may begin: after a separator or at a text's beginning
    edge[0] = True
    edge[1:] = ~inside
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    ending = np.ones(len(data), bool)
    ending[:-1] = ~inside[1:]
    ending[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & ending) + 1
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(11)[low] * up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    return h, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and the index of each run's first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.zeros(n, np.uint64)
    for j in range(size):
        s += h[j : j + n] * np.uint64((0xD1342543DE82EF95 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    first = np.arange(n)
    whole = first + size <= bounds[np.searchsorted(bounds, first, side="right")]
    return mix(s[whole]), first[whole]
