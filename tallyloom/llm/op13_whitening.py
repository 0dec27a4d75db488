"""Embedding whitening from a tiled covariance.

Each vector becomes whole numbers x (floor of SCALE times each entry). The fit list, each distinct x once, is written to the shared
folder. Its sums are exact. The dimensions are cut into column blocks of at most TILE; a pair of blocks is a tile. Rows of the fit
list are packed into row-blocks of about BLOCK bytes a column block, and each column block of a row-block goes, as small integers, to
the tiles that it is a side of: the shuffle is keyed by tile and slot (row-block modulo the number of shuffle partitions, so that a
tile is many tasks), and rows arrive in the order of row-blocks. A task holds two column blocks and one tile: it centres, multiplies
and sums; a second pass sums the slots of each tile. The tiles of a vector length are then put together and decomposed in one task,
whose memory is the square of the vector length, whatever the number of rows.

The driver holds, for each vector length, the sums and COMPONENTS vectors, never rows. Wider vectors have proportionally more tiles
of TILE columns each; where that would send a block to more than MOST_TILES tiles, blocks are wider instead.

Defined results: vectors that are null or hold null or non-finite entries are left out; vectors of each length are fitted by
themselves, empty ones give no rows; equal vectors count once in the fit and come back each; a null vec_id is kept; components
with no variance (below FLAT of the largest) have a null `whitened` and count in no error; `explained` is null if nothing varies; a
`deviation` beyond a long is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, COMPONENTS, TILE, MOST_TILES, BLOCK, FLAT = 256, 4, 32, 8, 1 << 20, 1e-12
BATCH = 4096
Fit = dict[int, dict]


def as_integers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x of the vectors that take part."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("long"))
    return vectors.filter(F.coalesce(usable, F.lit(False)) & (F.size("embedding") > 0)).select("vec_id", F.size("embedding").alias("dim"), x.alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of its rows, their vectors as a matrix) of a batch with columns dim and x."""
    if not batch.num_rows:
        return
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    column = batch.column("x")
    for dim in np.unique(dims).tolist():
        places = np.flatnonzero(dims == dim)
        rows = column if len(places) == batch.num_rows else column.take(pa.array(places))
        yield dim, places, rows.flatten().to_numpy(zero_copy_only=False).reshape(len(places), dim)


def scaled(x: np.ndarray, fit: dict) -> np.ndarray:
    """n * x - S: int64 where that is exact, else Python integers."""
    n, sums = fit["n"], fit["sums"]
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if most * n + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, fit: dict) -> np.ndarray:
    """x - S / n as doubles, rounded once."""
    return (scaled(x, fit) / fit["n"]).astype(np.float64)


def summed(fit_rows: DataFrame) -> Fit:
    """n and exact sums of each dimension, by vector length."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                own = held.setdefault(dim, [0, np.zeros(dim, object)])
                own[0] += len(x)
                own[1] += high.astype(object) * (1 << 32) + low.astype(object)
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "place": k, "n": n, "high": int(s) >> 32, "low": int(s) & 0xFFFFFFFF} for k, s in enumerate(sums)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    partial = fit_rows.mapInArrow(parts, "dim int, place int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    total = partial.groupBy("dim", "place").agg(F.sum("n").alias("n"), wide("high"), wide("low"))
    fit: Fit = {}
    for r in total.orderBy("dim", "place").collect():  # a row for each dimension
        own = fit.setdefault(r.dim, {"n": r.n, "sums": []})
        own["sums"].append((int(r.high) << 32) + int(r.low))
    return fit


def edges(dim: int) -> list[tuple[int, int]]:
    """The column blocks of vectors of a length."""
    width = max(TILE, -(-dim // MOST_TILES))
    return [(a, min(a + width, dim)) for a in range(0, dim, width)]


def column_blocks(fit_rows: DataFrame, slots: int) -> DataFrame:
    """Every column block of every row-block, once for each tile: dim, a, b (the tile), slot, block, side, bits, data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        count = 0
        for batch in batches:
            for dim, _, matrix in matrices(batch):
                blocks = edges(dim)
                step = max(1, BLOCK // (8 * (blocks[0][1] - blocks[0][0])))
                for at in range(0, len(matrix), step):
                    x = matrix[at : at + step]
                    ident, count = (task << 32) + count, count + 1
                    sides = []
                    for lo, hi in blocks:
                        part = np.ascontiguousarray(x[:, lo:hi])
                        kind = np.result_type(np.min_scalar_type(part.min()), np.min_scalar_type(part.max()), np.int8)
                        kind = kind if kind.kind == "i" else np.dtype(np.int64)
                        sides.append((kind.itemsize, part.astype(kind).tobytes()))
                    rows = [(a, b, k) for a in range(len(blocks)) for b in range(a, len(blocks)) for k in ((a, b) if a != b else (a,))]
                    out = {"dim": [dim] * len(rows), "a": [r[0] for r in rows], "b": [r[1] for r in rows], "slot": [(task + count) % slots] * len(rows), "block": [ident] * len(rows), "side": [r[2] for r in rows], "bits": [sides[r[2]][0] for r in rows], "data": [sides[r[2]][1] for r in rows]}
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return fit_rows.mapInArrow(pack, "dim int, a int, b int, slot int, block long, side int, bits int, data binary")


def tiles(blocks: DataFrame, fit: Fit, slots: int) -> DataFrame:
    """Sums of centred products of each tile: dim, a, b, slot, data (doubles). Rows of a tile and slot are read as a stream."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, left = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["dim"], r["a"], r["b"], r["slot"])
                if own != key:
                    if key is not None:
                        yield tile_row(key, total)
                    key, total = own, 0.0
                lo, hi = edges(r["dim"])[r["side"]]
                x = np.frombuffer(r["data"], f"<i{r['bits']}").astype(np.int64).reshape(-1, hi - lo)
                part = centred(x, {"n": fit[r["dim"]]["n"], "sums": fit[r["dim"]]["sums"][lo:hi]})
                if r["a"] == r["b"]:
                    total = total + part.T @ part
                elif r["side"] == r["a"]:
                    left = part  # the other side of the same row-block comes next
                else:
                    total = total + left.T @ part
        if key is not None:
            yield tile_row(key, total)

    order = ["dim", "a", "b", "slot", "block", "side"]
    return blocks.repartition("dim", "a", "b", "slot").sortWithinPartitions(*order).mapInArrow(multiply, "dim int, a int, b int, slot int, data binary")


def tile_row(key: tuple, total: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*key, np.ascontiguousarray(total, np.float64).tobytes()], kinds, strict=True)], names=["dim", "a", "b", "slot", "data"])


def tile_sums(partial: DataFrame) -> DataFrame:
    """One row for each tile: the sum over its slots, in their order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["dim"], r["a"], r["b"], 0)
                if own != key:
                    if key is not None:
                        yield tile_row(key, total)
                    key, total = own, 0.0
                total = total + np.frombuffer(r["data"], np.float64)
        if key is not None:
            yield tile_row(key, total)

    return partial.repartition("dim", "a", "b").sortWithinPartitions("dim", "a", "b", "slot").mapInArrow(add, "dim int, a int, b int, slot int, data binary")


def decomposed(sums: DataFrame, fit: Fit) -> DataFrame:
    """dim, component (from 1), e, trace, vector: the leading eigenvectors of each length's covariance."""
    counts = {dim: own["n"] for dim, own in fit.items()}

    def solve(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        blocks = edges(dim)
        v = np.zeros((dim, dim))
        for r in group.to_pylist():
            (a, a2), (b, b2) = blocks[r["a"]], blocks[r["b"]]
            v[a:a2, b:b2] = np.frombuffer(r["data"], np.float64).reshape(a2 - a, b2 - b) / counts[dim]
            v[b:b2, a:a2] = v[a:a2, b:b2].T
        values, vectors = np.linalg.eigh(v)
        top = range(dim - 1, max(dim - 1 - COMPONENTS, -1), -1)
        rows = [{"dim": dim, "component": k + 1, "e": float(values[i]), "trace": float(np.trace(v)), "vector": vectors[:, i].tolist()} for k, i in enumerate(top)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("dim", pa.int32()), ("component", pa.int32()), ("e", pa.float64()), ("trace", pa.float64()), ("vector", pa.list_(pa.float64()))]))

    return sums.groupBy("dim").applyInArrow(solve, "dim int, component int, e double, trace double, vector array<double>")


def whitened(x: np.ndarray, fit: dict) -> np.ndarray:
    """Columns: the components; NaN for those without variance. Summed row by row: equal vectors get equal values in any batch."""
    away = centred(x, fit)
    return np.stack([(away * v).sum(axis=1) for v in fit["vectors"]], axis=1) / fit["roots"]


def identity_errors(fit_rows: DataFrame, fit: Fit) -> dict[int, float | None]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by vector length."""
    used = {dim: np.flatnonzero(~np.isnan(own["roots"])) for dim, own in fit.items()}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Moments about the task's own mean, brought together batch by batch.
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                w = whitened(x, fit[dim])[:, used[dim]]
                mean = w.mean(axis=0)
                held[dim] = pooled(held.get(dim), (len(w), mean, (w - mean).T @ (w - mean)))
        for dim, (n, mean, products) in held.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "n": n, "mean": mean.tolist(), "products": products.ravel().tolist()}], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])

    def join(group: pa.Table) -> pa.Table:
        held = None
        for r in group.to_pylist():  # a row for each task
            mean = np.array(r["mean"])
            held = pooled(held, (r["n"], mean, np.array(r["products"]).reshape(len(mean), len(mean))))
        n, mean, products = held
        off = float(np.abs(products / n - np.eye(len(mean))).max()) if len(mean) else None
        return pa.table({"dim": group.column("dim").slice(0, 1), "error": pa.array([off], pa.float64())})

    partial = fit_rows.mapInArrow(parts, "dim int, n long, mean array<double>, products array<double>")
    return {r.dim: r.error for r in partial.groupBy("dim").applyInArrow(join, "dim int, error double").collect()}


def pooled(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and products about the mean of two sets of rows together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fitted(fit_rows: DataFrame) -> Fit:
    """By vector length: n, sums, values, trace, vectors, roots of the values (NaN: no variance) and error."""
    fit = summed(fit_rows)
    if not fit:
        return fit
    slots = int(fit_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = decomposed(tile_sums(tiles(column_blocks(fit_rows, slots), fit, slots)), fit)
    for r in found.orderBy("dim", "component").collect():  # COMPONENTS rows for each length
        own = fit[r.dim]
        own["trace"] = r.trace
        own.setdefault("values", []).append(r.e)
        own.setdefault("vectors", []).append(r.vector)
    for own in fit.values():
        own["vectors"] = np.array(own["vectors"])
        e = np.array(own["values"])
        own["roots"] = np.sqrt(np.where((e > 0) & (e > FLAT * e[0]), e, np.nan))
    for dim, error in identity_errors(fit_rows, fit).items():
        fit[dim]["error"] = error
    return fit


def deviations(x: np.ndarray, fit: dict) -> list[int | None]:
    """Sum of squares of n * x - S for each row, exact."""
    away = scaled(x, fit)
    if away.dtype != object:
        most = max(int(away.max()), -int(away.min()))
        if most * most * x.shape[1] < 1 << 63:
            return (away * away).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in away)]


def whiten(vectors: DataFrame) -> DataFrame:
    """For each vector and component up to COMPONENTS: vec_id, component, n, deviation, whitened, explained, identity_error."""
    usable = as_integers(vectors)
    fit_rows = cut(usable.select("dim", "x").distinct(), "whitening_fit")
    fit = fitted(fit_rows)
    kinds = [("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places, x in matrices(batch):
                own = fit[dim]
                w = whitened(x, own)
                k = w.shape[1]
                explained = [e / own["trace"] if own["trace"] > 0 else None for e in own["values"]]
                idents = batch.column("vec_id").take(pa.array(np.repeat(places, k)))
                each = [int(d) if d is not None else None for d in deviations(x, own)]
                values = [list(range(1, k + 1)) * len(x), [own["n"]] * (len(x) * k), [d for d in each for _ in range(k)], pa.array(w.ravel(), from_pandas=True), explained * len(x), [own["error"]] * (len(x) * k)]
                yield pa.RecordBatch.from_arrays([idents, *[pa.array(v, t) if isinstance(v, list) else v for v, (_, t) in zip(values, kinds, strict=True)]], names=["vec_id", *[name for name, _ in kinds]])

    return usable.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
