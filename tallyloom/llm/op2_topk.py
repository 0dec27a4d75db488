"""Exact top-k inner-product search with M-trees.

Components x become the integers floor(1024 * x). Inner products turn into distances by one more coordinate: with
M the largest squared length in a block, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M - 2 q.x,
so the nearest x' has the highest score.

Index (written once): rows are dealt to cells by their nearest pivot (one for each block that the rows fill, up to PIVOTS,
spread farthest-first over a sample of at most SAMPLE rows; the sample decides where rows go, every row is indexed), cells into blocks of at most BLOCK_BYTES (a cell that
holds a third of all rows is many blocks), and each block becomes an M-tree of pages of at most PAGE entries. An entry holds
its pivot, its covering radius and its distance to the parent's pivot; a leaf's entries are in order of that distance, so
those within the bound are one slice.

Search: queries of one cell are packed. A pack first meets one block of its own cell, which gives each query a bound (its
k-th distance so far), and then, with these bounds, the blocks that the pack's ball may reach: centres and radii of packs, cells and blocks are narrow
rows; a pack meets the cells first (PIVOTS a length), then the blocks of those that may hold a score of its lowest bound, and trees
and queries are fetched only for the pairs that are left. In a block a query goes
best-first by the lower bound d(q, pivot) - radius and leaves out an entry without computing its distance if
|d(q, parent) - d(entry, parent)| - radius is beyond its bound. Scores are exact integers whatever their size.

Defined results: vectors that are null, empty, or hold null or non-finite components, take no part; only vectors of a query's
own length are candidates; rows with the query's vec_id are its own and no candidates; of repeated query ids one row (the
smallest vector) asks; repeated candidate rows each count; null ids take no part; a score among a query's best that is no
64-bit integer raises OverflowError; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PAGE, PIVOTS, SAMPLE, BLOCK_BYTES, PACK_BYTES = 256, 256, 4096, 4 << 20, 512 << 10
#: Slack of distances against rounding, as a share of the longest length.
SLACK = 1e-6
#: Sums below this are exact in doubles, and in 64 bits.
EXACT, LONG = 2.0**52, 2**63


class Page:
    """One node: entries with pivots (or vectors), their squared lengths, distances to the page's own pivot, and radii and children (None in a leaf)."""

    __slots__ = ("points", "square", "radius", "to_parent", "rows", "children")


def gaps(points: np.ndarray, square: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of points to p."""
    return np.sqrt(np.maximum(square - 2 * (points @ p) + p @ p, 0.0))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """At most n of the points, each the farthest from those chosen before."""
    square = (points**2).sum(axis=1)
    chosen = [0]
    near = gaps(points, square, points[0])
    while len(chosen) < n:
        far = int(near.argmax())
        if near[far] <= 0:
            break
        chosen.append(far)
        near = np.minimum(near, gaps(points, square, points[far]))
    return points[chosen]


def build(points: np.ndarray, rows: np.ndarray, pivot: np.ndarray) -> tuple[Page, float]:
    """A subtree over points[rows] with the given pivot, and its covering radius."""
    own = points[rows]
    square = (own**2).sum(axis=1)
    to_pivot = gaps(own, square, pivot)
    page = Page()
    if len(rows) <= PAGE:
        order = np.argsort(to_pivot, kind="stable")
        page.points, page.square, page.to_parent, page.rows = own[order], square[order], to_pivot[order], rows[order]
        page.radius = page.children = None
        return page, float(to_pivot.max(initial=0.0))
    groups = min(PAGE, math.ceil(len(rows) / PAGE) + 1)
    seeds = spread(own[:: max(1, len(own) // (8 * groups))], groups)
    nearest = np.argmin((seeds**2).sum(axis=1) - 2 * own @ seeds.T, axis=1)
    members = [(seeds[g], rows[nearest == g]) for g in range(len(seeds))]
    members = [(p, m) for p, m in members if len(m)]
    if len(members) == 1:  # equal vectors: any split has the same radius
        members = [(members[0][0], part) for part in np.array_split(members[0][1], groups)]
    built = [build(points, m, p) for p, m in members]
    page.points = np.array([p for p, _ in members])
    page.square = (page.points**2).sum(axis=1)
    page.radius = np.array([r for _, r in built])
    page.to_parent = gaps(page.points, page.square, pivot)
    page.rows, page.children = None, [c for c, _ in built]
    return page, float(to_pivot.max())


class MTree:
    """A block's tree. vectors: whole numbers as doubles, of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.scale = max(1.0, float(np.abs(vectors).max(initial=0.0)))  # geometry is done in these units
        scaled = vectors / self.scale
        square = (scaled**2).sum(axis=1)
        self.most = float(square.max())
        points = np.concatenate([scaled, np.sqrt(np.maximum(self.most - square, 0))[:, None]], axis=1)
        self.pivot = points.mean(axis=0)
        self.root, self.radius = build(points, np.arange(len(ids)), self.pivot)
        self.computed = 0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        own = self.vectors[rows]
        if len(query) * self.scale * float(np.abs(query).max(initial=0.0)) < EXACT:
            return (own @ query).astype(np.int64).tolist()
        q = [int(x) for x in query]
        return [sum(int(x) * y for x, y in zip(v, q, strict=True)) for v in own]

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k highest (score, vec_id) pairs, ties to smaller ids; with a floor those of at least that score suffice."""
        q = np.append(query / self.scale, 0.0)
        own = float(q @ q)
        reach, slack = own + self.most, SLACK * (math.sqrt(own) + math.sqrt(self.most))
        radius_of = lambda s: math.sqrt(max(reach - 2 * (s / self.scale / self.scale), 0.0) + slack * slack) + slack
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
        tau = math.inf if floor is None else radius_of(floor)
        queue = [(0.0, 0, self.root, float(gaps(self.pivot[None], np.array([self.pivot @ self.pivot]), q)[0]))]
        self.computed += 1
        order = 1
        while queue:
            bound, _, page, to_pivot = heapq.heappop(queue)
            if bound - slack > tau:
                break
            if page.children is None:
                a, b = np.searchsorted(page.to_parent, [to_pivot - tau - slack, to_pivot + tau + slack])
                self.computed += b - a
                if a == b:
                    continue
                d = gaps(page.points[a:b], page.square[a:b], q)
                rows = page.rows[a:b][d <= tau + slack]
                for s, i in zip(self.scores(rows, query), self.ids[rows].tolist(), strict=True):
                    if i == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    tau = min(tau, radius_of(best[0][0]))
                continue
            near = np.flatnonzero(np.abs(to_pivot - page.to_parent) - page.radius <= tau + slack)
            self.computed += len(near)
            d = gaps(page.points[near], page.square[near], q)
            for j, distance in zip(near.tolist(), d.tolist(), strict=True):
                bound = max(distance - page.radius[j], 0.0)
                if bound - slack <= tau:
                    heapq.heappush(queue, (bound, order, page.children[j], distance))
                    order += 1
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the quantised vector (whole numbers as doubles), of rows that take part."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)
    rows = vectors.filter(F.col("vec_id").isNotNull() & ok)
    # floor() of a column gives a 64-bit integer, which large doubles are not: from 2 ** 52 on doubles are whole anyway.
    whole = lambda v: F.when(F.abs(v) < F.lit(EXACT), F.floor(v).cast("double")).otherwise(v)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: whole(F.lit(1024.0) * v.cast("double"))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def with_cells(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) with dim and cell, the nearest of their length's pivots."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    size = rows.agg(F.coalesce(F.sum(8 * F.size("v")), F.lit(0))).first()[0]
    most = min(PIVOTS, max(1, -(-size // BLOCK_BYTES)))
    by_dim: dict[int, list[list[float]]] = {}
    for v in some["v"].to_pylist():
        by_dim.setdefault(len(v), []).append(v)
    unit = lambda m: m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1.0)
    pivots = {dim: spread(unit(np.array(vs)), most) for dim, vs in by_dim.items()}  # at most PIVOTS a length, SAMPLE in all
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            cell = np.zeros(batch.num_rows, np.int32)
            for n in np.unique(dim).tolist():
                if n in shared.value:
                    own, p = np.flatnonzero(dim == n), shared.value[n]
                    m = unit(matrix(batch.column("v").take(pa.array(own)), n))
                    cell[own] = np.argmin((p**2).sum(axis=1) - 2 * m @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(dim, pa.int32()), pa.array(cell)], names=["vec_id", "v", "dim", "cell"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, cell int")


def index(rows: DataFrame) -> DataFrame:
    """One row per block of at most BLOCK_BYTES of one cell: dim, cell, part, parts, centre and radius of its ball, tree."""

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        vectors = matrix(t["v"].combine_chunks(), dim)
        tree = MTree(t["vec_id"].to_numpy(), vectors)
        centre, radius = ball(vectors)
        out = t.select(["dim", "cell", "part", "parts"]).slice(0, 1).append_column("centre", pa.array([centre.tolist()], pa.list_(pa.float64())))
        return out.append_column("radius", pa.array([radius], pa.float64())).append_column("tree", pa.array([pickle.dumps(tree)], pa.binary()))

    most = F.greatest(F.lit(1.0), F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
    size = rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int")).drop("n")
    dealt = rows.join(F.broadcast(size), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))  # at most SAMPLE cells
    return dealt.groupBy("dim", "cell", "part").applyInArrow(run, "dim int, cell int, part int, parts int, centre array<double>, radius double, tree binary")


def ball(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of a ball that holds all vectors."""
    centre = vectors.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1)).max())
    return centre, radius if math.isfinite(radius) else math.inf


PAIR = "query_id long, vec_id long, score long"


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each pack's queries in each block it meets. pairs: tree, queries (vec_id, v, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, asked in zip(batch.column("tree"), batch.column("queries"), strict=True):
                tree = pickle.loads(blob.as_buffer())
                out: tuple[list, list, list] = ([], [], [])
                for x in asked.as_py():
                    for s, c in tree.search(x["vec_id"], np.array(x["v"]), k, x["floor"]):
                        if not -LONG <= s < LONG:
                            raise OverflowError(f"the score of {x['vec_id']} and {c} is no 64-bit integer")
                        out[0].append(x["vec_id"]), out[1].append(c), out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return pairs.select("tree", "queries").mapInArrow(run, PAIR)


def packed(asked: DataFrame) -> DataFrame:
    """Queries (vec_id, v, dim, cell, floor) of one cell in packs of at most about PACK_BYTES."""
    most = F.greatest(F.lit(1.0), F.lit(PACK_BYTES) / (8 * F.col("dim")))
    size = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.first(most)).cast("int").alias("packs"))
    dealt = asked.join(F.broadcast(size), ["dim", "cell"])  # at most SAMPLE cells
    return dealt.groupBy("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("packs")).cast("int").alias("pack")).agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("queries"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gap(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def may_reach(centre: str, radius: str) -> Column:
    """Can a vector of the ball have a score of a pack's lowest bound with a query of the pack's ball (q_centre, q_radius)? With q = c + e and x = b + f,
    q x is at most c b + |c| |f| + |b| |e| + |e| |f|."""
    c, b = F.sqrt(dot("q_centre", "q_centre")), F.sqrt(dot(centre, centre))
    reach = c + F.col("q_radius")
    most = dot("q_centre", centre) + c * F.col(radius) + b * F.col("q_radius") + F.col("q_radius") * F.col(radius)
    # Scores beyond doubles give infinities or NaN: such a pair stays.
    return ~F.coalesce(most + SLACK * reach * (b + F.col(radius)) < F.col("floor"), F.lit(False))


def reached(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of packs (dim, cell, pack) and blocks (of_cell, part) that may hold one of the best."""

    def summary(t: pa.Table) -> pa.Table:
        own = t["queries"].combine_chunks().flatten()
        names = t.select(["dim", "cell", "pack"]).slice(0, 1)
        centre, radius = ball(matrix(own.field("v"), t["dim"][0].as_py()))
        floors = own.field("floor")
        low = None if floors.null_count else float(min(floors.to_pylist()))
        return names.append_column("q_centre", pa.array([centre.tolist()], pa.list_(pa.float64()))).append_column("q_radius", pa.array([radius], pa.float64())).append_column("floor", pa.array([low], pa.float64()))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from summary(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    asked = packs.mapInArrow(balls, "dim int, cell int, pack int, q_centre array<double>, q_radius double, floor double")
    narrow = blocks.select("dim", F.col("cell").alias("of_cell"), "part", "parts", "centre", "radius")
    middle = narrow.groupBy("dim", "of_cell").agg(F.min_by("centre", "part").alias("middle"))
    cells = narrow.join(F.broadcast(middle), ["dim", "of_cell"]).groupBy("dim", "of_cell").agg(F.first("middle").alias("middle"), F.max(gap("centre", "middle") + F.col("radius")).alias("wide"))
    near = asked.join(F.broadcast(cells), "dim").filter(may_reach("middle", "wide")).drop("middle", "wide")  # PIVOTS cells a length
    met = near.join(narrow, ["dim", "of_cell"]).filter(may_reach("centre", "radius"))
    return met.filter((F.col("cell") != F.col("of_cell")) | (F.col("part") != F.pmod("pack", "parts"))).select("dim", "cell", "pack", "of_cell", "part")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: its k highest scores among all other rows."""
    rows = cut(with_cells(usable(vectors)), "vectors")
    blocks = cut(index(rows), "blocks")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "cell")).alias("q")).select("vec_id", "q.*")
    # Bounds from one block of each query's own cell.
    first = packed(asked.withColumn("floor", F.lit(None).cast("long"))).join(blocks, ["dim", "cell"]).filter(F.col("part") == F.pmod("pack", "parts"))
    home = cut(best_of(searched(first, k), k), "home")
    bound = home.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    packs = cut(packed(asked.join(bound, "vec_id", "left")), "packs")
    # The stated queries, in packs, against the blocks that they may reach.
    trees = blocks.select("dim", F.col("cell").alias("of_cell"), "part", "tree")
    rest = reached(packs, blocks).join(packs, ["dim", "cell", "pack"]).join(trees, ["dim", "of_cell", "part"])
    found = home.select("query_id", "vec_id", "score").unionByName(searched(rest, k))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
