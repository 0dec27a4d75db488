"""Connected components and longest chains of a graph of any size.

Components: tasks hang the nodes of a block of edges, as the rows come, on the smallest node that the block connects them with. Nodes that hang
on several roots link these; the links, a few if neighbouring edges come together, are settled by star contraction: every node
hangs its larger neighbours on the smallest node it knows (large star), then itself and its smaller neighbours on the smallest of them
(small star), until nothing moves. Nodes' minima are aggregates, so that a hub with a third of the edges is
no task's group; its edges meet their minimum in a join, which adaptive execution splits. Rounds grow with the logarithm of the
diameter, each is written to the shared folder.

Chains: edges are dealt by ranges of component and time and passed in blocks; only components that lie across tasks or blocks go through rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tallyloom.sources.tables import cut

BLOCK = 1 << 18  # edges that a task holds at a time


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation over distinct edges (a > b)."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    hung = both.join(least, "a")
    if small:
        moved = hung.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = hung.filter("b > a").select(F.col("b").alias("x"), "m")
    return moved.filter("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _blocks(batches: Iterator[pa.RecordBatch], most: int, group: str | None = None) -> Iterator[pa.Table]:
    """Rows in tables of about `most`; rows that follow each other with one value of group stay together unless they fill a table."""
    held: list[pa.RecordBatch] = []
    for batch in (whole.slice(i, most) for whole in batches for i in range(0, whole.num_rows, most)):
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        block, held = pa.Table.from_batches(held), []
        if group:
            value = block.column(group)
            last = pc.index(pc.equal(value, value[-1]), True).as_py()
            if last:
                block, held = block.slice(0, last), block.slice(last).to_batches()
        yield block
    if held:
        yield pa.Table.from_batches(held)


def _coded(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The columns' values, one column after the other, as places in the ordered list of them (null: -1), and that list."""
    found = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    return place[pc.fill_null(found.indices, len(order)).to_numpy(zero_copy_only=False)], found.dictionary.take(pa.array(order))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that edges a, b connect each of n nodes with."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def components(edges: DataFrame, a: str, b: str, most: int = 100) -> DataFrame:
    """node and component (its smallest node) of every node that stands in an edge; edges to itself and repeated ones count once.
    Raises if `most` rounds don't settle it."""
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, size):
            codes, names = _coded(block.column("a"), block.column("b"))
            root = _roots(codes[: block.num_rows], codes[block.num_rows :], len(names))
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "root"])

    kind = pairs.schema["a"].dataType
    hung = cut(pairs.mapInArrow(run, StructType([StructField("node", kind), StructField("root", kind)])))
    nodes = cut(hung.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    torn = cut(nodes.filter("root < other").select("node", F.col("root").alias("least")))
    if torn.isEmpty():
        return nodes.select("node", F.col("root").alias("component"))
    now, mark = cut(hung.join(torn, "node").filter("root > least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()), None
    for _ in range(most):
        now = cut(_starred(_starred(now, False), True))
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == mark:
            break
        mark = sums
    else:
        raise ValueError(f"components still moved after {most} rounds")
    return nodes.join(now.select(F.col("a").alias("root"), F.col("b").alias("component")), "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def _earliest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The earliest ancestor, or itself, of each of n nodes that are numbered by time; edges a, b between nodes of one time may lead down."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    first = np.arange(n)
    while (first[a] < first[b]).any():
        now = first.tolist()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if now[x] < now[y]:
                now[y] = now[x]
        first = np.array(now)
        first = first[first]
    return first


def _passed(block: pa.Table) -> list[pa.Array]:
    """node, t, component, and the time and node of the earliest ancestor by the block's edges, of the nodes of a block that have a time."""
    n = block.num_rows
    ends, names = _coded(block.column("a"), block.column("b"))
    times, ticks = _coded(block.column("ta"), block.column("tb"))
    groups, labels = _coded(block.column("component"))
    _, seen = np.unique(ends, return_index=True)
    when = times[seen]
    order = np.lexsort((np.arange(len(names)), when))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    timed = (times[:n] >= 0) & (times[n:] >= 0)
    first = order[_earliest(rank[ends[:n]][timed], rank[ends[n:]][timed], len(names))[rank]]
    own = np.flatnonzero(when >= 0)
    first = first[own]
    return [names.take(pa.array(own)), ticks.take(pa.array(when[own])), labels.take(pa.array(groups[seen[own] % n])), ticks.take(pa.array(when[first])), names.take(pa.array(first))]


def longest_chains(edges: DataFrame, a: str, b: str, ticks: DataFrame, node: str, tick: str, most: int = 1000) -> DataFrame:
    """component, nodes and longest: the longest time that a path of edges (a before b, by the nodes' ticks) spans in each component.

    A path spans the time from its first node to its last, so a node's longest path begins at its earliest ancestor. A task passes its range of edges once in the
    order of time. Of components that lie across tasks or blocks, each round a node takes the earliest of its predecessors' and of its own earliest
    ancestor's, where one of the two changed. Nodes without a time are not counted and no path leads through them. Edges that lead
    backwards in time are refused."""
    at = ticks.select(F.col(node).alias("node"), F.col(tick).alias("t")).filter("t is not null")
    steps = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null"))
    begun = components(steps, "a", "b").join(at, "node", "left").select(F.col("node").alias("a"), "component", F.col("t").alias("ta"))
    timed = cut(steps.join(begun, "a").join(at.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b", "left").select("component", "a", "ta", "b", "tb"))
    if not timed.filter("ta > tb").isEmpty():
        raise ValueError("edges must not lead backwards in time")
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components with edges in other blocks, perhaps in other tasks, are marked: a block's first and last may be such."""
        blocks = _blocks(batches, size, "component")
        block, before = next(blocks, None), None
        while block is not None:
            after = next(blocks, None)
            here = block.column("component")
            found = _passed(block)
            edge = [here[0] if before is None else before, here[-1] if after is None else after.column("component")[0]]
            across = pc.is_in(found[2], value_set=pa.array(edge, found[2].type))
            yield pa.RecordBatch.from_arrays([*found, across], names=["node", "t", "component", "since", "origin", "across"])
            block, before = after, here[-1]

    kind, time = steps.schema["a"].dataType, at.schema["t"].dataType
    fields = [StructField("node", kind), StructField("t", time), StructField("component", timed.schema["component"].dataType), StructField("since", time), StructField("origin", kind), StructField("across", BooleanType())]
    found = cut(timed.repartitionByRange("component", "tb").sortWithinPartitions("component", "tb").mapInArrow(run, StructType(fields)))
    ends = found.filter("not across").select("component", "t", "since")
    first = F.struct(F.col("since").alias("t"), F.col("origin").alias("from"))
    open_ = cut(found.filter("across").groupBy("node").agg(F.min("t").alias("t"), F.min("component").alias("component"), F.min(first).alias("first"), F.max(first).alias("last")))
    changed = cut(open_.filter("first < last").select("node", "first", "component"))
    open_ = open_.drop("last")
    if not changed.isEmpty():
        torn = cut(changed.select("component").distinct())
        steps = cut(timed.filter("ta is not null and tb is not null").join(torn, "component", "left_semi").select("a", "b"))
        for _ in range(most):
            news = changed.select(F.col("node").alias("of"), F.col("first").alias("new"))
            offered = steps.join(news, F.col("a") == F.col("of")).select(F.col("b").alias("node"), "new")
            follow = open_.join(news, F.col("first.from") == F.col("of")).select("node", "new")
            jump = changed.select("node", F.col("first.from").alias("of")).join(open_.select(F.col("node").alias("of"), F.col("first").alias("new")), "of").select("node", "new")
            best = offered.unionByName(follow).unionByName(jump).groupBy("node").agg(F.min("new").alias("new"))
            now = cut(open_.join(best, "node", "left").select("node", "t", "component", F.least("first", "new").alias("first"), (F.col("new") < F.col("first")).alias("moved")))
            changed, open_ = now.filter("moved").select("node", "first"), now.drop("moved")
            if changed.isEmpty():
                break
        else:
            raise ValueError(f"chains still moved after {most} rounds")
    ends = ends.unionByName(open_.select("component", "t", F.col("first.t").alias("since")))
    return ends.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.col("t") - F.col("since")).alias("longest"))
