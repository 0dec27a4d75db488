"""Near-duplicate detection with bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets (128-bit digests) become one
representative. A representative's sketch is its SKETCH smallest hashes. Two sets with the similarity asked for share at
least Likeness.shared of the SKETCH smallest values of their union, up to a chance of CHANCE for each pair, so links are
looked for among pairs whose sketches share that many:

* Inverted lists of values with at most LIST representatives give pairs with the number of values they share. A pair stays
  if that number and the values of long lists that either side holds could reach what is needed.
* Values of longer lists alone matter only to representatives whose sketches hold enough of them (as many as the smallest
  set they may be linked with asks for): large groups of near copies. Those form clusters (connected by the rarest of their
  long-list values, one of which any such pair shares). A cluster is dealt into blocks of at most BLOCK shingles; within a
  block a task walks breadth-first from set to set over postings of whole sets that no component holds yet. A cluster of
  several blocks then has components; all but the largest of them are held, set by set, against all of its blocks, so no
  pair within one component is looked at again and none between two is missed.

Pairs then pass the estimate from the union's sketch, and the exact Jaccard of whole sets decides. Components come from
alternating large-star and small-star steps over the links.

With exact=True a sketch is instead the set's prefix: its n - ceil(least * n) + 1 smallest hashes. Two sets with the
similarity share a value of their prefixes for certain, so every pair that shares one is a candidate and no link is left
to chance; lists and clusters then hold more.

Defined results: null and blank texts have no shingles and link with nothing; texts with fewer than five words are one
shingle; rows with a null doc_id link with nothing and come back with a null component, kept; of rows that repeat a doc_id
the one with the smallest set digest counts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, PIECE, by_bytes, cut, flat, mix, shingles, words

SIZE, SKETCH, LIST, CHANCE = 5, 32, 48, 1e-8
#: Shingles of the sets in one block of a large cluster.
BLOCK = 1_500_000
#: Postings that are counted at once.
STEP = 1 << 16
LEAST = 85


@dataclass(frozen=True)
class Likeness:
    """The similarity asked for, in percent, and what follows from it."""

    least: int = LEAST
    exact: bool = False

    @property
    def shared(self) -> int:
        """Values of the union's sketch that linked sets share, but for a chance of CHANCE; one value of exact prefixes."""
        p, missed, s = self.least / 100, 0.0, 0
        if self.exact or p >= 1:
            return 1 if self.exact else SKETCH
        while (missed := missed + math.comb(SKETCH, s) * p**s * (1 - p) ** (SKETCH - s)) <= CHANCE:
            s += 1
        return max(1, s)

    def sketch(self, own: np.ndarray) -> np.ndarray:
        return own[: len(own) - -(-self.least * len(own) // 100) + 1] if self.exact else own[:SKETCH]

    def needed(self, a: Column, b: Column) -> Column:
        """How many sketch values a linked pair with sets of these sizes shares: `shared`, or less for small sets."""
        return F.least(F.lit(self.shared), F.ceil((a + b) * (self.least / (100 + self.least)) - 1e-9))

    def linked(self, a, b, overlap):
        return 100 * overlap >= self.least * (a + b - overlap)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (as signed integers) of each text."""
    data, offsets = flat(column)
    h, bounds = words(data, offsets, BLANK)
    s, first = shingles(h, bounds, SIZE)
    s = s.view(np.int64)
    at = np.searchsorted(first, bounds)
    for i in range(len(offsets) - 1):
        n = bounds[i + 1] - bounds[i]
        if n >= SIZE:
            yield np.unique(s[at[i] : at[i + 1]])
        elif n:
            whole = int(n)
            for w in h[bounds[i] : bounds[i + 1]].tolist():
                whole = (whole * 0x9FB21C651E98DF25 + w) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([whole], np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def signatures(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n (size of the set), digest, sketch (its smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PIECE):
            n, digest, sketch = [], [], []
            for own in shingle_sets(batch.column("text")):
                n.append(len(own)), digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest()), sketch.append(like.sketch(own))
            size = np.fromiter(map(len, sketch), np.int64, len(sketch))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "n", "digest", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def long_lists(reps: DataFrame) -> DataFrame:
    """Each representative with the values that others hold too, of short and of long lists (rarest first)."""
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("count")).filter("count > 1")
    rows = values.join(shared, "v")
    per_rep = rows.groupBy("rep", "n").agg(F.collect_list(F.struct("count", "v")).alias("values"))  # at most a sketch
    return per_rep.withColumn("long", F.array_sort(F.filter("values", lambda x: x["count"] > LIST))).withColumn("short", F.filter("values", lambda x: x["count"] <= LIST)).drop("values")


def short_list_pairs(held: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of representatives that may share enough values, from lists of at most LIST members."""
    rows = held.filter(F.size("short") > 0).select("rep", "n", F.size("long").alias("h"), F.explode("short.v").alias("v"))
    lists = rows.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "h"))).alias("m"))
    fits = lambda a, b: F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * like.least
    pairs = F.flatten(
        F.transform("m", lambda a, i: F.transform(F.filter(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: fits(a, b)), lambda b: F.struct(a["rep"].alias("a"), b["rep"].alias("b"), (F.least(a["h"], b["h"]) - like.needed(a["n"], b["n"])).alias("room"))))
    )
    return lists.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("o"), F.max("room").alias("room")).filter("o + room >= 0").select("a", "b")


def estimated(pairs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose overlap within the union's sketch is enough."""
    if like.exact:
        return pairs
    sketches = reps.select("rep", "n", "sketch")
    both = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    overlap = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.filter(overlap >= like.needed(F.col("na"), F.col("nb"))).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole sets of the wanted representatives (rep, digest): rep, own (64-bit hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PIECE):
            own, rep = [], []
            for r, digest, s in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:  # of rows that repeat a doc_id, the one that counts
                    rep.append(r), own.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(own, pa.binary())], names=["rep", "own"])

    rows = docs.join(wanted.select(F.col("rep").alias("doc_id"), "digest"), "doc_id")
    return rows.mapInArrow(run, "rep long, own binary")


def verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose whole sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                at = np.searchsorted(q, p)
                keep.append(like.linked(len(p), len(q), int((q[np.minimum(at, len(q) - 1)] == p).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def clusters(held: DataFrame, like: Likeness) -> DataFrame:
    """Representatives with enough values of long lists: rep, n, cluster (the smallest representative reachable over the rarest of these values)."""
    # What the smallest set that n may be linked with asks for: the pair's own number is this or more.
    least = F.least(F.lit(like.shared), F.ceil(F.col("n") * (like.least / 100) - 1e-9))
    large = held.filter(F.size("long") >= least).select("rep", "n", F.slice(F.col("long.v"), F.lit(1), (F.size("long") - least + 1).cast("int")).alias("keys"))
    rows = cut(large.select("rep", "n", F.explode("keys").alias("v")), "long_values")
    hubs = rows.groupBy("v").agg(F.min("rep").alias("hub"))
    edges = rows.join(hubs, "v").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    return rows.select("rep", "n").distinct().join(components(edges), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("cluster"))


class Postings:
    """Which of the sets hold each value."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def keep(self, fresh: np.ndarray) -> None:
        own = fresh[self.owner]
        self.values, self.owner = self.values[own], self.owner[own]

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        """How many values of `own` each set holds."""
        a, b = np.searchsorted(self.values, own, side="left"), np.searchsorted(self.values, own, side="right")
        ends = np.cumsum(b - a)
        total, at, done = np.zeros(len(self.size), np.int64), 0, 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, done + STEP, side="right")))
            n = b[at:to] - a[at:to]
            total += np.bincount(self.owner[np.arange(n.sum()) + np.repeat(a[at:to] - (np.cumsum(n) - n), n)], minlength=len(total))
            at, done = to, ends[to - 1]
        return total


def walk(reps: np.ndarray, sets: list[np.ndarray], like: Likeness) -> list[tuple[int, int]]:
    """Links that connect all sets whose links connect them: breadth-first over postings, each set reached once."""
    posts = Postings(sets)
    size = posts.size
    fresh, left, listed = np.ones(len(sets), bool), len(sets), len(sets)
    links: list[tuple[int, int]] = []
    for root in range(len(sets)):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        left -= 1
        while queue:
            i = queue.pop()
            if 2 * left < listed:  # reached sets leave the postings each time half of them are
                posts.keep(fresh)
                listed = left
            overlap = posts.overlaps(sets[i])
            near = np.flatnonzero(fresh & (overlap > 0) & like.linked(size[i], size, overlap))
            fresh[near] = False
            left -= len(near)
            links += [(int(reps[i]), int(reps[j])) for j in near]
            queue += near.tolist()
    return links


def cluster_links(members: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links that connect what is linked within clusters: block by block, then between components of clusters of several blocks."""
    weight = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    dealt = cut(members.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))), "blocks")

    def within(t: pa.Table) -> pa.Table:
        found = walk(t["rep"].to_numpy(), [np.frombuffer(x.as_buffer(), np.int64) for x in t["own"]], like)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = cut(dealt.select("rep", "cluster", "block").join(sets, "rep").groupBy("cluster", "block").applyInArrow(within, "a long, b long"), "within_blocks")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return links
    large = cut(large.join(components(links), "rep", "left").withColumn("part", F.coalesce("component", "rep")), "large_clusters")
    most = large.groupBy("cluster", "part").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("part", F.struct("k", "part")).alias("largest"))
    asked = large.join(most, "cluster").filter(F.col("part") != F.col("largest")).select("cluster", "rep", "part", "n")
    asks = asked.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("asks"))
    asked = asked.join(asks, "cluster").withColumn("ask", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("asks"))).join(large.groupBy("cluster").agg(F.max("blocks").alias("blocks")), "cluster")
    asked = asked.select("cluster", "rep", "part", "ask", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"))
    base = large.join(asks, "cluster").select("cluster", "rep", "part", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "block", F.lit(False).alias("asks"))

    def between(t: pa.Table) -> pa.Table:
        rep, part, asks = t["rep"].to_numpy(), t["part"].to_numpy(), t["asks"].to_numpy()
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in t["own"]]
        held = np.flatnonzero(~asks)
        out: tuple[list, list] = ([], [])
        if len(held):
            posts = Postings([own[j] for j in held])
            known: set[tuple[int, int]] = set()
            for i in np.flatnonzero(asks).tolist():
                overlap = posts.overlaps(own[i])
                near = held[(overlap > 0) & (part[held] != part[i]) & like.linked(len(own[i]), posts.size, overlap)]
                for j in near.tolist():  # one link between two components is enough
                    if (pair := (int(part[i]), int(part[j]))) not in known:
                        known.add(pair)
                        out[0].append(int(rep[i])), out[1].append(int(rep[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    rows = asked.unionByName(base).join(sets, "rep")
    return links.unionByName(rows.groupBy("cluster", "block", "ask").applyInArrow(between, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """rep, component (the smallest representative reachable) for every end of a link."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = cut(edges, "edges")
    total = edges.count(), None
    while True:
        # Large star: every larger neighbour of u points to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(total):
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
        total = tuple(now)


def near_duplicates(docs: DataFrame, least: int = LEAST, exact: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. least: similarity in percent of linked documents."""
    like = Likeness(least, exact)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(signatures(docs, like), "signatures")
    without = signed.filter(F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    signed = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("digest", "n", "sketch")).alias("s")).select("doc_id", "s.*")
    reps = cut(signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "representatives")
    held = cut(long_lists(reps), "lists")
    pairs = cut(estimated(short_list_pairs(held, like), reps, like), "pairs")
    members = clusters(held, like)
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(members.select("rep")).distinct().join(reps.select("rep", "digest"), "rep")
    sets = cut(sets_of(docs.filter(F.col("doc_id").isNotNull()), wanted), "sets")
    links = verified(pairs, sets, like).unionByName(cluster_links(members, sets, like))
    found = components(links)
    of_rep = reps.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "digest").join(of_rep, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(without)
