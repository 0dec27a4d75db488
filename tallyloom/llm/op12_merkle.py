"""A Merkle manifest of documents: a trie of fanout FANOUT over exact ranks, one subtree for each source.

Ranks come from digits, not from a sort of the table: counts of doc_id >> BIN (a bin) by source are summed to coarser digits of
WIDE bits; from the coarsest on, a node's offset is its parent's plus the counts of its smaller siblings, so that each bin
knows its first rank, and only rows of one bin are put in order. The base-FANOUT digits of a rank are a leaf's way in the trie:
nodes are keyed by the rank without its last digits, and runs that share the longest prefix are hashed together, level by level.
From the roots down each node gets the digests beside its way (left and right of it), which are a leaf's proof.

A driver loop runs once a level (the logarithm of the largest source); each level is written to the shared folder and is a
sixteenth of the one before. No group has more than FANOUT nodes; a bin holds 2**BIN doc_ids of one source.

Defined results: equal rows are counted before they are ranked and come back once each, in places next to each other; rows
that share a doc_id follow their leaf's digest; null doc_ids come first and are never tampered with; null and empty values
differ in the leaf; null source: a source of its own, the first one; texts of any length are hashed whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FANOUT, BIN, WIDE, TOP = 16, 8, 16, 60
#: Null doc_ids: the bin before the first.
BEFORE = -(1 << (63 - BIN)) - 1
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def leaves(docs: DataFrame) -> DataFrame:
    """skey (the source, so that null comes first), bin, doc_id, leaf, forged (leaf of the text in small letters, where that is the
    tampering), m (equal rows)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BIN), F.lit(BEFORE)).alias("bin"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(F.col("text")).alias("leaf"),
        F.when(tampered, leaf_of(F.translate("text", CAPITALS, SMALL))).alias("forged"),
    )
    return rows.groupBy("skey", "bin", "doc_id", "leaf").agg(F.first("forged").alias("forged"), F.count(F.lit(1)).alias("m"))


def offsets(bins: DataFrame) -> DataFrame:
    """skey, bin, first (rank of its first row), total (rows of the source), from counts n of bins."""
    shifts = list(range(WIDE, TOP - BIN + 1, WIDE))
    levels = [bins.select("skey", F.col("bin").alias("p0"), "n")]
    for k, _ in enumerate(shifts):
        parent = F.shiftright(f"p{k}", WIDE).alias(f"p{k + 1}")
        levels.append(levels[-1].groupBy("skey", parent).agg(F.sum("n").alias("n")))
    top = len(shifts)
    before = lambda *keys: Window.partitionBy("skey", *keys)

    def smaller(k: int, *keys: str) -> Column:
        """Rows of smaller siblings."""
        return F.coalesce(F.sum("n").over(before(*keys).orderBy(f"p{k}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    known = levels[top].select("skey", f"p{top}", smaller(top).alias("first"), F.sum("n").over(before()).alias("total"))
    for k in range(top - 1, -1, -1):
        own = levels[k].withColumn(f"p{k + 1}", F.shiftright(f"p{k}", WIDE))
        inner = own.withColumn("inner", smaller(k, f"p{k + 1}"))
        known = inner.join(known, ["skey", f"p{k + 1}"]).select("skey", f"p{k}", (F.col("first") + F.col("inner")).alias("first"), "total")
    return known.withColumnRenamed("p0", "bin")


def ranked(rows: DataFrame) -> DataFrame:
    """skey, rank (from 0 in the source), total, doc_id, leaf, forged: one row for each document."""
    places = cut(offsets(cut(rows.groupBy("skey", "bin").agg(F.sum("m").alias("n")), "merkle_bins")), "merkle_offsets")
    within = Window.partitionBy("skey", "bin").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inner", F.coalesce(F.sum("m").over(within), F.lit(0))).join(places, ["skey", "bin"]).withColumn("at", F.col("first") + F.col("inner"))
    each = F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("rank")
    return at.select("skey", each, "total", "doc_id", "leaf", "forged")


def joined(members: Column, what: str) -> Column:
    return F.array_join(F.transform(members, lambda x: x[what]), "")


def raised(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Runs of each level above nodes (key, idx, n, digest: one node of a key's n): key, idx (of the run), n (of runs), members
    (idx, digest) and digest."""
    levels: list[DataFrame] = []
    while most > 1:
        runs = nodes.filter(F.col("n") > 1).groupBy("key", (F.shiftright("idx", 4)).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("members"), F.first("n").alias("n"))
        fewer = F.shiftright(F.col("n") + (FANOUT - 1), 4)
        level = cut(runs.select("key", F.col("run").alias("idx"), fewer.alias("n"), "members", digest(joined(F.col("members"), "digest")).alias("digest")), f"{name}_{len(levels)}")
        levels.append(level)
        nodes, most = level.select("key", "idx", "n", "digest"), -(-most // FANOUT)
    return levels


def beside(members: Column, place: Column, what: str) -> Column:
    """Digests left and right of a member, as one step of a way."""
    part = lambda start, size: joined(F.slice(members, start, size), what)
    return F.struct(part(F.lit(1), place).alias("before"), part(place + 2, F.size(members)).alias("after"))


def lowered(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """key, idx, rest of the tops, and way (steps from the node up) of the nodes that the lowest level is made of; tops: one row for each
    key, with the way above its top."""
    others = [c for c in tops.columns if c not in ("key", "way")]
    one = lambda rows: rows.filter(F.col("n") == 1).select("key", "idx")
    ways: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        start = one(level).join(tops, "key").select("key", "idx", "way", *others)
        here = start if ways is None else start.unionByName(ways)
        opened = level.select("key", "idx", F.posexplode("members").alias("place", "x"), "members")
        step = F.array(beside(F.col("members"), F.col("place"), "digest"))
        ways = opened.join(here, ["key", "idx"]).select("key", F.col("x.idx").alias("idx"), F.concat(step, F.col("way")).alias("way"), *others)
        ways = cut(ways, f"merkle_ways_{k}") if k else ways
    return ways if ways is not None else tops.select("key", F.lit(0).cast("long").alias("idx"), "way", *others)


def most_of(rows: DataFrame, column: str) -> int:
    return rows.agg(F.max(column)).first()[0] or 0


def rooted(subroots: DataFrame) -> DataFrame:
    """key, subroot, way (from the subroot to the root) and root of every source. The sources are put in order by ranges."""
    placed = cut(subroots.orderBy("key").select("key", "subroot", F.monotonically_increasing_id().alias("id")), "merkle_sources")
    part = F.shiftright("id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not for each source
    at = counts.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    total = most_of(counts.agg(F.sum("n").alias("n")), "n")
    ranks = placed.join(at, part == F.col("part")).select(F.col("key").alias("source"), "subroot", (F.col("first") + F.col("id") - F.shiftleft("part", 33)).alias("idx"))
    ranks = cut(ranks, "merkle_source_ranks")
    nodes = ranks.select(F.lit("").alias("key"), "idx", F.lit(total).cast("long").alias("n"), F.col("subroot").alias("digest"))
    levels = raised(nodes, total, "merkle_roots")
    top = levels[-1] if levels else nodes
    tops = top.select("key", F.array().cast(f"array<{STEP}>").alias("way"), F.col("digest").alias("root"))
    ways = lowered(levels, tops)
    return cut(ranks.join(ways, "idx").select(F.col("source").alias("key"), "subroot", "way", "root"), "merkle_tops")


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, forged, subroot, root and way, an array of (before, after) from the leaf up."""
    rows = ranked(cut(leaves(docs), "merkle_leaves"))
    member = F.struct("rank", "leaf", "doc_id", "forged")
    runs = rows.groupBy(F.col("skey").alias("key"), F.shiftright("rank", 4).alias("idx")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("total").alias("total"))
    lone = F.col("total") == 1
    own = F.when(lone, F.get(F.col("members"), F.lit(0))["leaf"]).otherwise(digest(joined(F.col("members"), "leaf")))
    runs = cut(runs.withColumn("digest", own).withColumn("n", F.shiftright(F.col("total") + (FANOUT - 1), 4)), "merkle_runs")
    nodes = runs.select("key", "idx", "n", "digest")
    levels = raised(nodes, most_of(nodes, "n"), "merkle_nodes")
    tops = reduce(DataFrame.unionByName, [x.filter(F.col("n") == 1).select("key", F.col("digest").alias("subroot")) for x in [nodes, *levels]])
    tops = rooted(tops)
    single = nodes.filter(F.col("n") == 1).select("key", "idx").join(tops, "key").select("key", "idx", "way", "subroot", "root")
    ways = single.unionByName(lowered(levels, tops)) if levels else single
    opened = runs.join(ways, ["key", "idx"]).select(F.posexplode("members").alias("place", "x"), "members", "total", "way", "subroot", "root")
    step = F.when(F.col("total") == 1, F.array().cast(f"array<{STEP}>")).otherwise(F.array(beside(F.col("members"), F.col("place"), "leaf")))
    return opened.select("x.doc_id", "x.leaf", "x.forged", "subroot", "root", F.concat(step, F.col("way")).alias("way"))


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the digests beside its way lead to."""
    return F.aggregate(way, leaf, lambda acc, x: digest(x["before"], acc, x["after"]))


def verified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proof = F.array_join(F.transform("way", lambda x: F.concat(x["before"], x["after"])), "")
    out = manifest(docs).withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("way")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
