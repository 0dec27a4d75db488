"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

1. Every run of SEED words of a benchmark item is a seed; an item of fewer words is one seed as a whole. Test items are taken in blocks of bounded size, broadcast as sorted
   seed hashes; one pass over the documents joins them with the items on seeds. A document takes the seeds that it hits from the rarest (in the fewest items) to the most
   common; an item is met once, through its rarest hit seed.
2. A score of least * 2m with an item of m words takes least * m matches within (3 - 2 * least) * m words of the document. So a pair counts no further, however it was
   met, unless the document holds that many of the item's words: common seeds, which meet many items, cost one look at each item's words as numbers in a
   table, for all items of a document at once. Of what is left only the passages that hold so many words of the item are kept; no alignment that
   counts is lost, and none is left out for a seed's frequency.
3. Passages are aligned word by word (match 2, mismatch -1, gap -1). The best local score over twice the item's length is
   the similarity; a pair is a leak at LEAK or more. So the result is that of aligning every candidate's whole text.

Words are runs of letters and digits in small letters (all characters above 127 count as letters).

Defined results: null and empty texts, and items without words, match nothing; of equal item ids with
different texts each text counts and the best score stays; repeated document rows give one row per (doc_id, item_id); null
ids take no part; texts of any length are searched whole; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, SIGN, by_bytes, cut, flat, shingles, words

SEED, LEAK = 5, 0.6
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Words of a document that one passage begins in, at least.
STEP = 4096


def item_words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = flat(pc.utf8_lower(pa.array(texts, pa.string())))
    h, bounds = words(data, offsets, SIGN)
    return [h[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def seed_index(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted seed hashes with the item of each (a seed of several items several times)."""
    hashes, item = [], []
    for i, h in enumerate(items):
        s = np.unique(shingles(h, np.array([0, len(h)]), min(SEED, len(h)))[0]) if len(h) else np.zeros(0, np.uint64)
        hashes.append(s), item.append(np.full(len(s), i))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, item = np.concatenate(hashes), np.concatenate(item)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], item[order].astype(np.int64)


class WordTable:
    """The items' words as numbers of a vocabulary, side by side."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.sizes = np.array([len(h) for h in items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat_words = np.concatenate(items) if items else np.zeros(0, np.uint64)
        self.vocabulary, self.numbers = np.unique(flat_words, return_inverse=True)
        self.held = np.zeros(len(self.vocabulary), bool)

    def shared(self, of: np.ndarray, text_words: np.ndarray) -> np.ndarray:
        """How many words of each of the items `of` stand among the text's (distinct) words."""
        at = np.searchsorted(self.vocabulary, text_words)
        at = at[at < len(self.vocabulary)]
        at = at[among(text_words, self.vocabulary[at])]
        self.held[at] = True
        sizes = self.sizes[of]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.starts[of] - (ends - sizes), sizes)
        total = np.concatenate([[0], np.cumsum(self.held[self.numbers[places]])])
        self.held[at] = False
        return total[ends] - total[ends - sizes]


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """The best Smith-Waterman local score of two word sequences."""
    m = len(item)
    steps = np.arange(m)
    row, best = np.zeros(m + 1, np.int64), 0
    for w in passage:
        new = np.maximum(np.maximum(row[:-1] + np.where(item == w, 2, -1), row[1:] - 1), 0)
        new = np.maximum.accumulate(new + steps) - steps  # gaps along the item
        row[1:] = new
        best = max(best, int(new.max()))
    return best


def among(sorted_words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h are among the sorted words (one at least)."""
    return sorted_words[np.minimum(np.searchsorted(sorted_words, h), len(sorted_words) - 1)] == h


def passages(item: np.ndarray, text: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Spans of the text that hold every alignment with a score of least * 2 * len(item) or more."""
    m = len(item)
    need, span = max(1, math.ceil(least * m - 1e-9)), math.floor((3 - 2 * least) * m + 1e-9)
    of_item = among(np.unique(item), text)
    total = np.concatenate([[0], np.cumsum(of_item)])
    at = np.flatnonzero(of_item)  # the best alignment begins with a match
    at = at[total[np.minimum(at + span, len(text))] - total[at] >= need]
    if len(at):
        part = at // max(STEP, 4 * span)
        edges = np.flatnonzero((np.diff(at) > span) | (np.diff(part) > 0)) + 1
        for a, b in zip(at[np.append(0, edges)], at[np.append(edges, len(at)) - 1], strict=True):
            yield int(a), int(min(b + span, len(text)))


HITS = "doc_id long, item int, passage binary"


def seed_hits(docs: DataFrame, items: list[np.ndarray], least: float) -> DataFrame:
    """One row per document, item that it shares a seed with, and passage that may reach the score."""
    shared = docs.sparkSession.sparkContext.broadcast((*seed_index(items), items))
    widths = sorted({min(SEED, len(h)) for h in items if len(h)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, item, items = shared.value
        table = WordTable(items)
        for batch in by_bytes(batches, "text", PIECE):
            ids = batch.column("doc_id").to_pylist()
            data, offsets = flat(pc.utf8_lower(batch.column("text")))
            h, bounds = words(data, offsets, SIGN)
            s, first = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *(shingles(h, bounds, n) for n in widths), strict=True))
            low = np.searchsorted(seeds, s, side="left")
            found = np.flatnonzero(low < len(seeds))
            found = found[seeds[low[found]] == s[found]] if len(seeds) else found
            found = found[np.argsort(first[found], kind="stable")]
            doc = np.searchsorted(bounds, first[found], side="right") - 1
            out: tuple[list, list, list] = ([], [], [])
            edges = np.flatnonzero(np.diff(doc)) + 1
            for own in np.split(found, edges) if len(found) else ():
                d = np.searchsorted(bounds, first[own[0]], side="right") - 1
                if ids[d] is None:
                    continue
                text = h[bounds[d] : bounds[d + 1]]
                held = np.unique(text)
                hit = np.unique(s[own])
                a, b = np.searchsorted(seeds, hit, side="left"), np.searchsorted(seeds, hit, side="right")
                rarest = np.argsort(b - a, kind="stable")
                met = np.concatenate([item[x:y] for x, y in zip(a[rarest], b[rarest], strict=True)])
                of = met[np.sort(np.unique(met, return_index=True)[1])]
                of = of[table.shared(of, held) >= least * table.sizes[of] - 1e-9]
                for i in of.tolist():
                    for left, right in passages(items[i], text, least):
                        out[0].append(ids[d]), out[1].append(i), out[2].append(text[left:right].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["doc_id", "item", "passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)


def leaks_of_block(docs: DataFrame, ids: list[int], texts: list[str], least: float) -> DataFrame:
    spark = docs.sparkSession
    items = item_words(texts)
    hits = cut(seed_hits(docs, items, least), "seed_hits")
    shared = spark.sparkContext.broadcast((items, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = shared.value
        for batch in batches:
            doc, item, score = [], [], []
            for d, i, passage in zip(batch.column("doc_id").to_pylist(), batch.column("item").to_pylist(), batch.column("passage").to_pylist(), strict=True):
                s = align(items[i], np.frombuffer(passage, np.uint64)) / (2 * len(items[i]))
                if s >= least:
                    doc.append(d), item.append(ids[i]), score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "item_id", "similarity"])

    # Alignments cost far more than rows are long: deal them evenly.
    dealt = hits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id", "item", "passage"))
    return dealt.mapInArrow(run, "doc_id long, item_id long, similarity double")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, similarity."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        block = (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).toArrow()
        part = leaks_of_block(docs, block["item_id"].to_pylist(), block["text"].to_pylist(), least)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
