"""Exact substring deduplication with suffix arrays.

Every byte goes that a WIDTH-byte string covers which also starts earlier (smaller doc_id, or earlier in the document).
Whether strings are equal is found by suffix arrays and sorting over their bytes; hashes only deal the work out.

1. Shards of text. Windows of WIDTH bytes are grouped by their minimizer, the leftmost 32-gram with the smallest hash in the
   window, so equal windows meet wherever they stand; a window whose minimizer stands nowhere else has no equal. Neighbouring
   windows with one minimizer form a stretch, at most 168 bytes. Texts are dealt out in ranges of hashes of their beginnings,
   so that copies come in one batch. In each batch of texts (BATCH bytes) the stretches of
   minimizers that recur in it, with their neighbours in one string, get a suffix array, by Larsson-Sadakane refinement in numpy (8 bytes first, then doubling
   over groups that are not yet told apart, until WIDTH bytes are). Its suffixes that share WIDTH bytes stand side by side as
   one class; all but its earliest window go. Stretches that keep a window are recorded as
   (minimizer, document, place), so a passage that a third of the documents hold leaves each batch about once.
2. Shards of minimizers. Records are dealt into buckets by minimizer (BUCKET bytes of text each). Minimizers with one record
   are done; the stretches of the others are looked up in their texts. Of stretches that are equal byte for byte the
   earliest stays; these get suffix arrays in the same way, HOT records of one minimizer at most in one.
3. Shards of cores. A minimizer with more than HOT records stands in several shards. Of their earliest windows, neighbours
   whose minimizer lies in the same CELL places go on together; all such windows hold the same bytes around the
   minimizer, the core. Dealt out by core, equal windows meet again; a core with one record is done, the others get
   suffix arrays, and if they need several (over HOT records), the earliest windows of these are sorted by their bytes.

Defined results: a null text is empty (nothing removed); texts under WIDTH bytes keep all; rows with a null doc_id take no
part; rows that repeat a doc_id and its text count as one and each get its result; if their texts differ, each row loses
what was found for the doc_id; texts of any length are treated whole, in slices; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, flat, gram_hash, mix

WIDTH, LEVELS = 100, 5
GRAM = 1 << LEVELS
SPAN = WIDTH - GRAM + 1  # grams in a window
SLICE, BATCH, BUCKET = 1 << 18, 512 << 10, 32 << 20
#: Characters at a text's beginning that bring it beside its like.
LIKE = 64
#: Records of one minimizer in one shard (at most one array's bytes); bytes of one suffix array; wanted records of one bucket.
HOT, ARRAY, WANTED = 3000, 1 << 19, 60_000
#: Places of a minimizer in its window that one core covers; windows compared byte for byte at once.
CELL, SORTED = 18, 100_000


def stretches(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Stretches of the windows of data: columns minimizer, first window, number of windows. valid: windows within one text."""
    found = []
    for a in range(0, len(data) - WIDTH + 1, SLICE):
        part = data[a : a + SLICE + WIDTH - 1]
        h = gram_hash(part, LEVELS)
        low = np.uint64((1 << 24) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= SPAN:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < SPAN:
            m = np.minimum(m[: len(m) - (SPAN - step)], m[SPAN - step :])
        place = (m & low).astype(np.int64)
        ok = valid[a : a + len(place)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (place[1:] != place[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        if len(first):
            found.append(np.stack([h[place[first]], (first + a).astype(np.uint64), (last - first + 1).astype(np.uint64)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.uint64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def sizes(places: np.ndarray) -> np.ndarray:
    """Bytes of stretches; a place is (first window << 7 | number of windows)."""
    return (places & np.uint64(127)).astype(np.int64) + WIDTH - 1


def blobs(key: np.ndarray, records: np.ndarray, kind: str) -> pa.RecordBatch:
    """Records packed by key: one row per key."""
    order = np.argsort(key, kind="stable")
    key, records = key[order], np.ascontiguousarray(records[order])
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    width = records.shape[1] * 8
    offsets = np.concatenate([at, [len(key)]]) * width
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(records)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key[at].astype(np.int64)), pa.array([kind] * len(at), pa.string()), data], names=["key", "kind", "blob"])


def unpack(blob: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in blob), np.uint64).reshape(-1, width)


def doc_key(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The documents' bucket, as doc_bucket() has it."""
    doc = doc.view(np.uint64)
    return (doc ^ doc >> np.uint64(7) ^ doc >> np.uint64(15)).view(np.int64) % buckets


def doc_bucket(buckets: int) -> Column:
    doc = F.col("doc_id")
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 7)).bitwiseXOR(F.shiftrightunsigned(doc, 15)), F.lit(buckets))


def pass_spans(t: pa.Table) -> pa.Table | None:
    """Spans on their way past a grouping of other rows: their keys are -1 - bucket meanwhile."""
    if t["kind"][0].as_py() != "spans":
        return None
    return pa.table([pa.array(-1 - t["key"].to_numpy()), t["kind"], t["blob"]], names=["key", "kind", "blob"])


def beside(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.when(F.col("kind") == "spans", -1 - F.col("key")).otherwise(F.col("key")))


BLOBS = "key long, kind string, blob binary"


def numbers(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray(max(len(data) - 7, 0), kind, np.ascontiguousarray(data), strides=(1,))


def edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of sorted values differ from the one before, and which from both their neighbours."""
    new = np.ones(len(values) + 1, bool)
    np.not_equal(values[1:], values[:-1], out=new[1:-1])
    return new[:-1], new[:-1] & new[1:]


def suffix_array(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least WIDTH bytes in order of their first WIDTH bytes, and which of them share these with the one before. data: bytes of all strings; left: bytes to the string's end."""
    n = len(data)
    bits = max(n - 1, 1).bit_length()
    key = numbers(data, ">u8").astype(np.uint64)
    sa = np.argsort(key)
    sa = sa[left[sa] >= 8]
    key = key[sa]
    # Suffixes are in one group, by where it begins, as long as they are not told apart.
    rank = np.zeros(n, np.int32 if bits < 32 else np.int64)
    new, single = edges(key)
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, len(sa))))
    rank[sa] = group
    at = np.flatnonzero(~single & (left[sa] >= 16))  # a suffix that ends sooner than it is told apart needs no place
    member, group = sa[at], group[at]
    h = 8
    while h < WIDTH and len(at):
        step = min(h, WIDTH - h)
        second = rank[member + step]
        if 3 * bits < 64:
            pair = np.sort(group << 2 * bits | second.astype(np.int64) << bits | member)
            member = pair & ((1 << bits) - 1)
            pair >>= bits
        else:
            pair = group * n + second
            order = np.argsort(pair)
            member, pair = member[order], pair[order]
        sa[at] = member
        new, single = edges(pair)
        first = np.flatnonzero(new)
        group = np.repeat(at[first], np.diff(np.append(first, len(at))))
        rank[member] = group
        h += step
        open_ = ~single & (left[member] >= min(2 * h, WIDTH))
        if not open_.all():
            at, member, group = at[open_], member[open_], group[open_]
    sa = sa[left[sa] >= WIDTH]
    order = rank[sa]
    return sa, np.concatenate([[False], order[1:] == order[:-1]])[: len(sa)]


def removed_windows(strings: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in strings (concatenated bytes, sizes, earliest string first): string and offset of those that stand earlier, and of the earliest of each class."""
    end = np.cumsum(size)
    start = end - size
    kind = np.int32 if len(strings) < 1 << 31 else np.int64
    windows, follows = suffix_array(strings, np.repeat(end.astype(kind), size) - np.arange(len(strings), dtype=kind))
    head = np.flatnonzero(~follows)
    earliest = np.zeros(len(strings), bool)
    earliest[np.minimum.reduceat(windows, head)] = True
    again = np.zeros(len(strings), bool)
    again[windows] = True
    again &= ~earliest
    again, least = np.flatnonzero(again), np.flatnonzero(earliest)
    of, of_least = (np.searchsorted(end, x, side="right") for x in (again, least))
    return of, again - start[of], of_least, least - start[of_least]


def window_spans(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(document, start, end) covered by removed windows, sorted by document and place; runs of windows become one span."""
    if not len(doc):
        return np.zeros((0, 3), np.uint64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + np.uint64(1))])
    first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
    return np.stack([doc[first], place[first], place[last] + np.uint64(WIDTH)], axis=1)


def copies(data: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings (in order) those that equal an earlier one byte for byte, and the others."""
    padded = np.zeros((len(order), 2 + int(size[order].max())), np.uint8)
    padded[:, :2] = size[order].astype(np.uint16).view(np.uint8).reshape(-1, 2)
    place = np.arange(padded.shape[1] - 2)
    inside = place < size[order][:, None]
    padded[:, 2:] = np.where(inside, data[np.minimum(begin[order][:, None] + place, len(data) - 1)], 0)
    _, first = np.unique(padded.view(f"S{padded.shape[1]}").ravel(), return_index=True)
    other = np.ones(len(order), bool)
    other[first] = False
    return order[other], order[~other]


def repeated(groups: np.ndarray, docs: np.ndarray, places: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that stand earlier in their group of stretches, and those that don't: (document, start, end) of the first, then
    for each of the others its stretch, offset in it, and place in data. Stretches (group, document, place, begin in data)
    come sorted by group, document and place."""
    size = sizes(places)
    first, count = runs(groups)
    total = np.add.reduceat(size, first)
    part = (np.cumsum(total) - total) // ARRAY  # whole groups, about ARRAY bytes together
    spans, lead, offset = [], [], []
    for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(part)) + 1):
        a, b = first[own[0]], first[own[-1]] + count[own[-1]]
        # Earliest first, so that places in the array's text order the windows.
        order = a + np.lexsort((places[a:b] >> np.uint64(7), docs[a:b].view(np.int64)))
        copy, order = copies(data, begin, size, order)
        start = places[copy] >> np.uint64(7)
        spans.append(np.stack([docs[copy], start, start + size[copy].astype(np.uint64)], axis=1))
        n = size[order]
        take = np.repeat(begin[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        again, at, kept, kept_at = removed_windows(data[take], n)
        again, kept = order[again], order[kept]
        spans.append(window_spans(docs[again], (places[again] >> np.uint64(7)) + at.astype(np.uint64)))
        lead.append(kept), offset.append(kept_at)
    lead, offset = np.concatenate(lead), np.concatenate(offset)
    return np.concatenate(spans), lead, offset, begin[lead] + offset, size


def repeated_in(docs: np.ndarray, places: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start, end) of windows of a batch's stretches (document, place, begin in data) that stand earlier in it, and where in data these begin."""
    order = np.argsort(begin)
    docs, begin = docs[order], begin[order]
    count = (places[order] & np.uint64(127)).astype(np.int64)
    start = (places[order] >> np.uint64(7)).astype(np.int64)
    joins = (begin[1:] == begin[:-1] + count[:-1]) & (docs[1:] == docs[:-1]) & (start[1:] == start[:-1] + count[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~joins]))
    n = np.add.reduceat(count, first) + WIDTH - 1
    docs, start, begin = docs[first], start[first], begin[first]
    order = np.lexsort((start, docs.view(np.int64)))  # earliest first, so that places in the array's text order the windows
    docs, start, begin, n = docs[order], start[order], begin[order], n[order]
    take = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    again, at, _, _ = removed_windows(data[take], n)
    return window_spans(docs[again], (start[again] + at).astype(np.uint64)), np.sort(begin[again] + at)


def beside_copies(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts in the order of hashes of their beginnings and of themselves: copies stand side by side. Ranges end within a large group too, which no hash partition does."""
    by = [F.xxhash64(F.substring("text", 1, LIKE)), F.xxhash64("text"), F.col("doc_id")]
    return docs.repartitionByRange(buckets, *by).sortWithinPartitions(*by)


def windows(docs: DataFrame, buckets: int) -> DataFrame:
    """`records` (minimizer, document, place) by bucket of minimizers, and `spans` of what a batch already removes, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            data, offsets = flat(batch.column("text"))
            whole = np.ones(len(data), bool)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                whole[max(a, b - WIDTH + 1) : b] = False
            s = stretches(data, whole)
            row = np.searchsorted(offsets, s[:, 1].astype(np.int64), side="right") - 1
            docs_ = batch.column("doc_id").to_numpy()[row].view(np.uint64)
            place = (s[:, 1] - offsets[row].astype(np.uint64)) << np.uint64(7) | s[:, 2]
            order = np.lexsort((place, docs_.view(np.int64), s[:, 0]))
            key, docs_, place, begin = s[order, 0], docs_[order], place[order], s[order, 1].astype(np.int64)
            if len(key):  # a row that stands twice counts once
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (docs_[1:] != docs_[:-1]) | (place[1:] != place[:-1])])
                key, docs_, place, begin = key[once], docs_[once], place[once], begin[once]
            stays = np.ones(len(key), bool)
            first, count = runs(key)
            several = np.flatnonzero(np.repeat(count > 1, count))
            if len(several):
                spans, gone = repeated_in(docs_[several], place[several], begin[several], data)
                n = (place[several] & np.uint64(127)).astype(np.int64)
                stays[several] = np.searchsorted(gone, begin[several] + n) - np.searchsorted(gone, begin[several]) < n
                if len(spans):
                    yield blobs(doc_key(spans[:, 0], buckets), spans, "spans")
            records = np.stack([key[stays], docs_[stays], place[stays]], axis=1)
            yield blobs((records[:, 0] >> np.uint64(11)) % np.uint64(buckets), records, "records")

    return docs.mapInArrow(run, BLOBS)


def shared_stretches(records: DataFrame, buckets: int, hot: int) -> DataFrame:
    """By bucket of documents: `spans` as they come, and `wanted`: (document, place, minimizer, shard, shards) of stretches whose minimizers recur."""

    def run(t: pa.Table) -> pa.Table:
        if (spans := pass_spans(t)) is not None:
            return spans
        r = unpack(t["blob"], 3)
        r = r[np.lexsort((r[:, 2], r[:, 1].view(np.int64), r[:, 0]))]
        r = r[np.concatenate([[True], (r[1:] != r[:-1]).any(axis=1)])] if len(r) else r
        first, count = runs(r[:, 0])
        n, nth = np.repeat(count, count), np.arange(len(r)) - np.repeat(first, count)
        own = n > 1
        wanted = np.stack([r[own, 1], r[own, 2], r[own, 0], (nth[own] // hot).astype(np.uint64), (-(-n[own] // hot)).astype(np.uint64)], axis=1)
        return pa.Table.from_batches([blobs(doc_key(wanted[:, 0], buckets), wanted, "wanted")])

    return beside(records).repartition(buckets, "key").groupBy("key").applyInArrow(run, BLOBS)


def look_up(docs: DataFrame, wanted: DataFrame, buckets: int, arrays: int) -> DataFrame:
    """The wanted stretches with their bytes, packed by bucket of minimizers and shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("meta", pa.binary()), ("bytes", pa.binary())])
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        data, offsets = flat(left["text"])
        ids = left["doc_id"].to_numpy().view(np.uint64)
        order = np.argsort(ids, kind="stable")
        w = unpack(right["blob"], 5)
        at = order[np.minimum(np.searchsorted(ids[order], w[:, 0]), len(ids) - 1)]
        begin = offsets[at] + (w[:, 1] >> np.uint64(7)).astype(np.int64)
        size = sizes(w[:, 1])
        key = (mix(w[:, 2] + w[:, 3]) % np.uint64(arrays)).astype(np.int64)
        by_key = np.argsort(key, kind="stable")
        first, count = runs(key[by_key])
        rows: tuple[list, list, list] = ([], [], [])
        for a, k in zip(first.tolist(), count.tolist(), strict=True):
            own = by_key[a : a + k]
            n = size[own]
            take = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows[0].append(int(key[own[0]])), rows[1].append(np.ascontiguousarray(w[own]).tobytes()), rows[2].append(data[take].tobytes())
        return pa.table([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    return docs.groupBy("key").cogroup(wanted.repartition(buckets, "key").groupBy("key")).applyInArrow(run, "key long, meta binary, bytes binary")


def hashes(seed: np.ndarray, eight: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of `length` bytes (over 80, at most WIDTH) from places of data on. eight: its numbers()."""
    h = mix(seed.astype(np.uint64))
    for j in range(0, 80, 8):
        h = mix(h ^ eight[at + j])
    for j in (16, 8):  # the rest, and some of what came before
        h = mix(h ^ eight[at + length - j])
    return h


def places_of_minimizers(w: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where in each stretch its minimizer stands: the first gram of that hash."""
    size = sizes(w[:, 1])
    out = np.zeros(len(w), np.int64)
    part = (np.cumsum(size) - size) // SLICE
    for own in np.split(np.arange(len(w)), np.flatnonzero(np.diff(part)) + 1):
        n = size[own]
        start = np.cumsum(n) - n
        h = gram_hash(data[np.repeat(begin[own] - start, n) + np.arange(n.sum())], LEVELS)
        hit = np.flatnonzero(h == np.repeat(w[own, 2], n)[: len(h)])
        of = np.repeat(np.arange(len(own)), n)[hit]
        first, _ = runs(of)
        out[own[of[first]]] = hit[first] - start[of[first]]
    return out


def core_parts(w: np.ndarray, begin: np.ndarray, data: np.ndarray, lead: np.ndarray, offset: np.ndarray, arrays: int) -> pa.RecordBatch:
    """Windows (stretch, offset; in order) as rows by bucket of cores: how many records, (core, document, place) of each, and their bytes."""
    own, lead = np.unique(lead, return_inverse=True)
    w, begin = w[own], begin[own]
    gram = places_of_minimizers(w, begin, data)
    cell = (gram[lead] - offset) // CELL
    new = np.ones(len(lead), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (offset[1:] != offset[:-1] + 1) | (cell[1:] != cell[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(lead)))
    lead, offset, cell = lead[first], offset[first], cell[first]
    low = cell * CELL
    high = np.minimum(low + CELL, SPAN) - 1
    core = hashes(cell, numbers(data, "<u8"), begin[lead] + gram[lead] - low, WIDTH - (high - low))
    records = np.stack([core, w[lead, 0], ((w[lead, 1] >> np.uint64(7)) + offset.astype(np.uint64)) << np.uint64(7) | count.astype(np.uint64)], axis=1)
    key = (core % np.uint64(arrays)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    records, at, n = records[order], (begin[lead] + offset)[order], count[order] + WIDTH - 1
    first, rows = runs(key[order])
    blob = []
    for a, k in zip(first.tolist(), rows.tolist(), strict=True):
        size = n[a : a + k]
        take = np.repeat(at[a : a + k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        blob.append(np.uint64(k).tobytes() + records[a : a + k].tobytes() + data[take].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(key[order][first]), pa.array(["core"] * len(first), pa.string()), pa.array(blob, pa.binary())], names=["key", "kind", "blob"])


def shards(found: DataFrame, buckets: int, arrays: int) -> DataFrame:
    """`spans` by bucket of documents, and for minimizers in several shards their earliest windows by bucket of `core`s."""

    def run(t: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("blob", pa.binary())])
        w = unpack(t["meta"], 5)
        data = np.frombuffer(b"".join(x.as_buffer() for x in t["bytes"]), np.uint8)
        size = sizes(w[:, 1])
        begin = np.cumsum(size) - size
        order = np.lexsort((w[:, 1], w[:, 0].view(np.int64), w[:, 3], w[:, 2]))
        w, begin = w[order], begin[order]
        group = np.cumsum(np.concatenate([[0], (w[1:, 2:4] != w[:-1, 2:4]).any(axis=1)]))
        spans, lead, offset, _, _ = repeated(group, w[:, 0], w[:, 1], begin, data)
        out = []
        if len(spans):
            out.append(blobs(doc_key(spans[:, 0], buckets), spans, "spans"))
        split = w[lead, 4] > 1
        if split.any():
            out.append(core_parts(w, begin, data, lead[split], offset[split], arrays))
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    return found.repartition(arrays, "key").groupBy("key").applyInArrow(run, BLOBS)


def repeated_across(docs: np.ndarray, places: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(document, start, end) of windows (document, place, begin in data) of several suffix arrays that stand earlier in another one. Only windows whose hashes recur are compared."""
    eight = numbers(data, "<u8")
    h = np.concatenate([hashes(np.zeros(len(own), np.uint64), eight, own, WIDTH) for own in np.split(at, range(SORTED, len(at), SORTED))])
    order = np.argsort(h)
    first, count = runs(h[order])
    order = order[np.repeat(count > 1, count)]
    first, _ = runs(h[order])
    part = first // SORTED
    gone = [order[:0]]
    for own in np.split(order, first[1:][np.diff(part) > 0]) if len(order) else []:  # whole hashes
        text = np.ascontiguousarray(data[at[own][:, None] + np.arange(WIDTH)]).view(f"S{WIDTH}").ravel()
        by_text = np.lexsort((places[own], docs[own].view(np.int64), text))
        gone.append(own[by_text[1:][text[by_text[1:]] == text[by_text[:-1]]]])
    gone = np.concatenate(gone)
    gone = gone[np.lexsort((places[gone], docs[gone]))]
    return window_spans(docs[gone], places[gone])


def cores(rows: DataFrame, buckets: int, arrays: int, hot: int) -> DataFrame:
    """The `spans` of rows, and those of windows that stand earlier in another shard."""

    def run(t: pa.Table) -> pa.Table:
        if (spans := pass_spans(t)) is not None:
            return spans
        records, texts = [], []
        for blob in t["blob"]:
            raw = blob.as_buffer()
            n = int(np.frombuffer(raw, np.uint64, 1)[0])
            records.append(np.frombuffer(raw, np.uint64, 3 * n, 8).reshape(-1, 3)), texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 24 * n))
        r, data = np.concatenate(records), np.concatenate(texts)
        size = sizes(r[:, 2])
        begin = np.cumsum(size) - size
        order = np.lexsort((r[:, 2], r[:, 1].view(np.int64), r[:, 0]))
        first, count = runs(r[order, 0])
        n, nth = np.repeat(count, count), np.arange(len(r)) - np.repeat(first, count)
        own = n > 1
        if not own.any():
            return t.slice(0, 0)
        order, n, nth = order[own], n[own], nth[own]
        core, docs, places, begin = r[order, 0], r[order, 1], r[order, 2], begin[order]
        group = np.cumsum(np.concatenate([[0], (core[1:] != core[:-1]) | (nth[1:] % hot == 0)]))
        spans, lead, offset, at, _ = repeated(group, docs, places, begin, data)
        split = n[lead] > hot
        if split.any():
            lead, offset, at = lead[split], offset[split], at[split]
            spans = np.concatenate([spans, repeated_across(docs[lead], (places[lead] >> np.uint64(7)) + offset.astype(np.uint64), at, data)])
        return pa.Table.from_batches([blobs(doc_key(spans[:, 0], buckets), spans, "spans")])

    return beside(rows).repartition(arrays, "key").groupBy("key").applyInArrow(run, BLOBS)


def kept_bytes(docs: DataFrame, spans: DataFrame, buckets: int, keep_text: bool) -> DataFrame:
    extra = ", kept binary" if keep_text else ""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = unpack(right["blob"], 3) if right.num_rows else np.zeros((0, 3), np.uint64)
        s = s[np.lexsort((s[:, 1], s[:, 0]))]
        data, offsets = flat(left["text"])
        ids = left["doc_id"].to_numpy().view(np.uint64)
        first, last = np.searchsorted(s[:, 0], ids, side="left"), np.searchsorted(s[:, 0], ids, side="right")
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for i in range(len(ids)):
            own = data[offsets[i] : offsets[i + 1]]
            n = 0
            if last[i] > first[i]:
                begin, end = s[first[i] : last[i], 1].astype(np.int64), s[first[i] : last[i], 2].astype(np.int64)
                change = np.zeros(len(own) + 1, np.int32)
                np.add.at(change, np.minimum(begin, len(own)), 1)
                np.add.at(change, np.minimum(end, len(own)), -1)
                gone = np.cumsum(change[:-1]) > 0
                n = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                own = own[~gone]
            out[0].append(int(offsets[i + 1] - offsets[i])), out[1].append(int(offsets[i + 1] - offsets[i]) - len(own)), out[2].append(n)
            out[3].append(hashlib.sha256(own.tobytes()).hexdigest())
            if keep_text:
                out[4].append(own.tobytes())
        columns = [left["doc_id"].combine_chunks(), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.table([*columns, pa.array(out[4], pa.binary())] if keep_text else columns, names=[*names, "kept"] if keep_text else names)

    return docs.groupBy("key").cogroup(spans.repartition(buckets, "key").groupBy("key")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text `kept`, the remaining bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(least, -(-size // BUCKET))
    found = cut(shared_stretches(windows(beside_copies(docs, buckets), buckets), buckets, hot), "stretches")
    wanted = found.filter("kind = 'wanted'")
    arrays = max(least, -(-(wanted.agg(F.sum(F.octet_length("blob").cast("long"))).first()[0] or 0) // (40 * WANTED)))
    keyed = docs.withColumn("key", doc_bucket(buckets)).repartition(buckets, "key")  # dealt out once: look_up and kept_bytes share the exchange
    sharded = shards(look_up(keyed, wanted, buckets, arrays), buckets, arrays)
    return kept_bytes(keyed, found.filter("kind = 'spans'").unionByName(cores(sharded, buckets, arrays, hot)), buckets, keep_text)
