"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text into chunks of about 1 KB, so equal passages of different documents give
equal chunks wherever they stand. A task encodes each distinct chunk once and keeps its ids (in a cache of bounded size).
Encoding a chunk alone can split a word at its ends; the join of two chunks is repaired by encoding the text about it
again, from a safe place on its left to one on its right, widened chunk by chunk until both ends agree with token
boundaries of the chunks. A place is safe if a blank stands there between a visible ASCII character and an ASCII letter:
no pre-token of the vocabulary's pattern goes over it, whatever surrounds it.

Defined results: a null text is empty (no ids, ids_sha256 and decoded_sha256 of nothing); very long texts are encoded
whole; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, flat, gram_hash

#: Rolling-hash cuts stand every so many bytes on average; bytes of chunk text that a task's cache holds.
CHUNK_BYTES, CACHE_BYTES = 1024, 24 << 20
END = "<|endoftext|>"


def ranks_path() -> str:
    """Default vocabulary: the rank file of the byte-level BPE with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, lines: list[bytes], pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = len(ranks)
        self.whole = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: self.special})
        self.length = np.zeros(len(ranks) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.length[self.special] = len(END)
        self.cache: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.held = 0
        self.encoded_bytes = 0

    def ids(self, text: bytes) -> np.ndarray:
        self.encoded_bytes += len(text)
        return np.asarray(self.whole.encode(text.decode("utf-8"), allowed_special="all"), dtype=np.int64)

    def chunk(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk by itself, and where each token ends."""
        if (got := self.cache.get(text)) is not None:
            self.cache.move_to_end(text)
            return got
        ids = self.ids(text)
        got = ids.astype(np.uint16 if self.special < 65536 else np.uint32), np.cumsum(self.length[ids])
        self.cache[text] = got
        self.held += 8 * len(text)
        while self.held > 8 * CACHE_BYTES and len(self.cache) > 1:
            old, _ = self.cache.popitem(last=False)
            self.held -= 8 * len(old)
        return got

    def encode(self, text: bytes, cuts: list[int], safe: np.ndarray) -> np.ndarray:
        """Ids of text, from its chunks [0, cuts..., len) and sorted safe places."""
        if not cuts:
            return self.ids(text) if len(text) < 64 else self.chunk(text)[0]
        edges = [0, *cuts, len(text)]
        parts, done = [], 0  # the ids of text[:done] are exact and in parts
        for i, cut in enumerate(cuts):
            start = edges[i]
            k = int(np.searchsorted(safe, cut, side="right"))
            before = int(safe[k - 1]) if k else -1
            if before < max(start, done):  # no safe place in this chunk: the join after it widens over the chunk
                continue
            parts += self._between(text, done, before, edges, i, safe)
            done = before
        parts.append(self._tail(text, done, edges, safe))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _between(self, text: bytes, done: int, to: int, edges: list[int], i: int, safe: np.ndarray) -> list[np.ndarray]:
        """Exact ids of text[done:to], both safe places (or 0), with to in chunk i: the join's part encoded again, the rest from the chunk."""
        start = edges[i]
        first = done
        if done < start:  # the join before chunk i: up to the first safe place within it
            first = int(safe[np.searchsorted(safe, start)])
        ids, ends = self.chunk(text[start : edges[i + 1]])
        a = 0 if first == start else int(np.searchsorted(ends, first - start)) + 1
        b = 0 if to == start else int(np.searchsorted(ends, to - start)) + 1
        agree = (a == 0 or ends[a - 1] == first - start) and (b == 0 or ends[b - 1] == to - start)
        if not agree:  # a token of the chunk goes over the edge: widen to the whole stretch
            return [self.ids(text[done:to])]
        out = [self.ids(text[done:first])] if first > done else []
        return [*out, ids[a:b]]

    def _tail(self, text: bytes, done: int, edges: list[int], safe: np.ndarray) -> np.ndarray:
        last = edges[-2]
        k = np.searchsorted(safe, last)
        if k < len(safe) and done <= safe[k] and safe[k] < len(text):
            first = int(safe[k])
            ids, ends = self.chunk(text[last:])
            a = 0 if first == last else int(np.searchsorted(ends, first - last)) + 1
            if a == 0 or ends[a - 1] == first - last:
                return np.concatenate([self.ids(text[done:first]), ids[a:]]) if first > done else ids[a:]
        return self.ids(text[done:])

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk cuts and safe places of all texts, as positions in data."""
    n = len(data)
    if n < 17:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hash(data, 4)
    cuts = np.flatnonzero(h % np.uint64(CHUNK_BYTES) == 0) + 16
    cuts = cuts[cuts < n]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]  # between characters
    low = data | 0x20
    letter = (low >= 97) & (low <= 122) & (data < 128)
    shown = (data > 0x20) & (data < 0x7F)
    safe = np.flatnonzero((data[1:-1] == 0x20) & shown[:-2] & letter[2:]) + 1
    bounds = offsets[1:-1]
    # A cut's window must lie in its own text; places next to a text's edges are left out.
    owner = np.searchsorted(offsets, cuts, side="right") - 1
    cuts = cuts[cuts - 16 >= offsets[owner]]
    cuts = cuts[~np.isin(cuts, offsets)]
    near = np.unique(np.concatenate([bounds - 1, bounds]))
    return cuts, safe[~np.isin(safe, near)]


def encode_batch(codec: Codec, column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = flat(column)
    cuts, safe = places(data, offsets)
    raw = data.tobytes()
    c = np.searchsorted(cuts, offsets)
    s = np.searchsorted(safe, offsets)
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        yield codec.encode(raw[a:b], (cuts[c[i] : c[i + 1]] - a).tolist(), safe[s[i] : s[i + 1]] - a)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str | None) -> tuple[list[bytes], str]:
    import public_tokenizers

    with open(path or ranks_path(), "rb") as lines:
        return list(lines), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks: str | None = None, keep_ids: bool = False, schema: str = SCHEMA) -> DataFrame:
    """Per row: doc_id, number of ids, digests of the ids and of the text decoded from them; with keep_ids also `ids` and
    `decoded`. ranks: path of the rank file, read on the driver and sent to each task (about 1 MB, fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        number = [str(i) for i in range(codec.special + 1)]
        for batch in by_bytes(batches, "text", 4 << 20):
            count, ids_sha, text_sha, kept, texts = [], [], [], [], []
            for ids in encode_batch(codec, batch.column("text")):
                listed = ids.tolist()
                decoded = codec.decode(ids)
                count.append(len(listed))
                ids_sha.append(hashlib.sha256(",".join(map(number.__getitem__, listed)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    kept.append(listed)
                    texts.append(decoded)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + extra)
