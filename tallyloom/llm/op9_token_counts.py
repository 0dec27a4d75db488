"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

Pre-tokens are the blank-separated words of a text with the blank mark in front. A task inserts the distinct pre-tokens of
each batch of texts into a trie, built level by level. A trie node stands for a prefix and holds the best score of any
segmentation of that prefix into pieces of the vocabulary, with its number of pieces; it is worked out from the nodes above
it once, however many pre-tokens share the prefix. The nodes of a level are worked out together as numpy vectors. A
pre-token's terminal node thus gives its token count, and a document's count is the sum over its words.

Scores: the piece of rank r (order in the vocabulary file) has log probability -ln((r + 1) * H), H the sum of 1 / (r + 1)
(Zipf's law; the file has ranks, not probabilities). A character that is no piece by itself may also count as its UTF-8
bytes, each with the score of the last rank. Among equal scores fewer pieces win.

Defined results: a null or blank text has 0 words and 0 tokens; words of any length are scored whole; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_bytes

#: Longer words don't share prefixes worth a trie; they are scored one character after the other.
LONG_WORD = 128
MARK = "▁"


def read_pieces(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece model in rank order, without control, unknown and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Vocabulary:
    """Pieces as a trie: edges sorted by (node, character), the node that each leads to, and the score of the piece that ends there."""

    def __init__(self, pieces: list[str]) -> None:
        total = math.log(math.fsum(1 / (r + 1) for r in range(len(pieces))))
        edges: dict[tuple[int, str], int] = {}
        score = [-math.inf]
        for rank, piece in enumerate(pieces):
            node = 0
            for c in piece:
                if (child := edges.get((node, c))) is None:
                    child = edges[node, c] = len(score)
                    score.append(-math.inf)
                node = child
            score[node] = max(score[node], -math.log(rank + 1) - total)
        self.edges = edges
        keys = np.array([node << 21 | ord(c) for node, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.score = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(score)
        self.byte = -math.log(len(pieces)) - total

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Where each node's edge with the character leads; -1 without such an edge."""
        want = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def bytes_score(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of tokens of each character as bytes; -inf where the character is a piece."""
        n = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        node = self.step(np.zeros_like(chars), chars)
        whole = (node >= 0) & np.isfinite(self.score[node])
        return np.where(whole, -np.inf, n * self.byte), n


def trie_counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Token counts of distinct words (with their mark), none over LONG_WORD."""
    text = "".join(words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    out = np.zeros(len(words), np.int64)
    alive = np.flatnonzero(size > 0)  # words that go on
    node = np.zeros(len(alive), np.int64)  # their node in the level so far
    score, count = np.zeros(1), np.zeros(1, np.int64)
    open_: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # by start level: nodes, vocabulary nodes, score and count at the start
    depth = 0
    while len(alive):
        # The next level's nodes: distinct (parent, character).
        keys, inverse = np.unique(node << 21 | chars[start[alive] + depth], return_inverse=True)
        parent, c = keys >> 21, keys & 0x1FFFFF
        open_.append((np.arange(len(score)), np.zeros(len(score), np.int64), score, count))
        new_score, extra = vocabulary.bytes_score(c)
        new_score = score[parent] + new_score
        new_count = count[parent] + extra
        first = np.searchsorted(parent, np.arange(len(score) + 1))
        kept = []
        for nodes, states, s, k in open_:
            n = first[nodes + 1] - first[nodes]  # children of each
            total = int(n.sum())
            if not total:
                continue
            source = np.repeat(np.arange(len(nodes)), n)
            child = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[nodes], n)
            to = vocabulary.step(states[source], c[child])
            on = np.flatnonzero(to >= 0)
            if not len(on):
                continue
            child, to, s, k = child[on], to[on], s[source[on]], k[source[on]]
            with_piece = s + vocabulary.score[to]
            better = (with_piece > new_score[child]) | ((with_piece == new_score[child]) & (k + 1 < new_count[child])) & np.isfinite(with_piece)
            new_score[child[better]], new_count[child[better]] = with_piece[better], k[better] + 1
            kept.append((child, to, s, k))
        open_, score, count = kept, new_score, new_count
        depth += 1
        done = size[alive] == depth
        out[alive[done]] = count[inverse[done]]
        alive, node = alive[~done], inverse[~done]
    return out


def long_count(word: str, vocabulary: Vocabulary) -> int:
    """Token count of one word of any length."""
    score, count = 0.0, 0
    open_: list[tuple[int, float, int]] = []
    for c in word:
        open_.append((0, score, count))
        node = vocabulary.edges.get((0, c), -1)
        if node >= 0 and vocabulary.score[node] > -math.inf:
            score, count = -math.inf, 0
        else:
            n = len(c.encode("utf-8", "surrogatepass"))
            score, count = score + n * vocabulary.byte, count + n
        kept = []
        for at, s, k in open_:
            if (to := vocabulary.edges.get((at, c))) is not None:
                kept.append((to, s, k))
                p = s + float(vocabulary.score[to])
                if p > score or p == score and p > -math.inf and k + 1 < count:
                    score, count = p, k + 1
        open_ = kept
    return count


def count_words(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    marked = [MARK + w for w in words]
    out = trie_counts([w if len(w) <= LONG_WORD else "" for w in marked], vocabulary)
    for i, w in enumerate(marked):
        if len(w) > LONG_WORD:
            out[i] = long_count(w, vocabulary)
    return out


def token_counts(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens. pieces: path of the vocabulary, read on the driver (32,000 pieces, fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in by_bytes(batches, "text", 8 << 20):
            split = pc.utf8_split_whitespace(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            row = np.repeat(np.arange(batch.num_rows), split.value_lengths().to_numpy(zero_copy_only=False))
            coded = split.flatten().dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            distinct = coded.dictionary.to_pylist()
            shown = np.array([bool(w) for w in distinct], bool)
            per_word = count_words(distinct, vocabulary) if distinct else np.zeros(0, np.int64)
            words = np.bincount(row, shown[index], batch.num_rows).astype(np.int64)
            tokens = np.bincount(row, (per_word * shown)[index], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
