"""Language identification by multilingual mixture inference.

Training counts, over all documents with a language outside the held-out fold, how often each character trigram stands in
the words of each language (trigrams hashed into BUCKETS, summed in Spark). A word's likelihood in a language is the product
of its smoothed trigram probabilities. Each document is a mixture of languages: expectation-maximisation over its words
estimates the proportions, starting from all languages alike. Sets are compared by penalised likelihood, log likelihood -
PENALTY / 2 * (languages - 1) * ln(words), from the full set down to one language, each time without the smallest proportion: no language leaves
before the likelihood has seen it. The predicted language has the largest proportion, which is the
score.

Defined results: `und` with score 0 if a text is null, empty or without letters, or if nothing could be learned; texts of any
length count whole; ties go to the language that sorts first; null languages teach nothing; repeated rows count and are
answered each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold

BUCKETS, CONTEXTS, SMOOTH = 1 << 17, 1 << 15, 0.05
PENALTY, ROUNDS = 4.0, 8
SLICE = 2 << 20

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram and context buckets of all words' places (with the end of each word), where words begin among them, each word's row."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    text = " ".join(column.to_pylist())  # a blank parts the texts
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([code, [32]]).astype(np.uint32)
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    c = np.where(letter_table()[code], code, 0).astype(np.uint32)
    b = np.concatenate([[0], c[:-1]]).astype(np.uint32)
    a = np.where(b == 0, 0, np.concatenate([[0], b[:-1]])).astype(np.uint32)
    at = np.flatnonzero((c > 0) | (b > 0))
    a, b, c = a[at], b[at], c[at]
    context = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    context ^= context >> np.uint32(15)
    whole = (context + c) * np.uint32(0xC2B2AE3D)
    whole ^= whole >> np.uint32(13)
    whole *= np.uint32(0x27D4EB2F)
    begins = np.flatnonzero(b == 0)
    row = np.searchsorted(np.cumsum(size), at[begins], side="right")
    return (whole >> np.uint32(15)).astype(np.int64), (context * np.uint32(0x165667B1) >> np.uint32(17)).astype(np.int64), begins, row


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, kind (0 trigram, 1 context), bucket, n over the rows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in by_bytes(batches, "text", SLICE):
            whole, context, begins, row = trigrams(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            of_place = np.repeat(coded.indices.to_numpy(zero_copy_only=False)[row], np.diff(np.append(begins, len(whole))))
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                own = of_place == k
                t = total.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(CONTEXTS, np.int64)))
                t[0][:] += np.bincount(whole[own], minlength=BUCKETS)
                t[1][:] += np.bincount(context[own], minlength=CONTEXTS)
        for lang, counts in total.items():
            for kind, n in enumerate(counts):
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(np.full(len(seen), kind, np.int32)), pa.array(seen), pa.array(n[seen])], names=["lang", "kind", "bucket", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


class Languages:
    """Smoothed trigram log probabilities of each language."""

    def __init__(self, names: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.names = names
        self.whole = np.zeros((len(names), BUCKETS), np.float32)
        self.context = np.zeros((len(names), CONTEXTS), np.float32)
        for k, (kind, bucket, n) in enumerate(counts):
            self.whole[k, bucket[kind == 0]] = n[kind == 0]
            self.context[k, bucket[kind == 1]] = n[kind == 1]
        self.whole = np.log(self.whole + SMOOTH)
        self.context = np.log(self.context + SMOOTH * 40)

    def words(self, whole: np.ndarray, context: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log likelihood of each word in each language."""
        return np.stack([np.add.reduceat(w[whole] - c[context], begins) for w, c in zip(self.whole, self.context, strict=True)], axis=1)


def em(p: np.ndarray, begins: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and mixture log likelihood (of p) for each document. p: words by languages, scaled to at most 1; doc: each word's place among the documents."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(np.append(begins, len(p)))[:, None]
    for _ in range(rounds):
        r = p * share[doc]
        r /= r.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(r, begins, axis=0) / n
    return share, np.add.reduceat(np.log((p * share[doc]).sum(axis=1) + 1e-300), begins)


def mixtures(logp: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages for documents whose words begin at `begins`."""
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(logp - top, -60.0).astype(np.float64))
    n = np.diff(np.append(begins, len(p)))
    doc = np.repeat(np.arange(len(begins)), n)
    best = np.zeros((len(begins), p.shape[1]))
    allowed = np.ones(best.shape, bool)
    value = np.full(len(begins), -np.inf)
    left = np.arange(len(begins))
    while len(left):  # the whole set and then ever smaller ones
        words = np.flatnonzero(np.isin(doc, left))
        starts = np.cumsum(n[left]) - n[left]
        share, like = em(p[words], starts, np.repeat(np.arange(len(left)), n[left]), allowed[left].astype(np.float64), ROUNDS)
        k = allowed[left].sum(axis=1)
        penalised = like - PENALTY / 2 * (k - 1) * np.log(np.maximum(n[left], 2))
        wins = penalised > value[left]
        best[left[wins]], value[left[wins]] = share[wins], penalised[wins]
        smallest = p.shape[1] - 1 - np.argmin(np.where(allowed[left], share, np.inf)[:, ::-1], axis=1)  # of equal ones the last
        allowed[left, smallest] = False
        left = left[k > 1]
    return best


def language_id(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and `shares` (each selected language's proportion)."""
    spark = docs.sparkSession
    taught = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (fold() != 2)).withColumn("lang", F.col("lang").cast("string"))
    counts = trigram_counts(taught).toArrow().sort_by("lang")  # at most BUCKETS + CONTEXTS rows a language
    lang = np.array(counts["lang"].to_pylist(), dtype=object)
    names = sorted(set(lang.tolist()))
    columns = [counts[c].to_numpy() for c in ("kind", "bucket", "n")]
    shared = spark.sparkContext.broadcast((names, [tuple(c[lang == name] for c in columns) for name in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(*shared.value)
        for batch in by_bytes(batches, "text", SLICE):
            pred, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            shares: list = [None] * batch.num_rows
            if languages.names:
                whole, context, begins, row = trigrams(batch.column("text"))
                if len(begins):
                    rows, first = np.unique(row, return_index=True)
                    share = mixtures(languages.words(whole, context, begins), first)
                    top = share.argmax(axis=1)
                    pred[rows] = np.array(languages.names, object)[top]
                    score[rows] = np.minimum(share[np.arange(len(rows)), top], 1.0)
                    for r, s in zip(rows.tolist(), share, strict=True):
                        shares[r] = [(languages.names[k], float(s[k])) for k in np.flatnonzero(s > 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "shares"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "shares")
