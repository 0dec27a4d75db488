"""Toxicity scores after noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all documents (per task in numpy, summed in Spark).
2. Suspicious spans (a sign or digit between, before or after letters, a letter three times in a row, single letters with
   separators) become character lattices: a sign is itself or a letter it stands for, a run of one letter or sign is one or
   two of it (a channel that repeats symbols), a separator between single letters is nothing or a word edge (the reading as one word counts too). Viterbi decoding
   under the trigram model gives the restored span; spans of any length are decoded.
3. Features are whole words and word beginnings of 4 to 6 letters of the text and of its restored spans; a beginning that
   several words share is another feature than that of one word. Their toxic and clean documents are counted on a bounded
   sample of labelled rows (SAMPLE rows with the smallest hash of doc_id, training folds only); documents that share their
   smallest word hash (copies) count once. A feature is kept if it stands in at least LEAST toxic groups and its counts are
   beyond chance (EVIDENCE). Its share of toxic documents is shrunk towards that of the next shorter beginning (PRIOR).
4. A text's score is the largest share among its words, each by its most specific kept feature, and BASE at least.

Defined results: null and empty texts score BASE; texts of any length are scored whole; repeated rows give repeated results;
null labels teach nothing, of repeated labels the larger counts; without labels every score is BASE; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import PIECE, by_bytes, flat, fold

#: Labelled rows that the features are fitted on; toxic groups that a feature needs; score without any feature; threshold.
SAMPLE, LEAST, BASE, THRESHOLD = 20_000, 5, 0.01, 0.3
#: What a feature's counts must weigh against chance, in nats (documents times divergence from the sample's toxic share).
#: Documents that the share of a shorter word beginning (at last the sample's) counts for in a feature's share.
EVIDENCE, PRIOR = 12.0, 4.0
PREFIXES = (4, 5, 6)

# Letters that signs and digits stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
SEPARATORS = " .-_*"

#: Symbols of the character model: 0 word edge, 1 any other letter, a-z, then the lower-case letters of Latin-1.
SYMBOLS = 2 + 26 + 33
CHANNEL_LITERAL, CHANNEL_LEET, CHANNEL_SIGN, CHANNEL_REPEAT = 0.0, -1.0, -6.0, -0.7

SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*][^\W_]){3,}(?!\w)")
BETWEEN_WORDS = re.compile(r"[\s,;:?\"]+")
ODD_WORD = re.compile(r"[^\W\d_][0-9@$!|+(€*]+[^\W\d_]|([^\W\d_])\1\1|^[0-9@$!|(€]+[^\W\d_]{2}|[^\W\d_][0-9@$!|+(€*]+(?!\w)")
LAST_SIGNS = re.compile(r"(?<=[^\W\d_])[0-9@$!|+(€*]+(?!\w)")
WORD = re.compile(r"[^\W_]+")


def symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 95
    if 0xDF <= o <= 0xFF:
        return o - 0xDF + 28
    return 1


def symbols(data: np.ndarray) -> np.ndarray:
    """Symbols of UTF-8 bytes: 0 for what is no letter, with each run of it once."""
    low = data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    out = np.zeros(len(data), np.int64)
    ascii_letter = (low >= 97) & (low <= 122)
    out[ascii_letter] = low[ascii_letter].astype(np.int64) - 95
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) > 1 else np.zeros(0, np.int64)
    code = (data[lead + 1] & 0x3F).astype(np.int64) + 0xC0  # U+00C0 to U+00FF
    code = np.where((code < 0xDF) & (code != 0xD7), code + 32, code)
    out[lead] = np.where(code >= 0xDF, code - 0xDF + 28, 1)
    out[(data >= 0xC4) & (data != 0xC3)] = 1
    keep = (data & 0xC0) != 0x80
    out = out[keep]
    return out[(out > 0) | np.concatenate([[True], out[:-1] > 0])] if len(out) else out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """How often each trigram of symbols stands in the documents: gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in by_bytes(batches, "text", PIECE):
            data, offsets = flat(batch.column("text"))
            edges = np.insert(data, offsets[1:-1], 32) if batch.num_rows > 1 else data
            s = np.concatenate([[0], symbols(edges), [0]])
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """Decodes suspicious spans under the character model."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        tri = np.zeros(SYMBOLS**3)
        tri[gram] = n
        tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 1.0
        p1 = uni / uni.sum()
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None, :, :]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3)
        self.cached = lru_cache(50_000)(self._restore)

    def restore(self, span: str) -> str:
        return self.cached(span) if len(span) <= 200 else self._restore(span)

    def spaced(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """The lattice of single letters with separators: each separator is nothing or a word edge."""
        letters, i = span[::2], 0
        edge = [("", CHANNEL_LITERAL), (" ", CHANNEL_LITERAL)]
        while i < len(letters):
            c, j = letters[i], i + 1
            while j < len(letters) and letters[j] == c:
                j += 1
            if i:
                yield edge
            if not c.isalpha():
                for k in range(min(j - i, 2)):
                    if k:
                        yield edge
                    yield [*((x, CHANNEL_LEET) for x in LEET.get(c, "")), (c, CHANNEL_SIGN)]
            elif j - i == 1:
                yield [(c, CHANNEL_LITERAL)]
            else:
                two = CHANNEL_LITERAL if j - i == 2 else CHANNEL_REPEAT
                yield [(c, CHANNEL_REPEAT), *((x, two) for x in (c + c, f"{c} {c}")), *((x, two) for x in (f"{c}{c} {c}", f"{c} {c}{c}") if j - i > 2)]
            i = j

    def lattice(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """For each place the letters it may stand for, with channel log probabilities; a run of a letter is one place of one or two."""
        last = {k for m in LAST_SIGNS.finditer(span) for k in range(*m.span())}
        i = 0
        while i < len(span):
            c = span[i]
            j = i + 1
            while j < len(span) and span[j] == c:
                j += 1
            if c.isalpha():
                if j - i == 1:
                    yield [(c, CHANNEL_LITERAL)]
                else:
                    yield [(c, CHANNEL_REPEAT * (j - i > 1)), (c + c, CHANNEL_LITERAL if j - i == 2 else CHANNEL_REPEAT)]
            else:
                for _ in range(min(j - i, 2)):
                    options = [(x, CHANNEL_LEET) for x in LEET.get(c, "")]
                    # Numbers and punctuation at a word's end are nothing odd.
                    yield [*options, (c, CHANNEL_LITERAL if i in last else CHANNEL_SIGN)]
            i = j

    def _restore(self, span: str) -> str:
        """The likeliest reading of a span, in small letters; single letters with separators also as one word."""
        if SPACED.fullmatch(span):
            return f"{self.decoded(self.spaced(span))} {self.decoded(self.lattice(re.sub(r'[ .\-_*]', '', span)))}"
        return self.decoded(self.lattice(span))

    def decoded(self, places: Iterator[list[tuple[str, float]]]) -> str:
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in places:
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (s, done) in beam.items():
                for letters, cost in options:
                    x, y, score = a, b, s + cost
                    for c in letters:
                        z = symbol(c) if c.isalpha() else 0
                        if y or z:  # the model has each run of what is no letter once
                            score += self.log[x, y, z]
                            x, y = y, z
                    key = (x, y)
                    if key not in following or score > following[key][0]:
                        following[key] = (score, (done, letters) if letters else done)
            beam = following
        done = max((s + (self.log[a, b, 0] if b else 0.0), k) for k, ((a, b), (s, _)) in enumerate(beam.items()))[1]
        chain, out = list(beam.values())[done][1], []
        while chain:
            chain, letters = chain
            out.append(letters)
        return "".join(reversed(out))

    def restored(self, text: str) -> list[str]:
        """Restored words of a text in small letters."""
        spans = [m.group(0) for m in SPACED.finditer(text)] + [w for w in BETWEEN_WORDS.split(text) if ODD_WORD.search(w)]
        own = {span: set(WORD.findall(span)) for span in spans}
        return [w for span in spans for w in WORD.findall(self.restore(span)) if w not in own[span]]


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts may hold a span to decode (by bytes; the regular expressions decide)."""
    n = len(data)
    out = np.zeros(len(offsets) - 1, bool)
    if n < 5:
        return out
    low = data | 0x20
    letter = ((low >= 97) & (low <= 122)) | (data >= 0x80)
    sign = np.isin(data, np.frombuffer(b"0123456789@$!|+(*", np.uint8)) | (data == 0xE2)
    hit = np.zeros(n, bool)
    hit[:-1] |= sign[:-1] & letter[1:] | letter[:-1] & sign[1:]
    hit[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    gap = np.isin(data, np.frombuffer(SEPARATORS.encode(), np.uint8))
    hit[:-4] |= gap[:-4] & ~gap[1:-3] & gap[2:-2] & ~gap[3:-1] & gap[4:]
    at = np.flatnonzero(hit)
    out[np.minimum(np.searchsorted(offsets, at, side="right") - 1, len(out) - 1)] = True
    return out


def features(words: set[str]) -> set[str]:
    """Whole words; word beginnings with a trailing sign, two signs if several words of the text begin so."""
    begun = Counter(w[:k] for k in PREFIXES for w in words if len(w) >= k)
    return {w for w in words if len(w) >= 3} | {f"{p}--" if n > 1 else f"{p}-" for p, n in begun.items()}


def texts(batch: pa.RecordBatch, channel: Channel) -> Iterator[tuple[str, list[str]]]:
    """Each text in small letters, with its restored words."""
    data, offsets = flat(batch.column("text"))
    odd = suspicious(data, offsets)
    for text, look in zip(batch.column("text").to_pylist(), odd.tolist(), strict=True):
        low = (text or "").lower()
        yield low, channel.restored(low) if look else []


def group_of(words: set[str]) -> int:
    """The smallest word hash: the same for exact and for most near copies."""
    import xxhash

    return min((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in words), default=0)


def fit(docs: DataFrame, labels: DataFrame, channel, sample: int = SAMPLE) -> dict[str, float]:
    """Share of toxic documents by kept feature. channel: a broadcast (gram, n) pair."""
    taught = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taught), "doc_id").select("toxic", "text")

    def found(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decode = Channel(*channel.value)
            for batch in by_bytes(batches, "text", PIECE):
                out: tuple[list, list, list] = ([], [], [])
                for (text, restored), toxic in zip(texts(batch, decode), batch.column("toxic").to_pylist(), strict=True):
                    words = set(WORD.findall(text))
                    group = group_of(words)
                    words |= set(restored)
                    if wanted is None and toxic != 1:
                        continue
                    got = features(words)
                    if wanted is not None:
                        got &= wanted
                    out[0].extend(got), out[1].extend([group] * len(got)), out[2].extend([int(toxic == 1)] * len(got))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["feature", "grp", "toxic"])

        return run

    toxic = rows.filter("toxic = 1").mapInArrow(found(None), "feature string, grp long, toxic int").groupBy("feature").agg(F.countDistinct("grp").alias("n")).filter(F.col("n") >= LEAST)
    counted = {r["feature"]: r["n"] for r in toxic.toLocalIterator()}
    if not counted:
        return {}
    clean = rows.filter("toxic = 0").mapInArrow(found(frozenset(counted)), "feature string, grp long, toxic int").groupBy("feature").agg(F.countDistinct("grp").alias("n"))
    against = {r["feature"]: r["n"] for r in clean.toLocalIterator()}
    tally = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    rate = min(max(tally.get(1, 0) / max(sum(tally.values()), 1), 1e-6), 1 - 1e-6)
    out: dict[str, float] = {}
    for f in sorted(counted, key=lambda f: (len(f.rstrip("-")), f.count("-") == 0)):
        n, m = counted[f], against.get(f, 0)
        stem, many = f.rstrip("-"), "--" if f.endswith("--") else "-"
        shorter = (stem[:k] + many for k in sorted(PREFIXES, reverse=True) if k < len(stem) or k == len(stem) and "-" not in f)
        prior = next((out[g] for g in shorter if g in out), rate)
        share = (n + PRIOR * prior) / (n + m + PRIOR)
        raw = n / (n + m)
        weight = n * math.log(raw / rate) + (m * math.log((1 - raw) / (1 - rate)) if m else 0.0)
        if raw > rate and weight >= EVIDENCE:
            out[f] = share
    return {f: p for f, p in out.items() if p >= THRESHOLD}


class Scorer:
    """The largest share among a text's words, each word by its most specific kept feature."""

    def __init__(self, share: dict[str, float]) -> None:
        import ahocorasick

        self.share = share
        self.find = ahocorasick.Automaton()
        for f in share:
            self.find.add_word(f.rstrip("-"), f.rstrip("-"))
        if share:
            self.find.make_automaton()

    def score(self, text: str, restored: list[str]) -> float:
        if not self.share:
            return BASE
        if restored:
            text = f"{text} {' '.join(restored)}"
        starts = {e - len(key) + 1 for e, key in self.find.iter(text)}
        words = {WORD.match(text, i).group(0) for i in starts if not i or not text[i - 1].isalnum()}
        begun = Counter(w[:k] for k in PREFIXES for w in words if len(w) >= k)
        best = BASE
        for w in words:
            p = self.share.get(w)
            for k in sorted(PREFIXES, reverse=True):
                if p is None and len(w) >= k:
                    p = self.share.get(f"{w[:k]}--" if begun[w[:k]] > 1 else f"{w[:k]}-")
            best = max(best, p or 0.0)
        return min(best, 1.0)


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Broadcasts of the character model (at most SYMBOLS ** 3 counts) and of the kept features (bounded by the sample)."""
    spark = docs.sparkSession
    counts = trigram_counts(docs).toArrow()
    channel = spark.sparkContext.broadcast((counts["gram"].to_numpy(), counts["n"].to_numpy()))
    return channel, spark.sparkContext.broadcast(fit(docs, labels, channel, sample))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "__score") -> DataFrame:
    """docs with one more column of that name, which docs must not have."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")
    channel, share = model(docs, labels, sample)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, scorer = Channel(*channel.value), Scorer(share.value)
        for batch in by_bytes(batches, "text", PIECE):
            score = [scorer.score(text, restored) for text, restored in texts(batch, decode)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), labels, sample)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
