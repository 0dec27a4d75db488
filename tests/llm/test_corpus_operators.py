"""The corpus operators against plain versions: on the small tables, on planted cases, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import oracle
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import queries as Q
from tallyloom.llm.op1_decontaminate import leaks
from tallyloom.llm.op2_topk import top_k
from tallyloom.llm.op3_bpe import encode_documents
from tallyloom.llm.op4_warc import captures
from tallyloom.llm.op5_language import language_id
from tallyloom.llm.op6_suffix_dedup import remove_repeats
from tallyloom.llm.op7_pii import KINDS, pii
from tallyloom.llm.op8_toxicity import toxicity
from tallyloom.llm.op9_token_counts import read_pieces, token_counts
from tallyloom.llm.op10_near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession) -> list[tuple[int, str]]:
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def prose(rng: random.Random, n: int, most: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(most)}" for _ in range(n))


def awkward(spark: SparkSession, extra: bool = True) -> DataFrame:
    """Nulls, blanks, a very long text, repeated rows, ties and columns whose names clash with the operators' own."""
    rng = random.Random(1)
    long = prose(rng, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", "b", len(long)), (5, "one two", "en", "b", 7), (6, "one two", None, "b", 7), (7, "é😀 ß x" * 9, "de", None, None), (8, "a" * 200_000, "en", "c", 200_000), (9, "same row here with six words", "en", "c", 1), (9, "same row here with six words", "en", "c", 1)]
    df = spark.createDataFrame(rows, DOCS)
    names = ("score", "row", "base", "spans", "kept", "n", "key", "words", "component_id", "pattern", "toxic", "a", "b")
    return df.withColumns({c: F.lit("clash") for c in names}) if extra else df


# --- 1


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


def local_score(a: list[str], b: list[str]) -> int:
    row, best = [0] * (len(a) + 1), 0
    for w in b:
        new = [0]
        for j, v in enumerate(a):
            new.append(max(0, row[j] + (2 if v == w else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_leaks_have_the_plain_alignment_score(spark: SparkSession) -> None:
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {d: words_of(t) for d, t in documents(spark)}
    got = {(r.doc_id, r.item_id): r.similarity for r in Q.op1_decontamination(spark, SF).collect()}
    assert got
    for (d, i), s in got.items():
        assert s == pytest.approx(local_score(items[i], docs[d]) / (2 * len(items[i])))
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of_item = {i: grams(w) for i, w in items.items()}
    for d, w in docs.items():
        own = grams(w)
        for i, g in of_item.items():
            if (d, i) not in got and len(own & g) >= 3:
                assert local_score(items[i], w) / (2 * len(items[i])) < 0.6, (d, i)


def test_leaks_find_edited_passages_and_leave_others(spark: SparkSession) -> None:
    rng = random.Random(5)
    item = prose(rng, 40)
    edited = item.split()
    for k in (7, 19, 31):
        edited[k] = "changed"
    docs = [(1, f"{prose(rng, 300)} {item} {prose(rng, 300)}"), (2, f"{prose(rng, 50)} {' '.join(edited)}"), (3, prose(rng, 500)), (4, None), (5, "")]
    bench = [(10, item), (11, None), (12, "too short"), (13, ""), (None, item)]
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 10), (2, 10)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leaks(empty, spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    assert leaks(awkward(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("exact", [0, 9])
def test_leaks_are_those_of_aligning_all_pairs_that_share_a_seed(spark: SparkSession, exact: int) -> None:
    rng = random.Random(7)
    items = {i: prose(rng, n).split() for i, n in enumerate((30, 30, 41, 64), 10)}
    common = " ".join(items[10][6:11])  # one seed of an item is common everywhere
    items[14] = [*prose(rng, 20).split(), *common.split()]
    docs = {}
    for item in items.values():
        for every in (6, 7):
            for first in range(every):
                w = [f"x{len(docs)}" if k % every == first else v for k, v in enumerate(item)]
                docs[len(docs)] = f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}"
        # Words put in between: two copied, one not, and five in a row at the end.
        w = [y for k, v in enumerate(item) for y in ([v, f"y{k}"] if k % 2 and k < len(item) - 6 else [v])]
        docs[len(docs)] = f"{prose(rng, 100)} {' '.join(w)}"
        for _ in range(exact):
            docs[len(docs)] = f"{prose(rng, 10)} {' '.join(item)}"
    for _ in range(20):
        docs[len(docs)] = f"{prose(rng, 40)} {common} {prose(rng, 40)}"
    # The seed far from the copy, whose runs are of four words.
    docs[len(docs)] = f"{' '.join(items[12][:5])} {prose(rng, 6000)} {' '.join('z' if k % 5 == 4 else v for k, v in enumerate(items[12]))}"
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {}
    for d, text in docs.items():
        for i, w in items.items():
            if grams(w) & grams(text.split()):
                score = local_score(w, text.split()) / (2 * len(w))
                if score >= 0.6:
                    want[d, i] = score
    bench = [(i, " ".join(w)) for i, w in items.items()]
    rows = leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(want) > 60
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == pytest.approx(want)


def test_leaks_of_short_and_repeated_items_and_awkward_rows(spark: SparkSession) -> None:
    rng = random.Random(15)
    item = prose(rng, 30)
    bench = [(1, "one two"), (2, "seven"), (3, "four words stand here"), (4, ""), (5, item), (5, item + " and more words that follow"), (5, item)]
    long = f"{prose(rng, 30_000, 10**6)} {item} {prose(rng, 30_000, 10**6)} four words stand here"
    extra = spark.createDataFrame([(40, long), (41, "Seven"), (42, "four words stand"), (43, "one three two"), (44, "")], "doc_id long, text string")
    docs = awkward(spark).unionByName(extra, allowMissingColumns=True).withColumns({c: F.lit("clash") for c in ("item", "passage", "item_id", "similarity")})
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    want = {}
    for d, t in texts.items():
        if len(t) < 1000:
            for i, b in bench:
                score = local_score(words_of(b), words_of(t)) / max(1, 2 * len(words_of(b)))
                if words_of(b) and score >= 0.6:
                    want[d, i] = max(score, want.get((d, i), 0))
    want |= {(40, 3): 1.0, (40, 5): 1.0}
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {k for k in got if k[1] == 5} == {(40, 5)} and got == pytest.approx({k: v for k, v in want.items() if k in got})
    # Part of a short item may be enough for the score, but holds no seed: that is the whole item.
    assert set(want) - set(got) <= {(42, 3), (43, 1)}


def test_leaks_recall_against_aligning_all_pairs(spark: SparkSession) -> None:
    """Copies with one word in nine changed, dropped or added at random: nearly all of those that full alignment calls leaks are found."""
    rng = random.Random(16)
    items = {i: prose(rng, rng.randrange(20, 60), 10**5).split() for i in range(20)}
    docs = {}
    for item in items.values():
        for _ in range(5):
            out = []
            for w in item:
                u = rng.random()
                out += [w] if u > 0.11 else [f"x{len(docs)}"] if u > 0.07 else [] if u > 0.035 else [w, f"y{len(docs)}"]
            docs[len(docs)] = f"{prose(rng, 20)} {' '.join(out)} {prose(rng, 20)}"
    want = {(d, i) for d, t in docs.items() for i, w in items.items() if local_score(w, t.split()) >= 0.6 * 2 * len(w)}
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 60


# --- 2


def test_top_k_has_the_rows_of_its_sql(spark: SparkSession) -> None:
    assert not oracle.differences(Q.op2_mtree_topk(spark, SF), oracle.connect(SF), Q.ORACLE_SQL["op2_mtree_topk"])


def test_top_k_with_ties_repeats_and_unusable_vectors(spark: SparkSession) -> None:
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(4)]) for i in range(400)] + [(500 + i, [0.5] * 4) for i in range(300)]
    bad = [(1001, None), (1002, [None, 1.0, 1.0, 1.0]), (1003, [float("nan")] * 4), (1004, [float("inf")] * 4), (1100, None)]
    got = defaultdict(list)
    for r in top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = {q: [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:10]] for q in ints if q % 100 == 0}
    assert dict(got) == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def plain_top(rows: list, every: int = 100, k: int = 10) -> dict:
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    asked: dict[int, list] = {}
    for i, v in ints:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    out = {}
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -s) for s, i in best]
    return {q: best for q, best in out.items() if best}


def ranked(df: DataFrame) -> dict:
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


def test_top_k_with_lengths_large_components_and_several_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    from tallyloom.llm import op2_topk

    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3 + i % 2)]) for i in range(300)]
    rows += [(i, [rng.uniform(-1, 1) * 2.0**20 for _ in range(5)]) for i in range(300, 360)]  # sums beyond doubles' whole numbers
    rows += [(400, [2.0**41] + [0.0] * 5), (401, [1.0] + [0.0] * 5), (402, [2.0] + [0.0] * 5), (500, [0.25] * 3), (500, [0.125] * 3), (501, []), (600, [7.0] * 9)]
    monkeypatch.setattr(op2_topk, "BLOCK_BYTES", 2048)
    monkeypatch.setattr(op2_topk, "PACK_BYTES", 64)
    got = ranked(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == plain_top([r for r in rows if r[1]])
    huge = [(0, [2.0**60, 1.0]), (1, [2.0**60, 0.0])]
    with pytest.raises(Exception, match="no 64-bit integer"):
        top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()


def test_the_tree_leaves_out_most_of_clustered_vectors() -> None:
    import numpy as np

    from tallyloom.llm.op2_topk import MTree

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(100, 16)) * 4
    v = centre[rng.integers(0, 100, 10_000)] + 0.1 * rng.normal(size=(10_000, 16))
    v = np.floor(4096 * v / np.linalg.norm(v, axis=1, keepdims=True))
    tree = MTree(np.arange(len(v)), v)
    for q in range(0, len(v), 500):
        s = v @ v[q]
        s[q] = -np.inf
        want = sorted(zip((-s).tolist(), range(len(v)), strict=True))[:10]
        assert tree.search(q, v[q], 10) == [(int(-a), i) for a, i in want]
    assert tree.computed < 0.1 * 20 * len(v)


# --- 3


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_encoding_equals_the_tokenizers_library(spark: SparkSession, table: str) -> None:
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation(), plain.no_padding()
    special = "one <|endoftext|> two" + " word" * 3000 + "<|endoftext|>"
    df = spark.read.parquet(f"{SF}/documents.parquet") if table == "small" else awkward(spark).unionByName(spark.createDataFrame([(20, special, "en", "x", 1)], DOCS), allowMissingColumns=True)
    rows = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    for r in encode_documents(df).collect():
        ids = plain.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))), r.doc_id
    assert encode_documents(df.limit(0)).count() == 0


def test_shared_passages_are_encoded_once(spark: SparkSession) -> None:
    import pyarrow as pa

    from tallyloom.llm.op3_bpe import Codec, encode_batch, read_ranks

    rng = random.Random(17)
    passage = prose(rng, 4000)
    texts = [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(50)]
    codec = Codec(*read_ranks(None))
    assert len(list(encode_batch(codec, pa.array(texts)))) == 50
    assert codec.encoded_bytes < 0.15 * sum(map(len, texts))


# --- 4


def test_captures(spark: SparkSession) -> None:
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "http://a/4", ""), (5, "http://a\n/5", "é\r\n\r\nWARC/1.0\r\n" * 3), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in captures(pages.withColumn("record_type", F.lit("clash"))).collect()}
    first: dict[bytes, int] = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        payload = (html or "").encode()
        first.setdefault(payload, i)
        r = got.pop(i)
        want = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first[payload] == i else "revisit", None if first[payload] == i else first[payload])
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    assert not got
    assert captures(pages.limit(0)).count() == 0


def test_captures_of_the_small_pages(spark: SparkSession) -> None:
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    got = {r.page_id: (r.payload_digest, r.refers_to) for r in Q.op4_warc_transactions(spark, SF).collect()}
    want = {p.page_id: (base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode(), None if first[p.html or ""] == p.page_id else first[p.html or ""]) for p in pages}
    assert got == want


def test_archives_are_valid_and_bounded(spark: SparkSession, tmp_path: Path) -> None:
    import gzip
    import io

    from tallyloom.llm.op4_warc import assemble, parse, read_records, write_archives

    rng = random.Random(13)
    rows = [(i, f"http://a/{i}", "same page" if i % 3 == 0 else "".join(rng.choices("abcdefgh", k=4000))) for i in range(1, 200)]
    rows += [rows[0], rows[4], (None, "http://n/1", "same page"), (None, "http://n/2", None), (300, "http://big", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    write_archives(pages.repartition(2), path, archive=20_000)
    files = sorted(tmp_path.glob("archives/part-*"))
    assert len(files) > 10 and all(f.stat().st_size < 32_000 for f in files)
    ids, refers, members = set(), [], 0
    for f in files:
        data = f.read_bytes()
        records = list(parse(gzip.GzipFile(fileobj=io.BytesIO(data))))
        members += data.count(b"\x1f\x8b\x08\x00")
        assert len(records) % 3 == 0
        for h, _ in records:
            ids.add(h["warc-record-id"])
            if h["warc-type"] == "revisit":
                refers.append(h["warc-refers-to"])
    assert members >= 3 * 200 and refers and set(refers) <= ids
    nested = assemble(read_records(spark, path, payload=True)).collect()
    assert len(nested) == len({(i, h) for i, _, h in rows if i is not None}) + 2
    assert all(r.request.uri == r.capture.uri == r.metadata.uri for r in nested)
    got = captures(pages).collect()
    assert Counter(r.record_type for r in got if r.page_id is None) == {"response": 2}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {3}


# --- 5


def test_language_of_held_out_documents(spark: SparkSession) -> None:
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.op5_language_mixture(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_of_awkward_rows(spark: SparkSession) -> None:
    got = {r.doc_id: r for r in language_id(awkward(spark)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred != "und"
    assert language_id(awkward(spark).limit(0)).count() == 0


# --- 6


def repeats(rows: list[tuple[int, str]], size: int = 100) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            s = data[i : i + size]
            if s in seen:
                gone[i : i + size] = b"\x01" * size
            seen.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_of_the_small_documents(spark: SparkSession) -> None:
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op6_suffix_array_dedup(spark, SF).collect()}
    assert got == repeats(documents(spark))


@pytest.mark.parametrize("hot", [None, 50])
def test_repeats_of_planted_rows(spark: SparkSession, hot: int | None) -> None:
    rng = random.Random(4)
    passage, period = prose(rng, 60), "ab" * 400
    rows = [(i, f"{prose(rng, 30)} {passage if i % 3 else period} {prose(rng, 20)}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 500), (105, passage[:99]), (106, passage[:100]), (107, "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    found = remove_repeats(df) if hot is None else remove_repeats(df, hot=hot)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()} == repeats(rows)
    assert remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [None, 3])
def test_repeats_of_long_and_repeated_rows(spark: SparkSession, hot: int | None) -> None:
    rng = random.Random(14)
    passage = prose(rng, 80)
    long = prose(rng, 110_000)  # over two slices of 256 KB; the passage lies over a slice's edge
    rows = [(7, f"{long[: (1 << 18) - 200]}{passage}{long[(1 << 18) - 200 :]}"), (3, f"{prose(rng, 40)} {passage} {prose(rng, 9)}"), (9, long[100_000:100_300]), (-5, f"z {passage}")]
    rows += [(20 + i, f"{'pad ' * i}{passage} {prose(rng, 5)}") for i in range(40)] + [(100 + i, "same " * 60) for i in range(20)]
    df = spark.createDataFrame([*rows, rows[1], rows[1], (None, passage)], "doc_id long, text string").withColumn("blob", F.lit("clash"))
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in (remove_repeats(df) if hot is None else remove_repeats(df, hot=hot)).collect()]
    assert len(got) == len(rows) + 2
    assert dict(got) == repeats(rows)


def test_repeats_of_awkward_rows(spark: SparkSession) -> None:
    got = {r.doc_id: r for r in remove_repeats(awkward(spark)).collect()}
    want = repeats([(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").filter("doc_id <> 4").collect() if r.doc_id != 9])
    for i, w in want.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w, i
    assert got[9].n_removed == 0


# --- 7


def base_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(d: str) -> bool:
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(tests[k][0], text) if tests[k][1](m.group(0))]


ODD_PII = ["a@b", "a@b.c.d@e.f", "x a.b+c@d-e.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.02.03.004 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111111111112222", "+1 (555) 123-4567 +1", "+12345678901234567", "+1 2 3", "😀 a@b.cd +44 20 7946 0958", "@@a@b.c", "0000000000000000", "9.9.9.9" * 3, "1" * 50_000, "a" * 50_000 + "@", ("b." * 9000) + "@x"]


def test_personal_data_base(spark: SparkSession) -> None:
    rows = documents(spark) + [(10_000 + i, t) for i, t in enumerate(ODD_PII)] + [(20_000, None)]
    rng = random.Random(8)
    rows += [(30_000 + i, "".join(rng.choice("0123456789.@+- ()ab\n") for _ in range(200))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "base": F.lit(2)})
    text = dict(rows)
    for r in pii(df).collect():
        want = base_spans(text[r.doc_id] or "")
        n = Counter(k for k, _, _ in want)
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in KINDS), r.doc_id
        assert r.base_sha256 == sha(",".join(listed)), r.doc_id
        assert set(listed) <= set(r.spans.split(",")) | {""}
    assert pii(df.limit(0)).count() == 0


def test_personal_data_found_by_context(spark: SparkSession) -> None:
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 5)} my phone line2: +44 20 7946 0{i:03d} thanks all") for i in range(100, 160)]
    rows += [(i, f"{prose(rng, 5)} write to me at u{i}@mail{i % 7}.example.org or call") for i in range(200, 260)]
    planted = {900 + i: ("my phone line3:", f"0207-9460-{111 + i}", "thanks all") for i in range(10)}
    planted |= {920 + i: ("write to me at", f"jo.doe_{'abcdefghij'[i]}x#corp", "or call") for i in range(10)}
    planted |= {940 + i: ("write to me at", f"rosebud{'abcdefghij'[i]}", "or call") for i in range(10)}  # plain words that stand nowhere else
    rows += [(i, f"please {a} {w} {b}") for i, (a, w, b) in planted.items()]
    rows += [(980 + i, f"please write to me at once or call, once more, once again, at once {i}") for i in range(8)]  # a plain word that stands elsewhere too
    rows += [(990, "count 0207-9460-111x rows"), (991, "(0207-9460-112) stands in a text of its own")]
    got = {r.doc_id: r.spans for r in pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    at = {i: text[i].index(w) for i, (_, w, _) in planted.items()}
    found = sum(got[i] == f"{'phone' if i < 920 else 'email'}:{at[i]}:{at[i] + len(w)}" for i, (_, w, _) in planted.items())
    assert found >= 0.9 * len(planted), {i: (text[i], got[i]) for i in planted}
    assert all(got[980 + i] == "" for i in range(8)) and got[990] == ""
    assert got[991] == "phone:1:14"
    for i, t in rows:
        if i < 300:
            assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t))


def test_personal_data_of_awkward_rows(spark: SparkSession) -> None:
    rng = random.Random(10)
    long = " ".join(f"x{rng.randrange(10**6)}@y.zz 10.0.0.{rng.randrange(300)}" for _ in range(3000))
    df = awkward(spark).unionByName(spark.createDataFrame([(30, long, "en", "a", 1), (31, "call +44 20 7946 0958 call +44 20 7946 0959", "en", "a", 1)], DOCS), allowMissingColumns=True)
    for r in pii(df).collect():
        if r.doc_id in (30, 31):
            want = base_spans(long if r.doc_id == 30 else "call +44 20 7946 0958 call +44 20 7946 0959")
            assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
            assert (r.n_email, r.n_phone) == (sum(k == "email" for k, _, _ in want), sum(k == "phone" for k, _, _ in want))


# --- 8


def test_toxicity_of_held_out_documents(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op8_toxicity_deobfuscation(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    recall, precision = hit / sum(toxic[r.doc_id] for r in held), hit / max(1, sum(r.predicted for r in held))
    assert recall >= 0.8 and precision >= 0.6, (recall, precision)


def test_toxicity_of_awkward_rows(spark: SparkSession) -> None:
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(awkward(spark), labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(awkward(spark).limit(0), labels).count() == 0
    assert toxicity(awkward(spark), labels.limit(0)).filter("predicted = 1").count() == 0


def test_toxicity_of_spaced_and_long_spans_and_signs_at_the_end(spark: SparkSession) -> None:
    rng = random.Random(12)
    calm = [a + b + c for a in ("ba", "fe", "gu", "lo", "mi", "ne", "ro", "wi") for b in ("rin", "tal", "vos", "kem", "lub") for c in ("de", "ga", "mu", "zo", "ny", "pax", "qui")]
    say = lambda n: " ".join(rng.choice([*calm, "a"]) for _ in range(n))
    rows = [(i, f"{say(20)} you are such a {'stupid' if i % 4 == 0 else rng.choice(calm)} {say(20)}") for i in range(800)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    spaced = " ".join("".join(f"{say(30)} such a stupid {say(30)}".split()))
    planted = ["such a s t u p i d", "y o u a r e s u c h a s t u p i d", spaced, spaced.replace(" ", "-"), "stu" + "p" * 300 + "id", ".".join(["b4rinde"] * 60) + ".5tup1d", "s t u p p i d", "$tupid", "s+upid"]
    clean = ["y o u a r e", "such a l o t a l g a", "mivosmu! nerinde2 you are$", " ".join("".join(say(60).split())), "m" * 300]
    rows += list(enumerate(planted, 1000)) + list(enumerate(clean, 2000))
    got = {r.doc_id: r.predicted for r in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert {i: got[i] for i in got if i >= 1000} == {**{1000 + i: 1 for i in range(len(planted))}, **{2000 + i: 0 for i in range(len(clean))}}


def test_signs_at_the_end_of_a_word_are_letters_if_the_model_says_so() -> None:
    import numpy as np

    from tallyloom.llm.op8_toxicity import SYMBOLS, Channel, suspicious, symbols

    text = np.frombuffer(b" ".join([b"idiot ass calm"] * 200), np.uint8)
    x = np.concatenate([[0], symbols(text), [0]])
    gram, n = np.unique((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], return_counts=True)
    channel = Channel(gram, n)
    assert channel.restored("an idio+ an as$ and calm! calm2") == ["idiot", "ass"]
    data = np.frombuffer(b"an idio+ ", np.uint8)
    assert suspicious(data, np.array([0, len(data)])).all()


# --- 9


def plain_tokens(word: str, score: dict[str, float], worst: float, longest: int) -> int:
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + score[word[i:j]], best[i][1] + 1) for i in range(max(0, j - longest), j) if word[i:j] in score]
        if word[j - 1] not in score:
            n = len(word[j - 1].encode())
            options.append((best[j - 1][0] + n * worst, best[j - 1][1] + n))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts_against_plain_viterbi(spark: SparkSession) -> None:
    from tallyloom.llm.op9_token_counts import Vocabulary

    pieces = read_pieces()
    vocabulary = Vocabulary(pieces)
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    score: dict[str, float] = {}
    for r, p in enumerate(pieces):
        if p:
            score.setdefault(p, -math.log((r + 1) * total))
    rows = documents(spark)[:12] + [(900, "a" * 500 + " Ωmega 😀"), (901, ""), (902, None)]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))).collect()}
    cache: dict[str, int] = {}
    for d, t in rows:
        words = (t or "").split()
        n = 0
        for w in words:
            if w not in cache:
                cache[w] = plain_tokens("▁" + w, score, vocabulary.byte, 24)
            n += cache[w]
        assert got[d][0] == len(words)
        assert got[d][1] == n, (d, got[d], n)
    assert token_counts(awkward(spark).limit(0)).count() == 0


# --- 10


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def plain_components(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in rows}
    lists = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    up = {d: d for d in sets}

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    for d, s in sets.items():
        for e in {e for x in s for e in lists[x] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= 85 * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates_of_the_small_documents(spark: SparkSession) -> None:
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op10_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got == plain_components(rows)


def test_near_duplicates_in_large_groups_and_chains(spark: SparkSession) -> None:
    rng = random.Random(6)
    base = prose(rng, 200).split()
    rows = []
    for i in range(400):  # one group of near copies, all different
        w = list(base)
        w[i % 200] = f"changed{i}"
        rows.append((i, " ".join(w)))
    chain = prose(rng, 120).split()
    for i in range(30):  # each near the one before, far from the first
        chain = [*chain[2:], f"new{i}", f"newer{i}"]
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, "exact Copy of this very text here") for i in range(300)] + [(3000, None), (3001, " "), (3002, "few words"), (3003, "Few  words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "kept": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == plain_components(rows)
    assert near_duplicates(df.limit(0)).count() == 0
    assert {r.doc_id for r in near_duplicates(awkward(spark)).collect()} == set(range(1, 10))


def test_near_duplicates_of_many_texts_and_a_shorter_one(spark: SparkSession) -> None:
    rng = random.Random(11)
    rows = []
    for n in (11, 14, 17, 21):  # 7 to 17 shingles; each of the others has one or two more of its own
        base = prose(rng, n)
        k = len(rows)
        rows += [(k, base)] + [(k + i, f"{base} own{k + i}") for i in range(1, 61)] + [(k + i, f"{base} two{k + i} more{k + i}") for i in range(61, 121)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    want = plain_components(rows)
    assert want[121 + 60] == (11, 121)
    assert got == want


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_of_random_short_texts(spark: SparkSession, exact: bool) -> None:
    rng = random.Random(21)
    rows: list[tuple[int, str]] = []
    for n in range(5, 21):
        for copies in (2, 49, 50, 90):
            base = prose(rng, n).split()
            for _ in range(copies):
                w = list(base)
                if rng.random() < 0.7:
                    w = [*w, f"own{len(rows)}"] if rng.random() < 0.5 else [f"own{len(rows)}", *w]
                if rng.random() < 0.2:
                    w[rng.randrange(len(w))] = f"x{len(rows)}"
                rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, exact=exact).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_in_a_cluster_of_several_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    from tallyloom.llm import op10_near_dedup

    rng = random.Random(22)
    rows = []
    for g in range(3):  # three groups over one shared passage: one cluster of several blocks and components
        shared = prose(random.Random(1), 60).split()
        own = prose(rng, 60 + 40 * g).split()
        for i in range(120):
            w = [*shared, *own]
            w[rng.randrange(len(w))] = f"changed{g}x{i}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(op10_near_dedup, "BLOCK", 3000)
    df = spark.createDataFrame([*rows, (None, "a text without an id")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got.pop(None) == (1, None)
    assert got == plain_components(rows)


def test_near_duplicates_at_another_similarity(spark: SparkSession) -> None:
    rng = random.Random(23)
    base = prose(rng, 124).split()
    rows = [(0, " ".join(base))]
    for i, tail in enumerate((9, 14, 20), 1):  # similarities of 0.86, 0.79 and 0.71
        rows.append((i, " ".join([*base[:-tail], *(f"t{i}x{k}" for k in range(tail))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, linked in ((85, 1), (75, 2), (70, 3)):
        got = {r.doc_id: r.component_id for r in near_duplicates(df, least=least).collect()}
        assert sum(v == 0 for v in got.values()) == 1 + linked, least
