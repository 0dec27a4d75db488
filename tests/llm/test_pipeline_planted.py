"""The whole pipeline over planted rows: what each stage must drop, change and keep is known by construction."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline as P
import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_keeps_exactly_the_clean_rows(spark: SparkSession, tmp_path: Path) -> None:
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(23)
    prose = lambda n: " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n))
    items = [(k, prose(40)) for k in range(6)]
    clean = {i: prose(70) for i in range(200)}
    toxic = {200 + i: f"{prose(30)} zorgle {prose(30)}" for i in range(80)}
    copies = {300 + i: clean[i] for i in range(10)}
    near = {310 + i: " ".join(w if k != 35 else "changed" for k, w in enumerate(clean[10 + i].split())) for i in range(5)}
    leaks = {320 + i: f"{prose(30)} {items[i][1]} {prose(30)}" for i in range(5)}
    private = {330 + i: f"{prose(20)} write to user{i}@firm{i}.example.org or 10.0.0.{i} {prose(20)}" for i in range(5)}
    short = {340: "", 341: None, 342: "one two"}
    every = clean | toxic | copies | near | leaks | private | short
    rows = [(i, t, "en", "s", len(t or "")) for i, t in every.items()] + [(None, "without a number " + prose(20), None, None, None)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in toxic)) for i in clean | toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    changed = {i: f"{t.split(' write to ')[0]} write to <email> or <ip> {t.split(f'10.0.0.{i - 330} ')[1]}" for i, t in private.items()}
    left = clean | changed | short | {None: next(t for i, t, *_ in rows if i is None)}
    from public_tokenizers import path

    coder = tokenizers.Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    coder.no_truncation()
    coder.no_padding()
    want = Counter()
    for i, t in left.items():
        ids = coder.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want


def test_repeated_ids_and_overlapping_spans(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "x y z u v w q", "en", "s", 13), (3, "x y z u v w q", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13)], DOCS)
    kept = P.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "a"), (1, "a"), (1, "a"), (3, "x"), (3, "x")]  # rows of one id stay or go together
    # An address inside a phone number: of overlapping spans the first stays whole.
    text = "call +44 10.20.30.40 now"
    (row,) = P.redact(spark, spark.createDataFrame([(5, text, "en", "s", len(text))], DOCS), "").collect()
    assert (row.text, row.n_chars) == ("call <phone> now", 16)
