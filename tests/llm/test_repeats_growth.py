"""op6 where copies are many: minimizers of several shards, whole tables that repeat, and its suffix array by itself."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from test_corpus_operators import SF, documents, prose, repeats

from tallyloom.llm.op6_suffix_dedup import WIDTH, beside_copies, remove_repeats, suffix_array, windows


def results(df: DataFrame, **kw: int) -> dict[int, tuple]:
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **kw).collect()}


def test_repeats_of_minimizers_in_several_shards_and_arrays(spark: SparkSession) -> None:
    """Shards of one minimizer met in one task, but in two of its suffix arrays: the second one's windows stayed."""
    rng = random.Random(21)
    passages = [prose(rng, 22) for _ in range(500)]
    rows = [(i, " ".join(f"{prose(rng, 12)} {p}" for p in passages)) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert results(df, hot=2) == repeats(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot", [1, 4])
def test_repeats_with_variants_around_one_passage(spark: SparkSession, hot: int) -> None:
    """Cores with more records than a suffix array takes: what follows the passage varies in a few bytes only."""
    rng = random.Random(22)
    passage = prose(rng, 40)
    rows = [(i * 7 % 300, f"{prose(rng, 3)}{rng.choice('xyz')}{passage}{rng.choice('abc')}{rng.choice('de')}{prose(rng, 3)}") for i in range(300)]
    assert results(spark.createDataFrame(rows, "doc_id long, text string").repartition(60), hot=hot) == repeats(rows)


def test_copies_of_a_table_leave_few_records(spark: SparkSession) -> None:
    """Copies meet in a batch wherever they stand, so that a table that repeats k times asks for little more than one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    copies = docs.crossJoin(spark.range(6).select(F.col("id").alias("nth"))).select((F.col("doc_id") + 1000 * F.col("nth")).alias("doc_id"), "text")
    one, six = (windows(beside_copies(x, 8), 8).filter("kind = 'records'").agg(F.sum(F.octet_length("blob"))).first()[0] for x in (docs, copies.repartition(8)))
    assert six < 1.5 * one
    rows = [(d + 1000 * n, t) for d, t in documents(spark) if t for n in range(6)]
    assert results(copies) == repeats(rows)


@pytest.mark.parametrize("size", [5_000, (1 << 21) + 500])
def test_suffixes_stand_in_the_order_of_their_bytes(size: int) -> None:
    rng = np.random.default_rng(23)
    data = rng.integers(97, 101, size, dtype=np.uint8)
    data[size // 2 : size // 2 + 2000] = data[:2000]
    data[-400:] = 97
    end = np.array([50, 149, 1000, size // 2 + 777, size])
    left = np.repeat(end, np.diff(end, prepend=0)) - np.arange(size)
    sa, follows = suffix_array(data, left)
    assert np.array_equal(np.sort(sa), np.flatnonzero(left >= WIDTH))
    for a in range(0, len(sa), 1 << 18):
        text = data[sa[a : a + (1 << 18) + 1][:, None] + np.arange(WIDTH)].view(f"S{WIDTH}").ravel()
        assert (text[1:] >= text[:-1]).all()
        assert np.array_equal(follows[a + 1 : a + len(text)], text[1:] == text[:-1])
    assert follows.sum() >= 1500
