"""A phrase of thousands of items costs a document one look, and hides no leak."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import SparkSession

from tallyloom.llm.op1_decontaminate import WordTable, leaks


def test_shared_words_of_many_items_at_once() -> None:
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 60, n).astype(np.uint64) for n in (0, 1, 5, 30, 30, 7)]
    table = WordTable(items)
    for _ in range(50):
        held = np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64))
        of = rng.permutation(6)[: rng.integers(1, 7)]
        assert table.shared(of, held).tolist() == [sum(int(w) in set(held.tolist()) for w in items[i]) for i in of]
        assert not table.held.any()


def test_common_phrase_hides_no_leak(spark: SparkSession) -> None:
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    phrase = "answer the following question with one of"
    items = [(i, f"{prose(12)} {phrase} {prose(12)}") for i in range(8000)]
    docs = [(d, f"{prose(200)} {phrase} {prose(200)}") for d in range(300)]
    # The phrase is all that is left of the item's runs of five words; the other words stand there with gaps.
    words = items[77][1].split()
    loose = " ".join(w if 12 <= k < 19 or k % 5 else "x" for k, w in enumerate(words))
    docs.append((1000, f"{prose(50)} {loose} {prose(50)}"))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1000, 77)}
