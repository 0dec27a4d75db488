"""What the bootstrap finds does not fall with the size of the corpus about it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

from tallyloom.llm.op7_pii import pii


@pytest.mark.parametrize("others", [50, 1_200, 20_000])
def test_planted_identifiers_among_more_and_more_other_ones(spark: SparkSession, others: int) -> None:
    """Eight e-mails and six identifiers of an unknown form stand in one context; others stand anywhere in prose."""
    rng = random.Random(others)
    word = lambda: f"w{min(int(rng.paretovariate(0.8)), 4000)}"
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{prose(20)} reach operator mailbox user{i}@firm{i}.org {prose(20)}" for i in range(8)]
    planted = [f"Qx{i}-mail_Box.{i}zz" for i in range(6)]
    texts += [f"{prose(20)} reach operator mailbox {p} {prose(20)}" for p in planted]
    texts += [f"{prose(rng.randrange(5, 20))} other{i}@place{i}.net {prose(rng.randrange(5, 20))}" for i in range(others)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    found = pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    more = {r.doc_id: r.spans for r in found.filter("doc_id between 8 and 13").collect()}
    for i, p in enumerate(planted):
        at = texts[8 + i].index(p)
        assert more[8 + i] == f"email:{at}:{at + len(p)}"
    clean = found.filter("doc_id > 13").selectExpr("sum(n_email) AS base", "sum(size(split(spans, ','))) AS spans").first()
    assert clean.base == clean.spans == others
