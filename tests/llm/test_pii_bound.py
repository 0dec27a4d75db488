"""Patterns that can't be confident are left out before their words are gathered, and nothing that is found changes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import op7_pii
from tallyloom.llm.op7_pii import pii


def corpus(spark: SparkSession, seed: int) -> DataFrame:
    """Noise patterns with some e-mails and many plain words; planted ones, of which the second ("mail") follows from plain words that the first makes known."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alder", "birch", "cedar", "maple", "Oak", "elm", "42", "iX4b", "PINE"]) + rng.choice(["", "s", "ing", "x" * rng.randrange(9)])
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{prose(9)} noted near entry {''.join(rng.choices('abcdefgh', k=6)) if rng.random() < 0.95 else f'a{i}@b{i}.org'} {prose(9)}" for i in range(1500)]
    texts += [f"{prose(5)} reach operator mailbox user{i}@firm{i}.org {prose(9)}" for i in range(40)]
    names = ["zeltrab", "quorvex", "mintolk", "dravosk"]
    texts += [f"{prose(5)} reach operator mailbox {n} {prose(3)}" for n in names[:3]]
    texts += [f"{prose(5)} kindly write mail {n} {prose(3)}" for n in names for _ in range(2)]
    texts += [f"{prose(5)} kindly write mail c{i}@d{i}.net {prose(3)}" for i in range(12)]
    texts += [f"call line + card 4111 1111 1111 1111 {prose(4)}", "", None]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")


@pytest.mark.parametrize("seed", [1, 2])
def test_the_bound_loses_nothing(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, seed: int) -> None:
    docs = corpus(spark, seed)
    rows = {}

    def cut(df: DataFrame, name: str, write=op7_pii.cut) -> DataFrame:
        out = write(df, name)
        if "_edges_" in name or "_shown" in name:
            rows[name] = out.count()
        return out

    monkeypatch.setattr(op7_pii, "cut", cut)
    got = sorted(map(tuple, pii(docs).collect()))
    bounded, rows = sum(rows.values()), {}
    monkeypatch.setattr(op7_pii, "hopeful", lambda shown, touched: shown.select("key").distinct())
    assert got == sorted(map(tuple, pii(docs).collect()))
    assert any(r[-1].count("email") > r[1] for r in got)
    assert 2 * bounded < sum(n for name, n in rows.items() if "_edges_" in name)
