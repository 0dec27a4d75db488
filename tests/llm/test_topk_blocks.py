"""A pack of queries meets only the blocks whose ball it may reach, and loses nothing by it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import op2_topk


@pytest.mark.parametrize(("apart", "share"), [(40.0, 0.2), (0.0, 1.0)])
def test_blocks_met_by_packs(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, apart: float, share: float) -> None:
    monkeypatch.setattr(op2_topk, "BLOCK_BYTES", 8 * 16 * 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16)) * apart
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 1, 16)]) for i in range(3600)]
    met: list[tuple[int, int]] = []
    plain = op2_topk.reached

    def counted(packs, blocks):
        out = plain(packs, blocks)
        met.append((out.count(), packs.count() * blocks.count()))
        return out

    monkeypatch.setattr(op2_topk, "reached", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in op2_topk.top_k(df).collect()}
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(object)
    for q in range(0, 3600, 100):
        scores = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in scores]
    ((pairs, everything),) = met
    assert pairs <= share * everything


def test_no_join_on_the_length_alone_carries_trees(spark: SparkSession) -> None:
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 1.0, F.sin("id")).alias("embedding"))
    plan = op2_topk.top_k(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert all("tree" not in line for line in plan.splitlines() if "Join" in line and "(dim" in line and "part" not in line)
