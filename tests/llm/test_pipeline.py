"""Each stage of the pipeline drops and changes what its operator says, and nothing else."""

from __future__ import annotations

import random

import corpus_pipeline as P
from pyspark.sql import SparkSession
from test_corpus_operators import SF, awkward, base_spans, prose

from tallyloom.llm import queries as Q
from tallyloom.llm.op10_near_dedup import near_duplicates


def test_stages_keep_clean_rows_and_columns(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    toxic = {r.doc_id for r in Q.op8_toxicity_deobfuscation(spark, SF).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in near_duplicates(docs, P.LEAST).filter("kept").collect()}
    leaked = {r.doc_id for r in Q.op1_decontamination(spark, SF).collect()}
    for stage, want in ((P.drop_toxic, ids(docs) - toxic), (P.drop_near_duplicates, kept), (P.drop_leaks, ids(docs) - leaked)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and ids(out) == want
    assert P.encode(spark, docs, SF).count() == docs.count()


def test_redaction_leaves_no_base_span_of_email(spark: SparkSession) -> None:
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 4)} mail x{i}@y.example.org or +44 20 7946 {i:04d} end") for i in range(5)]
    out = P.redact(spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars"), SF).collect()
    assert len(out) == 5
    assert all("<email>" in r.text and "<phone>" in r.text and not base_spans(r.text) and r.n_chars == len(r.text) and r.text.endswith(" end") for r in out)


def test_run_over_awkward_and_whole_tables(spark: SparkSession) -> None:
    assert P.run(spark, SF).count() > 100
    docs = awkward(spark, extra=False)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 8 or stage is P.drop_near_duplicates
        assert stage(spark, docs.limit(0), SF).count() == 0
