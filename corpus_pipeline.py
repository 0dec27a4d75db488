"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents with benchmark items go,
personal data is replaced, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
Rows with a null doc_id pass the second and third stage as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, table
from tallyloom.llm.op1_decontaminate import leaks
from tallyloom.llm.op3_bpe import encode_documents
from tallyloom.llm.op7_pii import find_spans, redacted
from tallyloom.llm.op8_toxicity import THRESHOLD, scored
from tallyloom.llm.op10_near_dedup import near_duplicates

#: Similarity in percent of documents that count as near duplicates.
LEAST = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return scored(docs, table(spark, sf_dir, "labels"), name=name).filter(F.col(name) < THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and all that have none."""
    gone = near_duplicates(docs, LEAST).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    held = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    found = find_spans(docs, whole=True)
    text = F.when(F.size("spans") > 0, redacted(F.col("kept.text"), F.col("spans"))).otherwise(F.col("kept.text"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[new.get(c, F.col(f"kept.{c}")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("bpe", encode),
]

#: SQL can't express these stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
