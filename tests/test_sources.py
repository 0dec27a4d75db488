"""Readers and writers on small files."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import lineage, ml, sampling
from tallyloom.sources import tables as S


def test_json_lines_take_nulls_from_the_side_table(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "rows.jsonl").write_text('{"tick": 1, "v": 5}\n{"tick": 2, "v": null}\n{"tick": 3}\n')
    side = spark.createDataFrame([(2, 7), (1, 9)], "tick long, v long")
    got = S.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "tick long, v long", side, ["tick"], ["v"])
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 7), (3, None)]


def test_hashed_files_and_manifest(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"a")
    files = S.read_hashed_files(spark, str(tmp_path / "d"))
    row = files.first()
    assert row.sha256 == hashlib.sha256(b"a").hexdigest() and row.length == 1
    manifest = spark.createDataFrame([(row.path, row.sha256), ("gone", "x")], "path string, sha256 string")
    assert {r.path: r.state for r in S.bound_files(files, manifest).collect()} == {row.path: "ok", "gone": "missing"}


def test_update_one_refuses_other_counts(spark: SparkSession) -> None:
    rows = spark.range(3)
    assert S.update_one(rows, F.col("id") == 1, {"id": F.lit(9)}).agg(F.sum("id")).first()[0] == 11
    with pytest.raises(ValueError):
        S.update_one(rows, F.col("id") > 0, {"id": F.lit(9)})


def test_replace_partitions_leaves_the_others(spark: SparkSession, tmp_path: Path) -> None:
    path = str(tmp_path / "t")
    S.replace_partitions(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), path, ["k"])
    S.replace_partitions(spark.createDataFrame([(2, 5)], "k int, v int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 5)]


def test_report_guards_formulas(spark: SparkSession, tmp_path: Path) -> None:
    S.write_report(spark.createDataFrame([("=1+1", 1), ("ok", 2)], "a string, b int"), str(tmp_path / "r"), "csv")
    assert {r.a for r in spark.read.option("header", "true").csv(str(tmp_path / "r")).collect()} == {"'=1+1", "ok"}


def test_text_functions(spark: SparkSession) -> None:
    row = spark.range(1).select(T.clock_seconds(F.lit("1:05")).alias("a"), T.clock_seconds(F.lit("1:99")).alias("b"), T.clock_seconds(F.lit("1714")).alias("c"), T.basename(F.lit("C:\\x\\y/z.txt")).alias("d"), T.redact_secrets(F.lit("password = hunter2 at /home/me/x")).alias("e"), T.bounded_confidence(F.lit(float("nan"))).alias("f"), T.source_confidence(F.lit(1.5)).alias("g"), T.bounded_confidence(F.lit(1.5)).alias("h")).first()
    assert (row.a, row.b, row.c, row.d, row.f, row.g, row.h) == (65, None, None, "z.txt", 0.0, 0.0, 1.0)
    assert "hunter2" not in row.e and "/home" not in row.e


def test_closure_of_a_long_chain(spark: SparkSession) -> None:
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(9)], "child string, parent string")
    assert lineage.closure(edges).count() == 45


def test_prototypes_abstain_between_two_labels(spark: SparkSession) -> None:
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, v array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.1]), (2, [1.0, 1.0]), (3, None)], "id long, v array<double>")
    got = {r.id: r.predicted for r in ml.predict_with_margin(rows, ml.prototypes(known, "label", "v"), "id", "label", "v", 0.1).collect()}
    assert got == {1: "a", 2: None}


@pytest.mark.parametrize("n", [1, 2, 11, 12, 13, 40, 100])
def test_evenly_spaced_counts(spark: SparkSession, n: int) -> None:
    rows = spark.range(n).withColumn("k", F.lit(1))
    got = sorted(r.id for r in sampling.evenly_spaced(rows, ["k"], ["id"], 12).collect())
    assert got == (list(range(n)) if n <= 12 else sorted({round(i * (n - 1) / 11) for i in range(12)}))


def test_documents_escape_what_comes_from_rows(spark: SparkSession, tmp_path: Path) -> None:
    from tallyloom.sources import reports

    rows = spark.createDataFrame([("m<1>", 2, "a|b\nc", None), ("m<1>", 1, "<i>&\"'", 0.5)], "m string, i int, text string, v double")
    page = reports.html_reports(rows, "m", ["i"], ["i", "text", "v"], "Match").first().html
    assert "<h1>Match m&lt;1&gt;</h1>" in page and "<tr><td>1</td><td>&lt;i&gt;&amp;&quot;&#x27;</td><td>0.5</td></tr><tr><td>2</td><td>a|b\nc</td><td></td></tr>" in page
    note = reports.markdown_reports(rows, "m", ["i"], ["i", "text", "v"], "Match").first().markdown
    assert note == "# Match m<1>\n\n| i | text | v |\n| --- | --- | --- |\n| 1 | <i>&\"' | 0.5 |\n| 2 | a\\|b c |  |\n"
    reports.write_documents(reports.html_reports(rows.filter("i = 1").withColumn("m", F.lit("x")), "m", ["i"], ["i"], "Match"), "m", "html", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value.endswith("<td>1</td></tr></tbody></table></body></html>")


def test_names_in_compatibility_form_and_labels_with_case_folded(spark: SparkSession) -> None:
    import unicodedata

    texts = ["Plain Name-1", "ＦＵＬＬ　Ｗｉｄｔｈ！", "ｶﾀｶﾅ", "ﬁne Straße", "Ⅳ ①", "  Ä  b\tC ", "", None, "ΣΑΣ", "ñ_ñ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r.i: (r.n, r.k) for r in df.select("i", T.name_key(F.col("t")).alias("n"), T.label_key(F.col("t")).alias("k")).collect()}
    blanks = lambda x: " ".join(p for p in x.casefold().replace("\t", " ").split(" ") if p)
    for i, t in enumerate(texts):
        want = (None, None) if t is None else ("".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()), blanks(t))
        assert got[i] == want, t
