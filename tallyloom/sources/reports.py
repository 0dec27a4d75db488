"""Reports as documents: one HTML or Markdown text for each key, built where its rows are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import html_escape


def _cell(column: str) -> Column:
    """A field as text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _documents(rows: DataFrame, key: str, order: Sequence[str], line: Column, out: str, head: Column, foot: Column, between: str) -> DataFrame:
    """head, the lines of a key's rows in order, and foot."""
    lines = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), between)
    return rows.groupBy(key).agg(text.alias("__text")).select(key, F.concat(head, F.col("__text"), foot).alias(out))


def html_reports(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], title: str, lang: str = "en") -> DataFrame:
    """key and html: a page with a table of the key's rows in order, one cell for each field; everything that comes from the rows is escaped. A
    key is a report's unit (a match), whose rows make one text."""
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(_cell(c)), F.lit("</td>")) for c in fields], F.lit("</tr>"))
    name = F.concat(html_escape(F.lit(title)), F.lit(" "), html_escape(_cell(key)))
    names = F.concat(F.lit(""), *[F.concat(F.lit("<th>"), html_escape(F.lit(c)), F.lit("</th>")) for c in fields])
    head = F.concat(F.lit(f"<!doctype html><html lang='{lang}'><meta charset='utf-8'><title>"), name, F.lit("</title><body><h1>"), name, F.lit("</h1><table border='1'><thead><tr>"), names, F.lit("</tr></thead><tbody>"))
    return _documents(rows, key, order, cells, "html", head, F.lit("</tbody></table></body></html>"), "")


def markdown_cell(text: Column) -> Column:
    """Text that stays in its cell: bars and backslashes escaped, line breaks as blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\|])", r"\\$1"), r"[\r\n]+", " ")


def markdown_reports(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], title: str) -> DataFrame:
    """key and markdown: a heading and a table of the key's rows in order."""
    line = F.concat(F.lit("| "), *[x for c in fields for x in (markdown_cell(_cell(c)), F.lit(" | "))][:-1], F.lit(" |"))
    head = F.concat(F.lit(f"# {title} "), markdown_cell(_cell(key)), F.lit("\n\n| " + " | ".join(fields) + " |\n|" + " --- |" * len(fields) + "\n"))
    return _documents(rows, key, order, line, "markdown", head, F.lit("\n"), "\n")


def write_documents(documents: DataFrame, key: str, text: str, path: str) -> None:
    """One folder for each key, with the document as a text file."""
    documents.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
