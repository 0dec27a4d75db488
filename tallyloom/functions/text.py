"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def contains_folded(text: Column, keyword: str) -> Column:
    """Substring match that ignores ASCII case; no character of the keyword is special."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(text).contains(fold(F.lit(keyword)))


def like_escape(text: Column) -> Column:
    """Text with the signs that LIKE reads escaped by a backslash."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def redact_secrets(text: Column) -> Column:
    """Keys, tokens and absolute paths replaced by placeholders."""
    text = F.regexp_replace(text, r"(sk|pk)-[A-Za-z0-9_-]{8,}", "<key>")
    text = F.regexp_replace(text, r"(?i)bearer [A-Za-z0-9._-]+", "bearer <token>")
    text = F.regexp_replace(text, r'(?i)(password|secret|token|api_key)[ ]*[=:][ ]*"?[A-Za-z0-9_./+-]+"?', "$1=<secret>")
    text = F.regexp_replace(text, r"[A-Za-z]:\\[A-Za-z0-9_.\\-]+", "<path>")
    return F.regexp_replace(text, r"/(home|Users|root|tmp|var)/[A-Za-z0-9_./-]+", "<path>")


def csv_guard(text: Column) -> Column:
    """An apostrophe before text that a spreadsheet would take for a formula."""
    return F.when(text.rlike("^[\\x{FEFF}\\x20\\x09\\x0D\\x0A]*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _folded(parts: Iterator[pd.Series], change: Callable[[str], str]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([None if not isinstance(x, str) else change(x) for x in texts], dtype=object)


@F.pandas_udf(StringType())
def _name_folded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _folded(parts, lambda x: "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum()))


@F.pandas_udf(StringType())
def _case_folded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _folded(parts, str.casefold)


def _beyond_ascii(text: Column, python: Callable[[Column], Column], ascii_only: Column) -> Column:
    """Spark has no NFKC and no full case folding: texts with characters beyond ASCII go through Arrow to Python, the others stay in the JVM."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, python(F.when(beyond, text))).otherwise(ascii_only)


def name_key(text: Column) -> Column:
    """Letters and digits of any script only, in compatibility form (NFKC: full width, half width, ligatures) and with case folded."""
    return _beyond_ascii(text, _name_folded, F.regexp_replace(F.lower(text), "[^0-9a-z]", ""))


def label_key(text: Column) -> Column:
    """Case folded, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(_beyond_ascii(text, _case_folded, F.lower(text)), r"[\x20\x09-\x0D]+", " "))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def clock_seconds(text: Column) -> Column:
    """Seconds of m:ss; null for anything else."""
    ok = text.rlike("^[0-9]{1,2}:[0-5][0-9]$")
    return F.when(ok, F.split(text, ":")[0].cast("int") * 60 + F.split(text, ":")[1].cast("int"))


def clock_text(seconds: Column) -> Column:
    return F.concat((F.floor(seconds / 60)).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def bounded_confidence(value: Column) -> Column:
    """Within 0 to 1; null and not finite become 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0))


def source_confidence(value: Column) -> Column:
    """The value if it lies within 0 to 1, else 0 (no clamping)."""
    return F.when(value.between(0.0, 1.0), value).otherwise(F.lit(0.0))


def hash_bucket(seed: str, key: Column) -> Column:
    """A number from 0 to below 1 from the first 13 hexadecimal digits (52 bits, exact in a double) of SHA-256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def event_code(prefix: str, millis: Column) -> Column:
    return F.format_string(f"{prefix}-%09d", millis)
