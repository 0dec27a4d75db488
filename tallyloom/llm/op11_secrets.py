"""Secrets by base patterns and corpus-wide ownership frequency, with DataFrame functions only.

Base: assignments to secret-like names, access ids and long hex runs, by regular expressions whose possessive forms find the
same leftmost matches without recursion or rescans.

Ownership: the value of a base span (what is assigned, or the whole run) is a candidate if it looks live: LIVE_LENGTH characters
or more, letters and digits, ENTROPY bits a character, no word of an example in it. Candidates are known by their SHA-256 alone.
Every place in the corpus where a candidate's value stands, in a base context or bare, counts for it: distinct repositories and
distinct owners, each counted over pairs that were made distinct before (a value that stands millions of times at one owner is
one pair). A value at more than OWNERS owners or REPOSITORIES repositories is copied widely: an example. Any other candidate
is specific to its owner: live. Bare places of live values, outside the base spans, are spans of the kind that the
value has in its base context (of several the first listed).

Bare values are whole runs of letters, digits and + / _ . - (signs at the ends are cut off), or of letters and digits alone.

Defined results: a null text is empty: no spans, base_sha256 of the empty string, spans ''; texts of any length are read whole;
repeated rows give repeated results and count once for ownership; a null owner (repository) is an owner (repository) of its
own; a null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .op7_pii import located

KINDS = ("assign", "access", "hex")
LIVE_LENGTH, ENTROPY, OWNERS, REPOSITORIES = 12, 2.5, 2, 4

# The base patterns.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
ASSIGNED = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words of values that are no secrets; what values and bare runs are cut off at their ends.
EXAMPLES = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx"
ENDS = "+/_.=-"
WIDE = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])(?=[0-9+/_.-]*+[A-Za-z])[A-Za-z0-9+/_.-]{12,}+"
NARROW = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,}+"
SPANS = "array<struct<start:int,end:int,hash:string,live:boolean,kind:int>>"


def entropy(value: Column) -> Column:
    """Shannon entropy of value's characters, in bits a character."""
    n = F.length(value)

    def part(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.array_remove(F.split(value, ""), "")), F.lit(0.0), part)


def looks_live(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(EXAMPLES)
    return (F.length(value) >= LIVE_LENGTH) & mixed & (entropy(value) >= ENTROPY)


def base_spans(kind: str, text: Column) -> Column:
    """Base spans of a kind: (start, end, hash of the value, whether it looks live, place of the kind)."""
    value = lambda hit: F.regexp_extract(hit, ASSIGNED, 1) if kind == "assign" else hit
    kept = F.filter(located(text, BASE[kind]), lambda x: F.length(value(x["hit"])) >= LEAST[kind])

    def span(x: Column) -> Column:
        own = F.btrim(value(x["hit"]), F.lit(ENDS))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.sha2(own, 256).alias("hash"), looks_live(own).alias("live"), F.lit(KINDS.index(kind) + 1).alias("kind"))

    return F.when(text.rlike(BASE[kind]), F.transform(kept, span)).otherwise(F.array().cast(SPANS))


def bare_runs(pattern: str, text: Column) -> Column:
    """Runs that may be values, cut at their ends."""

    def span(x: Column) -> Column:
        start = x["start"] + F.length(x["hit"]) - F.length(F.ltrim(x["hit"], F.lit(ENDS)))
        own = F.btrim(x["hit"], F.lit(ENDS))
        return F.struct(start.alias("start"), (start + F.length(own)).alias("end"), F.sha2(own, 256).alias("hash"), F.lit(False).alias("live"), F.lit(0).alias("kind"))

    return F.when(text.rlike(pattern), F.transform(located(text, pattern), span)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One pass over the texts: row, doc_id, owner, repository, base (spans) and bare (runs outside of base spans)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), owner.alias("owner"), repository.alias("repository"))
    text = F.col("text")
    found = rows.select("*", F.concat(*[base_spans(k, text) for k in KINDS]).alias("base"), F.array_distinct(F.concat(bare_runs(WIDE, text), bare_runs(NARROW, text))).alias("runs"))
    free = F.filter("runs", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return cut(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", "base", free.alias("bare")), "secrets_found")


def verdicts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (hash, kind, owners, repositories, live), and all places of their values (row, start, end, base, hash)."""
    place = found.select("row", "owner", "repository", F.explode(F.concat("base", "bare")).alias("x")).select("row", "owner", "repository", "x.*")
    candidates = place.filter("live").groupBy("hash").agg(F.min("kind").alias("first"))
    places = cut(place.join(candidates, "hash").withColumn("base", F.col("kind") > 0), "secrets_places")
    pairs = places.select("hash", "first", "owner", "repository").distinct()
    by_owner = pairs.groupBy("hash", "first", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    counted = by_owner.groupBy("hash", F.col("first").alias("kind")).agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    return cut(counted.withColumn("live", (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)), "secrets_verdicts"), places


def candidates(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Every live-looking value of a base span: hash (SHA-256 of the value), kind, owners, repositories, live."""
    own = F.col("source") if owner is None else owner
    repo = F.struct(own, F.col("lang")) if repository is None else repository
    out = verdicts(scan(docs, own, repo))[0]
    return out.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans (start, place of the kind, end), comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Per row: doc_id, `base` and `spans` (arrays of start, kind from 1, end), n_live and n_copied (base spans of values that are specific to
    an owner, and of widely copied ones). Without other columns the owner is the source, its documents in one language a repository."""
    own = F.col("source") if owner is None else owner
    repo = F.struct(own, F.col("lang")) if repository is None else repository
    found = scan(docs, own, repo)
    judged, places = verdicts(found)
    told = places.select("row", "hash", "start", "end", "base").join(judged, "hash")
    more = F.collect_set(F.when(F.col("live") & ~F.col("base"), F.struct("start", "kind", "end")))
    count = lambda what: F.count(F.when(F.col("base") & what, 1))
    by_row = told.groupBy("row").agg(more.alias("more"), count(F.col("live")).alias("n_live"), count(~F.col("live")).alias("n_copied"))
    slim = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = found.select("row", "doc_id", slim.alias("base")).join(by_row, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")]
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"), *zero)


def secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, spans, n_live, n_copied."""
    found = find_secrets(docs)

    def count(place: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == place)).cast("long").alias(f"n_{KINDS[place - 1]}")

    counts = [count(i + 1) for i in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied")
