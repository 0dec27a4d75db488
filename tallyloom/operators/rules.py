"""Rules as data: predicates over facts, ranking, confidence decisions, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicate_truth(facts: DataFrame, predicates: DataFrame, scope: Sequence[str], key: str, number: str, most_rules: int = 10_000) -> DataFrame:
    """For each scope and predicate (rule, key, op, lo) the truth over the set of the key's values: true if ANY value
    satisfies it, false if none does, null if the key is absent. Values that are null or not numbers satisfy nothing. The
    number of rules is checked, as every scope gets a row for each."""
    rules = [r["rule"] for r in predicates.select("rule").distinct().limit(most_rules + 1).collect()]
    if len(rules) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    x, lo = F.col(number), F.col("lo")
    op = F.col("op")
    holds = F.when(op == "eq", x == lo).when(op == "neq", x != lo).when(op == "gte", x >= lo).when(op == "gt", x > lo).when(op == "lte", x <= lo).when(op == "lt", x < lo).when(op == "exists", F.lit(True))
    scopes = facts.select(*scope).distinct()
    # The predicates are a rule table: broadcast by Spark only if it is below the session's threshold.
    matched = facts.join(predicates, F.col(key) == F.col("pkey")).groupBy(*scope, "rule").agg(F.bool_or(F.coalesce(holds, F.lit(False))).alias("truth"))
    return scopes.withColumn("rule", F.explode(F.array(*map(F.lit, rules)))).join(matched, [*scope, "rule"], "left")


def top_rules(candidates: DataFrame, scope: Sequence[str], most: int, *order: Column) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).filter(F.col("rank") <= most)


def exemplars(rows: DataFrame, rule: str, quota: int, *order: Column) -> DataFrame:
    """At most quota rows of each rule."""
    return top_rules(rows, [rule], quota, *order)


def confidence_floor(rows: DataFrame, label: str, confidence: str, floor: float, clears: Sequence[str] = ()) -> DataFrame:
    """Scored rows below the floor become unscored with a reason, and `clears` null. Applying it again changes nothing."""
    low = (F.col(label) != "unscored") & (F.col(confidence) < floor)
    return rows.withColumns({"reason": F.when(low, "low_confidence")} | {c: F.when(~low, F.col(c)) for c in clears} | {label: F.when(low, "unscored").otherwise(F.col(label))})


def tiered(score: Column, families: Column, confirm: float, candidate: float, independent: int) -> Column:
    """confirmed, candidate or suppressed from a score and the number of independent sources."""
    return F.when((score >= confirm) & (families >= independent), "confirmed").when(score >= candidate, "candidate").otherwise("suppressed")


def agreed(values: Column, confident: Column) -> Column:
    """As an aggregate: the value that all confident rows have, null if they differ or none is."""
    kept = F.when(confident, values)
    return F.when(F.min(kept) == F.max(kept), F.min(kept))


def majority(rows: DataFrame, keys: Sequence[str], vote: str, least: int, share_percent: int) -> DataFrame:
    """Each key's most frequent vote if it has `least` votes in all and that share of them, else null; ties to the smaller vote."""
    counts = rows.filter(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.sum("n").alias("votes"), F.max("n").alias("top"), F.min_by(vote, F.struct(-F.col("n"), F.col(vote))).alias("winner"))
    return best.withColumn("winner", F.when((F.col("votes") >= least) & (F.col("top") * 100 >= F.col("votes") * share_percent), F.col("winner")))


def completeness(units: DataFrame, issues: DataFrame, expected: DataFrame, key: str, blocking: Sequence[str]) -> DataFrame:
    """incomplete if an issue blocks, unverifiable without an expected set, else verified_complete."""
    blocked = issues.filter(F.col("code").isin(*blocking)).select(key).distinct().withColumn("__b", F.lit(True))
    known = expected.select(key).distinct().withColumn("__e", F.lit(True))
    state = F.when(F.col("__b"), "incomplete").when(F.col("__e").isNull(), "unverifiable").otherwise("verified_complete")
    return units.join(blocked, key, "left").join(known, key, "left").withColumn("state", state).drop("__b", "__e")
