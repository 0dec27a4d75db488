"""Reports and audits over evaluations: envelopes, facts, votes, coverage, differences of versions, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.sources.tables import table

from .catalog import DAY, HOUR, events, query

E = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"


@query("""
    WITH n AS (SELECT o_orderkey + 1000 * CAST(o_orderkey % 50 = 0 AS INTEGER) * 100000 AS o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders)
    SELECT coalesce(a.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS DISTINCT FROM n.s THEN 'changed' ELSE 'same' END AS state
    FROM orders a FULL JOIN n ON a.o_orderkey = n.o_orderkey
""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table by key: added, removed, changed, same."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    moved = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey"))
    new = old.select(moved.alias("o_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.lit(True).alias("new"))
    both = old.withColumn("old", F.lit(True)).join(new, "o_orderkey", "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("o_orderstatus").eqNullSafe(F.col("s")), "changed").otherwise("same")
    return both.select("o_orderkey", state.alias("state"))


@query("""
    SELECT l_suppkey AS rule, count(*) FILTER (l_quantity < 10) AS shorter, count(*) FILTER (l_quantity BETWEEN 10 AND 40) AS within,
      count(*) FILTER (l_quantity > 40) AS longer, count(*) FILTER (l_quantity > 48) AS exceeds FROM lineitem GROUP BY 1
""")
def clip_length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule how many clips keep their length."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rule")).agg(F.count_if(q < 10).alias("shorter"), F.count_if(q.between(10, 40)).alias("within"), F.count_if(q > 40).alias("longer"), F.count_if(q > 48).alias("exceeds"))


@query(f"WITH {E} SELECT user_id, event_type, count(*) AS n, min(t) AS first, max(t) AS last FROM e GROUP BY 1, 2 HAVING count(*) >= 5")
def repeated_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that a user repeats five times or more."""
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).filter("n >= 5")


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS next FROM c)
    SELECT user_id, list(event_type ORDER BY k) AS top, CASE WHEN max(CASE WHEN k = 1 THEN n - coalesce(next, 0) END) >= 3 THEN min(CASE WHEN k = 1 THEN event_type END) END AS winner
    FROM r WHERE k <= 3 GROUP BY 1
""")
def vote_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent votes of each user, and the first if it leads by three."""
    c = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type"))), 1, 3)
    g = c.groupBy("user_id").agg(ranked.alias("r"))  # one entry per kind of event
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    lead = -first["less"] + F.coalesce(second["less"], F.lit(0))
    return g.select("user_id", F.transform("r", lambda x: x["event_type"]).alias("top"), F.when(lead >= 3, first["event_type"]).alias("winner"))


@query("""
    WITH b AS (SELECT l_returnflag AS input, count(DISTINCT l_suppkey) AS blocked FROM lineitem WHERE l_discount < 0.02 GROUP BY 1)
    SELECT input, blocked, CAST(row_number() OVER (ORDER BY blocked DESC, input) AS INTEGER) AS rank FROM b
""")
def blocker_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs by the number of rules that they block; the ranking sees one row per input."""
    g = table(spark, sf_dir, "lineitem").filter("l_discount < 0.02").groupBy(F.col("l_returnflag").alias("input")).agg(F.countDistinct("l_suppkey").alias("blocked"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("blocked"), "input")))


@query("SELECT event_type AS phase, count(*) AS calls, count(*) FILTER (value > 150) AS failures, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(value) AS longest FROM events GROUP BY 1")
def phase_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failures and durations of each phase."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), F.count_if(v > 150).alias("failures"), F.sum(F.round(v * 100).cast("long")).alias("cents"), F.max("value").alias("longest"))


@query("""
    SELECT user_id, count(*) FILTER (ok) AS operable, count(*) AS hours FROM (
      SELECT user_id, epoch_us(ts) // 3600000000 AS h, bool_and(event_type <> 'error') AS ok FROM events GROUP BY 1, 2) GROUP BY 1
""")
def operable_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which every reading is operable."""
    hours = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("h")).agg(F.bool_and(F.col("event_type") != "error").alias("ok"))
    return hours.groupBy("user_id").agg(F.count_if("ok").alias("operable"), F.count("*").alias("hours"))


@query(f"""
    WITH {E}, p AS (SELECT event_type AS was, lead(event_type) OVER w AS now, lead(t) OVER w - t AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT was, now, count(*) AS n FROM p WHERE gap <= 172800000000 GROUP BY 1, 2
""")
def transition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between consecutive events at most two days apart."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).select(F.col("event_type").alias("was"), F.lead("event_type").over(order).alias("now"), (F.lead("t").over(order) - F.col("t")).alias("gap"))
    return rows.filter(F.col("gap") <= 2 * DAY).groupBy("was", "now").agg(F.count("*").alias("n"))


@query("SELECT event_id, 3 * log2(least(600.0, value) + 1) + CASE event_type WHEN 'error' THEN 5.0 WHEN 'purchase' THEN 2.0 ELSE 0.0 END AS priority FROM events")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review priority: capped duration on a log scale and a weight by kind."""
    weight = F.when(F.col("event_type") == "error", 5.0).when(F.col("event_type") == "purchase", 2.0).otherwise(0.0)
    return table(spark, sf_dir, "events").select("event_id", (F.log2(F.least(F.lit(600.0), F.col("value")) + 1) * 3 + weight).alias("priority"))


@query("""
    SELECT event_id, 'EV-' || lpad(CAST(ms AS VARCHAR), 16, '0') || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS code FROM (
      SELECT event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) AS k FROM events)
""")
def event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from rounded times, with a number where several fall on one."""
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("t") / 1000).cast("long").alias("ms"))
    k = F.row_number().over(Window.partitionBy("ms").orderBy("event_id"))
    rows = rows.withColumn("k", k)
    return rows.select("event_id", F.concat(F.lit("EV-"), F.lpad(F.col("ms").cast("string"), 16, "0"), F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("code"))


@query(f"""
    WITH {E} SELECT event_id, 'value' AS key, 'number' AS value_type, value AS v_num, CAST(NULL AS VARCHAR) AS v_str FROM e
    UNION ALL SELECT event_id, 'kind', 'string', NULL, event_type FROM e
    UNION ALL SELECT event_id, 'k', 'number', CAST(json_extract_string(props, '$.k') AS DOUBLE), NULL FROM e WHERE json_extract_string(props, '$.k') IS NOT NULL
""")
def fact_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as typed facts, several from each row in one pass."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    k = F.get_json_object("props", "$.k").cast("double")

    def fact(key: str, kind: str, number, string):
        return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("value_type"), number.alias("v_num"), string.alias("v_str"))

    facts = F.array_compact(F.array(fact("value", "number", F.col("value"), text), fact("kind", "string", none, F.col("event_type")), F.when(k.isNotNull(), fact("k", "number", k, text))))
    return table(spark, sf_dir, "events").select("event_id", F.explode(facts).alias("f")).select("event_id", "f.*")


@query(f"""
    WITH {E}, w AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1)
    SELECT event_id, greatest(t - 3600000000, a) AS evidence_start, least(t + 3600000000, b) AS evidence_end, greatest(t - 18000000000, a) AS clip_start, least(t + 18000000000, b) AS clip_end
    FROM e JOIN w USING (user_id) WHERE event_type = 'error'
""")
def evaluation_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and clip about each error, clipped to the user's window."""
    rows = events(spark, sf_dir)
    bounds = rows.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    t = F.col("t")
    part = lambda name, r: [F.greatest(t - r, F.col("a")).alias(f"{name}_start"), F.least(t + r, F.col("b")).alias(f"{name}_end")]
    return rows.filter("event_type = 'error'").join(bounds, "user_id").select("event_id", *part("evidence", HOUR), *part("clip", 5 * HOUR))


@query("""
    WITH f AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase')
    SELECT event_id, 'formal' AS origin FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, 'provisional' FROM events WHERE event_type = 'click' AND (user_id, strftime(ts, '%Y-%m-%d')) NOT IN (SELECT user_id, day FROM f)
""")
def formal_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional clicks count only on days without a formal purchase of the same user."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    formal = rows.filter("event_type = 'purchase'")
    other = rows.filter("event_type = 'click'").join(formal.select("user_id", "day").distinct(), ["user_id", "day"], "left_anti")
    return formal.select("event_id", F.lit("formal").alias("origin")).unionByName(other.select("event_id", F.lit("provisional").alias("origin")))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS BIGINT) WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS own, n, CASE WHEN o_orderkey % 11 = 0 THEN n WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS resolved,
      o_orderkey % 11 <> 0 AND n IS NOT NULL AND CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END <> n AS conflict
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
""")
def exact_join_keeps_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact-key join that fills what is missing and reports, but keeps, what differs."""
    own = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("long")).when(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", own.alias("own"))
    other = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = rows.join(other, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    conflict = F.col("own").isNotNull() & F.col("n").isNotNull() & F.coalesce(F.col("own") != F.col("n"), F.lit(False))
    return both.select("o_orderkey", "own", "n", F.coalesce("own", "n").alias("resolved"), conflict.alias("conflict"))


@query(f"""
    WITH {E}, u AS (SELECT event_id, user_id, t - 10800000000 AS s, t + 10800000000 AS f FROM e WHERE event_type = 'error'),
    o AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u)
    SELECT event_id, r - s AS overlap FROM o WHERE r > s
""")
def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that begin before an earlier one of the same user has ended."""
    before = Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, sf_dir, "error").select("event_id", "user_id", (F.col("t") - 3 * HOUR).alias("s"), (F.col("t") + 3 * HOUR).alias("f"))
    return rows.withColumn("r", F.max("f").over(before)).filter("r > s").select("event_id", (F.col("r") - F.col("s")).alias("overlap"))


@query("""
    SELECT 'nation' AS edge, count(*) AS rows, count(*) FILTER (r_regionkey IS NULL) AS broken FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'customer', count(*), count(*) FILTER (n_nationkey IS NULL) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'orders', count(*), count(*) FILTER (c_custkey IS NULL) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, by edge."""
    out = None
    for name, ref, target, key in (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")):
        joined = table(spark, sf_dir, name).select(ref).join(table(spark, sf_dir, target).select(key), F.col(ref) == F.col(key), "left")
        part = joined.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("broken")).select(F.lit(name).alias("edge"), "rows", "broken")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || ',"type":"' || p_type || '"}') AS identity FROM part
""")
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of compact JSON with sorted keys."""
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(body, 256).alias("identity"))


@query("SELECT l_suppkey AS rule, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS refs, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def reference_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct references of each rule, merged in order (a bounded domain)."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    return rows.groupBy(F.col("l_suppkey").alias("rule")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("refs"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value / 150 BETWEEN 0 AND 1 THEN value / 150 ELSE 0 END AS source, greatest(0.0, least(1.0, value / 150)) AS bounded FROM events")
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence that is dropped, or clamped, out of range."""
    c = F.col("value") / 150
    return table(spark, sf_dir, "events").select("event_id", T.source_confidence(c).alias("source"), T.bounded_confidence(c).alias("bounded"))
