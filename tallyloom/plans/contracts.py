"""Contracts, reconciliations, reports and guarded writes: what must hold between tables, and what is to be said when it doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import fold, temporal
from tallyloom.sources.tables import table

from .catalog import DAY, HOUR, events, query
from .integrity import SPLIT, split_documents
from .rules import listed

E = "e AS (SELECT *, epoch_us(ts) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
BY_USER = "PARTITION BY user_id ORDER BY t, event_id"
#: Microseconds by which evidence may reach over a scope's edges.
TOLERANCE = 50_000


def facts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Events with the number `k` of their properties."""
    return events(spark, sf_dir, *kinds).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(f"""
    WITH {E} SELECT p.event_id, CASE WHEN p.k < 10 THEN 'missing context' WHEN EXISTS (SELECT 1 FROM e w WHERE w.event_type = 'view' AND w.user_id = p.user_id
        AND p.t >= w.t - 3600000000 - {TOLERANCE} AND p.t + 1800000000 <= w.t + 14400000000 + {TOLERANCE}) THEN 'inside' ELSE 'outside' END AS verdict FROM e p WHERE event_type = 'purchase'
""")
def scope_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored decisions whose evidence (half an hour) must lie within one of their scope's windows; without its context none may be scored."""
    scored = facts(spark, sf_dir, "purchase").select("event_id", "user_id", "t", "k")
    windows = events(spark, sf_dir, "view").select("user_id", (F.col("t") - HOUR - TOLERANCE).alias("s"), (F.col("t") + 4 * HOUR + TOLERANCE).alias("f"))
    inside = temporal.interval_join(scored, windows, ["user_id"], "t", "s", "f", 5 * HOUR).filter(F.col("t") + HOUR // 2 <= F.col("f"))
    found = scored.join(inside.select("event_id", F.lit(True).alias("inside")).distinct(), "event_id", "left")
    return found.select("event_id", F.when(F.col("k") < 10, "missing context").when(F.col("inside"), "inside").otherwise("outside").alias("verdict"))


@query("""
    WITH a AS (SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'P' ELSE min(l_linestatus) END AS label, list(DISTINCT CAST(l_linenumber AS BIGINT)) AS refs FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey, o_orderstatus <> label AS relabelled, list_sort(list_filter(list_distinct([1, o_orderkey % 7 + 1]), lambda x: NOT list_contains(refs, x))) AS extra FROM orders JOIN a ON l_orderkey = o_orderkey)
    SELECT o_orderkey, relabelled, array_to_string(extra, ',') AS extra FROM o WHERE relabelled OR len(extra) > 0
""")
def deterministic_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that change the label which the facts decide, or that cite more than those facts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    authority = lines.agg(F.when(F.min("l_linestatus") != F.max("l_linestatus"), "P").otherwise(F.min("l_linestatus")).alias("label"), F.collect_set(F.col("l_linenumber").cast("long")).alias("refs"))  # an order's lines
    said = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(authority, "o_orderkey")
    extra = F.array_sort(F.array_except(F.array(F.lit(1).cast("long"), F.col("o_orderkey") % 7 + 1), "refs"))
    said = said.select("o_orderkey", (F.col("o_orderstatus") != F.col("label")).alias("relabelled"), extra.alias("extra"))
    return said.filter(F.col("relabelled") | (F.size("extra") > 0)).withColumn("extra", F.array_join("extra", ","))


@query(f"""
    WITH {E}, c AS (SELECT user_id, t // 604800000000 AS week, list(DISTINCT event_type) AS kinds FROM e GROUP BY 1, 2),
    r AS (SELECT user_id, week, list_sort(list_filter(['click', 'view'], lambda x: NOT list_contains(kinds, x))) AS missing, list_sort(list_filter(['error', 'signup'], lambda x: list_contains(kinds, x))) AS forbidden FROM c)
    SELECT user_id, week, array_to_string(missing, ',') AS missing, array_to_string(forbidden, ',') AS forbidden FROM r WHERE len(missing) > 0 OR len(forbidden) > 0
""")
def candidate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sets that lack an expected kind or hold a forbidden one."""
    sets = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (7 * DAY)).alias("week")).agg(F.collect_set("event_type").alias("kinds"))  # five kinds
    missing = F.array_sort(F.array_except(listed("click", "view"), "kinds"))
    forbidden = F.array_sort(F.array_intersect(listed("error", "signup"), "kinds"))
    return sets.filter((F.size(missing) > 0) | (F.size(forbidden) > 0)).select("user_id", "week", F.array_join(missing, ",").alias("missing"), F.array_join(forbidden, ",").alias("forbidden"))


@query(f"""
    WITH {E}, i AS (SELECT *, t + k * 60000000 AS f FROM e), p AS (SELECT *, max(f) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
    SELECT user_id, count(*) AS n, count(*) FILTER (t % 1000 <> 0) AS off_tick, count(*) FILTER (before > t) AS overlapping,
        CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', event_id, t, f)), 1, 8) AS BIGINT)) AS BIGINT) AS frozen FROM p GROUP BY 1
""")
def annotation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated intervals by user: off the tick, overlapping an earlier one, and a digest that the order of rows does not change."""
    rows = facts(spark, sf_dir).withColumn("f", F.col("t") + F.col("k") * 60_000_000)
    before = F.max("f").over(Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", "event_id", "t", "f"), 256), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("before", before).withColumn("digest", digest)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("t") % 1000 != 0).alias("off_tick"), F.count_if(F.col("before") > F.col("t")).alias("overlapping"), F.sum("digest").alias("frozen"))


@query(f"""
    WITH {E}, s AS (SELECT user_id, t // 21600000000 AS sample, min(floor(value / 4)) FILTER (event_type = 'view') AS a, min(floor(value / 4)) FILTER (event_type = 'click') AS b, min(floor(value / 4)) FILTER (event_type = 'error') AS c FROM e GROUP BY 1, 2)
    SELECT user_id, count(*) AS samples, count(*) FILTER (a = b) AS supplier_consumer, count(*) FILTER (a = c) AS supplier_legacy, count(*) FILTER (b = c) AS consumer_legacy,
        count(*) FILTER (a = b AND b = c) AS all_three, count(*) FILTER (a IS NULL AND (b IS NOT NULL OR c IS NOT NULL)) AS supplier_missing FROM s GROUP BY 1
""")
def three_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier, consumer and legacy readings of the same samples: how often they agree, and where the supplier lacks one."""
    band = lambda kind: F.min(F.when(F.col("event_type") == kind, F.floor(F.col("value") / 4)))
    s = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (6 * HOUR)).alias("sample")).agg(band("view").alias("a"), band("click").alias("b"), band("error").alias("c"))
    n = lambda name, condition: F.count_if(F.expr(condition)).alias(name)
    return s.groupBy("user_id").agg(F.count("*").alias("samples"), n("supplier_consumer", "a = b"), n("supplier_legacy", "a = c"), n("consumer_legacy", "b = c"), n("all_three", "a = b AND b = c"), n("supplier_missing", "a IS NULL AND (b IS NOT NULL OR c IS NOT NULL)"))


@query(f"""
    WITH {E} SELECT event_id, 'R' || k AS rule, CASE WHEN event_id % 6 > 0 THEN event_id % 90 END AS "window", event_id % 5 AS most,
        concat_ws(',', CASE WHEN event_id % 6 = 0 THEN 'window missing' WHEN event_id % 90 > 60 THEN 'window over 60' END, CASE WHEN event_id % 5 = 0 THEN 'most below 1' END, CASE WHEN k < 3 THEN 'rule reserved' END) AS problems FROM e
""")
def policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in JSON as typed rows, with the bounds that they break."""
    window = F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 90)
    text = F.to_json(F.struct(F.concat(F.lit("R"), F.col("k")).alias("rule"), window.alias("window"), F.struct((F.col("event_id") % 5).alias("most")).alias("limits")))
    p = facts(spark, sf_dir).select("event_id", F.from_json(text, "rule string, window long, limits struct<most: long>").alias("p"))
    p = p.select("event_id", "p.rule", "p.window", F.col("p.limits.most").alias("most"))
    reserved = F.substring("rule", 2, 9).cast("long") < 3
    problems = F.concat_ws(",", F.when(F.col("window").isNull(), "window missing").when(F.col("window") > 60, "window over 60"), F.when(F.col("most") < 1, "most below 1"), F.when(reserved, "rule reserved"))
    return p.withColumn("problems", problems)


@query("""
    WITH s AS (SELECT doc_id, sha256(coalesce(text, '')) AS source, doc_id % 4 AS config FROM documents),
    d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN sha256('') ELSE source END AS source, CASE WHEN doc_id % 10 = 0 THEN 9 ELSE config END AS config FROM s WHERE doc_id % 5 > 0 OR doc_id % 10 = 0)
    SELECT s.doc_id, CASE WHEN d.doc_id IS NULL THEN 'new' ELSE concat_ws(',', CASE WHEN s.source <> d.source THEN 'source' END, CASE WHEN s.config <> d.config THEN 'config' END) END AS stale
    FROM s LEFT JOIN d USING (doc_id) WHERE d.doc_id IS NULL OR s.source <> d.source OR s.config <> d.config
""")
def resume_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must run again: rows without a result, or whose source or configuration has another fingerprint than the result's."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source"), (F.col("doc_id") % 4).alias("config"))
    done = now.filter("doc_id % 5 > 0 OR doc_id % 10 = 0").select("doc_id", F.when(F.expr("doc_id % 17 = 0"), F.sha2(F.lit(""), 256)).otherwise(F.col("source")).alias("s"), F.when(F.expr("doc_id % 10 = 0"), 9).otherwise(F.col("config")).alias("c"), F.lit(True).alias("done"))
    both = now.join(done, "doc_id", "left")
    changed = F.concat_ws(",", F.when(F.col("source") != F.col("s"), "source"), F.when(F.col("config") != F.col("c"), "config"))
    return both.select("doc_id", F.when(F.col("done").isNull(), "new").otherwise(changed).alias("stale")).filter("stale <> ''")


@query("""
    WITH a AS (SELECT doc_id, source, sha256(text) AS content, doc_id - 7 AS parent FROM documents WHERE text IS NOT NULL),
    c AS (SELECT content, count(DISTINCT source) AS lineages FROM a GROUP BY 1),
    r AS (SELECT doc_id, concat_ws(',', CASE WHEN parent >= 0 AND NOT EXISTS (SELECT 1 FROM a p WHERE p.doc_id = a.parent) THEN 'parent missing' END, CASE WHEN lineages > 1 THEN 'content of another lineage' END) AS problems FROM a JOIN c USING (content))
    SELECT * FROM r WHERE problems <> ''
""")
def artifact_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that may not be registered: their parent is not there, or the same content has another lineage."""
    a = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.sha2("text", 256).alias("content"), (F.col("doc_id") - 7).alias("parent"))
    lineages = a.groupBy("content").agg(F.countDistinct("source").alias("lineages"))
    known = a.select(F.col("doc_id").alias("parent"), F.lit(True).alias("known"))
    both = a.join(lineages, "content").join(known, "parent", "left")
    problems = F.concat_ws(",", F.when((F.col("parent") >= 0) & F.col("known").isNull(), "parent missing"), F.when(F.col("lineages") > 1, "content of another lineage"))
    return both.select("doc_id", problems.alias("problems")).filter("problems <> ''")


@query(f"""
    WITH {E}, b AS (SELECT event_id, ['confirmed', 'provisional', 'unknown'][k % 3 + 1] AS status, CASE WHEN k % 3 < 2 OR event_id % 17 = 0 THEN k END AS moment, CASE WHEN k % 3 < 2 THEN [k, k + event_id % 4, k + event_id % 5] ELSE CAST([] AS BIGINT[]) END AS evidence FROM e),
    r AS (SELECT event_id, CASE WHEN status = 'unknown' AND moment IS NOT NULL THEN 'unknown with a time' WHEN status = 'unknown' THEN NULL WHEN list_sort(list_distinct(evidence)) <> evidence THEN 'evidence not ordered and distinct' WHEN NOT list_contains(evidence, moment) THEN 'time not among the evidence' END AS problem FROM b)
    SELECT * FROM r WHERE problem IS NOT NULL
""")
def boundary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary records that break their contract: no time where unknown, otherwise ordered distinct evidence that holds the time."""
    status = F.element_at(listed("confirmed", "provisional", "unknown"), (F.col("k") % 3 + 1).cast("int"))
    at = F.when(F.expr("k % 3 < 2 OR event_id % 17 = 0"), F.col("k"))
    evidence = F.when(F.col("k") % 3 < 2, F.array("k", F.col("k") + F.col("event_id") % 4, F.col("k") + F.col("event_id") % 5)).otherwise(F.array().cast("array<bigint>"))
    b = facts(spark, sf_dir).select("event_id", status.alias("status"), at.alias("at"), evidence.alias("evidence"))
    unknown = F.col("status") == "unknown"
    problem = F.when(unknown & F.col("at").isNotNull(), "unknown with a time").when(unknown, F.lit(None)).when(F.array_sort(F.array_distinct("evidence")) != F.col("evidence"), "evidence not ordered and distinct").when(~F.array_contains("evidence", F.col("at")), "time not among the evidence")
    return b.select("event_id", problem.alias("problem")).filter("problem IS NOT NULL")


@query(f"""
    WITH {E}, s AS (SELECT user_id, t // 86400000000 AS day, min(k) AS sampled FROM e WHERE event_type = 'view' GROUP BY 1, 2), n AS (SELECT user_id, t // 86400000000 AS day, min(k) AS native FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
    SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(s.day, n.day) AS day, coalesce(native, sampled) AS boundary, coalesce(sampled <> native, false) AS conflict FROM s FULL JOIN n ON s.user_id = n.user_id AND s.day = n.day
""")
def producer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of two producers side by side: one pass gives their union and where they disagree."""
    of = lambda *kinds: F.min(F.when(F.col("event_type").isin(*kinds), F.col("k")))
    both = facts(spark, sf_dir, "view", "click").groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(of("view").alias("sampled"), of("click", "view").alias("native"))
    return both.select("user_id", "day", F.coalesce("native", "sampled").alias("boundary"), F.coalesce(F.col("sampled") != F.col("native"), F.lit(False)).alias("conflict"))


@query(f"""
    WITH {E}, g AS (SELECT user_id, t AS s, lead(t) OVER ({BY_USER}) AS f FROM e), m AS (SELECT * FROM g WHERE f - s >= 172800000000)
    SELECT p.event_id FROM e p WHERE event_type = 'purchase' AND k >= 5 AND NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = p.user_id AND p.t - 3600000000 < m.f AND m.s < p.t + 3600000000)
""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that the policy admits and whose window (an hour on each side) touches no gap of two days or more. A gap has
    no reading inside, so only the gaps that start or end at a neighbouring reading need a look: no join is needed."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = facts(spark, sf_dir).withColumn("after", F.lead("t").over(order)).withColumn("gap_start", F.when(F.col("after") - F.col("t") >= 2 * DAY, F.col("t"))).withColumn("gap_end", F.when(F.col("after") - F.col("t") >= 2 * DAY, F.col("after")))
    # The latest gap that ended before, and the first that starts later; a gap's own ends are readings.
    ended = F.last("gap_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.first("gap_start", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("ended", ended).withColumn("starts", starts)
    touched = F.coalesce(F.col("t") - HOUR < F.col("ended"), F.lit(False)) | F.coalesce(F.col("starts") < F.col("t") + HOUR, F.lit(False))
    return rows.filter((F.col("event_type") == "purchase") & (F.col("k") >= 5) & ~touched).select("event_id")


@query(f"""
    WITH {E}, d AS (SELECT user_id, t // 604800000000 AS week, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS readable, median(value) AS m FROM e GROUP BY 1, 2)
    SELECT user_id, week, n, floor(readable / n * 10000 + 0.5) / 10000 AS completeness, floor(m * readable / n * 10000 + 0.5) / 10000 AS quality FROM d
""")
def promotion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of readable rows, and the median value weighted with it, to four places."""
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (7 * DAY)).alias("week"))
    d = d.agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("view", "click", "purchase")).alias("readable"), F.percentile("value", 0.5).alias("m"))
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return d.select("user_id", "week", "n", four(F.col("readable") / F.col("n")).alias("completeness"), four(F.col("m") * F.col("readable") / F.col("n")).alias("quality"))


@query("""
    WITH v AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_linestatus = 'O' AND l_quantity > 10) AS b FROM lineitem GROUP BY 1)
    SELECT o_orderpriority AS rule, count(*) AS units, count(*) FILTER (a) AS first_view, count(*) FILTER (b) AS second_view, count(*) FILTER (a AND b) AS both, count(*) FILTER (a <> b) AS inconsistent
    FROM orders JOIN v ON l_orderkey = o_orderkey GROUP BY 1
""")
def scorability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rule: how many units either of two views can score, and where they disagree."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 10)).alias("b"))
    n = lambda name, condition: F.count_if(F.expr(condition)).alias(name)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("rule")).join(v, "o_orderkey")
    return rows.groupBy("rule").agg(F.count("*").alias("units"), n("first_view", "a"), n("second_view", "b"), n("both", "a AND b"), n("inconsistent", "a <> b"))


@query(f"""
    WITH {SPLIT}, x AS (SELECT split, source, CASE WHEN l.doc_id IS NULL THEN 'open' ELSE 'labelled' END AS status FROM s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
    SELECT split, source, status, count(*) AS n, grouping(source) = 1 AS total FROM x GROUP BY GROUPING SETS ((split, source, status), (split, status))
""")
def public_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by split, source and status, and over all sources, without ids or texts."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("status")).distinct()
    x = split_documents(spark, sf_dir).select("doc_id", "split", "source").join(labelled, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    counted = x.groupingSets([["split", "source", "status"], ["split", "status"]], "split", "source", "status")
    return counted.agg(F.count("*").alias("n"), (F.grouping("source") == 1).alias("total"))


@query("""
    WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT n_name, CAST(to_json({'nation': n_name, 'customers': CAST(sum(n) AS BIGINT), 'segments': list({'segment': c_mktsegment, 'n': n} ORDER BY c_mktsegment)}) AS VARCHAR) AS report FROM c JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
""")
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each nation as one JSON document."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    c = c.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    each = c.groupBy("n_name").agg(F.sum("n").alias("customers"), F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("segment"), "n"))).alias("segments"))  # five segments
    return each.select("n_name", F.to_json(F.struct(F.col("n_name").alias("nation"), "customers", "segments")).alias("report"))


@query(f"""
    WITH {E}, c AS (SELECT user_id, event_type, k % 10 AS theme, count(*) AS n FROM e GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type, theme) AS i FROM c)
    SELECT user_id, concat(CAST(CAST(sum(n) AS BIGINT) AS VARCHAR), ' events; ', string_agg(concat(event_type, ' ', theme, ': ', n), ', ' ORDER BY i) FILTER (i <= 8)) AS summary FROM r GROUP BY 1
""")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each user: how many events, and the eight most frequent kinds."""
    c = facts(spark, sf_dir).groupBy("user_id", "event_type", (F.col("k") % 10).alias("theme")).agg(F.count("*").alias("n"))
    lists = c.groupBy("user_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type", "theme"))).alias("ranked"))  # fifty kinds and themes
    said = F.transform(F.slice("ranked", 1, 8), lambda x: F.concat(x["event_type"], F.lit(" "), x["theme"], F.lit(": "), -x["less"]))
    return lists.select("user_id", F.concat(F.col("total"), F.lit(" events; "), F.array_join(said, ", ")).alias("summary"))


@query("""
    WITH l AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_linenumber) AS numbers, max(l_linenumber) AS highest, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(lines, 0) AS lines, CASE WHEN numbers = lines AND highest = lines THEN quantity END AS quantity, CASE WHEN numbers = lines AND highest = lines THEN returned END AS returned,
        CASE WHEN lines IS NULL THEN 'no rows' WHEN numbers = lines AND highest = lines THEN 'recomputed' ELSE 'unprovable' END AS basis FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def stored_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals rebuilt from stored rows; where the rows' numbers show that some are missing or repeated, they stay unknown."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.size(F.collect_set("l_linenumber")).alias("numbers"), F.max("l_linenumber").alias("highest"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    both = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    whole = (F.col("numbers") == F.col("lines")) & (F.col("highest") == F.col("lines"))
    basis = F.when(F.col("lines").isNull(), "no rows").when(whole, "recomputed").otherwise("unprovable")
    return both.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.when(whole, F.col("q")).alias("quantity"), F.when(whole, F.col("r")).alias("returned"), basis.alias("basis"))


@query("""
    WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM orders)
    SELECT * FROM r WHERE place <= 20
""")
def bounded_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty issues of each kind by a total order; Spark keeps twenty a task before it shuffles."""
    order = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderstatus"), F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(order)).filter("place <= 20").select("o_orderpriority", "o_orderkey", "place")


@query(f"""
    WITH {E}, r AS (SELECT user_id, t // 86400000000 AS day, event_id, floor(value) AS v, rank() OVER (PARTITION BY user_id, t // 86400000000 ORDER BY floor(value) DESC) AS place FROM e)
    SELECT user_id, day, CASE WHEN count(*) = 1 THEN min(event_id) END AS winner, count(*) AS tied FROM r WHERE place = 1 GROUP BY 1, 2
""")
def unique_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the highest score of each group; none where several share it. Two combining aggregates, no sort."""
    by_score = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day"), F.floor("value").alias("v")).agg(F.count("*").alias("tied"), F.min("event_id").alias("first"))
    best = by_score.groupBy("user_id", "day").agg(F.max_by(F.struct("tied", "first"), "v").alias("b"))
    return best.select("user_id", "day", F.when(F.col("b.tied") == 1, F.col("b.first")).alias("winner"), F.col("b.tied").alias("tied"))


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS parent FROM lineitem)
    SELECT l_orderkey, l_linenumber, o_custkey, CASE WHEN o_orderkey IS NULL THEN 'refused' ELSE 'saved' END AS outcome FROM c LEFT JOIN orders ON o_orderkey = parent
""")
def parent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that take their owner from the parent; without a parent they are refused."""
    parent = F.when(F.col("l_partkey") % 50 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parent.alias("o_orderkey"))
    both = rows.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit("saved").alias("outcome")), "o_orderkey", "left")
    return both.select("l_orderkey", "l_linenumber", "o_custkey", F.coalesce("outcome", F.lit("refused")).alias("outcome"))


@query("""
    WITH w AS (SELECT doc_id, quality AS value, 1 AS rank FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, toxic, 2 FROM labels WHERE doc_id % 2 = 0),
    k AS (SELECT doc_id, max(rank) AS rank FROM w GROUP BY 1), d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 11 > 0)
    SELECT DISTINCT w.doc_id, w.value FROM w JOIN k ON w.doc_id = k.doc_id AND w.rank = k.rank WHERE w.doc_id IN (SELECT doc_id FROM d)
""")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows after an upsert: new values win, and rows whose owner is gone are neither written nor kept."""
    labels, owners = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("text IS NOT NULL AND doc_id % 11 > 0").select("doc_id")
    stored = labels.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("value"), F.lit(1).alias("rank"))
    new = labels.filter("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("value"), F.lit(2).alias("rank"))
    rows = stored.unionByName(new).join(owners, "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.max_by("value", "rank").alias("value"))


@query(f"""
    WITH {E}, g AS (SELECT user_id, event_id, k, unnest(generate_series(t // 3600000000, (t + k * 60000000) // 3600000000)) AS hour FROM e WHERE event_type = 'purchase')
    SELECT user_id, hour, count(*) AS active, max(k) AS longest, min(event_id) AS first FROM g GROUP BY 1, 2
""")
def interval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals laid on a grid of hours, with what is active in each."""
    end = F.col("t") + F.col("k") * 60_000_000
    g = facts(spark, sf_dir, "purchase").select("user_id", "event_id", "k", F.explode(F.sequence(F.floor(F.col("t") / HOUR), F.floor(end / HOUR))).alias("hour"))
    return g.groupBy("user_id", "hour").agg(F.count("*").alias("active"), F.max("k").alias("longest"), F.min("event_id").alias("first"))


@query(f"""
    WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, t AS s, t + k * 600000000 AS f, row_number() OVER ({BY_USER}) AS n FROM e WHERE event_type IN ('view', 'click')),
    w AS (SELECT user_id, n, event_id AS kept, s AS ks, f AS kf, CAST(NULL AS BIGINT) AS loser, CAST(NULL AS BIGINT) AS winner FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.n, CASE WHEN NOT o.s - 1000000 <= kf OR o.f - o.s < kf - ks THEN o.event_id ELSE kept END, CASE WHEN NOT o.s - 1000000 <= kf OR o.f - o.s < kf - ks THEN o.s ELSE ks END, CASE WHEN NOT o.s - 1000000 <= kf OR o.f - o.s < kf - ks THEN o.f ELSE kf END,
        CASE WHEN NOT o.s - 1000000 <= kf THEN NULL WHEN o.f - o.s < kf - ks THEN kept ELSE o.event_id END, CASE WHEN NOT o.s - 1000000 <= kf THEN NULL WHEN o.f - o.s < kf - ks THEN o.event_id ELSE kept END
        FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
    SELECT user_id, loser AS event_id, winner AS retained FROM w WHERE loser IS NOT NULL
""")
def overlapping_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of candidates whose brackets overlap or come within a second of the one kept, the narrower stays; the others are archived with it."""
    rows = facts(spark, sf_dir, "view", "click").withColumn("f", F.col("t") + F.col("k") * 600_000_000)
    return fold.grouped_fold(rows, ["user_id"], ["t", "event_id"], ["event_id", "t", "f"], fold.narrower(1_000_000), "user_id long, event_id long, retained long")


@query(f"""
    WITH RECURSIVE {E}, x AS (SELECT user_id, event_id, t, floor(value / 5) AS v, lag(floor(value / 5)) OVER ({BY_USER}) AS old, lag(t) OVER ({BY_USER}) AS old_t FROM e WHERE event_type IN ('view', 'click')),
    r AS (SELECT *, v - old AS n FROM x WHERE v > old), z AS (SELECT user_id, event_id AS reset, t AS moment FROM e WHERE event_type = 'signup'),
    p AS (SELECT r.user_id, r.event_id, r.n, moment, row_number() OVER (PARTITION BY r.event_id ORDER BY moment, reset) AS i FROM r JOIN z ON z.user_id = r.user_id AND moment > old_t AND moment <= t + 7200000000),
    b AS (SELECT user_id, moment FROM p WHERE i <= n UNION SELECT user_id, t FROM r WHERE event_id NOT IN (SELECT event_id FROM p)),
    o AS (SELECT user_id, moment, row_number() OVER (PARTITION BY user_id ORDER BY moment) AS i FROM b),
    f AS (SELECT user_id, i, moment AS kt, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN moment - kt >= 72000000000 THEN moment ELSE kt END, moment - kt >= 72000000000 FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT user_id, kt AS moment FROM f WHERE kept
""")
def rounds_from_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries from rises of a score: a rise by n takes the first n resets since the last score, else its own time; boundaries keep twenty hours apart."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    reads = events(spark, sf_dir, "view", "click").withColumn("v", F.floor(F.col("value") / 5))
    rises = reads.withColumn("n", F.col("v") - F.lag("v").over(order)).withColumn("old_t", F.lag("t").over(order)).filter("n > 0").select("user_id", "event_id", "t", "n", "old_t")
    resets = events(spark, sf_dir, "signup").select("user_id", F.col("event_id").alias("reset"), F.col("t").alias("moment"))
    spans = rises.select("user_id", "event_id", "n", (F.col("old_t") + 1).alias("s"), (F.col("t") + 2 * HOUR).alias("f"))
    place = Window.partitionBy("event_id").orderBy("moment", "reset")
    placed = temporal.interval_join(resets, spans, ["user_id"], "moment", "s", "f", DAY).withColumn("i", F.row_number().over(place))
    alone = rises.join(placed.select("event_id").distinct(), "event_id", "left_anti").select("user_id", F.col("t").alias("moment"))
    bounds = placed.filter("i <= n").select("user_id", "moment").unionByName(alone).distinct().withColumn("state", F.lit(0))
    return fold.grouped_fold(bounds, ["user_id"], ["moment"], ["moment", "moment", "state"], fold.thin(20 * HOUR), "user_id long, moment long")


@query()
def diversified_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates in groups around the first of each place; the groups' first members come before all others."""
    rows = facts(spark, sf_dir).withColumn("week", F.floor(F.col("t") / (7 * DAY))).withColumn("x", F.col("value")).withColumn("y", F.col("k").cast("double"))
    grouped = fold.grouped_fold(rows, ["user_id", "week"], ["value", "event_id"], ["event_id", "x", "y"], fold.around_first(8.0), "user_id long, week long, event_id long, baseline long, grp long, lead boolean")
    order = Window.partitionBy("user_id", "week").orderBy(F.desc("lead"), "baseline")
    return grouped.withColumn("place", F.row_number().over(order))
