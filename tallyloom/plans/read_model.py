"""Search, statistics, comparison, ranking and audits over orders (as matches) and lineitem (as evaluations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import contains_folded
from tallyloom.operators import rules, sets
from tallyloom.sources.tables import table, upsert

from .catalog import query


@query("""
    WITH m AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
    e AS (SELECT l.*, strftime(m.o_orderdate, '%Y-%m-%d') AS day, m.o_orderkey, m.o_orderstatus FROM lineitem l JOIN m ON l_orderkey = o_orderkey)
    SELECT 'label' AS metric, l_returnflag AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS share FROM e GROUP BY 2
    UNION ALL SELECT 'rule', CAST(l_suppkey AS VARCHAR), count(*), NULL FROM e GROUP BY 2
    UNION ALL SELECT 'day', day, count(*), NULL FROM e GROUP BY 2
    UNION ALL SELECT 'improve_rule', CAST(l_suppkey AS VARCHAR), count(*), NULL FROM e WHERE l_returnflag = 'R' GROUP BY 2
    UNION ALL SELECT 'good_share', '', count(*), CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) / nullif(count(*) FILTER (l_returnflag IN ('A', 'R')), 0) FROM e
    UNION ALL SELECT 'evaluable', '', count(DISTINCT o_orderkey), NULL FROM e
    UNION ALL SELECT 'matches', '', count(*), NULL FROM m
    UNION ALL SELECT 'incomplete', '', count(*), NULL FROM m WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'without_evaluations', '', count(*), NULL FROM m WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def stats_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by label, rule and day, the share of good labels, and totals of matches. One join feeds one aggregation over
    grouping sets; the match totals don't need it."""
    m = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey")
    e = lines.join(m, F.col("l_orderkey") == F.col("o_orderkey"))
    # Narrow counts first, so that the grouping sets expand groups and not rows.
    counts = e.groupBy("l_returnflag", "l_suppkey", "day").agg(F.count("*").alias("n"))
    sums = counts.groupingSets([["l_returnflag"], ["l_suppkey"], ["day"], []], "l_returnflag", "l_suppkey", "day").agg(
        F.grouping_id().alias("g"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("n"))), F.lit(0)).alias("improve"),
    )
    none = F.lit(None).cast("double")

    def line(when: str, metric: str, item: Column, n: str, share: Column = none) -> Column:
        return F.when(F.expr(when), F.struct(F.lit(metric).alias("metric"), item.alias("item"), F.col(n).alias("n"), share.alias("share")))

    share = F.try_divide(F.col("good").cast("double"), F.col("good") + F.col("improve"))
    rule = F.col("l_suppkey").cast("string")
    lines_of = F.array_compact(F.array(line("g = 3", "label", F.col("l_returnflag"), "n"), line("g = 5", "rule", rule, "n"), line("g = 6", "day", F.col("day"), "n"), line("g = 5 AND improve > 0", "improve_rule", rule, "improve"), line("g = 7", "good_share", F.lit(""), "n", share)))
    report = sums.select(F.explode(lines_of).alias("x")).select("x.*")
    with_lines = m.join(lines.select("l_orderkey").distinct(), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    totals = with_lines.agg(F.count("l_orderkey").alias("evaluable"), F.count("*").alias("matches"), F.count_if(F.col("o_orderstatus") == "P").alias("incomplete"), F.count_if(F.col("l_orderkey").isNull()).alias("without_evaluations"))
    totals = totals.unpivot([], ["evaluable", "matches", "incomplete", "without_evaluations"], "metric", "n").select("metric", F.lit("").alias("item"), "n", none.alias("share"))
    return report.union(totals)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag IN ('A', 'R') AND l_discount >= 0.05 AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
      AND contains(lower(p_name), 'widget')
    ORDER BY o_orderdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 50 OFFSET 100
""")
def search_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional conjuncts, a keyword that ignores case, a stable order and one page of it."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-12-31T23:59:59.999999").cast("timestamp_ntz")))
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & (F.col("l_discount") >= 0.05))
    named = table(spark, sf_dir, "part").filter(contains_folded(F.col("p_name"), "WIDGET")).select("p_partkey")
    rows = lines.join(named, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    page = rows.orderBy(F.desc("o_orderdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").offset(100).limit(50)
    return page.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""
    SELECT l_returnflag AS label, count(*) FILTER (l_suppkey = 1) AS first, count(*) FILTER (l_suppkey = 2) AS second
    FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1
""")
def compare_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts of two suppliers side by side."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey").isin(1, 2))
    return rows.groupBy(F.col("l_returnflag").alias("label")).agg(F.count_if(F.col("l_suppkey") == 1).alias("first"), F.count_if(F.col("l_suppkey") == 2).alias("second"))


PRICES = [("1-URGENT", 30, 60), ("2-HIGH", 10, 40), ("3-MEDIUM", 5, 15), ("4-NOT SPECIFIED", None, 2)]


@query("""
    WITH price(model, i, o) AS (VALUES ('1-URGENT', 30, 60), ('2-HIGH', 10, 40), ('3-MEDIUM', 5, 15), ('4-NOT SPECIFIED', NULL, 2))
    SELECT o_orderpriority AS model, count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS input_tokens,
      CAST(sum(o_custkey * i + (o_orderkey % 1000) * o) AS BIGINT) AS cost
    FROM orders LEFT JOIN price ON o_orderpriority = model GROUP BY 1
""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens times price per model; unknown prices give an unknown cost."""
    prices = spark.createDataFrame(PRICES, "model string, i int, o int")
    rows = table(spark, sf_dir, "orders").join(prices, F.col("o_orderpriority") == F.col("model"), "left")
    cost = F.col("o_custkey") * F.col("i") + (F.col("o_orderkey") % 1000) * F.col("o")
    return rows.groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("calls"), F.sum("o_custkey").alias("input_tokens"), F.sum(cost).alias("cost"))


@query("""
    SELECT s.l_linestatus AS scope, d.label, count(l.l_returnflag) AS n
    FROM (SELECT DISTINCT l_linestatus FROM lineitem) s CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('X')) d(label)
    LEFT JOIN lineitem l ON l.l_linestatus = s.l_linestatus AND l.l_returnflag = d.label GROUP BY 1, 2
""")
def label_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every label of the domain, whether it occurs or not."""
    labels = ["A", "N", "R", "X"]
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("scope")).agg(*[F.count_if(F.col("l_returnflag") == v).alias(v) for v in labels])
    return counts.unpivot(["scope"], labels, "label", "n")


@query("""
    SELECT p_brand, p_partkey, n, rank FROM (
      SELECT p_brand, p_partkey, n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size, p_partkey) AS INTEGER) AS rank
      FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)
    WHERE rank <= 12
""")
def rule_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve first candidates of each group by a composite order."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"))
    return rules.top_rules(rows, ["p_brand"], 12, F.desc("n"), F.col("p_size"), F.col("p_partkey")).select("p_brand", "p_partkey", "n", "rank")


@query("""
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END,
        l_discount DESC, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS rank FROM lineitem)
    WHERE rank <= 3
""")
def exemplar_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three exemplars per rule: improvements first, the most confident, the earliest."""
    first = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = rules.exemplars(table(spark, sf_dir, "lineitem"), "l_suppkey", 3, first, F.desc("l_discount"), F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice"))
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("""
    SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value
    FROM events GROUP BY 1, 2, 3
""")
def distinct_best_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key the one with the highest value, ties to the smaller id."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sets.best_by_key(rows, ["user_id", "event_type", "day"], F.desc("value"), F.col("event_id")).select("user_id", "event_type", "day", "event_id", "value")


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS contents,
      CASE WHEN count(DISTINCT (l_partkey, l_suppkey)) = 1 THEN 'exact' ELSE 'conflict' END AS kind
    FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that stand several times, with equal or with different content."""
    return sets.duplicate_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS scopes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def id_reuse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are used in several scopes."""
    return sets.reused_ids(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""
    SELECT l_orderkey, CAST(x AS INTEGER) AS l_linenumber FROM (
      SELECT l_orderkey, unnest(generate_series(min(l_linenumber), max(l_linenumber))) AS x FROM lineitem GROUP BY 1)
    WHERE (l_orderkey, x) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem)
""")
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers missing within each order."""
    return sets.number_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
    SELECT o_custkey AS custkey, 'unexpected' AS kind FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)
    UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_nationkey < 20 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def expected_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are expected and missing, and keys that nobody expected."""
    expected = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("custkey"))
    return sets.expected_diff(expected, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' AND l_discount < 0.03 THEN 'unscored' ELSE CASE l_returnflag WHEN 'N' THEN 'unscored' ELSE l_returnflag END END AS label,
      CASE WHEN l_returnflag <> 'N' AND l_discount < 0.03 THEN 'low_confidence' END AS reason,
      CASE WHEN NOT (l_returnflag <> 'N' AND l_discount < 0.03) THEN l_suppkey END AS clip
    FROM lineitem
""")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows under the floor become unscored and lose their clip."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", "unscored").otherwise(F.col("l_returnflag")).alias("label"), "l_discount", F.col("l_suppkey").alias("clip"))
    return rules.confidence_floor(rows, "label", "l_discount", 0.03, ["clip"]).select("l_orderkey", "l_linenumber", "l_partkey", "label", "reason", "clip")


@query("""
    SELECT l_orderkey, CASE WHEN max(l_discount) >= 0.09 AND count(DISTINCT l_returnflag) >= 2 THEN 'confirmed' WHEN max(l_discount) >= 0.06 THEN 'candidate' ELSE 'suppressed' END AS decision
    FROM lineitem GROUP BY 1
""")
def tiered_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed, candidate or suppressed by score and independent sources."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("score"), F.countDistinct("l_returnflag").alias("families"))
    return g.select("l_orderkey", rules.tiered(F.col("score"), F.col("families"), 0.09, 0.06, 2).alias("decision"))


@query("""
    WITH i AS (SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 1)
    SELECT o_orderkey, CASE WHEN i.l_orderkey IS NOT NULL THEN 'incomplete' WHEN o_orderstatus = 'P' THEN 'unverifiable' ELSE 'verified_complete' END AS state
    FROM orders LEFT JOIN i ON o_orderkey = i.l_orderkey
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each match is provably whole: blocking issues, then whether an expected set is known."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    twice = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")
    issues = twice.select(F.col("l_orderkey").alias("o_orderkey"), F.lit("id_conflict").alias("code"))
    return rules.completeness(orders, issues, orders.filter("o_orderstatus <> 'P'"), "o_orderkey", ["id_conflict"]).select("o_orderkey", "state")


@query("""
    SELECT l_suppkey AS rule, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS unscored, count(DISTINCT l_orderkey) AS matches,
      min(l_orderkey) AS first_match, count(*) FILTER (l_linestatus = 'F') AS display_limited
    FROM lineitem GROUP BY 1
""")
def rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-rule totals, unscored rows, matches and display limits."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rule")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("unscored"), F.countDistinct("l_orderkey").alias("matches"), F.min("l_orderkey").alias("first_match"), F.count_if(F.col("l_linestatus") == "F").alias("display_limited")
    )


@query("""
    SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS good, count(*) FILTER (l_returnflag = 'R') AS improve
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts of each match, also of those without any. Lines are counted before the join."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("good"), F.count_if(F.col("l_returnflag") == "R").alias("improve"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good", "improve")])


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN count(*) = 1 OR min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS label, count(*) AS n
    FROM lineitem GROUP BY 1, 2
""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that all rows of a key agree on, or null."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(rules.agreed(F.col("l_returnflag"), F.lit(True)).alias("label"), F.count("*").alias("n"))


@query("""
    SELECT 'cell' AS part, CASE WHEN p_name LIKE '=%' THEN '' ELSE p_type END AS p_type, count(*) AS n, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM part GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*), CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) FROM part
""")
def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by type and over all, in one pass."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    g = table(spark, sf_dir, "part").rollup("p_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum(cents).alias("cents"))
    return g.select(F.when(F.col("g") == 1, "total").otherwise("cell").alias("part"), "p_type", "n", "cents")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'RENEWED' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer
    UNION ALL SELECT 1000000 + s_suppkey, 'SUPPLIER', s_name FROM supplier
""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known keys are updated but keep their name, new keys are inserted."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    changed = old.filter("c_custkey % 7 = 0").select("c_custkey", F.lit("RENEWED").alias("c_mktsegment"), F.lit("ignored").alias("c_name"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_name").alias("c_name"))
    return upsert(old, changed.unionByName(new), ["c_custkey"], keep=["c_name"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, 'no_match' AS violation FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'before_start' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'confidence' FROM lineitem WHERE NOT (l_discount BETWEEN 0.01 AND 1)
""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a contract, one line per violation; one join and one pass serve all checks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    found = F.array_compact(F.array(F.when(F.col("o_orderkey").isNull(), "no_match"), F.when(F.col("l_shipdate") < F.col("o_orderdate"), "before_start"), F.when(~F.col("l_discount").between(0.01, 1), "confidence")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(found).alias("violation"))


@query("""
    SELECT user_id, event_type, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS used FROM (
      SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY used <= 60
""")
def budget_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that fit a budget of 60 per user, in order."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id").orderBy("event_type").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("used", F.sum("n").over(order)).filter("used <= 60")
