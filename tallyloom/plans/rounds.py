"""Rounds and readings: matching, fusion, votes, runs, windows, samplers and roll-ups over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import fold, temporal
from tallyloom.sources.tables import table

from .catalog import DAY, HOUR, events, query

E = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"
BY_USER = "PARTITION BY user_id ORDER BY t, event_id"


def by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("t", "event_id")


@query()
def exclusive_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase takes the nearest view within three hours, before or after, that no purchase before it took."""
    views, purchases = events(spark, sf_dir, "view"), events(spark, sf_dir, "purchase")
    return fold.nearest_exclusive_match(views, purchases, ["user_id"], "t", "event_id", 3 * HOUR, "user_id long")


@query(f"""
    WITH {E}, h AS (SELECT * FROM e WHERE event_type = 'view'), a AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'error' GROUP BY 1, 2),
    x AS (SELECT h.event_id, h.user_id, h.t, CASE WHEN h.t - a.t <= 43200000000 THEN a.value END AS click FROM h ASOF LEFT JOIN a ON h.user_id = a.user_id AND h.t >= a.t)
    SELECT x.event_id, click, CASE WHEN x.t - b.t <= 43200000000 THEN b.value END AS error, coalesce(click, CASE WHEN x.t - b.t <= 43200000000 THEN b.value END) AS fused FROM x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.t >= b.t
""")
def asof_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with the latest readings of two sources at most twelve hours old, the first source before the second."""
    rows = events(spark, sf_dir, "view").select("event_id", "user_id", "t")
    for kind in ("click", "error"):
        source = events(spark, sf_dir, kind).select("user_id", "t", "value")
        rows = temporal.asof_backward(rows, source, ["user_id"], "t", "value", 12 * HOUR).drop("matched").withColumnRenamed("value", kind)
    return rows.select("event_id", "click", "error", F.coalesce("click", "error").alias("fused"))


@query(f"""
    WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS i FROM e WHERE event_type IN ('view', 'click'))
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.i, b.i) AS i, a.event_id AS view_id, b.event_id AS click_id, a.i IS NOT NULL AND b.i IS NOT NULL AS aligned
    FROM (SELECT * FROM n WHERE event_type = 'view') a FULL JOIN (SELECT * FROM n WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.i = b.i
""")
def zip_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences of a key row by row; what one of them lacks stays visible."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    side = lambda kind: events(spark, sf_dir, kind).select("user_id", F.row_number().over(order).cast("long").alias("i"), F.col("event_id").alias(f"{kind}_id"))
    both = side("view").join(side("click"), ["user_id", "i"], "full")
    return both.select("user_id", "i", "view_id", "click_id", (F.col("view_id").isNotNull() & F.col("click_id").isNotNull()).alias("aligned"))


@query(f"""
    WITH {E}, w AS (SELECT event_id, user_id, t - 7200000000 AS s, t + 7200000000 AS f FROM e WHERE event_type = 'error')
    SELECT a.event_id AS a, b.event_id AS b FROM w a JOIN w b ON a.user_id = b.user_id AND a.event_id < b.event_id AND greatest(a.s, b.s) <= least(a.f, b.f) + 1800000000
""")
def scene_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a key's scenes that overlap but for half an hour."""
    w = events(spark, sf_dir, "error")
    side = lambda n, more: w.select("user_id", F.col("event_id").alias(n), (F.col("t") - 2 * HOUR).alias(f"{n}s"), (F.col("t") + 2 * HOUR + more).alias(f"{n}f"))
    pairs = temporal.overlap_join(side("a", HOUR // 2), side("b", HOUR // 2), ["user_id"], 6 * HOUR, "as", "af", "bs", "bf")
    near = F.greatest("as", "bs") <= F.least("af", "bf")
    return pairs.filter((F.col("a") < F.col("b")) & near).select("a", "b")


@query("""
    WITH f AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS refs FROM lineitem GROUP BY 1),
    g AS (SELECT o_custkey, o_orderpriority AS reason, refs, count(*) AS n, min(o_orderkey) AS lead FROM orders JOIN f ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2, 3)
    SELECT o_custkey, reason, refs, lead, n, n - 1 <= 2 AS merged FROM g WHERE n > 1
""")
def shared_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items with the same reason and the same set of facts; they merge into the first if two others at most are related."""
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("refs"))  # three flags
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").join(refs, F.col("o_orderkey") == F.col("l_orderkey"))
    g = o.groupBy("o_custkey", F.col("o_orderpriority").alias("reason"), "refs").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lead"))
    return g.filter("n > 1").withColumn("merged", F.col("n") - 1 <= 2)


@query(f"""
    WITH {E}, s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({BY_USER}) AS seg, CASE WHEN event_type = 'view' THEN floor(value) END AS known FROM e)
    SELECT event_id, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(known IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS found FROM s
""")
def neighbour_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last known row before, else of the first after; barriers stop the walk."""
    rows = events(spark, sf_dir).withColumn("known", F.when(F.col("event_type") == "view", F.floor("value").cast("double")))
    rows = rows.withColumn("seg", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(by_user().rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("user_id", "seg").orderBy("t", "event_id")
    before = F.last("known", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("known", ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))
    return rows.select("event_id", F.coalesce(before, after).alias("found"))


@query("""
    WITH p AS (SELECT o_custkey AS path, o_orderkey AS ref FROM orders WHERE o_orderkey % 9 > 0), c AS (SELECT ref, count(*) AS used FROM p GROUP BY 1)
    SELECT o.o_orderkey, p.path, coalesce(used, 0) = 1 AS exact FROM orders o LEFT JOIN p ON p.ref = o.o_orderkey LEFT JOIN c ON c.ref = o.o_orderkey
""")
def exact_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that cite rows by id, attached to them; each row is to be consumed exactly once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    paths = orders.filter("o_orderkey % 9 > 0").groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(F.collect_list("o_orderkey").alias("refs"))  # a thousand keys at most
    refs = paths.select(F.col("o_custkey").alias("path"), F.explode("refs").alias("o_orderkey"))
    used = refs.groupBy("o_orderkey").agg(F.count("*").alias("used"), F.min("path").alias("path"))
    return orders.select("o_orderkey").join(used, "o_orderkey", "left").select("o_orderkey", "path", (F.coalesce("used", F.lit(0)) == 1).alias("exact"))


@query(f"""
    WITH {E}, s AS (SELECT user_id, CAST(floor(value / 3) AS BIGINT) AS v, CAST(floor(lead(value) OVER ({BY_USER}) / 3) AS BIGINT) AS nxt FROM e),
    c AS (SELECT user_id, v, count(*) AS n FROM s WHERE v = nxt GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS k FROM c)
    SELECT user_id, v, n, n >= 3 AND n * 10 >= total * 6 AS accepted FROM r WHERE k = 1
""")
def stable_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent of the stable votes (the next reading agrees), accepted from three votes and 60 % on."""
    rows = events(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 3))
    stable = rows.withColumn("next", F.lead("v").over(by_user())).filter("v = next").groupBy("user_id", "v").agg(F.count("*").alias("n"))
    best = stable.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("v")).alias("less"))).alias("b"), F.sum("n").alias("total"))
    return best.select("user_id", (-F.col("b.less")).alias("v"), F.col("b.n").alias("n"), ((F.col("b.n") >= 3) & (F.col("b.n") * 10 >= F.col("total") * 6)).alias("accepted"))


@query("""
    WITH d AS (SELECT unnest(['flag', 'status', 'bulk']) AS domain, unnest([l_returnflag, CASE WHEN l_linenumber < 6 THEN l_linestatus END, CASE WHEN l_quantity > 30 THEN 'bulk' END]) AS value FROM lineitem), t AS (SELECT domain, count(*) AS total FROM d GROUP BY 1)
    SELECT d.domain, coalesce(value, 'UNKNOWN') AS value, count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM d JOIN t USING (domain) GROUP BY 1, 2
""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of every value of every domain, unknown ones too, from one unpivot."""
    domains = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.when(F.col("l_linenumber") < 6, F.col("l_linestatus")), F.lit("bulk"), F.when(F.col("l_quantity") > 30, "bulk"))
    n = table(spark, sf_dir, "lineitem").select(F.explode(domains).alias("domain", "value")).groupBy("domain", F.coalesce("value", F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("domain")), 6))  # a row for each value


@query(f"""
    WITH {E} SELECT user_id, t // 3600000000 AS hour, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'AMBIGUOUS' END AS value, count(*) AS readings, count(DISTINCT event_type) AS candidates FROM e GROUP BY 1, 2
""")
def bin_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one value that all readings of a bin agree on, else ambiguous with the number of candidates."""
    kinds = F.countDistinct("event_type")
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.when(kinds == 1, F.min("event_type")).otherwise("AMBIGUOUS").alias("value"), F.count("*").alias("readings"), kinds.alias("candidates"))


@query("""
    WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 3 ORDER BY l_suppkey % 3) FILTER (l_quantity > 25) AS c FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN c IS NULL OR len(c) = 0 THEN 'UNKNOWN' WHEN len(c) = 1 THEN CAST(c[1] AS VARCHAR) ELSE 'AMBIGUOUS' END AS number, coalesce(array_to_string(c, ','), '') AS candidates FROM s
""")
def number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single number, or that it is ambiguous or unknown, with the candidates."""
    c = F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_suppkey") % 3)))  # three numbers
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(c.alias("c"))
    number = F.when(F.size("c") == 0, "UNKNOWN").when(F.size("c") == 1, F.get("c", F.lit(0)).cast("string")).otherwise("AMBIGUOUS")
    return s.select("l_orderkey", number.alias("number"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("candidates"))


@query(f"""
    WITH {E}, p AS (SELECT *, lag(t) OVER ({BY_USER}) AS bt, lag(event_type) OVER ({BY_USER}) AS bk, lag(value) OVER ({BY_USER}) AS bv FROM e)
    SELECT user_id, count(*) FILTER (bk = event_type) AS repeated, count(*) FILTER (t - bt > 172800000000) AS gaps, count(*) FILTER (bk = 'error' AND event_type = 'purchase') AS bought_after_error, count(*) FILTER (value < bv - 5) AS drops, count(*) FILTER (bt IS NULL AND event_type <> 'signup') AS without_start FROM p GROUP BY 1
""")
def consistency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five counters of what is inconsistent from one row to the next."""
    w = by_user()
    p = events(spark, sf_dir).withColumns({"bt": F.lag("t").over(w), "bk": F.lag("event_type").over(w), "bv": F.lag("value").over(w)})
    c = F.col
    counters = {"repeated": c("bk") == c("event_type"), "gaps": c("t") - c("bt") > 2 * DAY, "bought_after_error": (c("bk") == "error") & (c("event_type") == "purchase"), "drops": c("value") < c("bv") - 5, "without_start": c("bt").isNull() & (c("event_type") != "signup")}
    return p.groupBy("user_id").agg(*[F.count_if(v).alias(k) for k, v in counters.items()])


@query("SELECT concat(o_orderpriority, ':', o_orderstatus) AS revision, count(*) AS n FROM orders GROUP BY 1")
def revision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each domain and reason was revised."""
    return table(spark, sf_dir, "orders").groupBy(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("revision")).agg(F.count("*").alias("n"))


@query("""
    WITH r(s, lv) AS (VALUES ('P', 1), ('O', 2), ('F', 3)), x AS (SELECT o_custkey, o_orderkey, lv FROM orders JOIN r ON s = o_orderstatus), f AS (SELECT l_orderkey, min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS weakest FROM lineitem GROUP BY 1)
    SELECT o_custkey, max(lv) AS trigger, min(weakest) AS fact, least(max(lv), min(weakest)) AS readiness FROM x JOIN f ON l_orderkey = o_orderkey GROUP BY 1
""")
def rule_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule is as ready as its best trigger and its weakest required fact allow."""
    level = F.create_map(*[F.lit(x) for x in ("P", 1, "O", 2, "F", 3)])
    fact = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    weakest = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(fact).alias("weakest"))
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.element_at(level, F.col("o_orderstatus")).alias("lv")).join(weakest, "o_orderkey")
    return x.groupBy("o_custkey").agg(F.max("lv").alias("trigger"), F.min("weakest").alias("fact")).withColumn("readiness", F.least("trigger", "fact"))


@query("""
    WITH s AS (SELECT o_orderpriority AS source, CASE WHEN o_custkey % 7 = 0 THEN 'test' WHEN o_custkey % 7 = 1 THEN 'validation' ELSE 'train' END AS split, o_custkey FROM orders WHERE o_orderpriority NOT LIKE '5%' OR o_custkey % 7 > 1), d(split) AS (VALUES ('train'), ('validation'), ('test'), ('holdout'))
    SELECT p.source, d.split, count(s.o_custkey) AS rows, count(DISTINCT s.o_custkey) AS groups FROM (SELECT DISTINCT source FROM s) p CROSS JOIN d LEFT JOIN s ON s.source = p.source AND s.split = d.split GROUP BY 1, 2
""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct groups of each source and split; splits without rows show zeros."""
    m = F.col("o_custkey") % 7
    s = table(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").startswith("5") | (m > 1)).select(F.col("o_orderpriority").alias("source"), F.when(m == 0, "test").when(m == 1, "validation").otherwise("train").alias("split"), "o_custkey")
    n = s.groupBy("source", "split").agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("groups"))
    every = n.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("train", "validation", "test", "holdout")))).alias("split"))
    return every.join(n, ["source", "split"], "left").na.fill(0, ["rows", "groups"])


@query(f"""
    WITH {E}, p AS (SELECT event_type AS kind, value > 4 AS a, lead(value) OVER ({BY_USER}) > 4 AS b, lead(t) OVER ({BY_USER}) - t AS gap FROM e)
    SELECT kind, count(*) FILTER (gap <= 43200000000 AND a = b) AS agree, count(*) FILTER (gap <= 43200000000 AND a <> b) AS disagree, count(*) FILTER (gap > 43200000000 OR b IS NULL) AS undetermined FROM p GROUP BY 1
""")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: how often an independent signal (the next reading within half a day) agrees, disagrees or decides nothing."""
    w = by_user()
    p = events(spark, sf_dir).select(F.col("event_type").alias("kind"), (F.col("value") > 4).alias("a"), (F.lead("value").over(w) > 4).alias("b"), (F.lead("t").over(w) - F.col("t")).alias("gap"))
    near = F.col("gap") <= 12 * HOUR
    return p.groupBy("kind").agg(F.count_if(near & (F.col("a") == F.col("b"))).alias("agree"), F.count_if(near & (F.col("a") != F.col("b"))).alias("disagree"), F.count_if(~near | F.col("b").isNull()).alias("undetermined"))


@query("""
    WITH p AS (SELECT o_custkey % 5 AS fold, o_orderstatus AS label, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS predicted FROM orders), r AS (SELECT fold, label, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT fold, round(avg(recall), 6) AS balanced, CAST(sum(n) AS BIGINT) AS rows FROM r GROUP BY 1
""")
def fold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced recall of each held-out fold: the mean over labels, whatever their sizes."""
    predicted = F.when(F.col("o_totalprice") > 150000, "F").otherwise("O")
    r = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).alias("fold"), "o_orderstatus").agg(F.avg(F.when(F.col("o_orderstatus") == predicted, 1.0).otherwise(0.0)).alias("recall"), F.count("*").alias("n"))
    return r.groupBy("fold").agg(F.round(F.avg("recall"), 6).alias("balanced"), F.sum("n").alias("rows"))


@query(f"""
    WITH {E}, d AS (SELECT DISTINCT user_id, t // 86400000000 AS d FROM e), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS k FROM d), c AS (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT user_id, max(n) AS longest, median(n) AS middle, count(*) AS chains, count(*) - 1 AS missing_runs FROM c GROUP BY 1
""")
def path_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of days with an event: the longest, the median, their number and that of the gaps between."""
    days = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / DAY).alias("d"))
    c = temporal.islands(days, ["user_id"], "d").withColumn("n", F.col("hi") - F.col("lo"))
    return c.groupBy("user_id").agg(F.max("n").alias("longest"), F.median("n").alias("middle"), F.count("*").alias("chains"), (F.count("*") - 1).alias("missing_runs"))


@query("""
    WITH a AS (SELECT user_id, date_trunc('day', ts) AS d, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2), b AS (SELECT user_id, date_trunc('day', ts) AS d, max(value) AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (a.v = b.v) AS same, count(*) FILTER (a.v <> b.v) AS different, count(*) FILTER (b.v IS NULL) AS only_a, count(*) FILTER (a.v IS NULL) AS only_b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.d = b.d GROUP BY 1
""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same observations replayed in two modes: what agrees, differs, or exists in one only."""
    mode = lambda without, name: events(spark, sf_dir).filter(F.col("event_type") != without).groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.max("value").alias(name))
    both = mode("error", "a").join(mode("view", "b"), ["user_id", "d"], "full")
    a, b = F.col("a"), F.col("b")
    return both.groupBy("user_id").agg(F.count_if(a == b).alias("same"), F.count_if(a != b).alias("different"), F.count_if(b.isNull()).alias("only_a"), F.count_if(a.isNull()).alias("only_b"))


@query(f"""
    WITH {E}, s AS (SELECT user_id, event_type AS state, t // 86400000000 AS day, least(coalesce(lead(t) OVER ({BY_USER}), t), (t // 86400000000 + 1) * 86400000000) - t AS held FROM e)
    SELECT user_id, day, state, CAST(sum(held) AS BIGINT) AS held, count(*) AS events FROM s GROUP BY 1, 2, 3
""")
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in each state of each window (a day), a state lasting until the next event or the window's end."""
    day = F.floor(F.col("t") / DAY)
    held = F.least(F.coalesce(F.lead("t").over(by_user()), F.col("t")), (day + 1) * DAY) - F.col("t")
    return events(spark, sf_dir).select("user_id", day.alias("day"), F.col("event_type").alias("state"), held.alias("held")).groupBy("user_id", "day", "state").agg(F.sum("held").alias("held"), F.count("*").alias("events"))


@query("""
    WITH k(slot, kind) AS (VALUES (0, 'view'), (1, 'click'), (2, 'error')), d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events),
    c AS (SELECT d.user_id, d.day, slot, count(e.event_id) AS n FROM d CROSS JOIN k LEFT JOIN events e ON e.user_id = d.user_id AND date_trunc('day', e.ts) = d.day AND e.event_type = k.kind GROUP BY 1, 2, 3), l AS (SELECT *, lag(n) OVER (PARTITION BY user_id, slot ORDER BY day) AS before FROM c)
    SELECT user_id, epoch_us(day) AS day, slot, n - before AS change FROM l WHERE n <> before
""")
def slot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes in each slot of an array from one row of a key to the next."""
    slots = F.array(*[F.count_if(F.col("event_type") == k) for k in ("view", "click", "error")])
    rows = events(spark, sf_dir).groupBy("user_id", (F.floor(F.col("t") / DAY) * DAY).alias("day")).agg(slots.alias("slots"))
    each = rows.select("user_id", "day", F.posexplode("slots").alias("slot", "n"))
    each = each.withColumn("before", F.lag("n").over(Window.partitionBy("user_id", "slot").orderBy("day")))
    return each.filter("n <> before").select("user_id", "day", "slot", (F.col("n") - F.col("before")).alias("change"))


AFTER = "PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


@query(f"""
    WITH {E}, n AS (SELECT *, min(CASE WHEN event_type = 'click' THEN t END) OVER ({AFTER}) AS click, min(CASE WHEN event_type = 'error' THEN t END) OVER ({AFTER}) AS error FROM e)
    SELECT event_id, CASE WHEN click - t <= 14400000000 THEN 'peek' WHEN coalesce(error - t, 99999999999) > 21600000000 THEN 'info' ELSE 'none' END AS pattern FROM n WHERE event_type = 'view'
""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets by what follows: a click within four hours, or no error within six."""
    after = by_user().rowsBetween(1, Window.unboundedFollowing)
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("t"))).over(after)
    n = events(spark, sf_dir).withColumns({"click": first("click"), "error": first("error")}).filter("event_type = 'view'")
    t = F.col("t")
    return n.select("event_id", F.when(F.col("click") - t <= 4 * HOUR, "peek").when(F.coalesce(F.col("error") - t, F.lit(99_999_999_999)) > 6 * HOUR, "info").otherwise("none").alias("pattern"))


@query(f"""
    WITH {E}, v AS (SELECT *, floor(value / 10) AS v, lead(floor(value / 10)) OVER ({BY_USER}) AS nxt FROM e), s AS (SELECT *, CASE WHEN abs(v - nxt) <= 1 THEN v END AS stable FROM v),
    b AS (SELECT *, last_value(stable IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
    SELECT event_id, before, stable - before AS rise FROM b WHERE stable - before BETWEEN 1 AND 3
""")
def confirmed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises by one to three from the last stable value to a value that the next reading confirms."""
    w = by_user()
    rows = events(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 10).cast("double")).withColumn("next", F.lead("v").over(w))
    rows = rows.withColumn("stable", F.when(F.abs(F.col("v") - F.col("next")) <= 1, F.col("v")))
    rows = rows.withColumn("before", F.last("stable", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rise = F.col("stable") - F.col("before")
    return rows.filter(rise.between(1, 3)).select("event_id", "before", rise.alias("rise"))


@query(f"""
    WITH {E}, v AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS known FROM e), b AS (SELECT *, last_value(known IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
    SELECT event_id, before FROM b WHERE known >= 8 AND before < 4
""")
def resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reading is back at the top after a lower one; unknown readings between don't count."""
    known = F.when(F.col("event_type") != "error", F.col("value"))
    rows = events(spark, sf_dir).withColumn("known", known).withColumn("before", F.last("known", ignorenulls=True).over(by_user().rowsBetween(Window.unboundedPreceding, -1)))
    return rows.filter("known >= 8 AND before < 4").select("event_id", "before")


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN d BETWEEN 40 AND 50 THEN 'attacked' WHEN d < 40 THEN 'early' ELSE 'defended' END AS outcome FROM (SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
""")
def bracket_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome that the time from plant to end allows, within a tolerance."""
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    d = F.datediff("l_shipdate", "o_orderdate")
    return both.select("l_orderkey", "l_linenumber", F.when(d.between(40, 50), "attacked").when(d < 40, "early").otherwise("defended").alias("outcome"))


@query(f"""
    WITH {E}, n AS (SELECT DISTINCT user_id, t // 86400000000 AS day, CAST(floor(value / 4) AS BIGINT) AS number FROM e), k AS (SELECT user_id, day, min(number) AS number FROM n GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT user_id, number, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM k GROUP BY 1, 2
""")
def numbered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by number; days that several numbers claim belong to none of them."""
    n = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.min(F.floor(F.col("value") / 4)).alias("number"), F.max(F.floor(F.col("value") / 4)).alias("other")).filter("number = other")
    return n.groupBy("user_id", "number").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


@query(f"""
    WITH {E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER ({BY_USER}) <= 21600000000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER ({BY_USER}) AS chain FROM g), b AS (SELECT user_id, chain, min(t) AS start, max(CASE WHEN event_type = 'signup' THEN t END) AS prep FROM s GROUP BY 1, 2)
    SELECT s.event_id, coalesce(CASE WHEN prep <= t THEN prep END, start) AS begins FROM s JOIN b USING (user_id, chain) WHERE event_type = 'purchase'
""")
def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from a purchase along its unbroken chain to the last preparation, or to the chain's start."""
    s = temporal.sessionize(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR, "event_id", "chain")
    b = s.groupBy("user_id", "chain").agg(F.min("t").alias("start"), F.max(F.when(F.col("event_type") == "signup", F.col("t"))).alias("prep"))
    return s.filter("event_type = 'purchase'").join(b, ["user_id", "chain"]).select("event_id", F.coalesce(F.when(F.col("prep") <= F.col("t"), F.col("prep")), F.col("start")).alias("begins"))


@query(f"""
    WITH {E}, s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({BY_USER}) AS life FROM e)
    SELECT user_id, life, count(*) - 1 AS run, max(t) - min(t) AS lasted FROM s WHERE life > 0 GROUP BY 1, 2 HAVING count(*) - 1 >= 5
""")
def revive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five rows or more after an error without another."""
    s = events(spark, sf_dir).withColumn("life", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(by_user().rowsBetween(Window.unboundedPreceding, 0)))
    return s.filter("life > 0").groupBy("user_id", "life").agg((F.count("*") - 1).alias("run"), (F.max("t") - F.min("t")).alias("lasted")).filter("run >= 5")


@query(f"""
    WITH {E}, p AS (SELECT *, t - (10 - CAST(floor(value) AS BIGINT)) * 3600000000 AS projected FROM e), n AS (SELECT *, lead(projected) OVER ({BY_USER}) AS nxt FROM p)
    SELECT event_id, projected, coalesce(abs(nxt - projected) <= 21600000000, false) AS confirmed FROM n
""")
def countdown_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start that a countdown reading projects back to, confirmed if the next reading projects near it."""
    rows = events(spark, sf_dir).withColumn("projected", F.col("t") - (10 - F.floor("value")) * HOUR)
    near = F.abs(F.lead("projected").over(by_user()) - F.col("projected")) <= 6 * HOUR
    return rows.select("event_id", "projected", F.coalesce(near, F.lit(False)).alias("confirmed"))


@query(f"""
    WITH {E} SELECT v.event_id FROM e v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error' AND x.user_id = v.user_id AND x.t + 3600000000 >= v.t - 3600000000 AND x.t - 3600000000 <= v.t + 3600000000)
""")
def add_if_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose bracket overlaps no bracket that stands already."""
    side = lambda kind, n: events(spark, sf_dir, kind).select("user_id", F.col("event_id").alias(n), (F.col("t") - HOUR).alias(f"{n}s"), (F.col("t") + HOUR).alias(f"{n}f"))
    added = side("view", "a")
    taken = temporal.overlap_join(added, side("error", "b"), ["user_id"], 4 * HOUR, "as", "af", "bs", "bf").select("a").distinct()
    return added.join(taken, "a", "left_anti").select(F.col("a").alias("event_id"))


@query(f"""
    WITH {E}, w AS (SELECT user_id, event_id, t - 10800000000 AS s, t + 10800000000 AS f FROM e WHERE event_type = 'click'), m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
    g AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS grp FROM m)
    SELECT user_id, min(s) AS s, max(f) AS f, count(*) AS members, min(event_id) AS lead FROM g GROUP BY user_id, grp
""")
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets that overlap, directly or through others, as one group."""
    w = events(spark, sf_dir, "click").select("user_id", "event_id", (F.col("t") - 3 * HOUR).alias("s"), (F.col("t") + 3 * HOUR).alias("f"))
    order = Window.partitionBy("user_id").orderBy("s", "event_id")
    before = F.max("f").over(order.rowsBetween(Window.unboundedPreceding, -1))
    g = temporal.segments(w.withColumn("before", before), ["user_id"], ["s", "event_id"], ~F.coalesce(F.col("s") <= F.col("before"), F.lit(False)), "grp")
    return g.groupBy("user_id", "grp").agg(F.min("s").alias("s"), F.max("f").alias("f"), F.count("*").alias("members"), F.min("event_id").alias("lead")).drop("grp")


@query(f"""
    WITH {E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS k FROM g)
    SELECT user_id, event_type, min(t) AS start, count(*) - 1 AS witnesses FROM s GROUP BY user_id, event_type, k
""")
def folded_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated starts of one kind fold into the first, the others are its witnesses."""
    s = temporal.sessionize(events(spark, sf_dir), ["user_id", "event_type"], "t", DAY, "event_id", "k")
    return s.groupBy("user_id", "event_type", "k").agg(F.min("t").alias("start"), (F.count("*") - 1).alias("witnesses")).drop("k")


@query(f"""
    WITH {E}, d AS (SELECT user_id, t // 86400000000 AS day, list(DISTINCT event_type) AS kinds FROM e GROUP BY 1, 2), n AS (SELECT *, lead(kinds) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d)
    SELECT user_id, day, array_to_string(list_sort(list_intersect(kinds, nxt)), ',') AS shared, len(list_distinct(list_concat(kinds, nxt))) AS either, NOT list_has_any(kinds, nxt) AS crosses FROM n WHERE nxt IS NOT NULL
""")
def membership_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two neighbouring rounds have in common and together, and whether nothing joins them."""
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.collect_set("event_type").alias("kinds"))  # kinds are few
    n = d.withColumn("next", F.lead("kinds").over(Window.partitionBy("user_id").orderBy("day"))).filter(F.col("next").isNotNull())
    return n.select("user_id", "day", F.array_join(F.array_sort(F.array_intersect("kinds", "next")), ",").alias("shared"), F.size(F.array_union("kinds", "next")).cast("long").alias("either"), (~F.arrays_overlap("kinds", "next")).alias("crosses"))


@query(f"""
    WITH {E}, c AS (SELECT *, lag(event_type) OVER ({BY_USER}) AS before FROM e), w AS (SELECT user_id, t - 3600000000 AS s, t + 3600000000 AS f FROM c WHERE event_type <> before),
    m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w), g AS (SELECT *, sum(CASE WHEN s <= b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, f) AS k FROM m),
    u AS (SELECT user_id, min(s) AS s, max(f) AS f FROM g GROUP BY user_id, k), r AS (SELECT *, sum(f - s) OVER (PARTITION BY user_id ORDER BY s) AS spent FROM u)
    SELECT user_id, s, f, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 108000000000
""")
def refinement_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded windows around changes, merged, and taken in order until the budget of thirty hours is spent."""
    changed = events(spark, sf_dir).withColumn("before", F.lag("event_type").over(by_user())).filter("event_type <> before")
    w = changed.select("user_id", (F.col("t") - HOUR).alias("s"), (F.col("t") + HOUR).alias("f"))
    spent = F.sum(F.col("f") - F.col("s")).over(Window.partitionBy("user_id").orderBy("s"))
    return temporal.interval_union(w, ["user_id"], "s", "f").withColumn("spent", spent).filter(F.col("spent") <= 30 * HOUR).select("user_id", "s", "f", "spent")


@query(f"""
    WITH {E}, p AS (SELECT DISTINCT user_id, greatest(t // 3600000000 + o, 0) AS slot FROM e, (VALUES (-2), (-1), (0), (1), (2)) x(o) WHERE event_type = 'error'), g AS (SELECT DISTINCT user_id, (t // 86400000000) * 24 AS slot FROM e)
    SELECT user_id, slot, 'dense' AS plan FROM p UNION ALL SELECT user_id, slot, 'sparse' FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = g.user_id AND p.slot = g.slot)
""")
def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense slots around each trigger, clamped and without repeats, and a sparse grid where none of them is."""
    rows = events(spark, sf_dir)
    dense = rows.filter("event_type = 'error'").select("user_id", F.explode(F.array(*[F.greatest(F.floor(F.col("t") / HOUR) + o, F.lit(0)) for o in range(-2, 3)])).alias("slot")).distinct()
    sparse = rows.select("user_id", (F.floor(F.col("t") / DAY) * 24).alias("slot")).distinct().join(dense, ["user_id", "slot"], "left_anti")
    return dense.withColumn("plan", F.lit("dense")).unionByName(sparse.withColumn("plan", F.lit("sparse")))


@query(f"""
    WITH {E}, b AS (SELECT DISTINCT user_id, t // 1800000000 + o AS slot FROM e, (SELECT unnest(range(-3, 4)) AS o) WHERE event_type = 'signup'), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS total FROM b)
    SELECT user_id, slot FROM n WHERE i % CAST(ceil(total / 40.0) AS BIGINT) = 0
""")
def burst_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts around each trigger, thinned by a stride so that no key has more than forty samples."""
    own = Window.partitionBy("user_id")
    b = events(spark, sf_dir, "signup").select("user_id", F.explode(F.array(*[F.floor(F.col("t") / (HOUR // 2)) + o for o in range(-3, 4)])).alias("slot")).distinct()
    n = b.withColumns({"i": F.row_number().over(own.orderBy("slot")) - 1, "total": F.count("*").over(own)})
    return n.filter(F.col("i") % F.ceil(F.col("total") / 40) == 0).select("user_id", "slot")


@query(f"WITH {E} SELECT user_id, t // 3600000000 AS slot, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS tags FROM e GROUP BY 1, 2")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one time become one with all their tags."""
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("slot")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("tags"))


@query("""
    WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1 ORDER BY first, o_custkey LIMIT 20) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f)
""")
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the first twenty groups in order of intake."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first")).orderBy("first", "o_custkey").limit(20)
    return o.join(F.broadcast(first), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")  # twenty rows


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is used once, by the first that asks."""
    first = F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("b")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(first).select("l_partkey", "b.l_orderkey", "b.l_linenumber")


@query(f"""
    WITH {E}, w AS (SELECT event_id, user_id, t // 3600000000 AS h FROM e WHERE event_type = 'purchase'), x AS (SELECT event_id, user_id, h + o AS slot FROM w, (SELECT unnest(range(0, 4)) AS o)), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, slot) AS n FROM x)
    SELECT event_id, count(*) FILTER (n = 1) AS own, count(*) FILTER (n > 1) AS contested FROM c GROUP BY 1
""")
def overlap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as slots: those that several windows of a key claim belong to none."""
    w = events(spark, sf_dir, "purchase").select("event_id", "user_id", F.explode(F.array(*[F.floor(F.col("t") / HOUR) + o for o in range(4)])).alias("slot"))
    n = F.count("*").over(Window.partitionBy("user_id", "slot"))
    return w.withColumn("n", n).groupBy("event_id").agg(F.count_if(F.col("n") == 1).alias("own"), F.count_if(F.col("n") > 1).alias("contested"))


@query("SELECT o_custkey, epoch_us(o_orderdate) AS at, min(o_orderkey) AS frame FROM orders GROUP BY 1, 2")
def frame_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per key and time."""
    from tallyloom.sources.tables import micros

    return table(spark, sf_dir, "orders").groupBy("o_custkey", micros("o_orderdate").alias("at")).agg(F.min("o_orderkey").alias("frame"))


@query("""
    WITH old AS (SELECT o_orderkey AS id, o_custkey AS grp, CASE WHEN o_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 51 = 0 THEN 1 ELSE 0 END AS grp FROM orders), g AS (SELECT grp, min(split) AS split FROM old GROUP BY 1)
    SELECT n.id, CASE WHEN o.id IS NULL THEN 'registered' WHEN o.grp = n.grp THEN 'known' ELSE 'conflict' END AS outcome, coalesce(g.split, 'unassigned') AS split FROM new n LEFT JOIN old o ON o.id = n.id LEFT JOIN g ON g.grp = n.grp
""")
def idempotent_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering again changes nothing, another content is a conflict, and a group keeps the split that it has."""
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("held"), F.when(F.col("o_custkey") % 4 == 0, "test").otherwise("train").alias("split"))
    new = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 51 == 0, 1).otherwise(0)).alias("grp"))
    groups = old.groupBy(F.col("held").alias("grp")).agg(F.min("split").alias("split"))
    both = new.join(old.select("id", "held"), "id", "left").join(groups, "grp", "left")
    return both.select("id", F.when(F.col("held").isNull(), "registered").when(F.col("held") == F.col("grp"), "known").otherwise("conflict").alias("outcome"), F.coalesce("split", F.lit("unassigned")).alias("split"))
