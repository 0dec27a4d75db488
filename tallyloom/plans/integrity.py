"""Lineage, splits, journals, text, spatial, sampling and small-learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import lineage, ml, sampling, sets, spatial, temporal
from tallyloom.sources.tables import append_usage, delete_cascade, table

from .catalog import DAY, HOUR, events, query

BUCKET = "CAST(CAST('0x' || substr(sha256('split-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"
SPLIT = f"s AS (SELECT doc_id, source, text, CASE WHEN {BUCKET} < 0.8 THEN 'train' WHEN {BUCKET} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM documents)"


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their split by hash."""
    split = lineage.split_of(T.hash_bucket("split-1", F.col("doc_id")), [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", split.alias("split"))


@query(f"WITH {SPLIT} SELECT doc_id, split FROM s")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for each document that depends on its id alone."""
    return split_documents(spark, sf_dir).select("doc_id", "split")


@query(f"WITH {SPLIT} SELECT source, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_immutability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents fall in several splits."""
    return lineage.split_violations(split_documents(spark, sf_dir), "source", "split")


@query(f"WITH {SPLIT} SELECT doc_id FROM s WHERE split = 'train' AND text IN (SELECT text FROM s WHERE split <> 'train' AND text IS NOT NULL)")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents whose text stands in another split; only digests are shuffled."""
    rows = split_documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", "split", F.sha2("text", 256).alias("digest"))
    held = rows.filter("split <> 'train'").select("digest").distinct()
    return rows.filter("split = 'train'").join(held, "digest", "left_semi").select("doc_id")


@query("SELECT min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand several times; counts per digest are combined before the shuffle."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest"))
    return rows.agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("digest")


@query(r"""
    WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark),
    l AS (SELECT token FROM t WHERE length(token) >= 12),
    d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
    SELECT doc_id, count(*) AS tokens FROM d JOIN l USING (token) GROUP BY 1
""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold private tokens (long benchmark words): a join on words that are distinct within each document."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    private = table(spark, sf_dir, "benchmark").select(F.explode(words("text")).alias("token")).distinct().filter("length(token) >= 12")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(words("text"), lambda w: F.length(w) >= 12)).alias("token"))
    return rows.join(private, "token").groupBy("doc_id").agg(F.count("*").alias("tokens"))


EDGES = """
    SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
"""


@query(f"WITH RECURSIVE e AS ({EDGES}), p AS (SELECT child, parent AS ancestor FROM e UNION SELECT p.child, e.parent FROM p JOIN e ON p.ancestor = e.child) SELECT * FROM p")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and nations with everything they descend from."""

    def edge(name: str, child: str, parent: str, a: str, b: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), child).alias("child"), F.concat(F.lit(b), parent).alias("parent"))

    edges = edge("orders", "o_orderkey", "o_custkey", "o", "c").unionByName(edge("customer", "c_custkey", "c_nationkey", "c", "n")).unionByName(edge("nation", "n_nationkey", "n_regionkey", "n", "r"))
    return lineage.closure(edges)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that producer R hasn't processed."""
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("producer"))
    return lineage.unprocessed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", "R")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS entries FROM events GROUP BY 1")
def journal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each user."""
    return lineage.latest_state(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


@query("""
    WITH j AS (SELECT *, lag(event_id) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id FROM j WHERE before IS NOT NULL AND event_id % 97 = 0
""")
def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal rows whose stored hash isn't that of the line before; every 97th event's hash is broken on purpose."""
    line = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"), F.row_number().over(order).alias("seq"))
    before = F.sha2(F.lag("line").over(order), 256)
    rows = rows.withColumn("prev", F.when(F.col("event_id") % 97 == 0, F.lit("broken")).otherwise(before))
    return lineage.chain_breaks(rows, ["user_id"], "seq", "prev", "line").select("event_id")


@query(r"""
    SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '(sk|pk)-[A-Za-z0-9_-]{8,}', '<key>', 'g'), '(?i)bearer [A-Za-z0-9._-]+', 'bearer <token>', 'g'),
      '(?i)(password|secret|token|api_key)[ ]*[=:][ ]*"?[A-Za-z0-9_./+-]+"?', '\1=<secret>', 'g'),
      '[A-Za-z]:\\[A-Za-z0-9_.\\-]+', '<path>', 'g'), '/(home|Users|root|tmp|var)/[A-Za-z0-9_./-]+', '<path>', 'g') AS redacted
    FROM conversations
""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns without keys, tokens and paths."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.redact_secrets(F.col("text")).alias("redacted"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[\x{FEFF}\x20\x09\x0D\x0A]*[=+@-]') THEN '''' || text ELSE text END AS guarded FROM documents")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a spreadsheet can't take for a formula."""
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_guard(F.col("text")).alias("guarded"))


@query("""
    SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages
""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of escaped pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_escape(F.col("html")), 256).alias("digest"))


@query(r"""
    SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS name_key, trim(regexp_replace(lower(p_type), '[\x20\x09-\x0D]+', ' ', 'g')) AS label_key,
      replace(replace(replace(p_brand, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM part
""")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and label keys, and text escaped for LIKE."""
    return table(spark, sf_dir, "part").select("p_partkey", T.name_key(F.col("p_name")).alias("name_key"), T.label_key(F.col("p_type")).alias("label_key"), T.like_escape(F.col("p_brand")).alias("escaped"))


@query(r"""
    WITH a AS (SELECT regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS k, min(p_partkey) AS entity FROM part GROUP BY 1)
    SELECT p_partkey, entity FROM part JOIN a ON regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') = k
""")
def name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the entity that has their normalised name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", T.name_key(F.col("p_name")).alias("k"))
    return rows.join(rows.groupBy("k").agg(F.min("p_partkey").alias("entity")), "k").select("p_partkey", "entity")


ZONES = [("low", 0.0, 900.0, 15.0, 1000.0), ("mid", 10.0, 950.0, 30.0, 1100.0), ("high", 35.0, 900.0, 51.0, 1200.0)]


@query("""
    WITH z(zone, x0, y0, x1, y1) AS (VALUES ('low', 0.0, 900.0, 15.0, 1000.0), ('mid', 10.0, 950.0, 30.0, 1100.0), ('high', 35.0, 900.0, 51.0, 1200.0)),
    h AS (SELECT p_partkey, count(zone) AS n, min(zone) AS zone FROM part
      LEFT JOIN z ON p_size - x0 > 0.5 AND x1 - p_size > 0.5 AND p_retailprice - y0 > 0.5 AND y1 - p_retailprice > 0.5 GROUP BY 1)
    SELECT p_partkey, CASE WHEN n = 1 THEN zone END AS zone FROM h
""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only zone that holds each part (size, price) farther than 0.5 from its boundary."""
    zones = [(n, [(a, b), (c, b), (c, d), (a, d)]) for n, a, b, c, d in ZONES]
    rings = spark.createDataFrame(zones, "zone string, ring array<struct<x:double,y:double>>")
    points = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return spatial.locate(points, rings, 25.0, 0.5).select("p_partkey", "zone")


ANCHORS = "a AS (SELECT n_nationkey AS anchor, n_nationkey * 2.0 AS ax, 900 + n_nationkey * 10.0 AS ay FROM nation)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("anchor"), (n * 2.0).alias("ax"), (n * 10.0 + 900).alias("ay"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"""
    WITH {ANCHORS}, d AS (SELECT p_partkey, anchor FROM part, a WHERE (p_size - ax) * (p_size - ax) + (p_retailprice - ay) * (p_retailprice - ay) <= 64)
    SELECT p_partkey, min(anchor) AS anchor FROM d GROUP BY 1 HAVING count(*) = 1
""")
def radius_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with exactly one anchor within a radius of 8."""
    return spatial.unique_anchor(part_points(spark, sf_dir), anchors(spark, sf_dir), "p_partkey", 8.0)


@query(f"""
    WITH {ANCHORS}, d AS (SELECT p_partkey, anchor, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_size - ax) * (p_size - ax) + (p_retailprice - ay) * (p_retailprice - ay), anchor) AS n FROM part, a)
    SELECT p_partkey, list(anchor ORDER BY n) AS nearest FROM d WHERE n <= 3 GROUP BY 1
""")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest anchors of each part."""
    return spatial.nearest_anchors(part_points(spark, sf_dir), anchors(spark, sf_dir), 3).select("p_partkey", "nearest")


PREDICT = """
    WITH x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
    l AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) AS len FROM x GROUP BY 1),
    u AS (SELECT vec_id, label, i, v / len AS v FROM x JOIN l USING (vec_id)),
    c AS (SELECT label, i, sum(v) AS v FROM u GROUP BY 1, 2),
    n AS (SELECT label, greatest(sqrt(sum(v * v)), 1e-12) AS len FROM c GROUP BY 1),
    p AS (SELECT c.label, i, v / len AS v FROM c JOIN n USING (label)),
    s AS (SELECT vec_id, p.label, sum(u.v * p.v) AS s FROM u JOIN p USING (i) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS next FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, label))
    SELECT vec_id, CASE WHEN s - next >= {margin} THEN label END AS predicted FROM r WHERE n = 1
"""


def predicted(spark: SparkSession, sf_dir: str, margin: float) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ml.predict_with_margin(rows, ml.prototypes(rows, "label", "embedding"), "vec_id", "label", "embedding", margin)


@query(PREDICT.format(margin=0))
def prototype_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose prototype has the highest cosine."""
    return predicted(spark, sf_dir, 0.0)


@query(PREDICT.format(margin=0.02))
def margin_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but nothing where the runner-up is nearer than 0.02."""
    return predicted(spark, sf_dir, 0.02)


@query("""
    WITH s AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b, median(least(1.0, value / 200)) AS median FROM events GROUP BY 1),
    d AS (SELECT user_id, count(DISTINCT epoch_us(ts) // 86400000000) AS days FROM events GROUP BY 1)
    SELECT user_id, median, days / CAST(b // 86400000000 - a // 86400000000 + 1 AS DOUBLE) AS share,
      median * (days / CAST(b // 86400000000 - a // 86400000000 + 1 AS DOUBLE)) AS quality FROM s JOIN d USING (user_id)
""")
def observation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median confidence of each user times the share of days with readings."""
    day = F.floor(F.col("t") / DAY).cast("long")
    rows = events(spark, sf_dir).select("user_id", F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"), day.alias("day"))
    span = rows.groupBy("user_id").agg(F.countDistinct("day").alias("covered"), (F.max("day") - F.min("day") + 1).alias("span"))
    return sampling.quality(rows.join(span, "user_id"), ["user_id"], "confidence", "covered", "span").select("user_id", "median", "share", "quality")


@query("""
    WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    p AS (SELECT DISTINCT user_id, round_even(k * ((n - 1) / 11.0), 0) AS i FROM (SELECT DISTINCT user_id, n FROM r WHERE n > 12), range(12) g(k))
    SELECT event_id FROM r JOIN p ON r.user_id = p.user_id AND r.i = p.i UNION ALL SELECT event_id FROM r WHERE n <= 12
""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve evenly spaced events of each user."""
    return sampling.evenly_spaced(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 12).select("event_id")


@query("""
    SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1, 2
""")
def stratified_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event with the highest value of every user and day."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    return sampling.stratum_picks(rows, ["user_id"], F.col("day"), F.desc("value"), F.col("event_id")).select("user_id", "day", "event_id")


@query("""
    WITH u AS (SELECT user_id, epoch_us(ts) - 10800000000 AS s, epoch_us(ts) + 10800000000 AS f FROM events WHERE event_type = 'error')
    SELECT DISTINCT user_id, CAST(unnest(generate_series(CAST(ceil(s / 3600000000.0) AS BIGINT), f // 3600000000)) * 3600000000 AS BIGINT) AS t FROM u
""")
def grid_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole hours within three hours of each error, once per user."""
    windows = events(spark, sf_dir, "error").select("user_id", (F.col("t") - 3 * HOUR).alias("s"), (F.col("t") + 3 * HOUR).alias("f"))
    return sampling.time_grid(windows, ["user_id"], "s", "f", HOUR, "t")


@query("""
    SELECT 'customer' AS kind, c_custkey AS id, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 2
    UNION ALL SELECT 'order', o_orderkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 2
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation go, and their orders with them."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    kept, theirs = delete_cascade(customers, customers.filter("c_nationkey = 3"), "custkey", orders)
    a = kept.groupBy(F.col("custkey").alias("id")).agg(F.count("*").alias("n")).select(F.lit("customer").alias("kind"), "id", "n")
    return a.unionByName(theirs.groupBy(F.col("o_orderkey").alias("id")).agg(F.count("*").alias("n")).select(F.lit("order").alias("kind"), "id", "n"))


@query("SELECT event_id, substr(event_type, 1, 4) AS event_type, greatest(0, user_id - 5) AS counter FROM events")
def usage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows with short texts and counters that aren't negative."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") - 5).alias("counter"))
    return append_usage(rows, {"event_type": 4}, ["counter"])


@query("""
    SELECT l_orderkey, substr(sha256(string_agg(CAST(s AS VARCHAR), chr(10) ORDER BY CAST(s AS VARCHAR))), 1, 16) AS fingerprint
    FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY 1
""")
def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each order's set of suppliers that no order of rows changes."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sets.fingerprint(F.col("l_suppkey").cast("string")).alias("fingerprint"))


@query("""
    WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT l_returnflag, l_linestatus, a.n AS stored, coalesce(b.n, 0) AS live, a.n = coalesce(b.n, 0) AS agrees FROM a LEFT JOIN b USING (l_returnflag, l_linestatus)
""")
def two_view_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label totals of lines as stored, and of lines whose order exists: both views of one join and one count."""
    known = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    g = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("stored"), F.count("o_orderkey").alias("live"))
    return g.withColumn("agrees", F.col("stored") == F.col("live"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN 'unresolved' WHEN l_discount > 0.08 AND o_orderstatus = 'O' THEN 'above_source' ELSE 'ok' END AS state
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""")
def reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line's order exists and allows its confidence."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    state = F.when(F.col("o_orderkey").isNull(), "unresolved").when((F.col("l_discount") > 0.08) & (F.col("o_orderstatus") == "O"), "above_source").otherwise("ok")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"))


@query("""
    WITH e AS (SELECT *, epoch_us(ts) AS t FROM events),
    b AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 21600000000 OR event_type = 'error' THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM b)
    SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(t) AS "start", max(t) AS "end" FROM s GROUP BY 1, 2
""")
def continuity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each user's events that six idle hours or an error break."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    gap = F.lag("t").over(order)
    rows = events(spark, sf_dir).withColumn("breaks", gap.isNull() | (F.col("t") - gap > 6 * HOUR) | (F.col("event_type") == "error"))
    cut = temporal.segments(rows, ["user_id"], ["t", "event_id"], F.col("breaks"))
    return cut.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))
