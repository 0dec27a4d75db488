"""Rules, facts, scopes and contracts: predicates over facts, projections, labelling, text and value resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import temporal
from tallyloom.sources.tables import micros, table

from .catalog import DAY, HOUR, events, query

E = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"


def listed(*values: str) -> Column:
    return F.array(*map(F.lit, values))


@query("""
    WITH p AS (SELECT o.o_orderkey, o.o_orderstatus, list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(DISTINCT l_returnflag), x)) AS missing
        FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_orderkey, CASE WHEN len(missing) = 0 THEN 'scored' ELSE 'unscored' END AS label, array_to_string(missing, ',') AS missing
    FROM p WHERE len(missing) = 0 OR o_orderstatus <> 'F'
""")
def missing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose required facts are missing: dropped where the policy excludes, else kept unscored with the missing keys."""
    present = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("present"))  # three flags
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(present, "o_orderkey")
    rows = rows.withColumn("missing", F.array_except(listed("A", "N", "R"), "present"))
    none = F.size("missing") == 0
    return rows.filter(none | (F.col("o_orderstatus") != "F")).select("o_orderkey", F.when(none, "scored").otherwise("unscored").alias("label"), F.array_join("missing", ",").alias("missing"))


@query("""
    SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER) >= 20, false) AND coalesce(value > 2, false) AND coalesce(event_type IN ('view', 'click', 'purchase'), false) AS passed FROM events
""")
def strict_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conditions must hold; a missing key fails."""
    conditions = [F.get_json_object("props", "$.k").cast("int") >= 20, F.col("value") > 2, F.col("event_type").isin("view", "click", "purchase")]
    passed = F.lit(True)
    for c in conditions:
        passed = passed & F.coalesce(c, F.lit(False))
    return events(spark, sf_dir).select("event_id", passed.alias("passed"))


#: Rules over facts, with operators on numbers, text and lists.
RULES = [("R1", "value", "gt", "5"), ("R2", "value", "lte", "2.5"), ("R3", "kind", "eq", "error"), ("R4", "kind", "in", "view,click"), ("R5", "k", "between", "10,40"), ("R6", "k", "exists", ""), ("R7", "kind", "ne", "signup"), ("R8", "k", "lt", "7")]


@query(f"""
    WITH r(rule, fact, op, arg) AS (VALUES {", ".join(map(str, RULES))}),
    f AS (SELECT event_id, 'value' AS fact, value AS num, CAST(value AS VARCHAR) AS txt FROM events WHERE event_type <> 'signup' UNION ALL SELECT event_id, 'kind', NULL, event_type FROM events
        UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS DOUBLE), '' FROM events WHERE event_id % 3 > 0)
    SELECT i.event_id, r.rule, CASE WHEN op = 'exists' THEN f.event_id IS NOT NULL WHEN f.event_id IS NULL THEN NULL
        WHEN op = 'gt' THEN num > TRY_CAST(arg AS DOUBLE) WHEN op = 'lte' THEN num <= TRY_CAST(arg AS DOUBLE) WHEN op = 'lt' THEN num < TRY_CAST(arg AS DOUBLE)
        WHEN op = 'eq' THEN txt = arg WHEN op = 'ne' THEN txt <> arg WHEN op = 'in' THEN list_contains(string_split(arg, ','), txt)
        WHEN op = 'between' THEN num BETWEEN TRY_CAST(string_split(arg, ',')[1] AS DOUBLE) AND TRY_CAST(string_split(arg, ',')[2] AS DOUBLE) END AS result
    FROM events i, r LEFT JOIN f ON f.event_id = i.event_id AND f.fact = r.fact
""")
def typed_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules over unpivoted facts of several types; the result is null where the fact is unknown."""
    rows = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("double")
    fact = lambda name, num, txt, known: F.when(known, F.struct(F.lit(name).alias("fact"), num.alias("num"), txt.alias("txt")))
    facts = F.array(fact("value", F.col("value"), F.col("value").cast("string"), F.col("event_type") != "signup"), fact("kind", F.lit(None).cast("double"), F.col("event_type"), F.lit(True)), fact("k", k, F.lit(""), F.col("event_id") % 3 > 0))
    rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule", "fact", "op", "arg"), r, strict=True)]) for r in RULES])
    each = rows.select("event_id", F.array_compact(facts).alias("facts"), F.explode(rules).alias("r")).select("event_id", "r.*", F.get(F.filter("facts", lambda x: x["fact"] == F.col("r.fact")), F.lit(0)).alias("f"))
    num, txt, arg = F.col("f.num"), F.col("f.txt"), F.col("arg")
    number, parts = arg.try_cast("double"), F.split(arg, ",")
    op = F.col("op")
    result = F.when(op == "exists", F.col("f").isNotNull()).when(F.col("f").isNull(), F.lit(None)).when(op == "gt", num > number).when(op == "lte", num <= number).when(op == "lt", num < number)
    result = result.when(op == "eq", txt == arg).when(op == "ne", txt != arg).when(op == "in", F.array_contains(parts, txt)).when(op == "between", num.between(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")))
    return each.select("event_id", "rule", result.alias("result"))


@query("SELECT event_id, concat('kind=', event_type, ';value=', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS kept FROM events")
def whitelist_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's fields cut down to those on the list."""
    record = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("value"), F.floor("value").cast("string"), F.lit("user"), F.col("user_id").cast("string"))
    kept = F.map_filter(record, lambda k, v: k.isin("kind", "value") & v.isNotNull())
    return events(spark, sf_dir).select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("kept"))


@query("""
    WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS seen FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.0849 THEN 'accepted' ELSE 'cross-checked' END AS tier FROM c WHERE l_discount >= 0.0849 OR l_discount >= 0.0649 AND seen > 1
""")
def two_tier_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High confidence is taken; middling confidence only if another reading of the same says so too; the rest goes."""
    seen = F.count("*").over(Window.partitionBy("l_orderkey", "l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount").withColumn("seen", seen)
    high, middle = F.col("l_discount") >= 0.0849, (F.col("l_discount") >= 0.0649) & (F.col("seen") > 1)
    return rows.filter(high | middle).select("l_orderkey", "l_linenumber", F.when(high, "accepted").otherwise("cross-checked").alias("tier"))


@query("""
    WITH f AS (SELECT event_id // 4 AS fact_id, count(*) AS cited, bool_or(event_id % 11 = 0) AS dev FROM events GROUP BY 1)
    SELECT fact_id, cited FROM f WHERE NOT dev
""")
def formal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that cite no event of development."""
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("event_id") / 4).alias("fact_id"))
    facts = rows.groupBy("fact_id").agg(F.collect_list("event_id").alias("provenance"))  # four at most
    dev = rows.filter(F.col("event_id") % 11 == 0).select("event_id")
    bad = facts.select("fact_id", F.explode("provenance").alias("event_id")).join(dev, "event_id", "left_semi").select("fact_id")
    return facts.join(bad, "fact_id", "left_anti").select("fact_id", F.size("provenance").cast("long").alias("cited"))


@query("""
    SELECT o_orderkey, bool_and(coalesce(CASE WHEN l_partkey % 29 > 0 THEN l_shipdate END BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY, false)) AS kept
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def facts_inside_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision stays only if every fact it cites lies in its scope; a fact without a time fails."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_partkey") % 29 > 0, F.col("l_shipdate")).alias("at"))
    both = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    inside = F.col("at").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return both.groupBy("o_orderkey").agg(F.bool_and(F.coalesce(inside, F.lit(False))).alias("kept"))


@query(f"""
    WITH {E} SELECT p.event_id FROM e p WHERE event_type = 'purchase'
      AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error' AND x.user_id = p.user_id AND x.t BETWEEN p.t - 21600000000 AND p.t)
""")
def linked_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions without a suppressing event in the six hours before."""
    decisions = events(spark, sf_dir, "purchase").select("event_id", "user_id", (F.col("t") - 6 * HOUR).alias("s"), F.col("t").alias("f"))
    linked = temporal.interval_join(events(spark, sf_dir, "error").select("user_id", "t"), decisions, ["user_id"], "t", "s", "f", 6 * HOUR)
    return decisions.join(linked.select("event_id").distinct(), "event_id", "left_anti").select("event_id")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE 'unknown' END AS state FROM events")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that hold for the own view only are unknown elsewhere."""
    return events(spark, sf_dir).select("event_id", F.when(F.col("event_type").isin("view", "click"), F.floor("value").cast("string")).otherwise("unknown").alias("state"))


@query(f"""
    WITH {E} SELECT user_id, count(*) FILTER (event_type = 'signup') AS own, count(*) FILTER (event_type = 'signup') + 2 AS facts,
      concat_ws(',', string_agg(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), concat('n', count(*)), concat('last', max(t))) AS keys FROM e GROUP BY 1
""")
def enriched_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's own facts with derived ones appended; the input column stays as it is."""
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == "signup", F.col("event_id")))), lambda x: x.cast("string"))
    package = events(spark, sf_dir).groupBy("user_id").agg(ids.alias("own"), F.count("*").alias("n"), F.max("t").alias("last"))
    facts = F.concat("own", F.array(F.concat(F.lit("n"), "n"), F.concat(F.lit("last"), "last")))
    return package.withColumn("facts", facts).select("user_id", F.size("own").cast("long").alias("own"), F.size("facts").cast("long").alias("facts"), F.array_join("facts", ",").alias("keys"))


FIRST = "PARTITION BY user_id, date_trunc('day', ts) ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""
    WITH {E}, w AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER ({FIRST}) AS earlier, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id, date_trunc('day', ts)) AS views FROM e)
    SELECT event_id, CASE WHEN earlier = 0 THEN true WHEN views > 0 THEN false END AS is_first FROM w WHERE event_type = 'purchase'
""")
def first_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a purchase is the day's first: an explicit no needs proof that the day's feed is complete (a view), else unknown."""
    day = Window.partitionBy("user_id", "day")
    before = day.orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    rows = rows.withColumns({"earlier": F.count_if(F.col("event_type") == "purchase").over(before), "views": F.count_if(F.col("event_type") == "view").over(day)})
    return rows.filter(F.col("event_type") == "purchase").select("event_id", F.when(F.col("earlier") == 0, True).when(F.col("views") > 0, False).alias("is_first"))


@query(f"""
    WITH {E} SELECT user_id, t // 86400000000 AS day, string_agg(concat(event_type, ':', event_id), ',' ORDER BY t, event_id) AS timeline, count(*) AS n, arg_min(event_type, t::HUGEINT * 10000000 + event_id) AS opening,
      max(t) - min(t) AS length, round(avg(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END), 6) AS quality FROM e GROUP BY 1, 2
""")
def round_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document per user and day: events in order, opening, length and quality."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    nested = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("events"), F.round(F.avg(F.when(F.col("value") > 1, 1.0).otherwise(0.0)), 6).alias("quality"))
    first, last = F.get("events", F.lit(0)), F.element_at("events", -1)
    timeline = F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["event_type"], x["event_id"].cast("string"))), ",")
    return nested.select("user_id", "day", timeline.alias("timeline"), F.size("events").cast("long").alias("n"), first["event_type"].alias("opening"), (last["t"] - first["t"]).alias("length"), "quality")


@query(f"""
    WITH {E}, s AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN t END) AS signup, min(CASE WHEN event_type = 'purchase' THEN t END) AS purchase, count(*) FILTER (event_type = 'error') AS errors, arg_max(value, t::HUGEINT * 10000000 + event_id) AS last FROM e GROUP BY 1)
    SELECT user_id, unnest(list_filter([CASE WHEN purchase < signup THEN 'bought-before-signup' END, CASE WHEN errors > 10 THEN 'troubled' END, CASE WHEN last > 5 THEN 'strong-finish' WHEN last IS NOT NULL THEN 'weak-finish' END], lambda x: x IS NOT NULL)) AS label FROM s
""")
def contextual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by conditions over the first event of each kind and the last reading."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("t")))
    s = events(spark, sf_dir).groupBy("user_id").agg(first("signup").alias("signup"), first("purchase").alias("purchase"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("value", F.struct("t", "event_id")).alias("last"))
    labels = F.array(F.when(F.col("purchase") < F.col("signup"), "bought-before-signup"), F.when(F.col("errors") > 10, "troubled"), F.when(F.col("last") > 5, "strong-finish").when(F.col("last").isNotNull(), "weak-finish"))
    return s.select("user_id", F.explode(F.array_compact(labels)).alias("label"))


@query("""
    WITH u AS (SELECT DISTINCT user_id FROM events), k(rule) AS (VALUES ('purchase'), ('signup'), ('error')), d AS (SELECT user_id, event_type AS rule, max(value) AS best FROM events GROUP BY 1, 2 HAVING count(*) >= 5)
    SELECT u.user_id, k.rule, CASE WHEN d.user_id IS NULL THEN 'unscored' WHEN best > 5 THEN 'good' ELSE 'improve' END AS label FROM u CROSS JOIN k LEFT JOIN d ON d.user_id = u.user_id AND d.rule = k.rule
""")
def abstain_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user and rule: decided from enough facts, else an explicit unscored row."""
    rows = events(spark, sf_dir, "purchase", "signup", "error")
    decided = rows.groupBy("user_id", F.col("event_type").alias("rule")).agg(F.count("*").alias("n"), F.max("value").alias("best")).filter("n >= 5")
    asked = events(spark, sf_dir).select("user_id").distinct().select("user_id", F.explode(listed("purchase", "signup", "error")).alias("rule"))
    return asked.join(decided, ["user_id", "rule"], "left").select("user_id", "rule", F.when(F.col("n").isNull(), "unscored").when(F.col("best") > 5, "good").otherwise("improve").alias("label"))


@query("""
    SELECT event_id, 'strength' AS field, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS reading, 'known' AS reason FROM events UNION ALL
    SELECT event_id, 'kind', event_type, 'known' FROM events UNION ALL
    SELECT event_id, 'key', CASE WHEN event_id % 4 > 0 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) END, CASE WHEN event_id % 4 > 0 THEN 'known' ELSE 'unavailable' END FROM events
""")
def alias_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings under several names become one row per field, with the reason where one is unavailable."""
    names = F.create_map(*[F.lit(x) for x in ("val", "strength", "evt", "kind", "k", "key")])
    k = F.when(F.col("event_id") % 4 > 0, F.get_json_object("props", "$.k"))
    readings = F.create_map(F.lit("val"), F.floor("value").cast("string"), F.lit("evt"), F.col("event_type"), F.lit("k"), k)
    rows = events(spark, sf_dir).select("event_id", F.explode(readings).alias("name", "reading"))
    return rows.select("event_id", F.element_at(names, F.col("name")).alias("field"), "reading", F.when(F.col("reading").isNull(), "unavailable").otherwise("known").alias("reason"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) AS k, 'unknown' AS zone, 0.0::DOUBLE AS confidence FROM events")
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record whose missing fields take typed unknowns."""
    record = F.from_json("props", "k int, zone string, confidence double")
    return events(spark, sf_dir).select("event_id", record.alias("r")).select("event_id", F.coalesce("r.k", F.lit(-1)).alias("k"), F.coalesce("r.zone", F.lit("unknown")).alias("zone"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))


@query(f"""
    WITH {E}, whole AS (SELECT user_id, bool_or(event_type = 'signup' AND value > 8) AS w FROM e GROUP BY 1)
    SELECT w.user_id, CASE WHEN w THEN NULL ELSE min(t) FILTER (event_type = 'error') - 3600000000 END AS s, CASE WHEN w THEN NULL ELSE max(t) FILTER (event_type = 'error') + 3600000000 END AS f FROM whole w JOIN e USING (user_id) GROUP BY w.user_id, w
""")
def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull of a user's scopes; unknown if any of them is the whole timeline."""
    error = F.col("event_type") == "error"
    g = events(spark, sf_dir).groupBy("user_id").agg(F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 8)).alias("whole"), F.min(F.when(error, F.col("t") - HOUR)).alias("s"), F.max(F.when(error, F.col("t") + HOUR)).alias("f"))
    return g.select("user_id", F.when(~F.col("whole"), F.col("s")).alias("s"), F.when(~F.col("whole"), F.col("f")).alias("f"))


@query("""
    SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' THEN '[redacted]' ELSE left(regexp_replace(coalesce(text, ''), '[0-9]+', '#', 'g'), 200) END, '|' ORDER BY turn, role, text)) AS content FROM conversations GROUP BY 1
""")
def deep_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested turns: whole values go by the name of their key, digits by pattern, long text is cut at the cap."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    clean = lambda x: F.when(x["role"] == "system", "[redacted]").otherwise(F.left(F.regexp_replace(F.coalesce(x["text"], F.lit("")), "[0-9]+", "#"), F.lit(200)))
    return turns.select("conv_id", F.md5(F.array_join(F.transform("turns", clean), "|")).alias("content"))


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'bad' ELSE concat(l_linenumber, '-', CAST(l_quantity AS INTEGER)) END AS txt FROM lineitem),
    p AS (SELECT *, TRY_CAST(regexp_extract(txt, '^([0-9]+)-([0-9]+)$', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(txt, '^([0-9]+)-([0-9]+)$', 2) AS INTEGER) AS b FROM x)
    SELECT l_orderkey, l_linenumber, CASE WHEN a <= b THEN a END AS range_start, CASE WHEN a <= b THEN b END AS range_end FROM p
""")
def range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of a written range; unknown if it is none or runs backwards."""
    text = F.when(F.col("l_linenumber") % 3 == 0, "bad").otherwise(F.concat_ws("-", "l_linenumber", F.col("l_quantity").cast("int")))
    part = lambda i: F.regexp_extract("txt", "^([0-9]+)-([0-9]+)$", i).try_cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("txt")).select("l_orderkey", "l_linenumber", part(1).alias("a"), part(2).alias("b"))
    ok = F.col("a") <= F.col("b")
    return rows.select("l_orderkey", "l_linenumber", F.when(ok, F.col("a")).alias("range_start"), F.when(ok, F.col("b")).alias("range_end"))


@query("SELECT c_custkey, length(trim(c_name)) BETWEEN 1 AND 200 AS named, regexp_matches(c_name, '^[A-Za-z][A-Za-z0-9_.#-]{0,40}$') AS safe, regexp_matches(sha256(c_name), '^[0-9a-f]{64}$') AND c_custkey % 2 = 0 AS hashed FROM customer")
def valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which identifiers keep the rules on length, signs and digests."""
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.length(F.trim(name)).between(1, 200).alias("named"), name.rlike("^[A-Za-z][A-Za-z0-9_.#-]{0,40}$").alias("safe"), (F.sha2(name, 256).rlike("^[0-9a-f]{64}$") & (F.col("c_custkey") % 2 == 0)).alias("hashed"))


@query("""
    WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1, 2)
    SELECT user_id, epoch_us(day) AS day, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(a - b) <= 2 THEN greatest(a, b) END AS resolved, CASE WHEN a IS NULL AND b IS NULL THEN 'unknown' WHEN a IS NULL OR b IS NULL THEN 'single' WHEN abs(a - b) <= 2 THEN 'agreed' ELSE 'conflict' END AS status FROM s
""")
def two_source_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value from two sources: an unknown contradicts nothing, a conflict resolves to nothing."""
    best = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    s = events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(best("view").alias("a"), best("click").alias("b"))
    a, b = F.col("a"), F.col("b")
    near = F.abs(a - b) <= 2
    resolved = F.when(a.isNull(), b).when(b.isNull(), a).when(near, F.greatest(a, b))
    status = F.when(a.isNull() & b.isNull(), "unknown").when(a.isNull() | b.isNull(), "single").when(near, "agreed").otherwise("conflict")
    return s.select("user_id", micros("day").alias("day"), resolved.alias("resolved"), status.alias("status"))


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS core, l_discount * 100 AS b, l_tax * 100 AS a FROM lineitem),
    s AS (SELECT *, CASE WHEN a + b > 0 THEN least(1.0, greatest(50 - core, 0) / (a + b)) ELSE 1.0 END AS f FROM c)
    SELECT l_orderkey, l_linenumber, round(b * f, 6) AS before, round(a * f, 6) AS after, round(core + (a + b) * f, 6) AS length FROM s
""")
def clip_capping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead and tail of a clip shrink in proportion until it fits the cap; the core stays."""
    b, a, core = F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", core.alias("core"), b.alias("b"), a.alias("a"))
    c = c.withColumn("f", F.when(F.col("a") + F.col("b") > 0, F.least(F.lit(1.0), F.greatest(F.lit(50.0) - F.col("core"), F.lit(0.0)) / (F.col("a") + F.col("b")))).otherwise(1.0))
    return c.select("l_orderkey", "l_linenumber", F.round(F.expr("b * f"), 6).alias("before"), F.round(F.expr("a * f"), 6).alias("after"), F.round(F.expr("core + (a + b) * f"), 6).alias("length"))


@query("SELECT l_orderkey, l_linenumber, l_partkey * 1001 * 1000000 // 30000 AS micros FROM lineitem")
def rational_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a rational time base (1001 / 30000 of a second) in whole microseconds, without rounding errors."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey * 1001L * 1000000L div 30000L").alias("micros"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'screen' WHEN 'click' THEN 'screen' WHEN 'purchase' THEN 'shop' ELSE 'other' END AS family FROM events")
def source_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family that a source's alias belongs to."""
    families = F.create_map(*[F.lit(x) for x in ("view", "screen", "click", "screen", "purchase", "shop")])
    return events(spark, sf_dir).select("event_id", F.coalesce(F.try_element_at(families, F.col("event_type")), F.lit("other")).alias("family"))


@query("""
    WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, count(DISTINCT event_type) FILTER (value > 3) AS kinds, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, epoch_us(day) AS day, CASE WHEN kinds = 1 THEN 'known' WHEN kinds > 1 THEN 'conflicting' WHEN n < 2 THEN 'not_observed' ELSE 'unresolved' END AS reason FROM s
""")
def unknown_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a day's value is known or not."""
    s = events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.countDistinct(F.when(F.col("value") > 3, F.col("event_type"))).alias("kinds"), F.count("*").alias("n"))
    return s.select("user_id", micros("day").alias("day"), F.when(F.col("kinds") == 1, "known").when(F.col("kinds") > 1, "conflicting").when(F.col("n") < 2, "not_observed").otherwise("unresolved").alias("reason"))


@query(f"""
    WITH {E}, f AS (SELECT user_id, event_type, min(t::HUGEINT * 10000000 + event_id) AS first FROM e GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM f GROUP BY 1
""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of each user without repeats, in the order of their first event."""
    first = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct("t", "event_id")).alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("""
    SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'F' THEN 'returned-open' END, CASE WHEN l_discount > 0.08 AND l_quantity > 45 THEN 'discount-on-bulk' END, CASE WHEN l_extendedprice < l_quantity * 900 THEN 'price-too-low' END], lambda x: x IS NOT NULL)) AS violation FROM lineitem
""")
def reading_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across the fields of one reading; a row for each that is broken."""
    c = F.col
    broken = F.array(F.when((c("l_returnflag") == "R") & (c("l_linestatus") != "F"), "returned-open"), F.when((c("l_discount") > 0.08) & (c("l_quantity") > 45), "discount-on-bulk"), F.when(c("l_extendedprice") < c("l_quantity") * 900, "price-too-low"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array_compact(broken)).alias("violation"))


@query(f"""
    WITH {E}, s AS (SELECT user_id, min(t) FILTER (event_type = 'signup') AS signup, min(t) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'click') AS clicks, count(DISTINCT t // 86400000000) AS days, max(t) // 86400000000 - min(t) // 86400000000 + 1 AS span FROM e GROUP BY 1)
    SELECT user_id, 'order' AS assertion, coalesce(signup < purchase, false) AS holds FROM s UNION ALL SELECT user_id, 'clicks', clicks >= 5 FROM s UNION ALL SELECT user_id, 'coverage', days >= 0.5 * span FROM s
    UNION ALL SELECT s.user_id, 'no-error-after-signup', NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND event_type = 'error' AND t BETWEEN signup AND signup + 86400000000) FROM s
""")
def trace_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions on each user's trace: order, counts, coverage, and what must not happen."""
    rows = events(spark, sf_dir)
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("t")))
    day = F.floor(F.col("t") / DAY)
    signup = F.min(F.when(F.col("event_type") == "signup", F.col("t"))).over(Window.partitionBy("user_id"))
    bad = (F.col("event_type") == "error") & F.col("t").between(F.col("at"), F.col("at") + DAY)
    s = rows.withColumn("at", signup).groupBy("user_id").agg(first("signup").alias("signup"), first("purchase").alias("purchase"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.countDistinct(day).alias("days"), (F.max(day) - F.min(day) + 1).alias("span"), F.count_if(bad).alias("bad"))
    checks = {"order": F.coalesce(F.col("signup") < F.col("purchase"), F.lit(False)), "clicks": F.col("clicks") >= 5, "coverage": F.col("days") >= 0.5 * F.col("span"), "no-error-after-signup": F.col("bad") == 0}
    return s.select("user_id", F.explode(F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)])).alias("assertion", "holds"))


@query(f"""
    WITH {E}, core AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1), w AS (SELECT c.user_id, a, b, greatest(t - 7200000000, a) AS s, least(t + 7200000000, b) AS f FROM e JOIN core c USING (user_id) WHERE event_type = 'error'),
    m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
    SELECT user_id, round(sum(greatest(f - greatest(s, coalesce(before, s)), 0)) / greatest(max(b) - max(a), 1), 6) AS ratio FROM m GROUP BY 1
""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each user's core that the union of its windows, clipped to the core, covers."""
    rows = events(spark, sf_dir)
    core = rows.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = rows.filter(F.col("event_type") == "error").join(core, "user_id").select("user_id", F.greatest(F.col("t") - 2 * HOUR, "a").alias("s"), F.least(F.col("t") + 2 * HOUR, "b").alias("f"))
    covered = temporal.coverage(w, ["user_id"], "s", "f").join(core, "user_id")
    return covered.select("user_id", F.round(F.col("covered") / F.greatest(F.col("b") - F.col("a"), F.lit(1)), 6).alias("ratio"))


@query("""
    WITH g AS (SELECT l_linestatus AS grp, unnest([0.0, 0.1, 0.2, 0.3]) AS q, unnest(quantile_cont(l_discount, [0.0, 0.1, 0.2, 0.3])) AS margin FROM lineitem GROUP BY 1),
    s AS (SELECT grp, q, margin, avg(CASE WHEN l_discount < margin THEN 1.0 ELSE 0.0 END) AS abstained, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) FILTER (l_discount >= margin) AS accuracy FROM g JOIN lineitem ON l_linestatus = grp GROUP BY 1, 2, 3)
    SELECT grp, round(margin, 6) AS margin, round(accuracy, 6) AS accuracy, round(abstained, 6) AS abstained FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(accuracy, 9) DESC, q) AS k FROM s WHERE abstained <= 0.25) WHERE k = 1
""")
def margin_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of margins on a grid of quantiles the one with the best accuracy whose abstentions keep within the budget of a quarter."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), "l_discount", (F.col("l_returnflag") == "N").alias("right"))
    at = [0.0, 0.1, 0.2, 0.3]
    grid = rows.groupBy("grp").agg(F.percentile("l_discount", at).alias("m")).select("grp", F.posexplode("m").alias("q", "margin"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    s = rows.join(F.broadcast(grid), "grp").groupBy("grp", "q", "margin").agg(F.avg(one(F.col("l_discount") < F.col("margin"))).alias("abstained"), F.avg(F.when(F.col("l_discount") >= F.col("margin"), one(F.col("right")))).alias("accuracy"))  # two groups
    best = s.filter("abstained <= 0.25").groupBy("grp").agg(F.max(F.struct(F.round("accuracy", 9).alias("a"), (-F.col("q")).alias("q"), "margin", "accuracy", "abstained")).alias("b"))
    return best.select("grp", *[F.round(f"b.{c}", 6).alias(c) for c in ("margin", "accuracy", "abstained")])
