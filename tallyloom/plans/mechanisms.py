"""Folds that retract, time out, compose and settle; graphs, neighbours, picks, caps, journals and swaps, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import admission, components, engine, fixpoint, nearest, picks, retract, timers, transducer
from tallyloom.sources import swap
from tallyloom.sources.tables import scratch_path, table

from .catalog import DAY, HOUR, events, query
from .timeline import LATCH, E


@query(LATCH)
def retracted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from a twice confirmed signup to the next purchase, from rows that came shuffled in three batches."""
    fold = retract.RetractingFold(scratch_path(spark), ["user_id"], "t", "event_id", ["t", "event_type"], transducer.latch("signup", "purchase", 2), 5 * DAY, "start long, end long")
    rows = events(spark, sf_dir)
    batch = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in range(3):
        fold.arrive(rows.filter(batch == k), k)
    return fold.result(spark)


ENCOUNTERS = {"lost": 12 * HOUR, "quiet": DAY, "burst": 18 * HOUR, "again": 3 * DAY, "hold": 2 * DAY}


def machine() -> timers.TimedMachine:
    return timers.encounters("view", "click", "signup", "purchase", "error", **ENCOUNTERS)


@query()
def encounter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presences, bursts, engagements and holds of each user, with what falls due between rows."""
    return timers.timed_fold(events(spark, sf_dir), ["user_id"], "t", "event_id", ["event_type"], machine(), "user_id long, what string, since long, at long, n long")


@query(f"""
    WITH {E}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS gap FROM e WHERE event_type IN ('view', 'click')),
    r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > CASE event_type WHEN 'view' THEN 43200000000 ELSE 64800000000 END THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS run FROM g),
    s AS (SELECT user_id, event_type, min(t) AS a, max(t) AS b, count(*) AS n FROM r GROUP BY user_id, event_type, run)
    SELECT user_id, 'spotted' AS what, a AS since, a AS at, CAST(NULL AS BIGINT) AS n FROM s WHERE event_type = 'view'
    UNION ALL SELECT user_id, 'lost', b, b + 43200000000, NULL FROM s WHERE event_type = 'view'
    UNION ALL SELECT user_id, 'burst', a, b, n FROM s WHERE event_type = 'click'
""")
def presences_and_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same machine over sightings and shots alone: presences that end half a day after the last sighting, and bursts."""
    rows = timers.timed_fold(events(spark, sf_dir, "view", "click"), ["user_id"], "t", "event_id", ["event_type"], machine(), "user_id long, what string, since long, at long, n long")
    return rows.filter(F.col("what").isin("spotted", "lost", "burst"))


def near_label(window: Window) -> dict[str, Column]:
    """An unknown label takes that of the row behind it, if that is at most a day away."""
    close = F.abs(F.col("t") - F.lag("t").over(window)) <= DAY
    return {"label": F.coalesce("label", F.when(close, F.lag("label").over(window)))}


@query(f"""
    WITH {E}, l AS (SELECT user_id, event_id, t, CASE WHEN value > 60 THEN event_type END AS label, CASE WHEN t - lag(t) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM l),
    d AS (SELECT *, last_value(label IGNORE NULLS) OVER a AS before, i - max(CASE WHEN label IS NOT NULL THEN i END) OVER a AS db,
        first_value(label IGNORE NULLS) OVER z AS after, min(CASE WHEN label IS NOT NULL THEN i END) OVER z - i AS da FROM s
        WINDOW a AS (PARTITION BY user_id, run ORDER BY i), z AS (PARTITION BY user_id, run ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, CASE WHEN da IS NULL OR db <= da THEN before ELSE after END AS label FROM d
""")
def settled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown labels filled from the nearest known one of their day-long chain, by passes in both directions until nothing changes."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", F.when(F.col("value") > 60, F.col("event_type")).alias("label"))
    return fixpoint.to_fixpoint(rows, ["user_id"], ["t", "event_id"], ["label"], [near_label], 1000).rows.select("event_id", "label")


CHAINS = f"""
    WITH {E}, g AS (SELECT *, t - lag(t) OVER w <= 21600000000 AS tied FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    r AS (SELECT *, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM g),
    c AS (SELECT event_id AS node, t, min(event_id) OVER (PARTITION BY user_id, run) AS component, count(*) OVER (PARTITION BY user_id, run) AS n FROM r)
"""


def six_hour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one user's consecutive events at most six hours apart."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).withColumn("a", F.lag("event_id").over(order)).withColumn("gap", F.col("t") - F.lag("t").over(order))
    return rows.filter(F.col("gap") <= 6 * HOUR).select("a", F.col("event_id").alias("b"))


@query(f"{CHAINS} SELECT node, component FROM c WHERE n > 1")
def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of events that follow each other within six hours."""
    return components.components(six_hour_edges(spark, sf_dir), "a", "b")


@query(f"{CHAINS} SELECT component, count(*) AS nodes, max(t) - min(t) AS longest FROM c WHERE n > 1 GROUP BY component")
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and the longest time span of a chain in each component."""
    return components.longest_chains(six_hour_edges(spark, sf_dir), "a", "b", events(spark, sf_dir), "event_id", "t")


SHOPS = "a AS (SELECT s_suppkey AS anchor, n_name AS label, s_nationkey * 2.0 AS ax, 900 + s_acctbal / 10 AS ay FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as anchors with their nation as label."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("anchor"), F.col("n_name").alias("label"), (F.col("s_nationkey") * 2.0).alias("ax"), (900 + F.col("s_acctbal") / 10).alias("ay"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"""
    WITH {SHOPS}, d AS (SELECT p_partkey, anchor, (p_size - ax) * (p_size - ax) + (p_retailprice - ay) * (p_retailprice - ay) AS d FROM part, a),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY d, anchor) AS INTEGER) AS rank FROM d)
    SELECT p_partkey, anchor, sqrt(d) AS distance, rank FROM r WHERE rank <= 5
""")
def nearest_by_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest suppliers of each part, by cells that grow until they must hold them."""
    return nearest.nearest(parts(spark, sf_dir), shops(spark, sf_dir), "p_partkey", 5, 4.0)


@query(f"""
    WITH {SHOPS}, d AS (SELECT p_partkey, label, sqrt(min((p_size - ax) * (p_size - ax) + (p_retailprice - ay) * (p_retailprice - ay))) AS d FROM part, a GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS next FROM d WINDOW w AS (PARTITION BY p_partkey ORDER BY d, label))
    SELECT p_partkey, CASE WHEN d + 0.5 <= 12 AND (next IS NULL OR next - d > 1.0) THEN label END AS label FROM r WHERE n = 1
""")
def unique_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of the nearest supplier, where it lies well within the radius and no other nation is about as near."""
    return nearest.unique_nearest(parts(spark, sf_dir), shops(spark, sf_dir), "p_partkey", 12.0, 0.5).select("p_partkey", "label")


@query()
def farthest_first_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight customers of each nation, as far apart in balance as they can be."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return picks.farthest_first(rows, ["c_nationkey"], "c_custkey", ["c_acctbal"], 8)


@query()
def balanced_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events of each user: one for each stretch of the user's time, errors before others, the rest where the gaps are widest."""
    whole = Window.partitionBy("user_id")
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", F.min("t").over(whole).alias("a"), F.max("t").over(whole).alias("b"), rank.alias("rank"))
    return picks.balanced(rows, ["user_id"], "event_id", "t", "a", "b", "rank", 6).select("user_id", "event_id", "place")


@query()
def representative_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve orders that differ in status, priority and customer."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / DAY).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("score"), "o_orderstatus", F.col("o_custkey").alias("cluster"), "o_orderpriority", F.array("o_orderstatus", "o_orderpriority").alias("codes"), day.alias("a"), (day + 30).alias("b"))
    return picks.representatives(rows, "o_orderkey", "score", "o_orderstatus", "cluster", "o_orderpriority", "codes", "a", "b", 12)


@query(f"""
    WITH {E}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id, t // 86400000000, event_type ORDER BY t, event_id) AS n FROM e),
    x AS (SELECT *, CASE WHEN n <= 1 THEN row_number() OVER (PARTITION BY user_id, event_type, n <= 1 ORDER BY t, event_id) END AS m FROM d),
    y AS (SELECT *, coalesce(m <= 12 AND row_number() OVER (PARTITION BY user_id, m <= 12 ORDER BY t, event_id) <= 40, false) AS admitted FROM x),
    z AS (SELECT *, coalesce(sum(CAST(admitted AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mine,
        coalesce(sum(CAST(admitted AS INT)) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kinds FROM y)
    SELECT user_id, event_id, admitted, CASE WHEN NOT admitted THEN CASE WHEN mine >= 40 THEN 'user' WHEN kinds >= 12 THEN 'kind' ELSE 'kind a day' END END AS reason FROM z
""")
def reserved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events admitted under three running caps: forty of a user, twelve of a kind, one of a kind a day."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    caps = [admission.Cap("user", [], 40), admission.Cap("kind", ["event_type"], 12), admission.Cap("kind a day", ["event_type", "day"], 1)]
    return admission.reservations(rows, ["user_id"], ["t", "event_id"], "event_id", "event_id", caps, "user_id long")


@query()
def catalog_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a journal of sources and artifacts: the final state, and what broke an invariant."""
    k = F.get_json_object("props", "$.k").cast("int")
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    name = F.concat(F.lit("s"), (k % 12).cast("string"))
    source = F.struct(name.alias("id"), (k % 17).cast("string").alias("sha"), (k % 5).alias("unit"), F.element_at(F.array(F.lit("train"), F.lit("test")), k % 2 + 1).alias("split"))
    artifact = F.struct(F.concat(F.lit("a"), k.cast("string")).alias("id"), F.array(name).alias("parents"), F.array(k % 5).alias("units"), F.lit("clip").alias("kind"))
    kind = F.when(F.row_number().over(order) == 1, "init").when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "click", "learning_split").when(F.col("event_type") == "purchase", "artifact").when(F.col("event_type") == "view", "exposure").otherwise("status")
    data = F.when(F.col("event_type") == "purchase", F.to_json(artifact)).otherwise(F.to_json(source))
    rows = events(spark, sf_dir).select("user_id", F.row_number().over(order).cast("long").alias("seq"), kind.alias("kind"), data.alias("data"))
    return admission.journal(rows, ["user_id"], "seq", "kind", "data", admission.catalog(["train", "test"], ["train", "test"], ["clip"]), "user_id long")


@query("""
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 1000
""")
def staged_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in partitions by status: one is replaced; a replacement that takes another's rows is refused and changes nothing."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = swap.SwapTable(spark, scratch_path(spark), "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderstatus"], "o_orderkey")
    rules = {"price": F.col("o_totalprice") >= 0}
    kept.replace(rows, rules=rules)
    finished = rows.filter("o_orderstatus = 'F'")
    try:
        kept.replace(rows.filter("o_orderstatus <> 'F'").withColumn("o_orderstatus", F.lit("F")), finished.select("o_orderstatus"), rules=rules)
    except swap.Refused:
        kept.replace(finished.filter("o_totalprice > 1000").withColumn("o_totalprice", F.col("o_totalprice") * 2), finished.select("o_orderstatus"), rules=rules)
    return kept.read()


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as readings of a display: half a second a row, a longer pause after each idle day."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events(spark, sf_dir).withColumn("n", F.row_number().over(order)).withColumn("k", k)
    rows = rows.withColumn("pause", F.sum(F.when(F.col("t") - F.lag("t").over(order) > 2 * DAY, 1).otherwise(0)).over(order))
    kind, n = F.col("event_type"), F.col("n")
    menu = kind == "signup"
    slot = F.struct((F.col("k") % 4).cast("int").alias("slot"), (F.col("k") > 50).alias("available"), (F.col("k") % 3).cast("int").alias("charges"), F.lit(0.9).alias("confidence"), F.lit("slot").alias("name"))
    fell = F.struct(F.lit(5).alias("a_before"), F.when(F.col("k") % 2 == 0, 4).otherwise(5).alias("a_after"), F.lit(5).alias("b_before"), F.when(F.col("k") % 3 == 0, 4).otherwise(5).alias("b_after"), (F.col("k") % 5 > 0).alias("color"), F.lit(None).cast("boolean").alias("normal"), F.lit("tool").alias("label"), F.lit(0.9).alias("confidence"), F.lit(None).cast("double").alias("pair_confidence"))
    columns = {
        "t": n * 0.5 + F.col("pause") * 10.0, "view": F.when(menu, "menu").otherwise("live"), "confidence": F.least(F.lit(1.0), 0.6 + F.col("value") / 50), "phase": menu & (F.col("k") > 30), "buying": menu,
        "end_banner": kind == "error", "timer_gone": kind == "error", "timer": F.when(menu, 5.0).otherwise(80.0 - (n % 7)), "score_a": F.floor(n / 12), "score_b": F.lit(0).cast("long"),
        "planted": F.when(kind == "click", "planted").otherwise("none"), "plant_timer": F.col("k") > 20, "slots": F.array(slot), "own": F.lit(True), "report": kind == "purchase", "away": F.col("k") % 2 == 1,
        "trusted": F.lit(True), "stable": F.lit(True), "before_play": menu, "effect": F.when(kind == "view", F.concat(F.lit("e"), (F.col("k") % 2).cast("string"))), "effect_from": F.lit("enemy"), "effect_checked": F.lit(True),
        "added": F.when(kind == "click", F.array(fell)),
    }
    return rows.select("user_id", "event_id", *[c.alias(name) for name, c in columns.items()])


@query()
def direct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, ends, preparations, deaths, episodes, slots and added rows of the readings, from one fold; attributes as JSON."""
    facts = engine.accepted(engine.direct_facts(readings(spark, sf_dir), ["user_id"], "event_id", "user_id long"))
    return facts.withColumn("attributes", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes")))))
