"""From candidates to facts: holds, gates, brackets and extensions over ordered rows; gated projections; decision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import fold, temporal
from tallyloom.sources.tables import table

from .catalog import DAY, HOUR, events, query
from .rounds import BY_USER, E, by_user

BEFORE = f"{BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def rows_before() -> Window:
    return by_user().rowsBetween(Window.unboundedPreceding, -1)


@query(f"""
    WITH {E}, l AS (SELECT event_id, t, event_type IN ('view', 'purchase') AS f, lag(event_type IN ('view', 'purchase')) OVER w AS before, lag(t) OVER w AS since,
      lead(event_type IN ('view', 'purchase')) OVER w AS n1, lead(event_type IN ('view', 'purchase'), 2) OVER w AS n2 FROM e WINDOW w AS ({BY_USER}))
    SELECT event_id, f AS up, t - since AS bracket FROM l WHERE f <> before AND n1 = f AND n2 = f AND t - since <= {DAY}
""")
def held_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of a flag that the next two rows keep, with the bracket they happened in, a day at most."""
    rows = events(spark, sf_dir).withColumn("up", F.col("event_type").isin("view", "purchase"))
    w = by_user()
    rows = rows.select("event_id", "up", F.lag("up").over(w).alias("was"), (F.col("t") - F.lag("t").over(w)).alias("bracket"), F.lead("up").over(w).alias("n1"), F.lead("up", 2).over(w).alias("n2"))
    return rows.filter(f"up <> was AND n1 = up AND n2 = up AND bracket <= {DAY}").select("event_id", "up", "bracket")


@query(f"""
    WITH {E}, g AS (SELECT *, CASE WHEN event_type = 'signup' OR t - lag(t) OVER ({BY_USER}) > {12 * HOUR} THEN 1 ELSE 0 END AS b FROM e), s AS (SELECT *, sum(b) OVER ({BY_USER}) AS seg FROM g),
    m AS (SELECT *, max(t) OVER (PARTITION BY user_id, seg) AS tail FROM s)
    SELECT event_id, t AS was, tail FROM m WHERE event_type = 'purchase'
""")
def tail_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An end moves on over rows at most twelve hours apart, up to the first barrier."""
    rows = events(spark, sf_dir)
    rows = rows.withColumn("step", F.col("t") - F.lag("t").over(by_user()))
    rows = temporal.segments(rows, ["user_id"], ["t", "event_id"], (F.col("event_type") == "signup") | (F.col("step") > 12 * HOUR))
    rows = rows.withColumn("tail", F.max("t").over(Window.partitionBy("user_id", "segment")))
    return rows.filter("event_type = 'purchase'").select("event_id", F.col("t").alias("was"), "tail")


@query(f"""
    WITH {E}, l AS (SELECT *, lag(event_type) OVER w AS phase, t - lag(t) OVER w AS bracket FROM e WINDOW w AS ({BY_USER})),
    g AS (SELECT *, bracket <= {DAY} AS in_bracket, phase IN ('view', 'error') AS in_phase, value >= 5 AS numbered FROM l WHERE event_type = 'click')
    SELECT user_id, t // {DAY} AS day, count(*) AS candidates, count(*) FILTER (in_bracket AND in_phase AND numbered) AS passed,
      CASE WHEN max(t) FILTER (in_bracket AND in_phase AND numbered) - min(t) FILTER (in_bracket AND in_phase AND numbered) <= {HOUR} THEN min(event_id) FILTER (in_bracket AND in_phase AND numbered) END AS promoted FROM g GROUP BY 1, 2
""")
def gated_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates pass the gates of bracket, phase and number; those of a day promote one row, none if they compete (over an hour apart)."""
    w = by_user()
    rows = events(spark, sf_dir).withColumns({"phase": F.lag("event_type").over(w), "bracket": F.col("t") - F.lag("t").over(w)}).filter("event_type = 'click'")
    passed = (F.col("bracket") <= DAY) & F.col("phase").isin("view", "error") & (F.col("value") >= 5)
    own = lambda c: F.when(passed, F.col(c))
    spread = F.max(own("t")) - F.min(own("t"))
    return rows.groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("candidates"), F.count_if(passed).alias("passed"), F.when(spread <= HOUR, F.min(own("event_id"))).alias("promoted"))


@query(f"""
    WITH {E}, l AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER ({BEFORE}) AS state, last_value(CASE WHEN event_type <> 'error' THEN t END IGNORE NULLS) OVER ({BEFORE}) AS since FROM e),
    p AS (SELECT user_id, t // {3 * DAY} AS part, event_id, since FROM l WHERE event_type = 'purchase' AND state = 'view')
    SELECT user_id, part, count(*) AS pairs, CASE WHEN count(*) = 1 THEN min(event_id) END AS event_id, CASE WHEN count(*) = 1 THEN min(since) END AS since FROM p GROUP BY 1, 2
""")
def observed_state_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the last row of one state to the first of another with only undecided rows between; taken if it is the span's only pair."""
    known = F.col("event_type") != "error"
    last = lambda c: F.last(F.when(known, F.col(c)), ignorenulls=True).over(rows_before())
    pairs = events(spark, sf_dir).withColumns({"state": last("event_type"), "since": last("t")}).filter("event_type = 'purchase' AND state = 'view'")
    only = lambda c: F.when(F.count("*") == 1, F.min(c)).alias(c)
    return pairs.groupBy("user_id", F.floor(F.col("t") / (3 * DAY)).alias("part")).agg(F.count("*").alias("pairs"), only("event_id"), only("since"))


@query(f"""
    WITH {E}, c AS (SELECT *, bool_or(event_type IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING) AS backed FROM e),
    p AS (SELECT *, lag(t) OVER ({BY_USER}) AS last FROM c WHERE event_type = 'purchase' AND backed)
    SELECT event_id, user_id, t FROM p WHERE last IS NULL OR t - last > {12 * HOUR}
""")
def corroborated_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with corroborating rows within six hours; one that follows another within twelve hours is its repetition."""
    near = Window.partitionBy("user_id").orderBy("t").rangeBetween(-6 * HOUR, 6 * HOUR)
    backed = events(spark, sf_dir).withColumn("backed", F.bool_or(F.col("event_type").isin("error", "view")).over(near)).filter("event_type = 'purchase' AND backed")
    return temporal.repeat_suppressed(backed, ["user_id"], "t", "event_id", 12 * HOUR).select("event_id", "user_id", "t")


@query(f"""
    WITH {E}, w AS (SELECT *, count(CASE WHEN event_type = 'error' THEN 1 END) OVER f AS drops, max(CASE WHEN event_type = 'error' THEN t END) OVER f AS dropped_at, bool_or(event_type = 'view') OVER f AS backed FROM e
      WINDOW f AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING))
    SELECT event_id, t AS last_live, dropped_at FROM w WHERE event_type = 'signup' AND drops = 1 AND backed
""")
def recovered_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last live row, with exactly one drop in the day after it and a row that backs it."""
    after = Window.partitionBy("user_id").orderBy("t").rangeBetween(1, DAY)
    drop = F.col("event_type") == "error"
    rows = events(spark, sf_dir).withColumns({"drops": F.count(F.when(drop, 1)).over(after), "dropped_at": F.max(F.when(drop, F.col("t"))).over(after), "backed": F.bool_or(F.col("event_type") == "view").over(after)})
    return rows.filter("event_type = 'signup' AND drops = 1 AND backed").select("event_id", F.col("t").alias("last_live"), "dropped_at")


@query(f"""
    WITH {E}, l AS (SELECT *, value >= lag(value) OVER w AS won, lag(value) OVER w >= lag(value, 2) OVER w AS won_before, lag(value) OVER w AS carry FROM e WINDOW w AS ({BY_USER}))
    SELECT event_id, CASE WHEN carry IS NOT NULL THEN least(9000, floor(carry) * 100 + CASE WHEN won THEN 3000 WHEN won_before OR won_before IS NULL THEN 1900 ELSE 2400 END) END AS bound FROM l
""")
def economic_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that a balance can be after a row: what was there and the award that the chain of scores allows; unknown on the first row."""
    w = by_user()
    carry, older = F.lag("value").over(w), F.lag("value", 2).over(w)
    rows = events(spark, sf_dir).select("event_id", carry.alias("carry"), (F.col("value") >= carry).alias("won"), (carry >= older).alias("won_before"))
    award = F.when(F.col("won"), 3000).when(F.coalesce("won_before", F.lit(True)), 1900).otherwise(2400)
    return rows.select("event_id", F.when(F.col("carry").isNotNull(), F.least(F.lit(9000.0), F.floor("carry") * 100.0 + award)).alias("bound"))


@query(f"""
    WITH {E}, g AS (SELECT *, CASE WHEN event_type = 'error' OR t - lag(t) OVER ({BY_USER}) > {DAY} THEN 1 ELSE 0 END AS b FROM e), s AS (SELECT *, sum(b) OVER ({BY_USER}) AS seg FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY t, event_id) AS i FROM s WHERE event_type <> 'error'),
    m AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id, seg) - 2 AS lo, max(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id, seg) AS hi FROM p)
    SELECT event_id, user_id, CAST(seg AS BIGINT) AS run FROM m WHERE i BETWEEN lo AND hi
""")
def run_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs end at missing rows and pauses; each starts two rows at most before its first selected row and ends at the last."""
    rows = events(spark, sf_dir)
    rows = rows.withColumn("step", F.col("t") - F.lag("t").over(by_user()))
    rows = temporal.segments(rows, ["user_id"], ["t", "event_id"], (F.col("event_type") == "error") | (F.col("step") > DAY), "run").filter("event_type <> 'error'")
    own = Window.partitionBy("user_id", "run")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy("t", "event_id")))
    selected = F.when(F.col("event_type") == "purchase", F.col("i"))
    return rows.withColumns({"lo": F.min(selected).over(own) - 2, "hi": F.max(selected).over(own)}).filter("i BETWEEN lo AND hi").select("event_id", "user_id", "run")


@query(f"""
    WITH {E}, l AS (SELECT event_id AS a, lead(event_id) OVER w AS b, event_type = lead(event_type) OVER w AS same, lead(t) OVER w - t AS step, floor(lead(value) OVER w / 5) - floor(value / 5) AS more FROM e WINDOW w AS ({BY_USER}))
    SELECT a, b FROM l WHERE same AND step <= {DAY} AND more BETWEEN 0 AND 1
""")
def consecutive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between rows in a row: close in time, of the same anchor, support the same or one more."""
    w = by_user()
    level = F.floor(F.col("value") / 5)
    rows = events(spark, sf_dir).withColumn("level", level)
    ahead = lambda c: F.lead(c).over(w)
    return rows.select(F.col("event_id").alias("a"), ahead("event_id").alias("b"), (ahead("event_type") == F.col("event_type")).alias("same"), (ahead("t") - F.col("t")).alias("step"), (ahead("level") - F.col("level")).alias("more")).filter(f"same AND step <= {DAY} AND more BETWEEN 0 AND 1").select("a", "b")


@query(f"""
    WITH {E}, s AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER ({BY_USER}) AS seg FROM e),
    m AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY t, event_id) AS memory FROM s),
    c AS (SELECT *, lag(t) OVER ({BY_USER}) AS last FROM m WHERE event_type = 'view' AND memory IS NOT NULL)
    SELECT event_id, t - memory AS since FROM c WHERE last IS NULL OR t - last > {6 * HOUR}
""")
def onset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that remember a preparation since the last reset; of starts within six hours of each other the first."""
    rows = temporal.segments(events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "purchase", "part")
    own = Window.partitionBy("user_id", "part").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("memory", F.last(F.when(F.col("event_type") == "signup", F.col("t")), ignorenulls=True).over(own)).filter("event_type = 'view' AND memory IS NOT NULL")
    return temporal.repeat_suppressed(rows, ["user_id"], "t", "event_id", 6 * HOUR).select("event_id", (F.col("t") - F.col("memory")).alias("since"))


@query(f"""
    WITH {E}, s AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER ({BEFORE}) AS seg FROM e)
    SELECT user_id, seg, min(CASE WHEN event_type = 'view' THEN t END) AS start, count(CASE WHEN event_type = 'view' THEN 1 END) AS seconds FROM s GROUP BY 1, 2 HAVING count(CASE WHEN event_type = 'view' THEN 1 END) >= 3
""")
def phase_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of a phase before each start, if at least three were seen."""
    phase = F.col("event_type") == "view"
    rows = events(spark, sf_dir).withColumn("seg", F.count(F.when(F.col("event_type") == "purchase", 1)).over(rows_before()))
    return rows.groupBy("user_id", "seg").agg(F.min(F.when(phase, F.col("t"))).alias("start"), F.count_if(phase).alias("seconds")).filter("seconds >= 3")


@query(f"""
    WITH {E}, c AS (SELECT *, CASE event_type WHEN 'view' THEN 'pre' WHEN 'error' THEN 'pre' WHEN 'click' THEN 'post' ELSE event_type END AS cls FROM e), b AS (SELECT *, CASE WHEN cls = lag(cls) OVER ({BY_USER}) THEN 0 ELSE 1 END AS b FROM c),
    r AS (SELECT *, sum(b) OVER ({BY_USER}) AS run FROM b), x AS (SELECT *, min(t) OVER (PARTITION BY user_id, run) AS first, max(t) OVER (PARTITION BY user_id, run) AS last FROM r),
    w AS (SELECT *, CASE WHEN lag(cls) OVER w = 'pre' THEN lag(first) OVER w ELSE t END AS lo, CASE WHEN lead(cls) OVER w = 'post' THEN lead(last) OVER w ELSE t END AS hi FROM x WINDOW w AS ({BY_USER})),
    n AS (SELECT *, coalesce(lead(lo) OVER ({BY_USER}) - hi < {HOUR}, false) AS conflict FROM w WHERE event_type = 'purchase')
    SELECT event_id, CASE WHEN NOT conflict THEN lo END AS lo, CASE WHEN NOT conflict THEN hi END AS hi, conflict FROM n
""")
def window_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window grows back over preparing or undecided rows and on over ended ones; abstains where the next begins within an hour of its end."""
    w = by_user()
    kind = F.col("event_type")
    rows = events(spark, sf_dir).withColumn("cls", F.when(kind.isin("view", "error"), "pre").when(kind == "click", "post").otherwise(kind))
    rows = rows.withColumn("new", ~F.coalesce(F.col("cls") == F.lag("cls").over(w), F.lit(False)))
    rows = temporal.segments(rows, ["user_id"], ["t", "event_id"], F.col("new"), "run")
    own = Window.partitionBy("user_id", "run")
    rows = rows.withColumns({"first": F.min("t").over(own), "last": F.max("t").over(own)})
    lo = F.when(F.lag("cls").over(w) == "pre", F.lag("first").over(w)).otherwise(F.col("t"))
    hi = F.when(F.lead("cls").over(w) == "post", F.lead("last").over(w)).otherwise(F.col("t"))
    rows = rows.withColumns({"lo": lo, "hi": hi}).filter("event_type = 'purchase'")
    rows = rows.withColumn("conflict", F.coalesce(F.lead("lo").over(w) - F.col("hi") < HOUR, F.lit(False)))
    free = lambda c: F.when(~F.col("conflict"), F.col(c)).alias(c)
    return rows.select("event_id", free("lo"), free("hi"), "conflict")


@query(f"""
    WITH {E}, l AS (SELECT *, CAST(floor(value / 10) AS BIGINT) AS v FROM e), s AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM l WINDOW w AS ({BY_USER}))
    SELECT event_id, CASE WHEN v = before OR v = after THEN v END AS stable, CASE WHEN v > before AND coalesce(after < v, true) THEN before WHEN v = before OR v = after THEN v END AS accepted FROM s
""")
def stable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading is stable if a neighbour agrees; a rise that the next row doesn't keep gives way to the value before."""
    w = by_user()
    rows = events(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 10))
    rows = rows.withColumns({"was": F.lag("v").over(w), "then": F.lead("v").over(w)})
    stable = (F.col("v") == F.col("was")) | (F.col("v") == F.col("then"))
    fleeting = (F.col("v") > F.col("was")) & F.coalesce(F.col("then") < F.col("v"), F.lit(True))
    return rows.select("event_id", F.when(stable, F.col("v")).alias("stable"), F.when(fleeting, F.col("was")).when(stable, F.col("v")).alias("accepted"))


@query(f"""
    WITH {E} SELECT user_id, t // {DAY} AS day, count(*) AS sightings, CASE WHEN count(DISTINCT event_type) = 1 AND (count(*) >= 2 OR max(value) >= 45) THEN min(event_type) END AS side FROM e WHERE event_type IN ('view', 'click') GROUP BY 1, 2
""")
def side_from_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that two sightings, or a sure one, name without another's objection."""
    kinds = F.countDistinct("event_type")
    sure = (F.count("*") >= 2) | (F.max("value") >= 45)
    return events(spark, sf_dir, "view", "click").groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("sightings"), F.when((kinds == 1) & sure, F.min("event_type")).alias("side"))


@query(f"""
    WITH {E}, d AS (SELECT user_id, t // {DAY} AS day, bool_and(event_type <> 'purchase') AS unplanted, max(t % {DAY}) >= {12 * HOUR} AS expired, count(DISTINCT event_type) >= 2 AS both_there, floor(max(value) / 10) AS score FROM e GROUP BY 1, 2)
    SELECT user_id, day, CASE WHEN lead(score) OVER w > score THEN 'up' WHEN lead(score) OVER w < score THEN 'down' END AS winner, unplanted AND expired AND both_there AND coalesce(lead(score) OVER w <> score, false) AS timeout FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)
""")
def timeout_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds that ended by time: nothing planted, the clock run out, both sides there and the next score another."""
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(
        F.bool_and(F.col("event_type") != "purchase").alias("unplanted"), (F.max(F.col("t") % DAY) >= 12 * HOUR).alias("expired"), (F.countDistinct("event_type") >= 2).alias("both"), F.floor(F.max("value") / 10).alias("score")
    )
    d = d.withColumn("next", F.lead("score").over(Window.partitionBy("user_id").orderBy("day")))
    moved = F.coalesce(F.col("next") != F.col("score"), F.lit(False))
    return d.select("user_id", "day", F.expr("CASE WHEN next > score THEN 'up' WHEN next < score THEN 'down' END").alias("winner"), (F.col("unplanted") & F.col("expired") & F.col("both") & moved).alias("timeout"))


@query(f"""
    WITH {E} SELECT user_id, t // {HOUR} AS hour, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) FILTER (event_type = 'click') AS shots, max(value) FILTER (event_type = 'view') AS reading FROM e GROUP BY 1, 2
""")
def additions_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added rows merged into bins: which kinds, how many of one, the largest reading of another."""
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.count_if(kind == "click").alias("shots"), F.max(F.when(kind == "view", F.col("value"))).alias("reading"))


@query(f"""
    WITH {E}, b AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER p AS pt, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER p AS pv,
      first_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER f AS ft, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER f AS fv FROM e
      WINDOW p AS ({BEFORE}), f AS ({BY_USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT event_id, coalesce(ft - pt <= {3 * DAY} AND floor(pv / 10) = floor(fv / 10), false) AS retired FROM b WHERE event_type = 'signup'
""")
def retired_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts inside a bracket of two rows of the same level are retired; they stay, marked."""
    anchor = F.when(F.col("event_type") == "purchase", F.struct("t", F.floor(F.col("value") / 10).alias("v")))
    after = by_user().rowsBetween(1, Window.unboundedFollowing)
    rows = events(spark, sf_dir).withColumns({"p": F.last(anchor, ignorenulls=True).over(rows_before()), "f": F.first(anchor, ignorenulls=True).over(after)}).filter("event_type = 'signup'")
    return rows.select("event_id", F.expr(f"coalesce(f.t - p.t <= {3 * DAY} AND p.v = f.v, false)").alias("retired"))


@query(f"""
    WITH {E}, l AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER ({BEFORE}) AS state, last_value(CASE WHEN event_type <> 'error' THEN t END IGNORE NULLS) OVER ({BEFORE}) AS since, lag(t) OVER ({BY_USER}) AS previous FROM e)
    SELECT event_id, CASE WHEN since < t THEN since END AS lo, t AS hi, since < previous AS moved FROM l WHERE event_type <> 'error' AND event_type <> state
""")
def edge_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower bound of each edge moves back to the last row that was decided; an edge without width is open below."""
    known = F.col("event_type") != "error"
    last = lambda c: F.last(F.when(known, F.col(c)), ignorenulls=True).over(rows_before())
    rows = events(spark, sf_dir).withColumns({"state": last("event_type"), "since": last("t"), "previous": F.lag("t").over(by_user())}).filter(known & (F.col("event_type") != F.col("state")))
    return rows.select("event_id", F.expr("CASE WHEN since < t THEN since END").alias("lo"), F.col("t").alias("hi"), (F.col("since") < F.col("previous")).alias("moved"))


@query(f"""
    WITH {E}, r AS (SELECT *, lag(event_type) OVER w AS was, CASE WHEN lag(event_type) OVER w = lead(event_type) OVER w THEN lag(event_type) OVER w ELSE event_type END AS revised FROM e WINDOW w AS ({BY_USER})),
    l AS (SELECT *, lag(revised) OVER ({BY_USER}) AS now FROM r)
    SELECT event_id, now AS before, revised AS after, now = revised AS archived FROM l WHERE was <> event_type
""")
def stale_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a revision of states: `before` is written anew, edges whose ends no longer differ are archived."""
    w = by_user()
    was, then = F.lag("event_type").over(w), F.lead("event_type").over(w)
    rows = events(spark, sf_dir).withColumns({"was": was, "after": F.when(was == then, was).otherwise(F.col("event_type"))})
    rows = rows.withColumn("before", F.lag("after").over(w)).filter("was <> event_type")
    return rows.select("event_id", "before", "after", (F.col("before") == F.col("after")).alias("archived"))


@query("""
    SELECT l_partkey, l_shipdate, count(DISTINCT l_suppkey) AS suppliers, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN max(l_quantity) - min(l_quantity) <= 5 THEN max(l_quantity) END AS quantity FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1
""")
def same_key_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of several suppliers under one key become one row; a field is known where they agree."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_shipdate").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.min("l_returnflag").alias("flag"), F.max("l_returnflag").alias("other"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("quantity"))
    return g.filter("suppliers > 1").select("l_partkey", "l_shipdate", "suppliers", F.expr("CASE WHEN flag = other THEN flag END").alias("flag"), F.expr("CASE WHEN quantity - least <= 5 THEN quantity END").alias("quantity"))


@query(f"""
    WITH {E}, g AS (SELECT *, floor(value) AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM e),
    d AS (SELECT *, row_number() OVER (PARTITION BY user_id, t // {HOUR}, v ORDER BY event_id) AS i FROM g WHERE k BETWEEN 50 AND 99 AND v BETWEEN 1 AND 100)
    SELECT event_id, CAST(v AS BIGINT) AS v, concat_ws('-', user_id, row_number() OVER ({BY_USER})) AS fact_id FROM d WHERE i = 1
""")
def gated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of enough confidence and a whole number in range, one for each bin and value, numbered by key."""
    rows = events(spark, sf_dir).withColumns({"v": F.floor("value"), "k": F.get_json_object("props", "$.k").cast("double")}).filter("k BETWEEN 50 AND 99 AND v BETWEEN 1 AND 100")
    first = Window.partitionBy("user_id", F.floor(F.col("t") / HOUR), "v").orderBy("event_id")
    rows = rows.withColumn("i", F.row_number().over(first)).filter("i = 1")
    return rows.select("event_id", "v", F.concat_ws("-", "user_id", F.row_number().over(by_user())).alias("fact_id"))


@query(f"""
    WITH {E} SELECT event_id, t, CASE WHEN event_type <> 'error' THEN user_id END AS owner, CASE WHEN event_type <> 'error' THEN value END AS own_value, json_extract_string(props, '$.k') AS shared, event_type = 'error' AS partial FROM e
""")
def partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a trusted owner keep what all share; the owner's fields are unknown."""
    own = F.when(F.col("event_type") != "error", F.struct(F.col("user_id").alias("owner"), F.col("value").alias("own_value")))
    return events(spark, sf_dir).withColumn("own", own).select("event_id", "t", "own.owner", "own.own_value", F.get_json_object("props", "$.k").alias("shared"), (F.col("event_type") == "error").alias("partial"))


@query(f"""
    WITH {E}, w AS (SELECT user_id, min(t) AS lo, min(t) + {3 * DAY} AS hi FROM e GROUP BY 1), i AS (SELECT e.* FROM e JOIN w USING (user_id) WHERE t >= lo AND t < hi),
    n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS n FROM i WHERE event_type <> 'error'), u AS (SELECT user_id, count(*) AS unsupported FROM i WHERE event_type = 'error' GROUP BY 1)
    SELECT concat_ws(':', n.user_id, event_type, n) AS id, event_id, coalesce(unsupported, 0) AS unsupported FROM n LEFT JOIN u ON u.user_id = n.user_id
""")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a half-open window under ids that follow from their key; kinds without support are counted beside them."""
    own = Window.partitionBy("user_id")
    inside = events(spark, sf_dir).withColumn("lo", F.min("t").over(own)).filter(F.col("t") < F.col("lo") + 3 * DAY)
    inside = inside.withColumn("unsupported", F.count(F.when(F.col("event_type") == "error", 1)).over(own)).filter("event_type <> 'error'")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id"))
    return inside.select(F.concat_ws(":", "user_id", "event_type", n).alias("id"), "event_id", "unsupported")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS i FROM lineitem)
    SELECT o_custkey AS match_id, o_orderkey AS round_id, l_linenumber, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE l_returnflag END AS label, o_orderstatus <> 'O' AS rewritten FROM l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' OR i = 1
""")
def authority_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids come from the parent; where it has decided, its label replaces the row's own and repeated rows go."""
    parent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("round_id"), "o_orderstatus")
    i = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("round_id"), "l_linenumber", "l_returnflag", i.alias("i"))
    decided = F.col("o_orderstatus") != "O"
    rows = lines.join(parent, "round_id").filter(~decided | (F.col("i") == 1))
    return rows.select("match_id", "round_id", "l_linenumber", F.when(decided, F.col("o_orderstatus")).otherwise(F.col("l_returnflag")).alias("label"), decided.alias("rewritten"))


@query(f"""
    WITH {E}, l AS (SELECT *, lead(event_type) OVER ({BY_USER}) AS following FROM e)
    SELECT event_id, CASE WHEN value >= 30 THEN event_type WHEN value >= 10 AND following = event_type THEN event_type END AS fact, CASE WHEN value >= 30 THEN 'accepted' WHEN value >= 10 AND following = event_type THEN 'confirmed' WHEN value >= 10 THEN 'unconfirmed' ELSE 'low' END AS reason FROM l
""")
def semantic_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact is read where its confidence is enough, or lower but confirmed by the next reading; else unknown with the reason."""
    rows = events(spark, sf_dir).withColumn("following", F.lead("event_type").over(by_user()))
    sure, likely = F.col("value") >= 30, F.col("value") >= 10
    again = F.coalesce(F.col("following") == F.col("event_type"), F.lit(False))
    reason = F.when(sure, "accepted").when(likely & again, "confirmed").when(likely, "unconfirmed").otherwise("low")
    return rows.select("event_id", F.when(sure | (likely & again), F.col("event_type")).alias("fact"), reason.alias("reason"))


@query("""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity > 10)
    SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_returnflag IN ('A', 'N') THEN 'quantity=' || q END, CASE WHEN l_returnflag IN ('R', 'N') THEN 'status=' || l_linestatus END) AS attrs FROM a
""")
def whitelisted_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keep those of their attributes that their kind allows."""
    attrs = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"), F.lit("status"), F.col("l_linestatus"))
    # Attributes by kind.
    allowed = F.when(F.col("l_returnflag") == "A", F.array(F.lit("quantity"))).when(F.col("l_returnflag") == "R", F.array(F.lit("status"))).otherwise(F.array(F.lit("quantity"), F.lit("status")))
    kept = F.map_filter("attrs", lambda k, v: F.array_contains("allowed", k) & v.isNotNull())
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N' OR l_quantity > 10").withColumns({"attrs": attrs, "allowed": allowed})
    text = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("l_orderkey", "l_linenumber", text.alias("attrs"))


@query(f"""
    WITH {E}, l AS (SELECT *, last_value(CASE WHEN event_type IN ('view', 'error') THEN event_type END IGNORE NULLS) OVER ({BEFORE}) AS view, last_value(CASE WHEN event_type IN ('view', 'error') THEN t END IGNORE NULLS) OVER ({BEFORE}) AS since FROM e)
    SELECT event_id, event_type FROM l WHERE event_type IN ('click', 'purchase') AND view = 'view' AND t - since <= {DAY}
""")
def trusted_view_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events count only where the last view before them was good and no older than a day."""
    seen = F.when(F.col("event_type").isin("view", "error"), F.struct("event_type", "t"))
    rows = events(spark, sf_dir).withColumn("seen", F.last(seen, ignorenulls=True).over(rows_before()))
    return rows.filter(f"event_type IN ('click', 'purchase') AND seen.event_type = 'view' AND t - seen.t <= {DAY}").select("event_id", "event_type")


ALLOWED = [("view", 0, True), ("view", 1, False), ("click", 1, True), ("purchase", 0, False), ("purchase", 2, True)]  # fixed values: kind, producer, whether an actor is needed


@query(f"""
    WITH {E}, a(kind, producer, needs_actor) AS (VALUES {", ".join(f"('{k}', {p}, {str(n).lower()})" for k, p, n in ALLOWED)})
    SELECT event_id, CASE WHEN a.kind IS NULL THEN 'producer' WHEN needs_actor AND value < 5 THEN 'actor' ELSE 'ok' END AS verdict FROM e LEFT JOIN a ON a.kind = event_type AND a.producer = user_id % 3
""")
def producer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against the producers allowed for its kind, then against what they must name; others are quarantined with the reason."""
    allowed = spark.createDataFrame(ALLOWED, "event_type string, producer long, needs_actor boolean")  # five rows
    rows = events(spark, sf_dir).withColumn("producer", F.col("user_id") % 3).join(F.broadcast(allowed), ["event_type", "producer"], "left")
    return rows.select("event_id", F.when(F.col("needs_actor").isNull(), "producer").when(F.col("needs_actor") & (F.col("value") < 5), "actor").otherwise("ok").alias("verdict"))


@query("""
    WITH f AS (SELECT l_orderkey, l_linenumber, l_tax, unnest(['discount', 'quantity', 'flag']) AS field, unnest([CASE WHEN l_discount > 0 THEN l_tax END, 1 - l_tax, CASE WHEN l_returnflag <> 'N' THEN 0.5 END]) AS confidence FROM lineitem)
    SELECT l_orderkey, l_linenumber, field, round(confidence, 6) AS confidence FROM f WHERE confidence IS NOT NULL
""")
def field_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a row's fields are known, each with the confidence of the reader it came from."""
    confidence = F.map_from_arrays(
        F.array(F.lit("discount"), F.lit("quantity"), F.lit("flag")),
        F.array(F.when(F.col("l_discount") > 0, F.col("l_tax")), 1 - F.col("l_tax"), F.when(F.col("l_returnflag") != "N", 0.5)),
    )
    known = F.map_filter(confidence, lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(known).alias("field", "confidence")).withColumn("confidence", F.round("confidence", 6))


@query(f"""
    WITH {E}, d AS (SELECT user_id, t // {DAY} AS day, count(*) AS n, max(t) - min(t) AS span, bool_or(event_type = 'error') AS broken FROM e GROUP BY 1, 2)
    SELECT user_id, day, CASE WHEN n = 1 THEN 'instant' WHEN span < {6 * HOUR} THEN 'scene' ELSE 'round' END AS scope, greatest({6 * HOUR} - span, 0) AS shortfall,
      concat_ws(',', CASE WHEN n < 3 THEN 'few' END, CASE WHEN span < {6 * HOUR} THEN 'short' END, CASE WHEN broken THEN 'broken' END) AS reasons, n >= 3 AND span >= {6 * HOUR} AND NOT broken AS admissible,
      CASE WHEN n >= 3 AND span >= {6 * HOUR} AND NOT broken THEN 'scored' WHEN broken THEN 'unscored' ELSE 'reported' END AS gate FROM d
""")
def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of a scope in time and what it lacks; the reasons against it, admissible without any; scored, reported or rewritten as unscored."""
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.bool_or(F.col("event_type") == "error").alias("broken"))
    short = F.col("span") < 6 * HOUR
    reasons = F.filter(F.array(F.when(F.col("n") < 3, "few"), F.when(short, "short"), F.when(F.col("broken"), "broken")), lambda r: r.isNotNull())
    d = d.withColumn("found", reasons).withColumn("admissible", F.size("found") == 0)
    return d.select("user_id", "day", F.when(F.col("n") == 1, "instant").when(short, "scene").otherwise("round").alias("scope"), F.greatest(6 * HOUR - F.col("span"), F.lit(0)).alias("shortfall"), F.array_join("found", ",").alias("reasons"), "admissible", F.when(F.col("admissible"), "scored").when(F.col("broken"), "unscored").otherwise("reported").alias("gate"))


@query(f"""
    WITH {E}, l AS (SELECT *, floor(value / 10) - floor(lag(value) OVER w / 10) AS step, lag(event_type) OVER w AS before FROM e WINDOW w AS ({BY_USER}))
    SELECT event_id, CASE WHEN step = -1 THEN 'one' WHEN step < -1 THEN 'several' WHEN step IS NULL THEN 'unknown' ELSE 'none' END AS kills, CASE WHEN before = 'click' THEN 'direct' WHEN before = 'view' THEN 'motion' WHEN value > 40 THEN 'speed' ELSE 'unknown' END AS evidence,
      CASE WHEN before = event_type AND value >= 20 THEN 'confirmed' WHEN before = event_type THEN 'label' WHEN value >= 20 THEN 'polygon' WHEN before IS NULL THEN 'unknown' ELSE 'conflict' END AS zone,
      CASE lower(event_type) WHEN 'view' THEN 'watcher' WHEN 'click' THEN 'actor' WHEN 'purchase' THEN 'buyer' ELSE 'unknown' END AS role FROM l
""")
def decision_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four decisions a row: a drop by exactly one, evidence by precedence, label against place under thresholds, role by name."""
    w = by_user()
    rows = events(spark, sf_dir).withColumns({"level": F.floor(F.col("value") / 10), "was": F.lag("event_type").over(w)})
    rows = rows.withColumn("step", F.col("level") - F.lag("level").over(w))
    same, strong = F.coalesce(F.col("was") == F.col("event_type"), F.lit(False)), F.col("value") >= 20
    roles = F.create_map(*[F.lit(x) for pair in {"view": "watcher", "click": "actor", "purchase": "buyer"}.items() for x in pair])
    return rows.select(
        "event_id",
        F.when(F.col("step") == -1, "one").when(F.col("step") < -1, "several").when(F.col("step").isNull(), "unknown").otherwise("none").alias("kills"),
        F.when(F.col("was") == "click", "direct").when(F.col("was") == "view", "motion").when(F.col("value") > 40, "speed").otherwise("unknown").alias("evidence"),
        F.when(same & strong, "confirmed").when(same, "label").when(strong, "polygon").when(F.col("was").isNull(), "unknown").otherwise("conflict").alias("zone"),
        F.coalesce(F.try_element_at(roles, F.lower("event_type")), F.lit("unknown")).alias("role"),
    )


@query("""
    WITH v AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 < 3 THEN 'train' WHEN c_nationkey % 5 = 3 THEN 'validate' ELSE 'test' END AS split FROM customer WHERE c_acctbal > 0),
    r AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'test' WHEN c_nationkey % 5 < 3 THEN 'train' WHEN c_nationkey % 5 = 3 THEN 'validate' ELSE 'test' END AS split FROM customer WHERE c_custkey % 7 > 0)
    SELECT coalesce(v.c_custkey, r.c_custkey) AS c_custkey, v.split, r.split AS registered, CASE WHEN v.split IS NULL THEN 'unauthorised' WHEN r.split IS NULL THEN 'missing' WHEN v.split <> r.split THEN 'moved' ELSE 'same' END AS state FROM v FULL JOIN r ON v.c_custkey = r.c_custkey
""")
def split_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split that authorised rows get from their group, against what the registry says."""
    rest = F.col("c_nationkey") % 5
    split = F.when(rest < 3, "train").when(rest == 3, "validate").otherwise("test")
    customers = table(spark, sf_dir, "customer")
    view = customers.filter("c_acctbal > 0").select("c_custkey", split.alias("split"))
    registry = customers.filter("c_custkey % 7 > 0").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "test").otherwise(split).alias("registered"))
    state = F.when(F.col("split").isNull(), "unauthorised").when(F.col("registered").isNull(), "missing").when(F.col("split") != F.col("registered"), "moved").otherwise("same")
    return view.join(registry, "c_custkey", "full").withColumn("state", state)


@query("""
    WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) - count(DISTINCT l_linenumber) AS repeated, count(*) FILTER (l_quantity <= 0 OR l_quantity IS NULL) AS without_quantity, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_returnflag)), 1, 8) AS BIGINT)) AS BIGINT) AS signature FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(lines, 0) AS lines, coalesce(repeated, 0) AS repeated, coalesce(without_quantity, 0) AS without_quantity, lines IS NULL AS hollow, signature FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def bundle_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural checks and counts of each bundle, with a signature that doesn't depend on the order of its rows."""
    code = F.conv(F.substring(F.sha2(F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), 256), 1, 8), 16, 10).cast("long")
    bad = (F.col("l_quantity") <= 0) | F.col("l_quantity").isNull()
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), (F.count("*") - F.countDistinct("l_linenumber")).alias("repeated"), F.count_if(bad).alias("without_quantity"), F.sum(code).alias("signature"))  # noqa: E741
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("o_orderkey", known("lines"), known("repeated"), known("without_quantity"), F.col("lines").isNull().alias("hollow"), "signature")


@query("""
    SELECT a.l_orderkey AS left_order, b.l_orderkey AS right_order, a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_shipdate = b.l_shipdate WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'
""")
def key_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two suppliers that agree on every part of a key."""
    keys = ["l_partkey", "l_suppkey", "l_shipdate"]
    side = lambda flag, name: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(*keys, F.col("l_orderkey").alias(name))
    return side("A", "left_order").join(side("R", "right_order"), keys).select("left_order", "right_order", "l_partkey")


@query("""
    WITH s AS (SELECT s_suppkey AS key, 'supplier' AS kind, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, 'customer', c_name, c_nationkey FROM customer)
    SELECT kind, key, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region, lower(name) AS name FROM s LEFT JOIN nation ON n_nationkey = nation LEFT JOIN region ON r_regionkey = n_regionkey
""")
def knowledge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two layouts under one schema, with names from the small tables they refer to."""
    entity = lambda name, p: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(f"{p}_{name[:4]}key").alias("key"), F.lower(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("n_nationkey"))
    both = entity("supplier", "s").unionByName(entity("customer", "c"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    named = both.join(places, "n_nationkey", "left")
    known = lambda c, out: F.coalesce(F.col(c), F.lit("unknown")).alias(out)
    return named.select("kind", "key", known("n_name", "nation"), known("r_name", "region"), "name")


@query()
def reconciled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two sources (errors, purchases) against restarts (signups) and live samples (views): same, new or repeated."""
    return fold.reconciled(events(spark, sf_dir, "error", "purchase", "signup", "view"), ["user_id"], "t", "event_id", ("error", "purchase"), "signup", "view", 6 * HOUR, 12 * HOUR, "user_id long")


@query()
def fused_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors of a user at most two hours after the first of their group are one event; the surer reading is its value."""
    return fold.fused(events(spark, sf_dir, "click", "error"), ["user_id"], "t", "event_id", "value", 2 * HOUR, "user_id long")


@query()
def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from starts (signups) and ends (purchases), closed as partial at pauses of over two days."""
    return fold.boundary_windows(events(spark, sf_dir), ["user_id"], "t", "event_id", "event_type", "signup", "purchase", 2 * DAY, "user_id long")


@query()
def precedence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of an hour and more that overlap their group's seed: the kind first in precedence survives, two others are named."""
    order = F.array_position(F.array(*[F.lit(k) for k in ("purchase", "error", "click", "view", "signup")]), F.col("event_type"))
    scenes = events(spark, sf_dir).withColumns({"rank": order, "until": F.col("t") + HOUR + (F.col("value") * 60_000_000).cast("long")})
    return fold.precedence_groups(scenes, ["user_id"], "t", "event_id", "until", "rank", HOUR // 2, 2, "user_id long")


@query()
def diverse_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each user the best rows by value, two of a kind and six at most, none within a day of another."""
    rows = events(spark, sf_dir).withColumn("less", -F.col("value"))
    return fold.diverse_picks(rows, ["user_id"], "less", "event_id", "event_type", "t", 2, 6, DAY, "user_id long")


@query(f"""
    WITH {E}, b AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER ({BY_USER}) THEN 0 ELSE 1 END AS b FROM e), r AS (SELECT *, CAST(sum(b) OVER ({BY_USER}) AS BIGINT) AS run FROM b),
    g AS (SELECT user_id, run, any_value(event_type) AS zone, min(t) AS entered, max(t) AS seen, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT user_id, run, zone, lag(zone) OVER (PARTITION BY user_id ORDER BY run) AS origin, entered, seen - entered AS dwell FROM g
""")
def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that held for two rows at least, in order: where from, when entered, how long seen."""
    rows = events(spark, sf_dir).withColumn("new", ~F.coalesce(F.col("event_type") == F.lag("event_type").over(by_user()), F.lit(False)))
    rows = temporal.segments(rows, ["user_id"], ["t", "event_id"], F.col("new"), "run")
    g = rows.groupBy("user_id", "run").agg(F.first("event_type").alias("zone"), F.min("t").alias("entered"), (F.max("t") - F.min("t")).alias("dwell"), F.count("*").alias("n")).filter("n >= 2")
    return g.select("user_id", "run", "zone", F.lag("zone").over(Window.partitionBy("user_id").orderBy("run")).alias("origin"), "entered", "dwell")


@query(f"""
    WITH {E}, b AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER p AS pt, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER p AS pv,
      first_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER f AS ft, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER f AS fv FROM e
      WINDOW p AS ({BEFORE}), f AS ({BY_USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT event_id, CASE WHEN ft - pt <= {3 * DAY} AND floor(pv / 10) = floor(fv / 10) THEN 'purchase' ELSE event_type END AS state, coalesce(ft - pt <= {3 * DAY} AND floor(pv / 10) = floor(fv / 10), false) AS filled FROM b WHERE event_type = 'error'
""")
def bracketed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmeasured rows between two rows of one state and level, three days apart at most, take that state."""
    anchor = F.when(F.col("event_type") == "purchase", F.struct("t", F.floor(F.col("value") / 10).alias("v")))
    after = by_user().rowsBetween(1, Window.unboundedFollowing)
    rows = events(spark, sf_dir).withColumns({"p": F.last(anchor, ignorenulls=True).over(rows_before()), "f": F.first(anchor, ignorenulls=True).over(after)}).filter("event_type = 'error'")
    rows = rows.withColumn("filled", F.expr(f"coalesce(f.t - p.t <= {3 * DAY} AND p.v = f.v, false)"))
    return rows.select("event_id", F.when(F.col("filled"), "purchase").otherwise(F.col("event_type")).alias("state"), "filled")


@query(f"""
    WITH {E}, x AS (SELECT *, t + CAST(floor(value) AS BIGINT) * {HOUR} AS expiry FROM e), b AS (SELECT *, CASE WHEN abs(expiry - lag(expiry) OVER ({BY_USER})) <= {DAY} THEN 0 ELSE 1 END AS b FROM x),
    s AS (SELECT *, sum(b) OVER ({BY_USER}) AS seg FROM b), m AS (SELECT *, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, seg) AS anchored FROM s)
    SELECT event_id, event_type = 'purchase' AS measured FROM m WHERE anchored
""")
def countdown_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each measured row outward, in both directions, over rows that each expire within a day of their neighbour's expiry."""
    rows = events(spark, sf_dir).withColumn("expiry", F.col("t") + F.floor("value") * HOUR)
    rows = rows.withColumn("near", F.coalesce(F.abs(F.col("expiry") - F.lag("expiry").over(by_user())) <= DAY, F.lit(False)))
    rows = temporal.segments(rows, ["user_id"], ["t", "event_id"], ~F.col("near"))
    rows = rows.withColumn("anchored", F.bool_or(F.col("event_type") == "purchase").over(Window.partitionBy("user_id", "segment")))
    return rows.filter("anchored").select("event_id", (F.col("event_type") == "purchase").alias("measured"))


@query("""
    WITH new AS (SELECT o_orderkey, 'timeline' AS namespace, o_orderpriority AS label FROM orders WHERE o_orderkey % 3 = 0), old AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'timeline' ELSE 'manual' END AS namespace, o_orderstatus AS label FROM orders)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE namespace <> 'timeline' OR o_orderkey NOT IN (SELECT o_orderkey FROM new)
""")
def own_namespace_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace the stored ones of their key and namespace; what others wrote under the key stays."""
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("timeline").alias("namespace"), F.col("o_orderpriority").alias("label"))
    old = orders.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "timeline").otherwise("manual").alias("namespace"), F.col("o_orderstatus").alias("label"))
    return new.unionByName(old.join(new.select("o_orderkey", "namespace"), ["o_orderkey", "namespace"], "left_anti"))


@query()
def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds from system rows alone: armed by a signup, pending from a view of enough value, ended by a purchase."""
    return fold.lifecycles(events(spark, sf_dir), ["user_id"], "t", "event_id", "event_type", "value", ("signup", "view", "purchase", "error"), 5.0, DAY, "user_id long")
