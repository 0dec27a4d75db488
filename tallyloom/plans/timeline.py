"""Sessions, intervals, as-of joins, change detection and ordered folds over the events table (time in microseconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import fold, rules, temporal, transducer

from .catalog import DAY, HOUR, events, query

E = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"
WINDOWS = "u AS (SELECT user_id, t - 10800000000 AS s, t + 10800000000 AS f FROM e WHERE event_type = 'error')"


def error_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hours about each error."""
    return events(spark, sf_dir, "error").select("user_id", (F.col("t") - 3 * HOUR).alias("s"), (F.col("t") + 3 * HOUR).alias("f"))


UNION = f"""
    WITH {E}, {WINDOWS},
    m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u),
    g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS k FROM m),
    i AS (SELECT user_id, min(s) AS s, max(f) AS f FROM g GROUP BY user_id, k)
"""


@query(f"""
    WITH {E}, b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM b)
    SELECT user_id, session, min(t) AS "start", max(t) AS "end", count(*) AS n FROM s GROUP BY 1, 2
""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, broken by twelve idle hours."""
    return temporal.session_bounds(events(spark, sf_dir), ["user_id"], "t", 12 * HOUR, "event_id")


ISLANDS = """
    WITH d AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day FROM events {where}),
    r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d)
    SELECT user_id, min(day) AS lo, max(day) + 1 AS hi FROM r GROUP BY user_id, k {having}
"""


@query(ISLANDS.format(where="", having=""))
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days with events."""
    return temporal.islands(events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY)), ["user_id"], "day")


@query(ISLANDS.format(where="WHERE event_type IN ('error', 'click')", having="HAVING count(*) >= 3"))
def review_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged days in runs of at least three."""
    flagged = events(spark, sf_dir, "error", "click").withColumn("day", F.floor(F.col("t") / DAY))
    return temporal.islands(flagged, ["user_id"], "day").filter("hi - lo >= 3")


@query(f"{UNION} SELECT user_id, s, f FROM i")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged windows."""
    return temporal.interval_union(error_windows(spark, sf_dir), ["user_id"], "s", "f")


@query(f"{UNION} SELECT user_id, CAST(sum(f - s) AS BIGINT) AS covered, min(s) AS first, max(f) AS last FROM i GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that windows cover together."""
    return temporal.coverage(error_windows(spark, sf_dir), ["user_id"], "s", "f")


@query(f"{UNION} SELECT * FROM (SELECT user_id, f AS gap_start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS gap_end FROM i) WHERE gap_end - gap_start >= 86400000000")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a day or more between merged windows."""
    return temporal.coverage_gaps(error_windows(spark, sf_dir), ["user_id"], "s", "f", DAY)


@query(f"""
    WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT p.event_id, CASE WHEN p.t - v.t <= 86400000000 THEN v.t END AS matched, CASE WHEN p.t - v.t <= 86400000000 THEN v.value END AS seen
    FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t
""")
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at most a day before each purchase."""
    views = events(spark, sf_dir, "view").select("user_id", "t", F.col("value").alias("seen"))
    return temporal.asof_backward(events(spark, sf_dir, "purchase").select("user_id", "event_id", "t"), views, ["user_id"], "t", "seen", DAY).select("event_id", "matched", "seen")


@query(f"""
    WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'),
    v AS (SELECT user_id, t, b, lead(b) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM (SELECT user_id, t, max(CAST(floor(value / 40) AS BIGINT)) AS b FROM e WHERE event_type = 'view' GROUP BY 1, 2))
    SELECT p.event_id, CASE WHEN v.b = v.nxt OR p.t - v.t <= 21600000000 THEN v.b END AS band FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t
""")
def asof_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last band read before each purchase, if the next reading agrees or it is at most six hours old."""
    views = events(spark, sf_dir, "view").select("user_id", "t", F.floor(F.col("value") / 40).alias("band"))
    return temporal.asof_stable(events(spark, sf_dir, "purchase").select("user_id", "event_id", "t"), views, ["user_id"], "t", "band", 6 * HOUR).select("event_id", "band")


@query(f"{UNION} SELECT e.event_id, i.s, i.f FROM e JOIN i ON e.user_id = i.user_id AND e.t BETWEEN i.s AND i.f WHERE event_type = 'click'")
def interval_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the merged window that contains them."""
    union = temporal.interval_union(error_windows(spark, sf_dir), ["user_id"], "s", "f")
    return temporal.interval_join(events(spark, sf_dir, "click"), union, ["user_id"], "t", "s", "f", 6 * HOUR).select("event_id", "s", "f")


@query(f"""
    WITH {E}, a AS (SELECT user_id, event_id AS a, t AS s, t + 7200000000 AS f FROM e WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS b, t - 3600000000 AS x, t + 3600000000 AS y FROM e WHERE event_type = 'view')
    SELECT a, b FROM a JOIN b ON a.user_id = b.user_id AND s <= y AND f >= x
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of purchase and view windows that overlap."""
    a = events(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("a"), F.col("t").alias("s"), (F.col("t") + 2 * HOUR).alias("f"))
    b = events(spark, sf_dir, "view").select("user_id", F.col("event_id").alias("b"), (F.col("t") - HOUR).alias("x"), (F.col("t") + HOUR).alias("y"))
    return temporal.overlap_join(a, b, ["user_id"], 2 * HOUR, "s", "f", "x", "y").select("a", "b")


@query(f"WITH {E}, {WINDOWS} SELECT e.event_id, max(u.s) AS s FROM e JOIN u ON e.user_id = u.user_id AND e.t BETWEEN u.s AND u.f WHERE event_type = 'click' GROUP BY 1")
def latest_interval_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several windows about a click the one that began last."""
    held = temporal.interval_join(events(spark, sf_dir, "click"), error_windows(spark, sf_dir), ["user_id"], "t", "s", "f", 6 * HOUR)
    return held.groupBy("event_id").agg(F.max("s").alias("s"))


@query(f"""
    WITH {E}, p AS (SELECT a.event_id, b.event_id AS o, abs(b.t - a.t) AS d FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND abs(b.t - a.t) <= 43200000000)
    SELECT event_id, arg_min(o, (d, o)) AS nearest, min(d) AS distance FROM p GROUP BY 1
""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view nearest to each purchase within twelve hours."""
    return temporal.nearest(events(spark, sf_dir, "purchase"), events(spark, sf_dir, "view"), ["user_id"], "event_id", "t", "event_id", 12 * HOUR).select("event_id", "nearest", "distance")


@query(f"""
    WITH {E} SELECT event_id, nxt AS "next" FROM (SELECT event_id, event_type, first_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e) WHERE event_type = 'view'
""")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase or error after each view."""
    return temporal.next_of_kind(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type", "view", ["purchase", "error"], "event_id").select("event_id", "next")


@query(f"""
    WITH {E}, p AS (SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND abs(b.t - a.t) <= 21600000000)
    SELECT left_id, right_id FROM p QUALIFY count(*) OVER (PARTITION BY user_id, left_id) = 1 AND count(*) OVER (PARTITION BY user_id, right_id) = 1
""")
def mutual_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views within six hours that have no other candidate on either side."""
    return temporal.mutually_unique(events(spark, sf_dir, "purchase"), events(spark, sf_dir, "view"), ["user_id"], "event_id", "event_id", "t", 6 * HOUR).select("left_id", "right_id")


@query()
def exclusive_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase takes the earliest unused view of the day before it."""
    return fold.exclusive_match(events(spark, sf_dir, "view"), events(spark, sf_dir, "purchase"), ["user_id"], "t", "event_id", DAY, "user_id long")


@query(f"""
    WITH {E}, s AS (SELECT *, CAST(floor(value / 50) AS BIGINT) AS band, event_type <> 'error' AS ok FROM e)
    SELECT event_id, band FROM (SELECT *, lag(ok) OVER w AS pok, lag(band) OVER w AS pband FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE ok AND NOT coalesce(pok AND pband = band, false)
""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the value band; errors reset it."""
    rows = events(spark, sf_dir).withColumn("band", F.floor(F.col("value") / 50))
    return temporal.change_points(rows, ["user_id"], ["t", "event_id"], ["band"], F.col("event_type") != "error").select("event_id", "band")


@query(f"""
    WITH {E}, s AS (SELECT *, CASE WHEN event_type <> 'error' THEN value > 60 END AS f FROM e),
    p AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM s)
    SELECT event_id, CASE WHEN f THEN 'up' ELSE 'down' END AS flip FROM p WHERE f <> g
""")
def state_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the value crosses 60, errors ignored."""
    flag = F.when(F.col("event_type") != "error", F.col("value") > 60)
    return temporal.state_flips(events(spark, sf_dir), ["user_id"], ["t", "event_id"], flag).select("event_id", "flip")


FOLD = f"""
    WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, t, {{state}} AS x, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e {{where}}),
"""


@query(
    FOLD.format(state="CAST(floor(value / 100) AS BIGINT)", where="")
    + """
    f AS (SELECT user_id, n, event_id, t AS kt, x AS kx, true AS kept FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN o.x <> kx OR o.t - kt >= 172800000000 THEN o.t ELSE kt END, CASE WHEN o.x <> kx OR o.t - kt >= 172800000000 THEN o.x ELSE kx END, o.x <> kx OR o.t - kt >= 172800000000
        FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, event_id FROM f WHERE kept
"""
)
def heartbeat_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that change the band or come two days or more after the last kept one."""
    rows = events(spark, sf_dir).withColumn("band", F.floor(F.col("value") / 100))
    return fold.heartbeat_thin(rows, ["user_id"], "t", "event_id", "band", 2 * DAY, "user_id long")


@query()
def window_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one kind within six hours of a kept one join it; the strongest survives, the weakest sets the confidence."""
    return fold.dedup_in_time(events(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", "value", 6 * HOUR, "user_id long, event_type string")


@query()
def latched_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from a twice confirmed signup to the next purchase."""
    return fold.latched_intervals(events(spark, sf_dir), ["user_id"], "t", "event_id", "event_type", "signup", "purchase", 2, "user_id long")


@query()
def zone_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds as labels that must hold for a day to replace the current one."""
    rows = events(spark, sf_dir).withColumn("label", F.when(F.col("value") > 5, F.col("event_type")))
    return fold.debounced(rows, ["user_id"], "t", "event_id", "label", DAY // 4, "user_id long")


@query()
def monotone_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest non-decreasing track of each user's purchases."""
    rows = events(spark, sf_dir, "purchase").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return fold.monotone_track(rows, ["user_id"], "t", "event_id", "cents", "user_id long")


@query(f"""
    WITH {E}, p AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e WHERE value IS NOT NULL)
    SELECT event_id, CASE WHEN value = b THEN 'same' WHEN value < b AND b - value <= 20 THEN 'spent' WHEN value > b AND b < 10 THEN 'reload' WHEN value < b THEN 'switch' ELSE 'unexplained' END AS kind FROM p WHERE b IS NOT NULL
""")
def pair_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each step between consecutive readings."""
    v, b = F.col("value"), F.col("before")
    cases = [("same", v == b), ("spent", (v < b) & (b - v <= 20)), ("reload", (v > b) & (b < 10)), ("switch", v < b)]
    return temporal.classify_steps(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", cases, "unexplained").select("event_id", "kind")


QUIET = "WITH {e} SELECT event_id FROM (SELECT *, lag(t) OVER (PARTITION BY {keys} ORDER BY t, event_id) AS p FROM e {where}) WHERE p IS NULL OR t - p > {quiet}"


@query(QUIET.format(e=E, keys="user_id", where="WHERE event_type = 'click'", quiet=3 * HOUR))
def first_after_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First clicks after three quiet hours."""
    return temporal.first_after_pause(events(spark, sf_dir, "click"), ["user_id"], "t", "event_id", 3 * HOUR).select("event_id")


@query(QUIET.format(e=E, keys="user_id, event_type", where="", quiet=DAY))
def repeat_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose kind the user didn't have in the day before."""
    return temporal.repeat_suppressed(events(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", DAY).select("event_id")


@query("""
    WITH c AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT * FROM (SELECT *, n - coalesce(max(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS arrived FROM c) WHERE arrived > 0
""")
def multiplicity_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises of the daily count above the three days before."""
    counts = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
    return temporal.multiplicity_arrivals(counts, ["user_id"], "day", "n", 3)


@query(f"""
    WITH {E} SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS a, lead(event_type) OVER w AS b, t - lag(t) OVER w AS x, lead(t) OVER w - t AS y FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    WHERE (a = event_type AND x <= 36000000000) OR (b = event_type AND y <= 36000000000)
""")
def confirm_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a neighbour of the same kind within ten hours confirms."""
    return temporal.confirmed_by_neighbour(events(spark, sf_dir), ["user_id"], "t", "event_id", "event_type", 10 * HOUR).select("event_id")


@query(f"WITH {E} SELECT event_id FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE a > value AND b <= value AND c <= value")
def kframe_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops that hold for three readings."""
    return temporal.held_drops(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 3).select("event_id")


@query(f"WITH {E} SELECT event_id FROM (SELECT *, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE event_type = 'view' AND b = 'click' AND c = 'purchase'")
def pattern3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View, click, purchase in a row."""
    return temporal.pattern3(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type", ("view", "click", "purchase")).select("event_id")


@query(f"""
    WITH {E}, s AS (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 60) AS BIGINT) END AS v FROM e),
    k AS (SELECT *, CASE WHEN v IS NOT NULL THEN t END AS kt FROM s),
    p AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS bv, last_value(kt IGNORE NULLS) OVER b AS bt, first_value(v IGNORE NULLS) OVER a AS av, first_value(kt IGNORE NULLS) OVER a AS aft FROM k
      WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, coalesce(v, CASE WHEN bv = av AND aft - bt <= 172800000000 THEN bv END) AS filled FROM p
""")
def bracket_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors take the band of equal readings on both sides, two days apart at most."""
    rows = events(spark, sf_dir).withColumn("band", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 60)))
    return temporal.bracket_fill(rows, ["user_id"], "t", "event_id", "band", 2 * DAY).select("event_id", "filled")


@query(f"WITH {E} SELECT a.event_id, median(b.value) AS median, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 86400000000 AND a.t GROUP BY 1")
def trailing_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the day before each event."""
    return temporal.trailing_median(events(spark, sf_dir), ["user_id"], "event_id", "t", "value", DAY).select("event_id", "median", "n")


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS votes, max(n) AS top, arg_max(event_type, (n, -ascii(event_type), event_type)) AS x FROM c GROUP BY 1)
    SELECT user_id, votes, top, CASE WHEN votes >= 20 AND top * 100 >= votes * 28 THEN w END AS winner FROM g JOIN (SELECT user_id, min(event_type) AS w FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM c) WHERE n = m GROUP BY 1) USING (user_id)
""")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent kind of event, if it has enough votes and share."""
    return rules.majority(events(spark, sf_dir), ["user_id"], "event_type", 20, 28).select("user_id", "votes", "top", "winner")


@query("""
    WITH s AS (SELECT user_id, unnest(generate_series(min(CAST(epoch_us(ts) // 21600000000 AS BIGINT)), max(CAST(epoch_us(ts) // 21600000000 AS BIGINT)))) AS slot FROM events GROUP BY 1),
    b AS (SELECT user_id, CAST(epoch_us(ts) // 21600000000 AS BIGINT) AS slot, count(*) AS n, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'UNKNOWN' END AS state FROM events GROUP BY 1, 2)
    SELECT s.user_id, s.slot, coalesce(n, 0) AS n, state, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN state = 'UNKNOWN' THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS status FROM s LEFT JOIN b ON s.user_id = b.user_id AND s.slot = b.slot
""")
def second_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid of six-hour slots per user: unanimous state, conflict, or nothing seen."""
    rows = events(spark, sf_dir).withColumn("slot", F.floor(F.col("t") / (6 * HOUR)))
    cells = rows.groupBy("user_id", "slot").agg(F.count("*").alias("n"), F.coalesce(rules.agreed(F.col("event_type"), F.lit(True)), F.lit("UNKNOWN")).alias("state"))
    bounds = cells.groupBy("user_id").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = temporal.spine(bounds, ["user_id"], "lo", "hi", "slot").join(cells, ["user_id", "slot"], "left")
    status = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("state") == "UNKNOWN", "AMBIGUOUS").otherwise("OBSERVED")
    return grid.select("user_id", "slot", F.coalesce("n", F.lit(0)).alias("n"), "state", status.alias("status"))


@query("""
    WITH c AS (SELECT user_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'A1' END, CASE WHEN value > 100 THEN 'A2' END, CASE WHEN value < 1 THEN 'A3' END, CASE WHEN hour(ts) < 6 THEN 'A4' END], lambda x: x IS NOT NULL)) AS cause, event_type FROM events)
    SELECT cause, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view, count(*) AS total FROM c GROUP BY 1
""")
def cause_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several causes per row, counted by kind of event."""
    causes = F.array_compact(F.array(F.when(F.col("event_type") == "error", "A1"), F.when(F.col("value") > 100, "A2"), F.when(F.col("value") < 1, "A3"), F.when(F.hour("ts") < 6, "A4")))
    rows = events(spark, sf_dir).select("event_type", F.explode(causes).alias("cause"))
    return rows.groupBy("cause").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "purchase", "view")], F.count("*").alias("total"))


@query(f"""
    WITH {E}, g AS (SELECT user_id, CAST(t // 86400000000 AS BIGINT) AS day, min(t) FILTER (event_type = 'signup') AS a, min(t) FILTER (event_type = 'view') AS b, min(t) FILTER (event_type IN ('purchase', 'error')) AS z FROM e GROUP BY 1, 2)
    SELECT user_id, day, least(a, b) AS "start", z AS "end", CASE WHEN least(a, b) IS NULL THEN 'unknown' WHEN z IS NULL THEN 'partial' WHEN z >= least(a, b) THEN 'complete' ELSE 'conflict' END AS phase FROM g
""")
def round_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each user's day from the earliest signals, and what is known of it."""
    kind = F.col("event_type")
    first = lambda *k: F.min(F.when(kind.isin(*k), F.col("t")))
    g = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.least(first("signup"), first("view")).alias("start"), first("purchase", "error").alias("end"))
    phase = F.when(F.col("start").isNull(), "unknown").when(F.col("end").isNull(), "partial").when(F.col("end") >= F.col("start"), "complete").otherwise("conflict")
    return g.withColumn("phase", phase)


@query("""
    WITH g AS (SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) % 2 AS half, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'error') AS b FROM events GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN a > b THEN 1 - half WHEN b > a THEN half END AS implied FROM g)
    SELECT user_id, CASE WHEN count(DISTINCT implied) = 1 THEN min(implied) END AS side, count(implied) AS known FROM s GROUP BY 1
""")
def half_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that all known halves imply, null if they conflict."""
    half = F.floor(F.col("t") / DAY) % 2
    g = events(spark, sf_dir).groupBy("user_id", half.alias("half")).agg(F.count_if(F.col("event_type") == "purchase").alias("a"), F.count_if(F.col("event_type") == "error").alias("b"))
    g = g.withColumn("implied", F.when(F.col("a") > F.col("b"), 1 - F.col("half")).when(F.col("b") > F.col("a"), F.col("half")))
    return g.groupBy("user_id").agg(rules.agreed(F.col("implied"), F.lit(True)).alias("side"), F.count("implied").alias("known"))


PREDICATES = [("r1", "view", "gte", 150.0), ("r2", "error", "lt", 5.0), ("r3", "purchase", "neq", 1.0), ("r4", "signup", "exists", None), ("r5", "click", "eq", 2.0)]


@query("""
    WITH p(rule, pkey, op, lo) AS (VALUES ('r1', 'view', 'gte', 150.0), ('r2', 'error', 'lt', 5.0), ('r3', 'purchase', 'neq', 1.0), ('r4', 'signup', 'exists', NULL), ('r5', 'click', 'eq', 2.0)),
    f AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type, value FROM events),
    m AS (SELECT user_id, day, rule, bool_or(coalesce(CASE op WHEN 'gte' THEN value >= lo WHEN 'lt' THEN value < lo WHEN 'neq' THEN value <> lo WHEN 'eq' THEN value = lo ELSE true END, false)) AS truth FROM f JOIN p ON event_type = pkey GROUP BY 1, 2, 3)
    SELECT s.user_id, s.day, p.rule, m.truth FROM (SELECT DISTINCT user_id, day FROM f) s CROSS JOIN p LEFT JOIN m ON s.user_id = m.user_id AND s.day = m.day AND p.rule = m.rule
""")
def predicate_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued truth of each rule's predicate over each user's day."""
    facts = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    predicates = spark.createDataFrame(PREDICATES, "rule string, pkey string, op string, lo double")
    return rules.predicate_truth(facts, predicates, ["user_id", "day"], "event_type", "value")


@query("""
    WITH o AS (SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT k, count(*) AS n, min(event_id) AS first, count(DISTINCT user_id) AS users FROM o GROUP BY 1
""")
def json_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a field of the JSON context."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.countDistinct("user_id").alias("users"))


@query("""
    WITH c AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT epoch_us(d) AS "window", event_type, n FROM c
""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of a day."""
    from tallyloom.sources.tables import micros

    g = events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.withColumn("s", F.col("w.start")).select(micros("s").alias("window"), "event_type", "n")


LATCH = f"""
    WITH {E}, n AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
    p AS (SELECT user_id, part, min(t) FILTER (event_type = 'signup') AS "start", max(t) FILTER (event_type = 'purchase') AS "end", count(*) FILTER (event_type = 'signup') AS n FROM n GROUP BY user_id, part)
    SELECT user_id, "start", "end" FROM p WHERE n >= 2
"""


@query(LATCH)
def latched_intervals_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from a twice confirmed signup to the next purchase; each user's rows in blocks of five days."""
    return transducer.blocked_fold(events(spark, sf_dir), ["user_id"], "t", "event_id", ["t", "event_type"], transducer.latch("signup", "purchase", 2), 5 * DAY, "start long, end long")


@query(f"""
    WITH {E}, l AS (SELECT *, CASE WHEN value > 5 THEN event_type END AS label FROM e),
    b AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS new FROM l WHERE label IS NOT NULL),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM b),
    h AS (SELECT event_id, CASE WHEN t - min(t) OVER (PARTITION BY user_id, run) >= 21600000000 THEN label END AS held FROM r)
    SELECT user_id, event_id, last_value(held IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS label FROM l LEFT JOIN h USING (event_id)
""")
def debounced_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds as labels that must hold for a quarter of a day; each user's rows in blocks of five days."""
    rows = events(spark, sf_dir).withColumn("label", F.when(F.col("value") > 5, F.col("event_type")))
    return transducer.blocked_fold(rows, ["user_id"], "t", "event_id", ["event_id", "t", "label"], transducer.debounce(DAY // 4), 5 * DAY, "event_id long, label string")


@query()
def lifecycles_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup, a click of ten or more, purchase; errors for longer than two days leave nothing open. In blocks of five days."""
    machine = transducer.lifecycle(("signup", "click", "purchase", "error"), 10.0, 2 * DAY)
    return transducer.blocked_fold(events(spark, sf_dir), ["user_id"], "t", "event_id", ["t", "event_type", "value"], machine, 5 * DAY, "armed long, pending long, ended long")
