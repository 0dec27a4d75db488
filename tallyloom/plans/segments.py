"""Rounds, lives, numbers, feeds and checks over the events; reports as documents; a gate for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import boundaries, fixpoint, fold, ml, runs, samples, segments, temporal
from tallyloom.sources import reports
from tallyloom.sources.tables import table

from .catalog import DAY, HOUR, events, query
from .timeline import E


def kinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with k of their props."""
    return events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query()
def round_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each user: from signup to purchase, over views and clicks as readings; some errors cut the recording."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").when((F.col("event_type") == "error") & (k > 80), "break").otherwise("reading")
    rows = kinded(spark, sf_dir).withColumn("kind", kind).withColumn("t", F.col("t") - F.lit(1_704_067_200_000_000))
    columns = {"usable": F.col("event_type") == "view", "preparing": (F.col("event_type") == "error"), "segment": F.when(k > 50, "a").when(k > 10, "b"), "prepared_at": F.when(k % 3 == 0, F.col("t") - HOUR), "until": F.lit(30 * DAY)}
    return segments.round_windows(rows.select("user_id", "t", "kind", *[c.alias(n) for n, c in columns.items()]), ["user_id"], "t", "kind", 3 * DAY, HOUR, "until", "user_id long")


@query()
def reconciled_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as losses in each user's stretches of ten days: at most one for each life."""
    kind = F.when(F.col("event_type") == "error", "candidate").when(F.col("event_type") == "view", "live").when((F.col("event_type") == "signup") & (F.col("k") > 60), "restart").when(F.col("event_type") == "purchase", "revive")
    part = F.when(F.col("k") < 95, F.floor(F.col("t") / (10 * DAY)))
    rows = kinded(spark, sf_dir).select("user_id", part.alias("part"), "t", kind.alias("kind"), F.concat(F.lit("s"), F.col("k") % 3).alias("source"), (F.col("k") == 7).alias("unfit")).filter("kind IS NOT NULL")
    return segments.reconciled_lives(rows, ["user_id"], "part", "t", 6 * HOUR, 2, 12 * HOUR, True, "user_id long")


@query(f"""
    WITH {E}, b AS (SELECT user_id, t, t // 345600000000 - 4930 + CAST(CAST(json_extract_string(props, '$.k') AS INT) % 11 = 0 AS INT) AS n FROM e WHERE event_type = 'view'),
    s AS (SELECT *, count(*) OVER (PARTITION BY user_id, n) AS c FROM b),
    r AS (SELECT *, max(n) OVER (PARTITION BY user_id ORDER BY t) AS top FROM s WHERE c >= 2),
    f AS (SELECT user_id, n AS number, min(t) AS first, max(t) AS last FROM r WHERE n = top GROUP BY 1, 2),
    g AS (SELECT *, lag(last) OVER (PARTITION BY user_id ORDER BY number) AS floor FROM f),
    o AS (SELECT g.user_id, number, coalesce(max(e.t), first) AS start FROM g LEFT JOIN e ON e.user_id = g.user_id AND event_type = 'signup' AND e.t <= first AND (floor IS NULL OR e.t > floor) GROUP BY g.user_id, number, first),
    l AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY number) AS following FROM o)
    SELECT l.user_id, number, start, coalesce(min(e.t), following) AS "end" FROM l LEFT JOIN e ON e.user_id = l.user_id AND event_type = 'purchase' AND e.t > start AND (following IS NULL OR e.t <= following) GROUP BY l.user_id, number, start, following
""")
def numbered_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds by the number that views show (stretches of four days, sometimes misread), opened by signups and closed by purchases."""
    rows = kinded(spark, sf_dir)
    number = F.floor(F.col("t") / (4 * DAY)) - 4930 + (F.col("k") % 11 == 0).cast("int")
    states = rows.filter("event_type = 'view'").select("user_id", "t", number.alias("n"))
    marks = rows.filter(F.col("event_type").isin("signup", "purchase")).select("user_id", "t", F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"))
    return segments.numbered_rounds(states, marks, ["user_id"], "t", "n", 2)


@query()
def assigned_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as entries that errors take, in each user's stretches of four days."""
    rows = kinded(spark, sf_dir).withColumn("part", F.floor(F.col("t") / (4 * DAY))).withColumn("team", F.concat(F.lit("t"), F.col("k") % 2))
    entries = rows.filter("event_type = 'click'").select("user_id", "part", F.col("event_id").alias("id"), F.col("t").alias("time"), F.when(F.col("k") % 3 > 0, "elimination").otherwise("highlight").alias("kind"), "team", ((F.col("part") + 1) * (4 * DAY) - HOUR).alias("last"))
    units = rows.filter("event_type = 'error'").select("user_id", "part", F.col("event_id").alias("id"), (F.col("t") - 6 * HOUR).alias("low"), F.col("t").alias("high"), "team")
    return segments.assigned_feed(entries, units, ["user_id", "part"], 12 * HOUR, ["elimination", "highlight"], "user_id long, part long")


@query(f"""
    WITH {E}, s AS (SELECT i.event_id, i.user_id, max(c.value) AS v FROM e i LEFT JOIN e c ON c.user_id = i.user_id AND c.event_type = 'click' AND c.t BETWEEN i.t AND i.t + 86400000000 WHERE i.event_type = 'signup' GROUP BY 1, 2),
    p AS (SELECT i.event_id, i.user_id, count(c.t) AS n FROM e i LEFT JOIN e c ON c.user_id = i.user_id AND c.event_type = 'error' AND c.t BETWEEN i.t + 1 AND i.t + 43200000000 WHERE i.event_type = 'purchase' GROUP BY 1, 2)
    SELECT event_id, CASE WHEN v IS NULL THEN 'undetermined' WHEN v >= 80 THEN 'correct' WHEN v < 40 THEN 'false' ELSE 'undetermined' END AS verdict FROM s
    UNION ALL SELECT event_id, CASE WHEN n = 0 THEN 'correct' ELSE 'false' END FROM p
    UNION ALL SELECT event_id, 'abstained' FROM e WHERE event_type = 'view'
""")
def verified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups held against the clicks of the next day, purchases against errors in the next twelve hours; views have no check."""
    rows = events(spark, sf_dir)
    items = rows.filter(F.col("event_type").isin("signup", "purchase", "view")).select("user_id", "event_id", "t", F.col("event_type").alias("kind"))
    signals = rows.filter(F.col("event_type").isin("click", "error")).select("user_id", "t", F.col("event_type").alias("signal"), "value")
    checks = [segments.Check("signup", "click", 0, DAY, 80.0, 40.0), segments.Check("purchase", "error", 1, 12 * HOUR)]
    return segments.verified_items(items, signals, ["user_id"], "event_id", "t", checks, 12 * HOUR).select("event_id", "verdict")


ESCAPED = "replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""
    SELECT user_id, sha256('<!doctype html><html lang=''en''><meta charset=''utf-8''><title>Events of ' || user_id || '</title><body><h1>Events of ' || user_id
      || '</h1><table border=''1''><thead><tr><th>event_id</th><th>event_type</th><th>props</th></tr></thead><tbody>'
      || string_agg('<tr><td>' || event_id || '</td><td>' || event_type || '</td><td>' || {ESCAPED} || '</td></tr>', '' ORDER BY event_id) || '</tbody></table></body></html>') AS digest FROM events GROUP BY user_id
""")
def html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of an HTML page for each user."""
    pages = reports.html_reports(events(spark, sf_dir), "user_id", ["event_id"], ["event_id", "event_type", "props"], "Events of")
    return pages.select("user_id", F.sha2("html", 256).alias("digest"))


@query("""
    SELECT user_id, '# Events of ' || user_id || chr(10) || chr(10) || '| event_id | event_type |' || chr(10) || '| --- | --- |' || chr(10)
      || string_agg('| ' || event_id || ' | ' || event_type || ' |', chr(10) ORDER BY event_id) || chr(10) AS markdown FROM events GROUP BY user_id
""")
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table for each user."""
    return reports.markdown_reports(events(spark, sf_dir), "user_id", ["event_id"], ["event_id", "event_type"], "Events of")


@query("""
    WITH v AS (SELECT c_nationkey AS task, c_mktsegment AS s, avg(c_acctbal) / 10000 AS score, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS solvent, avg(CASE WHEN c_acctbal > 9000 THEN 1.0 ELSE 0.0 END) AS abstain FROM customer GROUP BY 1, 2),
    a AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY s) AS n FROM v),
    d AS (SELECT c.task, c.s, c.score - b.score AS gain, c.score - b.score < 0.02 AS g, b.solvent - c.solvent > 0.05 AS h, c.abstain - b.abstain > 0.05 AS i FROM a c JOIN a b ON b.task = c.task AND b.n = 1 WHERE c.n > 1)
    SELECT task || '-' || s AS version, gain, NOT (g OR h OR i) AS adopt, concat_ws(',', CASE WHEN g THEN 'gain' END, CASE WHEN h THEN 'guard:solvent' END, CASE WHEN i THEN 'abstain' END) AS reasons FROM d
""")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as versions of each nation's model: may one take the place of the first?"""
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("task"), "c_mktsegment").agg((F.avg("c_acctbal") / 10000).alias("score"), share(F.col("c_acctbal") > 0).alias("solvent"), share(F.col("c_acctbal") > 9000).alias("abstain"))
    first = rows.groupBy("task").agg(F.min("c_mktsegment").alias("active"))
    metrics = F.create_map(*[x for c in ("score", "solvent", "abstain") for x in (F.lit(c), F.col(c))])
    versions = rows.join(first, "task").select(F.concat_ws("-", "task", "c_mktsegment").alias("version"), "task", F.when(F.col("c_mktsegment") == F.col("active"), "ACTIVE").otherwise("CANDIDATE").alias("status"), F.lit(None).cast("string").alias("parent"), metrics.alias("metrics"))
    decisions = ml.gate(versions, versions.filter("status = 'CANDIDATE'"), "score", 0.02, ["solvent"], 0.05, "abstain", 0.05)
    return decisions.select("version", "gain", "adopt", F.array_join("reasons", ",").alias("reasons"))


@query(f"""
    WITH {E}, x AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM e WHERE event_type IN ('click', 'error')),
    c AS (SELECT user_id, k % 2 AS actor, event_id, t, value / 500 AS c, k % 3 AS a, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS source FROM x),
    m AS (SELECT s.event_id, arg_min(f.event_id, (f.t, f.event_id)) AS head FROM c s JOIN c f ON f.user_id = s.user_id AND f.actor = s.actor AND f.source = 1 AND abs(f.t - s.t) <= 28800000000 WHERE s.source = 2 GROUP BY 1),
    g AS (SELECT c.*, CASE WHEN source = 1 THEN event_id ELSE coalesce(head, -event_id) END AS grp FROM c LEFT JOIN m USING (event_id)),
    r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id, actor, grp) AS members, lead(c) OVER w AS nc, lead(a) OVER w AS na FROM g WINDOW w AS (PARTITION BY user_id, actor, grp ORDER BY c DESC, source, t, event_id))
    SELECT event_id, CAST(source AS INTEGER) AS source, members, nc IS NULL OR NOT (a <> na AND c - nc < 0.05) AS resolved FROM r WHERE n = 1
""")
def fused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors as two sources of one actor's events: an error belongs to the earliest click within eight hours; near-equal ones that differ are not resolved."""
    rows = kinded(spark, sf_dir).select("user_id", (F.col("k") % 2).alias("actor"), "event_id", "t", (F.col("value") / 500).alias("c"), (F.col("k") % 3).alias("a"), "event_type")
    side = lambda kind: rows.filter(F.col("event_type") == kind).drop("event_type")
    return temporal.fused_sources(side("click"), side("error"), ["user_id", "actor"], "event_id", "t", "c", "a", 8 * HOUR, 0.05, True, 8 * HOUR).select("event_id", "source", "members", "resolved")


@query()
def added_if_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views whose bracket of two hours overlaps no error's bracket, nor that of a view taken before."""
    side = lambda kind: events(spark, sf_dir, kind).select("user_id", "event_id", (F.col("t") - HOUR).alias("s"), (F.col("t") + HOUR).alias("f"))
    return temporal.added_if_free(side("error"), side("view"), ["user_id"], "event_id", "s", "f", 0, 4 * HOUR, "user_id long")


@query()
def starts_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated starts of one kind fold into the first of them for two days from that first one; the surest reading is named."""
    return fold.fused(events(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", "value", 2 * DAY, "user_id long, event_type string")


@query("""
    WITH x AS (SELECT vec_id, vec_id % 5 AS fold, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i) WHERE label IS NOT NULL),
    l AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) AS len FROM x GROUP BY 1),
    u AS (SELECT vec_id, fold, label, i, v / len AS v FROM x JOIN l USING (vec_id)),
    s AS (SELECT fold, label, i, sum(v) AS v FROM u GROUP BY 1, 2, 3),
    o AS (SELECT f.fold, s.label, s.i, sum(s.v) AS v FROM s JOIN (SELECT DISTINCT fold FROM u) f ON f.fold <> s.fold GROUP BY 1, 2, 3),
    n AS (SELECT fold, label, greatest(sqrt(sum(v * v)), 1e-12) AS len FROM o GROUP BY 1, 2),
    c AS (SELECT u.vec_id, u.fold, u.label, o.label AS guess, sum(u.v * o.v / len) AS s FROM u JOIN o ON o.fold = u.fold AND o.i = u.i JOIN n ON n.fold = o.fold AND n.label = o.label GROUP BY 1, 2, 3, 4),
    p AS (SELECT vec_id, fold, label, arg_max(guess, (s, -guess)) AS guess FROM c GROUP BY 1, 2, 3),
    b AS (SELECT fold, label, count(*) AS n, count(*) FILTER (guess = label) AS hits FROM p GROUP BY 1, 2)
    SELECT fold, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(hits) AS BIGINT) AS hits, avg(hits / CAST(n AS DOUBLE)) AS recall FROM b GROUP BY 1
""")
def left_out_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of prototypes fitted without the fold that they predict, for five folds."""
    return ml.left_out_recall(table(spark, sf_dir, "embeddings").withColumn("fold", F.col("vec_id") % 5), "fold", "label", "embedding")


MODES = f"""
    WITH {E}, l AS (SELECT user_id, event_id, t, CASE WHEN value > 60 THEN event_type END AS label, CASE WHEN t - lag(t) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM l),
    d AS (SELECT *, last_value(label IGNORE NULLS) OVER a AS before, i - max(CASE WHEN label IS NOT NULL THEN i END) OVER a AS db,
        first_value(label IGNORE NULLS) OVER z AS after, min(CASE WHEN label IS NOT NULL THEN i END) OVER z - i AS da FROM s
        WINDOW a AS (PARTITION BY user_id, run ORDER BY i), z AS (PARTITION BY user_id, run ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    m AS (SELECT event_id, CASE WHEN da IS NULL OR db <= da THEN before ELSE after END AS offline, before AS forward_only, CASE WHEN before = after THEN before END AS bracketed FROM d)
"""


def three_runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Unknown labels of day-long chains filled offline (from both sides), forwards only, and where both sides agree."""
    from .mechanisms import near_label

    rows = events(spark, sf_dir).select("user_id", "event_id", "t", F.when(F.col("value") > 60, F.col("event_type")).alias("label"))
    settled = lambda rows, order, both: fixpoint.to_fixpoint(rows, ["user_id"], order, ["label"], [near_label], 1000, both).rows.select("user_id", "event_id", "t", "label")
    forwards = settled(rows, ["t", "event_id"], False)
    backwards = settled(rows.withColumn("__back", -F.col("t")).withColumn("__tie", -F.col("event_id")), ["__back", "__tie"], False).select("event_id", F.col("label").alias("after"))
    agreed = forwards.join(backwards, "event_id").select("event_id", F.when(F.col("label") == F.col("after"), F.col("label")).alias("label"))
    return {"offline": settled(rows, ["t", "event_id"], True), "forward_only": forwards, "bracketed": agreed}


@query(f"{MODES} SELECT event_id, offline, forward_only, bracketed FROM m WHERE offline IS DISTINCT FROM forward_only OR offline IS DISTINCT FROM bracketed")
def mode_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on whose label the three modes don't agree."""
    return runs.run_differences(three_runs(spark, sf_dir), [], "event_id", "label")


@query(f"""
    {MODES}, w AS (SELECT 'offline' AS mode, offline AS v FROM m UNION ALL SELECT 'forward_only', forward_only FROM m UNION ALL SELECT 'bracketed', bracketed FROM m), c AS (SELECT mode, v, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT mode, CAST(sum(n) AS BIGINT) AS samples, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS known, string_agg(v || ':' || n, ',' ORDER BY v) AS states FROM c GROUP BY 1
""")
def mode_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each mode knows, and its states."""
    found = runs.run_coverage(three_runs(spark, sf_dir), [], "event_id", "label")
    return found.withColumn("states", F.array_join(F.transform("states", lambda s: F.concat_ws(":", s["value"], s["n"].cast("string"))), ","))


def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as samples of a display, five seconds apart."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    rows = kinded(spark, sf_dir).withColumn("n", n)
    k, kind = F.col("k"), F.col("event_type")
    columns = {
        "t": F.col("n") * 5.0, "round": F.when(k < 95, F.floor(F.col("n") / 9)), "ordinal": F.when(k < 95, F.floor(F.col("n") / 9)), "role": F.lit("duelist"), "side": F.when(k % 5 == 0, "defense").when(k % 5 < 3, "attack"),
        "own": k % 4 > 0, "hud": k % 7 > 0, "timer": F.when(kind == "view", k + 1.0), "ally": F.when(kind != "error", k % 6).cast("int"), "enemy": F.when(kind != "error", F.floor(k / 10) % 6).cast("int"), "planted": F.when(k % 3 == 0, kind == "purchase"),
        "carried": k % 11 == 0, "charges": F.array(*[F.least(F.lit(1.0), F.col("value") / d) for d in (20, 50, 90, 120)]), "feed": kind == "click", "kills": F.when((kind == "click") & (k % 2 == 0), F.array(F.struct((k % 4 == 0).alias("own_victim"), (k % 6 == 0).alias("own_killer")))), "death": (kind == "error") & (k > 80),
    }
    return rows.select("user_id", *[c.alias(name) for name, c in columns.items()])


@query()
def display_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation, combat and end of each round of the display's samples, with what each was taken from."""
    return samples.round_phases(displayed(spark, sf_dir), ["user_id"], samples.PhaseRules())


@query()
def sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen facts and the events of each of the display's samples."""
    rows = displayed(spark, sf_dir)
    found = samples.sample_facts(rows, samples.round_phases(rows, ["user_id"], samples.PhaseRules()), ["user_id"], samples.SampleRules())
    return found.withColumn("events", F.array_join("events", ","))


def half_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each user's half days as seconds of a display, steps from one to the next as transitions, stretches of twenty as rounds."""
    k = F.col("x.k")
    kind = F.col("x.event_type")
    slot = F.floor(F.col("t") / (DAY // 2)) - 39_446
    each = kinded(spark, sf_dir).groupBy("user_id", slot.alias("second")).agg(F.min_by(F.struct("event_type", "k", "event_id"), F.struct("t", "event_id")).alias("x"))
    value = F.when(kind == "signup", "BUY").when(kind == "purchase", "ENDED").when(kind == "error", "UNKNOWN").otherwise("ACTIVE")
    status = F.when(kind == "error", "UNKNOWN").when(k % 5 == 0, "INFERRED").otherwise("OBSERVED")
    seconds = each.select("user_id", "second", value.alias("value"), status.alias("status"), F.when(k < 80, F.floor(F.col("second") / 20)).alias("number"), F.col("x.event_id").alias("id"))
    order = Window.partitionBy("user_id").orderBy("second")
    steps = seconds.withColumns({"before": F.lag("value").over(order), "lower": F.lag("second").over(order).cast("double")}).filter("before <> value AND id % 3 > 0")
    turn = F.when((F.col("before") == "BUY") & (F.col("value") == "ACTIVE"), "round_start").when(F.col("value") == "ENDED", "round_end")
    transitions = steps.select("user_id", "id", turn.alias("kind"), "lower", F.col("second").cast("double").alias("upper"), "before", F.col("value").alias("after"), F.lit(None).cast("array<bigint>").alias("membership")).filter("kind IS NOT NULL")
    n = F.floor(F.col("second") / 20)
    rounds = seconds.select("user_id", n.alias("number")).distinct().select("user_id", "number", (F.col("number") * 20).alias("low"), (F.col("number") * 20 + 19).alias("high"), (F.col("number") * 20).alias("first"), (F.col("number") * 20 + 12).alias("last"))
    return seconds.drop("id"), transitions, rounds


@query()
def promoted_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends of rounds that pass every gate, or follow from two observed states, or why there is none."""
    parts = half_days(spark, sf_dir)
    start = boundaries.promoted(*parts, ["user_id"], boundaries.Gates("round_start", "BUY", "ACTIVE", 4.0, 3, 2.0, 2))
    end = boundaries.promoted(*parts, ["user_id"], boundaries.Gates("round_end", "ACTIVE", "ENDED", 4.0, 3, 2.0, None))
    return start.withColumn("kind", F.lit("round_start")).unionByName(end.withColumn("kind", F.lit("round_end")))


@query()
def judged_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate start with the first gate that it fails."""
    return boundaries.judged_candidates(*half_days(spark, sf_dir), ["user_id"], boundaries.Gates("round_start", "BUY", "ACTIVE", 4.0, 3, 2.0, 2))
