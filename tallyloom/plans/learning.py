"""Small models fitted from Spark's aggregates: splits by group, folds, learning curves, comparison with the incumbent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import ml
from tallyloom.sources.tables import table

from .catalog import events, query

E = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"
STEPS = f"{E}, s AS (SELECT user_id, event_type, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS y, lead(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS following FROM e)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value and kind of its user's next one; users divisible by three are held out."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).select("user_id", "event_type", F.col("value").alias("x"), F.lead("value").over(order).alias("y"), F.lead("event_type").over(order).alias("following"))
    return rows.filter("y IS NOT NULL").withColumn("held", F.col("user_id") % 3 == 0)


@query(f"""
    WITH {STEPS}, m AS (SELECT event_type, avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) / (regr_sxx(y, x) + 10) AS slope FROM s WHERE y IS NOT NULL AND user_id % 3 > 0 GROUP BY 1)
    SELECT event_type, round(any_value(slope), 6) AS slope, count(*) AS n, round(avg(abs(y - my - slope * (x - mx))), 6) AS ridge, round(avg(abs(y - my)), 6) AS centroid FROM s JOIN m USING (event_type) WHERE y IS NOT NULL AND user_id % 3 = 0 GROUP BY 1
""")
def ridge_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next value by a ridge line (penalty 10) and by the mean, fitted on some users and compared on the others."""
    rows = steps(spark, sf_dir)
    m = rows.filter("NOT held").groupBy("event_type").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.regr_sxy("y", "x") / (F.regr_sxx("y", "x") + 10)).alias("slope"))
    both = rows.filter("held").join(m, "event_type")
    return both.groupBy("event_type").agg(F.round(F.first("slope"), 6).alias("slope"), F.count("*").alias("n"), F.round(F.avg(F.abs(F.expr("y - my - slope * (x - mx)"))), 6).alias("ridge"), F.round(F.avg(F.abs(F.expr("y - my"))), 6).alias("centroid"))


@query(f"""
    WITH {STEPS}, c AS (SELECT event_type, following, count(*) AS n FROM s WHERE following IS NOT NULL AND user_id % 3 > 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, following) AS place FROM c)
    SELECT s.event_type, count(*) AS n, count(*) FILTER (place = 1) AS first, count(*) FILTER (place <= 2) AS first_two, count(*) FILTER (place IS NULL) AS unseen FROM s LEFT JOIN r ON s.event_type = r.event_type AND s.following = r.following WHERE s.following IS NOT NULL AND user_id % 3 = 0 GROUP BY 1
""")
def transition_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next kinds ranked by the transitions of some users; how high the true one stands for the others."""
    rows = steps(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "following"))  # a row for each pair of kinds
    ranked = rows.filter("NOT held").groupBy("event_type", "following").agg(F.count("*").alias("n")).withColumn("place", place).drop("n")
    both = rows.filter("held").join(ranked, ["event_type", "following"], "left")
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 1).alias("first"), F.count_if(F.col("place") <= 2).alias("first_two"), F.count_if(F.col("place").isNull()).alias("unseen"))


@query("""
    WITH l AS (SELECT l_orderkey % 10 AS part, l_returnflag AS flag, l_quantity AS x FROM lineitem),
    m AS (SELECT size, flag, avg(x) AS mean, median(x) AS median FROM l JOIN (SELECT unnest([1, 2, 4, 8]) AS size) ON part < size GROUP BY 1, 2),
    v AS (SELECT size, flag, 'mean' AS variant, mean AS c FROM m UNION ALL SELECT size, flag, 'median', median FROM m),
    q AS (SELECT DISTINCT x, flag AS truth, count(*) OVER (PARTITION BY x, flag) AS n FROM l WHERE part >= 8),
    r AS (SELECT size, variant, truth, n, v.flag, row_number() OVER (PARTITION BY size, variant, x, truth ORDER BY abs(x - c), v.flag) AS k FROM q, v)
    SELECT CAST(size AS BIGINT) AS size, variant, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (flag = truth), 0) AS BIGINT) AS hits FROM r WHERE k = 1 GROUP BY 1, 2
""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of nearest centroids (means and medians) by the share of rows that they were fitted on; equal held-out rows are
    counted before they meet the models."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"))
    sizes = F.filter(F.array(*[F.lit(s).cast("long") for s in (1, 2, 4, 8)]), lambda s: s > F.col("part"))
    m = rows.filter("part < 8").select("flag", "x", F.explode(sizes).alias("size")).groupBy("size", "flag").agg(F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"))
    variants = m.select("size", "flag", F.explode(F.create_map(F.lit("mean"), "mean", F.lit("median"), "median")).alias("variant", "c"))
    models = variants.groupBy("size", "variant").agg(F.collect_list(F.struct("flag", "c")).alias("m"))  # three flags
    held = rows.filter("part >= 8").groupBy("x", F.col("flag").alias("truth")).agg(F.count("*").alias("n"))
    all_models = models.agg(F.collect_list(F.struct("size", "variant", "m")).alias("models")).withColumn("one", F.lit(1))  # eight
    met = held.withColumn("one", F.lit(1)).join(all_models, "one").select("x", "truth", "n", F.inline("models"))
    nearest = F.array_min(F.transform("m", lambda v: F.struct(F.abs(F.col("x") - v["c"]).alias("d"), v["flag"].alias("flag"))))["flag"]
    return met.withColumn("flag", nearest).groupBy("size", "variant").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("flag") == F.col("truth"), F.col("n")).otherwise(0)).alias("hits"))


@query("""
    WITH l AS (SELECT l_linestatus AS grp, CASE WHEN l_orderkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split, CAST(round(l_discount * 100) AS BIGINT) AS x, l_returnflag = 'R' AS y, count(*) AS n FROM lineitem GROUP BY ALL),
    h AS (SELECT grp, split, c, CAST(sum(n) FILTER (y = (x >= c)) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS n FROM l, (SELECT unnest([2, 4, 6, 8, 11]) AS c) GROUP BY 1, 2, 3),
    b AS (SELECT grp, c, row_number() OVER (PARTITION BY grp ORDER BY hits DESC, c) AS k FROM h WHERE split = 'validation')
    SELECT b.grp, CAST(b.c AS BIGINT) AS chosen, coalesce(t.hits, 0) AS challenger, coalesce(i.hits, 0) AS champion, t.n, CASE WHEN coalesce(t.hits, 0) > coalesce(i.hits, 0) THEN 'adopt' ELSE 'keep' END AS decision
    FROM b JOIN h t ON t.grp = b.grp AND t.c = b.c AND t.split = 'test' JOIN h i ON i.grp = b.grp AND i.c = 4 AND i.split = 'test' WHERE k = 1
""")
def train_validate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold chosen on one split and compared on another with the one in use (4); one scan counts both splits."""
    x, split = F.round(F.col("l_discount") * 100).cast("long"), F.when(F.col("l_orderkey") % 10 < 8, "validation").otherwise("test")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("grp"), split.alias("split"), x.alias("x"), (F.col("l_returnflag") == "R").alias("y")).agg(F.count("*").alias("n"))
    cuts = rows.withColumn("c", F.explode(F.array(*[F.lit(c).cast("long") for c in (2, 4, 6, 8, 11)])))
    right = F.when(F.col("y") == (F.col("x") >= F.col("c")), F.col("n")).otherwise(0)
    on = lambda name: F.when(F.col("split") == name, right).otherwise(0)
    h = cuts.groupBy("grp", "c").agg(F.sum(on("validation")).alias("v"), F.sum(on("test")).alias("t"), F.sum(F.when(F.col("split") == "test", F.col("n"))).alias("n"))
    best = h.groupBy("grp").agg(F.max(F.struct("v", (-F.col("c")).alias("less"), "t", "n")).alias("b"), F.max(F.when(F.col("c") == 4, F.col("t"))).alias("champion"))
    return best.select("grp", (-F.col("b.less")).alias("chosen"), F.col("b.t").alias("challenger"), "champion", F.col("b.n").alias("n"), F.when(F.col("b.t") > F.col("champion"), "adopt").otherwise("keep").alias("decision"))


@query()
def left_out_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group scored by a class-balanced logistic model of the other groups."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    models = ml.left_out_logistic(rows, "grp", "y", ["a", "b"], penalty=1.0)
    z = F.element_at("w", 1) + F.element_at("w", 2) * F.col("a") + F.element_at("w", 3) * F.col("b")
    # A model a group, 100 at most: rows stay where they are, and weights don't go through their aggregate.
    scored = rows.join(F.broadcast(models), "grp").withColumn("said", (z >= 0).cast("int"))
    counts = scored.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("y")).alias("hits"))
    return counts.join(F.broadcast(models), "grp").select("grp", "n", "hits", "w")


@query()
def frame_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines matched one to one with the slots that fit them best in sum."""
    # Dealt by order before lines meet slots: the pairs, seven times the lines, are not shuffled.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("slot")
    return ml.assigned(lines.select("l_orderkey", "l_linenumber", "part", slots).withColumn("score", (F.col("part") * (F.col("slot") + 1) % 97).cast("double")), ["l_orderkey"], "l_linenumber", "slot", "score")


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their four main axes, whitened."""
    return ml.projected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, whiten=True)
