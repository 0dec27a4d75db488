"""Small learning operators on array columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from tallyloom.sources.tables import cut



def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v over its length, or over 1e-12 if that is larger."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def prototypes(rows: DataFrame, label: str, vector: str, weight: str | None = None) -> DataFrame:
    """The normalised sum of each label's normalised vectors, each times its weight."""
    own = F.lit(1.0) if weight is None else F.col(weight)
    parts = rows.select(label, own.alias("__w"), F.posexplode(normalised(F.col(vector))).alias("pos", "x")).withColumn("x", F.col("x") * F.col("__w"))
    sums = parts.groupBy(label, "pos").agg(F.sum("x").alias("x"))
    arrays = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("prototype"))
    return arrays.withColumn("prototype", normalised(F.col("prototype")))


def predict_with_margin(rows: DataFrame, model: DataFrame, ident: str, label: str, vector: str, margin: float, most_labels: int = 10_000) -> DataFrame:
    """The label with the highest cosine, null if the next one is nearer than margin. model has one row per label; their
    number is checked before they are sent to every task, which multiplies whole batches."""
    known = model.select(label, "prototype").orderBy(label).limit(most_labels + 1).collect()
    if len(known) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r in known], [r[1] for r in known]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, prototypes = shared.value
        weights = np.array(prototypes, np.float64)
        for frame in frames:
            vectors = np.array(frame["__v"].tolist(), np.float64)
            if not len(labels) or not len(vectors):
                yield pd.DataFrame({ident: frame[ident], "predicted": [None] * len(frame)})
                continue
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            scores = vectors @ weights.T
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(best)), best]
            scores[np.arange(len(best)), best] = -np.inf
            sure = top - scores.max(axis=1) >= margin
            yield pd.DataFrame({ident: frame[ident], "predicted": [labels[b] if ok else None for b, ok in zip(best, sure, strict=True)]})

    out = StructType([rows.schema[ident], StructField("predicted", model.schema[label].dataType)])
    return rows.filter(F.col(vector).isNotNull()).select(ident, F.col(vector).alias("__v")).mapInPandas(run, out)


def with_gaps(rows: DataFrame, model: DataFrame, ident: str, label: str, vector: str, most_labels: int = 10_000) -> DataFrame:
    """ident, predicted (the label with the highest cosine, the smallest of equals), top (that cosine) and gap (to the next label's; to 0 if there is one label)."""
    known = model.select(label, "prototype").orderBy(label).limit(most_labels + 1).collect()
    if len(known) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    labels, weights = [r[0] for r in known], np.array([r[1] for r in known], np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = np.array(frame["__v"].tolist(), np.float64)
            if not len(labels) or not len(vectors):
                continue
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            scores = vectors @ weights.T
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(best)), best]
            scores[np.arange(len(best)), best] = -np.inf
            second = scores.max(axis=1) if len(labels) > 1 else np.zeros(len(best))
            yield pd.DataFrame({ident: frame[ident], "predicted": [labels[b] for b in best], "top": top, "gap": top - second})

    out = StructType([rows.schema[ident], StructField("predicted", model.schema[label].dataType), StructField("top", DoubleType()), StructField("gap", DoubleType())])
    return rows.filter(F.col(vector).isNotNull()).select(ident, F.col(vector).alias("__v")).mapInPandas(run, out)


def self_train(labelled: DataFrame, unlabelled: DataFrame, ident: str, label: str, vector: str, margin: float, rounds: int = 3, most_per_class: int | None = None, anchor_weight: float = 1.0) -> DataFrame:
    """Prototypes after adding confidently predicted rows in each round: those whose gap to the next label is `margin` or more, of each label the `most_per_class` with the
    largest gaps (ties to the smaller ident). Labelled rows count anchor_weight times. Every round starts from the labelled rows alone."""
    anchors = labelled.select(label, vector, F.lit(anchor_weight).alias("__weight"))
    model = cut(prototypes(anchors, label, vector, "__weight"))
    for _ in range(rounds):
        sure = with_gaps(unlabelled, model, ident, label, vector).filter(F.col("gap") >= margin)
        if most_per_class is not None:
            best = Window.partitionBy("predicted").orderBy(F.desc("gap"), ident)
            sure = sure.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most_per_class)
        more = unlabelled.join(sure.select(ident, "predicted"), ident).select(F.col("predicted").alias(label), vector, F.lit(1.0).alias("__weight"))
        model = cut(prototypes(anchors.unionByName(more), label, vector, "__weight"))
    return model


def adopt(metrics: DataFrame, gain: float, most_drop: float) -> DataFrame:
    """Champion and challenger by group (group, role, score): adopt if the mean gain is enough and no group drops too far."""
    pairs = metrics.groupBy("group").pivot("role", ["champion", "challenger"]).agg(F.max("score"))
    total = pairs.agg(F.avg(F.col("challenger") - F.col("champion")).alias("gain"), F.min(F.col("challenger") - F.col("champion")).alias("worst"))
    return total.withColumn("decision", F.when((F.col("gain") >= gain) & (F.col("worst") >= -most_drop), "adopt").otherwise("reject"))


def gate(versions: DataFrame, candidates: DataFrame, metric: str, min_gain: float, guards: Sequence[str], most_drop: float, abstain: str, most_abstain: float) -> DataFrame:
    """version, task, baseline, gain, adopt and reasons of each candidate (version) against its task's active version. It is refused for a gain in the metric below min_gain, for each
    guard metric that drops by more than most_drop, and for an abstain rate that rises by more than most_abstain. A metric that the candidate lacks is the worst
    there is, one that the active version lacks is 0. Without an active version it is adopted. versions: version, task, status, parent, metrics (map)."""
    active = versions.filter("status = 'ACTIVE'").select("task", F.col("version").alias("baseline"), F.col("metrics").alias("__old"))
    both = versions.join(candidates.select("version").distinct(), "version").join(active, "task", "left")
    new = lambda m: F.coalesce(F.try_element_at("metrics", F.lit(m)), F.lit(float("-inf")))
    old = lambda m: F.coalesce(F.try_element_at("__old", F.lit(m)), F.lit(0.0))
    rise = F.coalesce(F.try_element_at("metrics", F.lit(abstain)), F.lit(0.0)) - old(abstain)
    broken = [F.when(new(metric) - old(metric) < min_gain, "gain"), *[F.when(old(g) - new(g) > most_drop, f"guard:{g}") for g in guards], F.when(rise > most_abstain, "abstain")]
    reasons = F.when(F.col("baseline").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken)))
    return both.select("version", "task", "baseline", F.when(F.col("baseline").isNotNull(), new(metric) - old(metric)).alias("gain"), (F.size(reasons) == 0).alias("adopt"), reasons.alias("reasons"))


def decided(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """versions after decisions of a gate, one for a task: an adopted one is ACTIVE and has the one before as parent, which is RETIRED; others are REJECTED."""
    own = decisions.select("version", F.col("adopt").alias("__adopt"), F.col("baseline").alias("__baseline"))
    left = decisions.filter("adopt AND baseline IS NOT NULL").select(F.col("baseline").alias("version"), F.lit(True).alias("__left"))
    joined = versions.join(own, "version", "left").join(left, "version", "left")
    status = F.when(F.col("__left"), "RETIRED").when(F.col("__adopt"), "ACTIVE").when(~F.col("__adopt"), "REJECTED").otherwise(F.col("status"))
    parent = F.when(F.col("__adopt"), F.col("__baseline")).otherwise(F.col("parent"))
    return joined.withColumns({"status": status, "parent": parent}).select(versions.columns)


def rolled_back(versions: DataFrame, tasks: DataFrame) -> DataFrame:
    """versions after the active one of each task (table of tasks) gave way to its parent; one without a parent stays."""
    going = versions.filter("status = 'ACTIVE' AND parent IS NOT NULL").join(tasks.select("task").distinct(), "task").select(F.col("version").alias("__going"), F.col("parent").alias("__back"))
    out = versions.join(going.select(F.col("__going").alias("version"), F.lit(True).alias("__out")), "version", "left").join(going.select(F.col("__back").alias("version"), F.lit(True).alias("__in")), "version", "left")
    return out.withColumn("status", F.when(F.col("__out"), "ROLLED_BACK").when(F.col("__in"), "ACTIVE").otherwise(F.col("status"))).select(versions.columns)


def left_out_recall(rows: DataFrame, group: str, label: str, vector: str, most_groups: int = 100) -> DataFrame:
    """group, rows, hits and recall (the mean over the group's labels of the share that is predicted right) of each group, predicted by prototypes of all other groups' rows: fitted once for every group, as all
    sums less the group's own. The driver holds a sum for each group and label (groups are counted first); labels that no other group has are not predicted. Rows with a null take no part."""
    used = cut(rows.filter(F.col(group).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(label).alias("l"), normalised(F.col(vector)).alias("v")))
    if used.select("g").distinct().limit(most_groups + 1).count() > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    parts = used.select("g", "l", F.posexplode("v").alias("pos", "x")).groupBy("g", "l", "pos").agg(F.sum("x").alias("x"))
    sums = {(r["g"], r["l"]): np.array([x["x"] for x in r["v"]]) for r in parts.groupBy("g", "l").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()}
    labels = sorted({label for _, label in sums})
    models = {}
    for g in {g for g, _ in sums}:
        rest = {name: [v for (h, other), v in sums.items() if other == name and h != g] for name in labels}
        known = [name for name in labels if rest[name]]
        if known:
            weights = np.array([np.sum(rest[name], axis=0) for name in known])
            models[g] = known, weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hit = np.zeros(len(frame), bool)
            for g, places in frame.groupby("g", sort=False).indices.items():
                if g in models:
                    known, weights = models[g]
                    best = (np.array(frame["v"].iloc[places].tolist()) @ weights.T).argmax(axis=1)
                    hit[places] = [known[b] == name for b, name in zip(best, frame["l"].iloc[places], strict=True)]
            yield pd.DataFrame({"g": frame["g"], "l": frame["l"], "hit": hit})

    told = used.mapInPandas(run, StructType([used.schema["g"], used.schema["l"], StructField("hit", BooleanType())]))
    by_label = told.groupBy("g", "l").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits"))
    return by_label.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("rows"), F.sum("hits").alias("hits"), F.avg(F.col("hits") / F.col("n")).alias("recall"))


def left_out_logistic(rows: DataFrame, group: str, label: str, features: Sequence[str], penalty: float, steps: int = 30, most_groups: int = 100) -> DataFrame:
    """For each group the logistic model (w: intercept, then one weight a feature) of all other groups' rows, label 0 or 1,
    both classes of equal weight, features' weights penalised by penalty / 2 times their squares. Newton steps for all models
    at once, one aggregation each; the driver holds a row of sums for each group. Groups are counted first. A group without
    rows of both classes beside it has no model; rows with a null take no part."""
    used = rows.select(F.col(group).alias("g"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features, 1)]).dropna()
    used = cut(used)  # every step reads the narrow rows, not the source
    counts = used.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).limit(most_groups + 1).collect()
    if len(counts) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    n, ones, d = sum(r["n"] for r in counts), sum(r["ones"] for r in counts), len(features) + 1
    balance = {r["g"]: ((n - r["n"]) / 2, n - r["n"] - ones + r["ones"], ones - r["ones"]) for r in counts}
    weights = {g: np.zeros(d) for g, (_, zeros, rest) in balance.items() if zeros and rest}
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, d)]]
    ridge = np.diag([0.0, *[penalty] * (d - 1)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    left = set(weights)
    for _ in range(steps if weights else 0):
        models = [F.struct(F.lit(g).alias("g"), *[F.lit(float(v)).alias(f"w{i}") for i, v in enumerate(weights[g])], F.lit(balance[g][0] / balance[g][1]).alias("zero"), F.lit(balance[g][0] / balance[g][2]).alias("one")) for g in left]
        each = used.withColumn("m", F.explode(F.array(*models))).filter(F.col("m.g") != F.col("g"))
        z = sum((F.col(f"m.w{i}") * x[i] for i in range(d)), F.lit(0.0))
        each = each.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("c", F.when(F.col("y") == 1, F.col("m.one")).otherwise(F.col("m.zero")))
        sums = [F.sum(F.col("c") * (F.col("y") - F.col("p")) * x[i]).alias(f"s{i}") for i in range(d)]
        sums += [F.sum(F.col("c") * F.col("p") * (1 - F.col("p")) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]
        for r in each.groupBy(F.col("m.g").alias("of")).agg(*sums).collect():
            hessian = np.zeros((d, d))
            for i, j in pairs:
                hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"]
            g = r["of"]
            step = np.linalg.solve(hessian + ridge, np.array([r[f"s{i}"] for i in range(d)]) - ridge @ weights[g])
            weights[g] = weights[g] + step
            if np.abs(step).max() < 1e-9:
                left.discard(g)
        if not left:
            break
    schema = StructType([StructField(group, rows.schema[group].dataType), StructField("w", ArrayType(DoubleType()))])
    return rows.sparkSession.createDataFrame([(g, w.tolist()) for g, w in weights.items()], schema)


def assigned(rows: DataFrame, keys: Sequence[str], left: str, right: str, score: str, most: int = 12) -> DataFrame:
    """Of each key's (left, right, score) rows the one-to-one pairs with the highest sum: keys, left, right, score. Left values
    in order take the smaller right one of equal sums; nothing is paired without a row or below a score of zero. A key holds
    `most` different right values at most (checked); the best sums of all their subsets are worked out for many keys at a time."""
    each = rows.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).cast("double").alias("s")))).alias("__pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            key = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            pairs = lists.flatten()
            value = pairs.field(2).to_numpy(zero_copy_only=False)
            (row, lefts), (column, rights) = (numbered(key, pairs.field(i), batch.num_rows) for i in (0, 1))
            if rights.max(initial=0) > most:
                raise ValueError(f"more than {most} values of {right} for one key")
            shape, of = np.unique(lefts * (most + 1) + rights, return_inverse=True)
            found = [np.zeros(0, np.int64)]
            for at, (n, m) in enumerate(zip(shape // (most + 1), shape % (most + 1), strict=True)):
                own = of == at
                place = np.cumsum(own) - 1
                mine = np.flatnonzero(own[key] & ~np.isnan(value))  # by key, then left, right and score
                block = max(1, 1_000_000 // (int(n) << int(m)))
                ends = np.searchsorted(place[key[mine]], np.arange(0, own.sum() + block, block))
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    some = mine[a:b]
                    found.append(matched(row[some], column[some], place[key[some]] % block, value[some], some, n, m))
            best = np.concatenate(found)
            own_key = [c.take(pa.array(key[best])) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own_key, *[pairs.field(i).take(pa.array(best)) for i in range(3)]], names=[*keys, left, right, score])

    fields = [rows.schema[c] for c in (*keys, left, right)] + [StructField(score, DoubleType())]
    return each.mapInArrow(run, StructType(fields))


def numbered(key: np.ndarray, values: pa.Array, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place (from 0) among its key's different values in order, and how many of them each key has."""
    coded = values.dictionary_encode(null_encoding="encode")
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    size = max(1, len(rank))
    known, at = np.unique(key * size + rank[coded.indices.to_numpy()], return_inverse=True)
    first = np.searchsorted(known, np.arange(keys + 1) * size)
    return at - first[key], np.diff(first)


def matched(row: np.ndarray, column: np.ndarray, group: np.ndarray, value: np.ndarray, ident: np.ndarray, n: int, m: int) -> np.ndarray:
    """The idents of the best pairs of each group of n lefts (row) and m rights (column); of a pair's values the last counts."""
    groups = int(group.max(initial=-1)) + 1
    scores, named = np.full((n, m, groups), -np.inf), np.zeros((n, m, groups), np.int64)
    scores[row, column, group], named[row, column, group] = value, ident
    masks = np.arange(1 << m)
    used = m - np.bitwise_count(masks).astype(int)
    best = np.zeros((1 << m, groups))  # of the lefts from i on, with the rights of the mask left
    taken = np.full((n, 1 << m, groups), -1, np.int8)
    for i in reversed(range(n)):
        rest = best
        best = rest.copy()
        for j in reversed(range(m)):
            free = masks[(masks >> j & 1 == 1) & (used <= i)]  # i lefts have taken i rights at most
            with_j, without = rest[free ^ (1 << j)] + scores[i, j], best[free]
            better = with_j >= without
            best[free] = np.where(better, with_j, without)
            taken[i, free] = np.where(better, np.int8(j), taken[i, free])
    mask = np.full(groups, (1 << m) - 1)
    out = []
    for i in range(n):
        j = taken[i, mask, np.arange(groups)]
        who = np.flatnonzero(j >= 0)
        out.append(named[i, j[who], who])
        mask[who] ^= 1 << j[who].astype(np.int64)
    return np.concatenate(out)


def projected(rows: DataFrame, ident: str, vector: str, k: int, whiten: bool = False) -> DataFrame:
    """ident and `axes`: centred vectors on their k main axes, each axis with its largest weight positive, over its standard
    deviation if whitened. Vectors are of one length; null ones take no part. The driver holds a matrix of that length squared."""
    used = rows.filter(F.col(vector).isNotNull()).select(ident, F.col(vector).cast("array<double>").alias("__v"))
    vectors = used.select(array_to_vector("__v").alias("v"))
    if vectors.isEmpty():
        return used.select(ident, F.array().cast("array<double>").alias("axes"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    stats = vectors.agg(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).select("s.mean", "s.variance").first()
    axes, mean = model.pc.toArray(), stats["mean"].toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    spread = np.sqrt(model.explainedVariance.toArray() * stats["variance"].toArray().sum()) if whiten else np.ones(k)
    spread = np.maximum(spread, 1e-12)
    listed = lambda values: F.lit([float(x) for x in values])
    columns = [(dot(F.col("__v"), listed(axes[:, i])) - float(mean @ axes[:, i])) / float(spread[i]) for i in range(k)]
    return used.select(ident, F.array(*columns).alias("axes"))
