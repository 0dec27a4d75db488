"""Learning operators against plain numpy and brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tallyloom import plans
from tallyloom.operators import ml


def newton(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    c = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    ridge = np.diag([0.0, *[penalty] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (y - p)) - ridge @ w)
    return w


def test_left_out_logistic_against_numpy(spark: SparkSession) -> None:
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)]
    rows = [(g, int(a - 0.5 * b + rng.gauss(0, 1) > 0.8), a, b) for g, a, b in rows]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("b", 1, None, 1.0)], "g string, y int, a double, b double")
    got = {r.g: np.array(r.w) for r in ml.left_out_logistic(df, "g", "y", ["a", "b"], 2.0).collect()}
    assert set(got) == set("abc")
    for g, w in got.items():
        other = [r for r in rows if r[0] != g]
        assert np.allclose(w, newton(np.array([r[2:] for r in other]), np.array([r[1] for r in other]), 2.0), atol=1e-6)


def test_left_out_logistic_without_both_classes(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 1.0)], "g string, y int, a double")
    assert ml.left_out_logistic(df, "g", "y", ["a"], 1.0).count() == 0
    assert ml.left_out_logistic(df.limit(0), "g", "y", ["a"], 1.0).count() == 0


def test_assignment_against_all_permutations(spark: SparkSession) -> None:
    rng = random.Random(8)
    rows = [(k, i, j, float(rng.randrange(50))) for k in range(40) for i in range(rng.randrange(1, 5)) for j in range(rng.randrange(1, 6)) if rng.random() < 0.9]
    rows = list({(k, i, j): s for k, i, j, s in rows}.items())
    rows = [(*key, s) for key, s in rows]
    got = ml.assigned(spark.createDataFrame(rows, "k long, i long, j long, s double").repartition(3), ["k"], "i", "j", "s").collect()
    score = {r[:3]: r[3] for r in rows}
    assert len({(r.k, r.i) for r in got}) == len({(r.k, r.j) for r in got}) == len(got)
    assert all(score[r.k, r.i, r.j] == r.s for r in got)
    for k in {r[0] for r in rows}:
        lefts, rights = sorted({r[1] for r in rows if r[0] == k}), sorted({r[2] for r in rows if r[0] == k})
        best = max(sum(score.get((k, i, j), 0.0) for i, j in zip(lefts, p, strict=True) if j is not None) for p in itertools.permutations([*rights, *[None] * len(lefts)], len(lefts)))
        assert sum(r.s for r in got if r.k == k) == best


def test_assignment_of_text_nulls_and_repeated_pairs(spark: SparkSession) -> None:
    rows = [("k", "b", 20, 1.0), ("k", "b", 20, 5.0), ("k", "a", 20, 4.0), ("k", "a", 3, 4.0), ("k", "c", 3, -1.0), ("k", "c", 20, None), (None, "a", 3, 0.0), ("n", "a", 3, float("nan"))]
    got = ml.assigned(spark.createDataFrame(rows, "k string, i string, j int, s double"), ["k"], "i", "j", "s").collect()
    assert {tuple(r) for r in got} == {("k", "a", 3, 4.0), ("k", "b", 20, 5.0), (None, "a", 3, 0.0)}


def test_orders_lines_are_shuffled_once_and_before_their_slots(spark: SparkSession) -> None:
    plan = plans.QUERIES["frame_assignment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_models_of_groups_are_not_sorted_with_their_rows(spark: SparkSession) -> None:
    plan = plans.QUERIES["left_out_logistic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_assignment_of_too_many_is_refused(spark: SparkSession) -> None:
    df = spark.createDataFrame([(0, 0, j, 1.0) for j in range(5)], "k long, i long, j long, s double")
    with pytest.raises(Exception, match="more than 4"):
        ml.assigned(df, ["k"], "i", "j", "s", most=4).collect()


@pytest.mark.parametrize("whiten", [False, True])
def test_projection_against_svd(spark: SparkSession, whiten: bool) -> None:
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) * [5, 4, 3, 1, 1, 1] + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = {r.id: r.axes for r in ml.projected(df, "id", "v", 3, whiten).collect()}
    _, s, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    axes = axes[:3].T * np.sign(axes[:3][np.arange(3), np.abs(axes[:3]).argmax(axis=1)])
    want = (x - x.mean(axis=0)) @ axes / (s[:3] / np.sqrt(199) if whiten else 1)
    assert set(got) == set(range(200)) and np.allclose([got[i] for i in range(200)], want, atol=1e-6)


def test_self_training_moves_prototypes_to_sure_rows(spark: SparkSession) -> None:
    labelled = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "id long, label string, v array<double>")
    unlabelled = spark.createDataFrame([(2, [0.9, 0.3]), (3, [0.2, 0.9]), (4, [0.7, 0.7])], "id long, v array<double>")
    got = {r.label: np.array(r.prototype) for r in ml.self_train(labelled, unlabelled, "id", "label", "v", 0.3, 1).collect()}
    unit = lambda *v: np.array(v) / np.linalg.norm(v)
    assert np.allclose(got["a"], unit(*(unit(1, 0) + unit(0.9, 0.3)))) and np.allclose(got["b"], unit(*(unit(0, 1) + unit(0.2, 0.9))))


def test_adoption_needs_gain_and_no_deep_drop(spark: SparkSession) -> None:
    def decided(*scores: tuple[float, float]) -> str:
        rows = [(str(i), role, s) for i, pair in enumerate(scores) for role, s in zip(("champion", "challenger"), pair, strict=True)]
        return ml.adopt(spark.createDataFrame(rows, "group string, role string, score double"), 0.02, 0.05).first().decision

    assert decided((0.5, 0.6), (0.5, 0.5)) == "adopt"
    assert decided((0.5, 0.9), (0.5, 0.4)) == "reject"
    assert decided((0.5, 0.51), (0.5, 0.5)) == "reject"


def test_self_training_takes_the_surest_rows_of_each_class(spark: SparkSession) -> None:
    rng = np.random.default_rng(4)
    known = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    rows = [(i, [float(x) for x in rng.normal(0, 1, 2)]) for i in range(60)]
    labelled = spark.createDataFrame(known, "label string, v array<double>")
    got = {r.label: np.array(r.prototype) for r in ml.self_train(labelled, spark.createDataFrame(rows, "id long, v array<double>"), "id", "label", "v", 0.1, 3, 5, 4.0).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    model = {k: unit(v) for k, v in known}
    for _ in range(3):
        sums = {k: 4.0 * unit(v) for k, v in known}
        gaps = {k: [] for k in model}
        for i, v in rows:
            (s1, k1), (s2, _) = sorted(((float(unit(v) @ p), k) for k, p in model.items()), reverse=True)
            if s1 - s2 >= 0.1:
                gaps[k1].append((-(s1 - s2), i))
        for k, found in gaps.items():
            for _, i in sorted(found)[:5]:
                sums[k] = sums[k] + unit(rows[i][1])
        model = {k: unit(v) for k, v in sums.items()}
    assert all(np.allclose(got[k], model[k]) for k in model)


VERSIONS = "version string, task string, status string, parent string, metrics map<string,double>"


@pytest.mark.parametrize(("metrics", "reasons"), [({"m": 0.52, "g": 0.5}, []), ({"m": 0.51, "g": 0.5}, ["gain"]), ({"m": 0.6, "g": 0.44}, ["guard:g"]), ({"m": 0.6, "g": 0.46}, []), ({"m": 0.6, "g": 0.5, "abstain": 0.11}, ["abstain"]), ({"m": 0.6, "g": 0.5, "abstain": 0.09}, []), ({}, ["gain", "guard:g"])])
def test_gate_decision_and_rollback(spark: SparkSession, metrics: dict, reasons: list[str]) -> None:
    versions = spark.createDataFrame([("v1", "t", "ACTIVE", None, {"m": 0.5, "g": 0.5}), ("v2", "t", "CANDIDATE", None, metrics), ("w", "u", "CANDIDATE", None, {})], VERSIONS)
    decisions = ml.gate(versions, versions.filter("status = 'CANDIDATE'"), "m", 0.015, ["g"], 0.05, "abstain", 0.1)
    got = {r.version: (r.baseline, r.adopt, r.reasons) for r in decisions.collect()}
    assert got == {"v2": ("v1", not reasons, reasons), "w": (None, True, [])}
    after = ml.decided(versions, decisions)
    status = {r.version: (r.status, r.parent) for r in after.collect()}
    assert status == {"v1": ("ACTIVE", None) if reasons else ("RETIRED", None), "v2": ("REJECTED", None) if reasons else ("ACTIVE", "v1"), "w": ("ACTIVE", None)}
    back = {r.version: r.status for r in ml.rolled_back(after, spark.createDataFrame([("t",), ("u",)], "task string")).collect()}
    assert back == {"v1": "ACTIVE", "v2": "REJECTED" if reasons else "ROLLED_BACK", "w": "ACTIVE"}
