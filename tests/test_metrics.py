"""Metrics, balancing, reports against brute force on small frames."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import prepare, reports


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_pair_count(spark):
    rnd = random.Random(3)
    ys = [rnd.randint(0, 1) for _ in range(400)]
    ss = [rnd.randint(0, 20) / 4 for _ in range(400)]
    df = spark.createDataFrame(list(zip(ys, ss)), "pos int, score double")
    got = M.auc(df, "score", "pos").first()["auc"]
    assert abs(got - _brute_auc(ys, ss)) < 1e-12


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "pos int, score double")
    assert M.auc(df, "score", "pos").first()["auc"] is None


def test_auc_invariant_to_monotone_map(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(200)]
    a = spark.createDataFrame(rows, "pos int, score double")
    b = a.withColumn("score", F.exp(F.col("score") * 3))
    assert abs(M.auc(a, "score", "pos").first()[0] - M.auc(b, "score", "pos").first()[0]) < 1e-12


def test_single_label_metrics_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, pred int")
    got = {r.metric: r.value for r in M.single_label_metrics(df).collect()}
    labels = sorted({y for y, _ in rows} | {p for _, p in rows})
    f1s, sup = {}, {}
    for c in labels:
        tp = sum(1 for y, p in rows if y == c and p == c)
        fp = sum(1 for y, p in rows if y != c and p == c)
        fn = sum(1 for y, p in rows if y == c and p != c)
        f1s[c] = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        sup[c] = sum(1 for y, _ in rows if y == c)
    assert abs(got["f1_macro"] - sum(f1s.values()) / len(labels)) < 1e-12
    assert abs(got["f1"] - sum(sup[c] * f1s[c] for c in labels) / len(rows)) < 1e-12
    assert abs(got["accuracy"] - sum(1 for y, p in rows if y == p) / len(rows)) < 1e-12


def test_multilabel_empty_row_argmax_zero(spark):
    from tessera.functions.labels import argmax
    df = spark.createDataFrame([([0, 0],), ([0, 1],)], "y array<int>")
    assert [r.a for r in df.select(argmax(F.col("y")).alias("a")).collect()] == [0, 1]


def test_balance_keeps_null_labels(spark):
    labels = ["A"] * 3 + ["B"] * 5 + [None] * 2
    df = spark.createDataFrame([(f"r{i}", lab) for i, lab in enumerate(labels)],
                               "record_id string, label string")
    out = prepare.balance_by_label(df)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"A": 3, "B": 3, None: 2}


def test_percentile_linear(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 4.0)], "layer int, score double")
    r = reports.robustness_summary(df).first()
    assert abs(r.ci95_low - 1.05) < 1e-12


def test_comparison_rule(spark):
    probe = spark.createDataFrame([("t", 1, 0.80)], "task string, best_layer int, best_score double")
    base = spark.createDataFrame([("t", "logistic", 0.77)], "task string, estimator string, "
                                                            "baseline_score double")
    r = reports.compare_to_baselines(probe, base, ["task"]).first()
    assert r.comparable is True and r.ok is False and abs(r.gap - 0.03) < 1e-12


def test_best_layer_ties_take_lowest(spark):
    df = spark.createDataFrame([("t", 0, 0.5), ("t", 1, 0.9), ("t", 2, 0.9)],
                               "task string, layer int, score double")
    assert reports.best_layer(df, ["task"]).first().best_layer == 1


def test_bootstrap_sizes(spark):
    df = spark.range(50).select(F.col("id"))
    sub = reports.bootstrap_subsample(df, seeds=(0, 1), fraction=0.8)
    counts = {r.seed: r["count"] for r in sub.groupBy("seed").count().collect()}
    assert counts == {0: 40, 1: 40}
