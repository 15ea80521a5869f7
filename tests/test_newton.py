"""Batched Newton fits against dense solutions (M2, M3, M7)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import newton, probes


def _dense(x, y, loss, weight, steps=200):
    """Damped dense Newton of one group."""
    xa = np.hstack([x, np.ones((len(x), 1))])
    coef = np.zeros((y.shape[1], xa.shape[1]))
    pen = np.ones(xa.shape[1])
    pen[-1] = 1.0 if loss == "squared_hinge" else 0.0

    def value(c):
        f = xa @ c.T
        if loss == "squared_hinge":
            v = (weight[:, None] * np.maximum(0, 1 - y * f) ** 2).sum(axis=0)
        else:
            v = (weight[:, None] * (np.logaddexp(0, f) - y * f)).sum(axis=0)
        return v + 0.5 * (c * c * pen).sum(axis=1)

    for k in range(len(coef)):
        for _ in range(steps):
            f = xa @ coef[k]
            if loss == "squared_hinge":
                gap = np.maximum(0, 1 - y[:, k] * f)
                g, h = xa.T @ (-2 * weight * gap * y[:, k]), xa.T @ (xa * (2 * weight * (gap > 0))[:, None])
            else:
                p = 1 / (1 + np.exp(-f))
                g, h = xa.T @ (weight * (p - y[:, k])), xa.T @ (xa * (weight * p * (1 - p))[:, None])
            step = np.linalg.solve(h + np.diag(pen), g + coef[k] * pen)
            t, trial = 1.0, coef.copy()
            while t > 1e-12:
                trial[k] = coef[k] - t * step
                if value(trial)[k] <= value(coef)[k]:
                    break
                t /= 2
            coef[k] = trial[k]
    return coef


def _rows(spark, groups):
    data = [(g, x[i].tolist(), y[i].tolist(), float(w[i])) for g, (x, y, w) in groups.items() for i in range(len(x))]
    return spark.createDataFrame(data, "`group` long, x array<double>, y array<double>, weight double").repartition(3)


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_all_groups_match_dense_newton(spark, loss):
    rng = np.random.default_rng(3)
    groups = {}
    for g, (n, d, k) in {5: (120, 3, 4), 9: (80, 6, 2), 11: (40, 1, 1)}.items():
        x = rng.standard_normal((n, d)) * rng.uniform(0.2, 5, d)
        y = (x @ rng.standard_normal((d, k)) + rng.standard_normal((n, k)) > 0.4).astype(float)
        groups[g] = (x, 2 * y - 1 if loss == "squared_hinge" else y, rng.integers(0, 3, n).astype(float))
    fits = newton.fit(_rows(spark, groups), loss, {g: (y.shape[1], x.shape[1]) for g, (x, y, _) in groups.items()})
    for g, (x, y, w) in groups.items():
        assert fits[g].converged and fits[g].iterations < 40
        assert np.allclose(fits[g].coef, _dense(x, y, loss, w), atol=1e-6)


def test_softmax_has_no_gradient_left(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 3))
    y = np.eye(4)[np.argmax(x @ rng.standard_normal((3, 4)) + rng.standard_normal((150, 4)), axis=1)]
    found = newton.fit(_rows(spark, {0: (x, y, np.ones(150))}), "softmax", {0: (4, 3)})[0]
    xa = np.hstack([x, np.ones((150, 1))])
    p = np.exp(xa @ found.coef.T)
    p /= p.sum(axis=1, keepdims=True)
    gradient = (p - y).T @ xa + found.coef * np.array([1, 1, 1, 0])
    assert found.converged and np.abs(gradient).max() < 1e-5


def test_groups_without_rows_and_unknown_losses(spark):
    rows = _rows(spark, {0: (np.ones((2, 1)), np.array([[1.0], [-1.0]]), np.ones(2))})
    assert np.allclose(newton.fit(rows, "squared_hinge", {0: (1, 1), 7: (1, 1)})[7].coef, 0)
    with pytest.raises(ValueError):
        newton.fit(rows, "hinge", {0: (1, 1)})


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, layer int, vec array<double>, label int, partition string")


def test_probes_of_all_layers_at_once(spark):
    """Layers of different widths and class counts; a layer with one class predicts it."""
    rng = np.random.default_rng(5)
    rows = []
    for layer, (d, k) in {0: (2, 3), 1: (4, 2), 2: (3, 1)}.items():
        for i in range(90):
            c = i % k
            rows.append((i, layer, (rng.standard_normal(d) * 0.1 + c * 3).tolist(), c, "test" if i // 6 % 3 == 0 else "train"))
    for estimator in ("svm", "logistic"):
        scores, pred = probes.probe_layers(_vectors(spark, rows), estimator=estimator, strict_test_coverage=False)
        got = {(r.layer, r.metric): r.value for r in scores.collect()}
        assert pred.count() == 90
        for layer in (0, 1, 2):
            assert got[layer, "accuracy"] == 1.0
        assert got[1, "roc_auc"] == 1.0
        cells = probes.probe_confusion(pred).filter("layer = 0").collect()
        assert sum(r.n for r in cells) == 30 and all(r.y == r.pred for r in cells)


def test_probe_falls_back_to_a_seeded_split(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, (rng.standard_normal(2) + 4 * (i % 2)).tolist(), i % 2, "") for i in range(100)]
    vecs = _vectors(spark, rows).drop("partition")
    _, a = probes.probe_layers(vecs)
    _, b = probes.probe_layers(vecs)
    assert 0 < a.count() < 100
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())


def test_labels_that_are_constant_in_train(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 0, rng.standard_normal(2).tolist(), i % 2, "test" if i // 2 % 4 == 0 else "train") for i in range(80)]
    vecs = _vectors(spark, rows).withColumn("labels", F.array((F.col("vec")[0] > 0).cast("int"), F.lit(0), F.lit(1)))
    _, pred = probes.probe_layers_multilabel(vecs, n_labels=3)
    out = pred.collect()
    assert len(out) == 20 and all(r.pred[1] == 0 and r.pred[2] == 1 for r in out)
    assert sum(r.pred[0] == r.y[0] for r in out) >= 18
