"""Vector operators: properties on small frames."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import decompose as DC
from tessera.operators import probes
from tessera.operators import vectors as VO


def _vecs(spark, n=60, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    rows = [(i, int(i % 3), 0, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, layer int, vec array<double>"), x


def test_l2_unit_norms(spark):
    v, _ = _vecs(spark)
    norms = VO.l2_normalize(v).select(VO.V.norm("vec").alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_project_out_orthonormal_is_idempotent(spark):
    v, _ = _vecs(spark)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((6, 2)))
    dirs = spark.createDataFrame([(0, k, [float(x) for x in q[:, k]]) for k in range(2)],
                                 "layer int, k int, vec array<double>")
    once = VO.project_out(v, dirs, n_drop=2)
    twice = VO.project_out(once, dirs, n_drop=2)
    a = {r.id: r.vec for r in once.collect()}
    b = {r.id: r.vec for r in twice.collect()}
    assert all(np.allclose(a[i], b[i], atol=1e-12) for i in a)


def test_null_space_leaves_zero_projection(spark):
    v, _ = _vecs(spark)
    w = np.random.default_rng(2).standard_normal((2, 6))
    dirs = spark.createDataFrame([(0, k, [float(x) for x in w[k]]) for k in range(2)],
                                 "layer int, k int, vec array<double>")
    out = np.array([r.vec for r in DC.null_space_remove(v, dirs).collect()])
    assert np.abs(out @ w.T).max() < 1e-9


def test_null_space_equals_the_projection_matrix(spark):
    """Dependent and zero directions, and a layer without any."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 6))
    w = rng.standard_normal((2, 6))
    w = np.vstack([w, w[0] - 2 * w[1], np.zeros(6)])
    v = spark.createDataFrame([(i, layer, [float(a) for a in x[i]]) for i in range(30) for layer in (0, 1)],
                              "id long, layer int, vec array<double>")
    dirs = spark.createDataFrame([(0, k, [float(a) for a in w[k]]) for k in range(4)],
                                 "layer int, k int, vec array<double>")
    want = x @ (np.eye(6) - w.T @ np.linalg.pinv(w @ w.T, rcond=1e-12) @ w)
    got = {(r.id, r.layer): r.vec for r in DC.null_space_remove(v, dirs).collect()}
    assert all(np.allclose(got[i, 0], want[i], atol=1e-8) and np.allclose(got[i, 1], x[i]) for i in range(30))


def test_center_and_scale_zero_variance(spark):
    rows = [(i, 0, 0, [float(i), 5.0]) for i in range(10)]
    v = spark.createDataFrame(rows, "id long, label int, layer int, vec array<double>")
    s = np.array([r.vec for r in VO.standard_scale(v).collect()])
    assert np.allclose(s[:, 1], 0.0) and abs(s[:, 0].std() - 1) < 1e-9


def test_pooling_unknown_name(spark):
    v, _ = _vecs(spark)
    try:
        VO.pool(v, "median")
        raise AssertionError
    except ValueError:
        pass


def test_pca_matches_numpy(spark):
    v, x = _vecs(spark, n=80, d=5)
    comps = DC.pca_components(v, k=3).orderBy("k").collect()
    xc = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    ratio = (s ** 2) / (s ** 2).sum()
    for r in comps:
        ref = vt[r.k] * np.sign(vt[r.k][np.argmax(np.abs(vt[r.k]))])
        assert np.allclose(r.vec, ref, atol=1e-6)
        assert abs(r.explained_variance_ratio - ratio[r.k]) < 1e-6


def test_scale_on_train_uses_population_std(spark):
    v, x = _vecs(spark, n=30, d=3)
    v = v.withColumn("partition", F.lit("train"))
    s = np.array([r.vec for r in probes.scale_on_train(v).orderBy("id").collect()])
    assert np.allclose(s, (x - x.mean(0)) / x.std(0), atol=1e-9)
