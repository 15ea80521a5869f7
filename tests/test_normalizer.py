"""Normalizations fitted on some rows and applied to others."""

import numpy as np
import pytest

from tessera.functions import labels
from tessera.operators import normalizer

VECS = "id int, layer int, vec array<double>, note string"


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(3)
    mix = rnd.normal(size=(2, 5, 5))
    rows = [(i, layer, (rnd.normal(size=5) @ mix[layer] + layer).tolist(), f"n{i}")
            for i in range(60) for layer in (0, 1)]
    return rows, spark.createDataFrame(rows, VECS)


def _matrices(rows, keep):
    return {layer: np.array([v for i, at, v, _ in rows if at == layer and keep(i)]) for layer in (0, 1)}


def _got(df):
    return {layer: np.array([r.vec for r in sorted(df.collect(), key=lambda r: r.id) if r.layer == layer])
            for layer in (0, 1)}


@pytest.mark.parametrize("method", ["center", "pca_remove", "whitening"])
def test_fit_on_train_apply_to_others(spark, data, tmp_path, method):
    rows, df = data
    path = str(tmp_path)
    normalizer.save(normalizer.fit(df.filter("id < 40"), method, k=2), path, "v1")
    normalizer.save(normalizer.fit(df, method, k=2), path, "v2")
    out = normalizer.transform(df.filter("id >= 40"), method, normalizer.load(spark, path, "v1"))
    assert out.columns == df.columns
    got, train, rest = _got(out), _matrices(rows, lambda i: i < 40), _matrices(rows, lambda i: i >= 40)
    for layer in (0, 1):
        mean = train[layer].mean(axis=0)
        x = rest[layer] - mean
        basis = np.linalg.svd(train[layer] - mean, full_matrices=False)[2][:2]
        basis *= np.sign(basis[np.arange(2), np.abs(basis).argmax(axis=1)])[:, None]
        z = x @ basis.T
        want = {"center": x, "pca_remove": x - z @ basis, "whitening": z / z.std(axis=0)}[method]
        assert np.allclose(got[layer], want, atol=1e-8)


def test_methods_without_state_and_unknown_ones(spark, data):
    _, df = data
    assert normalizer.fit(df, "l2").count() == 0
    assert normalizer.transform(df, "none", normalizer.fit(df, "none")) is df
    lengths = [np.linalg.norm(r.vec) for r in normalizer.transform(df, "l2", normalizer.fit(df, "l2")).collect()]
    assert np.allclose(lengths, 1)
    for call in (lambda: normalizer.fit(df, "other"), lambda: normalizer.transform(df, "other", df)):
        with pytest.raises(ValueError, match="other"):
            call()


@pytest.mark.parametrize("method", ["center", "whitening", "pca_remove"])
def test_layer_without_state_and_empty_tables(spark, data, method):
    _, df = data
    state = normalizer.fit(df.filter("layer = 0"), method, k=2)
    out = normalizer.transform(df, method, state)
    assert out.count() == df.count()
    assert out.filter("vec IS NULL").count() == out.filter("layer = 1").count()
    assert normalizer.transform(df.filter("id < 0"), method, state).count() == 0
    assert normalizer.fit(df.filter("id < 0"), method).count() == 0


def test_int_lists(spark):
    df = spark.createDataFrame([(3, "4", [1, None], ["5", "x"]), (None, "y", None, None)],
                               "a int, b string, c array<int>, d array<string>")
    got = df.select(*(labels.to_int_list(df, c).alias(c) for c in df.columns)).collect()
    assert tuple(got[0]) == ([3], [4], [1, None], [5, None]) and tuple(got[1]) == ([], [], [], [])
