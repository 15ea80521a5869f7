"""Sentence segments and pooling (V7), the n-gram kernel (T15, T16) and the encoder."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import encode, surface


@pytest.mark.parametrize("sizes, n, ends", [
    ([1], 7, [7]), ([2, 2], 4, [2, 4]), ([1, 1], 5, [2, 4]), ([1, 1], 3, [2, 3]),  # halves to even: 2.5 -> 2, 1.5 -> 2
    ([5, 1, 1], 2, [1, 2, 2]), ([0, 4], 4, [1, 4]), ([3, 0, 3], 6, [3, 4, 6]), ([1, 1, 1], 1, [1, 1, 1])])
def test_segment_ends(sizes, n, ends):
    starts, got = encode.segment_bounds(sizes, n)
    assert got.tolist() == ends and starts.tolist() == [0, *ends[:-1]]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 400))
def test_segments_are_consecutive_shares(sizes, n):
    starts, ends = encode.segment_bounds(sizes, n)
    total = sum(max(1, s) for s in sizes)
    assert starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] <= n
    for size, start, end in zip(sizes, starts.tolist(), ends.tolist()):
        share = Fraction(max(1, size) * n, total)
        assert end == n or (end - start >= 1 and abs(end - start - max(share, 1)) <= Fraction(1, 2))


@given(st.lists(st.integers(0, 9), min_size=1, max_size=8), st.integers(1, 40))
def test_segment_means(sizes, n):
    states = np.random.default_rng(n).standard_normal((n, 3))
    starts, ends = encode.segment_bounds(sizes, n)
    want = [states[a:b].mean(axis=0) if b > a else states.mean(axis=0) for a, b in zip(starts, ends)]
    assert np.allclose(encode.segment_means(states, starts, ends), want)


def test_pooling_of_texts(spark):
    df = spark.createDataFrame([("a", "One two. Three four five! Six?"), ("b", "..."), ("c", "same same"), ("d", "same")],
                               "record_id string, text string")
    out = encode.sentence_pool(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.record_id, r.layer, r.seg): r.vec for r in out.collect()}
    assert {k[0]: sum(1 for x in got if x[0] == k[0] and x[1] == 0) for k in got} == {"a": 3, "b": 1, "c": 1, "d": 1}
    assert all(v == 0 for v in got["b", 2, 0])
    assert np.allclose(got["c", 1, 0], got["d", 1, 0])


def _buckets(text, dim):
    c = [ord(x) for x in text]
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            h = c[i]
            for k in range(1, n):
                h = (h * surface.NGRAM_HASH_P + c[i + k]) % surface.NGRAM_HASH_M
            found[h % dim] += 1
    norm = sum(v * v for v in found.values()) ** 0.5
    return {b: v / norm for b, v in found.items()}


def test_ngrams_of_short_empty_and_long_texts(spark):
    long = "abcdé🙂 " * 200_000  # more than one block of the kernel
    texts = ["", None, "a", "ab", "日本語 text", long, "tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id int, text string").coalesce(1)
    found = surface.char_ngram_vectors(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.record_id, {})[r.bucket] = r.value
    for i, text in enumerate(texts):
        want = _buckets(text or "", 256)
        assert set(got.get(i, {})) == set(want)
        assert all(abs(got[i][b] - v) < 1e-12 for b, v in want.items())


def test_features_and_encoder_are_map_only(spark):
    df = spark.createDataFrame([("a", "Hello world."), ("b", "Zwei Sätze. Hier!"), ("c", "")],
                               "record_id string, text string")
    feats = surface.feature_vectors(df)
    vecs = encode.encode_texts(df)
    for out in (feats, vecs):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(len(r.features) == 264 for r in feats.collect())
    rows = {(r.record_id, r.layer): r.vec for r in vecs.collect()}
    assert len(rows) == 12 and all(len(v) == encode.DIM for v in rows.values())
    grams = np.zeros(256)
    for b, v in _buckets("hello world.", 256).items():
        grams[b] = v
    matrix = encode.projection_matrix()
    assert np.allclose(rows["a", 2], grams @ matrix[:, 2 * encode.DIM:3 * encode.DIM])


def test_plugged_in_encoder(spark):
    df = spark.createDataFrame([("a", "x", "y"), ("b", "zz", None)], "record_id string, text string, text_pair string")
    out = encode.encode_with(df, lambda texts, pairs: [[[float(len(t))], [float(len(p or ""))]] for t, p in zip(texts, pairs)],
                             pair_col="text_pair")
    assert {(r.record_id, r.layer, r.vec[0]) for r in out.collect()} == {("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 2.0), ("b", 1, 0.0)}
    assert out.agg(F.count("vec")).first()[0] == 4


def test_word_buckets_are_those_of_the_column(spark):
    words = ["a", "B", "größe", "日本", "a", "İx"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    want = [r[0] for r in df.orderBy("i").select(surface.ngram_bucket(F.col("w")).cast("int")).collect()]
    assert encode.token_buckets(pa.array(words), surface.NGRAM_DIM).tolist() == want
    assert encode.token_buckets(pa.array([], pa.string()), 256).tolist() == []


def test_pooling_of_normalized_and_long_texts(spark):
    long = " ".join(f"w{i % 97} v{i % 5}." for i in range(2 * encode.POOL_ROWS))
    texts = ["", "Ab c. d? E! f", "a. . b.", "x.y z", "ΟΔΟΣ. Σ!", long]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, text string").coalesce(1)
    key = ["record_id", "layer", "seg"]
    plain = encode.sentence_pool(df).orderBy(*key).collect()
    assert plain == encode.sentence_pool(df, normalized=True).orderBy(*key).collect()
    assert sum(r.record_id == "5" and r.layer == 0 for r in plain) == 2 * encode.POOL_ROWS
