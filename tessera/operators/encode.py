"""Text encoding stand-in and sentence-level pooling.

No model runtime ships with the library.  ``encode_texts`` is the default
encoder: hashed character n-gram counts (T15) projected by one fixed random
matrix per layer.  The matrices are generated from a seed (layers x buckets x
dim doubles -- bounded by the encoder shape) and sent with the function.  ``encode_with`` plugs in any real encoder through
``mapInPandas`` (Arrow batches, one batch per call).

``sentence_pool`` is the V7 rule over word tokens: each sentence gets a share
of the token positions proportional to its own token count (at least one,
half-even rounding), segments are consecutive, a segment's vector is the mean
of its token vectors and an empty segment falls back to the mean of all
tokens.  A token's state is its hash bucket's row of the layers' matrices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import surface
from tessera.session import ship_package

N_LAYERS = 4
DIM = 16
SEED = 7
#: Segments whose vectors a pooling task holds before it hands them on.
POOL_ROWS = 4096


def projection_matrix(*, n_layers: int = N_LAYERS, dim: int = DIM, buckets: int = surface.NGRAM_DIM,
                      seed: int = SEED) -> np.ndarray:
    """The matrices of all layers side by side: buckets x (layers * dim)."""
    rng = np.random.default_rng(seed)
    return np.hstack([rng.standard_normal((buckets, dim)) / np.sqrt(buckets) for _ in range(n_layers)])


def encode_texts(df: DataFrame, *, id_col: str = "record_id", text_col: str = "text",
                 n_layers: int = N_LAYERS, dim: int = DIM) -> DataFrame:
    """I1 default encoder: (id, layer, vec) for every text, all layers.  Map-only:
    one matrix product per batch gives all layers; a text without characters
    has zero vectors."""
    flat = df.select(id_col, surface.ngram_vector(
        text_col, weights=projection_matrix(n_layers=n_layers, dim=dim)).alias("_v"))
    return flat.select(id_col, F.posexplode(F.array(*[
        F.slice("_v", layer * dim + 1, dim) for layer in range(n_layers)])).alias("layer", "vec"))


def encode_with(df: DataFrame, encoder, *, id_col: str = "record_id", text_col: str = "text",
                pair_col: str | None = None) -> DataFrame:
    """I1 with a pluggable encoder ``encoder(texts, pairs) -> list[list[list[float]]]``
    (per text: one vector per layer), applied per Arrow batch."""
    import pandas as pd

    cols = [id_col, text_col] + ([pair_col] if pair_col else [])

    def run(batches):
        for pdf in batches:
            pairs = pdf[pair_col].tolist() if pair_col else None
            out = encoder(pdf[text_col].tolist(), pairs)
            ids, layers, vecs = [], [], []
            for rid, per_layer in zip(pdf[id_col].tolist(), out):
                for layer, v in enumerate(per_layer):
                    ids.append(rid)
                    layers.append(layer)
                    vecs.append([float(x) for x in v])
            yield pd.DataFrame({id_col: ids, "layer": layers, "vec": vecs})

    return df.select(*cols).mapInPandas(run, f"{id_col} string, layer int, vec array<double>")


def segment_bounds(sizes, n_tokens: int):
    """(start, end) token positions of consecutive segments (V7).

    Each segment gets a share of the tokens in proportion to its size, rounded
    half to even and at least one, until none is left.  As every share is at
    least one, the ends are the shares' running sum, cut at ``n_tokens``."""
    sizes = np.maximum(np.asarray(sizes, dtype=np.int64), 1)
    shares = np.maximum(1, np.rint(sizes * n_tokens / sizes.sum()).astype(np.int64))
    ends = np.minimum(np.cumsum(shares), n_tokens)
    return np.concatenate([[0], ends[:-1]]), ends


def segment_means(states: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean state of each segment as a difference of running sums; an empty
    segment has the mean of all."""
    sums = np.vstack([np.zeros((1, states.shape[1])), np.cumsum(states, axis=0)])
    lengths = (ends - starts)[:, None]
    return np.where(lengths > 0, (sums[ends] - sums[starts]) / np.maximum(lengths, 1), sums[-1] / len(states))


def token_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """``surface.ngram_bucket`` of every word, hashed once per distinct word."""
    coded = words.dictionary_encode()
    found = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % buckets for w in coded.dictionary.to_pylist()]
    return np.array(found, dtype=np.int64)[coded.indices.to_numpy()]


def sentence_pool(df: DataFrame, *, id_col: str = "record_id", text_col: str = "text",
                  n_layers: int = N_LAYERS, dim: int = DIM, normalized: bool = False) -> DataFrame:
    """V7: (id, layer, seg, vec) -- one vector per sentence and layer; a text
    without tokens has one zero vector per layer.  ``normalized``: see
    ``text.with_sentences``.

    A segmented reduction inside the row: the words of a text are cut once, by
    sentence, and its segments' means come from running sums over its token
    states.  No token becomes a row, nothing is shuffled, and at most
    ``POOL_ROWS`` segments and one text are held at a time."""
    ship_package(df.sparkSession)
    weights = projection_matrix(n_layers=n_layers, dim=dim)
    width = weights.shape[1]

    def packed(owners, held, ids):
        sizes, vecs = list(map(len, held)), np.concatenate(held)
        offsets = np.arange(len(vecs) + 1, dtype=np.int32) * width
        return pa.RecordBatch.from_arrays([
            ids.take(pa.array(np.repeat(owners, sizes))),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(vecs.ravel()))], [id_col, "seg", "_v"])

    def pooled(batches):
        for batch in batches:
            texts, ids = batch.column("_words"), batch.column(id_col)
            sentences, words = texts.offsets.to_numpy(), texts.values
            cuts, own = words.offsets.to_numpy(), token_buckets(words.values, len(weights))
            owners, held, n = [], [], 0
            for i in range(len(texts)):
                at = cuts[sentences[i]:sentences[i + 1] + 1]
                start, end = at[0], at[-1]
                held.append(np.zeros((1, width)) if start == end else segment_means(
                    weights[own[start:end]], *segment_bounds(np.diff(at), end - start)))
                owners.append(i)
                n += len(held[-1])
                if n >= POOL_ROWS:
                    yield packed(owners, held, ids)
                    owners, held, n = [], [], 0
            if held:
                yield packed(owners, held, ids)

    # a word token never straddles a sentence break (breaks are whitespace)
    sent = tx.with_sentences(df.select(id_col, text_col), text_col, "_sent", normalized)
    cut = sent.select(id_col, F.transform("_sent", tx.tokens).alias("_words"))
    segments = cut.mapInArrow(
        pooled, f"`{id_col}` {cut.schema[id_col].dataType.simpleString()}, seg int, _v array<double>")
    return segments.select(id_col, F.posexplode(F.array(*[
        F.slice("_v", layer * dim + 1, dim) for layer in range(n_layers)])).alias("layer", "vec"), "seg")
