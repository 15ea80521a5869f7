"""Surface features (T6-T16): eight scalars per text plus a hashed character
n-gram vector.

The scalars are column expressions over whole texts (no Python).  The n-gram
vector hashes every overlapping n-gram of a batch of texts from one array of
code points (a polynomial hash, exact integer arithmetic that SQL can repeat)
and counts the buckets of all its texts at once; nothing is shuffled.  Python's
salted ``hash`` cannot be reproduced, so any deterministic hash is as faithful;
this one creates no per-n-gram strings and no digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx

SCALAR_FEATURES = ["text_length", "punctuation_density", "special_char_count", "token_count",
                   "token_top_frequency", "token_unique_ratio", "lexical_overlap",
                   "domain_vocab_hits"]
NGRAM_DIM = 256
NGRAM_SIZES = (1, 2, 3)


def surface_scalars(df: DataFrame, *, vocabulary: list[str] | None = None,
                    text_col: str = "text", pair_col: str = "text_pair") -> DataFrame:
    """T7-T14 as columns next to the input columns."""
    tok = tx.tokens(text_col)
    has_pair = pair_col in df.columns
    pair_tok = (F.when(F.col(pair_col).isNotNull() & (F.col(pair_col) != ""),
                       tx.tokens(pair_col)) if has_pair else F.lit(None).cast("array<string>"))
    with_tok = df.withColumn("_tok", tok).withColumn("_ptok", pair_tok)
    t = F.col(text_col)
    return with_tok.select(
        *[c for c in df.columns if c not in SCALAR_FEATURES],
        F.length(t).alias("text_length"),
        tx.punctuation_density(t).alias("punctuation_density"),
        tx.special_char_count(t).alias("special_char_count"),
        F.size("_tok").alias("token_count"),
        tx.token_top_frequency(F.col("_tok")).alias("token_top_frequency"),
        tx.token_unique_ratio(F.col("_tok")).alias("token_unique_ratio"),
        tx.lexical_overlap(F.col("_tok"), F.col("_ptok")).alias("lexical_overlap"),
        tx.domain_vocab_hits(t, vocabulary or []).alias("domain_vocab_hits"),
    )


# Fixed parameters of the n-gram hash (ours; the reference's salted Python
# hash cannot be reproduced): h(c1) = c1, h(c1..ck) = (h(c1..ck-1) * P + ck) mod M
# over code points, bucket = h mod dim.
NGRAM_HASH_P = 1000003
NGRAM_HASH_M = 2147483647


def ngram_kernel(dim: int, sizes=NGRAM_SIZES, weights=None):
    """A function of a batch of lower-cased texts: their n-gram vectors, or,
    with ``weights`` (dim x outputs), the products with that matrix.

    The code points of many texts stand in one array; hashes of all n-grams
    come from shifted views of it and one ``bincount`` counts the buckets of
    all texts.  A longer text is cut into blocks that overlap by the longest
    n-gram, so memory is bounded by the block.  Everything the function needs is
    inside it, so workers need no import of this package."""
    p, m = NGRAM_HASH_P, NGRAM_HASH_M
    block = 1 << 20

    def vectors(texts):
        import numpy as np
        import pandas as pd

        longest = max(sizes)
        counts = np.zeros((len(texts), dim))

        def add(rows, parts, starts):
            """Count n-grams that begin in the first ``starts`` code points of each part."""
            cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            lengths = np.array([len(x) for x in parts])
            ends = np.repeat(np.cumsum(lengths), lengths)
            begun = np.arange(len(cps)) - (ends - np.repeat(lengths, lengths)) < np.repeat(starts, lengths)
            local = np.repeat(np.arange(len(parts)), lengths)
            total = np.zeros(len(parts) * dim, dtype=np.int64)
            h = cps
            for n in range(1, longest + 1):
                if n > 1:
                    h = (h[:-1] * p + cps[n - 1:]) % m
                if n in sizes:
                    own = np.flatnonzero((np.arange(len(h)) + n <= ends[:len(h)]) & begun[:len(h)])
                    total += np.bincount(local[own] * dim + h[own] % dim, minlength=len(total))
            np.add.at(counts, rows, total.reshape(len(parts), dim))

        rows, parts, held = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > block:
                for at in range(0, len(text), block):
                    add([i], [text[at:at + block + longest - 1]], np.array([min(block, len(text) - at)]))
                continue
            rows.append(i)
            parts.append(text)
            held += len(text)
            if held >= block:
                add(rows, parts, np.array([len(x) for x in parts]))
                rows, parts, held = [], [], 0
        if rows:
            add(rows, parts, np.array([len(x) for x in parts]))
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        return pd.Series(list(unit if weights is None else unit @ weights))

    return vectors


def ngram_vector(text, dim: int = NGRAM_DIM, sizes=NGRAM_SIZES, weights=None) -> Column:
    """T15 as a column: the L2-normalized bucket counts of a text's n-grams
    (all zero for an empty or null text), or their product with ``weights``."""
    kernel = F.pandas_udf(ngram_kernel(dim, tuple(sizes), weights), "array<double>")
    return kernel(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def ngram_bucket(gram: Column, dim: int = NGRAM_DIM) -> Column:
    """Bucket of a whole string (used for word tokens): md5 as a 32-bit number."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def char_ngram_vectors(df: DataFrame, *, id_col: str = "record_id", text_col: str = "text",
                       dim: int = NGRAM_DIM, sizes=NGRAM_SIZES) -> DataFrame:
    """T15 in long form: (id, bucket, value) for non-zero buckets, L2-normalized.
    Map-only: no row leaves its partition."""
    dense = df.select(id_col, ngram_vector(text_col, dim, sizes).alias("_v"))
    return dense.select(id_col, F.posexplode("_v").alias("bucket", "value")).filter(F.col("value") > 0)


def feature_vectors(df: DataFrame, *, vocabulary: list[str] | None = None,
                    id_col: str = "record_id", dim: int = NGRAM_DIM) -> DataFrame:
    """The input's columns and features ARRAY<DOUBLE> = 8 scalars ++ ``dim``
    n-gram values, in one pass over the rows."""
    scal = surface_scalars(df, vocabulary=vocabulary)
    return scal.select(
        *df.columns,
        F.concat(F.array(*[F.col(c).cast("double") for c in SCALAR_FEATURES]),
                 ngram_vector("text", dim)).alias("features"))
